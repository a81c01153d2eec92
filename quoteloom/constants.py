"""Fixed values of the engine's semantics."""

# Ranking.
BM25_K1, BM25_B = 1.5, 0.75
TOP_K = 6
COVERAGE_FLOOR = 0.34

# Passages, in characters.
CHUNK_TARGET, CHUNK_OVERLAP, CHUNK_MIN = 1100, 200, 120

# Quotes, after folding.
MIN_QUOTE_WORDS, MIN_QUOTE_CHARS = 4, 16

# Token estimates and output allowances.
CHARS_PER_TOKEN, MESSAGE_OVERHEAD, REQUEST_OVERHEAD = 3.6, 4, 3
DRAFT_OUTPUT, VERDICT_OUTPUT, OUTPUT_ESCALATION = 900, 160, 2

# Scheduling, in tokens and milliseconds.
CONCURRENCY, WINDOW_TOKENS, WINDOW_MS, MAX_ATTEMPTS = 100, 8000, 60_000, 5
BACKOFF_BASE_MS, BACKOFF_MAX_MS, RETRY_JITTER_MS = 500, 30_000, 1000
CONCURRENCY_MOST, WINDOW_TOKENS_LEAST = 200, 500

# Admission of requests, documents and fetched bodies.
MAX_DOCS, MAX_QUESTIONS, MIN_QUESTION, MAX_QUESTION = 20, 25, 3, 500
MAX_DOC_CHARS, MAX_CORPUS_CHARS, MAX_BODY_BYTES, MAX_CLAIMS = 400_000, 1_200_000, 2_000_000, 250
MAX_TITLE_CHARS, MAX_URL_CHARS, MAX_TOP_K, MAX_WINDOW_TOKENS = 200, 2048, 20, 1_000_000
MAX_REDIRECTS = 4
MIN_CONTEXT_WINDOW = 8192

# HTML.
MAIN_REGION_CHARS, LINK_CHARS, LINK_WORDS, LINK_RUN = 500, 28, 4, 4
HIGHLIGHT_CHARS = 1400

# Reasons for withholding a sentence, and the order they are reported in.
REASONS = ("no_citation", "missing_source", "quote_too_short", "quote_not_found", "not_entailed", "check_failed")

# Task states, in display order.
STATES = ("running", "retrying", "waiting-budget", "queued", "done", "failed", "cancelled")

# Words without weight in ranking.
STOPWORDS = tuple(
    "a an and are as at be been but by do does for from had has have he her his how i in into is it its of on or she "
    "that the their them there these they this to was were what when where which who why will with you your".split()
)

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = tuple(
    "mr mrs ms dr prof sr jr st mt rev hon inc ltd co corp dept est fig no vol op approx etc vs al eg ie cf ca circa "
    "jan feb mar apr jun jul aug sep sept oct nov dec".split()
)

# Named character references that are decoded.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "mdash": "—", "ndash": "–", "hellip": "…",
    "rsquo": "’", "lsquo": "‘", "ldquo": "“", "rdquo": "”", "middot": "·", "deg": "°", "amp": "&",
}

#: White space as in ECMAScript, as the inside of a character class.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
