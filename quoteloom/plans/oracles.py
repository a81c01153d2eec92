"""DuckDB SQL with the same rows as the registered queries.

Word lists, networks, element names and frames of prompts are the engine's own,
imported: a wrong entry would be wrong on both sides.  Tests of the functions
that use them hold them against literal outcomes.
"""

from __future__ import annotations

import re

from ..constants import ABBREVIATIONS, ENTITIES, REASONS, STATES, STOPWORDS
from ..functions.html import BLOCKS, DROPPED, REGIONS
from ..functions.url import BLOCKED_V4
from ..operators.answers import DRAFT_RULES, FRAME_END, PASSAGE_FRAME, PASSAGES_FRAME, QUESTION_FRAME, STATEMENT_FRAME, VERDICT_RULES
from ..operators.models import NOT_CHAT
from .fixtures import EVENT_STATES, KINDS, LITERALS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(map(_text, values)) + ")"


def _fold(text: str) -> str:
    return f"trim(regexp_replace(lower(strip_accents({text})), '[^a-z0-9]+', ' ', 'g'))"


def _tokens(text: str) -> str:
    return f"list_filter(string_split({_fold(text)}, ' '), lambda w: length(w) > 1 AND w NOT IN {_list(STOPWORDS)})"


_WORDS = f"len(string_split({_fold('text')}, ' '))"

#: Sentences: runs of closing characters that hold a real terminator and precede white space are cuts.
_SENTENCES = f"""
  chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents),
  flagged AS (SELECT *, c IN ('.', '!', '?', '"', '''', '’', '”', ')', ']') AS closing,
                     lead(c) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM chars),
  runs AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM flagged WHERE closing),
  spans AS (SELECT doc_id, min(i) AS a, max(i) AS z, arg_max(after, i) AS after,
                   bool_or(c IN ('!', '?')) AS strong, count(*) FILTER (c = '.') AS stops, arg_min(c, i) AS first
            FROM runs GROUP BY doc_id, run),
  words AS (SELECT s.*, regexp_extract(substr(d.text, greatest(1, s.a - 12)::INT, (s.a - greatest(1, s.a - 12))::INT), '[A-Za-z]+$') AS word
            FROM spans s JOIN documents d USING (doc_id)),
  cuts AS (SELECT doc_id, z AS cut FROM words
           WHERE (after IS NULL OR after IN (' ', chr(10), chr(13), chr(9)))
             AND (strong OR stops > CASE WHEN first = '.' AND (length(word) = 1 OR lower(word) IN {_list(ABBREVIATIONS)}) THEN 1 ELSE 0 END)
           UNION SELECT doc_id, length(text) FROM documents UNION SELECT doc_id, 0 FROM documents),
  pieces AS (SELECT doc_id, lag(cut) OVER (PARTITION BY doc_id ORDER BY cut) AS a, cut AS z FROM cuts),
  raw AS (SELECT p.doc_id, p.a, substr(d.text, (p.a + 1)::INT, (p.z - p.a)::INT) AS piece FROM pieces p JOIN documents d USING (doc_id) WHERE p.a IS NOT NULL),
  trimmed AS (SELECT doc_id, a + length(piece) - length(regexp_replace(piece, '^\\s+', '')) AS s, regexp_replace(piece, '^\\s+|\\s+$', '', 'g') AS sentence FROM raw),
  sentences AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS idx, s AS start, s + length(sentence) AS "end", sentence
                FROM trimmed WHERE sentence <> '')"""

#: Passages of documents without blank lines: sentences packed in order, one row of state for each.
_CHUNKS = f"""{_SENTENCES},
  many AS (SELECT doc_id, count(*) AS n FROM sentences GROUP BY doc_id),
  segs AS (SELECT doc_id, 0 AS s, length(text) AS e FROM documents WHERE length(text) <= 1100 AND trim(text, E' \\n\\t\\r') <> ''
           UNION ALL SELECT s.doc_id, s.start, s."end" FROM sentences s JOIN many USING (doc_id) JOIN documents d USING (doc_id) WHERE length(d.text) > 1100 AND n > 1
           UNION ALL SELECT doc_id, p, least(p + 1100, length(text)) FROM (SELECT d.doc_id, text, unnest(range(0, length(text), 1100)) AS p FROM documents d JOIN many USING (doc_id)
                                                                          WHERE length(text) > 1100 AND n <= 1)),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM segs),
  packed AS (SELECT doc_id, k, n, s AS cs, e AS ce, NULL::BIGINT AS ds, NULL::BIGINT AS de FROM numbered WHERE k = 1
             UNION ALL
             SELECT p.doc_id, x.k, p.n,
                    CASE WHEN x.e - p.cs <= 1100 THEN p.cs ELSE least(greatest(p.cs, p.ce - 200), x.s) END, x.e,
                    CASE WHEN x.e - p.cs > 1100 THEN p.cs END, CASE WHEN x.e - p.cs > 1100 THEN p.ce END
             FROM packed p JOIN numbered x ON x.doc_id = p.doc_id AND x.k = p.k + 1),
  ranges AS (SELECT doc_id, ds AS s, de AS e FROM packed WHERE ds IS NOT NULL UNION ALL SELECT doc_id, cs, ce FROM packed WHERE k = n),
  placed AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY doc_id) AS m, lead(s) OVER w AS next_s, lead(e) OVER w AS next_e FROM ranges WINDOW w AS (PARTITION BY doc_id ORDER BY s, e)),
  kept AS (SELECT doc_id, s, CASE WHEN r = m - 1 AND next_e - next_s < 120 THEN next_e ELSE e END AS e FROM placed WHERE NOT (r = m AND m > 1 AND e - s < 120)),
  chunks AS (SELECT 'c' || (row_number() OVER (ORDER BY doc_id, s, e) - 1) AS chunk_id, row_number() OVER (ORDER BY doc_id, s, e) AS place, k.doc_id,
                    row_number() OVER (PARTITION BY k.doc_id ORDER BY s, e) - 1 AS idx, s AS start, e AS "end", substr(d.text, (s + 1)::INT, (e - s)::INT) AS text
             FROM kept k JOIN documents d USING (doc_id))"""

_QUESTIONS = f"questions AS (SELECT item_id AS question_id, array_to_string(string_split({_fold('text')}, ' ')[1:12], ' ') AS question FROM benchmark)"


def _search(passages: str, questions: str = "questions") -> str:
    """The best passages, of a table (id, place, text)."""
    return f"""
  bag AS (SELECT id, place, {_tokens("text")} AS terms FROM {passages}),
  stats AS (SELECT count(*) AS n, avg(len(terms)) AS avg_length FROM bag),
  tf AS (SELECT id, place, len(terms) AS size, term, count(*) AS f FROM (SELECT *, unnest(terms) AS term FROM bag) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  asked AS (SELECT DISTINCT question_id, unnest({_tokens("question")}) AS term FROM {questions}),
  sizes AS (SELECT question_id, count(*) AS n_terms FROM asked GROUP BY 1),
  scored AS (SELECT question_id, id, place, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / avg_length))) AS score,
                    count(*)::DOUBLE / any_value(n_terms) AS coverage
             FROM asked JOIN tf USING (term) JOIN df USING (term) JOIN sizes USING (question_id), stats GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(score, 9) DESC, place) AS rank FROM scored)"""


def _verify(words: int = 4, chars: int = 16, relocation: bool = True) -> str:
    """The claims made of benchmark items, checked."""
    far = "" if relocation else "AND false"
    return f"""{_CHUNKS},
  kinds AS (SELECT unnest({list(KINDS)!r}) AS kind, unnest(range({len(KINDS)})) AS k),
  made AS (SELECT item_id * 8 + k AS claim_id, item_id AS question_id, kind,
                  CASE WHEN kind = 'unknown_passage' THEN 'none' ELSE 'c' || (item_id * 13) END AS chunk_id,
                  CASE kind WHEN 'verbatim' THEN text WHEN 'unknown_passage' THEN text WHEN 'upper' THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 'folded' THEN {_fold("text")}
                            WHEN 'tampered' THEN text || ' zzz' WHEN 'short' THEN array_to_string(string_split({_fold("text")}, ' ')[1:3], ' ') WHEN 'blank' THEN ' ' || chr(10) END AS quote
           FROM benchmark, kinds),
  cited AS (SELECT made.*, chunks.doc_id AS cited_doc, {_fold("chunks.text")} AS passage, {_fold("coalesce(quote, '')")} AS folded FROM made LEFT JOIN chunks USING (chunk_id)),
  early AS (SELECT *, CASE WHEN quote IS NULL OR trim(quote, E' \\n') = '' OR chunk_id IS NULL THEN 'no_citation' WHEN cited_doc IS NULL THEN 'missing_source'
                           WHEN length(folded) < {chars} OR len(string_split(folded, ' ')) < {words} THEN 'quote_too_short' END AS reason FROM cited),
  bodies AS (SELECT doc_id, {_fold("text")} AS body FROM documents),
  far AS (SELECT claim_id, arg_min(doc_id, (doc_id <> cited_doc, doc_id)) AS found FROM early JOIN bodies ON contains(body, folded)
          WHERE reason IS NULL AND NOT contains(passage, folded) {far} GROUP BY claim_id),
  verified AS (SELECT early.claim_id, question_id, kind, chunk_id, folded, coalesce(reason, CASE WHEN NOT contains(passage, folded) AND found IS NULL THEN 'quote_not_found' END) AS reason,
                      reason IS NULL AND NOT contains(passage, folded) AND found IS NOT NULL AS relocated,
                      CASE WHEN reason IS NULL THEN CASE WHEN contains(passage, folded) THEN cited_doc ELSE found END END AS span_doc_id
               FROM early LEFT JOIN far USING (claim_id))"""


_VERIFY = _verify()


def _spans(verified: str) -> str:
    """Where quotes of verified claims lie, of a table (claim_id, chunk_id, span_doc_id, relocated, folded): a place for each letter of a source."""
    return f"""
  located AS (SELECT v.claim_id, v.span_doc_id, v.relocated, v.folded, CASE WHEN v.relocated THEN d.text ELSE c.text END AS source, CASE WHEN v.relocated THEN 0 ELSE c.start END AS base
              FROM {verified} v LEFT JOIN chunks c ON c.chunk_id = v.chunk_id LEFT JOIN documents d ON d.doc_id = v.span_doc_id WHERE v.reason IS NULL),
  hits AS (SELECT *, strpos({_fold("source")}, folded) - 1 AS hit FROM located),
  signs AS (SELECT claim_id, unnest(string_split(source, '')) AS c, generate_subscripts(string_split(source, ''), 1) AS i FROM hits),
  letters AS (SELECT claim_id, i, row_number() OVER w AS k, CASE WHEN i - lag(i) OVER w = 1 THEN 0 ELSE 1 END AS opens
              FROM signs WHERE regexp_matches(lower(strip_accents(c)), '^[a-z0-9]$') WINDOW w AS (PARTITION BY claim_id ORDER BY i)),
  folded_at AS (SELECT claim_id, i, k - 2 + sum(opens) OVER (PARTITION BY claim_id ORDER BY k) AS p FROM letters),
  spanned AS (SELECT h.claim_id, h.span_doc_id, h.relocated, h.source, h.base, a.i - 1 AS s, z.i AS e
              FROM hits h JOIN folded_at a ON a.claim_id = h.claim_id AND a.p = h.hit JOIN folded_at z ON z.claim_id = h.claim_id AND z.p = h.hit + length(h.folded) - 1),
  owners AS (SELECT claim_id, arg_min(c.chunk_id, (c."end" < base + e, c.idx)) AS verified_chunk_id
             FROM spanned JOIN chunks c ON c.doc_id = span_doc_id AND c.start <= base + s AND c."end" > base + s GROUP BY claim_id),
  quoted AS (SELECT claim_id, span_doc_id, base + s AS span_start, base + e AS span_end, verified_chunk_id, substr(source, (s + 1)::INT, (e - s)::INT) AS source_text, relocated
             FROM spanned JOIN owners USING (claim_id))"""


def _renamed(ctes: str, names: str, prefix: str) -> str:
    """Common table expressions under other names."""
    return re.sub(rf"\b({'|'.join(names.split())})\b", rf"{prefix}\1", ctes)


#: Sentences of passages: the same expressions, over passages by their place.
_PASSAGE_SENTENCES = _renamed(_SENTENCES, "chars flagged runs spans words cuts pieces raw trimmed sentences documents", "p_")

#: The whole run: outcomes, claims, and what becomes of them.
_RUN = f"""{_CHUNKS}, {_QUESTIONS}, passages AS (SELECT chunk_id AS id, place, text FROM chunks), {_search("passages")},
  top AS (SELECT question_id, id AS chunk_id, coverage FROM ranked WHERE rank = 1),
  outcomes AS (SELECT q.question_id, q.question, t.chunk_id,
                      CASE WHEN NOT coalesce(t.coverage >= 0.34, false) THEN 'no_relevant_source' WHEN q.question_id % 6 = 5 THEN 'draft_failed' ELSE 'answered' END AS outcome
               FROM questions q LEFT JOIN top t USING (question_id)),
  made AS (SELECT o.question_id || ':' || k AS claim_id, o.question_id, k, o.chunk_id, CASE k WHEN 0 THEN b.text ELSE 'words that no source has ever held' END AS quote,
                  CASE k WHEN 0 THEN 'The source says so.' ELSE 'So it was told.' END AS sentence
           FROM outcomes o JOIN benchmark b ON b.item_id = o.question_id, (VALUES (0), (1)) AS v(k) WHERE o.outcome = 'answered'),
  cited AS (SELECT made.*, chunks.doc_id AS cited_doc, {_fold("chunks.text")} AS passage, {_fold("quote")} AS folded FROM made JOIN chunks USING (chunk_id)),
  early AS (SELECT *, CASE WHEN length(folded) < 16 OR len(string_split(folded, ' ')) < 4 THEN 'quote_too_short' END AS reason FROM cited),
  bodies AS (SELECT doc_id, {_fold("text")} AS body FROM documents),
  far AS (SELECT claim_id, arg_min(doc_id, (doc_id <> cited_doc, doc_id)) AS found FROM early JOIN bodies ON contains(body, folded)
          WHERE reason IS NULL AND NOT contains(passage, folded) GROUP BY claim_id),
  checked AS (SELECT early.claim_id, question_id, k, chunk_id, sentence, folded, coalesce(reason, CASE WHEN NOT contains(passage, folded) AND found IS NULL THEN 'quote_not_found' END) AS reason,
                     reason IS NULL AND NOT contains(passage, folded) AND found IS NOT NULL AS relocated,
                     CASE WHEN reason IS NULL THEN CASE WHEN contains(passage, folded) THEN cited_doc ELSE found END END AS span_doc_id
              FROM early LEFT JOIN far USING (claim_id)),
  final AS (SELECT *, coalesce(reason, CASE WHEN k > 0 OR question_id % 4 = 3 THEN 'check_failed' END) AS final_reason FROM checked),
  covered AS (SELECT question_id, count(*) FILTER (final_reason IS NULL) AS verified, count(*) AS total FROM final GROUP BY question_id),
  told AS (SELECT o.question_id, o.question, outcome, coalesce(verified, 0) AS verified, coalesce(total, 0) AS total,
                  CASE WHEN coalesce(total, 0) > 0 AND verified = 0 THEN 'No sentence of this answer could be traced to the sources, so none is shown.'
                       WHEN outcome = 'no_relevant_source' THEN 'No source comes close enough to this question to answer from.'
                       WHEN outcome = 'draft_failed' THEN 'The draft did not complete: timeout' END AS notice
           FROM outcomes o LEFT JOIN covered USING (question_id)),
  {_spans("checked").strip()},
  asked_drafts AS (SELECT question_id, any_value(o.question) AS question, '{PASSAGES_FRAME}' || string_agg('[' || id || '] (from "Document ' || c.doc_id || '")' || chr(10) || c.text, chr(10) || chr(10) ORDER BY rank)
                          || '{QUESTION_FRAME}' || any_value(o.question) AS content
                   FROM ranked JOIN chunks c ON c.chunk_id = id JOIN outcomes o USING (question_id) WHERE rank <= 6 AND outcome <> 'no_relevant_source' GROUP BY question_id),
  asked_checks AS (SELECT claim_id, question_id, '{PASSAGE_FRAME}' || source_text || '{STATEMENT_FRAME}' || sentence || '{FRAME_END}' AS content FROM checked JOIN quoted USING (claim_id) WHERE reason IS NULL),
  requests AS (SELECT 'draft' AS phase, 'draft:' || question_id AS task_id, question_id, 3 + 8 + ceil(length({_text(DRAFT_RULES)}) / 3.6::DOUBLE) + ceil(length(content) / 3.6::DOUBLE) + 900 AS estimate,
                      CASE WHEN question_id % 6 = 4 THEN 2 ELSE 1 END AS attempts, question_id % 6 = 5 AS failed, 300 AS tokens FROM asked_drafts
               UNION ALL SELECT 'verify', 'verify:' || claim_id, question_id, 3 + 8 + ceil(length({_text(VERDICT_RULES)}) / 3.6::DOUBLE) + ceil(length(content) / 3.6::DOUBLE) + 160,
                      1, question_id % 4 = 3, 100 FROM asked_checks)"""


def _decode(text: str) -> str:
    for name, char in ENTITIES.items():
        text = f"regexp_replace({text}, '&{name};', '{char.replace(chr(39), chr(39) * 2)}', 'gi')"
    return text


def _region() -> str:
    found = [f"regexp_extract(html, '{p.removeprefix('(?is)').replace(chr(39), chr(39) * 2)}', 1, 'is')" for p in REGIONS]
    return "CASE " + " ".join(f"WHEN length({f}) > 500 THEN {f}" for f in found) + " ELSE html END"


def _markup(text: str) -> str:
    text = f"regexp_replace({text}, '<!--.*?-->', ' ', 'gs')"
    for tag in DROPPED.split("|"):
        text = rf"regexp_replace({text}, '<{tag}\b[^>]*>.*?</{tag}>', ' ', 'gis')"
    text = rf"regexp_replace({text}, '<(br|hr)\s*/?>', chr(10), 'gi')"
    text = rf"regexp_replace({text}, '</({BLOCKS})\s*>', chr(10) || chr(10), 'gi')"
    text = _decode(f"regexp_replace({text}, '<[^>]+>', ' ', 'g')")
    text = rf"regexp_replace({text}, '\r\n?', chr(10), 'g')"
    text = rf"regexp_replace({text}, '[ \t\f\x0B\x{{A0}}]+', ' ', 'g')"
    text = rf"regexp_replace({text}, ' *\n *', chr(10), 'g')"
    text = rf"regexp_replace({text}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def _link_runs(source: str, key: str) -> str:
    """Text without runs of link-like blocks, of a table (key, text)."""
    return rf"""
  blocks AS (SELECT {key}, unnest(regexp_split_to_array(text, '\n{{2,}}')) AS b, generate_subscripts(regexp_split_to_array(text, '\n{{2,}}'), 1) AS i FROM {source}),
  bare AS (SELECT *, regexp_replace(b, '^\s+|\s+$', '', 'g') AS t FROM blocks),
  linked AS (SELECT *, length(t) BETWEEN 1 AND 27 AND NOT regexp_matches(t, '[.!?:;,]$') AND len(regexp_split_to_array(t, '\s+')) <= 4 AS link FROM bare),
  islands AS (SELECT *, i - row_number() OVER (PARTITION BY {key}, link ORDER BY i) AS island FROM linked),
  counted AS (SELECT *, count(*) OVER (PARTITION BY {key}, link, island) AS run FROM islands),
  joined AS (SELECT {key}, string_agg(b, chr(10) || chr(10) ORDER BY i) FILTER (NOT link OR run < 4) AS text FROM counted GROUP BY {key}),
  runless AS (SELECT {key}, regexp_replace(regexp_replace(coalesce(text, ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM joined)"""


_TITLE = r"nullif(substr(regexp_replace(regexp_replace(" + _decode("regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')") + r", '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), 1, 200), '')"
_V4 = "[" + ", ".join(f"'{n}'" for n in BLOCKED_V4) + "]"
_STATE = "(" + repr(EVENT_STATES.split()) + ")[((event_id + length(event_type)) % 7 + 1)::INT]"
_BOARD = f"""
  board AS (SELECT 't' || user_id AS task_id, coalesce(arg_max(event_type, event_id) FILTER (event_id % 3 = 0), 't' || user_id) AS label,
                   arg_max({_STATE}, event_id) AS state, arg_max(event_id % 4 + 1, event_id) AS attempts FROM events GROUP BY user_id)"""

#: How the five kinds of scripted tasks end when nothing waits for room: latencies, and back-off with half its jitter.
_ATTEMPTS = """ends(turn, state, attempts, ended_ms, error, tokens_used, refused) AS (VALUES
          (0, 'done', 1::BIGINT, 40::DOUBLE, '', 50::BIGINT, 0), (1, 'done', 2, 5 + 200 + 250 + 40, 'slow down', 60, 1), (2, 'failed', 5, 50 + 0.75 * (500 + 1000 + 2000 + 4000), 'busy (after 5 attempt(s))', 0, 0),
          (3, 'failed', 2, 10 + 375 + 20, 'no (after 2 attempt(s))', 0, 0), (4, 'done', 3, 5 + 375 + 7 + 750 + 30, 'busy', 70, 1))"""

ORACLES = {
    "fold_documents": f"SELECT doc_id, {_fold('text')} AS folded, {_WORDS} AS n_words FROM documents",
    "token_counts_by_document": f"SELECT doc_id, len({_tokens('text')})::BIGINT AS n_tokens, len(list_distinct({_tokens('text')}))::BIGINT AS n_distinct FROM documents",
    "token_stats": f"""
        WITH t AS (SELECT doc_id, unnest({_tokens("text")}) AS term FROM documents),
        d AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
        SELECT term, df, tf, round(greatest(0, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))), 6) AS idf FROM d, n""",
    "sentence_spans": f'WITH {_SENTENCES} SELECT doc_id, idx, start, "end", sentence FROM sentences',
    "chunk_spans": f'WITH RECURSIVE {_CHUNKS} SELECT chunk_id, doc_id, idx, start, "end", md5(text) AS text_md5 FROM chunks',
    "paragraph_chunks": f"""WITH RECURSIVE {_CHUNKS},
        place AS (SELECT doc_id, doc_id // 4 AS g, coalesce(sum(length(text) + 3) OVER (PARTITION BY doc_id // 4 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM documents),
        bodies AS (SELECT doc_id // 4 AS g, string_agg(text, chr(10) || ' ' || chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY 1),
        g_segs AS (SELECT g, s + off AS s, e + off AS e FROM segs JOIN place USING (doc_id)),
        g_numbered AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s) AS k, count(*) OVER (PARTITION BY g) AS n FROM g_segs),
        g_packed AS (SELECT g, k, n, s AS cs, e AS ce, NULL::BIGINT AS ds, NULL::BIGINT AS de FROM g_numbered WHERE k = 1
                     UNION ALL
                     SELECT p.g, x.k, p.n, CASE WHEN x.e - p.cs <= 1100 THEN p.cs ELSE least(greatest(p.cs, p.ce - 200), x.s) END, x.e,
                            CASE WHEN x.e - p.cs > 1100 THEN p.cs END, CASE WHEN x.e - p.cs > 1100 THEN p.ce END
                     FROM g_packed p JOIN g_numbered x ON x.g = p.g AND x.k = p.k + 1),
        g_ranges AS (SELECT g, ds AS s, de AS e FROM g_packed WHERE ds IS NOT NULL UNION ALL SELECT g, cs, ce FROM g_packed WHERE k = n),
        g_placed AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY g) AS m, lead(s) OVER w AS next_s, lead(e) OVER w AS next_e FROM g_ranges WINDOW w AS (PARTITION BY g ORDER BY s, e)),
        g_kept AS (SELECT g, s, CASE WHEN r = m - 1 AND next_e - next_s < 120 THEN next_e ELSE e END AS e FROM g_placed WHERE NOT (r = m AND m > 1 AND e - s < 120))
        SELECT g AS doc_id, row_number() OVER (PARTITION BY g ORDER BY s, e) - 1 AS idx, s AS start, e AS "end", md5(substr(text, (s + 1)::INT, (e - s)::INT)) AS text_md5 FROM g_kept JOIN bodies USING (g)""",
    "capped_claims": f"""WITH {_SENTENCES}, c AS (SELECT * FROM sentences WHERE idx < 250)
        SELECT doc_id, count(*) AS n, doc_id || ':' || max(idx) AS last_claim, md5(arg_max(sentence, idx)) AS last_md5 FROM c GROUP BY doc_id""",
    "index_stats": f"WITH RECURSIVE {_CHUNKS} SELECT count(*) AS n, round(avg(len({_tokens('text')})), 6) AS avg_length FROM chunks",
    "bm25_topk": f"""WITH RECURSIVE {_CHUNKS}, {_QUESTIONS}, passages AS (SELECT chunk_id AS id, place, text FROM chunks), {_search("passages")}
        SELECT question_id, rank, id AS chunk_id, round(score, 6) AS score, round(coverage, 6) AS coverage FROM ranked WHERE rank <= 6""",
    "stored_index_batches": f"""WITH RECURSIVE {_CHUNKS}, {_QUESTIONS}, halves AS (SELECT chunk_id AS id, place, text, doc_id <= (SELECT (min(doc_id) + max(doc_id)) // 2 FROM documents) AS early FROM chunks)
        SELECT 0 AS batch, question_id, rank, id AS chunk_id, round(score, 6) AS score, round(coverage, 6) AS coverage FROM (
          WITH passages AS (SELECT * FROM halves WHERE early), evens AS (SELECT * FROM questions WHERE question_id % 2 = 0), {_search("passages", "evens")} SELECT * FROM ranked WHERE rank <= 6)
        UNION ALL SELECT 1, question_id, rank, id, round(score, 6), round(coverage, 6) FROM (
          WITH passages AS (SELECT * FROM halves), others AS (SELECT * FROM questions WHERE question_id % 2 = 1), {_search("passages", "others")} SELECT * FROM ranked WHERE rank <= 6)""",
    "bm25_documents": f"""WITH {_QUESTIONS}, passages AS (SELECT doc_id AS id, doc_id AS place, text FROM documents), {_search("passages")}
        SELECT question_id, rank, id AS doc_id, round(score, 6) AS score, round(coverage, 6) AS coverage FROM ranked WHERE rank <= 6""",
    "retrieval_gate": f"""WITH {_QUESTIONS}, both_ AS (SELECT * FROM questions UNION ALL SELECT -1 - question_id, substr(question, 1, 9) || ' qqqzzz xxyyzz zzqqxx' FROM questions),
        passages AS (SELECT doc_id AS id, doc_id AS place, text FROM documents), {_search("passages", "both_")}
        SELECT b.question_id, round(coverage, 6) AS best_coverage, coalesce(coverage >= 0.34, false) AS relevant FROM both_ b LEFT JOIN ranked r ON r.question_id = b.question_id AND rank = 1""",
    "verify_quotes": f"WITH RECURSIVE {_VERIFY} SELECT claim_id, kind, CASE WHEN reason IS NULL THEN 'verified' ELSE 'unverified' END AS status, reason, relocated, span_doc_id FROM verified",
    "quote_spans": f"WITH RECURSIVE {_VERIFY}, {_spans('verified')} SELECT claim_id, span_doc_id, span_start, span_end, verified_chunk_id, md5(source_text) AS source_md5, relocated FROM quoted",
    "verify_strict": f"""WITH RECURSIVE {_verify(9, 60, False)}, {_spans('verified')}
        SELECT v.claim_id, kind, CASE WHEN reason IS NULL THEN 'verified' ELSE 'unverified' END AS status, reason,
               CASE reason WHEN 'no_citation' THEN 'No supporting quote was given for this sentence.' WHEN 'missing_source' THEN 'Passage "' || chunk_id || '" is not among those provided.'
                    WHEN 'quote_too_short' THEN 'The quote has ' || len(string_split(folded, ' ')) || ' word(s); fewer than 9, or too few characters, prove nothing.'
                    WHEN 'quote_not_found' THEN 'The quote occurs in none of the sources.' END AS detail, verified_chunk_id
        FROM verified v LEFT JOIN quoted q ON q.claim_id = v.claim_id""",
    "reason_ledger": f"WITH RECURSIVE {_VERIFY} SELECT reason, count(*) AS n FROM verified WHERE reason IN {_list(REASONS)} GROUP BY reason",
    "mechanical_tally": f"WITH RECURSIVE {_VERIFY} SELECT count(*) AS checked, count(*) FILTER (reason IS NULL) AS passed, count(reason) AS rejected FROM verified",
    "question_coverage": f"""WITH RECURSIVE {_VERIFY}, merged AS (SELECT question_id, CASE WHEN reason IS NOT NULL THEN reason WHEN claim_id % 5 < 2 THEN NULL WHEN claim_id % 5 = 2 THEN 'not_entailed' ELSE 'check_failed' END AS reason FROM verified)
        SELECT question_id, count(*) FILTER (reason IS NULL) AS verified, count(*) AS total, round(count(*) FILTER (reason IS NULL) / count(*)::DOUBLE, 6) AS ratio,
               count(*) FILTER (reason IS NULL) = 0 AS nothing_traced, count(*) FILTER (reason = 'not_entailed') AS not_entailed, count(*) FILTER (reason = 'check_failed') AS check_failed
        FROM merged GROUP BY question_id""",
    "html_titles": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "html_regions": f"SELECT page_id, length({_region()}) AS region_chars FROM pages",
    "html_text": f"WITH regions AS (SELECT page_id, {_region()} AS html FROM pages), plain AS (SELECT page_id, {_markup('html')} AS text FROM regions), {_link_runs('plain', 'page_id')} SELECT page_id, text FROM runless",
    "link_runs": rf"WITH cut AS (SELECT doc_id, regexp_replace(text, '(\S+ \S+) ', '\1' || chr(10) || chr(10), 'g') AS text FROM documents), {_link_runs('cut', 'doc_id')} SELECT doc_id, md5(text) AS kept_md5 FROM runless",
    "entity_decoding": f"SELECT page_id, md5({_decode('html')}) AS decoded_md5 FROM pages",
    "url_gate": """SELECT page_id, kind, fault FROM pages, (VALUES ('plain', ''), ('ftp', 'scheme'), ('port', 'port'), ('local', 'blocked_host'), ('loopback', 'blocked_address'),
                   ('private', 'blocked_address'), ('public', ''), ('bare', 'invalid')) AS k(kind, fault)""",
    "address_gate": f"""WITH n AS (SELECT unnest({_V4}) AS net),
        r AS (SELECT string_split(string_split(net, '/')[1], '.') AS p, string_split(net, '/')[2]::INT AS bits FROM n),
        s AS (SELECT p[1]::BIGINT * 16777216 + p[2]::BIGINT * 65536 + p[3]::BIGINT * 256 + p[4]::BIGINT AS low, (2 ** (32 - bits))::BIGINT AS size FROM r),
        a AS (SELECT c_custkey, (c_custkey * 7 % 256) * 16777216 + (c_custkey * 13 % 256) * 65536 + (c_custkey % 4) * 256 + 1 AS ip FROM customer)
        SELECT c_custkey, bool_or(ip >= low AND ip < low + size) AS blocked FROM a, s GROUP BY c_custkey""",
    "dns_gate": "SELECT page_id, CASE page_id % 4 WHEN 1 THEN 'private_address' WHEN 2 THEN 'private_address' WHEN 3 THEN 'unresolved' END AS fault FROM pages",
    "request_tokens": """WITH t AS (SELECT conv_id, sum(CASE WHEN text = '' THEN 0 ELSE ceil(length(text) / 3.6::DOUBLE) END + 4)::BIGINT + 3 AS n FROM conversations GROUP BY conv_id)
        SELECT conv_id, n + 900 AS first_attempt, n + 1800 AS second_attempt FROM t""",
    "budget_audit": """WITH r AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS at_ms, ceil(value)::BIGINT AS tokens FROM events)
        SELECT id, at_ms, tokens, sum(tokens) OVER (ORDER BY at_ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW)::BIGINT AS spent FROM r""",
    "burst_admission": """SELECT doc_id, 'done' AS state, (floor((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) / (8000 // 368)) * 60000)::BIGINT AS started_ms FROM documents""",
    "backoff_schedule": """WITH e AS (SELECT event_id, event_id % 8 + 1 AS a, (event_id % 10) / 10.0::DOUBLE AS r, CASE WHEN event_id % 3 = 0 THEN event_id % 5000 END AS asked FROM events),
        d AS (SELECT *, least(30000, 500 * pow(2, a - 1))::DOUBLE AS x FROM e)
        SELECT event_id, round(CASE WHEN coalesce(asked, 0) > 0 THEN asked + r * least(x, 1000) ELSE x * (0.5::DOUBLE + 0.5::DOUBLE * r) END, 6) AS delay_ms FROM d""",
    "event_props": "SELECT event_id, (props::JSON ->> '$.k')::BIGINT AS k, CASE WHEN json_type(props::JSON, '$.k') = 'VARCHAR' THEN nullif(trim(props::JSON ->> '$.k'), '') END AS k_text FROM events",
    "draft_parse": """SELECT item_id, item_id % 5 IN (0, 1, 4) AS sufficient, CASE item_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0 END::BIGINT AS n_claims,
        CASE WHEN item_id % 5 < 2 THEN 'Item ' || item_id || ' says so.' WHEN item_id % 5 = 4 THEN 'A brace } and "quote" inside' END AS first_text,
        CASE WHEN item_id % 5 < 2 THEN 'c1' END AS first_chunk FROM benchmark""",
    "verdict_parse": """SELECT item_id, item_id % 5 IN (0, 4) AS supported,
        CASE item_id % 5 WHEN 0 THEN 'stated' WHEN 3 THEN 'unreadable verdict' WHEN 4 THEN 'passage states it' ELSE 'not stated in passage' END AS reason FROM benchmark""",
    "model_catalogue": f"""WITH m AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'whisper-' || p_name ELSE p_name || '-' || p_partkey END AS id, (p_size * 1000)::BIGINT AS context_window FROM part)
        SELECT id, context_window, 'unknown' AS owned_by, row_number() OVER (ORDER BY context_window DESC, lower(id), id DESC) AS place FROM m
        WHERE context_window >= 8192 AND NOT regexp_matches(id, '{NOT_CHAT.removeprefix("(?i)")}', 'i')""",
    "retry_after": "SELECT event_id, (event_id % 50 + 0.5::DOUBLE) * CASE event_id % 5 WHEN 2 THEN 1 WHEN 3 THEN 60000 WHEN 4 THEN NULL ELSE 1000 END AS wait_ms FROM events",
    "reply_classes": """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN CASE WHEN event_id % 4 = 1 THEN 'retryable' ELSE 'final' END WHEN 2 THEN 'final'
        WHEN 3 THEN 'retryable' WHEN 4 THEN 'rate_limited' ELSE 'retryable' END AS kind FROM events""",
    "state_board": f"WITH {_BOARD} SELECT * FROM board",
    "streamed_board": f"WITH {_BOARD} SELECT * FROM board",
    "state_histogram": f"WITH {_BOARD}, s AS (SELECT unnest({list(STATES)!r}) AS state) SELECT s.state, count(task_id) AS n FROM s LEFT JOIN board USING (state) GROUP BY s.state",
    "doc_admission": """WITH d AS (SELECT doc_id, length(text) AS n, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS chars_before FROM documents)
        SELECT doc_id, chars_before, CASE WHEN n > 20000 THEN 'doc_too_large' WHEN n + chars_before > 1200000 THEN 'corpus_too_large' END AS fault FROM d""",
    "pasted_documents": r"""SELECT conv_id * 100 + turn AS position, 'Pasted text ' || (conv_id * 100 + turn + 1) AS title,
        md5(CASE WHEN turn = 1 THEN '' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END) AS text_md5,
        CASE WHEN turn = 1 OR text = '' THEN 'blank' END AS fault FROM conversations""",
    "fetched_pages": rf"""WITH t AS (SELECT url, html, page_id, {_TITLE} AS title, length(html) > 400000 AS truncated FROM pages)
        SELECT url, coalesce(title, regexp_extract(url, '^https?://([^/]+)', 1) || regexp_extract(url, '^https?://[^/]+([^?#]*)', 1)) AS title, truncated,
               CASE WHEN page_id % 7 = 0 THEN 'http_status' WHEN page_id % 4 = 2 THEN 'content_type' END AS fault FROM t""",
    "highlight_context": f"""WITH b AS (SELECT doc_id, text, {_fold("text")} AS body FROM documents),
        f AS (SELECT item_id, any_value(i.text) AS raw, min(doc_id) AS doc_id FROM benchmark i JOIN b ON contains(body, {_fold("i.text")}) GROUP BY item_id),
        s AS (SELECT item_id, doc_id, raw, b.text, strpos(b.text, raw) - 1 AS a FROM f JOIN b USING (doc_id) WHERE strpos(b.text, raw) > 0)
        SELECT item_id, doc_id AS span_doc_id, (a - greatest(0, a - 1400))::BIGINT AS n_before, md5(raw) AS marked_md5,
               md5(substr(text, (greatest(0, a - 1400) + 1)::INT, (a - greatest(0, a - 1400))::INT)) AS before_md5, md5(substr(text, (a + length(raw) + 1)::INT, 1400)) AS after_md5 FROM s""",
    "honest_mismatch": f"""WITH RECURSIVE {_CHUNKS}, p_documents AS (SELECT place AS doc_id, text FROM chunks), {_PASSAGE_SENTENCES},
        c AS (SELECT sentence AS statement, row_number() OVER (ORDER BY doc_id, start) - 1 AS i, count(*) OVER () AS n FROM p_sentences WHERE length(sentence) > 90 AND length(sentence) < 320)
        SELECT c.i % 2 = 0 AS honest, count(*) AS claims, count(*) FILTER (p.statement = c.statement) AS upheld
        FROM c JOIN c p ON p.i = CASE WHEN c.i % 2 = 0 THEN c.i ELSE (c.i * 7 + 13) % c.n END GROUP BY 1""",
    "question_lists": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS q, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
        t AS (SELECT doc_id, i, regexp_replace(q, '^\s+|\s+$', '', 'g') AS q FROM l),
        k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS position FROM t WHERE length(q) >= 3)
        SELECT doc_id AS list_id, position, md5(q) AS question_md5 FROM k WHERE position <= 25""",
    "request_validation": r"""WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, regexp_replace(text, '^\s+|\s+$', '', 'g') AS q FROM conversations),
        v AS (SELECT conv_id, 1 AS o, i, 'docs.' || i || '.origin' AS v FROM t WHERE role = 'system'
              UNION ALL SELECT conv_id, 2, i, 'questions.' || i FROM t WHERE length(q) NOT BETWEEN 3 AND 500
              UNION ALL SELECT DISTINCT conv_id, 3, 0, 'tokens_per_window' FROM t WHERE conv_id % 10 = 0)
        SELECT c.conv_id AS request_id, count(v.v) AS n_violations, arg_min(v.v, v.o * 1000 + v.i) AS fault FROM (SELECT DISTINCT conv_id FROM t) c LEFT JOIN v USING (conv_id) GROUP BY 1""",
    "numeric_entities": f"SELECT doc_id, md5({_decode('text')} || '&bogus;&lt;' || chr(128512)) AS decoded_md5 FROM documents",
    "fetched_texts": rf"""WITH regions AS (SELECT page_id, {_region()} AS html FROM pages), plain AS (SELECT page_id, {_markup('html')} AS text FROM regions), {_link_runs('plain', 'page_id')},
        k AS (SELECT page_id, html, ['text/html; charset=utf-8', 'text/plain', 'application/xhtml+xml', NULL][(page_id % 4 + 1)::INT] AS kind FROM pages)
        SELECT page_id, kind, md5(CASE WHEN page_id % 2 = 0 THEN r.text ELSE regexp_replace(regexp_replace(html, '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g') END) AS text_md5 FROM k JOIN runless r USING (page_id)""",
    "body_sizes": "SELECT page_id, CASE WHEN strlen(html) * CASE WHEN page_id % 100 = 0 THEN 900 ELSE 1 END > 2000000 THEN 'body_too_large' END AS fault FROM pages",
    "file_documents": r"""WITH f AS (SELECT item_id, item_id % 10 AS t, CASE item_id % 10 WHEN 4 THEN 'markdown' WHEN 5 THEN 'txt' ELSE 'md' END AS kind,
          CASE item_id % 10 WHEN 1 THEN ' ' || chr(10) || ' ' ELSE text END AS text FROM benchmark WHERE item_id % 10 <> 3)
        SELECT 'item-' || item_id || '.' || kind AS title, 'file' AS origin, CASE WHEN t <> 2 THEN length(text) END AS chars, CASE WHEN t <> 2 THEN md5(text) END AS text_md5,
               CASE t WHEN 1 THEN 'blank' WHEN 2 THEN 'too_large' END AS fault FROM f""",
    "redirect_walk": """WITH p AS (SELECT page_id, page_id % 10 AS t, 'http://h' || page_id || '.example' AS host FROM pages)
        SELECT page_id, CASE t WHEN 1 THEN host || '/c' WHEN 2 THEN 'http://10.0.0.1/y' WHEN 3 THEN 'https' || substr(host, 5) || '/s' WHEN 6 THEN 'http://169.254.169.254/meta' WHEN 7 THEN 'ftp:x'
               WHEN 8 THEN 'http://127.0.0.1' WHEN 9 THEN host || '/d e#f' ELSE host || '/a/b?x' END AS target,
               CASE WHEN t IN (0, 5) THEN 0 WHEN t = 4 THEN 4 ELSE 1 END::BIGINT AS hop,
               CASE WHEN t IN (2, 6, 8) THEN 'blocked_address' WHEN t = 4 THEN 'too_many_redirects' WHEN t = 5 THEN 'no_destination' WHEN t = 7 THEN 'scheme' END AS fault FROM p""",
    "url_documents": rf"""WITH regions AS (SELECT page_id, {_region()} AS html FROM pages), plain AS (SELECT page_id, {_markup('html')} AS text FROM regions), {_link_runs('plain', 'page_id')},
        p AS (SELECT page_id, page_id % 10 AS t, 'http://h' || page_id || '.example' AS host, {_TITLE} AS title, length(html) > 400000 AS truncated,
                     CASE WHEN page_id % 4 = 0 THEN r.text ELSE regexp_replace(regexp_replace(html, '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g') END AS text FROM pages JOIN runless r USING (page_id)),
        w AS (SELECT *, CASE t WHEN 1 THEN host || '/c' WHEN 2 THEN 'http://10.0.0.1/y' WHEN 3 THEN 'https' || substr(host, 5) || '/s' WHEN 6 THEN 'http://169.254.169.254/meta' WHEN 7 THEN 'ftp:x'
                      WHEN 8 THEN 'http://127.0.0.1' WHEN 9 THEN host || '/d e#f' ELSE host || '/a/b?x' END AS target, CASE WHEN t IN (0, 5) THEN 0 WHEN t = 4 THEN 4 ELSE 1 END::BIGINT AS hop,
                     CASE WHEN t IN (2, 6, 8) THEN 'blocked_address' WHEN t = 4 THEN 'too_many_redirects' WHEN t = 5 THEN 'no_destination' WHEN t = 7 THEN 'scheme'
                          WHEN page_id % 13 = 0 THEN 'unreachable' WHEN page_id % 7 = 0 THEN 'http_status' WHEN page_id % 4 = 2 THEN 'content_type' WHEN page_id % 11 = 0 THEN 'too_large' END AS fault FROM p)
        SELECT page_id, target, hop, CASE WHEN fault IS NULL THEN title END AS title, CASE WHEN fault IS NULL THEN md5(text) END AS text_md5, CASE WHEN fault IS NULL THEN truncated END AS truncated, fault FROM w""",
    "literal_hosts": f"SELECT page_id, host, fault FROM pages, (VALUES {', '.join(str(x) for x in LITERALS.items())}) AS l(host, fault)",
    "retried_tasks": f"""WITH {_ATTEMPTS} SELECT event_id, state, attempts, ended_ms, error, tokens_used FROM events JOIN ends ON turn = event_id % 5""",
    "cancelled_tasks": f"""WITH {_ATTEMPTS} SELECT event_id, CASE WHEN ended_ms > 1000 THEN 'cancelled' ELSE state END AS state, CASE WHEN ended_ms > 1000 THEN 2 ELSE attempts END::BIGINT AS attempts,
               least(ended_ms, 1000) AS ended_ms, CASE WHEN ended_ms > 1000 THEN 'busy' ELSE error END AS error, CASE WHEN ended_ms > 1000 THEN 0 ELSE tokens_used END::BIGINT AS tokens_used
        FROM events JOIN ends ON turn = event_id % 5""",
    "run_counters": f"""WITH {_ATTEMPTS} SELECT user_id::VARCHAR AS user_id, count(*) AS tasks, sum(attempts)::BIGINT AS dispatched, count(*) FILTER (state = 'done') AS completed, count(*) FILTER (state = 'failed') AS failed,
               0::BIGINT AS cancelled, sum(attempts - 1)::BIGINT AS retries, sum(refused)::BIGINT AS rate_limit_hits, 0::BIGINT AS budget_waits, count(*) AS peak_concurrency, max(ended_ms) AS wall_clock_ms,
               sum(100 + 200 * (attempts - 1))::BIGINT AS tokens_estimated, sum(tokens_used)::BIGINT AS tokens_actual, 0::BIGINT AS dropped
        FROM events JOIN ends ON turn = event_id % 5 GROUP BY user_id""",
    "task_ledger": f"""WITH {_ATTEMPTS} SELECT count(*) AS tasks, count(*) FILTER (state = 'done') AS completed, count(*) FILTER (state = 'failed') AS failed, 0::BIGINT AS cancelled, sum(tokens_used)::BIGINT AS tokens_actual,
               0::BIGINT AS dropped, sum(attempts)::BIGINT AS dispatched, sum(100 + 200 * (attempts - 1))::BIGINT AS tokens_estimated FROM events JOIN ends ON turn = event_id % 5""",
    "budget_settled": """WITH r AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS at_ms, ceil(value)::BIGINT AS tokens FROM events)
        SELECT id, at_ms, CASE WHEN id % 10 = 0 THEN greatest(tokens * 3, tokens, 0) ELSE greatest(tokens, 0) END AS tokens FROM r
        WHERE id % 7 <> 0 AND at_ms > 1705000000000 - 5 * 86400000 AND at_ms <= 1705000000000""",
    "window_meter": """WITH r AS (SELECT event_id AS id, epoch_us(ts) // 1000 AS at_ms, ceil(value)::BIGINT AS tokens FROM events),
        s AS (SELECT id, sum(tokens) OVER (ORDER BY at_ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW)::DOUBLE AS spent FROM r)
        SELECT id, CASE WHEN id % 50 = 0 THEN 0 ELSE round(least(100, spent / 120 * 100), 6) END AS pct FROM s""",
    "model_choice": f"""WITH m AS (SELECT p_partkey, p_brand, p_size, CASE WHEN p_partkey % 9 = 0 THEN 'whisper-' || p_name ELSE p_name || '-' || p_partkey END AS id, (p_size * 1000)::BIGINT AS context_window FROM part),
        fit AS (SELECT id, row_number() OVER (ORDER BY context_window DESC, lower(id), id DESC) AS place FROM m WHERE context_window >= 8192 AND NOT regexp_matches(id, '{NOT_CHAT.removeprefix("(?i)")}', 'i')),
        wanted AS (SELECT p_brand AS purpose, p_partkey AS rank, id FROM m WHERE p_partkey % 3 <> 0 OR p_size < 5 UNION ALL SELECT 'none', 1, 'no such model')
        SELECT purpose, coalesce(arg_min(w.id, rank) FILTER (w.id IN (SELECT id FROM fit)), (SELECT arg_min(id, place) FROM fit)) AS id FROM wanted w GROUP BY purpose""",
    "refused_parameters": """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 4 = 0 THEN CASE WHEN event_id % 3 <> 0 THEN 'reasoning_effort' END
        WHEN event_id % 4 = 1 THEN 'response_format' WHEN event_id % 4 = 2 THEN CASE WHEN event_id % 3 = 0 THEN 'response_format' ELSE 'reasoning_effort' END END AS dropped FROM events""",
    "model_calls": """WITH c AS (SELECT conv_id, sum(length(text))::BIGINT AS size FROM conversations GROUP BY conv_id), t AS (SELECT *, size % 6 AS turn FROM c)
        SELECT conv_id, CASE WHEN turn IN (3, 4) THEN 'failed' ELSE 'done' END AS state, CASE WHEN turn NOT IN (3, 4) THEN size || ' characters' END AS raw,
               CASE turn WHEN 3 THEN 'busy (after 3 attempt(s))' WHEN 4 THEN 'no such model (after 1 attempt(s))' END AS error, CASE WHEN turn NOT IN (3, 4) THEN 'stub' END AS model,
               CASE WHEN turn IN (1, 2) THEN 2 WHEN turn = 3 THEN 3 ELSE 1 END AS attempts, CASE WHEN turn IN (3, 4) THEN 0 WHEN turn IN (1, 2) THEN size % 97 + 2 ELSE size % 97 + 1 END AS tokens_used,
               CASE turn WHEN 3 THEN 'retryable' WHEN 4 THEN 'final' ELSE 'ok' END AS kind, false AS over FROM t""",
    "repeated_batches": f"""WITH {_BOARD} SELECT 't' || user_id AS task_id, count(*) AS n, min(event_id) AS first, max(event_id) AS last, sum(event_id % 4 + 1)::BIGINT AS attempts FROM events GROUP BY user_id""",
    "joined_lines": f"WITH {_BOARD} SELECT * FROM board",
    "budget_wakes": """WITH RECURSIVE e AS (SELECT user_id % 100 AS key, event_id, epoch_us(ts) // 1000 AS at_ms, ceil(value)::BIGINT AS tokens FROM events),
        ops AS (SELECT key, 'reserve' AS op, event_id::VARCHAR AS id, at_ms, tokens FROM e UNION ALL SELECT key, 'release', event_id::VARCHAR, at_ms + 1000, 0 FROM e WHERE event_id % 5 = 0
                UNION ALL SELECT key, 'reconcile', event_id::VARCHAR, at_ms + 1000, tokens * 2 FROM e WHERE event_id % 5 = 1
                UNION ALL SELECT DISTINCT key, 'tick', '', (SELECT max(at_ms) + 2000000000 FROM e), 0 FROM e),
        steps AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ms, id, op) AS k FROM ops),
        walk AS (SELECT DISTINCT key, 1::BIGINT AS k, NULL::BIGINT AS clock, []::STRUCT(id VARCHAR, at_ms BIGINT, tokens BIGINT)[] AS held, []::STRUCT(id VARCHAR, at_ms BIGINT, tokens BIGINT)[] AS line,
                        NULL::STRUCT(id VARCHAR, at_ms BIGINT, tokens BIGINT) AS told, NULL::VARCHAR AS verdict, NULL::BIGINT AS admitted FROM steps
                 UNION ALL
                 SELECT key, CASE WHEN room <= at_ms THEN k ELSE k + 1 END, CASE WHEN room <= at_ms THEN room ELSE at_ms END,
                        CASE WHEN room <= at_ms THEN held || [{'id': line[1].id, 'at_ms': room, 'tokens': line[1].tokens}]
                             WHEN op = 'release' THEN list_filter(held, lambda x: x.id <> id)
                             WHEN op = 'reconcile' THEN list_transform(held, lambda x: CASE WHEN x.id = id THEN {'id': x.id, 'at_ms': x.at_ms, 'tokens': greatest(x.tokens, tokens, 0)} ELSE x END)
                             ELSE list_filter(held, lambda x: x.at_ms > at_ms - 3600000) END,
                        CASE WHEN room <= at_ms THEN line[2:] WHEN op = 'reserve' AND tokens <= 150 THEN line || [{'id': id, 'at_ms': at_ms, 'tokens': tokens}]
                             WHEN op = 'release' THEN list_filter(line, lambda x: x.id <> id) ELSE line END,
                        CASE WHEN room <= at_ms THEN line[1] WHEN op = 'reserve' AND tokens > 150 THEN {'id': id, 'at_ms': at_ms, 'tokens': tokens}
                             WHEN op = 'release' THEN list_filter(line, lambda x: x.id = id)[1] END,
                        CASE WHEN room <= at_ms THEN 'ok' WHEN op = 'reserve' AND tokens > 150 THEN 'exceeds_ceiling' WHEN op = 'release' THEN 'released' END,
                        CASE WHEN room <= at_ms THEN room END
                 FROM (SELECT w.key, w.k, w.held, w.line, s.op, s.id, s.at_ms, s.tokens,
                              list_min(list_filter([w.clock] || list_transform(w.held, lambda x: x.at_ms + 3600000), lambda t: t >= w.clock AND len(w.line) > 0
                                AND coalesce(list_sum(list_transform(list_filter(w.held, lambda x: x.at_ms > t - 3600000), lambda x: x.tokens)), 0) + w.line[1].tokens <= 150)) AS room
                       FROM walk w JOIN steps s ON s.key = w.key AND s.k = w.k))
        SELECT key::VARCHAR AS budget_key, told.id AS id, told.at_ms AS asked_ms, told.tokens AS tokens, verdict, admitted AS admitted_ms FROM walk WHERE told IS NOT NULL""",
    "budget_stream": """WITH RECURSIVE e AS (SELECT user_id % 100 AS key, event_id, epoch_us(ts) // 1000 AS at_ms, ceil(value)::BIGINT AS tokens FROM events),
        ops AS (SELECT key, 'reserve' AS op, event_id::VARCHAR AS id, at_ms, tokens FROM e UNION ALL SELECT key, 'release', event_id::VARCHAR, at_ms + 1000, 0 FROM e WHERE event_id % 5 = 0
                UNION ALL SELECT key, 'reconcile', event_id::VARCHAR, at_ms + 1000, tokens * 2 FROM e WHERE event_id % 5 = 1),
        steps AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ms, id, op) AS k FROM ops),
        walk AS (SELECT key, 0::BIGINT AS k, []::STRUCT(id VARCHAR, at_ms BIGINT, tokens BIGINT)[] AS held, NULL::VARCHAR AS id, NULL::VARCHAR AS op, NULL::BIGINT AS at_ms, NULL::BIGINT AS tokens, NULL::VARCHAR AS verdict, NULL::BIGINT AS retry_at_ms
                 FROM (SELECT DISTINCT key FROM steps)
                 UNION ALL
                 SELECT key, k, CASE op WHEN 'release' THEN list_filter(held, lambda x: x.id <> id)
                                        WHEN 'reconcile' THEN list_transform(held, lambda x: CASE WHEN x.id = id THEN {'id': x.id, 'at_ms': x.at_ms, 'tokens': greatest(x.tokens, tokens, 0)} ELSE x END)
                                        ELSE CASE WHEN verdict = 'ok' THEN live || [{'id': id, 'at_ms': at_ms, 'tokens': tokens}] WHEN verdict = 'window_full' THEN live ELSE held END END,
                        id, op, at_ms, tokens, verdict, CASE WHEN verdict = 'window_full' THEN coalesce(live[1].at_ms, at_ms) + 3600000 END
                 FROM (SELECT *, CASE WHEN op <> 'reserve' THEN NULL WHEN tokens > 150 THEN 'exceeds_ceiling' WHEN coalesce(list_sum(list_transform(live, lambda x: x.tokens)), 0) + tokens > 150 THEN 'window_full' ELSE 'ok' END AS verdict
                       FROM (SELECT s.*, w.held, list_filter(w.held, lambda x: x.at_ms > s.at_ms - 3600000) AS live FROM walk w JOIN steps s ON s.key = w.key AND s.k = w.k + 1)))
        SELECT key::VARCHAR AS budget_key, id, at_ms, tokens, verdict, retry_at_ms FROM walk WHERE op = 'reserve'""",
    "ask_run": f"WITH RECURSIVE {_RUN} SELECT question_id, outcome, verified, total, round(CASE WHEN total > 0 THEN verified / total::DOUBLE ELSE 0 END, 6) AS ratio, notice FROM told",
    "run_sentences": f"""WITH RECURSIVE {_RUN}, n AS (SELECT question_id, count(*) AS n_retrieved, round(100 * max(coverage))::BIGINT AS best_coverage_pct FROM ranked WHERE rank <= 6 GROUP BY question_id)
        SELECT claim_id, question_id, sentence AS text, CASE WHEN final_reason IS NULL THEN 'verified' ELSE 'unverified' END AS status, final_reason AS reason,
               q.verified_chunk_id || CASE WHEN f.relocated THEN '*' ELSE '' END AS shown_passage, q.span_doc_id, span_start, span_end, CASE WHEN final_reason IS NULL THEN 'judge' END AS judge, n_retrieved, best_coverage_pct
        FROM final f LEFT JOIN quoted q USING (claim_id) LEFT JOIN n USING (question_id)""",
    "run_progress": f"""WITH RECURSIVE {_RUN}, p(seq, phase) AS (VALUES (0, 'retrieving'), (2, 'drafting'), (4, 'checking'), (6, 'entailing'), (8, 'done')),
        n AS (SELECT (SELECT count(*) FROM chunks) AS passages, (SELECT sum(len(terms))::BIGINT FROM bag) AS words, (SELECT count(*) FROM outcomes) AS questions, (SELECT count(*) FROM outcomes WHERE outcome <> 'no_relevant_source') AS relevant,
                     (SELECT count(*) FROM checked) AS claims, (SELECT count(*) FROM checked WHERE reason IS NULL) AS traced, (SELECT count(*) FROM final WHERE final_reason IS NULL) AS verified, (SELECT count(*) FROM final WHERE final_reason IS NOT NULL) AS withheld)
        SELECT seq, phase, CASE WHEN seq = 2 THEN passages END AS passages, CASE WHEN seq = 2 THEN words END AS words, CASE WHEN seq = 2 THEN questions END AS questions, CASE WHEN seq = 2 THEN relevant END AS relevant,
               CASE WHEN seq = 6 THEN claims END AS claims, CASE WHEN seq = 6 THEN traced END AS traced, CASE WHEN seq = 8 THEN verified END AS verified, CASE WHEN seq = 8 THEN withheld END AS withheld FROM p, n""",
    "run_prompts": f"""WITH RECURSIVE {_RUN} SELECT 'draft' AS pass, question_id::VARCHAR AS key, 2::BIGINT AS n, md5({_text(DRAFT_RULES)}) AS rules_md5, md5(content) AS asked_md5 FROM asked_drafts
        UNION ALL SELECT 'verify', claim_id, 2, md5({_text(VERDICT_RULES)}), md5(content) FROM asked_checks""",
    "run_ledger": f"""WITH RECURSIVE {_RUN}, r AS (SELECT *, CASE phase WHEN 'draft' THEN CASE WHEN attempts = 2 THEN 500 + 375 + 500 ELSE 500 END ELSE 500 END AS took,
                 estimate + CASE WHEN attempts = 2 THEN estimate + 900 ELSE 0 END AS reserved FROM requests),
        p AS (SELECT phase, count(*) AS tasks, max(took) AS wall FROM r GROUP BY phase),
        s AS (SELECT string_agg('"' || reason || '":' || n, ',' ORDER BY list_position({list(REASONS)!r}, reason)) AS by_reason FROM (SELECT final_reason AS reason, count(*) AS n FROM final WHERE final_reason IS NOT NULL GROUP BY 1))
        SELECT (SELECT count(*) FROM told) AS questions, (SELECT count(*) FROM final WHERE final_reason IS NULL) AS verified, (SELECT count(*) FROM final WHERE final_reason IS NOT NULL) AS unverified,
               (SELECT count(*) FROM checked) AS checked, (SELECT count(*) FROM checked WHERE reason IS NULL) AS passed, (SELECT count(*) FROM checked WHERE reason IS NOT NULL) AS rejected,
               (SELECT '{{' || by_reason || '}}' FROM s) AS by_reason, count(*) FILTER (failed) AS failed, sum(attempts - 1)::BIGINT AS retries_absorbed, 0::BIGINT AS rate_limit_hits, 0::BIGINT AS budget_waits,
               sum(reserved)::BIGINT AS tokens_estimated, sum(CASE WHEN failed THEN 0 ELSE tokens END)::BIGINT AS tokens_actual, sum(attempts)::BIGINT AS model_calls,
               (SELECT max(tasks) FROM p) AS peak_concurrency, (SELECT sum(wall) FROM p)::DOUBLE AS wall_clock_ms, count(*) FILTER (phase = 'verify') AS claims_dispatched FROM r""",
    "run_events": f"""WITH RECURSIVE {_RUN}
        SELECT 'phase' AS type, i::BIGINT AS at, p AS told FROM (VALUES (0, 'retrieving'), (1, 'drafting'), (2, 'checking'), (3, 'entailing'), (4, 'done')) AS v(i, p)
        UNION ALL SELECT 'models', 1, 'drafter'
        UNION ALL SELECT 'scheduler', NULL, phase || '|' || CASE WHEN failed THEN 'failed' ELSE 'done' END || '|' || task_id FROM requests
        UNION ALL SELECT 'claims', 100000 + question_id, min(claim_id) FROM asked_checks GROUP BY question_id
        UNION ALL SELECT 'result', 200000 + question_id, outcome || '|' || verified FROM told
        UNION ALL SELECT 'error', 300000 + question_id, notice FROM told WHERE outcome = 'draft_failed'""",
}
