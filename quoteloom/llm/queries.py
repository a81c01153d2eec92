"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .best_fit import best_fit_pack
from .decontamination import decontaminate, with_digest
from .exact_dedup import exact_dedup
from .importance import resample
from .language_id import identify
from .lm_scoring import score
from .merkle import merkle_manifest
from .near_dedup import near_components
from .packing import Limits, chat_examples, pack_documents, pack_examples
from .preferences import conversations, format_pairs, pairs_by_opening, pairs_by_reply, with_bounds
from .token_counts import lengths, suffix_sums
from .token_files import token_files
from .warc import archive_round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with another's reply, and against the best one of its opening."""
    whole = conversations(table(spark, sf_dir, "conversations"))
    return with_bounds(format_pairs(whole, pairs_by_opening(whole).union(pairs_by_reply(whole))))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(lengths(table(spark, sf_dir, "documents")))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents")).drop("loss")


def chat_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing operator on conversations, where segments and loss-bearing tokens bind as well as tokens."""
    examples = chat_examples(conversations(table(spark, sf_dir, "conversations")))
    return pack_examples(examples, Limits(2048, 8, 1024)).withColumnRenamed("doc_id", "conv_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A twentieth of the documents of 20 words or more, drawn towards the benchmark."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents by source, verified against a copy that lost line breaks in about half its rows."""
    lost = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle_manifest(table(spark, sf_dir, "documents"), changed=(lost, {"text": F.expr(r"replace(text, '\n', '')")}))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc,
        op2_token_files,
        op3_language_id,
        op4_exact_dedup,
        op5_preferences,
        op6_lm_scoring,
        op7_token_counts,
        op8_simhash_near_dedup,
        op9_packing,
        op10_decontamination,
        op11_best_fit,
        op12_importance,
        op13_merkle,
        chat_packing,
    )
}

ORACLES = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first_id <> page_id THEN first_id END AS refers_to
        FROM f""",
    "op4_exact_dedup": r"""
        WITH bare AS (
          SELECT doc_id, length(coalesce(text, '')) AS points,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents),
        best AS (
          SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
          FROM bare WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id))
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM best""",
    "op5_preferences": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i
                   FROM conversations WHERE conv_id IS NOT NULL),
        r AS (SELECT *, '<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS shown FROM t),
        f AS (SELECT conv_id, coalesce(min(i) FILTER (role = 'user'), 1) AS k, max(i) FILTER (role = 'assistant') AS last,
                     arg_max(text, i) FILTER (role = 'assistant') AS reply,
                     sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS weight FROM t GROUP BY conv_id),
        o AS (SELECT f.conv_id, f.weight, list((r.role, r.text) ORDER BY r.i) AS opening
              FROM f JOIN r ON f.conv_id = r.conv_id AND r.i <= f.k GROUP BY f.conv_id, f.weight),
        c AS (SELECT *, first_value(conv_id) OVER (PARTITION BY opening ORDER BY weight DESC, conv_id) AS chosen_id FROM o),
        many AS (SELECT greatest(0, ceil(log(greatest(1, count(*)) / 4096.0) / log(16) - 1e-9))::INT AS digits FROM f WHERE reply IS NOT NULL),
        dealt AS (SELECT conv_id, reply, md5(reply) AS h, substr(md5(conv_id::VARCHAR), 1, digits) AS bucket FROM f, many WHERE reply IS NOT NULL),
        circle AS (SELECT bucket, h, min(conv_id) AS giver FROM dealt GROUP BY bucket, h),
        following AS (SELECT bucket, h, coalesce(lead(giver) OVER w, first_value(giver) OVER w) AS rejected_id, count(*) OVER (PARTITION BY bucket) AS n
                      FROM circle WINDOW w AS (PARTITION BY bucket ORDER BY h)),
        q AS (SELECT 'opening' AS kind, chosen_id, conv_id AS rejected_id FROM c WHERE chosen_id <> conv_id
              UNION SELECT 'reply', conv_id, rejected_id FROM dealt JOIN following USING (bucket, h) WHERE n > 1),
        sides AS (SELECT q.*, 'chosen' AS side, r.i, r.role, r.text, r.shown FROM q JOIN f ON f.conv_id = q.chosen_id JOIN r ON r.conv_id = q.chosen_id AND (q.kind = 'opening' OR r.i <= f.last)
                  UNION ALL SELECT q.*, 'rejected', r.i, r.role, r.text, r.shown FROM q JOIN r ON r.conv_id = q.rejected_id WHERE q.kind = 'opening'
                  UNION ALL SELECT q.*, 'rejected', r.i, r.role, r.text, r.shown FROM q JOIN f ON f.conv_id = q.chosen_id JOIN r ON r.conv_id = q.chosen_id AND r.i < f.last WHERE q.kind = 'reply'
                  UNION ALL SELECT q.*, 'rejected', f.last, r.role, r.text, r.shown FROM q JOIN f ON f.conv_id = q.chosen_id JOIN f g ON g.conv_id = q.rejected_id JOIN r ON r.conv_id = q.rejected_id AND r.i = g.last
                            WHERE q.kind = 'reply'),
        p AS (SELECT a.kind, a.chosen_id, a.rejected_id, coalesce(min(a.i) FILTER (b.i IS NULL OR a.role <> b.role OR a.text <> b.text), max(a.i) + 1) - 1 AS n
              FROM sides a LEFT JOIN sides b ON b.side = 'rejected' AND b.kind = a.kind AND b.chosen_id = a.chosen_id AND b.rejected_id = a.rejected_id AND b.i = a.i
              WHERE a.side = 'chosen' GROUP BY ALL),
        placed AS (SELECT s.*, p.n, coalesce(sum(CASE WHEN s.i > p.n THEN length(shown) END) OVER (PARTITION BY s.kind, s.chosen_id, s.rejected_id, side ORDER BY s.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
                   FROM sides s JOIN p USING (kind, chosen_id, rejected_id)),
        told AS (SELECT kind, chosen_id, rejected_id, any_value(n)::BIGINT AS prompt_turns,
                        coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'chosen' AND i <= n), '') AS prompt,
                        coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'chosen' AND i > n), '') AS chosen,
                        coalesce(string_agg(shown, '' ORDER BY i) FILTER (side = 'rejected' AND i > n), '') AS rejected,
                        coalesce(string_agg((first + length(role) + 5) || '-' || (first + length(shown)), ',' ORDER BY i) FILTER (side = 'chosen' AND i > n AND role = 'assistant'), '') AS chosen_loss,
                        coalesce(string_agg((first + length(role) + 5) || '-' || (first + length(shown)), ',' ORDER BY i) FILTER (side = 'rejected' AND i > n AND role = 'assistant'), '') AS rejected_loss
                 FROM placed GROUP BY kind, chosen_id, rejected_id)
        SELECT *, CASE WHEN prompt_turns = 0 THEN 'no_prompt' WHEN chosen_loss = '' OR rejected_loss = '' THEN 'no_loss' ELSE 'ok' END AS status FROM told""",
    "op10_decontamination": r"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g
                FROM (SELECT item_id, w, least(10, len(w)) AS m,
                             unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT m FROM win),
        grams AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
                  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
        hits AS (SELECT grams.doc_id, grams.i, grams.m, win.item_id FROM grams JOIN win USING (m, g)),
        places AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                   FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
               coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN places ON d.doc_id = places.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op12_importance": r"""
        WITH bytes AS (SELECT list(list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, v) ORDER BY v) AS t FROM range(256) r(v)),
        texts AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
        split AS (SELECT side, id, list_filter(regexp_split_to_array(
                    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM texts),
        grams AS (SELECT side, id, array_to_string(w[i : i + m - 1], ' ') AS g
                  FROM (SELECT side, id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split, range(1, 4) r(m) WHERE len(w) >= m)),
        counted AS (SELECT side, id, g, count(*) AS c FROM grams GROUP BY ALL),
        distinct_grams AS (SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM counted)),
        hashed AS (SELECT g, xor(list_reduce(list_transform(range(1, len(x), 2), lambda i: ('0x' || x[i : i + 1])::BIGINT),
                                 lambda c, b: xor(t[xor(c & 255, b) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
                   FROM distinct_grams, bytes),
        featured AS (SELECT side, id, bucket, sum(c)::BIGINT AS c FROM counted JOIN hashed USING (g) GROUP BY ALL),
        sides AS (SELECT bucket, coalesce(sum(c) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(c) FILTER (side = 'b'), 0)::DOUBLE AS t FROM featured GROUP BY bucket),
        totals AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM sides),
        gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM sides, totals),
        weighed AS (SELECT id, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM featured JOIN gain USING (bucket) WHERE side = 'd' GROUP BY id),
        noise AS (SELECT id AS doc_id, len(w) AS words, ('0x' || sha256('42:' || id)[1:8])::BIGINT AS h FROM split WHERE side = 'd'),
        scored AS (SELECT doc_id, words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                          coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
                   FROM noise LEFT JOIN weighed ON doc_id = id),
        placed AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY words >= 20) AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM placed""",
    "op13_merkle": r"""
        WITH RECURSIVE kept AS (
          SELECT doc_id, source,
                 coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
                 text,
                 list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT),
                   lambda c, b: list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
                   4294967295::BIGINT) AS crc
          FROM documents),
        leaves AS (
          SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                 CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other, head FROM kept),
        placed AS (
          SELECT doc_id, source, leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS now,
                 row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM leaves),
        tree AS (
          SELECT source, 0 AS step, pos, n, leaf AS h FROM placed
          UNION ALL
          SELECT source, step + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY source, step, pos // 3, n),
        tops AS (SELECT source, step AS depth, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
        upper_tree AS (
          SELECT 0 AS step, pos, n, subroot AS h FROM tops
          UNION ALL
          SELECT step + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM upper_tree WHERE n > 1 GROUP BY step, pos // 3, n),
        inner_ways AS (
          SELECT s.source, s.step, s.pos, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos < s.pos), '') AS l,
                 coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos > s.pos), '') AS r
          FROM tree s LEFT JOIN tree o ON o.source IS NOT DISTINCT FROM s.source AND o.step = s.step AND o.pos // 3 = s.pos // 3 AND o.pos <> s.pos
          WHERE s.n > 1 GROUP BY ALL),
        upper_ways AS (
          SELECT s.step, s.pos, coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos < s.pos), '') AS l,
                 coalesce(string_agg(o.h, '' ORDER BY o.pos) FILTER (o.pos > s.pos), '') AS r
          FROM upper_tree s LEFT JOIN upper_tree o ON o.step = s.step AND o.pos // 3 = s.pos // 3 AND o.pos <> s.pos
          WHERE s.n > 1 GROUP BY ALL),
        inner_fold AS (
          SELECT source, pos AS place, 0 AS step, pos, now, '' AS way FROM placed
          UNION ALL
          SELECT f.source, f.place, f.step + 1, f.pos // 3, sha256(w.l || f.now || w.r), f.way || w.l || w.r
          FROM inner_fold f JOIN inner_ways w ON w.source IS NOT DISTINCT FROM f.source AND w.step = f.step AND w.pos = f.pos),
        upper_fold AS (
          SELECT f.source, f.place, 0 AS step, t.pos, f.now, f.way FROM inner_fold f JOIN tops t ON t.source IS NOT DISTINCT FROM f.source AND t.depth = f.step
          UNION ALL
          SELECT f.source, f.place, f.step + 1, f.pos // 3, sha256(w.l || f.now || w.r), f.way || w.l || w.r
          FROM upper_fold f JOIN upper_ways w ON w.step = f.step AND w.pos = f.pos),
        ended AS (SELECT source, place, arg_max(now, step) AS folded_root, arg_max(way, step) AS way FROM upper_fold GROUP BY ALL)
        SELECT p.doc_id, p.leaf, t.subroot, u.h AS root, sha256(e.way) AS proof_sha256, e.folded_root, e.folded_root = u.h AS verified
        FROM placed p JOIN tops t ON t.source IS NOT DISTINCT FROM p.source JOIN upper_tree u ON u.n = 1
        JOIN ended e ON e.source IS NOT DISTINCT FROM p.source AND e.place = p.pos""",
}
