"""The queries of this subpackage, and SQL for those that SQL can express.

Each query applies its operator to a whole table and derives the columns asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import conversation_repair as _conversation_repair
from quirework.llm import decontaminate as _decontaminate
from quirework.llm import exact_search as _exact_search
from quirework.llm import langid as _langid
from quirework.llm import line_dedup as _line_dedup
from quirework.llm import mixing as _mixing
from quirework.llm import near_dedup as _near_dedup
from quirework.llm import quality_crf as _quality_crf
from quirework.llm import quality_rules as _quality_rules
from quirework.llm import resampling as _resampling
from quirework.llm import secret_scan as _secret_scan
from quirework.llm import toxicity as _toxicity
from quirework.llm import warc as _warc
from quirework.llm._shared import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), result_col="c")
    return found.select(
        "doc_id",
        F.col("c.n_words").alias("n_words"),
        F.col("c.n_hit").alias("n_hit"),
        F.size("c.item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("c.item_ids"), ","), 256).alias("items_sha256"),
        (F.col("c.n_hit") > 0).alias("contaminated"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = _quality_rules.quality_rules(table(spark, sf_dir, "documents"), result_col="q")
    return judged.select("doc_id", *[f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance", "nearest")])


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _warc.read_warc(spark, _warc.write_warc(table(spark, sf_dir, "pages")))
    whole = F.col("record_type") == "response"
    return records.select(
        F.when(F.col("record_id") != "", F.col("record_id")).cast("long").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    langs, prototypes = _langid.language_prototypes(docs.filter(~held_out(F.col("doc_id"))))
    found = _langid.identify_languages(docs.drop("lang"), langs, prototypes, result_col="l")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = _secret_scan.scan_secrets(table(spark, sf_dir, "documents"), result_col="s")
    return scanned.select("doc_id", *[c.alias(k) for k, c in _secret_scan.span_columns(F.col("s")).items()])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _line_dedup.dedup_units(table(spark, sf_dir, "documents"), result_col="r")
    spans = F.transform("r.removed", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    return done.select(
        "doc_id",
        F.size("r.removed").cast("long").alias("n_removed"),
        F.aggregate("r.removed", F.lit(0).cast("long"), lambda n, x: n + x["words"]).alias("n_words_removed"),
        F.array_join(spans, ",").alias("removed"),
        F.sha2(F.coalesce("r.text", F.lit("")), 256).alias("clean_sha256"),
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = _quality_crf.train(docs, table(spark, sf_dir, "labels"))
    scored = _quality_crf.score_quality(docs, model, result_col="q")
    score = F.col("q.score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.7).cast("int").alias("predicted"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = _mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = _toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = _toxicity.score_toxicity(docs, model, result_col="t")
    score = F.col("t.score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = _exact_search.exact_top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), k=20, scale=64)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _conversation_repair.repair_report(_conversation_repair.damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality_rules": op2_quality_rules,
    "op3_warc": op3_warc,
    "op4_language_id": op4_language_id,
    "op5_secret_scan": op5_secret_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_near_dedup": op8_near_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_toxicity": op10_toxicity,
    "op11_resample": op11_resample,
    "op12_exact_topk": op12_exact_topk,
    "op13_repair_conversations": op13_repair_conversations,
}

SQL: dict[str, str] = {}

SQL["op1_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
bl AS (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM d, (SELECT DISTINCT n FROM bl) WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY ALL),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY ALL)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

SQL["op8_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 2 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY ALL),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, t.b FROM r JOIN both_ways t ON r.b = t.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id, min(r.b) = d.doc_id AS kept
FROM d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""

SQL["op3_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""

SQL["op6_line_dedup"] = r"""
WITH p AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '(?s).*?(?:\n+|[.!?,;:]+["'')\]]*[\x20\t\r]+|[。！？]+|$)')) AS piece,
         generate_subscripts(regexp_extract_all(text, '(?s).*?(?:\n+|[.!?,;:]+["'')\]]*[\x20\t\r]+|[。！？]+|$)'), 1) AS i
  FROM documents),
q AS (
  SELECT doc_id, i, piece, regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
  FROM p WHERE length(piece) > 0),
u AS (
  SELECT *, row_number() OVER d AS k, sum(n) OVER d AS upto FROM (
    SELECT doc_id, i, stop - length(piece) AS start, stop, array_to_string(w, ' ') AS norm,
           len(w) + len(regexp_extract_all(piece, '[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3041}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}]')) AS n
    FROM q WHERE len(w) > 0)
  WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
s AS (
  SELECT a.doc_id, a.k, a.start, a.upto - a.n AS w0, min(b.k) AS e FROM u a JOIN u b ON b.doc_id = a.doc_id AND b.k BETWEEN a.k AND a.k + 9
  WHERE b.upto >= a.upto - a.n + 10 GROUP BY ALL),
keyed AS (
  SELECT s.doc_id, s.k, s.start, s.w0, string_agg(c.norm, ' ' ORDER BY c.k) AS key, max(c.stop) AS stop, max(c.upto) AS w1
  FROM s JOIN u c ON c.doc_id = s.doc_id AND c.k BETWEEN s.k AND s.e GROUP BY ALL),
m AS (SELECT * FROM (SELECT *, min(doc_id) OVER (PARTITION BY key) AS first FROM keyed) WHERE first < doc_id),
g AS (SELECT *, CASE WHEN w0 > coalesce(max(w1) OVER (PARTITION BY doc_id ORDER BY w0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS head FROM m),
h AS (SELECT *, sum(head) OVER (PARTITION BY doc_id ORDER BY w0) AS run FROM g),
r AS (SELECT doc_id, min(start) AS a, max(stop) AS b, max(w1) - min(w0) AS n FROM h GROUP BY doc_id, run HAVING max(w1) - min(w0) >= 40),
spans AS (SELECT doc_id, count(*) AS n_removed, sum(n) AS n_words, string_agg(a || ':' || b, ',' ORDER BY a) AS removed FROM r GROUP BY ALL),
clean AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY i) AS text FROM q
  WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = q.doc_id AND r.a <= q.stop - length(q.piece) AND q.stop <= r.b) GROUP BY ALL)
SELECT d.doc_id, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words_removed, coalesce(removed, '') AS removed,
       sha256(coalesce(clean.text, '')) AS clean_sha256
FROM documents d LEFT JOIN spans USING (doc_id) LEFT JOIN clean USING (doc_id)
"""

#: CRC-32 by its polynomial; ``crc`` is the checksum of the column ``x`` of the table that {words} names.
_CRC32 = """
poly AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS i))),
sums AS (
  SELECT x, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, len(hex(x)) + 1, 2), lambda i: CAST('0x' || hex(x)[i:i + 1] AS BIGINT))),
                                        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS crc
  FROM (SELECT DISTINCT x FROM {words}), poly)"""

SQL["op11_resample"] = (
    r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT row, unnest(w) AS x FROM w),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
both_sides AS (SELECT x FROM d UNION ALL SELECT x FROM b),"""
    + _CRC32.format(words="both_sides")
    + r""",
s AS (SELECT crc % 10000 AS bucket, count(*) AS n FROM d JOIN sums USING (x) GROUP BY ALL),
t AS (SELECT crc % 10000 AS bucket, count(*) AS n FROM b JOIN sums USING (x) GROUP BY ALL),
total AS (SELECT (SELECT count(*) FROM d) + 10000.0 :: DOUBLE AS s, (SELECT count(*) FROM b) + 10000.0 :: DOUBLE AS t),
g AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1) * total.s / ((s.n + 1) * total.t))) AS gain
  FROM s LEFT JOIN t USING (bucket), total),
f AS (SELECT row, count(*) AS n, sum(gain) AS weight FROM d JOIN sums USING (x) JOIN g ON g.bucket = crc % 10000 GROUP BY ALL),
scored AS (
  SELECT doc_id, len(w.w) AS words, coalesce(f.n, 0) AS n_features, CAST(coalesce(f.weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(f.weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5 :: DOUBLE) / 4294967296.0 :: DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN f USING (row)),
ranked AS (SELECT *, CASE WHEN words >= 20 THEN row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place FROM scored)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CAST(CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM scored WHERE words >= 20) THEN place END AS BIGINT) AS rank
FROM ranked
"""
)

SQL["op12_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

SQL["op13_repair_conversations"] = (
    r"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS x FROM conversations),"""
    + _CRC32.format(words="c")
    + r""",
damaged AS (
  SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE role END AS role,
         CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE crc % 20 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM c JOIN sums USING (x)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
r AS (
  SELECT conv_id, turn, i, role, text, left(role, 1) AS ini,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault,
         left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
  FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM r GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0 AS i, {'c': 0, 'a': '', 't': [] :: VARCHAR[]} AS s0, {'c': 1000000000, 'a': '', 't': [] :: VARCHAR[]} AS s1,
         {'c': 2, 'a': 'I', 't': ['user:']} AS s2, {'c': 4, 'a': 'II', 't': ['user:', 'assistant:']} AS s3 FROM counts
  UNION ALL
  SELECT conv_id, i, n0 AS s0, n1 AS s1, m2 AS s2,
         least(n3, {'c': m2.c + 2, 'a': m2.a || 'I', 't': list_append(m2.t, 'assistant:')}) AS s3
  FROM (
    SELECT *, least(n2, {'c': n0.c + 2, 'a': n0.a || 'I', 't': list_append(n0.t, 'user:')}, {'c': n1.c + 2, 'a': n1.a || 'I', 't': list_append(n1.t, 'user:')},
                    {'c': n3.c + 2, 'a': n3.a || 'I', 't': list_append(n3.t, 'user:')}) AS m2
    FROM (
      SELECT dp.conv_id, r.i,
             {'c': s0.c + 3, 'a': s0.a || 'D', 't': s0.t} AS n0,
             least({'c': s1.c + 3, 'a': s1.a || 'D', 't': s1.t}, {'c': s0.c + CASE WHEN ini = 's' THEN stay ELSE 1000000000 END, 'a': s0.a || 'K', 't': list_append(s0.t, line)}) AS n1,
             least({'c': s2.c + 3, 'a': s2.a || 'D', 't': s2.t},
                   {'c': s0.c + CASE WHEN ini = 'u' THEN stay ELSE 1000000000 END, 'a': s0.a || 'K', 't': list_append(s0.t, line)},
                   {'c': s1.c + CASE WHEN ini = 'u' THEN stay ELSE 1000000000 END, 'a': s1.a || 'K', 't': list_append(s1.t, line)},
                   {'c': s3.c + CASE WHEN ini = 'u' THEN stay ELSE 1000000000 END, 'a': s3.a || 'K', 't': list_append(s3.t, line)},
                   {'c': s0.c + stay + 2, 'a': s0.a || 'R', 't': list_append(s0.t, 'user:' || text)},
                   {'c': s1.c + stay + 2, 'a': s1.a || 'R', 't': list_append(s1.t, 'user:' || text)},
                   {'c': s3.c + stay + 2, 'a': s3.a || 'R', 't': list_append(s3.t, 'user:' || text)}) AS n2,
             least({'c': s3.c + 3, 'a': s3.a || 'D', 't': s3.t},
                   {'c': s2.c + CASE WHEN ini = 'a' THEN stay ELSE 1000000000 END, 'a': s2.a || 'K', 't': list_append(s2.t, line)},
                   {'c': s2.c + stay + 2, 'a': s2.a || 'R', 't': list_append(s2.t, 'assistant:' || text)}) AS n3
      FROM dp JOIN (SELECT conv_id, i, ini, text, role || ':' || text AS line, CASE fault WHEN '' THEN 0 WHEN 't' THEN 1 ELSE 1000000000 END AS stay FROM r) r
        ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1))),
best AS (SELECT dp.conv_id, least(s0, s3) AS e FROM dp JOIN counts ON counts.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = counts.n)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.c, 0) AS BIGINT) AS cost,
       coalesce(e.a, '') AS audit, sha256(coalesce(array_to_string(e.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""
)
