"""DuckDB SQL with the rows of the queries."""

from __future__ import annotations

from quirework.functions.text import STOPWORDS

_WORDS = r"list_filter(list_transform(regexp_extract_all(coalesce({x}, ''), '[\p{{L}}\p{{Nd}}._/\-]+'), lambda w: trim(w, '._-/')), lambda w: w <> '')"
_CAMEL = r"string_split(regexp_replace(regexp_replace({x}, '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1' || chr(31) || '\2', 'g'), '(\p{{Ll}})(\p{{Lu}})', '\1' || chr(31) || '\2', 'g'), chr(31))"
_PARTS = r"list_filter(regexp_split_to_array({x}, '[._/\-]'), lambda q: q <> '')"


def terms(x: str) -> str:
    """The search terms of text ``x`` as an SQL list."""
    parts, stop = _PARTS.format(x="w"), ", ".join(f"'{s}'" for s in STOPWORDS)
    of_part = f"list_concat(CASE WHEN len({parts}) > 1 THEN [lower(p)] ELSE [] END, CASE WHEN len({_CAMEL.format(x='p')}) > 1 THEN list_transform({_CAMEL.format(x='p')}, lambda c: lower(c)) ELSE [] END)"
    plain = f"len({parts}) = 1 AND len({_CAMEL.format(x='w')}) = 1"
    word = f"CASE WHEN {plain} THEN CASE WHEN lower(w) IN ({stop}) THEN [] ELSE [lower(w)] END ELSE list_concat([lower(w)], flatten(list_transform({parts}, lambda p: {of_part}))) END"
    return f"list_filter(flatten(list_transform({_WORDS.format(x=x)}, lambda w: {word})), lambda t: strlen(t) BETWEEN 2 AND 64)"


def bm25(docs: str, queries: str, k: int, scoped: bool = False) -> str:
    """CTEs ending in ``hits``, from ``docs`` (scope, id, text) and ``queries`` (query_id, text[, scope])."""
    return f"""
d AS ({docs}), q AS ({queries}),
t AS (SELECT scope, id, {terms('text')} AS terms FROM d),
st AS (SELECT scope, count(*) AS n, CASE WHEN sum(len(terms)) = 0 THEN 1.0 ELSE sum(len(terms)) / count(*) END AS avgl FROM t GROUP BY scope),
qt AS (SELECT DISTINCT query_id{', scope AS qscope' if scoped else ''}, unnest({terms('text')}) AS term FROM q),
tf AS (SELECT scope, id, len, term, count(*) AS tf FROM (SELECT scope, id, len(terms) AS len, unnest(terms) AS term FROM t) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT query_id, scope, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avgl))), 6) AS score
       FROM tf JOIN df USING (scope, term) JOIN st USING (scope) JOIN qt USING (term) {'WHERE qscope = scope' if scoped else ''} GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, scope ORDER BY score DESC, id) AS INTEGER) AS rank FROM sc) WHERE rank <= {k})"""


_DOCS = "SELECT source AS scope, doc_id AS id, text FROM documents"
_ALL = "SELECT 'all' AS scope, doc_id AS id, text FROM documents"
_ITEMS = "SELECT item_id AS query_id, text FROM benchmark"
_COSINE = "round(coalesce(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / nullif(sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 0), 0), 6)"


def cosine(where: str, k: int) -> str:
    return f"""SELECT query_id, id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS id, {_COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND {where})) WHERE rank <= {k}"""


SQL: dict[str, str] = {}
SQL["tokenize_terms"] = f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM (SELECT doc_id, {terms('text')} AS t FROM documents)"
SQL["tokenize_page_terms"] = f"SELECT term, count(*) AS n FROM (SELECT unnest({terms('html')}) AS term FROM pages) GROUP BY term"
SQL["term_frequency"] = f"SELECT scope, term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM (SELECT source AS scope, doc_id, term, count(*) AS tf FROM (SELECT source, doc_id, unnest({terms('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY ALL"
SQL["bm25_corpus_stats"] = f"SELECT source AS scope, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total_length, round(CASE WHEN sum(n) = 0 THEN 1.0 ELSE sum(n) / count(*) END, 6) AS avg_length FROM (SELECT source, len({terms('text')}) AS n FROM documents) GROUP BY source"
SQL["bm25_topk_by_scope"] = f"WITH {bm25(_DOCS, _ITEMS, 10)} SELECT query_id, scope, id, score, rank FROM hits"
SQL["bm25_topk_global"] = f"WITH {bm25(_ALL, _ITEMS, 10)} SELECT query_id, id, score, rank FROM hits"
SQL["cosine_topk"] = cosine("true", 10)
SQL["cosine_topk_filtered"] = cosine("a.label = b.label", 10)
SQL["inverted_lists_topk"] = cosine("true", 10)
SQL["rrf_hybrid_topk"] = f"""WITH {bm25(_ALL, "SELECT doc_id AS query_id, text FROM documents WHERE doc_id % 50 = 0", 50)},
v AS ({cosine('true', 50)}),
u AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS part FROM hits UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM v),
s AS (SELECT query_id, id, round(sum(part), 8) AS score FROM u GROUP BY ALL)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) WHERE rank <= 10"""
_kept = "SELECT lang || '@' || source AS scope, doc_id AS id, text FROM documents WHERE lang IS NOT NULL"
SQL["all_retained_topk"] = f"WITH {bm25(_kept, _ITEMS, 3)} SELECT query_id, scope, id, score, rank FROM hits"
_own = bm25(_DOCS, "SELECT item_id AS query_id, text, 'src' || (item_id % 20) AS scope FROM benchmark", 5, True)
_latest = bm25(_DOCS, "SELECT item_id AS query_id, text, 'src19' AS scope FROM benchmark", 5, True)
SQL["compare_modes_union"] = f"SELECT *, 'project' AS mode FROM (WITH {_own} SELECT query_id, scope, id, score, rank FROM hits) UNION ALL SELECT *, 'latest' AS mode FROM (WITH {_latest} SELECT query_id, scope, id, score, rank FROM hits)"


def fnv(x: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, strlen({x}) + 1), lambda i: ascii(substr({x}, i, 1))::BIGINT)), lambda h, b: CAST((xor(h, b)::HUGEINT * 16777619) % 4294967296 AS BIGINT))"


SQL["eval_hit_mrr"] = f"""WITH {bm25(_ALL, _ITEMS, 10)},
r AS (SELECT item_id AS query_id, min(rank) AS rr FROM benchmark LEFT JOIN (SELECT h.query_id, h.rank FROM hits h JOIN documents x ON x.doc_id = h.id JOIN benchmark b ON b.item_id = h.query_id WHERE contains(x.text, b.text)) z ON z.query_id = item_id GROUP BY item_id),
g AS (SELECT rr, unnest(['all', 'half: ' || CASE WHEN {fnv("('q-' || query_id)")} % 2 = 0 THEN 'tune' ELSE 'test' END]) AS "group" FROM r)
SELECT "group", count(*) AS n, count(*) FILTER (rr <= 1) AS hit1, count(*) FILTER (rr <= 3) AS hit3, count(*) FILTER (rr <= 10) AS hit10, round(sum(CASE WHEN rr <= 10 THEN 1.0::DOUBLE / rr ELSE 0 END) / count(*), 6) AS mrr FROM g GROUP BY ALL"""
_GOLD = """gq AS (SELECT item_id AS query_id, 'src' || item_id % 20 AS dependency, CASE WHEN item_id % 2 = 0 THEN 'made' ELSE 'found' END AS source, item_id % 3 AS kind, text,
  array_to_string(string_split(text, ' ')[1:3], ' ') AS start FROM benchmark),
gc AS (SELECT source AS dependency, doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'S' || doc_id % 50 ELSE '' END AS symbol, lang AS package, text FROM documents),
gold AS (SELECT DISTINCT query_id, id, symbol FROM gq JOIN gc USING (dependency) WHERE id IN (query_id * 3, query_id * 7 + 1) OR contains(gc.text, gq.text) OR contains(gc.text, start)
  OR symbol <> '' AND query_id % 4 = 0 AND (package || '.' || symbol = 'en.S' || query_id % 50 OR symbol = 'S' || query_id % 9))"""
SQL["gold_answers"] = f"WITH {_GOLD} SELECT query_id, id FROM gold"
_RANKS = f"""{_GOLD},
own AS (WITH {bm25(_DOCS, "SELECT item_id AS query_id, 'src' || item_id % 20 AS scope, text FROM benchmark", 10, scoped=True)} SELECT 'own' AS method, query_id, id, rank FROM hits),
every AS (WITH {bm25(_ALL, _ITEMS, 10)} SELECT 'all' AS method, query_id, id, rank FROM hits),
h AS (SELECT method, query_id, id, rank, CASE WHEN symbol <> '' THEN package || '.' || symbol END AS name FROM (SELECT * FROM own UNION ALL SELECT * FROM every) JOIN gc USING (id)),
good AS (SELECT DISTINCT query_id, package || '.' || symbol AS name FROM gold JOIN gc USING (id, symbol) WHERE symbol <> ''),
rk AS (SELECT method, query_id, (SELECT min(rank) FROM h WHERE h.method = m.method AND h.query_id = gq.query_id AND h.id IN (SELECT id FROM gold WHERE gold.query_id = gq.query_id)) AS r,
  (SELECT min(rank) FROM h WHERE h.method = m.method AND h.query_id = gq.query_id AND (h.id IN (SELECT id FROM gold WHERE gold.query_id = gq.query_id) OR h.name IN (SELECT name FROM good WHERE good.query_id = gq.query_id))) AS l
  FROM gq, (SELECT unnest(['own', 'all']) AS method) m)"""
SQL["evaluation_table"] = f"""WITH {_RANKS},
a AS (SELECT query_id, CASE WHEN bool_or(symbol <> '') THEN 'API doc' ELSE 'prose' END AS answer FROM gold GROUP BY query_id),
grp AS (SELECT query_id, unnest(['all questions', CASE WHEN {fnv("'q-' || query_id")} % 2 = 0 THEN 'tune half' ELSE 'held-out test half' END, 'source: ' || source, 'kind: ' || kind, 'answer: ' || coalesce(answer, 'prose')]) AS g FROM gq LEFT JOIN a USING (query_id))
SELECT method, g AS "group", count(*) AS n, count(*) FILTER (r <= 1) AS hit1, count(*) FILTER (r <= 3) AS hit3, count(*) FILTER (r <= 10) AS hit10, count(*) FILTER (l <= 3) AS lenient3,
  round(sum(CASE WHEN r <= 10 THEN 1.0::DOUBLE / r ELSE 0 END) / count(*), 6) AS mrr, round(sum(CASE WHEN l <= 10 THEN 1.0::DOUBLE / l ELSE 0 END) / count(*), 6) AS lenient_mrr
FROM rk JOIN grp USING (query_id) GROUP BY method, g"""


def _poisson(u: str) -> str:
    """The Poisson number (mean 1) at ``u`` of the unit interval."""
    steps, upto, term = [], 0.0, 0.36787944117144233
    for k in range(12):
        upto += term
        steps.append(f"CASE WHEN {u} >= {upto!r}::DOUBLE THEN 1 ELSE 0 END")
        term /= k + 1
    return " + ".join(steps)


SQL["evaluation_bootstrap"] = f"""WITH {_RANKS},
d AS (SELECT query_id, sum(CASE WHEN method = 'own' THEN v ELSE 0 END) - sum(CASE WHEN method = 'all' THEN v ELSE 0 END) AS d FROM (SELECT *, CASE WHEN r <= 10 THEN 1.0::DOUBLE / r ELSE 0 END AS v FROM rk) GROUP BY query_id),
u AS (SELECT query_id, d, rep, CAST('0x' || substr(md5('0:' || query_id || ':' || rep), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM d, (SELECT unnest(range(1, 201)) AS rep)),
m AS (SELECT rep, sum(w * d) / sum(w) AS mean FROM (SELECT *, {_poisson('u')} AS w FROM u) GROUP BY rep HAVING sum(w) > 0),
p AS (SELECT mean, row_number() OVER (ORDER BY mean) - 1 AS place, count(*) OVER () AS n FROM m)
SELECT (SELECT round(avg(d), 6) FROM d) AS difference, round(min(mean) FILTER (place = n * 25 // 1000), 6) AS low, round(min(mean) FILTER (place = n * 975 // 1000), 6) AS high FROM p"""
SQL["tune_test_split"] = f"SELECT item_id, {fnv('name')} AS hash, CASE WHEN item_id % 7 = 0 OR {fnv('name')} % 2 = 0 THEN 'tune' ELSE 'test' END AS half FROM (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN 'dev-' ELSE 'q' END || item_id AS name FROM benchmark)"
SQL["latency_quantiles"] = "SELECT event_type, count(*) AS n, list_sort(list(value))[count(*) * 50 // 100 + 1] AS median, list_sort(list(value))[count(*) * 95 // 100 + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type"
SQL["phrase_copies"] = r"""WITH w AS (SELECT item_id, lower(text) AS low, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark)
SELECT a.item_id, b.item_id AS content_id, len(list_filter(range(1, len(b.w) - 3), lambda i: contains(a.low, array_to_string(b.w[i:i + 4], ' ')))) > 0 AS copied
FROM w a JOIN w b ON a.item_id - a.item_id % 2 = b.item_id - b.item_id % 2"""
SQL["answer_equivalence"] = r"""WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS s FROM conversations)
SELECT DISTINCT a.conv_id AS query_id, a.turn AS id FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = 0
WHERE a.turn = 0 OR len(list_intersect(a.s, b.s)) >= 0.3 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AND len(a.s) + len(b.s) > 0"""
SQL["metadata_filtered_points"] = "SELECT doc_id, source, lang FROM documents WHERE source = 'src3' AND lang = 'en'"
SQL["delete_ids_or_filter"] = "SELECT source, count(*) AS n FROM documents WHERE NOT (doc_id IN (1, 2, 3) OR source = 'src5') GROUP BY source"
_CHANGED = """SELECT source AS scope, doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN text || ' zebra unicorn' ELSE text END AS text FROM documents
  WHERE (doc_id % 3 <> 0 OR doc_id % 5 = 0) AND doc_id % 7 <> 0 AND doc_id % 11 <> 0 AND source IS DISTINCT FROM 'src5'
  UNION ALL SELECT source, doc_id, text FROM documents WHERE doc_id % 77 = 0"""
_SIZED = f"WITH d AS ({_CHANGED}), l AS (SELECT scope, id, len({terms('text')}) AS n FROM d)"
SQL["index_search_after_changes"] = f"""WITH {bm25(_CHANGED, "SELECT item_id AS query_id, text || ' unicorn' AS text FROM benchmark", 5)} SELECT query_id, scope, id, score, rank FROM hits"""
SQL["index_sizes_after_changes"] = f"{_SIZED} SELECT scope, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total, count(*) AS points, CAST(sum(n) AS BIGINT) AS length FROM l GROUP BY scope"
SQL["index_scope_filter"] = f"{_SIZED} SELECT scope, id, CAST(n AS INTEGER) AS length FROM l WHERE scope = 'src3'"
SQL["content_hash_reuse"] = "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, min(doc_id) OVER (PARTITION BY text) AS object_id, min(doc_id) OVER (PARTITION BY text) <> doc_id AS reused FROM documents"
SQL["reuse_counters"] = "SELECT source, count(*) FILTER (n > 1) AS reused, count(*) FILTER (n = 1) AS created FROM (SELECT source, row_number() OVER (PARTITION BY text ORDER BY source, doc_id) AS n FROM documents) GROUP BY source"
SQL["object_identity"] = "SELECT doc_id, sha256(strlen(source) || ':' || source || strlen(lang) || ':' || lang || strlen(text) || ':' || text) AS object_id FROM documents"
SQL["chunk_paragraph_pack"] = r"""WITH RECURSIVE p AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS parts FROM documents),
f AS (
  SELECT doc_id, 1 AS i, 0 AS ordinal, parts[1] AS chunk, parts FROM p WHERE len(parts) > 0
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN strlen(chunk) + 2 + strlen(parts[i + 1]) <= 500 THEN ordinal ELSE ordinal + 1 END,
         CASE WHEN strlen(chunk) + 2 + strlen(parts[i + 1]) <= 500 THEN chunk || chr(10) || chr(10) || parts[i + 1] ELSE parts[i + 1] END, parts
  FROM f WHERE i < len(parts))
SELECT doc_id, ordinal, CAST(strlen(chunk) AS INTEGER) AS bytes, md5(chunk) AS chunk_md5 FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, ordinal ORDER BY i DESC) AS n FROM f) WHERE n = 1"""
SQL["section_split"] = r"""WITH x AS (SELECT doc_id, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body FROM documents)
SELECT doc_id, CAST(0 AS INTEGER) AS ordinal, '' AS path, md5('intro') AS body_md5 FROM x
UNION ALL SELECT doc_id, 1, source, md5(body) FROM x UNION ALL SELECT doc_id, 2, source || ' > deep', md5('end') FROM x"""
# the first heading skips a level and counts as one down, so those that follow are below it
SQL["section_chunks_rendered"] = "SELECT conv_id, CAST(n - 1 AS INTEGER) AS section, CAST(0 AS INTEGER) AS part, CASE WHEN n = 1 THEN role ELSE first || ' > ' || role END AS path FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, first_value(role) OVER (PARTITION BY conv_id ORDER BY turn) AS first FROM conversations)"
SQL["section_chunks_packed"] = r"""WITH RECURSIVE t AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS section, '## ' || role AS heading,
  regexp_replace(replace(coalesce(text, ''), chr(10), chr(10) || chr(10)), '^\s+|\s+$', '', 'g') AS body FROM conversations),
p AS (SELECT *, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS parts, CASE WHEN body = '' THEN heading ELSE heading || chr(10) || chr(10) || body END AS whole FROM t),
f AS (
  SELECT conv_id, section, heading, 1 AS i, 0 AS part, parts[1] AS chunk, parts FROM p WHERE len(parts) > 0 AND strlen(whole) > 300
  UNION ALL
  SELECT conv_id, section, heading, i + 1, CASE WHEN strlen(chunk) + 2 + strlen(parts[i + 1]) <= 300 THEN part ELSE part + 1 END,
         CASE WHEN strlen(chunk) + 2 + strlen(parts[i + 1]) <= 300 THEN chunk || chr(10) || chr(10) || parts[i + 1] ELSE parts[i + 1] END, parts
  FROM f WHERE i < len(parts)),
c AS (
  SELECT conv_id, section, part, CASE WHEN part = 0 THEN heading || chr(10) || chr(10) || chunk ELSE chunk END AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, section, part ORDER BY i DESC) AS n FROM f) WHERE n = 1
  UNION ALL SELECT conv_id, section, 0, whole FROM p WHERE len(parts) = 0 OR strlen(whole) <= 300)
SELECT conv_id, section, part, CAST(strlen(content) AS INTEGER) AS bytes, md5(content) AS content_md5 FROM c"""
SQL["manifest_rollup"] = """SELECT lang AS generation, count(*) AS object_count, count(*) FILTER (first <> doc_id) AS reused_count, count(*) FILTER (first = doc_id) AS created_count, count(DISTINCT source) AS source_count,
any_value(c.n) AS chunk_count FROM (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first FROM documents) JOIN (SELECT lang AS g, count(DISTINCT line) AS n FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY lang) c ON c.g = lang GROUP BY lang"""
SQL["first_chunk_wins"] = "SELECT lang, CAST(length(text) AS INTEGER) AS length, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY lang, length(text)"
SQL["episode_packing"] = r"""WITH RECURSIVE r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, strlen(text)) AS i, strlen(text) AS b FROM conversations),
f AS (SELECT conv_id, i, 0 AS episode, b, b AS held FROM r WHERE i = 1
  UNION ALL SELECT r.conv_id, r.i, CASE WHEN held > 0 AND held + r.b > 500 THEN episode + 1 ELSE episode END, r.b, CASE WHEN held > 0 AND held + r.b > 500 THEN r.b ELSE held + r.b END FROM f JOIN r ON r.conv_id = f.conv_id AND r.i = f.i + 1)
SELECT conv_id, CAST(episode AS INTEGER) AS episode, count(*) AS chunks, CAST(sum(b) AS BIGINT) AS bytes FROM f GROUP BY conv_id, episode"""
SQL["episode_packing_of_corpus"] = r"""WITH RECURSIVE r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i, coalesce(strlen(text), 0) AS b FROM documents),
f AS (SELECT lang, i, 0 AS episode, b, b AS held FROM r WHERE i = 1
  UNION ALL SELECT r.lang, r.i, CASE WHEN held > 0 AND held + r.b > 12000 THEN episode + 1 ELSE episode END, r.b, CASE WHEN held > 0 AND held + r.b > 12000 THEN r.b ELSE held + r.b END FROM f JOIN r ON r.lang IS NOT DISTINCT FROM f.lang AND r.i = f.i + 1)
SELECT lang, CAST(episode AS INTEGER) AS episode, count(*) AS chunks, CAST(sum(b) AS BIGINT) AS bytes FROM f GROUP BY lang, episode"""
SQL["stride_sampling"] = "WITH r AS (SELECT event_id, user_id, row_number() OVER (ORDER BY event_id) - 1 AS p, count(*) OVER () AS n FROM events) SELECT event_id, user_id FROM r WHERE n <= 100 OR p IN (SELECT i * n // 100 FROM range(100) t(i), (SELECT any_value(n) AS n FROM r))"
SQL["breadcrumb_render"] = "SELECT doc_id, source || '@' || lang || CASE WHEN doc_id % 3 = 0 THEN ' > ' || lang || ' > ' || source WHEN doc_id % 2 = 0 THEN ' > docs/' || doc_id || ' > Symbol' ELSE '' END AS breadcrumb FROM documents"
SQL["keyword_texts"] = "SELECT doc_id, md5(CASE WHEN t = '' THEN text ELSE t || chr(10) || text END) AS text_md5, CASE WHEN t = '' THEN 'path' ELSE t END AS title FROM (SELECT doc_id, text, CASE WHEN doc_id % 3 <> 0 THEN '' WHEN doc_id % 2 = 0 THEN lang || '.' || source ELSE source END AS t FROM documents)"
SQL["symbol_fallback"] = "SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN source WHEN doc_id % 8 = 0 THEN 'func()' ELSE lang || '.' || source END AS content FROM documents"
SQL["unix_line_ends"] = "SELECT doc_id, md5(text) AS text_md5 FROM documents"
SQL["symbol_ranking"] = """WITH s AS (SELECT p_brand AS scope, p_partkey AS id, 'Part' || p_size || 'Of' || p_partkey AS symbol FROM part)
SELECT a.p_partkey AS query_id, a.p_brand AS scope, s.id, CASE WHEN a.p_partkey % 3 = 0 THEN 3.0 ELSE 1.0 END::DOUBLE AS score, CAST(1 AS INTEGER) AS rank FROM part a JOIN s ON s.scope = a.p_brand AND s.symbol = 'Part' || a.p_size || 'Of' || a.p_partkey"""
_REFS = """refs AS (SELECT CAST(o_custkey AS VARCHAR) AS project, 'go' AS ecosystem, 'p' || (o_custkey % 100) AS package, substr(o_orderpriority, 1, 1) AS version,
  CASE WHEN o_orderstatus = 'F' OR o_custkey % 100 % 3 = 0 THEN 'grace_period' WHEN o_orderkey % 97 = 0 THEN 'manual_pin' WHEN o_orderkey % 13 = 0 THEN 'project' ELSE 'grace_period' END AS reason, o_orderdate AS first_seen, o_orderdate AS last_seen FROM orders)"""
_GENS = """g AS (SELECT o_orderkey AS id, 'go' AS ecosystem, 'p' || (o_custkey % 100) AS package, substr(o_orderpriority, 1, 1) AS version,
  ['ACTIVE', 'SUPERSEDED', 'FAILED', 'INDEXING', 'VALIDATING'][o_orderkey % 5 + 1] AS state, o_orderdate AS updated_at FROM orders)"""
_PTRS = "ptr AS (SELECT package, version, max(id) AS generation FROM g WHERE state = 'ACTIVE' GROUP BY ALL)"
SQL["plan_full_outer"] = f"""WITH {_REFS}, {_GENS}, {_PTRS},
cur AS (SELECT project, package, arg_max(version, (last_seen, version)) AS old FROM refs WHERE last_seen < TIMESTAMP '1996-01-01' GROUP BY project, package),
des AS (SELECT project, package, min(version) AS version FROM refs WHERE last_seen >= TIMESTAMP '1995-01-01' GROUP BY ALL),
w AS (SELECT des.*, ptr.generation IS NOT NULL AS built, package < 'p5' AS mapped, nos.package IS NOT NULL AS sourceless FROM des LEFT JOIN ptr USING (package, version) LEFT JOIN (SELECT DISTINCT package, version FROM refs WHERE package >= 'p7') nos USING (package, version)),
b AS (SELECT coalesce(w.project, cur.project) AS project, coalesce(w.package, cur.package) AS package, version, old, NOT built AND (mapped OR NOT sourceless) AS build, CASE WHEN mapped THEN '' ELSE 'no knowledge source mapped' END AS why
      FROM w FULL JOIN cur ON w.project = cur.project AND w.package = cur.package),
a AS (SELECT project, package, CASE
  WHEN version IS NULL THEN [('DROP_REFERENCE', old, 'dependency removed'), ('GC_CANDIDATE', old, 'no longer referenced by this project (provisional — see RET-001)')]
  WHEN old IS NULL THEN list_concat([('ADD_REFERENCE', version, why)], CASE WHEN build THEN [('SYNC_VERSION', version, why)] ELSE [] END)
  WHEN old <> version THEN list_concat([('DROP_REFERENCE', old, 'version changed'), ('GC_CANDIDATE', old, 'no longer referenced by this project (provisional — see RET-001)'), ('ADD_REFERENCE', version, why)], CASE WHEN build THEN [('SYNC_VERSION', version, why)] ELSE [] END)
  WHEN build THEN [('SYNC_VERSION', version, 'referenced but not built — retrying')] ELSE [('NOOP', version, '')] END AS acts FROM b)
SELECT project, 'go' AS ecosystem, package, CAST(i - 1 AS INTEGER) AS ordinal, struct_extract(x, 1) AS kind, struct_extract(x, 2) AS version, struct_extract(x, 3) AS reason
FROM (SELECT project, package, unnest(acts) AS x, unnest(range(1, len(acts) + 1)) AS i FROM a)"""
SQL["gc_grace_expired"] = f"WITH {_REFS} SELECT ecosystem, package, version, 'grace_expired' AS reason FROM refs GROUP BY ecosystem, package, version HAVING count(*) FILTER (reason IN ('project', 'latest', 'manual_pin')) = 0 AND TIMESTAMP '2001-08-12' > max(last_seen) FILTER (reason = 'grace_period') + INTERVAL 14 DAY"
SQL["gc_orphans"] = f"WITH {_GENS} SELECT id, CASE WHEN state = 'FAILED' THEN 'failed' ELSE 'stale' END AS why FROM g WHERE (state = 'FAILED' OR state IN ('INDEXING', 'VALIDATING') AND TIMESTAMP '1996-01-01' > updated_at + INTERVAL 24 HOUR) AND id % 11 <> 0"
SQL["gc_superseded_duplicates"] = f"WITH {_GENS} SELECT id, package, version FROM g WHERE state = 'SUPERSEDED' AND (package, version) IN (SELECT (package, version) FROM g WHERE state = 'ACTIVE')"
SQL["reference_upsert"] = f"WITH {_REFS} SELECT project, package, version, reason, strftime(min(first_seen), '%Y-%m-%d') AS first_seen, strftime(max(last_seen), '%Y-%m-%d') AS last_seen FROM refs GROUP BY ALL"
SQL["drop_reference_grace"] = f"""WITH {_REFS}, gone AS (SELECT DISTINCT project, package, version FROM refs WHERE package < 'p3'),
l AS (SELECT * FROM refs WHERE (project, package, version) NOT IN (SELECT (project, package, version) FROM gone)),
n AS (SELECT package, version, reason FROM l UNION ALL SELECT DISTINCT package, version, 'grace_period' FROM gone WHERE (package, version) NOT IN (SELECT (package, version) FROM l))
SELECT package, version, reason, count(*) AS n FROM n GROUP BY ALL"""
SQL["promote_generations"] = f"""WITH {_GENS}, {_PTRS}, nw AS (SELECT package, version, max(id) AS new_id FROM g WHERE state = 'VALIDATING' AND id % 2 = 0 GROUP BY ALL),
s AS (SELECT id, CASE WHEN id = new_id THEN 'ACTIVE' WHEN new_id IS NOT NULL AND state = 'ACTIVE' THEN 'SUPERSEDED' ELSE state END AS state FROM g LEFT JOIN nw USING (package, version)),
p AS (SELECT coalesce(new_id, generation) AS x FROM ptr FULL JOIN nw USING (package, version))
SELECT state, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM s GROUP BY state UNION ALL SELECT 'pointers', count(*), CAST(sum(x) AS BIGINT) FROM p"""
SQL["promote_committed"] = f"""WITH {_GENS}, {_PTRS},
r AS (SELECT id, ecosystem, package, version, CASE WHEN state = 'VALIDATING' THEN 'READY' ELSE state END AS state FROM g),
fit AS (SELECT *, CASE WHEN id % 3 = 0 OR id % 4 = 1 THEN 'validation failed' WHEN state <> 'READY' THEN 'not ready' END AS why FROM r WHERE state IN ('READY', 'INDEXING')),
newest AS (SELECT package, version, max(id) AS nid FROM fit WHERE why IS NULL GROUP BY ALL),
o AS (SELECT 'outcome' AS part, coalesce(why, CASE WHEN id = nid THEN 'promoted' ELSE 'superseded' END) AS name, id FROM fit LEFT JOIN newest USING (package, version)
  UNION ALL SELECT 'outcome', 'unknown', -id FROM fit WHERE id % 50 = 3
  UNION ALL SELECT 'generations', CASE WHEN id = nid THEN 'ACTIVE' WHEN nid IS NOT NULL AND state = 'ACTIVE' THEN 'SUPERSEDED' ELSE state END, id FROM r LEFT JOIN newest USING (package, version)
  UNION ALL SELECT 'pointers', version, coalesce(nid, generation) FROM ptr FULL JOIN newest USING (package, version)
  UNION ALL SELECT 'no source', version, 0 FROM (SELECT DISTINCT package, version FROM r) WHERE (package, version) NOT IN (SELECT (package, version) FROM newest))
SELECT part, name, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM o GROUP BY part, name"""
SQL["rebuild_cleared"] = f"""WITH {_REFS}, {_GENS}, {_PTRS},
mine AS (SELECT DISTINCT project, package, version FROM refs WHERE reason <> 'manual_pin' AND package LIKE 'p1%'),
o AS (
  SELECT 'references' AS part, reason AS name, CAST(project AS BIGINT) AS id FROM refs WHERE (project, package, version) NOT IN (SELECT (project, package, version) FROM mine)
  UNION ALL SELECT 'pointers', version, generation FROM ptr WHERE (package, version) NOT IN (SELECT (package, version) FROM mine)
  UNION ALL SELECT 'generations', CASE WHEN id IN (SELECT generation FROM ptr WHERE (package, version) IN (SELECT (package, version) FROM mine)) THEN 'SUPERSEDED' ELSE state END, id FROM g)
SELECT part, name, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM o GROUP BY part, name"""
SQL["gc_cascade"] = f"""WITH {_REFS}, {_GENS}, {_PTRS},
gone AS (SELECT package, version FROM refs GROUP BY package, version HAVING count(*) FILTER (reason IN ('project', 'latest', 'manual_pin')) = 0 AND TIMESTAMP '2001-08-12' > max(last_seen) FILTER (reason = 'grace_period') + INTERVAL 14 DAY),
o AS (
  SELECT 'references' AS part, CAST(project AS BIGINT) AS id FROM refs WHERE (package, version) NOT IN (SELECT (package, version) FROM gone)
  UNION ALL SELECT 'pointers', generation FROM ptr WHERE (package, version) NOT IN (SELECT (package, version) FROM gone)
  UNION ALL SELECT 'generations', id FROM g WHERE (package, version) NOT IN (SELECT (package, version) FROM gone)
  UNION ALL SELECT 'chunks', l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT id FROM g WHERE (package, version) IN (SELECT (package, version) FROM gone))
  UNION ALL SELECT 'jobs SUCCEEDED', 0 FROM gone)
SELECT part, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM o GROUP BY part"""
SQL["active_pointer_join"] = f"WITH {_REFS}, {_GENS}, {_PTRS} SELECT DISTINCT project, package, version, generation IS NOT NULL AS has_active_generation FROM refs LEFT JOIN ptr USING (package, version)"
SQL["latest_active_argmax"] = f"WITH {_GENS}, {_PTRS} SELECT package, version, generation FROM (SELECT ptr.*, row_number() OVER (PARTITION BY ptr.package ORDER BY updated_at DESC, generation) AS n FROM ptr JOIN g ON g.id = generation) WHERE n = 1"
SQL["fleet_status"] = f"""WITH {_REFS}, {_GENS}, ptr AS (SELECT DISTINCT package, version FROM g WHERE state = 'ACTIVE' AND id % 2 = 0), d AS (SELECT DISTINCT project, package, version FROM refs)
SELECT count(DISTINCT project) AS projects, count(*) AS dependencies, count(ptr.package) AS active, count(*) - count(ptr.package) AS inactive FROM d LEFT JOIN ptr USING (package, version)"""
SQL["job_state_counts"] = "SELECT count(*) FILTER (event_id % 5 IN (0, 1)) AS pending, count(*) FILTER (event_id % 5 = 2) AS running, count(*) FILTER (event_id % 5 = 3) AS failed, count(*) AS total FROM events"
_HEALTH = "m AS (SELECT l_orderkey AS generation, count(DISTINCT l_suppkey) AS source_count, count(DISTINCT l_partkey) AS object_count, count(*) AS chunk_count, count(*) FILTER (l_returnflag <> 'R') AS point_count, count(DISTINCT l_linenumber) AS staged_count FROM lineitem GROUP BY l_orderkey)"
SQL["doctor_inconsistent_pointers"] = f"""WITH {_GENS}, {_PTRS}, {_HEALTH}
SELECT ptr.package, ptr.version, ptr.generation, CASE WHEN g.id IS NULL THEN 'dangling' WHEN g.state <> 'ACTIVE' THEN 'not active' WHEN chunk_count IS NULL THEN 'no manifest' WHEN point_count = 0 THEN 'empty' WHEN point_count <> chunk_count THEN 'counts differ' ELSE 'ok' END AS health
FROM ptr LEFT JOIN g ON g.id = ptr.generation AND g.id % 7 <> 0 LEFT JOIN m ON m.generation = ptr.generation"""
SQL["never_built_anti_join"] = f"""WITH {_REFS}, {_GENS}, ptr AS (SELECT DISTINCT package, version FROM g WHERE state = 'ACTIVE' AND id % 31 = 0)
SELECT DISTINCT package, version, package > 'p8' AS no_source FROM refs WHERE first_seen < TIMESTAMP '1998-08-01' - INTERVAL 5 MINUTE AND (package, version) NOT IN (SELECT (package, version) FROM ptr)"""
SQL["structural_validation"] = f"""WITH {_GENS}, {_HEALTH}
SELECT id AS generation, array_to_string(list_filter([CASE WHEN coalesce(source_count, 0) = 0 THEN 'no sources' END, CASE WHEN coalesce(object_count, 0) = 0 THEN 'no objects' END, CASE WHEN coalesce(chunk_count, 0) = 0 THEN 'no chunks' END,
  CASE WHEN coalesce(point_count, 0) <> coalesce(chunk_count, 0) THEN 'points differ from chunks' END, CASE WHEN m.generation IS NULL THEN 'manifest of another generation' END, CASE WHEN coalesce(staged_count, 0) <> coalesce(chunk_count, 0) THEN 'staged chunks differ from manifest' END], lambda x: x IS NOT NULL), '; ') AS failures
FROM g LEFT JOIN m ON m.generation = g.id"""
SQL["sanity_ratios"] = f"""WITH {_GENS}, {_HEALTH}, s AS (SELECT package, state, sum(object_count) AS o, sum(chunk_count) AS c FROM g JOIN m ON m.generation = g.id GROUP BY ALL)
SELECT a.package, array_to_string(list_filter([CASE WHEN b.o > 0 AND a.o / b.o < 0.9 THEN 'too few objects' END, CASE WHEN b.c > 0 AND a.c / b.c > 1.2 THEN 'too many chunks' END], lambda x: x IS NOT NULL), '; ') AS failures
FROM s a LEFT JOIN s b ON b.package = a.package AND b.state = 'ACTIVE' WHERE a.state = 'VALIDATING'"""
SQL["invalid_transitions"] = "SELECT l_returnflag AS from_state, l_linestatus AS to_state, count(*) AS n FROM lineitem WHERE (l_returnflag, l_linestatus) NOT IN (('A', 'F'), ('R', 'F')) GROUP BY ALL"
SQL["queue_bump"] = "SELECT user_id AS run, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, event_id) AS INTEGER) AS place FROM events"
SQL["import_longest_prefix"] = r"""WITH p AS (SELECT DISTINCT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS import_path FROM pages), m AS (SELECT DISTINCT regexp_extract(import_path, '^[^/]+(/[^/]+)?') AS module FROM p)
SELECT import_path, arg_max(module, length(module)) AS module FROM p JOIN m ON import_path = module OR starts_with(import_path, module || '/') GROUP BY import_path"""
SQL["registry_match"] = """WITH l AS (SELECT 'm' || (n_nationkey % 9) AS name, arg_max(n_name, n_nationkey) AS n_name FROM nation GROUP BY 1), i AS (SELECT name, unnest([n_name, 'shared']) AS package FROM l)
SELECT 'go' AS ecosystem, n_name AS package, min(i.name) AS manifest FROM nation LEFT JOIN i ON i.package = n_name GROUP BY n_name"""
SQL["ref_resolution"] = """WITH r AS (SELECT DISTINCT '1.' || p_size || '.0' AS ref, p_size AS commit FROM part UNION ALL SELECT DISTINCT 'rel-1.' || p_size || '.0', p_size FROM part WHERE p_size % 3 = 0),
c AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN '1.' || p_size || '.0' ELSE 'rel-1.' || p_size || '.0' END AS ref FROM part)
SELECT key, ref, commit FROM c JOIN r USING (ref)"""
SQL["file_listing_delta"] = """WITH o AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN upper(text) ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT CASE WHEN o.h IS NULL THEN 'added' WHEN n.h IS NULL THEN 'deleted' ELSE 'modified' END AS status, d.source || '/' || d.doc_id AS path FROM documents d LEFT JOIN o USING (doc_id) LEFT JOIN n USING (doc_id)
WHERE (o.h IS NULL) <> (n.h IS NULL) OR o.h <> n.h"""
SQL["package_names"] = "SELECT s_suppkey, 'my-' || lower(replace(s_name, '#', '-')) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'repository' ELSE 'official' END AS trust FROM supplier"
SQL["debounce_sessions"] = """WITH s AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
b AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS b FROM s)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, count(*) AS events, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM b GROUP BY user_id, b"""
SQL["coalesced_requests"] = """SELECT CAST(user_id AS VARCHAR) AS project, event_type = 'purchase' AS rebuild, bool_and(event_id % 2 = 0) AS offline, bool_or(event_id % 3 = 0) AS force, bool_or(event_id % 5 = 0) AS resolve,
CASE WHEN bool_or(event_id % 9 = 0) THEN '' ELSE string_agg(DISTINCT event_type, ',' ORDER BY event_type) END AS names, count(*) AS requests FROM events GROUP BY user_id, event_type = 'purchase'"""
SQL["coalesced_runs"] = """WITH r AS (SELECT *, user_id AS u, event_type = 'purchase' AS rebuild FROM events),
s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS n FROM r WINDOW w AS (PARTITION BY u, rebuild ORDER BY ts)),
b AS (SELECT *, sum(n) OVER (PARTITION BY u, rebuild ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT CAST(u AS VARCHAR) AS project, rebuild, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, bool_and(event_id % 2 = 0) AS offline, bool_or(event_id % 3 = 0) AS force, bool_or(event_id % 5 = 0) AS resolve,
CASE WHEN bool_or(event_id % 9 = 0) THEN '' ELSE string_agg(DISTINCT event_type, ',' ORDER BY event_type) END AS names, count(*) AS requests FROM b GROUP BY u, rebuild, run"""
SQL["validation_report"] = """WITH c AS (SELECT source AS generation, count(*) AS n, CAST(substr(source, 4) AS INT) AS k FROM documents WHERE source IS NOT NULL GROUP BY source),
f AS (SELECT generation, array_to_string(list_filter([CASE WHEN n % 3 = 0 THEN 'sanity: again' END, CASE WHEN n % 3 = 0 THEN 'sanity: by three' END, CASE WHEN n % 2 = 0 THEN 'structural: even' END,
  CASE WHEN k = 3 THEN 'version: no result' WHEN k % 5 = 0 THEN 'version: wrong version' END], lambda x: x IS NOT NULL), '; ') AS failures FROM c)
SELECT generation, CASE WHEN failures = '' THEN 'READY' ELSE 'FAILED' END AS state, failures FROM f"""

_NAME = "['CHANGELOG.md', 'a.md', 'b.MDX', 'c.txt', 'd.rst', 'LICENSE', 'e.go', 'history.TXT'][doc_id % 8 + 1]"
_PATH = "'d' || doc_id % 10 || '/e' || doc_id % 7 || '/' || doc_id || '/' ||"
_NORMALIZER = "CASE WHEN doc_id % 11 = 0 OR doc_id % 8 IN (0, 7) THEN 'release-notes' WHEN doc_id % 8 IN (1, 2) THEN 'markdown' WHEN doc_id % 8 IN (3, 4) OR doc_id % 8 = 5 AND doc_id % 3 = 0 THEN 'plaintext' END"
SQL["file_dispatch"] = f"SELECT doc_id, {_NORMALIZER} AS normalizer, CASE WHEN {_NORMALIZER} IS NOT NULL THEN 'sections' END AS chunker FROM documents"
SQL["normalized_objects"] = f"""WITH f AS (SELECT doc_id, {_NORMALIZER} AS normalizer, doc_id % 11 = 0 OR doc_id % 8 IN (0, 1, 2) AS md, CASE WHEN doc_id % 5 = 0 THEN '' ELSE '# v1.' || doc_id % 7 || '.0 notes' || chr(10) END || coalesce(text, '') AS content FROM documents)
SELECT doc_id, normalizer, CASE WHEN md THEN 'markdown' ELSE 'text' END AS content_type, md5(CASE WHEN md THEN content ELSE regexp_replace(content, '^\\s+|\\s+$', '', 'g') END) AS content_md5,
  CASE WHEN md AND normalizer = 'release-notes' AND doc_id % 5 <> 0 THEN 'v1.' || doc_id % 7 || '.0' ELSE '' END AS release_version FROM f WHERE normalizer IS NOT NULL"""
SQL["incremental_rebuild"] = f"""WITH f AS (SELECT doc_id, {_PATH} {_NAME} AS path, {_NORMALIZER} AS normalizer, doc_id % 11 = 0 OR doc_id % 8 IN (0, 1, 2) AS md,
  CASE WHEN doc_id % 5 = 0 THEN '' ELSE '# v1.' || doc_id % 7 || '.0 notes' || chr(10) END || coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN chr(10) || '# v9.9.9 more' || chr(10) ELSE '' END AS content FROM documents WHERE doc_id % 7 <> 0)
SELECT CASE WHEN doc_id % 6 = 1 THEN 'moved/' ELSE '' END || path AS path, normalizer, sha256(CASE WHEN md THEN content ELSE regexp_replace(content, '^\\s+|\\s+$', '', 'g') END) AS content_hash FROM f WHERE normalizer IS NOT NULL"""
SQL["pattern_matches"] = f"""WITH f AS (SELECT coalesce(source, 'none') AS repository, {_PATH} {_NAME} AS path FROM documents),
n AS (SELECT unnest(['*.md', '*.mdx', '*.txt', '*.rst', 'LICENSE*', 'license*', '*.go', 'go.mod']) AS name),
m AS (SELECT repository, name AS pattern, path FROM f, n WHERE regexp_matches(path, '^(.*/)?' || replace(replace(name, '.', '[.]'), '*', '[^/]*') || '(/.*)?$')
  UNION ALL SELECT repository, '/d3/e2/**/' || name, path FROM f, n WHERE regexp_matches(path, '^d3/e2/(.*/)?' || replace(replace(name, '.', '[.]'), '*', '[^/]*') || '(/.*)?$')
  UNION ALL SELECT repository, '/d1/*/1?1/', path FROM f WHERE regexp_matches(path, '^d1/[^/]*/1[^/]1/.*$')
  UNION ALL SELECT repository, 'd4/**/a.md', path FROM f WHERE regexp_matches(path, '^d4/(.*/)?a[.]md(/.*)?$')
  UNION ALL SELECT repository, 'e5/', path FROM f WHERE regexp_matches(path, '^(.*/)?e5/.*$'))
SELECT repository, pattern, count(*) AS n, min(path) AS first FROM m GROUP BY ALL"""
SQL["package_exports"] = """WITH p AS (SELECT *, p_brand AS package, CASE WHEN p_partkey % 4 = 0 THEN '__init__' ELSE 'm' || p_size % 5 END AS module FROM part),
d AS (SELECT package, module, p_partkey % 7 = 0 AS stub, p_partkey AS o, 'N' || p_size AS name, 'f' || p_partkey AS signature, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'doc' || p_partkey END AS doc FROM p WHERE p_partkey % 3 <> 0),
u AS (SELECT package, module, stub, name, min(o) AS first, arg_max(signature, o) AS signature, arg_max(doc, o) AS doc FROM d GROUP BY ALL),
e AS (SELECT coalesce(a.package, b.package) AS package, coalesce(a.name, b.name) AS name, a.name IS NULL AS late, coalesce(a.first, b.first) AS at_, coalesce(b.signature, a.signature) AS signature, CASE WHEN a.doc <> '' THEN a.doc ELSE coalesce(b.doc, '') END AS doc
  FROM (SELECT * FROM u WHERE module = '__init__' AND NOT stub) a FULL JOIN (SELECT * FROM u WHERE module = '__init__' AND stub) b ON a.package = b.package AND a.name = b.name),
i AS (SELECT package, CASE WHEN p_partkey % 10 = 0 THEN '_' ELSE '' END || 'L' || p_partkey % 40 AS name, min(p_partkey) AS at_, arg_max('m' || (p_size + 1) % 5, p_partkey) AS source, arg_max('N' || p_partkey % 50 + 1, p_partkey) AS original FROM p WHERE p_partkey % 3 = 0 AND module = '__init__' GROUP BY ALL),
l AS (SELECT DISTINCT package FROM p WHERE CAST(substr(package, 7, 2) AS INT) % 3 = 0),
w AS (SELECT package, n.name, 0 AS grp, false AS late, n.at_ FROM l, (VALUES ('N3', 0), ('L3', 1), ('N9', 2), ('L9', 3), ('L12', 5), ('X', 6)) n(name, at_)
  UNION ALL SELECT package, name, 0, late, at_ FROM e WHERE package NOT IN (SELECT package FROM l)
  UNION ALL SELECT package, name, 1, false, at_ FROM i WHERE package NOT IN (SELECT package FROM l) AND NOT starts_with(name, '_')),
f AS (SELECT w.*, e.signature, e.doc, '__init__' AS found_in FROM w JOIN e USING (package, name)
  UNION ALL SELECT w.*, u.signature, u.doc, i.source FROM w JOIN i USING (package, name) JOIN u ON u.package = w.package AND u.module = i.source AND u.name = i.original AND NOT u.stub WHERE (w.package, w.name) NOT IN (SELECT (package, name) FROM e))
SELECT package, CAST(row_number() OVER (PARTITION BY package ORDER BY grp, late, at_, name) - 1 AS INTEGER) AS position, name, signature, doc, found_in FROM f"""
SQL["promoted_metadata"] = "SELECT doc_id, '||' || '|' || coalesce(lang, '') || '|' || coalesce(source, '') AS metadata FROM documents"
SQL["files_within_borders"] = f"""WITH f AS (SELECT source AS repository, {_PATH} {_NAME} AS path FROM documents WHERE source IS NOT NULL)
SELECT * FROM f WHERE NOT starts_with(path, 'd3/e2/') AND NOT starts_with(path, 'd5/e1/')"""
SQL["python_package_folders"] = """WITH f AS (SELECT p_brand AS repository, p_partkey % 700 AS k, 'src' || p_partkey % 3 || '/pkg_' || p_partkey % 700 AS folder FROM part)
SELECT repository, 'Pkg-' || k AS package, CASE WHEN count(*) = 1 THEN min(folder) ELSE '' END AS folder, count(*) = 1 AS verified FROM f GROUP BY repository, k"""
SQL["git_repositories"] = r"""SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'host.example' WHEN 1 THEN split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) ELSE 'local' END AS host,
CASE page_id % 3 WHEN 0 THEN 'org/' || page_id WHEN 1 THEN trim(regexp_replace(regexp_replace(regexp_replace(split_part(url || '.git', '://', 2), '[?#].*$', ''), '^[^/]*', ''), '\.git$', ''), '/') ELSE 'srv/' || page_id END AS path FROM pages WHERE url IS NOT NULL"""
SQL["hits_with_content"] = f"SELECT query_id, h.id, h.rank, md5(text) AS content_md5 FROM ({cosine('true', 10)}) h JOIN documents d ON d.doc_id = h.id WHERE h.id % 3 <> 0"
SQL["point_provenance"] = """WITH l AS (SELECT source, lang, len(string_split(text, chr(10))) AS n FROM documents WHERE doc_id % 4 <> 0 AND text IS NOT NULL)
SELECT CASE WHEN source LIKE '%3' THEN 'registry' ELSE lang END AS source_type, CASE WHEN source LIKE '%3' THEN 'high' ELSE 'low' END AS authority, CAST(sum(n) AS BIGINT) AS n FROM l GROUP BY ALL"""
SQL["symbol_dependencies"] = """WITH d AS (SELECT o_custkey AS project, o_orderkey AS version, CASE WHEN o_orderstatus = 'O' THEN 'go' ELSE 'node' END AS dependency_ecosystem, substr(o_orderpriority, 1, 1) AS module FROM orders),
s AS (SELECT c_custkey AS project, CAST(c_custkey % 5 + 1 AS VARCHAR) AS module, CASE WHEN c_custkey % 2 = 0 THEN 'go' ELSE '' END AS ecosystem FROM customer)
SELECT s.project, s.module, arg_min(dependency_ecosystem, version) AS dependency_ecosystem, min(version) AS version FROM s LEFT JOIN d ON d.project = s.project AND d.module = s.module AND (s.ecosystem = '' OR s.ecosystem = d.dependency_ecosystem) GROUP BY s.project, s.module"""
_SITES = """u AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') || '-' || CAST(floor(l_quantity) AS INT) AS use_id, l_suppkey AS file, (l_partkey % 300) * 1048576 + l_orderkey % 90 AS s, (l_partkey % 300 + CAST(floor(l_quantity) AS INT) % 40) * 1048576 + CAST(floor(l_quantity) AS INT) AS e,
  CASE WHEN l_orderkey % 11 = 0 THEN '' ELSE CAST(l_orderkey % 6 AS VARCHAR) END AS module, 'pkg.Symbol' || l_partkey AS symbol FROM lineitem WHERE l_linenumber <= 3),
x AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') || '-' || CAST(floor(l_quantity) AS INT) AS site_id, CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE l_suppkey END AS file,
  CASE WHEN l_orderkey % 10 = 0 THEN 150 * 1048576 + 20 ELSE (l_partkey % 300) * 1048576 + l_orderkey % 90 + 3 END AS pos, l_orderkey % 60 AS project, CASE WHEN l_orderkey % 2 = 0 THEN '' ELSE 'asked' END AS text FROM lineitem WHERE l_linenumber > 3),
f AS (SELECT site_id, arg_min(use_id, (e - s, -s, use_id)) AS use_id FROM x JOIN u ON u.file = x.file AND s <= pos AND pos < e GROUP BY site_id)"""
SQL["call_site_uses"] = f"WITH {_SITES} SELECT site_id, use_id FROM f"
SQL["call_site_targets"] = f"""WITH {_SITES},
d AS (SELECT o_custkey AS project, substr(o_orderpriority, 1, 1) AS module, min(o_orderkey) AS version FROM orders GROUP BY ALL),
r AS (SELECT site_id, symbol, module, version, text FROM f JOIN u USING (use_id) JOIN x USING (site_id) LEFT JOIN d USING (project, module) WHERE module <> '')
SELECT site_id, symbol, CASE WHEN version IS NOT NULL THEN 'go' END AS ecosystem, module AS package, version, CASE WHEN version % 3 = 0 THEN version * 2 END AS generation, CASE WHEN text = '' THEN symbol ELSE text END AS query_text,
  CASE WHEN version IS NULL THEN 'dependency not found' WHEN version % 3 <> 0 THEN 'no active generation for this version' END AS error FROM r"""
SQL["release_notes_between"] = f"""WITH {_REFS}, {_GENS}, {_PTRS}, q AS (SELECT c_custkey AS query_id, 'p' || c_custkey % 130 AS package, CAST(c_custkey % 3 + 1 AS VARCHAR) AS a, CAST(c_custkey % 3 + 2 AS VARCHAR) AS b FROM customer),
k AS (SELECT q.*, package IN (SELECT package FROM refs) AS known, coalesce((SELECT generation FROM ptr WHERE ptr.package = q.package AND version = b), (SELECT generation FROM ptr WHERE ptr.package = q.package AND version = a)) AS generation FROM q)
SELECT query_id, 'go' AS ecosystem, CAST(l_linenumber AS VARCHAR) AS version, l_orderkey || '-' || l_linenumber AS excerpt, NULL AS error FROM k JOIN lineitem ON l_orderkey = generation WHERE l_returnflag = 'R' AND CAST(l_linenumber AS VARCHAR) IN (a, b)
UNION ALL SELECT query_id, NULL, NULL, NULL, 'dependency not found' FROM k WHERE NOT known"""
SQL["search_scopes"] = f"""WITH {_REFS}, {_GENS.replace('FROM orders)', 'FROM orders WHERE o_orderkey % 7 = 0)')}, {_PTRS},
q AS (SELECT c_custkey AS query_id, ['project', 'latest', 'compare', 'all-retained'][c_custkey % 4 + 1] AS mode, CAST(c_custkey + c_custkey % 3 * 7 AS VARCHAR) AS project, 'p' || c_custkey % 110 AS package FROM customer),
o AS (SELECT query_id, mode, 'project' AS found_by, (SELECT generation FROM ptr WHERE ptr.package = q.package AND ptr.version = v) AS generation, CASE WHEN project NOT IN (SELECT project FROM refs) THEN 'project not found' WHEN v IS NULL THEN 'dependency not found' END AS e
  FROM (SELECT q.*, (SELECT arg_min(version, (last_seen, version)) FROM refs WHERE refs.project = q.project AND refs.package = q.package) AS v FROM q) q WHERE mode IN ('project', 'compare')),
n AS (SELECT query_id, mode, 'latest' AS found_by, (SELECT generation FROM ptr WHERE ptr.package = q.package AND ptr.version = v) AS generation, CASE WHEN v IS NULL THEN 'dependency not found' END AS e
  FROM (SELECT q.*, (SELECT arg_min(version, 'go|' || refs.package || '|' || version || '|' || refs.project) FROM refs WHERE refs.package = q.package AND refs.package >= 'p3' AND CAST(refs.project AS BIGINT) % 4 = 0) AS v FROM q) q WHERE mode IN ('latest', 'compare')),
u AS (SELECT query_id, mode, found_by, generation, CASE WHEN generation IS NULL THEN coalesce(e, 'no active generation for this version') END AS error FROM (SELECT * FROM o UNION ALL SELECT * FROM n))
SELECT query_id, generation, error, found_by FROM u WHERE mode <> 'compare' OR generation IS NOT NULL
UNION ALL SELECT query_id, NULL, 'compare: project search: ' || max(error) FILTER (found_by = 'project') || '; latest search: ' || max(error) FILTER (found_by = 'latest'), 'compare' FROM u WHERE mode = 'compare' GROUP BY query_id HAVING count(generation) = 0
UNION ALL SELECT query_id, generation, NULL, 'all-retained' FROM q JOIN ptr USING (package) JOIN (SELECT DISTINCT package, version FROM refs) USING (package, version) WHERE mode = 'all-retained'
UNION ALL SELECT query_id, NULL, 'dependency not found', 'all-retained' FROM q WHERE mode = 'all-retained' AND package NOT IN (SELECT package FROM refs)"""
SQL["described_packages"] = f"""WITH {_REFS}, {_GENS}, {_PTRS}, {_HEALTH}, a AS (SELECT ptr.package, arg_max(ptr.version, (updated_at, -generation)) AS active_version, arg_max(generation, (updated_at, -generation)) AS generation, list(ptr.version ORDER BY ptr.version) AS vs FROM ptr JOIN g ON g.id = generation GROUP BY 1)
SELECT r.package, CASE WHEN r.package < 'p5' AND r.package IN (SELECT package FROM g) THEN upper(r.package) END AS alias, active_version, a.generation, array_to_string(list_filter(vs, lambda v: v <> active_version), ',') AS other_versions, object_count, chunk_count,
  CASE WHEN a.generation IS NULL THEN NULL WHEN m.generation IS NULL THEN 'unknown' ELSE 'READY' END AS status, point_count FROM (SELECT DISTINCT package FROM refs) r LEFT JOIN a USING (package) LEFT JOIN m ON m.generation = a.generation"""
SQL["hybrid_counts"] = "SELECT count(DISTINCT id) AS points FROM (SELECT doc_id AS id FROM documents UNION SELECT vec_id FROM embeddings)"
SQL["unranked_scan"] = "SELECT * FROM (SELECT source AS scope, doc_id AS id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS rank, 0.0::DOUBLE AS score FROM documents WHERE source IS NOT NULL) WHERE rank <= 7"
SQL["lowest_chunk_sample"] = "SELECT generation, chunk_id FROM (SELECT l_suppkey AS generation, l_orderkey || '-' || l_linenumber AS chunk_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey || '-' || l_linenumber) AS n FROM lineitem) WHERE n <= 5"
SQL["corpus_sweep"] = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT doc_id, line, count(*) AS n FROM l GROUP BY ALL)
SELECT (SELECT count(*) FROM documents) AS objects, CAST(sum(n) AS BIGINT) AS chunks, CAST(sum(CASE WHEN line = '' THEN n ELSE 0 END) AS BIGINT) AS empty_chunks, CAST(sum(n - 1) AS BIGINT) AS duplicate_ids, CAST(sum(CASE WHEN strlen(line) > 500 THEN n ELSE 0 END) AS BIGINT) AS oversized_chunks FROM b"""
SQL["last_promotion"] = f"WITH {_GENS}, {_PTRS} SELECT strftime(max(updated_at), '%Y-%m-%d') AS last_promotion FROM ptr JOIN g ON g.id = ptr.generation"
SQL["embedding_prompts"] = "SELECT doc_id, md5('title: ' || CASE WHEN doc_id % 3 = 0 OR coalesce(source, '') = '' THEN 'none' ELSE source END || ' | text: ' || text) AS prompt_md5, doc_id % 2 = 0 AS plain FROM documents"
SQL["embedding_cache_misses"] = """WITH t AS (SELECT coalesce(text, '') AS text FROM documents), c AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents WHERE doc_id % 3 = 0)
SELECT 'hit' AS kind, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM t WHERE text IN (SELECT text FROM c) UNION ALL SELECT 'miss', count(*), CAST(sum(length(text)) AS BIGINT) FROM (SELECT DISTINCT text FROM t WHERE text NOT IN (SELECT text FROM c))"""
SQL["vector_states"] = f"WITH {_GENS}, {_PTRS} SELECT generation, CASE WHEN generation % 9 = 0 THEN 'no replica' WHEN generation % 4 = 0 THEN 'none' WHEN generation % 3 = 0 THEN 'stale' ELSE 'current' END AS vectors FROM ptr"
SQL["embedding_switch"] = f"""WITH {_GENS}, {_PTRS}, p AS (SELECT DISTINCT l_orderkey AS generation FROM lineitem WHERE (l_orderkey % 5 <> 0 OR l_linenumber = 1) AND l_orderkey % 7 <> 0),
s AS (SELECT generation, generation NOT IN (SELECT generation FROM p) AS lost, CASE WHEN generation % 9 = 0 THEN 'no replica' WHEN generation % 4 = 0 THEN 'none' WHEN generation % 3 = 0 THEN 'stale' ELSE 'current' END AS v FROM ptr)
SELECT generation, v = 'stale' AND NOT lost AS "drop", v IN ('stale', 'none') OR v = 'current' AND lost AS embed FROM s"""
SQL["embedding_faults"] = """SELECT label AS generation, 'dimensions' AS fault, count(*) AS points FROM embeddings WHERE vec_id % 97 = 0 GROUP BY label
UNION ALL SELECT label, 'two kinds of metadata', count(*) FROM embeddings WHERE label < 2 GROUP BY label HAVING count(DISTINCT vec_id % 2) = 2"""
