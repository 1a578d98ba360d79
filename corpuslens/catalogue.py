"""The registered queries over the reference tables, and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslens.functions import text as T
from corpuslens.engine import Engine
from corpuslens.operators import chunking, entities, graph, resolution, retrieval, spans, structure

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: Words of the lexical queries; ids of the vectors and entities asked for.
TERMS, OTHER = ["with", "from", "that"], ["what", "are"]
VECTOR, ENTITY, FRIEND, DEPTH = 0, 1, 2, 2
NOW = "2025-01-01 00:00:00"

# Parts that the SQL of several queries begins with.
_TOKENS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '' AND strlen(t) <= 40)"
_DOCS = f"d AS (SELECT doc_id AS id, {_TOKENS} AS toks FROM documents), s AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM d)"


def _bm25_sql(queries: dict[int, list[str]]) -> str:
    values = ", ".join(f"({q}, '{t}')" for q, ts in queries.items() for t in ts)
    return f"""{_DOCS}, q(query_id, term) AS (VALUES {values}), terms AS (SELECT DISTINCT term FROM q),
tf AS (SELECT id, len(toks) AS len, term, len(list_filter(toks, lambda x: x = term)) AS tf FROM d, terms),
hit AS (SELECT * FROM tf WHERE tf > 0), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
scored AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
FROM hit JOIN df USING (term) JOIN q USING (term), s GROUP BY query_id, id)"""


_DENSE = f"dense AS (SELECT e.vec_id AS id, round(list_dot_product(e.embedding::DOUBLE[], o.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = {VECTOR}) o)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _asked(spark: SparkSession, d: str) -> list[float]:
    return _t(spark, d, "embeddings").where(F.col("vec_id") == VECTOR).first().embedding


@query(f"WITH {_bm25_sql({0: TERMS})} SELECT id AS doc_id, score, row_number() OVER (ORDER BY score DESC, id)::INT AS rank FROM scored ORDER BY score DESC, id LIMIT 10")
def bm25_topk(spark, d):
    best = retrieval.bm25(_t(spark, d, "documents"), {0: TERMS}).orderBy(F.desc("score"), "id").limit(10)
    return best.select(F.col("id").alias("doc_id"), "score", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))


_MANY = {0: TERMS, 1: OTHER, 2: ["der", "und", "nicht"], 3: ["que", "los"]}


@query(f"WITH {_bm25_sql(_MANY)} SELECT * FROM (SELECT query_id, id AS doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM scored) WHERE rank <= 5")
def bm25_multi_query(spark, d):
    return retrieval.top(retrieval.bm25(_t(spark, d, "documents"), _MANY), 5).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query(f"WITH {_DOCS}, t AS (SELECT id, unnest(toks) AS term FROM d) SELECT term, count(*) AS cf, count(DISTINCT id) AS df FROM t GROUP BY term ORDER BY df DESC, term LIMIT 50")
def term_stats(spark, d):
    tf = _t(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term", "doc_id").count()
    return tf.groupBy("term").agg(F.sum("count").alias("cf"), F.count("*").alias("df")).orderBy(F.desc("df"), "term").limit(50)


@query(f"SELECT lang, count(*) AS n_docs, round(avg(len({_TOKENS})), 6) AS avg_len FROM documents GROUP BY lang")
def field_stats(spark, d):
    return _t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n_docs"), F.round(F.avg(F.size(T.tokens(F.col("text")))), 6).alias("avg_len"))


@query(f"WITH {_DENSE} SELECT id AS vec_id, score FROM dense ORDER BY score DESC, id LIMIT 10")
def vector_knn(spark, d):
    return retrieval.vector_search(_t(spark, d, "embeddings"), _asked(spark, d)).orderBy(F.desc("score"), "id").limit(10).withColumnRenamed("id", "vec_id")


@query("SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) >= 0.3")
def vector_pairs_threshold(spark, d):
    vectors = _t(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.pairs_above(vectors, 0.3)


@query(f"WITH {_DOCS} SELECT id, len(list_filter(range(len(toks)), lambda i: toks[i + 1] = 'in' AND toks[i + 2] = 'the')) AS hits FROM d WHERE hits > 0")
def phrase_search(spark, d):
    return retrieval.phrase(_t(spark, d, "documents"), ["in", "the"])


@query(f"WITH {_DOCS} SELECT id AS doc_id FROM d WHERE list_contains(toks, 'the') AND NOT list_contains(toks, 'with')")
def must_not_term(spark, d):
    t = T.tokens(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", t.alias("t")).where(F.array_contains("t", "the") & ~F.array_contains("t", "with")).select("doc_id")


def _norm(name: str) -> str:
    return f"SELECT id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END AS s FROM {name}"


_FUSED = f"WITH {_bm25_sql({0: TERMS})}, {_DENSE}, lex30 AS (SELECT * FROM scored ORDER BY score DESC, id LIMIT 30), vec30 AS (SELECT * FROM dense ORDER BY score DESC, id LIMIT 30), a AS ({_norm('lex30')}), b AS ({_norm('vec30')}), f AS (SELECT coalesce(a.id, b.id) AS id, round(0.5 * coalesce(a.s, 0.0) + 0.5 * coalesce(b.s, 0.0), 6) AS score FROM a FULL OUTER JOIN b ON a.id = b.id)"


def _candidates(spark, d):
    lexical = retrieval.bm25(_t(spark, d, "documents"), {0: TERMS}).orderBy(F.desc("score"), "id").limit(30)
    dense = retrieval.vector_search(_t(spark, d, "embeddings"), _asked(spark, d)).orderBy(F.desc("score"), "id").limit(30)
    return retrieval.fused(lexical, dense, 0.5)


@query(f"{_FUSED} SELECT id, score FROM f")
def hybrid_full_outer(spark, d):
    return _candidates(spark, d)


@query(f"{_FUSED} SELECT id, score FROM f ORDER BY score DESC, id LIMIT 10")
def hybrid_alpha(spark, d):
    return _candidates(spark, d).orderBy(F.desc("score"), "id").limit(10)


@query(f"WITH {_bm25_sql({0: TERMS})} SELECT id AS doc_id, round(score * (1 + 0.4 * exp(-ln(2.0) / 30 * (id % 365))), 6) AS score FROM scored ORDER BY 2 DESC, 1 LIMIT 10")
def recency_rank(spark, d):
    now = F.lit(NOW).cast("timestamp")
    scored = retrieval.bm25(_t(spark, d, "documents"), {0: TERMS})
    modified = F.timestamp_seconds(F.unix_timestamp(now) - F.col("id") % 365 * 86400)
    return scored.select(F.col("id").alias("doc_id"), F.round(retrieval.recency(F.col("score"), modified, now), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


@query("SELECT doc_id, 'code:' || lang AS content_type FROM documents WHERE contains('code:' || lang, 'code') AND contains(source || '/' || doc_id::VARCHAR, 'src1/')")
def type_scope_filter(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("code:"), "lang").alias("content_type"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return docs.where(F.col("content_type").contains("code") & F.col("path").contains("src1/")).select("doc_id", "content_type")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS m FROM orders) WHERE m IS NULL OR (m >= TIMESTAMP '1996-01-01' AND m <= TIMESTAMP '1996-12-31')")
def date_filter_keep_unknown(spark, d):
    m = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    return _t(spark, d, "orders").select("o_orderkey", m.alias("m")).where("m is null or (m >= timestamp'1996-01-01' and m <= timestamp'1996-12-31')").select("o_orderkey")


_NEGATED = {0: TERMS, 1: OTHER}


@query(f"WITH {_bm25_sql(_NEGATED)}, bad AS (SELECT id FROM (SELECT * FROM scored WHERE query_id = 1 ORDER BY score DESC, id LIMIT 100) WHERE score > 0.5) SELECT id AS doc_id, score FROM scored WHERE query_id = 0 AND id NOT IN (SELECT id FROM bad)")
def negation_anti(spark, d):
    scored = retrieval.bm25(_t(spark, d, "documents"), _NEGATED)
    bad = scored.where("query_id = 1").orderBy(F.desc("score"), "id").limit(100).where("score > 0.5").select("id")
    return scored.where("query_id = 0").join(bad, "id", "left_anti").select(F.col("id").alias("doc_id"), "score")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def tag_semi(spark, d):
    return _t(spark, d, "documents").select("doc_id", "lang").join(_t(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("SELECT 'quality:' || quality::VARCHAR AS tag, count(*) AS n FROM labels GROUP BY quality UNION ALL SELECT 'toxic:' || toxic::VARCHAR, count(*) FROM labels GROUP BY toxic")
def tag_counts(spark, d):
    tags = F.array(F.concat(F.lit("quality:"), F.col("quality").cast("string")), F.concat(F.lit("toxic:"), F.col("toxic").cast("string")))
    return _t(spark, d, "labels").select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


_IN = lambda ws: "(" + ", ".join(f"'{w}'" for w in ws) + ")"
_KEYWORDS = f"list_filter(string_split_regex(lower(text), '\\s+'), lambda w: length(w) > 1 AND w NOT IN {_IN(T.STOP_WORDS)})"


@query(f"SELECT conv_id, turn, array_to_string({_KEYWORDS}, ' ') AS keywords FROM conversations")
def parse_keywords(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


@query(f"""WITH c AS (SELECT conv_id, turn, text, len({_KEYWORDS}) AS k, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM conversations)
SELECT conv_id, turn, round(least(0.95, greatest(0.05, 0.5 + CASE WHEN coalesce(lower(w[1]), '') IN {_IN(T.QUESTION_WORDS)} THEN 0.15 ELSE 0 END + CASE WHEN k <= 2 THEN -0.15 ELSE 0 END + CASE WHEN len(w) >= 5 THEN 0.1 ELSE 0 END
 + CASE WHEN contains(text, '"') THEN -0.25 ELSE 0 END
 + CASE WHEN len(list_filter(w, lambda x: contains(x, '_') OR contains(x, '::') OR contains(x, '.') OR (regexp_matches(x, '\\p{{Lu}}') AND regexp_matches(x, '\\p{{Ll}}') AND NOT regexp_matches(x, '^.\\p{{Ll}}*$')))) > 0 THEN -0.2 ELSE 0 END
 + CASE WHEN len(w) > 0 AND len(list_filter(w, lambda x: lower(x) IN {_IN(T.STOP_WORDS)})) > 0.4 * len(w) THEN 0.1 ELSE 0 END))::DOUBLE, 6) AS alpha FROM c""")
def dynamic_alpha(spark, d):
    text = F.col("text")
    return _t(spark, d, "conversations").select("conv_id", "turn", T.dynamic_alpha(text, F.size(T.keywords(text))).alias("alpha"))


@query(f"WITH {_DOCS} SELECT doc_id, instr(lower(text), 'with')::INT AS at, CASE WHEN length(text) > 300 THEN 300 ELSE length(text) END::INT AS most FROM documents WHERE contains(lower(text), 'with')")
def term_positions(spark, d):
    n = F.length("text")
    return _t(spark, d, "documents").where(F.lower("text").contains("with")).select("doc_id", F.instr(F.lower("text"), "with").alias("at"), F.when(n > 300, 300).otherwise(n).alias("most"))


@query()
def snippet_window(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.snippet(F.col("text"), TERMS).alias("snippet"))


def _plain_pattern(p: str) -> str:
    """The pattern without what only keeps long runs cheap."""
    for more in (r"(?:(?<![\w.+-])|\G)", r"(?:v|(?<!\d)|\G)"):
        p = p.replace(more, "v?" if "v|" in more else "")
    return p.replace("++", "+")


_LEAST = " ".join(f"WHEN '{k}' THEN {n}" for k, n in graph.LEAST.items())
_NOT = "(" + ", ".join(f"'{w}'" for w in graph.NO_IDENTIFIERS) + ")"
_FOUND = " UNION ALL ".join(f"SELECT id, {k} AS rank, '{kind}' AS entity_type, unnest(regexp_extract_all(text, '{_plain_pattern(p)}')) AS value FROM every" for k, (kind, p) in enumerate(graph.PATTERNS))
_PATTERNS = f"SELECT * FROM ({_FOUND}) WHERE strlen(value) >= CASE entity_type {_LEAST} ELSE 1 END AND NOT (entity_type = 'identifier' AND lower(value) IN {_NOT})"
_EVERY = "WITH every AS (SELECT 'd' || doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'p' || page_id::VARCHAR, html FROM pages)"


def _mentions(spark, d):
    docs = _t(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    pages = _t(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")), "html")
    return graph.mentions(docs.union(pages), "id", "text")


@query(f"{_EVERY}, m AS ({_PATTERNS}) SELECT entity_type, count(*) AS n, count(DISTINCT value) AS n_values FROM m GROUP BY entity_type")
def regex_entities(spark, d):
    return _mentions(spark, d).groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


@query(f"{_EVERY}, m AS ({_PATTERNS}) SELECT id, entity_type, value, count(*) AS n FROM m GROUP BY ALL")
def entity_mentions(spark, d):
    return _mentions(spark, d).groupBy("id", "entity_type", "value").agg(F.count("*").alias("n"))


def _star(spark, d, key="l_suppkey"):
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.col(key).alias("entity"))
    return lines.join(_t(spark, d, "orders").select(F.col("o_orderkey").alias("chunk"), F.col("o_custkey").alias("doc")), "chunk")


def _edges_sql(key: str) -> str:
    return f"m AS (SELECT DISTINCT l_orderkey AS chunk, o_custkey AS doc, {key} AS entity FROM lineitem JOIN orders ON l_orderkey = o_orderkey), e AS (SELECT x.entity AS a, y.entity AS b, count(DISTINCT x.chunk) AS weight, count(DISTINCT x.doc) AS doc_count FROM m x JOIN m y ON x.chunk = y.chunk AND x.entity < y.entity GROUP BY ALL)"


@query(f"WITH {_edges_sql('l_suppkey')} SELECT * FROM e")
def cooccurrence_star(spark, d):
    return graph.cooccurrence(_star(spark, d))


@query(f"WITH {_edges_sql('l_suppkey')} SELECT CASE WHEN a = {ENTITY} THEN b ELSE a END AS dst, weight FROM e WHERE a = {ENTITY} OR b = {ENTITY}")
def entity_neighbors(spark, d):
    return graph.neighbours(graph.cooccurrence(graph.beside(_star(spark, d), ENTITY)), ENTITY)


@query(f"WITH {_edges_sql('l_suppkey')} SELECT doc FROM m WHERE entity = {ENTITY} INTERSECT SELECT doc FROM m WHERE entity = {FRIEND}")
def shared_documents(spark, d):
    m = _star(spark, d)
    return m.where(f"entity = {ENTITY}").select("doc").intersect(m.where(f"entity = {FRIEND}").select("doc"))


@query(f"WITH {_edges_sql('l_suppkey')} SELECT entity - entity % 3 AS canonical, count(DISTINCT doc) AS n_docs FROM m GROUP BY 1")
def entity_documents_rollup(spark, d):
    return _star(spark, d).select((F.col("entity") - F.col("entity") % 3).alias("canonical"), "doc").distinct().groupBy("canonical").agg(F.count("doc").alias("n_docs"))


@query(f"WITH RECURSIVE {_edges_sql('l_partkey')}, s AS (SELECT a AS src, b AS dst FROM e UNION SELECT b, a FROM e), w(node, depth) AS (SELECT {ENTITY}::BIGINT, 0 UNION SELECT s.dst, w.depth + 1 FROM w JOIN s ON s.src = w.node WHERE w.depth < {DEPTH}) SELECT node, min(depth)::INT AS depth FROM w GROUP BY node")
def bfs_levels(spark, d):
    return graph.levels(graph.cooccurrence(_star(spark, d, "l_partkey")), ENTITY, DEPTH).select("node", "depth")


@query(f"WITH {_edges_sql('l_suppkey')}, r AS (SELECT CASE WHEN a % 10 = 0 THEN a // 10 + 1 ELSE a END AS x, CASE WHEN b % 10 = 0 THEN b // 10 + 1 ELSE b END AS y, weight FROM e) SELECT least(x, y) AS a, greatest(x, y) AS b, sum(weight)::BIGINT AS weight FROM r WHERE x <> y GROUP BY 1, 2")
def alias_rewire(spark, d):
    m = _star(spark, d)
    aliases = m.where("entity % 10 = 0").select(F.col("entity").alias("alias"), F.expr("entity div 10 + 1").alias("canonical")).distinct()
    return graph.rewired(graph.cooccurrence(m), aliases)


@query()
def resolve_entities(spark, d):
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("location").alias("entity_type"))
    people = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("person").alias("entity_type"))
    return resolution.resolve(parts.union(people))


@query("SELECT conv_id, turn, string_agg(text, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM conversations")
def context_window(spark, d):
    return chunking.context(_t(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "context")


@query("SELECT * FROM (SELECT turn AS src, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst, conv_id FROM conversations) WHERE dst IS NOT NULL")
def follows_edges(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return _t(spark, d, "conversations").select(F.col("turn").alias("src"), F.lag("turn").over(w).alias("dst"), "conv_id").where("dst is not null")


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^(The|Der|La|Los|Of|Th)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l)
SELECT doc_id, section::BIGINT AS section, (min(n) + 1)::INT AS start_line, (max(n) + 1)::INT AS end_line, string_agg(line, chr(10) ORDER BY n) AS body FROM f WHERE section > 0 GROUP BY doc_id, section""")
def line_sections(spark, d):
    return chunking.sections(_t(spark, d, "documents"), "doc_id", "text", pattern="^(The|Der|La|Los|Of|Th)")


def _html_sql() -> str:
    out = "html"
    for tag in ("script", "style", "noscript"):
        out = f"regexp_replace({out}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', '', 'g')"
    out = f"regexp_replace({out}, '(?i)</?({T.BLOCK_TAGS})(\\s[^>]*)?/?>', chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for entity, char in T.ENTITIES:
        out = f"replace({out}, '{entity}', {'chr(39)' if char == chr(39) else chr(39) + char + chr(39)})"
    return f"trim(regexp_replace(regexp_replace({out}, '[ \\t\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'))"


@query(f"SELECT page_id, {_html_sql()} AS text FROM pages")
def html_to_text(spark, d):
    return _t(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("SELECT event_id, unnest(json_keys(props)) AS key FROM events")
def json_keys(spark, d):
    return _t(spark, d, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("key"))


@query()
def chunk_text(spark, d):
    return chunking.chunks(_t(spark, d, "documents"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def content_hash_dedup(spark, d):
    return _t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'changed' END AS state FROM documents WHERE doc_id % 3 < 2")
def incremental_skip(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    stored = docs.where("doc_id % 3 > 0").select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.lit("stale")).otherwise(F.col("hash")).alias("old"))
    state = F.when(F.col("old").isNull(), "new").otherwise("changed")
    return docs.join(stored, "doc_id", "left").where("old is null or old <> hash").select("doc_id", state.alias("state"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_cascade(spark, d):
    gone = _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(gone, "l_orderkey", "left_anti")


@query("SELECT lang AS content_type, count(*) AS n, sum(n_chars)::BIGINT AS size, max(doc_id) AS last FROM documents GROUP BY lang")
def status_counts(spark, d):
    return _t(spark, d, "documents").groupBy(F.col("lang").alias("content_type")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"), F.max("doc_id").alias("last"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def stream_ingest(spark, d):
    from corpuslens.streaming.watch import ingest_available

    return ingest_available(spark, _t(spark, d, "documents").schema, f"{d}/documents.parquet", tempfile.mkdtemp(prefix="corpuslens-"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, date_trunc('hour', ts) AS hour FROM events GROUP BY event_type, date_trunc('hour', ts)")
def mention_timeline(spark, d):
    return _t(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 're') ORDER BY lower(p_name) = 're' DESC, length(p_name), p_name, p_partkey LIMIT 1")
def entity_lookup(spark, d):
    return structure.lookup(_t(spark, d, "part").select("p_partkey", "p_name"), "RE", "p_partkey", "p_name")


@query("SELECT DISTINCT p_name FROM part WHERE contains(lower(p_name), 're') ORDER BY p_name LIMIT 20")
def entity_suggest(spark, d):
    return structure.suggest(_t(spark, d, "part").select("p_name").distinct(), "RE", "p_name")


@query("""WITH h AS (SELECT conv_id, turn, 1 + turn % 3 AS depth FROM conversations)
SELECT conv_id, turn, depth, coalesce((SELECT max(b.turn) FROM h b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.depth < a.depth), -1) AS parent FROM h a""")
def heading_parents(spark, d):
    turns = _t(spark, d, "conversations").select("conv_id", "turn", (1 + F.col("turn") % 3).alias("depth"))
    return turns.withColumn("parent", F.coalesce(structure.heading_parent("conv_id", "turn", "depth"), F.lit(-1)))


@query("SELECT event_id AS doc_id, unnest(json_keys(props)) AS key, json_extract(props, '$.k')::VARCHAR AS value FROM events")
def object_keys(spark, d):
    return structure.object_keys(_t(spark, d, "events"), "event_id", "props")


@query("SELECT event_id AS doc_id, 0 AS pos, unnest(json_keys(props)) AS title, json_extract(props, '$.k')::VARCHAR AS body FROM events")
def keyed_chunks(spark, d):
    return structure.keyed_chunks(_t(spark, d, "events"), "event_id", "props")


@query()
def code_definitions(spark, d):
    return structure.definitions(_t(spark, d, "documents"))


@query(f"{_EVERY}, m AS ({_PATTERNS}) SELECT value AS name, min_by(entity_type, rank) AS entity_type, count(DISTINCT id)::BIGINT AS chunks FROM m GROUP BY value")
def entity_nodes(spark, d):
    return entities.counted_nodes(_mentions(spark, d)).select("name", "entity_type", "chunks")


@query(f"""{_EVERY}, o AS (SELECT id, {{0}} FROM every) SELECT id, value, place AS "offset" FROM (SELECT id, unnest(hits) AS value, unnest(list_transform(range(1, len(hits) + 1), lambda i: (list_sum(list_transform(gaps[1:i], lambda g: strlen(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: strlen(g))), 0))::BIGINT)) AS place FROM o) WHERE strlen(value) >= 3"""
       .replace("{0}", f"regexp_extract_all(text, '{_plain_pattern(graph.PATTERNS[6][1])}') AS hits, string_split_regex(text, '{_plain_pattern(graph.PATTERNS[6][1])}') AS gaps"))
def version_offsets(spark, d):
    docs = _t(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    pages = _t(spark, d, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")), "html")
    return graph.located_mentions(docs.union(pages), "id", "text").where("entity_type = 'version'").select("id", "value", "offset")


@query(f"WITH {_edges_sql('l_suppkey')} SELECT CASE WHEN a = {ENTITY} THEN b ELSE a END AS dst, weight FROM e WHERE a = {ENTITY} OR b = {ENTITY} ORDER BY weight DESC, dst LIMIT 10")
def entity_connections(spark, d):
    return entities.connections(graph.cooccurrence(graph.beside(_star(spark, d), ENTITY)), ENTITY, 10)


@query(f"WITH {_edges_sql('l_suppkey')} SELECT DISTINCT doc FROM m WHERE entity IN ({ENTITY}, {FRIEND})")
def entity_documents(spark, d):
    m = _star(spark, d)
    edges = m.select(F.col("chunk").alias("src"), F.col("entity").alias("dst")).distinct()
    asked = spark.range(ENTITY, FRIEND + 1).select(F.col("id").alias("node_id"))
    return entities.documents_of(edges, asked, m.select("chunk", "doc").distinct())


@query(f"""{_EVERY}, m AS ({_PATTERNS}), {_bm25_sql({0: TERMS})}, hit AS (SELECT DISTINCT substr(id, 2)::BIGINT AS id FROM m WHERE entity_type = 'version' AND id LIKE 'd%')
SELECT scored.id, round(score + CASE WHEN hit.id IS NULL THEN 0 ELSE 0.3 END, 6) AS score FROM scored LEFT JOIN hit USING (id)""".replace("hit AS (SELECT * FROM tf", "hits AS (SELECT * FROM tf").replace("FROM hit GROUP BY term", "FROM hits GROUP BY term").replace("FROM hit JOIN df", "FROM hits JOIN df"))
def entity_boost(spark, d):
    docs = _t(spark, d, "documents")
    m = graph.mentions(docs, "doc_id", "text")
    asked = entities.nodes(m.where("entity_type = 'version'"))
    found = entities.documents_of(entities.mention_edges(m), asked, docs.select(F.col("doc_id").alias("chunk"), F.col("doc_id").alias("doc")))
    return entities.boosted(retrieval.bm25(docs, {0: TERMS}).drop("query_id"), found, 0.3)


@query("SELECT conv_id AS doc, max(turn) AS confidence FROM conversations GROUP BY conv_id")
def document_confidence(spark, d):
    return entities.by_confidence(_t(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("confidence")))


_WORD = r"\w+(?:-\w+)*|\S"


@query(f"""WITH o AS (SELECT vec AS id, regexp_extract_all(text, '{_WORD}') AS hits, string_split_regex(text, '{_WORD}') AS gaps FROM (SELECT p_partkey AS vec, p_name || ' (no-frills): ' || p_name AS text FROM part UNION ALL SELECT -1 - c_custkey, c_name FROM customer))
SELECT id, value, start, start + length(value) AS "end" FROM (SELECT id, unnest(hits) AS value, unnest(list_transform(range(1, len(hits) + 1), lambda i: (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda g: length(g))), 0))::BIGINT)) AS start FROM o)""")
def word_tokens(spark, d):
    named = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" (no-frills): "), "p_name").alias("text"))
    named = named.union(_t(spark, d, "customer").select(-1 - F.col("c_custkey"), "c_name"))
    return spans.word_tokens(named, "id", "text").drop("k")


@query("SELECT conv_id, s AS start, s + w AS \"end\" FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), range(64) a(s), range(1, 13) b(w) WHERE s + w <= n")
def span_candidates(spark, d):
    sized = _t(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").cast("int").alias("n"))
    return spans.spans(sized, "n", "conv_id")


@query("SELECT lang, count(*) AS n, count(DISTINCT regexp_replace(source || '/' || doc_id::VARCHAR, '/[^/]*$', '')) AS folders FROM documents GROUP BY lang")
def parent_folders(spark, d):
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    return _t(spark, d, "documents").select("lang", F.regexp_replace(path, "/[^/]*$", "").alias("folder")).groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("folder").alias("folders"))


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n::VARCHAR || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0) || ' KB' ELSE printf('%.1f', n / 1048576.0) || ' MB' END AS written FROM (SELECT doc_id, strlen(text) AS n FROM documents)")
def sizes_written(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.bytes_written(F.octet_length("text").cast("long")).alias("written"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate::DATE::TIMESTAMP WHEN 1 THEN date_trunc('month', o_orderdate)::TIMESTAMP WHEN 2 THEN date_trunc('year', o_orderdate)::TIMESTAMP END AS date FROM orders")
def date_arguments(spark, d):
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    given = F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "yyyy-MM")).when(k == 2, F.date_format(at, "yyyy")).otherwise("soon")
    return _t(spark, d, "orders").select("o_orderkey", T.date_argument(given).alias("date"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id % 7 <> 0 UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 7 = 0")
def vector_commit(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "label")
    return retrieval.committed(e, e.where("vec_id % 7 = 0"), e.where("vec_id % 7 = 0").withColumn("vec_id", F.col("vec_id") + 1000000), "vec_id")


@query("SELECT label, count(*) AS n, round(avg(embedding[1]::DOUBLE), 6) AS first FROM embeddings GROUP BY label")
def pooled_vectors(spark, d):
    pooled = retrieval.mean_pooled(_t(spark, d, "embeddings"), "label", "embedding")
    return pooled.select("label", "n", F.round(F.get("mean", F.lit(0)), 6).alias("first"))


def _home(spark) -> str:
    """A folder of its own for an index: below spark.checkpoint.dir, which all executors share."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.gettempdir()}/corpuslens/index-{uuid.uuid4().hex}"


def _engine(spark, d) -> Engine:
    engine = Engine(spark, _home(spark))
    docs = _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("").alias("name"), F.col("text").alias("content"), F.col("lang").alias("content_type"))
    engine.index(docs.select("*", F.lit(None).cast("string").alias("content_hash"), F.octet_length("content").cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified")))
    return engine


@query(f"WITH {_bm25_sql({0: ['was', 'from', 'en']})} SELECT id::VARCHAR AS doc_id, score FROM scored ORDER BY score DESC, id::VARCHAR LIMIT 10")
def engine_query(spark, d):
    return _engine(spark, d).query("was from? EN").select("doc_id", "score")


@query(f"""WITH {_bm25_sql({0: ['was'], 1: ['the']})}, bad AS (SELECT id FROM (SELECT * FROM scored WHERE query_id = 1 ORDER BY score DESC, id::VARCHAR LIMIT 100) WHERE score > 0.5),
best AS (SELECT id, score FROM scored WHERE query_id = 0 ORDER BY score DESC, id::VARCHAR LIMIT 90) SELECT id::VARCHAR AS doc_id, score FROM best WHERE id NOT IN (SELECT id FROM bad) ORDER BY score DESC, id::VARCHAR LIMIT 30""")
def engine_negation(spark, d):
    return _engine(spark, d).query("was not the", limit=30).select("doc_id", "score")


@query(f"WITH {_DOCS} SELECT id::VARCHAR AS doc_id, len(list_filter(range(len(toks)), lambda i: toks[i + 1] = 'in' AND toks[i + 2] = 'the')) AS hits FROM d WHERE hits > 0")
def stored_phrase(spark, d):
    return _engine(spark, d).phrase(["in", "the"]).select(F.col("id").alias("doc_id"), "hits")
