"""The driver's tables in the roles of the engine's, once as DataFrames and once as DuckDB common table expressions."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.text import tokens
from tidewater.operators import lexical_index as L
from tidewater.operators.retrieval import Config
from tidewater.storage import importable, written

TODAY = 20240101
#: Half of the documents have a vector; a wide recall lets chunks meet on both routes.
CONFIG = Config(today=TODAY, recall=60, min_score=0.05)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def collection(doc_id: Column) -> Column:
    return F.when(doc_id % 3 == 0, "kb_b").otherwise("kb_a")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, vectors = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = F.col("doc_id")
    return (
        docs.join(labels, "doc_id", "left").join(vectors.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
        .select(
            d.alias("chunk_id"), "text", F.col("lang").alias("scenario"), F.col("source").alias("source_url"),
            F.when(F.col("quality") == 1, "active").when(F.col("quality") == 0, "inactive").alias("status"),
            (F.coalesce("toxic", F.lit(0)) == 1).alias("denied"),
            F.when(d % 11 == 0, "restricted").when(d % 5 == 0, None).otherwise("employee").alias("access"),
            F.when(d % 13 != 0, (2022 + d % 5) * 10000 + 630).cast("int").alias("valid_to"),
            F.when(d % 17 == 0, "parent").otherwise("child").alias("chunk_type"),
            F.when(d % 17 != 0, d - d % 17).alias("parent_id"),
            collection(d).alias("collection"), "embedding",
        )
    )


_INDEXES: dict[tuple, L.LexicalIndex] = {}


def lexical(spark: SparkSession, sf_dir: str) -> L.LexicalIndex:
    """The lexical index of ``documents``: built once for a version of its files (names, lengths and times), as long as it is there."""
    docs = table(spark, sf_dir, "documents")
    file_system = lambda path: path.getFileSystem(spark._jsc.hadoopConfiguration())
    version = []
    for name in sorted(docs.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        status = file_system(path).getFileStatus(path)
        version.append((name, status.getLen(), status.getModificationTime()))
    key = (spark.sparkContext.applicationId, CONFIG.k1, CONFIG.b, CONFIG.epsilon, *version)
    found = _INDEXES.get(key)
    path = found and spark._jvm.org.apache.hadoop.fs.Path(found.postings_path)
    if not found or not file_system(path).exists(path):
        found = _INDEXES[key] = L.build(docs.select(F.col("doc_id").alias("chunk_id"), "text", collection(F.col("doc_id")).alias("group")), CONFIG.k1, CONFIG.b, CONFIG.epsilon)
    return found


def denied(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()


def queries(spark: SparkSession, sf_dir: str, scenario: bool = False) -> DataFrame:
    items, vectors = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "embeddings")
    asked = F.when(F.col("item_id") % 4 == 0, "en") if scenario else F.lit(None)
    joined = items.join(vectors.select(F.col("vec_id").alias("item_id"), "embedding"), "item_id", "left")
    return joined.select(F.col("item_id").alias("query_id"), "text", F.col("embedding").alias("vector"), asked.cast("string").alias("scenario"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that hold a query's text word for word."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return L.containing(lexical(spark, sf_dir), items, docs)


#: Places of a text's vector.
PLACES = 64


def _signed_counts(batches):
    """Each document's words added up where it lies; of a batch each distinct word is hashed once."""
    for batch in batches:
        batch = batch.filter(pc.not_equal(batch.column("words"), ""))
        lists = pc.split_pattern(batch.column("words"), " ")
        words = lists.flatten().dictionary_encode()
        h = np.array([int.from_bytes(hashlib.md5(w.encode()).digest()[:2], "big") for w in words.dictionary.to_pylist()], np.int64)
        at, of = words.indices.to_numpy(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        sums = np.bincount(of * PLACES + h[at] % PLACES, np.where(h[at] % (2 * PLACES) < PLACES, 1.0, -1.0), len(lists) * PLACES)
        vectors = pa.FixedSizeListArray.from_arrays(sums, PLACES).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), vectors], ["id", "scope", "vector"])


def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, scope (language) and vector of each document with words: signed counts of hashed words in PLACES places. Written, as its readers go over it again and again."""
    importable(spark)
    text = F.coalesce("text", F.lit(""))
    # one string of words apart by spaces goes to Python faster than a list; without Han characters tokens are whole runs
    words = F.when(text.rlike(r"\p{IsHan}"), F.array_join(tokens(text), " ")).otherwise(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", words.alias("words"))
    found = docs.mapInArrow(_signed_counts, f"id {docs.schema['doc_id'].dataType.simpleString()}, scope string, vector array<double>")
    # documents of one id and language are one
    places = [f"p{i}" for i in range(PLACES)]
    sums = found.groupBy("id", "scope").agg(*(F.sum(F.col("vector")[i]).alias(x) for i, x in enumerate(places)))
    return written(sums.select("id", "scope", F.array(*places).alias("vector")), "text-vectors")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    rated = F.pmod(F.col("conv_id") * 31 + F.col("turn"), F.lit(4))
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("conv_id").alias("conversation_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"),
        F.when(F.col("role") == "assistant", F.when(rated == 0, "down").when(rated == 1, "up")).alias("feedback"), (F.col("conv_id") % 3).alias("tenant_id"),
    )


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    node = F.when(F.col("event_type") == "view", "rag_query").when(F.col("event_type") == "click", "intent").when(F.col("event_type") == "error", "execute").when(F.col("event_type") == "purchase", "verify").otherwise("close")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("conversation_id"), node.alias("node"), F.col("ts").alias("at"), F.col("value").alias("elapsed_ms"), (k % 3).alias("n_sources"), k.alias("k"))


CHUNKS = """
labelled AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
chunks AS (
  SELECT d.doc_id AS chunk_id, d.text, d.lang AS scenario, d.source AS source_url,
    CASE WHEN l.quality = 1 THEN 'active' WHEN l.quality = 0 THEN 'inactive' END AS status, coalesce(l.toxic, 0) = 1 AS denied,
    CASE WHEN d.doc_id % 11 = 0 THEN 'restricted' WHEN d.doc_id % 5 = 0 THEN NULL ELSE 'employee' END AS access,
    CASE WHEN d.doc_id % 13 <> 0 THEN ((2022 + d.doc_id % 5) * 10000 + 630)::INT END AS valid_to,
    CASE WHEN d.doc_id % 17 = 0 THEN 'parent' ELSE 'child' END AS chunk_type,
    CASE WHEN d.doc_id % 17 <> 0 THEN d.doc_id - d.doc_id % 17 END AS parent_id,
    CASE WHEN d.doc_id % 3 = 0 THEN 'kb_b' ELSE 'kb_a' END AS collection, e.embedding
  FROM documents d LEFT JOIN labelled l ON d.doc_id = l.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id
)"""
QUERIES = """
asked AS (SELECT b.item_id AS query_id, b.text, e.embedding AS vector, NULL::VARCHAR AS scenario FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id)"""
SCOPED = QUERIES.replace("NULL::VARCHAR", "CASE WHEN b.item_id % 4 = 0 THEN 'en' END")
TERMS = """
words AS MATERIALIZED (SELECT chunk_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS term FROM chunks),
tf AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM words GROUP BY ALL),
dl AS MATERIALIZED (SELECT c.chunk_id, coalesce(w.n, 0) AS dl FROM chunks c LEFT JOIN (SELECT chunk_id, count(*) AS n FROM words GROUP BY ALL) w ON c.chunk_id = w.chunk_id),
total AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(total.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, total GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
BM25 = TERMS + """,
qt AS (SELECT query_id, term, count(*) AS qn FROM (SELECT query_id, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS term FROM asked) GROUP BY ALL),
bm25 AS (
  SELECT query_id, tf.chunk_id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN idf ON qt.term = idf.term JOIN tf ON tf.term = qt.term JOIN dl ON dl.chunk_id = tf.chunk_id, total GROUP BY query_id, tf.chunk_id HAVING score > 0
)"""
ROUTES = BM25 + f""",
cosine AS (
  SELECT query_id, chunk_id, round(list_cosine_similarity(vector::DOUBLE[], embedding::DOUBLE[]), 4) AS score, access
  FROM asked JOIN chunks ON vector IS NOT NULL AND embedding IS NOT NULL AND (asked.scenario IS NULL OR asked.scenario = chunks.scenario)
  WHERE status = 'active' AND coalesce(chunk_type, '') <> 'parent' AND valid_to >= {TODAY}
),
vector_cut AS (SELECT * FROM cosine QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 60),
vector_route AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM vector_cut WHERE (access IS NULL OR access = 'employee') AND score >= 0.05
),
bm25_cut AS (SELECT * FROM bm25 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 120),
bm25_route AS (
  SELECT b.query_id, b.chunk_id, b.score, row_number() OVER (PARTITION BY b.query_id ORDER BY b.score DESC, b.chunk_id) AS rank
  FROM bm25_cut b JOIN chunks c ON b.chunk_id = c.chunk_id JOIN asked a ON a.query_id = b.query_id
  WHERE (access IS NULL OR access = 'employee') AND (status IS NULL OR status = 'active') AND coalesce(chunk_type, '') <> 'parent'
    AND (valid_to IS NULL OR valid_to = 0 OR valid_to >= {TODAY}) AND (a.scenario IS NULL OR a.scenario = c.scenario)
  QUALIFY rank <= 60
)"""


def fusion(vector_weight: float = 1.0, lexical_weight: float = 1.0, deny: bool = False) -> str:
    routes = ROUTES
    if deny:  # both routes leave denied documents out
        routes = routes.replace("WHERE status = 'active' AND coalesce(chunk_type", "WHERE NOT denied AND status = 'active' AND coalesce(chunk_type")
        routes = routes.replace("WHERE (access IS NULL OR access = 'employee') AND (status IS NULL", "WHERE NOT c.denied AND (access IS NULL OR access = 'employee') AND (status IS NULL")
    return routes + f""",
both_routes AS (
  SELECT query_id, chunk_id, score, rank, 0 AS route, 'vector' AS name, {vector_weight}::DOUBLE / (60 + rank) AS part FROM vector_route UNION ALL
  SELECT query_id, chunk_id, score, rank, 1, 'bm25', {lexical_weight}::DOUBLE / (60 + rank) FROM bm25_route
),
grouped AS (
  SELECT query_id, chunk_id, round(sum(part), 12) AS fused, arg_min(score, route) AS score, string_agg(name, ',' ORDER BY name) AS routes,
    min(route) AS route, arg_min(rank, route) AS place FROM both_routes GROUP BY ALL
),
fused AS (
  SELECT query_id, chunk_id, fused, score, routes, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, route, place, chunk_id) AS rank
  FROM grouped QUALIFY rank <= 10
),
of_source AS (
  SELECT f.*, row_number() OVER (PARTITION BY f.query_id, coalesce(c.source_url, c.chunk_id::VARCHAR) ORDER BY f.rank) AS nth, c.denied, c.parent_id
  FROM fused f JOIN chunks c ON f.chunk_id = c.chunk_id
),
final AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS final_rank FROM of_source WHERE nth <= 2 QUALIFY final_rank <= 5
)"""


GOLD = """
gold AS (SELECT b.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""
TEXT_VECTORS = """
hashed AS (
  SELECT doc_id, lang, ('0x' || substr(md5(word), 1, 4))::BIGINT AS h FROM (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}]+')) AS word FROM documents)
), places AS (SELECT doc_id, lang, h % 64 AS place, sum(CASE WHEN h % 128 < 64 THEN 1.0 ELSE -1.0 END)::DOUBLE AS value FROM hashed GROUP BY ALL
), text_vectors AS MATERIALIZED (
  SELECT doc_id AS id, any_value(lang) AS scope, list_transform(range(64), lambda i: coalesce(list_sum(list_filter(list_zip(list(place), list(value)), lambda x: x[1] = i).list_transform(lambda x: x[2])), 0)::DOUBLE) AS vector
  FROM places GROUP BY doc_id
)"""
MESSAGES = """
messages AS (
  SELECT conv_id * 100 + turn AS id, conv_id AS conversation_id, turn AS seq, role, text AS content,
    CASE WHEN role = 'assistant' THEN CASE (conv_id * 31 + turn) % 4 WHEN 0 THEN 'down' WHEN 1 THEN 'up' END END AS feedback, conv_id % 3 AS tenant_id FROM conversations
)"""
TRACES = """
traces AS (
  SELECT event_id AS id, user_id AS conversation_id, ts AS at, value AS elapsed_ms, (props->>'$.k')::INT AS k, (props->>'$.k')::INT % 3 AS n_sources,
    CASE event_type WHEN 'view' THEN 'rag_query' WHEN 'click' THEN 'intent' WHEN 'error' THEN 'execute' WHEN 'purchase' THEN 'verify' ELSE 'close' END AS node FROM events
)"""
