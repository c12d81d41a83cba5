"""Registered text and ingestion queries, each with its DuckDB statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import hashing as H
from tidewater.functions import text as T
from tidewater.operators import decisions as D
from tidewater.plans import adapt as A
from tidewater.sources import markdown, snapshots

Q, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _docs(spark, sf_dir):
    return A.table(spark, sf_dir, "documents")


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', ' ', 'g') AS text FROM documents) SELECT doc_id, unnest(regexp_extract_all(text, '\b(\d{3,4})\b', 1)) AS code FROM t""")
def error_code_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", " ")
    return _docs(spark, sf_dir).select("doc_id", F.explode(T.error_codes(plain)).alias("code"))


@query(r"SELECT item_id, CASE WHEN len(regexp_extract_all(text, '\b(\d{3,4})\b', 1)) > 0 THEN text || ' ' || array_to_string(regexp_extract_all(text, '\b(\d{3,4})\b', 1), ' ') ELSE text END AS query FROM benchmark")
def enhanced_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "benchmark").select("item_id", T.enhanced_query(F.col("text")).alias("query"))


@query(r"SELECT doc_id, sha256(substr(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g'), 1, 1800)) AS clean_sha256 FROM documents")
def clean_and_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.embedding_input(F.col("text")), 256).alias("clean_sha256"))


@query("SELECT doc_id, s.s::INT AS char_start, length(substr(text, s.s + 1, 1800))::INT AS length, sha256(substr(text, s.s + 1, 1800)) AS piece_sha256 FROM documents, (SELECT unnest(range(0, 2000000, 1800)) AS s) s WHERE s.s <= greatest(length(text) - 1, 0)")
def bounded_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _docs(spark, sf_dir).select("doc_id", F.inline(markdown.bounded(F.col("text"))))
    return parts.select("doc_id", "char_start", F.length("text").alias("length"), F.sha2("text", 256).alias("piece_sha256"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}]+'))::INT AS tokens, len(list_distinct(regexp_extract_all(text, '[\\p{L}\\p{N}]+')))::INT AS distinct_tokens FROM documents")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = T.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(terms).alias("tokens"), F.size(F.array_distinct(terms)).alias("distinct_tokens"))


@query("SELECT sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' || chr(10) || text) AS fingerprint, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY ALL")
def doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = H.fingerprint(F.to_json(F.struct("lang", "source")), F.col("text"))
    return _docs(spark, sf_dir).groupBy(mark.alias("fingerprint")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("SELECT doc_id, substr(sha256(source || '/' || doc_id || '.md'), 1, 16) AS id FROM documents")
def path_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", H.doc_id(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("id"))


_KEYS = [("license", 0, "Apache"), ("license", 1, "GNU"), ("secret", 2, "token"), ("secret", 3, "AKIA"), ("rights", 4, "reserved")]
_KEYS_SQL = "k(scenario, nth, keyword) AS (VALUES " + ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in _KEYS) + ")"


def _keywords(spark):
    return spark.createDataFrame(_KEYS, "scenario string, nth int, keyword string")


@query(f"""WITH {_KEYS_SQL}, w AS (SELECT conv_id * 100 + turn AS id, lower(text || CASE turn % 5 WHEN 0 THEN ' Apache' WHEN 1 THEN ' apachee' WHEN 2 THEN ' token akia' WHEN 3 THEN ' apache token' ELSE '' END) AS text FROM conversations),
h AS (SELECT w.id, k.scenario, k.nth, k.keyword, CASE WHEN contains(w.text, lower(k.keyword)) THEN lower(k.keyword) ELSE list_filter(regexp_extract_all(w.text, '[a-z0-9]+'), lambda x: levenshtein(x, lower(k.keyword)) <= 1)[1] END AS hit FROM w, k)
SELECT id, min(scenario) AS scenario, arg_min(CASE WHEN lower(keyword) = hit THEN keyword ELSE keyword || '≈' || hit END, nth) AS matched FROM h WHERE hit IS NOT NULL GROUP BY id HAVING count(DISTINCT scenario) = 1""")
def fuzzy_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with a keyword, a misspelt one, several of one scenario and some of two planted by turn."""
    planted = F.element_at(F.array(*map(F.lit, (" Apache", " apachee", " token akia", " apache token", ""))), (F.col("turn") % 5 + 1).cast("int"))
    c = A.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.concat("text", planted).alias("text"))
    return D.spelled_intent(c, _keywords(spark)).select("id", "scenario", "matched")


@query(f"""WITH {_KEYS_SQL} SELECT doc_id AS id, string_agg(DISTINCT scenario, ',' ORDER BY scenario) AS scenarios FROM (SELECT doc_id, text || CASE WHEN doc_id % 4 = 0 THEN ' reserved token' WHEN doc_id % 4 = 1 THEN ' apache gnu' ELSE '' END AS text FROM documents), k WHERE contains(lower(text), lower(keyword)) GROUP BY doc_id HAVING count(DISTINCT scenario) >= 2""")
def multi_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of two scenarios, or two of one, are planted by doc_id."""
    planted = F.when(F.col("doc_id") % 4 == 0, " reserved token").when(F.col("doc_id") % 4 == 1, " apache gnu").otherwise("")
    return D.several_problems(_docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.concat("text", planted).alias("text")), _keywords(spark)).select("id", "scenarios")


@query(r"""SELECT conv_id, turn, regexp_replace(replace(replace(replace(text, 'hello', ''), 'hi', ''), 'hey', ''), '[^\p{L}\p{N}_]', '', 'g') = '' AS greeting,
regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') LIKE '未解决%' AS reopened, regexp_matches(text, '只读|请勿\s*(?:自动\s*)?执行') AS read_only FROM conversations""")
def message_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_greeting(text, D.GREETINGS).alias("greeting"), T.is_reopen_request(text).alias("reopened"), T.is_read_only_request(text).alias("read_only"))


@query(r"""WITH s AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[。！？；!?;\n]|\.(?:\s|$)'), lambda x: regexp_matches(x, '\S'))) AS s FROM documents) SELECT doc_id, count(*) AS sentences FROM s GROUP BY doc_id""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a full stop's space goes with it here, so that both engines split alike
    parts = F.filter(F.split("text", r"[。！？；!?;\n]|\.(?:\s|$)", -1), lambda x: x.rlike(r"\S"))
    return _docs(spark, sf_dir).select("doc_id", F.size(parts).cast("long").alias("sentences")).where("sentences > 0")


@query("""WITH t AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id), w AS (SELECT conv_id, list_slice(string_split(arg_min(text, turn), ' '), 1, 6) AS terms FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, round(len(list_filter(terms, lambda x: contains(replace(answer, ' ', ''), replace(x, ' ', '')))) / len(terms), 9) AS coverage FROM t JOIN w USING (conv_id)""")
def gold_term_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = A.table(spark, sf_dir, "conversations")
    said = c.where("role = 'assistant'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("answer"))
    asked = c.where("role = 'user'").groupBy("conv_id").agg(F.slice(F.split(F.min_by("text", "turn"), " ", -1), 1, 6).alias("terms"))
    return said.join(asked, "conv_id").select("conv_id", F.round(T.term_coverage(F.col("answer"), F.col("terms")), 9).alias("coverage"))


@query("SELECT lang, count(*) AS files, sum(octet_length(encode(text)))::BIGINT AS bytes, max(length(text)) AS longest FROM documents GROUP BY lang")
def storage_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"), F.max(F.length("text")).cast("long").alias("longest"))


@query("""WITH t AS (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a href="[^"]*"')) AS links FROM pages) SELECT page_id, title, links::INT AS links FROM t""")
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit('<a href="[^"]*"')).alias("links"))


@query("SELECT event_id, CASE WHEN value < 1 THEN '<1 ms' WHEN value < 1000 THEN round(value)::BIGINT || ' ms' ELSE printf('%.1f s', value / 1000) END AS elapsed FROM events WHERE value IS NOT NULL")
def duration_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_id", T.duration(F.col("value")).alias("elapsed"))


@query("SELECT lang, sha256(string_agg(sha256('{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\"}'), '' ORDER BY sha256('{\"doc_id\":' || doc_id || ',\"source\":\"' || source || '\"}'))) AS digest FROM documents GROUP BY lang")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy("lang").agg(H.digest(F.col("doc_id"), F.col("source")).alias("digest"))


@query("""WITH f AS (SELECT doc_id % 600 AS total, doc_id % 5 + 20 AS fps, least(8, greatest(1, floor((doc_id % 600) / ((doc_id % 5 + 20) * 3)) + 1))::INT AS n, doc_id FROM documents)
SELECT doc_id, CASE WHEN n = 1 THEN [total::INT] ELSE list_transform(range(0, n), lambda i: round(i * total / (n - 1))::INT) END AS frames FROM f""")
def frame_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).withColumn("total", (F.col("doc_id") % 600).cast("int"))
    return d.select("doc_id", snapshots.frame_indices(F.col("total") + 1, (F.col("doc_id") % 5 + 20).cast("int"), 8).alias("frames"))


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(substr(coalesce(text, ''), 1, 90), '[^a-zA-Z0-9 ]', '', 'g')) AS i FROM documents),
p AS (SELECT doc_id, i, '## A' || chr(10) || doc_id || chr(10) || '### deep' || chr(10) || '##no' AS a, '## B' || chr(10) || 'end' AS b FROM d)
SELECT doc_id, 0 AS seq, 'parent' AS chunk_type, md5(i || chr(10) || a || chr(10) || chr(10) || b) AS digest FROM p UNION ALL SELECT doc_id, 1, 'child', md5(i) FROM p WHERE length(i) >= 60
UNION ALL SELECT doc_id, 1 + (length(i) >= 60)::INT, 'child', md5(a) FROM p UNION ALL SELECT doc_id, 2 + (length(i) >= 60)::INT, 'child', md5(b) FROM p""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page with an introduction (kept from 60 characters on), two headings, a deeper one and a line that only looks like one."""
    intro = F.trim(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 90), "[^a-zA-Z0-9 ]", ""))
    page = F.concat(intro, F.lit("\n## A\n"), F.col("doc_id").cast("string"), F.lit("\n### deep\n##no\n\n## B\nend"))
    parts = markdown.sections(A.table(spark, sf_dir, "documents").select("doc_id", page.alias("content")))
    return parts.select("doc_id", "seq", "chunk_type", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(r"""WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9 ]', '', 'g')) AS t, lang FROM documents),
c AS (SELECT doc_id, 0 AS seq, 0 AS char_start, 'parent' AS chunk_type, t AS text, t, lang FROM d UNION ALL
  SELECT doc_id, 1, s.s::INT, 'child', substr(t, s.s + 1, 1800), t, lang FROM d, (SELECT unnest(range(0, 2000000, 1800)) AS s) s WHERE t <> '' AND s.s <= length(t) - 1)
SELECT substr(sha256('kb'), 1, 12) || ':' || doc_id || ':r' || (doc_id % 3) || '#' || seq || CASE WHEN chunk_type = 'child' THEN ':' || char_start ELSE '' END AS chunk_id, chunk_type, md5(text) AS digest,
sha256('{"lang":"' || lang || '","source_id":"own"}' || chr(10) || t) AS doc_hash, 'kb' AS source_id, lang FROM c""")
def generation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's parent and cut children with their ids, and metadata that a document's own cannot override."""
    # runs that stay are joined: taking the other characters out one by one takes twice as long
    clean = F.trim(F.array_join(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-zA-Z0-9 ]+"), F.lit(0)), ""))
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("p/"), F.col("doc_id").cast("string")).alias("path"), clean.alias("content"), F.create_map(F.lit("lang"), "lang", F.lit("source_id"), F.lit("own")).alias("meta"))
    found = markdown.generation_chunks(docs, "kb", F.concat(F.lit("r"), (F.col("doc_id") % 3).cast("string")))
    return found.select("chunk_id", "chunk_type", F.md5(F.col("text").cast("binary")).alias("digest"), *(F.col("metadata")[x].alias(x) for x in ("doc_hash", "source_id", "lang")))
