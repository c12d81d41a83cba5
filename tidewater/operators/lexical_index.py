"""A BM25 index of impact-bounded posting blocks, written once and read by all lexical routes.

Documents are tokenized once, in blocks of bounded size, where they are read: nothing is shuffled but the terms' counts. A
row of the index is one block: its documents with their lengths and groups, and for each term their places and term
frequencies, as little-endian numbers (the terms as Arrow has them), so that a scan copies bytes. Panels of queries travel to the blocks. A top-k search adds up, for a query and a block, the greatest shares
that the terms give any of its documents (their impacts) and passes over the block if these do not reach the query's k-th
score so far in the task, so the result is exact.

Edge cases: a null or empty text is a document without terms, which counts for the mean length; rows that repeat an id are
documents of their own; terms in more than half of all documents take epsilon times the mean inverse frequency, and a
share that is negative by this bounds nothing; equal scores go by id; an empty table gives an empty index and no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions.text import tokens
from tidewater.storage import importable, new_path, spread, written

#: Queries of a panel, about; panels that go to every task whole, of more that many meet a part of the blocks; SLICE_BLOCKS bears on nothing now.
PANEL_QUERIES, BROADCAST_PANELS, SLICE_BLOCKS = 128, 16, 64
#: Bounds of a block: documents and tokens (one longer document is a block of its own).
BLOCK_DOCS, BLOCK_TOKENS = 128, 1 << 18
_BLOCK = "block long, words long, documents binary, lengths binary, groups array<string>, chars binary, ends binary, counts binary, places binary, tfs binary"
#: Blocks are large rows: bytes of a row group, which readers hold whole.
GROUP_BYTES = 16 << 20


@dataclass(frozen=True)
class LexicalIndex:
    """Paths of the blocks and of the terms (term, df), the number of documents and of their tokens, the floor of
    inverse document frequencies, and the parameters of the shares."""

    postings_path: str
    terms_path: str
    n: int
    words: int
    floor: float
    k1: float
    b: float

    def blocks(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_BLOCK).parquet(self.postings_path)

    def postings(self, spark: SparkSession) -> DataFrame:
        """term, block, ids, tfs, lengths and impact, a row for each term of a block."""
        importable(spark)
        rows = self.blocks(spark).mapInArrow(_postings, "term string, block long, ids array<long>, tfs array<int>, lengths array<int>")
        return rows.withColumn("impact", F.array_max(F.zip_with("tfs", "lengths", lambda tf, n: self.share(tf.cast("double"), n.cast("double")))))

    def terms(self, spark: SparkSession) -> DataFrame:
        """term, df, idf."""
        terms = spark.read.schema("term string, df long").parquet(self.terms_path)
        raw = _raw_idf(F.col("df"), self.n)
        return terms.select("term", "df", F.when(raw < 0, F.lit(self.floor)).otherwise(raw).alias("idf"))

    @property
    def mean(self) -> float:
        return self.words / self.n if self.words else 1.0

    def share(self, tf: Column, length: Column) -> Column:
        """What a term gives a document, before its inverse document frequency."""
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))


def _raw_idf(df: Column, n: int) -> Column:
    return F.log(F.lit(float(n)) - df + 0.5) - F.log(df + 0.5)


def _blocks(batches):
    """Rows of the index from batches of (chunk_id, group, terms); blocks are numbered inside the task."""
    task = TaskContext.get().partitionId() << 32
    block, ids, groups, lists, held = 0, [], [], [], 0

    def made():
        terms = pa.concat_arrays(lists)
        sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        coded = terms.flatten().dictionary_encode()
        keys, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), sizes), return_counts=True)
        term, doc = np.divmod(keys, len(ids))
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        names = coded.dictionary.take(pa.array(term[first])).cast(pa.string())
        _, ends, chars = pa.concat_arrays([names]).buffers() if len(names) else (None, b"\0\0\0\0", b"")
        numbers = lambda x, kind="<i4": np.asarray(x).astype(kind).tobytes()
        row = [task + block, int(sizes.sum()), numbers(ids, "<i8"), numbers(sizes), groups, bytes(chars or b""), bytes(ends)[: 4 * len(names) + 4], numbers(np.diff(np.r_[first, len(term)])), numbers(doc), numbers(tf)]
        kinds = {"long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}
        return pa.RecordBatch.from_arrays([pa.array([v], kinds[x.split()[1]]) for v, x in zip(row, _BLOCK.split(", "), strict=True)], [x.split()[0] for x in _BLOCK.split(", ")])

    for batch in batches:
        terms, sizes = batch.column("terms"), pc.list_value_length(batch.column("terms")).to_pylist()
        start = 0
        for i, (id_, group, size) in enumerate(zip(batch.column("chunk_id").to_pylist(), batch.column("group").to_pylist(), sizes, strict=True)):
            if ids and (len(ids) == BLOCK_DOCS or held + size > BLOCK_TOKENS):
                if i > start:
                    lists.append(terms.slice(start, i - start))
                yield made()
                block, ids, groups, lists, held, start = block + 1, [], [], [], 0, i
            ids.append(id_)
            groups.append(group)
            held += size
        lists.append(terms.slice(start))
    if ids:
        yield made()


def _rows(batches):
    """block, documents, lengths, groups, terms, counts, places and term frequencies of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            at = lambda name: batch.column(name)[i].as_buffer()  # noqa: B023, E731
            number = lambda name, kind="<i4": np.frombuffer(at(name), kind)  # noqa: B023, E731
            counts = number("counts")
            terms = pa.StringArray.from_buffers(len(counts), at("ends"), at("chars"))
            yield batch, i, number("documents", "<i8"), number("lengths"), batch.column("groups")[i].values, terms, counts, number("places"), number("tfs")


def _counts(batches):
    for _, _, _, _, _, terms, counts, _, _ in _rows(batches):
        yield pa.RecordBatch.from_arrays([terms, pa.array(counts)], ["term", "n"])


def _postings(batches):
    for batch, i, ids, lengths, _, terms, counts, places, tfs in _rows(batches):
        offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
        listed = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids[places], tfs, lengths[places])]
        yield pa.RecordBatch.from_arrays([terms, pa.array([batch.column("block")[i].as_py()] * len(terms), pa.int64()), *listed], ["term", "block", "ids", "tfs", "lengths"])


def build(chunks: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> LexicalIndex:
    """Index of chunks (chunk_id long, text, optionally group string, which a search may rank apart)."""
    spark = chunks.sparkSession
    importable(spark)
    group = F.col("group").cast("string") if "group" in chunks.columns else F.lit(None).cast("string")
    rows = spread(chunks.where("chunk_id is not null").select(F.col("chunk_id").cast("long").alias("chunk_id"), group.alias("group"), "text"))
    tokenized = rows.select("chunk_id", "group", tokens(F.coalesce("text", F.lit(""))).alias("terms"))
    paths = new_path(spark, "postings"), new_path(spark, "term-counts")
    blocks = written(tokenized.mapInArrow(_blocks, _BLOCK), "", paths[0], group_bytes=GROUP_BYTES)
    n, words = blocks.agg(F.coalesce(F.sum(F.size("groups")), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    counts = blocks.mapInArrow(_counts, "term string, n int")
    terms = written(counts.groupBy("term").agg(F.sum("n").cast("long").alias("df")), "", paths[1])
    mean = terms.agg(F.avg(_raw_idf(F.col("df"), n))).first()[0]
    return LexicalIndex(*paths, n, words, epsilon * (mean or 0.0), k1, b)


def term_stats(chunks: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """term, df, idf as of ``build``, without postings: only the terms' partial counts travel."""
    chunks = chunks.where("chunk_id is not null")
    n = chunks.count()
    terms = spread(chunks.select("text")).select(F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("term"))
    counts = written(terms.groupBy("term").agg(F.count("*").alias("df")), "term-counts")
    raw = _raw_idf(F.col("df"), n)
    mean = counts.agg(F.avg(raw)).first()[0]
    return counts.select("term", "df", F.when(raw < 0, F.lit(epsilon * (mean or 0.0))).otherwise(raw).alias("idf"))


def asked(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """query_id, term, weight: how often a query has the term, times its inverse document frequency."""
    terms = queries.select("query_id", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qn"))
    return terms.join(index.terms(queries.sparkSession), "term").select("query_id", "term", (F.col("qn") * F.col("idf")).alias("weight"))


def _parts(index: LexicalIndex, rows: DataFrame, *keep: str) -> DataFrame:
    """What each posting of rows (query_id, weight, x: array of ids, tfs, lengths) gives its document."""
    each = rows.select("query_id", "weight", *keep, F.explode("x").alias("x"))
    return each.select("query_id", *keep, F.col("x.ids").alias("chunk_id"), (F.col("weight") * index.share(F.col("x.tfs").cast("double"), F.col("x.lengths").cast("double"))).alias("part"))


def scores(index: LexicalIndex, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, score (6 digits) of all pairs that share a term; a repeated query term counts repeatedly."""
    rows = index.postings(queries.sparkSession).join(asked(index, queries), "term").withColumn("x", F.arrays_zip("ids", "tfs", "lengths"))
    return _parts(index, rows).groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")


_BEST = pa.schema([("query_id", pa.int64()), ("group", pa.string()), ("chunk_id", pa.int64()), ("score", pa.float64())])


def _met(index: LexicalIndex, terms: DataFrame) -> DataFrame:
    """Every block with every panel of the queries' terms (query_id, term, weight): few panels go to each task whole, of more
    a part meets a part of the blocks."""
    spark = terms.sparkSession
    importable(spark)
    terms = written(terms, "asked")
    panels = max(1, -(-terms.select("query_id").distinct().count() // PANEL_QUERIES))
    one = terms.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(panels)).alias("panel")).agg(*(F.collect_list(x).alias(name) for x, name in (("query_id", "asking"), ("term", "terms"), ("weight", "weights"))))
    few = panels <= BROADCAST_PANELS
    return spread(index.blocks(spark)).crossJoin(F.broadcast(one) if few else written(one.repartition(-(-panels // BROADCAST_PANELS)), "panels"))


class _Panel:
    """Queries, their terms as places in a vocabulary, and weights."""

    def __init__(self, row: dict):
        self.queries, self.of = np.unique(np.array(row["asking"], np.int64), return_inverse=True)
        coded = pa.array(row["terms"], pa.string()).dictionary_encode()
        self.vocabulary, self.codes, self.weights = coded.dictionary, coded.indices.to_numpy(), np.array(row["weights"], np.float64)

    def own(self, codes: np.ndarray) -> np.ndarray:
        """Weights of the queries by these terms."""
        at = np.full(len(self.vocabulary), -1)
        at[codes] = np.arange(len(codes))
        some = np.flatnonzero(at[self.codes] >= 0)
        out = np.zeros((len(self.queries), len(codes)))
        out[self.of[some], at[self.codes[some]]] = self.weights[some]
        return out


def _matches(batches):
    """For each block and panel: the panel, the block's documents, lengths and groups, the terms that both have, and for
    each posting the term's place among these, its document's place and its term frequency."""
    panels: dict[int, _Panel] = {}
    for batch, i, ids, lengths, groups, terms, counts, places, tfs in _rows(batches):
        panel = batch.column("panel")[i].as_py()
        if panel not in panels:
            panels[panel] = _Panel({x: batch.column(x)[i].as_py() for x in ("asking", "terms", "weights")})
        asks = panels[panel]
        codes = pc.fill_null(pc.index_in(terms, asks.vocabulary), -1).to_numpy()
        some = np.flatnonzero(codes >= 0)
        if len(some):
            sizes, first = counts[some], (np.cumsum(counts) - counts)[some]
            of = np.repeat(np.arange(len(some)), sizes)
            posting = np.arange(len(of)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
            yield panel, asks, ids, lengths, groups, codes[some], of, places[posting], tfs[posting]


def _product(index: LexicalIndex, k: int):
    """The k best documents of each query, and of each group apart, in the blocks of a task: per block one product of weights and shares."""
    k1, b, mean = index.k1, index.b, index.mean

    def best(batches):
        held: dict[tuple, tuple] = {}
        for panel, asks, ids, lengths, groups, codes, of, place, tf in _matches(batches):
            share = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[place] / mean))
            own, names = asks.own(codes), groups.dictionary_encode("encode")
            for group in np.unique(names.indices.to_numpy()[place]):
                mine = names.indices.to_numpy()[place] == group
                documents, column = np.unique(ids[place[mine]], return_inverse=True)
                given = np.zeros((len(codes), len(documents)))
                np.add.at(given, (of[mine], column), share[mine])
                key = panel, names.dictionary[group].as_py()
                if key not in held:
                    held[key] = asks.queries, np.full((len(asks.queries), k), -np.inf), np.zeros((len(asks.queries), k), np.int64)
                _, found, at = held[key]
                # scores are rounded to six digits, so a bound may lie that much below one
                alive = np.flatnonzero(np.maximum(own * given.max(axis=1), 0.0).sum(axis=1) >= np.maximum(found[:, -1], 0.0) - 1e-5)
                if not len(alive):
                    continue
                score = np.floor(own[alive] @ given * 1e6 + 0.5) / 1e6
                score, both = np.hstack([found[alive], np.where(score > 0, score, -np.inf)]), np.hstack([at[alive], np.broadcast_to(documents, score.shape)])
                first = np.lexsort((both, -score), axis=1)[:, :k]
                found[alive], at[alive] = np.take_along_axis(score, first, 1), np.take_along_axis(both, first, 1)
        for (_, group), (queries, found, at) in held.items():
            q, j = np.nonzero(np.isfinite(found))
            yield pa.RecordBatch.from_arrays([pa.array(queries[q]), pa.array([group] * len(q), pa.string()), pa.array(at[q, j]), pa.array(found[q, j])], schema=_BEST)

    return best


def topk(index: LexicalIndex, queries: DataFrame, k: int, grouped: bool = False) -> DataFrame:
    """The k best of ``scores`` for each query, or of each group of documents apart: query_id, (group,) chunk_id, score.

    Panels of queries meet the blocks where these lie; no more than the k best of a task leave it. A block is scored for a
    query only if its terms' impacts can still reach the k-th score found so far.
    """
    keys = ["query_id", *(["group"] if grouped else [])]
    blocks = _met(index, asked(index, queries))
    if not grouped:
        blocks = blocks.withColumn("groups", F.transform("groups", lambda _: F.lit(None).cast("string")))
    each = blocks.mapInArrow(_product(index, k), "query_id long, group string, chunk_id long, score double")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "chunk_id"))
    # few rows, which several readers of a plan take
    return written(each.withColumn("place", place).where(F.col("place") <= k).select(*keys, "chunk_id", "score"), "best")


def _holding(batches):
    """(query_id, chunk_id) of the documents that hold a query's term."""
    for _, asks, ids, _, _, codes, of, place, _ in _matches(batches):
        hit = asks.own(codes) > 0
        for q in np.flatnonzero(hit.any(axis=1)):
            found = ids[place[hit[q][of]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), asks.queries[q])), pa.array(found)], ["query_id", "chunk_id"])


def containing(index: LexicalIndex, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """(query_id, chunk_id) of texts (chunk_id, text) that hold a query's text word for word.

    A text that does holds every whole word inside the query's text, so only the documents of the rarest of these are
    looked at. A query without such a word (its outermost words may be parts of longer ones, and Han runs have no ends)
    is compared with all texts.
    """
    whole = F.regexp_replace("text", r"^[\p{L}\p{N}]+|[\p{L}\p{N}]+$", "")
    inner = F.when(F.col("text").rlike(r"\p{IsHan}"), F.array().cast("array<string>")).otherwise(tokens(whole))
    asked_for = written(queries.where("text is not null").select("query_id", F.col("text").alias("passage"), inner.alias("inner")), "passages")
    known = asked_for.select("query_id", F.explode(F.array_distinct("inner")).alias("term")).join(index.terms(queries.sparkSession).select("term", "df"), "term", "left")
    # a word that no document has is the rarest of all
    rarest = known.groupBy("query_id").agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), "term")).alias("term"))
    found = _met(index, rarest.select("query_id", "term", F.lit(1.0).alias("weight"))).mapInArrow(_holding, "query_id long, chunk_id long")
    found = written(found.distinct(), "holding")
    near = texts.select("chunk_id", "text").join(found, "chunk_id").join(asked_for.select("query_id", "passage"), "query_id").where(F.contains("text", F.col("passage")))
    rest = asked_for.where(F.size("inner") == 0).select("query_id", "passage")
    if rest.isEmpty():
        return written(near.select("query_id", "chunk_id"), "containing")  # the texts are looked at once, whoever reads the pairs
    return written(near.select("query_id", "chunk_id").unionByName(texts.join(rest, F.contains("text", F.col("passage"))).select("query_id", "chunk_id")), "containing")
