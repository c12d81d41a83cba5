"""Language identification by compression: zstandard with a raw-content dictionary per language.

The dictionaries are concatenated training texts, a bounded sample: for each language the SAMPLE_DOCS documents with the
least hashes of their id, up to DICTIONARY_BYTES (less where all languages together would need more than TOTAL_BYTES; no
language is left out). A text is cut into blocks, so that the dictionary matters
throughout a long one (a short text is taken in several rotations, as sizes are whole bytes); every block is compressed with every dictionary and the language with the smallest total wins.
The answer is accepted if the runner-up needs clearly more bytes.

Edge cases: a text that is null or has no letter is ``und`` with score 0; without any training row every text is;
equal sizes go to the alphabetically first language; a single learned language scores 1; null languages do not train;
a null doc_id is neither held out nor trained on; a long text is compressed block by block; other columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 400  # documents of a language in its dictionary, at most
DICTIONARY_BYTES, TOTAL_BYTES = 256 << 10, 64 << 20
BLOCK_BYTES = 2048
SHORT_BYTES, ROTATIONS = 400, 6
LEVEL = 6
MIN_MARGIN = 0.01


def fit(labelled: DataFrame) -> dict[str, bytes]:
    """Raw dictionary of each language from labelled documents (doc_id, text, lang)."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return {}
    size = min(DICTIONARY_BYTES, TOTAL_BYTES // len(counts))
    # four times the documents wanted, by their hashes: what reaches a language's window does not grow with the input
    share = F.try_element_at(F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 4 * SAMPLE_DOCS / n)))), F.col("lang"))
    at = F.xxhash64("doc_id")
    few = labelled.where(F.pmod(at, F.lit(1 << 30)) < share * (1 << 30)).select("lang", "doc_id", at.alias("at"), F.substring("text", 1, size).alias("text"))
    few = few.select("lang", "doc_id", "at", F.xxhash64("text").alias("tie"), F.octet_length("text").alias("bytes"), "text")
    order = Window.partitionBy("lang").orderBy("at", "doc_id", "tie")
    ranked = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_DOCS)
    ranked = ranked.withColumn("before", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    found: dict[str, bytes] = {}
    # texts of two dictionaries' length for a language, at most
    for row in sorted(ranked.where(F.coalesce("before", F.lit(0)) < size).select("lang", "k", "text").collect(), key=lambda r: (r["lang"], r["k"])):
        found[row["lang"]] = (found.get(row["lang"], b"") + row["text"].lower().encode("utf-8", "replace") + b"\n")[:size]
    return found


class Classifier:
    """Compressors of all languages; made once in a worker."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.compress = {}
        for lang in sorted(dictionaries):
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self.compress[lang] = zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin)"""
        if text is None or not self.compress or not any(map(str.isalpha, text)):
            return "und", 0.0, 0.0
        raw = text.lower().encode("utf-8", "replace")
        if len(raw) < SHORT_BYTES:  # sizes are whole bytes: rotations tell more
            words = raw.split()
            blocks = [b" ".join(words[k:] + words[:k]) for k in {len(words) * i // ROTATIONS for i in range(ROTATIONS)}]
        else:
            blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        sizes = sorted((sum(len(compress(x)) for x in blocks), lang) for lang, compress in self.compress.items())
        best, lang = sizes[0]
        if len(sizes) == 1:
            return lang, 1.0, 1.0
        return lang, sizes[1][0] / (best + sizes[1][0]), (sizes[1][0] - best) / sizes[1][0]


def classify(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, margin, accepted (the margin is not narrow)."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def scan(batches):
        model = Classifier(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, score, margin = zip(*(model(x.as_py()) for x in batch.column("text")), strict=True)
            accepted = [x != "und" and m >= min_margin for x, m in zip(lang, margin, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (lang, score, margin, accepted))], ["doc_id", "lang_pred", "score", "margin", "accepted"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, lang_pred string, score double, margin double, accepted boolean")


def fold():
    """crc32 of the doc_id's text modulo 4; fold 2 is held out."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
