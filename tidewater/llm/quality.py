"""Quality rules: base counts, and perplexity bands of a Spark-counted modified Kneser-Ney model.

The model is over n-grams of ORDER characters (code points of the lower-cased text, symbols included, after ORDER - 1 line
ends), one for each language of the column. Each task counts the distinct n-grams of its texts, Spark sums them over all documents, and joins and
aggregations alone make the discounts, the continuation counts and the interpolated probabilities of every order. So the
model grows with the input. Since all judged documents are counted, each of their n-grams has its probability in the
highest order; lower orders enter through the interpolation.

A text does not vouch for itself: what it holds of an n-gram's occurrences is taken off the count before the probability
is taken, so an n-gram that only this text has is worth what the lower orders give, however often it is repeated there.

The model is stored as arrays of n-gram hashes in ascending order with their counts and the two parts of their probability,
in shards of at most SHARD_ENTRIES (20 MiB each in a worker for 2**20): a shard goes round as a broadcast and adds its part
to each document's sum, in one pass over the documents for every PASS_SHARDS of them; the sums stand beside the documents in
between, and the broadcasts are destroyed after their pass.

A text's perplexity is that of its words: its characters' summed negative log-probability by the number of its words.
Symbols that are glued to words cost a word more, texts cut up by symbols of their own less; by the character both would
hide behind the symbols' predictable runs.

The bands come from each language's exact histogram of perplexities, cut at BAND_ABOVE and BAND_BELOW robust standard
deviations from the median.

Edge cases: a null text has no words; an empty one no perplexity; documents whose language is null are one language;
a language whose texts all score alike rejects nothing by perplexity; repeated doc_ids are judged row by row; an empty
table gives an empty result; a table without ``lang`` is one language; other columns are ignored, whatever their names, and
``kept`` returns them as they are; very long texts are counted and scored in parts of _CHUNK characters, so a task's memory
grows with the distinct n-grams of a text alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm import words as W
from tidewater.llm.store import BROADCAST_ROWS, discard, only, written

ORDER = 5
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Half width of a band above and below the median, in robust standard deviations, and at least in nats a word.
BAND_ABOVE, BAND_BELOW, BAND_LEAST = 5.0, 4.0, 0.5
SHARD_ENTRIES, PASS_SHARDS = 1 << 20, 16
_CHUNK = 1 << 20
_SPACES, _SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
_PER_NAT = 500  # histogram bins
_VALUE = np.uint64(0x9E3779B97F4A7C15)


def points(text: str) -> np.ndarray:
    """The lower-cased text's code points after ORDER - 1 line ends."""
    return np.frombuffer(("\n" * (ORDER - 1) + text.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)


def parts(c: np.ndarray):
    """The code points in parts that share ORDER - 1, so that each n-gram is in one part."""
    for i in range(0, len(c) - ORDER + 1, _CHUNK):
        yield c[i : i + _CHUNK + ORDER - 1]


def keys(c: np.ndarray, language: int | np.ndarray) -> np.ndarray:
    """Hash of each n-gram of ORDER code points, in a language with this hash (one for all, or one for each code point)."""
    language = language if isinstance(language, np.ndarray) else np.uint64(language & 0xFFFFFFFFFFFFFFFF)
    return W.windows(W.mixed((c.astype(np.uint64) + np.uint64(1)) * _VALUE + language), ORDER)


class Sorted:
    """Places of hashes in an ascending array of them, by a table of where each value of the leading bits starts."""

    def __init__(self, known: np.ndarray):
        self.bits = np.uint64(64 - max(4, len(known).bit_length() + 1))
        self.known = np.append(known, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.first = np.searchsorted(known, np.arange(1 << (64 - int(self.bits)), dtype=np.uint64) << self.bits).astype(np.int32)
        self.longest = int(np.diff(np.append(self.first, len(known))).max())

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether the hash is there)"""
        at = self.first[h >> self.bits]
        hit = self.known[at] == h
        open_ = np.flatnonzero(~hit)
        for step in range(1, self.longest):
            place = np.minimum(at[open_] + step, len(self.known) - 1)
            same = self.known[place] == h[open_]
            at[open_[same]] = place[same]
            hit[open_[same]] = True
            open_ = open_[~same & (self.known[place] < h[open_])]
            if not len(open_):
                break
        return at, hit


def _with_lang(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", _language(docs))


def _language(docs: DataFrame) -> Column:
    """Name of the document's language; the null one is empty and others start with =."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("")).alias("__lang")


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all documents (text, __lang, __lang_key); gram is the n-gram as a string."""

    def scan(batches):
        seen: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        held: dict[tuple[str, int], list[np.ndarray]] = {}
        size = 0

        def fold():
            for (lang, number), texts in held.items():
                c = np.concatenate(texts)  # n-grams over the joint of two texts are left out below
                ends = np.cumsum([len(x) for x in texts])
                h = keys(c, number)
                whole = np.ones(len(h), bool)
                for j in range(1, ORDER):
                    whole[ends[:-1] - j] = False
                h = h[whole]
                found, n = np.unique(h, return_counts=True)
                old, old_rows, old_n = seen.get(lang) or (np.empty(0, np.uint64), np.empty((0, ORDER), np.uint32), np.empty(0, np.int64))
                at, known = Sorted(old)(found)
                np.add.at(old_n, at[known], n[known])
                new = found[~known]
                if len(new):
                    _, is_new = Sorted(new)(h)
                    places = np.flatnonzero(is_new)
                    _, first = np.unique(h[places], return_index=True)
                    rows = np.lib.stride_tricks.sliding_window_view(c, ORDER)[np.flatnonzero(whole)[places[first]]]
                    by = np.argsort(np.concatenate([old, new]))
                    old, old_rows, old_n = (np.concatenate(x)[by] for x in ((old, new), (old_rows, rows), (old_n, n[~known])))
                seen[lang] = old, old_rows, old_n
            held.clear()

        for batch in batches:
            for text, lang, number in zip(batch.column("text"), *(batch.column(x).to_pylist() for x in ("__lang", "__lang_key")), strict=True):
                if text := text.as_py():
                    for c in parts(points(text)):
                        held.setdefault((lang, number), []).append(c)
                        size += len(c)
                        if size >= 2 * _CHUNK:
                            fold()
                            size = 0
        fold()
        for lang, (_, rows, n) in seen.items():
            for i in range(0, len(n), 1 << 16):
                part = np.ascontiguousarray(rows[i : i + (1 << 16)])
                grams = part.tobytes().decode("utf-32-le", "surrogatepass")
                grams = [grams[j : j + ORDER].encode("utf-8", "surrogatepass") for j in range(0, len(grams), ORDER)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(grams, pa.binary()), pa.array(n[i : i + (1 << 16)])], ["lang", "gram", "n"])

    found = docs.select("text", "__lang", "__lang_key").mapInArrow(scan, "lang string, gram binary, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n")).select("lang", F.col("gram").cast("string").alias("gram"), "n")


def model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, p, others, n, own, back): interpolated modified Kneser-Ney probability of each n-gram's last character after
    the others; ``others`` is the same without the own share of n-grams that are there once. p is the sum of ``own``, what
    the n occurrences give, and of the lower orders' part; ``back`` is that part without own shares.

    The highest order uses the counts, each lower one the number of distinct characters before. The lowest order is
    interpolated with the uniform distribution over the language's characters and one unseen.
    """
    levels = [counts]
    for k in range(order - 1, 0, -1):
        levels.append(levels[-1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count("*").alias("n")))
    below = None
    for k, level in enumerate(levels[::-1], 1):
        of = level.groupBy("lang").agg(*(F.sum(F.when(F.col("n") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)))
        y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        discount = [F.when(F.col(f"n{i}") > 0, F.greatest(F.lit(0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))).otherwise(0.5 * i) for i in (1, 2, 3)]
        of = written(of.select("lang", *(x.alias(f"d{i}") for i, x in enumerate(discount, 1))), "discounts")
        # a row for each language: sent to the tasks, or else all of a language's n-grams would meet in one
        table = level.join(F.broadcast(of) if of.count() <= BROADCAST_ROWS else of, "lang")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        table = table.select("lang", "gram", "n", F.least(d, F.col("n")).alias("d"), F.substring("gram", 1, k - 1).alias("context"), F.substring("gram", 2, k - 1).alias("rest"))
        contexts = table.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("left"), F.count("*").alias("kinds"))
        table = table.join(contexts, ["lang", "context"])
        if below is None:
            lower = 1 / (F.col("kinds") + 1)
        else:
            table, lower = table.join(below.select("lang", F.col("gram").alias("rest"), F.col("p").alias("lower"), F.col("others").alias("lower_others")), ["lang", "rest"]), F.col("lower")
        rest = F.col("left") / F.col("total")
        own = (F.col("n") - F.col("d")) / F.col("total")
        back = rest * (lower if k == 1 else F.col("lower_others"))
        others = F.when(F.col("n") > 1, own).otherwise(0.0) + back
        below = table.select("lang", "gram", (own + rest * lower).alias("p"), others.alias("others"), *([F.col("n"), own.alias("own"), back.alias("back")] if k == order else []))
        if k < order:
            below = written(below, "level")
    return below


_PARTS = ("n", "own", "back")
#: What a remaining count is lowered by before it is taken as a share of the whole one.
DISCOUNT = 0.75


def left_out(n: np.ndarray, own: np.ndarray, back: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Log-probabilities of n-grams when ``mine`` of their n occurrences are not counted."""
    return np.log(own * np.maximum(n - mine - DISCOUNT, 0.0) / (n - DISCOUNT) + back)


def counted(text: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, as hashes, and how often it has each."""
    found, n = np.empty(0, np.uint64), np.empty(0, np.int64)
    for c in parts(points(text)):
        h, m = np.unique(keys(c, number), return_counts=True)
        if len(found):
            h, place = np.unique(np.concatenate([found, h]), return_inverse=True)
            m = np.bincount(place, np.concatenate([n, m])).astype(np.int64)
        found, n = h, m
    return found, n


def _shards(probabilities: DataFrame):
    """Arrays (hashes in ascending order, counts, own and back) of at most about SHARD_ENTRIES n-grams each, one after another."""
    spark = probabilities.sparkSession

    def scan(batches):
        for batch in batches:
            c = np.frombuffer("".join(batch.column("gram").to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
            number = np.repeat(batch.column("number").to_numpy().view(np.uint64), ORDER)
            h = keys(c, number)[::ORDER] if len(c) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(batch.column(x) for x in _PARTS)], ["key", *_PARTS])

    rows = probabilities.select("gram", F.xxhash64("lang").alias("number"), *(F.col(x).cast("float").alias(x) for x in _PARTS))
    table = written(rows.mapInArrow(scan, "key long, n float, own float, back float"), "model")
    shards = -(-table.count() // SHARD_ENTRIES)
    for i in range(shards):
        got = (table.where(F.pmod(F.shiftrightunsigned("key", 8), F.lit(shards)) == i) if shards > 1 else table).toArrow()
        h = got["key"].to_numpy().view(np.uint64)
        by = np.argsort(h)
        yield spark.sparkContext.broadcast((h[by], *(got[x].to_numpy()[by] for x in _PARTS)))
    discard(table)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words"""
    if not text:
        return 0, 0, 0, 0, 0
    h = W.hashes(W.encoded(text))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += bool(line.strip(_SPACES))
        else:
            seen.add(line)
    repeat = 0
    if len(h) >= 3:
        three = W.windows(h, 3)
        ordered = np.sort(three)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            repeat = int(W.covered(np.flatnonzero(np.isin(three, twice)), 3, len(h)).sum())
    return len(h), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), dup, repeat


_SCORED = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_())]
_SCORED_DDL = "__n_words long, __word_chars long, __n_symbols long, __n_dup_lines long, __n_repeat_words long, __base_failed boolean"


def scored(docs: DataFrame, carry: list[str], keep) -> DataFrame:
    """The columns to carry as c0, c1 ..., and each document's base counts, language and mean negative log-probability of a word (nats), all of these prefixed by __. ``keep`` writes the result."""
    rows = docs.select(*(F.col(x).alias(f"c{i}") for i, x in enumerate(carry)), F.col("text").alias("__text"), _language(docs))
    rows = rows.withColumn("__lang_key", F.xxhash64("__lang"))
    probabilities = model(written(count_grams(rows.withColumnRenamed("__text", "text")), "grams"))
    carried = [f"c{i}" for i in range(len(carry))]
    held, n_pass = [], 0

    def passed(rows: DataFrame, shards: list, base: bool) -> DataFrame:
        """One pass over the documents: the sum over these shards, and in the first pass the base counts."""
        keep = [x for x in rows.columns if x != "__sum"]

        def scan(batches):
            tables = [(Sorted(shard.value[0]), shard.value[1:]) for shard in shards]
            for batch in batches:
                out, sums = [], []
                earlier = [0.0] * batch.num_rows if base else batch.column("__sum").to_pylist()
                for text, number, sum_ in zip(batch.column("__text"), batch.column("__lang_key").to_pylist(), earlier, strict=True):
                    text = text.as_py()
                    if base:
                        counts = base_counts(text)
                        out.append((*counts, counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]))
                    h, mine = counted(text, number) if text else (np.empty(0, np.uint64), None)
                    for find, values in tables if len(h) else ():
                        at, hit = find(h)
                        at, m = at[hit], mine[hit]
                        sum_ -= float((m * left_out(*(x[at].astype(np.float64) for x in values), m)).sum())
                    sums.append(sum_)
                found = [pa.array(x, t) for x, (_, t) in zip(zip(*out, strict=True), _SCORED, strict=True)] if out else []
                if batch.num_rows:
                    names = [*keep, *(["__" + n for n, _ in _SCORED] if base else []), "__sum"]
                    yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), *found, pa.array(sums, pa.float64())], names)

        ddl = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.select(*keep).schema)
        return rows.mapInArrow(scan, f"{ddl}{', ' + _SCORED_DDL if base else ''}, __sum double")

    for shard in _shards(probabilities):
        held.append(shard)
        if len(held) == PASS_SHARDS:
            last, rows = rows, written(passed(rows, held, not n_pass), "sums")
            for x in held:
                x.destroy()
            n_pass, held = n_pass + 1, []
            discard(last)
    if held or not n_pass:
        rows = passed(rows, held, not n_pass)
    score = F.when(F.col("__n_words") > 0, F.col("__sum") / F.col("__n_words")).alias("__log_ppl")
    table = keep(rows.select(*carried, "__lang", *("__" + n for n, _ in _SCORED), score))
    for x in held:
        x.destroy()
    return table


def bands(table: DataFrame) -> DataFrame:
    """(__lang, __least, __most) log-perplexity, from the histogram of all documents that pass the base rules."""
    value = F.floor(F.col("__log_ppl") * _PER_NAT)
    bins = written(table.where("not __base_failed and __log_ppl is not null").groupBy("__lang", value.alias("bin")).agg(F.count("*").alias("n")), "bins")
    middle = bins.groupBy("__lang").agg(F.percentile("bin", 0.5, F.col("n")).alias("middle"))
    spread = bins.join(middle, "__lang").groupBy("__lang", "middle").agg((1.4826 * F.percentile(F.abs(F.col("bin") - F.col("middle")), 0.5, F.col("n"))).alias("spread"))
    wide = lambda x: F.greatest(x * F.col("spread"), F.lit(BAND_LEAST * _PER_NAT))
    return spread.select("__lang", ((F.col("middle") + 0.5 - wide(BAND_BELOW)) / _PER_NAT).alias("__least"), ((F.col("middle") + 0.5 + wide(BAND_ABOVE)) / _PER_NAT).alias("__most"))


def _judged(docs: DataFrame, carry: list[str]) -> DataFrame:
    with only(docs.sparkSession, "scored") as keep:
        table = scored(docs, carry, keep)
    limits = written(bands(table), "bands")  # a row for each language
    inside = F.col("__log_ppl").between(F.col("__least"), F.col("__most"))
    return table.join(limits, "__lang", "left").withColumn("__kept", ~F.col("__base_failed") & F.coalesce(inside, F.lit(True)))


def judge(docs: DataFrame) -> DataFrame:
    """Every document with its counts, base_failed, log_ppl and kept."""
    found = _judged(docs, ["doc_id"])
    return found.select(F.col("c0").alias("doc_id"), *(F.col(f"__{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ppl", "kept")))


def kept(docs: DataFrame) -> DataFrame:
    """The documents that all rules keep, with all their columns, without a shuffle of the texts."""
    found = _judged(docs, docs.columns).where("__kept")
    return found.select(*(F.col(f"c{i}").alias(x) for i, x in enumerate(docs.columns)))
