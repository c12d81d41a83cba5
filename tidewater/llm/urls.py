"""URL filter: allow and block rules, and for the other URLs naive Bayes over segmented host words and path tokens.

Concatenated names in hosts are split by unigram Viterbi: the substrings of each distinct host label, up to LONGEST_WORD
letters, are joined to the counts of all words of all pages' visible text. The multinomial naive Bayes counts the tokens
of every page that a rule decides, hashed to BUCKETS places, so its size is fixed. What the rule itself matched of host and
path is no feature (it would only teach the rules), and both classes weigh alike: their counts are scaled to one total, so
that tokens that training has not seen speak for neither, and there is no prior. ``held_out`` measures it on pages that
rules decide but that it has not learned from.

Edge cases: a url that is null or has no ``://`` has empty host and path; without decided pages everything else is
allowed; a page whose tokens are all unknown is allowed; a page without html adds no words; repeated page_ids are judged row by row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.store import written

LONGEST_WORD = 63  # letters of a label in a host name, at most
BUCKETS = 1 << 16
#: Words of at most SHORT letters are in many labels; the join deals each out to SALTS places.
SHORT, SALTS = 3, 16
_LABELS_AT_ONCE = 512
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _SHAPE, 1), _UPPER, _LOWER), F.regexp_extract(url, _SHAPE, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. A rule is 'host/path'; verdicts are allow or block."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def beyond_rule(host: Column, path: Column, rule: Column) -> tuple[Column, Column]:
    """Host and path without what the rule matched of them."""
    domain = F.substring_index(rule, "/", 1)
    start = F.length(rule) - F.length(domain)
    rest = F.substring(host, F.lit(1), F.greatest(F.length(host) - F.length(domain), F.lit(0)))
    return F.rtrim(rest, F.lit(".")), F.substring(path, start + 1, F.length(path))


def lexicon(pages: DataFrame) -> DataFrame:
    """(word, n): counts of all lower-case words of the pages' visible text."""
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = pages.select(F.explode(F.split(F.lower(bare), r"[^\p{L}]+")).alias("word")).where(F.length("word").between(1, LONGEST_WORD))
    return written(words.groupBy("word").agg(F.count("*").alias("n")), "words")


class Segmenter:
    """Most probable split of a name under a unigram model; unknown words cost more with each letter."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """Counts of the words that can occur in the names, and of all words together where those are not all."""
        total = (sum(counts.values()) if total is None else total) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items() if len(w) > 1 or n > total / 1000}
        self.unknown = math.log(total) + math.log(10)

    def __call__(self, name: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = (
                (best[i] + self.cost.get(name[i:end], self.unknown + math.log(10) * (end - i)), i) for i in range(max(0, end - LONGEST_WORD), end)
            )
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        words, end = [], len(name)
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


def labels(host: str) -> list[str]:
    return [x for x in re.split(r"[^\w]+|_", host) if x]


def path_tokens(path: str) -> list[str]:
    """Digits all look alike."""
    return ["p:" + re.sub(r"\d+", "0", x) for x in labels(path.lower())]


def split_hosts(hosts: DataFrame) -> DataFrame:
    """(host, labels) of distinct hosts."""

    def scan(batches):
        for batch in batches:
            cut = pa.array([labels(x) for x in batch.column("host").to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("host"), cut], ["host", "labels"])

    return hosts.select("host").distinct().mapInArrow(scan, "host string, labels array<string>")


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words): each distinct label split under the counts of all words."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]

    def parts(batches):
        for batch in batches:
            for i in range(0, len(batch), _LABELS_AT_ONCE):
                found = [
                    (name, part) for name in batch.column("label")[i : i + _LABELS_AT_ONCE].to_pylist()
                    for part in {name[a:b] for a in range(len(name)) for b in range(a + 1, min(len(name), a + LONGEST_WORD) + 1)} if part.isalpha()
                ]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*found, strict=True)], ["label", "word"])

    def split(batches):
        for batch in batches:
            found = [Segmenter({x["word"]: x["n"] for x in r["known"]}, total)(r["label"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.string()))], ["label", "words"])

    short = F.length("word") <= SHORT
    sought = names.mapInArrow(parts, "label string, word string").withColumn("salt", F.when(short, F.pmod(F.xxhash64("label"), F.lit(SALTS)).cast("int")).otherwise(0))
    dealt = counts.withColumn("salt", F.explode(F.when(short, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    known = sought.join(dealt, ["word", "salt"]).select("label", F.struct("word", "n").alias("known"))
    every = known.unionByName(names.select("label", F.lit(None).cast(known.schema["known"].dataType).alias("known")))
    return every.groupBy("label").agg(F.collect_list("known").alias("known")).mapInArrow(split, "label string, words array<string>")


def _bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS


def train(decided: DataFrame, words: DataFrame) -> np.ndarray | None:
    """Log-odds of block per bucket from all (host, path, rule, verdict) rows; None if a class has none."""
    free_host, free_path = beyond_rule(F.col("host"), F.col("path"), F.col("rule"))
    decided = decided.select(free_host.alias("host"), free_path.alias("path"), "verdict")

    def scan(batches):
        for batch in batches:
            seen: Counter = Counter()
            for row in batch.to_pylist():
                block = int(row["verdict"] == "block")
                seen[block, None, -1] += 1
                seen.update((block, x, None) for x in labels(row["host"]))
                seen.update((block, None, _bucket(x)) for x in path_tokens(row["path"]))
            if seen:
                columns = [pa.array(x, t) for x, t in zip([*zip(*seen, strict=True), list(seen.values())], [pa.int32(), pa.string(), pa.int32(), pa.int64()], strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "label", "bucket", "n"])

    found = written(decided.mapInArrow(scan, "block int, label string, bucket int, n long").groupBy("block", "label", "bucket").agg(F.sum("n").alias("n")), "tokens")
    of_hosts = found.where("label is not null").join(words, "label").select("block", "n", F.explode("words").alias("word"))
    bucket = F.pmod(F.crc32(F.concat(F.lit("h:"), "word").cast("binary")), F.lit(BUCKETS)).cast("int").alias("bucket")
    rows = found.where("label is null").select("block", "bucket", "n").unionByName(of_hosts.select("block", bucket, "n"))
    seen = np.zeros((2, BUCKETS))
    pages = [0, 0]
    for r in rows.groupBy("block", "bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            pages[r["block"]] = r["n"]
        else:
            seen[r["block"], r["bucket"]] += r["n"]
    totals = seen.sum(axis=1)
    if not all(pages) or not totals.all():
        return None
    seen = 1 + seen * (totals.mean() / totals)[:, None]
    return np.log(seen[1]) - np.log(seen[0])


def host_scores(hosts: DataFrame, words: DataFrame, shared) -> DataFrame:
    """(host, host_score): the log-odds of the host's words, summed in the order of size."""

    def scan(batches):
        odds = shared.value
        for batch in batches:
            found = [float(sum(odds[_bucket("h:" + x)] for x in r)) for r in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.float64())], ["label", "score"])

    of_labels = words.mapInArrow(scan, "label string, score double")
    found = hosts.select("host", F.explode("labels").alias("label")).join(of_labels, "label").groupBy("host").agg(F.array_sort(F.collect_list("score")).alias("scores"))
    return found.select("host", F.aggregate("scores", F.lit(0.0), lambda a, x: a + x).alias("host_score"))


def held_out(pages: DataFrame, rules: list[tuple[str, str]], part: Column) -> DataFrame:
    """verdict (the rule's) and predicted of the decided pages in ``part`` (a condition on page_id), learned from the others.

    The model sees the held-out pages as it saw its own: without what the rule matched.
    """
    host, path = host_path(F.col("url"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    decided = pages.select("page_id", host.alias("host"), path.alias("path")).select("*", rule.alias("rule"), ruled.alias("verdict")).where("rule is not null")
    hosts = written(split_hosts(decided), "hosts")
    words = written(segmented(hosts.select(F.explode("labels").alias("label")).distinct(), lexicon(pages)), "segments")
    shared = pages.sparkSession.sparkContext.broadcast(train(decided.where(~part), words))
    free_host, free_path = beyond_rule(F.col("host"), F.col("path"), F.col("rule"))
    rest = decided.where(part).select("page_id", free_host.alias("host"), free_path.alias("path"), "verdict")
    scored = rest.join(host_scores(written(split_hosts(rest), "rest-hosts"), words, shared), "host", "left")

    def scan(batches):
        odds = shared.value
        for batch in batches:
            scores = [(row["host_score"] or 0.0) + sum(odds[_bucket(x)] for x in path_tokens(row["path"])) if odds is not None else -1.0 for row in batch.select(["path", "host_score"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("verdict"), pa.array(["block" if x > 0 else "allow" for x in scores], pa.string())], ["page_id", "verdict", "predicted"])

    return scored.mapInArrow(scan, "page_id long, verdict string, predicted string")


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, block_probability (null where a rule decides)."""
    host, path = host_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("*", rule.alias("rule"), ruled.alias("verdict"))
    decided, others = parsed.where("rule is not null"), parsed.where("rule is null")
    hosts = written(split_hosts(parsed), "hosts")
    words = written(segmented(hosts.select(F.explode("labels").alias("label")).distinct(), lexicon(pages)), "segments")
    odds = train(decided, words)
    shared = pages.sparkSession.sparkContext.broadcast(odds)
    others = others.withColumn("host_score", F.lit(0.0)) if odds is None else others.join(host_scores(hosts, words, shared), "host", "left")

    def scan(batches):
        odds = shared.value
        for batch in batches:
            verdicts, chances = [], []
            for row in batch.select(["path", "host_score"]).to_pylist():
                score = -1.0 if odds is None else (row["host_score"] or 0.0) + sum(odds[_bucket(x)] for x in path_tokens(row["path"]))
                chances.append(1 / (1 + math.exp(-max(-500.0, min(500.0, score)))))
                verdicts.append("block" if score > 0 else "allow")
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(x) for x in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(chances, pa.float64())],
                ["page_id", "host", "path", "rule", "verdict", "block_probability"],
            )

    judged = others.mapInArrow(scan, "page_id long, host string, path string, rule string, verdict string, block_probability double")
    return decided.withColumn("block_probability", F.lit(None).cast("double")).unionByName(judged)
