"""Host labels are split under the counts of all words, however rare."""

import math
import re
from collections import Counter

import brute
from pyspark.sql import functions as F

from tidewater.llm import queries, urls

SF = "/root/testdata/sf0.01"
BARE = re.compile(r"<(script|style)\b.*?</\1>|<[^>]*>", re.I | re.S)


def counts_of(pages):
    found = Counter(x for html in pages for x in re.findall(r"[^\W\d_]+", BARE.sub(" ", html or "").lower()))
    return {w: n for w, n in found.items() if len(w) <= urls.LONGEST_WORD}


def test_rare_words_split(spark):
    # more words than any fixed size of the lexicon held: all but two occur three times, those two once
    letters = [chr(97 + i) for i in range(26)]
    many = [a + b + c + d for a in letters for b in letters for c in letters for d in letters][: 1 << 17]
    html = [" ".join(many[i : i + 4096] * 3) for i in range(0, len(many), 4096)] + ["<p>zebrafish quilting</p>"]
    rows = [(i, "http://zebrafishquilting.org/x", x) for i, x in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    counts = urls.lexicon(pages)
    assert counts.count() == len(many) + 2
    names = spark.createDataFrame([("zebrafishquilting",), ("quiltingzebrafish",), ("x1",)], "label string")
    got = {r["label"]: r["words"] for r in urls.segmented(names, counts).collect()}
    assert got["zebrafishquilting"] == ["zebrafish", "quilting"] and got["quiltingzebrafish"] == ["quilting", "zebrafish"]
    assert "".join(got["x1"]) == "x1"


def test_judged_as_by_the_plain_model(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    segment = urls.Segmenter(counts_of(r["html"] for r in rows))
    tokens = lambda host, path: ["h:" + w for x in urls.labels(host) for w in segment(x)] + urls.path_tokens(path)
    got = {r["page_id"]: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), queries.URL_RULES).collect()}
    seen, pages = (Counter(), Counter()), [0, 0]
    for r in rows:
        if got[r["page_id"]]["rule"]:
            block = int(got[r["page_id"]]["verdict"] == "block")
            pages[block] += 1
            (host, path), (domain, _, start) = brute.url_parts(r["url"]), got[r["page_id"]]["rule"].partition("/")
            free = host[: len(host) - len(domain)].rstrip("."), path[len(start) + 1 :]
            seen[block].update(urls._bucket(x) for x in tokens(*free))
    size = [sum(x.values()) for x in seen]
    scaled = lambda c, b: seen[c][b] * (sum(size) / 2 / size[c]) + 1
    odds = lambda b: math.log(scaled(1, b)) - math.log(scaled(0, b))
    judged = 0
    for r in rows:
        if got[r["page_id"]]["rule"] is None:
            score = sum(odds(urls._bucket(x)) for x in tokens(*brute.url_parts(r["url"])))
            assert abs(got[r["page_id"]]["block_probability"] - 1 / (1 + math.exp(-score))) < 1e-9
            judged += 1
    assert judged


def test_rules_own_parts_do_not_decide(spark):
    """Words of the hosts decide, whatever the top-level domain; unknown words decide nothing."""
    good, bad = ["garden", "recipes", "museum", "library"], ["casino", "jackpot", "poker", "betting"]
    rows = [(i, f"http://{good[i % 4]}{good[(i + 1) % 4]}{i}.com/a", " ".join(good + bad) * 3) for i in range(200)]
    rows += [(1000 + i, f"http://{bad[i % 4]}{bad[(i + 1) % 4]}{i}.net/es/a", "") for i in range(20)]
    open_ = {2000: "http://casinopoker.org/x", 2001: "http://gardenmuseum.org/x", 2002: "http://casinopoker.net/x", 2003: "http://gardenmuseum.net/x", 2004: "http://zzqx.org/", 2005: "http://zzqx.net/"}
    pages = spark.createDataFrame([*rows, *((i, u, None) for i, u in open_.items())], "page_id long, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, queries.URL_RULES).collect() if r["page_id"] in open_}
    assert got == {2000: "block", 2001: "allow", 2002: "block", 2003: "allow", 2004: "allow", 2005: "allow"}
    found = urls.held_out(pages, queries.URL_RULES, (F.col("page_id") % 4) == 2).collect()
    assert len(found) > 40 and all(r["verdict"] == r["predicted"] for r in found)


def test_held_out_on_the_tables(spark):
    found = urls.held_out(spark.read.parquet(f"{SF}/pages.parquet"), queries.URL_RULES, F.crc32(F.col("page_id").cast("string").cast("binary")) % 4 == 2).collect()
    right = sum(r["verdict"] == r["predicted"] for r in found)
    print(f"held out: {right} of {len(found)}, blocked {sum(r['verdict'] == 'block' for r in found)}")
    assert found
