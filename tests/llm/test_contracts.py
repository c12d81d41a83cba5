"""Every corpus query against a plain version, on a driver table and on a fixture of odd rows."""

import hashlib
import zlib

import brute
import numpy as np
import oracle
import pytest
import zstandard
from tokenizers import Tokenizer

from tidewater.llm import decontaminate, language, line_dedup, ngram_join, packing, pii, quality, queries, substring_dedup, token_files, urls
from tidewater.llm.tokens import vocabulary

SF = "/root/testdata/sf0.01"
WORDS = [f"w{i}" for i in range(400)]


def odd_rows():
    """Nulls, empties, short and long texts, ties, near copies, chains and odd characters."""
    rng = np.random.default_rng(5)
    say = lambda n: " ".join(rng.choice(WORDS, n))
    base, passage = say(120), say(20)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One"), (6, "a b c d"), (7, "A b\tc d"), (8, base), (9, base.upper().replace("W", "w")), (10, base)]
    w = base.split()
    for i in range(12):  # a chain in which neighbours are near and the ends are not
        w = w[:]
        w[i * 9 : i * 9 + 1] = [f"x{i}"]
        rows.append((20 + i, " ".join(w)))
    rows += [(40 + i, say(30) + " " + passage + " " + say(25)) for i in range(6)]
    rows += [(50, "line one here\nline two here\nline three here\n\nline four"), (51, "x\nline one here\n\nline two here\nline three here\ny"), (52, "line one here\nline two here\nline three here\n\nline four")]
    rows += [(60, "é ü   mail: é@x.de a.b@c.org, +49 (30) 1234-5678. 10.0.0.1 256.1.1.1 4111 1111 1111 1111"), (61, say(3000)), (62, "z " * 5000), (63, "\x0b\x1c a 　 b"), (64, "<|endoftext|> don't ' 12³ \r\n  x")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), "doc_id long, text string").selectExpr("doc_id", "text", "'en' as lang", "1 as token", "2 as root", "3 as key", "4 as n", "5 as part", "6 as rank").repartition(5)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def both(docs, odd):
    return [(docs, pairs(docs)), (odd, pairs(odd))]


def test_ngram_join(docs, odd):
    for df, rows in both(docs, odd):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(df).collect()}
        assert got == brute.near_duplicates(rows)


def test_quality_base(docs, odd):
    for df, rows in both(docs, odd):
        got = {r["doc_id"]: tuple(r)[1:7] for r in quality.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
        assert got == {d: brute.base_counts(t) for d, t in rows}


def test_quality_kept(docs):
    found = quality.judge(docs).collect()
    assert not any(r["kept"] for r in found if r["base_failed"])
    good = [r for r in found if not r["base_failed"]]
    assert sum(r["kept"] for r in good) > 0.9 * len(good)
    assert quality.kept(docs).columns == docs.columns


def test_kneser_ney_against_plain(spark):
    texts = {"a": ["the quick brown fox jumps over the lazy dog and the cat " * 3, "the dog"], "b": ["жизнь прожить не поле перейти", ""], None: ["xyz!!"]}
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate((k, t) for k, x in texts.items() for t in x)], "doc_id long, text string, lang string")
    rows = docs.select("text", quality._language(docs)).selectExpr("*", "xxhash64(__lang) as __lang_key")
    found = quality.model(quality.count_grams(rows)).collect()
    for lang, mine in texts.items():
        want = brute.kneser_ney([t for t in mine if t])
        got = {r["gram"]: (r["p"], r["others"]) for r in found if r["lang"] == ("" if lang is None else "=" + lang)}
        assert got.keys() == want.keys()
        assert all(abs(a - b) < 1e-12 for g in got for a, b in zip(got[g], want[g], strict=True))
        # seen continuations of a context get less than 1 together
        total = {}
        for g, (p, _) in got.items():
            total[g[:-1]] = total.get(g[:-1], 0) + p
        assert all(0 < x < 1 for x in total.values())


def test_quality_verdict_against_plain(spark, docs):
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.select("doc_id", "text", "lang").collect()]
    want = brute.quality_kept(rows, quality.BAND_ABOVE, quality.BAND_BELOW, quality.BAND_LEAST)
    got = {r["doc_id"]: (r["log_ppl"], r["kept"]) for r in quality.judge(docs).collect()}
    assert all((x is None) == (want[d][0] is None) and (x is None or abs(x - want[d][0]) < 1e-3) for d, (x, _) in got.items())
    edge = {d for d, (_, near) in want.items() if near is None}  # within rounding of a band's end
    assert len(edge) < 10 and all(k == want[d][1] for d, (_, k) in got.items() if d not in edge)


def test_quality_rejects_junk(spark, docs):
    """Symbols glued to words, cut-up text and a foreign script go; the same texts without them stay."""
    good = [r for r in docs.where("lang = 'en'").join(quality.judge(docs).where("kept and n_words between 200 and 2000").select("doc_id"), "doc_id").limit(40).collect()]
    junk = {0: lambda t: " ".join(x + "#*$"[i % 3] * 3 for i, x in enumerate(t.split())), 1: lambda t: " ".join(x.upper() + "!!" for x in t.split())}
    planted = [(10**6 + 10 * i + j, make(r["text"]), "en") for i, r in enumerate(good) for j, make in junk.items() if i % 10 == 0]
    rng = np.random.default_rng(8)
    planted.append((10**7, " ".join("".join(rng.choice(list("абвгдежзийклмнопрст"), 6)) for _ in range(150)), "en"))
    table = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string"))
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(table).collect()}
    assert sum(kept[r["doc_id"]] for r in good) >= 0.95 * len(good)
    # shouting is a style of the corpus itself, so one such text may stay
    assert len([d for d, _, _ in planted if kept[d]]) <= 1


def test_no_text_vouches_for_itself(spark, docs):
    """Texts of made-up words, each four times in mixed order, go as those go that have each word once."""
    rng = np.random.default_rng(12)
    planted = []
    for i in range(20):
        words = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 7)) for _ in range(60)] * (4 if i % 2 else 1)
        planted.append((10**6 + i, " ".join(rng.permutation(words)), "en"))
    table = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string"))
    found = {r["doc_id"]: r for r in quality.judge(table).collect()}
    assert not any(found[d]["base_failed"] or found[d]["kept"] for d, _, _ in planted)


def test_quality_keeps_columns_of_any_name(spark):
    names = ["__lang", "__n_words", "__least", "__most", "__kept", "__sum", "__text", "c0", "c1", "__log_ppl", "__base_failed", "n"]
    rows = [(i, " ".join(f"word{j} of{i}" for j in range(60)), "en", *range(len(names))) for i in range(8)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", *(f"`{x}` int" for x in names)]))
    for table in (df, df.where("doc_id < 0")):
        assert sorted(map(tuple, quality.kept(table).collect())) == sorted(map(tuple, table.collect()))
        assert quality.judge(table).count() == table.count()


def test_packing(docs, odd):
    tokenizer = Tokenizer.from_file(vocabulary())
    for df, rows in both(docs, odd):
        want = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
        found = packing.pack(df, vocabulary()).collect()
        by_doc, by_sequence = {}, {}
        for r in found:
            by_doc.setdefault(r["doc_id"], []).append(r)
            by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert by_doc.keys() == want.keys()
        for d, parts in by_doc.items():
            parts.sort(key=lambda r: r["piece"])
            assert [r["piece"] for r in parts] == list(range(len(parts)))
            assert len(parts) == -(-len(want[d]) // 2048)
            at = 0
            for r in parts:
                assert r["start"] == at and r["length"] <= 2048
                assert r["ids_crc32"] == zlib.crc32(np.array(want[d][at : at + r["length"]], "<u4").tobytes())
                at += r["length"]
            assert at == len(want[d])
        total = sum(map(len, want.values()))
        for places in by_sequence.values():
            places.sort()
            at = 0
            for offset, length in places:
                assert offset == at
                at += length
            assert at <= 2048
        assert len(by_sequence) <= 1.05 * total / 2048 + 2


def test_substring_dedup(docs, odd):
    for df, rows in both(docs, odd):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.dedup(df).collect()}
        want = brute.substring_dedup(rows)
        assert {k: v for k, v in got.items() if v != want[k]} == {} and got.keys() == want.keys()


def test_suffix_automaton():
    automaton = substring_dedup.SuffixAutomaton()
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 3, 60).tolist() for _ in range(6)]
    for i, t in enumerate(texts):
        automaton.add(t, i)
    for before in range(7):
        for q in [*texts, rng.integers(0, 3, 60).tolist()]:
            known = {tuple(t[j : j + 5]) for t in texts[:before] for j in range(56)}
            assert automaton.windows(q, 5, before) == [j for j in range(len(q) - 4) if tuple(q[j : j + 5]) in known]


def test_pii_base(docs, odd, spark):
    for df, rows in both(docs, odd):
        found = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
        for d, t in rows:
            base = [(s["start"], s["rank"], s["kind"], s["end"]) for s in found[d] if s["rank"] < 4]
            assert base == brute.base_spans(t), d
            for s in found[d]:
                if s["rank"] == 4:
                    assert all(s["end"] <= b[0] or b[3] <= s["start"] for b in base)


def test_language(docs):
    model = language.fit(docs.where(language.fold() != 2))
    found = language.classify(docs, model).join(docs.select("doc_id", "lang", language.fold().alias("fold")), "doc_id")
    held = found.where("fold = 2 and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in held)


def test_language_against_plain_compression(docs):
    """The smallest output of one-shot compression with each dictionary, over whole texts."""
    model = language.fit(docs.where(language.fold() != 2))
    assert len(model) > 1
    dictionaries = {lang: zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for lang, raw in sorted(model.items())}
    size = lambda lang, x: len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=dictionaries[lang], write_content_size=False, write_checksum=False, write_dict_id=False).compress(x))

    def plain(text):
        if text is None or not any(c.isalpha() for c in text):
            return "und", 0.0
        raw = text.lower().encode("utf-8", "replace")
        parts = [raw[i : i + language.BLOCK_BYTES] for i in range(0, len(raw), language.BLOCK_BYTES)]
        if len(raw) < language.SHORT_BYTES:
            w = raw.split()
            parts = [b" ".join(w[k:] + w[:k]) for k in {len(w) * i // language.ROTATIONS for i in range(language.ROTATIONS)}]
        sizes = sorted((sum(size(lang, x) for x in parts), lang) for lang in dictionaries)
        return sizes[0][1], sizes[1][0] / (sizes[0][0] + sizes[1][0])

    rows = pairs(docs.where("doc_id % 7 = 0")) + [(-1, None), (-2, "123 !"), (-3, "ok"), (-4, "Straße é " * 400)]
    table = docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.classify(table, model).collect()}
    for d, t in rows:
        lang, score = plain(t)
        assert got[d][0] == lang and abs(got[d][1] - score) < 1e-12


def test_language_undetermined(odd):
    got = {r["doc_id"]: r["lang_pred"] for r in language.classify(odd, {"aa": b"abc " * 50, "bb": b"xyz " * 50}).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in ("aa", "bb")


def test_urls(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame(
        [(-1, None, None), (-2, "no scheme", "x"), (-3, "http://EXAMPLE.com/en/a?b", None), (-4, "https://www.example.com/en/x#y", "<p>hi"), (-5, "http://a.net/es/1", ""), (-6, "http://net/fr/", ""), (-7, "://", ""), (-8, "http://org?x=://b/c", "")],
        pages.schema,
    )
    table = pages.unionByName(odd)
    rules = sorted((r.partition("/") + (v,) for r, v in queries.URL_RULES), key=lambda r: -len("".join(r[:3])))
    got = {r["page_id"]: r for r in urls.judge(table, queries.URL_RULES).collect()}
    for r in table.collect():
        host, path = brute.url_parts(r["url"])
        hit = next(((d + s + p, v) for d, s, p, v in rules if (host == d or host.endswith("." + d)) and path.startswith(s + p)), (None, None))
        mine = got[r["page_id"]]
        assert (mine["host"], mine["path"], mine["rule"]) == (host, path, hit[0])
        assert mine["verdict"] in ("allow", "block") and hit[1] in (None, mine["verdict"])


def test_segmenter():
    segment = urls.Segmenter({"best": 50, "news": 40, "site": 30, "new": 10, "s": 5})
    assert segment("bestnewssite") == ["best", "news", "site"]


def test_token_files(spark, docs, odd, tmp_path):
    tokenizer = Tokenizer.from_file(vocabulary())
    for i, (df, rows) in enumerate(both(docs, odd)):
        path = str(tmp_path / str(i))
        token_files.write(df, path, vocabulary())
        want, at = {}, 0
        for d, t in sorted(rows):
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
            want[d] = at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
            at += len(ids)
        assert {r["doc_id"]: tuple(r)[1:] for r in token_files.read(spark, path, ids=False).collect()} == want
        some = sorted(rows)[:: max(1, len(rows) // 5)]
        assert token_files.read_documents(spark, path, [d for d, _ in some]) == {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for d, t in some}


def test_line_dedup(docs, odd, spark):
    for df, rows in both(docs, odd):
        want = brute.line_dedup(rows)
        got = {r["doc_id"]: (r["__lines"], r["__removed"], r["text"]) for r in line_dedup.dedup(df).collect()}
        assert {k: v for k, v in got.items() if v != want[k]} == {} and got.keys() == want.keys()
    assert oracle.differences(queries.op10_line_dedup(spark, SF), line_dedup.ORACLE_SQL, oracle.connect(SF)) == ""


def test_decontamination(spark, docs):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, benchmark).collect()}
    text = {r["item_id"]: r["text"] for r in benchmark.collect()}
    verbatim = {(d, i) for d, t in pairs(docs) for i, x in text.items() if t and x in t}
    assert verbatim <= found
    # the rest is similar enough by the plain definition
    whole = dict(pairs(docs))
    for d, i in found - verbatim:
        a = set(zip(*(decontaminate.plain(text[i]).split()[k:] for k in range(5)), strict=False))
        b = set(zip(*(decontaminate.plain(whole[d]).split()[k:] for k in range(5)), strict=False))
        assert len(a & b) >= 0.7 * len(a)


def test_simhash_blocks():
    """RADIUS differing bits of all 120, at random and spread as evenly as they can be, leave a block within reach."""
    rng = np.random.default_rng(3)
    bits, radius, width = decontaminate.BITS, decontaminate.RADIUS, decontaminate.BLOCK_BITS
    even = [width * (k % decontaminate.BLOCKS) + k // decontaminate.BLOCKS for k in range(radius)]
    for n in range(200):
        a = int.from_bytes(rng.bytes(bits // 8), "little")
        b = a
        for bit in even if n % 4 == 0 else rng.choice(bits, radius, replace=False):
            b ^= 1 << int(bit)
        own = {(k, (b >> (width * k)) & ((1 << width) - 1)) for k in range(decontaminate.BLOCKS)}  # a window's own values
        assert own & set(decontaminate.blocks(a))


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert ngram_join.near_duplicates(none).count() == 0
    assert decontaminate.leaks(none, benchmark).count() == 0
    assert quality.judge(none).count() == 0
    assert packing.pack(none, vocabulary()).count() == 0
    assert substring_dedup.dedup(none).count() == 0
    assert pii.find(none).count() == 0
    assert language.classify(none, language.fit(none)).count() == 0
    assert urls.judge(pages, queries.URL_RULES).count() == 0
    assert line_dedup.dedup(none).count() == 0
    assert decontaminate.leaks(odd, benchmark).count() == 0


def test_repeated_and_null_ids(spark):
    text = " ".join(WORDS[:60])
    df = spark.createDataFrame([(None, text), (7, text), (7, text), (8, text), (None, None), (9, text + " x")], "doc_id long, text string")
    near = ngram_join.near_duplicates(df).collect()
    assert {r["component_id"] for r in near if r["doc_id"] is not None} == {7} and len(near) == 6
    assert all(r["component_id"] is None for r in near if r["doc_id"] is None)
    cut = substring_dedup.dedup(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in cut) == [(0, 0), (0, 0), (7, 0), (7, 0), (8, 60), (9, 60)]
    for f in (quality.judge, pii.find, lambda x: packing.pack(x, vocabulary()), lambda x: language.classify(x, {"a": b"b" * 50}), line_dedup.dedup):
        assert f(df.withColumn("lang", df["text"].substr(1, 2))).count() >= 6
    benchmark = spark.createDataFrame([(1, text), (1, text), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    assert decontaminate.leaks(df, benchmark).where("item_id = 1").count() >= 5
    assert decontaminate.clean(df, benchmark).count() <= 2


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert 0 < len(rows) <= now.count()
        now = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() >= now.count()


def test_digest_columns(spark):
    r = queries.op6_pii(spark, SF).first()
    assert {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"} <= set(r.asDict())
    listed = ",".join(x for x in r["spans"].split(",") if x and not x.startswith("secret"))
    assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
