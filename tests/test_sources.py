"""Knowledge files and snapshot exports read from small folders of their own."""

import base64
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidewater.sources import markdown, snapshots


@pytest.fixture
def folder(tmp_path):
    intro = "x" * 60
    texts = {
        "a.md": f"---\nscenario: vpn\ntags: [one, two]\n---\n{intro}\n## First\nbody\n### deeper\nmore\n## Second\nend\n",
        "sub/b.md": "---\nscenario: email\n---\nno heading at all\n",
        "c.md": "no front matter",
        "d.md": "---\nscenario: vpn\n---\n![x](y.png)\n",
        "e.txt": "not read",
    }
    for name, text in texts.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(text)
    (tmp_path / "f.md").write_bytes(b"---\nscenario: vpn\n---\n\xff")
    return str(tmp_path)


def test_documents(spark, folder):
    rows = {r.path.rsplit("/", 1)[1]: r for r in markdown.documents(markdown.read_files(spark, folder), strict=True).collect()}
    assert sorted(rows) == ["a.md", "b.md", "c.md", "d.md", "f.md"]
    assert rows["a.md"].meta == {"scenario": "vpn", "tags": "one,two"} and rows["a.md"].error is None
    assert all(rows[x].error and rows[x].content is None for x in ("c.md", "d.md", "f.md"))
    assert rows["b.md"].doc_id == hashlib.sha256(rows["b.md"].path.encode()).hexdigest()[:16]


def test_sections(spark, folder):
    docs = markdown.documents(markdown.read_files(spark, folder), strict=True).where("error is null and path like '%/a.md'")
    found = [(r.seq, r.chunk_type, r.text) for r in markdown.sections(docs).orderBy("seq").collect()]
    assert [x[:2] for x in found] == [(0, "parent"), (1, "child"), (2, "child"), (3, "child")]
    assert [x[2] for x in found[1:]] == ["x" * 60, "## First\nbody\n### deeper\nmore", "## Second\nend"]
    alone = docs.selectExpr("doc_id", "'short intro\\n## Only\\nbody' AS content")
    assert [r.text for r in markdown.sections(alone).where("seq > 0").collect()] == ["## Only\nbody"]


def _export(path, damaged=False):
    files = {"b.md": b"second", "a.md": b"first"}
    hashes = {k: hashlib.sha256(v).hexdigest() for k, v in sorted(files.items())}
    whole = hashlib.sha256(json.dumps({"commit": "c1", "files": hashes}, separators=(",", ":")).encode()).hexdigest()
    stored = {k: {"sha256": hashes[k], "bytes": base64.b64encode(b"other" if damaged and k == "a.md" else v).decode()} for k, v in files.items()}
    path.write_text(json.dumps({"version": 1, "commit": "c1", "snapshot_hash": whole, "files": stored}))
    return str(path)


def test_export(spark, tmp_path):
    files = snapshots.read_export(spark, _export(tmp_path / "whole.json"))
    assert {r.path: bytes(r.content) for r in files.collect()} == {"a.md": b"first", "b.md": b"second"}
    assert snapshots.verified(files).collect() == [("c1", 2, 0, True)]
    assert snapshots.snapshot_hash(files, "c1").first()[0] == files.first().snapshot_hash
    assert snapshots.violations(files).count() == 0 and snapshots.violations(files.union(files)).collect() == [("repeated", 2, 0)]
    assert snapshots.verified(snapshots.read_export(spark, _export(tmp_path / "broken.json", damaged=True))).collect() == [("c1", 2, 1, False)]


def test_streams_and_headers(spark):
    stream = "event: a\ndata: 1\n\n: ping\n\ndata: 2\n\n"
    row = spark.createDataFrame([(1, stream, "lead [1] one [2]  [3] three")], "id int, stream string, text string")
    assert [tuple(x) for x in row.select(snapshots.events_of(row["stream"])).first()[0]] == [("a", "1"), ("", "2")]
    assert [(r.header, r.body) for r in snapshots.between_headers(row, "id", "text", r"\[[0-9]\]").orderBy("nth").collect()] == [("[1]", "one"), ("[3]", "three")]


def test_nested_samples(spark):
    found = snapshots.nested_samples(spark.range(100), "id", [5, 20], 7).collect()
    assert len(found) == 20 and sum(r.corpus == 5 for r in found) == 5


def test_sections_keep_rows_where_they_lie(spark):
    docs = spark.createDataFrame(
        [(1, "short\r\n##  \x0bno\n## A\n\n### deep\n##no\n" + " " * 200_000 + "x \n## B\t"), (1, "## C\n" + "y" * 60), (2, ""), (3, None), (4, "z" * 60 + "\n##\n## \n##\tD"), (None, "alone")], "doc_id long, content string"
    )
    parts = markdown.sections(docs)
    assert "Exchange" not in parts._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in parts.where("seq > 0").collect():
        found.setdefault(r.doc_id, []).append((r.seq, r.text))
    assert sorted(found[1]) == [(1, "##  \nno"), (1, "## C\n" + "y" * 60), (2, "## A\n\n### deep\n##no\n" + " " * 200_000 + "x"), (3, "## B")]
    assert found[4] == [(1, "z" * 60 + "\n##\n##"), (2, "##\tD")] and found[None] == [(1, "alone")] and set(found) == {1, 4, None}
    assert parts.where("seq = 0").count() == 6


def test_bounded_pieces(spark):
    texts = [None, "", "a" * 9, "ab\n\U0001f600é" * 4]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select("text", markdown.bounded(F.col("text"), 9).alias("pieces")).collect()
    for r in rows:
        starts = range(0, max(len(r.text or "") - 1, 0) + 1, 9)
        assert [tuple(x) for x in r.pieces] == [(i, r.text and r.text[i : i + 9]) for i in starts]


def test_generation_chunks_of_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "p", "one", {"a": "b"}), (1, "q", "two", {"a": "b"}), (None, "r", "three", {"a": "b"})], "doc_id long, path string, content string, meta map<string,string>")
    found = markdown.generation_chunks(docs, "kb", F.lit("r1"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((str(r.doc_id), r.chunk_id is None, r.text, r.metadata["source_url"]) for r in found.where("chunk_type = 'child'").collect()) == [("1", False, "one", "p"), ("1", False, "two", "q"), ("None", True, "three", "r")]
