"""Clashing column names, null and repeated ids in the stages' operators."""

from tidewater.llm import decontaminate, line_dedup

LINES = "one line here\nanother line here\na third line here"
ITEM = " ".join(f"w{i}" for i in range(30))


def test_line_dedup_with_clashing_names(spark):
    df = spark.createDataFrame([(1, LINES, 5, 6, 7, 8), (2, LINES, 5, 6, 7, 8), (3, None, 5, 6, 7, 8)], "doc_id long, text string, starts int, __id int, places int, lines int")
    got = {r["doc_id"]: r for r in line_dedup.dedup(df).collect()}
    assert got[1]["text"] == LINES and got[2]["text"] == "" and got[3]["text"] is None
    assert all((r["starts"], r["__id"], r["places"], r["lines"]) == (5, 6, 7, 8) for r in got.values())


def test_leaks_go_whatever_the_id(spark):
    df = spark.createDataFrame([(None, "x " + ITEM), (7, ITEM), (7, "clean words"), (8, None), (None, "")], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, ITEM), (None, None), (2, "")], "item_id long, text string")
    left = [(r["doc_id"], r["text"]) for r in decontaminate.clean(df, benchmark).collect()]
    assert sorted(left, key=repr) == sorted([(7, "clean words"), (8, None), (None, "")], key=repr)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, benchmark).collect()} == {(None, 1), (7, 1)}


def test_stages_keep_columns_of_the_counts_names(spark):
    df = spark.createDataFrame([(1, LINES, 5, 6), (2, LINES + "\nmore words", 5, 6), (3, None, 5, 6), (None, "", 5, 6), (4, LINES, 7, 8)], "doc_id long, text string, __lines int, __removed int")
    left = line_dedup.deduplicated(df)
    assert left.columns == df.columns
    assert sorted(map(tuple, left.collect()), key=repr) == sorted([(1, LINES, 5, 6), (2, "more words", 5, 6), (3, None, 5, 6), (None, "", 5, 6)], key=repr)
    assert line_dedup.deduplicated(df.where("false")).collect() == []
