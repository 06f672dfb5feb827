import pytest

from valograph.functions import schema
from valograph.functions.text import fill_template, mentions_by_number
from valograph.sources.readers import first_authors, resolved_schema
from valograph.sources.sinks import check_outputs


def test_columns_are_found_by_name_part_or_place(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Paper_ID int, author_name int, Note int")
    assert schema.find_column(df, ["paper_id"]) == "Paper_ID"
    assert schema.find_column(df, contains="NAME") == "author_name"
    assert schema.find_column(df, ["nothing"], position=2) == "Note" and schema.find_column(df, ["nothing"]) is None
    assert schema.first_existing(df, ["note", "Note", "Paper_ID"]) == "Note" and schema.first_existing(df, ["x"]) is None
    assert schema.columns_with_prefix(df, "A") == ["author_name"]
    schema.require_columns(df, ["Note"])
    with pytest.raises(ValueError, match="'x', 'y'"):
        schema.require_columns(df, ["y", "x", "Note"])


def test_schema_from_names_and_types():
    assert resolved_schema({"a b": "bigint", "c": "array<string>"}).simpleString() == "struct<a b:bigint,c:array<string>>"


def test_outputs_are_checked_by_rows(spark):
    frames = {"full": spark.range(5), "short": spark.range(1)}
    assert check_outputs(frames, {"full": 5, "short": 2, "absent": 1}) == [("full", True, 5), ("short", False, 1), ("absent", False, 0)]


def test_first_authors_prefer_the_one_placed_first(spark):
    rows = [("p", "Second", "middle", 1), ("p", "One", "First", 2), ("q", "", "first", 1), ("q", "Named", "last", 2), ("q", "Later", "last", 3), ("r", None, "first", 1)]
    df = spark.createDataFrame(rows, "paper_id string, author_name string, author_position string, place int")
    assert {tuple(x) for x in first_authors(df, [df["place"].asc()]).collect()} == {("p", "One"), ("q", "Named")}


def test_template_slots_hold_columns_and_the_rest_stays(spark):
    df = spark.createDataFrame([(1.5, "x%", None)], "n double, s string, t string")
    out = df.select(fill_template("100% of {s}\n{{{n:.2f}}} [{t}] {n}", s="s", n="n", t="t")).first()[0]
    assert out == "100% of x%\n{1.50} [] 1.5" and df.select(fill_template("")).first()[0] == ""


def test_mentions_keep_each_window_once_per_number(spark):
    index = [("w1", "exact", [1]), ("w2", "grouped", [1, 2, 2]), ("w1", "range", [1, 3]), ("w3", "exact", [])]
    df = spark.createDataFrame([(9, index), (8, [])], "doc long, index array<struct<window:string,kind:string,numbers:array<int>>>")
    got = {x.number: [(m.at, m.kind, m.window) for m in x.mentions] for x in mentions_by_number(df, "doc", "index").collect()}
    assert got == {1: [(0, "exact", "w1"), (1, "grouped", "w2")], 2: [(1, "grouped", "w2")], 3: [(2, "range", "w1")]}
