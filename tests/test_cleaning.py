import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.operators import clean, graph
from linkloom.sources import files


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_self_loops_compare_numbers_by_value(spark):
    df = spark.createDataFrame([("1", "1.0"), ("a", "a"), ("1", "a"), ("01", "1"), ("1d", "1")], "src string, dst string")
    assert rows(clean.drop_self_loops(df), "src", "dst") == [("1", "a"), ("1d", "1")]


def test_direction_is_numeric_for_numbers_and_text_otherwise(spark):
    df = spark.createDataFrame([("10", "2"), ("a2", "a10"), ("b", "7"), ("2", "10")], "src string, dst string")
    assert rows(clean.canonicalize_direction(df), "src", "dst") == [("2", "10"), ("2", "10"), ("7", "b"), ("a10", "a2")]


def test_types_are_sanitised(spark):
    df = spark.createDataFrame([("a b-c",), ("--",), (None,), ("é_1",)], "rel_type string")
    assert [r["type"] for r in clean.with_type(df).collect()] == ["abc", "REL", "REL", "é_1"]


def test_bad_times_are_counted(spark):
    df = spark.createDataFrame([("1",), ("1d",), ("NaN",), (None,), (" 2.5 ",)], "When string")
    with pytest.raises(ValueError, match="3 non-numeric"):
        clean.resolve_timestamp(df, "when").collect()
    with pytest.raises(ValueError, match="no time column"):
        clean.resolve_timestamp(df, "missing")
    assert clean.resolve_timestamp(df, "when", temporal=False).select("ts").distinct().first()["ts"] == 0.0


def test_collapse_takes_last_non_null_and_distinct_times(spark):
    data = [("1", "2", "T", 3.0, 0, "x"), ("1", "2", "T", 1.0, 1, None), ("1", "2", "T", 3.0, 2, "y"), ("1", "2", "T", 5.0, 3, None), ("1", "2", "U", 9.0, 4, None)]
    df = spark.createDataFrame(data, "src string, dst string, type string, ts double, row_idx long, note string")
    out = {r["type"]: r for r in clean.collapse_edges(df).collect()}
    assert out["T"]["timestamps"] == [1.0, 3.0, 5.0] and out["T"]["note"] == "y" and out["T"]["interaction_count"] == 3
    assert out["T"]["first_ts"] == 1.0 and out["T"]["ts"] == 5.0 and out["U"]["note"] is None


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(0, 3)), min_size=1, max_size=25))
def test_cleaning_is_idempotent_and_ignores_direction(spark, data):
    df = spark.createDataFrame([(str(a), str(b), str(t)) for a, b, t in data], "src string, dst string, ts string")
    turned = df.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "ts")
    once = clean.clean_edges(df, "ts")
    keep = ("src", "dst", "type", "timestamps")
    assert rows(once, *keep) == rows(clean.clean_edges(turned, "ts"), *keep)
    again = clean.clean_edges(once.select("src", "dst", F.explode("timestamps").alias("ts")), "ts")
    assert rows(once, *keep) == rows(again, *keep)


def test_largest_component_and_tie(spark, edges):
    assert len(rows(clean.largest_component(edges), "src", "dst")) == 4
    tie = spark.createDataFrame([("5", "6"), ("1", "2")], "src string, dst string")
    assert rows(clean.largest_component(tie), "src", "dst") == [("1", "2")]


def test_nid_is_dense_in_id_order(spark):
    df = spark.createDataFrame([("10",), ("9",), ("b",), ("a",), ("1.5",)], "id string")
    out = sorted((r["nid"], r["id"]) for r in clean.assign_nid(df).collect())
    assert out == [(0, "1.5"), (1, "9"), (2, "10"), (3, "a"), (4, "b")]


def test_csv_reading(spark, tmp_path):
    (tmp_path / "e.csv").write_text("Src,DST,Rel_Type,ts,w\n1,2,A,5,NA\n3,,B,6,1\nnull,4,C,7,2\n")
    df = files.read_edges(spark, str(tmp_path / "e.csv"))
    assert df.columns == ["src", "dst", "rel_type", "ts", "w", "row_idx"]
    out = clean.clean_edges(df, "TS").collect()
    assert [(r["src"], r["dst"], r["type"], r["w"]) for r in out] == [("1", "2", "A", None)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        files.read_edges(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "f.csv").write_text("ID,x\n1,3\n")
    assert files.read_features(spark, str(tmp_path / "f.csv")).collect()[0].asDict() == {"id": "1", "x": "3"}


def test_sample_graph(spark):
    nodes, links = files.sample_graph(spark)
    edges = clean.clean_edges(files.as_edges(links), temporal=False)
    assert nodes.count() == 6 and edges.count() == 6
    assert {r["degree"] for r in graph.degree(edges).collect()} == {2}
    assert graph.connected_components(edges).select("component").distinct().count() == 1
    path = [r["node"] for r in graph.shortest_path(edges, "0", "3").orderBy("step").collect()]
    assert path[0] == "0" and path[-1] == "3" and len(path) == 4
    near = sorted(r["node"] for r in graph.neighborhood(edges, "0").collect())
    assert near == ["1", "5"]


def test_whole_ids_beyond_doubles(spark):
    big = 2**53
    rows = [(str(big + 1), str(big)), (str(big), str(big + 1)), ("5", "9"), ("9" * 40, "9" * 39 + "8"), ("7", "7.0"), ("-3", "-4")]
    df = spark.createDataFrame(rows, "src string, dst string")
    left = [(r["src"], r["dst"]) for r in clean.canonicalize_direction(clean.drop_self_loops(df)).collect()]
    assert sorted(left) == sorted([(str(big), str(big + 1))] * 2 + [("5", "9"), ("9" * 39 + "8", "9" * 40), ("-4", "-3")])
    ids = spark.createDataFrame([(str(big + i),) for i in (3, 1, 2, 0)], "id string")
    assert [r["id"] for r in clean.assign_nid(ids).orderBy("nid").collect()] == [str(big + i) for i in range(4)]


def test_last_value_follows_the_files(spark, tmp_path):
    from linkloom.sources.files import read_edges

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "part-0.csv").write_text("src,dst,ts,note\na,b,1,old\n")
    (tmp_path / "in" / "part-1.csv").write_text("src,dst,ts,note\n" + "c,d,1,x\n" * 5000 + "a,b,2,new\n")
    got = clean.clean_edges(read_edges(spark, str(tmp_path / "in")), "ts").filter("src = 'a'").collect()
    assert [r["note"] for r in got] == ["new"]


def test_stored_edges_make_the_raw_rows_once(spark):
    """Same rows as the chain that looks at the times first, a bad time is refused, and the raw rows are made once."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = [("2", "1", "5", "x"), ("1", "2", "4", "x"), ("1", "2", "4", "x"), ("3", "3", "1", "x"), (None, "1", "2", "x"), ("10", "9", "7", None)]
    schema = "src string, dst string, ts string, rel_type string"
    raw = spark.createDataFrame(rows, schema).mapInArrow(count, schema)
    got = sorted(map(tuple, clean.stored_edges(raw, "ts").collect()))
    assert made.value == len(rows)
    assert got == sorted(map(tuple, clean.clean_edges(raw, "ts").collect())) and len(got) == 2
    with pytest.raises(ValueError, match="has 2 non-numeric"):
        clean.stored_edges(spark.createDataFrame([*rows, ("1", "5", "soon", "x"), (None, "5", None, "x")], schema), "ts")
