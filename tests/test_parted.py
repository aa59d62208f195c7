"""Upserts in parts: only touched parts are rewritten, readers see whole writes, files stay bounded."""

from pyspark.sql import functions as F

from linkloom.functions.scratch import list_dirs
from linkloom.operators import predicted as pr
from linkloom.sources.parted import PartedTable
from linkloom.sources.snapshots import SnapshotStore, merge_props


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def parts_of(spark, table, number):
    return {d for d in list_dirs(spark, f"{table.folder}/p={number:06d}") if d.startswith("__part")}


def test_upsert_rewrites_what_it_touches(spark, tmp_path):
    table = PartedTable(spark, str(tmp_path / "t"))
    first = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("a"))
    assert table.create(first, ["id"], parts=32) == 1
    new = spark.createDataFrame([(str(i), None, float(i)) for i in (3, 7, 2000)], "id string, a int, b double")
    assert table.upsert(new, merge_props) == 2
    assert 1 <= len(parts_of(spark, table, 2)) <= 3 and len(parts_of(spark, table, 1)) == 32
    want = [(str(i), 1, float(i) if i in (3, 7) else None) for i in range(1000)] + [("2000", None, 2000.0)]
    assert rows(table.read().select("id", "a", "b")) == sorted(map(str, want))
    assert rows(table.read(1)) == rows(first)  # the version before can still be read
    table.upsert(spark.createDataFrame([("3", 9)], "id string, a int"), merge_props)
    assert [tuple(r) for r in table.read().filter("id = '3'").select("a", "b").collect()] == [(9, 3.0)]


def test_unfinished_writes_are_not_seen_and_old_files_go(spark, tmp_path):
    table = PartedTable(spark, str(tmp_path / "t"))
    table.create(spark.createDataFrame([("a", 0)], "id string, n int"), ["id"], parts=4)
    table._write(spark.createDataFrame([("a", 99)], "id string, n int"), ["id"], 4, 2)  # no manifest follows
    assert rows(table.read()) == ["('a', 0)"]
    for n in range(1, 9):
        table.upsert(spark.createDataFrame([("a", n), (f"x{n}", n)], "id string, n int"), merge_props)
    assert len(table.versions()) == 3 and table.read().count() == 9
    files = [d for d in list_dirs(spark, table.folder) if d.startswith("p=")]
    assert len(files) <= 3 + 4  # the kept versions, and parts that lie where an older write put them
    assert table.read().filter("id = 'a'").first()["n"] == 8


def test_empty_tables(spark, tmp_path):
    table = PartedTable(spark, str(tmp_path / "t"))
    none = spark.createDataFrame([], "id string, n int")
    table.create(none, ["id"])
    assert table.read().count() == 0 and table.read().columns == ["id", "n"]
    table.upsert(none, merge_props)
    table.upsert(spark.createDataFrame([("a", 1), (None, 2)], "id string, n int"), merge_props)
    assert table.read().count() == 2


def test_snapshots_mix_whole_and_parted_versions(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    edges = spark.createDataFrame([("a", "b", "REL", 1.0), ("b", "c", "REL", 2.0)], "src string, dst string, type string, first_ts double")
    edges = edges.withColumns({"last_ts": F.col("first_ts"), "ts": F.col("first_ts"), "timestamps": F.array("first_ts"), "interaction_count": F.lit(1).cast("bigint")})
    store.write("g", "edges", pr.observed_rows(edges), partition_by="predicted")
    for n in range(10):
        chosen = spark.createDataFrame([("a", f"n{n}", 0.9)], "s string, t string, probability double")
        store.append_edges("g", pr.round_rows(store.edges("g"), chosen))
    found = store.edges("g")
    assert found.count() == 12 and sorted(r.predicted for r in found.collect()) == [0, 0, *range(1, 11)]
    assert len(store.parted("g", "edges").versions()) == 3
    store.write("g", "edges", found.filter("predicted < 2"), partition_by="predicted")
    assert store.edges("g").count() == 3
    store.write_edges("g", edges.filter("src = 'a'").withColumn("interaction_count", F.lit(7).cast("bigint")))
    assert store.edges("g").count() == 3 and store.edges("g").filter("src = 'a' and type = 'REL'").first()["interaction_count"] == 7
