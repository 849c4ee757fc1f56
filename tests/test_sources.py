"""Readers, writers, conversion and streams on small files."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from glosa.session import work_dir
from glosa.sources import conversion, readers, writers
from glosa.streaming import ingest


def dump(spark, rows, schema):
    path = work_dir(spark, "test")
    writers.write_csv(spark.createDataFrame(rows, schema), path)
    return path


def test_optional_columns_and_defaults(spark):
    path = dump(spark, [('say "hi",\nok \\', "2020-01-01", "True"), (None, "2020-01-01", "x"), ("b", None, "x"), ("c", "d", None)],
                "original_comment string, published_at string, is_spam string")
    rows = sorted(tuple(r) for r in readers.read_comments(spark, path).collect())
    assert rows == [("c", "d", "unknown", "unknown"), ('say "hi",\nok \\', "2020-01-01", "True", "unknown")]


def test_missing_required_column(spark):
    with pytest.raises(ValueError):
        readers.read_comments(spark, dump(spark, [("a",)], "original_comment string"))


def test_quoted_csv_has_one_line_per_row(spark):
    path = work_dir(spark, "test")
    writers.write_quoted_csv(spark.createDataFrame([(1, 'a "b"\nc'), (2, " d ")], "i long, t string"), path)
    rows = sorted((r.i, r.t) for r in readers.read_csv(spark, path, multi_line=False).collect())
    assert rows == [("1", 'a "b" c'), ("2", " d ")]


def test_coercion_leaves_ids_alone(spark):
    df = spark.createDataFrame([("Ugx1", "YES", "7", "n/a", "5.0")], "comment_id string, is_reply string, like_count string, created_at_unix string, reply_count string")
    assert tuple(conversion.coerce_types(df).first()) == ("Ugx1", True, 7, 0.0, 5)


def test_more_rows_than_the_source_fail(spark):
    a = spark.range(100).select(F.col("id"), F.lit("x").alias("c"))
    assert conversion.conversion_status(a, a.filter("id < 96")).first().status == "ok"
    assert conversion.conversion_status(a, a.filter("id < 95")).first().status == "failed"
    assert conversion.conversion_status(a, a.union(a)).first().status == "failed"


def test_cells_compare_with_tolerance_and_nulls(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, "x"), (3, 3.0, "y")], "k long, v double, s string")
    b = spark.createDataFrame([(1, 1.0000000001, None), (2, 2.5, "x")], "k long, v double, s string")
    assert {r.column: (r.compared, r.differing) for r in conversion.compare_tables(a, b, "k").collect()} == {"v": (2, 2), "s": (2, 1)}


def test_convert_skips_existing_targets(spark):
    root = work_dir(spark, "test")
    writers.write_csv(spark.createDataFrame([("1",)], "like_count string"), f"{root}/in/sub")
    first = conversion.convert_tree(spark, f"{root}/in", f"{root}/out")
    assert conversion.convert_tree(spark, f"{root}/in", f"{root}/out") == first
    assert all("/out/sub/" in p for p in first)
    assert [r.like_count for r in spark.read.parquet(*first).collect()] == [1]


def test_no_first_row_is_lost_however_late(spark):
    root = work_dir(spark, "test")
    rows = spark.range(15).select(F.col("id"), F.expr("TIMESTAMP '2024-01-01 00:00:00' + make_interval(0,0,0,id)").alias("ts"))
    for low, high in ((10, 15), (0, 6), (4, 12)):  # days out of order, some twice
        rows.filter(F.col("id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        ingest.append_new(stream, "id", "ts", f"{root}/out", f"{root}/cp")
    assert sorted(r.id for r in spark.read.parquet(f"{root}/out").collect()) == list(range(15))


def test_work_dir_follows_the_session():
    def session(**conf):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key.split(".")[1], default)))

    assert work_dir(session(checkpoint="hdfs:///shared/"), "x").startswith("hdfs:///shared/x-")
    assert work_dir(session(sql="hdfs:///warehouse"), "x").startswith("hdfs:///warehouse/x-")


def test_large_integers_stay_exact(spark):
    df = spark.createDataFrame([("9007199254740993",), ("12.7",), ("x",)], "like_count string")
    assert [r.like_count for r in conversion.coerce_types(df).collect()] == [9007199254740993, 12, 0]


def test_a_hundred_small_files(spark):
    root = work_dir(spark, "test")
    rows = spark.range(100).withColumn("view_count", F.col("id").cast("string"))
    rows.repartition(100, "id").sortWithinPartitions("id").write.partitionBy("id").option("header", True).csv(f"{root}/in")
    out = conversion.convert_tree(spark, f"{root}/in", f"{root}/out")
    assert len(out) == 100
    back = spark.read.option("recursiveFileLookup", True).parquet(f"{root}/out")
    assert sorted(r.view_count for r in back.collect()) == list(range(100))
    status = conversion.tree_status(spark, f"{root}/in", f"{root}/out").collect()
    assert len(status) == 100 and {r.status for r in status} == {"ok"}
    writers.write_csv(spark.createDataFrame([("1", "2")], "a string, b string").coalesce(1), f"{root}/in/late")
    late = conversion.tree_status(spark, f"{root}/in", f"{root}/out").filter("file LIKE 'late/%'").first()
    assert late.status == "missing" and late.source_rows == 1 and late.source_columns == 2


def test_repeated_keys_are_no_pairs(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0), (2, "z", 3.0), (None, "n", 0.0)], "k long, s string, v double")
    got = {r.column: (r.compared, r.differing) for r in conversion.compare_tables(a, a, "k").collect()}
    assert got == {"s": (4, 0), "v": (4, 0)}
    b = spark.createDataFrame([(1, "x", 1.0), (2, "z", 3.0 + 1e-9), (3, "q", 1.0)], "k long, s string, v double")
    got = {r.column: (r.compared, r.differing) for r in conversion.compare_tables(a, b, "k").collect()}
    assert got == {"s": (2, 3), "v": (2, 3)}


def test_types_are_compared(spark):
    a, b = spark.createDataFrame([(1, "x")], "a long, b string"), spark.createDataFrame([(1.0, 2)], "a double, c int")
    got = {r.column: (r.left_type, r.right_type, r.equal) for r in conversion.compare_types(a, b).collect()}
    assert got == {"a": ("bigint", "double", False), "b": ("string", None, False), "c": (None, "int", False)}


def test_work_dir_reads_the_cluster_setting(spark):
    assert spark.conf.get("spark.master", None) == spark.sparkContext.master  # core settings are visible here


def test_landing_keeps_its_tasks(spark, tmp_path, monkeypatch):
    from glosa.plans import source_queries

    sf = "/root/testdata/sf0.001"
    table = source_queries.views.table
    monkeypatch.setattr(source_queries.views, "table", lambda *args: table(*args).repartition(4))
    monkeypatch.setattr(source_queries, "work_dir", lambda *_: str(tmp_path))
    got = [r.event_id for r in source_queries.stream_dedupe(spark, sf).collect()]
    assert sorted(got) == sorted(r.event_id for r in table(spark, sf, "events").collect())
    assert len(list((tmp_path / "landing").glob("*.parquet"))) > 3
    assert len(list((tmp_path / "sink").glob("batch=*"))) == 3


@pytest.mark.parametrize("master, shared, root", [
    ("local[4]", None, "/house/"), ("yarn", "hdfs://x/work/", "hdfs://x/work/"), ("spark://h:7077", None, None),
    ("local-cluster[2,1,1024]", None, None),
])
def test_work_folder_is_shared(master, shared, root):
    own = {"spark.master": master, "spark.checkpoint.dir": shared, "spark.sql.warehouse.dir": "/house"}
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: own.get(key) or default))
    if root:
        assert work_dir(session, "x").startswith(f"{root}x-")
    else:
        with pytest.raises(RuntimeError):
            work_dir(session, "x")
