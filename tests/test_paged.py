import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan
from pyspark.sql.types import StructType

from muster.sources import paged

SCHEMA = "natural_key string, n int, tags array<string>, kind string"


def rows(spark, begin, end, kind="a"):
    return spark.range(begin, end).select(F.concat(F.lit("k"), F.lpad("id", 5, "0")).alias("natural_key"), F.col("id").cast("int").alias("n"), F.array(F.lit("x"), F.lit(None).cast("string")).alias("tags"), F.when(F.col("id") % 2 == 0, kind).alias("kind"))


def test_pages_are_written_in_requests_and_read_in_ranges(spark, tmp_path):
    path = str(tmp_path / "store")
    assert paged.read(spark, path, SCHEMA).count() == 0
    paged.write_missing(rows(spark, 0, 1000), path)
    sizes = [sum(1 for _ in open(p)) for p in paged.pages(path)]
    assert sum(sizes) == 1000 and max(sizes) <= 250
    # Of the second load the half that is stored conflicts; the rest is written.
    paged.write_missing(rows(spark, 500, 1500, "late").union(rows(spark, 1499, 1500, "late")), path)
    got = paged.read(spark, f"file://{path}", SCHEMA)
    assert got.count() == 1500 and got.where("kind = 'late'").agg(F.min("n")).first()[0] == 1000
    assert got.where("natural_key = 'k00003'").first().asDict() == {"natural_key": "k00003", "n": 3, "tags": ["x", None], "kind": None}
    assert not os.path.exists(f"{path}/_staged") or not os.listdir(f"{path}/_staged")
    reader = paged.FilteredReader(path, StructType.fromDDL(SCHEMA), 2)
    assert len(reader.partitions()) == -(-len(paged.pages(path)) // 2)
    left = list(reader.pushFilters([EqualTo(("kind",), "late"), GreaterThan(("n",), 1200)]))
    assert left == [GreaterThan(("n",), 1200)] and sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 250


def test_filters_reach_the_pages(spark, tmp_path):
    path = str(tmp_path / "store")
    paged.write_missing(rows(spark, 0, 300), path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert [r["n"] for r in paged.read(spark, path, SCHEMA).where("natural_key = 'k00042' and n > 5").collect()] == [42]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    paged.write_missing(rows(spark, 0, 10), path)
    before = paged.pages(path)
    bad = rows(spark, 10, 2000).withColumn("n", F.when(F.col("n") == 1900, F.raise_error(F.lit("broken")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="broken"):
        bad.repartitionByRange(4, "natural_key").write.format("pages").mode("append").save(path)
    assert paged.pages(path) == before and not os.listdir(f"{path}/_staged") and paged.read(spark, path, SCHEMA).count() == 10
    # A request that has landed, in a commit that is tried again, is not taken twice.
    one = rows(spark, 10, 20).coalesce(1)
    for _ in range(2):
        one.write.format("pages").mode("append").save(path)
    assert paged.read(spark, path, SCHEMA).count() == 20 and all(json.loads(x) for p in paged.pages(path) for x in open(p))
    with pytest.raises(Exception, match="250"):
        one.write.format("pages").option("size", 251).mode("append").save(path)


def test_a_collection_is_created_once_and_grows(spark):
    from muster.sources import records

    spark.sql("DROP TABLE IF EXISTS collection_of_test")
    try:
        records.create_collection(spark, "collection_of_test", "name string, n int")
        spark.sql("INSERT INTO collection_of_test VALUES ('a', 1, 'k', 'b')")
        for schema in ("name string, n int", "n int", "Name string, tags array<string>"):
            records.create_collection(spark, "collection_of_test", schema)
        assert [f.name for f in spark.table("collection_of_test").schema] == ["name", "n", "natural_key", "batch_id", "tags"]
        assert spark.table("collection_of_test").first().asDict() == {"name": "a", "n": 1, "natural_key": "k", "batch_id": "b", "tags": None}
        with pytest.raises(ValueError, match="another type of n"):
            records.create_collection(spark, "collection_of_test", "n string, more int")
        assert "more" not in spark.table("collection_of_test").columns
    finally:
        spark.sql("DROP TABLE IF EXISTS collection_of_test")
