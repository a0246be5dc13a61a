"""Footers: schemas, ranges, and the files that a lookup opens."""

import pytest
from pyspark.sql import functions as F

from wavemill.sources import footers, ranged


def dataset(spark, folder, n=400, files=8):
    rows = spark.range(n).select(F.format_string("w%05d", "id").alias("sample_id"), (F.col("id") * 2).alias("x"), F.array(F.lit(1.0).cast("float")).alias("v"))
    rows.repartitionByRange(files, "sample_id").write.parquet(folder)
    return rows


def test_ranges_and_lookups_open_few_files(spark, tmp_path):
    root = str(tmp_path / "d")
    dataset(spark, root)
    known = footers.catalogue(spark, root).cache()
    rows = sorted(known.collect(), key=lambda r: r.low)
    assert len(rows) == 8 and sum(r.rows for r in rows) == 400 and len({r.fingerprint for r in rows}) == 1
    assert rows[0].low == "w00000" and rows[-1].high == "w00399" and all(a.high < b.low for a, b in zip(rows, rows[1:])) and all(r.nulls == 0 for r in rows)
    found = footers.lookup(spark, root, ["w00003", "w00390", "nothing"], known=known)
    assert sorted(r.x for r in found.collect()) == [6, 780] and len(found.inputFiles()) == 2
    assert footers.lookup(spark, root, [], known=known).count() == 0 and footers.lookup(spark, root, ["zzz"]).count() == 0


def test_only_footers_are_read(spark, tmp_path):
    root = str(tmp_path / "d")
    spark.range(300_000).select(F.sha2(F.col("id").cast("string"), 256).alias("sample_id")).coalesce(1).write.option("compression", "none").parquet(root)
    path = footers.catalogue(spark, root).first().path
    data = ranged.Bytes(path)
    assert footers.footer(data).num_rows == 300_000 and data.taken <= footers.TAIL and data.size > 100 * footers.TAIL


def test_fragments_of_another_schema_are_refused(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    rows = dataset(spark, a)
    dataset(spark, b, 10, 1)
    assert footers.union(spark, [a, b]).count() == 410
    rows.limit(5).withColumn("x", F.col("x").cast("string")).write.parquet(c)
    with pytest.raises(ValueError, match=r"differ in schema.*BYTE_ARRAY.*INT64"):
        footers.union(spark, [a, b, c])
    (tmp_path / "b" / "broken.parquet").write_bytes(b"no")
    with pytest.raises(ValueError, match="unreadable fragments.*not a Parquet file"):
        footers.union(spark, [a, b])
    assert footers.catalogue(spark, b).filter("error is null").count() == 1


def test_files_without_a_range_are_always_opened(spark, tmp_path):
    root = str(tmp_path / "d")
    spark.createDataFrame([(None, 1)], "sample_id string, x int").write.parquet(root)
    spark.createDataFrame([("k", 2)], "sample_id string, x int").write.mode("append").parquet(root)
    got = {(r.low, r.nulls) for r in footers.catalogue(spark, root).filter("rows > 0").collect()}
    assert got == {(None, 1), ("k", 0)}
    assert [r.x for r in footers.lookup(spark, root, ["k"]).collect()] == [2]
    other = footers.catalogue(spark, root, "missing").filter("rows > 0")
    assert {r.nulls for r in other.collect()} == {-1}
