"""Keyed tables: last write wins, only touched partitions change, broken-off changes are taken up again."""

import os

import pytest
from pyspark.sql import functions as F

from lithos.sources import sql, stores


def rows(spark, n, version, step=1):
    return spark.range(0, n, step).select(F.col("id").alias("k"), F.lit(version).cast("long").alias("v"), F.concat(F.lit(f"v{version}-"), F.col("id").cast("string")).alias("text"))


def content(df):
    return sorted((r["k"] is None, r["k"] or 0, r["v"], r["text"]) for r in df.collect())


def files_of(folder):
    return {os.path.join(p, f): os.path.getmtime(os.path.join(p, f)) for p, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def test_upsert(spark, tmp_path):
    folder = str(tmp_path / "t")
    first = rows(spark, 100, 1).unionByName(spark.createDataFrame([(None, 1, "no key")], "k long, v long, text string"))
    stores.upsert_store(first, folder, ["k"], "v", 8)
    table = stores.read(spark, folder, "bucket", "int")
    assert content(table) == content(first)
    stores.upsert_store(rows(spark, 100, 2, 10), folder, ["k"], "v", 8)
    stores.upsert_store(rows(spark, 100, 0, 7), folder, ["k"], "v", 8)  # older versions do not come in
    want = {k: (2 if k % 10 == 0 else 1) for k in range(100)}
    got = {r["k"]: r["v"] for r in stores.read(spark, folder, "bucket", "int").filter("k IS NOT NULL").collect()}
    assert got == want
    before = content(stores.read(spark, folder, "bucket", "int"))
    stores.upsert_store(rows(spark, 100, 2, 10), folder, ["k"], "v", 8)  # the batch again
    assert content(stores.read(spark, folder, "bucket", "int")) == before
    stores.upsert_store(first.limit(0), folder, ["k"], "v", 8)
    assert content(stores.lookup(spark, folder, rows(spark, 3, 9), ["k"], 8)) == [(False, 0, 2, "v2-0"), (False, 1, 1, "v1-1"), (False, 2, 1, "v1-2")]
    assert stores.point_count(spark, folder).first()[0] == 101 and stores.point_count(spark, str(tmp_path / "none")).first()[0] == 0


def test_only_touched_buckets(spark, tmp_path):
    folder = str(tmp_path / "t")
    stores.upsert_store(rows(spark, 200, 1), folder, ["k"], "v", 16)
    before = files_of(folder)
    one = rows(spark, 1, 2)
    stores.upsert_store(one, folder, ["k"], "v", 16)
    bucket = one.select(stores.bucket_of(["k"], 16)).first()[0]
    kept = {f for f in before if f"bucket={bucket}/" not in f}
    after = files_of(folder)
    assert kept <= set(after) and all(after[f] == before[f] for f in kept) and len(kept) == len({f for f in before}) - len({f for f in before if f"bucket={bucket}/" in f})
    new = stores.new_keys(rows(spark, 205, 3), folder, ["k"], 16)
    assert sorted(r["k"] for r in new.collect()) == [200, 201, 202, 203, 204]
    plan = stores.lookup(spark, folder, one, ["k"], 16)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or f"(bucket#{''}" in plan and "PartitionFilters: [" in plan


def test_broken_off_changes(spark, tmp_path):
    """A change whose rows are whole is ended by the next one; one that is not whole goes."""
    folder = str(tmp_path / "t")
    stores.upsert_store(rows(spark, 20, 1), folder, ["k"], "v", 4)
    want = content(rows(spark, 20, 2))
    rows(spark, 20, 2).withColumn("bucket", stores.bucket_of(["k"], 4)).write.parquet(f"{folder}_pending")
    stores.recover(spark, folder, "bucket", "int")
    assert content(stores.read(spark, folder, "bucket", "int")) == want and not os.path.exists(f"{folder}_pending")
    rows(spark, 20, 3).withColumn("bucket", stores.bucket_of(["k"], 4)).write.parquet(f"{folder}_pending")
    os.remove(f"{folder}_pending/_SUCCESS")
    stores.upsert_store(rows(spark, 0, 9), folder, ["k"], "v", 4)
    assert content(stores.read(spark, folder, "bucket", "int")) == want


def test_runs(spark, tmp_path):
    folder = str(tmp_path / "runs")
    hyps = spark.range(60).select(
        F.format_string("%03d", (F.col("id") % 6).cast("int")).alias("run_id"), F.col("id").alias("hyp_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), (F.col("id") % 2 == 0).alias("approved"), F.col("id").alias("created_at")
    )
    stores.save_runs(hyps, folder)
    assert sorted(r["hyp_id"] for r in stores.load_run(spark, folder, "003").collect()) == list(range(3, 60, 6))
    assert stores.load_hypothesis(spark, folder, 9).first()["run_id"] == "003"  # and not 3: ids that look like numbers stay text
    before = files_of(folder)
    stores.replace_hypotheses(spark.createDataFrame([("003", 9, "other"), ("003", 1000, "of no run")], "run_id string, hyp_id long, text string"), folder)
    got = {r["hyp_id"]: r for r in stores.read(spark, folder, "run_id").collect()}
    assert len(got) == 60 and got[9]["text"] == "other" and not got[9]["approved"] and got[15]["text"] == "text 15"
    after = files_of(folder)
    assert all(after.get(f) == m for f, m in before.items() if "run_id=003" not in f)
    assert [tuple(r) for r in stores.list_runs(spark, folder).collect()] == [tuple(r) for r in sql.run_list(hyps).collect()]
    stores.save_runs(hyps.filter("run_id = '001'").limit(2), folder)  # a run anew
    assert stores.load_run(spark, folder, "001").count() == 2 and stores.load_run(spark, folder, "002").count() == 10
    plan = stores.load_run(spark, folder, "002")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_pending_folder_is_not_read(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        stores.read(spark, str(tmp_path / "nothing"), "run_id").count()
