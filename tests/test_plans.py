import pytest
from pyspark.sql import functions as F

from conftest import SF, rows
from quirelens.plans import lineage, skew, windows
from quirelens.queries import QUERIES


def hot(spark):
    left = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 97 == 0, None).otherwise(F.col("id") % 50).alias("k")
    )
    right = spark.range(0, 40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_the_plain_join(spark, how):
    left, right = hot(spark)
    salted = skew.salted_join(left, right, ["k"], how, ["id"], spread=8)
    assert rows(salted, *sorted(salted.columns)) == rows(left.join(right, "k", how), *sorted(salted.columns))


def test_hot_keys_are_few(spark):
    left, _ = hot(spark)
    assert rows(skew.hot_keys(left, ["k"], 0.2)) == [(7,)]


def test_salt_spreads_the_hot_key(spark):
    left, right = hot(spark)
    plan = skew.salted_join(left, right, ["k"], "inner", ["id"], spread=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and "xxhash64" in plan


def test_adaptive_join_splits_the_hot_key(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
    }
    left = spark.range(0, 60000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    right = spark.range(0, 60000, 1, 8).select(F.col("id").alias("k"), F.col("id").alias("v"))
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = skew.lookup_join(left, right, ["k"], "left", ["id"])
        assert out.count() == 60000
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
        plain = skew.lookup_join(left, right, ["k"], "left", ["id"])
        assert "_salt" in plain._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
        for k in conf:
            spark.conf.unset(k)


def test_next_in_group_in_chunks(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), "id")
    df = df.unionByName(spark.range(3).select(F.lit(None).cast("string").alias("k"), "id"))
    whole = windows.next_in_group(df, ["k"], ["id"], ["id"])
    cut_up = windows.next_in_group(df, ["k"], ["id"], ["id"], group_rows=10)
    assert rows(whole) == rows(cut_up)
    assert cut_up.filter("k = 'hot' and next_id is null").count() == 1


def test_latest_limits_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 5).alias("k"), "id")
    out = windows.latest(df, ["k"], [F.desc("id")])
    assert rows(out) == [(i, 95 + i) for i in range(5)]
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_cut_writes_to_the_shared_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = lineage.shared_folder(spark)
    assert named is None or folder == named
    df = lineage.cut(spark.range(10).withColumn("x", F.col("id") * 2))
    assert df.count() == 10
    assert all(folder.removeprefix("file:") in f for f in df.inputFiles())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "Range" not in plan


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(QUERIES["key_dups"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>" in plan
    assert "EqualTo(o_orderstatus,F)" in plan_of(QUERIES["fk_orphans"](spark, SF))
