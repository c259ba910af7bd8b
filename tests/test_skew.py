from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from conftest import executed_plan
from touchpath.operators.skew import lookup_join


@pytest.fixture(scope="module")
def sides(spark):
    """A third of the rows on one key (many of them identical), some without key, some unknown."""
    rng = random.Random(11)
    rows = [("hot", 1)] * 500 + [("hot", i) for i in range(500)] + [(None, i) for i in range(300)]
    rows += [(f"k{rng.randrange(400)}", i) for i in range(1700)]
    facts = spark.createDataFrame(rows, "k string, n int").repartition(5)
    lookup = spark.createDataFrame([("hot", "h"), *[(f"k{i}", f"v{i}") for i in range(0, 400, 2)], ("other", "o")], "k string, v string")
    return facts, lookup.groupBy("k").agg(F.min("v").alias("v"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_equals_the_plain_join(sides, how):
    facts, lookup = sides
    got = lookup_join(facts, lookup, ["k"], how)
    want = facts.join(lookup, "k", how)
    assert got.columns == want.columns

    def bag(df):
        return sorted(repr(tuple(r)) for r in df.collect())

    assert bag(got) == bag(want)


@pytest.mark.parametrize("keys", [["d"], ["n"], ["k", "d"]])
def test_keys_of_other_types(spark, keys):
    rows = spark.range(50).select((F.col("id") % 7).alias("n"), F.expr("date_add(date'2026-01-01', int(id % 7))").alias("d"), F.expr("concat('k', id % 7)").alias("k"))
    lookup = rows.where("n < 4").groupBy(*keys).agg(F.count("*").alias("c"))
    assert lookup_join(rows, lookup, keys).count() == rows.join(lookup, keys).count() == rows.where("n < 4").count()


HOT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_heavy_keys_are_split_and_facts_read_once(spark, how):
    """No list of heavy keys, no count before the join: AQE finds and splits them."""
    facts = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 900)).alias("k"), F.col("id").alias("n"))
    lookup = spark.range(450).select(F.concat(F.lit("k"), F.col("id")).alias("k")).union(spark.createDataFrame([("hot",)], "k string")).groupBy("k").agg(F.count("*").alias("v"))
    before = {k: spark.conf.get(k) for k in HOT}
    try:
        for k, v in HOT.items():
            spark.conf.set(k, v)
        joined = lookup_join(facts, lookup, ["k"], how)
        joined.collect()
        plan = executed_plan(joined).split("== Initial Plan ==")[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "skew=true" in plan
    assert plan.count("Range (0, 30000") == 1
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
