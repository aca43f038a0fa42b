from pyspark.sql import functions as F

from tillwise.functions.skew import CLASSES, crowded_parts, dealt_join, salted_join
from tillwise.functions.stages import one_plan
from tillwise.operators.policies import meet, rank_policies
from tillwise.plans import bindings as b
from tillwise.plans import q_policy


def test_salted_join_never_broadcasts_the_repeated_side(spark):
    """The planner sees 200 rows where the repeats make 3,200, so it must not choose by size."""
    big = spark.range(2000).select((F.col("id") % 200).alias("k"), F.col("id").alias("n"))
    small = spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        out = salted_join(big, small, ["k"], F.col("n"), how)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        assert out.where("v = 2 * k").count() == 2000
        assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_dealt_join_repeats_crowded_keys_only(spark):
    """One key holds half of the rows: it alone is dealt over salts, and the other side is repeated for it alone."""
    big = spark.range(8000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 200).cast("bigint").alias("k"), F.col("id").alias("n"))
    big = big.union(spark.sql("SELECT CAST(NULL AS bigint), -1L")).union(spark.sql("SELECT 5000L, -2L"))
    small = spark.range(300).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    for counted in (None, big.select("k").union(big.select("k"))):
        out = dealt_join(big, small, ["k"], F.col("n"), counted, together=500)
        assert out.count() == 8000 and out.where("v = 2 * k").count() == 8000 and out.select("n").distinct().count() == 8000
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "_class" in plan
    salts = dealt_join(big.withColumn("_n", F.col("n")), small.withColumn("_copy", F.lit(1)), ["k"], F.col("n"), together=500)
    assert set(salts.columns) == {"k", "n", "_n", "v", "_copy"}
    repeated = crowded_parts(big, big, ["k"], 500)
    assert small.join(repeated, F.pmod(F.xxhash64(F.col("k").cast("bigint")), F.lit(CLASSES)) == F.col("_class")).select("k", "_parts").collect() == [(7, 9)]


def test_pairs_carry_no_policy_through_a_shuffle(spark):
    """Rules, regions and trades of a policy are many times wider than a pair; they are shuffled once for each policy, not for each pair."""
    sf = "/root/testdata/sf0.001"
    out = meet(b.policy_pairs(spark, sf), b.stores(spark, sf).select("store_id", "region_code"), q_policy.policies(spark, sf), b.policy_finds(spark, sf))
    plan = out._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    sides = [plan.children().apply(i) for i in (0, 1)]
    names = [{a.name() for a in (side.output().apply(j) for j in range(side.output().size()))} for side in sides]
    assert "rules" not in names[0] and "region_code" in names[0] and "rules" in names[1]


def test_only_eligible_pairs_are_kept_for_benefits(spark):
    """Benefits read the eligible pairs several times; the others are not written, nor is what no benefit reads."""
    sf = "/root/testdata/sf0.001"
    with one_plan():
        kept = q_policy.eligible(spark, sf)
    assert not {"status", "reason", "collateral", "app_start"} & set(kept.columns)
    assert kept.count() == q_policy.eligibility(spark, sf).where("status = 'ELIGIBLE_ON_DECLARED_RULES'").count() > 0


def test_rank_merges_benefits_with_policies(spark):
    benefits = spark.sql("SELECT id AS store_id, id % 3 AS policy_id, DATE '2001-10-01' AS original_burn, 3 AS runway_extension_days, 5.0D AS interest_savings FROM range(20)")
    policies = spark.sql("SELECT id AS policy_id, DATE '2001-09-01' AS app_start, false AS collateral, 2 AS grace_months FROM range(3)")
    out = rank_policies(benefits, policies)
    assert out.count() == 20 and out.where("rank = 1").count() == 20
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner, (policy_id" in x]
    assert joins and all("strategy=merge" in x for x in joins)
