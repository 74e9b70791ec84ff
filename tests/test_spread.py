from pyspark.sql import functions as F

from fleetlife.operators import compare
from fleetlife.plans import sweep


def test_tasks_of_a_dedupe_do_not_grow_with_the_rows(spark):
    for n in (2_000, 20_000):
        rows = sweep.dealt(spark.range(n).select((F.col("id") % 7).alias("unit_number"), F.col("id").alias("time_cycles")), 10, per_task=5_000)
        many = rows.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(10)))).withColumns({"run": F.lit(1), "v": F.col("seed") * 1.0})
        once = compare.dedupe(many.unionByName(many.where("seed < 6")), ["unit_number", "time_cycles", "seed"], ["run"], same=["v"])
        sizes = [r["n"] for r in once.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 10 * n and len(sizes) == n // 500 and max(sizes) < 10_000
