from pyspark.sql import functions as F

from orrery.operators import gates


def test_overrides_replace_common_limits(spark):
    d = spark.createDataFrame([(1, "a", 0.6, 10.0), (2, "a", 0.4, 10.0), (3, "b", 0.4, 10.0), (4, "b", 0.2, 10.0), (5, "a", None, 10.0), (6, None, 0.9, 99.0)], "i int, label string, score double, area double")
    ok = gates.by_class("label", {"score": (0.5, None), "area": (None, 50)}, {"b": {"score": (0.3, None)}})
    assert {r.i for r in d.where(ok).collect()} == {1, 3}


def test_a_gate_learns_a_line_and_falls_back(spark):
    d = spark.range(400).selectExpr("id", "cast(id % 20 as double) as u", "cast(id % 7 as double) as v", "'a' as label").withColumn("y", ((F.col("u") - F.col("v") + (F.col("id") * 7 % 3) - 1) > 6).cast("int"))
    g = gates.train(d, ["u", "v"], "y")
    assert g.weights[0] > 0 > g.weights[1]
    right = d.withColumn("said", (g.z() >= g.least).cast("int")).where("said = y").count()
    assert right >= 380
    missing = spark.createDataFrame([(1, "a", None, 1.0, 0.9), (2, "a", None, 1.0, 0.1), (3, "a", 19.0, 0.0, 0.0), (4, "c", 0.0, 0.0, 0.9)], "i int, label string, u double, v double, score double")
    assert {r.i for r in gates.gated(missing, "label", {"a": g}, {"score": (0.5, None)}).collect()} == {1, 3, 4}
