from pyspark.sql import functions as F

from tidebar.operators import resample


def test_replicates_equal_brute_force_and_rows_are_not_exploded(spark):
    rows = [("a" if i % 3 else None, f"k{i}", None if i % 11 == 5 else (i % 17) - 7.5) for i in range(700)]
    df = spark.createDataFrame(rows, "side string, id string, v double")
    means = resample.replicate_means(df, ["side"], "v", "id", 9)
    # draws belong to tasks; a row must not become a row for each block of replicates
    assert "Generate explode" not in means._jdf.queryExecution().toString() and "md5" not in means._jdf.queryExecution().toString()
    got = {(r["side"], r["replicate"]): r["mean"] for r in means.collect()}
    assert len(got) == 18
    known = df.where("v is not null")
    for b in range(9):
        w = resample.poisson_weight(resample.uniform(F.col("id"), F.lit(b // 4), b % 4))
        for r in known.groupBy("side").agg((F.sum(w * F.col("v")) / F.sum(w)).alias("m")).collect():
            assert abs(got[(r["side"], b)] - r["m"]) < 1e-12
    flips = resample.sign_flip_test(df.where("side = 'a'"), ["side"], "v", "id", 40).collect()[0]
    h = [F.conv(F.substring(F.md5(F.concat_ws(":", "id", F.lit("flip"), F.lit(k // 32))), k % 32 + 1, 1), 16, 10).cast("int") < 8 for k in range(40)]
    own = known.where("side = 'a'").agg(F.sum("v").alias("obs"), *[F.sum(F.when(x, F.col("v")).otherwise(-F.col("v"))).alias(f"s{k}") for k, x in enumerate(h)]).collect()[0]
    assert abs(flips["p_value"] - (sum(abs(own[f"s{k}"]) >= abs(own["obs"]) - 1e-12 for k in range(40)) + 1) / 41) < 1e-12
