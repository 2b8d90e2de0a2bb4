"""Entry-prototype similarity, positive-unlabeled ranking and review queues."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import digest_id, finite, ratio
from ..session import cut, written
from .quantiles import exact_quantiles
from .study import rank_bins, unpivot


def prototype(features: DataFrame, annotations: DataFrame, names: Sequence[str], key: str = "observation_id") -> DataFrame:
    """Centre and scale of the rows that an annotation calls ENTRY."""
    return prototype_of(features.join(annotations.where(F.upper("human_decision") == "ENTRY").select(key), key), names)


def prototype_of(entries: DataFrame, names: Sequence[str]) -> DataFrame:
    """Centre (median) and scale (IQR, else population std, else 1) of the ENTRY rows; a single row of two arrays."""
    long = unpivot(entries, [], names)
    q = exact_quantiles(long, ["feature"], "value", [0.25, 0.5, 0.75], ["_a", "_m", "_b"])
    s = long.groupBy("feature").agg(F.stddev_pop("value").alias("_s"), F.count("value").alias("_n"))
    scale = F.when(F.col("_b") - F.col("_a") > 0, F.col("_b") - F.col("_a")).when((F.col("_n") > 1) & (F.col("_s") > 0), F.col("_s")).otherwise(1.0)
    rows = s.join(q, "feature", "left").select("feature", F.coalesce("_m", F.lit(0.0)).alias("center"), scale.alias("scale"))
    return rows.agg(
        F.array(*[F.coalesce(F.max(F.when(F.col("feature") == n, F.col("center"))), F.lit(0.0)) for n in names]).alias("center"),
        F.array(*[F.coalesce(F.max(F.when(F.col("feature") == n, F.col("scale"))), F.lit(1.0)) for n in names]).alias("scale"),
    )


def similarity(features: DataFrame, proto: DataFrame, names: Sequence[str], top: int = 3) -> DataFrame:
    """1 / (1 + RMS scaled distance) of every row; a missing value stands at the centre and is counted."""
    df = features.crossJoin(F.broadcast(proto))
    dist = [
        F.abs(F.coalesce(finite(n), F.get("center", F.lit(i))) - F.get("center", F.lit(i))) / F.get("scale", F.lit(i)) for i, n in enumerate(names)
    ]
    rms = F.sqrt(sum((d * d for d in dist), F.lit(0.0)) / len(names))
    ranked = F.sort_array(F.array(*[F.struct(d.alias("d"), F.lit(n).alias("n")) for d, n in zip(dist, names, strict=True)]))
    return df.withColumns(
        {
            "human_entry_similarity": 1.0 / (1.0 + rms),
            "explanation_features": F.array_join(F.slice(ranked, 1, top)["n"], ","),
            "missing_feature_count": sum((F.when(finite(n).isNull(), 1).otherwise(0) for n in names), F.lit(0)),
        }
    ).drop("center", "scale")


def roles(features: DataFrame, annotations: DataFrame, key: str = "observation_id") -> DataFrame:
    """ENTRY is positive, no decision is unlabeled, REJECT and UNCERTAIN are held out."""
    d = F.coalesce(F.upper("human_decision"), F.lit("UNLABELED"))
    role = (
        F.when(d == "ENTRY", "positive").when(d == "REJECT", "holdout_reject").when(d == "UNCERTAIN", "holdout_uncertain").otherwise("unlabeled")
    )
    return features.join(annotations.select(key, "human_decision"), key, "left").withColumns(
        {"human_decision": d, "pu_role": role, "pu_label": F.when(role == "positive", 1.0)}
    )


def positive_prior(pu: DataFrame) -> DataFrame:
    p, u = F.count_if(F.col("pu_role") == "positive"), F.count_if(F.col("pu_role") == "unlabeled")
    return pu.agg(
        p.alias("positive_count"), u.alias("unlabeled_count"), F.count_if(F.col("pu_role") == "holdout_reject").alias("holdout_reject_count"),
        F.coalesce(ratio(p, p + u), F.lit(0.0)).alias("positive_prior"),
    )


def ranking_quality(scores: DataFrame, annotations: DataFrame, k: int, key: str = "observation_id", score: str = "human_entry_similarity") -> DataFrame:
    """Precision at k and recall among decided rows; only k rows are ordered."""
    judged = scores.join(annotations.where(F.upper("human_decision").isin("ENTRY", "REJECT")).select(key, F.upper("human_decision").alias("_d")), key).where(F.col(score).isNotNull())
    top = judged.orderBy(F.desc(score), key).limit(k).agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("_d") == "ENTRY").alias("_hit"), F.count_if(F.col("_d") == "REJECT").alias("_miss"))
    whole = judged.agg(F.count(F.lit(1)).alias("evaluated_count"), F.count_if(F.col("_d") == "ENTRY").alias("manual_entry_count"))
    return whole.crossJoin(F.broadcast(top)).select(
        "evaluated_count", "manual_entry_count", "k", ratio("_hit", "k").alias("precision_at_k"), ratio("_hit", "manual_entry_count").alias("recall_on_manual_entries"),
        ratio("_miss", "k").alias("reject_rate_in_top_k"),
    )


def unannotated(scores: DataFrame, annotations: DataFrame, key: str = "observation_id") -> DataFrame:
    """Candidates without a decision: no annotation, or one that says UNLABELED."""
    decided = annotations.where(F.upper("human_decision") != "UNLABELED").select(key)
    return scores.join(decided, key, "left_anti")


def review(df: DataFrame, mode: str, reason: str, version: str = "queue_v1", key: str = "observation_id") -> DataFrame:
    return df.select(
        digest_id("entry_review_", key, F.lit(mode), F.lit(version), length=20).alias("review_id"), "*",
        F.lit(reason).alias("review_reason"), F.lit(mode).alias("review_mode"), F.lit(version).alias("review_queue_version"),
    )


def high_similarity(scores: DataFrame, annotations: DataFrame, k: int, key: str = "observation_id") -> DataFrame:
    top = unannotated(scores, annotations, key).orderBy(F.desc_nulls_last("human_entry_similarity"), key).limit(k)
    return review(top, "high_similarity", "high_similarity_to_entry_prototype", key=key)


def uncertain(scores: DataFrame, low: float, high: float, k: int, key: str = "observation_id") -> DataFrame:
    if low > high:
        raise ValueError("low must not exceed high")
    s = F.col("human_entry_similarity")
    top = scores.where(s.between(low, high)).orderBy(F.abs(s - (low + high) / 2.0), key).limit(k)
    return review(top, "uncertain", "uncertain_similarity_band", key=key)


def diverse(scores: DataFrame, names: Sequence[str], k: int, tie: str, key: str = "observation_id") -> DataFrame:
    """Best of each median-split bucket of up to three features, then the rows farthest from those picked.

    At most eight rows are picked from buckets, so the distance to them is computed
    against one short array.
    """
    scores = written(scores, "scores")
    values = {f"_x{i}": finite(n) for i, n in enumerate(names[:3])}
    ends = None
    for x, value in values.items():
        # a half ends at one row, and every row's half follows from that row's value and tie
        half = rank_bins(scores.select(tie, value.alias("_x")), [], "_x", tie, 2)
        end = half.where("bin_id = 0").agg(F.max(F.struct("_x", tie)).alias(f"{x}_end"))
        ends = end if ends is None else ends.crossJoin(end)
    ends = cut(ends)
    halves = {x: F.when(value.isNotNull(), F.when(F.struct(value.alias("_x"), F.col(tie)) <= F.col(f"{x}_end"), "0").otherwise("1")) for x, value in values.items()}
    parts = [F.concat(F.lit(f"{n}:"), F.coalesce(h, F.lit("<NA>"))) for n, h in zip(names[:3], halves.values(), strict=True)]
    df = scores.crossJoin(F.broadcast(ends)).withColumn("diversity_bucket", F.concat_ws("|", *parts)).select(*scores.columns, "diversity_bucket")
    s = F.desc_nulls_last("human_entry_similarity")
    best = df.withColumn("_r", F.row_number().over(Window.partitionBy("diversity_bucket").orderBy(s, key))).where("_r = 1").drop("_r")
    picked = cut(best.orderBy(s, key).limit(k))
    q = exact_quantiles(unpivot(scores, [], names), ["feature"], "value", [0.25, 0.5, 0.75], ["_a", "_m", "_b"])
    dev = unpivot(scores, [], names).groupBy("feature").agg(F.stddev_pop("value").alias("_s"))
    iqr = F.col("_b") - F.col("_a")
    fit = q.join(dev, "feature").select("feature", F.col("_m").alias("m"), F.when(iqr > 0, iqr).when(F.col("_s") > 0, F.col("_s")).otherwise(1.0).alias("s"))
    one = fit.agg(
        *[F.max(F.when(F.col("feature") == n, F.col("m"))).alias(f"_m{i}") for i, n in enumerate(names)],
        *[F.max(F.when(F.col("feature") == n, F.col("s"))).alias(f"_s{i}") for i, n in enumerate(names)],
    )

    one = cut(one)

    def vector(d: DataFrame) -> DataFrame:
        v = F.array(*[(F.coalesce(finite(n), F.col(f"_m{i}")) - F.col(f"_m{i}")) / F.col(f"_s{i}") for i, n in enumerate(names)])
        return d.crossJoin(F.broadcast(one)).withColumn("_v", v)

    marks = vector(picked).agg(F.collect_list("_v").alias("_picks"), F.count(F.lit(1)).alias("_got"))
    rest = vector(df.join(picked.select(key), key, "left_anti")).crossJoin(F.broadcast(marks))
    gap = F.array_min(
        F.transform("_picks", lambda p: F.sqrt(F.aggregate(F.zip_with("_v", p, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda x, y: x + y)))
    )
    more = rest.withColumn("_gap", gap).orderBy(F.desc("_gap"), s, key).limit(k)
    cols = [*scores.columns, "diversity_bucket"]
    both = picked.select(*cols, F.lit(0).alias("_o"), F.lit(None).cast("double").alias("_gap")).unionByName(more.select(*cols, F.lit(1).alias("_o"), "_gap"))
    out = both.orderBy("_o", F.desc("_gap"), s, key).limit(k).select(*cols)
    return review(out, "diverse", "diverse_feature_coverage", key=key)


def fallback_queue(candidates: DataFrame, annotations: DataFrame, k: int, key: str = "observation_id") -> DataFrame:
    """Unscored candidates by source priority, then time."""
    rank = F.when(F.col("candidate_source") == "rule_seeded", 0).when(F.col("candidate_source") == "manual_context", 1).when(F.col("candidate_source") == "model_ranked", 2).otherwise(99)
    top = candidates.join(annotations.select(key), key, "left_anti").orderBy(rank, F.asc_nulls_last("decision_bar_index"), key).limit(k)
    return review(top, "fallback", "rule_seeded_unscored_candidate", key=key)


def labeled_and_unlabeled(features: DataFrame, annotations: DataFrame, key: str = "observation_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Decided rows, undecided rows, and keys with more than one active annotation."""
    active = annotations.where(F.coalesce("is_active", F.lit(True))) if "is_active" in annotations.columns else annotations
    doubles = active.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    decided = active.where(F.upper("human_decision").isin("ENTRY", "REJECT", "UNCERTAIN"))
    return features.join(decided.select(key, "human_decision"), key), features.join(decided.select(key), key, "left_anti"), doubles


def tune_threshold(
    scores: DataFrame, k: int, probs: Sequence[float] = (0.5, 0.6, 0.7, 0.8, 0.9), key: str = "observation_id"
) -> DataFrame:
    """Threshold on decided validation rows by precision at k, recall, reject rate and height, in that order.

    The candidates are a handful of score quantiles, held in one row.
    """
    s, d = F.col("human_entry_similarity"), F.upper("human_decision")
    judged = scores.where(d.isin("ENTRY", "REJECT"))
    names = [f"_t{i}" for i in range(len(probs))]
    cuts = exact_quantiles(judged, [], "human_entry_similarity", probs, names).select(F.array_distinct(F.array(*names)).alias("_cuts"))
    rows = judged.crossJoin(F.broadcast(cuts)).withColumn("threshold", F.explode("_cuts"))
    table = rows.groupBy("threshold").agg(
        ratio(F.count_if((d == "ENTRY") & (s >= F.col("threshold"))), F.count_if(d == "ENTRY")).alias("recall_on_entry"),
        ratio(F.count_if((d == "REJECT") & (s >= F.col("threshold"))), F.count_if(d == "REJECT")).alias("reject_rate_above_threshold"),
    )
    top = judged.orderBy(F.desc("human_entry_similarity"), key).limit(k).agg(F.avg(F.when(d == "ENTRY", 1.0).otherwise(0.0)).alias("precision_at_k"))
    full = table.crossJoin(F.broadcast(top))
    order = F.struct(
        F.coalesce("precision_at_k", F.lit(-1.0)), F.coalesce("recall_on_entry", F.lit(-1.0)), -F.coalesce("reject_rate_above_threshold", F.lit(0.0)), "threshold"
    )
    return full.agg(F.max_by(F.struct("threshold", "precision_at_k", "recall_on_entry", "reject_rate_above_threshold"), order).alias("_b")).select("_b.*")


def calibration(scores: DataFrame, tie: str, bins: int = 10) -> DataFrame:
    """ENTRY share per score decile."""
    d = F.upper("human_decision")
    judged = scores.where(d.isin("ENTRY", "REJECT")).select(tie, "human_entry_similarity", d.alias("_d"))
    return rank_bins(judged, [], "human_entry_similarity", tie, bins).groupBy((F.col("bin_id") + 1).alias("decile")).agg(
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("_d") == "ENTRY").alias("entry_count"), F.avg(F.when(F.col("_d") == "ENTRY", 1.0).otherwise(0.0)).alias("entry_rate"),
        F.min("human_entry_similarity").alias("score_min"), F.max("human_entry_similarity").alias("score_max"),
    )


def manual_review(scores: DataFrame, k: int, key: str = "observation_id") -> DataFrame:
    """Three short lists: rejected yet similar, entered yet dissimilar, and closest to one half."""
    s, d = F.col("human_entry_similarity"), F.upper("human_decision")

    def take(df: DataFrame, name: str, *order: Column) -> DataFrame:
        return df.orderBy(*order, F.col(key)).limit(k).select(F.lit(name).alias("list"), key, "human_entry_similarity", "human_decision")

    # the lists read the scores three times, so only what they order is kept
    scores = written(scores.select(key, "human_entry_similarity", "human_decision"), "reviewed")
    a = take(scores.where(d == "REJECT"), "high_similarity_reject", s.desc())
    b = take(scores.where(d == "ENTRY"), "low_similarity_entry", s.asc())
    c = take(scores, "most_uncertain", F.abs(s - 0.5).asc())
    return a.unionByName(b).unionByName(c)
