"""Event studies, distributions, drift and binning over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.moments import excess_kurtosis, skew
from ..functions.scalar import finite, flag, null, ratio
from .quantiles import exact_quantiles, with_first_rank
from .resample import bootstrap_mean

UNTAGGED = "UNTAGGED"


def parse_tags(col: str) -> Column:
    """Tag list of a text column: a JSON list, else the text itself, else UNTAGGED."""
    text = F.col(col)
    listed = F.from_json(text, "array<string>")
    return (
        F.when(text.isNull() | (F.trim(text) == ""), F.array(F.lit(UNTAGGED)))
        .when(F.size(listed) > 0, listed)
        .when(F.size(listed) == 0, F.array(F.lit(UNTAGGED)))
        .otherwise(F.array(text))
    )


def explode_tags(df: DataFrame, col: str = "label_tags_json") -> DataFrame:
    return df.withColumn("label_tag", F.explode(parse_tags(col)))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(v).alias(name), finite(v).alias(value)) for v in values])
    return df.select(*ids, F.explode(pairs).alias("_p")).select(*ids, f"_p.{name}", f"_p.{value}")


def _on(left: DataFrame, right: DataFrame, groups: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-group results; a NULL group value matches itself."""
    groups = list(groups)
    renamed = right.withColumnsRenamed({g: f"_g_{g}" for g in groups})
    cond = [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups]
    return left.join(renamed, cond, how).drop(*[f"_g_{g}" for g in groups])


def return_stats(long: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Count, mean, std, win rate, quantiles and gain-to-loss ratio per group."""
    v = F.col(value)
    filled = long.withColumns({g: F.coalesce(F.col(g).cast("string"), F.lit("\u0000")) for g in groups})
    base = filled.groupBy(*groups).agg(
        F.count(v).alias("sample_count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        (F.avg(F.when(v.isNotNull(), flag(v > 0))) * 100.0).alias("win_rate"),
        ratio(F.avg(F.when(v > 0, v)), F.abs(F.avg(F.when(v < 0, v)))).alias("profit_loss_ratio"),
    )
    q = exact_quantiles(filled, groups, value, [0.05, 0.25, 0.5, 0.75, 0.95], ["q05", "q25", "median", "q75", "q95"])
    out = base.join(q, list(groups), "left").withColumn("small_sample_warning", sample_note(F.col("sample_count")))
    return out.withColumns({g: F.nullif(F.col(g), F.lit("\u0000")) for g in groups})


def sample_note(n: Column) -> Column:
    return F.when(n < 30, "severe").when(n < 100, "exploratory").otherwise("")


def event_study_by_tag(events: DataFrame, outcomes: Sequence[str]) -> DataFrame:
    """Outcome statistics by tag, event type and side, one row per outcome column."""
    groups = ["label_tag", "event_type", "side", "outcome"]
    long = unpivot(explode_tags(events), groups[:3], outcomes, "outcome", "value")
    return return_stats(long, groups)


# The grouping sets of the event study.
GROUPINGS = (
    ("label_tag",),
    ("event_type",),
    ("side",),
    ("symbol",),
    ("interval",),
    ("volatility_regime",),
    ("trend_regime",),
    ("time_session",),
    ("label_tag", "side"),
    ("label_tag", "side", "volatility_regime"),
)


def event_study(samples: DataFrame, label: str, draws: int = 200, key: str = "event_id") -> DataFrame:
    """Outcome statistics over ten grouping sets at once, with bootstrap intervals.

    Every sample is expanded to its ten group keys and aggregated once, so all sets
    share one pass; partial aggregation keeps a dominant group spread.
    """
    tagged = explode_tags(samples)
    keys = F.array(
        *[
            F.struct(
                F.lit(" + ".join(g)).alias("group_by"),
                F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("NULL")) for c in g]).alias("group_key"),
            )
            for g in GROUPINGS
        ]
    )
    long = tagged.select(F.explode(keys).alias("_k"), F.concat_ws("#", key, "label_tag").alias("_row"), finite(label).alias("value")).select(
        "_k.group_by", "_k.group_key", "_row", "value"
    )
    groups = ["group_by", "group_key"]
    ci = bootstrap_mean(long, groups, "value", "_row", draws)
    return return_stats(long, groups).join(ci.select(*groups, "ci_low", "ci_high"), groups, "left")


PROBS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
PROB_NAMES = ("q01", "q05", "q25", "q50", "q75", "q95", "q99")


def distribution(long: DataFrame, groups: Sequence[str], value: str = "value") -> DataFrame:
    """Moments, quantiles, tail share and warnings of each group."""
    groups = list(groups)
    v = F.col(value)
    base = long.groupBy(*groups).agg(
        F.count(v).alias("n"),
        F.count_if(v.isNull()).alias("missing_count"),
        F.avg(v).alias("mean"),
        F.when(F.count(v) == 1, 0.0).otherwise(F.stddev_samp(v)).alias("std"),
        skew(v).alias("skewness"),
        excess_kurtosis(v).alias("excess_kurtosis"),
    )
    q = exact_quantiles(long, groups, value, PROBS, PROB_NAMES)
    sized = long.where(v.isNotNull()).select(*groups, F.abs(v).alias("_a"))
    aq = exact_quantiles(sized, groups, "_a", [0.95, 0.99], ["_a95", "_a99"])
    tails = (
        sized.join(aq, groups)
        .groupBy(*groups)
        .agg(F.sum(F.when(F.col("_a") >= F.col("_a95"), F.col("_a"))).alias("_t"), F.sum("_a").alias("_all"), F.max("_a95").alias("_a95"), F.max("_a99").alias("_a99"))
        .select(
            *groups,
            F.when(F.col("_all").isNull(), null()).when(F.col("_all") > 0, F.col("_t") / F.col("_all")).otherwise(0.0).alias("top_5pct_abs_share"),
            F.when(F.col("_a95") > 0, F.col("_a99") / F.col("_a95")).alias("p99_to_p95_abs_ratio"),
        )
    )
    out = base.join(q, groups, "left").join(tails, groups, "left")
    heavy = (F.col("excess_kurtosis") > 1.0) | (F.col("top_5pct_abs_share") > 0.25)
    return out.withColumns(
        {
            "median": F.col("q50"),
            "iqr": F.col("q75") - F.col("q25"),
            "heavy_tail_warning": F.when(F.coalesce(heavy, F.lit(False)), 1).otherwise(0),
        }
    )


def entry_vs_reject(df: DataFrame, features: Sequence[str], decision: str = "human_decision") -> DataFrame:
    """Differences between ENTRY and REJECT distributions, one row per feature."""
    judged = df.where(F.upper(decision).isin("ENTRY", "REJECT")).withColumn("_d", F.lower(decision))
    stats = distribution(unpivot(judged, ["_d"], features), ["_d", "feature"])
    names = ["n", "mean", "median", "iqr", "skewness", "excess_kurtosis", "q05", "q95"]
    wide = stats.groupBy("feature").agg(
        *[F.max(F.when(F.col("_d") == d, F.col(n))).alias(f"{d}_{n}") for d in ("entry", "reject") for n in names]
    )
    return wide.withColumns({f"{n}_diff": F.col(f"entry_{n}") - F.col(f"reject_{n}") for n in names[1:]})


def drift(df: DataFrame, period: Column, features: Sequence[str]) -> DataFrame:
    """Per-period distribution against the first period of each feature."""
    stats = distribution(unpivot(df.withColumn("period", period), ["period"], features), ["period", "feature"])
    w = Window.partitionBy("feature").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    base, spread = F.first("median").over(w), F.first("iqr").over(w)
    move = F.col("median") - base
    return stats.withColumns(
        {
            "baseline_median": base,
            "median_diff_vs_first_period": move,
            "drift_warning": F.when(F.abs(move) > F.greatest(F.lit(0.5), 3.0 * F.coalesce(spread, F.lit(0.0))), 1).otherwise(0),
        }
    )


def rank_bins(long: DataFrame, groups: Sequence[str], value: str, tie: str, q: int) -> DataFrame:
    """Equal-count bins by first rank; rows keep their columns and gain ``bin_id``.

    Matches quantile cutting of ranks 1..n, with fewer bins when a group has fewer
    distinct values.
    """
    groups = list(groups)
    ranked = with_first_rank(long, groups, value, tie)
    kinds = ranked.groupBy(*groups, value).agg(F.lit(1).alias("_u")).groupBy(*groups).agg(F.count(F.lit(1)).alias("_kinds"))
    out = ranked.join(kinds, groups) if groups else ranked.crossJoin(F.broadcast(kinds))
    bins = F.greatest(F.lit(1), F.least(F.lit(q), F.col("_kinds")))
    at = F.ceil((F.col("rank_no") - 1) * bins / F.greatest(F.col("rank_total") - 1, F.lit(1))) - 1
    return out.withColumn("bin_id", F.when(bins <= 1, 0).otherwise(F.greatest(F.lit(0), at)).cast("long")).drop(
        "_kinds", "rank_no", "rank_total"
    )


def decision_bins(df: DataFrame, features: Sequence[str], tie: str, q: int = 4, decision: str = "human_decision") -> DataFrame:
    """ENTRY share per feature bin."""
    long = unpivot(df, [tie, decision], features).where(F.col("value").isNotNull())
    d = F.upper(decision)
    out = rank_bins(long, ["feature"], "value", tie, q).groupBy("feature", "bin_id").agg(
        F.min("value").alias("bin_left"),
        F.max("value").alias("bin_right"),
        F.count(F.lit(1)).alias("total_count"),
        F.count_if(d == "ENTRY").alias("entry_count"),
        F.count_if(d == "REJECT").alias("reject_count"),
    )
    return out.withColumn("entry_rate", ratio("entry_count", F.col("entry_count") + F.col("reject_count")))


def outcome_bins(df: DataFrame, features: Sequence[str], outcomes: Sequence[str], tie: str, q: int = 4, decision: str = "human_decision") -> DataFrame:
    """Outcome distribution per feature bin; for reading after the fact only."""
    ids = [tie, decision, *outcomes]
    long = unpivot(df, ids, features).where(F.col("value").isNotNull())
    binned = rank_bins(long, ["feature"], "value", tie, q)
    edges = binned.groupBy("feature", "bin_id").agg(
        F.min("value").alias("bin_left"), F.max("value").alias("bin_right"),
        F.count_if(F.upper(decision) == "ENTRY").alias("entry_count"), F.count_if(F.upper(decision) == "REJECT").alias("reject_count"),
    )
    by = unpivot(binned.withColumnRenamed("value", "_v"), ["feature", "bin_id"], outcomes, "outcome_col", "value")
    stats = distribution(by, ["feature", "bin_id", "outcome_col"])
    return stats.join(edges, ["feature", "bin_id"]).select(
        F.lit("posterior_only").alias("analysis_role"), "feature", "bin_id", "bin_left", "bin_right", "outcome_col", "n",
        "entry_count", "reject_count", "median", "iqr", "skewness", "excess_kurtosis",
    )


def interval_bins(long: DataFrame, groups: Sequence[str], value: str, bins: int, equal_width: bool = False) -> DataFrame:
    """Right-closed bins between exact quantile edges (or equal widths), repeated edges merged.

    Adds ``bin_id`` (1-based), ``bin_left`` and ``bin_right``.
    """
    groups = list(groups)
    names = [f"_e{k}" for k in range(bins + 1)]
    if equal_width:
        ends = long.groupBy(*groups).agg(F.min(value).alias("_a"), F.max(value).alias("_b"))
        edges = ends.select(
            *groups, *[(F.col("_a") + (F.col("_b") - F.col("_a")) * (k / bins)).alias(n) for k, n in enumerate(names)]
        )
    else:
        edges = exact_quantiles(long, groups, value, [k / bins for k in range(bins + 1)], names)
    edges = edges.select(*groups, F.array_distinct(F.array(*names)).alias("_edges"))
    out = long.where(F.col(value).isNotNull()).join(edges, groups)
    return _place(out.where(F.size("_edges") > 1), value)


def _place(df: DataFrame, value: str) -> DataFrame:
    inner = F.slice("_edges", F.lit(2), F.greatest(F.size("_edges") - 2, F.lit(0)))
    out = df.withColumn("bin_id", F.size(F.filter(inner, lambda e: e < F.col(value))) + 1)
    return out.withColumns(
        {"bin_left": F.element_at("_edges", F.col("bin_id")), "bin_right": F.element_at("_edges", F.col("bin_id") + 1)}
    ).drop("_edges")


def feature_bins(samples: DataFrame, features: Sequence[str], label: str, bins: int = 5, equal_width: bool = False) -> DataFrame:
    """Label statistics per feature bin."""
    long = unpivot(samples, [label], features)
    binned = interval_bins(long, ["feature"], "value", bins, equal_width)
    groups = ["feature", "bin_id"]
    v = F.col(label)
    base = binned.groupBy(*groups).agg(
        F.max("bin_left").alias("bin_left"), F.max("bin_right").alias("bin_right"), F.count(F.lit(1)).alias("sample_count"),
        F.avg(v).alias("label_mean"), (F.avg(flag(v > 0)) * 100.0).alias("win_rate_pct"),
    )
    q = exact_quantiles(binned, groups, label, [0.25, 0.5, 0.75], ["p25", "label_median", "p75"])
    return base.join(q, groups, "left").withColumn("low_sample_warning", F.when(F.col("sample_count") < 20, 1).otherwise(0))


def factor_bins(samples: DataFrame, factors: Sequence[str], label: str, key: str, bins: int = 5, draws: int = 200, digits: int | None = None) -> DataFrame:
    """Factor binning with bootstrap intervals, monotonicity and the missing rate.

    A factor with fewer distinct values than bins gets fewer bins. With ``digits`` the
    edges are rounded to as many, for factors that are.
    """
    long = unpivot(samples, [key, label], factors, "factor", "value")
    whole = long.groupBy("factor").agg(
        F.avg(flag(F.col("value").isNull())).alias("missing_rate"), F.count(F.lit(1)).alias("source_sample_count")
    )
    known = long.where(F.col("value").isNotNull() & F.col(label).isNotNull())
    shape = (
        known.groupBy("factor", "value").agg(F.count(F.lit(1)).alias("_c"))
        .groupBy("factor").agg(F.count(F.lit(1)).alias("_kinds"), F.sum("_c").alias("_rows"))
        .withColumn(
            "_bins",
            F.least(F.lit(max(2, bins)), F.col("_kinds"), F.greatest(F.lit(2), F.floor(F.col("_rows") / 5))),
        )
        .where((F.col("_rows") >= 2) & (F.col("_kinds") >= 2))
    )
    # one quantile pass serves every possible bin count
    cuts = sorted({k / b for b in range(2, max(2, bins) + 1) for k in range(b + 1)})
    edges = exact_quantiles(known, ["factor"], "value", cuts, [f"_p{i}" for i in range(len(cuts))]).join(shape, "factor")
    if digits is not None:
        edges = edges.withColumns({f"_p{i}": F.round(f"_p{i}", digits) for i in range(len(cuts))})
    pick = F.lit(None).cast("array<double>")
    for b in range(2, max(2, bins) + 1):
        pick = F.when(F.col("_bins") == b, F.array(*[F.col(f"_p{cuts.index(k / b)}") for k in range(b + 1)])).otherwise(pick)
    edges = edges.select("factor", F.array_distinct(pick).alias("_edges")).where(F.size("_edges") > 1)
    binned = _place(known.join(edges, "factor"), "value")
    groups = ["factor", "bin_id"]
    v = F.col(label)
    base = binned.groupBy(*groups).agg(
        F.max("bin_left").alias("bin_left"), F.max("bin_right").alias("bin_right"), F.count(v).alias("sample_count"),
        F.avg(v).alias("mean_label"), (F.avg(flag(v > 0)) * 100.0).alias("win_rate"),
    )
    q = exact_quantiles(binned, groups, label, [0.25, 0.5, 0.75], ["q25", "median_label", "q75"])
    ci = bootstrap_mean(binned, groups, label, key, draws).select(*groups, "ci_low", "ci_high")
    w = Window.partitionBy("factor").orderBy("bin_id")
    order = base.withColumn("_no", F.row_number().over(w)).withColumn(
        "_rk",
        F.rank().over(Window.partitionBy("factor").orderBy("mean_label"))
        + (F.count(F.lit(1)).over(Window.partitionBy("factor", "mean_label")) - 1) / 2.0,
    )
    trend = order.groupBy("factor").agg(F.when(F.count(F.lit(1)) >= 2, F.corr("_no", "_rk")).alias("monotonicity_score"))
    return base.join(q, groups, "left").join(ci, groups, "left").join(trend, "factor", "left").join(whole, "factor")
