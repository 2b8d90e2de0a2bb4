"""Time-ordered splits, purging, embargo and their integrity checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import ratio
from .chunks import CHUNK, KEYS, dense_index
from .overlap import greedy_non_overlapping, overlap_flag

ORDER = ("bar_index", "observation_id")


def ordered(df: DataFrame, keys: Sequence[str] = KEYS, width: int = CHUNK, order: str = "bar_index", tie: str = "observation_id") -> DataFrame:
    """Position and total count of every sample in time order within its series."""
    return dense_index(df, keys, order, width, name="_pos", ties=(tie,), total="_n")


def ratio_cuts(train: float, validation: float, test: float) -> None:
    if abs(train + validation + test - 1.0) > 1e-9 or min(train, validation, test) <= 0:
        raise ValueError("ratios must be positive and sum to 1")


def chronological(df: DataFrame, train: float, validation: float, test: float, keys: Sequence[str] = KEYS, width: int = CHUNK) -> DataFrame:
    """Label every sample train, validation or test by its share of the ordered series.

    A series too short to fill all three parts is labelled ``too_small``.
    """
    ratio_cuts(train, validation, test)
    pos = ordered(df, keys, width)
    n, p = F.col("_n"), F.col("_pos")
    first = F.floor(n * train)
    held = F.floor(n * validation)
    short = (n < 3) | (first <= 0) | (held <= 0) | (n - first - held <= 0)
    return pos.withColumn(
        "split",
        F.when(short, "too_small").when(p < first, "train").when(p < first + held, "validation").otherwise("test"),
    ).drop("_pos", "_n")


def purged_embargo(
    df: DataFrame, train_ratio: float, purge: int, embargo: int, keys: Sequence[str] = KEYS, width: int = CHUNK,
    order: str = "bar_index", tie: str = "observation_id",
) -> DataFrame:
    """Train and test by sample count, with purged rows before and embargoed rows after the cut."""
    pos = ordered(df, keys, width, order, tie)
    n, p = F.col("_n"), F.col("_pos")
    cut = F.least(n, F.greatest(F.lit(0), F.floor(n * train_ratio)))
    return pos.withColumn(
        "split",
        F.when(p < F.greatest(cut - max(0, purge), F.lit(0)), "train")
        .when(p < cut, "purged")
        .when(p < F.least(n, cut + max(0, embargo)), "embargoed")
        .otherwise("test"),
    ).drop("_pos", "_n")


def expanding_folds(
    df: DataFrame, n_splits: int = 3, train_ratio: float = 0.5, purge: int = 0, embargo: int = 0,
    keys: Sequence[str] = KEYS, width: int = CHUNK, order: str = "bar_index", tie: str = "observation_id",
) -> DataFrame:
    """Walk-forward folds with a growing train part; one row per sample, fold and role."""
    pos = ordered(df, keys, width, order, tie)
    n, p = F.col("_n"), F.col("_pos")
    first = F.greatest(F.lit(1), F.floor(n * train_ratio))
    size = F.greatest(F.lit(1), F.floor((n - first) / max(1, n_splits)))
    roles = []
    for k in range(max(1, n_splits)):
        end = first + k * size
        stop = n if k == n_splits - 1 else F.least(n, end + size)
        test_from = F.least(stop, end + max(0, embargo))
        usable = (n >= 2) & (end < n) & (stop > end) & (end - max(0, purge) > 0) & (test_from < stop)
        role = F.when(p < end - max(0, purge), "train").when((p >= test_from) & (p < stop), "test")
        roles.append(F.struct(F.lit(f"period_{k + 1}").alias("period"), F.when(usable, role).alias("split")))
    out = pos.withColumn("_f", F.explode(F.filter(F.array(*roles), lambda r: r["split"].isNotNull())))
    return out.select("*", "_f.period", "_f.split").drop("_pos", "_n", "_f")


def rolling_folds(
    df: DataFrame, train: int, validation: int, test: int, step: int, keys: Sequence[str] = KEYS, width: int = CHUNK
) -> DataFrame:
    """Fixed-size rolling folds; a sample is copied into each fold whose window holds it."""
    if min(train, validation, test, step) <= 0:
        raise ValueError("windows and step must be positive")
    pos = ordered(df, keys, width)
    span = train + validation + test
    last = F.floor((F.col("_n") - span) / step)
    lo = F.greatest(F.lit(0), F.ceil((F.col("_pos") - span + 1) / step))
    hi = F.least(last, F.floor(F.col("_pos") / step))
    fold = F.explode(F.when((F.col("_n") >= span) & (lo <= hi), F.sequence(lo, hi)))
    out = pos.withColumn("fold", fold)
    at = F.col("_pos") - F.col("fold") * step
    return out.withColumn(
        "split", F.when(at < train, "train").when(at < train + validation, "validation").otherwise("test")
    ).drop("_pos", "_n")


def purge_overlaps(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mark train rows whose label window meets a validation or test window as purged."""
    train, rest = df.where("split = 'train'"), df.where("split <> 'train'")
    judged = overlap_flag(
        train, rest.where("split in ('validation', 'test')"), keys, "label_start_bar", "label_end_bar", "_hit"
    )
    kept = judged.withColumn("split", F.when(F.col("_hit"), "purged").otherwise("train")).drop("_hit")
    return kept.unionByName(rest)


def embargo_train(df: DataFrame, keys: Sequence[str], bars: int) -> DataFrame:
    """Mark train rows within ``bars`` of the evaluation range as embargoed."""
    if bars <= 0:
        return df
    held = df.where("split in ('validation', 'test')").groupBy(*keys).agg(
        F.min("bar_index").alias("_lo"), F.max("bar_index").alias("_hi")
    )
    near = (F.col("split") == "train") & F.col("bar_index").between(F.col("_lo") - bars, F.col("_hi") + bars)
    return df.join(held, list(keys), "left").withColumn(
        "split", F.when(F.coalesce(near, F.lit(False)), "embargoed").otherwise(F.col("split"))
    ).drop("_lo", "_hi")


def embargo_boundaries(df: DataFrame, keys: Sequence[str], bars: int) -> DataFrame:
    """Drop the first validation and test rows that follow too closely on the part before."""
    ends = df.groupBy(*keys).agg(
        F.max(F.when(F.col("split") == "train", F.col("bar_index"))).alias("_t"),
        F.max(F.when(F.col("split") == "validation", F.col("bar_index"))).alias("_v"),
    )
    prev = F.when(F.col("split") == "validation", F.col("_t")).when(F.col("split") == "test", F.col("_v"))
    close = F.coalesce(F.col("bar_index") <= prev + bars, F.lit(False))
    return df.join(ends, list(keys), "left").withColumn(
        "split", F.when(close, "embargoed").otherwise(F.col("split"))
    ).drop("_t", "_v")


def purge_episodes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mark train rows that share an episode with an evaluation row; decided per episode, without pairs."""
    on = [*keys, "episode_id"]
    shared = df.where("split in ('validation', 'test')").select(*on).distinct().withColumn("_shared", F.lit(True))
    hit = (F.col("split") == "train") & F.coalesce("_shared", F.lit(False))
    return df.join(shared, on, "left").withColumn(
        "split", F.when(hit, "purged_episode").otherwise(F.col("split"))
    ).drop("_shared")


def purged_chronological(
    df: DataFrame, train: float, validation: float, test: float, embargo: int = 0, episodes: bool = False,
    keys: Sequence[str] = KEYS, width: int = CHUNK,
) -> DataFrame:
    """Chronological split with label-window purge, embargo and, when asked, whole episodes on one side."""
    out = purge_overlaps(chronological(df, train, validation, test, keys, width), keys)
    out = embargo_train(out, keys, embargo)
    return purge_episodes(out, keys) if episodes else out


def purged_walk_forward(
    df: DataFrame, train: int, validation: int, test: int, step: int, embargo: int = 0, episodes: bool = False,
    keys: Sequence[str] = KEYS, width: int = CHUNK,
) -> DataFrame:
    """Rolling folds, each purged and embargoed on its own."""
    on = [*keys, "fold"]
    out = purge_overlaps(rolling_folds(df, train, validation, test, step, keys, width), on)
    out = embargo_train(out, on, embargo)
    return purge_episodes(out, on) if episodes else out


def non_overlapping(df: DataFrame, keys: Sequence[str] = KEYS, size: int = CHUNK) -> DataFrame:
    """Greedy thinning so that kept label windows never touch."""
    return greedy_non_overlapping(df, keys, "label_start_bar", "label_end_bar", "observation_id", size)


def integrity(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts, order, duplicates, episode leaks and window overlaps of a split, with PASS or FAIL."""
    keys = list(keys)
    used = df.where("split in ('train', 'validation', 'test')")

    def of(part: str, col: str, how) -> Column:
        return how(F.when(F.col("split") == part, F.col(col)))

    base = df.groupBy(*keys).agg(
        *[F.count_if(F.col("split") == s).alias(f"{s}_count") for s in ("train", "validation", "test")],
        F.count_if(F.col("split").isin("purged", "purged_episode")).alias("purged_count"),
        F.count_if(F.col("split") == "embargoed").alias("embargoed_count"),
        *[of(s, "bar_index", F.min).alias(f"_{s}_lo") for s in ("validation", "test")],
        *[of(s, "bar_index", F.max).alias(f"_{s}_hi") for s in ("train", "validation")],
    )
    doubles = (
        used.groupBy(*keys, "observation_id").agg(F.count_distinct("split").alias("_k"))
        .groupBy(*keys).agg(F.count_if(F.col("_k") > 1).alias("duplicate_observation_count"))
    )
    overlap = overlap_flag(
        used.where("split = 'train'"), used.where("split <> 'train'"), keys, "label_start_bar", "label_end_bar", "_hit"
    ).groupBy(*keys).agg(F.count_if("_hit").alias("label_window_overlap_count"))
    out = base.join(doubles, keys, "left").join(overlap, keys, "left")
    if "episode_id" in df.columns:
        leaks = (
            used.groupBy(*keys, "episode_id")
            .agg(F.max(F.when(F.col("split") == "train", 1)).alias("_a"), F.max(F.when(F.col("split") != "train", 1)).alias("_b"))
            .groupBy(*keys).agg(F.count_if((F.col("_a") == 1) & (F.col("_b") == 1)).alias("episode_leakage_count"))
        )
        out = out.join(leaks, keys, "left")
    else:
        out = out.withColumn("episode_leakage_count", F.lit(0))
    out = out.fillna(0, ["duplicate_observation_count", "label_window_overlap_count", "episode_leakage_count"])
    disorder = F.coalesce(F.col("_train_hi") > F.col("_validation_lo"), F.lit(False)) | F.coalesce(
        F.col("_validation_hi") > F.col("_test_lo"), F.lit(False)
    )
    empty = (F.col("train_count") == 0) | (F.col("validation_count") == 0) | (F.col("test_count") == 0)
    notes = [
        (disorder, "time_order_violation"),
        (empty, "empty_split"),
        (F.col("duplicate_observation_count") > 0, "duplicate_observation_id_across_splits"),
        (F.col("episode_leakage_count") > 0, "episode_leakage"),
        (F.col("label_window_overlap_count") > 0, "label_window_overlap"),
    ]
    out = out.withColumn("warnings", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in notes])), ","))
    return out.withColumn("status", F.when(F.col("warnings") == "", "PASS").otherwise("FAIL")).drop(
        "_validation_lo", "_test_lo", "_train_hi", "_validation_hi"
    )


def sample_gate(n: Column, minimum: int) -> Column:
    return F.when(n.isNull(), "unavailable").when(n < minimum, "rejected_low_sample").otherwise("passed")


def degradation(inside: Column, outside: Column) -> Column:
    """Share of the in-sample metric lost outside."""
    return ratio(inside - outside, F.abs(inside))


def rule_verdict(
    n_train: Column, n_test: Column, inside: Column, outside: Column, q: Column | None, alpha: float, minimum: int, limit: float
) -> Column:
    """Sample gate, availability, false-discovery gate and degradation gate, in that order."""
    lost = degradation(inside, outside)
    out = (
        F.when(n_train.isNull() | n_test.isNull(), "unavailable")
        .when((n_train < minimum) | (n_test < minimum), "rejected_low_sample")
        .when(lost.isNull(), "unavailable")
    )
    if q is not None:
        out = out.when(q.isNull(), "unavailable").when(q > alpha, "rejected_fdr")
    return out.when(lost > limit, "rejected_oos_degradation").otherwise(
        "validated_candidate" if q is not None else "exploratory_candidate"
    )
