"""Plan-time column guards: outcome names never reach a feature table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

# What each contract calls an outcome: beginnings, whole names, parts of a name.
CONTRACTS = {
    "dataset": {"starts": ("fwd_", "post_"), "names": ("mfe_10", "mae_10", "manual_trade_final_return_pct", "manual_trade_holding_bars"), "parts": ()},
    "factor": {"starts": ("fwd_", "mfe", "mae", "post_", "future", "manual_trade_final", "exit", "pnl", "label"), "names": (), "parts": ()},
    "context": {"starts": (), "names": (), "parts": ("fwd", "post", "future", "mfe", "mae", "hit_tp", "hit_sl", "pnl", "exit", "label")},
}
# Columns that only index rows.
INDEX_COLUMNS = ("event_id", "trade_id", "session_id", "symbol", "interval", "bar_index", "event_type", "side", "open_time_ms", "event_time_bjt", "created_at")


def forbidden(columns: Iterable[str], contract: str = "factor") -> list[str]:
    """The names that a contract doesn't allow as inputs; the dataset contract minds case, the others don't."""
    rule = CONTRACTS[contract]

    def bad(name: str) -> bool:
        name = name if contract == "dataset" else name.strip().lower()
        return name.startswith(rule["starts"]) or name in rule["names"] or any(p in name for p in rule["parts"])

    return [c for c in columns if bad(c) or (contract == "context" and not c.strip())]


def require_safe(columns: Iterable[str], contract: str = "factor") -> None:
    """Raise before any job when a name looks like an outcome."""
    bad = forbidden(columns, contract)
    if bad:
        raise ValueError(f"outcome columns are not allowed as inputs: {', '.join(bad)}")


def leakage_table(df: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per column of ``df`` with its finding; ``registry`` has feature_name and model_input_allowed."""
    bad = forbidden(df.columns)
    known = df.sparkSession.createDataFrame([(c, c in bad, c in INDEX_COLUMNS) for c in df.columns], "column string, outcome boolean, indexes boolean")
    allowed = registry.groupBy(F.col("feature_name").alias("column")).agg(F.min("model_input_allowed").alias("allowed"))
    finding = (
        F.when(F.col("outcome"), "forbidden").when(F.col("indexes"), "index").when(F.col("allowed").isNull(), "unregistered").when(~F.col("allowed"), "disallowed").otherwise("allowed")
    )
    return known.join(allowed, "column", "left").select("column", finding.alias("finding"))


def split_columns(df: DataFrame, key: str = "event_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Feature, label and index tables of one wide table, each with the key, by the dataset contract."""
    bad = set(forbidden(df.columns, "dataset"))
    index = [c for c in df.columns if c in INDEX_COLUMNS]
    feats = [c for c in df.columns if c not in bad and c not in index]
    return df.select(key, *feats), df.select(key, *[c for c in df.columns if c in bad]), df.select(*index)


def drop_outcomes(df: DataFrame, contract: str = "factor") -> DataFrame:
    return df.drop(*forbidden(df.columns, contract))


# Annotation vocabularies.
DECISIONS = ("ENTRY", "REJECT", "UNCERTAIN", "UNLABELED")
TIMINGS = ("CURRENT_BAR_CLOSE", "NEXT_BAR_CONFIRMATION")


def validate_annotations(df: DataFrame, reason_tags: Sequence[str]) -> DataFrame:
    """Every annotation with the list of rules it breaks; an empty list is a valid row."""
    d = F.upper(F.trim("human_decision"))
    conf = F.expr("try_cast(confidence as int)")
    current = F.col("decision_timing") == "CURRENT_BAR_CLOSE"
    unknown = F.size(F.filter(F.coalesce("reason_tags", F.array().cast("array<string>")), lambda t: ~t.isin(*reason_tags))) > 0
    checks = [
        (~F.coalesce(d.isin(*DECISIONS), F.lit(False)), "decision"),
        (~F.coalesce(F.col("decision_timing").isin(*TIMINGS), F.lit(False)), "timing"),
        (current & (F.col("setup_bar_index") != F.col("decision_bar_index")), "setup_not_decision"),
        (F.col("setup_bar_index") > F.col("decision_bar_index"), "setup_after_decision"),
        ((d != "UNLABELED") & ~F.coalesce(conf.between(1, 5), F.lit(False)), "confidence"),
        (unknown, "reason_tag"),
        (F.coalesce(F.trim("symbol"), F.lit("")) == "", "symbol"),
    ]
    return df.withColumn("errors", F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in checks])), ","))
