"""Strategy consistency of sessions against declared profiles, all of them rows.

A profile is a row whose demands are arrays and maps; evidence is one aggregate over a session's
events and one over its trades; scores, caps and gates are maps that higher-order functions
combine, so another component, cap or profile is data and not another branch.

Profiles: profile_id, strategy_id, allowed_sides, required_tags, forbidden_tags (arrays),
allowed (map name -> array: symbols, intervals, regimes), limits (map name -> number:
stop_loss_pct, take_profit_pct, max_holding_bars, max_missing_note_pct, min_sample_count),
risk_model, exit_rules_required, expected (map feature -> (op, value)).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import flag
from .behavior import GENERIC_TAGS, thirds
from .guards import forbidden
from .study import parse_tags

# The most points of each component, points for closed trades.
LIMITS = {
    "sample_sufficiency": 10.0,
    "profile_completeness": 15.0,
    "entry_tag_consistency": 15.0,
    "direction_discipline": 10.0,
    "entry_setup_consistency": 10.0,
    "risk_execution_discipline": 15.0,
    "exit_discipline": 10.0,
    "result_stability": 10.0,
    "data_quality_audit": 5.0,
}
SUFFICIENT = {5: 2.0, 10: 5.0, 30: 8.0, 50: 10.0}
# Score bands with their recommendation and wording, and the template's name.
BANDS = {80.0: ("suitable_for_analysis", "behavior appears repeatable; continue with out-of-sample audit"), 60.0: ("needs_manual_review", "partially defined behavior; manual review is required")}
LOWEST = ("not_suitable_for_rule_mining", "insufficient evidence of a repeatable audited strategy")
TEMPLATE = "reversal_long_after_drop"

PROFILE_SCHEMA = (
    "profile_id string, strategy_id string, allowed_sides array<string>, required_tags array<string>, forbidden_tags array<string>, allowed map<string, array<string>>, "
    "limits map<string, double>, risk_model string, exit_rules_required boolean, expected map<string, struct<op: string, value: double>>"
)


def default_profile(profile_id: str = TEMPLATE) -> tuple:
    """The template row: long after a fall, with a long lower wick on volume."""
    # The template's demands.
    return (
        profile_id, TEMPLATE, ["LONG"], ["长下影", "放量"], [], {}, {"stop_loss_pct": 1.0, "take_profit_pct": 2.0, "max_holding_bars": 20.0, "max_missing_note_pct": 40.0, "min_sample_count": 30.0},
        "fixed_stop_take", True, {"pre_ret_20": ("<=", -0.02), "event_lower_wick_ratio": (">=", 0.3)},
    )


def _number(limits: str, name: str, otherwise: float) -> Column:
    return F.coalesce(F.try_element_at(F.col(limits), F.lit(name)), F.lit(otherwise))


def _held(condition: Column, value: Column) -> Column:
    """Whether a value meets an (op, value) demand; null where the value is missing or the op unknown."""
    op, against = condition["op"], condition["value"]
    kept = F.create_map(F.lit("<="), value <= against, F.lit(">="), value >= against, F.lit("<"), value < against, F.lit(">"), value > against, F.lit("=="), value == against)
    return F.try_element_at(kept, op)


def demand_hits(events: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Hit rate of each expected feature (a map), their mean, and the shares of rows that meet any and all; demands without any value are left out.

    Rows are folded to the patterns of met demands first, of which a key has few.
    """
    keys = list(keys)
    values = F.create_map(*[x for f in features for x in (F.lit(f), F.col(f).cast("double"))]) if features else F.create_map().cast("map<string,double>")
    met = F.transform_values(F.coalesce("expected", F.create_map().cast("map<string,struct<op:string,value:double>>")), lambda f, s: _held(s, F.try_element_at(values, f)))
    folded = events.select(*keys, F.array_sort(F.map_entries(met)).alias("_met")).groupBy(*keys, "_met").agg(F.count("*").alias("_n"))
    each = folded.select(*keys, "_n", F.explode("_met").alias("_m")).groupBy(*keys, F.col("_m.key").alias("_f")).agg(
        (F.sum(F.when(F.col("_m.value"), F.col("_n")).otherwise(0)) * 100.0 / F.sum(F.when(F.col("_m.value").isNotNull(), F.col("_n")))).alias("_rate")
    )
    known = each.where("_rate is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_f", "_rate"))).alias("_r"))  # a profile's demands
    known = known.select(*keys, F.map_from_entries("_r").alias("hit_rates"))
    judged = folded.join(known, keys).withColumn("_met", F.filter("_met", lambda m: F.map_contains_key("hit_rates", m["key"])))
    yes = lambda m: F.coalesce(m["value"], F.lit(False))
    share = lambda c: F.sum(F.when(c, F.col("_n")).otherwise(0)) * 100.0 / F.sum("_n")
    out = judged.groupBy(*keys).agg(share(F.exists("_met", yes)).alias("match_any_pct"), share(F.forall("_met", yes)).alias("match_all_pct"))
    mean = F.aggregate(F.map_values("hit_rates"), F.lit(0.0), lambda a, x: a + x) / F.size("hit_rates")
    return out.join(known, keys).withColumn("match_pct", mean)


def tag_drift(opens: DataFrame, keys: Sequence[str], order: str, tie: str, width: int) -> DataFrame:
    """Whether the most frequent tag differs between thirds; below six rows nothing is judged."""
    keys = list(keys)
    tags = F.filter(parse_tags("label_tags_json"), lambda t: t != "UNTAGGED")
    parts = thirds(opens.select(*keys, order, tie, tags.alias("_tags")), keys, order, tie, width).where("_n >= 6")
    counts = parts.select(*keys, "part", F.explode("_tags").alias("_tag")).groupBy(*keys, "part", "_tag").agg(F.count("*").alias("_c"))
    first = counts.groupBy(*keys, "part").agg(F.min_by("_tag", F.struct(-F.col("_c"), "_tag")).alias("_top"))
    return first.groupBy(*keys).agg(F.when(F.count_distinct("_top") > 1, 1).otherwise(0).alias("tag_drift_warning"))


def event_evidence(events: DataFrame, profiles: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Counts over a session's entries under its profile; ``events`` has profile_id (null: none declared)."""
    keys = list(keys)
    bad = forbidden(features)
    if bad:
        raise ValueError(f"outcome columns are not allowed in profiles: {', '.join(bad)}")
    entries = F.upper("event_type").isin("OPEN", "OPEN_LONG", "OPEN_SHORT")
    df = events.join(profiles, "profile_id", "left").withColumn("_tags", F.filter(parse_tags("label_tags_json"), lambda t: t != "UNTAGGED"))
    opens = df.where(entries)
    side, tags = F.upper("side"), F.col("_tags")
    tagged = F.size(tags) > 0
    asked = F.size("required_tags") > 0
    out = opens.groupBy(*keys).agg(
        F.first("profile_id").alias("profile_id"), F.count("*").alias("sample_count"), F.count_if(tagged).alias("tagged"),
        F.count_if(F.when(asked, F.arrays_overlap(tags, "required_tags")).otherwise(tagged)).alias("required"),
        F.count_if(F.arrays_overlap(tags, "forbidden_tags")).alias("forbidden_tag_hit_count"), F.count_if(F.trim(F.coalesce("note", F.lit(""))) == "").alias("unnoted"),
        F.count_if(side == "LONG").alias("long_count"), F.count_if(side == "SHORT").alias("short_count"), F.count_if(F.array_contains("allowed_sides", side)).alias("kept_side"),
    )
    top = opens.select(*keys, F.explode("_tags").alias("_tag")).groupBy(*keys, "_tag").agg(F.count("*").alias("_c"))
    top = top.where(~F.lower(F.trim("_tag")).isin(*GENERIC_TAGS)).groupBy(*keys).agg(F.max("_c").alias("top_tag"))
    closes = events.groupBy(*keys).agg(F.count_if(F.upper("event_type").contains("CLOSE")).alias("close_count"))
    return out.join(top, keys, "left").join(closes, keys, "left").join(demand_hits(opens, features, keys), keys, "left").fillna(0, ["top_tag"])


def trade_evidence(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closed trades, and whether costs and exit reasons are recorded, as far as the table has such columns."""
    has = set(trades.columns)
    costs = {"fee_bps", "slippage_bps"} <= has
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    reasons = [F.max(flag(blank(c))) for c in ("exit_reason", "exit_event_type", "close_reason") if c in has]
    return trades.groupBy(*keys).agg(
        (F.count_if(F.upper(F.coalesce("status", F.lit(""))) == "CLOSED") if "status" in has else F.lit(None).cast("long")).alias("closed"),
        ((F.count("fee_bps") > 0) & (F.count("slippage_bps") > 0) if costs else F.lit(False)).alias("costs_known"), F.lit(costs).alias("costs_kept"),
        (F.greatest(*reasons, F.lit(0.0)) > 0 if reasons else F.lit(False)).alias("exits_known"),
    )


def _percent(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) * 100.0 / F.col(whole)).otherwise(0.0)


def _given(*columns: Column) -> Column:
    return F.aggregate(F.array(*[F.coalesce(c, F.lit(False)).cast("double") for c in columns]), F.lit(0.0), lambda a, x: a + x)


def _named(items: dict[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*map(F.lit, items)), F.array(*items.values()))


def scores(evidence: DataFrame, profiles: DataFrame, keys: Sequence[str], leakage: str = "PASS", quality: str = "PASS") -> DataFrame:
    """Component points, total under caps, gate failures, recommendation and wording of each session.

    ``evidence`` has the columns of ``event_evidence`` and ``trade_evidence``, agreement_pct of similar
    contexts (or null) and the drift warnings. Without a declared profile there are figures but no score.
    """
    df = evidence.join(profiles, "profile_id", "left").fillna(0, ["direction_drift_warning", "tag_drift_warning", "feature_drift_warning"])
    n, sides = F.col("sample_count"), F.size("allowed_sides")
    declared = F.col("strategy_id").isNotNull()
    clean, sound = leakage.upper() == "PASS", quality.upper() in ("PASS", "OK")
    closed = F.coalesce("closed", "close_count")
    asked_stop = F.map_contains_key("limits", "stop_loss_pct") | F.map_contains_key("limits", "take_profit_pct")
    modelled = F.coalesce(F.col("risk_model") != "", F.lit(False))
    kept_pct = F.when(sides > 0, _percent("kept_side", "sample_count")).otherwise(F.greatest("long_count", "short_count") * 100.0 / n)
    one_seen = (F.col("long_count") == 0) | (F.col("short_count") == 0)
    tag_pct = _percent("required", "sample_count") * 0.55 + _percent("tagged", "sample_count") * 0.30 + _percent("top_tag", "sample_count") * 0.15
    tag_pct = tag_pct - F.least(F.lit(100.0), _percent("forbidden_tag_hit_count", "sample_count") * 2.0)
    df = df.withColumns(
        {
            "profile_status": F.when(~declared, "UNDECLARED").when(F.col("strategy_id") == TEMPLATE, "DEFAULT_REVERSAL_LONG_TEMPLATE").otherwise("CUSTOM"),
            "closed_trades": closed, "untagged_pct": 100.0 - _percent("tagged", "sample_count"), "missing_note_pct": _percent("unnoted", "sample_count"), "direction_consistency_pct": kept_pct,
            "possible_selection_bias": F.coalesce(F.col("close_count"), F.lit(0)) < F.greatest(F.lit(1), F.floor(n * 0.3)),
            "directional_coverage_warning": F.coalesce((sides == 2) & one_seen, F.lit(False)),
            "_risk": F.coalesce((modelled & asked_stop) | F.col("costs_known"), F.lit(False)), "_exit": F.coalesce("exits_known", F.lit(False)),
        }
    )
    named = {
        "sample_sufficiency": F.aggregate(F.map_entries(F.create_map(*[x for at, p in SUFFICIENT.items() for x in (F.lit(at), F.lit(p))])), F.lit(0.0), lambda a, s: F.when(F.col("closed_trades") >= s["key"], F.greatest(a, s["value"])).otherwise(a)),
        "profile_completeness": LIMITS["profile_completeness"] / 6 * _given(
            sides > 0, F.size("required_tags") > 0, modelled, asked_stop, F.map_contains_key("limits", "max_holding_bars") | F.col("exit_rules_required"), F.exists(F.map_values("allowed"), lambda v: F.size(v) > 0)
        ),
        "entry_tag_consistency": F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), tag_pct)) * 0.15, 2),
        "direction_discipline": F.when(~(F.coalesce(sides, F.lit(0)) > 0), F.when(F.greatest("long_count", "short_count") * 100.0 / n >= 95.0, 3.0).otherwise(4.0)).when(F.col("directional_coverage_warning"), 6.0).otherwise(kept_pct / 10.0),
        "entry_setup_consistency": F.coalesce(F.coalesce("agreement_pct", "match_all_pct") / 10.0, F.lit(5.0)),
        "risk_execution_discipline": F.when(~F.col("_risk"), 0.0).when(F.coalesce("costs_kept", F.lit(False)), 15.0).otherwise(10.0),
        "exit_discipline": F.when(F.col("_exit"), 10.0).when(F.coalesce("close_count", F.lit(0)) > 0, 4.0).otherwise(0.0),
        "result_stability": 10.0 - 2.5 * (F.col("direction_drift_warning") + F.col("tag_drift_warning") + F.col("feature_drift_warning") + F.col("possible_selection_bias").cast("int")),
        "data_quality_audit": F.lit(LIMITS["data_quality_audit"] if clean and sound else 0.0),
    }
    most = F.create_map(*[x for k, v in LIMITS.items() for x in (F.lit(k), F.lit(v))])
    df = df.withColumn("component_scores", F.when(declared, F.map_zip_with(_named(named), most, lambda k, p, top: F.round(F.greatest(F.lit(0.0), F.least(p, top)), 2))))
    df = df.withColumn("raw_score", F.round(F.aggregate(F.map_values("component_scores"), F.lit(0.0), lambda a, x: a + x), 2))
    # every cap is its reason, its height and when it holds
    caps = {
        "closed_trades < 10: cap 40": (40.0, F.col("closed_trades") < 10),
        "closed_trades < 30: cap 60": (60.0, F.col("closed_trades").between(10, 29)),
        "no labels: cap 55": (55.0, F.col("tagged") == 0),
        "no risk metadata: cap 75": (75.0, ~F.col("_risk")),
        "no exit metadata: cap 80": (80.0, ~F.col("_exit")),
        "data quality failed: cap 50": (50.0, F.lit(not sound)),
    }
    heights = F.create_map(*[x for k, (h, _) in caps.items() for x in (F.lit(k), F.lit(h))])
    holding = _named({k: c for k, (_, c) in caps.items()})
    df = df.withColumn("_caps", F.when(declared & F.lit(clean), F.map_filter(heights, lambda k, _: F.coalesce(F.element_at(holding, k), F.lit(False)))))
    total = F.round(F.least("raw_score", F.coalesce(F.array_min(F.map_values("_caps")), F.lit(100.0))), 2)
    gates = {
        "sample_count below min_sample_count": n < _number("limits", "min_sample_count", 30.0),
        "direction_consistency_pct below hard floor for declared allowed_sides": (sides == 1) & (F.col("direction_consistency_pct") < 70.0),
        "untagged_pct too high": F.col("untagged_pct") > 60.0,
        "missing_note_pct above profile limit": declared & (F.col("missing_note_pct") > _number("limits", "max_missing_note_pct", 40.0)),
        "possible_selection_bias_warning is true": F.col("possible_selection_bias"),
        "forbidden_tag_hit_count > 0": F.col("forbidden_tag_hit_count") > 0,
    }
    failing = F.map_filter(_named(gates), lambda _, v: F.coalesce(v, F.lit(False)))
    df = df.withColumns({"total_score": F.when(declared & F.lit(clean), total), "caps_applied": F.map_keys("_caps"), "gate_failures": F.map_keys(failing)})
    band = F.array_max(F.filter(F.array(*map(F.lit, BANDS)), lambda b: F.col("total_score") >= b))
    place = F.create_map(*[x for b, (r, w) in BANDS.items() for x in (F.lit(b), F.struct(F.lit(r).alias("r"), F.lit(w).alias("w")))])
    placed = F.coalesce(F.try_element_at(place, band), F.struct(F.lit(LOWEST[0]).alias("r"), F.lit(LOWEST[1]).alias("w")))
    floored = F.array_contains("gate_failures", list(gates)[1])
    advice = F.when(floored, LOWEST[0]).when(~declared, "descriptive_only").when(F.col("total_score").isNull(), "invalid_due_to_leakage")
    advice = advice.when((placed["r"] == BANDS[80.0][0]) & (F.size("gate_failures") > 0), BANDS[60.0][0]).otherwise(placed["r"])
    wording = F.when(~declared, "behavior statistics and sample structure only").when(F.col("total_score").isNull(), "invalid_due_to_leakage").otherwise(placed["w"])
    return df.withColumns({"recommendation": advice, "interpretation": wording}).select(
        *keys, "profile_id", "profile_status", "sample_count", "closed_trades", "long_count", "short_count", "direction_consistency_pct", "untagged_pct", "missing_note_pct", "match_pct", "match_any_pct", "match_all_pct", "agreement_pct",
        "direction_drift_warning", "tag_drift_warning", "feature_drift_warning", "directional_coverage_warning", "possible_selection_bias", "component_scores", "raw_score", "total_score", "caps_applied", "gate_failures", "recommendation", "interpretation",
    )
