"""Scores of sessions under profile rows: top band, caps, gates, missing profiles and broken rules."""

import pytest
from pyspark.sql import functions as F

from tidebar.operators import scorecard as S

FEATURES = ("pre_ret_20", "event_lower_wick_ratio")
LONG = ("long", "mine", ["LONG"], ["turn"], ["bad"], {"intervals": ["1m"]}, {"stop_loss_pct": 1.0, "take_profit_pct": 2.0, "max_holding_bars": 20.0}, "fixed", True, {"pre_ret_20": ("<=", -0.01), "event_lower_wick_ratio": (">=", 0.3), "missing": (">", 1.0)})
BOTH = ("both", "mine", ["LONG", "SHORT"], *LONG[3:])
BARE = ("bare", "mine", [], [], [], {}, {}, None, False, {})

EVENT = "session_id string, profile_id string, event_type string, side string, label_tags_json string, note string, pre_ret_20 double, event_lower_wick_ratio double, t long, no long"


def session(name, profile, count=60, side="LONG", tags='["turn","volume"]', closed=None, note="n", wick=0.5):
    opens = [(name, profile, "OPEN", side if isinstance(side, str) else side[i % len(side)], tags, note, -0.03, wick, i, i) for i in range(count)]
    return opens + [(name, profile, "CLOSE", "LONG", "[]", "n", None, None, i, 10_000 + i) for i in range(count if closed is None else closed)]


def score(spark, rows, costs=True, agreement=None, leakage="PASS", quality="PASS"):
    events = spark.createDataFrame(rows, EVENT)
    profiles = spark.createDataFrame([LONG, BOTH, BARE, S.default_profile("template")], S.PROFILE_SCHEMA)
    trades = events.where("event_type = 'CLOSE'").select("session_id", F.lit("CLOSED").alias("status"))
    if costs:
        trades = trades.withColumns({"fee_bps": F.lit(4.0), "slippage_bps": F.lit(1.0), "exit_reason": F.lit("rule")})
    found = S.event_evidence(events, profiles, FEATURES, ["session_id"]).join(S.trade_evidence(trades, ["session_id"]), "session_id", "left")
    drift = S.tag_drift(events.where("event_type = 'OPEN'"), ["session_id"], "t", "no", 7)
    found = found.join(drift, "session_id", "left").withColumns({"agreement_pct": F.lit(agreement).cast("double"), "direction_drift_warning": F.lit(0), "feature_drift_warning": F.lit(0)})
    return {r.session_id: r for r in S.scores(found, profiles, ["session_id"], leakage, quality).collect()}


def test_bands_caps_and_gates(spark):
    rows = [
        *session("best", "long"), *session("template", "template", tags='["长下影"]'), *session("none", None), *session("small", "long", 20), *session("tiny", "long", 6),
        *session("untagged", "long", tags="[]"), *session("short", "long", side="SHORT"), *session("oneside", "both"), *session("mixed", "both", side=("LONG", "SHORT")), *session("bare", "bare"),
        *session("open", "long", closed=5), *session("bad", "long", tags='["turn","bad"]'), *session("mute", "long", note=" "), *session("wick", "long", wick=0.1),
    ]
    got = score(spark, rows)
    best = got["best"]
    assert best.component_scores == S.LIMITS and best.total_score == 100.0 and best.gate_failures == [] and best.recommendation == "suitable_for_analysis"
    assert best.match_all_pct == 100.0 and best.match_pct == 100.0 and best.profile_status == "CUSTOM"
    assert got["template"].profile_status == "DEFAULT_REVERSAL_LONG_TEMPLATE" and got["template"].component_scores["profile_completeness"] == 12.5
    none = got["none"]
    assert (none.profile_status, none.total_score, none.component_scores, none.recommendation) == ("UNDECLARED", None, None, "descriptive_only")
    assert got["small"].caps_applied == ["closed_trades < 30: cap 60"] and got["small"].total_score == 60.0 and got["small"].component_scores["sample_sufficiency"] == 5.0
    assert got["tiny"].total_score == 40.0 and got["tiny"].recommendation == "not_suitable_for_rule_mining" and "sample_count below min_sample_count" in got["tiny"].gate_failures
    assert got["untagged"].total_score == 55.0 and got["untagged"].component_scores["entry_tag_consistency"] == 0.0 and got["untagged"].gate_failures == ["untagged_pct too high"]
    assert got["short"].component_scores["direction_discipline"] == 0.0 and got["short"].recommendation == "not_suitable_for_rule_mining"
    assert got["oneside"].component_scores["direction_discipline"] == 6.0 and got["oneside"].directional_coverage_warning
    assert got["mixed"].component_scores["direction_discipline"] == 10.0
    bare = got["bare"].component_scores
    assert bare["profile_completeness"] == 0.0 and bare["direction_discipline"] == 3.0 and bare["entry_setup_consistency"] == 5.0
    assert got["open"].possible_selection_bias and got["open"].component_scores["result_stability"] == 7.5
    bad = got["bad"]
    assert bad.gate_failures == ["forbidden_tag_hit_count > 0"] and bad.component_scores["entry_tag_consistency"] == 0.0 and bad.total_score == 85.0 and bad.recommendation == "needs_manual_review"
    assert got["mute"].gate_failures == ["missing_note_pct above profile limit"]
    assert got["wick"].component_scores["entry_setup_consistency"] == 0.0 and got["wick"].match_any_pct == 100.0 and got["wick"].match_pct == 50.0


def test_without_costs_and_with_failed_audits(spark):
    rows = [*session("s", "long"), *session("bare", "bare")]
    got = score(spark, rows, costs=False)
    assert got["s"].component_scores["risk_execution_discipline"] == 10.0 and got["s"].component_scores["exit_discipline"] == 4.0 and got["s"].caps_applied == ["no exit metadata: cap 80"]
    assert got["bare"].component_scores["risk_execution_discipline"] == 0.0 and got["bare"].total_score <= 75.0
    got = score(spark, rows, agreement=20.0, quality="FAIL")
    assert got["s"].total_score == 50.0 and got["s"].component_scores["data_quality_audit"] == 0.0 and got["s"].component_scores["entry_setup_consistency"] == 2.0
    got = score(spark, rows, leakage="FAIL")
    assert got["s"].total_score is None and got["s"].recommendation == "invalid_due_to_leakage" and got["s"].interpretation == "invalid_due_to_leakage"


def test_top_tag_drifts_between_thirds(spark):
    rows = [r if r[8] < 20 or r[2] == "CLOSE" else (*r[:4], '["other thing"]', *r[5:]) for r in session("drift", "long")]
    got = score(spark, rows + session("few", "long", 5))
    assert got["drift"].tag_drift_warning == 1 and got["few"].tag_drift_warning == 0


def test_outcome_features_are_refused(spark):
    with pytest.raises(ValueError):
        S.event_evidence(spark.createDataFrame(session("s", None), EVENT), spark.createDataFrame([LONG], S.PROFILE_SCHEMA), ("mfe_10",), ["session_id"])
