"""Entry candidates and review lists: volume frames without engine windows, scores worked out once."""

import math

from pyspark.sql import functions as F

from tidebar.operators import similarity, universe

NAN, INF = float("nan"), float("inf")


def test_candidates_follow_window_frames_on_odd_volumes(bars):
    i = F.col("bar_index")
    odd = F.when(i % 41 == 3, None).when(i % 53 == 5, NAN).when(i % 67 == 7, INF).when(i % 23 < 5, 0.0).otherwise(F.col("volume"))
    x = bars.withColumn("volume", odd)
    limits = dict(min_drop=0.001, min_range=0.001, lower_shadow=0.05, confirm_body=0.05)
    out = universe.entry_universe(x, size=32, **limits)
    assert "stddev_pop" not in out._jdf.queryExecution().toString()
    got = {(r.symbol, r.bar_index): r.decision_timing for r in out.collect()}
    want = {}
    for symbol in ("HOT", "COLD"):
        rows = sorted(x.where(F.col("symbol") == symbol).collect(), key=lambda r: r.bar_index)

        def core(k):
            if k < 6:
                return False
            v = rows[k].volume
            known = [r.volume for r in rows[max(0, k - 20) : k] if r.volume is not None]
            usual = rows[k - 1].close / rows[k - 5].close - 1 <= -0.001 and (rows[k].high - rows[k].low) / rows[k - 1].close >= 0.001
            if not usual or v is None or not known:
                return False
            if not all(map(math.isfinite, known)):
                return True
            mean = sum(known) / len(known)
            s = math.sqrt(sum((y - mean) ** 2 for y in known) / len(known))
            z = (v - mean) / s if s > 0 else 0.0
            return (mean > 0 and (v / mean >= 1.5 or math.isnan(v))) or z >= 1.0 or math.isnan(z)

        for k, r in enumerate(rows):
            span = r.high - r.low
            if core(k) and (min(r.open, r.close) - r.low) / span >= 0.05:
                want[symbol, k] = "CURRENT_BAR_CLOSE"
            elif k and core(k - 1) and r.close > r.open and (r.close - r.open) / span >= 0.05:
                want[symbol, k] = "NEXT_BAR_CONFIRMATION"
    assert len(want) > 20 and got == want


def test_review_lists_work_out_scores_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    cols = "observation_id string, human_entry_similarity double, human_decision string"
    rows = [(f"o{i:03}", (i * 37 % 100) / 100, ("ENTRY", "REJECT", "UNCERTAIN")[i % 3]) for i in range(90)]
    scores = spark.createDataFrame(rows, cols).mapInPandas(count, cols)
    out = [(r.list, r.observation_id) for r in similarity.manual_review(scores, 2).collect()]
    assert seen.value == len(rows)

    def first(name, kept, order):
        return [(name, r[0]) for r in sorted(kept, key=lambda r: (order(r), r[0]))[:2]]

    assert sorted(out) == sorted(
        first("high_similarity_reject", [r for r in rows if r[2] == "REJECT"], lambda r: -r[1])
        + first("low_similarity_entry", [r for r in rows if r[2] == "ENTRY"], lambda r: r[1])
        + first("most_uncertain", rows, lambda r: abs(r[1] - 0.5))
    )


def test_diverse_halves_come_from_one_row_a_feature(spark, monkeypatch):
    """Buckets equal those of ranks joined back, with nulls, ties and a constant feature; ranked rows aren't joined by id."""
    rows = [(f"o{i:03}", i, (i * 29 % 60) / 60, None if i % 11 == 3 else float(i * 17 % 13), 4.0, float(i % 3)) for i in range(60)]
    scores = spark.createDataFrame(rows, "observation_id string, obs_no long, human_entry_similarity double, a double, b double, c double")
    ranked, joined = similarity.rank_bins, []

    def watched(df, *rest):
        joined.append("observation_id" in df.columns)
        return ranked(df, *rest)

    monkeypatch.setattr(similarity, "rank_bins", watched)
    got = similarity.diverse(scores, ["a", "b", "c"], 60, "obs_no").collect()
    half = []
    for at in (3, 4, 5):
        known = sorted((r[at], r[1]) for r in rows if r[at] is not None)
        kinds = min(2, len({v for v, _ in known}))
        half.append({tie: max(0, math.ceil(k * kinds / (len(known) - 1)) - 1) if kinds > 1 else 0 for k, (_, tie) in enumerate(known)})
    want = {r[0]: "|".join(f"{n}:{h.get(r[1], '<NA>')}" for n, h in zip("abc", half, strict=True)) for r in rows}
    assert {r.observation_id: r.diversity_bucket for r in got} == want and len(got) == len(rows)
    assert joined == [False] * 3
