"""Bar cleaning, quality reports, ids and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalar import finite, interval_ms, utc8_text
from .chunks import CHUNK, KEYS, dense_index, over_chunks

NUMERIC = ("open", "high", "low", "close", "volume")


def coerce(raw: DataFrame) -> DataFrame:
    """Readable numbers or NULL, and the first reason a row cannot be kept."""
    df = raw.withColumns({c: finite(F.expr(f"try_cast({c} as double)")) for c in NUMERIC})
    df = df.withColumn("open_time_ms", F.expr("try_cast(open_time_ms as bigint)"))
    close_time = F.expr("try_cast(close_time_ms as bigint)") if "close_time_ms" in raw.columns else (
        F.col("open_time_ms") + interval_ms() - 1
    )
    df = df.withColumn("close_time_ms", close_time)
    o, h, lo, cl = (F.col(x) for x in ("open", "high", "low", "close"))
    missing = F.lit(False)
    for name in ("open_time_ms", "close_time_ms", *NUMERIC):
        missing = missing | F.col(name).isNull()
    return df.withColumn(
        "reject_reason",
        F.when(missing, "missing")
        .when(F.col("close_time_ms") < F.col("open_time_ms"), "time_order")
        .when((h < lo) | (o < lo) | (o > h) | (cl < lo) | (cl > h), "invalid_ohlc")
        .when(F.col("volume") < 0, "invalid_volume"),
    )


def clean(raw: DataFrame, start_ms: int | None = None, end_ms: int | None = None) -> DataFrame:
    """Valid rows, the last arrival per open time, inside the closed date range, densely indexed.

    ``ingest_seq`` stands for the input order. Copies of one bar are folded by an
    aggregate with map-side combining, so even a key with very many copies is cheap.
    """
    ok = coerce(raw).where(F.col("reject_reason").isNull())
    fields = ["close_time_ms", *NUMERIC]
    latest = (
        ok.groupBy("symbol", "interval", "open_time_ms")
        .agg(F.max_by(F.struct(*fields), "ingest_seq").alias("_r"))
        .select("symbol", "interval", "open_time_ms", *[F.col(f"_r.{f}").alias(f) for f in fields])
    )
    if start_ms is not None:
        latest = latest.where(F.col("open_time_ms") >= start_ms)
    if end_ms is not None:
        latest = latest.where(F.col("open_time_ms") <= end_ms)
    return dense_index(latest, KEYS, "open_time_ms", 86_400_000 * 365)


def _arrival_steps(df: DataFrame, size: int) -> DataFrame:
    pos = dense_index(df, KEYS, "ingest_seq", size, name="_pos")
    return over_chunks(
        pos,
        lambda d, w: d.withColumn("_back", F.col("open_time_ms") < F.lag("open_time_ms").over(w)),
        back=1,
        index="_pos",
        size=size,
    )


def clean_stats(raw: DataFrame, size: int = CHUNK) -> DataFrame:
    """Counts of dropped, duplicate, invalid and out-of-order rows per series."""
    tagged = coerce(raw)
    why = F.col("reject_reason")
    dropped = tagged.groupBy(*KEYS).agg(
        F.count_if(why.isNotNull()).alias("dropped_invalid"),
        F.count_if(why == "invalid_ohlc").alias("invalid_ohlc"),
        F.count_if(why == "invalid_volume").alias("invalid_volume"),
    )
    kept = tagged.where(why.isNull())
    copies = (
        kept.groupBy(*KEYS, "open_time_ms").agg((F.count(F.lit(1)) - 1).alias("_extra"))
        .groupBy(*KEYS).agg(F.sum("_extra").alias("dropped_duplicates"))
    )
    order = _arrival_steps(kept.select(*KEYS, "open_time_ms", "ingest_seq"), size).groupBy(*KEYS).agg(
        F.count_if("_back").alias("out_of_order")
    )
    zero = {c: 0 for c in ("dropped_duplicates", "out_of_order")}
    return dropped.join(copies, [*KEYS], "left").join(order, [*KEYS], "left").fillna(zero)


def series_quality(cleaned: DataFrame, stats: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Expected, actual, missing and duplicated bars with a PASS / WARNING / FAIL verdict."""
    agg = cleaned.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("actual_bars"),
        F.count_distinct("open_time_ms").alias("_opens"),
        F.min("open_time_ms").alias("_first"),
        F.max("open_time_ms").alias("_last"),
    )
    expected = F.greatest(F.floor((F.lit(end_ms) - F.lit(start_ms)) / interval_ms()) + 1, F.lit(0))
    out = agg.join(stats, [*KEYS], "left").withColumns(
        {
            "expected_bars": expected,
            "missing_bars": F.greatest(expected - F.col("_opens"), F.lit(0)),
            "duplicated_bars": F.col("dropped_duplicates") + F.col("actual_bars") - F.col("_opens"),
            "invalid_rows": F.col("dropped_invalid"),
            "strictly_increasing": F.col("out_of_order") == 0,
            "first_open_time_bjt": utc8_text("_first"),
            "last_open_time_bjt": utc8_text("_last"),
        }
    )
    return out.withColumn(
        "data_quality_status",
        F.when((F.col("invalid_rows") > 0) | ~F.col("strictly_increasing"), "FAIL")
        .when((F.col("duplicated_bars") > 0) | (F.col("missing_bars") > 0), "WARNING")
        .otherwise("PASS"),
    ).select(
        *KEYS, "expected_bars", "actual_bars", "missing_bars", "duplicated_bars", "invalid_rows",
        "strictly_increasing", "first_open_time_bjt", "last_open_time_bjt", "data_quality_status",
    )


def raw_audit(raw: DataFrame, size: int = CHUNK) -> DataFrame:
    """Audit of the unclean feed: gaps, copies, disorder, unreadable and impossible values, warnings."""
    df = raw.withColumns({f"_{c}": finite(F.expr(f"try_cast({c} as double)")) for c in NUMERIC}).withColumn(
        "open_time_ms", F.expr("try_cast(open_time_ms as bigint)")
    )
    o, h, lo, cl, v = (F.col(f"_{x}") for x in NUMERIC)
    bad = F.coalesce((h < F.greatest(o, cl, lo)) | (lo > F.least(o, cl, h)), F.lit(False))
    counts = df.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(F.col("open_time_ms").isNull()).alias("missing_time_rows"),
        F.count_if(bad).alias("invalid_ohlc_rows"),
        F.count_if(o.isNull() | h.isNull() | lo.isNull() | cl.isNull()).alias("non_numeric_ohlcv_rows"),
        F.count_if(v.isNull()).alias("missing_volume_rows"),
        F.count_if(F.coalesce(v < 0, F.lit(False))).alias("negative_volume_rows"),
    )
    timed = df.where(F.col("open_time_ms").isNotNull()).select(*KEYS, "open_time_ms", "ingest_seq")
    opens = timed.groupBy(*KEYS, "open_time_ms").agg(F.count(F.lit(1)).alias("_c"))
    pos = dense_index(opens, KEYS, "open_time_ms", 86_400_000 * 365, name="_pos")
    gaps = over_chunks(
        pos,
        lambda d, w: d.withColumn("_gap", F.col("open_time_ms") - F.lag("open_time_ms").over(w)),
        back=1,
        index="_pos",
        size=size,
    )
    step = interval_ms()
    shape = gaps.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("actual_bars"),
        F.sum(F.col("_c") - 1).alias("duplicate_bars"),
        F.coalesce(F.sum(F.when(F.col("_gap") > step, F.floor(F.col("_gap") / step) - 1)), F.lit(0)).alias("missing_bars"),
        (F.floor((F.max("open_time_ms") - F.min("open_time_ms")) / F.first(step)) + 1).alias("expected_bars"),
    )
    order = _arrival_steps(timed, size).groupBy(*KEYS).agg(F.count_if("_back").alias("out_of_order_bars"))
    out = counts.join(shape, [*KEYS], "left").join(order, [*KEYS], "left").fillna(
        0, ["actual_bars", "duplicate_bars", "missing_bars", "expected_bars", "out_of_order_bars"]
    )
    hard = ("invalid_ohlc_rows", "non_numeric_ohlcv_rows", "missing_time_rows", "missing_volume_rows", "negative_volume_rows")
    # Warning names in reporting order.
    names = [
        ("missing_time_rows", "missing_time"),
        ("missing_bars", "missing_bars"),
        ("duplicate_bars", "duplicate_bars"),
        ("out_of_order_bars", "out_of_order"),
        ("invalid_ohlc_rows", "invalid_ohlc"),
        ("non_numeric_ohlcv_rows", "non_numeric_ohlcv"),
        ("negative_volume_rows", "negative_volume"),
        ("missing_volume_rows", "missing_volume"),
    ]
    out = out.withColumns(
        {
            "invalid_rows": sum((F.col(x) for x in hard), F.lit(0)),
            "warnings": F.array_join(F.array_compact(F.array(*[F.when(F.col(a) > 0, F.lit(b)) for a, b in names])), ","),
        }
    )
    return out.withColumn(
        "quality_status",
        F.when(F.col("invalid_rows") > 0, "FAIL").when(F.col("warnings") != "", "WARNING").otherwise("PASS"),
    )


def with_candle_id(df: DataFrame, length: int = 32) -> DataFrame:
    text = F.concat_ws("|", F.upper("symbol"), "interval", F.coalesce(F.col("open_time_ms").cast("string"), F.lit("")))
    return df.withColumn("candle_id", F.substring(F.sha2(text, 256), 1, length))


def content_digest(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Order-free fingerprint of the rows of each key: two xor lanes, a sum lane and the row count.

    Rows are reduced by commutative aggregates, so nothing is sorted or gathered.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    h = F.md5(text)
    a = F.conv(F.substring(h, 1, 15), 16, 10).cast("long")
    b = F.conv(F.substring(h, 17, 15), 16, 10).cast("long")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.bit_xor(a).alias("_x1"),
        F.bit_xor(b).alias("_x2"),
        F.sum(F.pmod(a, F.lit(1_000_003))).alias("_s"),
    ).withColumn(
        "data_version",
        F.concat(F.lit("dv_"), F.substring(F.sha2(F.concat_ws("|", "row_count", "_x1", "_x2", "_s"), 256), 1, 24)),
    )


def range_slice(bars: DataFrame, start_ms: int, end_ms: int, minimum: int) -> tuple[DataFrame, DataFrame]:
    """Half-open slice and its coverage verdict: ready, needs_market_data or error."""
    part = bars.where((F.col("open_time_ms") >= start_ms) & (F.col("open_time_ms") < end_ms))
    step = interval_ms()
    cover = bars.groupBy(*KEYS).agg(
        F.min("open_time_ms").alias("available_start_ms"),
        (F.max("open_time_ms") + F.first(step)).alias("available_end_ms"),
        F.count_if((F.col("open_time_ms") >= start_ms) & (F.col("open_time_ms") < end_ms)).alias("bars_in_range"),
    )
    verdict = cover.withColumn(
        "status",
        F.when((F.col("available_start_ms") > start_ms) | (F.col("available_end_ms") < end_ms), "needs_market_data")
        .when(F.col("bars_in_range") < minimum, "error")
        .otherwise("ready"),
    )
    return part, verdict


def sample_size_class(n: Column) -> Column:
    return (
        F.when(n < 30, "observation_only").when(n < 100, "exploratory").when(n < 500, "preliminary").otherwise("research_ready")
    )


def column_audit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, missing share, NaN and infinity counts, constant flag; one pass over the data."""
    numeric = [c for c in columns if dict(df.dtypes)[c] in ("double", "float")]
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        v = F.col(c)
        num = c in numeric
        bad = F.isnan(v) if num else F.lit(False)
        inf = (F.abs(v) == float("inf")) if num else F.lit(False)
        low = F.min(v.cast("string")) if not num else F.min(F.when(~bad, v)).cast("string")
        high = F.max(v.cast("string")) if not num else F.max(F.when(~bad, v)).cast("string")
        aggs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(v.isNull() | bad).alias("missing"),
                F.count_if(F.coalesce(inf, F.lit(False))).alias("infinite"),
                F.coalesce(low == high, F.lit(True)).alias("is_constant"),
            ).alias(f"_{c}")
        )
    one = df.agg(*aggs)
    return one.select("n", F.explode(F.array(*[F.col(f"_{c}") for c in columns])).alias("s")).select(
        F.col("s.column").alias("column"),
        F.col("n").alias("rows"),
        F.col("s.missing").alias("missing"),
        (F.col("s.missing") / F.col("n")).alias("missing_ratio"),
        F.col("s.infinite").alias("infinite"),
        F.col("s.is_constant").alias("is_constant"),
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of each value of several text columns in one aggregate."""
    long = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("UNKNOWN")).alias("value")) for c in columns])
        ).alias("s")
    )
    return long.groupBy("s.column", "s.value").agg(F.count(F.lit(1)).alias("n")).toDF("column", "value", "n")


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """Every id that occurs more than once, with its count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_differences(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys of each table missing from each other one, counted by one outer aggregate."""
    names = list(sides)
    tagged = None
    for n in names:
        part = sides[n].select(key, *[F.lit(1 if m == n else 0).alias(m) for m in names])
        tagged = part if tagged is None else tagged.unionByName(part)
    seen = tagged.groupBy(key).agg(*[F.max(n).alias(n) for n in names])
    rows = []
    for a in names:
        for b in names:
            if a != b:
                rows.append(F.struct(F.lit(a).alias("left_table"), F.lit(b).alias("right_table"), ((F.col(a) == 1) & (F.col(b) == 0)).alias("miss")))
    return (
        seen.select(F.explode(F.array(*rows)).alias("s"))
        .groupBy("s.left_table", "s.right_table")
        .agg(F.count_if("s.miss").alias("only_left"))
        .toDF("left_table", "right_table", "only_left")
    )
