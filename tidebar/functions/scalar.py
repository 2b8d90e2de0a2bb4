"""Column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Interval vocabulary and its length in milliseconds.
INTERVAL_MS = {
    "1m": 60_000,
    "3m": 180_000,
    "5m": 300_000,
    "15m": 900_000,
    "30m": 1_800_000,
    "1h": 3_600_000,
    "2h": 7_200_000,
    "4h": 14_400_000,
    "6h": 21_600_000,
    "8h": 28_800_000,
    "12h": 43_200_000,
    "1d": 86_400_000,
    "3d": 259_200_000,
    "1w": 604_800_000,
}

UTC8_MS = 8 * 3_600_000
DAY_MS = 86_400_000


def zero_padded(n: Column, width: int) -> Column:
    """A number with leading zeros up to ``width`` digits; longer ones are kept whole."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def null() -> Column:
    return F.lit(None).cast("double")


def finite(x) -> Column:
    """NaN and both infinities become NULL."""
    v = c(x).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), null()).otherwise(v)


def ratio(num, den, eps: float = 0.0) -> Column:
    """num / den, NULL where the denominator is zero (or below ``eps`` in size)."""
    n, d = c(num).cast("double"), c(den).cast("double")
    return F.when(F.abs(d) >= eps if eps > 0 else d != 0.0, n / d)


def change(start, end) -> Column:
    """end / start - 1, NULL on a zero or missing start."""
    return ratio(end, start) - 1.0


def clamp(x, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c(x), F.lit(lo)), F.lit(hi))


def ramp(x, lo: float, hi: float) -> Column:
    """Linear 0..1 ramp between lo and hi; a missing input counts as 0."""
    return F.coalesce(clamp((c(x) - lo) / (hi - lo), 0.0, 1.0), F.lit(0.0))


def ln_pos(x) -> Column:
    v = c(x)
    return F.when(v > 0, F.ln(v))


def flag(cond) -> Column:
    """1.0 / 0.0, an unknown condition counting as false."""
    return F.when(c(cond), 1.0).otherwise(0.0)


def any_null(*cols) -> Column:
    return reduce(lambda a, b: a | b, [c(x).isNull() for x in cols])


def epoch_ms(df: DataFrame, col: str) -> Column:
    """Epoch milliseconds of a timestamp column, whatever the session zone."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', `{col}`)")
    if isinstance(kind, T.TimestampType):
        return F.unix_millis(col)
    if isinstance(kind, T.StringType):
        return F.unix_millis(F.try_to_timestamp(F.col(col)))
    return F.col(col).cast("long")


def interval_ms(col="interval") -> Column:
    m = F.create_map(*[F.lit(v) for kv in INTERVAL_MS.items() for v in kv])
    return F.try_element_at(m, c(col))


def utc8_hour(ms) -> Column:
    return F.pmod(F.floor((c(ms) + UTC8_MS) / 3_600_000), F.lit(24)).cast("int")


def utc8_date(ms) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor((c(ms) + UTC8_MS) / DAY_MS).cast("int"))


def utc8_month(ms) -> Column:
    return F.date_format(utc8_date(ms), "yyyy-MM")


def utc8_text(ms) -> Column:
    """ISO text of an epoch in UTC+8, whole seconds."""
    s = F.pmod(F.floor((c(ms) + UTC8_MS) / 1000), F.lit(86_400)).cast("int")
    return F.concat(
        F.date_format(utc8_date(ms), "yyyy-MM-dd"),
        F.lit("T"),
        F.lpad(F.floor(s / 3600).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad(F.floor((s % 3600) / 60).cast("string"), 2, "0"),
        F.lit(":"),
        F.lpad((s % 60).cast("string"), 2, "0"),
        F.lit("+08:00"),
    )


def local_text_ms(col) -> Column:
    """Epoch ms of ISO text; text without an offset is taken as UTC+8."""
    t = F.trim(c(col))
    zoned = t.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$")
    return F.unix_millis(F.try_to_timestamp(F.when(zoned, t).otherwise(F.concat(t, F.lit("+08:00")))))


def normal_symbol(col="symbol") -> Column:
    s = F.upper(F.trim(c(col)))
    return F.when(s.rlike("^[A-Z0-9]{3,30}$"), s)


def normal_interval(col="interval") -> Column:
    s = F.trim(c(col))
    return F.when(s.isin(*INTERVAL_MS), s)


def digest_id(prefix: str, *parts, length: int = 24) -> Column:
    """Stable id: prefix and the head of a SHA-256 over the joined parts; a missing part is empty text."""
    texts = [F.coalesce(c(p).cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *texts), 256), 1, length))


# Coefficients of the rational error-function approximation 7.1.26 of Abramowitz and Stegun.
ERF_T = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erfc(x) -> Column:
    """Complementary error function, absolute error below 1.5e-7."""
    v = c(x)
    a = F.abs(v)
    t = 1.0 / (1.0 + ERF_T * a)
    poly = t * (ERF_A[0] + t * (ERF_A[1] + t * (ERF_A[2] + t * (ERF_A[3] + t * ERF_A[4]))))
    tail = poly * F.exp(-a * a)
    return F.when(v < 0, 2.0 - tail).otherwise(tail)


def normal_sf(z) -> Column:
    return 0.5 * erfc(c(z) / F.sqrt(F.lit(2.0)))


def chi_square_sf(x, dof) -> Column:
    """Chi-square upper tail by the Wilson-Hilferty cube-root transform."""
    v, k = c(x), c(dof).cast("double")
    s = 2.0 / (9.0 * k)
    z = (F.pow(F.greatest(v, F.lit(0.0)) / k, F.lit(1.0 / 3.0)) - (1.0 - s)) / F.sqrt(s)
    return normal_sf(z)


def md5_mod(text, n) -> Column:
    """Deterministic draw 0..n-1 from the md5 of a text (portable to any SQL engine)."""
    h = F.conv(F.substring(F.md5(c(text)), 1, 15), 16, 10).cast("long")
    return F.pmod(h, c(n).cast("long"))
