"""Numeric expressions: missing numbers, rounding, the normal law, Greeks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hart's rational approximation of the normal tail (1968, in the
# double-precision form published by West in 2005), highest power first.
HART_NUM = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
HART_DEN = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
HART_SWITCH = 7.07106781186547
ROOT_TWO_PI = 2.506628274631


def missing_as_zero(value: Column | str) -> Column:
    """Null and NaN count as 0."""
    col = F.col(value) if isinstance(value, str) else value
    col = col.cast("double")
    return F.when(col.isNull() | F.isnan(col), F.lit(0.0)).otherwise(col)


def nan_as_null(value: Column | str) -> Column:
    col = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(col), col)


def round_cents(value: Column) -> Column:
    """Two decimals, decided on the exact binary value, halves to even."""
    return F.regexp_replace(F.format_number(value, 2), ",", "").cast("double")


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def norm_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2.0) / F.lit((2.0 * 3.141592653589793) ** 0.5)


def norm_cdf(x: Column) -> Column:
    z = F.abs(x)
    decay = F.exp(-z * z / 2.0)
    near = decay * _horner(HART_NUM, z) / _horner(HART_DEN, z)
    fraction = z + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = z + F.lit(k) / fraction
    far = decay / fraction / F.lit(ROOT_TWO_PI)
    tail = F.when(z > 37, 0.0).when(z < HART_SWITCH, near).otherwise(far)
    return F.when(x > 0, 1.0 - tail).otherwise(tail)


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters cannot pull apart.

    A filter on a plain computed column is pushed below it with the whole
    expression written out at each mention; long formulas then outgrow code
    generation. Filters are not pushed into what a generator makes.
    """
    made = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    kept = [c for c in df.columns if c not in columns]
    return df.withColumn("_made", made).select(*kept, *[F.col(f"_made.{n}").alias(n) for n in columns])


def with_greeks(df: DataFrame, years: Column, iv: Column, rate: float, dividend: float = 0.0,
                invalid: float | None = None) -> DataFrame:
    """Add Black-Scholes `delta` and per-day `theta`.

    Rows without usable inputs get `invalid` for both.
    """
    usable = F.coalesce((F.col("spot") > 0) & (F.col("strike") > 0) & (years > 0) & (iv > 0), F.lit(False))
    fallback = F.lit(invalid).cast("double")
    spot = F.when(usable, F.col("spot"))
    keep = F.exp(F.lit(-dividend) * F.col("_t"))
    discount = F.exp(F.lit(-rate) * F.col("_t"))
    deviation = F.col("_v") * F.sqrt("_t")
    staged = df.withColumns({"_s": spot, "_t": years, "_v": iv, "_call": F.col("option_type") == "call"})
    staged = staged.withColumn("_d1", F.when(usable, (
        F.ln(F.col("_s") / F.col("strike"))
        + (rate - dividend + 0.5 * F.col("_v") * F.col("_v")) * F.col("_t")) / deviation))
    staged = staged.withColumns({"_n1": norm_cdf(F.col("_d1")),
                                 "_n2": norm_cdf(F.col("_d1") - deviation)})
    decay = F.col("_s") * keep * norm_pdf(F.col("_d1")) * F.col("_v") / (2.0 * F.sqrt("_t"))
    carry = rate * F.col("strike") * discount
    yield_ = dividend * F.col("_s") * keep
    call_theta = -decay - carry * F.col("_n2") + yield_ * F.col("_n1")
    put_theta = -decay + carry * (1.0 - F.col("_n2")) - yield_ * (1.0 - F.col("_n1"))
    delta = keep * (F.col("_n1") - F.when(F.col("_call"), 0.0).otherwise(1.0))
    theta = F.when(F.col("_call"), call_theta).otherwise(put_theta) / 365.0
    ready = F.col("_d1").isNotNull()
    made = computed_once(staged, {"delta": F.when(ready, delta).otherwise(fallback),
                                  "theta": F.when(ready, theta).otherwise(fallback)})
    return made.drop("_s", "_t", "_v", "_call", "_d1", "_n1", "_n2")
