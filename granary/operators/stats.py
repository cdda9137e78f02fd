"""Summaries, percentiles, entropy, signatures, fits and cost integrals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(c: str, p: float) -> Column:
    """The value at rank ceil(p n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {c})")


def spread(df: DataFrame, by: list[str], c: str) -> DataFrame:
    """n, median, least, most, mean, population deviation, its percentage of the mean, and whether that is over 10."""
    out = df.groupBy(*by).agg(
        F.count(c).alias("n"), F.median(c).alias("median"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd")
    )
    cv = F.coalesce(F.try_divide(100 * F.col("sd"), F.col("mean")), F.lit(0.0))
    return out.withColumn("cv", cv).withColumn("unstable", cv > 10)


def percentiles(df: DataFrame, by: list[str], c: str) -> DataFrame:
    return df.groupBy(*by).agg(*[nearest_rank(c, p).alias(name) for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))])


def run_summary(runs: DataFrame) -> DataFrame:
    """Per group without its base row (index 0): errors apart, sums of the rest; packed is null unless every row has it."""
    held = runs.filter("index <> 0")
    ok = F.col("status") != "error"
    total = lambda c: F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c)
    return held.groupBy("family", "format", "rep").agg(
        F.count(F.when(~ok, 1)).alias("errors"), F.count(F.when(ok, 1)).alias("revisions"), total("logical"), total("incremental"), F.when(F.bool_and(F.col("packed").isNotNull()), F.sum("packed")).alias("packed")
    )


def entropy_bytes(df: DataFrame, by: list[str], symbol: Column) -> DataFrame:
    """Order-0 entropy of the symbols of each group, in bytes: -sum(c log2(c / n)) / 8."""
    counts = df.groupBy(*by, symbol.alias("__s")).agg(F.count("*").alias("c"))
    totals = F.sum("c").over(Window.partitionBy(*by))
    part = counts.withColumn("h", -F.col("c") * F.log2(F.col("c") / totals) / 8)
    return part.groupBy(*by).agg(F.sum("h").alias("entropy"), F.sum("c").alias("n"))


def conditional_entropy_bytes(df: DataFrame, by: list[str], symbol: Column, above: Column) -> DataFrame:
    """Entropy of symbols given the bit length of the symbol above, seven at most."""
    bits = F.least(F.when(above == 0, 0).otherwise(F.floor(F.log2(above)) + 1), F.lit(7)).cast("int")
    held = entropy_bytes(df.withColumn("__context", bits), [*by, "__context"], symbol)
    return held.groupBy(*by).agg(F.sum("entropy").alias("entropy"), F.sum("n").alias("n"))


def signature(values: Column) -> Column:
    """struct<l1, l2, n> of the finite values of an array: order and layout don't matter."""
    finite = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    held = F.transform(finite, lambda x: x.cast("double"))
    zero = F.lit(0.0)
    return F.struct(F.aggregate(held, zero, lambda a, x: a + F.abs(x)).alias("l1"), F.aggregate(held, zero, lambda a, x: a + x * x).alias("l2"), F.size(held).alias("n"))


def affine_fit(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.count("*").alias("n"))


def plane_fit(df: DataFrame, by: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """(by, a, b, c, n) of least squares ``y = a x1 + b x2 + c`` by its normal equations; null where they have no one solution."""
    held = df.select(*by, *[F.col(v).cast("double").alias(k) for k, v in (("y", y), ("p", x1), ("q", x2))]).filter("y IS NOT NULL AND p IS NOT NULL AND q IS NOT NULL")
    s = lambda e, name: F.sum(e).alias(name)
    p, q, t = F.col("p"), F.col("q"), F.col("y")
    sums = held.groupBy(*by).agg(s(p, "sp"), s(q, "sq"), s(t, "st"), s(p * p, "pp"), s(p * q, "pq"), s(q * q, "qq"), s(p * t, "pt"), s(q * t, "qt"), F.count("*").alias("n"))
    c = {k: F.col(k) for k in ("sp", "sq", "st", "pp", "pq", "qq", "pt", "qt", "n")}
    # about the means: two equations
    pp, pq, qq = c["n"] * c["pp"] - c["sp"] * c["sp"], c["n"] * c["pq"] - c["sp"] * c["sq"], c["n"] * c["qq"] - c["sq"] * c["sq"]
    pt, qt = c["n"] * c["pt"] - c["sp"] * c["st"], c["n"] * c["qt"] - c["sq"] * c["st"]
    det = pp * qq - pq * pq
    a, b = F.when(det != 0, (pt * qq - qt * pq) / det), F.when(det != 0, (qt * pp - pt * pq) / det)
    found = sums.withColumns({"a": a, "b": b})
    return found.select(*by, "a", "b", ((c["st"] - F.col("a") * c["sp"] - F.col("b") * c["sq"]) / c["n"]).alias("c"), "n")


def robust_fit(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """(by, kind, a, c, bits): of identity, least squares, scale alone and offset alone that whose rounded residuals have the fewest bits in all.

    Squared errors are ruled by a few large ones; bits follow the usual value. Ties go by that order.
    """
    held = df.select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")).filter("__x IS NOT NULL AND __y IS NOT NULL")
    u, v = F.col("__x"), F.col("__y")
    n, su, sv, uu, uv = (F.col(f"__{k}") for k in ("n", "su", "sv", "uu", "uv"))
    sums = held.groupBy(*by).agg(F.count("*").alias("__n"), F.sum(u).alias("__su"), F.sum(v).alias("__sv"), F.sum(u * u).alias("__uu"), F.sum(u * v).alias("__uv"))
    den = n * uu - su * su
    slope = F.when(den > 0, (n * uv - su * sv) / den).otherwise(F.lit(1.0))
    one, zero = F.lit(1.0), F.lit(0.0)
    kinds = [("identity", one, zero), ("affine", slope, (sv - slope * su) / n), ("scale", F.when(uu > 0, uv / uu).otherwise(one), zero), ("offset", one, (sv - su) / n)]
    fits = sums.select(*by, *[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), a.alias("a"), c.alias("c")).alias(k) for i, (k, a, c) in enumerate(kinds)])

    def bits(k: str) -> Column:
        r = F.abs(F.round(v - F.col(f"{k}.a") * u - F.col(f"{k}.c"))).cast("long")
        return F.sum(F.when(r > 0, F.length(F.bin(r))).otherwise(0))

    priced = held.join(fits, by).groupBy(*by).agg(*[F.struct(bits(k).alias("bits"), F.first(k).alias("fit")).alias(k) for k, _, _ in kinds])
    best = F.array_min(F.array(*[F.struct(F.col(f"{k}.bits").alias("bits"), F.col(f"{k}.fit").alias("fit")) for k, _, _ in kinds]))
    return priced.select(*by, best.alias("m")).select(*by, "m.fit.kind", "m.fit.a", "m.fit.c", "m.bits")


def cumulative(df: DataFrame, by: list[str], order: list[str], c: str) -> DataFrame:
    return df.withColumn("cumulative", F.sum(c).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def byte_days(sizes: DataFrame, by: list[str], day: str, size: str, order: list[str], horizon: Column) -> DataFrame:
    """Integral of a step function: each size holds from its day to the next one's, the last to the horizon."""
    w = Window.partitionBy(*by).orderBy(day, *order)
    upto = F.coalesce(F.lead(day).over(w), horizon)
    held = sizes.withColumn("__bd", F.col(size) * F.datediff(upto, F.col(day)))
    return held.groupBy(*by).agg(F.sum("__bd").alias("byte_days"))


def storage_price(byte_days: Column, final_bytes: Column, horizon_months: float, dollars_gb_month: float) -> Column:
    return (byte_days / 30 + final_bytes * horizon_months) * dollars_gb_month / 1e9


def compared(df: DataFrame, by: list[str], variant: str, old: str, new: str, c: str) -> DataFrame:
    """Means of two variants side by side and the old over the new."""
    p = df.groupBy(*by).pivot(variant, [old, new]).agg(F.avg(c))
    return p.select(*by, F.col(old).alias("old"), F.col(new).alias("new"), F.try_divide(F.col(old), F.col(new)).alias("speedup"))


def placements(df: DataFrame, by: list[str], c: Column, width: float) -> DataFrame:
    """Histogram with buckets of equal width."""
    return df.groupBy(*by, F.floor(c / width).alias("bucket")).agg(F.count("*").alias("n"))
