"""Numbers: six significant digits and Tukey fences over exact quantiles (type 7)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import stage

FENCE = 1.5


@F.pandas_udf(T.DoubleType())
def _six(x: pd.Series) -> pd.Series:
    return x.map(lambda v: float(f"{v:.6g}"), na_action="ignore")


def sig6(x: Column) -> Column:
    """Six significant digits of the exact binary value, ties to even digits, as C prints them: the JVM's own
    formatter rounds the shortest decimal text half up."""
    return F.when(x.isNotNull(), _six(x.cast("double")))


def fences(df: DataFrame, keys: list[str], value: str, k: float = FENCE, name: str = "fence") -> DataFrame:
    """keys, <name>_low, <name>_high: Q1 - k*IQR and Q3 + k*IQR of value."""
    return fences_of(df, keys, {name: value}, k)


def fences_of(df: DataFrame, keys: list[str], values: dict[str, str], k: float = FENCE) -> DataFrame:
    """keys, and for each name -> value <name>_low, <name>_high, in one aggregate. Nulls don't count."""
    df = df.groupBy(*keys).agg(*(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias(f"__{name}") for name, value in values.items()))
    out = []
    for name in values:
        q1, q3 = F.col(f"__{name}")[0], F.col(f"__{name}")[1]
        out += [(q1 - k * (q3 - q1)).alias(f"{name}_low"), (q3 + k * (q3 - q1)).alias(f"{name}_high")]
    return df.select(*keys, *out)


#: Relative error of the ranks that brackets are made from; a bracket reaches twice as far to either side.
RANK_ERROR = 1e-4


def grouped_quantiles(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float], others: list[Column], error: float = RANK_ERROR) -> DataFrame:
    """keys, the aggregates `others`, and for each name -> p the exact quantile (type 7) of value, for few groups of
    any size. rows are read three times and should be written. Nulls don't count, NaN is greatest.

    An aggregate of bounded size brackets each quantile; then the rows below each bracket are counted, and only
    the values inside are ranked. Where a count shows that a bracket misses its ranks, it is opened to all values.
    """
    names = list(probs)
    ends = [min(max(probs[x] + s * 2 * error, 0.0), 1.0) for x in names for s in (-1, 1)]
    cuts = F.percentile_approx(value, F.array(*map(F.lit, ends)), F.lit(int(1 / error)))
    head = stage(rows.groupBy(*keys).agg(*others, F.count(value).alias("__n"), cuts.alias("__c")), "brackets")
    null_safe = lambda a, b: [a[k].eqNullSafe(b[f"{k}__r"]) for k in keys]

    def beside(left, right):
        right = right.withColumnsRenamed({k: f"{k}__r" for k in keys})
        on = F.lit(True)
        for same in null_safe(left, right):
            on = on & same
        return left.join(F.broadcast(right), on).drop(*(f"{k}__r" for k in keys))

    met = beside(rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v")), head.select(*keys, "__c"))
    lo, hi = (lambda k: F.col("__c")[2 * k]), (lambda k: F.col("__c")[2 * k + 1])
    tests = [x for k in range(len(names)) for x in (F.count(F.when(F.col("__v") < lo(k), 1)), F.count(F.when(F.col("__v") <= hi(k), 1)))]
    counts = stage(met.groupBy(*keys).agg(F.array(*tests).alias("__b")), "below")
    limits = []
    for k, x in enumerate(names):
        pos = F.lit(probs[x]) * (F.col("__n") - 1)
        fits = (F.col("__b")[2 * k] <= F.floor(pos)) & (F.ceil(pos) < F.col("__b")[2 * k + 1])
        limits.append(F.struct(F.lit(x).alias("q"), pos.alias("pos"), fits.alias("fits"), lo(k).alias("lo"), hi(k).alias("hi"), F.when(fits, F.col("__b")[2 * k]).otherwise(0).alias("below")))
    limits = stage(beside(head.select(*keys, "__n", "__c"), counts).select(*keys, F.array(*limits).alias("__o")), "limits")
    inside = beside(rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v")), limits)
    taken = lambda o: ~o["fits"] | ((F.col("__v") >= o["lo"]) & (F.col("__v") <= o["hi"]))
    inside = inside.filter(F.exists("__o", taken)).groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__k"))
    inside = beside(inside, limits).select(*keys, "__v", "__k", F.explode(F.filter("__o", taken)).alias("o")).select(*keys, "__v", "__k", "o.*")
    upto = F.col("below") + F.sum("__k").over(Window.partitionBy(*keys, "q").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("__u", upto)
    at = lambda rank: F.min(F.when(F.col("__u") > rank, F.col("__v")))
    found = inside.groupBy(*keys, "q", "pos").agg(at(F.floor("pos")).alias("a"), at(F.ceil("pos")).alias("b"))
    low = F.floor("pos")
    exact = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise((low + 1 - F.col("pos")) * F.col("a") + (F.col("pos") - low) * F.col("b"))
    wide = found.select(*keys, "q", exact.alias("x")).groupBy(*keys).agg(*(F.max(F.when(F.col("q") == x, F.col("x"))).alias(x) for x in names))
    wide = wide.withColumnsRenamed({k: f"{k}__r" for k in keys})
    on = F.lit(True)
    for same in null_safe(head, wide):
        on = on & same
    return head.drop("__n", "__c").join(wide, on, "left").drop(*(f"{k}__r" for k in keys))
