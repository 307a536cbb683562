"""Counts of paired states, their ratios and propensities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidwork.functions.scores import binomial


def contingency(df: DataFrame, a: str, b: str, bin_of: Column) -> DataFrame:
    """(bin, a, b, n): how often each pair of states occurs in each bin."""
    return df.groupBy(bin_of.alias("bin"), F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def propensities(counts: DataFrame, least: int = 1) -> DataFrame:
    """(bin, a, b, n, propensity): ln(N n_ab / (F_a F_b)) of symmetrised counts; -ln 10 for pairs that never occur.

    Bins with fewer than least pairs are left out."""
    both = counts.unionByName(counts.select("bin", F.col("b").alias("a"), F.col("a").alias("b"), "n")).groupBy("bin", "a", "b").agg(F.sum("n").alias("n"))
    states = both.select("bin", "a").distinct()
    grid = states.join(states.withColumnRenamed("a", "b"), "bin").join(both, ["bin", "a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    of_a, of_b, of_bin = (F.sum("n").over(Window.partitionBy("bin", *c)) for c in (["a"], ["b"], []))
    filled = grid.withColumn("fa", of_a).withColumn("fb", of_b).withColumn("total", of_bin).where(F.col("total") >= 2 * least)
    # products of two counts are beyond a long
    n, total, fa, fb = (F.col(c).cast("double") for c in ("n", "total", "fa", "fb"))
    value = F.when(F.col("n") > 0, F.log(total * n / (fa * fb))).otherwise(-F.log(F.lit(10.0)))
    return filled.select("bin", "a", "b", "n", value.alias("propensity"))


def frequencies(df: DataFrame, keys: list[str], test: Column) -> DataFrame:
    """keys, n, hits, p, relative2 and se of a binomial frequency."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(test).alias("hits"))
    return counted_frequencies(counted, keys)


def counted_frequencies(counted: DataFrame, keys: list[str]) -> DataFrame:
    """frequencies of what is counted already: (keys, n, hits)."""
    p, relative, se = binomial(F.col("hits"), F.col("n"))
    return counted.select(*keys, "n", "hits", p.alias("p"), relative.alias("relative2"), se.alias("se"))


def ratios(frequency: DataFrame, key: str, base: str) -> DataFrame:
    """Each key's frequency over that of the base key, with the error of a ratio of independent frequencies."""
    first = frequency.where(F.col(key) == base).select(F.col("p").alias("bp"), F.col("relative2").alias("b2"))
    ratio = F.when(F.col("bp") > 0, F.col("p") / F.col("bp"))
    return frequency.join(F.broadcast(first), F.lit(True)).select(key, ratio.alias("ratio"), (ratio * F.sqrt(F.col("relative2") + F.col("b2"))).alias("se"))  # first is one row


def conserved_cube(df: DataFrame, kind: str, contact_class: Column, share: Column, same: Column) -> DataFrame:
    """Counters for each combination of kind, class and share bin, and for all marginals (grouping tells which)."""
    rows = df.select(F.col(kind).alias("kind"), contact_class.alias("class"), F.least(F.floor(share * 10), F.lit(10)).cast("int").alias("bin"), same.cast("int").alias("same"))
    return rows.cube("kind", "class", "bin").agg(F.grouping_id().cast("long").alias("grouping"), F.count(F.lit(1)).alias("n"), F.sum("same").alias("n_same"))


def histogram(values: DataFrame, value: str, width: float, bins: int) -> DataFrame:
    """(bin, n, total): values by bin of a width, the last bin open."""
    return values.groupBy(F.least(F.floor(F.col(value) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def adaptive_bins(binned: DataFrame, least: int = 90) -> DataFrame:
    """(first_bin, last_bin, n, mean): neighbouring bins joined until each holds at least so many values; what is left
    at the end is dropped. binned is a histogram, so one array holds it whatever the input."""
    rows = binned.agg(F.array_sort(F.collect_list(F.struct("bin", "n", "total"))).alias("rows"))
    done = F.array().cast("array<struct<first_bin:int,last_bin:int,n:bigint,mean:double>>")
    start = F.struct(F.lit(None).cast("int").alias("first"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("total"), done.alias("done"))

    def step(acc: Column, b: Column) -> Column:
        n, total, first = acc["n"] + b["n"], acc["total"] + b["total"], F.coalesce(acc["first"], b["bin"])
        full = n >= least
        out = F.array(F.struct(first.alias("first_bin"), b["bin"].alias("last_bin"), n.alias("n"), (total / n).alias("mean")))
        return F.struct(
            F.when(full, F.lit(None).cast("int")).otherwise(first).alias("first"),
            F.when(full, F.lit(0).cast("long")).otherwise(n).alias("n"),
            F.when(full, F.lit(0.0)).otherwise(total).alias("total"),
            F.when(full, F.concat(acc["done"], out)).otherwise(acc["done"]).alias("done"),
        )

    return rows.select(F.inline(F.aggregate("rows", start, step, lambda acc: acc["done"])))


def log_log_fit(df: DataFrame, y: str, x: str, group: str) -> DataFrame:
    """Least squares of ln|y| on ln x in each group: slope, intercept, r."""
    rows = df.where((F.col(x) > 0) & (F.col(y) != 0)).select(group, F.log(F.abs(F.col(y))).alias("ly"), F.log(x).alias("lx"))
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.regr_slope("ly", "lx").alias("slope"), F.regr_intercept("ly", "lx").alias("intercept"), F.corr("ly", "lx").alias("r"))


def in_band(value: Column, low: float, high: float) -> Column:
    """Values from low to high, and unknown ones."""
    return value.isNull() | value.between(low, high)


def scaled_violations(df: DataFrame, exponents: tuple[float, ...], bin_of: Column, least: float = 0.15) -> DataFrame:
    """(bin, exponent, n, mean, se, significant): mean of |cv| / d ** exponent in each bin with its error, and how many
    of them are significant: acc ** 2 * (1 - 1 / t ** 2) above least ** 2. df: (cv, d, t)."""
    rows = df.where((F.col("d") > 0) & F.col("cv").isNotNull()).select(bin_of.alias("bin"), "cv", "d", "t", F.explode(F.array(*[F.lit(float(e)) for e in exponents])).alias("exponent"))
    acc = F.abs(F.col("cv")) / F.pow("d", "exponent")
    rows = rows.withColumn("acc", acc)
    sure = F.when(F.col("t") != 0, F.col("acc") * F.col("acc") * (F.lit(1.0) - F.lit(1.0) / (F.col("t") * F.col("t")))) > least * least
    n = F.count(F.lit(1))
    variance = F.greatest(F.avg(F.col("acc") * F.col("acc")) - F.avg("acc") * F.avg("acc"), F.lit(0.0))
    return rows.groupBy("bin", "exponent").agg(n.alias("n"), F.avg("acc").alias("mean"), F.when(n > 1, F.sqrt(variance / (n - 1))).otherwise(F.lit(0.0)).alias("se"), F.count_if(sure).alias("significant"))


def best_round(totals: DataFrame, group: str, name: str, total: str) -> DataFrame:
    """(group, name, total): the round of the greatest total, the first by name of equals."""
    order = Window.partitionBy(group).orderBy(F.desc(total), name)
    return totals.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(group, name, total)


def top(df: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k rows in the order of keys, highest first in the first of them."""
    return df.orderBy(F.desc(keys[0]), *keys[1:]).limit(k)


def top_in_groups(df: DataFrame, group: str, keys: list[str], k: int) -> DataFrame:
    """df with r, the place of a row in its group in the order of keys (highest first in the first), up to k."""
    order = Window.partitionBy(group).orderBy(F.desc(keys[0]), *keys[1:])
    return df.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def set_parts(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("first", "second")) -> DataFrame:
    """(op, columns): union, intersection and both differences of two tables of equal columns, as sets."""
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), f"{names[0]}_only": a.subtract(b), f"{names[1]}_only": b.subtract(a)}
    out = None
    for op, df in parts.items():
        rows = df.select(F.lit(op).alias("op"), *a.columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def inside(df: DataFrame, key: str, value: str, test: Column) -> DataFrame:
    """(key, inside, n): whether all values of a key also occur where test holds, and how many different ones there are."""
    sets = df.groupBy(key).agg(F.collect_set(value).alias("all"), F.collect_set(F.when(test, F.col(value))).alias("some"))
    return sets.select(key, (F.size(F.array_except("all", "some")) == 0).alias("inside"), F.size("all").alias("n"))
