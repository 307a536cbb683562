"""Column functions: similarity normalisation, superposition scale, combined score and divergences."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
S0, TM0, FAR = 0.05, 0.167, 10.0
PC_LOADS = {"n_ali": 0.80, "si": 0.85, "tm": 0.92, "co": 0.97}
Q_MEAN = (0.386, -0.547)
Q_DEVIATION = (1.327, -0.673)
Q_MOST, L_FAR = 0.25, 2000.0

PC_SUM = sum(PC_LOADS.values())


def shorter(l1: Column, l2: Column, norm: str = "min") -> Column:
    """Length that counts are divided by: min, max or the whole part of the geometric mean."""
    if norm == "min":
        return F.least(l1, l2)
    if norm == "max":
        return F.greatest(l1, l2)
    return F.floor(F.sqrt(l1 * l2))


def tm_scale2(length: Column) -> Column:
    """Square of the distance scale of the superposition score; null for chains of 15 residues or fewer."""
    d0 = F.lit(1.24) * F.cbrt(length - F.lit(15.0)) - F.lit(1.8)
    return F.when((length > 15) & (d0 > 0), d0 * d0)


def divergence(s: Column, s0: Column | float, far: float = FAR) -> Column:
    """-ln((s - s0) / (1 - s0)), at most far; far where s does not exceed s0."""
    base = F.lit(s0) if isinstance(s0, float) else s0
    return F.when(s > base, F.least(-F.log((s - base) / (F.lit(1.0) - base)), F.lit(far))).otherwise(F.lit(far))


def random_overlap(length: Column) -> Column:
    """Contact overlap expected of unrelated chains."""
    return F.lit(Q_MEAN[0]) * F.pow(length, F.lit(Q_MEAN[1]))


def contact_divergence(q: Column, length: Column) -> Column:
    mean, dev = random_overlap(length), F.lit(Q_DEVIATION[0]) * F.pow(length, F.lit(Q_DEVIATION[1]))
    floor = F.least(mean, F.lit(Q_MOST))
    far_dev, far_mean = Q_DEVIATION[0] * L_FAR ** Q_DEVIATION[1], Q_MEAN[0] * L_FAR ** Q_MEAN[1]
    start = 1.0 - math.log(far_dev) + math.log(1.0 - far_mean)
    return F.when(q > floor + dev, -F.log((q - floor) / (F.lit(1.0) - floor))).otherwise(F.lit(start) - (q - mean) / dev)


def combined_score(n_ali: Column, si: Column, tm: Column, co: Column) -> Column:
    return sum((F.lit(w) * c for w, c in zip(PC_LOADS.values(), (n_ali, si, tm, co), strict=True)), F.lit(0.0)) / F.lit(PC_SUM)


def combined_divergence(pc: Column, n_ali: Column, length: Column) -> Column:
    """Divergence of the combined score; the aligned fraction is subtracted without its weight, as defined."""
    rest = PC_SUM - PC_LOADS["n_ali"]
    floor = (F.lit(PC_LOADS["si"] * S0 + PC_LOADS["tm"] * TM0) + F.lit(PC_LOADS["co"]) * F.least(random_overlap(length), F.lit(Q_MOST))) / F.lit(rest)
    return divergence((pc * F.lit(PC_SUM) - n_ali) / F.lit(rest), floor)


def binomial(count: Column, total: Column) -> tuple[Column, Column, Column]:
    """Frequency, its squared relative error and its standard error; 0, 1 and 0 where nothing was counted."""
    p = F.when(total > 0, count / total).otherwise(F.lit(0.0))
    relative = F.when(count > 0, (F.lit(1.0) - p) / count).otherwise(F.lit(1.0))
    return p, relative, F.when(count > 0, p * F.sqrt(relative)).otherwise(F.lit(0.0))


def mean_error(values: Column, n_independent: Column) -> Column:
    """Standard error of a mean of values (an aggregate) over a number of independent ones."""
    return F.sqrt(F.greatest(F.avg(values * values) - F.avg(values) * F.avg(values), F.lit(0.0)) / n_independent)


def domain_fragments(domain: Column) -> Column:
    """'1-186,285-327' as an array of (ini, end); fails where a fragment is not two numbers."""
    parts = F.split(domain, ",")
    well = F.forall(parts, lambda p: F.regexp_like(p, F.lit(r"^\d+-\d+$")))
    pairs = F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("-"), F.lit(1)).cast("int").alias("ini"), F.split_part(p, F.lit("-"), F.lit(2)).cast("int").alias("end")))
    return F.when(well, pairs).when(domain.isNotNull(), F.raise_error(F.concat(F.lit("not a domain: "), domain)).cast("array<struct<ini:int,end:int>>"))


def in_fragments(position: Column, fragments: Column) -> Column:
    return F.exists(fragments, lambda f: position.between(f["ini"], f["end"]))


def leading_number(label: Column) -> Column:
    """Leading integer of a residue label, null if it has none."""
    return F.nullif(F.regexp_extract(label, r"^\d+", 0), F.lit("")).cast("int")


def equivalent(a: Column, b: Column) -> Column:
    """Residues that are equal or either unknown."""
    return (a == b) | (a == "X") | (b == "X")


def ungapped(sequence: Column, gap: str = "-") -> Column:
    return F.replace(sequence, F.lit(gap), F.lit(""))


def path_stem(path: Column) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def gap_cost(open_cost: float, extend: float, length: Column) -> Column:
    return F.lit(open_cost) + F.lit(extend) * length
