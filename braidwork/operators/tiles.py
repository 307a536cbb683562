"""Work on all pairs of a family as arrays: families are dealt into tiles, and two tiles meet in one group.

A group holds at most two tiles, so tasks stay small however large a family is, and each chain is turned into an array
once a group instead of once a pair.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Context, Decimal
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most chains of a tile, and pairs that are computed at once.
TILE, AT_ONCE = 256, 4096
#: Most chains of a tile where a group gives its pairs block by block or only sums of them, and chains of a side of a block.
#: Chains are sent to as many groups as their family has tiles, so wide tiles send few copies.
WIDE, BLOCK = 2048, 128
#: Partitions for each group, so that few groups share one, and most of them: every task reports to the driver.
SPREAD, MOST_PARTITIONS = 2, 2_000
#: A tile that holds any family, and the column that tells groups with the same tiles apart.
WHOLE, SHARE = 2**31 - 1, ["share"]


def dealt(chains: DataFrame, *columns: str, tile: int = TILE) -> DataFrame:
    """(family, low, high, tile, chain, columns): each chain goes to every pair of tiles that its own is one of."""
    sizes = chains.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    rows = chains.join(sizes, "family").withColumn("tile", F.pmod(F.xxhash64("chain"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return rows.select("family", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "chain", *columns)


@dataclass
class Tiles:
    """Chains of one or two tiles as arrays, padded with nan and -1 (elements, where there are any: 0) to the longest.
    Pairs are those of the tiles, unless their rows are given."""

    family: int
    chain: np.ndarray
    xyz: np.ndarray
    kind: np.ndarray
    ss: np.ndarray
    length: np.ndarray
    table: pa.Table
    rows: np.ndarray | None = None
    others: np.ndarray | None = None
    tile: np.ndarray | None = None

    @cached_property
    def _both(self) -> tuple[np.ndarray, np.ndarray]:
        if self.rows is not None:
            return self.rows, self.others
        same = (self.tile == self.tile[0]).all() and self.table.column("low")[0].as_py() == self.table.column("high")[0].as_py()
        return np.nonzero((self.chain[:, None] > self.chain[None, :]) & (same | (self.tile[:, None] != self.tile[None, :])))

    @property
    def first(self) -> np.ndarray:
        return self._both[0]

    @property
    def second(self) -> np.ndarray:
        return self._both[1]

    @cached_property
    def planes(self) -> np.ndarray:
        """Coordinates as (residue, axis, chain)."""
        return np.ascontiguousarray(self.xyz.transpose(1, 2, 0))

    @cached_property
    def holes(self) -> np.ndarray:
        """(residue, chain): where there are no coordinates."""
        return np.isnan(self.planes).any(axis=1)

    def blocks(self, label: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """Rows of two sides, and which of their pairs count (None: all of them): every pair of the group once, in either
        order. With labels, all rows of a side have the same one."""
        low, high = self.table.column("low")[0].as_py(), self.table.column("high")[0].as_py()

        def sides(tile: int) -> list[np.ndarray]:
            rows = np.flatnonzero(self.tile == tile)
            parts = [rows] if label is None else [rows[label[rows] == v] for v in np.unique(label[rows])]
            return [part[k : k + BLOCK] for part in parts for k in range(0, len(part), BLOCK)]

        one = sides(low)
        two = one if low == high else sides(high)
        for x, a in enumerate(one):
            for b in two[: x + 1] if low == high else two:
                if low == high and (a is b or self.chain[a].min() <= self.chain[b].max()):
                    # rows of equal chains are no pair
                    differ = self.chain[a][:, None] > self.chain[b][None] if a is b else self.chain[a][:, None] != self.chain[b][None]
                    yield a, b, differ
                else:
                    yield a, b, None

    def named(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The greater and the smaller chain of each pair of a block."""
        one, two = self.chain[a][:, None], self.chain[b][None]
        return np.maximum(one, two), np.minimum(one, two)

    def pairs(self, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of both chains of each pair, the greater chain first."""
        for k in range(0, len(self.first), at_once):
            yield self.first[k : k + at_once], self.second[k : k + at_once]


def padded(lists: pa.Array, values: np.ndarray, width: int, fill) -> np.ndarray:
    """List values of each row in one array, filled up to width."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.full((len(lists), width), fill, values.dtype)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def tiles_of(table: pa.Table) -> Tiles:
    table = table.combine_chunks()
    chain, tile = table.column("chain").to_numpy(), table.column("tile").to_numpy()
    n = len(chain)
    xyz, kind, ss, length = np.zeros((n, 0, 3)), np.zeros((n, 0), np.int64), np.zeros((n, 0), np.int64), np.zeros(n, np.int64)
    if "residues" in table.column_names:
        lists = pa.concat_arrays(table.column("residues").chunks)
        lists = lists.cast(lists.type) if lists.offset == 0 else pa.concat_arrays([lists])
        fields, length = lists.flatten(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
        width = int(length.max(initial=0))
        held = [f.name for f in fields.type]
        if "x" in held:
            xyz = np.stack([padded(lists, fields.field(c).to_numpy(zero_copy_only=False).astype(float), width, np.nan) for c in "xyz"], axis=2)
        kind = padded(lists, fields.field("aa").to_numpy(zero_copy_only=False).astype(np.int64), width, -1)
        ss = padded(lists, fields.field("ss").to_numpy(zero_copy_only=False).astype(np.int64), width, 0) if "ss" in held else np.zeros_like(kind)
    return Tiles(table.column("family")[0].as_py(), chain, xyz, kind, ss, length, table, tile=tile)


def over_pairs(chains: DataFrame, columns: list[str], run: Callable[[Tiles], dict[str, np.ndarray]] | Callable[[Tiles], Iterator[dict[str, np.ndarray]]], schema: str, tile: int = TILE, shares: int = 1) -> DataFrame:
    """run on the tiles of each group; its arrays are the columns of schema (name type, ...), without family and with it
    put first. A generator gives them part by part, so that no group holds all of its pairs. Chains of a null family are
    in no pair. With shares, every group is there so many times, and the column share of its table tells which one it is."""
    order = [("tile", "ascending"), ("chain", "ascending")]

    def columns_of(t: Tiles, out: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        n = len(next(iter(out.values())))
        return {"family": pa.array(np.full(n, t.family), pa.int32())} | {k: v if isinstance(v, pa.Array) else pa.array(v) if isinstance(v, list) else pa.array(np.ascontiguousarray(v)) for k, v in out.items()}

    def whole(table: pa.Table) -> pa.Table:
        t = tiles_of(table.sort_by(order))
        return pa.table(columns_of(t, run(t)))

    def by_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tiles_of(pa.Table.from_batches(list(batches)).sort_by(order))
        for out in run(t):
            yield pa.RecordBatch.from_pydict(columns_of(t, out))

    work = by_parts if inspect.isgeneratorfunction(run) else whole

    rows = chains.where(F.col("family").isNotNull()).withColumn("family", F.col("family").cast("int"))
    return by_tiles(rows, columns, tile, shares).groupBy("family", "low", "high", *SHARE[:shares > 1]).applyInArrow(work, f"family int, {schema}")


def by_tiles(rows: DataFrame, columns: list[str], tile: int = TILE, shares: int = 1) -> DataFrame:
    """dealt, over a number of partitions that follows the number of groups: their work grows with the pairs, not with
    the bytes that partitions would be merged by."""
    tiles = F.ceil(F.count(F.lit(1)) / tile)
    groups = rows.groupBy("family").agg((tiles * (tiles + 1) / 2).alias("groups")).agg(F.sum("groups")).first()[0] or 1
    found = dealt(rows, *columns, tile=tile)
    if shares > 1:
        found = found.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    return found.repartition(min(max(int(groups), 1) * shares * SPREAD, MOST_PARTITIONS), "family", "low", "high", *SHARE[:shares > 1])


def rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """values as Spark's round gives them: halves of their shortest decimals go away from zero. Only values so near to a
    half that doubles can't tell are taken as decimals."""
    unit = 10.0**digits
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.abs(values) * unit
        whole = np.floor(scaled)
        rest = scaled - whole
        out = np.copysign((whole + (rest >= 0.5)) / unit, values) + 0.0
        near = np.flatnonzero((np.abs(rest - 0.5) <= scaled * 2.0**-51) & np.isfinite(values))
    if len(near):
        different, at = np.unique(values.flat[near], return_inverse=True)
        most, step = Context(prec=400), Decimal(1).scaleb(-digits)
        out.flat[near] = np.array([float(Decimal(repr(v)).quantize(step, ROUND_HALF_UP, most)) + 0.0 for v in different.tolist()])[at]
    return out


def joined(parts: list[dict[str, np.ndarray]], empty: dict[str, type]) -> dict[str, np.ndarray]:
    """Parts of columns put one after another."""
    return {k: np.concatenate([p[k] for p in parts]).astype(t) if parts else np.zeros(0, t) for k, t in empty.items()}
