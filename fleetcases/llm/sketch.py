"""Count-min sketch over 64-bit keys, built per partition and merged by Spark.

Two rows of cells; a key's estimate is the smaller of its two cells, so it never is below the
true count. What later passes need of the merged sketch is only whether an estimate reaches a
level, one bit per cell; its size is ``2 * cells / 8`` bytes per level, bounded by ``MAX_CELLS``
whatever the input. With more keys than cells the estimates only get larger: nothing is lost,
the exact second pass gets more to group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetcases.llm.common import U, mix, pack, unpack

#: cells of a row at most: 2 rows of 2^28 bits are 64 MB
MAX_CELLS = 1 << 28
CHUNK = 1 << 20
ROWS_SCHEMA = "chunk long, part long, ones binary, many binary, counts binary"


def cells_for(n_keys: int) -> int:
    """Cells of a row for about ``n_keys`` keys: four a key, a power of two, within MAX_CELLS."""
    return min(MAX_CELLS, max(CHUNK, 1 << max(0, 4 * n_keys - 1).bit_length()))


def cells_of(keys: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each key in either row."""
    a = mix(keys + U(0x51ED270B)) & U(cells - 1)
    b = (mix(keys ^ U(0xA24BAED4963EE407)) & U(cells - 1)) + U(cells)
    return a, b


class PartitionSketch:
    """Cells that the keys of a partition fall into, with counts; kept sparse and folded as they
    grow, so memory follows the distinct cells of one partition."""

    def __init__(self, cells: int, fold: int = 4_000_000):
        self.cells, self.fold = cells, fold
        self.new: list[np.ndarray] = []
        self.size = 0
        self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        self.new += cells_of(keys, self.cells)
        self.size += 2 * len(keys)
        if self.size > self.fold:
            self._fold()

    def _fold(self) -> None:
        at, n = np.unique(np.concatenate(self.new), return_counts=True) if self.new else (
            np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if len(self.at):
            both = np.concatenate([self.at, at])
            at, back = np.unique(both, return_inverse=True)
            n = np.bincount(back, np.concatenate([self.n, n])).astype(np.int64)
        self.at, self.n, self.new, self.size = at, n, [], 0

    def rows(self, part: int) -> Iterator[dict]:
        """One row per chunk of cells with a hit: cells hit once, cells hit more and how often."""
        self._fold()
        chunk = (self.at // U(CHUNK)).astype(np.int64)
        for c in np.unique(chunk):
            lo, hi = np.searchsorted(chunk, [c, c + 1])
            at, n = (self.at[lo:hi] % U(CHUNK)).astype(np.uint32), self.n[lo:hi]
            one = n == 1
            yield {"chunk": int(c), "part": part, "ones": pack(np.diff(at[one], prepend=np.uint32(0))),
                   "many": pack(np.diff(at[~one], prepend=np.uint32(0))),
                   "counts": pack(np.minimum(n[~one], 2**31).astype(np.uint32))}


def _sum(pdf: pd.DataFrame) -> np.ndarray:
    total = np.zeros(CHUNK, np.uint32)
    for ones, many, counts in zip(pdf["ones"], pdf["many"], pdf["counts"], strict=True):
        total[np.cumsum(unpack(ones, np.uint32), dtype=np.uint32)] += np.uint32(1)
        total[np.cumsum(unpack(many, np.uint32), dtype=np.uint32)] += unpack(counts, np.uint32)
    return total


def merge(rows: DataFrame, cells: int, levels: tuple[int, ...]) -> list[np.ndarray]:
    """Sum the partition sketches chunk by chunk and return, for each level, the bits of the
    cells that reach it. Partitions are summed in groups first, so no task holds the rows of
    all partitions; the driver gets the bits alone (bounded by MAX_CELLS)."""
    groups = 8

    def first(key, pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.flatnonzero(t := _sum(pdf)).astype(np.uint32)
        n, one = t[at], t[at] == 1
        return pd.DataFrame({"chunk": [key[0]], "part": [0], "ones": [pack(np.diff(at[one], prepend=np.uint32(0)))],
                             "many": [pack(np.diff(at[~one], prepend=np.uint32(0)))], "counts": [pack(n[~one])]})

    def last(key, pdf: pd.DataFrame) -> pd.DataFrame:
        total = _sum(pdf)
        return pd.DataFrame({"chunk": [key[0]], "bits": [pack(np.concatenate(
            [np.packbits(total >= n, bitorder="little") for n in levels]))]})

    n_parts = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    if int(n_parts) > groups * 8:
        rows = rows.groupBy("chunk", F.pmod("part", F.lit(groups)).alias("g")).applyInPandas(
            lambda key, pdf: first(key, pdf), ROWS_SCHEMA)
    out = [np.zeros(2 * cells // 8, np.uint8) for _ in levels]
    size = CHUNK // 8
    for r in rows.groupBy("chunk").applyInPandas(last, "chunk long, bits binary").collect():
        bits = unpack(bytes(r["bits"]), np.uint8)
        for k in range(len(levels)):
            out[k][r["chunk"] * size:(r["chunk"] + 1) * size] = bits[k * size:(k + 1) * size]
    return out


def reaches(bits: np.ndarray, keys: np.ndarray, cells: int) -> np.ndarray:
    """Whether the estimate of each key reaches the level of ``bits``."""
    a, b = cells_of(keys, cells)

    def on(c):
        return (bits[(c >> U(3)).astype(np.int64)] >> (c & U(7)).astype(np.uint8)) & np.uint8(1)
    return (on(a) & on(b)).astype(bool)
