"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a hash of the text, so equal texts stand together. Exact bytes below candidate
keys are counted across all partitions, the candidates around each ideal cut are refined until a
cut is close enough or can't be improved, and only then rows are exchanged, once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lettermill.llm.common import prepare, released, stored

SHARDS = 24
#: A cut may be off by this share of a shard's bytes.
TOLERANCE = 0.001
#: Candidates in the first round, and for each cut in each later round.
FIRST_PROBES, PROBES = 2048, 255
#: Refine what would give one task more rows than this.
BLOCK_ROWS = 1_000_000
_TOP = 1 << 128


def _key(h: int, g: int = -(1 << 63)) -> int:
    """A place in the order of (h, g), both signed 64-bit."""
    return (h + (1 << 63)) << 64 | (g + (1 << 63))


def _halves(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([(k >> 64) - (1 << 63) for k in keys], np.int64), np.array([(k & (1 << 64) - 1) - (1 << 63) for k in keys], np.int64))


def locate(bh: np.ndarray, bg: np.ndarray, h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """How many of the sorted boundaries (bh, bg) are at or below each (h, g)."""
    low, high = np.searchsorted(bh, h, "left"), np.searchsorted(bh, h, "right")
    for at in np.unique(low[low < high]):
        rows = np.flatnonzero((low == at) & (high > at))
        low[rows] += np.searchsorted(bg[at : high[rows[0]]], g[rows], "right")
    return low


def _counts(keyed: DataFrame, bounds: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact rows and bytes between neighbouring boundaries."""
    bh, bg = _halves(bounds)

    def run(batches):
        rows, size = np.zeros(len(bh) + 1, np.int64), np.zeros(len(bh) + 1, np.int64)
        for batch in batches:
            at = locate(bh, bg, batch.column(0).to_numpy(), batch.column(1).to_numpy())
            rows += np.bincount(at, minlength=len(rows))
            np.add.at(size, at, batch.column(2).to_numpy())
        used = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(rows[used]), pa.array(size[used])], names=["b", "n", "s"])

    out = np.zeros((2, len(bounds) + 1), np.int64)
    for b, n, s in keyed.select("h", "g", "size").mapInArrow(released(run), "b long, n long, s long").groupBy("b").agg(F.sum("n"), F.sum("s")).collect():
        out[:, b] = n, s
    return out[0], out[1]


def _between(lo: int, hi: int) -> list[int]:
    """Candidates strictly between two keys: other hashes first, then rows within one hash."""
    a, b = lo >> 64, hi >> 64
    if b - a > 1:
        return sorted({(a + (b - a) * i // (PROBES + 1)) << 64 for i in range(1, PROBES + 1)} - {lo, hi, a << 64})
    if b > a and hi != b << 64:
        return [b << 64]
    return sorted({lo + (hi - lo) * i // (PROBES + 1) for i in range(1, PROBES + 1)} - {lo, hi})


@dataclass
class Cuts:
    bounds: list[int]
    rows: np.ndarray
    size: np.ndarray
    #: Of each stretch between boundaries.
    shard: np.ndarray


def find_cuts(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE, block_rows: int = BLOCK_ROWS) -> Cuts:
    """Refine candidates until each cut meets the tolerance or stands between single keys."""
    bounds = sorted({_key(-(1 << 63) + (1 << 64) * i // FIRST_PROBES) for i in range(FIRST_PROBES)})
    while True:
        rows, size = _counts(keyed, bounds)
        below = np.cumsum(size)[:-1]  # bytes below each boundary
        total, n = int(size.sum()), int(rows.sum())
        most = max(block_rows // 100, 4 * n // FIRST_PROBES) if n < 50 * block_rows else block_rows
        add: set[int] = set()
        for k in range(1, shards):
            want = total * k / shards
            at = int(np.searchsorted(below, want, "right"))  # the stretch in which the ideal cut lies
            off = min(abs(below[at - 1] - want) if at else total, abs(below[at] - want) if at < len(below) else total - want)
            if off > tolerance * total / shards and rows[at] > 1:
                add.update(_between(bounds[at - 1] if at else 0, bounds[at] if at < len(bounds) else _TOP))
        for at in np.flatnonzero(rows > most):
            add.update(_between(bounds[at - 1] if at else 0, bounds[at] if at < len(bounds) else _TOP))
        add.difference_update(bounds)
        if not add:
            cut = []
            for k in range(1, shards):
                want = total * k / shards
                at = int(np.searchsorted(below, want, "right"))
                sides = [x for x in (at - 1, at) if 0 <= x < len(below)]
                cut.append(min(sides, key=lambda x: abs(below[x] - want)))
            shard = np.searchsorted(np.array(cut), np.arange(len(bounds) + 1) - 1, "right")
            return Cuts(bounds, rows, size, shard)
        bounds = sorted({*bounds, *add})


def shard_documents(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), tolerance: float = TOLERANCE) -> DataFrame:
    """Place every row in one of ``shards`` shards of near-equal bytes.

    Columns: id, size (UTF-8 bytes of the text, null as none, plus 8), text_crc32, shard, slot
    (gapless from 0 in its shard), equal texts at neighbouring slots, and the columns named in
    ``keep`` (to move the texts themselves, for ``write_shards``). A null text counts as empty.
    Repeated rows stay, each with a slot of its own; null ids are placed like others; an empty
    table gives an empty result; other columns are dropped.
    """
    prepare(df.sparkSession)
    text = F.coalesce(df[text_col], F.lit(""))
    carried = [df[c].alias(f"keep_{i}") for i, c in enumerate(keep)]
    keyed = df.select(
        df[id_col].alias("id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.coalesce(df[id_col].cast("string"), F.lit(""))).alias("g"),
        F.xxhash64(F.monotonically_increasing_id()).alias("r"),
        *carried,
    )
    # repeated rows differ in the last 20 bits, so that no key has to stay whole
    keyed = stored(keyed.withColumn("g", F.shiftleft(F.shiftright("g", 20), 20).bitwiseOR(F.col("r").bitwiseAND(F.lit((1 << 20) - 1)))).drop("r"), "shard-keys")
    cuts = find_cuts(keyed, shards, tolerance)
    bh, bg = _halves(cuts.bounds)
    before = np.concatenate([[0], np.cumsum(cuts.rows)[:-1]])
    first = np.searchsorted(cuts.shard, np.arange(shards), "left")
    base = before - before[np.minimum(first, len(before) - 1)][cuts.shard]
    shard = cuts.shard.astype(np.int32)

    def place(batches):
        for batch in batches:
            at = locate(bh, bg, batch.column("h").to_numpy(), batch.column("g").to_numpy())
            cols = [pa.array(at.astype(np.int64)), pa.array(shard[at]), pa.array(base[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "block", "shard", "base"])

    schema = ", ".join(f"{c} {t}" for c, t in keyed.dtypes) + ", block long, shard int, base long"
    order = Window.partitionBy("block").orderBy("h", "g", "id")
    placed = keyed.mapInArrow(released(place), schema).withColumn("slot", F.col("base") + F.row_number().over(order) - 1)
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot", *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)))


def write_shards(df: DataFrame, path: str, shards: int = SHARDS, **options) -> None:
    """Write the rows to ``path``, a folder for each shard, in the order of slots within a file."""
    placed = shard_documents(df, shards, keep=tuple(c for c in df.columns if c != options.get("id_col", "doc_id")), **options)
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
