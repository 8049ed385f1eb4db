"""Vectors that the nearest-neighbour operators share: cleaning, pivots, and the local join of held rows with passing ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.common import released

#: Cells of a score matrix at once, in one task.
CELLS = 1 << 22


def finite(vector: str) -> Column:
    """True if the vector is there and all of its components are finite."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def matrix(column, dim: int, kind=np.float64) -> np.ndarray:
    """Rows of an Arrow list column; components that a vector lacks count as 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def best(scores: np.ndarray, k: int, slack: float = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's k largest entries above -inf, and of all that equal the last (or miss it by ``slack``)."""
    if not scores.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - slack if k < scores.shape[1] else np.full(len(scores), -np.inf)
    return np.nonzero((scores >= last[:, None]) & (scores > -np.inf))


def ranks(keys: np.ndarray) -> np.ndarray:
    """Place of each entry within its run of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return np.arange(len(keys)) - np.repeat(first, np.diff(np.append(first, len(keys))))


def meet(held: DataFrame, passing: DataFrame, join, schema: str) -> DataFrame:
    """Rows of ``join`` for each unit: ``held`` rows of the unit, all at once, with ``passing`` ones, batch by batch.

    Both have a column ``unit``; the other columns of both are filled with null where a side lacks them.
    The caller bounds how many held rows a unit has; passing rows stream through. Spark deals and sorts the rows.
    ``join(held, passing)`` gets Arrow tables and returns one of ``schema``.
    """
    both = held.withColumn("side", F.lit(0)).unionByName(passing.withColumn("side", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c not in ("unit", "side")]
    own = {0: [c for c in columns if c in held.columns], 1: [c for c in columns if c in passing.columns]}
    spark = both.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        unit, kept, table = None, [], None
        for batch in batches:
            units = batch.column("unit").to_numpy(zero_copy_only=False)
            sides = batch.column("side").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.concatenate([[True], (units[1:] != units[:-1]) | (sides[1:] != sides[:-1])])).tolist() if len(units) else []
            for i, j in zip(edges, [*edges[1:], len(units)], strict=True):
                if units[i] != unit:
                    unit, kept, table = units[i], [], None
                part = pa.Table.from_batches([batch.slice(i, j - i)]).select(own[sides[i]])
                if sides[i] == 0:
                    kept.append(part)
                elif kept:
                    table = table if table is not None else pa.concat_tables(kept).combine_chunks()
                    kept = [table]
                    yield from join(table, part).to_batches()

    dealt = both.repartition(n, "unit").sortWithinPartitions("unit", "side")
    return dealt.mapInArrow(released(run), schema)
