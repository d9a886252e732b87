"""What a profile needs besides plain aggregates, from one scan each.

A task turns its rows into partial results by numpy: centred power sums, bins,
and masked matrix products of all pairs of columns; or the distinct keys that it
met in each column.  Partial results are summed by row number over the tasks, so
neither rows nor tasks are multiplied by the number of columns.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this repository

BINS = 16
#: Values that a task turns into numpy at once; columns whose products one scan makes.
VALUES, BLOCK = 1 << 20, 1024
#: Distinct values of a column that a task holds, about; values in a row that it sends.
HELD, SENT = 1 << 20, 1 << 14


def blocks(n: int, size: int) -> list[tuple[range, range]]:
    """Pairs of ranges of columns whose products together hold all pairs."""
    parts = [range(k, min(n, k + size)) for k in range(0, n, size)]
    return [(a, b) for i, a in enumerate(parts) for b in parts[i:]]


def _matrix(batch: pa.RecordBatch, low: int, high: int) -> np.ndarray:
    """Rows x columns, NaN for null."""
    return np.stack([c.slice(low, high - low).to_numpy(zero_copy_only=False).astype(np.float64, copy=False) for c in batch.columns], 1)


def _chunks(batches, columns: int):
    step = max(1, VALUES // max(1, columns))
    for batch in batches:
        for low in range(0, batch.num_rows, step):
            yield _matrix(batch, low, min(batch.num_rows, low + step))


def _rows(numbers, values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(list(values), pa.list_(pa.float64()))], ["row", "sums"])


def _summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sums of the arrays of each row number: as many rows as there are columns of the data."""

    def work(batches):
        row = held = None
        for batch in batches:
            for number, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = values.values.to_numpy()
                if number != row:
                    if row is not None:
                        yield _rows([row], [held])
                    row, held = number, own.copy()
                else:
                    held += own
        if row is not None:
            yield _rows([row], [held])

    found = parts.repartition("row").sortWithinPartitions("row").mapInArrow(work, "row int, sums array<double>")
    return {r["row"]: np.array(r["sums"]) for r in found.collect()}


def shapes_and_products(df: DataFrame, numbers: list, first: list[tuple[float, float, float]], products: bool) -> tuple[dict[int, dict], np.ndarray | None]:
    """Bins and centred power sums of each column, and the products of all pairs.

    ``numbers`` are Columns (doubles, null where there is no value), ``first`` their
    least, largest and mean values.  The products, 4 x columns x columns, are for
    (a, b): sums of a times b, of a, and of a squared over the rows that have both
    (a and b centred), and the number of these rows.
    """
    n = len(numbers)
    low, high, mean = (np.array(x, np.float64) for x in zip(*first))
    named = [c.alias(f"x{i}") for i, c in enumerate(numbers)]
    parts = blocks(n, BLOCK) if products else []
    if len(parts) == 1:
        parts, together = [], True
    else:
        together = False

    def work(batches):
        sums, gram = np.zeros((n, 5 + BINS)), np.zeros((4, n, n)) if together else None
        column = np.arange(n) * BINS
        with np.errstate(all="ignore"):
            for x in _chunks(batches, n):
                has = ~np.isnan(x)
                at = np.where(high > low, np.floor((x - low) / (high - low) * BINS), 0.0)
                places = np.minimum(BINS - 1, np.where(has, at, 0.0)).astype(np.int64) + column
                sums[:, 5:] += np.bincount(places[has], minlength=n * BINS).reshape(n, BINS)
                d = np.where(has, x - mean, 0.0)
                power = d
                sums[:, 0] += has.sum(0)
                for k in (1, 2, 3, 4):
                    sums[:, k] += power.sum(0)
                    power = power * d
                if together:
                    gram += _products(d, has, d, has)
        extra = [np.concatenate([s, *(g[i] for g in gram)]) for i, s in enumerate(sums)] if together else sums
        yield _rows(range(n), extra)

    found = _summed(df.select(*named).mapInArrow(work, "row int, sums array<double>"))
    zero = np.zeros(5 + BINS + 4 * n * together)
    rows = [found.get(i, zero) for i in range(n)]
    shapes = {i: {"bins": rows[i][5 : 5 + BINS].astype(int).tolist(), "s": [0.0, *rows[i][1:5].tolist()]} for i in range(n)}
    if not products:
        return shapes, None
    if together:
        return shapes, np.stack([r[5 + BINS :].reshape(4, n) for r in rows], 1)
    gram = np.zeros((4, n, n))
    for a, b in parts:  # a scan for each pair of blocks
        gram[:, a.start : a.stop, b.start : b.stop], mirrored = _block(df, named, mean, a, b)
        gram[:, b.start : b.stop, a.start : a.stop] = mirrored
    return shapes, gram


def _products(d: np.ndarray, has: np.ndarray, e: np.ndarray, have: np.ndarray) -> np.ndarray:
    mask, other = has.astype(np.float64), have.astype(np.float64)
    return np.stack([d.T @ e, d.T @ other, (d * d).T @ other, mask.T @ other])


def _block(df: DataFrame, named: list, mean: np.ndarray, a: range, b: range) -> tuple[np.ndarray, np.ndarray]:
    """The products of the columns in ``a`` with those in ``b``, and of those in ``b`` with those in ``a``."""
    chosen = sorted({*a, *b})
    i, j = (np.searchsorted(chosen, np.array(x)) for x in (a, b))

    def work(batches):
        there, back = np.zeros((4, len(a), len(b))), np.zeros((4, len(b), len(a)))
        with np.errstate(all="ignore"):
            for x in _chunks(batches, len(chosen)):
                has = ~np.isnan(x)
                d = np.where(has, x - mean[chosen], 0.0)
                there += _products(d[:, i], has[:, i], d[:, j], has[:, j])
                back += _products(d[:, j], has[:, j], d[:, i], has[:, i])
        yield _rows(range(len(a)), there.transpose(1, 0, 2).reshape(len(a), -1))
        yield _rows(range(len(a), len(a) + len(b)), back.transpose(1, 0, 2).reshape(len(b), -1))

    found = _summed(df.select(*[named[k] for k in chosen]).mapInArrow(work, "row int, sums array<double>"))
    there = np.stack([found.get(k, np.zeros(4 * len(b))).reshape(4, -1) for k in range(len(a))], 1)
    back = np.stack([found.get(len(a) + k, np.zeros(4 * len(a))).reshape(4, -1) for k in range(len(b))], 1)
    return there, back


def _keys(column: pa.Array) -> np.ndarray:
    """The values that are there as 64-bit numbers, equal ones alike and others not."""
    column = column.drop_null()
    if pa.types.is_floating(column.type):
        return (column.cast(pa.float64()).to_numpy() + 0.0).view(np.int64)  # -0.0 is 0.0
    if pa.types.is_boolean(column.type):
        column = column.cast(pa.int8())
    elif pa.types.is_date32(column.type):
        column = column.cast(pa.int32())
    return column.cast(pa.int64()).to_numpy()


class Met:
    """Distinct keys of one column, from arrays of them: held in bounded memory until many are new."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(keys)
        self.size += len(keys)
        if self.size > HELD:
            self.keys()

    def keys(self) -> np.ndarray:
        self.parts = [np.unique(np.concatenate(self.parts))] if self.parts else [np.zeros(0, np.int64)]
        self.size = len(self.parts[0])
        return self.parts[0]


def distinct_keys(df: DataFrame, values: list, rows: int) -> list[int]:
    """Exact numbers of distinct values of several columns (integers, booleans, floats, dates, timestamps) of a table of so many rows.

    One scan and one shuffle of what is left when each task has dropped its own
    repetitions, packed by column and range of hashes.  The ranges follow the
    rows, so a set that a task holds is bounded.
    """
    n, shards = len(values), 1 + rows // HELD

    def sent(column: int, keys: np.ndarray):
        shard = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
        for at in np.flatnonzero(np.diff(cuts)).tolist():
            own = keys[order[cuts[at] : cuts[at + 1]]]
            for k in range(0, len(own), SENT):
                yield pa.RecordBatch.from_arrays([pa.array([column], pa.int32()), pa.array([at], pa.int32()), pa.array([own[k : k + SENT]], pa.list_(pa.int64()))], ["column", "shard", "keys"])

    def work(batches):
        held = [Met() for _ in range(n)]
        for batch in batches:
            for k, met in enumerate(held):
                met.add(_keys(pc.unique(batch.column(k))))
                if met.size > HELD // 2:  # mostly new values: no use in holding them
                    yield from sent(k, met.keys())
                    held[k] = Met()
        for k, met in enumerate(held):
            yield from sent(k, met.keys())

    def counted(batches):
        at, met = None, Met()
        for batch in batches:
            for column, shard, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if at != (column, shard):
                    if at:
                        yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([len(met.keys())], pa.int64())], ["column", "n"])
                    at, met = (column, shard), Met()
                met.add(keys.values.to_numpy())
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([len(met.keys())], pa.int64())], ["column", "n"])

    parts = df.select(*[v.alias(f"v{k}") for k, v in enumerate(values)]).mapInArrow(work, "column int, shard int, keys array<long>")
    parts = parts.repartition("column", "shard").sortWithinPartitions("column", "shard").mapInArrow(counted, "column int, n long")
    found = dict(parts.groupBy("column").agg(F.sum("n")).collect())  # a row a column
    return [found.get(k, 0) for k in range(n)]
