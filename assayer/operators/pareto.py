"""Non-dominated sorting and its reward."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.operators.tiles import tanimoto


def fronts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """`df` with `front`, 1 for rows that no other row dominates, 2 for those only they dominate, and so on.

    Each group of `by` (a batch) is sorted on its own. Points alike in all columns
    are one point. Rows enter in an order in which dominators come first, and
    take the first front none of whose members dominates them, found by bisection.
    """
    points = df.select(*by, *columns).distinct()
    fields = points.schema
    group = list(by)
    d = len(columns)

    def sort(table: pa.Table) -> pa.Table:
        x = np.column_stack([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])
        rank, members = np.zeros(len(x), np.int32), []
        for i in np.lexsort([-x[:, k] for k in range(d - 1, -1, -1)]):
            low, high = 0, len(members)
            while low < high:
                mid = (low + high) // 2
                m = np.array(members[mid])
                if ((m >= x[i]).all(1) & (m > x[i]).any(1)).any():
                    low = mid + 1
                else:
                    high = mid
            if low == len(members):
                members.append([])
            members[low].append(x[i])
            rank[i] = low + 1
        return table.append_column("front", pa.array(rank))

    grouped = points.groupBy(*group) if group else points.groupBy(F.lit(1))
    ranked = grouped.applyInArrow(sort, T.StructType([*fields, T.StructField("front", T.IntegerType())]))
    return df.join(ranked, [*group, *columns])


def crowding(words: np.ndarray) -> np.ndarray:
    """Crowding of each vector in its front: the gaps around it in every member's order of distance, the farthest far."""
    apart = 1.0 - tanimoto(words, words)
    out = np.zeros(len(words))
    for row in apart:
        order = np.argsort(row, kind="stable")
        out[order[-1]] += 1e4
        out[order[1:-1]] += row[order[2:]] - row[order[:-2]]
    return out


def ranked_worst_first(x: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Row numbers from the worst front to the best; fronts are peeled from below.

    Inside a front rows go by number, or by crowding if vectors are given and the
    front has more than two rows.
    """
    below = (x[:, None, :] >= x[None, :, :]).all(2) & (x[:, None, :] > x[None, :, :]).any(2)  # row dominates column
    left, out = np.ones(len(x), bool), []
    while left.any():
        front = np.flatnonzero(left & ~(below & left[None, :]).any(1))
        left[front] = False
        if words is not None and len(front) > 2:
            front = front[np.argsort(crowding(words[front]), kind="stable")]
        out.append(front)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def reward(df: DataFrame, columns: Sequence[str], threshold: float = 0.5, by: Sequence[str] = ("step",), order: str = "idx", words: str | None = None, out: str = "pareto_front") -> DataFrame:
    """`df` with the rank of each row in its batch, scaled to a reward.

    k is a row's place from the worst. A row that reaches the threshold everywhere
    gets (1 - threshold) + (k - undesirable) / desirable, others k / (2 undesirable).
    Rows alike in all columns share the place of the first. A batch is one task's
    work: batches are what a generator proposes at once, and bounded by it.
    """
    need = [*by, order, *columns, *([words] if words else [])]

    def rank(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        x = np.column_stack([table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])
        w = None
        if words:
            w = np.array(table.column(words).to_pylist(), dtype=np.int64).view(np.uint64)
        place = np.empty(len(x), np.int64)
        place[ranked_worst_first(x, w)] = np.arange(len(x))
        _, first, same = np.unique(x, axis=0, return_index=True, return_inverse=True)
        k = place[first[same.ravel()]].astype(float)
        good = (x >= threshold).all(1)
        n_good, n_bad = int(good.sum()), int((~good).sum())
        value = np.where(good, (1 - threshold) + (k - n_bad) / max(1, n_good), k / max(1, 2 * n_bad))
        return table.select([*by, order]).append_column(out, pa.array(value))

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*by, order]) + f", `{out}` double"
    ranks = df.select(*need).groupBy(*by).applyInArrow(rank, schema)
    return df.join(ranks, [*by, order])
