"""Exact nearest rows by dot product: every block of queries meets every block of a gallery, in a task of its own.

Products of matrices only choose the candidates, with room for their rounding; each candidate's similarity is then added up in
the order of its components, as the column expression `dot` does. So ties are those of the exact sums, whatever the block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Room for the rounding of products; queries whose products are held at once; rows of a block at least, where there are cores left.
ROOM, AT_ONCE, LEAST_ROWS = 1e-9, 64, 1_000
KEYS = ["down", "across"]


def in_blocks(queries: DataFrame, gallery: DataFrame, find, extra: list[str], rows: int, pairs: int) -> DataFrame:
    """find over each block of queries (vec_id, v) with each block of a gallery (g_id, g and more): vec_id, sim and the columns named.

    A block has about rows of the gallery, and pairs with the queries it meets, so neither side is broadcast and a task doesn't grow with the input.
    """
    n, cores = gallery.count(), queries.sparkSession.sparkContext.defaultParallelism
    across, down = max(-(-n // rows), min(cores, n // LEAST_ROWS), 1), max(-(-queries.count() // max(pairs // rows, 1)), 1)
    dim = lambda v: F.when(F.forall(v, lambda x: x.isNotNull()), F.size(v)).otherwise(-1).alias("dim")
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("vec_id", "v", dim("v"), block("vec_id", down).alias("down")).select("*", each(across).alias("across"))
    right = gallery.where("g_id IS NOT NULL").select("*", dim("g"), block("g_id", across).alias("across")).select("*", each(down).alias("down"))
    schema = StructType([queries.schema["vec_id"], *[gallery.schema[c] for c in extra], StructField("sim", DoubleType())])
    names = [f.name for f in schema]

    def run(q: pa.Table, g: pa.Table) -> pa.Table:
        found = list(_found(q, g, find, extra)) if q.num_rows and g.num_rows else []
        return pa.concat_tables([t.select(names) for t in found]) if found else _as(schema).empty_table()

    return left.groupBy(*KEYS).cogroup(right.groupBy(*KEYS)).applyInArrow(run, schema)


def _as(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _found(q: pa.Table, g: pa.Table, find, extra: list[str]):
    """Rows of find for queries of each length of vector; rows of the gallery of another length, or with nulls, have no similarity and follow."""
    for d in pc.unique(q["dim"]).to_pylist():
        some = q.filter(pc.equal(q["dim"], d))
        alike = pc.and_(pc.equal(g["dim"], d), d >= 0)
        for of, known in ((g.filter(alike), True), (g.filter(pc.invert(alike)), False)):
            if not of.num_rows:
                continue
            group = find.groups(of)
            of, group = _few_copies(of, group, find.keep + 1) if known else _first(of, group, find)
            for a in range(0, some.num_rows, AT_ONCE):
                part = some.slice(a, AT_ONCE)
                i, j, sim = _chosen(part, of, group, d, find) if known else _others(part, of)
                out = {"vec_id": part["vec_id"].take(pa.array(i)), **{c: of[c].take(pa.array(j)) for c in extra}}
                yield pa.table(out | {"sim": pa.array(sim, pa.float64(), mask=None if known else np.ones(len(i), bool))})


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    return np.concatenate(flat).reshape(len(column), d) if flat else np.zeros((0, d))


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy()


def _rank(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by all keys, the first leading, and each row's place within the rows of the first key."""
    order = np.lexsort(keys[::-1])
    lead = keys[0][order]
    starts = np.flatnonzero(np.r_[True, lead[1:] != lead[:-1]]) if len(lead) else np.zeros(0, int)
    return order, np.arange(len(lead)) - np.repeat(starts, np.diff(np.r_[starts, len(lead)]))


def _few_copies(g: pa.Table, group: np.ndarray, most: int) -> tuple[pa.Table, np.ndarray]:
    """Of rows with the same vector and group only those of the least ids: the others can't be found, as they tie with these and come later."""
    vectors = _matrix(g["g"], g["dim"][0].as_py())
    whole = np.ascontiguousarray(np.c_[vectors, group.astype(float)]).view(np.uint64)
    _, copies = np.unique(whole.view(np.dtype((np.void, whole.shape[1] * 8))).ravel(), return_inverse=True)
    order, place = _rank(copies.ravel(), _ids(g["g_id"]))
    stay = np.sort(order[place < most])
    return g.take(pa.array(stay)), group[stay]


def _first(g: pa.Table, group: np.ndarray, find) -> tuple[pa.Table, np.ndarray]:
    """The rows without similarity that may be needed: the first of each of the first groups, one more each than are kept, as a query isn't its own neighbour."""
    order, place = _rank(group, _ids(g["g_id"]))
    stay = order[place <= find.keep]
    stay = stay[np.isin(group[stay], np.unique(group)[: find.best + 1])]
    return g.take(pa.array(stay)), group[stay]


def _others(q: pa.Table, g: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = np.nonzero(_ids(q["vec_id"])[:, None] != _ids(g["g_id"])[None])
    return i, j, np.zeros(len(i))


def _chosen(q: pa.Table, g: pa.Table, group: np.ndarray, d: int, find) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and similarity of what find keeps."""
    a, b, ids = _matrix(q["v"], d), _matrix(g["g"], d), _ids(g["g_id"])
    with np.errstate(invalid="ignore", over="ignore"):
        near = a @ b.T
        near[~np.isfinite(near)] = np.inf  # looked at in any case: in SQL NaN is above all numbers
        near[_ids(q["vec_id"])[:, None] == ids[None]] = -np.inf
        i, j = np.nonzero((near >= find.least(near, group) - ROOM) & (near > -np.inf))
        sim = np.zeros(len(i))
        for x in range(d):
            sim += a[i, x] * b[j, x]
    down = np.where(np.isnan(sim), -np.inf, -sim)
    stay = find.leading(i, group[j], down, ids[j])
    return i[stay], j[stay], sim[stay]


def _least_of(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row, or the least if there are fewer."""
    k = min(k, x.shape[1])
    return -np.partition(-x, k - 1, axis=1)[:, k - 1 : k]


class Nearest:
    """The k nearest rows; of equal ones those of the least ids."""

    def __init__(self, k: int):
        self.keep, self.best = k, 1

    def groups(self, g: pa.Table) -> np.ndarray:
        return np.zeros(g.num_rows, int)

    def least(self, near: np.ndarray, group: np.ndarray) -> np.ndarray:
        return _least_of(near, self.keep)

    def leading(self, i, group, down, ids) -> np.ndarray:
        order, place = _rank(i, down, ids)
        return order[place < self.keep]


class BestGroups:
    """The nearest row of each of the groups with the nearest rows; a group that is not among a block's best is not among the best of all."""

    def __init__(self, by: str, best: int):
        self.by, self.keep, self.best = by, 1, best

    def groups(self, g: pa.Table) -> np.ndarray:
        """Places of the groups in order; nulls are a group, the last."""
        values = g[self.by].combine_chunks()
        known = pc.unique(values)
        known = known.take(pc.sort_indices(known, null_placement="at_end"))
        return pc.index_in(values, value_set=known).to_numpy(zero_copy_only=False).astype(int)

    def least(self, near: np.ndarray, group: np.ndarray) -> np.ndarray:
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
        tops = np.maximum.reduceat(near[:, order], starts, axis=1)
        at = np.cumsum(np.r_[0, np.diff(group[order]) > 0])
        least = np.empty_like(near)
        least[:, order] = np.maximum(tops, _least_of(tops, self.best))[:, at]
        return least

    def leading(self, i, group, down, ids) -> np.ndarray:
        pair = i * (group.max(initial=0) + 1) + group
        order, place = _rank(pair, down, ids)
        first = order[place == 0]
        order, place = _rank(i[first], down[first], group[first])
        return first[order[place < self.best]]
