"""Best items of every query where all pairs compete: scored in cells of bounded size, only the best leave a cell.

Queries and items of a group are dealt to blocks, every pair of blocks is one
cell, and a cell multiplies matrices. What travels is each item once for each
block of queries, each query once for each block of items, and top_k rows of a
query from each cell; no row for a pair ever exists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.sources.tables import materialize, ship_package

#: Queries and items of a cell, and the weight (words or entries) of its items; both sides multiplied at a time.
QUERIES, ITEMS, WEIGHT = 16384, 16384, 4_000_000
ROWS, COLUMNS = 1024, 2048
#: Terms of a cell that so many pairs hold are multiplied as dense columns, SLAB of them at a time; others pair by pair.
DENSE, SLAB = 4096, 512
MICRO = Decimal("0.000001")


def micros(x: np.ndarray) -> np.ndarray:
    """Millionths of the values, rounded half up by their shortest decimals, as Spark rounds to six places."""
    y = x * 1e6
    out = np.floor(np.abs(y) + 0.5)
    close = np.abs(np.abs(y) + 0.5 - np.rint(np.abs(y) + 0.5)) < 1e-5
    if close.any():
        values, back = np.unique(np.abs(x[close]), return_inverse=True)
        out[close] = np.array([float(Decimal(repr(float(v))).quantize(MICRO, ROUND_HALF_UP) * 1_000_000) for v in values])[back]
    return np.where(y < 0, -out, out).astype(np.int64)


class Best:
    """The top_k items of each query by score, ties by place, over columns that come in the order of places."""

    def __init__(self, queries: int, top_k: int):
        self.score = np.full((queries, top_k), np.iinfo(np.int64).min)
        self.place = np.full((queries, top_k), np.iinfo(np.int64).max)

    def add(self, begin: int, score: np.ndarray, first: int, there: np.ndarray) -> None:
        """Scores of queries from ``begin`` on against items from place ``first`` on; ``there`` tells which count.

        Only what may beat a query's last one is rounded: a later item loses a tie.
        """
        top_k, (n, width) = self.score.shape[1], score.shape
        last = self.score[begin : begin + n, -1]
        filled = last > np.iinfo(np.int64).min
        bound = np.where(filled, (last + 0.5) / 1e6, -np.inf)
        bound -= 1e-12 + 1e-14 * np.abs(np.where(filled, bound, 0.0))
        if width > top_k and not filled.all():
            masked = np.where(there[~filled], score[~filled], -np.inf)
            bound[~filled] = np.partition(masked, width - top_k, axis=1)[:, width - top_k] - 1.1e-6
        i, j = np.nonzero((score >= bound[:, None]) & there)
        old = np.repeat(np.arange(n), top_k)
        who = np.concatenate((old, i))
        what = np.concatenate((self.score[begin : begin + n].ravel(), micros(score[i, j])))
        where = np.concatenate((self.place[begin : begin + n].ravel(), first + j))
        order = np.lexsort((where, -what.astype(np.float64), who))
        who, what, where = who[order], what[order], where[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        kept = rank < top_k
        self.score[begin + who[kept], rank[kept]] = what[kept]
        self.place[begin + who[kept], rank[kept]] = where[kept]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of queries, places of items and scores in millionths of what was found."""
        i, k = np.nonzero(self.score > np.iinfo(np.int64).min)
        return i, self.place[i, k], self.score[i, k]


class Sparse:
    """Rows of (term, value) of one side, ordered by row."""

    def __init__(self, row: np.ndarray, term: np.ndarray, value: np.ndarray, size: int):
        self.row, self.term, self.value, self.size = row, term, value, size
        self.starts = np.searchsorted(row, np.arange(size + 1))

    def cut(self, begin: int, end: int) -> Sparse:
        end = min(end, self.size)
        a, b = self.starts[begin], self.starts[end]
        return Sparse(self.row[a:b] - begin, self.term[a:b], self.value[a:b], end - begin)


def product(left: Sparse, right: Sparse, terms: int, kind: type = np.float64) -> np.ndarray:
    """Sums over common terms of the products of values, for all pairs of rows; dense columns are multiplied as ``kind``."""
    nl, nr = np.bincount(left.term, minlength=terms), np.bincount(right.term, minlength=terms)
    out = np.zeros((left.size, right.size), dtype=kind)
    pairs = nl.astype(np.int64) * nr
    hot = np.flatnonzero(pairs >= DENSE)
    place = np.full(terms, -1)
    place[hot] = np.arange(len(hot))
    lp, rp = place[left.term], place[right.term]
    for begin in range(0, len(hot), SLAB):
        width = min(SLAB, len(hot) - begin)
        sides = []
        for side, p in ((left, lp), (right, rp)):
            own = (p >= begin) & (p < begin + width)
            dense = np.zeros((side.size, width), dtype=kind)
            dense[side.row[own], p[own] - begin] = side.value[own]
            sides.append(dense)
        out += sides[0] @ sides[1].T
    rare = (pairs > 0) & (pairs < DENSE)
    lo, ro = np.flatnonzero(rare[left.term]), np.flatnonzero(rare[right.term])
    if len(lo):
        ro = ro[np.argsort(right.term[ro], kind="stable")]
        sorted_terms = right.term[ro]
        start, count = np.searchsorted(sorted_terms, left.term[lo]), nr[left.term[lo]]
        which = np.repeat(np.arange(len(lo)), count)
        other = ro[np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))]
        cell = left.row[lo][which] * right.size + right.row[other]
        out += np.bincount(cell, weights=left.value[lo][which] * right.value[other], minlength=out.size).reshape(out.shape).astype(kind, copy=False)
    return out


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Row numbers and values of the entries of a list column."""
    whole = column.combine_chunks()
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    n = np.diff(whole.offsets.to_numpy())
    return np.repeat(np.arange(len(n)), n), whole.flatten()


def packed(row: np.ndarray, values: np.ndarray, rows: int) -> pa.Array:
    """The whole numbers of each row, from 0 on and in the order of rows, as bytes: seven bits in each, the eighth says that more follow."""
    n = np.ones(len(values), dtype=np.int64)
    for k in range(1, 9):
        n += values >= 1 << 7 * k
    ends = np.concatenate(([0], np.cumsum(n)))
    out = np.zeros(ends[-1], dtype=np.uint8)
    for k in range(int(n.max(initial=0))):
        more = np.flatnonzero(n > k)
        out[ends[more] + k] = values[more] >> 7 * k & 127 | np.where(n[more] > k + 1, 128, 0)
    offsets = ends[np.searchsorted(row, np.arange(rows + 1))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpacked(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of what packed() made."""
    whole = pa.concat_arrays([c.cast(pa.binary()) for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])] or [pa.array([], pa.binary())])
    _, places, data = whole.buffers()
    if not len(whole) or data is None:
        return np.array([], np.int64), np.array([], np.int64)
    offsets = np.frombuffer(places, dtype=np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64)
    held = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    last = held < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(ends)]
    values = (held[starts] & 127).astype(np.int64)
    for k in range(1, int((ends - starts).max(initial=0)) + 1):
        more = np.flatnonzero(ends - starts >= k)
        values[more] |= (held[starts[more] + k] & 127).astype(np.int64) << 7 * k
    return np.repeat(np.arange(len(whole)), np.diff(np.searchsorted(ends, offsets - offsets[0]))), values


def steps(row: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of values that rise within each row the first and then the differences."""
    out = np.diff(values, prepend=0)
    first = np.diff(row, prepend=-1) != 0
    out[first] = values[first]
    return out


def sums_of(row: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The values that steps() came from."""
    total = np.cumsum(step)
    first = np.flatnonzero(np.diff(row, prepend=-1) != 0)
    return total - np.repeat(total[first] - step[first], np.diff(np.append(first, len(row))))


Kernel = Callable[[pa.Table, pa.Table], Iterator[tuple[int, np.ndarray, int, np.ndarray]]]


def best_in_cells(queries: DataFrame, items: DataFrame, groups: list[str], weight: Column | None, kernel: Kernel, top_k: int, item_rows: int = ITEMS, order: str | None = None) -> DataFrame:
    """id, pos and score of the top_k items of each query that are best in some cell, ``groups`` equal on both sides.

    ``queries(id string or long, ...)``, ``items(pos long, ...)``; ``weight`` is an item's share
    of WEIGHT. The kernel gets the queries and the items of a cell, the items by
    pos and the queries by their column ``order``, if there is one, and yields (first query, scores, first item, which count)
    with first items ascending for each query.
    """
    ship_package(queries.sparkSession)
    queries = materialize(queries, "asking")  # read twice: their blocks are counted first
    kind = queries.schema["id"].dataType
    names = [f"_g{k}" for k in range(len(groups))]
    keys = [F.col(g).alias(n) for g, n in zip(groups, names, strict=True)]
    load = F.ceil(F.coalesce(F.sum(weight), F.lit(0)) / F.lit(WEIGHT)) if weight is not None else F.lit(0)
    of_items = items.groupBy(*keys).agg(F.greatest(F.ceil(F.count("*") / F.lit(item_rows)), load).cast("int").alias("_ib"))
    of_queries = queries.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(QUERIES)).cast("int").alias("_qb"))
    blocks = materialize(of_items.join(of_queries, names) if names else of_items.crossJoin(of_queries), "blocks")

    def dealt(side: DataFrame, key: str, own: str, other: str) -> DataFrame:
        sizes = blocks.toDF(*(f"{c}_{own}" if c in names else c for c in blocks.columns))  # names of its own: both sides meet again
        met = side.join(sizes, [F.col(g) == F.col(f"{n}_{own}") for g, n in zip(groups, names, strict=True)]) if names else side.crossJoin(F.broadcast(sizes))
        mine = F.pmod(F.xxhash64(key), F.col(own)).cast("int")
        each = F.when(F.col(other) > 0, F.sequence(F.lit(0), F.col(other) - 1))
        return met.withColumn("_mine", mine).withColumn("_other", F.explode(each)).drop("_ib", "_qb", *(g for g in groups if g != key))

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        best = Best(left.num_rows, top_k)
        left = left.sort_by(order) if order else left
        right = right.take(pc.sort_indices(right, sort_keys=[("pos", "ascending")], null_placement="at_start"))
        if left.num_rows and right.num_rows:
            for first_query, score, first_item, there in kernel(left, right):
                best.add(first_query, score, first_item, there)
        i, place, score = best.rows()
        taken = [left.column("id").take(pa.array(i, pa.int64())), right.column("pos").take(pa.array(place, pa.int64()))]
        return pa.table([*taken, pa.array(score, pa.int64())], ["id", "pos", "micro"])

    a = dealt(queries, "id", "_qb", "_ib").withColumnRenamed("_mine", "_q").withColumnRenamed("_other", "_i")
    b = dealt(items, "pos", "_ib", "_qb").withColumnRenamed("_mine", "_i").withColumnRenamed("_other", "_q")
    cells = (t.groupBy(*(f"{n}_{own}" for n in names), "_q", "_i") for t, own in ((a, "_qb"), (b, "_ib")))
    found = next(cells).cogroup(next(cells)).applyInArrow(match, f"id {kind.simpleString()}, pos long, micro long")
    return found.select("id", "pos", (F.col("micro") / F.lit(1e6)).alias("score"))


def term_kernel(score: Callable[[np.ndarray, pa.Table, pa.Table], tuple[np.ndarray, np.ndarray]], encode: Callable[[pa.Table, pa.Table], tuple[Sparse, Sparse, int]]) -> Kernel:
    """A kernel from products of sparse rows: ``score`` turns a product and both sides into scores and which count."""

    def kernel(left: pa.Table, right: pa.Table) -> Iterator[tuple[int, np.ndarray, int, np.ndarray]]:
        x, y, terms = encode(left, right)
        for i in range(0, right.num_rows, COLUMNS):
            part = y.cut(i, i + COLUMNS)
            for q in range(0, left.num_rows, ROWS):
                rows = x.cut(q, q + ROWS)
                made, there = score(product(rows, part, terms), left.slice(q, ROWS), right.slice(i, COLUMNS))
                yield q, made, i, there

    return kernel


def numbered(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Terms of both sides as numbers of the left side's distinct ones; -1 on the right where the left has none."""
    coded = left.dictionary_encode() if len(left) else pa.array([], pa.string()).dictionary_encode()
    at = pc.index_in(right, value_set=coded.dictionary)
    return coded.indices.to_numpy().astype(np.int64), at.fill_null(-1).to_numpy().astype(np.int64), len(coded.dictionary)
