"""Where vectors of equal label rank among the neighbours of a query, over all pairs of queries and rows.

The job is quadratic by nature.  It is cut into units of one block of queries
and one part of the rows; a unit streams its rows past its queries in matrix
products of bounded tiles and keeps, for each query, its ``TOP`` nearest and its
nearest of equal label.  A second run counts, for queries without such a row
among the nearest, how many rows come before it.

Similarity is rounded to six places before it is compared, ties go by id.  A
matrix product adds in an order of its own, so a product that lies within that
error of a rounding edge is summed again in order, place by place.  It runs
over the places where both vectors have values, and is null (last) without one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quillspark.scratch import discard, materialize

TOP, SCALE = 10, 1e6
QUERY_BLOCK, PART, LEAST_PART = 1 << 15, 1 << 17, 1 << 13
TILE = 1024, 2048
#: Stand-ins for null similarity and for a pair of one id.
NULL, LEAST = -1e300, -1.7e308


@dataclass
class _Rows:
    """Vectors ordered by label; those without one come last."""

    id: np.ndarray
    label: np.ndarray
    n_labelled: int
    values: np.ndarray
    norm: np.ndarray
    given: np.ndarray | None
    finite: bool
    more: list[np.ndarray]


def _matrix(column, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Values with 0 where there is none, and where there are some (None: everywhere)."""
    flat = column.flatten()
    if column.null_count == 0 and flat.null_count == 0 and len(flat) == len(column) * width and (np.diff(column.offsets.to_numpy()) == width).all():
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width), None
    values, given = np.zeros((len(column), width)), np.zeros((len(column), width), bool)
    for i, row in enumerate(column.to_pylist()):
        for j, x in enumerate(row or ()):
            if x is not None:
                values[i, j], given[i, j] = x, True
    return values, given


def _rows(table, width: int) -> _Rows:
    """Columns: unit, kind, id, label, values, and more."""
    label = table.column("label").combine_chunks()
    known = label.is_valid().to_numpy(zero_copy_only=False)
    label = label.fill_null(0).to_numpy()
    order = np.lexsort((label, ~known))
    values, given = _matrix(table.column("values").combine_chunks(), width)
    values = values[order]
    with np.errstate(all="ignore"):
        norm = np.sqrt((values * values).sum(1))
    more = [table.column(name).to_numpy()[order] for name in table.schema.names[5:]]
    return _Rows(table.column("id").to_numpy()[order], label[order], int(known.sum()), values, norm, None if given is None else given[order], bool(np.isfinite(norm).all()), more)


class _Best:
    """For each query the ``width`` least of (negative scaled similarity, id, other label); infinite: none yet."""

    def __init__(self, n: int, width: int):
        self.nk, self.id, self.other = np.full((n, width), np.inf), np.full((n, width), np.iinfo(np.int64).max), np.ones((n, width), bool)

    def edge(self, low: int, high: int) -> np.ndarray:
        """Least similarity that can still enter."""
        return (-self.nk[low:high, -1] - 0.5) / SCALE

    def add(self, at: np.ndarray, nk: np.ndarray, ids: np.ndarray, other: np.ndarray) -> None:
        last, last_id = self.nk[at, -1], self.id[at, -1]
        keep = (nk < last) | ((nk == last) & (ids <= last_id))
        at, nk, ids, other = at[keep], nk[keep], ids[keep], other[keep]
        if not len(at):
            return
        width = self.nk.shape[1]
        queries, row = np.unique(at, return_inverse=True)
        row = np.concatenate([np.repeat(np.arange(len(queries)), width), row])
        nk, ids, other = (np.concatenate([old[queries].ravel(), new]) for old, new in ((self.nk, nk), (self.id, ids), (self.other, other)))
        order = np.lexsort((other, ids, nk, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(queries)))[row]
        take = place < width
        to, order = (queries[row[take]], place[take]), order[take]
        self.nk[to], self.id[to], self.other[to] = nk[order], ids[order], other[order]


def _error(width: int) -> float:
    """Of two sums of products in any order, and of scaling one, for each unit of the norms' product."""
    return 1e-15 * (width + 1)


def _scaled(dots: np.ndarray, i: np.ndarray, j: np.ndarray, q: _Rows, rows: _Rows) -> np.ndarray:
    """Similarities of the pairs (i, j), rounded: whole millionths."""
    size = np.abs(dots) * SCALE
    with np.errstate(invalid="ignore"):
        unsure = np.flatnonzero(np.abs(size - np.floor(size) - 0.5) <= SCALE * (1e-15 + _error(q.values.shape[1]) * q.norm[i] * rows.norm[j]))
    unsure = unsure[dots[unsure] != NULL]
    if len(unsure):
        exact = np.zeros(len(unsure))
        for k in range(q.values.shape[1]):
            exact += q.values[i[unsure], k] * rows.values[j[unsure], k]
        dots = dots.copy()
        dots[unsure] = exact
    return np.copysign(np.floor(np.abs(dots * SCALE) + 0.5), dots) + 0.0


def _tiles(q: _Rows, rows: _Rows) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """Bounds of queries and of rows, products, and each query's error in them."""
    by_id = np.argsort(q.id, kind="stable")
    first, last = (np.searchsorted(q.id[by_id], rows.id, side) for side in ("left", "right"))
    same = [(by_id[k], j) for j in np.flatnonzero(last > first).tolist() for k in range(first[j], last[j])]
    same_q, same_row = (np.array([s[k] for s in same], np.int64) for k in range(2))
    for low in range(0, len(q.id), TILE[0]):
        high = min(low + TILE[0], len(q.id))
        for left in range(0, len(rows.id), TILE[1]):
            right = min(left + TILE[1], len(rows.id))
            with np.errstate(all="ignore"):
                dots = q.values[low:high] @ rows.values[left:right].T
                slack = 1e-15 + 2 * _error(q.values.shape[1]) * q.norm[low:high] * rows.norm[left:right].max()
            if not (q.finite and rows.finite):
                dots, slack = np.where(np.isnan(dots), np.inf, np.maximum(dots, NULL / 10)), np.where(np.isfinite(slack), slack, 0.0)
            if q.given is not None or rows.given is not None:
                both = np.ones_like(q.values[low:high]) if q.given is None else q.given[low:high].astype(float)
                dots[both @ (np.ones_like(rows.values[left:right]) if rows.given is None else rows.given[left:right].astype(float)).T == 0] = NULL
            here = (same_q >= low) & (same_q < high) & (same_row >= left) & (same_row < right)
            dots[same_q[here] - low, same_row[here] - left] = -np.inf
            yield low, high, left, right, dots, slack


def _at_least(dots: np.ndarray, edge: np.ndarray, slack: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        edge = edge - slack - np.abs(edge) * 1e-14
    return dots >= np.maximum(np.where(np.isnan(edge), LEAST, edge), LEAST)[:, None]


def _nearest(q: _Rows, rows: _Rows, top: _Best, equal: _Best) -> None:
    """Lets ``rows`` pass by the queries."""
    q_label, row_label = q.label[: q.n_labelled], rows.label[: rows.n_labelled]
    for low, high, left, right, dots, slack in _tiles(q, rows):
        # Only what is among the tile's own nearest can enter a list.
        edge, n = top.edge(low, high), dots.shape[1]
        if n > TOP and np.isinf(edge).any():
            edge = np.maximum(edge, np.partition(dots, n - TOP, axis=1)[:, n - TOP] - 1 / SCALE - slack)
        i, j = np.nonzero(_at_least(dots, edge, slack))
        nk = -_scaled(dots[i, j], i + low, j + left, q, rows) + 0.0
        i, j = i + low, j + left
        same = (i < q.n_labelled) & (j < rows.n_labelled) & (q.label[i] == rows.label[j])
        top.add(i, nk, rows.id[j], ~same)
        for label in np.intersect1d(q_label[low:high], row_label[left:right]):
            a, b = np.searchsorted(q_label[low:high], [label, label + 1]) + low
            c, d = np.searchsorted(row_label[left:right], [label, label + 1]) + left
            part, off = dots[a - low : b - low, c - left : d - left], slack[a - low : b - low]
            i, j = np.nonzero(_at_least(part, np.maximum(equal.edge(a, b), part.max(1) - 1 / SCALE - off), off))
            nk = -_scaled(part[i, j], i + a, j + c, q, rows) + 0.0
            equal.add(i + a, nk, rows.id[j + c], np.zeros(len(i), bool))


def _ahead(q: _Rows, rows: _Rows, count: np.ndarray) -> None:
    """Counts the rows that come before the one that each query names."""
    nk, own = q.more
    for low, high, left, right, dots, slack in _tiles(q, rows):
        near = _at_least(dots, (-nk[low:high] - 0.5) / SCALE, slack)
        with np.errstate(all="ignore"):
            over = (-nk[low:high] + 0.5) / SCALE
            sure = dots > (over + slack + np.abs(over) * 1e-14)[:, None]
        count[low:high] += sure.sum(1)
        i, j = np.nonzero(near & ~sure)
        mine = -_scaled(dots[i, j], i + low, j + left, q, rows) + 0.0
        i, j = i + low, j + left
        before = (mine < nk[i]) | ((mine == nk[i]) & (rows.id[j] < own[i]))
        np.add.at(count, i[before], 1)


def _units(batches: Iterable, width: int) -> Iterator[tuple[_Rows, Iterator[_Rows]]]:
    """The queries of each unit, and its rows in batches."""
    import pyarrow as pa

    def pieces():
        for batch in batches:
            mark = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(mark)) + 1).tolist(), len(mark)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield *divmod(int(mark[a]), 2), batch.slice(a, b - a)

    source = pieces()
    piece = next(source, None)
    while piece:
        unit, asked = piece[0], []
        while piece and piece[:2] == (unit, 0):
            asked.append(piece[2])
            piece = next(source, None)

        def rows():
            nonlocal piece
            while piece and piece[:2] == (unit, 1):
                yield _rows(pa.Table.from_batches([piece[2]]), width)
                piece = next(source, None)

        passing = rows()
        if asked:
            yield _rows(pa.Table.from_batches(asked), width), passing
        for _ in passing:
            pass


def _find(width: int):
    def run(batches: Iterable):
        import pyarrow as pa

        fields = [("nk", pa.float64()), ("id", pa.int64()), ("other", pa.bool_())]
        struct = lambda best, take, **kw: pa.StructArray.from_arrays([pa.array(a[take], t) for a, (_, t) in zip((best.nk, best.id, best.other), fields)], fields=[pa.field(*f) for f in fields], **kw)
        for q, passing in _units(batches, width):
            top, equal = _Best(len(q.id), TOP), _Best(len(q.id), 1)
            for rows in passing:
                _nearest(q, rows, top, equal)
            found = top.nk < np.inf
            offsets = np.concatenate([[0], found.sum(1).cumsum()]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), struct(top, found))
            best = struct(equal, (slice(None), 0), mask=pa.array(equal.nk[:, 0] == np.inf))
            yield pa.RecordBatch.from_arrays([pa.array(q.id), lists, best], ["q", "top", "equal"])

    return run


def _count(width: int):
    def run(batches: Iterable):
        import pyarrow as pa

        for q, passing in _units(batches, width):
            count = np.zeros(len(q.id), np.int64)
            for rows in passing:
                _ahead(q, rows, count)
            yield pa.RecordBatch.from_arrays([pa.array(q.id), pa.array(count)], ["q", "n"])

    return run


def _grid(vectors: DataFrame, queries: DataFrame, n_rows: int, n_queries: int) -> DataFrame:
    """Every block of queries (id, label, values, nk, own) with every part of the rows, the queries first."""
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    parts = max(1, -(-n_rows // PART), min(vectors.sparkSession.sparkContext.defaultParallelism, -(-n_rows // LEAST_PART)))
    every = lambda n, by: F.explode(F.sequence(F.lit(0), F.lit((n - 1) * by), F.lit(by)))
    asked = queries.select((F.pmod(F.xxhash64("id"), F.lit(blocks)) * parts).alias("at"), every(parts, 1).alias("step"), F.lit(0).alias("kind"), "id", "label", "values", "nk", "own")
    rows = vectors.select(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(parts)).alias("at"), every(blocks, parts).alias("step"), F.lit(1).alias("kind"), "id", "label", "values", F.lit(0.0).alias("nk"), F.lit(0).cast("long").alias("own"))
    units = asked.union(rows).select((F.col("at") + F.col("step")).cast("int").alias("unit"), "kind", "id", "label", "values", "nk", "own")
    return units.repartitionById(blocks * parts, "unit").sortWithinPartitions("unit", "kind", "id")


def question_scores(vectors: DataFrame, is_query) -> DataFrame:
    """q, hits1, hits10, rr, ndcg10 of the rows of ``vectors`` (id: long, label: integer, values) that are queries; rows of equal label are relevant.

    Every row but those of the query's id is ranked.  Rows without an id take no part.
    """
    vectors = vectors.where("id is not null").select("id", F.col("label").cast("long").alias("label"), "values")
    queries = vectors.where(is_query)
    n_rows, width, n_queries = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("values")), F.lit(0)), F.count(F.when(is_query, 1))).first()
    asked = queries.select("*", F.lit(0.0).alias("nk"), F.lit(0).cast("long").alias("own"))
    entry = "struct<nk:double,id:long,other:boolean>"
    found = _grid(vectors, asked, n_rows, n_queries).mapInArrow(_find(max(width, 1)), f"q long, top array<{entry}>, equal {entry}")
    tops = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, TOP)
    found = materialize(found.groupBy("q").agg(tops.alias("top"), F.min("equal").alias("equal")).where(F.size("top") > 0), "nearest")
    relevant = F.filter("top", lambda x: ~x["other"])
    far = found.where((F.size(relevant) == 0) & F.col("equal").isNotNull()).select(F.col("q").alias("id"), F.col("equal.nk").alias("nk"), F.col("equal.id").alias("own"))
    if n_far := far.count():
        ahead = _grid(vectors, queries.join(far, "id").select("id", "label", "values", "nk", "own"), n_rows, n_far).mapInArrow(_count(max(width, 1)), "q long, n long")
        plain, found = found, materialize(found.join(ahead.groupBy("q").agg(F.sum("n").alias("n")), "q", "left"), "nearest")
        discard(plain)
    else:
        found = found.withColumn("n", F.lit(None).cast("long"))
    gain = lambda hit: F.aggregate(F.transform("top", lambda x, i: F.when(hit(x), 1 / F.log2(i + 2)).otherwise(0.0)), F.lit(0.0), lambda s, x: s + x)
    first = F.array_position(F.transform("top", lambda x: x["other"]), False)
    rank = F.when(first > 0, first).otherwise(F.col("n") + 1)
    return found.select("q", F.when(first == 1, 1).otherwise(0).cast("long").alias("hits1"), F.size(relevant).cast("long").alias("hits10"),
                        F.round(F.coalesce(1 / rank, F.lit(0.0)), 6).alias("rr"), F.round(gain(lambda x: ~x["other"]) / gain(lambda x: F.lit(True)), 6).alias("ndcg10"))
