"""Exact nearest items for a table of queries.

No pair of a query and an item ever becomes a row. Scores are computed on numpy blocks inside
tasks and only each block's best ``k`` per query leave it. Three plans, picked by checked sizes:

* few items: every task gets the item matrix, queries stream past it, no shuffle at all. Where far
  blocks can be skipped, that is only done for items of one block;
* few queries: every task gets the query matrix, items stream past it, k rows per query and
  task are shuffled;
* neither: items are cut into blocks of about ``block_rows``. A first pass over each query's own
  blocks bounds its k-th distance, and the second pass visits only the blocks that can still hold
  something nearer and returns only what is. For the feature metric, blocks are ranges of one feature;
  for l2 and cosine they are cells around pivots, which the triangle inequality skips. For the inner
  product nothing can be skipped. Cells that lie near each other are kept in groups that fill a task,
  so a query is sent once to a group, with a bit for each cell it visits there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.session import BROADCAST_CELLS, compute_partitions, written

# feature and l2 are squared distances, cosine and ip (inner product) similarities; ranking is
# always ascending on "cost", the distance or the negated similarity
METRICS = ("feature", "l2", "cosine", "ip")
# Costs of queries and items that are held at once, twice as many in single precision.
_CHUNK_CELLS = 1_000_000
# Distances of queries or items and pivots that are held at once.
_PLACED_CELLS = 256_000
# Numbers on either side of pairs whose exact cost is computed at once.
_EXACT_CELLS = 500_000
# Numbers that a task holds of either side; what is more is cut by hash.
GROUP_CELLS = 2_000_000
# Items in a group of cells, however short their vectors: a query meets few of a large group's cells.
GROUP_ROWS = 50_000
# Similarities of shorter vectors are so dense that single precision hardly tells them apart.
_WIDE = 16
# Fewer queries than this are not spread over more tasks.
_LEAST_QUERIES = 1000
# Ranges of the pruning feature; a crowded one is cut further by hash.
_RANGES = 256
# Pivots for each block that the items would fill, and at most.
_PIVOTS_PER_BLOCK = 16
_PIVOTS = 1024
# Shorter vectors have no direction that the triangle inequality could use.
_SHORT = 1e-3


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    if not len(column):
        return np.zeros((0, width))
    return np.concatenate(column.to_numpy()).astype(np.float64, copy=False).reshape(len(column), -1)


def vector_rows(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The same of an Arrow column, without an object for each vector."""
    if column.null_count:
        raise ValueError("a vector is null")
    parts = [c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks]
    if not len(column):
        return np.zeros((0, width))
    return np.concatenate(parts, dtype=np.float64).reshape(len(column), -1)


def _unit(m: np.ndarray) -> np.ndarray:
    return m / (np.sqrt(np.einsum("ij,ij->i", m, m)) + 1e-10)[:, None]


def _prepare(m: np.ndarray, metric: str) -> np.ndarray:
    return _unit(m) if metric == "cosine" else m


def _pair_cost(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Cost of aligned rows; the same two vectors always give the same bits."""
    if metric in ("cosine", "ip"):
        return -np.einsum("ij,ij->i", q, x)
    cost = np.zeros(len(q))
    for j in range(q.shape[1]):
        d = q[:, j] - x[:, j]
        d *= d
        # a feature absent on either side adds nothing
        cost += np.nan_to_num(d, nan=0.0) if metric == "feature" else d
    return cost


def _factors(m: np.ndarray, metric: str, side: str) -> np.ndarray:
    """Rows whose product with the other side's rows is the cost, so that one matrix product
    gives the costs of a whole block."""
    if metric in ("cosine", "ip"):
        return -m if side == "query" else m
    here = ~np.isnan(m)
    v = np.where(here, m, 0.0)
    if metric == "l2":
        here = np.ones((len(m), 1))
        square = (v * v).sum(1, keepdims=True)
    else:
        square = v * v
    here = here.astype(np.float64)
    return np.hstack([square, here, -2.0 * v] if side == "query" else [here, square, v])


def _exact_cost(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray, metric: str):
    """Cost of the pairs of query ``rows`` and item ``cols``, a bounded number at a time."""
    step = max(1, _EXACT_CELLS // max(1, q.shape[1]))
    parts = [_pair_cost(q[rows[at:at + step]], x[cols[at:at + step]], metric)
             for at in range(0, len(rows), step)]
    return np.concatenate(parts) if parts else np.zeros(0)


def item_factors(x: np.ndarray, metric: str) -> tuple[np.ndarray, float]:
    """Factors of a block of items and their greatest squared length, for ``best_in_block``."""
    # similarities of long vectors need few digits to find the k-th place; distances cancel
    few = metric in ("cosine", "ip") and x.shape[1] >= _WIDE
    fx = _factors(x, metric, "item").astype(np.float32 if few else np.float64)
    return fx, np.einsum("ij,ij->i", fx, fx).max() if len(fx) else 0.0


def best_in_block(q: np.ndarray, x: np.ndarray, k: int, metric: str, *, factors=None,
                  limit: np.ndarray | None = None, cell: np.ndarray | None = None,
                  visited: np.ndarray | None = None):
    """(query row, item row, cost) of each query's k cheapest items, ties by item row.

    Items must be ordered by id, so that the row order is the id order. Items that cost more than
    ``limit`` of a query may be left out. With ``cell``, the place of each item's cell, a query meets
    only items of cells that its row of ``visited`` names. ``factors`` are those of the items, if known.
    """
    n_q, n_x = len(q), len(x)
    if not n_q or not n_x or k <= 0:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    fx, longest = item_factors(x, metric) if factors is None else factors
    slack = 1e-5 if fx.dtype == np.float32 else 1e-11
    held = _CHUNK_CELLS * 8 // fx.itemsize
    step = max(1, held // n_x)
    # queries that visit the same cells meet them together
    alike, ends = np.arange(n_q), None
    if visited is not None and visited.all():
        visited = None
    if visited is not None:
        bits = np.packbits(visited, axis=1)
        alike = np.lexsort(bits.T)
        ends = np.flatnonzero(np.r_[(bits[alike[1:]] != bits[alike[:-1]]).any(axis=1), True]) + 1
    out, at = [], 0
    while at < n_q:
        stop = min(n_q, at + step)
        here, allowed = None, None
        if visited is not None:
            stop = max(stop, int(ends[np.searchsorted(ends, at, "right")]))
            used = visited[alike[at:stop]].any(axis=0)
            here = np.flatnonzero(used[cell])
            stop = min(stop, at + max(step, held // max(1, len(here))))
        own = alike[at:stop]
        at = stop
        if visited is not None:
            if not len(here):
                continue
            seen = visited[own]
            allowed = None if seen[:, used].all() else seen[:, cell[here]]
            here = None if len(here) == n_x else here
        fq = _factors(q[own], metric, "query").astype(fx.dtype)
        reach = slack * (1.0 + np.sqrt((fq * fq).sum(1) * longest))
        cost = fq @ (fx if here is None else fx[here]).T
        if cost.shape[1] > k:
            if allowed is not None:
                cost[~allowed] = np.inf
            if limit is None:
                bound = np.partition(cost, k - 1, axis=1)[:, k - 1].astype(np.float64)
            else:
                bound = limit[own].astype(np.float64)
            # keep everything that rounding could have pushed past the k-th place
            near = cost <= _above(bound + reach, cost.dtype)
            if limit is not None:
                many = np.flatnonzero(np.count_nonzero(near, axis=1) > 4 * k)
                if len(many):
                    bound[many] = np.minimum(
                        bound[many], np.partition(cost[many], k - 1, axis=1)[:, k - 1])
                    near[many] = cost[many] <= _above((bound + reach)[many], cost.dtype)
            if allowed is not None:
                near &= allowed
            rows, cols = np.divmod(np.flatnonzero(near.ravel()), near.shape[1])
        elif allowed is not None:
            rows, cols = np.nonzero(allowed)
        else:
            rows, cols = (a.ravel() for a in np.indices(cost.shape))
        cols = cols if here is None else here[cols]
        exact = _exact_cost(q, x, own[rows], cols, metric)
        order = np.lexsort((cols, exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.searchsorted(rows, np.arange(len(own)))
        keep = np.arange(len(rows)) - first[rows] < k
        out.append((own[rows[keep]], cols[keep], exact[keep]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(a) for a in zip(*out))


def _above(bound: np.ndarray, dtype) -> np.ndarray:
    """A column of numbers of that precision that are no less."""
    out = bound.astype(dtype)
    return np.where(out < bound, np.nextafter(out, dtype.type(np.inf)), out)[:, None]


def _sorted_items(frame: pd.DataFrame) -> pd.DataFrame:
    return frame.sort_values("iid", kind="stable").reset_index(drop=True)


def _frame(qids, iids, cost) -> pd.DataFrame:
    return pd.DataFrame({"qid": qids, "iid": iids, "cost": cost})


def nearest(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    metric: str,
    *,
    query_id: str = "query_id",
    item_id: str = "id",
    query_vec: str = "vec",
    item_vec: str = "vec",
    prune_on: int | None = None,
    block_rows: int = 50_000,
    broadcast_cells: int = BROADCAST_CELLS,
) -> DataFrame:
    """(query_id, item_id, score, rank) of the k nearest items of every query.

    ``score`` is a squared distance for ``feature`` and ``l2``, else a similarity.
    ``prune_on`` is the position of the feature used to skip far blocks.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    spark = queries.sparkSession
    q = queries.select(F.col(query_id).alias("qid"),
                       F.col(query_vec).cast("array<double>").alias("qvec"))
    x = items.select(F.col(item_id).alias("iid"),
                     F.col(item_vec).cast("array<double>").alias("ivec"))
    schema = f"qid {q.schema['qid'].dataType.simpleString()}, " \
             f"iid {x.schema['iid'].dataType.simpleString()}, cost double"

    head = x.select(F.size("ivec").alias("w")).head()
    width = max(1, head.w) if head else 1
    # a block of items is compared as a whole, but no more where others can be skipped
    skips = metric in ("l2", "cosine") or (metric == "feature" and prune_on is not None)
    # an item is its vector and id; a query keeps k results in every task besides
    items_here = _small(x, "iid", width, broadcast_cells, block_rows if skips else None)
    few_items = items_here is not None
    queries_here = None
    if not few_items:
        q, x = written(q, "queries"), written(x, "items")  # read several times
        queries_here = _small(q, "qid", width + 2 * k, broadcast_cells)

    if few_items:
        found = _items_to_all(spark, q, items_here, k, metric, schema, width)
    elif queries_here is not None:
        found = _queries_to_all(spark, queries_here, x, k, metric, schema, width)
    else:
        found = _blocks(q, x, k, metric, schema, width, prune_on, block_rows)

    score = -F.col("cost") if metric in ("cosine", "ip") else F.col("cost")
    if not few_items:
        found = _merge(found, k)
    return found.select(F.col("qid").alias(query_id), F.col("iid").alias(item_id),
                        score.alias("score"), F.col("rank").cast("int").alias("rank"))


def _small(df, key, width, cells, most=None):
    """The table itself if it has at most ``cells`` numbers of 8 bytes, ids included, and ``most`` rows,
    else None.

    Rows are counted before any comes to the driver.
    """
    bound = max(1, cells // width)
    bound = bound if most is None else min(bound, most)
    if df.limit(bound + 1).count() > bound:
        return None
    local = df.toPandas()
    texts = local[key].str.len().sum() / 8 if local[key].dtype == object else 0
    return local if len(local) * width + texts <= max(cells, width) else None


def _items_to_all(spark, q, local, k, metric, schema, width):
    local = _sorted_items(local)
    shared = spark.sparkContext.broadcast(
        (local["iid"].to_numpy(), _prepare(_matrix(local["ivec"], width), metric)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, mat = shared.value
        factors = item_factors(mat, metric)
        for b in batches:
            qm = _prepare(_matrix(b["qvec"], width), metric)
            rows, cols, cost = best_in_block(qm, mat, k, metric, factors=factors)
            out = _frame(b["qid"].to_numpy()[rows], ids[cols], cost)
            # rows come grouped by query and ranked: the place inside the group is the rank
            out["rank"] = out.groupby(rows).cumcount().to_numpy() + 1 if len(out) else []
            yield out

    # scoring is bound by CPU, not by bytes: spread queries over all cores
    return q.repartition(compute_partitions(spark), "qid") \
        .mapInPandas(scan, schema + ", rank int")


def _queries_to_all(spark, local, x, k, metric, schema, width):
    shared = spark.sparkContext.broadcast(
        (local["qid"].to_numpy(), _prepare(_matrix(local["qvec"], width), metric)))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, qm = shared.value
        best = None
        limit = np.full(len(qm), np.inf)  # what the k-th of each query costs so far
        for b in batches:
            b = _sorted_items(b)
            xm = _prepare(_matrix(b["ivec"], width), metric)
            rows, cols, cost = best_in_block(qm, xm, k, metric, limit=limit)
            new = pd.DataFrame({"q": rows, "iid": b["iid"].to_numpy()[cols], "cost": cost})
            best = new if best is None else pd.concat([best, new], ignore_index=True)
            best = best.sort_values(["q", "cost", "iid"], kind="stable")
            place = best.groupby("q").cumcount()
            limit[best["q"][place == k - 1]] = best["cost"][place == k - 1]
            best = best[place < k]
        if best is not None:
            yield _frame(qids[best["q"].to_numpy()], best["iid"].to_numpy(),
                         best["cost"].to_numpy())

    return x.mapInPandas(scan, schema)


def _blocks(q, x, k, metric, schema, width, prune_on, block_rows):
    if metric in ("l2", "cosine"):
        return _cells(q, x, k, metric, schema, width, block_rows)
    if metric != "feature" or prune_on is None:
        # nothing can be skipped: every query meets every item
        everything = F.lit(0).alias("block")
        return best_in_shared_blocks(q.select("*", everything), x.select("*", everything), k, metric,
                                     schema, width)

    x, spans = _ranges(x, prune_on, block_rows)
    at = F.get("qvec", prune_on)
    at = F.when(F.isnan(at), F.lit(None)).otherwise(at)
    by_block = F.array(*[F.struct(F.lit(b).alias("block"), F.lit(lo).alias("lo"),
                                  F.lit(hi).alias("hi")) for b, lo, hi in spans])

    def gap(s):
        # least squared difference any item of the range can have; 0 when unknown
        d = F.greatest(s["lo"] - at, at - s["hi"], F.lit(0.0))
        return F.coalesce(d * d, F.lit(0.0))

    # pass 1: the nearest range of each query bounds its k-th distance
    nearest_first = F.array_sort(F.transform(by_block, lambda s: F.struct(
        gap(s).alias("gap"), F.xxhash64("qid", s["block"]).alias("mix"),
        s["block"].alias("block"))))
    q = q.withColumn("home", F.get(nearest_first, 0)["block"])
    x = written(x, "ranges")
    first = written(best_in_shared_blocks(
        q.withColumn("block", F.col("home")), x, k, metric, schema, width), "nearest")
    limit = _merge(first, k).groupBy("qid").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("cost")).alias("kth"))
    # pass 2: every other range that is not provably farther (with room for rounding)
    reach = q.join(limit, "qid", "left").withColumn("near", F.filter(by_block, lambda s: (
        s["block"] != F.col("home")) & (F.col("kth").isNull()
                                        | (gap(s) <= F.col("kth") * (1 + 1e-9)))))
    rest = reach.select("qid", "qvec", "kth", F.explode("near.block").alias("block"))
    second = best_in_shared_blocks(rest, x, k, metric, schema, width)
    return first.unionByName(second)


class Cells:
    """Pivots, and how near and far the items of each one's cell are from it.

    An item lies in the cell of its nearest pivot. Items without a direction or a finite length lie in
    a cell of their own, number -1, that is never skipped.
    """

    def __init__(self, pivots: np.ndarray, metric: str):
        self.pivots, self.metric = pivots, metric
        self.apart = np.sqrt(self._squares(pivots))

    def _squares(self, m: np.ndarray) -> np.ndarray:
        p = self.pivots
        return np.maximum((m * m).sum(1)[:, None] - 2 * m @ p.T + (p * p).sum(1), 0.0)

    def plain(self, m: np.ndarray) -> np.ndarray:
        """Which rows the triangle inequality holds for."""
        size = np.sqrt(np.einsum("ij,ij->i", m, m))
        return np.isfinite(size) & ((size >= _SHORT) if self.metric == "cosine" else True)

    def place(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row and its distance to the pivot."""
        ok = self.plain(m)
        away = self._squares(_prepare(np.where(ok[:, None], m, 0.0), self.metric))
        cell = away.argmin(axis=1)
        return np.where(ok, cell, -1), np.sqrt(away[np.arange(len(m)), cell])

    def measured(self, near: np.ndarray, far: np.ndarray, count: np.ndarray, odd: int,
                 width: int) -> Cells:
        """``odd`` items are in the cell -1, the last one of ``groups``."""
        self.near, self.far, self.count = near, far, count
        self.groups = gathered(near_order(self.pivots), np.r_[count, odd], width)
        return self

    def homes(self, m: np.ndarray, k: int) -> np.ndarray:
        """For each row, whether a cell is among the nearest ones that hold ``k`` items together."""
        order = np.argsort(self._squares(_prepare(m, self.metric)), axis=1, kind="stable")
        have = np.cumsum(self.count[order], axis=1)
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, have - self.count[order] < k, axis=1)
        return out & (self.count > 0)

    def reached(self, m: np.ndarray, kth: np.ndarray) -> np.ndarray:
        """For each row, which cells may hold an item at least as near as the cost ``kth``."""
        ok = self.plain(m)
        away = np.sqrt(self._squares(_prepare(np.where(ok[:, None], m, 0.0), self.metric)))
        # cosine is the distance of unit vectors: |a - b|^2 = 2 - 2 a.b
        square = kth if self.metric == "l2" else 2 + 2 * kth
        limit = np.sqrt(np.maximum(square, 0.0))
        # inside the shell around the pivot, and beyond the plane halfway to the query's own pivot
        least = np.maximum(away - self.far, self.near - away)
        own = away.argmin(axis=1)
        between = self.apart[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (away**2 - (away[np.arange(len(m)), own] ** 2)[:, None]) / (2 * between)
        least = np.maximum(least, np.where(between > 0, plane, 0.0))
        room = 1e-6 * (1 + away + self.far)
        return (~ok[:, None] | ~np.isfinite(kth)[:, None] | (least <= limit[:, None] + room)) \
            & (self.count > 0)


def near_order(p: np.ndarray) -> np.ndarray:
    """Row numbers, near rows behind each other: halved along the widest column again and again."""
    def halved(own):
        if len(own) < 3:
            return own
        widest = np.ptp(p[own], axis=0).argmax()
        own = own[np.argsort(p[own, widest], kind="stable")]
        return np.concatenate([halved(own[:len(own) // 2]), halved(own[len(own) // 2:])])

    return halved(np.arange(len(p)))


def gathered(order: np.ndarray, sizes: np.ndarray, width: int) -> list[np.ndarray]:
    """Cells with items, in groups that fill a task; those that ``order`` does not name come last."""
    rows, groups, have = max(1, min(GROUP_ROWS, GROUP_CELLS // width)), [], 0
    rest = np.setdiff1d(np.arange(len(sizes)), order)
    for c in np.r_[order, rest]:
        if not sizes[c]:
            continue
        if not groups or have + sizes[c] > rows:
            groups.append([])
            have = 0
        groups[-1].append(int(c))
        have += sizes[c]
    return [np.array(g) for g in groups]


def grouped(x: DataFrame, groups: list[np.ndarray], numbers: list[int]) -> DataFrame:
    """Items with the group of their cell (``block``) and the cell's ``place`` in it; ``numbers`` are
    the cells that ``groups`` count by place."""
    at = [(numbers[c], g, i) for g, cells in enumerate(groups) for i, c in enumerate(cells)]
    where = x.sparkSession.createDataFrame(at, "cell int, block int, place int")
    return x.join(F.broadcast(where), "cell").drop("cell")  # a row a cell


def sent(part: pd.DataFrame, seen: np.ndarray, groups: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """The queries of ``part`` for each group that has a cell which they visit, and which ones."""
    for g, cells in enumerate(groups):
        own = seen[:, cells]
        rows = np.flatnonzero(own.any(axis=1))
        if len(rows):
            bits = np.packbits(own[rows], axis=1)
            yield part.iloc[rows].assign(block=np.int32(g), bits=[b.tobytes() for b in bits])


def _measure(x, metric, width, block_rows):
    """Items with the group and place of their cell, and the cells; pivots and one row a cell come back."""
    size = x.count()
    most = max(1, min(_PIVOTS, BROADCAST_CELLS // width, _PIVOTS_PER_BLOCK * -(-size // block_rows)))
    picked = x.orderBy(F.xxhash64("iid"), "iid").limit(most).toPandas()
    m = _matrix(picked["ivec"], width)
    m = m[np.isfinite(m).all(axis=1)] if len(m) else np.zeros((0, width))
    cells = Cells(np.unique(_prepare(m, metric), axis=0) if len(m) else np.zeros((1, width)), metric)
    shared = x.sparkSession.sparkContext.broadcast(cells)
    kind = x.schema["iid"].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            step = max(1, _PLACED_CELLS // len(shared.value.pivots))
            for at in range(0, len(b), step):
                part = b.iloc[at:at + step]
                cell, away = shared.value.place(_matrix(part["ivec"], width))
                yield part.assign(cell=cell.astype("int32"), away=away)

    placed = written(x.mapInPandas(
        place, f"iid {kind}, ivec array<double>, cell int, away double"), "cells")
    stats = {r.cell: r for r in placed.groupBy("cell").agg(
        F.min("away").alias("near"), F.max("away").alias("far"),
        F.count(F.lit(1)).alias("n")).collect()}
    rows = [stats.get(c) for c in range(len(cells.pivots))]
    cells.measured(np.array([r.near if r else 0.0 for r in rows]),
                   np.array([r.far if r else 0.0 for r in rows]),
                   np.array([r.n if r else 0 for r in rows]), stats[-1].n if -1 in stats else 0, width)
    x = grouped(placed.drop("away"), cells.groups, [*range(len(cells.pivots)), -1])
    return x, cells, -1 in stats


def visits(q, cells, odd, k, width, first=None):
    """(qid, qvec, kth, block, bits): the groups with cells that a query visits first, or, given what
    those held, others that may hold something as near; ``bits`` name the cells, ``kth`` is what
    is found so far. ``odd``: whether there are items that no pivot stands for."""
    shared = q.sparkSession.sparkContext.broadcast(cells)
    again = first is not None
    kind = q.schema["qid"].dataType.simpleString()
    if again:
        kth = _merge(first, k).groupBy("qid").agg(
            F.when(F.count(F.lit(1)) >= k, F.max("cost")).alias("kth"))
        q = q.join(kth, "qid", "left")
    else:
        q = q.withColumn("kth", F.lit(None).cast("double"))
    q = q.select("qid", "qvec", F.coalesce("kth", F.lit(float("inf"))).alias("kth"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = shared.value
        for b in batches:
            step = max(1, _PLACED_CELLS // len(cells.pivots))
            for at in range(0, len(b), step):
                part = b.iloc[at:at + step]
                m = _matrix(part["qvec"], width)
                home = cells.homes(m, k)
                seen = cells.reached(m, part["kth"].to_numpy(np.float64)) & ~home if again else home
                odd_too = np.full((len(part), 1), odd and not again)
                yield from sent(part, np.hstack([seen, odd_too]), cells.groups)

    return q.mapInPandas(run, f"qid {kind}, qvec array<double>, kth double, block int, bits binary")


def _cells(q, x, k, metric, schema, width, block_rows):
    x, cells, odd = _measure(x, metric, width, block_rows)
    x = written(x, "groups")
    first = written(best_in_shared_blocks(
        visits(q, cells, odd, k, width), x, k, metric, schema, width, GROUP_ROWS), "nearest")
    second = best_in_shared_blocks(
        visits(q, cells, odd, k, width, first), x, k, metric, schema, width, GROUP_ROWS)
    return first.unionByName(second)


def _merge(found, k):
    w = Window.partitionBy("qid").orderBy("cost", "iid")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _ranges(x, prune_on, block_rows):
    """Number each item's range of one feature; only the edges of at most _RANGES ranges come to
    the driver."""
    n_blocks = min(_RANGES, max(1, -(-x.count() // block_rows)))
    at = F.get("ivec", prune_on)
    x = x.withColumn("at", F.when(F.isnan(at), F.lit(None)).otherwise(at))
    shares = [i / n_blocks for i in range(1, n_blocks)]
    edges = sorted(set(x.agg(F.percentile_approx("at", shares).alias("e")).first()["e"] or [])) \
        if shares else []
    edges = edges or [0.0]  # two ranges at least
    # items without the feature (NaN) form a range of their own
    ranges = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol="at",
                        outputCol="block", handleInvalid="keep")
    x = ranges.transform(x.fillna(float("nan"), ["at"])) \
        .withColumn("block", F.col("block").cast("int")) \
        .withColumn("at", F.when(~F.isnan("at"), F.col("at")))
    stats = x.groupBy("block").agg(F.min("at").alias("lo"), F.max("at").alias("hi")) \
        .orderBy("block").collect()
    inf = float("inf")
    spans = [(s.block, -inf if s.lo is None else s.lo, inf if s.hi is None else s.hi)
             for s in stats]
    return x.select("iid", "ivec", "block"), spans


def best_in_shared_blocks(q, x, k, metric, schema, width, rows=None):
    """Best k per query among the items that share a block with it, per part of the block.

    ``q`` has a row per query and block it visits, and may have a cost ``kth`` beyond which nothing is
    asked for; with ``bits``, it meets only items whose ``place`` they name. Neither side of a block is
    bounded, so a block with many items is cut into parts by hash and one with many queries into
    chunks; every part meets every chunk and no task holds more than about ``GROUP_CELLS`` numbers,
    or ``rows`` rows, of either, or of the results.
    """
    spark = q.sparkSession
    rows = min(rows or GROUP_CELLS, max(1, GROUP_CELLS // width))
    n_x, n_q = ({r.block: r.n for r in df.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
                for df in (x, q))  # a row a block
    share = max(_LEAST_QUERIES, -(-sum(n_q.values()) // (4 * compute_partitions(spark))))
    share = min(share, rows, max(1, GROUP_CELLS // max(1, k)))
    cuts = spark.createDataFrame(
        [(b, -(-n_x[b] // rows), -(-n // share)) for b, n in n_q.items() if b in n_x],
        "block int, parts int, chunks int")
    # a row a block; else Spark, to which their size is unknown, may send out all queries or items instead
    cuts = F.broadcast(cuts)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    q = q.join(cuts, "block").withColumn("part", every("parts")) \
        .withColumn("chunk", own("qid", "chunks"))
    x = x.join(cuts, "block").withColumn("part", own("iid", "parts")) \
        .withColumn("chunk", every("chunks"))

    def found(qs, xs, rows, cols, cost):
        return pa.table({"qid": qs["qid"].take(pa.array(rows)), "iid": xs["iid"].take(pa.array(cols)),
                         "cost": pa.array(cost)})

    def score(qs: pa.Table, xs: pa.Table) -> pa.Table:
        if not len(qs) or not len(xs):
            return found(qs.slice(0, 0), xs.slice(0, 0), *np.zeros((2, 0), int), np.zeros(0))
        # by id, so that the row order is the id order; only numbers are copied, and once
        order = pc.sort_indices(xs, sort_keys=[("iid", "ascending")]).to_numpy()
        chosen = {}
        if "kth" in qs.column_names:
            chosen["limit"] = np.nan_to_num(qs["kth"].to_numpy().astype(np.float64), nan=np.inf,
                                            posinf=np.inf, neginf=-np.inf)
        if "bits" in qs.column_names:
            bits = np.frombuffer(b"".join(qs["bits"].to_pylist()), np.uint8).reshape(len(qs), -1)
            chosen |= {"visited": np.unpackbits(bits, axis=1).astype(bool),
                       "cell": xs["place"].to_numpy()[order].astype(np.int64)}
        x = _prepare(vector_rows(xs["ivec"], width)[order], metric)
        rows, cols, cost = best_in_block(
            _prepare(vector_rows(qs["qvec"], width), metric), x, k, metric, **chosen)
        return found(qs, xs, rows, order[cols], cost)

    keys = ["block", "part", "chunk"]
    theirs = [c for c in ("kth", "bits") if c in q.columns]
    place = [c for c in ("place",) if c in x.columns]
    return q.select(*keys, "qid", "qvec", *theirs).groupBy(*keys).cogroup(
        x.select(*keys, "iid", "ivec", *place).groupBy(*keys)).applyInArrow(score, schema)
