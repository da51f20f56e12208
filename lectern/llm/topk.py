"""Exact top-k by inner product with Fagin's threshold algorithm over sorted lists per dimension."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows of a block of candidates, and of a block of queries.
CANDIDATES, QUERIES = 8_192, 4_096
#: Entries read from each list in the first round; each round that follows reads twice as many.
FIRST = 16


def _top(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


class SortedLists:
    """A block of integer vectors with, for each dimension, its rows in ascending order of value."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.order = np.argsort(self.rows, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.rows, self.order, 0)
        # sums of float64 products are exact below 2 ** 53
        self.most = float(np.abs(rows).max(initial=0))
        self.fast = self.rows.astype(np.float64)

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the k best rows but `own`, and how many rows were scored.

        Each round reads on in all lists, from the side that the query's sign favours, and scores the
        rows seen for the first time. No row unseen can score more than the query has with the values
        last read; when that bound is less than the k-th score, the rest can't enter the result. When
        the next round would read more entries than there are rows left, those are scored at once.
        """
        n = len(self.ids)
        use = np.flatnonzero(query)
        down = query[use] > 0
        fast = float(np.abs(query).max(initial=0)) * self.most * len(query) < 2**52
        q = query.astype(np.float64) if fast else query
        data = self.fast if fast else self.rows
        unseen = np.ones(n, bool)
        mine = np.searchsorted(self.ids, own)
        while mine < n and self.ids[mine] == own:
            unseen[mine] = False
            mine += 1
        best_ids, best, depth, width, scored = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, FIRST, 0
        while depth < n and len(use):
            stop = min(n, depth + width)
            seen = np.concatenate((self.order[depth:stop, use[~down]].ravel(), self.order[n - stop : n - depth, use[down]].ravel()))
            fresh = np.zeros(n, bool)
            fresh[seen] = True
            fresh = np.flatnonzero(fresh & unseen)
            unseen[fresh] = False
            if len(fresh):
                score = (data[fresh] @ q).astype(np.int64)
                scored += len(fresh)
                if len(best) == k:
                    better = score >= best[-1]
                    fresh, score = fresh[better], score[better]
                ids, score = np.concatenate((best_ids, self.ids[fresh])), np.concatenate((best, score))
                keep = _top(score, ids, k)
                best_ids, best = ids[keep], score[keep]
            last = np.where(down, self.sorted[n - stop, use], self.sorted[stop - 1, use])
            bound = sum(int(a) * int(b) for a, b in zip(last, query[use], strict=True)) if not fast else int(last.astype(np.float64) @ q[use])
            if len(best) == k and bound < best[-1]:
                break
            depth, width = stop, width * 2
            rest = np.flatnonzero(unseen)
            if width * len(use) >= len(rest):  # reading on costs more than scoring every row left
                score = (data @ q).astype(np.int64)[rest]
                scored += len(rest)
                ids, score = np.concatenate((best_ids, self.ids[rest])), np.concatenate((best, score))
                keep = _top(score, ids, k)
                return ids[keep], score[keep], scored
        if not len(use):  # every score is 0
            keep = np.flatnonzero(unseen)[:k]
            return self.ids[keep], np.zeros(len(keep), np.int64), len(keep)
        return best_ids, best, scored


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        asks = np.asarray(table.column("asks").combine_chunks())
        rows = np.asarray(table.column("v").combine_chunks().flatten(), np.int64).reshape(len(ids), -1)
        lists = SortedLists(ids[~asks], rows[~asks])
        out: list = [[], [], []]
        for own, q in zip(ids[asks].tolist(), rows[asks], strict=True):
            found, score, _ = lists.top(q, k, own)
            out[0].append(np.full(len(found), own))
            out[1].append(found)
            out[2].append(score)
        cols = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
        return pa.table(cols, names=["query_id", "vec_id", "score"])

    return run


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k rows of greatest integer inner product.

    Components become floor(scale * x), x as double. Queries are the rows whose vec_id is divisible
    by `every`; candidates are all rows of other vec_ids. Ties go to the smaller vec_id; with fewer
    candidates a query gets them all, with none no row. Vectors that are null or empty, or hold null
    or non-finite components, and rows with a null vec_id take no part; vectors of different lengths
    don't meet. Of rows that repeat a vec_id the smallest vector counts. Scores must fit a long.

    Blocks of CANDIDATES rows meet blocks of QUERIES; each pair of blocks runs the threshold algorithm
    and gives k rows a query, of which a window keeps the best. So no task holds more than two blocks,
    and what is shuffled back grows with queries times blocks, not with pairs.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    v = v.where("vec_id is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    v = v.select("vec_id", F.transform("e", lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    v = v.withColumn("dim", F.size("v"))
    count = v.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    cblocks, qblocks = max(1, -(-count.n // CANDIDATES)), max(1, -(-count.q // QUERIES))
    rows = v.select(F.pmod(F.xxhash64("vec_id"), F.lit(cblocks).cast("long")).alias("c"), F.explode(F.expr(f"sequence(0L, {qblocks - 1}L)")).alias("q"), "dim", "vec_id", F.lit(False).alias("asks"), "v")
    asks = v.where(F.col("vec_id") % every == 0)
    asks = asks.select(F.explode(F.expr(f"sequence(0L, {cblocks - 1}L)")).alias("c"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(qblocks).cast("long")).alias("q"), "dim", "vec_id", F.lit(True).alias("asks"), "v")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])
    found = rows.unionAll(asks).groupBy("c", "q", "dim").applyInArrow(_search(k), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
