"""Exact top-k inner products by Fagin's threshold algorithm.

Components become floor(1024 * x). Candidates are dealt to blocks of bounded size by hash, queries to blocks of their
own, and each pair of blocks meets once. Within a block equal vectors are one entry with their smallest ids; every
dimension has a list sorted by value. A query walks the lists of its non-zero dimensions from the side that favours it,
scores what is new, and stops when the bound, the score of a vector as good as the lists' present ends, is below its
kth result (not at a tie, as a smaller id may still come). The blocks' results merge by a ranked window.

Cases: null vectors and those with a null or non-finite component take no part, nor does a null id; vectors of different
length don't meet; a row isn't its own result, but a row that repeats its id and vector (as integers) is one row, and
vectors that share an id are queries and candidates of their own, whose results are ranked together under that id; fewer
candidates than k give all; an empty table gives an empty result; other columns are ignored. A score beyond 64 bits is set to the
nearest 64-bit value before scores are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BLOCK_ROWS = 8192
QUERY_ROWS = 16384
_LIMIT = 1 << 63


def whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x): float64 if sums of products are exact in it, else Python integers."""
    f = np.floor(1024.0 * x)
    big = float(np.abs(f).max(initial=0))
    if big * big * max(f.shape[-1], 1) < 2**53:
        return f
    return np.vectorize(int, otypes=[object])(f) if f.size else f.astype(object)


class Lists:
    """Distinct vectors of a block, their ids, and the sorted list of each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        seen: dict[object, int] = {}
        self.ids: list[list[int]] = []
        rows = []
        for i, v in enumerate(vectors):
            name = v.tobytes() if vectors.dtype != object else tuple(v)
            at = seen.setdefault(name, len(rows))
            if at == len(rows):
                rows.append(i)
                self.ids.append([])
            own = self.ids[at]
            if len(own) <= k and (not own or own[-1] != ids[i]):
                own.append(int(ids[i]))
        self.vectors = vectors[rows]
        self.order = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.sort(self.vectors, axis=0).T.copy()

    def top(self, me: int, q: np.ndarray, k: int) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id) without me, best first, and how many vectors were scored."""
        n = len(self.vectors)
        dims = np.flatnonzero(q != 0)
        seen = np.zeros(n, dtype=bool)
        scored_at: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        ahead = [int(d) for d in dims]
        depth, step = 0, 8
        best = np.zeros(0)
        while depth < n and len(ahead):
            stop = min(n, depth + step)
            rise, fall = dims[q[dims] > 0], dims[q[dims] < 0]
            fresh = np.concatenate([self.order[rise, n - stop : n - depth].ravel(), self.order[fall, depth:stop].ravel()])
            mark = np.zeros(n, dtype=bool)
            mark[fresh] = True
            mark &= ~seen
            new = np.flatnonzero(mark)
            seen |= mark
            if len(new):
                s = self.vectors[new] @ q
                if s.dtype == object:
                    s = np.array([max(-_LIMIT, min(_LIMIT - 1, x)) for x in s], dtype=object)
                scored_at.append(new)
                scores.append(s)
                count = np.array([len(self.ids[j]) for j in new]) if len(best) < k else None
                best = np.sort(np.concatenate([best, np.repeat(s, np.minimum(count, k + 1)) if count is not None else s]))[-(k + 1) :]
            bound = (self.values[rise, n - stop] * q[rise]).sum() + (self.values[fall, stop - 1] * q[fall]).sum()
            if len(best) > k and bound < best[0]:
                break
            depth, step = stop, step * 2
        if not len(ahead):
            scored_at, scores = [np.arange(n)], [np.zeros(n, dtype=self.vectors.dtype)]
        at = np.concatenate(scored_at) if scored_at else np.zeros(0, int)
        s = np.concatenate(scores) if scores else np.zeros(0)
        keep = np.argsort(-s, kind="stable")
        out: list[tuple[int, int]] = []
        for j in keep:
            if len(out) >= k and int(s[j]) < out[k - 1][0]:
                break
            out += [(int(s[j]), i) for i in self.ids[at[j]] if i != me]
            out.sort(key=lambda x: (-x[0], x[1]))
            del out[k:]
        return out, int(seen.sum())


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    flat = table.column(name).combine_chunks()
    values = np.asarray(flat.flatten(), dtype=np.float64)
    return values.reshape(len(flat), len(values) // len(flat))


def _meet(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if queries.num_rows and rows.num_rows:
            both = whole(np.concatenate([_matrix(queries, "v"), _matrix(rows, "v")]))
            lists = Lists(np.asarray(rows.column("vec_id")), both[queries.num_rows :], k)
            for me, q in zip(queries.column("vec_id").to_pylist(), both[: queries.num_rows], strict=True):
                out += [(me, i, s) for s, i in lists.top(me, q, k)[0]]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns, strict=True)})

    return run


def top_inner_products(vectors: DataFrame, k: int = 10, query_filter: str = "vec_id % 100 = 0", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that passes query_filter the k rows of greatest inner product."""
    v = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    # Multiples of 1 / 1024 only, so that vectors which are equal as integers are equal rows.
    v = v.withColumn("v", F.transform("v", lambda x: F.when(F.abs(x) < float(1 << 50), F.floor(x * 1024).cast("double") / 1024).otherwise(x)))
    v = v.filter("vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))").distinct().withColumn("dim", F.size("v"))
    n, n_q = v.agg(F.count("*"), F.count(F.when(F.expr(query_filter), 1))).first()
    n_rows, n_queries = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n_q // QUERY_ROWS))
    rows = v.withColumn("row_block", F.pmod(F.xxhash64("vec_id"), F.lit(n_rows)).cast("int")).withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    queries = v.filter(query_filter).withColumn("query_block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_queries)).cast("int")).withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    by = ["dim", "query_block", "row_block"]
    found = queries.groupBy(*by).cogroup(rows.groupBy(*by)).applyInArrow(_meet(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2(vectors: DataFrame) -> DataFrame:
    return top_inner_products(vectors)
