"""Exact top-k inner products, with bounds from segment means and deviations, coarse to fine.

For a vector cut into segments of length l, with mean m and deviation s of each segment,
<q, x> <= sum of l * (m_q * m_x + s_q * s_x), by Cauchy-Schwarz on what is left around the
means. The same statistics bound the distance from below; the inner product is (|q|^2 +
|x|^2 - d^2) / 2. A block of candidates is bounded with 4 segments, what may still beat a
query's k-th score with 16, and only survivors are computed, on integers.

All queries meet all candidates in blocks, in a grid: candidate blocks are dealt into shards,
query blocks into groups, and a cell of the grid holds about CELL of each at most, so that a block
travels once a cell and not once a partner. A cell keeps the k best of each of its queries. Vectors that are null, empty or hold null or non-finite components take no part; vectors
meet vectors of their own length only. Rows that share a vec_id are one query and never
each other's candidates; repeated candidates count once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import materialize, width

BLOCK, SCALE, SEGMENTS = 1024, 256, (4, 16)
#: Pairs whose vectors are gathered at a time.
PAIRS = 1 << 15
#: Candidate blocks and query blocks in a cell; a block has BLOCK vectors.
CELL = (64, 16)
_BLOCKS = "dim int, block long, size int, ids binary, vecs binary"


def integers(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v: array<long> of floor(SCALE * x); rows that take no part are left out."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = rows.where(F.col(vec_id).isNotNull() & (F.size(v) > 0) & ~bad)
    return fine.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * SCALE)).alias("v"))


def narrow(v: np.ndarray) -> tuple[int, bytes]:
    """Bytes an integer, 2 or 8, and the components as little-endian integers of that size."""
    size = 2 if len(v) and -(1 << 15) <= v.min() and v.max() < 1 << 15 else 8
    return size, v.astype(f"<i{size}").tobytes()


def blocks(rows: DataFrame) -> DataFrame:
    """Up to BLOCK vectors of one length a row: ids as 64-bit integers, components in the narrowest that hold them all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for pdf in batches:
            size = pdf["v"].map(len)
            for dim, part in pdf.groupby(size):
                for at in range(0, len(part), BLOCK):
                    some = part.iloc[at : at + BLOCK]
                    yield pd.DataFrame([(dim, number, *narrow(np.concatenate(some["v"].to_numpy())), some["vec_id"].to_numpy("<i8").tobytes())], columns=["dim", "block", "size", "vecs", "ids"])
                    number += 1

    return rows.mapInPandas(run, _BLOCKS)


def _segments(v: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """sqrt(l) * mean and sqrt(l) * deviation of each of at most n segments; products of these sum to the bound."""
    cuts = np.unique(np.linspace(0, v.shape[1], min(n, v.shape[1]) + 1).astype(int))[:-1]
    size = np.diff(np.append(cuts, v.shape[1]))
    mean = np.add.reduceat(v, cuts, axis=1) / size
    square = np.add.reduceat(v * v, cuts, axis=1) / size
    root = np.sqrt(size)
    return root * mean, root * np.sqrt(np.maximum(square - mean * mean, 0))


class Vectors:
    """A block, opened, with its statistics."""

    def __init__(self, ids: bytes, vecs: bytes, dim: int, size: int = 8):
        self.ids = np.frombuffer(ids, "<i8")
        self.v = np.frombuffer(vecs, f"<i{size}").astype(np.int64).reshape(-1, dim)
        self.f = self.v.astype(np.float64)
        self.most = float(np.abs(self.f).max()) if len(self.v) else 0.0
        self.stats = [np.hstack(_segments(self.f, n)) for n in SEGMENTS]


def _better(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def search(q: Vectors, x: Vectors, best: list[tuple[np.ndarray, np.ndarray]], k: int) -> int:
    """Update best[(scores, ids)] of each query with the candidates of a block; returns how many were computed."""
    floor = np.array([s[-1] if len(s) >= k else -np.inf for s, _ in best])
    slack = 1e-9 * (1 + q.most * x.most * q.v.shape[1])
    exact = q.most * x.most * q.v.shape[1] < 2.0**53
    coarse = q.stats[0] @ x.stats[0].T + slack
    if not np.isfinite(floor).all():
        # the best of the coarse bounds give a first k-th score to beat
        lead = np.argpartition(-coarse, min(k, coarse.shape[1] - 1), axis=1)[:, : k + 1]
        for i in np.flatnonzero(~np.isfinite(floor)):
            s = (x.f[lead[i]] @ q.f[i]) if exact else (x.v[lead[i]] @ q.v[i])
            s = np.sort(s[x.ids[lead[i]] != q.ids[i]])[::-1]
            if len(s) >= k:
                floor[i] = s[k - 1]
    rows, cols = np.nonzero(coarse >= floor[:, None])
    done = 0
    for at in range(0, len(rows), PAIRS):
        r, c = rows[at : at + PAIRS], cols[at : at + PAIRS]
        fine = np.einsum("ij,ij->i", q.stats[1][r], x.stats[1][c]) + slack
        r, c = r[fine >= floor[r]], c[fine >= floor[r]]
        own = q.ids[r] != x.ids[c]
        r, c = r[own], c[own]
        done += len(r)
        score = np.einsum("ij,ij->i", q.f[r], x.f[c]).astype(np.int64) if exact else np.einsum("ij,ij->i", q.v[r], x.v[c])
        keep = score >= floor[r]
        r, c, score = r[keep], c[keep], score[keep]
        cuts = np.searchsorted(r, np.arange(len(q.ids) + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[i], cuts[i + 1]
            best[i] = _better(np.append(best[i][0], score[a:b]), np.append(best[i][1], x.ids[c[a:b]]), k)
    return done


def nearest(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score for each of queries(vec_id, v) against candidates(vec_id, v)."""
    few = materialize(queries.select("vec_id", "v").dropDuplicates(["vec_id"]))
    q = materialize(blocks(few.repartition(max(1, few.count() // BLOCK))))
    x = materialize(blocks(candidates))
    shards = max(width(candidates.sparkSession), -(-x.count() // CELL[0]))
    groups = max(1, -(-q.count() // CELL[1]))
    dealt = lambda df, n: F.pmod(F.xxhash64(df["block"]), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = x.withColumn("shard", dealt(x, shards)).withColumn("group", every(groups))
    q = q.withColumn("group", dealt(q, groups)).withColumn("shard", every(shards))

    def run(xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = lambda df: [(Vectors(r.ids, r.vecs, r.dim, r.size), r.dim) for r in df.itertuples(index=False)]
        theirs = rows(xs) if len(qs) else []
        for query, dim in rows(qs):
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in query.ids]
            for other, size in theirs:
                if size == dim:
                    search(query, other, best, k)
            out.append((np.repeat(query.ids, [len(s) for s, _ in best]), np.concatenate([i for _, i in best]), np.concatenate([s for s, _ in best])))
        ids, others, scores = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pd.DataFrame({"query_id": ids, "vec_id": others, "score": scores})

    found = x.groupBy("shard", "group").cogroup(q.groupBy("shard", "group")).applyInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def digest(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The contract's row: the k best of all rows for each row whose id is divisible by ``every``."""
    rows = integers(embeddings)
    return nearest(rows, rows.where(F.col("vec_id") % every == 0), k)
