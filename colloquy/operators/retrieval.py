"""Batch retrieval: dense inner products and BM25, the best k passages a query."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.numeric import r4, r6
from colloquy.operators.datasets import ranges
from colloquy.operators.graph import BROADCAST_ROWS
from colloquy.sources.cache import cut

K1, B = 1.2, 0.75
#: Vectors in a range of the corpus, and queries (about) that meet a range at once.
RANGE, QUERIES = 4096, 1024
#: Scores are rounded to six places; products that lie further below the k-th can't tie with it.
SLACK = 2e-6


def _products(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Queries(qid, q, _bad) and a range(_r, vec_id, embedding, _odd) -> the pairs that may be among the k best of a query in the range, with their products.

    A matrix product, whose sums are in no set order, tells which pairs these are; those get the sum component by component. Of equal sums
    the k smallest ids are enough. A null component or another length makes the product null, as it does in SQL; infinities and NaN are summed too.
    """

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right, out = right.sort_values("vec_id", ignore_index=True), []
        ids, p = right["vec_id"].to_numpy(), int(right["_r"].iloc[0]) if len(right) else 0
        size, n_q = right["embedding"].map(len).to_numpy(), left["q"].map(len).to_numpy()
        fine, good = ~right["_odd"].to_numpy(dtype=bool), ~left["_bad"].to_numpy(dtype=bool)

        def put(rows: np.ndarray, at: np.ndarray, score: np.ndarray | None) -> None:
            value = np.full(len(rows), np.nan) if score is None else score
            # NaN comes back from pandas as null
            out.append(pd.DataFrame({"qid": left["qid"].to_numpy()[rows], "vec_id": ids[at], "__p": p, "score": value, "nan": np.isnan(value) & (score is not None), "scored": len(ids)}))

        for d in np.unique(n_q):
            for sound in (True, False):
                rows = np.flatnonzero((n_q == d) & (good == sound))
                same = np.flatnonzero(fine & (size == d)) if sound else np.array([], dtype=int)
                none = np.setdiff1d(np.arange(len(ids)), same)[:k]
                put(np.repeat(rows, len(none)), np.tile(none, len(rows)), None)
                if not len(same):
                    continue
                x = np.stack(right["embedding"].to_numpy()[same]).astype("float64")
                longest = np.sqrt((x * x).sum(axis=1).max())
                for lo in range(0, len(rows), 256):
                    part = rows[lo : lo + 256]
                    q = np.stack(left["q"].to_numpy()[part]).astype("float64")
                    with np.errstate(all="ignore"):
                        a = q @ x.T
                        odd = ~np.isfinite(a)
                        a[odd] = -np.inf
                        least = np.partition(a, len(same) - k, axis=1)[:, len(same) - k] if len(same) > k else np.full(len(part), -np.inf)
                        slack = SLACK + 1e-12 * np.sqrt((q * q).sum(axis=1)) * longest
                        r, c = np.nonzero(odd | ~(a < (least - slack)[:, None]))
                        s = np.zeros(len(r))
                        for j in range(d):
                            s += q[r, j] * x[c, j]
                    order = np.lexsort((c, -s, r))
                    r, c, s = r[order], c[order], s[order]
                    new = np.ones(len(r), dtype=bool)
                    new[1:] = (r[1:] != r[:-1]) | ~((s[1:] == s[:-1]) | (np.isnan(s[1:]) & np.isnan(s[:-1])))
                    at = np.arange(len(r))
                    keep = at - np.maximum.accumulate(np.where(new, at, 0)) < k
                    put(part[r[keep]], same[c[keep]], s[keep])
        return pd.concat(out) if out and len(ids) else pd.DataFrame({c: [] for c in ("qid", "vec_id", "__p", "score", "nan", "scored")})

    return run


def dense(queries: DataFrame, corpus: DataFrame, k: int, rows: int = RANGE) -> DataFrame:
    """queries(qid, q), corpus(vec_id, embedding) -> qid, vec_id, score, rank, scored: the k largest inner products, exactly, ties to the smaller vec_id.

    The corpus lies in ranges of about ``rows`` vectors by norm, longest first, and |q| |x| bounds a product. Queries
    meet the first range, then twice as many ranges a time, but only those whose longest vector may still beat their
    k-th score. scored is how many vectors a query was multiplied with. Vectors of one norm bound nothing: then a
    query meets all ranges. A block of queries meets a range by a matrix product in a task, which keeps what may be among the k best of a query. Rows with a null id or vector take no part.
    """
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    c = corpus.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding", norm("embedding").alias("_m"))
    n = max(1, -(-corpus.count() // rows))
    c = ranges(c, [F.desc("_m"), F.col("vec_id")], n)
    top = cut(c.groupBy("__p").agg(F.max("_m").alias("_most")))  # a row a range
    q = cut(queries.where("qid IS NOT NULL AND q IS NOT NULL").select("qid", "q", norm("q").alias("_n")))
    kind = c.schema["vec_id"].dataType
    best = cut(q.select("qid", F.lit(None).cast(kind).alias("vec_id"), F.lit(None).cast("double").alias("score"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("scored")).limit(0))
    blocks = max(1, -(-q.count() // QUERIES))
    q, c = (d.withColumn("_bad", F.exists(v, lambda x: x.isNull())) for d, v in ((q.withColumn("_b", F.pmod(F.xxhash64("qid"), F.lit(blocks))), "q"), (c, "embedding")))
    schema = f"qid {q.schema['qid'].dataType.simpleString()}, vec_id {kind.simpleString()}, __p int, score double, nan boolean, scored long"
    lo, wide = 0, 1
    while lo < n:
        floor = best.groupBy("qid").agg(F.max(F.when(F.col("rank") == k, F.col("score"))).alias("_floor"))
        # scores are rounded to six places
        beats = F.col("_floor").isNull() | (F.col("_n") * F.col("_most") >= F.col("_floor") - 1e-6)
        some = F.broadcast(top.where(F.col("__p").between(lo, lo + wide - 1)))
        met = cut(q.hint("merge").join(floor, "qid", "left").join(some, beats).select("qid", "q", "_bad", "__p", "_b"))
        side = met.select(F.col("__p").alias("_r"), F.col("_b").alias("_q")).distinct().hint("merge").join(c.select("vec_id", "embedding", F.col("_bad").alias("_odd"), "__p"), F.col("_r") == F.col("__p")).drop("__p")
        d = met.groupBy("__p", "_b").cogroup(side.groupBy("_r", "_q")).applyInPandas(_products(k), schema)
        d = d.withColumn("score", F.when(F.col("nan"), F.lit(float("nan"))).otherwise(r6("score")))
        w = Window.partitionBy("qid", "__p")
        d = d.withColumn("_k", F.row_number().over(w.orderBy(F.desc("score"), "vec_id"))).where(F.col("_k") <= k)
        both = d.select("qid", "vec_id", "score", F.when(F.col("_k") == 1, F.col("scored")).otherwise(0).alias("scored")).unionByName(best.select("qid", "vec_id", "score", F.when(F.col("rank") == 1, F.col("scored")).otherwise(0).alias("scored")))
        last = Window.partitionBy("qid")
        both = both.withColumns({"rank": F.row_number().over(last.orderBy(F.desc("score"), "vec_id")), "scored": F.sum("scored").over(last)})
        best = cut(both.where(F.col("rank") <= k).select("qid", "vec_id", "score", "rank", "scored"))
        lo, wide = lo + wide, 2 * wide
    return best


def bm25(queries: DataFrame, docs: DataFrame, qid: str, did: str, k: int, text: str = "text") -> DataFrame:
    """qid, did, score: postings joined on the word with the query's words, summed by document.

    Only the queries' words are counted apart; a document's others go into one sum, which its length needs.
    """
    split = lambda df, key: df.select(key, F.explode(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")).alias("w"))
    q = cut(split(queries, qid).distinct())
    asked, tokens = cut(q.select("w").distinct().withColumn("_q", F.lit(True))), split(docs, did).withColumn("_c", F.lit(1))
    if asked.count() <= BROADCAST_ROWS:
        tokens = tokens.join(F.broadcast(asked), "w", "left")
    else:
        tokens = tokens.groupBy(did, "w").agg(F.count("*").alias("_c")).hint("merge").join(asked, "w", "left")
    tf = cut(tokens.groupBy(did, F.when(F.col("_q"), F.col("w")).alias("w")).agg(F.sum("_c").alias("tf")))
    size = tf.groupBy(did).agg(F.sum("tf").alias("len"))
    stats = F.broadcast(size.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")))
    wanted = tf.where("w IS NOT NULL")
    df = wanted.groupBy("w").agg(F.count("*").alias("df"))
    d = wanted.hint("merge").join(df, "w").hint("merge").join(size, did).crossJoin(stats)
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * ((1 - B) + B * F.col("len") / F.col("avg_len")))
    s = d.select(did, "w", weight.alias("x")).hint("merge").join(q, "w").groupBy(qid, did).agg(r4(F.sum("x")).alias("score"))
    w = Window.partitionBy(qid).orderBy(F.desc("score"), did)
    return s.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).select(qid, did, "score")
