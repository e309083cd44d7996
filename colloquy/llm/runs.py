"""Periodic runs of words, by block convolution at dyadic scales.

At scale B a text's words, as integers, are cut into blocks of B, and each block is laid over the
window that follows: sum (x - y)^2 = sum x^2 + sum y^2 - 2 sum xy for all offsets at once, the
last sum by number-theoretic transforms of all blocks together. Integers stay exact: as many
primes are taken as the largest possible sum needs, so a sum is zero if it is zero by all. A zero
is an occurrence, and its distance d a seed, from which the stretch of words equal to those d
later is extended both ways.

A run of period q and length max(24, 3 q) or more has a seed: with q in [B, 2 B) its first 2 q
words hold a whole block, and the words q later are in the run still; blocks of 8 do so for all q
below 16. A stretch whose period q divides d is found again at d; it is kept for its least period.

Blocks are convolved only if each of their words comes again within the window's reach, since
others have no occurrence there. Seeds of one distance in neighbouring blocks are one stretch.

A text is worked on alone, in memory in proportion to its words, whatever their number; transforms
are done CELLS integers at a time. Null and empty texts have no words and no runs. Rows that share
an id, or have none, are documents of their own; repeated rows give repeated rows. Columns other
than doc_id and text are ignored, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import opened, sealed

WORD = r"[^\x20\x09-\x0D]+"
SHORTEST, TIMES, BLOCK = 24, 3, 8
#: Primes c 2^k + 1 with a generator; transforms have up to 2^26 places.
PRIMES = ((2013265921, 31), (469762049, 3))
#: Integers in a transform, and places compared, at a time.
CELLS = 1 << 20
#: Characters in a batch of rows of the output.
BATCH = 1 << 24

_FOUND = "doc_id long, no_id boolean, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


@functools.lru_cache(maxsize=64)
def _roots(p: int, g: int, n: int, inverse: bool) -> np.ndarray:
    """The first n / 2 powers of an n-th root of one."""
    w = pow(g, (p - 1) // n * (n - 1 if inverse else 1), p)
    out = np.ones(1, np.uint64)
    while len(out) < n // 2:
        out = np.concatenate([out, out * np.uint64(pow(w, len(out), p)) % np.uint64(p)])
    return out


def transform(x: np.ndarray, p: int, g: int) -> np.ndarray:
    """Number-theoretic transforms of the rows, in bit-reversed order; the length is a power of two."""
    (rows, n), m = x.shape, np.uint64(p)
    roots, half = _roots(p, g, n, False), n // 2
    while half:
        a = x.reshape(rows, -1, 2, half)
        u, v = a[:, :, 0], a[:, :, 1]
        x = np.stack([(u + v) % m, (u + (m - v)) * roots[:: n // (2 * half)] % m], axis=2)
        half //= 2
    return x.reshape(rows, n)


def restore(x: np.ndarray, p: int, g: int) -> np.ndarray:
    """The inverse of :func:`transform`."""
    (rows, n), m = x.shape, np.uint64(p)
    roots, half = _roots(p, g, n, True), 1
    while half < n:
        a = x.reshape(rows, -1, 2, half)
        u, v = a[:, :, 0], a[:, :, 1] * roots[:: n // (2 * half)] % m
        x = np.stack([(u + v) % m, (u + (m - v)) % m], axis=2)
        half *= 2
    return x.reshape(rows, n) * np.uint64(pow(n, -1, p)) % m


def occurrences(ids: np.ndarray, at: np.ndarray, size: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of zero squared differences between the blocks at ``at`` and what lies first to last words later.

    ids: integers from 1 on. What lies beyond the text is 0 and so equals nothing.
    """
    n = 1 << (last - first + size - 1).bit_length()
    padded = np.concatenate([ids, np.zeros(last + size + n, np.int64)])
    most, primes = size * int(ids.max()) ** 2, PRIMES[:1]
    if most >= PRIMES[0][0]:
        primes = PRIMES
    starts, distances = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(at), rows := max(1, CELLS // n)):
        b = at[lo : lo + rows]
        block, window = padded[b[:, None] + np.arange(size)], padded[b[:, None] + np.arange(first, first + n)]
        zero = np.ones((len(b), last - first + 1), bool)
        for p, g in primes:
            m = np.uint64(p)
            x, y = block.astype(np.uint64) % m, window.astype(np.uint64) % m
            turned = np.zeros((len(b), n), np.uint64)
            turned[:, -np.arange(size) % n] = x
            cross = restore(transform(turned, p, g) * transform(y, p, g) % m, p, g)[:, : last - first + 1]
            squares = np.concatenate([np.zeros((len(b), 1), np.uint64), np.cumsum(y * y % m, axis=1)], axis=1)
            sums = squares[:, size : size + last - first + 1] - squares[:, : last - first + 1]
            zero &= ((x * x % m).sum(axis=1, keepdims=True) + sums + (m - cross) * np.uint64(2)) % m == 0
        i, d = np.nonzero(zero)
        starts.append(b[i])
        distances.append(d + first)
    return np.concatenate(starts), np.concatenate(distances)


def reach(ids: np.ndarray, at: np.ndarray, distance: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on, one step (1 or -1) after another, equal those ``distance`` later."""
    out, live, w, last = np.zeros(len(at), np.int64), np.arange(len(at)), 8, len(ids) - 1
    while len(live):
        on = []
        for lo in range(0, len(live), rows := max(1, CELLS // w)):
            some = live[lo : lo + rows]
            i = (at[some] + step * out[some])[:, None] + step * np.arange(w)
            j = i + distance[some][:, None]
            miss = (i < 0) | (j > last) | (ids[np.clip(i, 0, last)] != ids[np.clip(j, 0, last)])
            ends = miss.any(axis=1)
            out[some] += np.where(ends, miss.argmax(axis=1), w)
            on.append(some[~ends])
        live, w = np.concatenate(on), min(2 * w, 4096)
    return out


def periodic(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the integers from 1 on, by start, then period."""
    n = len(ids)
    if n < SHORTEST:
        return []
    order = np.argsort(ids, kind="stable")
    again = np.full(n, n, np.int64)  # how far on the same word comes again
    gap = np.diff(order)
    same = ids[order[1:]] == ids[order[:-1]]
    again[order[:-1][same]] = gap[same]
    furthest = again[: n // BLOCK * BLOCK].reshape(-1, BLOCK).max(axis=1)
    found: dict[tuple[int, int], int] = {}
    size = BLOCK
    while size == BLOCK or TIMES * size <= n:
        first, last = 1 if size == BLOCK else size, 2 * size - 1
        at = np.flatnonzero(furthest <= last) * size
        if len(at):
            b, d = occurrences(ids, at, size, first, last)
            while first <= last:
                own = (d >= first) & (d < 2 * first)
                _extend(ids, b[own], d[own], size, found)
                first *= 2
        furthest = furthest[: len(furthest) // 2 * 2].reshape(-1, 2).max(axis=1)
        size *= 2
    return sorted((s, e - s, q) for (s, e), q in found.items())


def _extend(ids: np.ndarray, b: np.ndarray, d: np.ndarray, size: int, found: dict[tuple[int, int], int]) -> None:
    """Adds the runs that the seeds lie in to ``found``: (start, end) to period."""
    order = np.lexsort((b, d))
    b, d = b[order], d[order]
    chained = np.zeros(len(b), bool)
    chained[1:] = (d[1:] == d[:-1]) & (b[1:] == b[:-1] + size)
    b, d = b[~chained], d[~chained]
    order = np.argsort(b, kind="stable")
    b, d = b[order], d[order]
    known = np.zeros(len(b), bool)
    if len(b):
        for (s, e), q in found.items():
            lo, hi = np.searchsorted(b, (s, e))
            known[lo:hi] |= (b[lo:hi] + size + d[lo:hi] <= e) & (d[lo:hi] % q == 0)
    b, d = b[~known], d[~known]
    right = reach(ids, b, d, 1)
    start, end = b - reach(ids, b - 1, d, -1), b + right + d
    good = (right >= size) & (end - start >= np.maximum(SHORTEST, TIMES * d))
    for s, e, q in zip(start[good].tolist(), end[good].tolist(), d[good].tolist(), strict=True):
        found[s, e] = min(q, found.get((s, e), q))


def detected(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs, collapsed (the text's words, one space between them, without each run's words after its first period)."""
    find = re.compile(WORD).findall

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "no_id", "n_words", "runs", "collapsed"]
        out: list[tuple] = []
        held = 0
        for pdf in batches:
            for doc, no_id, text in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), pdf["text"], strict=True):
                words, runs = find(text), []
                if len(words) >= SHORTEST:
                    number = {w: i for i, w in enumerate(dict.fromkeys(words), 1)}
                    runs = periodic(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                kept = words
                if runs:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s, length, q in runs:
                        edge[s + q] += 1
                        edge[s + length] -= 1
                    kept = [w for w, k in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not k]
                out.append((doc, no_id, len(words), [{"start": s, "length": length, "period": q} for s, length, q in runs], " ".join(kept)))
                held += len(text) + 64
                if held >= BATCH:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=columns)

    return opened(sealed(docs).mapInPandas(run, _FOUND))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text, in which every tenth document by crc32 of its id (no id: none) repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    got = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), words.alias("_w"), F.size(words).alias("_n"))
    a = F.when(F.col("_n") > 0, F.col("_g") % F.col("_n"))
    got = got.withColumn("_a", a.cast("int"))
    got = got.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    # a period is more than a tenth of what it fills, so ten of them do
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), 10)), F.lit(1), F.col("_n") - F.col("_a"))
    text = F.when(F.col("_p").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), tail), " "))
    return got.select("doc_id", text.alias("text"))


def _longest(runs: Column) -> Column:
    """The run of greatest length / period; ties: least start, then period."""

    def compare(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(x > y, -1).when(x < y, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(F.signum(a["period"] - b["period"]).cast("int"))

    return F.get(F.array_sort(runs, compare), F.lit(0))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row for each document, of its planted words."""
    best = _longest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    got = detected(planted(docs)).withColumn("_best", best)
    return got.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("_best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
