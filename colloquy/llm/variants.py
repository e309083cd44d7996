"""Spelling variants by blocked Gram matrices.

Two words that differ by one inserted, deleted or replaced letter have letter counts at a squared
distance of 1 or 2. Words are dealt into blocks by length, and within a length by their counts of
five groups of letters; a near word's block is the word's own, or one that has one more in a
group, or one more in one and one less in another. So a word meets its own block and 15 beside it,
not its length's whole vocabulary, and no near pair is lost. Blocks are cut into tiles of at
most TILE words (TILE_CHARS characters), two tiles of adjacent blocks give one NumPy product
of their count matrices, |x|^2 + |y|^2 - 2 x y is the squared distance of all their words, and pairs
at most two apart are verified letter by letter, all at once.

Counts are exact in doubles up to words of 90 million letters. Tiles are made from a range
sort by block, which splits a block that has a third of all words; Spark splits the join's hot
blocks. Occurrences are summed before they are shuffled, and a word's partners are reduced to their
number and the best, so no list of them is ever gathered.

A word's form is its near word of largest n, ties to the first in code-point order, if that is at
least TIMES the word's own; roots follow forms by doubling. Null and empty texts have no words; a
row without an id has its words as they are; repeated rows count again. Columns other than doc_id and
text are ignored, whatever their names. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import ascii_lower, discard, materialize, width

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, OFTEN, TIMES, DELETE = 6, 5, 5, 199
#: Words, and characters, in a tile at most.
TILE, TILE_CHARS = 1024, 1 << 22
#: Letters in five groups of like frequency; all others are the last group.
GROUPS = ("ei", "ats", "nor", "ldcu", "")

_TILES = "key string, tile long, length int, words array<string>, ns array<long>"


def occurrences(docs: DataFrame, delete: int | None = DELETE) -> DataFrame:
    """word, n of all runs of letters, in lower case; where ``delete`` divides a run's hash with its document's id, the run lacks a letter.

    Shorter words are left out, before they are counted: a run is never longer than its letters.
    """
    found = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    run = found.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), ascii_lower(F.col("run")).alias("run"))
    if delete is None:
        return run.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    # the hash is the same for all of a document's repeats, but counting them first would keep a row a document and word
    h = F.crc32(F.concat(F.col("doc_id"), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(h % delete == 0, less).otherwise(F.col("run"))
    return run.select(word.alias("word")).where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n"))


def _key(word) -> list:
    counts = [F.length(word) - F.length(F.translate(word, g, "")) for g in GROUPS[:-1]]
    return [*counts, F.length(word) - sum(counts[1:], counts[0])]


def tiles(words: DataFrame) -> DataFrame:
    """key, tile, length, words, ns: up to TILE words of one block a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, key = TaskContext.get().partitionId() << 32, [], None
        for pdf in batches:
            out = []
            for k, w, n in zip(pdf["key"], pdf["word"], pdf["n"].tolist(), strict=True):
                if held and (k != key or len(held) >= TILE or len(held) * len(w) >= TILE_CHARS):
                    out.append((key, number, len(held[0][0]), *map(list, zip(*held, strict=True))))
                    number, held = number + 1, []
                key = k
                held.append((w, n))
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([(key, number, len(held[0][0]), *map(list, zip(*held, strict=True)))], columns=columns)

    columns = ["key", "tile", "length", "words", "ns"]
    keyed = words.select(F.concat_ws(",", *(c.cast("string") for c in _key(F.col("word")))).alias("key"), "word", "n")
    ranged = keyed.repartitionByRange(width(words.sparkSession), "key", "word").sortWithinPartitions("key", "word")
    return ranged.mapInPandas(run, _TILES)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words of one length, a row each, and how often each of the alphabet's letters is in each."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
    known = np.unique(codes)
    index = np.searchsorted(known, codes) + np.arange(len(words))[:, None] * len(known)
    counts = np.bincount(index.ravel(), minlength=len(words) * len(known)).reshape(len(words), -1)
    full = np.zeros((len(words), 256), np.float64)
    full[:, known] = counts
    return codes, full


def near(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the pairs one edit apart; each list has words of one length, b's the same or one more."""
    (x, cx), (y, cy) = letters(a), letters(b)
    squared = (cx * cx).sum(axis=1)[:, None] + (cy * cy).sum(axis=1)[None, :] - 2 * (cx @ cy.T)
    i, j = np.nonzero(squared <= 2)
    size, keep = x.shape[1], []
    for lo in range(0, len(i), rows := max(1, TILE_CHARS // size)):
        u, v = x[i[lo : lo + rows]], y[j[lo : lo + rows]]
        if y.shape[1] == size:
            keep.append((u != v).sum(axis=1) == 1)
        else:
            head = np.cumprod(u == v[:, :-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
            tail = np.cumprod((u == v[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
            keep.append(head + tail >= size)
    ok = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[ok], j[ok]


def partners(words: DataFrame) -> DataFrame:
    """word, near, near_n: both ways for all pairs of words one edit apart; words are distinct and at least one letter long."""
    cut = materialize(tiles(words))
    m = len(GROUPS)
    k = F.transform(F.split("key", ","), lambda s: s.cast("int"))
    steps = [[0] * m]
    steps += [[int(g == i) for g in range(m)] for i in range(m)]
    steps += [[int(g == i) - int(g == j) for g in range(m)] for i in range(m) for j in range(i)]
    keys = F.array(*(F.concat_ws(",", *((k[g] + s[g]).cast("string") for g in range(m))) for s in steps))
    other = cut.select("key", F.col("tile").alias("o_tile"), F.col("words").alias("o_words"), F.col("ns").alias("o_ns"))
    asked = cut.select(F.col("key").alias("own"), "tile", "words", "ns", F.explode(keys).alias("key"))
    # the tiles' sizes are those of the files, but what explode makes of them is not known beforehand: no broadcast
    met = asked.hint("merge").join(other, "key").where((F.col("own") != F.col("key")) | (F.col("tile") <= F.col("o_tile")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for same, a, an, b, bn in zip(pdf["same"].tolist(), pdf["words"], pdf["ns"], pdf["o_words"], pdf["o_ns"], strict=True):
                a, an, b, bn = list(a), np.asarray(an), list(b), np.asarray(bn)
                i, j = near(a, b)
                if same:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    a, b = np.array(a, object), np.array(b, object)
                    out.append(pd.DataFrame({"word": np.concatenate([a[i], b[j]]), "n": np.concatenate([an[i], bn[j]]), "near": np.concatenate([b[j], a[i]]), "near_n": np.concatenate([bn[j], an[i]])}))
            if out:
                yield pd.concat(out)

    met = met.select((F.col("tile") == F.col("o_tile")).alias("same"), "words", "ns", "o_words", "o_ns")
    return met.mapInPandas(run, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): forms followed to the last, twice as far each round."""
    got = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = got.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        # hint: words that share a form are many, forms few; both are tables with real sizes
        step = materialize(got.join(on.hint("merge"), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")))
        discard(got)
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        got = step


def grouped(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of distinct (word, n)."""
    words = materialize(words.where(F.col("n") >= OFTEN))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    few = partners(words).groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("n"), best.alias("best"))
    enough = -F.col("best.minus") >= TIMES * F.col("n")
    few = materialize(few.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n")))
    root = roots(few.where("form IS NOT NULL"))
    got = words.join(few.hint("merge"), "word", "left").join(root.hint("merge"), "word", "left")
    return got.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row for each word."""
    return grouped(occurrences(docs))
