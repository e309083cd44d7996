"""Near copies: sets of five-word shingles with Jaccard similarity of SIMILAR or more.

SimHash finds the first candidates: fingerprints of the sets, of which those within
three bits meet in their balls (:mod:`colloquy.llm.simhash`). At similarity 0.8 some ten
of 64 bits differ, and balls of half that radius are far too many, so banded min-hashes
find the rest. Exact set similarity decides on every candidate of either kind. Two sets meet in
a bucket of one of BANDS bands if the ROWS minima of that band agree; at similarity 0.8
all bands miss with a chance of (1 - 0.8^5)^32, 3 in a million, and less above. Equal
sets are one node, so exact copies cost one row. A bucket first tests its members
against its least and its most central one (whose buckets hold most rows: the text that the
others were made from, if it is there), which links a large group of copies without its
pairs; then every pair in a bucket whose members these links did not join is tested too.

Texts under WORDS words are one shingle; texts without words are copies of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm import simhash
from colloquy.llm.common import discard, materialize, opened, sealed
from colloquy.llm.components import components

WORDS, SEED = 5, simhash.SEED
#: Similarity as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 32, 5
#: Classes of set size to a factor of e, so that sizes of one class differ by some 3 %.
SIZES = 32
#: Shingles hashed at a time.
CHUNK = 1024
#: Ids up to which they are broadcast (at most 32 MB) instead of shuffling the texts.
BROADCAST_IDS = 4_000_000

_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
_MUL = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    return np.unique(simhash.hashes(text, WORDS))


def buckets(h: np.ndarray) -> np.ndarray:
    """A bucket's name for each band of a set; none for the empty set."""
    if not len(h):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), CHUNK):
        np.minimum(least, ((h[at : at + CHUNK] ^ _XOR) * _MUL).min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for m in least.reshape(BANDS, ROWS).T:
        out = (out ^ m) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import xxhash

    for pdf in batches:
        keys, fps, names = [], [], []
        for t in pdf["text"]:
            h = shingles(t)
            keys.append(xxhash.xxh64_intdigest(h.tobytes(), SEED))
            fps.append(simhash.majority(h))
            names.append(buckets(h))
        yield pdf.assign(key=np.array(keys, np.uint64).view(np.int64), fp=np.array(fps, np.uint64).view(np.int64), buckets=names)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"key": pdf["key"], "set": [shingles(t).view(np.int64) for t in pdf["text"]]})


def _component_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"key": pdf["key"], "component": pdf["component"], "set": [shingles(t).view(np.int64) for t in pdf["text"]]})


def _similar(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs(u, v) of nodes whose sets are similar."""
    some = materialize(pairs.select(F.col("u").alias("key")).union(pairs.select("v")).distinct())
    texts = prints.select("key", "text").hint("merge").join(some, "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))
    sets = materialize(texts.mapInPandas(_sets, "key long, set array<long>"))
    discard(some)
    of = lambda c: sets.select(F.col("key").alias(c), F.col("set").alias(f"set_{c}"))
    both = pairs.hint("merge").join(of("u"), "u").hint("merge").join(of("v"), "v")
    same, total = F.size(F.array_intersect("set_u", "set_v")), F.size("set_u") + F.size("set_v")
    a, b = SIMILAR
    return materialize(both.where((a + b) * same >= a * total).select("u", "v"))


def _prefixes(nodes: DataFrame, prints: DataFrame) -> DataFrame:
    """key, component, n, shingle, pos of nodes(key, component): the places from 0 of a set of n ordered by how many of the nodes have a shingle, rarest first.

    Only the first fifth of each set, which its partner's first ninth must meet, and no shingle that one node alone has.
    """
    texts = prints.select("key", "text").hint("merge").join(nodes, "key").groupBy("key", "component").agg(F.min("text").alias("text"))
    sets = texts.mapInPandas(_component_sets, "key long, component long, set array<long>")
    rows = materialize(sets.select("key", "component", F.explode("set").alias("shingle")))
    held = materialize(rows.groupBy("shingle").agg(F.count("*").alias("f")))
    order = rows.hint("merge").join(held, "shingle").groupBy("key", "component").agg(F.sort_array(F.collect_list(F.struct("f", "shingle"))).alias("set"))
    n = F.size("set")
    first = order.select("key", "component", n.alias("n"), F.posexplode(F.slice("set", 1, F.floor(n / 5).cast("int") + 1)).alias("pos", "at"))
    out = materialize(first.where("at.f > 1").select("key", "component", "n", "at.shingle", "pos"))
    discard(rows, held)
    return out


def _crossing(members: DataFrame, found: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs(u, v) of nodes of different components of found(node, component) that may be similar, for all nodes of buckets of members(bucket, key) that found does not join.

    Sets x and y, x the smaller, are similar if 9 times what they share is at least
    4 (|x| + |y|). If the first shingle that they share is at place i of x and j of y, they
    share |x| - i and |y| - j at most, so they meet where 9 i <= 5 |x| - 4 |y| and
    9 j <= 5 |y| - 4 |x| or they are not similar. y asks only in the classes of size that
    its j leaves open, so what a family has in common is met by those alone that have too little of
    their own, and these are mostly joined already: where one component has most rows of a
    shingle, its rows meet only those of others.
    """
    named = materialize(members.hint("merge").join(found, members["key"] == found["node"], "left").select("bucket", "key", F.coalesce("component", "key").alias("component")))
    split = materialize(named.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("bucket"))
    nodes = materialize(named.hint("merge").join(split, "bucket", "left_semi").select("key", "component").distinct())
    rows = _prefixes(nodes, prints)
    size = lambda c: F.floor(F.log(c) * SIZES).cast("int")
    index = rows.where("9 * pos <= n").select("shingle", size("n").alias("size"), F.col("key").alias("kx"), F.col("component").alias("cx"), F.col("n").alias("nx"), F.col("pos").alias("i"))
    low, high = F.ceil(F.col("n") * 4 / 5), F.least(F.col("n"), F.floor((F.col("n") * 5 - F.col("pos") * 9) / 4))
    asked = rows.where(low <= high).select("shingle", F.explode(F.sequence(size(low), size(high))).alias("size"), F.col("key").alias("ky"), F.col("component").alias("cy"), F.col("n").alias("ny"), F.col("pos").alias("j"))
    index, asked = materialize(index), materialize(asked)
    at = ["shingle", "size"]
    held = asked.groupBy(*at, F.col("cy").alias("c")).agg(F.count("*").alias("k")).union(index.groupBy(*at, F.col("cx").alias("c")).agg(F.count("*").alias("k")))
    held = held.groupBy(*at, "c").agg(F.sum("k").alias("k"))
    most = materialize(held.groupBy(*at).agg(F.count("*").alias("cs"), F.max_by("c", F.struct("k", "c")).alias("most")).where("cs > 1").select(*at, "most"))
    x = materialize(index.hint("merge").join(most, at).withColumn("own", F.expr("cx = most")).drop("most"))
    y = materialize(asked.hint("merge").join(most, at).withColumn("other", F.expr("cy <> most")).drop("most"))
    near = "cx <> cy AND (nx < ny OR nx = ny AND kx < ky) AND 9 * i <= 5 * nx - 4 * ny AND 9 * j <= 5 * ny - 4 * nx"
    meet = lambda x, y: x.hint("merge").join(y, at).where(near).select(F.least("kx", "ky").alias("u"), F.greatest("kx", "ky").alias("v"))
    out = materialize(meet(x, y.where("other")).union(meet(x.where("NOT own"), y.where("NOT other"))).distinct())
    discard(named, split, nodes, rows, index, asked, most, x, y)
    return out


def _balls(nodes: DataFrame) -> DataFrame:
    """Pairs(u, v) of nodes(key, fp) whose fingerprints are equal or linked by their balls; a fingerprint's nodes meet its least one."""
    least = materialize(nodes.groupBy("fp").agg(F.min("key").alias("hub")))
    met = materialize(simhash.links(simhash.candidates(least.select("fp"))))
    of = lambda c, k: least.select(F.col("fp").alias(c), F.col("hub").alias(k))
    far = met.hint("merge").join(of("u", "a"), "u").hint("merge").join(of("v", "b"), "v").select("a", "b")
    same = nodes.hint("merge").join(least, "fp").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    return far.union(same).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _components(nodes: DataFrame, prints: DataFrame) -> DataFrame:
    """node, component of nodes(key, fp, buckets) that are similar to another."""
    rows = materialize(nodes.select("key", F.explode("buckets").alias("bucket")))
    met = materialize(rows.groupBy("bucket").agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("bucket", "lo", "n"))
    members = materialize(rows.hint("merge").join(met, "bucket"))
    company = members.groupBy("key").agg(F.sum("n").alias("company"))
    mid = members.hint("merge").join(company, "key").groupBy("bucket").agg(F.max_by("key", F.struct("company", "key")).alias("mid"))
    hubs = members.hint("merge").join(materialize(mid), "bucket").select("key", F.explode(F.array("lo", "mid")).alias("hub")).where("key <> hub")
    star = hubs.select(F.least("key", "hub").alias("u"), F.greatest("key", "hub").alias("v"))
    star = materialize(star.union(_balls(nodes.select("key", "fp"))).distinct())
    discard(rows, met)
    links = _similar(star, prints)
    found = materialize(components(links))
    rest = materialize(_crossing(members.select("bucket", "key"), found, prints).hint("merge").join(star, ["u", "v"], "left_anti"))
    discard(star, members)
    if rest.isEmpty():
        return found
    more = _similar(rest, prints)
    return found if more.isEmpty() else materialize(components(links.union(more)))


def representatives(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: its least doc_id's. Rows that share that id, and rows without an id, stay."""
    prints = materialize(opened(sealed(docs).mapInPandas(_prints, "doc_id long, no_id boolean, text string, key long, fp long, buckets array<long>")))
    first = [F.any_value(c).alias(c) for c in ("fp", "buckets")]  # the same for all rows of a key
    nodes = materialize(prints.groupBy("key").agg(F.min("doc_id").alias("doc_id"), *first))
    found = _components(nodes, prints)
    named = nodes.hint("merge").join(found, nodes["key"] == found["node"], "left")
    keep = named.groupBy(F.coalesce("component", "key").alias("component")).agg(F.min("doc_id").alias("doc_id"))
    keep = materialize(keep.where("doc_id IS NOT NULL").select("doc_id").distinct())
    discard(prints, nodes)
    keep = F.broadcast(keep) if keep.count() <= BROADCAST_IDS else keep.hint("merge")
    return docs.join(keep, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
