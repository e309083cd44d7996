"""SimHash fingerprints, and links within a Hamming radius of 3 by meet-in-the-middle balls.

Two fingerprints within 3 bits meet halfway: some value is within one bit of one of them
and within two of the other. Every fingerprint that may have a partner emits the values
within one bit (near) and, if its number of set bits is even, those at two bits (far): of
two fingerprints three bits apart one is even. All that meet at a value where one is near
are within the radius, so each value links them to its least near one; the links are as
many as the members, not their pairs.

Which fingerprints may have a partner is found first with smaller balls: of three equal
parts of the bits one holds a differing bit (if there is one), so without that part two
bits differ at most, and one-bit balls over the other two parts meet. A fingerprint alone
in all of these has no partner and emits nothing more.

A link is kept if the two fingerprints differ in RADIUS bits or fewer, which their meeting
already implies. A null text has no words: fingerprint zero, linked like any other. A null
doc_id is linked but never the least; a group of null ids only has a null component.
Repeated rows come out repeated. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import discard, materialize, opened, sealed
from colloquy.llm.components import components

WORDS, SEED, RADIUS = 3, 42, 3
#: Bits of the parts of which one is left out.
PARTS = ((0, 22), (22, 43), (43, 64))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANE = (np.arange(8) * 256).astype(np.int64)
#: Ids up to which they are broadcast (at most 32 MB) instead of shuffling the texts.
BROADCAST_IDS = 4_000_000


def hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle of a text, repeats included."""
    import xxhash

    found = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII blanks only
    if not found:
        return np.zeros(0, np.uint64)
    whole = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    k = min(words, len(found))
    stop = ends[k - 1 :].tolist()
    begin = [0, *(ends[: len(found) - k] + 1).tolist()]
    of = xxhash.xxh64_intdigest
    return np.array([of(whole[a:b], SEED) for a, b in zip(begin, stop, strict=True)], np.uint64)


def majority(h: np.ndarray) -> int:
    """Unsigned 64-bit SimHash: the bits that are set in over half of the hashes."""
    lanes = h.view(np.uint8).reshape(-1, 8) + _LANE
    ones = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int.from_bytes(np.packbits(ones.ravel() * 2 > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str, words: int = WORDS) -> int:
    """Unsigned 64-bit SimHash of the shingles of a text; 0 without words."""
    return majority(hashes(text, words))


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (long, the bits of the fingerprint)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["doc_id", "no_id"]].assign(fp=np.array([fingerprint(t, words) for t in pdf["text"]], np.uint64).view(np.int64))

    return opened(sealed(docs).mapInPandas(run, "doc_id long, no_id boolean, fp long"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits: range | list[int]) -> list[int]:
    return [1 << b for b in bits]


def _explode(masks: list[tuple[int, int, int]], fp: Column) -> Column:
    """((fp & keep) ^ flip) | tag for each (keep, flip, tag)."""
    rows = F.array(*(F.struct(F.lit(_signed(k)).alias("k"), F.lit(_signed(f)).alias("f"), F.lit(_signed(t)).alias("t")) for k, f, t in masks))
    return F.explode(F.transform(rows, lambda r: fp.bitwiseAND(r["k"]).bitwiseXOR(r["f"]).bitwiseOR(r["t"])))


def _xor(flips: list[int], fp: Column) -> Column:
    return F.transform(F.array(*(F.lit(_signed(f)) for f in flips)), lambda f: fp.bitwiseXOR(f))


def candidates(prints: DataFrame) -> DataFrame:
    """The rows of prints(fp), all distinct, that share a one-bit ball with another without one of PARTS."""
    full = (1 << 64) - 1
    masks = []
    for i, (a, b) in enumerate(PARTS):
        part = ((1 << b) - 1) ^ ((1 << a) - 1)
        keep, tag = full ^ part, (i + 1) << a
        masks += [(keep, f, tag) for f in [0, *_flips([x for x in range(64) if not a <= x < b])]]
    met = prints.select(_explode(masks, F.col("fp")).alias("key"), "fp").withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1")
    return materialize(met.select("fp").distinct())


def links(some: DataFrame) -> DataFrame:
    """(u, v): links that join all fingerprints of some(fp) within RADIUS."""
    one, two = _flips(range(64)), [(1 << a) | (1 << b) for a in range(64) for b in range(a)]
    even = F.bit_count("fp") % 2 == 0
    near = F.transform(_xor([0, *one], F.col("fp")), lambda z: F.struct(z.alias("z"), F.lit(True).alias("near")))
    far = F.transform(_xor(two, F.col("fp")), lambda z: F.struct(z.alias("z"), F.lit(False).alias("near")))
    balls = some.select("fp", F.explode(F.when(even, F.concat(near, far)).otherwise(near)).alias("b")).select("fp", "b.z", "b.near")
    hub = F.min(F.when(F.col("near"), F.col("fp"))).over(Window.partitionBy("z"))
    met = balls.withColumn("hub", hub).where("hub IS NOT NULL AND hub <> fp").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()
    return met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)


def grouped(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp, component_id for each row of docs(doc_id, text)."""
    prints = materialize(fingerprints(docs, words))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("doc")))
    some = candidates(nodes.select("fp"))
    met = materialize(links(some))
    found = materialize(components(met))
    named = nodes.hint("merge").join(found, nodes["fp"] == found["node"], "left").select("fp", "doc", F.coalesce("component", "fp").alias("component"))
    named = materialize(named)
    least = materialize(named.groupBy("component").agg(F.min("doc").alias("component_id")))
    named_ = materialize(named.hint("merge").join(least, "component").select("fp", "component_id"))
    discard(nodes, some, met, found, named, least)
    return prints.hint("merge").join(named_, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row: doc_id, fingerprint (16 hex digits), component_id."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with one row of each group: its least doc_id's. Rows that share that id, and rows without an id, stay."""
    keep = materialize(grouped(docs.select("doc_id", "text"), words).where("doc_id = component_id").select("doc_id").distinct())
    keep = F.broadcast(keep) if keep.count() <= BROADCAST_IDS else keep.hint("merge")
    return docs.join(keep, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
