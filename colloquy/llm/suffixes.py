"""Removal of repeated byte strings by distributed prefix doubling.

A byte goes if a string of LENGTH bytes over it also starts earlier (smaller doc_id, or
earlier in the same document). Prefix doubling gives every position a rank for its first
h bytes, sorts the pairs (rank at i, rank at i + offset) at growing offsets, and drops
positions as they become unique, until the prefixes are past the threshold. Only equality of ranks
matters here, so a rank is a 64-bit name, made from the pair of names below it.

* h = 1, 2, 4, ... 32: pairs at offsets 1 to 16 lie in one task's buffer and are named there.
* h = 32, sorted by Spark: only anchors are sent. The anchor of a LENGTH-byte string is its least
  32-byte name (the first, if several). It depends on the string's bytes alone, so equal
  strings have their anchors at the same place in them, and a string whose anchor's name
  occurs once is unique: thinning to anchors loses none. The strings of one anchor start at
  consecutive positions, a segment, which falls as a whole with its anchor. A segment that
  equals an earlier one goes as a whole.
* h = 66, in the same sort: pairs (rank at p - 34, rank at p) and (rank at p, rank at p + 34) around an
  anchor p, by 8 bits of their names; the half of a segment whose pair occurs once is dropped.
* h = LENGTH, sorted by Spark: every position that is left, by the pair (rank of 64 bytes at i,
  rank of 64 bytes at i + 36), in the order of documents and places; the first of each pair stays.

Two different strings are taken as equal only if both 64-bit ranks of the last round agree
(or, for whole segments, the names of a segment and of its anchor).
Before each shuffle a batch keeps the earliest of its own equal keys, so a string that
a third of all documents hold costs a row a batch.

Null texts are empty; texts under LENGTH bytes lose nothing. A null doc_id comes first.
A document is a distinct pair of doc_id and text (its hash, the tag): texts that share a
doc_id, or have none, come one after the other by tag and lose only their own repeats.
Rows with the same doc_id and text count as one document and lose the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import discard, materialize, opened

LENGTH, SEED = 100, 32
SPREAD = LENGTH - SEED + 1  # places that a seed can have in a string
HALF = (LENGTH - SEED) // 2
#: Positions that a task names at a time.
CHUNK = 1 << 18
#: Bytes of spans (two longs each, and 64 a document) up to which they are broadcast instead of shuffling the texts.
BROADCAST_BYTES = 64 << 20
NO_ID = -(1 << 63)

_M, _N, _LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64((1 << 20) - 1)
_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROW = "key long, next long, seg long, doc long, tag long, w long, kind int"
SHIPPED, OPEN, GONE = 0, 1, 2


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of concatenations from the names of the parts."""
    h = a * _N + b
    h ^= h >> np.uint64(31)
    h *= _M
    return h


def names(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the 4 and of the 32 bytes from each position."""
    h, four = _BYTE[buf], None
    for k in (1, 2, 4, 8, 16):
        h = pair(h[:-k], h[k:])
        if k == 2:
            four = h
    return four, h


def ends(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the first and of the last 64 of the LENGTH bytes from positions ``at``."""
    return pair(h[at], h[at + 32]), pair(h[at + LENGTH - 64], h[at + LENGTH - 32])


def whole(four: np.ndarray, h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Names of the LENGTH bytes from positions ``at``."""
    return pair(pair(h[at], h[at + 32]), pair(h[at + 64], four[at + 96]))


def _chunks(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of whole documents, long ones in overlapping parts: bytes, and of each part its document, its offset there and its place in the buffer (with the end)."""
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([0, *(len(x) for _, _, x in parts)])
        return np.frombuffer(b"".join(x for _, _, x in parts), np.uint8), np.array([d for d, _, _ in parts]), np.array([o for _, o, _ in parts]), np.cumsum(sizes)

    for doc, text in zip(pdf["doc"].tolist(), pdf["text"], strict=True):
        raw = text.encode("utf-8", "surrogatepass")
        for at in range(0, len(raw) - LENGTH + 1, CHUNK):
            parts.append((doc, at, raw[at : at + CHUNK + LENGTH - 1]))
            size += len(parts[-1][2])
            if size >= CHUNK:
                yield out()
                parts, size = [], 0
    if parts:
        yield out()


def anchors(buf: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each segment in a buffer: its anchor, first and last string start, part, name of 32 bytes, name of the segment with its 66-byte marks packed for :func:`_level_32`."""
    four, h = names(buf)
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    for k in (1, 2, 4, 8, 16, 32):
        key = np.minimum(key[:-k], key[k:])
    at = (np.minimum(key[: -(SPREAD - 64)], key[SPREAD - 64 :]) & _LOW).astype(np.int64)  # anchor of each start
    part = np.repeat(np.arange(len(places) - 1), np.diff(places))[: len(at)]
    ok = np.arange(len(at)) + LENGTH <= places[part + 1]
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(part, prepend=-1) != 0))
    last = np.append(new[1:], len(at)) - 1
    last = np.minimum(last, places[part[new] + 1] - LENGTH)
    good = ok[new]
    first, last = new[good], last[good]
    p, part = at[first], part[first]
    seg = pair(pair(whole(four, h, first), whole(four, h, last)), ((p - first) * 128 + last - first).astype(np.uint64))
    left = pair(h[np.maximum(p - HALF, 0)], h[p])
    right = pair(h[p], h[np.minimum(p + HALF, len(h) - 1)])
    marks = (((left >> np.uint64(56)) << np.uint64(8)) | (right >> np.uint64(56))).astype(np.int64)
    return p, first, last, part, h[p], seg.view(np.int64), marks


def _first_of(doc: np.ndarray, at: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lead): rows by keys, document, place; lead marks the first of each key."""
    order = np.lexsort((at, doc, *keys))
    lead = np.ones(len(order), bool)
    lead[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, lead


def _runs(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals [lo, hi] of starts, sorted and joined where they touch, document by document."""
    if not len(doc):
        return doc, lo, hi
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    group = np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1
    span = int(hi.max()) + 2
    top = np.maximum.accumulate(hi + group * span) - group * span
    new = np.append(True, (doc[1:] != doc[:-1]) | (lo[1:] > top[:-1] + 1))
    begin = np.flatnonzero(new)
    return doc[begin], lo[begin], np.maximum.reduceat(hi, begin)


def _rows(key: np.ndarray, seg: np.ndarray, doc: np.ndarray, w: np.ndarray, kind: int, then: np.ndarray | int = 0) -> pd.DataFrame:
    return pd.DataFrame({"key": key, "next": then, "seg": seg, "doc": doc, "w": w, "kind": np.full(len(doc), kind, np.int32)})


def _gone(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
    """Rows for intervals of removed strings; their key only spreads them."""
    doc, lo, hi = _runs(doc, lo, hi)
    return _rows((doc.astype(np.uint64) * _M + lo.astype(np.uint64) * _N).view(np.int64), lo, doc, hi, GONE)


def _coded(pdf: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """pdf with doc as a place among the batch's documents in order, and these documents."""
    each = pdf[["doc", "tag"]].drop_duplicates().sort_values(["doc", "tag"], ignore_index=True)
    code = pd.MultiIndex.from_frame(each).get_indexer(pd.MultiIndex.from_frame(pdf[["doc", "tag"]]))
    return pdf.assign(doc=code), each


def _decoded(rows: pd.DataFrame, each: pd.DataFrame) -> pd.DataFrame:
    """rows with doc and tag for places; keys that only spread rows get the tag too."""
    code = rows["doc"].to_numpy(np.int64)
    doc, tag = each["doc"].to_numpy(np.int64)[code], each["tag"].to_numpy(np.int64)[code]
    key = rows["key"].to_numpy(np.int64)
    return pd.DataFrame({"key": np.where(rows["kind"] > 0, key ^ tag, key), "next": rows["next"], "seg": rows["seg"], "doc": doc, "tag": tag, "w": rows["w"], "kind": rows["kind"]})


def _name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = []
        pdf, each = _coded(pdf)
        for buf, docs, offsets, places in _chunks(pdf):
            p, first, last, part, name, seg, marks = anchors(buf, places)
            move = offsets[part] - places[part]
            got.append((name.view(np.int64), seg, docs[part], p + move, p - first, last - first, marks))
        if not got:
            continue
        name, seg, doc, p, left, more, marks = (np.concatenate(x) for x in zip(*got, strict=True))
        order, lead = _first_of(doc, p, seg)
        head = order[lead][np.cumsum(lead) - 1]
        again, order = order[(doc[order] != doc[head]) | (p[order] != p[head])], order[lead]
        lo = p[again] - left[again]
        yield _decoded(_gone(doc[again], lo, lo + more[again]), each)
        w = (p << 32) | (left << 24) | (more << 16) | marks
        name, seg, doc, p, w = name[order], seg[order], doc[order], p[order], w[order]
        order, lead = _first_of(doc, p, name)
        several = np.zeros(len(order), bool)
        several[np.flatnonzero(lead)] = np.diff(np.append(np.flatnonzero(lead), len(order))) > 1
        ship, rest = order[lead], order[~lead]
        out = _rows(name[ship], seg[ship], doc[ship], w[ship], SHIPPED)
        out["kind"] = np.where(several[lead], SHIPPED - 1, SHIPPED).astype(np.int32)  # -1: the batch has more of this name
        yield _decoded(out, each)
        yield _decoded(_rows((doc[rest].astype(np.uint64) * _M + p[rest].astype(np.uint64) * _N).view(np.int64), seg[rest], doc[rest], w[rest], OPEN), each)


def _level_32(rows: DataFrame) -> DataFrame:
    """doc, tag, kind, lo, hi: removed intervals, and of open segments the anchor and the first and last start that are left."""
    # one shuffle by key and sent serves all windows; the marks in w's low bits see what stands beside a document in a task's buffer, so they don't order
    rows = rows.withColumn("sent", F.col("kind") <= 0).repartition("key", "sent")
    group = Window.partitionBy("key", "sent")
    same = Window.partitionBy("key", "sent", "seg").orderBy("doc", "tag", F.shiftright("w", 16))
    bits = lambda shift, n: F.shiftright("w", shift).bitwiseAND(F.lit((1 << n) - 1))
    rows = rows.withColumn("lead", F.rank().over(same) == 1)
    rows = rows.withColumns({"n": F.count_if("lead").over(group), "many": F.min("kind").over(group) < 0})
    rows = rows.where("kind > 0 OR many OR n > 1 OR NOT lead").withColumns({"l": bits(8, 8), "r": bits(0, 8)})
    half = lambda c: F.count_if("lead").over(Window.partitionBy("key", "sent", c)) > 1
    rows = rows.withColumns({"keep_l": (F.col("kind") > 0) | F.col("many") | half("l"), "keep_r": (F.col("kind") > 0) | F.col("many") | half("r")})
    p = F.shiftright("w", 32)
    first = p - bits(24, 8)
    last = first + bits(16, 8)
    fallen = (F.col("kind") <= 0) & ~F.col("lead")
    lo = F.when(F.col("keep_l"), first).otherwise(F.greatest(first, p - (HALF - 1)))
    hi = F.when(F.col("keep_r"), last).otherwise(F.least(last, p - (HALF + 1)))
    out = rows.select(
        "doc",
        "tag",
        F.when(fallen | (F.col("kind") == GONE), GONE).otherwise(OPEN).alias("kind"),
        F.when(F.col("kind") == GONE, F.col("seg")).when(fallen, first).otherwise(lo).alias("lo"),
        F.when(F.col("kind") == GONE, F.col("w")).when(fallen, last).otherwise(hi).alias("hi"),
    )
    return out.where((F.col("kind") == GONE) | (F.col("lo") <= F.col("hi")))


def _whole_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of the last round: a name for every start that is left in a document's open segments."""
    for pdf in batches:
        got, pieces, size = [], [], 0
        pdf, each = _coded(pdf)

        def flush() -> None:
            h = names(np.frombuffer(b"".join(x for _, _, _, x in pieces), np.uint8))[1]
            n = np.array([hi - lo + 1 for _, lo, hi, _ in pieces])
            skip = np.cumsum([0, *(len(x) for _, _, _, x in pieces)])[:-1]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            got.append((*ends(h, np.repeat(skip, n) + step), np.repeat([d for d, _, _, _ in pieces], n), np.repeat([lo for _, lo, _, _ in pieces], n) + step))

        for doc, text, los, his in zip(pdf["doc"].tolist(), pdf["text"], pdf["lo"], pdf["hi"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            los, his = np.asarray(los, np.int64), np.asarray(his, np.int64)
            his = np.minimum(his, len(raw) - LENGTH)  # for texts whose tags collide
            _, los, his = _runs(np.zeros(len(los), np.int64), los[los <= his], his[los <= his])
            for lo, hi in zip(los.tolist(), his.tolist(), strict=True):
                pieces.append((doc, lo, hi, raw[lo : hi + LENGTH]))
                size += len(pieces[-1][3])
                if size >= CHUNK:
                    flush()
                    pieces, size = [], 0
        if pieces:
            flush()
        if not got:
            continue
        name, then, doc, at = (np.concatenate(x) for x in zip(*got, strict=True))
        name, then = name.view(np.int64), then.view(np.int64)
        order, lead = _first_of(doc, at, then, name)
        same = np.cumsum(lead) - 1
        head = order[lead][same]
        again = order[(doc[order] != doc[head]) | (at[order] != at[head])]
        yield _decoded(_gone(doc[again], at[again], at[again]), each)
        ship = order[lead]
        yield _decoded(_rows(name[ship], np.zeros(len(ship), np.int64), doc[ship], at[ship], SHIPPED, then[ship]), each)


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs(doc, tag, ...) with lo and hi, null where there are none. Few spans are broadcast; else both sides are shuffled."""
    return docs.join(F.broadcast(spans) if _few(spans) else spans.hint("merge"), ["doc", "tag"], "left")


def _few(spans: DataFrame) -> bool:
    n, total = spans.agg(F.count("*"), F.sum(F.size("lo"))).first()
    return 64 * n + 16 * (total or 0) <= BROADCAST_BYTES


def _gather(rows: DataFrame) -> DataFrame:
    """doc, tag, lo, hi: a document's intervals, joined where they touch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            n = pdf["lo"].map(len).to_numpy()
            row = np.repeat(np.arange(len(pdf)), n)
            row, lo, hi = _runs(row, np.concatenate(pdf["lo"].to_numpy()), np.concatenate(pdf["hi"].to_numpy()))
            cuts = np.flatnonzero(np.diff(row)) + 1
            yield pd.DataFrame({"doc": pdf["doc"], "tag": pdf["tag"], "lo": np.split(lo, cuts) if len(cuts) else [lo], "hi": np.split(hi, cuts) if len(cuts) else [hi]})

    both = rows.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "hi")).alias("x"))
    return both.select("doc", "tag", F.col("x.lo").alias("lo"), F.col("x.hi").alias("hi")).mapInPandas(run, "doc long, tag long, lo array<long>, hi array<long>")


def repeats(docs: DataFrame) -> DataFrame:
    """docs(doc, tag, text) -> doc, tag, lo, hi: maximal runs of starts of strings that also start earlier."""
    one = materialize(_level_32(docs.mapInPandas(_name, _ROW)))
    left = materialize(_gather(one.where(F.col("kind") == OPEN)))
    some = _with_spans(docs, left).where(F.col("lo").isNotNull())
    last = some.mapInPandas(_whole_names, _ROW)
    same = Window.partitionBy("key", "next", "kind").orderBy("doc", "tag", "w")
    last = last.withColumn("k", F.rank().over(same)).where(F.when(F.col("kind") == GONE, True).otherwise(F.col("k") > 1))
    more = last.select("doc", "tag", F.when(F.col("kind") == GONE, F.col("seg")).otherwise(F.col("w")).alias("lo"), F.col("w").alias("hi"))
    out = materialize(_gather(one.where(F.col("kind") == GONE).select("doc", "tag", "lo", "hi").unionByName(more)))
    discard(one, left)
    return out


def _keyed(docs: DataFrame, *keep: Column | str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("tag"), text.alias("text"), *keep)


def covered(lo: list[int] | None, hi: list[int] | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last byte of each removed run of a document of n bytes."""
    if lo is None or not len(lo):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lo, end = np.asarray(lo, np.int64), np.minimum(np.asarray(hi, np.int64) + LENGTH, n)
    lo, end = lo[lo < n], end[lo < n]
    _, a, b = _runs(np.zeros(len(lo), np.int64), lo, end - 1)
    return a, b + 1


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, lo, hi in zip(pdf["text"], pdf["lo"], pdf["hi"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                a, b = covered(lo, hi, len(raw))
                sha, at = hashlib.sha256(), 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    sha.update(raw[at:x])
                    at = y
                sha.update(raw[at:])
                out.append((len(raw), int((b - a).sum()), len(a), sha.hexdigest()))
            rows = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield rows.assign(doc_id=pdf["doc"], no_id=pdf["no_id"])

    spans = repeats(_keyed(docs))
    both = _with_spans(_keyed(docs, F.col("doc_id").isNull().alias("no_id")), spans).select("doc", "no_id", "text", "lo", "hi")
    return opened(both.mapInPandas(run, "doc_id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the repeated strings; a character goes if all of its bytes do."""

    @F.pandas_udf("string")
    def kept(text: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.Series:
        out = []
        for t, x, y in zip(text, lo, hi, strict=True):
            if x is None:
                out.append(t)
                continue
            raw = t.encode("utf-8", "surrogatepass")
            gone = np.zeros(len(raw), bool)
            for p, q in zip(*(z.tolist() for z in covered(x, y, len(raw))), strict=True):
                gone[p:q] = True
            b = np.frombuffer(raw, np.uint8)
            lead = np.flatnonzero((b & 0xC0) != 0x80)
            whole_chars = np.logical_and.reduceat(gone, lead) if len(lead) else gone
            out.append(b[~np.repeat(whole_chars, np.diff(np.append(lead, len(b))))].tobytes().decode("utf-8", "surrogatepass"))
        return pd.Series(out)

    spans = repeats(_keyed(docs))
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"))
    both = _with_spans(keyed, spans)
    text = F.when(F.col("lo").isNull(), F.col("row.text")).otherwise(kept("row.text", "lo", "hi")).alias("text")
    return both.select(*(text if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
