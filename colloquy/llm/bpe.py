"""Byte-level BPE by merge replay over the distinct words of a slice of the corpus.

A task takes the words of its texts that it hasn't met before, lays their bytes out in
one array, and indexes the positions of every token pair by the pair's rank. Merges are
then applied in rank order, each to all the words that hold it at once; only the pairs
beside a merge are looked up again. A pair that a merge makes may rank lower than the
merge, and only a word's leftmost place is merged at a time, so each word sees the same
merges in the same order as if it were encoded alone.

Texts are cut at single spaces before they are cut into words by the pattern, which cuts
there anyway unless white space stands on both sides; such texts are cut as a whole.
Null texts are empty texts; very long texts need memory for their own ids only.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from colloquy.llm.common import opened, sealed

#: Words kept in each of two generations, and characters of text worked on at a time.
KEEP, SLICE = 300_000, 4_000_000
NO_RANK = np.int64(1 << 40)
_DOUBLE = re.compile(r"\s \s|\s \Z|\A \s|\A \Z")


class Ranks:
    """Ranks of a vocabulary file, with the tables that replay and decoding need."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.byte = np.array([ranks.get(bytes([x]), -1) for x in range(256)], np.int64)
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        pairs = [(ranks[t[:i]] * self.size + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        keys, to = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        self.keys, self.to = np.append(keys, np.iinfo(np.int64).max), np.append(to, NO_RANK)
        by_id = [b""] * self.size
        for t, r in ranks.items():
            by_id[r] = t
        self.len = np.array([len(t) for t in by_id], np.int64)
        self.at = np.cumsum(self.len) - self.len
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, NO_RANK where it isn't a token."""
        key = a * self.size + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], NO_RANK)

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.len[ids]
        ends = np.cumsum(size)
        if not len(ids):
            return b""
        return self.bytes[np.arange(ends[-1]) + np.repeat(self.at[ids] - (ends - size), size)].tobytes()


def replay(words: list[bytes], ranks: Ranks) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit integers."""
    size = np.array([len(w) for w in words], np.int64)
    n = int(size.sum())
    if not n:
        return [b""] * len(words)
    tok = ranks.byte[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words)), size)
    nxt, prv = np.arange(1, n + 1), np.arange(-1, n)  # n and -1: no neighbour in the word
    first = np.flatnonzero(np.diff(word, prepend=-1))
    nxt[first[1:] - 1], nxt[n - 1], prv[first] = n, n, -1
    rank = np.full(n + 1, NO_RANK)
    inner = np.flatnonzero(nxt < n)
    rank[inner] = ranks.pair(tok[inner], tok[inner + 1])
    alive = np.ones(n, bool)

    index: dict[int, list[np.ndarray]] = defaultdict(list)
    heap: list[int] = []

    def add(at: np.ndarray) -> None:
        r = rank[at]
        at, r = at[r < NO_RANK], r[r < NO_RANK]
        if not len(at):
            return
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        cuts = np.flatnonzero(np.diff(r)) + 1
        for k, group in zip(r[np.append(0, cuts)].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
            if k not in index:
                heapq.heappush(heap, k)
            index[k].append(group)

    add(inner)
    while heap:
        r = heapq.heappop(heap)
        groups = index.pop(r)
        at = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
        at = at[rank[at] == r]
        if not len(at):
            continue
        w = word[at]
        lead = np.empty(len(at), bool)
        lead[0] = True
        np.not_equal(w[1:], w[:-1], out=lead[1:])
        if not lead.all():  # further places in the same words wait
            index[r] = [at[~lead]]
            heapq.heappush(heap, r)
            at = at[lead]
        gone = nxt[at]
        after = nxt[gone]
        tok[at], nxt[at], alive[gone], rank[gone] = r, after, False, NO_RANK
        prv[after] = at  # prv has a spare place for n
        right = after < n
        rank[at] = NO_RANK
        here = at[right]
        rank[here] = ranks.pair(tok[here], tok[after[right]])
        before = prv[at]
        before = before[before >= 0]
        rank[before] = ranks.pair(tok[before], tok[nxt[before]])
        add(np.concatenate([before, here]))

    left = np.flatnonzero(alive)
    counts = np.bincount(word[left], minlength=len(words))
    ids = tok[left].astype("<u4").tobytes()
    ends = (np.cumsum(counts) * 4).tolist()
    return [ids[e - 4 * c : e] for e, c in zip(ends, counts.tolist(), strict=True)]


class Encoder:
    """Texts to ids, with the words met before."""

    def __init__(self, path: str, pattern: str):
        # cutting at single spaces is right for patterns that bind one space to what follows it
        probe = "a b. c's 1 é,  x"
        if regex.findall(pattern, probe) != [w for c in re.split("(?<=[^ ])(?= [^ ])", probe) for w in regex.findall(pattern, c)]:
            raise ValueError("the pattern doesn't cut before single spaces")
        self.ranks, self.words = Ranks(path), regex.compile(pattern)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        at, out = 0, []
        while at < len(texts):
            cut, size = [], 0
            while at < len(texts) and size < SLICE:
                cut.append(self._chunks(texts[at]))
                size += len(texts[at])
                at += 1
            known = self._learn({c for chunks in cut for c in chunks})
            out += [b"".join([known[c] for c in chunks]) for chunks in cut]
        return out

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of all ``chunks``: from those in use, else from those in use before, else by replay over their words."""
        if len(self.known) > KEEP:
            self.before, self.known = self.known, {}
        if len(self.pieces) > KEEP:
            self.pieces = {}
        new = chunks.difference(self.known)
        again = new.intersection(self.before)
        self.known.update((c, self.before[c]) for c in again)
        cut = [(c, [p.encode("utf-8", "surrogatepass") for p in self.words.findall(c)]) for c in new.difference(again)]
        distinct = list({p for _, ps in cut for p in ps}.difference(self.pieces))
        self.pieces.update(zip(distinct, replay(distinct, self.ranks), strict=True))
        ids = self.pieces
        self.known.update((c, b"".join([ids[p] for p in ps])) for c, ps in cut)
        return self.known

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if _DOUBLE.search(text):
            return [text]
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One a Python worker and vocabulary."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, pattern)
        for pdf in batches:
            ids = enc.encode(pdf["text"].tolist())
            yield pdf[["doc_id", "no_id"]].assign(ids=ids, decoded=[enc.ranks.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in ids])

    return opened(sealed(docs).mapInPandas(run, "doc_id long, no_id boolean, ids binary, decoded binary"))


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's row: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, pattern)
        for pdf in batches:
            out = []
            for x in enc.encode(pdf["text"].tolist()):
                back = enc.ranks.decode(np.frombuffer(x, "<u4").astype(np.int64))
                out.append((len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(back).hexdigest()))
            n, ids, back = zip(*out, strict=True) if out else ((), (), ())
            yield pdf[["doc_id", "no_id"]].assign(n_tokens=n, ids_sha256=ids, decoded_sha256=back)

    return opened(sealed(docs).mapInPandas(run, "doc_id long, no_id boolean, n_tokens long, ids_sha256 string, decoded_sha256 string"))
