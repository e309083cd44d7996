"""Sequences of at most LENGTH ids, filled with lexically near documents.

BM25's statistics cover all documents: how many hold each token, and their mean length.
Each document is keyed by its KEYS heaviest tokens, and Spark deals the documents by the
order of these keys, so that documents about the same things meet wherever they were in
the input; a hash spreads those of equal keys over tasks. A shard is a bounded run of that
order with an inverted index from token to documents. A sequence starts with a seed,
the document that the last sequence cut (its rest) or else the next unused one; while
it has room, all of the seed's tokens are looked up, and the unused documents that score
best follow, ties to the earlier. Documents are cut where a sequence is full, so only a
shard's last ids could need padding; they go to sequences of falling powers of two, which
need none.

Sequence ids are unique. Null texts have the end id only; repeated rows are packed once
each; a null doc_id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import discard, materialize, opened, sealed, width
from colloquy.llm.vocab import at_blanks, encoder

LENGTH, SHARD_DOCS, SHARD_IDS = 2048, 2048, 8 << 20
K1, B, KEYS = 1.2, 0.75, 3
#: Neighbours of a seed that are sorted at once.
FIRST = 32
#: Tokens that at least one in SPREAD documents of a shard of DENSE or more has, the HEAVY commonest of these, are scored for all pairs by one product of matrices.
SPREAD, HEAVY, DENSE = 16, 256, 256


class Statistics:
    """Documents, mean length, and for each token how many documents hold it. As long as the vocabulary, whatever the corpus."""

    def __init__(self, docs: int, ids: int, holds: np.ndarray):
        self.mean, self.holds = ids / max(docs, 1), holds
        self.idf = np.log1p((docs - holds + 0.5) / (holds + 0.5))

    def weight(self, token: np.ndarray, tf: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return self.idf[token] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))


def statistics(coded: DataFrame, vocabulary: int, dtype: str) -> Statistics:
    """Over all rows of coded(ids); a row a task and token is summed by Spark, a row a token comes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(vocabulary + 2, np.int64)
        for pdf in batches:
            for raw in pdf["ids"]:
                ids = np.frombuffer(raw, dtype)
                n[distinct(ids)[0]] += 1
                n[-2:] += 1, len(ids)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"token": at, "n": n[at]})

    got = coded.select("ids").mapInPandas(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(vocabulary + 2, np.int64)
    n[got["token"]] = got["n"]
    return Statistics(int(n[-2]), int(n[-1]), n[:-2])


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, ascending, and how often each occurs."""
    s = np.sort(ids, kind="stable")  # a radix sort for 16 bits
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1])[: len(s)])
    return s[first].astype(np.int64), np.diff(np.append(first, len(s)))


def heaviest(ids: np.ndarray, stats: Statistics) -> list[int]:
    """The KEYS tokens of largest weight that another document holds too, -1 where there are fewer."""
    token, tf = distinct(ids)
    shared = stats.holds[token] > 1
    token, w = token[shared], stats.weight(token[shared], tf[shared], len(ids))
    order = np.lexsort((token, -w))[:KEYS] if len(w) <= 64 else np.argpartition(-w, KEYS)[:KEYS]
    best = token[order][np.lexsort((token[order], -w[order]))].tolist()
    return best + [-1] * (KEYS - len(best))


class Index:
    """BM25 over the documents of one shard; tokens that one of them alone holds find nothing and are left out."""

    def __init__(self, ids: list[np.ndarray], stats: Statistics):
        size = np.array([len(x) for x in ids])
        doc = np.repeat(np.arange(len(ids)), size)
        key, tf = np.unique(np.concatenate(ids).astype(np.int64) * len(ids) + doc, return_counts=True)
        term, doc = key // len(ids), key % len(ids)
        begin = np.flatnonzero(np.diff(term, prepend=-1))
        df = np.diff(np.append(begin, len(term)))
        shared = np.flatnonzero(np.repeat(df > 1, df))
        self.terms = int((df > 1).sum())
        self.term, self.doc = np.repeat(np.arange(self.terms), df[df > 1]), doc[shared]
        self.weight = stats.weight(term[shared], tf[shared], size[self.doc])
        self.base = self._dense(len(ids))
        order = np.argsort(self.doc, kind="stable")
        self.query = np.split(self.term[order], np.searchsorted(self.doc[order], np.arange(1, len(ids))))
        self.left = len(ids)
        self._lists()

    def _dense(self, n: int) -> np.ndarray | None:
        """A row for each seed: the scores of all documents by the tokens that many have; these leave the lists."""
        df = np.bincount(self.term, minlength=self.terms)
        heavy = np.flatnonzero(df * SPREAD >= n)
        if n < DENSE or not len(heavy):
            return None
        heavy = heavy[np.argsort(-df[heavy], kind="stable")[:HEAVY]]
        row = np.full(self.terms, -1)
        row[heavy] = np.arange(len(heavy))
        at = row[self.term]
        many = at >= 0
        weight = np.zeros((len(heavy), n))
        weight[at[many], self.doc[many]] = self.weight[many]
        self.term, self.doc, self.weight = self.term[~many], self.doc[~many], self.weight[~many]
        return (weight > 0).T.astype(weight.dtype) @ weight

    def _lists(self) -> None:
        """The documents and weights of each term as views of their own."""
        ends = np.cumsum(np.bincount(self.term, minlength=self.terms)).tolist()
        at = [slice(a, b) for a, b in zip([0, *ends], ends, strict=False)]
        self.docs_of, self.weights_of = [self.doc[x] for x in at], [self.weight[x] for x in at]

    def _forget(self, used: np.ndarray) -> None:
        """Documents that are used leave the lists once they are an eighth of those in them."""
        left = len(used) - int(np.count_nonzero(used))
        if left < self.left - self.left // 8:
            stay = ~used[self.doc]
            self.term, self.doc, self.weight, self.left = self.term[stay], self.doc[stay], self.weight[stay], left
            self._lists()

    def ranked(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents by score for all tokens of the seed, best first, ties to the earlier; beyond the best FIRST sorted only if asked for. ``used`` only grows from call to call."""
        terms = self.query[seed].tolist()
        if not terms and self.base is None:
            return
        self._forget(used)
        score = np.zeros(len(used))
        if terms:
            doc, weight = np.concatenate([self.docs_of[t] for t in terms]), np.concatenate([self.weights_of[t] for t in terms])
            score = np.bincount(doc, weight, minlength=len(used))
        if self.base is not None:
            score = np.rint((score + self.base[seed]) * 1e9)  # a product may sum equal documents in other orders
        score[used] = 0
        hit = np.flatnonzero(score)
        low = -score[hit]
        if len(hit) > FIRST:
            first = low <= np.partition(low, FIRST)[FIRST]  # with all that tie
            yield from hit[first][np.argsort(low[first], kind="stable")].tolist()
            hit, low = hit[~first], low[~first]
        yield from hit[np.argsort(low, kind="stable")].tolist()

    def near(self, seed: int, used: np.ndarray) -> list[int]:
        return list(self.ranked(seed, used))


def plan(ids: list[np.ndarray], stats: Statistics) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of a shard."""
    index, used = Index(ids, stats), np.zeros(len(ids), bool)
    queue, left = iter(()), sum(len(x) for x in ids)
    unused = iter(range(len(ids)))
    seq = offset = 0
    room = LENGTH if left >= LENGTH else 1 << (left.bit_length() - 1)
    doc = start = seed = -1
    while left:
        if doc < 0:
            if offset and seed >= 0:
                queue, seed = index.ranked(seed, used.copy()), -1
            doc = next(queue, -1)  # each once, and nothing else is taken meanwhile
            if doc < 0:
                doc = next(d for d in unused if not used[d])
            used[doc], start = True, 0
        if not offset:
            seed, queue = doc, iter(())
        n = min(room - offset, len(ids[doc]) - start)
        yield doc, start, n, seq, offset
        start, offset, left = start + n, offset + n, left - n
        if start == len(ids[doc]):
            doc = -1
        if offset == room and left:
            seq, offset = seq + 1, 0
            room = LENGTH if left >= LENGTH else 1 << (left.bit_length() - 1)


def packed(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    vocabulary = max(encoder(path, at_blanks).tokenizer.get_vocab_size(), end + 1)
    dtype = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path, at_blanks)
        for pdf in batches:
            ids = [np.frombuffer(x, "<u4").astype(dtype).tobytes() for x in enc.encode(pdf["text"], end)]
            yield pdf[["doc_id", "no_id"]].assign(ids=ids)

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(keys=[heaviest(np.frombuffer(x, dtype), model.value) for x in pdf["ids"]])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 40
        held: list[tuple[int, bool, np.ndarray]] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal first, held, size
            rows = []
            for at, start, n, seq, offset in plan([x for _, _, x in held], model.value):
                doc, no_id, x = held[at]
                rows.append((doc, no_id, start, n, zlib.crc32(x[start : start + n].astype("<u4").tobytes()), len(x), first + seq, offset))
            first, held, size = rows[-1][6] + 1, [], 0
            return pd.DataFrame(rows, columns=["doc_id", "no_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for pdf in batches:
            for doc, no_id, raw in zip(pdf["doc_id"].tolist(), pdf["no_id"].tolist(), pdf["ids"], strict=True):
                held.append((doc, no_id, np.frombuffer(raw, dtype)))
                size += len(held[-1][2])
                if len(held) >= SHARD_DOCS or size >= SHARD_IDS:
                    yield flush()
        if held:
            yield flush()

    coded = materialize(sealed(docs).mapInPandas(encode, "doc_id long, no_id boolean, ids binary"))
    model = docs.sparkSession.sparkContext.broadcast(statistics(coded, vocabulary, dtype))
    rows = materialize(coded.mapInPandas(keyed, "doc_id long, no_id boolean, ids binary, keys array<int>"))
    discard(coded)
    order = [*(F.col("keys")[k] for k in range(KEYS)), F.xxhash64("doc_id", "ids"), F.col("doc_id")]
    dealt = rows.repartitionByRange(width(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "no_id", "ids")
    schema = "doc_id long, no_id boolean, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return opened(dealt.mapInPandas(pack, schema))
