"""Token ids as directly addressable codes.

A segment holds the ids of consecutive documents. Ids are split into chunks of 8 bits:
level 0 has the low chunk of every id, level k the k-th chunk of the ids that need it.
Each level but the last has a bitmap of the ids that go on, and a directory of the ones
before every BLOCK bits, so that id i is found with one rank a level and nothing is
decoded but its chunks.

Segment, little endian: ``DAC1``, uint32 documents, uint64 ids, uint32 levels; per
document int64 id (NO_ID for null) and uint32 ids; per level uint64 length, its bytes, and but for
the last the bitmap (bits from the low end) and the directory (uint32 a BLOCK of bits).

Segments are rows of a table written by Spark in ascending doc_id order (nulls first,
repeated ids by a hash of the text), so any store that Spark writes will do. A null text
has no ids but the end id. A special token's string within a text is ordinary text, as the
vocabulary's own description encodes it (``encode_special_tokens``), so that no document can write
the end id itself. The least long, NO_ID, stands for null and is no id of its own.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import materialize, width
from colloquy.llm.vocab import before_spaces, encoder

BITS, BLOCK, SEGMENT = 8, 512, 1 << 20
NO_ID = -(1 << 63)
_SCHEMA = "part int, seq int, first_doc long, n_docs long, n_tokens long, before long, payload binary"


def pack(doc_ids: list[int], counts: list[int], ids: np.ndarray) -> bytes:
    """One segment."""
    out = [np.array(doc_ids, "<i8").tobytes(), np.array(counts, "<u4").tobytes()]
    rest, levels = ids.astype(np.uint32), 0
    while levels == 0 or len(rest):
        out.append(struct.pack("<Q", len(rest)))
        out.append((rest & 0xFF).astype(np.uint8).tobytes())
        more = rest >= 1 << BITS
        levels += 1
        if more.any():
            bitmap = np.packbits(more, bitorder="little")
            ones = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), BLOCK))
            out += [b"\x01", bitmap.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
        else:
            out.append(b"\x00")
        rest = rest[more] >> BITS
    return b"".join([b"DAC1", struct.pack("<IQI", len(counts), len(ids), levels), *out])


class Segment:
    """A segment's bytes, opened without decoding."""

    def __init__(self, raw: bytes):
        if raw[:4] != b"DAC1":
            raise ValueError("not a segment")
        docs, self.n, levels = struct.unpack_from("<IQI", raw, 4)
        at = 20
        self.doc_ids = np.frombuffer(raw, "<i8", docs, at)
        self.counts = np.frombuffer(raw, "<u4", docs, at := at + 8 * docs)
        at += 4 * docs
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            chunk = np.frombuffer(raw, np.uint8, n, at + 8)
            at += 8 + n
            bitmap = directory = None
            if raw[at]:
                bitmap = np.frombuffer(raw, np.uint8, -(-n // 8), at + 1)
                directory = np.frombuffer(raw, "<u4", -(-n // BLOCK), at + 1 + len(bitmap))
                at += len(bitmap) + 4 * len(directory)
            at += 1
            self.levels.append((chunk, bitmap, directory))

    def __getitem__(self, i: int) -> int:
        """Id i, by one rank a level."""
        value, shift = 0, 0
        for chunk, bitmap, directory in self.levels:
            value |= int(chunk[i]) << shift
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                return value
            block = i // BLOCK
            head = bitmap[block * BLOCK // 8 : (i >> 3) + 1].copy()
            head[-1] &= (1 << (i & 7)) - 1
            i = int(directory[block]) + int(np.bitwise_count(head).sum())
            shift += BITS
        return value

    def all(self) -> np.ndarray:
        value = np.zeros(self.n, np.uint32)
        at = np.arange(self.n)
        for k, (chunk, bitmap, _) in enumerate(self.levels):
            value[at] |= chunk.astype(np.uint32) << np.uint32(BITS * k)
            if bitmap is not None:
                at = at[np.unpackbits(bitmap, count=len(chunk), bitorder="little").astype(bool)]
        return value


def write(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Encode all texts and write the segments; returns the table of segments as read back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, part = encoder(path, before_spaces), TaskContext.get().partitionId()
        seq = before = size = 0
        held: list[tuple[int, bytes]] = []

        def flush() -> pd.DataFrame:
            nonlocal seq, before, size, held
            ids = np.frombuffer(b"".join(x for _, x in held), "<u4")
            row = (part, seq, held[0][0], len(held), len(ids), before, pack([d for d, _ in held], [len(x) // 4 for _, x in held], ids))
            seq, before, size, held = seq + 1, before + len(ids), 0, []
            return pd.DataFrame([row], columns=["part", "seq", "first_doc", "n_docs", "n_tokens", "before", "payload"])

        for pdf in batches:
            for d, x in zip(pdf["doc_id"].tolist(), enc.encode(pdf["text"], end), strict=True):
                held.append((d, x))
                size += len(x) // 4
                if size >= SEGMENT:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # the hash and the row's number spread rows that share an id, or have none, over several ranges
    order = ["doc_id", "_hash", "_row"]
    rows = rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(width(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialize(ordered.mapInPandas(run, _SCHEMA))


def read(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the segments alone.

    A document's start needs the ids of all segments before it: one sum a partition of
    the writer, which is what the ordered window runs over and what is broadcast.
    """
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("total"), F.min("first_doc").alias("first"))
    base = parts.select("part", (F.sum("total").over(Window.orderBy("first", "part")) - F.col("total")).alias("base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, payload in zip((pdf["base"] + pdf["before"]).tolist(), pdf["payload"], strict=True):
                seg = Segment(payload)
                raw, ends = seg.all().astype("<u4").tobytes(), np.cumsum(seg.counts, dtype=np.int64)
                starts = ends - seg.counts
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                ids = pd.array(seg.doc_ids, dtype="Int64")
                ids[seg.doc_ids == NO_ID] = pd.NA
                yield pd.DataFrame({"doc_id": ids, "start": at + starts, "n_tokens": seg.counts.astype(np.int64), "ids_crc32": crc})

    return segments.select("part", "before", "payload").join(F.broadcast(base), "part").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, path: str, end: int = 2) -> DataFrame:
    """The contract's row for each document, from the segments as read back."""
    return read(write(docs, path, end))
