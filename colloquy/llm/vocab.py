"""Texts to ids with the tokenizers library, remembering the ids of parts that recur.

A text is cut where the tokenizer cuts anyway, so the ids of the parts, one after the
other, are the ids of the text. Cutting and the search among known parts are Arrow
kernels over a slice of texts at a time; the library sees a part once, and again only
if it went unused while KEEP others were met.

The rules of cutting hold for the pre-tokenizers of byte_bpe_50k.json and
word_bpe_49k.json; a file with other ones is refused.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts remembered, characters of text worked on at a time, and new parts given to the library at a time.
KEEP, SLICE, SOME = 1_000_000, 8_000_000, 20_000
#: Fewer words than this aren't put into one text.
FEW = 64
_W = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_DOUBLE = rf"{_W} {_W}|{_W} \z|\A {_W}|\A \z|\x00"
_LINES = rf"\n{_W}|{_W}\n"
#: A mark after a letter begins a piece for every pre-tokenizer here (U+0130 lower-cases to two characters, of which the last is no letter).
_MARK = r"([A-Za-zÀ-ÖØ-öø-\x{12f}\x{131}-ɏ])([.,!?;:*#$%&|])"

Cut = Callable[[pa.Array], tuple[pa.Array, np.ndarray]]


def before_spaces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """For byte-level pre-tokenizers, which bind one space to what follows: cuts before single spaces, around single line ends and before marks; none where spaces or other white space meet."""
    marked = pc.replace_substring(pc.replace_substring_regex(texts, _MARK, "\\1\0\\2"), " ", "\0 ")
    apart = pc.replace_substring(marked, "\n", "\0\n\0")
    cut = pc.if_else(pc.match_substring_regex(texts, _LINES), marked, apart)
    return cut, pc.match_substring_regex(texts, _DOUBLE).to_numpy(zero_copy_only=False)


def at_blanks(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """For pre-tokenizers that drop white space: cuts at spaces and line ends. Marks are cut off in words that are new (Encoder._asked), not in all of the text."""
    cut = pc.replace_substring(pc.replace_substring(texts, "\n", "\0"), " ", "\0")
    return cut, pc.match_substring(texts, "\0").to_numpy(zero_copy_only=False)


#: The pre-tokenizer parts that each rule of cutting is right for.
FITS = {
    "before_spaces": [("ByteLevel", True)],
    "at_blanks": [("Split", "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"), ("ByteLevel", False)],
}


#: Words of these letters only are one piece for at_blanks, and this normalizer does nothing to them but lower their case.
_LETTERS = r"\A[A-Za-zÀ-ÖØ-öø-ÿ]+\z"
_LOWERS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}


def _fits(conf: dict, cut: Cut) -> bool:
    pre = conf["pre_tokenizer"] or {}
    parts = pre.get("pretokenizers", [pre])
    return [(p.get("type"), p["pattern"]["Regex"] if p.get("type") == "Split" else p.get("use_regex")) for p in parts] == FITS[cut.__name__]


class Encoder:
    def __init__(self, path: str, cut: Cut):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        if not _fits(conf, cut):
            raise ValueError(f"{cut.__name__} isn't known to be right for the pre-tokenizer of {path}")
        self.tokenizer, self.cut = Tokenizer.from_file(path), cut
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.plain = None
        if cut is at_blanks and conf["normalizer"] == _LOWERS and (mark := conf["model"].get("end_of_word_suffix")):
            # the same vocabulary for words that are normal and whole already, many in one text, since each ends with an id that ends words
            pre = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, conf["pre_tokenizer"]["pretokenizers"][-1]]}
            self.plain = Tokenizer.from_str(json.dumps(conf | {"normalizer": None, "pre_tokenizer": pre}))
            self.plain.encode_special_tokens = True
            vocabulary = self.plain.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for w, i in vocabulary.items() if w.endswith(mark)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.ids, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, texts: Iterable[str], end: int | None = None) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, then ``end`` if given."""
        tail, some, size, out = b"" if end is None else end.to_bytes(4, "little"), [], 0, []
        for t in texts:
            some.append(t)
            size += len(t)
            if size >= SLICE:
                out += self._slice(some, tail)
                some, size = [], 0
        return out + self._slice(some, tail) if some else out

    def _slice(self, texts: list[str], tail: bytes) -> list[bytes]:
        rows = pa.array(texts, pa.large_string())
        cut, whole = self.cut(rows)
        alone = np.flatnonzero(whole)
        lists = pc.split_pattern(cut.filter(pa.array(~whole)), "\0")
        parts = pa.concat_arrays([lists.flatten(), rows.take(pa.array(alone))])
        n_parts = np.ones(len(texts), np.int64)
        n_parts[~whole] = pc.list_value_length(lists).to_numpy()
        coded = parts.dictionary_encode()
        at = self._learn(coded.dictionary)[coded.indices.to_numpy()]
        ids, n = _taken(self.ids, self.size, at)
        ends, ids = np.cumsum(n), ids.astype("<u4").tobytes()
        # parts of the cut texts come first, then the texts that stay whole
        order = np.append(np.flatnonzero(~whole), alone)
        stop = np.append(0, ends)[np.cumsum(n_parts[order])] * 4
        out: list[bytes] = [b""] * len(texts)
        for i, a, b in zip(order.tolist(), np.append(0, stop[:-1]).tolist(), stop.tolist(), strict=True):
            out[i] = ids[a:b] + tail
        return out

    def _learn(self, parts: pa.Array) -> np.ndarray:
        """Where each of the distinct ``parts`` stands among the known ones, after the library has seen the new ones."""
        if len(self.known) > KEEP:
            used = pc.index_in(self.known, value_set=parts).is_valid().to_numpy(zero_copy_only=False)
            self.ids, self.known, self.size = self.ids[np.repeat(used, self.size)], self.known.filter(pa.array(used)), self.size[used]
        parts = parts.cast(pa.string())
        # the known are looked up among the parts, of which there are fewer: a table is built of these
        found = pc.index_in(self.known, value_set=parts)
        again = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        at = np.full(len(parts), -1, np.int64)
        at[found.drop_null().to_numpy()] = again
        missing = at < 0
        at[missing] = np.arange(len(self.known), len(self.known) + int(missing.sum()))
        new = parts.filter(pa.array(missing))
        ids, size = self._asked(new)
        self.known = pa.concat_arrays([self.known, new])
        self.ids, self.size = np.append(self.ids, ids), np.append(self.size, size)
        return at

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As :func:`_library`, for words of lower-case letters."""
        if len(words) < FEW:
            return _library(self.plain, words)
        ids = [np.zeros(0, np.uint32)]
        for k in range(0, len(words), SOME):
            got = self.plain.encode_batch_fast([" ".join(words[k : k + SOME].to_pylist())], add_special_tokens=False)  # without the places of ids in the text
            ids.append(np.array(got[0].ids, np.uint32))
        ids = np.concatenate(ids)
        size = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        if len(size) != len(words) or size.sum() != len(ids):  # a vocabulary that lacks a letter
            return _library(self.plain, words)
        return ids, size

    def _asked(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of the parts, one after the other, and how many each has; of letters only, once for all ways to write them in capitals."""
        if self.plain is None:
            return _library(self.tokenizer, new)
        zero = pc.match_substring(new, "\0")
        lists = pc.split_pattern(pc.replace_substring_regex(new.filter(pc.invert(zero)), _MARK, "\\1\0\\2"), "\0")
        pieces = lists.flatten().dictionary_encode()
        alike = pc.match_substring_regex(pieces.dictionary, _LETTERS)
        low = pc.utf8_lower(pieces.dictionary.filter(alike)).dictionary_encode()
        asked = [_library(self.tokenizer, pieces.dictionary.filter(pc.invert(alike))), self._words(low.dictionary), _library(self.tokenizer, new.filter(zero))]
        ids, size = (np.concatenate(x) for x in zip(*asked, strict=True))
        # where each piece stands among those that were asked for, then the pieces of each part in order
        alike, zero = alike.to_numpy(zero_copy_only=False), zero.to_numpy(zero_copy_only=False)
        at, others = np.zeros(len(alike), np.int64), len(asked[0][1])
        at[~alike], at[alike] = np.arange(others), others + low.indices.to_numpy()
        n = np.ones(len(new), np.int64)
        n[~zero] = pc.list_value_length(lists).to_numpy()
        of, whole = np.repeat(np.arange(len(new)), n), np.repeat(zero, n)
        every = np.zeros(len(of), np.int64)
        every[~whole], every[whole] = at[pieces.indices.to_numpy()], others + len(asked[1][1]) + np.arange(int(zero.sum()))
        ids, size = _taken(ids, size, every)
        return ids, np.bincount(of, size, minlength=len(new)).astype(np.int64)


def _taken(ids: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the parts at the places ``at``, one after the other, and how many each has; ids holds size[i] ids of part i after those of the parts before."""
    n, ends = size[at], np.append(0, np.cumsum(size)).astype(np.int64) * ids.itemsize
    parts = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(ids))])
    got = parts.take(pa.array(at)).buffers()[2]  # copied part by part, without an index for each id
    return np.frombuffer(got or b"", ids.dtype, int(n.sum())), n


def _library(tokenizer, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    ids, size = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for k in range(0, len(parts), SOME):
        words = parts[k : k + SOME].to_pylist()
        got = tokenizer.encode(words, is_pretokenized=True, add_special_tokens=False)  # each part by itself, one result for all
        ids.append(np.array(got.ids, np.uint32))
        size.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(words)))
    return np.concatenate(ids), np.concatenate(size)


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, cut: Cut) -> Encoder:
    """One a Python worker and vocabulary."""
    key = (path, cut.__name__)
    if key not in _encoders:
        _encoders[key] = Encoder(path, cut)
    return _encoders[key]
