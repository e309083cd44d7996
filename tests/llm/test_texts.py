"""Operators on documents against brute force over edge cases."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from conftest import sha
from pyspark.sql import functions as F

from colloquy.llm import bpe, packing, pii, quality, secrets, simhash, suffixes, tokenstore

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality(docs, texts, none):
    got = by_id(quality.apply_policy(quality.ledger(docs.select("doc_id", "text"))))
    for i, t in enumerate(texts):
        w = WORDS.findall(t or "")
        at = {}
        for k in range(len(w) - 4):
            at.setdefault(tuple(w[k : k + 5]), []).append(k)
        cover = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
        assert r["n_symbols"] == sum(c in quality.SYMBOLS for c in t or "")
    assert got[5]["kept"] and not got[18]["kept"] and not got[17]["kept"] and not got[15]["kept"]
    kept = quality.kept(docs)
    assert kept.columns == docs.columns and {5, 8, 9} <= set(by_id(kept))
    assert quality.kept(none).count() == 0
    led = quality.ledger(docs.select("doc_id", "text"))
    for r in quality.ablation(led).collect():
        m = quality.mask("v2") & ~quality.BIT[r["rule"]]
        assert r["kept_without"] == sum(x["fail_bits"] & m == 0 for x in led.collect())


def spans_of(t, rules):
    out = []
    for order, (kind, pattern, ok) in enumerate(rules):
        out += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, t) if ok(m)]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def luhn(d):
    d = [int(x) for x in d[::-1]]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and luhn(re.sub("[^0-9]", "", m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
]
HARD = ["a@b.com_foo@c.de x@@y.z @a.b u@v a@b.c.", "1.2.3.4.5 0001.2.3.255 1.2.3.999 300.1.1.1.2", "4111-1111-1111-1111 4111111111111112 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1 234 567 8901 ++49(30)1234-5678. +1 2", "é😀 a@b.co 4111111111111111 +12345678901"]


def test_pii(spark, docs, texts, none, nameless):
    got = by_id(pii.digest(docs))
    for i, t in enumerate(texts):
        want = spans_of(t or "", PII)
        assert got[i]["base_sha256"] == sha(want)
        assert set(filter(None, want.split(","))) <= set(got[i]["spans"].split(","))
    assert "iban:10:37" in got[11]["spans"] and "tel:" in got[11]["spans"]
    hard = by_id(pii.digest(spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string")))
    assert [hard[i]["base_sha256"] for i in range(len(HARD))] == [sha(spans_of(t, PII)) for t in HARD]
    clean = pii.redacted(docs)
    assert clean.columns == docs.columns
    out = by_id(clean)
    assert out[10]["text"] == "call [PHONE] or mail [EMAIL], card [CARD], ip [IP] not 10.0.0.256" and out[5]["text"] == texts[5] and out[0]["text"] is None
    assert pii.digest(none).count() == 0 and pii.digest(nameless).count() == 3


SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
]


def test_secrets(docs, texts, none):
    got = by_id(secrets.digest(docs))
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == sha(spans_of(t or "", SECRETS))
    assert got[13]["spans"] == "" and got[14]["spans"] == ""  # beside an endpoint only; alone
    assert secrets.digest(none).count() == 0 and secrets.digest(docs).count() == len(texts) + 1


def test_byte_bpe(docs, texts, none):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(bpe.digest(docs, path, public_tokenizers.PATTERN))
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t or ""))
    assert bpe.digest(none, path, public_tokenizers.PATTERN).count() == 0
    assert bytes(by_id(bpe.encoded(docs, path, public_tokenizers.PATTERN))[19]["decoded"]).decode() == texts[19]


def library(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_store(docs, texts, none, nameless):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [x + [2] for x in library("byte_bpe_50k.json", texts)]
    rows = sorted(tokenstore.digest(docs, path).collect(), key=lambda r: (r["doc_id"], r["start"]))
    order = sorted([*range(len(texts)), 5])
    at = 0
    for r, i in zip(rows, order, strict=True):
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(want[i]), zlib.crc32(np.array(want[i], "<u4").tobytes()))
        at += len(want[i])
    ids = np.array([0, 255, 256, 70000, 1 << 24, 1, 65535] * 300, np.uint32)
    seg = tokenstore.Segment(tokenstore.pack([4], [len(ids)], ids))
    assert (seg.all() == ids).all() and all(seg[i] == ids[i] for i in range(len(ids)))
    assert tokenstore.digest(none, path).count() == 0
    assert sorted((r["doc_id"] is None, r["start"]) for r in tokenstore.digest(nameless, path).collect())[-1][0]


def test_packing(docs, texts, none):
    want = [x + [1] for x in library("word_bpe_49k.json", texts)]
    rows = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = np.array(want[r["doc_id"]], "<u4")
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for i, w in enumerate(want):
        assert sum(r["length"] for r in pieces[i]) == len(w) * (2 if i == 5 else 1)
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == packing.LENGTH or at & (at - 1) == 0
    assert packing.packed(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_packing_puts_near_documents_together():
    rng = np.random.default_rng(0)
    docs = [np.append(rng.choice(200, 300) + 1000 * (k % 3), 1) for k in range(30)]
    seq = {}
    holds = np.bincount(np.concatenate([np.unique(x) for x in docs]))
    stats = packing.Statistics(len(docs), sum(map(len, docs)), holds)
    for d, _, n, s, _ in packing.plan(docs, stats):
        seq.setdefault(s, []).append((d % 3, n))
    full = [x for x in seq.values() if sum(n for _, n in x) == packing.LENGTH]
    same = [max(sum(n for t, n in x if t == k) for k in range(3)) / packing.LENGTH for x in full]
    assert np.mean(same) > 0.6


def test_suffixes(docs, texts, none, nameless):
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        edge = np.flatnonzero(np.diff(np.append(False, gone).astype(int)) == 1)
        want[i] = (len(b), int(gone.sum()), len(edge), sha(bytes(np.frombuffer(b, np.uint8)[~gone])))
    rows = suffixes.digest(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
    assert want[6][1] == want[6][0] and want[16][1] > 2000 and want[9][1] > 100
    out = suffixes.deduplicated(docs)
    assert out.columns == docs.columns and by_id(out)[6]["text"] == "" and by_id(out)[0]["text"] is None and by_id(out)[8]["text"] == texts[8]
    assert suffixes.digest(none).count() == 0 and suffixes.digest(nameless).count() == 3


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_suffixes_shuffle_or_broadcast(spark, texts, limit, monkeypatch):
    monkeypatch.setattr(suffixes, "BROADCAST_BYTES", limit)
    d = spark.createDataFrame([(0, texts[8]), (1, texts[9])], "doc_id long, text string")
    assert by_id(suffixes.digest(d))[1]["n_removed"] == len(texts[9].split(" ", 30)[30].encode()) + (texts[9][: -len(texts[9].split(" ", 30)[30])][-1:] == texts[8][-1:])


def brute_simhash(texts):
    import xxhash

    fps = []
    for t in texts:
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    comp = list(range(len(fps)))
    for _ in fps:
        comp = [min(comp[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
    return fps, comp


def test_simhash(docs, texts, none, nameless):
    fps, comp = brute_simhash(texts)
    rows = simhash.digest(docs).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        assert (r["fingerprint"], r["component_id"]) == (f"{fps[r['doc_id']]:016x}", comp[r["doc_id"]])
    assert comp[6] == 5 and comp[1] == comp[2] == 0
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and {5, 8} <= set(by_id(kept)) and not {6, 1, 2} & set(by_id(kept))
    assert simhash.digest(none).count() == 0
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.digest(nameless).collect()), key=repr)
    assert got == [(3, 3), (None, 3), (None, None)]


def test_simhash_links_all_within_three_bits(spark):
    rng = np.random.default_rng(4)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    for f in list(fps):
        chain = f
        for _ in range(4):
            for b in rng.choice(64, 3, replace=False):
                chain ^= 1 << int(b)
            fps.append(chain)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    from colloquy.llm.components import components

    got = {signed.index(r["node"]): r["component"] for r in components(simhash.links(simhash.candidates(nodes))).collect()}
    comp = list(range(len(fps)))
    for _ in range(8):
        comp = [min(comp[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3) for i in range(len(fps))]
    least = [min(signed[j] for j in range(len(fps)) if comp[j] == comp[i]) for i in range(len(fps))]
    assert [got.get(i, signed[i]) for i in range(len(fps))] == least


def test_components_of_a_long_chain_and_a_star(spark):
    from colloquy.llm.components import components

    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 501 + i) for i in range(200)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "u long, v long")).groupBy("component").agg(F.count("*").alias("n")).collect()
    assert sorted((r["component"], r["n"]) for r in got) == [(100, 61), (500, 201)]
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_words_of_letters_are_asked_for_once_and_lists_shrink():
    """Capitals make no new word where the vocabulary lowers them, with the library's own ids; documents that are used leave a shard's lists."""
    from tokenizers import Tokenizer

    from colloquy.llm.vocab import Encoder, at_blanks

    path = public_tokenizers.path("word_bpe_49k.json")
    enc, own = Encoder(path, at_blanks), Tokenizer.from_file(path)
    asked = []

    class Asked:
        def encode(self, words, **how):
            asked.extend(words)
            return plain.encode(words, **how)

    plain, enc.plain = enc.plain, Asked()
    texts = ["Straße STRASSE straße École école ÉCOLE e\u0301cole H\u0331at h\u0331at", "don't DON'T x2y İstanbul ıÿŸ ªº Σας it's", "", "word Word WORD, word"]
    assert [np.frombuffer(x, "<u4").tolist() for x in enc.encode(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked.count("word") == asked.count("école") == asked.count("straße") == 1 and "WORD" not in asked
    docs = [np.array([i % 7, i % 5, 8]) for i in range(64)] + [np.array([7])]
    index = packing.Index(docs, packing.Statistics(65, 193, np.full(9, 10)))
    used = np.arange(65) < 40
    assert sorted(index.near(3, used)) == list(range(40, 64)) and index.left == 25 and max(map(len, index.docs_of)) == 24
    assert packing.Index([np.array([1]), np.array([2])], packing.Statistics(2, 2, np.ones(3))).near(0, np.zeros(2, bool)) == []


@pytest.mark.parametrize("heavy", [1, 5, 1000])
def test_common_tokens_leave_the_lists(monkeypatch, heavy):
    """Scores of tokens that many documents have come from one product for all pairs; the order of neighbours is that of the lists, equal documents by place."""
    rng = np.random.default_rng(heavy)
    docs = [np.minimum(rng.zipf(1.3, rng.integers(1, 60)), 400).astype("<u2") for _ in range(250)]
    docs += [docs[i] for i in range(50)]
    holds = np.bincount(np.concatenate([np.unique(x) for x in docs]), minlength=401)
    stats = packing.Statistics(len(docs), sum(map(len, docs)), holds)
    used = rng.random(len(docs)) < 0.2
    monkeypatch.setattr(packing, "DENSE", 1 << 40)
    lists, pieces = packing.Index(docs, stats), list(packing.plan(docs, stats))
    monkeypatch.setattr(packing, "DENSE", 256)
    monkeypatch.setattr(packing, "HEAVY", heavy)
    index = packing.Index(docs, stats)
    assert lists.base is None and sum(map(len, index.docs_of)) < sum(map(len, lists.docs_of)) and (heavy > 5 or sum(map(len, index.docs_of)))
    for seed in range(0, len(docs), 7):
        assert index.near(seed, used) == lists.near(seed, used)
    assert list(packing.plan(docs, stats)) == pieces


def test_words_of_one_text_are_words_alone(monkeypatch):
    from colloquy.llm import vocab

    enc = vocab.encoder(public_tokenizers.path("word_bpe_49k.json"), vocab.at_blanks)
    words = vocab.pa.array(["a", "zebra", "übergrößenträgerïn", "x" * 300, "the", "ñ"])
    monkeypatch.setattr(vocab, "SOME", 4)
    monkeypatch.setattr(vocab, "FEW", 0)
    want = vocab._library(enc.tokenizer, words)
    assert all(np.array_equal(a, b) for a, b in zip(enc._words(words), want, strict=True))
    monkeypatch.setattr(enc, "last", np.zeros_like(enc.last))  # a vocabulary whose words have no end: each is asked for by itself
    assert all(np.array_equal(a, b) for a, b in zip(enc._words(words), want, strict=True))
    assert len(enc._words(words.slice(0, 0))[0]) == 0
