import random
import re
import zlib

import numpy as np
import pytest
from conftest import sha

from colloquy.llm import runs


def brute(x):
    """Stretches equal to themselves q later, of least period q, each found by looking at every place."""
    n, out = len(x), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and x[j] == x[j + q]:
                j += 1
            w = x[i : j + q]
            if j > i and len(w) >= max(24, 3 * q) and not any(w[r:] == w[:-r] for r in range(1, q)):
                out.append((i, len(w), q))
            i = max(j, i + 1)
    return sorted(out)


def expected(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc is not None:
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    got = brute(w)
    drop = {i for s, length, q in got for i in range(s + q, s + length)}
    best = None
    for s, length, q in got:
        if best is None or length * best[2] > best[1] * q:
            best = (s, length, q)
    return (
        len(got),
        *(best or (None, None, None)),
        best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in got)),
        sha(" ".join(x for i, x in enumerate(w) if i not in drop)),
    )


def row(r):
    return r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256


@pytest.mark.parametrize("seed", range(4))
def test_against_every_place(seed):
    rng = random.Random(seed)
    for _ in range(150):
        k, size, x = rng.choice([1, 2, 3, 5]), rng.choice([10, 23, 24, 60, 200]), []
        while len(x) < size:
            u = [rng.randint(1, k) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 33]))]
            x += u * rng.randint(1, 6) + u[: rng.randint(0, len(u))] if rng.random() < 0.6 else [rng.randint(1, k + 3) for _ in range(rng.randint(1, 9))]
        assert runs.periodic(np.array(x)) == brute(x)


def test_shortest_and_bounds():
    one = lambda x: runs.periodic(np.array(x))
    assert one([1] * 23) == [] and one([1] * 24) == [(0, 24, 1)]
    assert one(list(range(1, 10)) * 3) == [(0, 27, 9)] and one((list(range(1, 10)) * 3)[:-1]) == []
    assert one([7, *([1, 2] * 12), 2]) == [(1, 24, 2)]
    assert one([1] * 30 + [2] + [1] * 30) == [(0, 30, 1), (31, 30, 1)]


def test_exact_where_one_prime_is_not_enough():
    x = np.random.default_rng(3).integers(1, 2_000_000, 4000)
    x[1000:] = np.resize(x[1000:1900], 3000)
    assert int(x.max()) ** 2 * 8 > runs.PRIMES[0][0]
    assert runs.periodic(x) == [(1000, 3000, 900)]


def test_transform_and_sums():
    rng = np.random.default_rng(5)
    for p, g in runs.PRIMES:
        x = rng.integers(0, p, (3, 64)).astype(np.uint64)
        assert (runs.restore(runs.transform(x, p, g), p, g) == x).all()
    ids = rng.integers(1, 3, 200)
    b, d = runs.occurrences(ids, np.arange(0, 160, 8), 8, 1, 15)
    assert sorted(zip(b.tolist(), d.tolist(), strict=True)) == sorted((i, k) for i in range(0, 160, 8) for k in range(1, 16) if (ids[i : i + 8] == ids[i + k : i + k + 8]).all())


def test_very_long_texts():
    assert runs.periodic(np.ones(200_000, np.int64)) == [(0, 200_000, 1)]
    x = np.random.default_rng(1).integers(1, 50_000, 300_000)
    x[100_000:] = np.resize(x[100_000:160_000], 200_000)
    assert runs.periodic(x) == [(100_000, 200_000, 60_000)]


def test_documents(spark, docs, texts):
    want = {i: expected(i, t) for i, t in enumerate(texts) if len(t or "") < 20_000}
    got = runs.digest(docs).collect()
    assert len(got) == len(texts) + 1
    assert {r.doc_id: row(r) for r in got if r.doc_id in want} == want


def test_planted_documents(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.choice([1, 2, 30, 90, 300])))) for i in range(-40, 160)]
    got = {r.doc_id: row(r) for r in runs.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: expected(i, t) for i, t in rows}
    assert sum(x[0] for x in got.values()) > 5


def test_operator_gives_runs_and_text(spark):
    text = "start " + "go now please " * 10 + "end"
    r = runs.detected(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (32, [(1, 30, 3)], "start go now please end")


def test_no_rows_and_no_ids(spark, none, nameless):
    assert runs.digest(none).collect() == []
    got = [(r.doc_id, *row(r)) for r in runs.digest(nameless).collect()]
    assert sorted(got, key=repr) == sorted(((d, *expected(d, t)) for d, t in [(None, "a b c d e f g h i j k l m n"), (None, None), (3, "a b c d e f g h i j k l m n")]), key=repr)
    big = 2**62 + 5
    df = spark.createDataFrame([(big, "x " * 40), (None, "y " * 40), (1, "")], "doc_id long, text string")
    assert {r.doc_id: r.n_runs for r in runs.digest(df).collect()} == {big: 1, None: 1, 1: 0}
