import random
import re
import zlib
from collections import Counter

import pytest

from colloquy.llm import variants


def counted(docs, delete=199):
    out = Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{d}:{w}".encode())
            if delete and d is not None and h % delete == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(words):
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = {}
    for w, n in words.items():
        r = w
        while form[r]:
            r = form[r]
        out[w] = (n, len(near[w]), form[w], words[form[w]] if form[w] else None, r)
    return out


def result(df):
    rows = df.collect()
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(got) == len(rows)
    return got


def family(rng, n):
    """Words with chains of edits, anagrams and letters beside the alphabet."""
    base = ["".join(rng.choice("abcdeéÿñ×ß") for _ in range(rng.randint(6, 9))) for _ in range(n)]
    out = list(base)
    for w in base:
        for _ in range(3):
            i, c = rng.randrange(len(w)), rng.choice("abcde")
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[::-1]])
            out.append(w)
    return {w: rng.choice([5, 6, 30, 150, 800, 5000]) for w in out if len(w) >= 6}


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    words = family(random.Random(seed), 60)
    got = result(variants.grouped(frame(spark, words)))
    assert got == expected(words)
    assert any(x[2] for x in got.values())


def test_small_tiles_lose_nothing(spark, monkeypatch):
    words = family(random.Random(9), 40)
    monkeypatch.setattr(variants, "TILE", 3)
    assert result(variants.grouped(frame(spark, words))) == expected(words)


def test_one_hot_block(spark):
    """A third of all words in one block: same letters, other orders."""
    rng = random.Random(4)
    words = {"".join(rng.sample("abcdefgh", 8)): rng.choice([5, 40, 300]) for _ in range(300)} | {w[:4] + "e" + w[4:]: 7 for w in family(rng, 30)}
    assert result(variants.grouped(frame(spark, words))) == expected(words)


def test_chains_ties_and_long_words(spark):
    long = "ab" * 50_000
    words = {"colour": 5000, "colours": 1000, "coloursx": 200, "coloursxy": 5, "colous": 1000, long: 9, long + "c": 45, "zzzzzz": 5}
    got = result(variants.grouped(frame(spark, words)))
    assert got == expected(words)
    assert got["coloursxy"][4] == "colour" and got[long][2] == long + "c" and got["zzzzzz"] == (5, 0, None, None, "zzzzzz")


def test_documents(spark, docs, texts):
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])]
    assert result(variants.digest(docs)) == expected(counted(rows))
    assert {r.word: r.n for r in variants.occurrences(docs, None).where("n >= 5").collect()} == counted(rows, None)


def test_deleted_letters(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzÀé") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    rows = [(d, " ".join(rng.choice(vocab).title() for _ in range(60)) + ". X-ray's") for d in range(300)]
    want = expected(counted(rows))
    assert result(variants.digest(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_no_rows_and_no_ids(spark, none):
    assert variants.digest(none).collect() == []
    rows = [(None, "unnamed words"), (None, None), (2**62 + 5, "unnamed")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(variants.digest(df)) == expected(counted(rows))
