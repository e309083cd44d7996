"""Texts that share a doc_id, or have none, lose their own repeats only."""

import random
from collections import Counter

import pytest

from colloquy.llm import suffixes


@pytest.mark.parametrize("shared", [None, 7])
def test_texts_with_one_id(spark, shared):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    passage, clean, twice = text(300), text(900), text(400)
    first = text(100) + passage
    rows = [(shared, first), (shared, clean), (shared, twice + "1" + text(50)), (shared, twice + "2" + text(50)), (9, clean[:200] + passage)]
    rows = [(shared, "x" + text(20) + passage + text(500)) if r[1] == first else r for r in rows]
    out = [r["text"] for r in suffixes.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert clean in out and rows[0][1] in out  # nothing in them is earlier
    assert "" in out  # all of the last is
    kept = Counter(t[:400] == twice for t in out if t and (t in (rows[2][1], rows[3][1]) or t == rows[2][1][400:] or t == rows[3][1][400:]))
    assert kept == {True: 1, False: 1}  # the same start in two texts is two places
