"""The near copies that the pipeline must find."""

import random

import corpus_pipeline

from colloquy.llm import near, simhash


def jaccard(a, b):
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_near_copies_between_080_and_095(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for k in range(40):
        base = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(300)]
        rows.append((100 * k, " ".join(base)))
        want.add(100 * k)
        for i, n in enumerate((1, 2, 3, 5, 6, 9, 14)):
            copy = list(base)
            for at in rng.sample(range(300), n):
                copy[at] = f"new{i}x{at}"
            rows.append((100 * k + 1 + i, " ".join(copy)))
    text, rows = dict(rows), rows + [(None, "left out of all groups"), (None, "left out of all groups")]
    ids = list(text)
    comp = {i: i for i in ids}
    for group in range(40):
        own = [i for i in ids if i // 100 == group]
        links = [(a, b) for a in own for b in own if a < b and jaccard(text[a], text[b]) >= 0.8]
        for _ in own:
            for a, b in links:
                comp[a] = comp[b] = min(comp[a], comp[b])
    want = {i for i in ids if comp[i] == i}
    far = [i for i in ids if i % 100 and 0.8 <= jaccard(text[i], text[i - i % 100]) <= 0.95 and (simhash.fingerprint(text[i]) ^ simhash.fingerprint(text[i - i % 100])).bit_count() > simhash.RADIUS]
    assert len(far) > 40 and len(want) > 40  # beyond the fingerprints' radius; some texts are no copies
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert {x for x in got if x is not None} == want and got.count(None) == 2


def test_pairs_that_a_hub_does_not_join(spark):
    """Members near each other but not near the least or greatest of their bucket."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base[: 200 - 12 * k]) for k in range(8)]
    keep = near.representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r["doc_id"] for r in keep.collect()] == [0]  # a chain of links of 0.88 and more


def test_no_documents(spark, none):
    assert near.representatives(none).count() == 0


def crossing(spark, texts, found):
    """What is left to test of texts in one bucket, as places in texts."""
    from xxhash import xxh64_intdigest

    keys = [xxh64_intdigest(near.shingles(t).tobytes(), near.SEED) - (1 << 63) for t in texts]
    prints = spark.createDataFrame(list(zip(keys, texts, strict=True)), "key long, text string")
    members = spark.createDataFrame([(b, k) for b in (1, 2) for k in keys], "bucket long, key long")
    found = spark.createDataFrame([(keys[i], keys[c]) for i, c in found], "node long, component long")
    at = {k: i for i, k in enumerate(keys)}
    return {frozenset((at[r["u"]], at[r["v"]])) for r in near._crossing(members, found, prints).collect()}


def variants(rng, n, most):
    """Texts of one base with up to `most` edits each, words of their own or of all."""
    base = [f"w{rng.randrange(50)}x{i}" for i in range(120)]
    out = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randint(1, most)):
            at, kind = rng.randrange(len(words)), rng.randrange(4)
            words[at : at + 1] = [[f"own{k}at{at}"], ["common"], [], [words[at], "common"]][kind]
        out.append(" ".join(words[: rng.randint(100, 140)]))
    return out


def test_crossing_keeps_every_similar_pair(spark):
    texts = list(dict.fromkeys(variants(random.Random(9), 300, 9)))
    want = {frozenset((a, b)) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8}
    assert len(want) > 200 and want <= crossing(spark, texts, [])
    joined = [(i, 0) for i in range(0, len(texts), 2)]  # one component of half of the texts, which meets others only
    apart = {p for p in want if any(i % 2 for i in p)}
    got = crossing(spark, texts, joined)
    assert apart <= got and not any(all(i % 2 == 0 for i in p) for p in got)


def test_family_that_is_not_similar_makes_no_pairs(spark):
    """60 of 74 words in common, 0.65 similar: no pair is written, where a bucket's pairs were n (n - 1) / 2."""
    shared = [f"s{i}" for i in range(60)]
    texts = [" ".join(shared + [f"own{k}x{i}" for i in range(14)]) for k in range(200)]
    assert jaccard(texts[0], texts[1]) < 0.8
    assert crossing(spark, texts, []) == set()
    assert near.representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() == 200
