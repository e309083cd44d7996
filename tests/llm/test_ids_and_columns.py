"""Ids that doubles can't hold beside nulls, and columns with the operators' own names, for all ten."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from colloquy.llm import bpe, near, packing, pii, quality, secrets, simhash, suffixes, tokenstore, topk, urls

IDS = [(1 << 60) + 1, (1 << 63) - 1, (1 << 62) + 5, -7, 0, None, None]
WORD, BYTE, MULTI = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken"))
#: Names that the operators use inside.
CLASH = ["n_words", "fail_bits", "kept", "_doc", "_w", "_lo", "_hi", "lo", "hi", "doc", "tag", "row", "_t", "_all", "_email", "base", "spans", "key", "fp", "ids", "keys", "no_id", "weak", "parts", "component_id", "_id"]
DIGESTS = {
    "simhash": simhash.digest,
    "quality": quality.ledger,
    "packing": lambda d: packing.packed(d, WORD),
    "pii": pii.digest,
    "bpe": lambda d: bpe.digest(d, MULTI, public_tokenizers.PATTERN),
    "tokenstore": lambda d: tokenstore.digest(d, BYTE),
    "secrets": secrets.digest,
    "suffixes": suffixes.digest,
}


@pytest.fixture(scope="module")
def big(spark):
    rows = [(i, None if k == 6 else f"text number {k} with some words of its own {k * k}", *[k] * len(CLASH)) for k, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} int" for c in CLASH)).coalesce(1)


@pytest.mark.parametrize("name", DIGESTS)
def test_ids_survive(big, name):
    rows = DIGESTS[name](big).collect()
    got = [r["doc_id"] for r in rows if name != "packing" or r["start"] == 0]  # packing cuts documents
    assert sorted(got, key=repr) == sorted(IDS, key=repr)


@pytest.mark.parametrize("stage", [quality.kept, near.representatives, simhash.representatives, suffixes.deduplicated])
def test_columns_survive(big, stage):
    out = stage(big)
    assert out.columns == big.columns
    have = {r["text"]: r for r in big.collect()}
    for r in out.collect():
        assert all(r[c] == have[r["text"]][c] for c in CLASH)


def test_redaction_keeps_columns(big):
    out = pii.redacted(big.withColumn("text", F.concat("text", F.lit(" a@b.co"))))
    assert out.columns == big.columns and all(r["_email"] == r["base"] == r["n_words"] for r in out.collect())


def test_component_of_large_ids(spark):
    d = spark.createDataFrame([((1 << 62) + 5, "a b c d"), ((1 << 63) - 1, "a b c d"), (-9, "other words here now"), (None, "other words here now")], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["component_id"]) for r in simhash.digest(d).collect()), key=repr) == sorted([((1 << 62) + 5, (1 << 62) + 5), ((1 << 63) - 1, (1 << 62) + 5), (-9, -9), (None, -9)], key=repr)


def test_vectors_and_urls(spark):
    v = spark.createDataFrame([(i, [1.0, float(k)], "x") for k, i in enumerate([(1 << 62), -50, (1 << 60) + 1, None])], "vec_id long, embedding array<float>, shard string")
    got = {(r["query_id"], r["vec_id"]) for r in topk.digest(v).collect()}
    assert (-50, (1 << 60) + 1) in got and (-50, 1 << 62) in got
    u = spark.createDataFrame([(i, f"http://h{k}.net/", k) for k, i in enumerate(IDS)], "page_id long, url string, s int")
    assert sorted((r["page_id"] for r in urls.filtered(u).collect()), key=repr) == sorted(IDS, key=repr)


@pytest.mark.parametrize("kind", ["empty", "nulls", "bare"])
def test_pipeline_on_odd_tables(spark, kind):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = {"empty": [], "nulls": [(None, None, None, None, None)] * 3 + [(1, None, None, None, None)], "bare": [(1, "", None, None, 0), (None, " ", None, None, 1)]}[kind]
    df = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        if name == "sequences":
            assert out.count() >= df.count()
            break
        assert out.columns == df.columns
        out = corpus_pipeline.materialize(out)
        assert out.count() <= df.count()
        df = out if name == "quality_rules" and out.count() else df  # rejected rows meet the later stages too


def test_best_of_a_shard_against_brute_force():
    """Scores of all the seed's tokens, with the corpus's statistics and not the shard's."""
    import math

    import numpy as np

    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 40, rng.integers(3, 30)) for _ in range(60)]
    corpus = docs + [rng.integers(0, 25, 50) for _ in range(100)]
    holds = np.bincount(np.concatenate([np.unique(x) for x in corpus]), minlength=40)
    stats = packing.Statistics(len(corpus), sum(map(len, corpus)), holds)
    index = packing.Index(docs, stats)
    mean = sum(map(len, corpus)) / len(corpus)
    for seed in range(10):
        used = np.zeros(len(docs), bool)
        used[seed] = True
        want = {}
        for i, d in enumerate(docs):
            s = 0.0
            for t in set(docs[seed].tolist()):
                tf = int((d == t).sum())
                if tf and sum((x == t).any() for x in docs) > 1:
                    s += math.log1p((len(corpus) - holds[t] + 0.5) / (holds[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
            if s and i != seed:
                want[i] = s
        got = index.near(seed, used)
        assert sorted(got) == sorted(want) and all(want[a] >= want[b] - 1e-9 for a, b in zip(got, got[1:], strict=False))


def test_context_changes_the_outcome(spark):
    cases = ["ssn 123-45-6789", "123-45-6789 is my social number", "order 123-45-6789 of today", "123-45-6789", "call (212) 555-1234", "(212) 555-1234", "part (212) 555-1234 here", "passport AB1234567", "AB1234567"]
    got = {r["doc_id"]: (r["spans"].split(":")[0], r["scores"]) for r in pii.digest(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    assert [got[i][0] for i in range(len(cases))] == ["ssn", "ssn", "", "", "tel", "tel", "", "passport", ""]
    assert got[0][1] == "0.7" and got[4][1] == "0.9" and got[5][1] == "0.6"


def test_nearest_context_decides(spark):
    t = "order 123-45-6789 and ssn 123-45-6780 call (212) 555-0100 or invoice (212) 555-0101"
    cases = [t, "ssn order 123-45-6789", "order ssn 123-45-6789", "invoice 123-45-6789 ssn", "part: (212) 555-0100 fax", "part (212) 555-0100 fax"]
    got = {r["doc_id"]: r["spans"] for r in pii.digest(spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")).collect()}
    at = [t.index(x) for x in ("123-45-6780", "(212) 555-0100")]
    assert got[0] == f"ssn:{at[0]}:{at[0] + 11},tel:{at[1]}:{at[1] + 14}"
    assert [bool(got[i]) for i in range(1, 6)] == [False, True, True, True, True]
