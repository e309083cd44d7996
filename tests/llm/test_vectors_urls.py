"""Top-k search against brute force, URL rules and held-out accuracy, the pipeline."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import topk, urls


@pytest.mark.parametrize("cell", [topk.CELL, (1, 1)])
def test_topk(spark, cell, monkeypatch):
    monkeypatch.setattr(topk, "CELL", cell)
    monkeypatch.setattr(topk, "BLOCK", 16 if cell == (1, 1) else 1024)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, None, 0), (303, [1.0, None] + [0.0] * 6, 0), (304, [float("nan")] * 8, 0), (305, [math.inf] + [0.0] * 7, 0), (350, [0.5, 0.5], 0), (351, [0.25, -1.0], 0), (None, [0.0] * 8, 0), (352, [], 0)]
    got = {}
    for r in topk.digest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    fine = [(i, np.floor(256 * np.array([np.float32(x) for x in v], float)).astype(int)) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in fine:
        if q % 50 == 0:
            best = sorted((-int(v @ w), i) for i, w in fine if i != q and len(w) == len(v))[:5]
            assert sorted(got.pop(q)) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert not got
    assert topk.digest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_prune_and_hold():
    rng = np.random.default_rng(0)
    make = lambda n, at: topk.Vectors(np.arange(at, at + n, dtype="<i8").tobytes(), np.floor(256 * np.cumsum(rng.normal(size=(n, 64)), axis=1) / 8).astype("<i8").tobytes(), 64)
    q, x = make(20, 0), make(2000, 1000)
    exact = q.v @ x.v.T
    for s in range(2):
        assert (q.stats[s] @ x.stats[s].T + 1e-6 >= exact).all()
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(20)]
    done = topk.search(q, x, best, 5)
    assert done < exact.size / 4
    assert all((np.sort(exact[i])[::-1][:5] == best[i][0]).all() for i in range(20))


URLS = [
    (0, "HTTP://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/"),
    (1, "https://example.net", "example.net", "", None),
    (2, "https://example.net/", "example.net", "/", "net/"),
    (3, "http://x.example.com/de/?q", "x.example.com", "/de/", "example.com/de/"),
    (4, "http://notexample.com/de/", "notexample.com", "/de/", None),
    (5, "ftp://b.org/fr/#a", "b.org", "/fr/", "org/fr/"),
    (6, "no scheme", "", "", None),
    (7, None, "", "", None),
    (8, "http://h?x://y/", "h", "", None),
    (9, "", "", "", None),
    (9, "", "", "", None),
]


def test_url_rules(spark):
    df = spark.createDataFrame([(i, u, "junk") for i, u, *_ in URLS], "page_id long, url string, host string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"]) for r in urls.filtered(df).collect()), key=repr)
    assert got == sorted(((i, h, p, r) for i, _, h, p, r in URLS), key=repr)
    assert urls.filtered(df.limit(0)).count() == 0


def brute_scores(texts):
    """(full, without the held-out fold) of each text by dictionaries of counts."""
    out = []
    for use in (lambda h: True, lambda h: not h):
        gram, ctx = {}, {}
        for s, n, accepted, held in texts:
            if accepted is None or not use(held):
                continue
            padded = urls.START * urls.ORDER + s + urls.STOP
            for i in range(urls.ORDER, len(padded)):
                for k in range(urls.ORDER + 1):
                    gram[accepted, padded[i - k : i + 1]] = gram.get((accepted, padded[i - k : i + 1]), 0) + n
                    ctx[accepted, k, padded[i - k : i]] = ctx.get((accepted, k, padded[i - k : i]), 0) + n
        scores = []
        for s, *_ in texts:
            padded, total = urls.START * urls.ORDER + s + urls.STOP, 0.0
            for i in range(urls.ORDER, len(padded)):
                p = {}
                for c in (True, False):
                    p[c] = urls.FLOOR
                    for k in range(urls.ORDER + 1):
                        p[c] = (gram.get((c, padded[i - k : i + 1]), 0) + urls.BETA * p[c]) / (ctx.get((c, k, padded[i - k : i]), 0) + urls.BETA)
                total += math.log(p[True]) - math.log(p[False])
            scores.append(total / (len(s) + 1) if s else 0.0)
        out.append(scores)
    return list(zip(*out, strict=True))


def _random_urls():
    rng = np.random.default_rng(1)
    part = lambda alphabet: "".join(rng.choice(list(alphabet), 12))
    rows = [(f"{part('abcde')}.example.net/en/{part('abc')}", True) for _ in range(300)] + [(f"{part('defgh')}.net/x/{part('fgh')}", False) for _ in range(300)]
    rows += [(f"{part('abé日')}.com/{part('abc')}", None) for _ in range(60)] + [("", None), ("x", None), ("long.net/" + "ab" * 3000, False)]
    return rows


@pytest.mark.parametrize("hot", [urls.HOT, 1.0, 0.0])
def test_url_scores_against_dictionaries(spark, hot, monkeypatch):
    monkeypatch.setattr(urls, "HOT", hot)  # some, none or all windows by broadcast
    texts = [(s, 1 + i % 3, a, i % 5 == 0) for i, (s, a) in enumerate(_random_urls())]
    got = {r["id"]: r for r in urls.scored(spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id long, s string, n long, accepted boolean, held boolean").repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, (full, trial) in enumerate(brute_scores(texts)):
        assert abs(got[i]["score"] - full) < 1e-6 and abs(got[i]["trial"] - trial) < 1e-6, texts[i]


def test_url_models_held_out(spark):
    rows = [(i, "http://" + s, a) for i, (s, a) in enumerate(_random_urls()) if a is not None and len(s) < 99]
    df = spark.createDataFrame([(i, u) for i, u, _ in rows] + [(None, None)], "page_id long, url string")
    texts = urls.judged(df).where("by_rule IS NOT NULL").select(F.col("page_id").alias("id"), F.concat("host", "path").alias("s"), F.lit(1).alias("n"), (F.col("by_rule") == "allow").alias("accepted"))
    texts = texts.withColumn("held", F.pmod(F.xxhash64("s"), F.lit(urls.FOLDS)) == 0)
    held = urls.scored(texts).join(texts, "id").where("held").select(F.col("trial").alias("score"), "accepted", "n")
    at = urls.cut(held)
    hit = [(r["score"] >= at) == r["accepted"] for r in held.collect()]
    assert len(hit) > 60 and np.mean(hit) > 0.95
    assert urls.filtered(df).count() == len(rows) + 1


def test_pipeline(spark, docs):
    import corpus_pipeline

    df, counts = docs.select("doc_id", "text", "lang", "source", "n_chars"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == df.columns
        df = corpus_pipeline.materialize(out)
        counts.append(df.count())
    assert len(corpus_pipeline.STAGES) == 5 and counts[0] > counts[1] == counts[2] == counts[3] and counts[4] >= counts[3]
