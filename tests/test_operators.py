"""Golden values, invariants, and batch against stream."""

import base64
import hashlib
import json
import math
import pickle
import random
import zlib

import pytest
from pyspark.sql import functions as F

from colloquy.functions import folds, numeric, parsing, texts
from colloquy.operators import advantages as A
from colloquy.operators import builders
from colloquy.operators import datasets as DS
from colloquy.operators import graph as G
from colloquy.operators import metrics as M
from colloquy.operators import rewards as W
from colloquy.operators import sampling as S
from colloquy.operators import retrieval, scoring, sft, tokens, trees
from colloquy.sources import cache, custom, files
from colloquy.streaming import steps, windows


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def scores(spark, *triples):
    return spark.createDataFrame(list(triples), "uid string, sample_id long, score double, resp_len long")


def test_group_advantages(spark):
    d = scores(spark, ("a", 1, 1.0, 1), ("a", 2, 3.0, 3), ("b", 3, 2.0, 1))
    got = dict(rows(A.grpo(d), "sample_id", "advantage"))
    assert got[1] == pytest.approx(-0.7071, abs=1e-3) and got[2] == pytest.approx(0.7071, abs=1e-3) and got[3] == pytest.approx(2 / (1 + 1e-6))
    assert dict(rows(A.rloo(d), "sample_id", "advantage")) == {1: -2.0, 2: 2.0, 3: 2.0}
    assert dict(rows(A.opo(scores(spark, ("a", 1, 4.0, 1), ("a", 2, 0.0, 3))), "sample_id", "advantage")) == {1: 3.0, 2: -1.0}
    best = scores(spark, ("a", 1, 5.0, 1), ("a", 2, 3.0, 1), ("a", 3, 1.0, 1), ("b", 4, 1.0, 1))
    assert dict(rows(A.passk(best, norm=False), "sample_id", "advantage")) == {1: 2.0, 2: 0.0, 3: 0.0}
    assert rows(A.too_small(best), "uid") == [("b",)]


def test_gae_ignores_masked_values(spark):
    reward, mask = [0, 0, 0.1, 0.1, 0.1, 0, 0, 0.1, 1, 0, 0], [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    seen = []
    for seed in (1, 2):
        rng = random.Random(seed)
        known = iter([4.0, 5.0, 6.0, 7.0, 9.0])
        value = [next(known) if m else rng.random() for m in mask]
        d = spark.createDataFrame([([float(x) for x in reward], value, [float(m) for m in mask])], "reward array<double>, value array<double>, mask array<double>")
        r = A.gae(d).first()
        seen.append((r["advantage"], [x for x, m in zip(r["returns"], mask, strict=True) if m]))
    assert seen[0] == seen[1]
    d = spark.createDataFrame([([0.0, 0.0, 1.0], [0.5] * 3, [0.0, 1.0, 1.0])], "reward array<double>, value array<double>, mask array<double>")
    assert A.gae(d).first()["advantage"] == pytest.approx([0.475, 0.475, 0.5])


def test_estimators_by_name():
    assert A.estimator("grpo") is A.grpo
    with pytest.raises(ValueError):
        A.estimator("none such")
    with pytest.raises(ValueError):
        A.register_estimator("grpo")(lambda df: df)
    with pytest.raises(ValueError):
        tokens.diagnostics("none such")


def test_best_and_majority(spark):
    d = spark.createDataFrame([("s", "u", i, float(i), p) for i, p in enumerate("ABABA", 1)], "src string, uid string, k long, v double, p string")
    got = {r["metric"]: r["value"] for r in M.group_metrics(d, ["src", "uid"], "v", "k", "p").collect()}
    assert got["mean@5"] == 3.0 and got["maj@5/mean"] == 1.0 and got["best@2/mean"] == pytest.approx(3.8) and got["worst@2/mean"] == pytest.approx(2.2)
    rng = random.Random(0)
    draws = [max(rng.choices(range(1, 6), k=4)) for _ in range(20000)]
    assert got["best@4/mean"] == pytest.approx(sum(draws) / len(draws), abs=0.03)


def test_tree_backup(spark):
    t = spark.createDataFrame([(1, 1, None, 0, False, 0.0, 0.0), (1, 2, 1, 1, True, 1.0, 0.0), (1, 3, 1, 1, True, 0.0, 0.0)], "tree_id long, node_id long, parent_id long, level int, is_terminal boolean, action_reward double, critic_value double")
    got = {r["node_id"]: r for r in trees.backup(t).collect()}
    assert got[1]["value"] == 0.5 and got[1]["visits"] == 2 and got[1]["advantage"] is None
    assert got[2]["advantage"] == 0.5 and got[3]["advantage"] == -0.5
    assert trees.backup(t.where("false")).count() == 0


def test_scoring(spark):
    d = spark.createDataFrame([("a \\boxed{x} \\boxed{\\frac{1}{2}} b",), ("none",), ("\\boxed{open",)], "t string")
    assert [r[0] for r in d.select(scoring.boxed(F.col("t"))).collect()] == ["\\frac{1}{2}", None, None]
    p = spark.createDataFrame([(6,), (8,), (10,)], "n int").select(scoring.overlong_penalty(F.col("n"), 10, 4, 1.0)).collect()
    assert [r[0] for r in p] == [0.0, -0.5, -1.0]
    with pytest.raises(Exception, match="no scorer"):
        spark.createDataFrame([("?", "x", "y")], "data_source string, solution string, ground_truth string").select(scoring.score_by_source()).collect()


def test_parsing(spark):
    texts_ = ['{"action": {"type": "continue"}}', '```json\n{"action": "diagnose", "diagnosis": "Flu"}\n```', "<action>switch</action>", "nothing", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts_)], "i int, t string")
    assert rows(d.select("i", parsing.action(F.col("t")).alias("a"), parsing.diagnosis(F.col("t")).alias("d")), "i", "a", "d") == [(0, "ask", None), (1, "diagnose", "flu"), (2, "ask", None), (3, None, None), (4, None, None)]
    e = spark.createDataFrame([([20, 10, 34, 1, 0, 0, 0],)], "ids array<long>")
    assert e.select(tokens.eos_mask(F.col("ids"), [1])).first()[0] == [1, 1, 1, 1, 0, 0, 0]


def test_normalisers_differ(spark):
    r = spark.createDataFrame([("A  b!",)], "t string").select(texts.normalized(F.col("t")), texts.collapsed(F.col("t"))).first()
    assert tuple(r) == ("a  b", "a b")


def test_splits_share_no_group(spark):
    d = spark.createDataFrame([(f"g{i % 40}", i) for i in range(400)], "g string, k long")
    s = DS.group_split(d, "g", "k", {"test": 50, "val": 50, "train": 200}, "1")
    n = dict(rows(s.groupBy("split").count(), "split", "count"))
    assert n == {"test": 50, "val": 50, "train": 200}
    assert s.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_changes_nothing(spark, parts):
    d = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v")).repartition(parts)
    want = [(k, i) for i, (v, k) in enumerate(sorted((k % 7, k) for k in range(500)))]
    assert rows(DS.ranked(d, [F.col("v"), F.col("k")]), "k", "rank") == sorted(want)


def test_pad_and_repeat(spark):
    d = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "i long, x string")
    assert rows(DS.repeat(d, 2, "i"), "i", "x") == [(0, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "c")]
    assert rows(DS.repeat(d, 2, "i", interleave=False), "i", "x") == [(0, "a"), (1, "b"), (2, "c"), (3, "a"), (4, "b"), (5, "c")]
    assert DS.pad_to(d, 2, "i").where("is_pad").count() == 1 and DS.pad_to(d, 3, "i").where("is_pad").count() == 0
    with pytest.raises(Exception, match="differs"):
        DS.unite(d, d.withColumn("x", F.lit("z")), "i").collect()


def _sums(df, parts):
    lens = {(r["step"], r["row"]): r["len"] for r in df.collect()}
    got = parts.collect()
    assert sorted((r["step"], r["row"]) for r in got) == sorted(lens)
    out = {}
    for r in got:
        out.setdefault(r["step"], {}).setdefault(r["part"], []).append(lens[r["step"], r["row"]])
    return out


@pytest.mark.parametrize("equal", [False, True])
def test_balance(spark, equal):
    """Steps of odd and equal lengths, one that has most rows, one smaller than the number of parts."""
    rng = random.Random(5)
    sizes = {0: 40, 1: 8, 2: 2000, 3: 4, 4: 100}
    rows_ = [(s, i, 7 if s == 4 else rng.choice([1, 3, 50, rng.randint(1, 1000)])) for s, n in sizes.items() for i in range(n)]
    d = spark.createDataFrame(rows_, "step long, row long, len long").repartition(3)
    for step, parts in _sums(d, S.balanced(d, "step", "row", "len", 4, equal)).items():
        sums = [sum(parts.get(k, [])) for k in range(4)]
        assert max(sums) - min(sums) <= max(max(p) for p in parts.values())
        assert not equal or {len(p) for p in parts.values()} == {sizes[step] // 4}
    one = d.where("step = 2").withColumn("step", F.lit(0))
    (parts,) = _sums(one, S.balanced(one, None, "row", "len", 4, equal)).values()
    assert max(map(sum, parts.values())) - min(map(sum, parts.values())) <= 1000
    assert S.balanced(d.limit(0), "step", "row", "len", 4).collect() == []


def test_balance_needs_equal_counts(spark):
    d = spark.createDataFrame([(0, i, i) for i in range(7)], "step long, row long, len long")
    with pytest.raises(Exception, match="divides"):
        S.balanced(d, "step", "row", "len", 4, True).collect()


def test_micro_batches(spark):
    rng = random.Random(5)
    rows_ = [(s, i, rng.randint(1, 100)) for s, n in ((0, 40), (1, 5000), (2, 1)) for i in range(n)]
    d = spark.createDataFrame(rows_, "step long, row long, len long")
    got = {(r["step"], r["row"]): (r["batch"], r["place"]) for r in S.micro_batches(d, "step", "row", "len", 300, divisor=2).collect()}
    for step, n in ((0, 40), (1, 5000), (2, 1)):
        own = {i: (*got[step, i], x) for s, i, x in rows_ if s == step}
        assert sorted(p for _, p, _ in own.values()) == list(range(n))
        order = sorted(own, key=lambda i: own[i][1])
        assert [(own[i][0], i) for i in order] == sorted((own[i][0], i) for i in own)
        total = {}
        for b, _, x in own.values():
            total.setdefault(b, []).append(x)
        need = -(-sum(x for *_, x in own.values()) // 300)
        assert len(total) == min(n, need + need % 2) and all(sum(x) <= 330 for x in total.values())
        work = [sum(x * x for x in total[b]) for b in range(len(total))]
        assert work == sorted(work, reverse=True)
    with pytest.raises(Exception, match="exceeds"):
        S.micro_batches(d, "step", "row", "len", 50).collect()


def test_ranked_within(spark):
    rng = random.Random(2)
    d = [(rng.choice([0, 0, 0, 1, 2]), i, rng.randint(0, 5)) for i in range(200)]
    got = rows(DS.ranked_within(spark.createDataFrame(d, "g long, i long, x long"), "g", [F.desc("x"), F.col("i")]), "i", "rank", "size")
    want = []
    for g in range(3):
        own = sorted((x for x in d if x[0] == g), key=lambda x: (-x[2], x[1]))
        want += [(i, k, len(own)) for k, (_, i, _) in enumerate(own)]
    assert got == sorted(want)


@pytest.mark.parametrize(("k", "common"), [(1, 1000), (3, 1000), (3, 4), (2, 0), (60, 3)])
def test_closest_is_all_pairs(spark, k, common):
    """Common words (all of them, for 0), names of one word, equal names, empty names, fewer partners than k."""
    rng = random.Random(k + common)
    word = lambda: rng.choice(["the", "the", "of", "acute", "mild", "fever", "cough", "rash", "pain", "joint", "x1", "x2", "x3"])
    left = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 9])))) for i in range(40)]
    right = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 9])))) for i in range(120)]
    got = G.closest(spark.createDataFrame(left, "a long, x string"), spark.createDataFrame(right, "b long, y string"), "a", "x", "b", "y", k, common_rows=common)
    want = []
    for a, x in left:
        u = set(x.split())
        pairs = sorted((-len(u & set(y.split())) / len(u | set(y.split())), b) for b, y in right if u & set(y.split()))
        want += [(a, b, r, round(-s, 9)) for r, (s, b) in enumerate(pairs[:k], 1)]
    assert sorted((r["a"], r["b"], r["rank"], round(r["score"], 9)) for r in got.collect()) == sorted(want)


def test_closest_levels(spark):
    """A query that a level finishes is not carried on, and one with common words only is left to the last."""
    right = [(i, f"name{i} word{i} the") for i in range(50)] + [(99, "name1 word1")]
    left = [(1, "name1 word1"), (2, "name2 other"), (3, "the")]
    d = G.closest(spark.createDataFrame(left, "a long, x string"), spark.createDataFrame(right, "b long, y string"), "a", "x", "b", "y", 1, common_rows=10)
    assert rows(d, "a", "b", "level") == [(1, 99, 0.8), (2, 2, 0.2), (3, 0, 0.0)]


def _read(spark, names, kind):
    """Names as a table, and how often a row of it has been computed."""
    n = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            n.add(len(b))
            yield b

    return spark.createDataFrame([(x,) for x in names], f"{kind} string").mapInPandas(seen, f"{kind} string"), n


def test_closest_and_resolve_read_names_once(spark):
    """The names come from a join and a grouping of all edges, which each use made again."""
    names = [f"{a} {b} {i}" for i in range(40) for a in ("hot", "old") for b in ("ring", "bolt")]
    right, n = _read(spark, names, "disease")
    left = spark.createDataFrame([("hot ring x",), ("bolt",), ("nothing alike",)], "query string")
    got = G.closest(left, right, "query", "query", "disease", "disease", 2, common_rows=10)
    assert rows(got, "query", "rank", "disease") == [("bolt", 1, "hot bolt 0"), ("bolt", 2, "hot bolt 1"), ("hot ring x", 1, "hot ring 0"), ("hot ring x", 2, "hot ring 1")]
    assert n.value == len(names)
    right, n = _read(spark, names, "disease")
    got = G.resolve(left.union(spark.createDataFrame([("OLD bolt 7",), (None,)], "query string")), right)
    assert rows(got.where("query IS NOT NULL"), "query", "disease") == [("OLD bolt 7", "old bolt 7"), ("bolt", "hot bolt 0"), ("hot ring x", "hot ring 0"), ("nothing alike", None)]
    assert n.value == len(names) and got.where("query IS NULL AND disease IS NULL").count() == 1


def test_closest_keeps_few_of_alike_rows(spark):
    right = spark.createDataFrame([(i, f"hot ring {i}" if i % 2 else f"hot bolt {i} {i + 1}") for i in range(500)], "b long, y string")
    left = cache.cut(spark.createDataFrame([("hot",), ("ring 7",)], "x string"))
    kept, often = G._distinguished(left, right, "x", "b", "y", 2)
    assert rows(kept, "b") == [(0,), (1,), (2,), (3,), (6,), (7,)]  # 6: 'hot' and '7' of four words
    assert rows(often, "_w", "_f") == [("7", 2), ("hot", 500), ("ring", 250)]


@pytest.mark.parametrize("parts", ["1", "7", "50"])
def test_premature_whatever_the_order(spark, parts):
    """Six tenths of a weight of tenths is not less than 0.6, in any order of the sum."""
    edges = spark.createDataFrame([("flu", f"s{i}", 0.1) for i in range(10)] + [("flu", "s10", 0.0)], "disease string, symptom string, weight double")
    turns = [("e", "flu", i, f"s{i}", "ask", None) for i in range(6)] + [("e", "flu", 6, "s10", "diagnose", "flu")]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        d = W.graph_turn_rewards(spark.createDataFrame(turns, "episode_id string, disease string, turn_id long, fact string, action string, diagnosis string").repartition(3), edges)
        last = d.where("turn_id = 6").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert (last["coverage"], last["premature"], last["is_correct"], last["n_new"]) == (0.6, False, True, 7)


def test_resample_finds_the_interval(spark):
    d = spark.createDataFrame([(k, float(k % 5)) for k in range(50)], "k long, weight double")
    got = dict(rows(S.resample(d, "k", "weight", 200, "5"), "draw", "k"))
    assert len(got) == 200
    import hashlib

    total, run, ends = sum(k % 5 for k in range(50)), 0, []
    for k in range(50):
        run += k % 5
        ends.append((run / total, k))
    for draw, k in got.items():
        u = int(hashlib.md5(f"5|{draw}".encode()).hexdigest()[:12], 16) / (1 << 48)
        assert next(j for e, j in ends if u < e) == k


def test_files(spark, tmp_path):
    d = spark.createDataFrame([(1, float("nan"), {"a": 1}), (2, 0.5, {"a": 2})], "k long, x double, m map<string,long>")
    files.write_jsonl(d.select("k"), f"{tmp_path}/j")
    assert rows(files.read_jsonl(spark, f"{tmp_path}/j", "k long"), "k") == [(1,), (2,)]
    assert [r["x"] for r in files.without_nan(d).orderBy("k").collect()] == [None, 0.5]
    assert json.loads(files.as_json_columns(d).orderBy("k").first()["m"]) == {"a": 1}
    once = cache.materialize(d.select("k"), f"{tmp_path}/c")
    assert cache.materialize(d.select(F.col("k") + 1), f"{tmp_path}/c").count() == once.count() == 2
    assert rows(files.rewrite(spark, f"{tmp_path}/c", lambda t: t.select((F.col("k") * 10).alias("k"))), "k") == [(10,), (20,)]


def test_ewma_stream_is_batch(spark, tmp_path):
    pts = [(n, s, float(s * 3 % 7)) for n in ("a", "b") for s in range(6)]
    for i, s in enumerate([2, 0, 1, 4, 3, 5]):  # files come out of order
        spark.createDataFrame([p for p in pts if p[1] == s], "name string, step long, x double").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    out = steps.run(steps.ewma_stream(steps.read_steps(spark, f"{tmp_path}/in", "name string, step long, x double")), f"{tmp_path}/out")
    want = steps.ewma(spark.createDataFrame(pts, "name string, step long, x double"))
    assert rows(out, "name", "step", "value") == [(n, s, pytest.approx(v)) for n, s, v in rows(want, "name", "step", "value")]


def test_episode_stream(spark, tmp_path):
    spark.createDataFrame([("e1", 0, "ask"), ("e2", 0, "ask")], "episode_id string, turn_id long, action string").coalesce(1).write.json(f"{tmp_path}/in")
    spark.createDataFrame([("e1", 1, "diagnose"), ("e2", 1, "ask"), ("e2", 2, "ask")], "episode_id string, turn_id long, action string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    got = steps.run(steps.episodes(steps.read_steps(spark, f"{tmp_path}/in", "episode_id string, turn_id long, action string"), 3), f"{tmp_path}/out")
    assert rows(got, "episode_id", "turns", "outcome") == [("e1", 2, 1.0), ("e2", 3, -2.0)]


def test_stream_windows_are_batch_windows(spark, tmp_path):
    t = spark.range(200).select((F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)).alias("ts"), (F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v"))
    t.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = steps.run(windows.tumbling(spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in"), "ts", "10 minutes", ["k"], "v"), f"{tmp_path}/out")
    want = windows.tumbling(t, "ts", "10 minutes", ["k"], "v")
    done = set(rows(got, "start", "k", "n", "total"))
    assert done and done <= set(rows(want, "start", "k", "n", "total"))


def test_growing_table_keeps_batches_once(spark, tmp_path):
    spark.range(10).coalesce(1).write.json(f"{tmp_path}/in")
    for _ in range(2):
        steps.grow(spark.readStream.schema("id long").json(f"{tmp_path}/in"), f"{tmp_path}/out", F.col("id") % 2 == 0)
    assert spark.read.parquet(f"{tmp_path}/out/rows").count() == 5


def test_rounding_nudges_ties(spark):
    assert spark.range(1).select(numeric.r6(F.lit(0.0000005)), numeric.r6(F.lit(-0.0))).first()[0] == 1e-6


def test_user_scorer(spark):
    def exact(x, t, bonus=0.0):
        if (x == "boom").any():
            raise RuntimeError
        return [(1.0 if a == b else 0.5) + bonus if a != "nan" else "?" for a, b in zip(x, t, strict=True)]

    d = spark.createDataFrame([("a", "a"), ("b", "a"), ("boom", "a"), ("nan", "a")], "x string, t string").coalesce(1)
    assert [r[0] for r in d.select(scoring.user_scorer(exact)(F.col("x"), F.col("t"), bonus=1.0)).collect()] == [2.0, 1.5, 0.0, 0.0]


def test_ngrams(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (2, "a"), (3, ""), (4, None)], "k int, t string")
    w = texts.held(d, w=texts.words(texts.normalized(F.col("t"))))
    got = {r["k"]: r["g"] for r in w.select("k", texts.ngrams(F.col("w")).alias("g")).collect()}
    want = [" ".join("abcdef"[i : i + n]) for n in range(1, 5) for i in range(7 - n)]
    assert sorted(got[1]) == sorted(want) and len(got[1]) == 18 and got[2] == ["a"] and got[3] == [] and not got[4]


def test_mentions_in_a_long_text(spark):
    rng = random.Random(2)
    words = [rng.choice("abcdefgh") * 2 for _ in range(5000)]
    grams = {" ".join(words[i : i + n]) for n in range(1, 5) for i in range(len(words) - n + 1)}
    entries = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(n)) for n in (1, 2, 3, 4, 5) for _ in range(40)]
    d, s = spark.createDataFrame([(1, " ".join(words))], "k int, t string"), spark.createDataFrame([(e,) for e in entries], "symptom string")
    assert {r["symptom"] for r in G.mentioned(d, "k", "t", s).collect()} == {e for e in entries if e in grams and e.count(" ") < 4}


def test_texts_that_hold_others(spark):
    rng = random.Random(4)
    some = lambda n, most: sorted({"".join(rng.choice("abc ") for _ in range(rng.randint(0, most))) for _ in range(n)})
    whole, part = some(200, 12), some(200, 5)
    got = rows(G.containing(spark.createDataFrame([(x,) for x in whole], "a string"), spark.createDataFrame([(x,) for x in part], "b string"), "a", "b"), "a", "b")
    assert got == sorted((a, b) for a in whole for b in part if b and b in a)


@pytest.mark.parametrize("least", [0.0, 0.2, 0.5, 1.0])
def test_similar_names(spark, least):
    rng = random.Random(6)
    names = sorted({" ".join(rng.choice(["the", "the", "of", *(f"w{i}" for i in range(9))]) for _ in range(rng.randint(1, 6))) for _ in range(60)})
    d = spark.createDataFrame([(n,) for n in names], "a string")
    got = {(r["a"], r["b"]): r["score"] for r in G.jaccard(d, d.withColumnRenamed("a", "b"), "a", "a", "b", "b", least).collect()}
    sets = {n: set(n.split()) for n in names}
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in names for b in names}
    assert got == pytest.approx({k: v for k, v in want.items() if v > 0 and v >= least})


def test_scan_over_many_blocks(spark):
    d = spark.createDataFrame([([float(i) for i in range(1000)],), ([],)], "x array<double>")
    step = lambda a, x: ({"s": a["s"] + x}, a["s"] + x)
    got = [r[0] for r in d.select(folds.scan(F.col("x"), {"s": F.lit(0.0)}, step, "double")).collect()]
    assert got[0] == [i * (i + 1) / 2 for i in range(1000)] and got[1] == []


def test_first_mentions_of_the_graph(spark):
    """Initial symptoms, symptoms of other diseases inside a sentence, verbatim facts, repeats: worked out by hand."""
    edges = spark.createDataFrame([("flu", "fever", 3.0), ("flu", "dry cough", 1.0), ("gout", "swollen toe", 5.0)], "disease string, symptom string, weight double")
    facts = ["fever", "he says: swollen toe and dry cough", "unknown", "odd", "dry cough", "odd"]
    turns = spark.createDataFrame([("e", "flu", i, f, "diagnose" if i == 5 else "ask", "Flu") for i, f in enumerate(facts)], "episode_id string, disease string, turn_id long, fact string, action string, diagnosis string")
    from colloquy.operators import rewards as W

    got = W.graph_turn_rewards(turns, edges, spark.createDataFrame([("e", "Fever"), ("e", "headache")], "episode_id string, fact string")).orderBy("turn_id").collect()
    assert [r["delta"] for r in got] == [0, 0.25, 0, 0, 0, 0] and [r["coverage"] for r in got] == [0.75, 1, 1, 1, 1, 1]
    assert [r["n_new"] for r in got] == [0, 2, 2, 3, 3, 3] and [r["is_duplicate"] for r in got] == [True, False, False, False, True, False]
    assert got[-1]["is_correct"] and not got[-1]["premature"] and got[-1]["reward"] == 1.0


def test_answers_after_clean_up(spark):
    pairs = {"\\dfrac12": "\\frac{1}{2}", "0.5": "\\frac{1}{2}", "3/4": "\\frac{3}{4}", "x=5": "5", "\\sqrt2": "\\sqrt{2}", "12\\%": "12", ".25": "0.25", "90^\\circ": "90", "5\\text{ cm}": "5", "\\left(1,\\right)": "(1,)", "\\frac3{4}": "\\frac{3}{4}", "03/4": "03/4", "": ""}
    d = spark.createDataFrame(list(pairs.items()), "x string, want string")
    assert all(r["got"] == r["want"] for r in d.select("want", scoring.math_normal(F.col("x")).alias("got")).collect())
    finals = {"x = $5$": "5", "1,234": "1234", "\\text{five}": "five", "12 square feet": "12", "a fracab": "frac{a}{b}", "\\boxed{7}": "7", "1,2x": "1,2x"}
    d = spark.createDataFrame(list(finals.items()), "x string, want string")
    assert [(r["got"], r["want"]) for r in d.select("want", scoring.answer_normal(F.col("x")).alias("got")).collect() if r["got"] != r["want"]] == []


def test_managers_and_user_files(spark, tmp_path):
    (tmp_path / "own.py").write_text("import time\n\ndef slow(x, t, wait=0.0):\n    if x == 'sleep':\n        time.sleep(wait)\n    if x == 'bad':\n        raise ValueError(x)\n    return float(x == t)\n")
    d = spark.createDataFrame([("a", "a"), ("b", "a"), ("bad", "bad"), ("sleep", "sleep")], "solution string, ground_truth string").coalesce(1)
    began = __import__("time").time()
    got = dict(rows(scoring.manager("prime")(d, scorer=scoring.from_file(f"{tmp_path}/own.py", "slow"), limit=1.0, wait=60.0), "solution", "score"))
    assert got == {"a": 1.0, "b": 0.0, "bad": 0.0, "sleep": 0.0} and __import__("time").time() - began < 40
    with pytest.raises(ValueError):
        scoring.from_file(f"{tmp_path}/own.py", "none such")
    with pytest.raises(ValueError):
        scoring.manager("none such")
    with pytest.raises(ValueError):
        scoring.register_manager("naive")(lambda rows: rows)


def test_majority_of_resamples(spark):
    d = spark.createDataFrame([("s", "u", i, float(i), "A") for i in range(1, 6)], "src string, uid string, k long, v double, p string")
    got = {r["metric"]: r["value"] for r in M.group_metrics(d, ["src", "uid"], "v", "k", "p", draws=400).collect() if r["metric"].startswith("maj")}
    assert set(got) == {"maj@2/mean", "maj@2/std", "maj@4/mean", "maj@4/std", "maj@5/mean"}
    assert got["maj@2/mean"] == pytest.approx(3, abs=0.3) and got["maj@2/std"] == pytest.approx(2**0.5, abs=0.2)  # one pred: the first row drawn


def test_resampled_majority_stays_with_its_group(spark):
    """Draws by hand; whatever the number of draws, they are shuffled nowhere: rows are, once, by group."""
    rng = random.Random(5)
    d = [("s", f"u{g}", i, float(rng.randint(0, 9)), rng.choice(["A", "B", None])) for g, n in enumerate((1, 2, 3, 9, 33)) for i in range(n)]
    t = spark.createDataFrame(d, "src string, uid string, _o long, _v double, _p string").repartition(8, "src", "uid")
    got = M.resampled_majority(t, ["src", "uid"], 3, "42")
    want = {}
    for u in ("u2", "u3", "u4"):
        own, k = [x for x in d if x[1] == u], 2
        while k < len(own):
            won = []
            for b in range(3):
                drawn = [own[int(hashlib.md5(f"42|s|{u}|{k}|{b}|{j}".encode()).hexdigest()[:8], 16) % len(own)] for j in range(k)]
                preds = [x[4] for x in drawn]
                won.append(drawn[min(range(k), key=lambda j: (-preds.count(preds[j]), preds.index(preds[j])))][4])
                won[-1] = next(x[3] for x in drawn if x[4] == won[-1])
            mean = sum(won) / 3
            want[u, f"maj@{k}/mean"], want[u, f"maj@{k}/std"] = mean, math.sqrt(sum((v - mean) ** 2 for v in won) / 3)
            k *= 2
    assert {(r["uid"], r["metric"]): r["value"] for r in got.collect()} == pytest.approx(want)
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


def test_only_the_metrics_asked_for(spark, monkeypatch):
    monkeypatch.setattr(M, "TASK_ROWS", 10)
    d = spark.createDataFrame([("s", f"u{i % 40}", i, float(i % 7), "AB"[i % 2]) for i in range(200)], "src string, uid string, k long, v double, p string")
    nine = lambda m: {(r["uid"], r["metric"], round(r["value"], 9)) for r in m.collect()}
    every = nine(M.group_metrics(d, ["src", "uid"], "v", "k", "p", draws=2))
    for only in (("maj",), ("mean", "std"), ("std",), ("best",), ("best", "worst")):
        got = M.group_metrics(d, ["src", "uid"], "v", "k", "p", draws=2, only=only)
        assert nine(got) == {x for x in every if x[1].split("@")[0] in only}
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert (" AS pw#" in plan) == bool({"best", "worst"} & set(only))
        assert ("RepartitionByExpression [src" in plan and ", 20" in plan) == (only == ("maj",))


def test_prime_by_hand(spark):
    t = spark.createDataFrame([("u", 1, 0, 1, 1.0, 1.0), ("u", 1, 1, 1, 3.0, 1.0), ("u", 2, 0, 1, 4.0, 0.0), ("u", 2, 1, 0, 9.0, 0.0)], "uid string, sample_id long, pos long, mask int, reward double, acc double")
    got = {(r["sample_id"], r["pos"]): r["returns"] for r in A.prime_rloo(t, 1.0, 1.0).collect()}
    # sums of means 6 and 1: tokens 2r - 6, outcome 2a - 1
    assert got == pytest.approx({(1, 0): -4 + 0 + 1, (1, 1): 0 + 1, (2, 0): 2 - 1, (2, 1): 0}, abs=1e-6)


def test_streams_that_gather(spark, tmp_path):
    for step in range(3):
        spark.createDataFrame([(f"g{step}{i}", float(j * (i % 2)), step) for i in range(4) for j in range(2)], "uid string, score double, step long").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    read = lambda: steps.read_steps(spark, f"{tmp_path}/in", "uid string, score double, step long")
    assert rows(steps.gather_groups(read(), f"{tmp_path}/a", 3, 5), "uid") == [("g01",), ("g03",), ("g11",)]
    with pytest.raises(Exception, match="fewer than 99 groups"):
        steps.gather_groups(read(), f"{tmp_path}/b", 99, 5)
    with pytest.raises(Exception, match="fewer than 99 groups"):
        steps.gather_groups(read(), f"{tmp_path}/c", 99, 2)
    assert rows(steps.difficulty_stream(read(), f"{tmp_path}/d"), "uid", "difficulty")[1] == ("g01", 0.5)


def test_steps_that_never_come(spark, tmp_path):
    spark.createDataFrame([("a", s, 2.0) for s in (1, 2, 3, 4, 5)], "name string, step long, x double").coalesce(1).write.json(f"{tmp_path}/in")
    out = steps.run(steps.ewma_stream(steps.read_steps(spark, f"{tmp_path}/in", "name string, step long, x double"), max_wait=3), f"{tmp_path}/out")
    assert rows(out, "step", "kind") == [(0, "lost"), *((s, "value") for s in (1, 2, 3, 4, 5))]


def _batches(spark, path, schema, *batches):
    """A file a batch, in order."""
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.json(f"{path}/{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(path))


def test_late_steps_are_told(spark, tmp_path):
    """Early steps wait over batches; lost, late and repeated ones are rows; a key's state holds what waits and what is lost."""
    x = lambda *s: [("a", k, float(k)) for k in s]
    stream = _batches(spark, tmp_path / "in", "name string, step long, x double", x(0, 2), x(5, 4, 2), x(7, 8, 8), x(1, 3, 0), x(6, 9))
    with steps.keyed_state(spark):
        q = steps.ewma_stream(stream, alpha=1.0, max_wait=4).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    got = spark.read.parquet(f"{tmp_path}/out")
    assert rows(got.where("kind = 'value'"), "step", "value") == [(k, float(k)) for k in (0, 2, 3, 4, 5, 6, 7, 8, 9)]
    assert rows(got.where("kind <> 'value'"), "kind", "step") == [("again", 0), ("again", 2), ("again", 8), ("late", 1), ("lost", 1)]
    assert max(held) <= 1 + 4 + 1 and held[-1] == 1


def test_idle_episodes_end(spark, tmp_path):
    """An episode that goes quiet ends by its timer; one that is done leaves no row for late turns."""
    import time

    stream = _batches(spark, tmp_path / "in", "episode_id string, turn_id long, action string", [("quiet", 0, "ask"), ("done", 0, "answer")], [("done", 1, "ask"), ("more", 0, "ask")], [("more", 1, "diagnose")])
    with steps.keyed_state(spark):
        q = steps.episodes(stream, 5, idle_ms=4000).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="1 second").start(f"{tmp_path}/out")
    try:
        until, got = time.time() + 90, []
        while len(got) < 3 and time.time() < until:
            time.sleep(1)
            got = rows(spark.read.schema("episode_id string, turns long, outcome double").parquet(f"{tmp_path}/out"), "episode_id", "turns", "outcome") if (tmp_path / "out").exists() else []
    finally:
        q.stop()
    assert got == [("done", 1, 1.0), ("more", 2, 1.0), ("quiet", 1, -2.0)]


@pytest.mark.parametrize("n", [0, 1, 99, 100, 137, 200, 500])
def test_first_n_by_ranges(spark, monkeypatch, n):
    monkeypatch.setattr(DS, "GATHER", -1)
    d = spark.createDataFrame([(i * 7919 % 200, i % 3) for i in range(200)], "k long, g long").repartition(3)
    want = sorted((r["g"], r["k"]) for r in d.collect())[:n]
    assert rows(DS.first_n(d, [F.col("g"), F.col("k")], n), "g", "k") == want


def test_dense_search_stops_by_norm(spark):
    rng = random.Random(4)
    vec = lambda scale: [scale * rng.uniform(-1, 1) for _ in range(8)]
    corpus = [(i, vec(10.0 if i < 30 else 0.1)) for i in range(600)] + [(600, [0.0] * 8), (601, [0.0] * 8), (602, None)]
    queries = [(q, vec(1.0)) for q in range(7)] + [(7, [0.0] * 8)]
    from colloquy.operators import retrieval

    got = retrieval.dense(spark.createDataFrame(queries, "qid long, q array<double>"), spark.createDataFrame(corpus, "vec_id long, embedding array<double>"), 3, rows=40).collect()
    want = []
    for q, x in queries:
        scored = sorted((-(round(sum(a * b for a, b in zip(x, y, strict=True)), 6) + 0.0), i) for i, y in corpus if y)
        want += [(q, i, r, -s) for r, (s, i) in enumerate(scored[:3], 1)]
    assert sorted((r["qid"], r["vec_id"], r["rank"], pytest.approx(r["score"], abs=2e-6)) for r in got) == sorted(want)
    assert max(r["scored"] for r in got if r["qid"] < 7) < 200 and {r["scored"] for r in got if r["qid"] == 7} == {602}


@pytest.mark.parametrize("threshold", [0.2, 0.5, 0.7])
def test_repeated_questions(spark, threshold):
    rng = random.Random(1)
    word = lambda: rng.choice(["is", "it", "the", "pain", "fever", "night", "cough", "where?", "when?"])
    asked = [(c, 2 * t, rng.choice([" ".join(word() for _ in range(rng.randint(0, 7))), "is it the pain", None if rng.random() < 0.1 else "x"])) for c in range(6) for t in range(25)]
    d = spark.createDataFrame(asked, "conv_id long, turn long, text string")
    want, seen = [], {}
    for c, t, x in sorted(asked, key=lambda r: r[:2]):
        w = set((x or "").lower().split())
        again = any(w and o and len(w & o) / len(w | o) > threshold for o in seen.get(c, []))
        seen.setdefault(c, []).append(w)
        many = (x or "").count("?") > 1
        want.append((c, t, "<Repeated>" if again else "<Multiple>" if many else "<Normal>"))
    assert rows(W.question_checks(d, threshold), "conv_id", "turn", "verifier") == want


@pytest.mark.parametrize("common", [0, 2, 1000])
def test_best_statements(spark, common):
    rng = random.Random(common)
    word = lambda: rng.choice(["pain", "fever", "night", "cough", "where", "since", "x1", "x2", "x3", "x4"])
    turns = [(c, t, sorted({word() for _ in range(rng.randint(0, 5))})) for c in range(5) for t in range(40)]
    q, f = [r for r in turns if r[1] % 2 == 0], [r for r in turns if r[1] % 2]
    got = W.best_statements(spark.createDataFrame(q, "conv_id long, turn long, words array<string>"), spark.createDataFrame(f, "conv_id long, fact_id long, words array<string>"), common=common)
    want = []
    for c, t, w in q:
        scored = sorted((-(len(set(w) & set(v)) - 0.25 * (i < t)), i) for d, i, v in f if d == c)
        if scored[0][0] < 0:
            want.append((c, t, scored[0][1]))
    assert rows(got, "conv_id", "turn", "fact_id") == sorted(want)


def test_one_dialogue_of_many_questions(spark):
    """50,000 turns, one in ten asked before."""
    d = spark.range(50_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.concat(F.lit("do you have sign "), F.when(F.col("id") % 10 == 9, F.col("id") - 5).otherwise(F.col("id")).cast("string"), F.lit(" of kind "), F.md5(F.when(F.col("id") % 10 == 9, F.col("id") - 5).otherwise(F.col("id")).cast("string")), F.lit(" since "), F.md5((F.when(F.col("id") % 10 == 9, F.col("id") - 5).otherwise(F.col("id")) + 1).cast("string"))).alias("text"))
    got = W.question_checks(d).groupBy("verifier").count()
    assert rows(got, "verifier", "count") == [("<Normal>", 45_000), ("<Repeated>", 5_000)]


def test_users_views_stay(spark):
    from colloquy.sources.views import view

    spark.range(1).createOrReplaceTempView("events")
    view(spark, "/root/testdata/sf0.001", "rollouts").limit(1).count()
    assert spark.table("events").columns == ["id"]
    spark.catalog.dropTempView("events")


def _folded(tree, gamma):
    """value and visits by walking each tree from its leaves, without recursion."""
    kids, out = {}, {}
    for n, (parent, _, _) in tree.items():
        kids.setdefault(parent, []).append(n)
    order, at = [], list(kids.get(None, []))
    while at:
        n = at.pop()
        order.append(n)
        at += kids.get(n, [])
    for n in reversed(order):
        if tree[n][2]:
            out[n] = (0.0, 1)
            continue
        known = [(tree[c][1] + gamma * out[c][0], out[c][1]) for c in kids.get(n, []) if out[c][0] is not None]
        out[n] = (sum(v for v, _ in known) / len(known), sum(m for _, m in known)) if known else (None, 0)
    return out


def _tree(rng, n, pick):
    """node: (parent, reward, is_terminal); some leaves have not ended, and some inner nodes have."""
    parent = {0: None} | {i: pick(i) for i in range(1, n)}
    inner = set(parent.values())
    return {i: (p, round(rng.random(), 3), rng.random() < (0.02 if i in inner else 0.8)) for i, p in parent.items()}


@pytest.mark.parametrize("gamma", [1.0, 0.9])
def test_deep_trees(spark, gamma):
    """A chain of 10,000 nodes, one whose end is unknown, a caterpillar, bushy and odd trees, a single node: all as a walk folds them."""
    rng = random.Random(8)
    forest = {
        0: _tree(rng, 10_000, lambda i: i - 1) | {9_999: (9_998, 0.5, True)},
        1: _tree(rng, 300, lambda i: i - 1) | {299: (298, 0.5, False)},
        2: _tree(rng, 900, lambda i: i - 1 if i % 2 == 0 or i == 1 else max(i - 2, 0)),
        3: _tree(rng, 600, lambda i: rng.randrange(i)),
        4: _tree(rng, 600, lambda i: max(0, i - rng.randint(1, 4))),
        5: {0: (None, 0.0, True)},
        6: {0: (None, 0.0, False)},
    }
    rows_, want = [], {}
    for t, tree in forest.items():
        depth = {}
        for n, (p, r, end) in tree.items():
            depth[n] = 0 if p is None else depth[p] + 1
            rows_.append((t, n, p, depth[n], end, r, 0.0))
        want |= {(t, n): x for n, x in _folded(tree, gamma).items()}
    d = spark.createDataFrame(rows_, "tree_id long, node_id long, parent_id long, level int, is_terminal boolean, action_reward double, critic_value double").repartition(3)
    got = {(r["tree_id"], r["node_id"]): (r["value"], r["visits"]) for r in trees.backup(d, gamma).collect()}
    assert got.keys() == want.keys()
    for k, (v, m) in want.items():
        assert got[k][1] == m and (got[k][0] == v if v is None else got[k][0] == pytest.approx(v, abs=1e-6)), k


def test_contraction_is_the_walk(spark):
    rng = random.Random(3)
    tree = _tree(rng, 200, lambda i: (i - 1) // 2)
    depth = {}
    rows_ = []
    for n, (p, r, end) in tree.items():
        depth[n] = 0 if p is None else depth[p] + 1
        rows_.append((1, n, p, depth[n], end, r, rng.random()))
    d = spark.createDataFrame(rows_, "tree_id long, node_id long, parent_id long, level int, is_terminal boolean, action_reward double, critic_value double")
    a, b = (sorted((r["node_id"], r["value"] and round(r["value"], 9), r["visits"], r["advantage"] and round(r["advantage"], 9)) for r in trees.backup(d, 0.9, shallow=s).collect()) for s in (64, 0))
    assert a == b


def test_chains_of_scattered_ids_are_spliced(spark, monkeypatch):
    """Runs of 16 links, ids in no order, rewards that are missing: what was put aside comes back as the walk has it."""
    monkeypatch.setattr(trees, "RUN", 16)
    rng = random.Random(5)
    name = rng.sample(range(1 << 40), 120)
    rows_ = [(1, name[i], None if i == 0 else name[max(i - 1 - (i % 2 == 0), 0)], (i + 1) // 2, i % 2 == 1 or i == 118, None if i % 7 == 0 else rng.random()) for i in range(119)]
    d = spark.createDataFrame(rows_, "tree_id long, node_id long, parent_id long, level int, is_terminal boolean, action_reward double")
    a, b = (sorted((r["node_id"], r["value"] and round(r["value"], 9), r["visits"]) for r in trees.values(d, 0.9, shallow=s).collect()) for s in (80, 0))
    assert a == b and len(a) == 119


def test_outcomes_of_episodes_are_windows(spark):
    """e10 reads the turns twice, for turns and for episodes, and not twice more for the outcomes."""
    from colloquy.plans.advantages import e10

    plan = e10(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_") == 2, plan


def test_circle_of_parents(spark, monkeypatch):
    monkeypatch.setattr(trees, "ROUNDS", 6)
    d = spark.createDataFrame([(1, 1, 2, 0, False, 0.0, 0.0), (1, 2, 1, 1, False, 0.0, 0.0)], "tree_id long, node_id long, parent_id long, level int, is_terminal boolean, action_reward double, critic_value double")
    with pytest.raises(ValueError, match="circle"):
        trees.backup(d, shallow=0)


CHATS = [
    [("system", "You are a helpful assistant."), ("user", "What is 2+2?"), ("assistant", "2+2 equals 4."), ("user", "And what is 4+4?"), ("assistant", "4+4 equals 8.")],
    [("system", "You are a helpful assistant."), ("user", "Tell me a joke."), ("assistant", "Why did the chicken cross the road?"), ("user", "Why?"), ("assistant", "To get to the other side!")],
]


def _points(text):
    return F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c))


def _chats(spark, chats, length=512, truncation="error"):
    d = spark.createDataFrame([(i, c) for i, c in enumerate(chats)], "id int, m array<struct<role string, content string>>")
    head = lambda role: F.concat(F.lit("<|im_start|>"), role, F.lit("\n"))
    d = sft.multi_turn(d.select("id", sft.message_parts(F.col("m"), _points, head, "<|im_end|>\n").alias("parts")), "parts", length, 7, truncation)
    return [r["row"] for r in d.orderBy("id").collect()]


def test_chat_masks(spark):
    for chat, row in zip(CHATS, _chats(spark, CHATS), strict=True):
        text = "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in chat)
        n = len(text)
        assert [chr(x) for x in row.input_ids[:n]] == list(text) and set(row.input_ids[n:]) == {7}
        assert all(len(a) == 512 for a in row)
        on = "".join(chr(x) for x, m in zip(row.input_ids, row.loss_mask, strict=True) if m)
        off = "".join(chr(x) for x, m in zip(row.input_ids[:n], row.loss_mask, strict=False) if not m)
        said = [c for r, c in chat if r == "assistant"]
        assert on == "".join(f"{c}<|im_end|>\n" for c in said) and not any(c in off for c in said)
        assert row.attention_mask == [1] * n + [0] * (512 - n)
        assert row.position_ids == [*range(n), *[0] * (512 - n)] and sum(row.loss_mask[n:]) == 0


def test_chat_masks_cut_and_checked(spark):
    n = len("".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for r, c in CHATS[0]))
    whole = _chats(spark, CHATS[:1], n)[0]
    for side, part in (("right", slice(0, 40)), ("left", slice(n - 40, n))):
        row = _chats(spark, CHATS[:1], 40, side)[0]
        assert (row.input_ids, row.loss_mask, row.attention_mask) == (whole.input_ids[part], whole.loss_mask[part], [1] * 40)
    for bad, what in (([("user", "x"), ("system", "y")], "not the first"), ([("robot", "x")], "unknown role"), (CHATS[0], "longer")):
        with pytest.raises(Exception, match=what):
            _chats(spark, [bad], 40)
    assert _chats(spark, [[("system", "s"), ("tool", "a"), ("tool", "b"), ("user", None)]], 200)[0].loss_mask == [0] * 200
    assert _chats(spark, [[]], 3)[0].input_ids == [7, 7, 7]


def _single(p, r, length, side):
    """The rule, place by place."""
    x, n = p + r, len(p) + len(r)
    ids = x + [0] * (length - n) if n <= length else x[-length:] if side == "left" else x[:length]
    attention = [1] * min(n, length) + [0] * max(length - n, 0)
    loss = list(attention)
    if len(p) > 1:
        for i in range(min(len(p), length) - 1):
            loss[i] = 0
    if n:
        loss[min(n, length) - 1] = 0
    seen, places = 0, []
    for a in attention:
        seen += a
        places.append(max(seen - 1, 0))
    return ids, attention, places, loss


@pytest.mark.parametrize("side", ["left", "right"])
def test_prompt_masks(spark, side):
    cases = [([1, 2, 3], [4, 5]), ([1], [2, 3]), ([], [1, 2]), ([1, 2], []), ([], []), (list(range(1, 20)), [90, 91]), ([1, 2], list(range(30, 50))), ([1, 2, 3, 4, 5], [6, 7, 8])]
    d = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(cases)] + [(99, None, [5])], "i int, p array<int>, r array<int>")
    got = {r["i"]: tuple(r["row"]) for r in sft.single_turn(d, "p", "r", 8, 0, side).collect()}
    assert got == {i: _single(p, r, 8, side) for i, (p, r) in enumerate(cases)} | {99: _single([], [5], 8, side)}
    with pytest.raises(Exception, match="longer"):
        sft.single_turn(d, "p", "r", 8, 0).collect()


def test_row_builders(spark):
    packed = base64.b64encode(zlib.compress(pickle.dumps(json.dumps([{"input": "9", "output": "81"}])))).decode()
    evil = base64.b64encode(zlib.compress(pickle.dumps(random.Random))).decode()
    rows_ = [
        (1, "square", "", '[{"input": "2", "output": "4"}]', packed, "{}", "2024-08-01T00:00:00"),
        (2, "cube", "def f(x):", None, '[{"input": "é", "output": "\\""}]', '{"func_name": "f"}', "2024-12-31T23:00:00"),
        (3, "late", "", "[]", "[]", "{}", "2025-01-01T00:00:00"),
        (4, "evil", None, "[]", evil, None, "2024-09-01T00:00:00"),
    ]
    d = spark.createDataFrame(rows_, "k int, question_content string, starter_code string, public_test_cases string, private_test_cases string, metadata string, contest_date string")
    got = {r["extra_info"]["index"]: r for r in builders.built(d, builders.code(), "k").collect()}
    truth = [json.loads(got[i]["reward_model"]["ground_truth"]) for i in range(3)]
    assert truth == [{"inputs": ["2", "9"], "outputs": ["4", "81"], "fn_name": None}, {"inputs": ["é"], "outputs": ['"'], "fn_name": "f"}, {"inputs": [], "outputs": [], "fn_name": None}]
    assert got[0]["prompt"][0]["content"].endswith("# YOUR CODE HERE\n```") and got[1]["prompt"][0]["content"].endswith("```python\ndef f(x):\n```")
    q = spark.createDataFrame([(i, f"q{i}", "r", "a", "b", "c") for i in range(60)], ["k", "Question", "Correct Answer", "Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3"])
    out = builders.built(q, builders.gpqa("k"), "k").collect()
    letters = [r["reward_model"]["ground_truth"] for r in out]
    assert all(f"\n{x}) r" in r["prompt"][0]["content"] for x, r in zip(letters, out, strict=True)) and set(letters) == set("ABCD")


def test_preferences(spark):
    d = spark.createDataFrame([(i, f"p{i}", f"c{i}", f"r{i}") for i in range(10)], "k int, prompt string, chosen string, rejected string")
    assert rows(builders.preference_sft(d.where("k = 1")), "prompt", "response", "kind") == [("p1", "c1", "chosen"), ("p1", "r1", "rejected")]
    got = rows(builders.preference_rm(d, "k"), "split", "k")
    assert got == [("test", 8), ("test", 9), *(("train", i) for i in range(8))]
    r = builders.preference_rl(d.withColumn("response", F.col("chosen")), "k").orderBy("extra_info.index").first()
    assert (r["prompt"][0]["content"], r["reward_model"]["style"], r["ability"], r["extra_info"]["index"]) == ("p0", "model", "alignment", 0)


def test_case_records(spark):
    records = [
        {"disease": "flu", "chief_complaint": "I have a fever", "symptoms_pool": {"fever": 0.5}, "initial_symptoms": ["fever"], "data_source": "kg2"},
        {"disease": "flu", "chief_complaint": "too short"},
        {"ground_truth": {"answer_info": "cold", "atomic_facts": ["It runs."]}, "prompt": [{"role": "system", "content": "s"}, {"role": "user", "content": " my nose runs a lot \nProblem: which?\nOptions"}]},
        {"disease": "", "ground_truth": {"disease": "rash", "symptoms_pool": {"itch": 1}, "initial_symptoms": ["itch"], "atomic_facts": ["x"]}, "prompt": [{"role": "user", "content": "it itches all over"}]},
        {"ground_truth": "text", "prompt": [{"role": "user", "content": "it itches all over"}]},
        {"disease": "flu", "prompt": [{"role": "user", "content": "nested complaint here"}]},
    ]
    d = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, "no json"), (10, None)], "i int, record string")
    got = builders.case_rows(d, "record", "sys", "I say: {chief_complaint}", prefix="p_").orderBy("i").collect()
    assert [(r["i"], r["disease"], r["chief_complaint"], r["initial_symptoms"], r["symptoms_pool"], r["data_source"]) for r in got] == [
        (0, "flu", "I have a fever", ["fever"], {"fever": 0.5}, "p_kg2"),
        (2, "cold", "my nose runs a lot", ["It runs."], {}, "p_kg"),
        (3, "rash", "it itches all over", ["itch"], {"itch": 1.0}, "p_kg"),
    ]
    assert [tuple(m) for m in got[0]["prompt"]] == [("system", "sys"), ("user", "I say: I have a fever")]


USER = """
class Numbers:
    schema = "n long, part int"

    def __init__(self, options):
        self.parts = int(options["parts"])

    def partitions(self):
        return list(range(self.parts))

    def rows(self, part):
        for k in range(3):
            yield part * 3 + k, part

class Odd:
    def key(self, rows):
        return (rows["n"] % 2).where(rows["n"] != 4)
"""


def test_user_classes(spark, tmp_path):
    (tmp_path / "own.py").write_text(USER)
    d = custom.dataset(spark, scoring.from_file(str(tmp_path / "own.py"), "Numbers"), parts=4)
    assert rows(d, "n", "part") == [(k, k // 3) for k in range(12)]
    assert d.rdd.getNumPartitions() == 4
    got = sorted((r["place"], r["n"]) for r in custom.sampled(d, scoring.from_file(str(tmp_path / "own.py"), "Odd"), "n", "n").collect())
    assert [n for _, n in got] == [0, 2, 6, 8, 10, 1, 3, 5, 7, 9, 11, 4] and [p for p, _ in got] == list(range(12))
    for bad in (dict, "x"):
        with pytest.raises(TypeError):
            custom.dataset(spark, bad)
    with pytest.raises(TypeError, match="key"):
        custom.sampled(d, dict, "n", "n")


def test_episodes_share_trips_to_the_state(spark, tmp_path, monkeypatch):
    """the state has a key a bucket, not one an episode; late turns, turns over several batches and lost ids stay right."""
    monkeypatch.setattr(steps, "BUCKETS", 3)
    at = lambda turns: [(f"e{i}", t, a) for i in range(200) for t, a in turns(i)]
    stream = _batches(
        spark, tmp_path / "in", "episode_id string, turn_id long, action string",
        at(lambda i: [(1, "ask"), (0, "diagnose" if i % 2 else "ask")]), at(lambda i: [(2, "answer"), (3, "ask")] if i % 3 else []), at(lambda i: [(4, "ask"), (5, "diagnose")]),
    )
    with steps.keyed_state(spark):
        q = steps.episodes(stream, 4).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
    want = sorted((f"e{i}", 1, 1.0) if i % 2 else (f"e{i}", 3, 1.0) if i % 3 else (f"e{i}", 4, 1.0) for i in range(200))
    got = spark.read.schema("episode_id string, turns long, outcome double").parquet(f"{tmp_path}/out")
    assert rows(got, "episode_id", "turns", "outcome") == want
    keys = spark.read.format("statestore").option("stateVarName", "done").load(f"{tmp_path}/c").select("key").distinct().count()
    assert keys == 3


def test_parts_of_vectors_are_floored_in_their_own_precision(spark, tmp_path):
    """F2: 0.18 as a float times 100 is 18 in floats, and less than 18 in doubles."""
    from colloquy.plans.registry import QUERIES

    spark.createDataFrame([(1, [0.18] * 64, 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert rows(QUERIES["g7"](spark, str(tmp_path)), "chunk", "part") == [(k, " ".join(["18"] * 16)) for k in range(4)]


def test_denial_is_a_whole_word_of_any_script(spark):
    """the query and its SQL agree on a word that begins with a denial before a letter that is not ASCII."""
    import duckdb
    from colloquy.plans.registry import ORACLES

    texts_ = ["el noñíllos, al", "nothing", "no", "ñno a", "has no, or", "never_ a", "not2 a"]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id INT, turn INT, text TEXT)")
    con.executemany("INSERT INTO conversations VALUES (?, 0, ?)", [(i, f"a b c d e {t}") for i, t in enumerate(texts_)])
    want = [r[2] for r in con.execute(ORACLES["h15"] + " ORDER BY conv_id").fetchall()]
    d = spark.createDataFrame([(i, f"he says no a b c d e {t} fever") for i, t in enumerate(texts_)], "k int, t string")
    got = [r[1] for r in rows(d.select("k", parsing.denied_before(F.col("t"), F.lit("fever")).alias("d")), "k", "d")]
    assert got == want == [False, False, True, False, True, False, False]


def test_imbalance_query_gives_the_balanced_sums(spark, tmp_path):
    """the sums after balancing are results, beside the SQL that balances the same way."""
    import duckdb
    from colloquy.plans.registry import ORACLES, QUERIES

    # event_id gives step and length; steps of one row to many, with whole rounds and what is left of them
    n = [i for i in range(4000) if i % 20 < 12 or i < 60]
    spark.createDataFrame([(i, i % 7, float(i % 5), "a") for i in n], "event_id long, user_id long, value double, event_type string").withColumn("ts", F.timestamp_seconds(F.col("event_id"))).write.parquet(f"{tmp_path}/events.parquet")
    d = QUERIES["d24"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    cols = ("step", "balanced_least", "balanced_most", "least", "most", "gap", "mean", "within", "around")
    got = rows(d, *cols)
    assert got == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES['d24']})").fetchall())
    assert len(got) == 20 and all(r[1] <= r[6] <= r[2] for r in got) and len({r[1] for r in got}) > 5


def test_augment_meets_each_symptom_of_a_name_once(spark, monkeypatch):
    """copies of a name's symptom don't each meet the diseases of the name."""
    seen, merge = [], G.merge
    monkeypatch.setattr(G, "merge", lambda *e: seen.append(e) or merge(*e))
    edges = spark.createDataFrame([(f"d{i}", "old sign", 0.5) for i in range(50)], "disease string, symptom string, weight double")
    extra = spark.createDataFrame([("all", "new sign", 0.1 + i % 3 / 10) for i in range(60)] + [("d1", "old sign", 0.9), ("none", "new sign", 1.0)], "name string, symptom string, weight double")
    got = rows(G.augment(edges, extra, edges.select(F.lit("all").alias("alias"), "disease")), "disease", "symptom", "weight")
    assert got == sorted([(f"d{i}", "new sign", pytest.approx(0.3)) for i in range(50)] + [(f"d{i}", "old sign", 0.9 if i == 1 else 0.5) for i in range(50)])
    assert seen[0][1].count() == 51


def test_dense_search_by_matrix_products_is_exact(spark, monkeypatch):
    """copies, ties after rounding, null and non-finite components, other lengths; no pair becomes a row unless it may be among the best."""
    from colloquy.operators import retrieval

    rng = random.Random(6)
    base = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(40)]
    corpus = [(i, base[i % 40] if i < 300 else [x + 1e-8 for x in base[i % 40]]) for i in range(400)]
    corpus += [(400, [None] + [1.0] * 5), (401, [1.0] * 4), (402, [float("inf")] + [0.0] * 5), (403, [float("nan")] * 6), (404, []), (405, None)]
    queries = [(q, base[q]) for q in range(9)] + [(9, [1.0] * 4), (10, [None] * 6), (11, [0.0] * 6), (12, [])]
    seen, products = [], retrieval._products
    monkeypatch.setattr(retrieval, "QUERIES", 5)
    monkeypatch.setattr(retrieval, "_products", lambda k: seen.append(k) or products(k))
    q, c = spark.createDataFrame(queries, "qid long, q array<double>"), spark.createDataFrame(corpus, "vec_id long, embedding array<double>")
    dot = F.aggregate(F.zip_with("q", "embedding", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    # a length of 0 or another gives null, as it does in SQL
    all_ = q.crossJoin(c.where("embedding IS NOT NULL")).select("qid", "vec_id", numeric.r6(dot).alias("score"))
    key = lambda r: (r["score"] is None, r["score"] == r["score"], -(r["score"] or 0.0) if r["score"] == r["score"] else 0.0, r["vec_id"])
    want = {}
    for r in all_.collect():
        want.setdefault(r["qid"], []).append(r)
    want = sorted((i, n, r["vec_id"], str(r["score"])) for i, rs in want.items() for n, r in enumerate(sorted(rs, key=key)[:3], 1))
    got = sorted((r["qid"], r["rank"], r["vec_id"], str(r["score"])) for r in retrieval.dense(q, c, 3, rows=1000).collect())
    assert got == want and seen


def test_symptom_patterns_share_their_boundary_and_first_letter(spark):
    """F8: a pattern is tried only where a word begins with its letter; labels are as by the list of patterns."""
    import re

    words_ = sorted({re.sub(r"\\b|\.\*|\?", " " if "*" in p else "", p).strip() for ps in texts.SYMPTOM_TYPES.values() for p in ps})
    xs = [f"{a}{w}{b}" for w in words_ for a, b in (("", ""), ("un", ""), ("a ", "s x"), ("A. ", "!"), ("x-", "'s"))] + ["retinal or other atrophy", "", "ache", "tumor", "a  Mean\tage"]

    def plain(x):
        s = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 '\-]", " ", x.lower())).strip()
        return next((k for k, ps in texts.SYMPTOM_TYPES.items() if re.search(texts.any_of(ps), s)), "patient_reportable")

    d = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "k int, x string")
    assert [r[1] for r in rows(d.select("k", texts.symptom_type(F.col("x")).alias("t")), "k", "t")] == [plain(x) for x in xs]
    assert all(texts._at_words(ps).startswith(r"\b(?:") for ps in texts.SYMPTOM_TYPES.values())
    assert d.select(texts.symptom_type(F.lit(None).cast("string")).alias("t")).first()["t"] == "patient_reportable"


def test_jaccard_prefix_knows_both_sizes(spark, monkeypatch):
    """a word of all texts joins no pair of texts of two words, which must share both at a half; and no pair is lost."""
    seen = []
    names = [f"finding {i}" for i in range(120)] + ["finding", "17", "finding 3 4", "a b finding 5", "3 finding x y", "q r s t u"]
    d = spark.createDataFrame([(x,) for x in names], "t string")
    distinct = type(d).distinct
    monkeypatch.setattr(type(d), "distinct", lambda f: seen.append(f) or distinct(f))
    for least in (0.2, 0.5, 0.8):
        seen.clear()
        got = G.jaccard(d, d.withColumnRenamed("t", "u"), "t", "t", "u", "u", least)
        met = seen[-1]
        words_ = {x: set(x.split()) for x in names}
        alike = lambda x, y: len(words_[x] & words_[y]) / len(words_[x] | words_[y])
        assert rows(got, "t", "u") == sorted((x, y) for x in names for y in names if alike(x, y) and alike(x, y) >= least - 1e-12)
        if least == 0.5:
            assert met.count() < 1000


def test_normalized_looks_for_ranges(spark):
    every = "".join(map(chr, [*range(1, 0x250), 0x2028, 0xFFFD, 0x1F600])) + "Az09 -'"
    d = spark.createDataFrame([(every,)], "x string")
    assert d.select(texts.normalized(F.col("x"))).first()[0] == d.select(F.trim(F.regexp_replace(F.lower("x"), r"[^a-z0-9 \-']", " "))).first()[0]
    assert "[^" not in str(texts.normalized(F.col("x"))) and "[^" not in str(texts.collapsed(F.col("x")))


def test_kinds_of_a_graph_once_a_disease(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"A.": {"x!": 0.5, "y": "no"}, "b": ["z"], "c": 3, "d": "t", "e": []}')
    d = G.read_graph(spark, str(tmp_path))
    assert "SchemaOfVariant" not in d._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert sorted(map(tuple, d.collect()), key=str) == [("a", "x", 0.5), ("a", "y", None), ("b", "z", 1.0)]


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def dialogue(spark):
    turns = spark.createDataFrame(
        [("e", "d", 0, "has a", "ask"), ("e", "d", 1, "b", "ask"), ("e", "d", 2, None, "ask"), ("e", "d", 3, "a", "ask"), ("e", "d", 4, "c", "ask"), ("e", "d", 5, "b", "diagnose"), ("f", "x", 0, "Unknown", "ask"), ("f", "x", 1, "odd", "ask")],
        "episode_id string, disease string, turn_id long, fact string, action string",
    ).withColumn("diagnosis", F.lit("d"))
    return turns, spark.createDataFrame([("d", "a", 0.5), ("d", "a", 0.2), ("d", "b", 0.25), ("d", "c", 0.25), ("y", "odd", 1.0)], "disease string, symptom string, weight double")


def test_turn_rewards_in_one_shuffle(spark):
    turns, edges = dialogue(spark)
    initial = spark.createDataFrame([("e", "d", "c"), ("e", "d", "odd"), ("e", "d", "c")], "episode_id string, disease string, fact string")
    d = W.graph_turn_rewards(turns, edges, initial)
    assert shuffles(d) == 1
    want = [("e", 0, 0.5, 0.75, 1, False, False), ("e", 1, 0.25, 1.0, 2, False, False), ("e", 2, 0.0, 1.0, 2, False, False), ("e", 3, 0.0, 1.0, 2, False, True), ("e", 4, 0.0, 1.0, 2, False, True), ("e", 5, 0.0, 1.0, 2, True, False), ("f", 0, 0.0, 0.0, 0, False, False), ("f", 1, 0.0, 0.0, 1, False, False)]
    cols = ("episode_id", "turn_id", "delta", "coverage", "n_new", "is_correct", "is_duplicate")
    assert rows(d, *cols) == want
    assert rows(W.graph_turn_rewards(turns, edges, initial.drop("disease")), *cols) == want


def test_text_turn_rewards_in_one_shuffle(spark):
    turns, edges = dialogue(spark)
    d = W.text_turn_rewards(turns.withColumn("text", F.when(F.col("turn_id") == 0, "no a").otherwise(F.concat(F.lit("there is "), "fact"))), edges.where("weight <> 0.2"))
    assert shuffles(d) == 1
    assert rows(d.where("episode_id = 'e'"), "turn_id", "delta", "n_collected") == [(0, 0.0, 0), (1, 0.25, 1), (2, 0.0, 1), (3, 0.5, 2), (4, 0.25, 3), (5, 0.0, 3)]


def test_bm25_counts_only_words_asked_for(spark):
    docs = spark.createDataFrame([(1, "a b b c d e"), (2, "b f g"), (3, "..."), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "B a b")], "item_id long, text string")
    d = retrieval.bm25(q, docs, "item_id", "doc_id", 3)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
    idf = lambda df: math.log(1 + (2 - df + 0.5) / (df + 0.5))
    weight = lambda tf, n: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 4.5))
    assert rows(d, "doc_id", "score") == [(1, pytest.approx(idf(1) * weight(1, 6) + idf(2) * weight(2, 6), abs=1e-4)), (2, pytest.approx(idf(2) * weight(1, 3), abs=1e-4))]


def test_mentions_without_lambdas(spark):
    texts_ = spark.createDataFrame([(1, "one two  three"), (2, ""), (3, None), (4, "five")], "k long, t string")
    entries = spark.createDataFrame([("two",), ("one two three",), ("five",), ("three one",), (None,)], "symptom string")
    d = G.mentioned(texts_, "k", "t", entries)
    assert "lambda" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert rows(d, "k", "symptom") == [(1, "one two three"), (1, "two"), (4, "five")]
    assert rows(G.mentioned(texts_, "k", "t", entries.where("symptom IS NULL")), "k") == []


def test_fact_turn_rewards_in_one_shuffle(spark):
    turns = spark.createDataFrame([("e", 0, "a", "ask"), ("e", 1, "a", "ask"), ("e", 2, "z", "ask"), ("e", 3, None, "ask"), ("e", 4, "b", "answer"), ("f", 0, "a", "ask")], "episode_id string, turn_id long, fact string, action string")
    turns = turns.withColumns({"answer": F.lit("A"), "answer_idx": F.lit("a")})
    facts = spark.createDataFrame([("e", "a"), ("e", "a"), ("e", "b"), ("e", None), (None, "a")], "episode_id string, fact string")
    d = W.fact_turn_rewards(turns, facts)
    assert shuffles(d) == 1
    third = pytest.approx(1 / 3)
    assert rows(d.where("episode_id = 'e'"), "turn_id", "is_unknown", "is_duplicate", "delta", "n_facts", "r_diag") == [(0, False, False, third, 3, 0.0), (1, False, True, 0.0, 3, 0.0), (2, True, False, 0.0, 3, 0.0), (3, True, False, 0.0, 3, 0.0), (4, False, False, 0.0, 3, 1.0)]
    assert rows(d.where("episode_id = 'f'"), "is_unknown", "n_facts", "r_diag") == [(True, None, -2.0)]


def test_symptoms_are_judged_once(spark, monkeypatch):
    plans, write = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df))
    edges = spark.createDataFrame([("d", "ache", 0.5), ("d", "serum", 0.2)], "disease string, symptom string, weight double")
    assert rows(G.clean(edges, 1, 2), "symptom") == [("ache",)]
    assert any("RLIKE" in p for p in plans) and not any("RLIKE" in p and "Aggregate" in p for p in plans)
