"""Weighted disease-symptom edges: cleaning, resolution, similarity joins, coverage.

Edges are a table edges(disease, symptom, weight); duplicate pairs keep the larger weight.
Similarity joins go through an equality on words or n-grams and verify afterwards.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.texts import clean_symptom, held, normalized, symptom_type, words
from colloquy.sources.cache import cut


def read_graph(spark: SparkSession, path: str, wholetext: bool = True) -> DataFrame:
    """Edges of JSON documents {disease: {symptom: weight}} or {disease: [symptom]}, one a file or (wholetext False) one a line, which many tasks can read; other values are skipped."""
    docs = spark.read.text(path, wholetext=wholetext).select(F.parse_json("value").alias("v"))
    # a value's kind and a disease's name are found once a disease, not once an edge
    rows = spark.sql("SELECT d.key AS disease, d.value AS v, substr(schema_of_variant(d.value), 1, 5) AS kind FROM {docs}, LATERAL variant_explode(v) AS d", docs=docs)
    edges = spark.sql(
        """SELECT disease, CASE WHEN kind = 'ARRAY' THEN try_variant_get(e.value, '$', 'string') ELSE e.key END AS symptom,
                  CASE WHEN kind = 'ARRAY' THEN 1.0D ELSE try_variant_get(e.value, '$', 'double') END AS weight
           FROM {rows} r, LATERAL variant_explode(r.v) AS e WHERE kind IN ('ARRAY', 'OBJEC')""",
        rows=rows.withColumn("disease", normalized(F.col("disease"))),
    )
    return merge(edges.where("symptom IS NOT NULL").select("disease", normalized(F.col("symptom")).alias("symptom"), "weight"))


def merge(*edges: DataFrame) -> DataFrame:
    """Union of edge tables, the largest weight of a pair."""
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out.groupBy("disease", "symptom").agg(F.max("weight").alias("weight"))


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("disease").orderBy(F.desc("weight"), "symptom")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Rows of a side, counted beforehand, that is broadcast.
BROADCAST_ROWS = 1 << 18


def small(df: DataFrame) -> DataFrame:
    """df written, as a side to broadcast if it is small, else to merge."""
    d = cut(df)
    return F.broadcast(d) if d.count() <= BROADCAST_ROWS else d.hint("merge")


def clean(edges: DataFrame, least: int, most: int) -> DataFrame:
    """Clean symptoms only, diseases with at least ``least`` of them, the ``most`` heaviest each. A symptom is judged once, not once an edge."""
    names = cut(edges.select("symptom").distinct())  # else the optimizer judges before it groups
    fine = small(names.where(clean_symptom(F.col("symptom"))))
    d = edges.join(fine, "symptom", "left_semi").withColumn("_n", F.count("*").over(Window.partitionBy("disease"))).where(F.col("_n") >= least)
    return top_edges(d, most).drop("_n", "rank")


def dropped(edges: DataFrame) -> DataFrame:
    """How many edges fail by type of symptom."""
    n = edges.groupBy("symptom").agg(F.count("*").alias("_n")).where(~clean_symptom(F.col("symptom")))
    return n.groupBy(symptom_type(F.col("symptom")).alias("symptom_type")).agg(F.sum("_n").alias("n"))


def pools(edges: DataFrame) -> DataFrame:
    """disease, n, pool: common has 10 to 50 symptoms, the rest from 5 on is extended."""
    n = edges.groupBy("disease").agg(F.count("*").alias("n")).where("n >= 5")
    return n.withColumn("pool", F.when(F.col("n").between(10, 50), "common").otherwise("extended"))


#: Weights are summed as integers of this many to one, so that no order of a sum changes it, or which side of a threshold it is on.
UNITS = 1_000_000_000


def units(weight: Column) -> Column:
    return F.round(weight * UNITS).cast("long")


def coverage(collected: DataFrame, cases: DataFrame, edges: DataFrame, weighted: bool = True) -> DataFrame:
    """cases(case_id, disease), collected(case_id, symptom) -> case_id, coverage: share of the disease's weight (or symptoms) that was collected, 0 if it has none."""
    value = units(F.col("weight")) if weighted else F.lit(1)
    total = edges.groupBy("disease").agg(F.sum(value).alias("total"))
    hit = collected.distinct().hint("merge").join(cases, "case_id").hint("merge").join(edges, ["disease", "symptom"]).groupBy("case_id").agg(F.sum(value).alias("hit"))
    d = cases.join(total, "disease", "left").join(hit, "case_id", "left")
    return d.select("case_id", F.coalesce(F.col("hit") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)).alias("coverage"))


def _tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    d = df.select(key, F.array_distinct(words(normalized(F.col(text)))).alias("_t"))
    return d.select(key, F.size("_t").alias("_n"), F.explode("_t").alias("_w"))


def jaccard(left: DataFrame, right: DataFrame, lkey: str, ltext: str, rkey: str, rtext: str, least: float = 0.0) -> DataFrame:
    """lkey, rkey, score > 0 and >= least of all pairs that share a word.

    For a threshold the words are ordered by how rare they are on the right, and only the first
    n - o + 1 of a text's n words are joined with texts of m words, where such a pair must share
    o = ceil(least / (1 + least) (n + m)): two texts that are similar enough share
    one of these, so a word that all texts have joins nothing. Sizes must fit the threshold too. Candidates
    get their exact score from their word sets.
    """
    a, b = _tokens(left, lkey, ltext), _tokens(right, rkey, rtext).withColumnsRenamed({"_n": "_m"})
    if least <= 0:
        both = a.hint("merge").join(b, "_w").groupBy(lkey, rkey).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"), F.first("_m").alias("_m"))
        return both.select(lkey, rkey, (F.col("_c") / (F.col("_n") + F.col("_m") - F.col("_c"))).alias("score"))
    common = b.groupBy("_w").agg(F.count("*").alias("_f"))

    def rare(d: DataFrame, key: str, n: str, m: str, other: DataFrame) -> DataFrame:
        order = Window.partitionBy(key).orderBy(F.coalesce("_f", F.lit(0)), "_w")
        d = d.hint("merge").join(common, "_w", "left").withColumn("_k", F.row_number().over(order))
        d = d.where(F.col("_k") <= F.col(n) - F.ceil(F.lit(least) * F.col(n) - 1e-9) + 1)
        sizes = F.broadcast(other.select(m).distinct())  # as many rows as there are sizes of texts
        d = d.join(sizes, (F.col(m) >= least * F.col(n)) & (F.col(n) >= least * F.col(m)))
        return d.where(F.col("_k") <= F.col(n) - F.ceil(F.lit(least / (1 + least)) * (F.col(n) + F.col(m)) - 1e-9) + 1).select(key, n, m, "_w")

    met = rare(a, lkey, "_n", "_m", b).hint("merge").join(rare(b, rkey, "_m", "_n", a), ["_w", "_n", "_m"]).select(lkey, rkey).distinct()
    sets = lambda df, key, text, out: df.select(key, F.array_distinct(words(normalized(F.col(text)))).alias(out))
    d = met.hint("merge").join(sets(left, lkey, ltext, "_a"), lkey).hint("merge").join(sets(right, rkey, rtext, "_b"), rkey)
    same = F.size(F.array_intersect("_a", "_b"))
    return d.select(lkey, rkey, (same / (F.size("_a") + F.size("_b") - same)).alias("score")).where(F.col("score") >= least)


def top_matches(pairs: DataFrame, lkey: str, rkey: str, k: int) -> DataFrame:
    w = Window.partitionBy(lkey).orderBy(F.desc("score"), rkey)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: A word is common if more rows than this, and more than one in COMMON_SHARE, have it.
COMMON_ROWS, COMMON_SHARE = 1000, 1000
LEVELS = (0.8, 0.5, 0.2)


def _by_rarity(tokens: DataFrame, key: str, n: str, often: DataFrame, common: int) -> DataFrame:
    """tokens with _k, the word's place among its text's from the rarest on, and _hot, whether it is common; written."""
    order = Window.partitionBy(key).orderBy(F.coalesce("_f", F.lit(0)), "_w")
    d = tokens.hint("merge").join(often, "_w", "left").withColumn("_k", F.row_number().over(order))
    return cut(d.select(key, n, "_w", "_k", (F.coalesce("_f", F.lit(0)) > common).alias("_hot")))


def _with_scores(pairs: DataFrame, a: DataFrame, b: DataFrame, lkey: str, rkey: str) -> DataFrame:
    """Pairs with their exact score, from the word sets a(lkey, _a) and b(rkey, _b)."""
    d = pairs.hint("merge").join(a, lkey).hint("merge").join(b, rkey)
    same = F.size(F.array_intersect("_a", "_b"))
    return d.select(lkey, rkey, (same / (F.size("_a") + F.size("_b") - same)).alias("score"))


def _distinguished(left: DataFrame, right: DataFrame, ltext: str, rkey: str, rtext: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``right`` that may be among the k best of a row of ``left``, and how many rows of all have each of the left side's words (_w, _f); both written.

    Rows that have the same of these words, and as many words in all, score alike for every row of
    ``left``: the k with the smallest rkey are enough. Rows that have none of them score 0.
    """
    asked = small(_tokens(left, ltext, ltext).select("_w").distinct())
    met = _tokens(right, rkey, rtext).join(asked, "_w", "left_semi")
    rows = cut(met.groupBy(rkey).agg(F.first("_n").alias("_n"), F.sort_array(F.collect_list("_w")).alias("_set")))
    often = cut(rows.groupBy("_set").agg(F.count("*").alias("_c")).select(F.explode("_set").alias("_w"), "_c").groupBy("_w").agg(F.sum("_c").alias("_f")))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_set", "_n").orderBy(rkey))).where(F.col("_r") <= k)
    return cut(right.hint("merge").join(first.select(rkey), rkey, "left_semi")), often


def closest(left: DataFrame, right: DataFrame, lkey: str, ltext: str, rkey: str, rtext: str, k: int, levels: tuple[float, ...] | None = None, common_rows: int = COMMON_ROWS) -> DataFrame:
    """lkey, rkey, score, rank, level: the k rows of ``right`` with the largest Jaccard similarity above 0 for each of ``left``, ties to the smaller rkey; no threshold.

    Thresholds descend. At a level, open queries meet the right side on the words that a pair
    of that similarity must share (the rarest n - ceil(level n) + 1 of n words), so every pair that
    similar is known, and a query that holds k of them is finished with that level. Common words (see
    COMMON_SHARE) are not joined: pairs that share nothing else reach (common words of the query) / n
    at most, so a query is finished only at a level above that. Queries that no level finishes have level
    0: they meet all rows with a word of theirs that is not common; and rows that share only common
    words with them score alike if they have the same common words and the same size, so of such a
    family k rows are enough. No word that a share of all rows has is joined to rows, for any query. Without
    ``levels``, LEVELS are gone through if a query has a common word; if none has, a word of a query meets few rows anyway,
    and all are met at once. Both sides are read once, and only what :func:`_distinguished` leaves of the right one is met.
    """
    left, right = cut(left.select(*{lkey: 0, ltext: 0})), cut(right.select(*{rkey: 0, rtext: 0}))
    common = max(common_rows, right.count() // COMMON_SHARE)
    right, often = _distinguished(left, right, ltext, rkey, rtext, k)
    a, b = _tokens(left, lkey, ltext), _tokens(right, rkey, rtext).withColumnsRenamed({"_n": "_m"})
    if levels is None:
        if often.where(F.col("_f") > common).isEmpty():
            return top_matches(jaccard(left, right, lkey, ltext, rkey, rtext), lkey, rkey, k).withColumn("level", F.lit(0.0))
        levels = LEVELS
    a, b = _by_rarity(a, lkey, "_n", often, common), _by_rarity(b, rkey, "_m", often, common)
    sets = lambda d, key, out, *more: cut(d.groupBy(key).agg(F.collect_list("_w").alias(out), F.max("_hot").alias("_any"), *more))
    a_sets, b_sets = sets(a, lkey, "_a", F.sum(F.col("_hot").cast("int")).alias("_h")), sets(b, rkey, "_b", F.sort_array(F.collect_list(F.when(F.col("_hot"), F.col("_w")))).alias("_set"))
    open_, out = a_sets.select(lkey, F.size("_a").alias("_n"), "_h"), []
    prefix = lambda d, n, t: d.where(~F.col("_hot") & (F.col("_k") <= F.col(n) - F.ceil(F.lit(t) * F.col(n) - 1e-9) + 1))
    for t in levels:
        met = prefix(a, "_n", t).join(open_.select(lkey), lkey, "left_semi").hint("merge").join(prefix(b, "_m", t), "_w")
        met = met.where((F.col("_m") >= t * F.col("_n")) & (F.col("_n") >= t * F.col("_m"))).select(lkey, rkey).distinct()
        best = top_matches(_with_scores(met, a_sets, b_sets, lkey, rkey).where(F.col("score") >= t), lkey, rkey, k)
        done = open_.where(F.col("_h") < t * F.col("_n")).select(lkey)
        best = cut(best.join(done, lkey, "left_semi").withColumn("_c", F.max("rank").over(Window.partitionBy(lkey))).where(F.col("_c") >= k).drop("_c"))
        out.append(best.withColumn("level", F.lit(float(t))))
        open_ = cut(open_.join(best.select(lkey).distinct(), lkey, "left_anti"))
    left_over = a.join(open_.select(lkey), lkey, "left_semi")
    met = left_over.where(~F.col("_hot")).hint("merge").join(b.where(~F.col("_hot")), "_w").select(lkey, rkey)
    family = Window.partitionBy("_set", F.size("_b")).orderBy(rkey)
    few = cut(b_sets.where("_any").withColumn("_r", F.row_number().over(family)).where(F.col("_r") <= k).select(rkey, "_set"))
    met = met.unionByName(left_over.where("_hot").hint("merge").join(few.select(rkey, F.explode("_set").alias("_w")), "_w").select(lkey, rkey)).distinct()
    last = top_matches(_with_scores(met, a_sets, b_sets, lkey, rkey), lkey, rkey, k)
    return reduce(DataFrame.unionByName, [*out, last.withColumn("level", F.lit(0.0))])


def resolve(queries: DataFrame, diseases: DataFrame, least: float = 0.2) -> DataFrame:
    """queries(query), diseases(disease) -> query, disease: equal after normalising, else the best Jaccard match, else null."""
    diseases = cut(diseases.select("disease"))
    names = diseases.groupBy(normalized(F.col("disease")).alias("_d")).agg(F.min("disease").alias("disease"))
    q = cut(queries.select("query", normalized(F.col("query")).alias("_q")).hint("merge").join(names, F.col("_q") == F.col("_d"), "left").select("query", "disease"))
    rest = q.where("disease IS NULL").select("query")
    close = closest(rest.where("query IS NOT NULL").distinct(), diseases, "query", "query", "disease", "disease", 1).where(F.col("score") >= least)
    return q.where("disease IS NOT NULL").unionByName(rest.hint("merge").join(close.select("query", "disease"), "query", "left"))


def mentioned(texts: DataFrame, key: str, text: str, symptoms: DataFrame) -> DataFrame:
    """key, symptom: dictionary entries that occur in the text as 1 to 4 words in a row; an equality join on n-grams of the sizes that the dictionary has.

    A small dictionary goes to the texts, so that only n-grams that are entries are shuffled.
    """
    entries = cut(symptoms.select("symptom").where("symptom IS NOT NULL").distinct())
    side = F.broadcast(entries) if entries.count() <= BROADCAST_ROWS else entries.hint("merge")
    sizes = sorted(r["n"] for r in entries.select(F.size(F.split("symptom", " ")).alias("n")).where("n BETWEEN 1 AND 4").distinct().collect())
    d = held(texts.select(key, text), _w1=words(normalized(F.col(text))))
    # each word beside those after it, by arrays side by side: lambdas would be slower
    at = [f"_w{n}" for n in range(1, max(sizes, default=1) + 1)]
    d = d.select(key, F.inline(F.arrays_zip(*(F.slice("_w1", n, F.size("_w1")).alias(c) if n > 1 else F.col(c) for n, c in enumerate(at, 1)))).alias(*at))
    grams = d.select(key, F.explode(F.array(*(reduce(lambda a, c: F.concat(a, F.lit(" "), F.col(c)), at[1:n], F.col(at[0])) for n in sizes)).cast("array<string>")).alias("symptom"))
    return grams.join(side, "symptom", "left_semi").select(key, "symptom").distinct()


def _grams(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, g: distinct runs of 1 to 3 characters."""
    s = F.col(text)
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))
    some = [F.when(F.length(s) >= n, of(n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]
    return df.select(key, F.explode(F.array_distinct(F.concat(*some))).alias("g"))


def containing(whole: DataFrame, part: DataFrame, wkey: str, pkey: str) -> DataFrame:
    """wkey, pkey of all pairs of whole(wkey) and part(pkey), both distinct texts, where the first holds the second.

    A text that holds another holds each of its runs of three characters (or all of it, if it
    is shorter): they meet on the part's rarest one, and ``contains`` decides.
    """
    grams = _grams(whole, wkey, wkey)
    often = grams.groupBy("g").agg(F.count("*").alias("_f"))
    runs = _grams(part.where(F.length(pkey) > 0), pkey, pkey).where(F.length("g") == F.least(F.length(pkey), F.lit(3)))
    key = runs.hint("merge").join(often, "g", "left").groupBy(pkey).agg(F.min_by("g", F.struct(F.coalesce("_f", F.lit(0)), F.col("g"))).alias("g"))
    return grams.hint("merge").join(key, "g").where(F.col(wkey).contains(F.col(pkey))).select(wkey, pkey)


def diseases_of(queries: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """queries(query) -> query, disease, score, rank: the best edge of a disease, weight times 1 for a substring either way, else times Jaccard from .5 on.

    Equal texts and n-grams are substrings.
    """
    symptoms = edges.select("symptom").distinct()
    q = queries.select("query", normalized(F.col("query")).alias("_q"))
    texts = q.select("_q").distinct()
    inside = containing(texts, symptoms, "_q", "symptom").unionByName(containing(symptoms, texts, "symptom", "_q")).distinct()
    inside = inside.hint("merge").join(q, "_q").select("query", "symptom", F.lit(1.0).alias("factor"))
    close = jaccard(queries, symptoms, "query", "query", "symptom", "symptom", 0.5).withColumnRenamed("score", "factor")
    factor = inside.unionByName(close).groupBy("query", "symptom").agg(F.max("factor").alias("factor"))
    best = factor.hint("merge").join(edges, "symptom").groupBy("query", "disease").agg(F.max(F.col("weight") * F.col("factor")).alias("score")).where("score > 0")
    return top_matches(best, "query", "disease", k)


def augment(edges: DataFrame, extra: DataFrame, aliases: DataFrame) -> DataFrame:
    """extra(name, symptom, weight) attached to diseases by name or alias(alias, disease), merged by largest weight."""
    known = edges.select("disease").distinct()
    names = known.select(F.col("disease").alias("name"), "disease").unionByName(aliases.select(F.col("alias").alias("name"), "disease")).distinct()
    # a name's copies of a symptom would each meet all diseases of the name
    once = extra.groupBy("name", "symptom").agg(F.max("weight").alias("weight"))
    more = once.hint("merge").join(names, "name").hint("merge").join(known, "disease", "left_semi")
    return merge(edges.select("disease", "symptom", "weight"), more.select("disease", "symptom", "weight"))


def hit_flag(rows: DataFrame, keys: DataFrame, on: str, flag: str) -> DataFrame:
    """rows with a boolean: whether ``on`` occurs in keys."""
    d = rows.join(keys.select(on).distinct().withColumn("_in", F.lit(True)), on, "left")
    return d.withColumn(flag, F.coalesce(F.col("_in"), F.lit(False))).drop("_in")


def share(c: Column) -> Column:
    return F.avg(c.cast("double"))
