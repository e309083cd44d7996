"""URL verdicts: host and path rules, else the log-likelihood ratio of two character models.

Both models are variable-order Markov models over the characters of host and path: an order-k
estimate is smoothed by the order below it, p_k = (n(ctx, c) + BETA * p_{k-1}) / (n(ctx) + BETA).
They learn from every URL that a rule judges, with exact counts in Spark tables that grow
with the input. A window is a character with the ORDER before it. Counts of an order are
sums over the windows that end alike, and estimates go up order by order: a join on the
suffix, which as many grams share as the alphabet has characters. A URL's score is the mean
of its windows' log ratios, summed as integers, so that no order of rows changes it.

A fifth of the judged URLs (by a hash of host and path) stays out of the counts that calibrate
the cut: it is where balanced accuracy is best on that fifth.

Null urls and urls without ``://`` have an empty host and path; they fit no rule and
score 0. Repeated rows give repeated results; extra columns are ignored. Repeated urls
count as often as they occur.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import ascii_lower, discard, materialize

#: rule -> verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
ORDER, BETA, FOLDS, BINS, SPAN = 5, 2.0, 5, 4096, 8.0
#: Symbols before a text and at its end, the chance of a symbol below order 0, and the unit of summed log ratios.
START, STOP, FLOOR, UNIT = "\x01", "\x03", 1 / 256, float(1 << 32)
#: Keys that hold more than this share of all rows are joined by broadcast; there are at most 1 / HOT of them.
HOT = 1e-4
_COUNTS = ("a", "r", "pa", "pr")  # accepted, rejected; the same without the held-out fold


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(ascii_lower(raw), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule in sorted(RULES, key=lambda r: (len(r), r)):
        h, _, p = rule.partition("/")
        out = F.when(((host == h) | host.endswith("." + h)) & path.startswith("/" + p), F.lit(rule)).otherwise(out)
    return out


def judged(pages: DataFrame) -> DataFrame:
    """pages(page_id, url) with host, path, rule, by_rule (allow, block or null)."""
    host, path = host_path(F.col("url"))
    df = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    df = df.withColumn("rule", rule_of(F.col("host"), F.col("path")))
    verdict = F.element_at(F.create_map(*(F.lit(x) for kv in RULES.items() for x in kv)), F.col("rule"))
    return df.withColumn("by_rule", F.when(F.col("rule").isNotNull(), verdict))


def windows(texts: DataFrame, *keep: str) -> DataFrame:
    """keep, w: each symbol of texts(s) with the ORDER before it, the end symbol included."""
    chars = F.array_remove(F.split(F.concat(F.lit(START * ORDER), "s", F.lit(STOP)), ""), "")
    d = texts.withColumn("_c", chars)  # referred to often, so that it is not evaluated anew for each symbol
    at = F.sequence(F.lit(0), F.size("_c") - (ORDER + 1))
    w = F.transform(at, lambda i: F.concat(*(F.get(F.col("_c"), i + k) for k in range(ORDER + 1))))
    return d.select(*keep, F.explode(w).alias("w"))


def learned(texts: DataFrame) -> DataFrame:
    """texts(s, n, accepted, held) -> w, c, ratio, trial: each window, how often it occurs in texts, and its log ratio under all counts and without the held-out fold.

    ``accepted`` is null where nothing is known; such texts give windows but no counts.
    """
    n, yes, no, part = F.col("n"), F.col("accepted"), ~F.col("accepted"), ~F.col("held")
    counts = {"a": yes, "r": no, "pa": yes & part, "pr": no & part}
    grams = windows(texts, "n", "accepted", "held").groupBy(F.col("w").alias("g"))
    level = materialize(grams.agg(F.count("*").alias("c"), *(F.sum(F.when(v, n).otherwise(0)).alias(k) for k, v in counts.items())))
    levels = [level]
    for k in range(ORDER - 1, -1, -1):
        levels.append(materialize(levels[-1].groupBy(F.right("g", F.lit(k + 1)).alias("g")).agg(*(F.sum(c).alias(c) for c in _COUNTS))))
    below = None
    for k, level in enumerate(reversed(levels)):
        of = Window.partitionBy(F.substring("g", 1, k))  # the context; with no more grams than symbols
        d = level.withColumns({f"all_{c}": F.sum(c).over(of) for c in _COUNTS})
        if below is None:
            d = d.withColumns({f"low_{c}": F.lit(FLOOR) for c in _COUNTS})
        else:
            d = d.withColumn("suffix", F.right("g", F.lit(k))).hint("merge").join(below, "suffix")
        d = d.withColumns({f"est_{c}": (F.col(c) + BETA * F.col(f"low_{c}")) / (F.col(f"all_{c}") + BETA) for c in _COUNTS})
        if k < ORDER:
            below = d.select(F.col("g").alias("suffix"), *(F.col(f"est_{c}").alias(f"low_{c}") for c in _COUNTS))
    unit = lambda a, r: F.round((F.ln(a) - F.ln(r)) * UNIT).cast("long")
    out = materialize(d.select(F.col("g").alias("w"), "c", unit(F.col("est_a"), F.col("est_r")).alias("ratio"), unit(F.col("est_pa"), F.col("est_pr")).alias("trial")))
    discard(*levels)
    return out


def lookup(rows: DataFrame, values: DataFrame, key: str, n: str) -> DataFrame:
    """The inner join of rows with values on ``key``, of which values has each once and with ``n``, its number of rows. The few that hold a share of HOT or more are broadcast, the rest is shuffled."""
    total = values.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > total * HOT
    often = F.broadcast(values.where(hot).drop(n))
    rest = rows.join(often.select(key), key, "left_anti").hint("merge").join(values.where(~hot).drop(n), key)
    return rows.join(often, key).unionByName(rest)


def scored(texts: DataFrame) -> DataFrame:
    """texts(id, s, n, accepted, held) -> id, score, trial: the means over a text's symbols of log p(accepted) - log p(rejected); trial without the held-out fold. 0 for an empty text."""
    model = learned(texts)
    d = lookup(windows(texts.where("s <> ''"), "id"), model, "w", "c").groupBy("id")
    mean = lambda c: F.sum(c) / F.count("*") / UNIT
    found = d.agg(mean("ratio").alias("score"), mean("trial").alias("trial"))
    zero = F.lit(0.0)
    out = materialize(texts.select("id").hint("merge").join(found, "id", "left").select("id", F.coalesce("score", zero).alias("score"), F.coalesce("trial", zero).alias("trial")))
    discard(model)
    return out


def cut(held: DataFrame) -> float:
    """The score at or above which balanced accuracy over ``held(score, accepted, n)`` is best; BINS rows come to the driver."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + SPAN) * (BINS / (2 * SPAN)))))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    got = held.groupBy(bin_.cast("int").alias("bin")).agg(count(F.col("accepted")).alias("a"), count(~F.col("accepted")).alias("r")).toPandas()
    a, r = np.zeros(BINS + 1), np.zeros(BINS + 1)
    a[got["bin"]], r[got["bin"]] = got["a"], got["r"]
    if not a.sum() or not r.sum():
        return 0.0
    gain = a[::-1].cumsum()[::-1] / a.sum() - r[::-1].cumsum()[::-1] / r.sum()
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 * (2 * SPAN / BINS) - SPAN)


def filtered(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, score."""
    df = judged(pages).withColumn("s", F.concat("host", "path"))
    distinct = df.groupBy("s").agg(F.count("*").alias("n"), F.any_value(F.col("by_rule") == "allow").alias("accepted"))  # host and path decide the rule
    held = F.pmod(F.xxhash64("s"), F.lit(FOLDS)) == 0
    texts = materialize(distinct.select(F.monotonically_increasing_id().alias("id"), F.unhex(F.md5("s")).alias("key"), "s", "n", "accepted", held.alias("held")))
    scores = scored(texts.drop("key"))
    known = materialize(texts.hint("merge").join(scores, "id").select("key", "n", "accepted", "held", "score", "trial"))
    threshold = cut(known.where("held AND accepted IS NOT NULL").select(F.col("trial").alias("score"), "accepted", "n"))
    discard(scores)
    out = lookup(df.withColumn("key", F.unhex(F.md5("s"))), known.select("key", "n", "score"), "key", "n")
    verdict = F.coalesce(F.col("by_rule"), F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
