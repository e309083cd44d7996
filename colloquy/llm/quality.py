"""Quality rules as a bitmask ledger, with SQL functions alone.

Every rule is evaluated once a document. The ledger keeps the measurements, one bit a
failed rule and the version of the rules; a policy is a mask over those bits, so a new
policy or an ablation reads the stored ledger and no text. A null text has no words; a
null doc_id stays null; repeated rows give repeated ledger rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import materialize

GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: name -> failure as a Column over the measurements; the bit is the place in this list.
RULES: list[tuple[str, Column | str]] = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("short_words", "n_words > 0 AND word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("repeated_lines", "n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("shouting", "n_words > 0 AND 2 * n_capitals > word_chars"),
]
#: Changes with RULES, so that ledgers of other rules are not mixed up.
RULE_SET = "2"
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: version -> the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "short_words", "long_words"),
    "v2": tuple(BIT),
}


def mask(version: str) -> int:
    return sum(BIT[r] for r in POLICIES[version])


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals (all long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, GAP), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    length = F.length(text)
    df = docs.withColumns({"_w": words, "_l": lines})
    df = df.withColumn("_n", F.size("_w"))
    # a hash of each window of five words; windows can repeat from six words on
    grams = F.transform(F.slice("_w", F.lit(1), F.col("_n") - (WINDOW - 1)), lambda w, i: F.xxhash64(w, *(F.get(F.col("_w"), i + k) for k in range(1, WINDOW))))
    df = df.withColumn("_h", F.when(F.col("_n") > WINDOW, grams))
    # only texts in which a window repeats are sorted
    twice = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(twice, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = F.zip_with(
        F.slice("_s", F.lit(1), F.size("_s") - 1),
        F.slice("_s", F.lit(2), F.size("_s") - 1),
        # equal hashes propose, the words themselves decide
        lambda a, b: F.when((a["h"] == b["h"]) & (F.slice("_w", a["i"] + 1, F.lit(WINDOW)) == F.slice("_w", b["i"] + 1, F.lit(WINDOW))), F.array(a["i"], b["i"])),
    )
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))))
    steps = F.zip_with(F.slice("_p", F.lit(1), F.size("_p") - 1), F.slice("_p", F.lit(2), F.size("_p") - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
    repeats = F.when(F.col("_p").isNotNull(), F.aggregate(steps, F.lit(WINDOW), lambda a, x: a + x)).otherwise(F.lit(0))
    # One row is made of the measurements by a generator: a filter above it stays above, where
    # the optimizer would else move all of this into the filter and evaluate arrays once an element.
    row = F.struct(
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        repeats.cast("long").alias("n_repeat_words"),
        (length - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_capitals"),
    )
    return df.select(*docs.columns, F.inline(F.array(row)))


def _judged(docs: DataFrame) -> DataFrame:
    """``measured`` with fail_bits (int), one bit for each failed rule, and rule_set."""
    bits = sum((F.when(F.expr(rule) if isinstance(rule, str) else rule, F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES[1:]), F.when(F.expr(RULES[0][1]), F.lit(1)).otherwise(F.lit(0)))
    return measured(docs).withColumns({"fail_bits": bits, "rule_set": F.lit(RULE_SET)})


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, measurements, fail_bits, rule_set of docs(doc_id, text, ...)."""
    return _judged(docs.select("doc_id", "text")).drop("text")


def stored(docs: DataFrame) -> DataFrame:
    """The ledger, written once."""
    return materialize(ledger(docs))


def apply_policy(led: DataFrame, version: str = "v2") -> DataFrame:
    """kept (boolean), no rule of the policy failed, and the policy's name."""
    return led.withColumns({"kept": F.col("fail_bits").bitwiseAND(F.lit(mask(version))) == 0, "policy": F.lit(version)})


def kept(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The rows of docs that the policy keeps, with the columns of docs alone."""
    return apply_policy(_judged(docs.select(F.struct("*").alias("_doc"), "text")), version).where("kept").select("_doc.*")


def ablation(led: DataFrame, version: str = "v2") -> DataFrame:
    """For each rule of the policy: documents it rejects, rejects alone, and what the policy keeps without it.

    The ledger is first counted by its bits, at most 2**len(RULES) rows, so the policy's
    variants are read off a handful of rows.
    """
    m = mask(version)
    by_bits = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).alias("bit")) for r in POLICIES[version]))
    each = by_bits.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    has, rest = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.lit(m).bitwiseXOR(F.col("bit")))
    return each.groupBy("rule").agg(
        F.sum(F.when(has, F.col("n")).otherwise(0)).alias("rejected"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
        F.sum(F.when(rest == 0, F.col("n")).otherwise(0)).alias("kept_without"),
    )
