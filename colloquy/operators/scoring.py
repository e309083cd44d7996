"""Scores of answers against labels, as Columns."""

from __future__ import annotations

import signal
import threading
import types
import uuid
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The end of a text in which an answer is looked for, a fixed value like the patterns of answers below.
CLIP = 300


def last_match(x: Column, pattern: str, group: int = 1) -> Column:
    """The last match, or null."""
    return F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(group)), F.lit(-1))


def strict_number(x: Column) -> Column:
    """The last number after four hashes in the end of the text, without commas."""
    return F.regexp_replace(last_match(F.right(x, F.lit(CLIP)), r"#### (-?[0-9.,]+)"), r"[,$]", "")


def flexible_number(x: Column) -> Column:
    """The last number in the end of the text that is not a lone point."""
    found = F.filter(F.regexp_extract_all(F.right(x, F.lit(CLIP)), F.lit(r"(-?[0-9.,]+)"), F.lit(1)), lambda v: ~v.isin("", "."))
    return F.try_element_at(found, F.lit(-1))


def qa_normal(x: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.regexp_replace(F.lower(x), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def exact_match(x: Column, truth: Column) -> Column:
    """1 if the last <answer> equals the label after normalising."""
    got = last_match(x, r"(?s)<answer>(.*?)</answer>")
    return F.when(got.isNotNull() & (qa_normal(got) == qa_normal(truth)), 1.0).otherwise(0.0)


def final_answer(x: Column) -> Column:
    return F.trim(last_match(F.right(x, F.lit(CLIP)), r"(?i)Answer\s*:\s*([^\n]+)"))


def boxed(x: Column) -> Column:
    """The content of the last \\boxed{...}, braces balanced, or null: one pass over the characters after it."""
    n = F.size(F.split(x, r"\\boxed\{", -1))
    tail = F.when(n > 1, F.element_at(F.split(x, r"\\boxed\{", -1), -1))
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("len"))

    def step(a: Column, c: Column) -> Column:
        depth = F.when(a["depth"] == 0, 0).when(c == "{", a["depth"] + 1).when(c == "}", a["depth"] - 1).otherwise(a["depth"])
        return F.struct(depth.alias("depth"), F.when(depth > 0, a["len"] + 1).otherwise(a["len"]).alias("len"))

    got = F.aggregate(F.split(tail, ""), start, step)
    return F.when(got["depth"] == 0, F.substring(tail, F.lit(1), got["len"]))


# What the clean-up of answers replaces and removes.
MATH_LAYOUT = ("\n", "\\!")
MATH_DROPS = ("\\left", "\\right", "^{\\circ}", "^\\circ", "\\$")
ANSWER_SWAPS = (("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"))
ANSWER_DROPS = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet",
    "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students", "childrentickets",
    "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}",
    "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)
BOXED_SOURCES = ("lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500")
GEOMETRY_SOURCES = ("hiyouga/geometry3k",)
#: More answer tags than this and a right answer counts a quarter.
TAGS = 10


def _swap(x: Column, old: str, new: str = "") -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def math_normal(x: Column) -> Column:
    """A mathematical answer as text: no layout, degrees, dollars, percent or units; fractions and roots with braces; a short name before = dropped."""
    for old in MATH_LAYOUT:
        x = _swap(x, old)
    x = _swap(_swap(_swap(x, "\\\\", "\\"), "tfrac", "frac"), "dfrac", "frac")
    for old in MATH_DROPS:
        x = _swap(x, old)
    x = F.split_part(x, F.lit("\\text{ "), F.lit(1))
    x = _swap(_swap(_swap(x, "\\%"), " .", " 0."), "{.", "{0.")
    x = F.when(x.startswith("."), F.concat(F.lit("0"), x)).otherwise(x)
    x = F.regexp_replace(x, r"\A[^=]{0,2}=([^=]*)\z", "$1")
    x = _swap(F.regexp_replace(x, r"\\sqrt([^{])", r"\\sqrt{$1}"), " ")
    x = F.regexp_replace(F.regexp_replace(x, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"), r"\\frac([^{])\{", r"\\frac{$1}{")
    x = F.when(x == "0.5", F.lit("\\frac{1}{2}")).otherwise(x)
    return F.regexp_replace(x, r"\A(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)\z", r"\\frac{$1}{$2}")


def answer_normal(x: Column) -> Column:
    """A final answer as text: what follows the last =, without filler words, units, dollars and text commands; commas out of whole numbers."""
    x = F.element_at(F.split(x, "="), -1)
    for old, new in ANSWER_SWAPS:
        x = _swap(x, old, new)
    for old in ANSWER_DROPS:
        x = _swap(x, old)
    x = F.regexp_replace(x, r"([^\n]*?)\$([^\n]*?)\$([^\n]*)", r"\$$2\$")
    for name in ("text", "textbf", "overline"):
        x = F.regexp_replace(x, r"\\" + name + r"\{(.*?)\}", "$1")
    x = F.regexp_replace(x, r"\\boxed\{(.*)\}", "$1")
    x = F.regexp_replace(F.regexp_replace(x, r"frac([^{])(.)", r"frac{$1}{$2}"), r"sqrt([^{])", r"sqrt{$1}")
    x = _swap(x, "$")
    return F.trim(F.when(_swap(x, ",").rlike(r"\A[0-9]+\z"), _swap(x, ",")).otherwise(x))


def boxed_match(x: Column, truth: Column) -> Column:
    """1 if the last boxed answer and the label are the same after clean-up."""
    return F.when(F.coalesce(math_normal(boxed(x)) == math_normal(truth), F.lit(False)), 1.0).otherwise(0.0)


def geometry_score(x: Column, truth: Column, share: float = 0.1) -> Column:
    """Mostly whether the boxed answer is right, the rest for thoughts followed by a boxed answer."""
    form = F.when(x.rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z"), 1.0).otherwise(0.0)
    return (1 - share) * boxed_match(x, truth) + share * form


def search_score(x: Column, truth: Column) -> Column:
    """:func:`exact_match`, a quarter of it where the text has too many answer tags."""
    many = (F.regexp_count(x, F.lit("<answer>")) > TAGS) | (F.regexp_count(x, F.lit("</answer>")) > TAGS)
    return exact_match(x, truth) * F.when(many, 0.25).otherwise(1.0)


def score_by_source(source: str = "data_source", solution: str = "solution", truth: str = "ground_truth") -> Column:
    """The scorer of each source; a source without one is an error."""
    s, x, t = F.col(source), F.col(solution), F.col(truth)
    number = F.when(strict_number(x) == t, 1.0).otherwise(0.0)
    signed = F.when(answer_normal(final_answer(x)) == answer_normal(t), 1.0).otherwise(-1.0)
    return (
        F.when(s == "openai/gsm8k", number)
        .when(s.isin(*BOXED_SOURCES), boxed_match(x, t))
        .when(s.isin(*GEOMETRY_SOURCES), geometry_score(x, t))
        .when(s.startswith("searchR1_"), search_score(x, t))
        .when((s == "math_dapo") | s.startswith("aime"), signed)
        .otherwise(F.raise_error(F.concat(F.lit("no scorer for source "), s)).cast("double"))
    )


def tags_and_tools(x: Column, accuracy: Column) -> Column:
    """struct<answer, format_error, tool_reward, format_reward> of a traced solution.

    Thought and answer tags (those after the thoughts) must balance, there must be an answer, and it
    must be under 1000 characters. Without answer tags the answer is what follows the last tool
    response, else what is left after the thoughts without tool blocks and speakers, else
    all. Tools pay only where the accuracy is over a half.
    """
    n = lambda t, tag: F.regexp_count(t, F.lit(tag))
    rest = F.trim(F.when(x.contains("</think>"), F.element_at(F.split(x, "</think>"), -1)).otherwise(x))
    tagged = rest.rlike(r"(?s)<answer>.*?</answer>")
    after_tool = F.regexp_extract(rest, r"(?s)</tool_response>\s*assistant\s*\n(.*?)(?:\n|\z)", 1)
    bare = F.regexp_replace(F.regexp_replace(rest, r"(?s)<tool_call>.*?</tool_call>|<tool_response>.*?</tool_response>", ""), r"\b(user|assistant)\b", "")
    found = F.when(tagged, F.regexp_extract(rest, r"(?s)<answer>(.*?)</answer>", 1)).when(rest.rlike(r"</tool_response>\s*assistant\s*\n"), after_tool).when(x.contains("</think>"), bare).otherwise(x)
    found = F.regexp_replace(found, r"\A\s+|\s+\z", "")
    answer = F.when(found == "", F.trim(x)).otherwise(found)
    bad = (n(x, "<think>") != n(x, "</think>")) | (n(rest, "<answer>") != n(rest, "</answer>")) | ~tagged | (found == "") | (F.length(answer) >= 1000)
    used = x.rlike(r"(?s)<tool_call>.*?</tool_call>|<tool_response>.*?</tool_response>")
    right = F.when(F.length(answer) >= 1000, 0.0).otherwise(accuracy)
    return F.struct(answer.alias("answer"), bad.alias("format_error"), F.when(used & (right > 0.5), 1.0).otherwise(0.0).alias("tool_reward"), F.when(bad, -1.0).otherwise(0.0).alias("format_reward"))


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    """0 up to most - buffer, then down to -factor at most."""
    return F.least(-(length - (most - buffer)) / buffer * factor, F.lit(0.0))


def tool_shaped(score: Column, turns: Column) -> Column:
    """A wrong answer that used tools loses less, never below -0.6."""
    return F.when(score < 0, F.least(F.lit(-0.6), score + (turns - 2) / 2 * 0.1)).otherwise(score)


class OutOfTime(Exception):
    """A user's scorer took longer than its limit."""


def _within(seconds: float, run: Callable[[], Any]) -> Any:
    """run(), or OutOfTime: by a timer signal, which Python gives to a process's main thread, where Spark's workers run functions."""
    if seconds <= 0 or threading.current_thread() is not threading.main_thread():
        return run()

    def stop(*_: Any) -> None:
        raise OutOfTime

    old = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return run()
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, old)


def user_scorer(score: Callable[..., Any], default: float = 0.0, limit: float = 300.0) -> Callable[..., Column]:
    """A Column function from a user's batch scorer: score(solutions, truths, **kwargs) -> scores, over pandas Series in Arrow batches.

    A batch that fails, or takes longer than ``limit`` seconds, is scored row by row, each with that
    limit; rows that fail alone, or give no number, get the default.
    """
    def make(solution: Column, truth: Column, **kwargs: Any) -> Column:
        @F.pandas_udf("double")
        def run(x: pd.Series, t: pd.Series) -> pd.Series:
            try:
                out = list(_within(limit, lambda: score(x, t, **kwargs)))
            except Exception:  # one bad row must not lose its batch
                out = []
                for a, b in zip(x, t, strict=True):
                    try:
                        out += list(_within(limit, lambda a=a, b=b: score(pd.Series([a]), pd.Series([b]), **kwargs)))
                    except Exception:
                        out.append(None)
            return pd.to_numeric(pd.Series(out, dtype="object"), errors="coerce").astype("float64")

        return F.coalesce(F.nanvl(run(solution, truth), F.lit(None).cast("double")), F.lit(default))

    return make


def row_scorer(score: Callable[..., Any], default: float = 0.0, limit: float = 300.0) -> Callable[..., Column]:
    """:func:`user_scorer` for score(solution, truth, **kwargs) -> number, a row at a time."""

    def batch(x: pd.Series, t: pd.Series, **kwargs: Any) -> list[Any]:
        out = []
        for a, b in zip(x, t, strict=True):
            try:
                out.append(_within(limit, lambda a=a, b=b: score(a, b, **kwargs)))
            except Exception:
                out.append(None)
        return out

    return user_scorer(batch, default, 0.0)


def from_file(path: str, name: str) -> Any:
    """A function or class that a Python file defines. The file is read here only: its module is never imported by name, so Spark sends what it defines to the tasks by value."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    module = types.ModuleType(f"user_file_{uuid.uuid4().hex}")
    exec(compile(source, path, "exec"), module.__dict__)  # noqa: S102
    if not hasattr(module, name):
        raise ValueError(f"{path} defines no {name!r}")
    return getattr(module, name)


Manager = Callable[..., DataFrame]
_MANAGERS: dict[str, Manager] = {}


def register_manager(name: str) -> Callable[[Manager], Manager]:
    """Reward managers by name; a name taken by another function is an error."""

    def put(f: Manager) -> Manager:
        if _MANAGERS.setdefault(name, f) is not f:
            raise ValueError(f"manager {name!r} is registered already")
        return f

    return put


def manager(name: str) -> Manager:
    if name not in _MANAGERS:
        raise ValueError(f"unknown manager {name!r}; known: {sorted(_MANAGERS)}")
    return _MANAGERS[name]


@register_manager("naive")
def naive_manager(rows: DataFrame, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """rows(data_source, solution, ground_truth) with score, by source or by a Column function of solution and label."""
    return rows.withColumn("score", score_by_source() if scorer is None else scorer(F.col("solution"), F.col("ground_truth")))


@register_manager("batch")
def batch_manager(rows: DataFrame, scorer: Callable[..., Any], **kwargs: Any) -> DataFrame:
    """Scores by a user's batch scorer, an Arrow batch at a time."""
    return rows.withColumn("score", user_scorer(scorer)(F.col("solution"), F.col("ground_truth"), **kwargs))


@register_manager("dapo")
def dapo_manager(rows: DataFrame, most: int, buffer: int, factor: float = 1.0, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """:func:`naive_manager` with the penalty for over-long responses (resp_len) in score; acc keeps the score without it."""
    d = naive_manager(rows, scorer).withColumnRenamed("score", "acc")
    return d.withColumn("score", F.col("acc") + overlong_penalty(F.col("resp_len"), most, buffer, factor))


@register_manager("prime")
def prime_manager(rows: DataFrame, scorer: Callable[..., Any], limit: float = 300.0, **kwargs: Any) -> DataFrame:
    """Scores by a user's row scorer side by side in tasks; a row that fails or takes longer than ``limit`` seconds scores 0."""
    return rows.withColumn("score", row_scorer(scorer, 0.0, limit)(F.col("solution"), F.col("ground_truth"), **kwargs))


def rows_by(df: DataFrame, generator: type, schema: str, *columns: str) -> DataFrame:
    """df's rows beside the rows that a user's generator class gives for ``columns``: eval(*values) yields tuples of ``schema``."""
    return df.lateralJoin(F.udtf(generator, returnType=schema)(*(F.col(c).outer() for c in columns)))
