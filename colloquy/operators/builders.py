"""Canonical training rows from the shapes that sources come in: each source is a set of field rules, applied by one projection."""

from __future__ import annotations

import base64
import io
import json
import pickle
import zlib
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.numeric import hash_key
from colloquy.operators.datasets import ranked

# What models were asked, as benchmarks publish it.
CHOICE_PROMPT = (
    "Answer the following multiple choice question. The last line of your response should be of the following "
    "format: 'Answer: $LETTER' (without quotes) where LETTER is one of ABCD. Think step by step before "
    "answering.\n\n"
)
CODE_PROMPT = (
    "You will be given a question (problem specification) and will generate a correct Python program "
    "that matches the specification and passes all tests.\n\nQuestion: "
)
CODE_STARTER = (
    "You will use the following starter code to write the solution to the problem and enclose your "
    "code within delimiters.\n```python\n"
)
CODE_STDIN = (
    "Read the inputs from stdin solve the problem and write the answer to stdout (do not directly test "
    "on the sample inputs). Enclose your code within delimiters as follows. Ensure that when the python "
    "program runs, it reads the inputs, runs the algorithm and writes output to STDOUT."
    "```python\n# YOUR CODE HERE\n```"
)
CODE_DATES = ("2024-08-00T00:00:00", "2025-01-00T00:00:00")


@dataclass(frozen=True)
class Rule:
    """How a source's row becomes a canonical one."""

    source: str
    ability: str
    question: Column
    answer: Column
    style: str = "rule"
    split: str = "test"
    keep: Column | None = None


def built(df: DataFrame, rule: Rule, key: str) -> DataFrame:
    """data_source, prompt, ability, reward_model, extra_info(split, index); index: the row's place by ``key`` among those that the rule keeps."""
    d = ranked(df if rule.keep is None else df.where(rule.keep), [F.col(key)], "__i")
    return d.select(
        F.lit(rule.source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), rule.question.alias("content"))).alias("prompt"),
        F.lit(rule.ability).alias("ability"),
        F.struct(F.lit(rule.style).alias("style"), rule.answer.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(rule.split).alias("split"), F.col("__i").alias("index")).alias("extra_info"),
    )


def united(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def aime(problem: str = "Problem", answer: str = "Answer", source: str = "Maxwell-Jia/AIME_2024") -> Rule:
    return Rule(source, "English", F.col(problem), F.col(answer).cast("string"))


def cnmo(language: str, question: str = "question", answer: str = "answer") -> Rule:
    """language: en or zh; each is a source of its own."""
    return Rule(f"opencompass/cnmo2024_{language}", "Math", F.col(question), F.col(answer).cast("string"))


def gpqa(key: str, question: str = "Question", right: str = "Correct Answer", wrong: tuple[str, ...] = ("Incorrect Answer 1", "Incorrect Answer 2", "Incorrect Answer 3"), seed: str = "0", source: str = "Idavidrein/gpqa") -> Rule:
    """Options in an order by hash of seed, key and column; the answer is the right one's letter."""
    quoted = lambda c: F.col(f"`{c}`")
    options = F.array_sort(F.array(*(F.struct(hash_key(seed, F.col(key), F.lit(c)).alias("h"), quoted(c).alias("text"), F.lit(c == right).alias("right")) for c in (right, *wrong))))
    lettered = F.array_join(F.transform(options, lambda o, i: F.concat(F.chr(65 + i), F.lit(") "), o["text"])), "\n")
    letter = F.chr(64 + F.array_position(F.transform(options, lambda o: o["right"]), F.lit(True)))
    return Rule(source, "Math", F.concat(F.lit(CHOICE_PROMPT), quoted(question), F.lit("\n\n"), lettered), letter)


class _Texts(pickle.Unpickler):
    """Unpickles what needs no class: texts, numbers, lists."""

    def find_class(self, module: str, name: str):
        raise pickle.UnpicklingError(f"{module}.{name} is not text")


def _unpack(x: str | None) -> str | None:
    try:
        got = _Texts(io.BytesIO(zlib.decompress(base64.b64decode(x)))).load()
        json.loads(got)
        return got
    except Exception:
        return None


def unpacked(packed: Column) -> Column:
    """JSON of what was packed as base64(zlib(pickle(JSON))); null for what isn't such a text."""

    def run(x: pd.Series) -> pd.Series:
        return x.map(_unpack)

    return F.pandas_udf(run, "string")(packed)


_TESTS = "array<struct<input:string,output:string>>"


def code(question: str = "question_content", starter: str = "starter_code", public: str = "public_test_cases", private: str = "private_test_cases", metadata: str = "metadata", date: str = "contest_date", dates: tuple[str, str] = CODE_DATES, source: str = "livecodebench/code_generation_lite") -> Rule:
    """Programming tasks of contests in a range of dates; the answer is JSON of the tests' inputs, outputs and the function's name (null: stdin).

    Private tests are JSON, or JSON that was packed (:func:`unpacked`); Python runs for the packed ones only.
    """
    own = F.coalesce(F.col(starter), F.lit(""))
    ask = F.when(own != "", F.concat(F.lit(CODE_STARTER), own, F.lit("\n```"))).otherwise(F.lit(CODE_STDIN))
    packed = F.when(~F.ltrim(F.col(private)).startswith("["), F.col(private))
    none = F.array().cast(_TESTS)
    tests = F.concat(F.coalesce(F.from_json(F.col(public), _TESTS), none), F.coalesce(F.from_json(F.coalesce(unpacked(packed), F.col(private)), _TESTS), none))
    answer = F.to_json(F.struct(F.transform(tests, lambda t: t["input"]).alias("inputs"), F.transform(tests, lambda t: t["output"]).alias("outputs"), F.get_json_object(metadata, "$.func_name").alias("fn_name")), {"ignoreNullFields": "false"})
    keep = (F.col(date) >= dates[0]) & (F.col(date) < dates[1])
    return Rule(source, "Code", F.concat(F.lit(CODE_PROMPT), F.col(question), F.lit("\n\n"), ask), answer, keep=keep)


def preference_sft(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """prompt, response, kind: two rows of each."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("response")) for k, c in (("chosen", chosen), ("rejected", rejected))))
    others = [c for c in df.columns if c not in (prompt, chosen, rejected)]
    return df.select(*others, F.col(prompt).alias("prompt"), F.inline(kinds)).select(*others, "prompt", "response", "kind")


def preference_rm(df: DataFrame, key: str, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected", train: float = 0.75) -> DataFrame:
    """key, prompt, chosen, rejected, split: the first share of the rows by ``key`` is train, the last 1 - share is test. Shares are rounded to the nearest row, half to even."""
    n = F.broadcast(df.agg(F.count("*").alias("__n")))
    d = ranked(df.select(key, F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected")), [F.col(key)], "__i").crossJoin(n)
    head, tail = F.bround(F.col("__n") * train), F.col("__n") - F.bround(F.col("__n") * (1 - train))
    split = F.concat(F.when(F.col("__i") < head, F.array(F.lit("train"))).otherwise(F.array().cast("array<string>")), F.when(F.col("__i") >= tail, F.array(F.lit("test"))).otherwise(F.array().cast("array<string>")))
    return d.withColumn("split", F.explode(split)).drop("__i", "__n")


def preference_rl(df: DataFrame, key: str, prompt: str = "prompt", response: str = "response", source: str = "Dahoas/full-hh-rlhf") -> DataFrame:
    """Canonical rows to be scored by a model; their ground truth is the logged response, which a model's score doesn't use."""
    return built(df, Rule(source, "alignment", F.col(prompt), F.col(response), style="model", split="train"), key)


#: A complaint of fewer characters than this is none.
SHORTEST = 10
_LEGACY = "struct<disease:string,answer_info:string,symptoms_pool:map<string,double>,initial_symptoms:array<string>,atomic_facts:array<string>>"
_CASE = "struct<disease:string,chief_complaint:string,symptoms_pool:map<string,double>,initial_symptoms:array<string>,data_source:string,ground_truth:string,prompt:array<struct<role:string,content:string>>>"


def case_rows(df: DataFrame, record: str, system: str, user: str, prefix: str = "") -> DataFrame:
    """df's rows that are cases, with prompt, disease, chief_complaint, symptoms_pool, initial_symptoms, data_source; ``record`` is a JSON text.

    A record without a disease or a complaint is of the older, nested shape: the disease stands in ground_truth (or is
    its answer_info), its pool and symptoms too (facts in sentences stand for symptoms that are missing), and the
    complaint is the first user's message, up to its problem. A record without a disease, or whose
    complaint is shorter than SHORTEST, is rejected. {chief_complaint} in ``user`` is replaced; data_source gets the prefix.
    """
    names = {c: F.col("__r")[c] for c in ("disease", "chief_complaint", "symptoms_pool", "initial_symptoms", "data_source", "ground_truth", "prompt")}
    d = df.withColumn("__r", F.from_json(record, _CASE)).withColumn("__g", F.from_json(F.col("__r.ground_truth"), _LEGACY))
    old = (F.coalesce(names["disease"], F.lit("")) == "") | (F.coalesce(names["chief_complaint"], F.lit("")) == "")
    said = F.get(F.filter(names["prompt"], lambda m: m["role"] == "user"), F.lit(0))["content"]
    g, nested = F.col("__g"), F.coalesce(F.col("__r.ground_truth").startswith("{"), F.lit(True))
    fact = F.when(F.size(g["initial_symptoms"]) > 0, g["initial_symptoms"]).otherwise(g["atomic_facts"])
    pick = lambda new, legacy, ok=nested: F.when(old & ok, legacy).otherwise(new)
    d = d.select(
        *df.columns,
        pick(names["disease"], F.coalesce(g["disease"], g["answer_info"])).alias("disease"),
        pick(names["chief_complaint"], F.btrim(F.split_part(said, F.lit("\nProblem:"), F.lit(1)), F.lit(" \t\n\r")), said.isNotNull()).alias("chief_complaint"),
        F.coalesce(pick(names["symptoms_pool"], g["symptoms_pool"]), F.create_map().cast("map<string,double>")).alias("symptoms_pool"),
        F.coalesce(pick(names["initial_symptoms"], fact), F.array().cast("array<string>")).alias("initial_symptoms"),
        F.concat(F.lit(prefix), F.coalesce(names["data_source"], F.lit("kg"))).alias("data_source"),
    )
    d = d.where((F.coalesce("disease", F.lit("")) != "") & (F.length(F.coalesce("chief_complaint", F.lit(""))) >= SHORTEST))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return d.withColumn("prompt", F.array(message("system", F.lit(system)), message("user", F.replace(F.lit(user), F.lit("{chief_complaint}"), F.col("chief_complaint")))))
