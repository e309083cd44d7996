"""Training rows with token-level loss masks, from arrays of token ids. Tokenizers are the caller's.

A row is a struct of four arrays of ``max_length`` places: input_ids, attention_mask, position_ids, loss_mask. Short rows
are padded at the end; long ones lose their end (``right``), their beginning (``left``), or are an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.texts import held

TRUNCATIONS = ("error", "left", "right")
ROLES = ("system", "user", "assistant", "tool")


def _fitted(x: Column, n: Column, length: int, pad: int, truncation: str, what: str) -> Column:
    """The array x of n places at a length."""
    if truncation not in TRUNCATIONS:
        raise ValueError(f"unknown truncation {truncation!r}")
    long = {
        "left": F.slice(x, n - length + 1, F.lit(length)),
        "right": F.slice(x, F.lit(1), F.lit(length)),
        "error": F.raise_error(F.concat(F.lit(f"{what} of "), n.cast("string"), F.lit(f" tokens is longer than {length}"))).cast("array<int>"),
    }[truncation]
    return F.when(n > length, long).otherwise(F.concat(x, F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - n, F.lit(0)))))


def single_turn(df: DataFrame, prompt: str, response: str, max_length: int, pad: int, truncation: str = "error", out: str = "row") -> DataFrame:
    """df with a row of a prompt's and a response's tokens (array<int>; null: none).

    The place before a token is what predicts it, so the mask is on from the prompt's last token and off at
    the response's last; a prompt of one token or none is not masked. Both places are counted from the start
    of the row as it is after truncation, on the left too. Positions count tokens and stay at the last one under padding.
    """
    none = F.array().cast("array<int>")
    ids = lambda c: F.coalesce(F.col(c).cast("array<int>"), none)
    d = held(df, _p=F.size(ids(prompt)), _n=F.size(ids(prompt)) + F.size(ids(response)), _x=F.concat(ids(prompt), ids(response)))
    m = F.lit(max_length)
    places = F.sequence(F.lit(0), m - 1)
    kept = F.least(F.col("_n"), m)
    off = lambda i: (i >= kept) | ((F.col("_p") > 1) & (i < F.least(F.col("_p"), m) - 1)) | (i == kept - 1)
    row = F.struct(
        _fitted(F.col("_x"), F.col("_n"), max_length, pad, truncation, "a row").alias("input_ids"),
        F.transform(places, lambda i: (i < kept).cast("int")).alias("attention_mask"),
        F.transform(places, lambda i: F.greatest(F.least(i, kept - 1), F.lit(0))).alias("position_ids"),
        F.transform(places, lambda i: F.when(off(i), 0).otherwise(1)).alias("loss_mask"),
    )
    return d.withColumn(out, row).drop("_p", "_n", "_x")


def message_parts(messages: Column, encode: callable, header: callable, footer: str) -> Column:
    """array<struct<role, head array<int>, body array<int>>> of messages (array<struct<role, content>>): the tokens of ``header(role)``, and of the content with ``footer`` behind it, by ``encode`` (a Column function from text to array<int>)."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), encode(header(m["role"])).alias("head"), encode(F.concat(F.coalesce(m["content"], F.lit("")), F.lit(footer))).alias("body")))


def multi_turn(df: DataFrame, parts: str, max_length: int, pad: int = 0, truncation: str = "error", out: str = "row") -> DataFrame:
    """df with a row of a whole chat from ``parts`` (:func:`message_parts`): the mask is on over assistants' bodies and off over all heads, other roles and padding.

    A system message that isn't first, and a role that is none of ROLES, are errors. Positions are 0 under padding.
    """
    p = F.col(parts)
    wrong = F.filter(p, lambda m, i: ((m["role"] == "system") & (i > 0)) | ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)))
    bad = F.get(wrong, F.lit(0))["role"]
    message = F.when(bad == "system", F.lit("the system's message is not the first")).otherwise(F.concat(F.lit("unknown role "), F.coalesce(bad, F.lit("null"))))
    checked = F.when(F.size(wrong) > 0, F.raise_error(message).cast(df.schema[parts].dataType)).otherwise(p)
    d = held(df, _p=checked)
    on = lambda m: F.when(m["role"] == "assistant", 1).otherwise(0)
    tokens = F.flatten(F.transform("_p", lambda m: F.concat(m["head"], m["body"])))
    mask = F.flatten(F.transform("_p", lambda m: F.concat(F.array_repeat(F.lit(0), F.size(m["head"])), F.array_repeat(on(m), F.size(m["body"])))))
    d = held(d, _x=tokens, _m=mask)
    d = held(d, _n=F.size("_x"))
    places, kept = F.sequence(F.lit(0), F.lit(max_length - 1)), F.least(F.col("_n"), F.lit(max_length))
    row = F.struct(
        _fitted(F.col("_x"), F.col("_n"), max_length, pad, truncation, "a chat").alias("input_ids"),
        F.transform(places, lambda i: (i < kept).cast("int")).alias("attention_mask"),
        F.transform(places, lambda i: F.when(i < kept, i).otherwise(0)).alias("position_ids"),
        _fitted(F.col("_m"), F.col("_n"), max_length, 0, truncation, "a chat").alias("loss_mask"),
    )
    return d.withColumn(out, row).drop("_p", "_x", "_m", "_n")
