"""Parsing of model output as Column builders: JSON objects in text, tags, tool calls, chats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

from colloquy.functions.texts import normalized, without_think

ASKS = ("ask", "continue", "switch")


def _object(text: Column) -> Column:
    """A JSON object as a variant, else null."""
    v = F.try_parse_json(F.trim(text))
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def json_object(x: Column) -> Column:
    """The object in a fenced json block, else between the outer braces after thoughts are taken out, else between the outer braces."""
    fence = F.regexp_extract(x, r"(?is)```json\s*(.*?)```", 1)
    braces = lambda t: F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    return F.coalesce(_object(fence), _object(braces(without_think(x))), _object(braces(x)))


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def action(x: Column) -> Column:
    """ask (also for continue and switch), diagnose, or null: from the object's action, or its type, name or value if that is an object, else from an action tag."""
    v = json_object(x)
    nested = F.coalesce(_get(v, "$.action.type"), _get(v, "$.action.name"), _get(v, "$.action.value"))
    raw = F.lower(F.trim(F.when(v.isNotNull(), F.coalesce(nested, _get(v, "$.action"))).otherwise(F.regexp_extract(x, r"(?is)<action>\s*(ask|continue|switch|diagnose)\s*</action>", 1))))
    return F.when(raw.isin(*ASKS), "ask").when(raw == "diagnose", "diagnose")


def diagnosis(x: Column) -> Column:
    """The object's diagnosis, else the last diagnosis tag that is no placeholder, else what follows Final Answer; normalised, or null."""
    v = json_object(x)
    tags = F.filter(F.regexp_extract_all(x, F.lit(r"(?is)<diagnosis>(.*?)</diagnosis>"), F.lit(1)), lambda t: ~t.rlike(r"^\s*(\.\.\.|\[.*\])?\s*$"))
    last = F.try_element_at(tags, F.lit(-1))
    said = F.nullif(F.regexp_extract(x, r"(?i)Final Answer:\s*([^\n]+)", 1), F.lit(""))
    return F.nullif(normalized(F.coalesce(_get(v, "$.diagnosis"), last, said)), F.lit(""))


def question(x: Column) -> Column:
    v = json_object(x)
    tag = F.nullif(F.regexp_extract(x, r"(?is)<question>(.*?)</question>", 1), F.lit(""))
    said = F.nullif(F.regexp_extract(without_think(x), r"(?s)Question:\s*(.+)$", 1), F.lit(""))
    return F.trim(F.coalesce(_get(v, "$.question"), tag, said))


def valid_turn(x: Column) -> Column:
    """An action of the set with its question or diagnosis."""
    a = action(x)
    return F.coalesce(((a == "ask") & question(x).isNotNull()) | ((a == "diagnose") & diagnosis(x).isNotNull()), F.lit(False))


def plain_action(x: Column) -> Column:
    """{action, content} of the plain format: Final Answer or Question at the start of what follows the thoughts."""
    t = F.trim(without_think(x))
    answer, ask = F.regexp_extract(t, r"(?is)^Final Answer:\s*(.*)$", 1), F.regexp_extract(t, r"(?is)^Question:\s*(.*)$", 1)
    a, q = t.rlike(r"(?i)^Final Answer:"), t.rlike(r"(?i)^Question:")
    return F.struct(F.when(a, "answer").when(q, "ask").alias("action"), F.when(a, F.trim(answer)).when(q, F.trim(ask)).alias("content"))


def tool_calls(x: Column) -> Column:
    """array<struct<name, arguments>> of the tool calls that parse."""
    raw = F.regexp_extract_all(x, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    found = F.transform(raw, lambda t: F.struct(_get(F.try_parse_json(t), "$.name").alias("name"), F.to_json(F.try_variant_get(F.try_parse_json(t), "$.arguments", "variant")).alias("arguments")))
    return F.filter(found, lambda c: c["name"].isNotNull())


def chat_messages(x: Column) -> Column:
    """array<struct<role, content>> of rendered chat text; text without marks is one user message."""
    pattern = r"(?s)<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>"
    roles, texts = F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), F.regexp_extract_all(x, F.lit(pattern), F.lit(2))
    found = F.zip_with(roles, texts, lambda r, t: F.struct(r.alias("role"), F.trim(t).alias("content")))
    return F.when(F.size(roles) > 0, found).otherwise(F.array(F.struct(F.lit("user").alias("role"), F.trim(x).alias("content"))))


def split_media(x: Column) -> Column:
    """array<struct<type, text>>: image and video tags as parts of their own."""
    parts = F.filter(F.split(F.regexp_replace(x, "(<image>|<video>)", "\u0001$1\u0001"), "\u0001"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.when(p == "<image>", "image").when(p == "<video>", "video").otherwise("text").alias("type"), F.when(~p.isin("<image>", "<video>"), p).alias("text")))


def denied_before(text: Column, term: Column, words: int = 5) -> Column:
    """Whether a denial stands among the words before the term's first mention. Words end where neither a letter nor a digit of any script follows."""
    at = F.instr(F.lower(text), F.lower(term))
    before = F.filter(F.split(F.substring(F.lower(text), F.lit(1), at - 1), r"\s+"), lambda w: w != "")
    near = F.array_join(F.slice(before, F.greatest(F.size(before) - words + 1, F.lit(1)), F.lit(words)), " ")
    return F.when(at > 0, near.rlike(r"(?=[ndw])(?<![\p{L}\p{N}_])(no|not|never|without|denies|deny|denied)(?![\p{L}\p{N}_])"))


def verdict(x: Column) -> Column:
    """1 for a boxed True or the word CORRECT, 0 for INCORRECT or another boxed value."""
    return F.when(x.rlike(r"\\boxed\{\s*True\s*\}"), 1.0).when(x.rlike(r"\bINCORRECT\b"), 0.0).when(x.rlike(r"\bCORRECT\b"), 1.0).otherwise(0.0)


def wikihow_clean(x: Column) -> Column:
    """Without bracketed artifacts; a title mark ends a sentence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(x), r" \[title\]", ". "), r"\[.*?\]", ""), "  +", " "))


def patient_reply(x: Column, answer: str = "I don't know.", unknown: str = "unknown") -> Column:
    """{answer, fact_id} of a patient's JSON, with defaults; text that is no object is the answer."""
    v = json_object(x)
    said = F.when(v.isNull(), F.nullif(F.trim(x), F.lit("")))
    return F.struct(F.coalesce(_get(v, "$.answer"), said, F.lit(answer)).alias("answer"), F.coalesce(_get(v, "$.fact_id"), F.lit(unknown)).alias("fact_id"))


def no_think_once(x: Column) -> Column:
    """/no_think at the end of the first system block of a rendered prompt, unless some block has it."""
    return F.when(x.contains("/no_think"), x).otherwise(F.regexp_replace(x, r"(?s)\A(.*?<\|im_start\|>system\n.*?)(<\|im_end\|>)", "$1 /no_think$2"))


def tagged_trace(x: Column) -> Column:
    """array<struct<role, content>> of a trace: code and answers are the assistant's, interpreter output the tool's."""
    pattern = r"(?s)<(code|interpreter|answer)>(.*?)</\1>"
    tags, texts = F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), F.regexp_extract_all(x, F.lit(pattern), F.lit(2))
    return F.zip_with(tags, texts, lambda t, c: F.struct(F.when(t == "interpreter", "tool").otherwise("assistant").alias("role"), F.trim(c).alias("content")))


def point_reward(points: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """1 / sqrt(n * k) if the k-th of n points (array<struct<x, y>>) is the first inside the box, -1 / n if none is, -1 without points."""
    n, k = F.size(points), first_inside(points, left, top, right, bottom)
    return F.when(n == 0, -1.0).when(k.isNotNull(), 1 / F.sqrt(n * k)).otherwise(-1.0 / n)


def first_inside(points: Column, left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """The place, from 1, of the first point inside the box, or null."""
    inside = F.transform(points, lambda p, i: F.when((p["x"] >= left) & (p["x"] <= right) & (p["y"] >= top) & (p["y"] <= bottom), i + 1))
    return F.array_min(F.filter(inside, lambda i: i.isNotNull()))


def points_of(x: Column) -> Column:
    """array<struct<x, y>> of an answer's JSON list of {"point_2d": [x, y]}, or null where a part of it is malformed."""
    raw = F.from_json(F.regexp_extract(x, r"(?s)(\[.*\])", 1), "array<struct<point_2d:array<double>>>")
    fine = F.forall(raw, lambda p: F.coalesce((F.size(p["point_2d"]) == 2) & p["point_2d"][0].isNotNull() & p["point_2d"][1].isNotNull(), F.lit(False)))
    return F.when(fine, F.transform(raw, lambda p: F.struct(p["point_2d"][0].alias("x"), p["point_2d"][1].alias("y"))))


def collinear(points: Column) -> Column:
    """Whether three of the points lie on a line, by the cross product, as close as one part in a thousand million."""
    def off(a: Column, b: Column, c: Column) -> Column:
        u, v = (b["y"] - a["y"]) * (c["x"] - a["x"]), (c["y"] - a["y"]) * (b["x"] - a["x"])
        return F.abs(u - v) <= 1e-9 * F.greatest(F.abs(u), F.abs(v))

    rest = lambda i: F.slice(points, i + 2, F.size(points))
    pairs = F.flatten(F.transform(points, lambda a, i: F.transform(rest(i), lambda b, j: F.struct(a.alias("a"), b.alias("b"), (i + j + 1).alias("j")))))
    return (F.size(points) >= 3) & F.exists(pairs, lambda p: F.exists(F.slice(points, p["j"] + 2, F.size(points)), lambda c: off(p["a"], p["b"], c)))


def after_thoughts(x: Column) -> Column:
    """What follows one leading, non-empty block of thoughts, or null."""
    once = (F.regexp_count(x, F.lit("<think>")) == 1) & (F.regexp_count(x, F.lit("</think>")) == 1)
    return F.when(x.startswith("<think>") & once & (F.trim(F.regexp_extract(x, r"(?s)\A<think>(.*?)</think>", 1)) != ""), F.trim(F.regexp_extract(x, r"(?s)</think>(.*)\z", 1)))


def point_score(points: Column, left: Column, top: Column, right: Column, bottom: Column, fmt: float = 1.0, acc: float = 1.0) -> Column:
    """struct<score, format, accuracy, num_pred, first_correct, only_correct, is_collinear> of an answer's points (null: malformed): -1 for a malformed or collinear answer, else format and accuracy weighted."""
    line = F.coalesce(collinear(points), F.lit(False))
    ok = points.isNotNull() & ~line
    reward, k = point_reward(points, left, top, right, bottom), first_inside(points, left, top, right, bottom)
    n = F.when(ok, F.size(points)).otherwise(0)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.struct(
        F.when(ok, fmt + acc * reward).otherwise(-1.0).alias("score"), F.when(ok, 1.0).otherwise(0.0).alias("format"), F.when(ok, reward).otherwise(-1.0).alias("accuracy"),
        n.alias("num_pred"), flag(ok & (k == 1)).alias("first_correct"), flag(ok & (n == 1) & k.isNotNull()).alias("only_correct"), line.cast("int").alias("is_collinear"),
    )


def count_chain(letters: Column, target: Column) -> Column:
    """A worked answer to how often ``target`` is among letters: a line a letter, then the boxed count."""
    line = F.transform(letters, lambda c: F.concat(c, F.when(c == target, " = ").otherwise(" != "), target, F.lit(".")))
    n = F.size(F.filter(letters, lambda c: c == target)).cast("string")
    return F.concat(F.array_join(line, "\n"), F.lit("\n\\boxed{"), n, F.lit("} "), target, F.lit(" in "), F.array_join(letters, "-"), F.lit("."))


def without_nan(c: Column, kind: DataType) -> Column:
    """c of that type with each NaN inside it, at any depth, as null."""
    if isinstance(kind, DoubleType | FloatType):
        return F.nanvl(c, F.lit(None).cast(kind))
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: without_nan(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: without_nan(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*(without_nan(c[f.name], f.dataType).alias(f.name) for f in kind)))
    return c


def flat_columns(c: Column, kind: StructType, prefix: str = "") -> list[Column]:
    """The leaves of a nested struct as columns named by their path, a/b/c."""
    out = []
    for f in kind:
        name = f"{prefix}{f.name}"
        out += flat_columns(c[f.name], f.dataType, f"{name}/") if isinstance(f.dataType, StructType) else [c[f.name].alias(name)]
    return out
