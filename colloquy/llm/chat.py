"""Chat formatting by compiled templates.

A template is parsed into a syntax tree, constants in it are folded, and what is left becomes
Python closures, built once a task, that yield a conversation's text piece by piece together
with the marks between which a model's own words stand (``{% generation %}``).

The language::

    {{ expr }}   {# remark #}   {% set x = expr %}   {%- and -%} take the white space beside them
    {% if expr %} {% elif expr %} {% else %} {% endif %}
    {% for m in messages %} {% endfor %}      loop.first, loop.last, loop.index, loop.index0, loop.previous
    {% generation %} {% endgeneration %}
    'text' 12 true false none   x.key x['key'] x[0]   not and or   == != < <= > >= in   + - % ~
    a if b else c   x | trim | upper | lower | length | default('y') | escape

It is a sandbox: names are the caller's values and nothing else, a dot reads a key of a
mapping and never an attribute, only the listed filters can be called, and nothing multiplies
a text or counts up a range, so that output and time are bounded by input and template. A name
or key that is missing is none, which prints as nothing. ``messages`` is a stream that one
``for`` reads once; ``first`` is its first message. A body under ``generation`` stays in one part.

``escape`` makes control strings in a text harmless and is undone by :func:`unescape`: a
backslash becomes two, and one backslash goes behind the first character of every control string.

Rows are dealt by conversation and sorted, and a conversation is rendered as its rows come in, so a
task holds a message and a part (PART characters, or one piece if that is longer), never a
conversation: one that has a third of all rows, or a very long text, passes as a stream. Null
texts and roles are empty; rows without an id are one conversation, without an id; rows that share
a turn (repeated rows too) go by role, then text; null turns come first. Other columns are ignored,
whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import enum
import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import width

#: Characters in a row of the output, and in a batch of rows.
PART, BATCH = 1 << 20, 1 << 22
#: Depth of nesting, and tokens in an expression, that the parser takes.
DEPTH, LENGTH = 50, 300

#: Marks of turns; none is a part of another's beginning.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}<<SYS>> {{ m.text | escape }} <</SYS>>"
    "{% else %}[ROLE] {{ m.role | escape }} [/ROLE] {{ m.text | escape }}</s>"
    "{% endif %}{% endfor %}"
)


class Mark(enum.Enum):
    """Where generated text begins and ends among the pieces of a text."""

    BEGIN = "begin"
    END = "end"


class TemplateError(ValueError):
    """The template, or a value that it was given, is no good."""


def escape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    return re.sub(f"(?=(?:{'|'.join(map(re.escape, controls))}))(.)", r"\1" + "\\\\", text.replace("\\", "\\\\"), flags=re.S)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


# Syntax


_TAG = re.compile(r"""\{#.*?#\}|\{(?P<kind>[{%])(?P<lead>-?)(?P<body>(?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"])*?)(?P<trail>-?)(?:\}\}|%\})""", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>()\[\].|~+\-%,=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t"}
_WORDS = {"true": True, "false": False, "none": None}
_KEYWORDS = {"and", "or", "not", "in", "if", "else", *_WORDS}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    while source[at:].strip():
        if not (m := _TOKEN.match(source, at)):
            raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
        at, kind = m.end(), m.lastgroup
        value = m[kind]
        if kind == "str":
            value = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), value[1:-1], flags=re.S)
        elif kind == "int":
            value = int(value)
        elif kind == "name" and value in _KEYWORDS:
            kind = "op"
        out.append((kind, value))
    return out


class _Expression:
    """Recursive descent over one tag's tokens; nodes are tuples that begin with their kind."""

    def __init__(self, source: str):
        self.tokens, self.at, self.depth = _tokens(source), 0, 0
        if len(self.tokens) > LENGTH:
            raise TemplateError("expression is too long")

    def take(self, *ops: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, kind: str, value: Any = None) -> Any:
        if self.at == len(self.tokens) or self.tokens[self.at][0] != kind or value not in (None, self.tokens[self.at][1]):
            raise TemplateError(f"expected {value or kind}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> tuple:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self) -> tuple:
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("nested too deeply")
        out = self.either()
        if self.take("if"):
            test = self.either()
            self.need("op", "else")
            out = ("choice", test, out, self.choice())
        self.depth -= 1
        return out

    def either(self) -> tuple:
        out = self.both()
        while self.take("or"):
            out = ("or", out, self.both())
        return out

    def both(self) -> tuple:
        out = self.negation()
        while self.take("and"):
            out = ("and", out, self.negation())
        return out

    def negation(self) -> tuple:
        turns = 0
        while self.take("not"):
            turns += 1
        out = self.comparison()
        for _ in range(min(turns, 2 + turns % 2)):
            out = ("not", out)
        return out

    def comparison(self) -> tuple:
        out = self.sum()
        if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            return ("binary", op, out, self.sum())
        if self.take("not"):
            self.need("op", "in")
            return ("not", ("binary", "in", out, self.sum()))
        return out

    def sum(self) -> tuple:
        out = self.filtered()
        while op := self.take("+", "-", "%", "~"):
            out = ("binary", op, out, self.filtered())
        return out

    def filtered(self) -> tuple:
        out = self.item()
        while self.take("|"):
            name, args = self.need("name"), []
            if name not in FILTERS and name != "escape":
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                args.append(self.choice())
                self.need("op", ")")
            if len(args) != (name == "default"):
                raise TemplateError(f"wrong number of arguments for {name!r}")
            out = ("filter", name, out, *args)
        return out

    def item(self) -> tuple:
        out = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                out = ("item", out, ("const", self.need("name")))
            else:
                out = ("item", out, self.choice())
                self.need("op", "]")
        return out

    def atom(self) -> tuple:
        if self.take("("):
            out = self.choice()
            self.need("op", ")")
            return out
        if word := self.take(*_WORDS):
            return ("const", _WORDS[word])
        if self.take("-"):
            return ("const", -self.need("int"))
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("str", "int"):
            self.at += 1
            return ("const", self.tokens[self.at - 1][1])
        return ("name", self.need("name"))


def parse(source: str) -> list[tuple]:
    """The syntax tree: text, out, set, if, for and generation nodes."""
    pieces, at, strip = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        pieces.append(("text", text.rstrip() if m["lead"] else text))
        if m["kind"]:
            if not m[0].endswith("}}" if m["kind"] == "{" else "%}"):
                raise TemplateError(f"tag is not closed: {m[0][:20]!r}")
            pieces.append(("out" if m["kind"] == "{" else "tag", m["body"].strip()))
        at, strip = m.end(), bool(m["trail"])
    pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
    if any(kind == "text" and re.search(r"\{[{%#]", body) for kind, body in pieces):
        raise TemplateError("a tag is not closed")
    rest = iter(pieces)

    def block(until: tuple[str, ...], depth: int) -> tuple[list[tuple], str, str]:
        if depth > DEPTH:
            raise TemplateError("nested too deeply")
        out: list[tuple] = []
        for kind, body in rest:
            if kind == "text":
                out.append((kind, body))
                continue
            if kind == "out":
                out.append((kind, _Expression(body).whole()))
                continue
            word, _, more = body.partition(" ")
            if word in until:
                return out, word, more
            if word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.*)", more.strip(), re.S)):
                out.append(("set", m[1], _Expression(m[2]).whole()))
            elif word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", more.strip(), re.S)):
                inner, _, _ = block(("endfor",), depth + 1)
                out.append(("for", m[1], _Expression(m[2]).whole(), inner))
            elif word == "if":
                arms: list[tuple] = []
                while word != "endif":
                    test = ("const", True) if word == "else" else _Expression(more).whole()
                    inner, word, more = block(("endif",) if word == "else" else ("elif", "else", "endif"), depth + 1)
                    arms.append((test, inner))
                out.append(("if", arms))
            elif word == "generation":
                inner, _, _ = block(("endgeneration",), depth + 1)
                out.append(("generation", inner))
            else:
                raise TemplateError(f"unexpected {{% {body[:20]} %}}")
        if until:
            raise TemplateError(f"{until[-1]} is missing")
        return out, "", ""

    return block((), 0)[0]


# Values


def _shown(x: Any) -> str:
    if x is None:
        return ""
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (str, int)):
        return str(x)
    raise TemplateError("only texts, numbers and truth values can be printed")


def _text(x: Any) -> str:
    if isinstance(x, str) or x is None:
        return x or ""
    raise TemplateError("this filter takes a text")


FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, dict)) else 0,
    "default": lambda x, y: y if x is None else x,
}


def _item(x: Any, key: Any) -> Any:
    if isinstance(x, dict):
        return x.get(key)
    if isinstance(x, (list, str)) and isinstance(key, int):
        return x[key] if -len(x) <= key < len(x) else None
    return None


def _binary(op: str, a: Any, b: Any) -> Any:
    if op == "~":
        return _shown(a) + _shown(b)
    if op in ("==", "!="):
        return (a == b) == (op == "==")
    if op == "in":
        return isinstance(b, (str, list, dict)) and (isinstance(a, str) or not isinstance(b, str)) and a in b
    if not (isinstance(a, str) and isinstance(b, str) and op not in "-%" or isinstance(a, int) and isinstance(b, int)):
        raise TemplateError(f"{op} takes two numbers" + " or two texts" * (op not in "-%"))
    if op == "%" and not b:
        raise TemplateError("division by zero")
    return {"+": lambda: a + b, "-": lambda: a - b, "%": lambda: a % b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()


# Folding and closures


def _fold(node: tuple, controls: tuple[str, ...]) -> tuple:
    """The same expression with every part that no value decides computed."""
    kind, *parts = node
    parts = [_fold(p, controls) if isinstance(p, tuple) else p for p in parts]
    node = (kind, *parts)
    known = [p[0] == "const" for p in parts if isinstance(p, tuple)]
    if kind in ("and", "or", "choice") and known[0]:
        truth = bool(parts[0][1])
        return parts[1 if truth else 2] if kind == "choice" else parts[truth == (kind == "and")]
    if kind not in ("const", "name") and all(known):
        return ("const", _expression(node, controls)({}))
    return node


def fold(tree: list[tuple], controls: tuple[str, ...]) -> list[tuple]:
    """Constant expressions computed, dead branches dropped, texts side by side joined."""
    out: list[tuple] = []

    def add(nodes: list[tuple]) -> None:
        for n in nodes:
            if n[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + n[1])
            elif n != ("text", ""):
                out.append(n)

    for node in tree:
        kind = node[0]
        if kind == "out":
            e = _fold(node[1], controls)
            # a joined text is written part by part, so that its constant ends meet the texts beside them
            add(_spread(e))
        elif kind == "set":
            add([("set", node[1], _fold(node[2], controls))])
        elif kind == "for":
            add([("for", node[1], _fold(node[2], controls), fold(node[3], controls))])
        elif kind == "generation":
            add([("generation", fold(node[1], controls))])
        elif kind == "if":
            arms = []
            for test, body in node[1]:
                test = _fold(test, controls)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold(body, controls)))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                add(arms[0][1])
            elif arms:
                add([("if", arms)])
        else:
            add([node])
    return out


def _spread(e: tuple) -> list[tuple]:
    if e[0] == "binary" and e[1] == "~":
        return [*_spread(e[2]), *_spread(e[3])]
    return [("text", _shown(e[1]))] if e[0] == "const" else [("out", e)]


def _expression(node: tuple, controls: tuple[str, ...]) -> Callable[[dict], Any]:
    kind, *parts = node
    if kind == "const":
        value = parts[0]
        return lambda env: value
    if kind == "name":
        name = parts[0]
        if name == "messages":
            raise TemplateError("messages can only be looped over")
        return lambda env: env.get(name)
    if kind == "binary":
        op, a, b = parts[0], _expression(parts[1], controls), _expression(parts[2], controls)
        return lambda env: _binary(op, a(env), b(env))
    if kind == "filter":
        name, x, args = parts[0], _expression(parts[1], controls), [_expression(p, controls) for p in parts[2:]]
        if name == "escape":
            return lambda env: escape(_text(x(env)), controls)
        f = FILTERS[name]
        return lambda env: f(x(env), *(a(env) for a in args))
    a, *more = (_expression(p, controls) for p in parts)
    if kind == "not":
        return lambda env: not a(env)
    if kind == "item":
        return lambda env: _item(a(env), more[0](env))
    if kind == "and":
        return lambda env: a(env) and more[0](env)
    if kind == "or":
        return lambda env: a(env) or more[0](env)
    return lambda env: more[0](env) if a(env) else more[1](env)


def _statement(node: tuple, controls: tuple[str, ...]) -> Callable[[dict], Iterator]:
    kind = node[0]
    if kind == "text":
        return lambda env: iter((node[1],))
    if kind == "out":
        e = _expression(node[1], controls)
        return lambda env: iter((_shown(e(env)),))
    if kind == "set":
        e = _expression(node[2], controls)

        def assign(env: dict) -> Iterator:
            env[node[1]] = e(env)
            return iter(())

        return assign
    if kind == "if":
        arms = [(_expression(t, controls), _block(b, controls)) for t, b in node[1]]

        def branch(env: dict) -> Iterator:
            return next((body(env) for test, body in arms if test(env)), iter(()))

        return branch
    if kind == "generation":
        body = _block(node[1], controls)

        def marked(env: dict) -> Iterator:
            yield Mark.BEGIN
            yield from body(env)
            yield Mark.END

        return marked
    name, body = node[1], _block(node[3], controls)
    source = None if node[2] == ("name", "messages") else _expression(node[2], controls)

    def loop(env: dict) -> Iterator:
        items = env["messages"]() if source is None else source(env)
        if not isinstance(items, (list, Iterator)):
            raise TemplateError("only lists and messages can be looped over")
        rest, end = iter(items), object()
        item, previous, k = next(rest, end), None, 0
        while item is not end:
            coming = next(rest, end)
            state = {"first": not k, "last": coming is end, "index0": k, "index": k + 1, "previous": previous}
            yield from body({**env, name: item, "loop": state})
            item, previous, k = coming, item, k + 1

    return loop


def _block(nodes: list[tuple], controls: tuple[str, ...]) -> Callable[[dict], Iterator]:
    steps = [_statement(n, controls) for n in nodes]

    def run(env: dict) -> Iterator:
        for s in steps:
            yield from s(env)

    return run


class Template:
    """A template ready to render; ``controls`` are the strings that ``escape`` makes harmless."""

    def __init__(self, source: str, controls: tuple[str, ...] = CONTROLS):
        if any(len(c) < 2 or "\\" in c for c in controls):
            raise TemplateError("control strings have two characters at least and no backslash")
        self.tree = fold(parse(source), controls)
        self._run = _block(self.tree, controls)

    def render(self, messages: Iterable[dict], **values: Any) -> Iterator:
        """Pieces of text, and Mark.BEGIN and Mark.END around generated ones. Messages are read as the pieces are."""
        rest = iter(messages)
        head = list(itertools.islice(rest, 1))
        streams = iter([itertools.chain(head, rest)])

        def once() -> Iterator:
            if (s := next(streams, None)) is None:
                raise TemplateError("messages can be looped over once only")
            return s

        return self._run({**values, "first": head[0] if head else None, "messages": once})


# Tables


_FORMATTED = "conv_id long, no_id boolean, part int, start long, text string, spans array<struct<start:long,end:long>>"


def formatted(rows: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, **values: Any) -> DataFrame:
    """conv_id (null where no_id), part, start, text, spans of rows of (conv_id, turn, role, text).

    The texts of a conversation's parts, joined, are the formatted conversation; start is the
    characters before the part; spans are the generated places, in characters from the
    conversation's start, each in one part. A conversation's parts lie in one partition, in order.
    """
    Template(template, controls)  # errors in the template are the caller's, before any task runs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = Template(template, controls)
        columns = ["conv_id", "no_id", "part", "start", "text", "spans"]
        out: list[tuple] = []
        held = 0
        stream = (x for pdf in batches for x in zip(pdf["conv_id"].tolist(), pdf["no_id"].tolist(), pdf["role"], pdf["text"], strict=True))
        for (conv, no_id), turns in itertools.groupby(stream, key=lambda x: x[:2]):
            part = start = at = 0
            pieces: list[str] = []
            spans: list[dict] = []
            begun: list[int] = []
            for piece in itertools.chain(compiled.render(({"role": r, "text": t} for _, _, r, t in turns), **values), [None]):
                if piece is Mark.BEGIN:
                    begun.append(at)
                elif piece is Mark.END:
                    spans.append({"start": begun.pop(), "end": at})
                elif piece:
                    pieces.append(piece)
                    at += len(piece)
                if piece is None or at - start >= PART and not begun:
                    out.append((conv, no_id, part, start, "".join(pieces), spans))
                    held += at - start + 64
                    part, start, pieces, spans = part + 1, at, [], []
                if held >= BATCH:
                    yield pd.DataFrame(out, columns=columns)
                    out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=columns)

    conv = F.col("conv_id").cast("long")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    bare = rows.select(F.coalesce(conv, F.lit(0)).alias("conv_id"), conv.isNull().alias("no_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    dealt = bare.repartition(width(rows.sparkSession), "no_id", "conv_id").sortWithinPartitions("no_id", "conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "no_id", "role", "text").mapInPandas(run, _FORMATTED)


_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>> (?P<system>.*?) <</SYS>>|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*?)</s>|(?!\[INST\]|<<SYS>>|\[ROLE\])(?P<assistant>.*?)</s>", re.S)


def read_turns(parts: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of a conversation that TEMPLATE has formatted, from its parts in order."""
    rest = ""
    for part in parts:
        rest, at = rest + part, 0
        while m := _TURN.match(rest, at):
            kind = m.lastgroup
            yield (unescape(m["role"]) if kind == "other" else kind, unescape(m[kind]))
            at = m.end()
        rest = rest[at:]
    if rest:
        raise ValueError("a turn has no end")


def digest(rows: DataFrame) -> DataFrame:
    """The contract's row for each conversation, from the formatted text and its spans alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = (x for pdf in batches for x in zip(pdf["conv_id"].tolist(), pdf["no_id"].tolist(), pdf["start"].tolist(), pdf["text"], pdf["spans"], strict=True))
        out: list[tuple] = []
        for (conv, no_id), parts in itertools.groupby(stream, key=lambda x: x[:2]):
            turns, loss, n_turns, loss_chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

            def texts(parts=parts, loss=loss) -> Iterator[str]:
                nonlocal loss_chars, size
                for _, _, start, text, spans in parts:
                    size += len(text)
                    for s in spans:
                        own = unescape(text[s["start"] - start : s["end"] - start])
                        loss_chars += len(own)
                        loss.update(own.encode())
                    yield text

            for role, text in read_turns(texts()):
                n_turns += 1
                turns.update(f"{role}\n{text}\n".encode())
            out.append((conv, no_id, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), size))
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    columns = ["conv_id", "no_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    got = formatted(rows).mapInPandas(run, "conv_id long, no_id boolean, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return got.select(F.when(~F.col("no_id"), F.col("conv_id")).alias("conv_id"), *columns[2:])
