import random

import pytest
from conftest import sha

from colloquy.llm import chat
from colloquy.llm.chat import Mark, Template, TemplateError

SCHEMA = "conv_id long, turn long, role string, text string, start long, part int, spans string, no_id boolean, n_turns long"


def rendered(source, messages=(), **values):
    return "".join(x for x in Template(source).render(messages, **values) if not isinstance(x, Mark))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("a{# b #}c", "ac"),
        ("{{ 'its' if false else \"q\" }}", "q"),
        ("{{ 1 + 2 - 4 }}{{ 'a' + 'b' ~ 3 }}{{ 7 % 4 }}", "-1ab33"),
        ("{{ x.a['b'] }}|{{ x.missing.more }}|{{ nothing }}", "5||"),
        ("{{ y[0] ~ y[-1] }}{{ y[9] }}{{ 'abc'[1] }}", "pqb"),
        ("{{ ' aB ' | trim | upper }}{{ none | default('d') }}{{ 'abc' | length }}", "ABd3"),
        ("{% if x.a.b == 5 and not false %}yes{% else %}no{% endif %}", "yes"),
        ("{% if n < 2 %}a{% elif n >= 3 %}b{% else %}c{% endif %}", "b"),
        ("{{ 'a' in 'cab' }}{{ 'z' not in y }}{{ not not 1 }}", "truetruetrue"),
        ("{% for i in y %}{{ loop.index }}{{ i }}{% if not loop.last %},{% endif %}{% endfor %}", "1p,2q"),
        ("a  {%- if true %}  b  {%- endif -%}  c", "a  bc"),
        ("{% set k = n + 1 %}{{ k }}{% if true %}{% set k = 9 %}{% endif %}{{ k }}", "49"),
        ("{{ '%}' }}{{ 'a\\nb' }}", "%}a\nb"),
        ("{{ (1 if n > 5 else 2) + (3 or 4) }}", "5"),
    ],
)
def test_language(source, want):
    assert rendered(source, x={"a": {"b": 5}}, y=["p", "q"], n=3) == want


@pytest.mark.parametrize(
    "source",
    ["{{ 1", "{% if x %}", "{% endfor %}", "{{ x.__class__() }}", "{{ x | exec }}", "{{ 'a' * 9 }}", "{{ messages }}", "{% for x y %}{% endfor %}", "{{ 1 2 }}", "{{ 'a }}", "{{ " + "(" * 60 + "1" + ")" * 60 + " }}", "{{ 1" + " + 1" * 400 + " }}", "{{ 1 % 0 }}", "{% if true %}" * 60 + "{% endif %}" * 60, "{% else %}", "{{ x | default }}", "{{ x | trim(1) }}", "{% while 1 %}"],
)
def test_bad_templates(source):
    with pytest.raises(TemplateError):
        Template(source)


def test_sandbox():
    assert rendered("{{ x.__class__ }}{{ x.items }}{{ ''.__class__ }}{{ f.__globals__ }}", x={}, f=rendered) == ""
    for bad in ("{{ f }}", "{{ 'a' + 1 }}", "{% for c in 'abc' %}{% endfor %}", "{% for a in messages %}{% endfor %}{% for a in messages %}{% endfor %}"):
        with pytest.raises(TemplateError):
            rendered(bad, [{"role": "user", "text": ""}], f=rendered)


def test_folding():
    assert Template("a{{ 'b' ~ (1 + 1) }}{% if 1 == 2 %}{{ x }}{% elif true %}c{% else %}d{% endif %}").tree == [("text", "ab2c")]
    assert Template("{{ x ~ ('a' | upper) ~ 'b' }}c").tree == [("out", ("name", "x")), ("text", "Abc")]
    assert Template("{% if x and false %}a{% endif %}{{ true or x }}").tree[-1] == ("text", "true")


def test_messages_are_a_stream():
    seen = []

    def source():
        for k in range(5):
            seen.append(k)
            yield {"role": "user", "text": str(k)}

    out = Template("{{ first.text }}:{% for m in messages %}{{ loop.previous.text ~ m.text }}{% endfor %}").render(source())
    assert next(out) == "0" and seen == [0]
    assert "".join(out) == ":001122334"


def test_generation_marks():
    got = list(Template(chat.TEMPLATE).render([{"role": "user", "text": "q"}, {"role": "assistant", "text": "a</s>"}]))
    at = got.index(Mark.BEGIN)
    assert got[at : at + 3] == [Mark.BEGIN, "a<\\/s>", Mark.END]


def test_escape_goes_back():
    rng = random.Random(1)
    bits = [*chat.CONTROLS, "\\", "\\\\", "<", "s>", "/", "[", "INST]", "]", "<<", "x", "\n", " ", "ROLE"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(c in e for c in chat.CONTROLS)


def conversations():
    rng = random.Random(3)
    bits = [*chat.CONTROLS, "\\", "<", "/", " ", "\n", "word", "é👩", " [/INST] "]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "[ROLE]", None, ""]), rng.choice([None, "", text(), text()])) for c in (1, 2, 3, None, 2**62 + 5, -1) for t in range(rng.randint(1, 9))]
    rows += [(7, None, "assistant", "first"), (7, 0, "user", "b"), (7, 0, "user", "a"), (7, 0, "user", "a"), (8, 0, "assistant", "long " * 300_000), (8, 1, "user", "x" * 2_000_000)]
    return rows


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda y: (y[0], y[1].encode(), y[2].encode()))
        loss = [x for _, r, x in own if r == "assistant"]
        size = 0
        for _, r, x in own:
            e = len(chat.escape(x))
            size += {"user": len("[INST]  [/INST]") + e, "assistant": e + 4, "system": len("<<SYS>>  <</SYS>>") + e}.get(r, len("[ROLE]  [/ROLE] </s>") + e + len(chat.escape(r)))
        out[conv] = (len(own), sha("".join(f"{r}\n{x}\n" for _, r, x in own)), sum(map(len, loss)), sha("".join(loss)), size)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "s", True, 3) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("part", [1, 50, 1 << 20])
def test_conversations(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)
    rows = conversations()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.digest(table(spark, rows)).collect()}
    assert got == expected(rows)


def test_parts_and_spans(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a[INST]b")]
    r = chat.formatted(table(spark, rows)).first()
    assert r.text == "[INST] hi [/INST]a[\\INST]b</s>"
    assert [r.text[s.start : s.end] for s in r.spans] == ["a[\\INST]b"]
    r = chat.formatted(table(spark, rows), "{{ hello }}{% for m in messages %}{{ m.role ~ ':' ~ m.text ~ '\n' }}{% endfor %}", hello="H ").first()
    assert (r.text, r.spans) == ("H user:hi\nassistant:a[INST]b\n", [])


def test_one_conversation_of_many_turns(spark):
    rows = [(5, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(30_000)]
    got = chat.digest(table(spark, rows)).collect()
    assert len(got) == 1 and got[0].n_turns == 30_000 and got[0].loss_sha256 == sha("".join(x for _, _, r, x in rows if r == "assistant"))


def test_no_rows(spark):
    assert chat.digest(table(spark, [])).collect() == []
    with pytest.raises(TemplateError):
        chat.formatted(table(spark, []), "{{")
