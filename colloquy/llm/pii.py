"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

SQL functions alone. Words on either side raise a span's score (CONTEXT) or lower it
(AGAINST), and of both kinds the word that stands nearest decides, for the span if they are as
near: telephone numbers, social security numbers and passport numbers stand or fall by
them, while a checksum outweighs them. Offsets are code points. A null text has no
spans; repeated rows give repeated results; extra columns pass through, whatever their
names, but for base and spans, which the results replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.spans import joined, matches, overlaps, tagged

# A match can only begin where a run of its characters begins or where the last match
# ended (\G), so the engine doesn't try every place inside a run; the matches are the same.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
TEL = r"(?<![0-9A-Za-z+-])\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}(?![0-9-])"
PASSPORT = r"(?<![0-9A-Za-z-])[A-Z]{1,2}[0-9]{7,8}(?![0-9A-Za-z-])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"

KINDS = ("email", "ip", "card", "phone", "iban", "tel", "ssn", "passport")
BASE = 4
#: Prior score of a confirmed span, and the words nearby that raise it.
PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "tel": 0.6, "ssn": 0.4, "passport": 0.2}
CONTEXT = {
    "email": "mail|contact", "ip": "address|host|server", "card": "card|visa|credit|payment", "phone": "phone|call|tel|mobile",
    "iban": "iban|bank|account", "tel": "phone|call|tel|mobile|fax", "ssn": "ssn|social|security|insurance", "passport": "passport|travel document",
}
#: Words nearby that lower it: numbers of things, not of people.
AGAINST = r"\b(?:order|invoice|part|serial|model|version|isbn|ticket|sku|build)\b"
BEFORE, AFTER, LIFT, DROP, THRESHOLD = 48, 24, 0.3, 0.3, 0.5


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when((n - i) % 2 == 1, doubled(value(i))).otherwise(value(i)))
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes its check: letters count as 10 to 35, the first four characters go last."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    code = lambda i: F.ascii(F.substring(turned, i, F.lit(1)))
    rest = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)),
        F.lit(0),
        lambda a, i: F.when(code(i) < 58, (a * 10 + code(i) - 48) % 97).otherwise((a * 100 + code(i) - 55) % 97),
    )
    return rest == 1


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _ip_ok(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))


def found(docs: DataFrame) -> DataFrame:
    """docs with base and spans: array<struct<start, ord, kind, end, value, score>>; spans has the base ones and the added ones."""
    df = docs.select(F.struct("*").alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    t = F.col("_t")
    many = t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")
    between = lambda n, lo, hi: (n >= lo) & (n <= hi)
    email = matches(t, EMAIL, t.contains("@"))
    ip = F.filter(matches(t, IP, t.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")), lambda s: _ip_ok(s["value"]))
    card = F.filter(matches(t, CARD, many), lambda s: F.when(between(F.length(_digits(s["value"])), 14, 19), luhn(_digits(s["value"]))).otherwise(False))
    phone = F.filter(matches(t, PHONE, t.contains("+")), lambda s: between(F.length(_digits(s["value"])), 10, 15))
    iban = F.filter(matches(t, IBAN, t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}")), lambda s: mod97(F.regexp_replace(s["value"], " ", "")))
    tel = matches(t, TEL, t.rlike(r"\([0-9]{3}\)"))
    ssn = matches(t, SSN, t.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}"))
    passport = matches(t, PASSPORT, t.rlike("[A-Z][0-9]{7}"))
    each = (email, ip, card, phone, iban, tel, ssn, passport)
    df = df.withColumns({f"_{k}": tagged(c, k, i) for i, (k, c) in enumerate(zip(KINDS, each, strict=True))})
    df = df.withColumn("_base", F.concat(*(f"_{k}" for k in KINDS[:BASE])))
    of = lambda table, kind: F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), kind)

    def score(s: Column) -> Column:
        before = F.substring(t, F.greatest(s["start"] + 1 - BEFORE, F.lit(1)), F.least(s["start"], F.lit(BEFORE)))
        before, after = F.lower(before), F.lower(F.substring(t, s["end"] + 1, F.lit(AFTER)))

        def distance(words: Column) -> Column:
            """Characters between the span and the nearest of the words; null without one."""
            gap = lambda side, head, tail: F.when(F.regexp_like(side, words), F.length(F.call_function("regexp_extract", side, F.concat(F.lit(head), words, F.lit(tail)), F.lit(1))))
            return F.least(gap(before, r"(?s)\A.*(?:", r")(.*)\z"), gap(after, r"(?s)\A(.*?)(?:", ")"))

        up, down = distance(of(CONTEXT, s["kind"])), distance(F.lit(AGAINST))
        shift = F.when(up.isNull() & down.isNull(), 0.0).when(down.isNull() | (up <= down), LIFT).otherwise(-DROP)
        return F.round(F.least(F.lit(1.0), of(PRIOR, s["kind"]) + shift), 2)

    more = F.concat(*(f"_{k}" for k in KINDS[BASE:]))
    added = F.filter(more, lambda s: ~overlaps(s, F.col("_base")))
    scored = F.transform(F.concat(F.col("_base"), added), lambda s: s.withField("score", score(s)))
    df = df.withColumn("_all", F.when(F.size(F.concat("_base", more)) > 0, scored))
    none = F.filter(F.transform("_base", lambda s: s.withField("score", F.lit(0.0))), lambda s: F.lit(False))
    keep = F.filter("_all", lambda s: (s["ord"] < BASE) | (s["score"] >= THRESHOLD))
    rest = [F.col("_doc")[c].alias(c) for c in docs.columns if c not in ("base", "spans")]
    return df.select(*rest, F.coalesce(F.filter("_all", lambda s: s["ord"] < BASE), none).alias("base"), F.coalesce(keep, none).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row for each document, and the scores of its spans in their order."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    scores = F.array_join(F.transform(F.sort_array("spans"), lambda s: s["score"].cast("string")), ",")
    return found(docs.select("doc_id", "text")).select("doc_id", *(count(k) for k in KINDS[:BASE]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    df = found(docs.select(F.struct("*").alias("_doc"), "text"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        cut = F.array(F.substring(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        fresh = F.struct(s["end"].alias("at"), F.concat(a["out"], cut).alias("out"))
        return F.when(s["start"] >= a["at"], fresh).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))

    clean = F.aggregate(F.sort_array("spans"), zero, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    text = F.when(F.size("spans") > 0, clean).otherwise(F.col("text")).alias("text")
    return df.select(*(text if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns))
