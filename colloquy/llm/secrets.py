"""Secret scan: strong patterns alone, weak candidates only beside the other parts of a credential.

SQL functions alone. A credential has an identifier, a secret and perhaps an endpoint.
Every part spans a scope of ``SCOPE`` code points around it; weak candidates (long mixed
strings, shaped like secrets) are joined to those intervals by document and bin of offsets. One is
reported if an identifier's scope holds its first or last place, so a value longer than a
scope is linked too, or if both an endpoint's and a strong secret's do; each further kind
of part nearby raises its rank. An endpoint alone, as any link in a text, reports nothing.
A null text has no spans; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import materialize
from colloquy.llm.spans import joined, matches, overlaps, tagged

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
#: Further parts of a credential.
IDENT = r"""(?i)(?:client|account|user|access_?key)[_-]?id["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.-]{6,}"""
ENDPOINT = r"(?i)(?:https?|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[A-Za-z0-9._:@/-]{4,}"
#: Whole runs of 20 or more, dotted parts and padding included; not the full stop after one, nor a name before ``=value``.
WEAK = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-][A-Za-z0-9+/_.-]{18,}[A-Za-z0-9+/_-](?!\.*[A-Za-z0-9+/_-])(?!={1,2}[A-Za-z0-9+/_-])={0,2}"
SCOPE = 256
IDENTIFIERS = ("access", "ident")
KINDS = ("assign", "access", "hex", "weak")


def scanned(docs: DataFrame) -> DataFrame:
    """docs(key, text) -> key, base (spans), weak (candidates) and parts (identifiers, strong secrets and endpoints)."""
    df = docs.select("key", F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    t = F.col("_t")
    assign = F.filter(matches(t, ASSIGN, t.rlike("(?i)password|passwd|secret|token|api_?key"), 2), lambda s: F.length(s["part"]) >= 8)
    access, hexes = matches(t, ACCESS, t.contains("AKIA")), matches(t, HEX, t.rlike("[0-9a-f]{32}"))
    df = df.withColumns({"_assign": tagged(assign, "assign", 0), "_access": tagged(access, "access", 1), "_hex": tagged(hexes, "hex", 2)})
    ident, ends = matches(t, IDENT, t.rlike("(?i)(client|account|user|access_?key)[_-]?id")), matches(t, ENDPOINT, t.contains("://"))
    df = df.withColumns({"base": F.concat("_assign", "_access", "_hex"), "parts": F.concat("_assign", "_access", "_hex", tagged(ident, "ident", 4), tagged(ends, "endpoint", 5))})
    others = F.filter("parts", lambda p: p["ord"] > 2)
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[a-z]") & v.rlike("[A-Z]")
    some = F.exists("parts", lambda p: p["kind"].isin(*IDENTIFIERS) | (p["kind"] == "endpoint"))
    weak = F.filter(tagged(matches(t, WEAK, some), "weak", 3), lambda s: mixed(s["value"]) & ~overlaps(s, F.col("base")) & ~overlaps(s, others))
    return df.withColumn("weak", weak).select("key", "base", "weak", "parts")


def linked(rows: DataFrame) -> DataFrame:
    """The interval join: key, w, parts, rank for candidates of rows(key, weak, parts) with an identifier, or an endpoint and a strong secret, in scope.

    parts are the ``kind:start:end`` in scope, as many as fit into it; rank counts the kinds of part.
    """
    bins = lambda lo, hi: F.sequence(F.floor(lo / SCOPE), F.floor(hi / SCOPE))
    some = rows.where((F.size("weak") > 0) & (F.size("parts") > 0)).dropDuplicates(["key"])
    w = some.select("key", F.explode("weak").alias("w"))
    w = w.select("key", "w", F.explode(F.array_distinct(F.array(F.floor(F.col("w.start") / SCOPE), F.floor(F.col("w.end") / SCOPE)))).alias("bin")).repartition("key", "bin")
    p = some.select("key", F.explode("parts").alias("p")).select("key", "p", (F.col("p.start") - SCOPE).alias("lo"), (F.col("p.end") + SCOPE).alias("hi"))
    p = p.select("key", "p", "lo", "hi", F.explode(bins(F.col("lo"), F.col("hi"))).alias("bin"))
    within = w["w"]["start"].between(p["lo"], p["hi"]) | w["w"]["end"].between(p["lo"], p["hi"])
    met = w.hint("merge").join(p, (w["key"] == p["key"]) & (w["bin"] == p["bin"]) & within).select(w["key"], "w", "p")
    has = lambda *kinds: F.bool_or(F.col("p.kind").isin(*kinds))
    one = F.concat_ws(":", "p.kind", F.col("p.start").cast("string"), F.col("p.end").cast("string"))
    got = met.groupBy("key", "w").agg(
        has(*IDENTIFIERS).alias("ident"), has("endpoint").alias("endpoint"), has("assign", "hex").alias("secret"), F.sort_array(F.collect_set(one)).alias("parts")
    )
    got = got.where("ident OR (endpoint AND secret)")
    return got.select("key", "w", "parts", sum(F.col(c).cast("int") for c in ("ident", "endpoint", "secret")).alias("rank"))


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans, links) a document; spans has the base ones and the linked weak ones, links of each of these the parts and the rank."""
    # a null id is no number, so that rows with and without an id never share a key
    key = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.coalesce(F.col("text"), F.lit(""))), 256)
    wide = scanned(docs.select(F.struct(key.alias("id"), F.col("doc_id").alias("doc_id")).alias("key"), "text"))
    rows = materialize(wide.select(F.col("key.doc_id").alias("doc_id"), F.col("key.id").alias("key"), "base", "weak", "parts"))
    link = F.concat(F.lit("weak:"), F.col("w.start").cast("string"), F.lit(":"), F.col("w.end").cast("string"), F.lit("="), F.array_join("parts", "+"), F.lit("#"), F.col("rank").cast("string"))
    added = linked(rows).groupBy("key").agg(F.collect_list("w").alias("added"), F.sort_array(F.collect_list(F.struct(F.col("w.start"), link.alias("link")))).alias("links"))
    out = rows.hint("merge").join(added, "key", "left")
    none = F.filter("base", lambda s: F.lit(False))
    links = F.coalesce(F.array_join(F.transform("links", lambda x: x["link"]), ","), F.lit(""))
    return out.select("doc_id", "base", F.concat(F.col("base"), F.coalesce(F.col("added"), none)).alias("spans"), links.alias("links"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's row for each document, and the parts that each weak span was linked to."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found(docs.select("doc_id", "text")).select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "links")
