"""Rewards over logged dialogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.numeric import r6
from colloquy.operators import rewards as W
from colloquy.operators import tokens as K
from colloquy.plans.base import query
from colloquy.sources.cache import cut
from colloquy.sources.views import view

T = ("episode_turns",)
TK = ("episode_turns", "kg_edges")


def _turns(t: DataFrame) -> DataFrame:
    """Diagnoses name the disease in half of the episodes; some facts are unknown, some hold a further one, some are none of the graph's."""
    k = F.col("turn_id")
    fact = F.when(k % 11 == 10, F.lit("unknown")).when(k % 5 == 4, F.concat("fact", F.lit(" and finding 7 today"))).when(k % 7 == 6, F.concat(F.lit("odd "), k.cast("string"))).otherwise(F.col("fact"))
    return t.withColumns({"diagnosis": F.when(F.length("episode_id") % 2 == 0, F.col("disease")).otherwise(F.lit("something else")), "fact": fact})


def _graph_rewards(spark: SparkSession, sf: str) -> DataFrame:
    t = cut(view(spark, sf, "episode_turns").select("episode_id", "disease", "turn_id", "fact", "action"))  # read three times
    return W.graph_turn_rewards(_turns(t), _edges(spark, sf), t.where("turn_id = 3").select("episode_id", "disease", "fact"))


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "kg_edges").select("disease", "symptom", "weight")


@query("e19", "SELECT episode_id, turn_id, row_number() OVER (PARTITION BY episode_id, fact ORDER BY turn_id) = 1 AND fact NOT LIKE '%0' AS is_new FROM episode_turns", T)
def e19(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "episode_turns")
    known = t.where(F.col("fact").endswith("0")).select("episode_id", "fact")
    return W.first_mentions(t, known).select("episode_id", "turn_id", "is_new")


@query(
    "e20",
    """SELECT episode_id, turn_id, CAST(sum(n) OVER (PARTITION BY episode_id ORDER BY turn_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_collected FROM (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY episode_id, fact ORDER BY turn_id) = 1 THEN 1 ELSE 0 END AS n FROM episode_turns) t""",
    T,
)
def e20(spark: SparkSession, sf: str) -> DataFrame:
    d = W.first_mentions(view(spark, sf, "episode_turns"))
    return W.running(d, F.col("is_new").cast("long"), "n_collected").select("episode_id", "turn_id", "n_collected")


@query("e23", "SELECT episode_id, turn_id, turn_id = max(turn_id) OVER (PARTITION BY episode_id) AS is_final FROM episode_turns", T)
def e23(spark: SparkSession, sf: str) -> DataFrame:
    return W.final_flag(view(spark, sf, "episode_turns")).select("episode_id", "turn_id", "is_final")


#: What each turn's fact adds: itself if the disease has it, else the graph's symptoms whose words it holds, else the fact as it is.
_ITEMS = """x AS (SELECT episode_id, disease, turn_id, action, CASE WHEN turn_id % 11 = 10 THEN 'unknown' WHEN turn_id % 5 = 4 THEN fact || ' and finding 7 today' WHEN turn_id % 7 = 6 THEN 'odd ' || CAST(turn_id AS VARCHAR) ELSE fact END AS fact,
  turn_id = max(turn_id) OVER (PARTITION BY episode_id) AS is_final FROM episode_turns),
own AS (SELECT x.*, k.symptom IS NOT NULL AS own FROM x LEFT JOIN kg_edges k ON k.disease = x.disease AND k.symptom = x.fact),
hit AS (SELECT u.fact, s.symptom FROM (SELECT DISTINCT fact FROM own WHERE NOT own AND fact <> 'unknown') u JOIN (SELECT DISTINCT symptom FROM kg_edges) s ON contains(' ' || u.fact || ' ', ' ' || s.symptom || ' ')),
item AS (SELECT episode_id, disease, turn_id, fact AS item, 'own' AS source FROM own WHERE own
  UNION ALL SELECT o.episode_id, o.disease, o.turn_id, coalesce(hit.symptom, o.fact), CASE WHEN hit.symptom IS NULL THEN 'verbatim' ELSE 'other' END FROM own o LEFT JOIN hit ON hit.fact = o.fact WHERE NOT own AND o.fact <> 'unknown')"""

_I1 = f"""WITH {_ITEMS},
u AS (SELECT disease, symptom, CAST(round(weight * 1000000000) AS BIGINT) AS w FROM kg_edges),
tot AS (SELECT disease, sum(w) AS total FROM u GROUP BY 1),
st AS (SELECT DISTINCT e.episode_id, e.disease, e.fact AS item FROM episode_turns e JOIN kg_edges k ON k.disease = e.disease AND k.symptom = e.fact WHERE e.turn_id = 3),
fi AS (SELECT i.episode_id, i.disease, i.item, min(i.turn_id) AS t0 FROM item i LEFT JOIN st ON st.episode_id = i.episode_id AND st.item = i.item WHERE st.item IS NULL GROUP BY 1, 2, 3 UNION ALL SELECT episode_id, disease, item, -1 FROM st),
g AS (SELECT fi.*, coalesce(u.w, 0) AS w FROM fi LEFT JOIN u ON u.disease = fi.disease AND u.symptom = fi.item),
b AS (SELECT episode_id, t0, sum(w) AS gain, count(*) AS n FROM g GROUP BY 1, 2),
c AS (SELECT x.*, coalesce(tot.total, 0) AS total, coalesce(b.gain, 0) / tot.total AS delta, coalesce(s0.gain, 0) + sum(coalesce(b.gain, 0)) OVER w AS hit, sum(coalesce(b.n, 0)) OVER w AS n_new, coalesce(f2.t0 < x.turn_id, false) AS again,
        x.is_final AND x.action = 'diagnose' AND length(x.episode_id) % 2 = 0 AS is_correct
      FROM x LEFT JOIN b ON b.episode_id = x.episode_id AND b.t0 = x.turn_id LEFT JOIN b s0 ON s0.episode_id = x.episode_id AND s0.t0 = -1 LEFT JOIN fi f2 ON f2.episode_id = x.episode_id AND f2.item = x.fact LEFT JOIN tot ON tot.disease = x.disease
      WINDOW w AS (PARTITION BY x.episode_id ORDER BY x.turn_id ROWS UNBOUNDED PRECEDING)),
r AS (SELECT * REPLACE (coalesce(delta, 0) AS delta), coalesce(hit / nullif(total, 0), 0) AS coverage, CASE WHEN NOT is_final THEN 0.0 WHEN action <> 'diagnose' THEN -2.0 WHEN is_correct THEN 1.0 ELSE 0.0 END AS r_diag, is_correct AND NOT (10 * hit >= 6 * total AND n_new >= 2) AS premature FROM c)
"""


@query("i1", _I1 + "SELECT episode_id, turn_id, round(coverage, 6) + 0.0 AS coverage, CAST(n_new AS BIGINT) AS n_new, round(0.4 * delta + r_diag, 6) + 0.0 AS reward, is_correct, premature, again AND NOT is_final AS is_duplicate FROM r", TK)
def i1(spark: SparkSession, sf: str) -> DataFrame:
    d = _graph_rewards(spark, sf)
    return d.select("episode_id", "turn_id", r6("coverage").alias("coverage"), "n_new", r6("reward").alias("reward"), "is_correct", "premature", "is_duplicate")


@query(
    "d8",
    _I1
    + """SELECT episode_id, round(sum(delta), 6) + 0.0 AS delta_sum, round(avg(CASE WHEN action IN ('ask', 'diagnose') THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS valid_format_rate,
round(max(coverage), 6) + 0.0 AS coverage, bool_or(is_correct) AS is_correct, bool_or(premature) AS premature, count(*) AS turn_count FROM r GROUP BY episode_id""",
    TK,
)
def d8(spark: SparkSession, sf: str) -> DataFrame:
    m = W.episode_metrics(_graph_rewards(spark, sf))
    return m.select("episode_id", r6("delta_sum").alias("delta_sum"), r6("valid_format_rate").alias("valid_format_rate"), r6("coverage").alias("coverage"), "is_correct", "premature", "turn_count")


@query(
    "d31",
    """SELECT episode_id, array_to_string(list(fact || ':' || action ORDER BY turn_id), ',') AS turns FROM episode_turns GROUP BY episode_id""",
    T,
)
def d31(spark: SparkSession, sf: str) -> DataFrame:
    t = W.trajectories(view(spark, sf, "episode_turns").select("episode_id", "turn_id", "fact", "action"))
    return t.select("episode_id", F.array_join(F.transform("turns", lambda x: F.concat_ws(":", x["fact"], x["action"])), ",").alias("turns"))


_I3 = """WITH t AS (SELECT episode_id, turn_id, fact, CASE action WHEN 'diagnose' THEN 'answer' ELSE action END AS action, chr(CAST(65 + length(fact) % 3 AS INT)) AS answer, 'A' AS answer_idx,
                turn_id = max(turn_id) OVER (PARTITION BY episode_id) AS is_final FROM episode_turns),
f AS (SELECT DISTINCT e.episode_id, k.symptom AS fact FROM (SELECT DISTINCT episode_id, disease FROM episode_turns) e JOIN kg_edges k ON k.disease = e.disease),
n AS (SELECT episode_id, count(*) AS n_facts FROM f GROUP BY 1),
d AS (SELECT t.*, f.fact IS NOT NULL AS own, coalesce(n_facts, 0) AS n_facts FROM t LEFT JOIN f ON f.episode_id = t.episode_id AND f.fact = t.fact LEFT JOIN n ON n.episode_id = t.episode_id),
k AS (SELECT *, row_number() OVER (PARTITION BY episode_id, fact, action = 'ask' AND own ORDER BY turn_id) AS k FROM d),
r AS (SELECT *, action = 'ask' AND NOT own AS is_unknown, action = 'ask' AND own AND k > 1 AS is_duplicate, CASE WHEN action = 'ask' AND own AND k = 1 THEN 1.0 / greatest(n_facts, 1) ELSE 0.0 END AS delta,
        CASE WHEN NOT is_final THEN 0.0 WHEN action <> 'answer' THEN -2.0 WHEN answer = answer_idx THEN 1.0 ELSE 0.0 END AS r_diag FROM k)
"""


def _fact_rewards(spark: SparkSession, sf: str) -> DataFrame:
    t = cut(view(spark, sf, "episode_turns").select("episode_id", "disease", "turn_id", "fact", "action"))  # read twice below
    facts = t.select("episode_id", "disease").distinct().join(_edges(spark, sf), "disease").select("episode_id", F.col("symptom").alias("fact"))
    t = t.withColumns({"action": F.when(F.col("action") == "diagnose", "answer").otherwise(F.col("action")), "answer": F.chr(65 + F.length("fact") % 3), "answer_idx": F.lit("A")})
    return W.fact_turn_rewards(t, facts)


@query("i3", _I3 + "SELECT episode_id, turn_id, is_unknown, is_duplicate, round(0.4 * delta + r_diag, 6) + 0.0 AS reward FROM r", TK)
def i3(spark: SparkSession, sf: str) -> DataFrame:
    return _fact_rewards(spark, sf).select("episode_id", "turn_id", "is_unknown", "is_duplicate", r6("reward").alias("reward"))


@query(
    "d9",
    _I3
    + """SELECT episode_id, count(*) AS turn_count, round(sum(0.4 * delta + r_diag), 6) + 0.0 AS reward_sum, round(avg(0.4 * delta + r_diag), 6) + 0.0 AS reward_mean, round(sum(delta), 6) + 0.0 AS delta_sum, round(arg_max(r_diag, turn_id), 6) + 0.0 AS r_diag,
bool_or(is_final AND action = 'answer' AND answer = answer_idx) AS is_correct, bool_or(action = 'answer') AS answered, round(avg(CASE WHEN action IN ('ask', 'answer') THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS valid_format_rate,
round(avg(CASE WHEN turn_id % 4 = 3 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS no_eos_rate,
round(CAST(count(*) FILTER (WHERE is_unknown) AS DOUBLE) / greatest(count(*) FILTER (WHERE action = 'ask'), 1), 6) + 0.0 AS unknown_rate,
round(CAST(count(*) FILTER (WHERE is_duplicate) AS DOUBLE) / greatest(count(*) FILTER (WHERE action = 'ask'), 1), 6) + 0.0 AS duplicate_rate,
round(CAST(count(*) FILTER (WHERE action = 'ask' AND own AND k = 1) AS DOUBLE) / greatest(max(n_facts), 1), 6) + 0.0 AS fact_coverage FROM r GROUP BY 1""",
    TK,
)
def d9(spark: SparkSession, sf: str) -> DataFrame:
    m = W.fact_metrics(_fact_rewards(spark, sf).withColumn("is_no_eos", F.col("turn_id") % 4 == 3))
    return m.select(*(c if c in ("episode_id", "turn_count", "is_correct", "answered") else r6(c).alias(c) for c in m.columns))


_I4 = """WITH t AS (SELECT sample_id, text, CASE CAST(sample_id % 5 AS INT) WHEN 0 THEN '<Normal>' WHEN 1 THEN '<Repeated>' WHEN 2 THEN '<Timeout>' WHEN 3 THEN '<HUMAN_Timeout>' END AS verifier, answer_idx FROM (
  SELECT sample_id, CASE CAST(sample_id % 3 AS INT) WHEN 0 THEN text WHEN 1 THEN concat('<think>y</think> Final Answer: ', answer_idx) ELSE concat('<think>z</think>Question: ', text) END AS text, answer_idx FROM model_outputs) u),
a AS (SELECT *, trim(regexp_extract(text, '(?is)<think>.*?</think>(.*)$', 1)) AS tail FROM t),
k AS (SELECT *, CASE WHEN starts_with(tail, 'Question:') THEN 'question' WHEN starts_with(tail, 'Final Answer:') THEN 'final_answer' END AS kind FROM a),
r AS (SELECT *, CASE WHEN kind IS NULL THEN 0.0 WHEN kind = 'final_answer' THEN 1.0 ELSE 0.1 + CASE WHEN verifier = '<Timeout>' THEN 0.2 WHEN verifier = '<HUMAN_Timeout>' THEN 0.4 WHEN verifier = '<Normal>' THEN 0.9 ELSE 0.0 END END AS process_reward,
        coalesce(kind = 'final_answer' AND upper(trim(substr(tail, 14))) = answer_idx, false) AS is_correct FROM k)
"""


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    m = view(spark, sf, "model_outputs")
    k = F.col("sample_id") % 3
    text = F.when(k == 0, F.col("text")).when(k == 1, F.concat(F.lit("<think>y</think> Final Answer: "), "answer_idx")).otherwise(F.concat(F.lit("<think>z</think>Question: "), "text"))
    v = F.col("sample_id") % 5
    tag = F.when(v == 0, "<Normal>").when(v == 1, "<Repeated>").when(v == 2, "<Timeout>").when(v == 3, "<HUMAN_Timeout>")
    return W.verifier_rewards(m.select("sample_id", text.alias("text"), tag.alias("verifier"), F.lit("yes").alias("patient"), "answer_idx", F.lit(False).alias("is_final")))


@query("i4", _I4 + "SELECT sample_id, kind IS NOT NULL AS valid, round(process_reward, 6) + 0.0 AS process_reward, is_correct FROM r", ("model_outputs",))
def i4(spark: SparkSession, sf: str) -> DataFrame:
    return _verified(spark, sf).select("sample_id", "valid", r6("process_reward").alias("process_reward"), "is_correct")


@query(
    "d10",
    _I4
    + """, v AS (SELECT *, CAST(sample_id // 6 AS BIGINT) AS episode_id, sample_id = max(sample_id) OVER (PARTITION BY sample_id // 6) AS fin, sample_id % 7 <> 0 AS fine,
  CASE CAST(sample_id % 6 AS INT) WHEN 0 THEN '<Normal>' WHEN 1 THEN '<Repeated>' WHEN 2 THEN '<Timeout>' WHEN 3 THEN '<HUMAN_Timeout>' WHEN 4 THEN '<Multiple>' END AS tag FROM k),
e AS (SELECT *, CASE WHEN kind IS NULL THEN 'format' WHEN tag IS NULL THEN 'error' WHEN tag = '<Normal>' AND fine THEN 'effective' WHEN tag = '<Normal>' THEN 'reject' ELSE tag END AS what FROM v)
SELECT episode_id, count(*) AS turn_count, """
    + ", ".join(
        f"round(CAST(count(*) FILTER (WHERE NOT fin AND what = '{what}') AS DOUBLE) / greatest(count(*) FILTER (WHERE NOT fin), 1), 6) + 0.0 AS {name}_rate"
        for name, what in (("incorrect_format", "format"), ("multiple", "<Multiple>"), ("repeated", "<Repeated>"), ("verify_timeout", "<Timeout>"), ("effective", "effective"), ("human_reject", "reject"), ("human_timeout", "<HUMAN_Timeout>"), ("assistant_error", "error"))
    )
    + """, coalesce(bool_or(fin AND kind = 'final_answer'), false) AS is_valid, bool_or(fin AND coalesce(kind = 'final_answer' AND upper(trim(substr(tail, 14))) = answer_idx, false)) AS is_correct FROM e GROUP BY 1""",
    ("model_outputs",),
)
def d10(spark: SparkSession, sf: str) -> DataFrame:
    """Six turns an episode; every seventh patient refuses."""
    m, k = view(spark, sf, "model_outputs"), F.col("sample_id")
    text = F.when(k % 3 == 0, F.col("text")).when(k % 3 == 1, F.concat(F.lit("<think>y</think> Final Answer: "), "answer_idx")).otherwise(F.concat(F.lit("<think>z</think>Question: "), "text"))
    tag = F.when(k % 6 == 0, "<Normal>").when(k % 6 == 1, "<Repeated>").when(k % 6 == 2, "<Timeout>").when(k % 6 == 3, "<HUMAN_Timeout>").when(k % 6 == 4, "<Multiple>")
    d = m.select(F.floor(k / 6).alias("episode_id"), k.alias("turn_id"), text.alias("text"), tag.alias("verifier"), F.when(k % 7 != 0, "yes").alias("patient"), "answer_idx")
    e = W.verifier_metrics(W.verifier_rewards(W.final_flag(d)))
    return e.select(*(r6(c).alias(c) if c.endswith("_rate") else c for c in e.columns))


_FACTS = "u AS (SELECT episode_id, concat('F', right(fact, 2)) AS fact_id, min(fact) AS text FROM episode_turns WHERE turn_id < 2 GROUP BY 1, 2)"


@query(
    "c1",
    f"""WITH {_FACTS}, g AS (SELECT episode_id, lower(trim(text)) AS k, min(fact_id) AS id FROM u GROUP BY 1, 2),
t AS (SELECT episode_id, turn_id, concat('F', right(fact, 2 - CAST(turn_id % 2 AS INT))) AS fact_id, CASE WHEN turn_id % 3 > 0 THEN upper(fact) END AS fact_text FROM episode_turns)
SELECT t.episode_id, t.turn_id, coalesce(u.text, fact_text, 'unknown') AS text, coalesce(u.fact_id, g.id, 'unknown') AS checked_id
FROM t LEFT JOIN u ON u.episode_id = t.episode_id AND u.fact_id = t.fact_id LEFT JOIN g ON g.episode_id = t.episode_id AND g.k = lower(trim(fact_text))""",
    T,
)
def c1(spark: SparkSession, sf: str) -> DataFrame:
    """Also C21: the id checked against the case."""
    t = view(spark, sf, "episode_turns")
    facts = t.where("turn_id < 2").groupBy("episode_id", F.concat(F.lit("F"), F.right("fact", F.lit(2))).alias("fact_id")).agg(F.min("fact").alias("text"))
    turns = t.select("episode_id", "turn_id", F.concat(F.lit("F"), F.right("fact", (2 - F.col("turn_id") % 2).cast("int"))).alias("fact_id"), F.when(F.col("turn_id") % 3 > 0, F.upper("fact")).alias("fact_text"))
    return W.link_facts(turns, facts).select("episode_id", "turn_id", "text", "checked_id")


@query(
    "c11",
    """WITH q AS (SELECT conv_id, turn, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS t FROM conversations WHERE role = 'user'),
p AS (SELECT a.conv_id, a.turn, max(CASE WHEN len(a.t) > 0 AND len(b.t) > 0 AND CAST(len(list_intersect(a.t, b.t)) AS DOUBLE) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) > 0.2 THEN 1 ELSE 0 END) AS again
      FROM q a JOIN q b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY 1, 2)
SELECT q.conv_id, q.turn, CASE WHEN coalesce(again, 0) = 1 THEN '<Repeated>' WHEN length(text) - length(replace(text, '?', '')) > 1 THEN '<Multiple>' ELSE '<Normal>' END AS verifier FROM q LEFT JOIN p ON p.conv_id = q.conv_id AND p.turn = q.turn""",
)
def c11(spark: SparkSession, sf: str) -> DataFrame:
    q = view(spark, sf, "dialogue").where("role = 'user'")
    return W.question_checks(q, 0.2).select("conv_id", "turn", "verifier")


@query("c13", "SELECT c.tree_id, c.node_id, p.critic_value AS parent_value FROM tree_nodes c JOIN tree_nodes p ON p.tree_id = c.tree_id AND p.node_id = c.parent_id", ("tree_nodes",))
def c13(spark: SparkSession, sf: str) -> DataFrame:
    n = view(spark, sf, "tree_nodes")
    p = n.select("tree_id", F.col("node_id").alias("parent_id"), F.col("critic_value").alias("parent_value"))
    return n.join(p, ["tree_id", "parent_id"]).select("tree_id", "node_id", "parent_value")


@query(
    "i5",
    """WITH o AS (SELECT *, pos - row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS g FROM token_logs WHERE mask = 1),
r AS (SELECT sample_id, max(pos) AS e FROM o GROUP BY sample_id, g), k AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY e) - 1 AS turn_id, max(e) OVER (PARTITION BY sample_id) AS last FROM r),
t AS (SELECT DISTINCT sample_id, unnest(range(3)) AS turn_id FROM token_logs),
l AS (SELECT DISTINCT sample_id, last FROM k)
SELECT t.sample_id, coalesce(k.e, l.last) AS pos, round(sum((t.turn_id + 1) / 10.0), 6) + 0.0 AS reward FROM t JOIN l ON l.sample_id = t.sample_id LEFT JOIN k ON k.sample_id = t.sample_id AND k.turn_id = t.turn_id GROUP BY 1, 2""",
    ("token_logs",),
)
def i5(spark: SparkSession, sf: str) -> DataFrame:
    logs = view(spark, sf, "token_logs")
    turns = logs.select("sample_id").distinct().withColumn("turn_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("reward", (F.col("turn_id") + 1) / 10.0)
    return W.place_rewards(turns, K.spans(logs), "reward").select("sample_id", "pos", r6("reward").alias("reward"))


@query(
    "c12",
    """WITH q AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 3)) AS w FROM conversations WHERE role = 'user'),
f AS (SELECT conv_id, turn AS fact_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: length(x) > 3)) AS w FROM conversations WHERE role = 'assistant'),
s AS (SELECT q.conv_id, q.turn, f.fact_id, len(list_intersect(q.w, f.w)) - CASE WHEN f.fact_id < q.turn THEN 0.25 ELSE 0 END AS score FROM q JOIN f ON f.conv_id = q.conv_id)
SELECT conv_id, turn, fact_id FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, fact_id) = 1""",
)
def c12(spark: SparkSession, sf: str) -> DataFrame:
    """Questions linked to the statement that shares most words; statements already made count a quarter less."""
    d = view(spark, sf, "dialogue").withColumn("words", F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: F.length(x) > 3)))
    q, f = d.where("role = 'user'").select("conv_id", "turn", "words"), d.where("role = 'assistant'").select("conv_id", F.col("turn").alias("fact_id"), "words")
    return W.best_statements(q, f)


@query("c2", f"WITH {_ITEMS} SELECT episode_id, turn_id, item, source FROM item", TK)
def c2(spark: SparkSession, sf: str) -> DataFrame:
    """A fact counts as the disease's own symptom, else as those that the graph's dictionary finds in it, else verbatim."""
    return W.collected(_turns(view(spark, sf, "episode_turns")), _edges(spark, sf)).select("episode_id", "turn_id", "item", "source")


@query(
    "i2",
    """WITH t AS (SELECT *, turn_id = max(turn_id) OVER (PARTITION BY episode_id) AS is_final FROM episode_turns),
m AS (SELECT episode_id, disease, turn_id, fact FROM t WHERE turn_id % 3 <> 0 UNION ALL SELECT episode_id, disease, turn_id, 'finding 7' FROM t WHERE turn_id % 4 = 1 AND NOT (turn_id % 3 = 0 AND fact = 'finding 7')),
f AS (SELECT m.episode_id, m.disease, m.fact, k.weight, min(m.turn_id) AS turn_id FROM m JOIN kg_edges k ON k.disease = m.disease AND k.symptom = m.fact GROUP BY 1, 2, 3, 4),
s AS (SELECT disease, sum(weight) AS total FROM kg_edges GROUP BY 1),
g AS (SELECT episode_id, turn_id, sum(weight / total) AS delta FROM f JOIN s ON s.disease = f.disease GROUP BY 1, 2)
SELECT t.episode_id, t.turn_id, round(0.4 * coalesce(delta, 0) + CASE WHEN NOT is_final THEN 0 WHEN action <> 'diagnose' THEN -2.0 WHEN length(t.episode_id) % 2 = 0 THEN 1.0 ELSE 0.0 END, 6) + 0.0 AS reward
FROM t LEFT JOIN g ON g.episode_id = t.episode_id AND g.turn_id = t.turn_id""",
    TK,
)
def i2(spark: SparkSession, sf: str) -> DataFrame:
    """Facts out of sentences of several forms; every third turn denies its fact, every fourth tells of a second one far from the denial."""
    k = F.col("turn_id")
    t = cut(view(spark, sf, "episode_turns").select("episode_id", "disease", "turn_id", "fact", "action"))  # read twice
    t = t.withColumn("diagnosis", F.when(F.length("episode_id") % 2 == 0, F.col("disease")).otherwise(F.lit("something else")))
    head = F.when(k % 3 == 0, "he has no ").when(k % 3 == 1, "he has had ").otherwise("since the day before yesterday there is ")
    tail = F.when(k % 4 == 1, " but as he says himself all the time there is finding 7 too").when(k % 4 == 2, "").otherwise(" today")
    return W.text_turn_rewards(t.withColumn("text", F.concat(head, "fact", tail)), _edges(spark, sf)).select("episode_id", "turn_id", r6("reward").alias("reward"))


