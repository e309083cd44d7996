"""Text functions and row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.functions import parsing as P
from colloquy.functions import texts as T
from colloquy.functions.numeric import r6
from colloquy.operators import scoring as S
from colloquy.plans.base import query
from colloquy.sources.views import table, view

Q = ("qa_cases",)
M = ("model_outputs",)
_N1 = "trim(regexp_replace(lower({0}), '[^a-z0-9 \\-'']', ' ', 'g'))"
_N2 = "trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9 ''\\-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _sql_list(words: tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _alt(words: tuple[str, ...]) -> str:
    return "|".join(words).replace("'", "''")


@query("h1", f"SELECT doc_id, {_N1.format('user_content')} AS h1, {_N2.format('user_content')} AS h2 FROM qa_cases", Q)
def h1(spark: SparkSession, sf: str) -> DataFrame:
    """H1 and H2 side by side."""
    return view(spark, sf, "qa_cases").select("doc_id", T.normalized(F.col("user_content")).alias("h1"), T.collapsed(F.col("user_content")).alias("h2"))


@query(
    "h3",
    f"""WITH t AS (SELECT DISTINCT name, list_filter(string_split({_N2.format("regexp_replace(name, '\\([^)]*\\)', ' ', 'g')")}, ' '), lambda x: x <> '') AS w FROM (SELECT concat('Acute ', p_type, ' (', p_brand, ') type 2') AS name FROM part) u),
k AS (SELECT name, w, list_filter(w, lambda x: x NOT IN ({_sql_list(T.GROUP_STOPWORDS)}) AND NOT regexp_full_match(x, '[0-9]+')) AS kept FROM t)
SELECT name, array_to_string((CASE WHEN len(kept) > 0 THEN kept ELSE w END)[1:3], ' ') AS group_key FROM k""",
)
def h3(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "part").select(F.concat(F.lit("Acute "), "p_type", F.lit(" ("), "p_brand", F.lit(") type 2")).alias("name")).distinct()
    return n.select("name", T.group_key(F.col("name")).alias("group_key"))


#: Every piece of every text between line ends and stops, behind a word that the filters look at.
_NAMES = """n AS (SELECT DISTINCT CASE CAST(length(x) % 6 AS INT) WHEN 0 THEN 'serum ' WHEN 1 THEN 'mild ' WHEN 2 THEN 'study of ' WHEN 3 THEN '5 mg ' WHEN 4 THEN 'adult ' ELSE 'a, ' END || x AS name
  FROM (SELECT unnest(regexp_split_to_array(text, '[.;!?\n]+')) AS x FROM documents) t WHERE x <> '')"""


def _names(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.explode(F.split("text", r"[.;!?\n]+")).alias("x")).where("x <> ''")
    k = F.length("x") % 6
    head = F.when(k == 0, "serum ").when(k == 1, "mild ").when(k == 2, "study of ").when(k == 3, "5 mg ").when(k == 4, "adult ").otherwise("a, ")
    return d.select(F.concat(head, "x").alias("name")).distinct()


def _type_sql(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{_alt(tuple(f'(?:{p})' for p in ps))}') THEN '{label}'" for label, ps in T.SYMPTOM_TYPES.items()) + " ELSE 'patient_reportable' END"


@query("b5", f"WITH {_NAMES} SELECT name, {_type_sql(_N2.format('name'))} AS symptom_type FROM n")
def b5(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("name", T.symptom_type(F.col("name")).alias("symptom_type"))


@query(
    "b4",
    f"""WITH {_NAMES}, s AS (SELECT name, {_N2.format('name')} AS s FROM n)
SELECT name, length(s) BETWEEN 3 AND 80 AND NOT contains(name, ',') AND len(list_filter(string_split(s, ' '), lambda x: x <> '')) <= 8 AND NOT regexp_matches(s, '[0-9]+\\s*(mg|g|dl|mmol|iu|ml|kg|cm|mm|%)\\b')
  AND {_type_sql('s')} = 'patient_reportable' AS v2,
  length(name) BETWEEN 3 AND 120 AND NOT regexp_matches(name, '(?i){_alt(tuple(f"(?:{p})" for p in T.BAD_SYMPTOMS_V1))}') AND NOT regexp_matches(name, '(?i)[0-9]+\\s*(mg|g|dl|mmol|iu|ml|kg|cm|mm)\\b') AS v1 FROM s""",
)
def b4(spark: SparkSession, sf: str) -> DataFrame:
    """Both generations of the symptom filter."""
    return _names(spark, sf).select("name", T.clean_symptom(F.col("name")).alias("v2"), T.clean_symptom_v1(F.col("name")).alias("v1"))


@query(
    "b6",
    f"""WITH {_NAMES}, s AS (SELECT name, {_N2.format('name')} AS d FROM n)
SELECT name, length(d) >= 4 AND d NOT IN ({_sql_list(T.BAD_DISEASE_NAMES)}) AND len(list_filter(string_split(d, ' '), lambda x: x <> '')) <= 8 AND NOT regexp_matches(d, '\\b(patient|patients|male|female|adult|child|children)\\b') AS clean FROM s""",
)
def b6(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("name", T.clean_disease(F.col("name")).alias("clean"))


_QUESTIONS = """q AS (SELECT doc_id, concat('What is the ', CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN 'most likely diagnosis' WHEN 1 THEN 'best treatment' WHEN 2 THEN 'mechanism' WHEN 3 THEN 'receptor' WHEN 4 THEN 'biopsy' WHEN 5 THEN 'consent' WHEN 6 THEN 'prognosis' ELSE 'name' END, ' here?') AS question FROM qa_cases)"""


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*(F.lit(x) for x in ("most likely diagnosis", "best treatment", "mechanism", "receptor", "biopsy", "consent", "prognosis", "name")))
    return view(spark, sf, "qa_cases").select("doc_id", "answer", F.concat(F.lit("What is the "), F.element_at(kinds, (F.col("doc_id") % 8).cast("int") + 1), F.lit(" here?")).alias("question"))


@query("b7", f"WITH {_QUESTIONS} SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(lower(question), '{_alt(ks)}') THEN '{label}'" for label, ks in T.INTENTS.items()) + " ELSE 'other' END AS intent FROM q", Q)
def b7(spark: SparkSession, sf: str) -> DataFrame:
    return _questions(spark, sf).select("doc_id", T.intent(F.col("question")).alias("intent"))


_CASES = f"""c AS (SELECT q.doc_id, q.source, q.answer, q.question, CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'Administer fluids' WHEN 1 THEN 'Acute gout' WHEN 2 THEN '5 mg of it' WHEN 3 THEN 'Physical therapy' ELSE 'Heart failure' END AS info,
  user_content, list_filter(regexp_split_to_array(user_content, '[.;!?\\n]+'), lambda x: trim(x) <> '') AS facts
  FROM (SELECT doc_id, source, answer, user_content, concat('What is the ', CASE CAST(doc_id % 8 AS INT) WHEN 0 THEN 'most likely diagnosis' WHEN 1 THEN 'best treatment' WHEN 2 THEN 'cause' WHEN 3 THEN 'receptor' WHEN 4 THEN 'biopsy' WHEN 5 THEN 'most likely condition' WHEN 6 THEN 'prognosis' ELSE 'name' END, ' here?') AS question FROM qa_cases) q)"""


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*(F.lit(x) for x in ("most likely diagnosis", "best treatment", "cause", "receptor", "biopsy", "most likely condition", "prognosis", "name")))
    infos = F.array(*(F.lit(x) for x in ("Administer fluids", "Acute gout", "5 mg of it", "Physical therapy", "Heart failure")))
    pick = lambda a, n: F.element_at(a, (F.col("doc_id") % n).cast("int") + 1)
    question = F.concat(F.lit("What is the "), pick(kinds, 8), F.lit(" here?"))
    facts = F.filter(F.split("user_content", r"[.;!?\n]+"), lambda x: F.trim(x) != "")
    return view(spark, sf, "qa_cases").select("doc_id", "source", "answer", question.alias("question"), pick(infos, 5).alias("info"), "user_content", facts.alias("facts"))


_FAILURE = f"""CASE WHEN NOT regexp_matches(lower(question), '{_alt(T.DIAGNOSTIC_QUESTIONS)}') THEN 'fail_diag_keyword'
WHEN regexp_matches(lower(info), '^({_alt(T.NO_DISEASE_STARTS)})') OR regexp_matches(lower(info), '{_alt(tuple(f"(?:{p})" for p in T.NO_DISEASE))}') THEN 'fail_answer_type'
WHEN len(list_filter(coalesce(facts, []), lambda x: regexp_matches(lower(x), '{_alt(tuple(f"(?:{p})" for p in T.SYMPTOM_MARKERS))}'))) = 0 THEN 'fail_no_symptoms' END"""


@query("b8", f"WITH {_CASES} SELECT doc_id, {_FAILURE} AS failure FROM c", Q)
def b8(spark: SparkSession, sf: str) -> DataFrame:
    """The first stage of the cascade that a case fails."""
    return _cases(spark, sf).select("doc_id", T.cascade_failure(F.col("question"), F.col("info"), F.col("facts")).alias("failure"))


@query(
    "b9",
    f"""WITH {_CASES} SELECT source, status, count(*) AS n FROM (SELECT source, CASE WHEN answer IS NULL THEN 'no_answer' WHEN len(coalesce(facts, [])) < 4 THEN 'no_facts' WHEN length(user_content) < 120 THEN 'bad_prompt' ELSE 'kept' END AS status FROM c) t GROUP BY 1, 2""",
    Q,
)
def b9(spark: SparkSession, sf: str) -> DataFrame:
    """The first failure of a record as a column, counted by source. The prompt's own frame makes three facts."""
    status = F.when(F.col("answer").isNull(), "no_answer").when(F.coalesce(F.size("facts"), F.lit(0)) < 4, "no_facts").when(F.length("user_content") < 120, "bad_prompt").otherwise("kept")
    return _cases(spark, sf).groupBy("source", status.alias("status")).agg(F.count("*").alias("n"))


@query("b10", "SELECT sample_id, CASE WHEN contains(text, 'Final Answer') THEN 'kept_final' WHEN contains(text, 'Question:') THEN 'kept_question' ELSE 'dropped' END AS status FROM model_outputs", M)
def b10(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return view(spark, sf, "model_outputs").select("sample_id", F.when(t.contains("Final Answer"), "kept_final").when(t.contains("Question:"), "kept_question").otherwise("dropped").alias("status"))


@query("b11", "SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')) <= 256")
def b11(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")) <= 256).select("doc_id")


@query("b12", "SELECT o_orderkey FROM orders WHERE length(o_orderpriority) > 0 AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def b12(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").where((F.length("o_orderpriority") > 0) & (d >= F.lit("1995-01-01").cast("timestamp")) & (d < F.lit("1996-01-01").cast("timestamp"))).select("o_orderkey")


_DX = """d AS (SELECT DISTINCT concat(CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN 'possible ' WHEN 1 THEN '' WHEN 2 THEN 'flu or ' WHEN 3 THEN '' WHEN 4 THEN 'gout (or flu) ' ELSE 'one two three four five six seven eight ' END, p_name, CASE WHEN p_partkey % 3 = 0 THEN ' (ABC)' ELSE '' END) AS pred, p_name AS truth FROM part)"""


def _dx(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    head = F.when(k == 0, "possible ").when(k == 1, "").when(k == 2, "flu or ").when(k == 3, "").when(k == 4, "gout (or flu) ").otherwise("one two three four five six seven eight ")
    return table(spark, sf, "part").select(F.concat(head, "p_name", F.when(F.col("p_partkey") % 3 == 0, " (ABC)").otherwise("")).alias("pred"), F.col("p_name").alias("truth")).distinct()


_SINGLE = f"""{_N1.format('pred')} <> '' AND NOT regexp_matches(lower(pred), '{_alt(tuple(f"(?:{p})" for p in T.UNCERTAIN + T.SEVERAL))}')
  AND (len(regexp_extract_all(pred, '\\(([^)]*)\\)', 1)) = 0 OR (len(regexp_extract_all(pred, '\\(([^)]*)\\)', 1)) = 1 AND trim(regexp_replace(pred, '\\([^)]*\\)', '', 'g')) <> ''))
  AND len(list_filter(string_split({_N1.format('pred')}, ' '), lambda x: x <> '')) <= 8"""


@query("b16", f"WITH {_DX} SELECT pred, truth, {_SINGLE} AS single, {_SINGLE} AND (contains({_N1.format('pred')}, {_N1.format('truth')}) OR contains({_N1.format('truth')}, {_N1.format('pred')})) AS matched FROM d")
def b16(spark: SparkSession, sf: str) -> DataFrame:
    """B16 and B17."""
    return _dx(spark, sf).select("pred", "truth", T.single_diagnosis(F.col("pred")).alias("single"), T.diagnosis_match(F.col("pred"), F.col("truth")).alias("matched"))


_OBJ = """o AS (SELECT sample_id, text, CASE WHEN contains(text, '```json') THEN regexp_extract(text, '(?s)```json\\s*(.*?)```', 1) ELSE regexp_extract(regexp_replace(text, '(?is)<think>.*?</think>', '', 'g'), '(?s)(\\{.*\\})', 1) END AS js FROM model_outputs),
a AS (SELECT sample_id, text, js, CASE WHEN js <> '' THEN coalesce(json_extract_string(js, '$.action.type'), json_extract_string(js, '$.action')) ELSE regexp_extract(text, '(?is)<action>\\s*(ask|continue|switch|diagnose)\\s*</action>', 1) END AS raw FROM o)"""


@query("h11", f"WITH {_OBJ} SELECT sample_id, CASE WHEN raw IN ('ask', 'continue', 'switch') THEN 'ask' WHEN raw = 'diagnose' THEN 'diagnose' END AS action FROM a", M)
def h11(spark: SparkSession, sf: str) -> DataFrame:
    """H10 and H11."""
    return view(spark, sf, "model_outputs").select("sample_id", P.action(F.col("text")).alias("action"))


@query(
    "h12",
    f"WITH {_OBJ} SELECT sample_id, nullif({_N1.format('''coalesce(CASE WHEN js <> '' THEN json_extract_string(js, '$.diagnosis') END, nullif(regexp_extract(text, '(?i)Final Answer:\\s*([^\\n]+)', 1), ''))''')}, '') AS diagnosis FROM a",
    M,
)
def h12(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "model_outputs").select("sample_id", P.diagnosis(F.col("text")).alias("diagnosis"))


@query(
    "b26",
    f"""WITH {_OBJ} SELECT sample_id, coalesce((raw IN ('ask', 'continue', 'switch') AND (CASE WHEN js <> '' THEN json_extract_string(js, '$.question') END IS NOT NULL OR contains(text, '<question>')))
  OR (raw = 'diagnose' AND CASE WHEN js <> '' THEN json_extract_string(js, '$.diagnosis') END IS NOT NULL), false) AS valid FROM a""",
    M,
)
def b26(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "model_outputs").select("sample_id", P.valid_turn(F.col("text")).alias("valid"))


@query(
    "h13",
    """WITH t AS (SELECT sample_id, trim(regexp_replace(text, '(?is)<think>.*?</think>', '', 'g')) AS t FROM model_outputs)
SELECT sample_id, CASE WHEN starts_with(t, 'Final Answer:') THEN 'answer' WHEN starts_with(t, 'Question:') THEN 'ask' END AS action, CASE WHEN starts_with(t, 'Final Answer:') THEN trim(substr(t, 14)) WHEN starts_with(t, 'Question:') THEN trim(substr(t, 10)) END AS content FROM t""",
    M,
)
def h13(spark: SparkSession, sf: str) -> DataFrame:
    """H7 and H13."""
    d = view(spark, sf, "model_outputs").withColumn("p", P.plain_action(F.col("text")))
    return d.select("sample_id", "p.action", "p.content")


@query("h5", "SELECT doc_id, substr(sha1(concat_ws('||', source, CAST(doc_id AS VARCHAR), user_content)), 1, 16) AS uid FROM qa_cases", Q)
def h5(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "qa_cases").select("doc_id", T.stable_uid(F.col("source"), F.col("doc_id").cast("string"), F.col("user_content")).alias("uid"))


@query(
    "h6",
    """SELECT doc_id, trim(regexp_extract(user_content, '(?s)^(.*?)Problem:', 1)) AS context, trim(regexp_extract(user_content, '(?s)Problem:(.*?)Options:', 1)) AS problem, json_extract_string(trim(regexp_extract(user_content, '(?s)Options:(.*)$', 1)), '$.A') AS option_a FROM qa_cases""",
    Q,
)
def h6(spark: SparkSession, sf: str) -> DataFrame:
    """A5 and H6: parts of a prompt, and JSON in a string."""
    c = F.col("user_content")
    part = lambda p: F.trim(F.regexp_extract(c, p, 1))
    options = F.from_json(part(r"(?s)Options:(.*)$"), "A string, B string")
    return view(spark, sf, "qa_cases").select("doc_id", part(r"(?s)^(.*?)Problem:").alias("context"), part(r"(?s)Problem:(.*?)Options:").alias("problem"), options["A"].alias("option_a"))


@query("h4", "SELECT conv_id, turn, trim(regexp_replace(regexp_replace(x, '^(?:[-*]|[0-9]+[.)])\\s*', ''), '\\s+', ' ', 'g')) AS fact FROM (SELECT conv_id, turn, concat(CASE CAST(turn % 3 AS INT) WHEN 0 THEN '- ' WHEN 1 THEN '12. ' ELSE '' END, trim(replace(text, chr(10), '  '))) AS x FROM conversations) t")
def h4(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("turn") % 3
    x = F.concat(F.when(k == 0, "- ").when(k == 1, "12. ").otherwise(""), F.trim(F.replace("text", F.lit("\n"), F.lit("  "))))
    return table(spark, sf, "conversations").select("conv_id", "turn", T.atomic_fact(x).alias("fact"))


@query(
    "g4",
    """WITH w AS (SELECT doc_id, i, ws[i] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT doc_id, string_split(user_content, ' ') AS ws FROM qa_cases) a) b),
f AS (SELECT doc_id, i, w FROM w QUALIFY row_number() OVER (PARTITION BY doc_id, lower(w) ORDER BY i) = 1)
SELECT doc_id, array_to_string(list(w ORDER BY i), ' ') AS facts, count(*) AS n FROM f GROUP BY 1""",
    Q,
)
def g4(spark: SparkSession, sf: str) -> DataFrame:
    """The first of equal facts, whatever their case, in order; arrays need no shuffle."""
    w = F.transform(F.split("user_content", " "), lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x")))
    d = T.held(view(spark, sf, "qa_cases").select("doc_id", "user_content"), w=F.sort_array(w)).where("w IS NOT NULL")
    first = F.filter("w", lambda s, j: (j == 0) | (F.get(F.col("w"), j - 1)["low"] != s["low"]))
    d = d.select("doc_id", F.transform(F.array_sort(F.transform(first, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))), lambda s: s["x"]).alias("k"))
    return d.select("doc_id", F.array_join("k", " ").alias("facts"), F.size("k").cast("long").alias("n"))


@query("h20", "SELECT doc_id, array_to_string(list_transform(string_split(user_content, ' '), lambda x, i: concat('F', CASE WHEN i <= 1000 THEN lpad(CAST(i - 1 AS VARCHAR), 3, '0') ELSE CAST(i - 1 AS VARCHAR) END, ':', x)), ',') AS facts FROM qa_cases", Q)
def h20(spark: SparkSession, sf: str) -> DataFrame:
    f = T.fact_ids(F.split("user_content", " "))
    return view(spark, sf, "qa_cases").select("doc_id", F.array_join(F.transform(f, lambda x: F.concat(x["fact_id"], F.lit(":"), x["text"])), ",").alias("facts"))


@query(
    "h17",
    """SELECT sample_id, list_last(regexp_extract_all(right(solution, 300), '#### (-?[0-9.,]+)', 1)) AS strict, list_last(list_filter(regexp_extract_all(right(solution, 300), '(-?[0-9.,]+)', 1), lambda x: x NOT IN ('', '.'))) AS flexible FROM responses""",
    ("responses",),
)
def h17(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("solution")
    return view(spark, sf, "responses").select("sample_id", S.strict_number(x).alias("strict"), S.flexible_number(x).alias("flexible"))


@query("h18", "SELECT sample_id, CASE CAST(sample_id % 4 AS INT) WHEN 0 THEN '\\frac{' || ground_truth || '}{2}' WHEN 1 THEN ground_truth WHEN 2 THEN '' END AS boxed FROM responses", ("responses",))
def h18(spark: SparkSession, sf: str) -> DataFrame:
    """The last box: nested braces, an earlier box, an empty one, one that never closes."""
    k, g = F.col("sample_id") % 4, F.col("ground_truth")
    x = F.when(k == 0, F.concat(F.lit("so \\boxed{no} then \\boxed{\\frac{"), g, F.lit("}{2}} end"))).when(k == 1, F.concat(F.lit("\\boxed{"), g, F.lit("}"))).when(k == 2, F.lit("\\boxed{a} \\boxed{} }")).otherwise(F.concat(F.lit("\\boxed{a} \\boxed{{"), g, F.lit("}")))
    return view(spark, sf, "responses").select("sample_id", S.boxed(x).alias("boxed"))


@query(
    "h19",
    """WITH m AS (SELECT *, CASE CAST(sample_id % 4 AS INT) WHEN 0 THEN 'x = ' || ground_truth || '\\%' WHEN 1 THEN '.' || ground_truth WHEN 2 THEN '\\tfrac' || left(ground_truth, 1) || '3' ELSE ground_truth || '\\text{ kg}' END AS v,
  CASE CAST(sample_id % 3 AS INT) WHEN 0 THEN 'y = $' || ground_truth || '$ dollars' WHEN 1 THEN '\\text{' || ground_truth || '} square units' ELSE '1,00' || ground_truth END AS w FROM responses),
m1 AS (SELECT *, split_part(replace(replace(v, '\\%', ''), 'tfrac', 'frac'), '\\text{ ', 1) AS v1, regexp_replace(regexp_replace(list_last(string_split(w, '=')), ' |dollars|square|units|[$]', '', 'g'), '\\\\text[{](.*?)[}]', '\\1', 'g') AS w1 FROM m),
m2 AS (SELECT *, replace(regexp_replace(CASE WHEN starts_with(v1, '.') THEN '0' || v1 ELSE v1 END, '^[^=]{0,2}=([^=]*)$', '\\1'), ' ', '') AS v2 FROM m1),
m3 AS (SELECT *, regexp_replace(v2, '\\\\frac([^{])([^{])', '\\\\frac{\\1}{\\2}', 'g') AS v3 FROM m2)
SELECT sample_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(solution), '[!-/:-@\\[-`{-~]', '', 'g'), '\\b(a|an|the)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS answer,
CASE WHEN v3 = '0.5' THEN '\\frac{1}{2}' ELSE v3 END AS math,
CASE WHEN regexp_matches(replace(w1, ',', ''), '^[0-9]+$') THEN replace(w1, ',', '') ELSE w1 END AS final FROM m3""",
    ("responses",),
)
def h19(spark: SparkSession, sf: str) -> DataFrame:
    """The three clean-ups: of questions' answers, of mathematics, of final answers."""
    k, g = F.col("sample_id"), F.col("ground_truth")
    v = F.when(k % 4 == 0, F.concat(F.lit("x = "), g, F.lit("\\%"))).when(k % 4 == 1, F.concat(F.lit("."), g)).when(k % 4 == 2, F.concat(F.lit("\\tfrac"), F.left(g, F.lit(1)), F.lit("3"))).otherwise(F.concat(g, F.lit("\\text{ kg}")))
    w = F.when(k % 3 == 0, F.concat(F.lit("y = $"), g, F.lit("$ dollars"))).when(k % 3 == 1, F.concat(F.lit("\\text{"), g, F.lit("} square units"))).otherwise(F.concat(F.lit("1,00"), g))
    return view(spark, sf, "responses").select("sample_id", S.qa_normal(F.col("solution")).alias("answer"), S.math_normal(v).alias("math"), S.answer_normal(w).alias("final"))


#: A boxed answer without percent, units, a short name before = and spaces; the label of a search question without case, punctuation, articles and spaces around.
_BOXED = r"replace(regexp_replace(split_part(replace(regexp_extract(solution, '(?s).*\\boxed[{](.*)[}]', 1), '\%', ''), '\text{ ', 1), '^[^=]{0,2}=([^=]*)$', '\1'), ' ', '')"
_NAMED = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(list_last(regexp_extract_all(solution, '(?s)<answer>(.*?)</answer>', 1))), '[!-/:-@\[-`{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"
_SCORED = rf"""CASE WHEN data_source = 'openai/gsm8k' THEN CASE WHEN replace(list_last(regexp_extract_all(right(solution, 300), '#### (-?[0-9.,]+)', 1)), ',', '') = ground_truth THEN 1.0 ELSE 0.0 END
WHEN data_source = 'searchR1_nq' THEN CASE WHEN {_NAMED} = ground_truth THEN CASE WHEN len(string_split(solution, '<answer>')) - 1 > 10 THEN 0.25 ELSE 1.0 END ELSE 0.0 END
WHEN data_source = 'lighteval/MATH' THEN CASE WHEN {_BOXED} = ground_truth THEN 1.0 ELSE 0.0 END
WHEN data_source = 'hiyouga/geometry3k' THEN CASE WHEN {_BOXED} = ground_truth THEN 0.9 ELSE 0.0 END + CASE WHEN regexp_matches(solution, '(?s)^<think>.*</think>.*\\boxed[{{].*[}}]') THEN 0.1 ELSE 0.0 END
ELSE CASE WHEN trim(list_last(regexp_extract_all(right(solution, 300), '(?i)Answer\s*:\s*([^\n]+)', 1))) = ground_truth THEN 1.0 ELSE -1.0 END END"""


@query("i6", f"SELECT sample_id, round(CAST({_SCORED} AS DOUBLE), 6) + 0.0 AS score FROM responses", ("responses",))
def i6(spark: SparkSession, sf: str) -> DataFrame:
    """Each answer against its label, by source."""
    return view(spark, sf, "responses").select("sample_id", r6(S.score_by_source()).alias("score"))


@query("k3", "SELECT sample_id, manager, round(score, 6) + 0.0 AS score FROM (SELECT sample_id, 'naive' AS manager, " + f"CAST({_SCORED} AS DOUBLE) AS score FROM responses UNION ALL SELECT sample_id, 'dapo', CAST({_SCORED} AS DOUBLE) + least(-(length(solution) - 12) / 8.0, 0) FROM responses UNION ALL SELECT sample_id, 'batch', CAST(length(solution) + length(ground_truth) AS DOUBLE) FROM responses UNION ALL SELECT sample_id, 'prime', CASE WHEN ground_truth LIKE '1%' THEN 0 ELSE length(solution) END FROM responses) t", ("responses",))
def k3(spark: SparkSession, sf: str) -> DataFrame:
    """Reward managers by name: by source, with the penalty for length, by a user's batch scorer, and by a row scorer that fails on some rows."""
    r = view(spark, sf, "responses").withColumn("resp_len", F.length("solution"))

    def sizes(x, t):
        return x.str.len() + t.str.len()

    def brittle(x: str, t: str) -> int:
        if t.startswith("1"):
            raise ValueError(t)
        return len(x)

    out = None
    for name, params in (("naive", {}), ("dapo", {"most": 20, "buffer": 8}), ("batch", {"scorer": sizes}), ("prime", {"scorer": brittle})):
        one = S.manager(name)(r, **params).select("sample_id", F.lit(name).alias("manager"), r6("score").alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


@query("k6", "SELECT sample_id, CAST(i AS INTEGER) AS place, substr(ground_truth, i, 1) AS digit FROM (SELECT sample_id, ground_truth, unnest(range(1, length(ground_truth) + 1)) AS i FROM responses) t", ("responses",))
def k6(spark: SparkSession, sf: str) -> DataFrame:
    """A user's generator class: rows from a row."""

    class Digits:
        def eval(self, text: str):
            for i, c in enumerate(text, 1):
                yield i, c

    r = view(spark, sf, "responses").select("sample_id", "ground_truth")
    return S.rows_by(r, Digits, "place int, digit string", "ground_truth").select("sample_id", "place", "digit")


@query("h22", "SELECT doc_id, concat('system:', 'You are a doctor.', '|user:', user_content) AS messages FROM qa_cases", Q)
def h22(spark: SparkSession, sf: str) -> DataFrame:
    m = F.array(F.struct(F.lit("system").alias("role"), F.lit("You are a doctor.").alias("content")), F.struct(F.lit("user").alias("role"), F.col("user_content").alias("content")))
    return view(spark, sf, "qa_cases").select("doc_id", F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["role"], x["content"])), "|").alias("messages"))


@query(
    "h9",
    "SELECT conv_id, string_agg(role || '=' || trim(text), '|' ORDER BY turn) AS messages FROM conversations GROUP BY 1",
)
def h9(spark: SparkSession, sf: str) -> DataFrame:
    """Chats rendered to text and parsed back."""
    d = table(spark, sf, "conversations")
    one = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    chat = d.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", one.alias("t")))).alias("x")).select("conv_id", F.array_join(F.transform("x", lambda r: r["t"]), "").alias("chat"))
    return chat.select("conv_id", F.array_join(F.transform(P.chat_messages(F.col("chat")), lambda m: F.concat_ws("=", m["role"], m["content"])), "|").alias("messages"))


@query(
    "h15",
    """WITH t AS (SELECT conv_id, turn, lower(concat('he says no ', text, ' fever')) AS t FROM conversations),
b AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(substr(t, 1, instr(t, 'fever') - 1), '\\s+'), lambda x: x <> '') AS w FROM t)
SELECT conv_id, turn, regexp_matches(array_to_string(w[greatest(len(w) - 4, 1):len(w)], ' '), '(^|[^\\p{L}\\p{N}_])(no|not|never|without|denies|deny|denied)([^\\p{L}\\p{N}_]|$)') AS denied FROM b""",
)
def h15(spark: SparkSession, sf: str) -> DataFrame:
    """A denial is a whole word, in letters of any script: no word of another language that begins with one."""
    x = F.concat(F.lit("he says no "), "text", F.lit(" fever"))
    return table(spark, sf, "conversations").select("conv_id", "turn", P.denied_before(x, F.lit("fever")).alias("denied"))


_CALLS = r"""t AS (SELECT event_id, CASE CAST(event_id % 6 AS INT) WHEN 0 THEN 'go <tool_call>{"name": "' || event_type || '", "arguments": {"n": ' || CAST(event_id % 9 AS VARCHAR) || '}}</tool_call> on'
  WHEN 1 THEN '<tool_call>{"name": "a", "arguments": {"n": 1}}</tool_call>' || chr(10) || '<tool_call>{"name": "' || event_type || '", "arguments": {"n": [1, 2]}}</tool_call>'
  WHEN 2 THEN '<tool_call>broken</tool_call><tool_call>' || chr(10) || '{"name": "' || event_type || '"}</tool_call>' WHEN 3 THEN 'no call ' || event_type WHEN 4 THEN '<tool_call>{"name": "open"' ELSE '<tool_call>{"arguments": {"n": 3}}</tool_call> nameless' END AS t FROM events)"""


@query(
    "h16",
    f"""WITH {_CALLS}, c AS (SELECT event_id, t, list_filter(regexp_extract_all(t, '(?s)<tool_call>(.*?)</tool_call>', 1), lambda x: coalesce(json_valid(x) AND json_extract_string(CASE WHEN json_valid(x) THEN x END, '$.name') IS NOT NULL, false)) AS c FROM t)
SELECT event_id, array_to_string(list_transform(c, lambda x: json_extract_string(x, '$.name')), ',') AS names, array_to_string(list_transform(c, lambda x: replace(coalesce(json_extract_string(x, '$.arguments.n'), '-'), ' ', '')), ';') AS n, regexp_replace(t, '(?s)<tool_call>.*?</tool_call>', '', 'g') AS rest FROM c""",
)
def h16(spark: SparkSession, sf: str) -> DataFrame:
    """One call, two, a broken one before a good one, none, one that never closes, one without a name."""
    k, e = F.col("event_id") % 6, F.col("event_type")
    call = lambda name, args: F.concat(F.lit('<tool_call>{"name": "'), name, F.lit('", "arguments": {"n": '), args, F.lit("}}</tool_call>"))
    t = (
        F.when(k == 0, F.concat(F.lit("go "), call(e, (F.col("event_id") % 9).cast("string")), F.lit(" on")))
        .when(k == 1, F.concat(call(F.lit("a"), F.lit("1")), F.lit("\n"), call(e, F.lit("[1, 2]"))))
        .when(k == 2, F.concat(F.lit('<tool_call>broken</tool_call><tool_call>\n{"name": "'), e, F.lit('"}</tool_call>')))
        .when(k == 3, F.concat(F.lit("no call "), e))
        .when(k == 4, F.lit('<tool_call>{"name": "open"'))
        .otherwise(F.lit('<tool_call>{"arguments": {"n": 3}}</tool_call> nameless'))
    )
    d = T.held(table(spark, sf, "events").select("event_id", t.alias("t")), c=P.tool_calls(F.col("t")))
    n = F.transform("c", lambda x: F.replace(F.coalesce(F.get_json_object(x["arguments"], "$.n"), F.lit("-")), F.lit(" "), F.lit("")))
    return d.select("event_id", F.array_join(F.transform("c", lambda x: x["name"]), ",").alias("names"), F.array_join(n, ";").alias("n"), F.regexp_replace("t", r"(?s)<tool_call>.*?</tool_call>", "").alias("rest"))


@query(
    "h23",
    """WITH t AS (SELECT page_id, CASE CAST(page_id % 5 AS INT) WHEN 0 THEN 'see <image> ' || url WHEN 1 THEN '<video><image>' || url || '<image>' WHEN 2 THEN url WHEN 3 THEN '<image>' ELSE 'a <video>b</video> ' || url END AS x FROM pages),
p AS (SELECT page_id, list_filter(string_split(replace(replace(x, '<image>', chr(1) || '<image>' || chr(1)), '<video>', chr(1) || '<video>' || chr(1)), chr(1)), lambda v: v <> '') AS p FROM t)
SELECT page_id, array_to_string(list_transform(p, lambda v: CASE v WHEN '<image>' THEN 'image:' WHEN '<video>' THEN 'video:' ELSE 'text:' || v END), ',') AS parts FROM p""",
)
def h23(spark: SparkSession, sf: str) -> DataFrame:
    """Media marks first, last, side by side, alone and missing."""
    k, u = F.col("page_id") % 5, F.col("url")
    x = F.when(k == 0, F.concat(F.lit("see <image> "), u)).when(k == 1, F.concat(F.lit("<video><image>"), u, F.lit("<image>"))).when(k == 2, u).when(k == 3, F.lit("<image>")).otherwise(F.concat(F.lit("a <video>b</video> "), u))
    return table(spark, sf, "pages").select("page_id", F.array_join(F.transform(P.split_media(x), lambda p: F.concat(p["type"], F.lit(":"), F.coalesce(p["text"], F.lit("")))), ",").alias("parts"))


@query("h26", "SELECT source, string_agg(concat('Doc ', CAST(k AS VARCHAR), ' (Title: ', CAST(doc_id AS VARCHAR), ') ', replace(text, chr(10), ' ')), chr(10) ORDER BY k) AS passages FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) t WHERE k <= 3 GROUP BY 1")
def h26(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    d = table(spark, sf, "documents").select("source", "doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("t"), k.alias("k")).where("k <= 3")
    x = F.sort_array(F.collect_list(F.struct("k", "doc_id", "t")))
    one = lambda p: F.concat(F.lit("Doc "), p["k"].cast("string"), F.lit(" (Title: "), p["doc_id"].cast("string"), F.lit(") "), p["t"])
    return d.groupBy("source").agg(x.alias("x")).select("source", F.array_join(F.transform("x", one), "\n").alias("passages"))


@query("h30", "SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(concat('x [title] ', user_content, ' [step] y'), ' \\[title\\]', '. ', 'g'), '\\[.*?\\]', '', 'g'), '  +', ' ', 'g')) AS text FROM qa_cases", Q)
def h30(spark: SparkSession, sf: str) -> DataFrame:
    x = F.concat(F.lit("x [title] "), "user_content", F.lit(" [step] y"))
    return view(spark, sf, "qa_cases").select("doc_id", P.wikihow_clean(x).alias("text"))


@query("h33", """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN NULL ELSE l_discount END AS "a", l_tax AS "b/c", CASE WHEN l_quantity > 25 THEN NULL ELSE l_quantity END AS "b/d/e",
concat('{"a":', CASE WHEN l_discount > 0.05 THEN 'null' ELSE 'x' END, ',"list":[', CASE WHEN l_discount > 0.05 THEN 'null' ELSE 'x' END, ',', CASE WHEN l_quantity > 25 THEN 'null' ELSE 'x' END, ']}') AS shape FROM lineitem""")
def h33(spark: SparkSession, sf: str) -> DataFrame:
    """NaN becomes null at any depth; a nested row becomes columns by path."""
    nan = F.lit(float("nan"))
    a, e = F.when(F.col("l_discount") > 0.05, nan).otherwise(F.col("l_discount").cast("double")), F.when(F.col("l_quantity") > 25, nan).otherwise(F.col("l_quantity").cast("double"))
    row = F.struct(a.alias("a"), F.struct(F.col("l_tax").alias("c"), F.struct(e.alias("e")).alias("d")).alias("b"))
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", row.alias("row"), F.struct(a.alias("a"), F.array(a, e).alias("list")).alias("more"))
    d = d.select("l_orderkey", "l_linenumber", *(P.without_nan(F.col(c), d.schema[c].dataType).alias(c) for c in ("row", "more")))
    shape = F.to_json(F.struct(F.when(F.col("more.a").isNotNull(), "x").alias("a"), F.transform("more.list", lambda x: F.when(x.isNotNull(), "x")).alias("list")), {"ignoreNullFields": "false"})
    return d.select("l_orderkey", "l_linenumber", *P.flat_columns(F.col("row"), d.schema["row"].dataType), F.replace(shape, F.lit('"x"'), F.lit("x")).alias("shape"))


@query("i14", """WITH t AS (SELECT event_id, event_type || CASE CAST(event_id % 7 AS INT) WHEN 0 THEN ' so \\boxed{True}' WHEN 1 THEN ' INCORRECT' WHEN 2 THEN ' is CORRECT' WHEN 3 THEN ' \\boxed{False}' WHEN 4 THEN ' CORRECTLY said' WHEN 5 THEN ' \\boxed{ True } INCORRECT' ELSE ' CORRECT, not INCORRECT' END AS x FROM events)
SELECT event_id, CASE WHEN regexp_matches(x, '\\\\boxed\\{\\s*True\\s*\\}') THEN 1.0 WHEN regexp_matches(x, '\\bINCORRECT\\b') THEN 0.0 WHEN regexp_matches(x, '\\bCORRECT\\b') THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM t""")
def i14(spark: SparkSession, sf: str) -> DataFrame:
    said = F.array(*(F.lit(x) for x in (" so \\boxed{True}", " INCORRECT", " is CORRECT", " \\boxed{False}", " CORRECTLY said", " \\boxed{ True } INCORRECT", " CORRECT, not INCORRECT")))
    x = F.concat("event_type", F.element_at(said, (F.col("event_id") % 7).cast("int") + 1))
    return table(spark, sf, "events").select("event_id", P.verdict(x).alias("score"))


_WORDS = """w AS (SELECT l_orderkey, l_linenumber, list_transform(range(1, 4 + CAST(l_linenumber % 3 AS BIGINT)), lambda i: substr(md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)), i, 1)) AS c FROM lineitem)"""


@query(
    "h32",
    f"""WITH {_WORDS}, n AS (SELECT *, c[1] AS t, len(list_filter(c, lambda x: x = c[1])) AS n FROM w)
SELECT l_orderkey, l_linenumber, array_to_string(list_append(list_transform(c, lambda x: x || CASE WHEN x = t THEN ' = ' ELSE ' != ' END || t || '.'), '\\boxed{{' || CAST(n AS VARCHAR) || '}} ' || t || ' in ' || array_to_string(c, '-') || '.'), chr(10)) AS answer, CASE WHEN n = 1 THEN 1 ELSE 0 END AS score FROM n""",
)
def h32(spark: SparkSession, sf: str) -> DataFrame:
    """Words of three to five letters by hash, the worked count of their first letter, and whether an answer of 1 would be right."""
    word = F.md5(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    d = T.held(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", word.alias("w")), c=F.transform(F.sequence(F.lit(1), 3 + (F.col("l_linenumber") % 3).cast("int")), lambda i: F.substring(F.col("w"), i, F.lit(1))))
    d = d.withColumn("answer", P.count_chain(F.col("c"), F.col("c")[0]))
    return d.select("l_orderkey", "l_linenumber", "answer", (S.boxed(F.col("answer")) == "1").cast("int").alias("score"))


_TRACES = """t AS (SELECT event_id, event_id % 2 AS acc, CASE CAST(event_id % 8 AS INT) WHEN 0 THEN '<think>a</think><answer> ' || event_type || ' </answer>' WHEN 1 THEN '<think>a<think>b</think><answer>' || event_type || '</answer>' WHEN 2 THEN 'plain ' || event_type
  WHEN 3 THEN '<think>a</think><tool_call>{}</tool_call><tool_response>r</tool_response>assistant' || chr(10) || event_type || chr(10) || 'more' WHEN 4 THEN '<think>a</think> user said <tool_call>x</tool_call> ' || event_type WHEN 5 THEN '<think>a</think><tool_call>x</tool_call><answer>' || event_type || '</answer>'
  WHEN 6 THEN '<think>a</think><answer>' || repeat('long ', 250) || '</answer>' ELSE '<think>a</think><answer>  </answer><tool_response>r</tool_response>' END AS x FROM events)"""


@query(
    "h29",
    f"""WITH {_TRACES}, r AS (SELECT *, trim(CASE WHEN contains(x, '</think>') THEN list_last(string_split(x, '</think>')) ELSE x END) AS rest FROM t),
f AS (SELECT *, regexp_matches(rest, '(?s)<answer>.*?</answer>') AS tagged, regexp_replace(CASE WHEN regexp_matches(rest, '(?s)<answer>.*?</answer>') THEN regexp_extract(rest, '(?s)<answer>(.*?)</answer>', 1)
  WHEN regexp_matches(rest, '</tool_response>\\s*assistant\\s*\\n') THEN regexp_extract(rest, '(?s)</tool_response>\\s*assistant\\s*\\n(.*?)(?:\\n|\\z)', 1)
  WHEN contains(x, '</think>') THEN regexp_replace(regexp_replace(rest, '(?s)<tool_call>.*?</tool_call>|<tool_response>.*?</tool_response>', '', 'g'), '\\b(user|assistant)\\b', '', 'g') ELSE x END, '\\A\\s+|\\s+\\z', '', 'g') AS found FROM r),
a AS (SELECT *, CASE WHEN found = '' THEN trim(x) ELSE found END AS answer FROM f),
b AS (SELECT *, len(string_split(x, '<think>')) <> len(string_split(x, '</think>')) OR len(string_split(rest, '<answer>')) <> len(string_split(rest, '</answer>')) OR NOT tagged OR found = '' OR length(answer) >= 1000 AS bad FROM a)
SELECT event_id, answer, bad AS format_error, CASE WHEN regexp_matches(x, '(?s)<tool_call>.*?</tool_call>|<tool_response>.*?</tool_response>') AND acc = 1 AND length(answer) < 1000 THEN 1.0 ELSE 0.0 END::DOUBLE AS tool_reward, CASE WHEN bad THEN -1.0 ELSE 0.0 END::DOUBLE AS format_reward FROM b""",
)
def h29(spark: SparkSession, sf: str) -> DataFrame:
    """Traces with balanced and unbalanced tags, tools, no answer, a long one and an empty one."""
    k, e = F.col("event_id") % 8, F.col("event_type")
    x = (
        F.when(k == 0, F.concat(F.lit("<think>a</think><answer> "), e, F.lit(" </answer>"))).when(k == 1, F.concat(F.lit("<think>a<think>b</think><answer>"), e, F.lit("</answer>"))).when(k == 2, F.concat(F.lit("plain "), e))
        .when(k == 3, F.concat(F.lit("<think>a</think><tool_call>{}</tool_call><tool_response>r</tool_response>assistant\n"), e, F.lit("\nmore"))).when(k == 4, F.concat(F.lit("<think>a</think> user said <tool_call>x</tool_call> "), e))
        .when(k == 5, F.concat(F.lit("<think>a</think><tool_call>x</tool_call><answer>"), e, F.lit("</answer>"))).when(k == 6, F.concat(F.lit("<think>a</think><answer>"), F.repeat(F.lit("long "), F.lit(250)), F.lit("</answer>")))
        .otherwise(F.lit("<think>a</think><answer>  </answer><tool_response>r</tool_response>"))
    )
    d = table(spark, sf, "events").select("event_id", x.alias("x"), (F.col("event_id") % 2).cast("double").alias("acc"))
    return d.select("event_id", S.tags_and_tools(F.col("x"), F.col("acc")).alias("r")).select("event_id", "r.answer", "r.format_error", "r.tool_reward", "r.format_reward")


@query("h14", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'plain ' || event_type END AS answer, CASE WHEN event_id % 2 = 0 THEN 'F1' ELSE 'unknown' END AS fact_id FROM events")
def h14(spark: SparkSession, sf: str) -> DataFrame:
    x = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"answer": "'), "event_type", F.lit('", "fact_id": "F1"}'))).otherwise(F.concat(F.lit("plain "), "event_type"))
    return table(spark, sf, "events").select("event_id", P.patient_reply(x).alias("r")).select("event_id", "r.answer", "r.fact_id")


@query(
    "h8",
    """WITH t AS (SELECT conv_id, turn, CASE CAST(turn % 4 AS INT) WHEN 0 THEN '<|im_start|>system' || chr(10) || role || '<|im_end|>' || text WHEN 1 THEN '<|im_start|>system' || chr(10) || role || ' /no_think<|im_end|>' || text
  WHEN 2 THEN '<|im_start|>user' || chr(10) || text || '<|im_end|>' ELSE '<|im_start|>user' || chr(10) || text || '<|im_end|><|im_start|>system' || chr(10) || 'one<|im_end|><|im_start|>system' || chr(10) || 'two<|im_end|>' END AS x FROM conversations)
SELECT conv_id, turn, CASE WHEN contains(x, '/no_think') THEN x ELSE regexp_replace(x, '(?s)\\A(.*?<\\|im_start\\|>system\\n.*?)(<\\|im_end\\|>)', '\\1 /no_think\\2') END AS prompt FROM t""",
)
def h8(spark: SparkSession, sf: str) -> DataFrame:
    """System blocks without the switch, with it, missing, and two of them behind a user's."""
    k = F.col("turn") % 4
    x = (
        F.when(k == 0, F.concat(F.lit("<|im_start|>system\n"), "role", F.lit("<|im_end|>"), "text")).when(k == 1, F.concat(F.lit("<|im_start|>system\n"), "role", F.lit(" /no_think<|im_end|>"), "text"))
        .when(k == 2, F.concat(F.lit("<|im_start|>user\n"), "text", F.lit("<|im_end|>"))).otherwise(F.concat(F.lit("<|im_start|>user\n"), "text", F.lit("<|im_end|><|im_start|>system\none<|im_end|><|im_start|>system\ntwo<|im_end|>")))
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", P.no_think_once(x).alias("prompt"))


@query(
    "h31",
    """WITH t AS (SELECT event_id, CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'so <code>' || event_type || '</code> gives <interpreter> ' || CAST(user_id AS VARCHAR) || '</interpreter><answer>done</answer>' WHEN 1 THEN '<code>a' || chr(10) || event_type || '</code><interpreter></interpreter><code>b</code><interpreter>2</interpreter>'
  WHEN 2 THEN 'nothing ' || event_type ELSE '<interpreter>' || event_type || '</interpreter> and <code>open' END AS x FROM events),
m AS (SELECT event_id, regexp_extract_all(x, '(?s)<(code|interpreter|answer)>(.*?)</(?:code|interpreter|answer)>', 1) AS r, regexp_extract_all(x, '(?s)<(code|interpreter|answer)>(.*?)</(?:code|interpreter|answer)>', 2) AS c FROM t)
SELECT event_id, array_to_string(list_transform(list_zip(r, c), lambda p: CASE WHEN p[1] = 'interpreter' THEN 'tool=' ELSE 'assistant=' END || trim(p[2])), '|') AS trace FROM m""",
)
def h31(spark: SparkSession, sf: str) -> DataFrame:
    """One round, two, none, and one that never closes."""
    k, e = F.col("event_id") % 4, F.col("event_type")
    x = (
        F.when(k == 0, F.concat(F.lit("so <code>"), e, F.lit("</code> gives <interpreter> "), F.col("user_id").cast("string"), F.lit("</interpreter><answer>done</answer>")))
        .when(k == 1, F.concat(F.lit("<code>a\n"), e, F.lit("</code><interpreter></interpreter><code>b</code><interpreter>2</interpreter>")))
        .when(k == 2, F.concat(F.lit("nothing "), e)).otherwise(F.concat(F.lit("<interpreter>"), e, F.lit("</interpreter> and <code>open")))
    )
    m = F.transform(P.tagged_trace(x), lambda r: F.concat(r["role"], F.lit("="), r["content"]))
    return table(spark, sf, "events").select("event_id", F.array_join(m, "|").alias("trace"))


_POINTS = """p AS (SELECT l_orderkey, l_linenumber, CASE CAST((l_orderkey + l_linenumber) % 4 AS INT) WHEN 0 THEN [[l_quantity, 5.0]] WHEN 1 THEN [[l_quantity, 5.0], [l_linenumber * 10.0, 6.0]] WHEN 2 THEN [[l_quantity, 5.0], [l_linenumber * 10.0, 5.0], [3.0, 5.0]] ELSE [[l_quantity, 5.0], [l_linenumber * 10.0, 7.0], [l_quantity + 20, 9.0]] END AS p,
  (l_orderkey + l_linenumber) % 5 = 4 AS bad, (l_orderkey + l_linenumber) % 4 = 2 OR ((l_orderkey + l_linenumber) % 4 = 3 AND 4.0 * (l_linenumber * 10.0 - l_quantity) = 40.0) AS line FROM lineitem)"""


@query(
    "h28",
    f"""WITH {_POINTS}, k AS (SELECT *, list_position(list_transform(p, lambda q: q[1] BETWEEN 0 AND 20 AND q[2] BETWEEN 0 AND 10), true) AS k, len(p) AS n FROM p),
r AS (SELECT *, NOT bad AND NOT line AS ok, CASE WHEN k > 0 THEN 1 / sqrt(n * k) ELSE -1.0 / n END AS acc FROM k)
SELECT l_orderkey, l_linenumber, round(CASE WHEN ok THEN 1 + acc ELSE -1 END, 6) + 0.0 AS score, round(CASE WHEN ok THEN acc ELSE -1 END, 6) + 0.0 AS accuracy, CAST(CASE WHEN ok THEN n ELSE 0 END AS INTEGER) AS num_pred,
CASE WHEN ok AND k = 1 THEN 1 ELSE 0 END AS first_correct, CASE WHEN ok AND n = 1 AND k > 0 THEN 1 ELSE 0 END AS only_correct, CASE WHEN NOT bad AND line THEN 1 ELSE 0 END AS is_collinear FROM r""",
)
def h28(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of one to three points in JSON behind thoughts; some on a line, some without thoughts."""
    k = F.col("l_orderkey") + F.col("l_linenumber")
    one = lambda x, y: F.concat(F.lit('{"point_2d": ['), x.cast("string"), F.lit(", "), F.lit(y).cast("string"), F.lit("]}"))
    q, n = F.col("l_quantity").cast("double"), F.col("l_linenumber") * 10.0
    points = F.when(k % 4 == 0, one(q, 5.0)).when(k % 4 == 1, F.concat_ws(", ", one(q, 5.0), one(n, 6.0))).when(k % 4 == 2, F.concat_ws(", ", one(q, 5.0), one(n, 5.0), one(F.lit(3.0), 5.0))).otherwise(F.concat_ws(", ", one(q, 5.0), one(n, 7.0), one(q + 20, 9.0)))
    text = F.concat(F.when(k % 5 == 4, "").otherwise("<think>look</think> "), F.lit("at ["), points, F.lit("]"))
    d = T.held(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("x")), p=P.points_of(P.after_thoughts(F.col("x"))))
    r = d.select("l_orderkey", "l_linenumber", P.point_score(F.col("p"), F.lit(0.0), F.lit(0.0), F.lit(20.0), F.lit(10.0)).alias("r"))
    return r.select("l_orderkey", "l_linenumber", r6("r.score").alias("score"), r6("r.accuracy").alias("accuracy"), "r.num_pred", "r.first_correct", "r.only_correct", "r.is_collinear")


