"""Data sets: sources, sinks, row builders, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.functions.numeric import hash_key, r6
from colloquy.functions.texts import cascade_failure
from colloquy.operators import datasets as DS
from colloquy.operators import graph as G
from colloquy.operators import retrieval
from colloquy.plans.base import query
from colloquy.plans.text import _CASES, _FAILURE, _cases
from colloquy.sources import cache, files
from colloquy.sources.views import table, view

R = ("rollouts",)
K = ("kg_edges",)
Q = ("qa_cases",)


def _tmp(spark: SparkSession) -> str:
    import uuid

    return f"{cache.shared_dir(spark)}/{uuid.uuid4().hex}"


@query("a1", "SELECT event_id, event_type, value FROM events")
def a1(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines out and in."""
    path = _tmp(spark)
    files.write_jsonl(table(spark, sf, "events").select("event_id", "event_type", "value"), path)
    return files.read_jsonl(spark, path, "event_id long, event_type string, value double")


@query("a2", "SELECT event_id % 7 = 0 AS bad, count(*) AS n FROM events GROUP BY 1")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import types as T

    path = _tmp(spark)
    e = table(spark, sf, "events")
    e.select(F.when(F.col("event_id") % 7 == 0, F.lit('{"event_id": ')).otherwise(F.to_json(F.struct("event_id"))).alias("value")).write.text(path)
    good, bad = files.read_jsonl_checked(spark, path, T.StructType([T.StructField("event_id", T.LongType())]))
    count = lambda df, flag: df.agg(F.count("*").alias("n")).select(F.lit(flag).alias("bad"), "n")
    return count(good, False).unionByName(count(bad, True))


@query("a3", "SELECT disease, symptom, round(weight, 6) + 0.0 AS weight FROM kg_edges UNION ALL SELECT 'listed', 'sign', 1.0", K)
def a3(spark: SparkSession, sf: str) -> DataFrame:
    """A graph in JSON documents, one a disease, and one with a list entry and one of no use, read back side by side."""
    path = _tmp(spark)
    e = view(spark, sf, "kg_edges").groupBy("disease").agg(F.map_from_entries(F.collect_list(F.struct("symptom", "weight"))).alias("m"))
    one = F.concat(F.substring(F.to_json(F.create_map("disease", "m")), F.lit(1), F.length(F.to_json(F.create_map("disease", "m"))) - 1), F.lit("}"))
    odd = spark.range(1).select(F.lit('{"listed": ["sign"], "odd": 3}').alias("value"))
    e.select(one.alias("value")).unionByName(odd).write.text(path)
    return G.read_graph(spark, path, wholetext=False).select("disease", "symptom", r6("weight").alias("weight"))


@query("a4", "SELECT n_nationkey AS key, n_name AS name, NULL::VARCHAR AS segment FROM nation UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def a4(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _tmp(spark), _tmp(spark)
    table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")).write.parquet(a)
    table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")).write.parquet(b)
    return files.read_tables(spark, [a, b])


@query("a6", "SELECT conv_id, turn, role, text FROM conversations")
def a6(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.array(F.struct("role", F.struct("text").alias("body"))).alias("message"))
    return d.select("conv_id", "turn", files.nested(d, ["message", "role"]).alias("role"), files.nested(d, ["message", "body", "text"]).alias("text"))


@query("a7", """SELECT conv_id, turn, concat('{"role":"', role, '","turn":', CAST(turn AS VARCHAR), '}') AS message FROM conversations""")
def a7(spark: SparkSession, sf: str) -> DataFrame:
    """Nested columns as JSON strings, written and read."""
    path = _tmp(spark)
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.struct("role", "turn").alias("message"))
    files.as_json_columns(d).write.parquet(path)
    return spark.read.parquet(path)


@query("a10", "SELECT o_orderstatus AS split, count(*) AS n FROM orders GROUP BY 1")
def a10(spark: SparkSession, sf: str) -> DataFrame:
    path = _tmp(spark)
    files.write_splits(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("split")), path)
    return spark.read.parquet(f"{path}/parquet").groupBy("split").agg(F.count("*").alias("n"))


@query("a11", "SELECT s_suppkey, upper(s_name) AS s_name FROM supplier")
def a11(spark: SparkSession, sf: str) -> DataFrame:
    path = _tmp(spark)
    table(spark, sf, "supplier").select("s_suppkey", "s_name").write.parquet(path)
    return files.rewrite(spark, path, lambda df: df.withColumn("s_name", F.upper("s_name")))


@query("a14", "SELECT step, sample_id, CASE WHEN score > 90 THEN NULL ELSE score END AS score FROM rollouts", R)
def a14(spark: SparkSession, sf: str) -> DataFrame:
    path = _tmp(spark)
    d = view(spark, sf, "rollouts").select("step", "sample_id", F.when(F.col("score") > 90, float("nan")).otherwise(F.col("score")).alias("score"))
    files.dump_steps(d, path)
    return spark.read.schema("sample_id long, score double, step long").json(path)


@query("a15", "SELECT uid, count(*) AS n FROM rollouts GROUP BY 1", R)
def a15(spark: SparkSession, sf: str) -> DataFrame:
    path = _tmp(spark)
    cache.materialize(view(spark, sf, "rollouts").groupBy("uid").agg(F.count("*").alias("n")), path)
    return cache.materialize(spark.createDataFrame([], "uid string, n long"), path)


@query("a16", "SELECT 'a' AS name, count(*) AS n FROM supplier UNION ALL SELECT 'b', count(*) FROM customer")
def a16(spark: SparkSession, sf: str) -> DataFrame:
    path = _tmp(spark)
    files.append_named(table(spark, sf, "supplier").select(F.col("s_name").alias("x")), path, "a")
    files.append_named(table(spark, sf, "customer").select(F.col("c_name").alias("x")), path, "b")
    return spark.read.parquet(path).groupBy("name").agg(F.count("*").alias("n"))


def _suppliers(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    first = F.broadcast(s.agg(F.min("s_suppkey").alias("_first")))
    return s.crossJoin(first).select((F.col("s_suppkey") - F.col("_first")).cast("long").alias("row_id"), F.col("s_name").alias("name"))


_MAN = "SELECT step % 3 AS split, data_source, pred, len(string_split(uid, '-')) + step % 4 AS n FROM rollouts"


@query(
    "d4",
    f"""SELECT split, data_source, pred, count(*) AS n, CAST(min(n) AS BIGINT) AS least, CAST(max(n) AS BIGINT) AS most, round(avg(n), 6) + 0.0 AS mean FROM ({_MAN}) t GROUP BY GROUPING SETS ((split), (split, data_source), (split, pred))""",
    R,
)
def d4(spark: SparkSession, sf: str) -> DataFrame:
    """A18 and D4."""
    facts = F.sequence(F.lit(1).cast("long"), F.size(F.split("uid", "-")) + F.col("step") % 4)
    m = files.manifest(view(spark, sf, "rollouts").select((F.col("step") % 3).alias("split"), "data_source", "pred", facts.alias("facts")), "split", "data_source", "pred", "facts")
    return m.select("split", "data_source", "pred", "n", F.col("least").cast("long").alias("least"), F.col("most").cast("long").alias("most"), r6("mean").alias("mean"))


@query("d30", "SELECT (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_returnflag = 'A') AS n_a, (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')) AS n_shared")
def d30(spark: SparkSession, sf: str) -> DataFrame:
    """D30 and G2."""
    li = table(spark, sf, "lineitem")
    a, r = li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'")
    return a.agg(F.countDistinct("l_suppkey").alias("n_a")).crossJoin(DS.overlap(a, r, "l_suppkey"))


@query("d32", "SELECT o_orderstatus AS split, count(*) AS n, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS changed FROM orders GROUP BY 1")
def d32(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("split")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("changed"))


@query("b1", "SELECT event_id AS id, event_type FROM events")
def b1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").drop("props", "ts").withColumnsRenamed({"event_id": "id"}).select("id", "event_type")


@query("b2", "SELECT event_id FROM events WHERE event_id BETWEEN 10 AND 400 AND event_id % 3 = 1")
def b2(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").where(F.col("event_id").between(10, 400) & (F.col("event_id") % 3 == 1)).select("event_id")


@query("b15", "SELECT doc_id, coalesce(answer, nullif(trim(regexp_extract(user_content, '(?s)Problem:(.{1,10})', 1)), ''), 'none') AS label FROM qa_cases WHERE length(coalesce(answer, user_content)) > 0", Q)
def b15(spark: SparkSession, sf: str) -> DataFrame:
    label = F.coalesce("answer", F.nullif(F.trim(F.regexp_extract("user_content", "(?s)Problem:(.{1,10})", 1)), F.lit("")), F.lit("none"))
    return view(spark, sf, "qa_cases").where(F.length(F.coalesce("answer", "user_content")) > 0).select("doc_id", label.alias("label"))


@query("b19", "SELECT sample_id, concat(solution, ' Think step by step.') AS prompt, replace(regexp_extract(solution, '#### (-?[0-9.,]+)', 1), ',', '') AS answer FROM responses WHERE data_source = 'openai/gsm8k'", ("responses",))
def b19(spark: SparkSession, sf: str) -> DataFrame:
    """One projection from a source's row to the canonical row."""
    r = view(spark, sf, "responses").where("data_source = 'openai/gsm8k'")
    rows = DS.canonical(r, prompt=F.concat("solution", F.lit(" Think step by step.")), answer=F.replace(F.regexp_extract("solution", r"#### (-?[0-9.,]+)", 1), F.lit(","), F.lit("")), source="openai/gsm8k", style="rule", split="train", index=F.col("sample_id"))
    return rows.select(F.col("extra_info.index").alias("sample_id"), F.col("prompt")[0]["content"].alias("prompt"), F.col("reward_model.ground_truth").alias("answer"))


@query("b22", "SELECT o_orderkey, 'chosen' AS kind, o_orderpriority AS response FROM orders UNION ALL SELECT o_orderkey, 'rejected', o_orderstatus FROM orders")
def b22(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("chosen"), F.col("o_orderstatus").alias("rejected"))
    return o.unpivot(["o_orderkey"], ["chosen", "rejected"], "kind", "response")


@query("b25", "SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'new prompt' ELSE text END AS text, turn = 0 AND text <> 'new prompt' AS changed FROM conversations")
def b25(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "conversations").withColumn("prompt", F.array(F.struct(F.when(F.col("turn") == 0, "system").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"))))
    first = d.where("turn = 0")
    return DS.with_system_prompt(first, "new prompt").select("conv_id", "turn", F.col("prompt")[0]["content"].alias("text"), "changed").unionByName(d.where("turn <> 0").select("conv_id", "turn", "text", F.lit(False).alias("changed")))


@query("c10", "SELECT event_id, event_type, value * 2 AS twice FROM events")
def c10(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return DS.unite(e.select("event_id", "event_type"), e.select("event_id", "event_type", (F.col("value") * 2).alias("twice")), "event_id")


@query(
    "c17",
    """WITH q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.qid, d.vec_id, round(list_sum(list_transform(list_zip(q.e, d.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))), 6) + 0.0 AS score FROM q, embeddings d)
SELECT qid, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) <= 3""",
)
def c17(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return retrieval.dense(q, e.select("vec_id", "embedding"), 3).select("qid", "vec_id", "score")


@query(
    "c17_bm25",
    """WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '')) AS w FROM documents),
tf AS (SELECT doc_id, w, count(*) AS tf FROM t GROUP BY 1, 2), len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1), st AS (SELECT count(*) AS n, avg(len) AS avg_len FROM len), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '')) AS w FROM benchmark WHERE item_id % 50 = 0),
s AS (SELECT item_id, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))) AS score FROM q JOIN tf ON tf.w = q.w JOIN df ON df.w = q.w JOIN len ON len.doc_id = tf.doc_id, st GROUP BY 1, 2)
SELECT item_id, doc_id, round(score, 4) + 0.0 AS score FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 4) DESC, doc_id) <= 3""",
)
def c17_bm25(spark: SparkSession, sf: str) -> DataFrame:
    """Items whose id is divisible by 50 against all documents of all languages."""
    q = table(spark, sf, "benchmark").where("item_id % 50 = 0")
    return retrieval.bm25(q, table(spark, sf, "documents"), "item_id", "doc_id", 3)


@query("f17", "SELECT p_partkey, string_agg(o, ',' ORDER BY h) AS options FROM (SELECT p_partkey, o, md5('1|' || CAST(p_partkey AS VARCHAR) || '|' || o) AS h FROM (SELECT p_partkey, unnest([p_brand, p_type, p_name]) AS o FROM part) t) u GROUP BY 1")
def f17(spark: SparkSession, sf: str) -> DataFrame:
    x = F.transform(F.array("p_brand", "p_type", "p_name"), lambda o: F.struct(hash_key("1", F.col("p_partkey"), o).alias("h"), o.alias("o")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(F.array_sort(x), lambda s: s["o"]), ",").alias("options"))


@query("g1", "SELECT 'c' AS kind, c_name AS name FROM customer UNION ALL SELECT 's', s_name FROM supplier")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.lit("c").alias("kind"), F.col("c_name").alias("name")).unionByName(table(spark, sf, "supplier").select(F.col("s_name").alias("name"), F.lit("s").alias("kind")))


@query("g3", "SELECT DISTINCT l_suppkey FROM lineitem WHERE l_linenumber = 1 EXCEPT SELECT l_suppkey FROM lineitem WHERE l_linenumber = 6 AND l_quantity = 50 AND l_discount > 0.08")
def g3(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.where("l_linenumber = 1").select("l_suppkey").distinct().join(li.where("l_linenumber = 6 AND l_quantity = 50 AND l_discount > 0.08"), "l_suppkey", "left_anti")


@query("g5", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE n_chars > 100 GROUP BY text")
def g5(spark: SparkSession, sf: str) -> DataFrame:
    """Exact copies by hash of the text, then a quality filter."""
    d = table(spark, sf, "documents").where("n_chars > 100").groupBy(F.sha2("text", 256).alias("h"))
    return d.agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("g6", "SELECT event_id * 3 + k AS event_id, event_type FROM events, range(3) r(k)")
def g6(spark: SparkSession, sf: str) -> DataFrame:
    return DS.repeat(table(spark, sf, "events").select("event_id", "event_type"), 3, "event_id").select("event_id", "event_type")


@query("g7", "SELECT vec_id, k AS chunk, array_to_string(list_transform(embedding[k * 16 + 1:k * 16 + 16], lambda x: CAST(CAST(floor(x * 100) AS BIGINT) AS VARCHAR)), ' ') AS part FROM embeddings, range(4) r(k)")
def g7(spark: SparkSession, sf: str) -> DataFrame:
    d = DS.unfold_arrays(table(spark, sf, "embeddings"), ["embedding"], 4)
    return d.select("vec_id", F.col("chunk").cast("long").alias("chunk"), F.array_join(F.transform("embedding", lambda x: F.floor(x * F.lit(100).cast("float")).cast("string")), " ").alias("part"))


@query("g8", "SELECT event_id // 4 AS fold, string_agg(event_type, ',' ORDER BY event_id) AS kinds FROM events GROUP BY 1")
def g8(spark: SparkSession, sf: str) -> DataFrame:
    x = F.sort_array(F.collect_list(F.struct("event_id", "event_type")))
    d = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 4).alias("fold")).agg(x.alias("x"))
    return d.select("fold", F.array_join(F.transform("x", lambda r: r["event_type"]), ",").alias("kinds"))


@query("g9", "WITH s AS (SELECT CAST(s_suppkey AS BIGINT) - (SELECT min(s_suppkey) FROM supplier) AS row_id, s_name AS name, (SELECT count(*) FROM supplier) AS n FROM supplier) SELECT row_id, name, false AS is_pad FROM s UNION ALL SELECT row_id + n, name, true FROM s WHERE row_id < (7 - n % 7) % 7")
def g9(spark: SparkSession, sf: str) -> DataFrame:
    """Rows padded to a multiple of 7."""
    return DS.pad_to(_suppliers(spark, sf), 7, "row_id")


@query("g10", "WITH s AS (SELECT CAST(s_suppkey AS BIGINT) - (SELECT min(s_suppkey) FROM supplier) AS row_id, (SELECT count(*) FROM supplier) AS n FROM supplier) SELECT row_id, CAST(row_id * 5 // n AS BIGINT) AS chunk FROM s")
def g10(spark: SparkSession, sf: str) -> DataFrame:
    return DS.chunked(_suppliers(spark, sf).select("row_id"), 5, "row_id")


@query("g11", "SELECT conv_id, string_agg(role || CAST(turn AS VARCHAR), ',' ORDER BY turn) AS pairs FROM conversations GROUP BY 1")
def g11(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays of structs to struct of arrays and back."""
    x = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"))
    wide = x.select("conv_id", F.col("x.turn").alias("turn"), F.col("x.role").alias("role"))
    return wide.select("conv_id", F.array_join(F.transform(F.arrays_zip("turn", "role"), lambda r: F.concat(r["role"], r["turn"].cast("string"))), ",").alias("pairs"))


@query(
    "g12",
    "SELECT event_id, CAST(e AS INTEGER) AS epoch, (row_number() OVER (PARTITION BY e ORDER BY md5('12|' || CAST(e AS VARCHAR) || '|' || CAST(event_id AS VARCHAR)), event_id) - 1) // 32 AS batch FROM events, range(2) r(e)",
)
def g12(spark: SparkSession, sf: str) -> DataFrame:
    from colloquy.operators.sampling import epoch_order

    return epoch_order(table(spark, sf, "events").select("event_id"), "event_id", 2, "12", 32).select("event_id", "epoch", "batch")


@query("h25", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS loss_mask, length(text) AS n FROM conversations")
def h25(spark: SparkSession, sf: str) -> DataFrame:
    """Loss on assistant spans only."""
    d = table(spark, sf, "conversations")
    return d.select("conv_id", "turn", (F.col("role") == "assistant").cast("int").alias("loss_mask"), F.length("text").cast("long").alias("n"))


@query(
    "i13",
    """WITH g AS (SELECT disease, disease_group, symptom, weight, row_number() OVER (PARTITION BY disease ORDER BY weight DESC, symptom) AS rank FROM kg_edges),
c AS (SELECT disease, disease_group, string_agg(symptom, ',' ORDER BY rank) AS pool, max(symptom) FILTER (WHERE rank = 1) AS top FROM g WHERE rank <= 6 GROUP BY 1, 2 HAVING count(*) >= 3)
SELECT disease, disease_group, pool, concat(CASE CAST(('0x' || substr(md5('21|' || disease), 1, 4)) AS INTEGER) % 2 WHEN 0 THEN 'I have ' ELSE 'My problem is ' END, top) AS chief_complaint FROM c""",
    K,
)
def i13(spark: SparkSession, sf: str) -> DataFrame:
    """Cases from clean edges."""
    return DS.cases(view(spark, sf, "kg_edges"), 3, 6, ["I have ", "My problem is "], "21").select("disease", "disease_group", F.array_join("pool", ",").alias("pool"), "chief_complaint")


@query("b20", "SELECT p_partkey, concat(upper(substr(p_name, 1, 1)), lower(substr(p_name, 2)), ': ', p_type) AS context, array_to_string([trim(p_brand), trim(p_type)], '|') AS choices, CAST(p_size % 2 AS INTEGER) AS label FROM part")
def b20(spark: SparkSession, sf: str) -> DataFrame:
    """Multiple choice: clean context, choices, integer label."""
    context = F.concat(F.upper(F.substring("p_name", 1, 1)), F.lower(F.expr("substr(p_name, 2)")), F.lit(": "), "p_type")
    choices = F.transform(F.array("p_brand", "p_type"), lambda x: F.trim(x))
    return table(spark, sf, "part").select("p_partkey", context.alias("context"), F.array_join(choices, "|").alias("choices"), (F.col("p_size") % 2).cast("int").alias("label"))


@query("b21", "SELECT sample_id, concat('searchR1_', data_source) AS data_source, coalesce(nullif(ground_truth, '7'), solution) AS answer FROM responses", ("responses",))
def b21(spark: SparkSession, sf: str) -> DataFrame:
    """Search questions: tagged source, label with a fallback."""
    r = view(spark, sf, "responses")
    return r.select("sample_id", F.concat(F.lit("searchR1_"), "data_source").alias("data_source"), F.coalesce(F.nullif("ground_truth", F.lit("7")), "solution").alias("answer"))


@query(
    "b23",
    """WITH o AS (SELECT p_partkey, p_brand AS correct, unnest([p_brand, p_type, p_name]) AS o FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY md5('5|' || CAST(p_partkey AS VARCHAR) || '|' || o)) AS k FROM o)
SELECT p_partkey, string_agg(chr(CAST(64 + k AS INT)) || ') ' || o, ' ' ORDER BY k) AS options, max(chr(CAST(64 + k AS INT))) FILTER (WHERE o = correct) AS letter FROM r GROUP BY 1""",
)
def b23(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark rows: options in hash order with letters, and the right letter."""
    x = F.array_sort(F.transform(F.array("p_brand", "p_type", "p_name"), lambda o: F.struct(hash_key("5", F.col("p_partkey"), o).alias("h"), o.alias("o"))))
    d = table(spark, sf, "part").select("p_partkey", "p_brand", F.transform(x, lambda s: s["o"]).alias("o"))
    lettered = F.transform("o", lambda o, i: F.concat(F.chr(65 + i), F.lit(") "), o))
    return d.select("p_partkey", F.array_join(lettered, " ").alias("options"), F.chr(64 + F.array_position("o", F.col("p_brand"))).alias("letter"))


@query("b24", "SELECT event_id, 'train' AS split, event_type AS kind, CAST(user_id AS VARCHAR) AS user FROM events")
def b24(spark: SparkSession, sf: str) -> DataFrame:
    """Extra keys carried along; a row's own keys win."""
    own = F.create_map(F.lit("split"), F.lit("train"), F.lit("kind"), F.col("event_type"))
    extra = F.create_map(F.lit("user"), F.col("user_id").cast("string"), F.lit("kind"), F.lit("lost"))
    both = DS.merged_map(own, extra)
    return table(spark, sf, "events").select("event_id", both["split"].alias("split"), both["kind"].alias("kind"), both["user"].alias("user"))


@query("d6", f"WITH {_CASES}, f AS (SELECT info, {_FAILURE} AS failure FROM c) SELECT count(*) AS total, count(*) FILTER (WHERE failure = 'fail_diag_keyword') AS fail_diag_keyword, count(*) FILTER (WHERE failure = 'fail_answer_type') AS fail_answer_type, count(*) FILTER (WHERE failure = 'fail_no_symptoms') AS fail_no_symptoms, count(*) FILTER (WHERE failure IS NULL) AS passed, round(CAST(count(*) FILTER (WHERE failure IS NULL AND lower(info) = 'heart failure') AS DOUBLE) / greatest(count(*) FILTER (WHERE failure IS NULL), 1), 6) + 0.0 AS covered FROM f", Q)
def d6(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by stage of the cascade, and the share of what passed whose answer is a known disease."""
    known = spark.createDataFrame([("heart failure",)], "disease string")
    d = _cases(spark, sf).select(F.lower(F.trim("info")).alias("disease"), cascade_failure(F.col("question"), F.col("info"), F.col("facts")).alias("failure"))
    d = G.hit_flag(d, known, "disease", "known")
    n = lambda stage: F.count_if(F.col("failure") == stage).alias(stage)
    passed = F.col("failure").isNull()
    return d.agg(F.count("*").alias("total"), n("fail_diag_keyword"), n("fail_answer_type"), n("fail_no_symptoms"), F.count_if(passed).alias("passed"), r6(F.count_if(passed & F.col("known")) / F.greatest(F.count_if(passed), F.lit(1))).alias("covered"))


@query(
    "d12",
    """SELECT data_source, step % 2 AS half, count(*) AS n, round(avg(CASE WHEN pred = 'click' THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy, round(avg(CASE WHEN pred IN ('click', 'view') THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS answer_rate,
round(avg(CASE WHEN resp_len < 5 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS invalid_rate, round(avg(resp_len), 6) + 0.0 AS turns, round(avg(score / 100.0), 6) + 0.0 AS coverage FROM rollouts GROUP BY ROLLUP (data_source, step % 2)""",
    R,
)
def d12(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation by split, with totals."""
    from colloquy.operators.metrics import evaluation_summary

    r = view(spark, sf, "rollouts").select("data_source", (F.col("step") % 2).alias("half"), (F.col("pred") == "click").alias("correct"), F.col("pred").isin("click", "view").alias("has_final"), (F.col("resp_len") < 5).alias("invalid"), F.col("resp_len").alias("turn_count"), (F.col("score") / 100.0).alias("coverage"))
    d = evaluation_summary(r, ["data_source", "half"])
    return d.select("data_source", "half", "n", *(r6(c).alias(c) for c in d.columns[3:]))


@query(
    "d33",
    """WITH b AS (SELECT *, score - 0.1 * resp_len AS reward, 1 + sample_id % 40 AS prompt_len FROM rollouts),
k AS (SELECT uid, step, score, resp_len, row_number() OVER (PARTITION BY uid ORDER BY sample_id) AS slot FROM b QUALIFY count(*) OVER (PARTITION BY uid) >= 2),
t AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, slot) AS r FROM k WHERE slot <= 2),
p AS (SELECT uid, max(step) FILTER (WHERE r = 1) AS step, max(-resp_len / 50.0) FILTER (WHERE r = 1) AS c, max(-resp_len / 50.0) FILTER (WHERE r = 2) AS j, max(-resp_len / 60.0) FILTER (WHERE r = 1) AS rc, max(-resp_len / 40.0) FILTER (WHERE r = 2) AS rj FROM t GROUP BY 1),
l AS (SELECT step, avg((c - j) - (rc - rj)) AS logits, avg(c) AS chosen_lp, avg(j) AS rejected_lp FROM p GROUP BY 1)
SELECT b.step, """
    + ", ".join(f"round(CAST({f}({x}) AS DOUBLE), 6) + 0.0 AS {n}_{t}" for n, x in (("score", "score"), ("reward", "reward"), ("length", "resp_len"), ("prompt", "prompt_len")) for f, t in (("avg", "mean"), ("max", "max"), ("min", "min")))
    + """, round(avg(CASE WHEN resp_len = 97 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS clip_ratio, round(avg(CASE WHEN prompt_len = 40 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS prompt_clip_ratio,
round(max(logits), 6) + 0.0 AS logits, round(max(chosen_lp), 6) + 0.0 AS chosen_lp, round(max(rejected_lp), 6) + 0.0 AS rejected_lp FROM b LEFT JOIN l ON l.step = b.step GROUP BY b.step""",
    R,
)
def d33(spark: SparkSession, sf: str) -> DataFrame:
    """Preference runs: figures of all rows, log-probabilities and logits of the pairs, by step."""
    from colloquy.operators.metrics import preference_metrics

    w = Window.partitionBy("uid")
    b = view(spark, sf, "rollouts").withColumns({"reward": F.col("score") - 0.1 * F.col("resp_len"), "prompt_len": 1 + F.col("sample_id") % 40})
    d = b.withColumns({"slot": F.row_number().over(w.orderBy("sample_id")), "n": F.count("*").over(w)}).where("n >= 2 AND slot <= 2")
    d = d.withColumn("r", F.row_number().over(w.orderBy(F.desc("score"), "slot")))
    of = lambda r, by: F.max(F.when(F.col("r") == r, -F.col("resp_len") / by))
    pairs = d.groupBy("uid").agg(F.max(F.when(F.col("r") == 1, F.col("step"))).alias("step"), of(1, 50.0).alias("chosen_lp"), of(2, 50.0).alias("rejected_lp"), of(1, 60.0).alias("ref_chosen_lp"), of(2, 40.0).alias("ref_rejected_lp"))
    m = preference_metrics(b, pairs, 97, 40, "step")
    return m.select("step", *(r6(c).alias(c) for c in m.columns[1:]))


@query("d11", "SELECT metric, round(value, 6) + 0.0 AS value FROM (SELECT avg(CASE WHEN pred IN ('click', 'view') THEN 1.0 ELSE 0.0 END)::DOUBLE AS valid_rate, (count(*) FILTER (WHERE pred = 'click') / nullif(count(*) FILTER (WHERE pred IN ('click', 'view')), 0))::DOUBLE AS accuracy_of_valid FROM rollouts) t UNPIVOT (value FOR metric IN (valid_rate, accuracy_of_valid))", R)
def d11(spark: SparkSession, sf: str) -> DataFrame:
    """Batch accuracy as a long table."""
    from colloquy.operators.metrics import long

    valid, right = F.col("pred").isin("click", "view"), F.col("pred") == "click"
    m = view(spark, sf, "rollouts").agg(F.avg(valid.cast("double")).alias("valid_rate"), (F.count_if(right) / F.nullif(F.count_if(valid), F.lit(0))).alias("accuracy_of_valid"))
    return long(m.withColumn("_k", F.lit(0)), ["_k"]).select("metric", r6("value").alias("value"))
