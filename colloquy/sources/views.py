"""Rollout, graph, dialogue and token tables as views over the base tables; the text is valid in Spark and DuckDB."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "rollouts": r"""
SELECT concat(CAST(user_id AS STRING), '-', CAST(CAST(ts AS DATE) AS STRING)) AS uid,
       event_id AS sample_id, value AS score, event_type AS pred,
       1 + event_id % 97 AS resp_len,
       CASE WHEN user_id % 3 = 0 THEN 'src_a' WHEN user_id % 3 = 1 THEN 'src_b' ELSE 'src_c' END AS data_source,
       event_id % 20 AS step, ts
FROM events""",
    "kg_edges": r"""
SELECT concat(p_name, ' ', CAST(l_partkey AS STRING)) AS disease,
       concat('finding ', CAST(l_suppkey AS STRING)) AS symptom,
       max(l_discount) + 0.01 AS weight, p_name AS disease_group
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_suppkey % 3 <> 0
GROUP BY p_name, l_partkey, l_suppkey""",
    "episode_turns": r"""
SELECT concat(p_name, ' ', CAST(l_partkey AS STRING)) AS uid,
       concat(CAST(l_partkey AS STRING), '-', CAST(l_orderkey % 4 AS STRING)) AS episode_id,
       concat(p_name, ' ', CAST(l_partkey AS STRING)) AS disease,
       CAST(row_number() OVER (PARTITION BY l_partkey, l_orderkey % 4 ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS turn_id,
       concat('finding ', CAST(l_suppkey AS STRING)) AS fact,
       CASE WHEN l_returnflag = 'R' THEN 'diagnose' ELSE 'ask' END AS action
FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "token_logs": r"""
SELECT l_orderkey AS sample_id, l_orderkey % 500 AS uid,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS BIGINT) AS pos,
       CASE WHEN l_returnflag = 'A' THEN 0 ELSE 1 END AS mask,
       l_discount AS reward, l_tax AS value,
       -l_quantity / 50.0 AS old_lp, -(l_quantity + l_linenumber) / 52.0 AS new_lp, -l_quantity / 48.0 AS ref_lp
FROM lineitem""",
    "tree_nodes": r"""
SELECT o_custkey AS tree_id, n AS node_id,
       CASE WHEN n = 1 THEN NULL ELSE CAST(floor(n / 2.0) AS BIGINT) END AS parent_id,
       CAST(floor(ln(n + 0.5) / ln(2.0)) AS INT) AS level,
       2 * n > cnt AS is_terminal,
       CASE WHEN 2 * n > cnt AND o_orderstatus = 'F' THEN 1.0E0 ELSE 0.0E0 END AS action_reward,
       o_totalprice / 500000.0E0 AS critic_value
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS n,
             count(*) OVER (PARTITION BY o_custkey) AS cnt FROM orders) t""",
    "model_outputs": r"""
SELECT event_id AS sample_id,
       CASE CAST(event_id % 7 AS INT)
         WHEN 0 THEN concat('{"action": "ask", "question": "is it ', event_type, '?"}')
         WHEN 1 THEN concat('```json', chr(10), '{"action": "diagnose", "diagnosis": "', event_type, '"}', chr(10), '```')
         WHEN 2 THEN '<think>{"action": "diagnose"}</think>{"action": {"type": "ask"}, "question": "why?"}'
         WHEN 3 THEN concat('<think>x</think> Question: any ', event_type, '? and more?')
         WHEN 4 THEN concat('Final Answer: ', chr(CAST(65 + event_id % 5 AS INT)))
         WHEN 5 THEN concat('<action>continue</action><question>', event_type, '</question>')
         ELSE concat('no tags ', event_type) END AS text,
       chr(CAST(65 + event_id % 4 AS INT)) AS answer_idx
FROM events""",
    "responses": r"""
SELECT p_partkey AS sample_id, CAST(p_size AS STRING) AS ground_truth,
       CASE CAST(p_partkey % 5 AS INT) WHEN 0 THEN 'openai/gsm8k' WHEN 1 THEN 'searchR1_nq' WHEN 2 THEN 'math_dapo' WHEN 3 THEN 'lighteval/MATH' ELSE 'hiyouga/geometry3k' END AS data_source,
       CASE CAST(p_partkey % 5 AS INT)
         WHEN 0 THEN concat('so #### ', CAST(p_size + p_partkey % 2 AS STRING))
         WHEN 1 THEN concat('<answer>The ', CAST(p_size + p_partkey % 2 AS STRING), '.</answer>', CASE WHEN p_partkey % 3 = 0 THEN repeat('<answer></answer>', 11) ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN concat('<answer>The ', CAST(p_size + p_partkey % 2 AS STRING), '</answer>') ELSE '' END)
         WHEN 2 THEN concat('Answer: ', CAST(p_size + p_partkey % 2 AS STRING))
         WHEN 3 THEN concat('so ', chr(92), 'boxed{x = ', CAST(p_size + p_partkey % 2 AS STRING), chr(92), '%}')
         ELSE concat(CASE WHEN p_partkey % 3 = 0 THEN 'so ' ELSE '<think>t</think>' END, chr(92), 'boxed{', CAST(p_size + p_partkey % 2 AS STRING), chr(92), 'text{ kg}}') END AS solution
FROM part""",
    "qa_cases": r"""
SELECT d.doc_id, d.source,
       concat(substr(d.text, 1, CAST(floor(length(d.text) / 2.0) AS INT)), chr(10), 'Problem: ', substr(d.text, CAST(floor(length(d.text) / 2.0) AS INT) + 1), chr(10), 'Options: {"A": "x", "B": "y"}') AS user_content,
       CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 1 THEN 'A' ELSE 'B' END AS answer
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "dialogue": r"""
SELECT conv_id, turn, role, text FROM conversations""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS as a DataFrame over the tables of ``sf_dir``."""
    sql, own = VIEWS[name], hashlib.md5(sf_dir.encode()).hexdigest()[:12]
    for t in TABLES:  # under names that no user's view has
        sql, n = re.subn(rf"\b(FROM|JOIN) {t}\b", rf"\1 _colloquy_{own}_{t}", sql)
        if n:
            table(spark, sf_dir, t).createOrReplaceTempView(f"_colloquy_{own}_{t}")
    return spark.sql(sql)
