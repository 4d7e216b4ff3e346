"""The given tables in the roles that the operators expect.

Each role is one SELECT that Spark and DuckDB both understand, so a query and its
oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from decilog.session import table

ROLES = {
    # observed actions: cluster = a bucket of users, session = a day
    "obs": """SELECT event_id AS obs_id, concat('c', CAST(user_id % 20 AS VARCHAR(9))) AS cluster_key, user_id,
        event_type AS action, value, ts, CAST(CAST(ts AS DATE) AS VARCHAR(10)) AS session_id,
        value > 100 AS sparse, CASE WHEN value > 5 THEN value / 100 END AS distance,
        CASE WHEN event_id % 3 = 0 THEN 'sim' ELSE 'hh' END AS source FROM events""",
    # one metric row per session and cluster
    "metrics": """SELECT session_id, cluster_key, avg(value) / 100 AS value, min(ts) AS ts, count(*) AS n FROM obs GROUP BY session_id, cluster_key""",
    # strategy nodes of clusters, several per cluster, some inactive
    "nodes": """SELECT concat('n', CAST(c_custkey AS VARCHAR(19))) AS node_id, concat('c', CAST(c_custkey % 23 AS VARCHAR(19))) AS cluster_key,
        c_custkey AS created_at, c_acctbal > 3000 AS active, lower(c_mktsegment) AS source, c_nationkey = 3 AS locked,
        c_acctbal / 10000 AS gto_score FROM customer""",
    "suppressions": """SELECT concat('c', CAST(s_suppkey % 20 AS VARCHAR(19))) AS cluster_key, s_acctbal < 100 AS active, s_suppkey AS ts FROM supplier""",
    # a corpus of vectors with a hard-filter key, a validity interval and weights
    "corpus": """SELECT vec_id AS id, embedding AS vec, label % 2 AS part, CASE label % 5 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'error' END AS action, label,
        0.5 + (vec_id % 5) / 10.0 AS confidence, 1 - (vec_id % 3) / 10.0 AS gto_score,
        vec_id AS added_at, CASE WHEN vec_id % 7 = 0 THEN vec_id + 200 ELSE 0 END AS removed_at, vec_id % 11 <> 0 AS active,
        (vec_id * 13) % 400 AS spr FROM embeddings""",
    # corpus rows as voters: raw labels with sizes, and for a third of them shares of several labels, some of which name no action
    "voters": """SELECT id, vec, part, active, confidence, gto_score, CASE label % 5 WHEN 0 THEN 'bet' WHEN 1 THEN 'raise' WHEN 2 THEN 'call' WHEN 3 THEN 'check' ELSE 'odd' END AS action,
        CAST(id % 9 AS DOUBLE) / 4 AS size_frac, CASE WHEN id % 6 > 0 THEN CAST(id % 12 AS DOUBLE) / 2 END AS raise_ratio, id % 29 = 0 AS allin FROM corpus""",
    "shares": """SELECT id, 'bet' AS action, CAST(spr % 6 AS DOUBLE) / 10 AS share FROM corpus WHERE id % 3 = 0 UNION ALL
        SELECT id, 'raise' AS action, CAST(id % 4 AS DOUBLE) / 10 - CAST(0.1 AS DOUBLE) AS share FROM corpus WHERE id % 3 = 0 UNION ALL
        SELECT id, 'muck' AS action, CAST(0.25 AS DOUBLE) AS share FROM corpus WHERE id % 3 = 0 UNION ALL
        SELECT id, 'fold' AS action, CAST(0.5 AS DOUBLE) AS share FROM corpus WHERE id % 12 = 0""",
    # equities by a key that three quarters of the moves have
    "equity": """SELECT l_partkey % 64 AS eq_key, CAST(sum(amount) AS DOUBLE) / count(*) / 60 AS mean, CAST(count(*) % 7 AS DOUBLE) / 20 AS variance FROM moves WHERE l_partkey % 64 < 48 GROUP BY l_partkey % 64""",
    # solved distributions of clusters: the newest solve of each
    "targets": """SELECT cluster_key, 'view' AS action, 1 - s AS p FROM (SELECT cluster_key, max_by(exploitability, solve_id) / 200 AS s FROM solves GROUP BY cluster_key) t UNION ALL
        SELECT cluster_key, 'purchase' AS action, s AS p FROM (SELECT cluster_key, max_by(exploitability, solve_id) / 200 AS s FROM solves GROUP BY cluster_key) u""",
    # decisions of a hand: an order's lines in a total order
    "moves": """SELECT l_orderkey AS hand_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) - 1 AS seq,
        CASE WHEN l_linenumber <= 2 THEN 'preflop' WHEN l_linenumber <= 4 THEN 'flop' WHEN l_linenumber <= 6 THEN 'turn' ELSE 'river' END AS street,
        CASE WHEN l_linenumber <= 2 THEN 0 WHEN l_linenumber <= 4 THEN 1 WHEN l_linenumber <= 6 THEN 2 ELSE 3 END AS street_no,
        CASE l_suppkey % 6 WHEN 0 THEN 'UTG' WHEN 1 THEN 'MP' WHEN 2 THEN 'CO' WHEN 3 THEN 'BTN' WHEN 4 THEN 'SB' ELSE 'BB' END AS actor,
        CASE WHEN l_linestatus = 'F' AND l_quantity < 12 THEN 'fold' WHEN l_returnflag = 'A' THEN 'raise' WHEN l_returnflag = 'R' THEN 'call'
             WHEN l_quantity > 40 THEN 'bet' ELSE 'check' END AS action,
        CAST(l_quantity AS BIGINT) AS amount, 5000 - l_partkey % 1000 AS stack_after, l_partkey, l_suppkey, l_extendedprice AS price, l_shipdate AS ts
        FROM lineitem""",
    "payoffs": """SELECT o_orderkey AS hand_id, o_totalprice / 1000 - 150 AS bb_delta, o_custkey, o_orderpriority AS opponent,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'aborted' END AS status, o_orderdate AS ts FROM orders""",
    # patches of clusters over time
    "patches": """SELECT o_orderkey AS patch_id, concat('c', CAST(o_custkey % 20 AS VARCHAR(19))) AS cluster_key, o_orderdate AS ts,
        CASE WHEN o_orderkey % 4 = 0 THEN 'manual' ELSE 'autoloop' END AS source,
        concat('n', CAST(o_custkey AS VARCHAR(19))) AS new_node_id, CASE WHEN o_orderkey % 3 = 0 THEN concat('n', CAST(o_custkey - 1 AS VARCHAR(19))) END AS prev_node_id,
        o_totalprice / 1000000 AS pre_loss, CASE WHEN o_orderstatus = 'P' THEN 'rolled_back' ELSE 'applied' END AS status FROM orders""",
    # solves of clusters: newest counts
    "solves": """SELECT concat('c', CAST(o_custkey % 25 AS VARCHAR(19))) AS cluster_key, o_orderkey AS solve_id, o_totalprice / 5000 AS exploitability, o_orderdate AS solved_at FROM orders""",
    # a lookup table with an exact key, a prefix and a value
    "lookup": """SELECT concat(p_brand, '|', p_type, '|', CAST(p_size AS VARCHAR(9))) AS k, concat(p_brand, '|', p_type) AS prefix, p_brand, p_type, min(p_retailprice) AS v FROM part WHERE p_size % 3 <> 0 GROUP BY p_brand, p_type, p_size""",
}


def uses(sql: str) -> list[str]:
    """The roles that a statement names, each after those that it needs."""
    found: list[str] = []
    for name, body in ROLES.items():
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            found += [x for x in [*uses(body), name] if x not in found]
    return found


def with_roles(sql: str) -> str:
    """DuckDB SQL with the named roles as common table expressions in front."""
    names = uses(sql)
    head = ", ".join(f"{n} AS ({ROLES[n]})" for n in names)
    if not head:
        return sql
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {sql[14:]}"
    if sql.upper().startswith("WITH"):
        return f"WITH {head}, {sql[4:]}"
    return f"WITH {head} {sql}"


def role(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A role's DataFrame over the tables in ``sf_dir``, or over those given by name."""
    body, frames = ROLES[name], {}
    for x in set(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", body)):
        frames[x] = given[x] if x in given else role(spark, sf_dir, x, **given) if x in ROLES else table(spark, sf_dir, x)
        body = re.sub(rf"\b(FROM|JOIN)\s+{x}\b", rf"\1 {{{x}}}", body)
    return spark.sql(body, **frames)


#: Lines that a task sorts by hand, as near as hands can be dealt out.
TASK_ROWS = 200_000


def ordered_moves(spark: SparkSession, sf_dir: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """The moves for windows over hands: whole hands in as many partitions as keep each near ``task_rows`` lines.

    Every window is sorted within its task, so what a task holds does not grow with the table,
    however many shuffle partitions the session has.
    """
    lines = table(spark, sf_dir, "lineitem")
    parts = max(-(-lines.count() // task_rows), spark.sparkContext.defaultParallelism)
    return role(spark, sf_dir, "moves", lineitem=lines.repartition(parts, "l_orderkey"))
