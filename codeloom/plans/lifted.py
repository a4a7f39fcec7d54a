"""A graph lifted from the star-schema tables, by SQL that Spark and other engines run alike.

Table names stand in braces: Spark fills in DataFrames, others the names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NODES = """
SELECT CAST(r_regionkey AS BIGINT) AS node_idx, 'region:' || r_regionkey AS id, r_name AS name, 'PARTICLE' AS type, 'models/region.py' AS file,
       CAST(r_regionkey * 10 + 1 AS INT) AS line_start, CAST(r_regionkey * 10 + 9 AS INT) AS line_end, CAST(0.25 * r_regionkey AS DOUBLE) AS mass FROM {region}
UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), 'nation:' || n_nationkey, n_name, 'PARTICLE', 'models/n' || n_nationkey || '.py', 11, 19, CAST(0.125 * n_nationkey AS DOUBLE) FROM {nation}
UNION ALL SELECT CAST(1000000 + c_custkey AS BIGINT), 'customer:' || c_custkey, c_name, 'TRANSFORM', 'src/m' || (c_custkey % 50) || '.py', CAST(c_custkey % 90 * 10 + 1 AS INT), CAST(c_custkey % 90 * 10 + 9 AS INT), CAST(0.5 AS DOUBLE) FROM {customer}
UNION ALL SELECT CAST(20000000 + s_suppkey AS BIGINT), 'supplier:' || s_suppkey, s_name, 'MEDIATOR', 'lib/s' || (s_suppkey % 7) || '.py', CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS DOUBLE) FROM {supplier}
UNION ALL SELECT CAST(30000000 + p_partkey AS BIGINT), 'part:' || p_partkey, p_name, 'FRONTEND', 'templates/t' || (p_partkey % 20) || '.html', 1, CAST(p_size AS INT), CAST(0.125 * (p_size % 16) AS DOUBLE) FROM {part}
UNION ALL SELECT CAST(1000000000 + o_orderkey AS BIGINT), 'order:' || o_orderkey, 'order_' || o_orderkey, 'VERTEX', 'src/m' || (o_orderkey % 50) || '.py', CAST(o_orderkey % 90 * 10 + 1 AS INT), CAST(o_orderkey % 90 * 10 + 9 AS INT), CAST(0.25 * (o_orderkey % 8) AS DOUBLE) FROM {orders}
UNION ALL SELECT CAST(500000000 + c_custkey AS BIGINT), 'util:' || c_custkey,
       CASE c_custkey % 11 WHEN 0 THEN 'test_util' WHEN 1 THEN 'handle' WHEN 2 THEN '_private' WHEN 3 THEN 'Main' WHEN 4 THEN 'signal_hub' ELSE 'util' || c_custkey END, 'MEDIATOR',
       CASE c_custkey % 13 WHEN 0 THEN 'pkg/__init__.py' WHEN 1 THEN 'a/tests/helpers.py' WHEN 2 THEN 'app/signals.py' WHEN 3 THEN 'app/management/commands/run.py' WHEN 4 THEN 'lib/cli.py'
            WHEN 5 THEN 'lib/calc_test.py' WHEN 6 THEN 'lib/plugin_base.py' ELSE 'lib/u' || (c_custkey % 7) || '.py' END,
       CAST(c_custkey % 90 * 10 + 1 AS INT), CAST(c_custkey % 90 * 10 + 9 AS INT), CAST(NULL AS DOUBLE) FROM {customer}
"""
#: Part to supplier once per line item, so with repeats.
SUPPLY = """
SELECT CAST(l_orderkey * 100 + l_linenumber AS BIGINT) AS edge_idx, 'part:' || l_partkey AS source, 'supplier:' || l_suppkey AS target, 'DEPENDENCY' AS type,
       CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR(9)) AS resolution FROM {lineitem}
"""
EDGES = """
SELECT CAST(1000000000 + o_orderkey AS BIGINT) AS edge_idx, 'order:' || o_orderkey AS source, 'customer:' || o_custkey AS target, 'CALL' AS type, CAST(0.95 AS DOUBLE) AS confidence, 'name' AS resolution FROM {orders}
UNION ALL SELECT CAST(2000000000 + c_custkey AS BIGINT), 'customer:' || c_custkey, 'nation:' || c_nationkey, 'PARTICLE_ENTANGLEMENT', CAST(NULL AS DOUBLE), NULL FROM {customer}
UNION ALL SELECT CAST(3000000000 + n_nationkey AS BIGINT), 'nation:' || n_nationkey, 'region:' || n_regionkey, 'PARTICLE_ENTANGLEMENT', CAST(NULL AS DOUBLE), NULL FROM {nation}
UNION ALL SELECT CAST(3500000000 + n_nationkey AS BIGINT), 'nation:' || n_nationkey, 'nation:' || ((n_nationkey + 1) % 25), 'CALL', CAST(0.4 AS DOUBLE), NULL FROM {nation}
UNION ALL SELECT CAST(4000000000 + s_suppkey AS BIGINT), 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'SERIALIZER_ENTANGLEMENT', CAST(NULL AS DOUBLE), NULL FROM {supplier}
UNION ALL SELECT CAST(4500000000 + c_custkey AS BIGINT), 'util:' || c_custkey, 'util:' || (c_custkey - c_custkey % 4), 'CALL', CAST(0.5 AS DOUBLE), NULL FROM {customer} WHERE c_custkey % 4 IN (1, 2)
UNION ALL SELECT DISTINCT CAST(5000000000 + l_partkey * 1000000 + l_suppkey AS BIGINT), 'part:' || l_partkey, 'supplier:' || l_suppkey, 'DEPENDENCY', CAST(NULL AS DOUBLE), NULL FROM {lineitem}
"""
#: A diff per region: a section per nation, one of them deleting, with two hunks, context and a note.
DIFFS = """
SELECT 'd' || n_regionkey AS diff, CAST(n_nationkey * 100 + n AS BIGINT) AS line_no,
       CASE n WHEN 0 THEN 'diff --git a/models/n' || n_nationkey || '.py b/models/n' || n_nationkey || '.py' WHEN 1 THEN '--- a/models/n' || n_nationkey || '.py'
              WHEN 2 THEN CASE WHEN n_nationkey % 6 = 5 THEN '+++ /dev/null' ELSE '+++ b/models/n' || n_nationkey || '.py' END
              WHEN 3 THEN '@@ -' || (n_nationkey % 9 + 10) || ',3 +' || (n_nationkey % 9 + 10) || ',4 @@ class X' WHEN 4 THEN ' context' WHEN 5 THEN '-old' WHEN 6 THEN '+new' WHEN 7 THEN '+newer'
              WHEN 8 THEN ' context' WHEN 9 THEN '@@ -' || (n_nationkey + 40) || ' +' || (n_nationkey + 41) || ' @@' WHEN 10 THEN '-gone' ELSE '\\ No newline at end of file' END AS line
FROM {nation} CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7
     UNION ALL SELECT 8 UNION ALL SELECT 9 UNION ALL SELECT 10 UNION ALL SELECT 11) AS steps
"""
#: Class-like ids of parts: python:shop.<Name><Suffix>, with a type that the suffix does not decide.
NAMED = """
SELECT CAST(p_partkey AS BIGINT) AS node_idx,
       'python:shop' || (p_partkey % 17) || '.' || upper(substr(p_name, 1, 1)) || substr(replace(p_name, ' ', 'X'), 2) ||
       CASE p_partkey % 8 WHEN 0 THEN 'ListView' WHEN 1 THEN 'CreateView' WHEN 2 THEN 'Serializer' WHEN 3 THEN 'Model' WHEN 4 THEN 'Service' WHEN 5 THEN '.handle_Update' WHEN 6 THEN 'DeleteView' ELSE '' END AS id,
       CASE p_partkey % 6 WHEN 0 THEN 'VERTEX' WHEN 1 THEN 'TRANSFORM' WHEN 2 THEN 'PARTICLE' WHEN 3 THEN 'MEDIATOR' WHEN 4 THEN 'FRONTEND' ELSE 'JAVASCRIPT' END AS type FROM {part}
"""
#: Uses of brands by those ids.
NAMED_EDGES = """
SELECT CAST(p_partkey AS BIGINT) AS edge_idx,
       'python:shop' || (p_partkey % 17) || '.' || upper(substr(p_name, 1, 1)) || substr(replace(p_name, ' ', 'X'), 2) ||
       CASE p_partkey % 8 WHEN 0 THEN 'ListView' WHEN 1 THEN 'CreateView' WHEN 2 THEN 'Serializer' WHEN 3 THEN 'Model' WHEN 4 THEN 'Service' WHEN 5 THEN '.handle_Update' WHEN 6 THEN 'DeleteView' ELSE '' END AS source,
       'python:brands.' || replace(p_brand, '#', '') || 'Model' AS target, CASE WHEN p_partkey % 5 < 2 THEN 'PARTICLE_ENTANGLEMENT' ELSE 'CALL' END AS type FROM {part}
"""
TEMPLATES = """
SELECT 'pages/' || p_type || '/p' || p_partkey || '.html' AS rel_path,
       '<p>{{ ' || replace(p_name, ' ', '_') || '.price }} {{brand' || (p_partkey % 3) || '}}</p>{% if x %}{% endif %}' || CASE WHEN p_size % 4 = 0 THEN '<script src="bootstrap.js"></script>' ELSE '' END ||
       '<script>function f' || p_size || '(a) {} var go' || p_size || ' = (x) => x; document = () => 1; ' ||
       CASE WHEN p_size % 3 = 0 THEN 'async function load' || p_size || '() { fetch(''/api/' || replace(p_type, ' ', '-') || ''') } ' ELSE '' END ||
       CASE WHEN p_size % 5 = 0 THEN 'el.addEventListener("click", f); $(el); ' ELSE '' END || CASE WHEN p_size % 7 = 0 THEN 'L.map(el); axios.get(u);' ELSE '' END || '</script>' AS content FROM {part}
"""


def lift(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The result of one of the statements above on the tables in ``sf_dir``."""
    body = sql
    names = [t for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem") if f"{{{t}}}" in body]
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"codeloom_{t}")
        body = body.replace(f"{{{t}}}", f"codeloom_{t}")
    return spark.sql(body.replace("VARCHAR(9)", "STRING"))


def lift_in_order(spark: SparkSession, sf_dir: str, *statements: str) -> DataFrame:
    """The results of the statements one after the other, with ``place``: where a row comes in them.

    That is the number of its SELECT, then the file and the row of the table that it was read from (those of a SELECT DISTINCT have one place).
    The statements are plain SELECTs of one table each, joined by UNION ALL.
    """
    out: DataFrame | None = None
    for n, select in enumerate(x for sql in statements for x in sql.split("UNION ALL")):
        (table,) = set(re.findall(r"\{(\w+)\}", select))
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").select("*", "_metadata.file_path", "_metadata.row_index")
        rows.createOrReplaceTempView(f"codeloom_{table}_rows")
        at = "'' AS file_path, -1L AS row_index" if "DISTINCT" in select else "file_path, row_index"
        body = select.replace("FROM {", f", struct({n} AS part, {at}) AS place FROM {{", 1).replace(f"{{{table}}}", f"codeloom_{table}_rows")
        part = spark.sql(body.replace("VARCHAR(9)", "STRING"))
        out = part if out is None else out.union(part.toDF(*out.columns))
    return out


def plain(sql: str) -> str:
    """The statement over tables of the plain names."""
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        sql = sql.replace(f"{{{t}}}", t)
    return sql
