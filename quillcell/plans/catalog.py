"""The registry of queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its operator id, with the SQL that must give the same rows."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(col: str | Column, name: str | None = None) -> Column:
    """A double rounded to six places, with no negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.round(c.cast("double"), 6) + F.lit(0.0)).alias(name or (col if isinstance(col, str) else "value"))


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib

    for name in ("matrix", "stats", "graph", "sources", "reads"):
        importlib.import_module(f"quillcell.plans.queries_{name}")


# SQL text shared by the checks: the adapters of quillcell.plans.adapters.
LINE = """m AS (
  SELECT CAST(l_partkey AS VARCHAR) AS gene, CAST(l_suppkey AS VARCHAR) AS cell, sum(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2)"""
NAMES = """names AS (
  SELECT CAST(p_partkey AS VARCHAR) AS key,
    (CASE WHEN p_name LIKE 'blue%' THEN 'mt-' WHEN p_brand = 'Brand#11' THEN 'ERCC-' ELSE 'g' END)
      || CAST(p_partkey AS VARCHAR) AS gene, p_type, p_brand, p_size, p_name FROM part)"""
NAMED = NAMES + """, m AS (
  SELECT n.gene, CAST(l_suppkey AS VARCHAR) AS cell, sum(l_quantity) AS value
  FROM lineitem JOIN names n ON CAST(l_partkey AS VARCHAR) = n.key GROUP BY 1, 2)"""
NORM = """t AS (SELECT cell, sum(value) AS reads FROM m GROUP BY 1),
nrm AS (SELECT gene, m.cell, log2(value * 10000.0 / reads + 1) AS v FROM m JOIN t ON m.cell = t.cell)"""
NC = "nc AS (SELECT count(DISTINCT cell) AS n FROM m)"
TOKENS = """m AS (
  SELECT gene, cell, CAST(count(*) AS DOUBLE) AS value FROM (
    SELECT unnest(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+')) AS gene, CAST(doc_id AS VARCHAR) AS cell
    FROM documents) WHERE gene <> '' GROUP BY 1, 2)"""
EMB = """m AS (
  SELECT CAST(i - 1 AS VARCHAR) AS gene, CAST(vec_id AS VARCHAR) AS cell, CAST(embedding[i] AS DOUBLE) AS value
  FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS i FROM embeddings))"""
REGIONS = """cl AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS cell, CAST(n_regionkey AS VARCHAR) AS cluster
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
LABELS = "cl AS (SELECT CAST(vec_id AS VARCHAR) AS cell, CAST(label AS VARCHAR) AS cluster FROM embeddings)"
BRANDS = """mk AS (
  SELECT CASE WHEN p_size % 3 = 0 THEN 'Mm Hs' WHEN p_size % 3 = 1 THEN 'Mm' ELSE 'Hs' END AS species,
    CAST(p_partkey AS VARCHAR) AS gene, p_brand AS cell_type, p_size / 1000.0 AS ui FROM part
  UNION ALL SELECT 'Mm Hs', CAST(p_partkey AS VARCHAR), p_type, 0.01 FROM part)"""
MOMENTS = """st AS (
  SELECT gene, count(*) AS z, avg(v) AS mz, coalesce(var_pop(v), 0) * count(*) AS m2z FROM nrm GROUP BY 1),
gs AS (
  SELECT gene, n, z, z * mz / n AS mean, (m2z + mz * mz * z * (n - z) / n) / (n - 1) AS var FROM st, nc)"""
LINEAR = """lin AS (SELECT gene, cell, pow(2, v) - 1 AS v FROM nrm),
st AS (SELECT gene, count(*) AS z, avg(v) AS mz, coalesce(var_pop(v), 0) * count(*) AS m2z FROM lin GROUP BY 1),
gs AS (
  SELECT gene, n, z, z * mz / n AS mean, (m2z + mz * mz * z * (n - z) / n) / (n - 1) AS var FROM st, nc)"""


def R(expr: str) -> str:
    """SQL counterpart of ``r6``."""
    return f"round(CAST({expr} AS DOUBLE), 6) + 0.0"
