"""Named queries with, where SQL can express them, an independent SQL statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Shared prefix of the SQL side, written from the definitions, not from the Spark code.
BASE = """WITH RECURSIVE
g AS (SELECT l_suppkey % 40 AS s, CAST(floor(l_partkey / 4) AS BIGINT) AS v,
             CAST(least(2, sum(CASE WHEN l_quantity > 40 THEN 1 ELSE 0 END)) AS BIGINT) AS d
      FROM lineitem GROUP BY ALL),
mk AS (SELECT v, 'm' || v AS snp, v % 9 AS k, CAST(floor(v / 9) AS BIGINT) AS j,
              CAST(floor((v % 9) / 3) + 1 AS BIGINT) AS base,
              substr('ABD', CAST(v % 3 + 1 AS INT), 1) AS sub,
              CAST(CAST(floor((v % 9) / 3) + 1 AS INT) AS VARCHAR) || substr('ABD', CAST(v % 3 + 1 AS INT), 1) AS chrom,
              CAST(floor(v / 9) AS BIGINT) * 100000 + 1 AS pos,
              CAST(floor(floor(v / 9) / 5) AS BIGINT) AS jj
       FROM (SELECT DISTINCT v FROM g)),
mg AS (SELECT *, 'G' || chrom || '_' || jj AS gene FROM mk),
ph AS (SELECT s_suppkey % 40 AS s,
              CAST(sum(CAST(round(s_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS y
       FROM supplier GROUP BY ALL),
ph2 AS (SELECT c_custkey % 40 AS s,
              CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS y
       FROM customer WHERE c_custkey % 40 IN (SELECT s FROM ph) GROUP BY ALL),
nn AS (SELECT count(*) AS n FROM ph),
q0 AS (SELECT v, count(*) AS n_obs, CAST(sum(d) AS BIGINT) AS sum_d, CAST(sum(d * d) AS BIGINT) AS sum_dd
       FROM g GROUP BY v),
q AS (SELECT v, n_obs, sum_d, sum_dd, CAST(sum_d AS DOUBLE) / n_obs AS mean,
             CAST(sum_d AS DOUBLE) / n_obs / 2 AS af,
             least(CAST(sum_d AS DOUBLE) / n_obs / 2, 1 - CAST(sum_d AS DOUBLE) / n_obs / 2) AS maf,
             CAST(n_obs AS DOUBLE) / n AS call_rate,
             (sum_dd - CAST(sum_d AS DOUBLE) * sum_d / n_obs) / n AS var,
             n_obs * sum_dd = sum_d * sum_d AS flat
      FROM q0 CROSS JOIN nn),
zc AS (SELECT s, g.v, d - mean AS z FROM g JOIN q ON g.v = q.v),
zs AS (SELECT s, g.v, CASE WHEN flat THEN 0.0 ELSE (d - mean) / sqrt(var) END AS z
       FROM g JOIN q ON g.v = q.v),
yc AS (SELECT s, y - avg(y) OVER () AS y FROM ph),
vy AS (SELECT sum(y * y) / (count(*) - 1) AS v2 FROM yc),
yc2 AS (SELECT s, y - avg(y) OVER () AS y FROM ph2),
vy2 AS (SELECT sum(y * y) / (count(*) - 1) AS v2 FROM yc2),
sc AS (SELECT zc.v, sum(z * y) / sum(z * z) AS beta, sqrt(max(v2) / sum(z * z)) AS se,
              sum(z * y) * sum(z * y) / sum(z * z) / max(v2) AS chi2
       FROM zc JOIN yc USING (s) CROSS JOIN vy
       WHERE v IN (SELECT v FROM q WHERE n_obs > 0 AND call_rate >= 0.9 AND maf >= 0.01 AND NOT flat)
       GROUP BY zc.v),
sc2 AS (SELECT zc.v, sum(z * y) / sum(z * z) AS beta,
              sum(z * y) * sum(z * y) / sum(z * z) / max(v2) AS chi2
       FROM zc JOIN yc2 USING (s) CROSS JOIN vy2
       WHERE v IN (SELECT v FROM q WHERE n_obs > 0 AND call_rate >= 0.9 AND maf >= 0.01 AND NOT flat)
       GROUP BY zc.v),
ss AS (SELECT mg.v, snp, sub, base, chrom, pos, k, j, jj, gene, beta, se, round(chi2, 9) AS chi2,
              CASE WHEN round(chi2, 9) <= 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 160),
                lambda i: exp((2 * i + 1) * ln(sqrt(round(chi2, 9) / 2)) - round(chi2, 9) / 2 - lgamma(i + 1.5)))) END AS p,
              q.n_obs, q.maf, q.call_rate
       FROM sc JOIN mg USING (v) JOIN q USING (v)),
ss2 AS (SELECT v, round(chi2, 9) AS chi2,
              CASE WHEN round(chi2, 9) <= 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 160),
                lambda i: exp((2 * i + 1) * ln(sqrt(round(chi2, 9) / 2)) - round(chi2, 9) / 2 - lgamma(i + 1.5)))) END AS p
       FROM sc2),
gen AS (SELECT 'C' || c_custkey AS gene_id, CAST(c_custkey AS BIGINT) AS gid,
               CAST(CAST(floor((c_custkey % 9) / 3) + 1 AS INT) AS VARCHAR) || substr('ABD', CAST(c_custkey % 3 + 1 AS INT), 1) AS chrom,
               CAST(floor(c_custkey / 9) AS BIGINT) * 33000 + 1 AS st,
               CAST(floor(c_custkey / 9) AS BIGINT) * 33000 + 501 + c_nationkey * 2000 AS en
        FROM customer),
qt AS (SELECT 'Q' || s_suppkey AS qtl, CAST(s_suppkey AS BIGINT) AS qid,
              CAST(CAST(floor((s_suppkey % 9) / 3) + 1 AS INT) AS VARCHAR) || substr('ABD', CAST(s_suppkey % 3 + 1 AS INT), 1) AS chrom,
              CAST(floor(s_suppkey / 9) AS BIGINT) * 500000 + (s_suppkey * 7919) % 100000 AS qpos,
              300000 AS win
       FROM supplier)
"""


def sql(text: str) -> str:
    """Attach the shared prefix; ``text`` starts with SELECT or with ``, name AS (``."""
    return BASE + text.strip()


def query(name: str, oracle: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = sql(oracle)
        return fn
    return add


def r(col: Column | str, name: str, digits: int = 6) -> Column:
    """Rounded double without negative zero, under a name."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.round(c.cast("double"), digits) + F.lit(0.0)).alias(name)


def big(col: Column | str, name: str | None = None) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return c.cast("bigint").alias(name or col)
