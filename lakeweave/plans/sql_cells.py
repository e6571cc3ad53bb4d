"""DuckDB SQL for cells, sketches and pairs: the independent statement the Spark plans are checked with."""

from __future__ import annotations

from lakeweave.functions.hashing import minhash_seeds
from lakeweave.functions.text import WHITESPACE

# Text (s), whole-number (i) and fractional (d) columns of the test tables.
TEST_TABLES = {
    "region": "r_regionkey:i r_name:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d",
    "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d "
    "l_discount:d l_tax:d l_returnflag:s l_linestatus:s",
    "events": "event_id:i user_id:i event_type:s value:d props:s",
    "documents": "doc_id:i text:s lang:s source:s n_chars:i",
    "embeddings": "vec_id:i label:i",
    "pages": "page_id:i url:s html:s",
    "benchmark": "item_id:i text:s",
    "labels": "doc_id:i quality:i toxic:i",
    "conversations": "conv_id:i turn:i role:s text:s",
}


def _text_of(column: str, kind: str) -> str:
    if kind == "d":
        return (
            f"CASE WHEN {column} = floor({column}) AND abs({column}) < 1e15 "
            f"THEN CAST(CAST({column} AS BIGINT) AS VARCHAR) ELSE CAST({column} AS VARCHAR) END"
        )
    return f"CAST({column} AS VARCHAR)"


def cells_sql(tables=TEST_TABLES) -> str:
    selects = []
    for table in tables:
        for entry in TEST_TABLES[table].split():
            column, kind = entry.split(":")
            selects.append(
                f"SELECT '{table}' AS dataset_id, '{column}' AS column_name, "
                f"{_text_of(column, kind)} AS value FROM {table}"
            )
    return " UNION ALL ".join(selects)


def values_cte(tables=TEST_TABLES) -> str:
    whitespace = "||".join(f"chr({ord(c)})" for c in WHITESPACE)
    return f"""
cells AS ({cells_sql(tables)}),
vals AS (
  SELECT dataset_id, column_name, lower(trim(value, {whitespace})) AS v, count(*) AS cells
  FROM cells WHERE value IS NOT NULL GROUP BY ALL),
support AS (SELECT dataset_id, column_name, sum(cells)::BIGINT AS support FROM vals GROUP BY ALL)"""


def signature_cte() -> str:
    seeds = ", ".join(f"({i}, '{s}:')" for i, s in enumerate(minhash_seeds(128)))
    return f"""
seeds(pos, seed) AS (VALUES {seeds}),
sig AS (
  SELECT dataset_id, column_name, pos, min(substr(sha1(seed || v), 1, 16)) AS h
  FROM vals CROSS JOIN seeds WHERE v <> '' GROUP BY ALL)"""


def once_hashed_cte() -> str:
    """``sig`` and ``exact`` of the family that takes one digest a value, and exact sizes."""
    draw = lambda name: f"1 + ('0x' || substr(md5('{name}:' || pos), 1, 8))::BIGINT % 2147483646 AS f{name}"
    return f"""
once AS (
  SELECT dataset_id, column_name, ('0x' || substr(md5(v), 1, 8))::BIGINT % 2147483647 AS lo,
         ('0x' || substr(md5(v), 9, 8))::BIGINT % 2147483647 AS hi
  FROM vals WHERE v <> ''),
seeds AS (SELECT pos, {", ".join(draw(n) for n in "abcdef")} FROM range(128) r(pos)),
sig AS (
  SELECT dataset_id, column_name, pos,
         min(((fa * lo + fb * hi + fc) % 2147483647) * 2147483648 + (fd * lo + fe * hi + ff) % 2147483647) AS h
  FROM once CROSS JOIN seeds GROUP BY ALL),
exact AS (SELECT dataset_id, column_name, count(*) AS cardinality FROM once GROUP BY ALL)"""


def cardinality_cte() -> str:
    return """
bits AS (
  SELECT dataset_id, column_name, ('0x' || substr(sha1('0:' || v), 1, 16))::UBIGINT AS b
  FROM vals WHERE v <> ''),
regs AS (
  SELECT dataset_id, column_name, b & 1023::UBIGINT AS idx,
         max(CASE WHEN (b >> 10) = 0 THEN 54 ELSE 55 - length(ltrim(bin(b >> 10), '0')) END) AS r
  FROM bits GROUP BY ALL),
card AS (
  SELECT dataset_id, column_name,
         greatest(1, floor((0.7213::DOUBLE / (1 + 1.079::DOUBLE / 1024)) * 1048576::DOUBLE
           / (sum(pow(2.0::DOUBLE, -r)) + (1024 - count(*)))))::BIGINT AS cardinality
  FROM regs GROUP BY ALL)"""


def pairs_cte(sketched: str = "card") -> str:
    """``pairs`` from ``sig`` and a table of ``(dataset_id, column_name, cardinality)``."""
    return f"""
hits AS (
  SELECT l.dataset_id AS ld, l.column_name AS lc, r.dataset_id AS rd, r.column_name AS rc,
         count(*) / 128.0::DOUBLE AS j
  FROM sig l JOIN sig r ON l.pos = r.pos AND l.h = r.h AND l.dataset_id < r.dataset_id GROUP BY ALL),
sized AS (
  SELECT hits.*, a.cardinality::DOUBLE AS kl, b.cardinality::DOUBLE AS kr,
         least(a.cardinality, b.cardinality)::DOUBLE AS mn, greatest(a.cardinality, b.cardinality)::DOUBLE AS mx
  FROM hits JOIN {sketched} a ON ld = a.dataset_id AND lc = a.column_name
            JOIN {sketched} b ON rd = b.dataset_id AND rc = b.column_name),
common AS (SELECT *, mn - (mn - j * mx) / (1.0::DOUBLE + j) AS o FROM sized),
bounded AS (
  SELECT *, (o / kl > mn / kl + 1e-12 OR o / kr > mn / kr + 1e-12) AS over_bound FROM common),
pairs AS (
  SELECT ld AS left_dataset, lc AS left_column, rd AS right_dataset, rc AS right_column,
         CASE WHEN over_bound THEN mn / mx ELSE j END AS js,
         (CASE WHEN over_bound THEN mn ELSE o END) / kl AS jc_left_in_right,
         (CASE WHEN over_bound THEN mn ELSE o END) / kr AS jc_right_in_left
  FROM bounded
  WHERE js >= 0.3 OR jc_left_in_right >= 0.5 OR jc_right_in_left >= 0.5)"""


def pairs_sql(select: str, tables=TEST_TABLES, extra: str = "") -> str:
    return (
        f"WITH {values_cte(tables)}, {signature_cte()}, {cardinality_cte()}, {pairs_cte()}{extra} {select}"
    )
