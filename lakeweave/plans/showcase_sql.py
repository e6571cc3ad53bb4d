"""DuckDB SQL for the showcase queries, written from the operator definitions."""

from __future__ import annotations

from lakeweave.plans.sql_cells import (
    TEST_TABLES,
    cardinality_cte,
    once_hashed_cte,
    pairs_cte,
    pairs_sql,
    signature_cte,
    values_cte,
)

NOW = "946684800"
MONTH = "(30.44::DOUBLE * 24 * 3600)"

SQL: dict[str, str] = {}

# --- columns, sketches, joinability -------------------------------------------------------------------

SQL["joinable_columns"] = pairs_sql("SELECT * FROM pairs")
SQL["indexed_joinable_columns"] = SQL["joinable_columns"]
SQL["joinable_preview"] = pairs_sql(
    """SELECT * FROM pairs ORDER BY jc_left_in_right DESC, jc_right_in_left DESC, js DESC,
       left_dataset, left_column, right_dataset, right_column LIMIT 100"""
)
SQL["once_hashed_joinable_columns"] = f"WITH {values_cte()}, {once_hashed_cte()}, {pairs_cte('exact')} SELECT * FROM pairs"

# Columns of the test tables with their logical type.
PROFILED = {
    "region": "r_regionkey:number r_name:text",
    "nation": "n_nationkey:number n_name:text n_regionkey:number",
    "customer": "c_custkey:number c_name:text c_nationkey:number c_acctbal:number c_mktsegment:text",
    "supplier": "s_suppkey:number s_name:text s_nationkey:number s_acctbal:number",
    "part": "p_partkey:number p_name:text p_brand:text p_type:text p_size:number p_retailprice:number",
    "orders": "o_orderkey:number o_custkey:number o_orderstatus:text o_totalprice:number "
    "o_orderdate:calendar_date o_orderpriority:text",
    "lineitem": "l_orderkey:number l_partkey:number l_suppkey:number l_linenumber:number "
    "l_quantity:number l_extendedprice:number l_discount:number l_tax:number l_returnflag:text "
    "l_linestatus:text l_shipdate:calendar_date",
    "events": "event_id:number ts:calendar_date user_id:number event_type:text value:number props:text",
    "documents": "doc_id:number text:text lang:text source:text n_chars:number",
    "embeddings": "vec_id:number embedding:array label:number",
    "pages": "page_id:number url:text html:text",
    "benchmark": "item_id:number text:text",
    "labels": "doc_id:number quality:number toxic:number",
    "conversations": "conv_id:number turn:number role:text text:text",
}


def _profile_sql() -> str:
    parts = []
    for table, columns in PROFILED.items():
        for i, entry in enumerate(columns.split()):
            name, kind = entry.split(":")
            blank = f"count(*) FILTER ({name} IS NULL OR trim({name}) = '')" if kind == "text" else "0"
            parts.append(
                f"SELECT '{table}' AS dataset_id, count(*) AS row_count, {i} AS position, "
                f"'{name}' AS column_name, '{kind}' AS type, count(*) - count({name}) AS nulls, "
                f"{blank} AS semantic_nulls FROM {table}"
            )
    return " UNION ALL ".join(parts)


SQL["column_profile"] = _profile_sql()
SQL["column_support"] = f"WITH {values_cte()} SELECT * FROM support WHERE support >= 50"
SQL["clean_values"] = f"""WITH {values_cte()}
SELECT dataset_id, column_name, count(*) AS distinct_values, sum(cells)::BIGINT AS cells,
       min(v) AS lowest, sum(length(v))::BIGINT AS characters
FROM vals WHERE v <> '' GROUP BY ALL"""
SQL["minhash_signature"] = f"""WITH {values_cte()}, {signature_cte()}
SELECT dataset_id, column_name, pos AS position, h AS hash FROM sig"""
SQL["register_cardinality"] = f"WITH {values_cte()}, {cardinality_cte()} SELECT * FROM card"


def _sketches_sql(keep: str, tables=TEST_TABLES) -> str:
    return f"""WITH {values_cte(tables)}, {signature_cte()}, {cardinality_cte()},
joined AS (SELECT dataset_id, column_name, string_agg(h, ',' ORDER BY pos) AS signature FROM sig GROUP BY ALL)
SELECT dataset_id, column_name, signature, cardinality
FROM joined JOIN card USING (dataset_id, column_name) JOIN support USING (dataset_id, column_name)
WHERE {keep}"""


SQL["column_sketches"] = _sketches_sql("support >= 50")
SQL["streamed_sketches"] = _sketches_sql("true")
SQL["landed_file_sketches"] = _sketches_sql("support >= 50", ("customer", "orders"))
SQL["exact_cardinality"] = f"""WITH {values_cte()}
SELECT dataset_id, column_name, count(*) AS cardinality FROM vals WHERE v <> '' GROUP BY ALL"""

# --- join graph ---------------------------------------------------------------------------------------

_EDGES = """, edges AS (
  SELECT least(left_dataset, right_dataset) AS src, greatest(left_dataset, right_dataset) AS dst,
         count(*) AS num_joinable_columns, max(js) AS max_js,
         max(greatest(jc_left_in_right, jc_right_in_left)) AS max_jc
  FROM pairs WHERE left_dataset <> right_dataset GROUP BY ALL),
ends AS (
  SELECT src AS dataset, dst AS partner, num_joinable_columns, max_jc FROM edges
  UNION ALL SELECT dst, src, num_joinable_columns, max_jc FROM edges),
nodes AS (
  SELECT dataset, count(*) AS num_partners, sum(num_joinable_columns)::BIGINT AS total_joinable_columns,
         max(max_jc) AS max_jc_with_partner
  FROM ends GROUP BY ALL),
pair_counts AS (
  SELECT left_dataset, right_dataset, count(*) AS num_column_pairs FROM pairs GROUP BY ALL)"""
SQL["dataset_edges"] = pairs_sql("SELECT * FROM edges", extra=_EDGES)
SQL["visible_edges"] = pairs_sql("SELECT * FROM edges WHERE max_jc >= 0.8", extra=_EDGES)
SQL["dataset_nodes"] = pairs_sql("SELECT * FROM nodes", extra=_EDGES)
SQL["dataset_pair_counts"] = pairs_sql("SELECT * FROM pair_counts", extra=_EDGES)
SQL["hub_degree"] = pairs_sql(
    """SELECT dataset, count(DISTINCT partner) AS num_partners FROM ends GROUP BY ALL
       ORDER BY num_partners DESC, dataset LIMIT 15""",
    extra=_EDGES,
)
_LABELS = (
    """, sizes(dataset_id, n) AS ("""
    + " UNION ALL ".join(f"SELECT '{t}', count(*) FROM {t}" for t in PROFILED)
    + """),
labelled AS (
  SELECT dataset_id, 'table of ' || n || ' rows (' || dataset_id || ')' AS label FROM sizes WHERE n >= 300)"""
)
SQL["top_hubs"] = pairs_sql(
    """SELECT nodes.*, coalesce(label, dataset) AS label
       FROM (SELECT * FROM nodes ORDER BY num_partners DESC, dataset LIMIT 15) nodes
       LEFT JOIN labelled ON dataset = dataset_id""",
    extra=_EDGES + _LABELS,
)
SQL["top_dataset_pairs"] = pairs_sql(
    """SELECT left_dataset, right_dataset, num_column_pairs,
              coalesce(a.label, left_dataset) AS left_label, coalesce(b.label, right_dataset) AS right_label,
              coalesce(a.label, left_dataset) || ' ↔ ' || coalesce(b.label, right_dataset) AS pair
       FROM (SELECT * FROM pair_counts
             ORDER BY num_column_pairs DESC, left_dataset, right_dataset LIMIT 15) p
       LEFT JOIN labelled a ON left_dataset = a.dataset_id
       LEFT JOIN labelled b ON right_dataset = b.dataset_id""",
    extra=_EDGES + _LABELS,
)


def _histogram(values: str, bins: int) -> str:
    """CTEs ending in ``histogram`` over a CTE body of ``(series, value)``."""
    return f"""
series_values AS ({values}),
spans AS (
  SELECT series, CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END::DOUBLE AS low,
         CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END::DOUBLE AS high
  FROM series_values GROUP BY ALL),
edged AS (
  SELECT series, bin, spans.low AS first, spans.high AS last,
         spans.low + bin * ((spans.high - spans.low) / {bins}.0::DOUBLE) AS low,
         CASE WHEN bin = {bins - 1} THEN spans.high
              ELSE spans.low + (bin + 1) * ((spans.high - spans.low) / {bins}.0::DOUBLE) END AS high
  FROM spans CROSS JOIN range({bins}) r(bin)),
histogram AS (
  SELECT e.series, e.bin::INT AS bin, e.low, e.high, count(v.value) AS count
  FROM edged e LEFT JOIN series_values v
    ON e.series = v.series AND v.value >= e.low AND (v.value < e.high OR (e.bin = {bins - 1} AND v.value <= e.high))
  GROUP BY ALL)"""


SQL["containment_histogram"] = pairs_sql(
    "SELECT * FROM histogram",
    extra=", "
    + _histogram(
        " UNION ALL ".join(
            f"SELECT '{c}' AS series, {c} AS value FROM pairs"
            for c in ("js", "jc_left_in_right", "jc_right_in_left")
        ),
        30,
    ),
)
SQL["value_histogram"] = "WITH " + _histogram(
    " UNION ALL ".join(
        f"SELECT '{c}' AS series, {c} AS value FROM lineitem"
        for c in ("l_extendedprice", "l_quantity", "l_discount", "l_tax")
    ),
    40,
) + " SELECT * FROM histogram"

# --- embeddings ---------------------------------------------------------------------------------------

_MATCHES = """WITH vectors AS (
  SELECT 'label' || label || '.v' || vec_id AS name, embedding::DOUBLE[] AS e FROM embeddings),
matches AS (
  SELECT a.name AS col1, b.name AS col2, list_cosine_similarity(a.e, b.e) AS score
  FROM vectors a JOIN vectors b ON a.name < b.name
  WHERE list_cosine_similarity(a.e, b.e) >= 0.3)"""
SQL["cosine_pairs"] = f"{_MATCHES} SELECT col1, col2, round(score, 9) AS score FROM matches"
SQL["top_matches"] = f"""{_MATCHES}
SELECT col1, col2, round(score, 9) AS score FROM matches ORDER BY matches.score DESC, col1, col2 LIMIT 50"""
SQL["strong_edges"] = f"""{_MATCHES}
SELECT col1, col2, round(score, 9) AS score, split_part(col1, '.', 1) AS dataset1,
       split_part(col2, '.', 1) AS dataset2
FROM matches WHERE matches.score >= 0.4"""
SQL["endpoint_frequency"] = f"""{_MATCHES}
SELECT dataset, count(*) AS count FROM (
  SELECT split_part(col1, '.', 1) AS dataset FROM matches
  UNION ALL SELECT split_part(col2, '.', 1) FROM matches)
GROUP BY ALL ORDER BY count DESC, dataset LIMIT 10"""


def _ordered_cells() -> str:
    from lakeweave.plans.sql_cells import _text_of

    keys = {
        "region": "r_regionkey",
        "nation": "n_nationkey",
        "customer": "c_custkey",
        "supplier": "s_suppkey",
        "part": "p_partkey",
        "orders": "o_orderkey",
        "lineitem": "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
        "l_returnflag, l_linestatus",
        "events": "event_id",
        "documents": "doc_id",
        "embeddings": "vec_id",
        "pages": "page_id",
        "benchmark": "item_id",
        "labels": "doc_id",
        "conversations": "conv_id, turn",
    }
    return " UNION ALL ".join(
        f"SELECT '{t}' AS dataset_id, '{c}' AS column_name, row_number() OVER (ORDER BY {key}) AS row_id, "
        f"{_text_of(c, k)} AS value, {'false' if k == 's' else f'coalesce({c} = 0, false)'} AS falsy FROM {t}"
        for t, key in keys.items()
        for c, k in (entry.split(":") for entry in TEST_TABLES[t].split())
    )


_SAMPLED = f"""WITH ordered AS ({_ordered_cells()}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset_id, column_name ORDER BY row_id) AS rn FROM ordered)"""
SQL["column_samples"] = f"""{_SAMPLED}
SELECT dataset_id, column_name, string_agg(value, '|' ORDER BY rn) AS samples
FROM ranked WHERE rn <= 25 GROUP BY ALL"""
_TEXTS = """SELECT dataset_id, column_name,
       'Column: ' || dataset_id || '.' || column_name || '. Sample values: '
         || coalesce(string_agg(value, ', ' ORDER BY rn) FILTER (value <> '' AND NOT falsy), '') AS text
FROM ranked WHERE rn <= 50 GROUP BY dataset_id, column_name"""
SQL["column_text"] = f"{_SAMPLED} {_TEXTS}"
_EMBEDDED = r"""
words AS (
  SELECT dataset_id, column_name, unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS word
  FROM texts),
slots AS (
  SELECT dataset_id, column_name, ('0x' || substr(md5(word), 1, 8))::BIGINT % 512 AS slot FROM words WHERE word <> ''),
counted AS (
  SELECT dataset_id, column_name, slot % 256 AS place, sum(CASE WHEN slot < 256 THEN 1 ELSE -1 END)::DOUBLE AS n
  FROM slots GROUP BY ALL),
norms AS (SELECT dataset_id, column_name, sqrt(sum(n * n)) AS norm FROM counted GROUP BY ALL),
embedded AS (
  SELECT t.dataset_id, t.column_name,
         list(CASE WHEN norm > 0 THEN coalesce(n, 0::DOUBLE) / norm ELSE 0::DOUBLE END ORDER BY r.place) AS embedding
  FROM texts t CROSS JOIN range(256) r(place)
  LEFT JOIN counted c ON t.dataset_id = c.dataset_id AND t.column_name = c.column_name AND r.place = c.place
  LEFT JOIN norms m ON t.dataset_id = m.dataset_id AND t.column_name = m.column_name
  GROUP BY ALL)"""
SQL["column_embedding"] = f"{_SAMPLED}, texts AS ({_TEXTS}), {_EMBEDDED} SELECT * FROM embedded"
SQL["alike_by_embedding"] = f"""{_SAMPLED}, texts AS ({_TEXTS}), {_EMBEDDED},
named AS (SELECT dataset_id || '.' || column_name AS name, embedding AS e FROM embedded WHERE list_sum(list_transform(embedding, lambda x: abs(x))) > 0)
SELECT a.name AS col1, b.name AS col2, round(list_cosine_similarity(a.e, b.e), 9) AS score
FROM named a JOIN named b ON a.name < b.name WHERE list_cosine_similarity(a.e, b.e) >= 0.5
ORDER BY score DESC, col1, col2 LIMIT 50"""
SQL["streamed_embeddings"] = f"""WITH texts AS (
  SELECT 'd' || doc_id AS dataset_id, 'text' AS column_name, min(text) AS text FROM documents GROUP BY ALL), {_EMBEDDED}
SELECT * FROM embedded"""

# --- catalog ------------------------------------------------------------------------------------------

CATALOG = """catalog_base AS (
  SELECT o_orderkey, o_custkey,
    lower(n_name) || '.example.org' AS domain, 'o' || o_orderkey AS dataset_id,
    nullif(substr(o_orderpriority, 3), 'NOT SPECIFIED') AS category,
    CASE o_orderstatus WHEN 'F' THEN 'tabular' WHEN 'O' THEN 'map' ELSE 'href' END AS format,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN []::VARCHAR[]
         ELSE [lower(c_mktsegment), CASE WHEN o_orderstatus = 'F' THEN 'logistics'
                                         ELSE lower(substr(o_orderpriority, 3)) END] END AS tags,
    floor(o_totalprice / 40)::BIGINT AS download_count, floor(o_totalprice / 25)::BIGINT AS view_count,
    epoch(o_orderdate)::BIGINT AS publication_date,
    epoch(o_orderdate)::BIGINT + (o_custkey % 700) * 86400 AS updated_at,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 17 <> 0 THEN
      floor((o_totalprice / 1000) * (o_totalprice / 1000) * (o_totalprice / 1000) / 10)::BIGINT END AS row_count
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
catalog AS (
  SELECT *, CASE WHEN format = 'tabular' AND o_custkey % 56 > 0 THEN
    list_transform(range(0, o_custkey % 56), lambda i: {
      'name': 'c' || i,
      'type': (['text', 'number', 'calendar_date', 'point'])[(o_orderkey + i) % 4 + 1],
      'nulls': row_count * (i % 7) // 10,
      'semantic_nulls': row_count * (((o_orderkey % 60) * (i % 3)) % 101) // 100}) END AS columns
  FROM catalog_base),
measured AS (
  SELECT *, coalesce(len(columns), 0) AS attributes,
         CASE WHEN len(columns) > 0 AND row_count > 0 THEN
           list_sum(list_transform(columns, lambda c: c.semantic_nulls / row_count::DOUBLE * 100.0::DOUBLE)) / len(columns)
         END AS sparseness,
         trunc((""" + NOW + """ - publication_date) / """ + MONTH + """)::INT AS age_months,
         trunc((""" + NOW + """ - updated_at) / """ + MONTH + """)::INT AS update_months
  FROM catalog)"""
SQL["catalog_records"] = f"""WITH {CATALOG}
SELECT domain, dataset_id, category, format, array_to_string(tags, ',') AS tags, download_count, view_count,
       updated_at, row_count, attributes::INT AS attributes, round(sparseness, 6) AS sparseness
FROM measured"""
SQL["tag_frequency"] = f"""WITH {CATALOG}
SELECT domain, tag AS key, count(*) AS count FROM (SELECT domain, unnest(tags) AS tag FROM catalog)
WHERE tag IS NOT NULL GROUP BY ALL"""
SQL["category_frequency"] = f"""WITH {CATALOG}
SELECT category AS key, count(*) AS count FROM catalog WHERE category IS NOT NULL GROUP BY ALL"""
SQL["format_frequency"] = f"""WITH {CATALOG}
SELECT domain, format AS key, count(*) AS count FROM catalog GROUP BY ALL"""
SQL["column_type_frequency"] = f"""WITH {CATALOG}
SELECT domain, c.type AS key, count(*) AS count FROM (SELECT domain, unnest(columns) AS c FROM catalog)
GROUP BY ALL"""

_EDGES_OF = {
    "row_count": (
        "0-1K:0:1e3 1K-10K:1e3:1e4 10K-100K:1e4:1e5 100K-1M:1e5:1e6 1M-10M:1e6:1e7 10M+:1e7:1e300"
    ),
    "view_count": "0-100:0:100 100-1K:100:1e3 1K-10K:1e3:1e4 10K+:1e4:1e300",
    "download_count": "0-100:0:100 100-1K:100:1e3 1K-10K:1e3:1e4 10K+:1e4:1e300",
    "attributes": "0-10:0:10 10-20:10:20 20-30:20:30 30-40:30:40 40-50:40:50 50+:50:1e300",
    "sparseness": "<_1%_sparse:0:1 1-5%_sparse:1:5 5-10%_sparse:5:10 10-25%_sparse:10:25 "
    "25-50%_sparse:25:50 50%+_sparse:50:100",
}


def _bucket_rows(value: str) -> str:
    rows = []
    for i, entry in enumerate(_EDGES_OF[value].split()):
        label, low, high = entry.split(":")
        rows.append(f"({i}, '{label.replace('_', ' ')}', {low}::DOUBLE, {high}::DOUBLE)")
    return ", ".join(rows)


def _buckets(value: str, by_domain: bool = True, where: str = "true") -> str:
    by = "d.domain, " if by_domain else ""
    return f"""WITH {CATALOG}, b(ordinal, bucket, low, high) AS (VALUES {_bucket_rows(value)})
SELECT {by}b.ordinal, b.bucket, count(m.{value}) AS count
FROM (SELECT DISTINCT domain FROM measured WHERE {where}) d CROSS JOIN b
LEFT JOIN measured m ON m.domain = d.domain AND m.{value} >= b.low AND m.{value} < b.high
GROUP BY ALL"""


SQL["row_buckets"] = _buckets("row_count")
SQL["view_buckets"] = _buckets("view_count")
SQL["download_buckets"] = _buckets("download_count")
SQL["attribute_buckets"] = _buckets("attributes")
SQL["sparseness_buckets"] = _buckets("sparseness", where="sparseness IS NOT NULL")
_REPORT_BUCKET = """CASE WHEN row_count >= 1000000 THEN '1M+' WHEN row_count >= 100000 THEN '100K–1M'
  WHEN row_count >= 10000 THEN '10K–100K' WHEN row_count >= 1000 THEN '1K–10K'
  WHEN row_count >= 0 THEN '0–1K' ELSE 'unknown' END"""
SQL["report_row_buckets"] = f"""WITH {CATALOG}
SELECT {_REPORT_BUCKET} AS key, count(*) AS count FROM catalog GROUP BY ALL"""


def _ages(months: str) -> str:
    return f"""
age_counts AS (
  SELECT domain, {months} AS months, count(*) AS count FROM measured WHERE {months} >= 0 GROUP BY ALL),
age_span AS (
  SELECT domain, unnest(range(min(months), max(months) + 1))::INT AS months FROM age_counts GROUP BY domain),
ages AS (
  SELECT domain, months, coalesce(count, 0) AS count
  FROM age_span LEFT JOIN age_counts USING (domain, months))"""


SQL["publication_age"] = f"WITH {CATALOG}, {_ages('age_months')} SELECT * FROM ages"
SQL["update_age"] = f"WITH {CATALOG}, {_ages('update_months')} SELECT * FROM ages"
SQL["age_peak"] = f"""WITH {CATALOG}, {_ages('age_months')}
SELECT domain, months, count FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY count DESC, months) AS rn FROM ages) WHERE rn = 1"""


def _summary() -> str:
    """CTEs ending in ``summary(domain, statistic, key, count)``."""

    def ages(name: str, months: str) -> str:
        return f"""
{name}_counts AS (
  SELECT domain, {months} AS months, count(*) AS n FROM measured WHERE {months} >= 0 GROUP BY ALL),
{name} AS (
  SELECT s.domain, '{name}' AS statistic, s.months::VARCHAR AS key, coalesce(c.n, 0) AS count
  FROM (SELECT domain, unnest(range(min(months), max(months) + 1))::INT AS months
        FROM {name}_counts GROUP BY domain) s
  LEFT JOIN {name}_counts c ON s.domain = c.domain AND s.months = c.months)"""

    def bucketed(name: str, value: str, where: str = "true") -> str:
        return f"""
{name}_b(ordinal, bucket, low, high) AS (VALUES {_bucket_rows(value)}),
{name} AS (
  SELECT d.domain, '{name}' AS statistic, b.bucket AS key, count(m.{value}) AS count
  FROM (SELECT DISTINCT domain FROM measured WHERE {where}) d CROSS JOIN {name}_b b
  LEFT JOIN measured m ON m.domain = d.domain AND m.{value} >= b.low AND m.{value} < b.high
  GROUP BY ALL)"""

    names = (
        "publication_age last_update row_counts view_counts download_counts attribute_counts "
        "sparseness_counts"
    ).split()
    frequencies = """
frequencies AS (
  SELECT domain, 'categories' AS statistic, category AS key, count(*) AS count
  FROM catalog WHERE category IS NOT NULL GROUP BY ALL
  UNION ALL SELECT domain, 'formats', format, count(*) FROM catalog GROUP BY ALL
  UNION ALL SELECT domain, 'tag_counts', tag, count(*)
  FROM (SELECT domain, unnest(tags) AS tag FROM catalog) WHERE tag IS NOT NULL GROUP BY ALL
  UNION ALL SELECT domain, 'column_types', c.type, count(*)
  FROM (SELECT domain, unnest(columns) AS c FROM catalog) GROUP BY ALL)"""
    parts = [
        ages("publication_age", "age_months"),
        ages("last_update", "update_months"),
        bucketed("row_counts", "row_count"),
        bucketed("view_counts", "view_count"),
        bucketed("download_counts", "download_count"),
        bucketed("attribute_counts", "attributes"),
        bucketed("sparseness_counts", "sparseness", "sparseness IS NOT NULL"),
        frequencies,
    ]
    union = " UNION ALL ".join(f"SELECT * FROM {n}" for n in [*names, "frequencies"])
    return f"{CATALOG}, {', '.join(parts)}, summary AS ({union})"


SQL["catalog_summary"] = f"WITH {_summary()} SELECT * FROM summary"
SQL["domain_rollup"] = f"""WITH {_summary()}
SELECT domain, statistic, key, sum(count)::BIGINT AS count, grouping(domain) = 1 AS is_total
FROM summary GROUP BY GROUPING SETS ((domain, statistic, key), (statistic, key))"""
_ORDERED_LABELS = " UNION ALL ".join(
    f"SELECT '{statistic}' AS statistic, * FROM {statistic}_b"
    for statistic in (
        "row_counts view_counts download_counts attribute_counts sparseness_counts".split()
    )
)
SQL["overall_report"] = f"""WITH {_summary()}, labels_in_order AS ({_ORDERED_LABELS}),
totals AS (SELECT statistic, key, sum(count)::BIGINT AS count FROM summary GROUP BY ALL)
SELECT NULL::VARCHAR AS domain, t.statistic, t.key, t.count,
       CASE WHEN t.statistic IN ('publication_age', 'last_update') THEN t.key::INT ELSE o.ordinal END AS position
FROM totals t LEFT JOIN labels_in_order o ON t.statistic = o.statistic AND t.key = o.bucket"""
SQL["summary_lookup"] = f"""WITH {CATALOG}
SELECT format AS key, count(*) AS count, 'domain' AS scope FROM catalog
WHERE domain = 'nation_3.example.org' GROUP BY ALL
UNION ALL SELECT format, count(*), 'all' FROM catalog GROUP BY ALL"""

_PORTAL = f"""raw AS (
  SELECT 'o' || o_orderkey AS dataset_id, 'Order ' || o_orderkey AS name,
    nullif(substr(o_orderpriority, 3), 'NOT SPECIFIED') AS category,
    CASE WHEN o_custkey % 9 = 0 THEN '' ELSE lower(o_orderstatus) || ',' || lower(o_orderpriority) END AS tags,
    CASE o_orderstatus WHEN 'F' THEN 'tabular' WHEN 'O' THEN 'map' END AS view_type,
    CASE WHEN o_custkey % 2 = 0 THEN 'csv' END AS download_type,
    CASE WHEN o_orderkey % 5 > 0 THEN o_custkey * o_custkey - 9 END AS row_count,
    epoch(o_orderdate)::BIGINT AS created_at,
    CASE WHEN o_orderkey % 4 > 0 THEN epoch(o_orderdate)::BIGINT + (o_custkey % 900) * 43200
         WHEN o_orderkey % 8 > 0 THEN epoch(o_orderdate)::BIGINT END AS updated_at,
    floor(o_totalprice)::BIGINT AS view_count, floor(o_totalprice / 3)::BIGINT AS download_count,
    o_orderkey % 10 > 0 AS listed, o_orderkey AS ok, o_custkey AS ck, year(o_orderdate)::INT AS created_year
  FROM orders),
report AS (
  SELECT dataset_id, name, category, tags, view_type, download_type,
    CASE WHEN listed THEN 1 + (ck % 5 = 0)::INT + (ck % 7 = 0)::INT + (ok % 3 = 0)::INT + (ok % 7 = 0)::INT
                            + (ok % 4 = 1)::INT + (ok % 6 = 5)::INT ELSE 0 END AS n_columns,
    row_count, created_at, updated_at, view_count, download_count,
    listed AND (ck % 5 = 0 OR ck % 7 = 0) AS has_location_column,
    listed AND (ok % 3 = 0 OR ok % 7 = 0) AS has_date_column,
    listed AND ((ok % 4 = 1 AND ck % 2 = 0) OR ok % 6 = 5) AS has_year_column,
    {_REPORT_BUCKET} AS row_count_bucket, created_year,
    floor(({NOW} - updated_at) / 86400.0::DOUBLE)::INT AS updated_days_ago
  FROM raw)"""
SQL["report_records"] = f"WITH {_PORTAL} SELECT * FROM report"
_TOP_HEADLINES = " UNION ALL ".join(
    f"""(SELECT '{c}' AS headline, {c} AS key, count(*) AS count FROM report GROUP BY ALL
         ORDER BY count DESC, key NULLS LAST LIMIT 10)"""
    for c in ("view_type", "download_type", "category")
)
SQL["headline_counts"] = f"""WITH {_PORTAL} {_TOP_HEADLINES}
UNION ALL SELECT 'row_count_bucket', row_count_bucket, count(*) FROM report GROUP BY ALL
UNION ALL SELECT 'created_year', created_year::VARCHAR, count(*) FROM report GROUP BY ALL"""
SQL["recency_buckets"] = f"""WITH {_PORTAL},
b(ordinal, bucket, low, high) AS (VALUES (0, '<=30d', -1, 30), (1, '31-180d', 30, 180),
  (2, '181-365d', 180, 365), (3, '1-2y', 365, 730), (4, '2y+', 730, 1000000))
SELECT ordinal, bucket, count(dataset_id) AS count
FROM b LEFT JOIN report ON updated_days_ago > low AND updated_days_ago <= high GROUP BY ALL
UNION ALL SELECT 5, NULL, count(*) FROM report WHERE updated_days_ago IS NULL OR updated_days_ago <= -1"""
SQL["semantic_coverage"] = f"""WITH {_PORTAL}
SELECT 'With location columns' AS label, round(avg(has_location_column::DOUBLE) * 100, 6) AS percent FROM report
UNION ALL SELECT 'With date/datetime columns', round(avg(has_date_column::DOUBLE) * 100, 6) FROM report
UNION ALL SELECT 'With year columns', round(avg(has_year_column::DOUBLE) * 100, 6) FROM report"""

# --- domain counts and reports ------------------------------------------------------------------------

_RUNS = """run AS (
  SELECT lower(n_name) || '.example.org' AS domain,
    CASE WHEN n_nationkey % 7 = 3 THEN -1 ELSE count(*) END AS count,
    CASE WHEN n_nationkey % 7 = 3 THEN 'Timeout after 60s' END AS error
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name),
rerun AS (
  SELECT lower(n_name) || '.example.org' AS domain,
    CASE WHEN n_nationkey = 10 THEN -1 ELSE count(*) END AS count,
    CASE WHEN n_nationkey = 10 THEN 'refused' END AS error
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name),
population AS (
  SELECT lower(n_name) || '.example.org' AS domain, upper(n_name[1]) || lower(n_name[2:]) AS city,
         sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS population
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE n_nationkey % 10 <> 9 GROUP BY n_name),
known AS (SELECT domain, count, city, population FROM run JOIN population USING (domain))"""
SQL["run_summary"] = f"""WITH {_RUNS}
SELECT count(*) FILTER (count >= 0) AS successful, count(*) FILTER (count < 0) AS failed,
       count(*) FILTER (error LIKE '%Timeout%') AS timeouts,
       coalesce(sum(count) FILTER (count >= 0), 0)::BIGINT AS total_datasets, count(*) AS domains
FROM run"""
SQL["merge_counts"] = f"""WITH {_RUNS}
SELECT coalesce(run.domain, rerun.domain) AS domain,
       CASE WHEN run.count >= 0 OR rerun.count IS NULL THEN run.count ELSE rerun.count END AS count,
       CASE WHEN run.count >= 0 OR rerun.count IS NULL THEN run.error ELSE rerun.error END AS error
FROM run FULL JOIN rerun ON run.domain = rerun.domain"""
SQL["download_summary"] = """SELECT 'n' || c_nationkey AS domain,
       count(*) FILTER (o_orderstatus = 'F') AS successful, count(*) FILTER (o_orderstatus = 'O') AS skipped,
       count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS failed
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"""
_IDS = """expected AS (SELECT 'n' || c_nationkey AS domain, 'c' || c_custkey AS dataset_id FROM customer),
existing AS (
  SELECT 'n' || c_nationkey AS domain, 'c' || c_custkey AS dataset_id
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_totalprice < 60000)"""
SQL["completeness"] = f"""WITH {_IDS}
SELECT domain, count(*) FILTER (NOT found) AS missing_count, count(*) AS total_count FROM (
  SELECT DISTINCT domain, dataset_id, (domain, dataset_id) IN (SELECT (domain, dataset_id) FROM existing) AS found
  FROM expected)
GROUP BY ALL HAVING missing_count > 0"""
SQL["not_yet_done"] = f"""WITH {_IDS}
SELECT dataset_id, domain FROM expected WHERE dataset_id NOT IN (SELECT dataset_id FROM existing)"""
SQL["id_difference"] = f"""WITH {_IDS}
SELECT dataset_id FROM expected EXCEPT SELECT dataset_id FROM existing"""
SQL["counts_with_population"] = f"WITH {_RUNS} SELECT * FROM known"
_LINE = """line AS (
  SELECT regr_slope(log10(count::DOUBLE), log10(population::DOUBLE)) AS slope,
         regr_intercept(log10(count::DOUBLE), log10(population::DOUBLE)) AS intercept,
         min(population)::DOUBLE AS x_low, max(population)::DOUBLE AS x_high
  FROM known WHERE count > 0 AND population > 0)"""
SQL["trend_line"] = f"""WITH {_RUNS}, {_LINE}
SELECT round(slope, 6) AS slope, round(intercept, 6) AS intercept, x_low, x_high FROM line"""
SQL["trend_curve"] = f"""WITH {_RUNS}, {_LINE},
curve AS (
  SELECT point::INT AS point, intercept, slope,
         CASE WHEN point = 199 THEN x_high ELSE x_low + point * ((x_high - x_low) / 199.0::DOUBLE) END AS x
  FROM line CROSS JOIN range(200) r(point))
SELECT point, round(x, 3) AS x, round(pow(10.0::DOUBLE, intercept + slope * log10(x)), 6) AS y FROM curve"""
SQL["count_extremes"] = f"""WITH {_RUNS}
(SELECT * FROM known ORDER BY population, domain LIMIT 3)
UNION (SELECT * FROM known ORDER BY population DESC, domain LIMIT 3)
UNION (SELECT * FROM known ORDER BY count, domain LIMIT 2)
UNION (SELECT * FROM known ORDER BY count DESC, domain LIMIT 2)"""
SQL["format_share"] = f"""WITH {CATALOG},
f AS (SELECT domain, format AS key, count(*) AS count FROM catalog GROUP BY ALL)
SELECT *, round(count / (sum(count) OVER (PARTITION BY domain))::DOUBLE * 100, 1) AS share FROM f"""
SQL["row_share"] = f"""SELECT *, round(count / (sum(count) OVER ())::DOUBLE * 100, 2) AS share
FROM (SELECT ordinal, bucket, sum(count)::BIGINT AS count FROM ({_buckets('row_count')}) GROUP BY ALL)"""
SQL["match_share"] = """SELECT matches, count, round(count / (sum(count) OVER ())::DOUBLE, 2) AS share
FROM (SELECT regexp_matches(text, '[T|t]re') AS matches, count(*) AS count FROM documents
      WHERE text IS NOT NULL GROUP BY ALL)"""
SQL["tabular_share"] = f"""WITH {CATALOG}
SELECT domain, count(*) AS total_datasets, count(*) FILTER (format = 'tabular') AS tabular_count,
       count(*) FILTER (format = 'tabular') / count(*)::DOUBLE * 100.0::DOUBLE AS tabular_percentage
FROM catalog GROUP BY domain HAVING count(*) >= 10"""
_CATEGORY_RANKS = """ranked AS (
  SELECT domain, category, row_number() OVER (PARTITION BY domain ORDER BY count(*) DESC, category) AS rn
  FROM catalog WHERE category IS NOT NULL {} GROUP BY domain, category),
tops AS (
  SELECT domain, string_agg(category, ',' ORDER BY rn) AS top_keys FROM ranked WHERE rn <= 3 GROUP BY domain)"""
SQL["top_categories"] = f"WITH {CATALOG}, {_CATEGORY_RANKS.format('')} SELECT * FROM tops"
SQL["city_report"] = f"""WITH {CATALOG}, {_RUNS}, {_CATEGORY_RANKS.format('')}
SELECT row_number() OVER (ORDER BY count, domain) AS serial, domain, city, count, top_keys AS top_categories
FROM known LEFT JOIN tops USING (domain)"""
SQL["tag_weights"] = f"""WITH {CATALOG},
t AS (SELECT tag AS key, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM catalog) GROUP BY ALL)
SELECT key, round(ln(n + 1), 9) AS weight FROM t
WHERE NOT (contains(key, 'tif') OR contains(key, 'kml') OR contains(key, 'kmz') OR contains(key, 'gis'))
ORDER BY n DESC, key LIMIT 100"""
SQL["name_words"] = """SELECT key, n::DOUBLE AS weight FROM (
  SELECT word AS key, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY ALL)
WHERE NOT (contains(key, 'tif') OR contains(key, 'kml') OR contains(key, 'kmz') OR contains(key, 'gis'))
ORDER BY n DESC, key LIMIT 10"""
SQL["sampled_columns"] = f"""WITH {values_cte()},
chosen AS (SELECT dataset_id FROM (SELECT DISTINCT dataset_id FROM cells) ORDER BY md5('123:' || dataset_id), dataset_id LIMIT 3),
ranked AS (
  SELECT dataset_id, column_name, row_number() OVER (
    PARTITION BY dataset_id ORDER BY md5('123:' || dataset_id || '.' || column_name), column_name) AS rn
  FROM (SELECT DISTINCT dataset_id, column_name FROM cells) WHERE dataset_id IN (SELECT dataset_id FROM chosen))
SELECT dataset_id, column_name FROM ranked WHERE rn <= 5"""
SQL["first_datasets"] = f"""WITH {CATALOG}
SELECT dataset_id, domain FROM catalog ORDER BY dataset_id LIMIT 200"""

# --- pages and domains --------------------------------------------------------------------------------

_HOST = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"
_TITLE = """trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ' || chr(9) || chr(10) || chr(13))"""
SQL["page_titles"] = f"SELECT page_id, {_TITLE} AS title FROM pages"
SQL["pages_by_title"] = f"SELECT page_id, url FROM pages WHERE contains(lower({_TITLE}), 'th')"
SQL["distinct_domains"] = f"SELECT DISTINCT {_HOST} AS domain FROM pages WHERE {_HOST} <> ''"
SQL["streamed_domains"] = SQL["distinct_domains"]
SQL["unseen_domains"] = f"""SELECT DISTINCT {_HOST} AS domain FROM pages WHERE {_HOST} <> ''
EXCEPT SELECT {_HOST} FROM pages WHERE url LIKE '%ref=%'"""
SQL["lines_by_prefix"] = """SELECT url FROM pages
WHERE starts_with(url, 'http://') AND NOT starts_with(url, 'http://www.')"""
SQL["lines_by_substring"] = (
    "SELECT url FROM pages WHERE contains(url, '.example.') AND NOT contains(url, 'page=')"
)
SQL["safe_names"] = """SELECT page_id, translate(url, ':@-', '___') AS field,
       regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g') AS domain FROM pages"""

# --- landed payloads ----------------------------------------------------------------------------------

_PAYLOADS = """payloads AS (
  SELECT 'e' || event_id AS dataset_id, event_id, event_type, user_id, props,
    CASE WHEN value > 200 OR event_type = 'error' THEN 'error'
         WHEN event_type = 'view' AND event_id % 3 < 2 THEN 'empty'
         WHEN event_type = 'view' THEN 'not_array'
         WHEN event_type = 'signup' THEN 'not_json'
         ELSE 'accepted' END AS route
  FROM events),
accepted AS (SELECT * FROM payloads WHERE route = 'accepted')"""
SQL["payload_routes"] = f"WITH {_PAYLOADS} SELECT dataset_id, route FROM payloads"
SQL["record_schemas"] = f"""WITH {_PAYLOADS}
SELECT dataset_id, array_to_string(json_keys(props), ',') AS fields FROM accepted"""
SQL["landed_cells"] = f"""WITH {_PAYLOADS}
SELECT dataset_id, 1 AS row_id, 'k' AS column_name, json_extract_string(props, '$.k') AS value FROM accepted
UNION ALL SELECT dataset_id, 2, 'user', user_id::VARCHAR FROM accepted
UNION ALL SELECT dataset_id, 2, 'type', event_type FROM accepted"""
SQL["landed_row_counts"] = f"WITH {_PAYLOADS} SELECT dataset_id, 3::BIGINT AS row_count FROM accepted"
SQL["profiled_catalog"] = f"""WITH {_PAYLOADS}
SELECT event_type AS domain, dataset_id,
  CASE WHEN event_id % 4 = 3 THEN 'map' ELSE 'tabular' END AS format,
  CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 6 = 1 THEN event_id
       WHEN route = 'accepted' THEN 3 WHEN route = 'empty' THEN 0 END AS row_count,
  CASE WHEN event_id % 4 = 3 THEN NULL
       WHEN event_id % 6 <> 1 AND route = 'accepted' THEN 'k/number/2/0 type/text/2/2 :@region/text/0/0'
       WHEN event_id % 6 <> 1 AND route = 'empty' THEN 'k/number/0/0 type/text/0/0 :@region/text/0/0'
       ELSE 'k/number/?/? type/text/?/? :@region/text/?/?' END AS columns
FROM payloads"""
SQL["portal_records"] = """SELECT 'e' || event_id AS dataset_id, floor(epoch(ts))::BIGINT AS created_at,
  CASE event_id % 5 WHEN 1 THEN floor(epoch(ts))::BIGINT + 60 WHEN 2 THEN NULL ELSE floor(epoch(ts))::BIGINT END AS updated_at,
  CASE WHEN event_id % 2 = 0 THEN event_id * 2 END AS row_count, event_id AS crawl_rows
FROM events"""
SQL["strict_routes"] = """SELECT 'e' || event_id AS dataset_id,
  ['not_json', 'accepted', 'empty', 'error', 'not_array', 'not_json', 'accepted', 'not_json', 'not_json'][event_id % 9 + 1] AS route
FROM events"""
SQL["number_keys"] = """WITH n AS (
  SELECT o_orderkey AS row_id, (1000000000000000 + o_orderkey * 1000)::VARCHAR AS w, (12345678 + o_orderkey)::VARCHAR || '.5' AS p FROM orders)
SELECT row_id, w AS a, w AS b, w AS c, p AS d, p AS e, w AS f, p AS g, false AS exponent FROM n"""
_FILES = """files AS (
  SELECT role AS domain, conv_id || '-' || turn AS dataset_id, role, turn,
    CASE (conv_id + turn) % 7 WHEN 0 THEN 'empty' WHEN 1 THEN 'empty' WHEN 2 THEN 'not_object'
                              WHEN 3 THEN 'corrupt' ELSE 'valid' END AS state
  FROM conversations)"""
SQL["metadata_states"] = f"WITH {_FILES} SELECT domain, dataset_id, state FROM files"
SQL["metadata_issues"] = f"""WITH {_FILES}
SELECT domain, count(*) FILTER (state = 'empty') AS empty_files,
       count(*) FILTER (state = 'corrupt') AS corrupt_files, count(*) AS files
FROM files GROUP BY ALL HAVING empty_files > 0 OR corrupt_files > 0"""
SQL["metadata_records"] = f"""WITH {_FILES}
SELECT domain, dataset_id, role AS category, 'tabular' AS format, turn AS view_count
FROM files WHERE state = 'valid'"""
SQL["summary_status"] = f"""WITH {_FILES},
domains AS (SELECT DISTINCT event_type AS domain FROM events UNION ALL SELECT DISTINCT role FROM conversations),
found AS (
  SELECT domain, count(*) AS files_processed, count(*) FILTER (state = 'valid') AS valid_files
  FROM files GROUP BY ALL)
SELECT domain,
       CASE WHEN e.error IS NOT NULL THEN 'failed' WHEN files_processed IS NULL THEN 'skipped' ELSE 'success' END AS status,
       CASE WHEN e.error IS NOT NULL THEN e.error WHEN files_processed IS NULL THEN 'no_metadata' END AS reason, files_processed,
       coalesce(valid_files, 0) AS valid_files
FROM domains LEFT JOIN found USING (domain)
LEFT JOIN (SELECT role AS domain, min('refused turn ' || turn) AS error FROM conversations WHERE role = 'system' GROUP BY role) e
  USING (domain)"""

# --- stores -------------------------------------------------------------------------------------------

SQL["stored_pairs"] = SQL["joinable_columns"]
SQL["stored_labels"] = "SELECT 'p' || p_partkey AS dataset_id, p_name AS name FROM part"
SQL["stored_population"] = f"""WITH {_RUNS}
SELECT domain, city, 'a, "b" ' || city AS state, population FROM population"""
SQL["stored_lines"] = "SELECT trim(url) AS value FROM pages"
SQL["stored_matches"] = SQL["top_matches"]
SQL["stored_sketches"] = SQL["minhash_signature"]
SQL["stored_embeddings"] = """SELECT 'label' || label AS dataset_id, 'v' || vec_id AS column_name,
  round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings"""
SQL["stored_summary"] = SQL["catalog_summary"]
SQL["stored_counts"] = f"WITH {_RUNS} SELECT * FROM run"
SQL["stored_routes"] = SQL["payload_routes"]
SQL["schemas_with_fallback"] = f"""WITH {_PAYLOADS}
SELECT dataset_id, CASE WHEN route = 'accepted' THEN array_to_string(json_keys(props), ',') ELSE 'k,type,:@region' END AS fields
FROM payloads"""
