"""Schemas of stored and exchanged tables."""

from __future__ import annotations

RAW_PAYLOADS = "dataset_id string, status int, body string"

CELLS = "dataset_id string, row_id int, column_name string, value string, json_type string"

SKETCHES = (
    "dataset_id string, column_name string, signature array<bigint>, cardinality bigint"
)

PAIRS = (
    "left_dataset string, left_column string, right_dataset string, right_column string, "
    "js double, jc_left_in_right double, jc_right_in_left double"
)

# Field names of a crawl metadata file.
CRAWL_FILE = (
    "category string, format string, tags array<string>, downloadCount bigint, viewCount bigint, "
    "createdAt bigint, publicationDate bigint, updatedAt bigint, rowCount bigint, "
    "columns array<struct<name: string, type: string, nulls: bigint, semantic_nulls: bigint>>"
)

CRAWL_RECORDS = (
    "domain string, dataset_id string, category string, format string, tags array<string>, "
    "download_count bigint, view_count bigint, created_at bigint, publication_date bigint, "
    "updated_at bigint, row_count bigint, "
    "columns array<struct<name: string, type: string, nulls: bigint, semantic_nulls: bigint>>"
)

# Field names of a portal's own metadata document.
PORTAL_FILE = (
    "name string, category string, tags array<string>, viewType string, downloadType string, "
    "assetType string, createdAt variant, publicationDate variant, viewLastModified variant, "
    "rowsUpdatedAt variant, dataUpdatedAt variant, viewCount bigint, downloadCount bigint, "
    "metadata struct<rowCount: string>, rowCount bigint, "
    "columns array<struct<fieldName: string, name: string, dataTypeName: string>>"
)

DOMAIN_COUNTS = "domain string, count bigint, error string"

POPULATION = "domain string, city string, `state/province` string, population bigint"

LABELS = "dataset_id string, name string"

MATCHES = "col1 string, col2 string, score double"

EMBEDDINGS = "dataset_id string, column_name string, embedding array<double>"

REGISTERS = "dataset_id string, column_name string, slot int, reg bigint"

SUMMARY = "domain string, statistic string, key string, count bigint"

CATALOG_PAGE = (
    "results array<struct<metadata: struct<domain: string>, resource: struct<id: string>>>"
)
