"""Landed JSON: dataset payloads, metadata documents and catalog pages.

Bodies stay text until they are split into rows, and each row is parsed on its own, so the size limit of a
VARIANT value applies to a row and not to a whole dataset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeweave import schemas
from lakeweave.functions import times
from lakeweave.functions.text import plain_number, strip
from lakeweave.operators.sketch import COLUMN_KEY
from lakeweave.session import materialize

ROUTES = ("accepted", "empty", "error", "not_json", "not_array")


def read_bodies(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """``(dataset_id, body)`` of the files ``<prefix><dataset_id>.json`` below ``path``.

    ``domain`` is the name of the folder that holds the file.
    """
    return (
        spark.read.text(path, wholetext=True, pathGlobFilter=f"{prefix}*.json", recursiveFileLookup=True)
        .select(
            F.element_at(F.split("_metadata.file_path", "/"), -2).alias("domain"),
            F.regexp_extract("_metadata.file_name", f"^{prefix}(.*)\\.json$", 1).alias("dataset_id"),
            F.col("value").alias("body"),
        )
    )


def _starts_with(body: Column, token: str) -> Column:
    return F.coalesce(strip(body).startswith(token), F.lit(False))


def is_json(body: Column) -> Column:
    """Whether the whole text is one JSON value.

    The parsers stop behind the first value. With something around the text, what follows the value has to be what was put there; two
    different frames leave no text that closes both by itself.
    """
    framed = [F.concat(F.lit(a), body, F.lit(b)) for a, b in (("[", "]"), ('{"v":', "}"))]
    return F.coalesce(F.try_parse_json(framed[0]).isNotNull() & F.try_parse_json(framed[1]).isNotNull(), F.lit(False))


def _elements(body: Column) -> Column:
    """Elements of a JSON array as JSON text; null for anything else."""
    return F.when(_starts_with(body, "["), F.from_json(body, "array<string>"))


def _is_blank_row(row: Column) -> Column:
    """A record, as JSON text, that holds nothing."""
    return row.isNull() | (F.regexp_replace(row, "\\s", "") == "{}")


def holds_nothing(value: Column) -> Column:
    """A JSON value that counts as false: none, null, false, 0, empty text, array or object. Text is judged as text: "0" and "false" hold something."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | kind.isin("VOID", "OBJECT<>"), True)
        .when(kind == "BOOLEAN", ~F.try_variant_get(value, "$", "boolean"))
        .when(kind == "STRING", F.try_variant_get(value, "$", "string") == "")
        .when(kind.startswith("ARRAY"), F.to_json(value) == "[]")
        .otherwise(F.coalesce(F.try_variant_get(value, "$", "double") == 0, F.lit(False)))
    )


def route_payloads(raw: DataFrame) -> DataFrame:
    """Add ``route`` to landed ``(dataset_id, status, body)``.

    A JSON object with a true ``error`` or an HTTP error is ``error``; an array without content is
    ``empty``; a good status with text that is not JSON, or JSON that is no array, gets a route of its own.
    """
    parsed = F.when(is_json(F.col("body")), F.try_parse_json("body"))
    elements = F.when(_starts_with(F.col("body"), "["), F.try_variant_get(parsed, "$", "array<variant>"))
    refused = _starts_with(F.col("body"), "{") & ~holds_nothing(F.try_variant_get(parsed, "$.error", "variant"))
    return raw.select(
        "*",
        F.when(F.coalesce(refused, F.lit(False)) | (F.coalesce("status", F.lit(0)) >= 400), "error")
        .when(elements.isNotNull() & F.forall(elements, holds_nothing), "empty")
        .when(elements.isNotNull(), "accepted")
        .when(parsed.isNotNull(), "not_array")
        .otherwise("not_json")
        .alias("route"),
    )


def rows_of(bodies: DataFrame) -> DataFrame:
    """``(dataset_id, row_id, row)``, one row of JSON text per element of each body."""
    return bodies.select("dataset_id", F.posexplode(_elements(F.col("body"))).alias("row_id", "row"))


def _plain(value: Column, json_type: Column) -> Column:
    """Numbers in plain notation, whatever they were written like."""
    return F.when(json_type.rlike("^(DECIMAL|DOUBLE|FLOAT)"), plain_number(value)).otherwise(value)


def cells_of_rows(rows: DataFrame, nested: bool = False) -> DataFrame:
    """One row per key of each record, with the JSON type of its value.

    Nested values are left out unless ``nested`` asks for their JSON text.
    """
    objects = rows.where(_starts_with(F.col("row"), "{"))
    cells = (
        objects.select("dataset_id", "row_id", F.try_parse_json("row").alias("record"))
        .lateralJoin(
            objects.sparkSession.tvf.variant_explode(F.col("record").outer())
        )
        .select(
            "dataset_id",
            "row_id",
            F.col("key").alias("column_name"),
            F.try_variant_get("value", "$", "string").alias("value"),
            F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0).alias("json_type"),
        )
    )
    if not nested:
        cells = cells.where(~F.col("json_type").isin("OBJECT", "ARRAY"))
    return cells.withColumn("value", _plain(F.col("value"), F.col("json_type")))


def boolean_columns(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """``(dataset_id, column_name)`` of the columns that hold a boolean in every record.

    Such columns are not compared with others. Take them out of a column-level table such as the sketches
    with `without_columns`; their cells are few distinct values and cost nothing to carry that far.
    """
    counts = rows.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("records"))
    return (
        cells.groupBy(*COLUMN_KEY)
        .agg(
            F.count(F.lit(1)).alias("present"),
            F.count_if(F.col("json_type") == "BOOLEAN").alias("booleans"),
        )
        .where(F.col("present") == F.col("booleans"))
        .join(counts, "dataset_id")
        .where(F.col("booleans") == F.col("records"))
        .select(*COLUMN_KEY)
    )


def without_columns(table: DataFrame, columns: DataFrame) -> DataFrame:
    return table.join(columns.select(*COLUMN_KEY), COLUMN_KEY, "left_anti")


#: Files of more bytes are split; smaller ones are read as one value each, which needs no shuffle.
WHOLE_BYTES = 32 << 20

FILE = ["path", "block"]


def _landed_files(spark: SparkSession, path: str, prefix: str, condition: Column, **options) -> DataFrame:
    """Text of the landed files, with the dataset that the file, or a folder of files, is named after."""
    name = F.regexp_extract("_metadata.file_path", f"/{prefix}([^/]*)\\.json(/.*)?$", 1)
    found = spark.read.text(path, recursiveFileLookup=True, **options)
    return found.where(condition).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), name.alias("dataset_id"), F.col("value").alias("text")
    ).where(F.col("dataset_id") != "")


def running(rows: DataFrame, order: str, amounts: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its amount over all rows of the same file up to this one, without putting a file into one task.

    Rows are summed within their block of the file; the totals of blocks, one row each, are summed within the file and added.
    """
    within = Window.partitionBy(*FILE).orderBy(order)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    named = rows.withColumns({f"{n}_own": a for n, a in amounts.items()})
    totals = named.groupBy(*FILE).agg(*[F.sum(f"{n}_own").alias(f"{n}_block") for n in amounts])
    bases = totals.select(*FILE, *[F.coalesce(F.sum(f"{n}_block").over(before), F.lit(0)).alias(f"{n}_base") for n in amounts])
    summed = named.withColumns({n: F.sum(f"{n}_own").over(within) for n in amounts})
    joined = summed.join(bases, FILE).withColumns({n: F.col(n) + F.col(f"{n}_base") for n in amounts})
    return joined.drop(*[f"{n}_{end}" for n in amounts for end in ("own", "base")])


def _occurrences(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def split_rows(spark: SparkSession, path: str, prefix: str = "data_", condition: Column | None = None) -> DataFrame:
    """``(dataset_id, row_id, row)`` of JSON arrays of any size: a file is read in byte ranges, and its records are put together from them.

    The text is cut behind every ``}``, which the reader does wherever a range of the file ends. A cut is the end of a record if it stands outside of quotes
    and one level deep. Both follow from running sums: of the quotes before a piece, and then of the brackets outside of quotes. Pieces between two
    ends are joined and parsed as the part of the array that they are. A file whose sums do not come out even, or that is no array, has no rows. An array without
    objects is one piece.
    """
    pieces = _landed_files(spark, path, prefix, F.lit(True) if condition is None else condition, lineSep="}")
    pieces = materialize(pieces.withColumn("place", F.monotonically_increasing_id()), "pieces")
    # A backslash and the character behind it are no quote; no pair of them is cut, since a bracket is never escaped.
    bare = F.regexp_replace("text", r"\\.", "")
    quoted = running(pieces, "place", {"quotes": _occurrences(bare, '"')})
    own = _occurrences(bare, '"')
    opens_inside = (F.col("quotes") - own) % 2 == 1
    outside = F.regexp_replace(F.when(opens_inside, F.concat(F.lit('"'), bare)).otherwise(bare), '"[^"]*("|$)', "")
    closes = F.col("quotes") % 2 == 0
    change = _occurrences(outside, "[{") - _occurrences(outside, "]}") - F.when(closes, 1).otherwise(0)
    # The last piece of a file has no bracket behind it; what it lacks is evened out by counting the file's end as one level up.
    deep = running(quoted.withColumn("closes", closes), "place", {"depth": change})
    ended = F.col("closes") & (F.col("depth") == 1)
    numbered = running(deep, "place", {"ends": F.when(ended, 1).otherwise(0)}).withColumn("record", F.col("ends") - F.when(ended, 1).otherwise(0))
    numbered = materialize(numbered.select("path", "block", "dataset_id", "place", "text", "record", "depth", "closes"), "numbered")
    last = F.struct("block", "place")
    sound = numbered.groupBy("path").agg(
        F.max(last).alias("last"), F.max_by(F.struct("depth", "closes", "text"), last).alias("end"), F.min_by("text", last).alias("start")
    )
    # Behind the last object stands the bracket of the array alone, and the piece counted one level too many down.
    sound = sound.where((F.col("end.depth") == -1) & F.col("end.closes") & strip(F.col("start")).startswith("[") & strip(F.col("end.text")).endswith("]"))
    joined = numbered.join(sound.select("path", "last"), "path").withColumn("final", last == F.col("last"))
    text = F.when(F.col("final"), F.regexp_replace("text", r"\]\s*$", "")).otherwise(F.concat("text", F.lit("}")))
    parts = joined.withColumn("text", text).groupBy("path", "dataset_id", "record").agg(
        F.sort_array(F.collect_list(F.struct("block", "place", "text"))).alias("parts")
    )
    whole = F.regexp_replace(F.array_join(F.transform("parts", lambda p: p["text"]), ""), r"^\s*[\[,]", "")
    elements = F.from_json(F.concat(F.lit("["), whole, F.lit("]")), "array<string>")
    groups = parts.select("path", F.col("parts")[0]["block"].alias("block"), "dataset_id", "record", elements.alias("rows"))
    placed = running(groups, "record", {"after": F.coalesce(F.size("rows"), F.lit(0))})
    first = F.col("after") - F.size("rows")
    return placed.select("dataset_id", first.alias("first"), F.posexplode("rows").alias("k", "row")).select("dataset_id", (F.col("first") + F.col("k")).cast("int").alias("row_id"), "row")


def read_rows(spark: SparkSession, path: str, prefix: str = "data_", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Records of all dataset payloads below ``path``: files ``<prefix><dataset_id>.json``, or folders of that name with files of arrays in them.

    A file of up to ``whole_bytes`` is one value; a larger one is read in ranges, see `split_rows`. ``row_id`` counts within a file.
    """
    small = F.col("_metadata.file_size") <= whole_bytes
    bodies = _landed_files(spark, path, prefix, small, wholetext=True).withColumnRenamed("text", "body")
    return rows_of(bodies).unionByName(split_rows(spark, path, prefix, ~small))


def record_schemas(rows: DataFrame) -> DataFrame:
    """``(dataset_id, fields)``: keys of the first non-empty record of each dataset, in record order."""
    filled = rows.where(_starts_with(F.col("row"), "{") & ~_is_blank_row(F.col("row")))
    return filled.groupBy("dataset_id").agg(
        F.min_by(F.json_object_keys("row"), "row_id").alias("fields")
    )


def schemas_or_metadata(schemas_found: DataFrame, portal: DataFrame) -> DataFrame:
    """Field lists from landed records, else from the portal's column list; empty lists are dropped."""
    stated = portal.select(
        "dataset_id",
        F.filter(
            F.transform("columns", lambda c: c["field_name"]),
            lambda f: f.isNotNull() & (f != ""),
        ).alias("stated"),
    )
    return (
        schemas_found.join(stated, "dataset_id", "full_outer")
        .select("dataset_id", F.coalesce("fields", "stated").alias("fields"))
        .where(F.size("fields") > 0)
    )


def check_metadata(bodies: DataFrame) -> DataFrame:
    """Add ``state``: ``valid`` for a non-empty JSON object, else ``empty``, ``not_object`` or ``corrupt``.

    ``null`` and ``{}`` are empty.
    """
    parsed = F.try_parse_json("body")
    kind = F.schema_of_variant(parsed)
    return bodies.withColumn(
        "state",
        F.when(parsed.isNull(), "corrupt")
        .when(kind.isin("VOID", "OBJECT<>"), "empty")
        .when(kind.startswith("OBJECT"), "valid")
        .otherwise("not_object"),
    )


def metadata_issues(checked: DataFrame) -> DataFrame:
    """Per domain, metadata files that are empty or cannot be read; only domains that have some."""
    return (
        checked.groupBy("domain")
        .agg(
            F.count_if(F.col("state") == "empty").alias("empty_files"),
            F.count_if(F.col("state") == "corrupt").alias("corrupt_files"),
            F.count(F.lit(1)).alias("files"),
        )
        .where((F.col("empty_files") > 0) | (F.col("corrupt_files") > 0))
    )


def crawl_metadata(checked: DataFrame) -> DataFrame:
    """Crawl records from checked metadata bodies ``(domain, dataset_id, body, state)``."""
    return (
        checked.where(F.col("state") == "valid")
        .select("domain", "dataset_id", F.from_json("body", schemas.CRAWL_FILE).alias("m"))
        .select(
            "domain",
            "dataset_id",
            "m.category",
            "m.format",
            "m.tags",
            F.col("m.downloadCount").alias("download_count"),
            F.col("m.viewCount").alias("view_count"),
            F.col("m.createdAt").alias("created_at"),
            F.col("m.publicationDate").alias("publication_date"),
            F.col("m.updatedAt").alias("updated_at"),
            F.col("m.rowCount").alias("row_count"),
            "m.columns",
        )
    )


def portal_metadata(bodies: DataFrame) -> DataFrame:
    """Portal documents ``(domain, dataset_id, body)`` as the input of crawl and report records.

    Times are epoch seconds, from whole or fractional numbers or from ISO text. A row time in text that cannot be read hides the
    time of the data, as a readable one does. ``row_count`` is what the document's own metadata states, ``stated_row_count`` the number beside it.
    """
    def epoch(name: str) -> Column:
        return F.unix_seconds(times.from_variant(F.col(f"m.{name}")))

    rows_updated = F.col("m.rowsUpdatedAt")
    unreadable = (F.schema_of_variant(rows_updated) == "STRING") & (F.try_variant_get(rows_updated, "$", "string") != "") & epoch("rowsUpdatedAt").isNull()
    columns = F.transform(
        F.col("m.columns"),
        lambda c: F.struct(
            c["fieldName"].alias("field_name"),
            c["name"].alias("name"),
            c["dataTypeName"].alias("data_type"),
        ),
    )
    return bodies.select(
        "domain", "dataset_id", F.from_json("body", schemas.PORTAL_FILE).alias("m")
    ).select(
        "domain",
        "dataset_id",
        "m.name",
        "m.category",
        "m.tags",
        F.col("m.viewType").alias("view_type"),
        F.col("m.downloadType").alias("download_type"),
        F.col("m.assetType").alias("asset_type"),
        epoch("createdAt").alias("created_at"),
        epoch("publicationDate").alias("publication_date"),
        epoch("viewLastModified").alias("view_last_modified"),
        epoch("rowsUpdatedAt").alias("rows_updated_at"),
        F.when(~F.coalesce(unreadable, F.lit(False)), epoch("dataUpdatedAt")).alias("data_updated_at"),
        F.col("m.viewCount").alias("view_count"),
        F.col("m.downloadCount").alias("download_count"),
        F.col("m.metadata.rowCount").try_cast("bigint").alias("row_count"),
        F.col("m.rowCount").alias("stated_row_count"),
        columns.alias("columns"),
    )


def catalog_domains(pages: DataFrame) -> DataFrame:
    """``domain`` of every item on landed catalog pages ``(body)``."""
    return (
        pages.select(F.from_json("body", schemas.CATALOG_PAGE).alias("page"))
        .select(F.explode("page.results").alias("item"))
        .select(F.col("item.metadata.domain").alias("domain"))
    )
