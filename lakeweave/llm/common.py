"""What the operators of this subpackage share: rows with a key of their own, and written steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.session import materialize

__all__ = ["documents_of", "in_files", "materialize", "keyed", "placed", "small_count"]

#: Steps of a plan that keep a row of a file what it is.
_PLAIN = ("Project", "Filter", "SubqueryAlias")


def documents_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """Only ``doc_id`` and ``text``, so that other columns of the input, whatever their names, cannot clash; and ``key_col`` as ``row_key``, if it is named."""
    key = [] if key_col is None else [F.col(f"`{key_col}`").alias("row_key")]
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *key)


def keyed(docs: DataFrame) -> DataFrame:
    """Adds ``row_key``, unique for each row, so that null and repeated ids stay apart.

    The keys follow the place of a row in its input split, so the input has to be a set of files: a table, or a step that was written
    (``materialize``). Anything that shuffles would number its rows anew each time it is read. The splits follow the cores of the moment, so a
    key holds for one job only: what hands keys from one job to the next writes the keyed rows and reads them from there.
    """
    return docs.withColumn("row_key", F.monotonically_increasing_id())


def in_files(docs: DataFrame) -> bool:
    """Whether ``docs`` are rows of one Parquet table as its files have them, all or some: then every job finds the same rows, and file and place name a row.

    A table that is made by anything else, or listed from several paths, of which one may come twice, has to be written first.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in _PLAIN:
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    return plan.relation().fileFormat().toString() == "Parquet" and plan.relation().location().rootPaths().size() == 1


def placed(docs: DataFrame, file: str = "file", place: str = "place") -> DataFrame:
    """``docs``, which are `in_files`, with a 64-bit name of each row's file and its place there. Both together are unique and hold for any job, in whatever splits it reads."""
    at = docs.metadataColumn("_metadata")
    return docs.select("*", F.xxhash64(at["file_path"]).alias(file), at["row_index"].alias(place))


def small_count(rows: int, per_group: int) -> int:
    """Groups that hold about ``per_group`` rows each."""
    return max(1, -(-rows // per_group))
