"""Runs that pick up where the last one stopped, as streams over folders that new files arrive in.

Each function processes what is new and returns when it is done (``availableNow``). Progress lives in a
checkpoint folder; output of a batch goes to a folder named by the batch, so that a batch that is run again
after a failure replaces its own output and nothing is counted twice.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lakeweave import schemas
from lakeweave.operators.similarity import embed_columns, hashed_terms
from lakeweave.operators.sketch import (
    COLUMN_KEY,
    distinct_values,
    merge_registers,
    registers,
    sketches_from_registers,
)
from lakeweave.session import shuffles_end_with_the_write

FAN = 8


def file_stream(
    spark: SparkSession, path: str, schema, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Rows of parquet files below ``path`` as they arrive."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def table_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Rows of the parquet table at ``path`` as they arrive, whether it is one file or a folder of files.

    A name pattern is held against files and not against the folder they are in, so a folder is the place of the stream itself, and a
    single file is looked for by its name in the folder it stands in.
    """
    place, system = _file_system(spark, path)
    if system.getFileStatus(place).isDirectory():
        return file_stream(spark, path, schema, files_per_batch=files_per_batch)
    name = re.sub(r"([\\{}\[\]*?])", r"\\\1", place.getName())
    return file_stream(spark, place.getParent().toString(), schema, name, files_per_batch)


def _run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def _run_name(checkpoint: str) -> str:
    """Name of the folder that the runs of one checkpoint write to; a new checkpoint adds to a store and replaces nothing in it."""
    return hashlib.sha256(checkpoint.encode()).hexdigest()[:16]


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _complete_banks(spark: SparkSession, run: str) -> dict[tuple[int, int], str]:
    """Completely written banks below the folder of a run: first and last batch, and the path."""
    place, system = _file_system(spark, run)
    found = {}
    for status in system.listStatus(place) if system.exists(place) else []:
        path = status.getPath()
        bounds = path.getName().removeprefix("batches=").split("-")
        marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        if len(bounds) == 2 and all(b.isdigit() for b in bounds) and system.exists(marker):
            found[int(bounds[0]), int(bounds[1])] = path.toString()
    return found


def _widest(banks: dict[tuple[int, int], str]) -> list[tuple[int, int]]:
    """The fewest banks that hold every batch once: ranges nest, so a bank counts unless it lies within another one."""
    return [r for r in banks if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in banks)]


def update_registers(stream: DataFrame, store: str, checkpoint: str, family: str = "sha1", fan: int = FAN) -> None:
    """Fold the new cells of ``stream(dataset_id, column_name, value)``, or of `sources.tables.typed_cells`, into the register store.

    Only the registers of the batch are written. They merge with the earlier ones by minimum, so the stream itself keeps no state,
    however many columns there are. Every ``fan`` banks of one size are folded into one of the next size, so after n batches a read folds
    less than ``fan`` banks of each of log(n) sizes. A folded bank takes the place of its parts at the moment its success marker appears,
    and the parts are deleted in a later batch; a batch that is run again after a failure finds them and writes the same banks once more.
    A checkpoint folder has banks of its own, several may feed one store.
    """
    if fan < 2:
        raise ValueError(f"fan must be at least 2, not {fan}")
    run = f"{store}/run={_run_name(checkpoint)}"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = {r: path for r, path in _complete_banks(spark, run).items() if r[1] < batch_id}
        for bounds in set(before) - set(_widest(before)):
            place, system = _file_system(spark, before.pop(bounds))
            system.delete(place, True)
        bank = lambda first: f"{run}/batches={first}-{batch_id}"
        with shuffles_end_with_the_write(spark):
            registers(distinct_values(batch), family=family, by_value=True).write.mode("overwrite").parquet(bank(batch_id))
        width = fan
        while (batch_id + 1) % width == 0:
            first, part = batch_id + 1 - width, width // fan
            parts = [before.get((start, start + part - 1)) for start in range(first, batch_id + 1 - part, part)]
            if None in parts:  # Batches written under another fan stay as they are.
                break
            folded = merge_registers(spark.read.parquet(*parts, bank(batch_id + 1 - part)))
            folded.write.mode("overwrite").parquet(bank(first))
            width *= fan

    _run(stream, handle, checkpoint)


def register_banks(spark: SparkSession, store: str) -> list[str]:
    """Paths of the banks that a read of the store folds."""
    place, system = _file_system(spark, store)
    runs = [s.getPath() for s in system.listStatus(place)] if system.exists(place) else []
    paths = []
    for run in runs:
        if run.getName().startswith("run="):
            banks = _complete_banks(spark, run.toString())
            paths += [banks[bounds] for bounds in sorted(_widest(banks))]
    return paths


def stored_registers(spark: SparkSession, *stores: str) -> DataFrame:
    """Register banks of everything that has arrived in one or several stores so far."""
    paths = [path for store in stores for path in register_banks(spark, store)]
    return spark.read.schema(schemas.REGISTERS).parquet(*paths) if paths else spark.createDataFrame([], schemas.REGISTERS)


def stored_sketches(spark: SparkSession, *stores: str) -> DataFrame:
    """Sketches over everything that has arrived so far; the same as those of one batch run."""
    return sketches_from_registers(merge_registers(stored_registers(spark, *stores)))


def _first_text(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first text in text order of a column that no earlier batch had; null only where there is no other."""
    first = None
    for frame in frames:
        first = min([*frame["text"].dropna(), *([] if first is None else [first])], key=str.encode, default=None)
    if not state.exists:
        state.update((True,))
        yield pd.DataFrame({"dataset_id": [key[0]], "column_name": [key[1]], "text": [first]}, dtype=object)


def update_embeddings(
    stream: DataFrame,
    store: str,
    checkpoint: str,
    embedder: Callable[[DataFrame], DataFrame] = hashed_terms,
) -> None:
    """Embed the columns of ``stream(dataset_id, column_name, text)`` that are not stored yet.

    A column is known by dataset and name, so it does not matter which files of a dataset share a batch. Of several texts
    of one column in a batch the first in text order counts. Each checkpoint folder writes to a folder of its own below
    ``store``, so a new one adds to a store and replaces nothing in it.

    The columns a checkpoint has seen are the state of its stream, so a batch looks up its own columns and reads nothing this checkpoint has
    written; only what other checkpoints wrote to the store is read, keys alone. With many columns choose the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``), which keeps the state on disk.
    """
    run = _run_name(checkpoint)
    schema = "dataset_id string, column_name string, text string"
    fresh = (
        stream.select(*[F.col(name).cast("string").alias(name) for name in (*COLUMN_KEY, "text")])
        .groupBy(*COLUMN_KEY)
        .applyInPandasWithState(_first_text, schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)
    )

    def handle(batch: DataFrame, batch_id: int) -> None:
        done = _other_runs(batch.sparkSession, store, run)
        if done is not None:
            same = [batch[c].eqNullSafe(done[f"done_{c}"]) for c in COLUMN_KEY]
            batch = batch.join(done, same, "left_anti")
        embed_columns(batch, embedder).write.mode("overwrite").parquet(f"{store}/run={run}/batch_id={batch_id}")

    _run(fresh, handle, checkpoint)


def _other_runs(spark: SparkSession, store: str, run: str) -> DataFrame | None:
    """Columns that other checkpoints have stored, None if there are no others."""
    place, system = _file_system(spark, store)
    runs = [s.getPath() for s in system.listStatus(place)] if system.exists(place) else []
    others = [p.toString() for p in runs if p.getName().startswith("run=") and p.getName() != f"run={run}"]
    if not others:
        return None
    stored = spark.read.schema(schemas.EMBEDDINGS).option("recursiveFileLookup", True).parquet(*others)
    return stored.select(*[F.col(c).alias(f"done_{c}") for c in COLUMN_KEY]).distinct()


def stored_embeddings(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(store).select("dataset_id", "column_name", "embedding")


def update_domains(stream: DataFrame, store: str, checkpoint: str) -> None:
    """Write each domain of ``stream(domain)`` once, across all runs.

    The set of domains seen is the state of the stream. It has no watermark, because a domain stays known
    for good, so it grows with the number of distinct domains.
    """
    found = stream.where(F.coalesce(F.col("domain"), F.lit("")) != "").select("domain")
    (
        found.dropDuplicates(["domain"])
        .writeStream.format("parquet")
        .option("path", store)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
