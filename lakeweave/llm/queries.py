"""The operators of this subpackage as queries on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import attribution, chat, dac, decontaminate, jaccard_join, language, neighbours, packing, personal_data, runs, sharding, suffix_array, whitening
from lakeweave.llm.queries_sql import OP3_SQL, OP10_SQL
from lakeweave.session import scratch_path


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """What is left of each document without the strings of 200 bytes that occur more than once."""
    found = suffix_array.repeats(_table(spark, directory, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_ngram_jaccard_join(spark: SparkSession, directory: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of at least 0.85."""
    found = jaccard_join.jaccard_components(_table(spark, directory, "documents"), width=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op3_benchmark_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    """Words of each document that stand in a 10-word window of a benchmark item."""
    found = decontaminate.find_contamination(_table(spark, directory, "documents"), _table(spark, directory, "benchmark"), window=10)
    return decontaminate.digest(found)


def op4_best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    packed = packing.pack_documents(_table(spark, directory, "documents"), capacity=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_language_id(spark: SparkSession, directory: str) -> DataFrame:
    """The language of each document by a network trained on the rows that are not held out."""
    found = language.identify_languages(_table(spark, directory, "documents"))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_nearest_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    """The ten nearest other vectors of every vector whose id is divisible by 100."""
    return neighbours.neighbours(_table(spark, directory, "embeddings"), every=100, k=10)


def op7_kd_sharding(spark: SparkSession, directory: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, copies together."""
    axes = {"id": F.col("doc_id"), "size": F.octet_length("text"), "source": F.crc32(F.encode(F.coalesce("source", F.lit("")), "UTF-8"))}
    placed = sharding.kd_shards(_table(spark, directory, "documents"), 16, axes)
    nothing = F.lit(None).cast("int")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", nothing.alias("grown_shard"))


def op8_token_codes(spark: SparkSession, directory: str) -> DataFrame:
    """All documents written as directly addressable codes and read back."""
    target = scratch_path(spark, "codes")
    dac.write_codes(_table(spark, directory, "documents"), target, end_id=2)
    return dac.stored_documents(dac.read_codes(spark, target))


def op9_section_tokens(spark: SparkSession, directory: str) -> DataFrame:
    """Tokens of each line of each document; a token on a border belongs to the line of its first character."""
    found = attribution.section_tokens(_table(spark, directory, "documents"), rule="first")
    return found.select("doc_id", "section", "start", "end", "n_tokens", "n_crossing")


def op10_chat_formatting(spark: SparkSession, directory: str) -> DataFrame:
    """All conversations, and one made of control strings, folded from events, rendered and read back."""
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = _table(spark, directory, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    rendered = chat.render(chat.fold_events(chat.events_of_turns(turns)))
    return chat.digests(chat.read_back(rendered))


def op11_embedding_whitening(spark: SparkSession, directory: str) -> DataFrame:
    """All embeddings as whole numbers, projected on the first four components of their covariance, with unit variance."""
    return whitening.whiten(_table(spark, directory, "embeddings"), most=4, scale=256)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: a tenth of the documents, chosen by a checksum of the id, repeat a stretch of their own words up to their end."""
    checksum = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    split = docs.select("doc_id", "text", (checksum % 10 == 0).alias("chosen"), F.floor(checksum / 10).alias("g")).withColumn(
        "words", F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)))
    )
    sized = split.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    placed = sized.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    written = F.expr("concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p), cast((n - a) div p as int))), slice(words, a + 1, (n - a) % p))")
    return placed.select("doc_id", F.when(F.col("chosen") & (F.col("n") > 0), F.array_join(written, " ")).otherwise(F.col("text")).alias("text"))


def digest_of_runs(docs: DataFrame) -> DataFrame:
    return runs.digest(runs.periodic_runs(with_planted_runs(docs), least_words=6, least_periods=4))


def op12_periodic_runs(spark: SparkSession, directory: str) -> DataFrame:
    """Stretches of each document that repeat four times or more, and what is left with one period of each."""
    return digest_of_runs(_table(spark, directory, "documents"))


def op13_personal_data(spark: SparkSession, directory: str) -> DataFrame:
    """Places of emails, network addresses, card and phone numbers in every document, plain and disguised."""
    return personal_data.digest(personal_data.find_personal_data(_table(spark, directory, "documents")))


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_language_id": op5_language_id,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_kd_sharding": op7_kd_sharding,
    "op8_token_codes": op8_token_codes,
    "op9_section_tokens": op9_section_tokens,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_personal_data": op13_personal_data,
}

SQL: dict[str, str] = {
    "op3_benchmark_decontamination": OP3_SQL,
    "op10_chat_formatting": OP10_SQL,
}
