"""A training corpus from raw documents, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder
and hands the reread table to the next one. The first four return the columns of ``documents``:

toxicity         documents that the classifier chain calls toxic go
near_dedup       one document of each near-duplicate group stays (five-word shingles, similarity 0.8)
decontamination  documents that hold a 10-word window of the benchmark go
pii              personal data is replaced by its kind in brackets; n_chars follows
sentencepiece    doc_id, n_pieces, ids (SentencePiece) and round_trip (whether the ids decode to the text)

Null and empty texts are clean and pass. Rows with a null doc_id, or with one that other rows have too, are judged
by their own text; of rows with equal doc_id and text one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relforge.llm import decontamination as decontam
from relforge.llm import near_dedup, pii, sentencepiece, toxicity
from relforge.llm.shared import saved, table

#: Lists of rows to drop up to this length go to the executors; longer ones are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def _without(docs: DataFrame, drop: DataFrame, on: list) -> DataFrame:
    drop = saved(drop, "drop")
    return docs.join(F.broadcast(drop) if drop.count() <= BROADCAST_ROWS else drop, on, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, chain, prefix="_toxicity_")
    return scored.where(F.col("_toxicity_toxic") < chain.threshold).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 OR doc_id IS NULL")
    if odd.isEmpty():
        found = near_dedup.near_duplicates(docs.select("doc_id", "text"), shingle=5)
        return _without(docs, found.where("NOT kept").select("doc_id"), ["doc_id"])
    # the id and the text name a row, so that rows without an id or with a shared one are judged by their own text
    rows = docs.withColumn("_row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("hash"), F.col("text").isNull().alias("empty")))
    rows = saved(rows.dropDuplicates(["_row"]), "rows")
    found = near_dedup.near_duplicates(rows.select("_row", "text"), shingle=5, key="_row")
    return _without(rows, found.where("NOT kept").select("_row"), ["_row"]).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("hash")).alias("_row"), "text")
    found = decontam.overlap(keyed, table(spark, sf_dir, "benchmark"), key="_row").where("contaminated")
    drop = found.select(F.col("_row.doc_id").alias("_id"), F.col("_row.hash").alias("_hash")).distinct()
    return _without(docs, drop, [F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))])


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = sentencepiece.model_path()
    rows = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("source_crc32"))
    ids = saved(sentencepiece.encode(rows, path, ["doc_id", "source_crc32"]), "pieces")  # one Python worker a task
    back = sentencepiece.decode(ids, path, ["doc_id", "source_crc32", "ids"], digest=True)
    return back.select("doc_id", F.col("n_ids").alias("n_pieces"), "ids", (F.col("source_crc32") == F.col("text_crc32")).alias("round_trip"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("pii", redact), ("sentencepiece", encode)]

#: The classifier and the tokenizer are beyond SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage over all documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
