"""From raw documents to piece ids: language, near copies, benchmark passages, secrets, pieces.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept.
All but the last return the columns they were given. Between stages the rows are written
as Parquet, so a lost executor costs a stage's work at most.

Null texts have no letter and go in the first stage; documents without doc_id are never
near copies. Extra columns stay. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, language, minhash, pieces, secrets
from quire.llm.common import col, has_at_most, shared_folder, small_batches, table

#: Share of a text's letters in one language below which the text is rejected.
MIN_LANGUAGE_SCORE = 1 / 3
#: Ids up to which a list of dropped documents is broadcast.
BROADCAST_IDS = 1_000_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language of their own: no letters, or no language with a third of them."""
    model = language.train(docs)
    found = small_batches(docs).withColumn("__language", language.identify(col("text"), model, spark))
    clear = (F.col("__language.lang_pred") != "und") & (F.col("__language.score") >= MIN_LANGUAGE_SCORE)
    return found.where(clear).drop("__language")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near copies; of repeated rows, one."""
    found = minhash.near_duplicates(docs)
    gone = found.where("NOT kept").select(F.col("doc_id").alias("__id")).distinct()
    kept = docs.join(_light(gone), col("doc_id") == F.col("__id"), "left_anti")
    twice = docs.groupBy(col("doc_id").alias("__id")).count().where("count > 1 AND __id IS NOT NULL").select("__id")
    twice = _light(twice)
    once = kept.join(twice, col("doc_id") == F.col("__id"), "left_anti")
    repeated = kept.join(twice, col("doc_id") == F.col("__id"), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts; ``n_chars`` follows."""
    text = secrets.redact(col("text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = small_batches(docs).withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add ``piece_ids`` and their number, ``n_pieces``."""
    out = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.withColumn("n_pieces", F.size("piece_ids").cast("long"))


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode_pieces),
]

#: Several stages are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def _light(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if has_at_most(ids, BROADCAST_IDS) else ids


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder.

    A stage's rows are deleted once the next stage's are written; those before the last
    stage stay, since the result is computed from them.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:  # the stage before is read no more
                _delete(spark, f"{folder}/{k - 1}")
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
