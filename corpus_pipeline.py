"""A corpus pipeline over ``documents``: each stage's table is written and read again by the next.

All stages take the columns of ``documents`` by name, ignore further ones,
whatever their names, and give no row for an empty table. Null texts are empty
ones: the classifier scores them as texts without words, near-dedup links them
with nothing, the scan leaves them null, the mix never takes them, packing makes
them one end id. Rows alike in doc_id and text are one after near-dedup; other
stages judge each row for itself. Null doc_ids stay; a null source is a source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.best_fit_packing import pack_documents
from lodestream.llm.near_dedup import deduplicated
from lodestream.llm.quality_classifier import ACCEPT, filtered
from lodestream.llm.secret_scan import secret_scan
from lodestream.llm.source_mixing import mixed
from lodestream.llm.store import stored
from lodestream.llm.tokens import default_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return filtered(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"), ACCEPT)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return deduplicated(docs.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark, and n_chars follows."""
    done = secret_scan(docs.select(*COLUMNS))
    chars = F.when(F.size("secrets") > 0, F.length("redacted").cast("long")).otherwise(F.col("n_chars"))
    return done.withColumn("n_chars", chars).withColumn("text", F.col("redacted")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixed(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each token piece, with its place in a sequence."""
    return pack_documents(docs.select(*COLUMNS), default_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify_quality),
    ("minhash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("source mixing", mix),
    ("best-fit packing", pack),
]
#: Model scores and hash draws have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs, f"stage{n}")
    return docs
