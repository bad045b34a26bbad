"""A corpus pipeline: toxicity, near-duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept and gives a DataFrame, which
is written as Parquet and read again for the next. All but the last give the columns of documents.

Defined results of every stage: an empty table gives an empty table, further columns are passed on by all stages but
the last, and no text is cut. What each does with nulls, empty texts and repeated rows is stated below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from docflow.llm import bpe, minhash, mixing, toxicity
from docflow.llm.common import shared_dir
from docflow.llm.queries import tokenizer

TOKENIZER = "byte_bpe_50k.json"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the cut.

    A null text is scored as an empty one, without features, and stays; repeated rows are scored alike and all stay or
    all go; a document needs neither a label nor a key. If no label is toxic every document stays.
    """
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links of similarity 0.8 or more on five-word shingles, the one of least doc_id.

    Null and empty texts and those without words are linked with nothing and stay, also beside each other; so do rows
    without a doc_id that are no copies. Of rows with one doc_id and one text a single one stays.
    """
    return minhash.deduplicated(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix; that order is the order of files and of rows within them.

    Documents of a null source are a source of their own, null and empty texts count one byte, repeated rows are placed
    one by one.
    """
    return mixing.mixed(docs, exponent=0.5, block_bytes=1 << 16)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the place in the mix: the file and the row within it (null if docs aren't files).

    Null and empty texts have no ids; repeated rows are encoded one by one.
    """
    try:
        placed = docs.select("*", F.col("_metadata.file_name").alias("mix_file"), F.col("_metadata.row_index").alias("mix_row"))
    except AnalysisException:
        placed = docs.select("*", F.lit(None).cast("string").alias("mix_file"), F.lit(None).cast("long").alias("mix_row"))
    rows = bpe.encode(placed.select("doc_id", "source", "lang", "mix_file", "mix_row", "text"), tokenizer(TOKENIZER), into="ids", drop=("text",))
    return rows.select("doc_id", "source", "lang", "mix_file", "mix_row", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: SQL can express neither the fitted classifier nor the schedule; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are kept in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{folder}/{k}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
