"""From raw documents to token files: each stage takes all that the one before it kept.

1. quality: documents that the classifier rejects go;
2. near duplicates: of each group of similar documents one stays;
3. decontamination: documents with enough benchmark text go;
4. mixing: sources are brought to their target weights, rows repeated or left out;
5. tokens: what is left is encoded, written as ORC, and reported from the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwise.llm import decontamination, mixing, quality, tokens, trie
from stallwise.llm.folders import kept, new_folder
from stallwise.llm.shipping import ship


def _wrapped(docs: DataFrame) -> DataFrame:
    """Whole rows in one column, so that no name of theirs can clash."""
    return docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = quality.scored(_wrapped(docs), quality.fitted(docs, labels), ["_row"], text="_text")
    return rows.filter(F.col("score") >= 0.5).select("_row.*")


def keep_one_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return trie.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.judged(decontamination.contamination(_wrapped(docs), benchmark, ["_row"], text="_text"))
    return found.filter(~F.col("contaminated")).select("_row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.select(
        F.struct("*").alias("_row"), F.col("text").alias("_text"), F.col("source").alias("_from"), F.col("doc_id").alias("_id")
    )
    taken = mixing.mixed(rows, text="_text", source="_from", key="_id")
    mix = mixing.copies(taken, ["_row", "_text"], text="_text")
    return mix.select(F.col("_row").withField("text", F.col("_text")).alias("_row")).select("_row.*")


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    files = new_folder(spark, "tokens")
    tokens.write_tokens(docs, files)
    return tokens.token_report(spark, files)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_group),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("tokens", write_token_files),
]

#: SQL can express neither a trained classifier nor a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; the rows of the last one."""
    folder = sf_dir.rstrip("/")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, folder), f"stage-{name}")
    return STAGES[-1][1](spark, docs, folder)
