"""From documents to token files: five stages, each a function of (spark, docs, sf_dir).

Each stage gets all rows that the one before kept, written as Parquet and read again; all but the last return the
columns of documents. Labels and the benchmark are read from sf_dir.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, minhash, mixing, quality, tokens
from sparkloom.llm._common import aside, fresh, scratch, table, written

#: The sample aims at this part of the tokens that reach the stage; sources weigh by their tokens to this power.
KEEP, POWER = 0.8, 0.7
TOKENIZER = "word_bpe_49k.json"


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, a score of 0.3 or more.

    Null and empty texts are scored like others, texts of any length whole. Equal texts score alike, so repeated rows
    stay or go together. An empty table stays empty. Columns pass through, whatever their names.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows, restored = aside(docs, "_score")
    return restored(quality.score(rows, model).filter(F.col("_score") >= quality.THRESHOLD))


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; shingles of five words, similarity 0.8.

    Rows that share an id are one document and stay together; rows with a null id stay, and so do null and empty texts,
    which link with nothing. An empty table stays empty. Columns pass through, whatever their names.
    """
    groups = minhash.near_duplicates(docs.select("doc_id", "text"))
    (gone,) = fresh(docs, "_id")
    rows = groups.filter("not kept").select(F.col("id").alias(gone)).distinct()
    return docs.join(rows, docs["doc_id"].cast("bigint") == rows[gone], "left_anti")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words less than one in twenty lies in windows of the benchmark.

    Null and empty texts have no words and stay. Rows with equal ids are judged one by one, equal rows alike. An empty
    table stays empty, an empty benchmark keeps all. Columns pass through, whatever their names.
    """
    rows, restored = aside(docs, *decontaminate.ADDED)
    return restored(decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark")).filter("not contaminated"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the calibrated probabilities sample.

    Null and empty texts have no tokens and go; a null source or language is a value of its own. Rows with equal ids
    share their draw. An empty table stays empty. Columns pass through, whatever their names.
    """
    rows, restored = aside(docs, *mixing.ADDED)
    return restored(mixing.mix(rows, keep=KEEP, power=POWER).filter("_sampled"))


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token files; returns doc_id, start, n_tokens and ids_crc32 as read from them.

    A null text is its end id alone, null ids come first, rows with equal ids keep their records. An empty table gives
    an empty result. Other columns are ignored.
    """
    return tokens.digest(tokens.read_tokens(tokens.write_tokens(docs, scratch(spark, "tokens"), TOKENIZER)))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_dedup", minhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("token_records", token_records),
]

#: The classifier and the tokenizer can't be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
