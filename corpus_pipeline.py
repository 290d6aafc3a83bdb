"""The corpus pipeline: language ID, near-dedup, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom.llm import decontaminate, language, mixing, near_dup, queries, token_shards
from headroom.llm.common import discard, read, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_LANGUAGE_SCORE = 0.1
NEAR_DUP_PERCENT = 80  # of the union of 5-word shingles; the 85 of minhash_dedup is the query op10's own


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects null texts, texts without letters and texts of which hardly an n-gram is known in the predicted language; repeated rows leave or stay together."""
    model = language.learn(docs, F.lit(True))
    found = language.identify(docs, model)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(COLUMNS)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the first by doc_id (null last) and text.

    Rows are judged one by one: repeated rows, and copies without an id, are copies like
    others; rows that share an id but not a text are documents of their own. Null and empty
    texts stay.
    """
    return near_dup.first_rows(docs, percent=NEAR_DUP_PERCENT).select(COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a passage of the benchmark leave, each judged by its own text, whatever its id; null and empty texts stay."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark")).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per copy that the mix takes, in training order; a copy keeps its document's id and its whole text.

    Rows of size 0 (null, empty or blank texts) are taken 0 times. A null source is a source of its own;
    repeated rows are mixed as separate documents.
    """
    return mixing.curriculum_mix(docs).select(COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in the order in which a written table holds its rows, which is the training order of the stage before; each copy is encoded as often as it comes, a null text is empty.

    Rows that are no written table have no order: they stand by doc_id (null first), then text.
    """
    return token_shards.token_shards(docs, queries.default_tokenizer(), order=_table_order(docs))


def _table_order(docs: DataFrame) -> list[Column] | None:
    """Number of the part and of the row in it: a sorted table is written as sorted parts."""
    order = [F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int"), F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    try:
        docs.select(*order).schema
    except AnalysisException:
        return None
    return order


STAGES = [
    ("language_id", language_stage),
    ("minhash_dedup", near_dup_stage),
    ("decontaminate", decontamination_stage),
    ("curriculum_mix", mixing_stage),
    ("token_shards", token_stage),
]

#: The stages learn models and tokenize, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; a stage's table goes when the next one is written."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    shards = STAGES[-1][1](spark, docs, sf_dir)  # written, and read back from the shards alone
    discard(docs)
    return shards
