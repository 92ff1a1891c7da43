"""Documents to training tokens: drop poor texts, drop near duplicates, mix sources to their weights, encode.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept. All but the last return the columns
of documents; the last returns tokens. ``run`` writes each stage to the shared folder before the next one reads it, so a
lost executor costs at most the stage at hand.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplexspark.llm.bpe import bpe_encode
from simplexspark.llm.mixing import mix_sources
from simplexspark.llm.neardup import drop_near_duplicates
from simplexspark.llm.quality import grade_of, rate_quality, train
from simplexspark.llm.queries import KEEP_TAIL
from simplexspark.llm.text import table
from simplexspark.sources.stages import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is at least ``KEEP_TAIL``. The model is fitted on those of
    ``docs`` that are rated; without any, all stay that the prior lets stay. Null texts are judged as empty ones."""
    model = train(docs, table(spark, sf_dir, "labels"), grade_of(), 3)
    rated = rate_quality(docs.select(F.struct("*").alias("doc"), F.col("text").alias("text")), model)
    return rated.where(F.col("tail") >= KEEP_TAIL).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text they decode to, for each row."""
    coded = bpe_encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), decoded_col="decoded")
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]
#: No SQL: the classifier is fitted and the mix draws by hash; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
