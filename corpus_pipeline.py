"""From documents to token ids: quality filter, one of each group of near copies, mixture of sources, tokens.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir), works on all that the stage before
kept and returns a table, which is written as Parquet and read again. All but the last return the columns of
``documents``. ``ORACLE_SQL`` is None: training, entropy balancing and tokens are not SQL; tests hold the stages
against brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from histoplane.llm import mixing, ngram_join, quality, sentencepiece_bpe
from histoplane.llm.common import cut, read_table

#: Documents with a lower score are rejected.
LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, read_table(spark, sf_dir, "labels"), ~quality.held_out())
    return quality.score(docs, model).where(F.col("score") >= LEAST_QUALITY).select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def sentencepiece_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode(docs.select("doc_id", "source", "text"), sentencepiece_bpe.model_path(), outputs=[*sentencepiece_bpe.DIGESTS, "ids"])


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("mixing sources to target weights", source_mixing),
    ("SentencePiece encoding and decoding", sentencepiece_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{i}")
    return docs
