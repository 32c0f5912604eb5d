"""A pipeline over documents: five stages, each by one of the operators of wayloom.llm.

Each stage takes all that its predecessor kept and returns the columns of documents; the last returns the tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import langid
from wayloom.llm.bpe import bpe_decode, bpe_encode
from wayloom.llm.common import materialise, read
from wayloom.llm.decontam import decontaminate
from wayloom.llm.linededup import dedup_lines
from wayloom.llm.simhash import near_copies

#: Documents whose language is less certain than this go, with those that have no letter.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows of docs whose language can be told; each row is judged by its own text."""
    net = langid.learn(docs.where(~langid.held_out("doc_id")))
    told = langid.identify(docs, net, whole=True)
    sure = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return told.where(sure).select(*(F.col("doc")[c].alias(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, packed as little-endian unsigned 32-bit integers, and whether they decode back."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    both = bpe_decode(bpe_encode(docs, path, keep=("lang", "source", "n_chars")), path)
    return both.select(
        "doc_id", "lang", "source", "n_chars", "ids",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language ID", language),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: Networks, fingerprints and tokens are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
