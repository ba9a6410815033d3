"""A corpus made ready for training: five stages over ``documents``, each one of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's input. All but the last return the columns of ``documents``. Null and empty
texts are clean, alone in their group, free of secrets and of size 0; an empty table stays empty.
Stages keep the session's Arrow batches small, as they share their executors with each other's workers.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.llm import jaccard_join, secret_scan, source_mix, toxicity
from passageworks.llm import queries as q
from passageworks.llm import sentencepiece_codec as sp
from passageworks.llm.sample import id_crc
from passageworks.llm.store import small_batches, written

MOST_SENT = 1 << 20  # ids (8 MB) up to which a list of documents is sent to the tasks


def _sent(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= MOST_SENT else ids


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows of three folds."""
    held_out = F.coalesce(id_crc() % 4 == 2, F.lit(False))
    model = toxicity.train(docs, q.table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.keep_clean(docs, model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that similarity connects, the one of least id stays.

    A row that repeats an id goes too. What leaves is the smaller part, so the texts that stay
    are only filtered, not shuffled, as long as the ids that leave are few enough to be sent.
    """
    found = written(jaccard_join.similar_documents(docs), "components")
    gone = written(found.where("component_id <> doc_id").select("doc_id").distinct(), "gone")
    again = found.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1")
    again = written(again.select("doc_id"), "again")
    kept = docs.join(_sent(gone), "doc_id", "left_anti").join(_sent(again), "doc_id", "left_anti")
    repeated = docs.join(_sent(again), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(docs.columns).union(repeated.select(docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret becomes a mark; all documents stay."""
    return secret_scan.without_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix, as often as it takes them, in its order."""
    mix = source_mix.mixed(docs, source_mix.plan_mix(docs))
    return mix.toDF(*docs.columns, "_shard").drop("_shard")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as SentencePiece ids with an end id, and the text that they decode to, as hashes."""
    pieces = sp.Pieces.read(q.tokenizer_file("piece_bpe_32k.model"))
    return sp.encoded(docs, pieces, sp.DIGEST, sp.digest, keep=("doc_id", "source"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _bounded(stage: Stage) -> Stage:
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _bounded(drop_toxic)),
    ("ngram_jaccard_join", _bounded(one_of_each_group)),
    ("secret_scan", _bounded(mask_secrets)),
    ("source_mix", _bounded(mix_sources)),
    ("sentencepiece", _bounded(encode_pieces)),
]

# A trained classifier and a tokenizer cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = q.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
