"""The registered queries of this subpackage and their SQL, each over its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.llm.sample import id_crc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The folder of public tokenizer files; None asks the package that ships them.
TOKENIZERS = os.environ.get("TOKENIZER_FOLDER")


def tokenizer_file(name: str) -> str:
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passageworks.llm import sentencepiece_codec as sp

    pieces = sp.Pieces.read(tokenizer_file("piece_bpe_32k.model"))
    return sp.encoded(table(spark, sf_dir, "documents"), pieces, sp.DIGEST, sp.digest)


OP7_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[]
      WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
  FROM words),
each AS (SELECT doc_id, unnest(s) AS t FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM each a JOIN each b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * k >= 80 * (len(x.s) + len(y.s) - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sets
  UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.r = ways.a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, min(r) AS component_id
FROM sets JOIN reach USING (doc_id) GROUP BY doc_id, s
"""


@query("op7_ngram_jaccard_join", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passageworks.llm.jaccard_join import similar_documents

    return similar_documents(table(spark, sf_dir, "documents"), percent=80, size=5)


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passageworks.llm import toxicity as tox

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(id_crc() % 4 == 2, F.lit(False))
    model = tox.train(docs, labels, ~held_out)
    return tox.toxicity(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passageworks.llm.secret_scan import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


@query("op10_source_mix")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passageworks.llm.source_mix import plan_mix, taken_words

    docs = table(spark, sf_dir, "documents")
    return taken_words(docs, plan_mix(docs))


@query("op6_line_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passageworks.llm import line_quality as lq

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(id_crc() % 5 == 0, F.lit(False))
    model = lq.train(docs, labels, ~held_out)
    return lq.quality(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


OP8_SQL = """
WITH RECURSIVE r AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM r a JOIN r b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id),
counted AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM least LEFT JOIN counted USING (vec_id)
"""


@query("op8_cap_filters", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passageworks.llm.cap_filters import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


@query("op3_p_stable")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passageworks.llm.p_stable import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op4_backoff_lm")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passageworks.llm.backoff_lm import document_scores

    return document_scores(table(spark, sf_dir, "documents"), order=3, own_order=2)


@query("op5_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from passageworks.llm import section_tokens as st

    ranks = st.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents")
    return st.token_counts(docs, ranks, public_tokenizers.PATTERN, ("source", "lang", "text"), "most")


@query("op13_pii_boosting")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passageworks.llm.pii_boosting import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
i AS (
  SELECT item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM benchmark),
size AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d),
tf AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS t FROM d) GROUP BY ALL),
weight AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, size GROUP BY t, n_docs),
norm AS (SELECT doc_id, 50 + (50 * len(t) * n_docs) // n_terms AS m FROM d, size WHERE len(t) > 0),
asked AS (SELECT item_id, unnest(t) AS t FROM i),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN weight USING (t) JOIN norm USING (doc_id) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""


@query("op12_fp_search", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passageworks.llm.fp_search import ranked_documents

    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         list_sum([t[1] * t[2] FOR t IN list_zip(a.q, r.q)])::BIGINT AS score
  FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op11_hilbert_negatives", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from passageworks.llm.hilbert_negatives import hard_negatives

    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 100 == 0, positives=5, k=10, window=(30, 90))
