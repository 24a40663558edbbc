"""From raw documents to packed training sequences."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seriata.llm import copies, language, packing, pii, toxicity
from seriata.llm.common import doc_crc, table
from seriata.session import settle

FOREIGN = 12.0  # bits per byte, half as much again as bytes take without any model
REMEMBER = 100_000  # words; executors hold the memory of four stages before by then
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``judge`` of ``docs(doc_id, text)``; every other column is put aside, so that no name can clash.

    ``judge`` may add columns to the rows it keeps and change ``text``.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    aside = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)])
    kept = judge(docs.select("doc_id", "text", aside.alias("__rest")))
    back = {c: F.col(f"__rest.c{i}") for i, c in enumerate(rest)}
    return kept.select(*[back.get(c, F.col(c)).alias(c) for c in docs.columns])


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose toxicity reaches the threshold.

    A NULL or empty text is not toxic.  Repeated rows are judged alike and all
    stay or all go; other columns pass through, whatever their names; without
    documents, or without labels, nothing is rejected.
    """
    machine = toxicity.train(docs.where(doc_crc() % 4 != 2), table(spark, sf_dir, "labels"))
    return _judged(docs, lambda d: toxicity.score(d, machine).where(F.col("score") < toxicity.THRESHOLD))


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that are no text in a language.

    Those are NULL, empty, without a letter, or so far from every language that
    its trees code them in more bits than ``FOREIGN``, as random letters or
    another script; prose in a language that is not among them takes 8 to 10.
    Without a language to learn from only a letter is asked for.  Repeated rows
    are judged alike; other columns pass through, whatever their names.
    """
    model = language.train(docs.where(doc_crc() % 5 != 0))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return _judged(docs, lambda d: language.identify(d, model).where(F.col("bits") < FOREIGN))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies.

    Near copies are texts that the fingerprints of ``op1`` link, two bits apart
    at most, found with its trie, and texts whose sets of five words in a row
    are alike, which fingerprints so close mostly miss.  It is the one with the smallest number, of equals the first by text; one
    without a number only if none of its class has any.
    """

    def first(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy("__class").orderBy(F.asc_nulls_last("doc_id"), "text", "__rest")
        known = copies.fingerprint_links(rows)
        ranked = copies.with_class(rows, "__class", known).withColumn("__rank", F.row_number().over(order))
        return ranked.where(F.col("__rank") == 1)

    return _judged(docs, first)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the kind in place of personal data; ``n_chars`` is counted again, NULL texts stay, other columns pass through."""
    field = pii.train(docs)
    clean = _judged(docs, lambda d: pii.redact(d, field))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences; NULL and empty texts, and repeated rows, are documents too."""
    return packing.pack(packing.pieces(docs, TOKENIZER, remember=REMEMBER))


STAGES = [
    ("toxicity", not_toxic),
    ("language", in_a_language),
    ("near duplicates", without_near_duplicates),
    ("personal data", without_personal_data),
    ("packing", packed),
]

ORACLE_SQL = None  # SQL can express none of the stages; tests compare them with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    return docs
