"""The corpus pipeline: documents in, token ids of the chosen ones out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm import langid, linededup, mixing, overlap, sentencepieces, simhash
from cellweave.llm.common import fresh, maybe_among, stage, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: those without a letter, and those far less alike to every language
    than what the profiles were fitted on, all rows of the training folds. lang becomes the language that was told,
    which the mixing goes by."""
    rows = langid.training_rows(docs)
    profiles = langid.fit_profiles(rows, per_lang=None)
    return langid.keep_identified(docs, profiles, least=langid.least_likeness(rows, profiles))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in repeats of three-line windows go; n_chars follows the text."""
    return linededup.dedup_lines(docs, n_chars_col="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Links are op4's rule (three-word shingles, 3 of 64 bits) and a similarity of 0.8 or more of five-word shingles;
    a group is what links of either kind connect. Rows without an id stay.
    """
    classes = stage(simhash.near_duplicates(docs), "copies")
    gone = stage(overlap.later_ids(docs, classes=classes), "near-copies")
    # texts that can't be among those need no shuffle to stay
    own, maybe = fresh(docs, "gone", "maybe_gone")
    told = maybe_among(docs, "doc_id", gone, maybe)
    doubt = told.where(maybe).drop(maybe)
    return told.where(~F.col(maybe)).drop(maybe).union(doubt.join(gone.withColumnRenamed("doc_id", own), F.col("doc_id") == F.col(own), "left_anti"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics come near their target shares."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with a check that they decode to its text."""
    return sentencepieces.encode_texts(docs, sentencepieces.Codec())


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("near-duplicate removal", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("SentencePiece encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints and segmentations are beyond SQL; tests/llm/test_pipeline.py holds a brute-force version against run().
ORACLE_SQL = None
