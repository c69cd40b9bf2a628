"""From documents to token ids: language, exact copies, near copies, the mix of sources, pieces.

Each stage takes what its predecessor kept and returns the columns of documents, the last one token ids. Near copies are
documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more; of each group linked so, the smallest
doc_id stays. The mix may hold a document twice, and only some of its words (see pulseforge.llm.mixing.mixed_documents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulseforge.llm import exact_dedup, language_id, mixing, ngram_join, piece_codec
from pulseforge.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with letters whose language is told with a score of 0.5 or more."""
    return language_id.speakable(docs.select(COLUMNS))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs.select(COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs.select(COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, score and others of every document."""
    return piece_codec.encode(docs.select(COLUMNS), ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Language models, random draws and lattices are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
