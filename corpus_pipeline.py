"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. quality classifier: documents scored below 0.3 go;
2. line dedup: lines whose key occurs in 10 documents or more go, in every document;
3. n-gram Jaccard join: of each component of five-word shingle sets with a similarity
   of 0.8 or more, the document with the smallest id stays;
4. mixing: documents are repeated and cut so that the sources' words meet their targets;
5. SentencePiece: the ids of every text that is left. Encoding only: nothing is decoded
   here, and no column says whether the ids give the text back (``op6`` does that).

Each stage takes (spark, docs, sf_dir), works on all of ``docs``, and but for the last
returns the columns of ``documents``. Fitting uses labels of the training fold only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replysift.llm import gbt_quality, line_dedup, mixing, partenum_join, sentencepiece_backend
from replysift.llm.common import read_table, stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
QUALITY_CUT = 0.3


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; ``n_chars`` follows the text."""
    known = df.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long"))
    return known.select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier scores at ``QUALITY_CUT`` or more."""
    trees = gbt_quality.fit_quality(docs, read_table(spark, sf_dir, "labels"), gbt_quality.usable_fold())
    scored = gbt_quality.score_quality(docs.select(*COLUMNS), trees, score_col="__score")
    return _documents(scored.where(F.col("__score") >= QUALITY_CUT))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents share; documents stay, if empty."""
    return _documents(line_dedup.dedup_lines(docs.select(*COLUMNS), min_docs=10))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return _documents(partenum_join.one_of_each(docs.select(*COLUMNS), n=5, num=80, den=100))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: repeated, left out, or cut at the ends of an arc."""
    return _documents(mixing.mixed_documents(mixing.mix_sources(mixing.sized(docs.select(*COLUMNS)))))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, packed (two bytes each, little-endian)."""
    import public_tokenizers

    encoded = sentencepiece_backend.encode_texts(docs.select(*COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))
    return encoded.select("doc_id", "source", "n_tokens", "ids")


STAGES = [
    ("quality_classifier", quality),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: The classifier, the join and the encoder can't be written in SQL; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every result but the last is stored and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
