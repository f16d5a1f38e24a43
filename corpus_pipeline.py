"""A corpus pipeline: each stage works on all documents that its predecessor kept, and its decisions take effect.

Every stage takes (spark, docs, sf_dir), docs with the columns of `documents` (doc_id, text, lang, source, n_chars) and any others, and
returns all of them as they came, but for the last, which returns the encoded texts. A row is a document of its own, whether or
not its doc_id is null or occurs again. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import decontamination, languages, near_dups, secrets, tokens
from barline.llm._spark import written


def _aside(docs: DataFrame, own: set[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with all other columns than these under names that no operator uses, and what takes them back to docs' columns."""
    names = {c: c if c in own else f"column {k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select([F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return renamed, lambda made: made.select([F.col(f"`{n}`").alias(c) for c, n in names.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a recognised language; those without letters (`und`) go.

    Null and empty texts have no letters and go; so does everything if no row has a label. Repeated rows share their fate. Ties between languages go to the
    first by name. Very long texts are read whole.
    """
    model = languages.train(docs.where(F.col("lang").isNotNull() & F.coalesce(~languages.held_out(), F.lit(True))).select("doc_id", "text", "lang"))
    held, back = _aside(docs, {"text"})
    return back(languages.identify(held, model).where("lang_pred <> 'und'"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest doc_id.

    Rows of one doc_id, or of none, are told apart by their texts: of repeated rows one stays. Null and empty texts are like nothing and stay.
    """
    return near_dups.distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold half of a benchmark item or more, or thirteen of its tokens in a row.

    Null and empty texts hold nothing and stay. Rows of one doc_id with different texts are judged each by its own. An empty benchmark drops nothing.
    """
    row = F.xxhash64("doc_id", "text")
    found = decontamination.contaminated(docs.select(row.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.select(F.col("doc_id").alias("contaminated row")).distinct()
    return docs.join(gone, row == F.col("contaminated row"), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and replaces each secret in its text; n_chars follows the text.

    Null texts stay null, empty ones empty. Repeated rows are masked alike.
    """
    held, back = _aside(docs, {"doc_id", "text", "n_chars"})
    found = secrets.scan(held)
    changed = {"text": F.col("masked"), "n_chars": F.when(F.size("secrets") > 0, F.char_length("masked").cast("long")).otherwise(F.col("n_chars"))}
    return back(found.withColumns({k: v for k, v in changed.items() if k in docs.columns}))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each text, a row for each row. Null and empty texts have no ids."""
    coded = tokens.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("secret scan", mask_secrets),
    ("BPE encoding", encode),
]

#: Language models, Markov models and BPE are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again as the next one's docs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k + 1}")
    return docs
