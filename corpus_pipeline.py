"""A corpus made ready for training: documents in, packed token sequences out.

Each stage takes what the one before kept. The stages are operators of ``emberframe.llm``; all but the last return the
columns of ``documents``.
"""

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession

from emberframe.llm.common import stored, table
from emberframe.llm.jaccard_join import without_near_copies
from emberframe.llm.line_dedup import without_repeated_lines
from emberframe.llm.packing import packed, word_encoder
from emberframe.llm.secrets import without_secrets
from emberframe.llm.toxicity import without_toxic

VOCABULARY, END_ID = "word_bpe_49k.json", 2


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go. The labels are those of the table, the texts to learn from those of ``docs``."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier, or within three edits of it, go; so do documents that lose all their lines."""
    return without_repeated_lines(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return without_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return without_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences of 4096 ids."""
    return packed(docs, word_encoder(vocabularies.path(VOCABULARY)), END_ID)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL can express neither the learnt filter nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
