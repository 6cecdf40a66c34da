"""A training corpus from the documents: toxicity filter, one of each group of near copies, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet in the shared folder and the next stage reads that. All stages
but the last return the columns of documents, whatever columns these are; extra
ones stay, and their names may clash with none that the stages use.

Null and empty texts pass all filters, and each is a piece of its closing id in
the last stage. Rows of null ids are kept unless their own text is toxic or
holds a benchmark item. A row that is there several times is one row after the
n-gram join if it has words. No documents, labels or benchmark items are
tables like others: nothing comes out, the fixed insults alone are judged by,
and nothing is removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rastra.llm import decontaminate, ngram_join, packing, toxicity
from rastra.llm.common import materialize
from rastra.llm.queries import held_out, table, word_tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator scores under 0.3, judged row by row; ties and repeats have equal scores."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn_from=~held_out(4))
    return toxicity.keep_below(docs, model, 0.3)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of the n-gram Jaccard join, one row: the document of the least id (see ngram_join.one_of_each)."""
    return ngram_join.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their token ids; every row is a document of its own."""
    return packing.pack(docs, word_tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL can express neither boosted trees nor packing; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
