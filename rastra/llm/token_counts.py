"""Delta-maintained token counts by source, language and tokenizer version.

A batch holds signed rows: inserts (+), deletes (-) and revised counts (the new
less the old). Its sums are added to the totals; the new totals and the list of
applied batches are committed together as the next version, so that a batch
that is delivered again changes nothing. Only one batch's rows are read, never
those of earlier ones.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastra.llm.common import materialize, prepare
from rastra.llm.versions import Versions

KEYS = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Patterns of a token by tokenizer version.
PATTERNS = {
    "space-words-1": r"[^\x09-\x0D\x20]+",
    "letter-words-1": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+",
}


def pattern_count(text: Column, tokenizer: str) -> Column:
    """Tokens of a text by a pattern; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERNS[tokenizer])), F.lit(0)).cast("long")


def _counter(path: str):
    """A function from UTF-8 data to its number of ids, by a tokenizer file: word BPE (.json) or ranks of byte BPE (.tiktoken)."""
    if path.endswith(".json"):
        from rastra.llm.packing import tokenizer

        tok = tokenizer(path)
        return lambda data: len(tok.ids(data)) // 4
    encoding = _encoding(path)
    return lambda data: len(encoding.encode_ordinary(data.decode("utf-8")))


@cache
def _encoding(path: str):
    """One for each worker process and file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def with_counts(docs: DataFrame, tokenizers: dict[str, str], text_col: str = "text") -> DataFrame:
    """The table with, in place of the text, its number of tokens by each tokenizer: a column's name and a file.

    Files are word BPE whose words white space parts (see packing.WordTokenizer)
    or ranks of byte BPE. Null and empty texts have no tokens; each row is
    counted by itself, and all other columns stay as they are.
    """
    prepare(docs.sparkSession)
    kept = [f for f in docs.schema if f.name != text_col]
    schema = T.StructType([*kept, *(T.StructField(name, T.LongType()) for name in tokenizers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = [_counter(path) for path in tokenizers.values()]
        for b in batches:
            at = b.schema.names.index(text_col)
            texts = [x or b"" for x in b.column(at).cast(pa.binary()).to_pylist()]
            counts = [pa.array(np.array([count(x) for x in texts], np.int64)) for count in counters]
            own = [c for k, c in enumerate(b.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*own, *counts], [f.name for f in schema])

    return docs.mapInArrow(run, schema)


def signed(rows: DataFrame, tokenizer: str, docs: int, tokens: Column) -> DataFrame:
    """Delta rows: ``docs`` is 1 for inserts, -1 for deletes, 0 for revised counts; ``tokens`` is added.

    Null counts are none. Null sources and languages are values of their own.
    Each row counts, repeats too; other columns are ignored.
    """
    tokens = F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))
    return rows.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(docs).cast("long").alias("n_docs"), tokens.alias("n_tokens"))


def inserts(rows: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    return signed(rows, tokenizer, 1, tokens)


def deletes(rows: DataFrame, tokenizer: str, tokens: Column) -> DataFrame:
    return signed(rows, tokenizer, -1, -tokens)


def revisions(rows: DataFrame, tokenizer: str, old: Column, new: Column) -> DataFrame:
    return signed(rows, tokenizer, 0, new - old)


class TokenCounts:
    """Totals at a root folder that all executors share.

    Null sources and languages are groups of their own. A batch without rows is
    recorded and changes nothing else. Groups whose documents have all been
    deleted leave the totals.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.versions = spark, Versions(spark, root)

    def totals(self, version: int | None = None) -> DataFrame:
        version = self.versions.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], TOTALS)
        return self.spark.read.schema(TOTALS).parquet(f"{self.versions.at(version)}/totals")

    def batches(self, version: int | None = None) -> DataFrame:
        """Ids of the applied batches."""
        version = self.versions.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], "batch_id string")
        return self.spark.read.schema("batch_id string").parquet(f"{self.versions.at(version)}/batches")

    def apply(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch's deltas to the totals, unless it was applied before; tells whether it was added."""
        added = True
        sums = lambda d: d.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        own = materialize(sums(deltas), "deltas")

        def write(last: int, staged: str) -> None:
            nonlocal added
            added = not self.batches(last).filter(F.col("batch_id") == batch_id).limit(1).count()
            new = sums(self.totals(last).unionByName(own)) if added else self.totals(last)
            new.filter("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{staged}/totals")
            one = self.spark.createDataFrame([(batch_id,)] * added, "batch_id string")
            self.batches(last).unionByName(one).coalesce(1).write.parquet(f"{staged}/batches")

        if self.batches().filter(F.col("batch_id") == batch_id).limit(1).count():
            return False
        self.versions.update(write)
        return added
