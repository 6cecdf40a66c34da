"""N-gram Jaccard join by MinHash banding.

1. Every text becomes its set of hashed word n-grams. Rows of equal sets form a
   class; classes, not ids, are what is compared, so that two texts under one id
   stay apart.
2. A class has 32 bands of 6 MinHash rows. At a similarity of 0.8 two sets meet
   in a band with probability 1 - (1 - 0.8^6)^32 = 0.99994; at 0.3, with 0.023.
   Band hashes are shuffled alone, without the sets.
3. Classes that share band buckets are dealt to groups, the components of these
   ties, and a group to chunks of bounded rows and bytes. Most groups are one
   chunk. Two chunks meet in a block only through members that share a bucket
   with the other side, so a group that is long but thin makes few comparisons.
4. Only candidates' n-gram sets are made again. Each block is a task's work by
   itself; pairs become counts inside it and are never rows.
5. Links make the final components.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastra.llm.common import join_hot, materialize, prepare, unused, words_of
from rastra.llm.components import connected_components

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)
BANDS, ROWS = 32, 6
#: Members of a chunk, and bytes of their n-gram sets, on average; a block holds two chunks at most.
BLOCK_ROWS, BLOCK_BYTES = 256, 16 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _Q
    return x ^ (x >> np.uint64(29))


def ngram_set(data: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; fewer words than n, but not none, are one n-gram."""
    words = words_of(data)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    m = len(h) - k + 1
    acc = h[:m].copy()
    for j in range(1, k):
        acc = acc * _P + h[j : j + m]
    return np.unique(_mix(acc + np.uint64(k)))


def digest_of(grams: np.ndarray) -> bytes:
    """A set's 128-bit digest."""
    return xxhash.xxh128_digest(grams.tobytes())


class Bander:
    """Band hashes of n-gram sets; the coefficients follow from a seed."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(grams), 256):
            np.minimum(least, (grams[i : i + 256, None] * self.a + self.b).min(axis=0), out=least)
        rows = least.reshape(self.bands, self.rows)
        acc = np.arange(1, self.bands + 1, dtype=np.uint64) * _Q
        for j in range(self.rows):
            acc = _mix(acc * _P + rows[:, j])
        return acc.view(np.int64)


def _text_hash(text: Column) -> Column:
    """Tells the texts under one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, its text's hash, the set's 128-bit digest (d1, d2), its size and its band hashes; no bands for an empty set."""
    schema = "doc_id long, th long, d1 long, d2 long, n_grams long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bander = Bander(bands, rows)
        for b in batches:
            digests, sizes, hashes, ends = [], [], [], [0]
            for data in b.column("text").cast(pa.binary()).to_pylist():
                grams = ngram_set(data or b"", n)
                digests.append(digest_of(grams))
                sizes.append(len(grams))
                if len(grams):
                    hashes.append(bander(grams))
                ends.append(len(hashes) * bands)
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            flat = np.concatenate(hashes) if hashes else np.empty(0, np.int64)
            bands_col = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            arrays = [b.column("doc_id"), b.column("th"), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(sizes, pa.int64()), bands_col]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "th", "d1", "d2", "n_grams", "bands"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, schema)


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set."""
    n, m = len(left), len(right)
    grams = np.concatenate([*left, *right])
    rows = np.repeat(np.arange(n + m), [len(x) for x in (*left, *right)])
    order = np.argsort(grams, kind="stable")
    grams, rows = grams[order], rows[order]
    new = np.concatenate(([True], grams[1:] != grams[:-1])) if len(grams) else np.empty(0, bool)
    col = np.cumsum(new) - 1
    often = np.bincount(col)[col] > 1 if len(col) else np.empty(0, bool)
    rows, col = rows[often], col[often]
    if len(col):
        col = np.cumsum(np.concatenate(([0], (col[1:] != col[:-1]).astype(np.int64))))
    out = np.zeros((n, m))
    width = max(64, min(4096, 8_000_000 // (n + m)))
    for k in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [k, k + width])
        used = np.zeros((n + m, width), np.float32)
        used[rows[lo:hi], col[lo:hi] - k] = 1
        out += used[:n] @ used[n:].T
    return out.astype(np.int64)


def compare_block(keys: np.ndarray, sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, across: bool, similar: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """For each class of a block: how many rows linked classes have, and the least key that links lead to.

    ``side`` is 0 or 1; in a block ``across`` two chunks only pairs of different
    sides count, since those within a side belong to its own block.
    """
    li = np.flatnonzero(side == 0) if across else np.arange(len(keys))
    ri = np.flatnonzero(side == 1) if across else li
    left, right = [sets[i] for i in li], [sets[i] for i in ri]
    both = intersections(left, right)
    sizes = np.array([[len(x)] for x in left]) + np.array([len(x) for x in right])
    linked = (both * (similar.numerator + similar.denominator) >= similar.numerator * sizes) & (both > 0)
    if not across:
        np.fill_diagonal(linked, False)
    links, root = np.zeros(len(keys), np.int64), keys.copy()
    links[li] += linked @ copies[ri]
    if across:
        links[ri] += linked.T @ copies[li]
    top = np.iinfo(np.int64).max
    while True:
        was = root.copy()
        root[li] = np.minimum(root[li], np.where(linked, root[ri][None, :], top).min(axis=1))
        root[ri] = np.minimum(root[ri], np.where(linked, root[li][:, None], top).min(axis=0))
        if (was == root).all():
            return links, root


def _blocks_of(banded: DataFrame, hubs: DataFrame, classes: DataFrame, total: int, block_rows: int, block_bytes: int) -> DataFrame:
    """The blocks each candidate class goes to: key, grp, bi, bj and its side in them.

    A class meets its own chunk, and of its group's other chunks those with
    which it shares a bucket.
    """
    met = materialize(join_hot(banded, hubs, ["band"], "met", total), "met")
    groups = connected_components(met.select(F.col("key").alias("u"), F.col("hub").alias("v")))
    groups = groups.select(F.col("node").alias("key"), F.col("label").alias("grp")).join(classes.select("key", "n_grams"), "key")
    sizes = groups.groupBy("grp").agg(F.count("*").alias("members"), (F.sum("n_grams") * 8).alias("bytes"))
    sizes = sizes.withColumn("chunks", F.greatest(F.ceil(F.col("members") / block_rows), F.ceil(F.col("bytes") / block_bytes)).cast("long"))
    dealt = join_hot(groups, sizes, ["grp"], "members", total).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")))
    dealt = materialize(dealt.select("key", "grp", "chunk", "chunks"), "dealt")
    own = dealt.select("key", "grp", F.col("chunk").alias("bi"), F.col("chunk").alias("bj"), F.lit(0).alias("side"))
    # buckets of groups of several chunks: (band, chunk) pairs are fewer than members, and each is work for a block
    wide = dealt.filter("chunks > 1").drop("chunks")
    there = join_hot(met.select("key", "band"), wide.withColumn("one", F.lit(1)), ["key"], "one", total).select("key", "band", "grp", "chunk")
    there = materialize(there, "there")
    seen = there.groupBy("band", "chunk").agg(F.count("*").alias("n"))
    listed = seen.groupBy("band").agg(F.collect_set("chunk").alias("others"), F.sum("n").alias("n")).filter(F.size("others") > 1)
    across = join_hot(there, listed, ["band"], "n", total).select("key", "grp", "chunk", F.explode("others").alias("other")).filter("chunk <> other").distinct()
    return own.unionByName(
        across.select("key", "grp", F.least("chunk", "other").alias("bi"), F.greatest("chunk", "other").alias("bj"), (F.col("chunk") > F.col("other")).cast("int").alias("side"))
    )


def _told(docs: DataFrame, n: int, similarity: str, bands: int, rows: int, block_rows: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and each class's digest, key, number of rows, least row (doc_id and text hash), label and links.

    ``docs`` has doc_id, text and the text's hash, th. Keys are numbers of this
    run; they are written with the classes, so that all later steps see the same.
    """
    similar = Fraction(similarity)
    signed = materialize(signatures(docs, n, bands, rows), "signed")
    named = signed.filter("n_grams > 0 and doc_id is not null")
    classes = named.groupBy("d1", "d2").agg(
        F.min(F.struct("doc_id", "th")).alias("least"), F.count("*").alias("copies"), F.max("n_grams").alias("n_grams"), F.first("bands").alias("bands")
    )
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("key"), "d1", "d2", "least.doc_id", "least.th", "copies", "n_grams", "bands"), "classes")
    banded = classes.select("key", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("key").alias("hub"), F.count("*").alias("met")).filter("met > 1")
    blocks = materialize(_blocks_of(banded, hubs, classes, signed.count() * bands, block_rows, block_bytes), "blocks")

    picked = blocks.select("key").distinct().join(classes.select("key", "doc_id", "th", "copies", "d1", "d2"), "key")
    texts = docs.filter("doc_id is not null").groupBy("doc_id", "th").agg(F.first("text").alias("text")).join(picked, ["doc_id", "th"])
    found = (
        _sets(texts, n).join(blocks, "key").groupBy("grp", "bi", "bj").applyInArrow(_block_runner(similar), "key long, links long, root long")
    )
    found = materialize(found, "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    ends = connected_components(found.filter("key <> root").select(F.col("key").alias("u"), F.col("root").alias("v")))
    told = classes.drop("bands").join(links, "key", "left").join(ends.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = told.groupBy("label").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.count("*").alias("members"))
    told = join_hot(told, least, ["label"], "members", signed.count()).drop("members")
    return signed, materialize(told, "told")


def join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = 5,
    similarity: str = "0.8",
    bands: int = BANDS,
    rows: int = ROWS,
    block_rows: int = BLOCK_ROWS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each row with its similarity class and its number of links.

    Columns: doc_id; class_id, the least id among the rows that links connect,
    itself included; copy_id, the least id among rows of an equal n-gram set;
    n_links, the number of other rows with a Jaccard similarity of word n-grams
    of at least ``similarity``, copies included. Ids must be integers.

    Words are lower-cased runs of digits, letters and non-ASCII characters. A
    text of fewer than n words is one n-gram. Null and empty texts, or texts
    without words, have no links and are their own class. Rows are the units:
    rows of one id may have different texts, each with classes and links of its
    own, and a repeated row is a copy. Rows of null ids are returned with null
    classes and no links. An empty table gives no rows. Other columns are
    ignored.
    """
    prepare(docs.sparkSession)
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).withColumn("th", _text_hash(F.col("text")))
    signed, told = _told(own, n, similarity, bands, rows, block_rows, block_bytes)
    told = told.select(
        "d1", "d2", "copies", F.col("doc_id").alias("copy_id"), F.col("first.doc_id").alias("class_id"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    named = signed.filter("n_grams > 0 and doc_id is not null").select("doc_id", "d1", "d2")
    in_class = join_hot(named, told, ["d1", "d2"], "copies", signed.count())
    alone = signed.filter("n_grams = 0 or doc_id is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links")
    )
    return in_class.select("doc_id", "class_id", "copy_id", "n_links").unionByName(alone)


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """The candidates' n-gram sets as sorted little-endian unsigned 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [ngram_set(x or b"", n) for x in b.column("text").cast(pa.binary()).to_pylist()]
            halves = np.frombuffer(b"".join(map(digest_of, sets)), np.int64).reshape(-1, 2)
            same = (halves[:, 0] == b.column("d1").to_numpy()) & (halves[:, 1] == b.column("d2").to_numpy())
            if not same.all():
                raise ValueError("a text was not the same when it was read again")
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("copies"), pa.array([x.tobytes() for x in sets], pa.binary())], ["key", "copies", "grams"])

    return texts.select("key", "copies", "d1", "d2", "text").mapInArrow(run, "key long, copies long, grams binary")


def _block_runner(similar: Fraction):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        keys, copies, side = (table.column(c).to_numpy() for c in ("key", "copies", "side"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
        across = table.column("bi")[0].as_py() != table.column("bj")[0].as_py()
        if len(keys) < 2 or across and len(set(side.tolist())) < 2:
            links, root = np.zeros(len(keys), np.int64), keys
        else:
            links, root = compare_block(keys, sets, copies, side, across, similar)
        some = links > 0
        return pa.table({"key": keys[some], "links": links[some], "root": root[some]})

    return run


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents, but of each similarity class only one row, that of the least id; all columns stay.

    Rows are dropped, not ids: a row goes only if its own text is linked to the
    row that stays. Rows of one id and different, unlinked texts all stay. Of
    rows of the least id within a class, those of the least text hash stay, and
    of equal ones in id and text the one whose columns hash least. Rows of null
    ids, and null or wordless texts, stay. An empty table stays empty. Ids must
    be integers.
    """
    spark = docs.sparkSession
    prepare(spark)
    i, t = unused(docs, "id", "th")
    keyed = docs.withColumns({i: docs[id_col].cast("long"), t: _text_hash(docs[text_col])})
    own = keyed.select(F.col(i).alias("doc_id"), F.col(t).alias("th"), docs[text_col].alias("text"))
    options = {"n": 5, "similarity": "0.8", "bands": BANDS, "rows": ROWS, "block_rows": BLOCK_ROWS, "block_bytes": BLOCK_BYTES} | options
    signed, told = _told(own, **options)
    named = signed.filter("n_grams > 0 and doc_id is not null").groupBy("doc_id", "th", "d1", "d2").agg(F.count("*").alias("met"))
    firsts = told.filter((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.th") == F.col("th"))).select("doc_id", "th", F.lit(True).alias("stays"))
    fate = named.join(firsts, ["doc_id", "th"], "left").filter("stays is null or met > 1")
    fate = materialize(fate.select(F.col("doc_id").alias(i), F.col("th").alias(t), F.coalesce("stays", F.lit(False)).alias("once")), "fate")
    kept = keyed.join(fate, [i, t], "left_anti").select(*docs.columns)
    if not fate.filter("once").limit(1).count():
        return kept
    repeated = keyed.join(fate.filter("once").select(i, t), [i, t], "left_semi")
    one = repeated.groupBy(i, t).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("row"))
    return kept.unionByName(one.select("row.*"))
