"""Benchmark decontamination: documents that hold windows of benchmark items.

The benchmark is the stated query set. It is read in blocks of bounded size;
each block's windows are broadcast as sorted hashes with the place of their
words in the block's text, and one pass over the documents finds them, so
neither side is shuffled. Each hit is verified word by word. If there are
several blocks, a pass's result is written to the shared folder before the next
block is read, so that one block is in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastra.llm.common import WORD_TABLE, materialize, prepare, words_of

#: Bytes of benchmark text in a broadcast block, which become some five times as many, ten while they are built; a larger benchmark takes more passes.
BLOCK_BYTES = 16_000_000
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _prefix_hashes(hashes: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """For n from 1 to size: the hashes of every n consecutive words, by their words' hashes."""
    acc = hashes.copy()
    for n in range(1, min(size, len(hashes)) + 1):
        if n > 1:
            acc = acc[:-1] * _P + hashes[n - 1 :]
        mixed = (acc ^ (acc >> np.uint64(29))) * _MIX
        yield n, mixed ^ (mixed >> np.uint64(32))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


class Windows:
    """The windows of one length in a block: their hashes in order, where their words are, and whose they are."""

    def __init__(self, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, items: np.ndarray):
        order = np.lexsort((items, hashes))
        self.hashes, first = np.unique(hashes[order], return_index=True)
        self.first = np.append(first, len(order)).astype(np.int32)
        self.starts, self.stops, self.items = (x[order].astype(np.int32) for x in (starts, stops, items))
        bits = max(10, int(8 * len(self.hashes)).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.filter = np.zeros(1 << (bits - 3), np.uint8)  # a bit for each of the hashes' low ends
        low = self.hashes & self.mask
        np.bitwise_or.at(self.filter, low >> np.uint64(3), np.uint8(1) << (low & np.uint64(7)).astype(np.uint8))

    def bytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def candidates(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Positions whose hash is one of the windows', with the range of entries that have it."""
        low = hashes & self.mask
        may = np.flatnonzero((self.filter[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1)
        if len(may):
            at = np.minimum(np.searchsorted(self.hashes, hashes[may]), len(self.hashes) - 1)
            met = self.hashes[at] == hashes[may]
            for i, k in zip(may[met].tolist(), at[met].tolist(), strict=True):
                yield i, int(self.first[k]), int(self.first[k + 1])


class WindowSet:
    """The windows of one block of items.

    A window is ``size`` consecutive words of an item; an item of fewer words,
    but not none, is one window. ``text`` holds the items' words by single
    spaces, for verification.
    """

    def __init__(self, items: list[tuple], size: int):
        self.size, self.names = size, [item for item, _ in items]
        texts, at, found = [], 0, {}
        for k, (_, text) in enumerate(items):
            words = words_of((text or "").encode())
            if not words:
                continue
            n = min(size, len(words))
            hashes = dict(_prefix_hashes(_word_hashes(words), n))[n]
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)  # with the space after
            starts = at + np.concatenate(([0], ends[:-1]))
            found.setdefault(n, []).append((hashes, starts[: len(hashes)], at + ends[n - 1 :] - 1, np.full(len(hashes), k)))
            texts.append(b" ".join(words))
            at += len(texts[-1]) + 1
        self.text = b" ".join(texts)
        self.windows = {n: Windows(*(np.concatenate(x) for x in zip(*parts, strict=True))) for n, parts in sorted(found.items())}

    def bytes(self) -> int:
        return len(self.text) + sum(w.bytes() for w in self.windows.values())

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word spans [start, stop) covered by windows, merged, and the items that they belong to."""
        spans: list[tuple[int, int]] = []
        owners: set[int] = set()
        if self.windows and len(words) >= next(iter(self.windows)):
            told = {}
            for n, hashes in _prefix_hashes(_word_hashes(words), self.size):
                if n not in self.windows:
                    continue
                w = self.windows[n]
                for i, a, b in w.candidates(hashes):
                    own = b" ".join(words[i : i + n])
                    if (n, own) not in told:  # entries of one hash have the same words, but for a chance in 2^64 a pair
                        told[n, own] = {k for k, x, y in zip(w.items[a:b].tolist(), w.starts[a:b].tolist(), w.stops[a:b].tolist(), strict=True) if self.text[x:y] == own}
                        owners |= told[n, own]
                    if told[n, own]:
                        spans.append((i, i + n))
        return merge_spans(spans), {self.names[k] for k in owners}


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def without_words(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the bytes from the first to the last word of each span."""
    flat = np.frombuffer(data.translate(WORD_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], flat.view(np.int8), [0])))
    begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for b, e in spans:
        out.append(data[at : begins[b]])
        at = ends[e - 1]
    return b"".join([*out, data[at:]])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of about as many bytes of text; one block is on the driver at a time, and one at least."""
    own = benchmark.select(benchmark[item_col].alias("item"), benchmark[text_col].alias("text")).filter("text is not null")
    total = own.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = own if n == 1 else own.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield [(r.item, r.text) for r in part.collect()]


def _passes(out: DataFrame, blocks: Iterator[list[tuple]], size: int, one_pass) -> DataFrame:
    """``one_pass`` for each block. A result is written before the next block is read; the last one stays lazy."""
    context, held = out.sparkSession.sparkContext, None
    for block in blocks:
        if held is not None:
            out = materialize(out, "pass")
            held.destroy()
        held = context.broadcast(WindowSet(block, size))
        out = one_pass(out, held)
    return out


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 10,
    block_bytes: int = BLOCK_BYTES,
    clean_text: bool = False,
) -> DataFrame:
    """For each document: n_words, the word spans that occurring windows cover, and the items they belong to.

    Columns: doc_id, n_words, spans (array of start, stop; merged), items
    (array of item ids as strings, sorted); with ``clean_text`` also ``clean``,
    the text without the hit words.

    Null and empty texts have no words and no spans. Items without words have
    no windows. An item of a null id hits, but has no name to be listed by.
    Items that repeat an id are one item. Null ids and repeated rows of
    documents are kept, each row on its own. An empty benchmark hits nothing; no
    documents give no rows. Other columns are ignored. A benchmark beyond
    ``block_bytes`` writes the documents once for each further block.
    """
    prepare(docs.sparkSession)
    out = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    out = out.withColumns({
        "n_words": F.lit(0).cast("long"),
        "spans": F.expr("cast(array() as array<struct<start: long, stop: long>>)"),
        "items": F.expr("cast(array() as array<string>)"),
    })
    out = _passes(out, _blocks(benchmark, item_col, item_text_col, block_bytes), size, _pass)
    cols = ["doc_id", "n_words", "spans", "items"]
    if clean_text:
        out, cols = _cleaned(out), [*cols, "clean"]
    return out.select(*cols)


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _pass(docs: DataFrame, held) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: WindowSet = held.value
        for b in batches:
            counts, spans, items = [], [], []
            texts = b.column("text").cast(pa.binary()).to_pylist()
            for data, was, had in zip(texts, b.column("spans").to_pylist(), b.column("items").to_pylist(), strict=True):
                words = words_of(data or b"")
                hit, own = windows.scan(words)
                if was:
                    hit = merge_spans(hit + [(s["start"], s["stop"]) for s in was])
                counts.append(len(words))
                spans.append([{"start": s, "stop": e} for s, e in hit])
                items.append(sorted({*(str(x) for x in own if x is not None), *had}))
            arrays = [b.column("doc_id"), b.column("text"), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "n_words", "spans", "items"])

    return docs.mapInArrow(run, docs.schema)


def _cleaned(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            spans = b.column("spans").to_pylist()
            clean = [
                without_words(t, [(x["start"], x["stop"]) for x in s]).decode() if t and s else None if t is None else t.decode()
                for t, s in zip(texts, spans, strict=True)
            ]
            names = [*b.schema.names, "clean"]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(clean, pa.string())], names)

    return docs.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, clean string")


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 10, block_bytes: int = BLOCK_BYTES, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without those that hold any window of the benchmark; all columns stay.

    The rows pass through the scan themselves, so that nothing is joined or
    shuffled. Rows with null or empty texts stay, null ids and repeated rows are
    judged by their own text; an empty benchmark removes nothing.
    """
    prepare(docs.sparkSession)

    def one_pass(out: DataFrame, held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows: WindowSet = held.value
            for b in batches:
                texts = b.column(b.schema.names.index(text_col)).cast(pa.binary()).to_pylist()
                keep = [not windows.scan(words_of(t or b""))[0] for t in texts]
                yield b.filter(pa.array(keep, pa.bool_()))

        return out.mapInArrow(run, out.schema)

    return _passes(docs, _blocks(benchmark, item_col, item_text_col, block_bytes), size, one_pass)
