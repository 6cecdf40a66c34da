"""Packing token sequences by Karmarkar-Karp multiway differencing.

Each document's ids are cut into full windows, which stand alone, and a rest,
which is cut into short pieces. The pieces of a bounded group of documents are
dealt to windows by differencing: every piece starts as a partial partition of
one filled window, and the two partitions of the largest imbalance merge with
opposing order, fullest windows onto emptiest ones. The windows come out nearly
equal; if the fullest exceeds the capacity the window count rises by one and
the group is dealt anew.

All of it runs inside the partition that read the documents: no shuffle, one
pass, and memory for one group of pieces and a bounded cache of words.
"""

from __future__ import annotations

import heapq
import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rastra.llm.common import LOWER_TABLE, prepare

#: Tokens that a group leaves free for each window, so that differencing seldom needs one more.
SLACK = 4
#: Shares of a group's tokens that are cut to pieces of so many tokens, which even out what larger pieces leave.
FINE = ((0.01, 8), (0.06, 64))
#: Words kept in each of the two generations of the word cache.
CACHE_WORDS = 300_000


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Deal items to k windows by the largest differencing method; returns the item numbers of each window.

    A partial partition holds k sums less their least one, in ascending order,
    so that only windows above the least are kept; the rest count as zero.
    """
    if k < 1:
        return []
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    # a partition: (sums ascending, their items); windows that aren't listed are empty
    parts: dict[int, tuple[list[int], list[list[int]]]] = {}
    heap = []
    for n, i in enumerate(order):
        parts[n] = ([sizes[i]], [[i]])
        heap.append((-sizes[i], n))
    heapq.heapify(heap)
    nxt = len(order)
    while len(heap) > 1:
        (_, x), (_, y) = heapq.heappop(heap), heapq.heappop(heap)
        (s, a), (t, b) = parts.pop(x), parts.pop(y)
        free = k - max(len(s), len(t))
        over = min(len(s), len(t)) - free  # so many windows take from both
        if over <= 0:
            sums, items = s + t, a + b
        else:
            # the least `over` of each side meet, the least of one with the largest of these of the other
            sums = [u + v for u, v in zip(s[:over], reversed(t[:over]), strict=True)] + s[over:] + t[over:]
            items = [u + v for u, v in zip(a[:over], reversed(b[:over]), strict=True)] + a[over:] + b[over:]
        rank = sorted(range(len(sums)), key=sums.__getitem__)
        sums, items = [sums[r] for r in rank], [items[r] for r in rank]
        spread = sums[-1] - (sums[0] if len(sums) >= k else 0)
        parts[nxt] = (sums, items)
        heapq.heappush(heap, (-spread, nxt))
        nxt += 1
    out = parts.popitem()[1][1] if parts else []
    return out + [[] for _ in range(k - len(out))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most the capacity; their count rises until each fits."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("a piece exceeds the capacity")
    k = -(-sum(sizes) // capacity)
    while True:
        dealt = difference(sizes, k)
        if max(sum(sizes[i] for i in w) for w in dealt) <= capacity:
            return [w for w in dealt if w]
        k += 1


def split(pieces: list[tuple], tokens: int) -> tuple[list[tuple], list[tuple]]:
    """The pieces (document, start, ids, tokens of the document) of the first so many tokens, and the others; one may be cut."""
    at = 0
    for i, (doc, start, ids, total) in enumerate(pieces):
        n = len(ids) // 4
        if at + n > tokens:
            if at == tokens:
                return pieces[:i], pieces[i:]
            cut = tokens - at
            return [*pieces[:i], (doc, start, ids[: 4 * cut], total)], [(doc, start + cut, ids[4 * cut :], total), *pieces[i + 1 :]]
        at += n
    return list(pieces), []


def graded(pieces: list[tuple], shares: tuple = FINE) -> list[tuple]:
    """The pieces, of which the last ones, of about these shares of the tokens, are cut to smaller ones."""
    kept, cut = list(pieces), []
    tokens = sum(len(p[2]) // 4 for p in pieces)
    for share, size in shares:
        want = int(share * tokens)
        while kept and want > 0:
            doc, start, ids, total = kept.pop()
            want -= len(ids) // 4
            cut += [(doc, start + at, ids[4 * at : 4 * (at + size)], total) for at in range(0, len(ids) // 4, size)]
    return kept + cut


class WordTokenizer:
    """Ids of a text by a tokenizer that never joins what ASCII white space parts.

    Words are looked up in a cache of two generations, which bounds its memory;
    what is missing goes to the tokenizer itself. Texts that could hold a special
    token go to it whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.byte_chars = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}

    def _encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        """Ids of a word that isn't cached. A closing comma or full stop after a letter is a word of its own."""
        if (found := self.old.get(word)) is None:
            end = word[-1:]
            if len(word) > 1 and end in b".," and word[-2:-1].isalpha():  # an ASCII letter
                found = self._cached(word[:-1]) + self._cached(end)
            elif word.isalpha():
                found = array("I", [t.id for t in self.model.tokenize(word.decode())]).tobytes()
            else:
                text = word.decode("utf-8")
                if len(word) > 1 and end in b".," and (c := text[-2]) < "ɐ" and c != "İ" and c.isalpha():
                    found = self._cached(word[:-1]) + self._cached(end)
                elif max(text) < "ɐ" and "İ" not in text and text.isalpha() and unicodedata.is_normalized("NFC", text):
                    raw = text.lower().encode().decode("latin-1").translate(self.byte_chars)
                    found = array("I", [t.id for t in self.model.tokenize(raw)]).tobytes()
                else:
                    found = self._encode(text)
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        self.young[word] = found
        return found

    def _cached(self, word: bytes) -> bytes:
        return self.young.get(word) or self._word(word)

    def ids(self, data: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids of UTF-8 data."""
        if b"<|" in data:
            return self._encode(data.decode("utf-8"))
        words = data.translate(LOWER_TABLE).split()
        found = list(map(self.young.get, words))
        if None in found:
            cached = self._cached
            found = [cached(w) if x is None else x for w, x in zip(words, found, strict=True)]
        return b"".join(found)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One for each worker process and file."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _schema(id_type: str) -> str:
    return f"doc_id {id_type}, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 1,
    piece: int = 512,
    group: int = 1024,
    slack: int = SLACK,
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens; returns the pieces.

    A document is its text's ids and then ``end_id``. Its full windows become
    sequences at once. The rest is cut into pieces of at most ``piece`` tokens;
    each ``group`` of pieces is dealt to near-equal windows (see ``windows``).
    A group is cut to some number of whole windows less ``slack`` tokens each,
    and what is over goes on in the next group; a part of its pieces is cut
    smaller (see ``graded``). A partition's last group has what is left.

    Columns: doc_id, start (ids of its document before it), length, token_ids
    (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset (in the
    sequence, without gaps from 0). Sequence ids are unique but not dense.

    Null and empty texts are documents of the closing id alone. Null ids and
    repeated rows are kept, each row as a document of its own. Words go to the
    tokenizer as they are, however long. An empty table gives no rows. Other
    columns are ignored.
    """
    prepare(docs.sparkSession)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    id_type = own.schema["doc_id"].dataType
    schema = _schema(id_type.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, end = tokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        seq = (TaskContext.get().partitionId() << 33) - 1
        kind, names = None, ["doc_id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"]
        out: list[tuple] = []
        rest: list[tuple] = []
        held = 0  # tokens of the rest

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        def emit(w: list[tuple]) -> None:
            nonlocal seq
            seq, at = seq + 1, 0
            for doc, start, ids, total in w:
                out.append((doc, start, len(ids) // 4, ids, total, seq, at))
                at += len(ids) // 4

        def deal(last: bool = False) -> None:
            tokens = sum(len(r[2]) // 4 for r in rest)
            now, rest[:] = split(rest, tokens if last else tokens // capacity * (capacity - slack))
            now = graded(now)
            for w in windows([len(r[2]) // 4 for r in now], capacity):
                emit([now[i] for i in sorted(w)])

        for b in batches:
            kind = b.schema.field("doc_id").type
            for doc, data in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                ids = tok.ids(data or b"") + end
                total = len(ids) // 4
                full = total - total % capacity
                for start in range(0, full, capacity):
                    seq += 1
                    out.append((doc, start, capacity, ids[4 * start : 4 * (start + capacity)], total, seq, 0))
                for start in range(full, total, piece):
                    stop = min(start + piece, total)
                    rest.append((doc, start, ids[4 * start : 4 * stop], total))
                held += total - full
                if len(rest) >= group and held >= 2 * capacity:
                    deal()
                    held = sum(len(r[2]) // 4 for r in rest)
                if len(out) >= 2000:
                    yield batch()
        deal(last=True)
        if out:
            yield batch()

    return own.mapInArrow(run, schema)
