"""Language-model scores by a hidden Markov model over words.

Tokens are the runs of characters between ASCII white space, lower-cased in
A-Z, and one end token. States emit each word of the training texts by itself.
One count in each of 256 classes (the last three bytes, hashed) is left for
words that training hasn't seen. The model is therefore a distribution over all
texts.

Training: token counts are aggregated over the whole corpus; the texts become
ids once, in a table in the shared folder, in blocks of bounded size. Each
Baum-Welch round runs the scaled forward and backward recursions over all
training texts. Expected counts of the most frequent words are summed to one row
for each, which the driver gets and broadcasts. Those of all other words are
kept in a distributed table, dealt by the word's 64-bit hash: a block sends its
words' counts there and gets their sums back, so that nothing that grows with
the vocabulary is broadcast. These sums are kept to a thousandth of an octave,
and the model's emissions are shares of the sums as kept, so they add up to one. The
states start as the parts of a mixture of unigrams, whose steps read all
training texts too, from parts that lean to words at random.

Scoring: the scaled forward recursion in double precision. For the unigrams,
counts of words beyond the broadcast head come by a join on the word.
"""

from __future__ import annotations

import ctypes
import zlib
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rastra.llm.common import LOWER_TABLE, delete_path, materialize, prepare, scratch

#: No word holds a space.
END = b" "
CLASSES, SUFFIX = 256, 3
#: Words whose counts are broadcast, and those of them whose emissions are; the others' are in a distributed table.
HEAD_WORDS, MODEL_WORDS = 150_000, 32_000
STATES, ROUNDS = 8, 3
#: Steps of the mixture that the states start from, how far its first parts lean to words (a factor's logarithm), and
#: the most frequent words, which its parts tell texts apart by.
GUESS_ROUNDS, LEAN, GUESS_WORDS = 3, 0.5, MODEL_WORDS
#: Tokens of texts that the recursions go through side by side, unless one text has more, and those whose emissions are held at a time.
BATCH_TOKENS, SPELL_TOKENS = 500_000, 100_000
#: Tokens of a block of texts, unless one text has more, and words (one for each of its blocks) of a part of the table.
BLOCK_TOKENS, PART_WORDS = 3_000_000, 500_000
#: Bytes from which an array is mapped by itself, so that it goes back to the system when it is freed.
MAPPED = 4 << 20


def _give_back() -> None:
    """Return what earlier tasks of this worker have left to the system, and let large arrays be mapped by themselves.

    Workers are used again, and by default the C library keeps freed arrays of up to 32 MB.
    """
    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, MAPPED)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 2 * MAPPED)  # M_TRIM_THRESHOLD
        libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tokens_of(data: bytes) -> list[bytes]:
    """The words of a text; the end token is not among them."""
    return data.translate(LOWER_TABLE).split()


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % CLASSES


def _class_column(token: str) -> Column:
    return F.crc32(F.substring(token, -SUFFIX, SUFFIX)) % CLASSES


def count_tokens(docs: DataFrame) -> DataFrame:
    """token (binary) and its count c in the texts; the end token counts once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["token", "c"])
            counts.clear()
            return out

        for b in batches:
            for data in b.column("text").cast(pa.binary()).to_pylist():
                counts.update(tokens_of(data or b""))
                counts[END] += 1
                if len(counts) > 400_000:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Head:
    """The most frequent tokens with their counts, and what the whole vocabulary sums up to."""

    index: dict[bytes, int]
    ids: np.ndarray  # in the model: 0 for the end, then words, then classes
    log_count: np.ndarray  # log10(c + 1)
    log_share: np.ndarray  # log10 of the share within the class; 0 for words that the model has
    class_total: np.ndarray  # of c + 1 over the class's words, and 1
    words: int  # that the model has, without the end
    n: int
    v: int

    @property
    def size(self) -> int:
        return 1 + self.words + CLASSES


def make_head(counts: DataFrame, head_words: int, model_words: int) -> Head:
    """The head holds all words from some count up, and of the next step of counts those of small hashes that still fit.

    It has about ``head_words`` at most; the driver gets these and bounded sums.
    """
    words_only = counts.filter(F.col("token") != F.lit(END))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = counts.filter(F.col("token") == F.lit(END)).select("c").collect()
    step = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")  # at most a thousand steps
    sizes = sorted(((r.step, r.n) for r in words_only.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, met, part = 1 << 30, 0, F.lit(False)
    for at, k in sizes:
        if met + k > head_words:
            left = head_words - met
            share = max(0.0, left - 4 * left**0.5) / k
            part = (step == at) & (F.pmod(F.xxhash64("token"), F.lit(1 << 40)) < int(share * (1 << 40)))
            break
        least, met = at, met + k
    top = words_only.filter((step >= least) | part).toArrow()
    order = np.lexsort((np.array(top.column("token").to_pylist(), object), -top.column("c").to_numpy()))
    top = top.take(pa.array(order))
    tokens, c = [END, *top.column("token").to_pylist()], np.concatenate(([ends[0].c if ends else 0], top.column("c").to_numpy())).astype(np.float64)
    words = min(model_words, len(top))
    total = np.ones(CLASSES)
    for r in words_only.groupBy(_class_column("token").alias("g")).agg(F.sum(F.col("c") + 1).alias("s")).collect():
        total[r.g] += r.s
    classes = np.array([word_class(t) for t in tokens])
    np.subtract.at(total, classes[1 : words + 1], c[1 : words + 1] + 1)
    ids = np.where(np.arange(len(tokens)) <= words, np.arange(len(tokens)), 1 + words + classes)
    share = np.where(ids > words, np.log10((c + 1) / total[classes]), 0.0)
    return Head({t: i for i, t in enumerate(tokens)}, ids.astype(np.uint16), np.log10(c + 1), share, total, words, int(n), int(v))


def _planes(x: np.ndarray) -> bytes:
    """Numbers of four bytes as all first bytes, all second bytes and so on, which compress better."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 4).T.tobytes()


def _joined(data: bytes, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(dtype).ravel()


def _steps_of(x: np.ndarray) -> np.ndarray:
    """Numbers from 2^-30 to 2^35 as thousandths of an octave above 2^-30; lesser ones are 0."""
    with np.errstate(divide="ignore"):
        octaves = np.log2(x, dtype=np.float32) if x.dtype == np.float32 else np.log2(x)
    octaves += 30
    octaves *= 1000
    return np.clip(np.rint(octaves, out=octaves), 0, 65_535, out=octaves).astype("<u2")


_VALUES = np.concatenate(([0.0], 2.0 ** (np.arange(1, 65_536) / 1000 - 30)))


def _short(steps: np.ndarray) -> bytes:
    """Steps as all lower bytes and then all upper bytes, which compress better."""
    return np.ascontiguousarray(steps).view(np.uint8).reshape(-1, 2).T.tobytes()


def _unshort(data: bytes) -> np.ndarray:
    """The numbers that the steps stand for."""
    return _VALUES[np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(2, -1).T).view("<u2").ravel()]


def indexed(docs: DataFrame, held: Broadcast) -> DataFrame:
    """For each text: a unique key, its block, its ids (unsigned 32-bit, in planes of bytes), sums over tokens, and the words beyond the head.

    Ids up to ``head.words`` are the model's; those above are places in the
    block's own list of other words. The list's hashes are in ``vocab`` of one
    more row for each block, whose key is null. ``n_tokens`` counts all,
    ``n_known`` those of the head with c > 0; ``log_count`` sums over the head's
    tokens. ``docs`` has doc_id, text and train.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"key long, block long, doc_id {kind}, train boolean, n_tokens long, n_known long, log_count double, ids binary, others array<binary>, vocab binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head: Head = held.value
        key, index = TaskContext.get().partitionId() << 40, head.index
        block, size, tokens = TaskContext.get().partitionId() << 24, head.words + 1, 0
        known = 10**head.log_count > 1.5  # the end is in the head even if training has no text
        own: dict[bytes, int] = {}
        names = ["key", "block", "doc_id", "train", "n_tokens", "n_known", "log_count", "ids", "others", "vocab"]
        types = [pa.int64(), pa.int64(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.binary()]

        def batch(cols: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        def listed() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
            own.clear()
            return batch([[None], [block], [None], [False], [0], [0], [0.0], [None], [None], [hashes.tobytes()]])

        for b in batches:
            types[2] = b.schema.field("doc_id").type
            cols: list[list] = [[] for _ in names]
            for doc_id, train, data in zip(b.column("doc_id").to_pylist(), b.column("train").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = tokens_of(data or b"")
                words.append(END)
                at = np.fromiter(map(index.get, words, repeat(-1)), np.int64, len(words))
                inside, ids = at[at >= 0], at.copy()
                beyond = np.flatnonzero((at < 0) | (at >= size))
                ids[beyond] = [size + own.setdefault(words[i], len(own)) for i in beyond.tolist()]
                others = [words[i] for i in np.flatnonzero(at < 0).tolist()]
                found = (key, block, doc_id, train, len(words), int(known[inside].sum()), float(head.log_count[inside].sum()), _planes(ids.astype("<u4")), others, None)
                for col, x in zip(cols, found, strict=True):
                    col.append(x)
                key, tokens = key + 1, tokens + len(words)
                if tokens >= BLOCK_TOKENS:
                    yield batch(cols)
                    yield listed()
                    cols, tokens, block = [[] for _ in names], 0, block + 1
            yield batch(cols)
        if tokens:
            yield listed()

    return docs.select("doc_id", "text", "train").mapInArrow(run, schema)


@dataclass
class Model:
    start: np.ndarray  # of K states
    step: np.ndarray  # K x K
    emit: np.ndarray  # K x ids


def _packed(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of texts of like length: their numbers, their ids in order of position, and how many reach each position."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        longest = len(texts[order[at]])
        took = order[at : at + max(1, BATCH_TOKENS // longest)]
        at += len(took)
        lengths = np.array([len(texts[i]) for i in took])
        reach = np.searchsorted(-lengths, -np.arange(longest), side="left")
        begin = np.concatenate(([0], np.cumsum(reach)))
        flat = np.empty(begin[-1], np.int32)
        for row, i in enumerate(took):
            flat[begin[: len(texts[i])] + row] = texts[i]
        yield np.array(took), flat, begin


def _spells(begin: np.ndarray) -> list[tuple[int, int]]:
    """Runs of positions, first and last but one, that hold about ``SPELL_TOKENS`` tokens each."""
    out, at = [], 0
    while at < len(begin) - 1:
        stop = max(at + 1, int(np.searchsorted(begin, begin[at] + SPELL_TOKENS)))
        out.append((at, min(stop, len(begin) - 1)))
        at = out[-1][1]
    return out


def _forward(model: Model, flat: np.ndarray, begin: np.ndarray, keep: bool) -> tuple[np.ndarray | None, np.ndarray]:
    """Scaled forward probabilities, if they are to be kept, and scales of a packed batch. Emissions are looked up a spell at a time."""
    k, dtype = len(model.start), model.emit.dtype
    alpha, scale, ones, last = np.empty((len(flat), k), dtype) if keep else None, np.empty(len(flat), dtype), np.ones(k, dtype), None
    for t0, t1 in _spells(begin):
        emit = model.emit.T[flat[begin[t0] : begin[t1]]]
        for t in range(t0, t1):
            lo, hi = begin[t], begin[t + 1]
            a = emit[lo - begin[t0] : hi - begin[t0]]
            a *= last[: hi - lo] @ model.step if t else model.start
            s = np.matmul(a, ones, out=scale[lo:hi])
            last = np.divide(a, s[:, None], out=alpha[lo:hi] if keep else a)
    return alpha, scale


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 of each text's probability of ids, by the scaled forward recursion."""
    out = np.zeros(len(texts))
    for took, flat, begin in _packed(texts):
        logs = np.log10(_forward(model, flat, begin, False)[1])
        rows = np.arange(len(flat)) - np.repeat(begin[:-1], np.diff(begin))
        out[took] = np.bincount(rows, logs, len(took))
    return out


def expected_counts(model: Model, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, steps and emissions over texts, and their log10 likelihood."""
    k, size = model.emit.shape
    start, step, emitted, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, size)), 0.0
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def add() -> None:
        ids, gammas = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        for s in range(k):
            emitted[s] += np.bincount(ids, gammas[:, s], size)

    for _, flat, begin in _packed(texts):
        alpha, scale = _forward(model, flat, begin, True)
        total += float(np.log10(scale.astype(np.float64)).sum())
        passed = np.zeros((k, k))
        back = np.ones((begin[-1] - begin[-2], k), alpha.dtype)  # of a position, divided by the later scales
        for t0, t1 in reversed(_spells(begin)):
            emit = model.emit.T[flat[begin[t0] : begin[t1]]]
            gamma = np.empty_like(emit)
            for t in range(t1 - 1, t0 - 1, -1):
                lo, hi = begin[t], begin[t + 1]
                here = emit[lo - begin[t0] : hi - begin[t0]]
                np.multiply(alpha[lo:hi], back, out=gamma[lo - begin[t0] : hi - begin[t0]])
                if t:
                    here *= back
                    here /= scale[lo:hi, None]
                    before = begin[t - 1]
                    passed += alpha[before : before + hi - lo].T @ here
                    back = np.ones((lo - before, k), alpha.dtype)  # a text that ends there has nothing behind it
                    np.matmul(here, model.step.T, out=back[: hi - lo])
            if not t0:
                start += gamma[: begin[1]].sum(axis=0)
            held.append((flat[begin[t0] : begin[t1]], gamma))
            if sum(len(x) for x, _ in held) >= 4 * SPELL_TOKENS:  # the sums are as long as the vocabulary, so they are added seldom
                add()
        step += passed * model.step
        del alpha, scale  # before the next batch's are made
    if held:
        add()
    return start, step, emitted, total


def _texts(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The ids of the texts that there are; the column is not copied on the way."""
    return [_joined(x.as_buffer(), "<i4") for x in column if x.is_valid]


@dataclass
class Rest:
    """What emissions of the other words follow from, beside their expected counts."""

    parts: int  # of the distributed table
    total: float  # of c + 1 over all words, and one for each class
    mass: np.ndarray | None = None  # of each state's counts; none before the first round, when all states emit them alike


def _with_rest(model: Model, rest: Rest, vocab: np.ndarray, sums: pa.Table | None) -> tuple[Model, np.ndarray]:
    """The model with the emissions of a block's other words, and these words' order by the part of the table."""
    k, dtype = len(model.start), model.emit.dtype
    order = np.argsort(vocab % np.uint64(rest.parts), kind="stable")
    more = np.ones((len(vocab), k), dtype)
    if rest.mass is not None:
        told = sorted(zip(sums.column("part").to_pylist(), sums.column("sums").to_pylist(), strict=True))
        at = 0
        for _, data in told:
            met = _unshort(data).reshape(-1, k)
            more[order[at : at + len(met)]] = (met + 10 * (met.sum(axis=1, keepdims=True) + 1) / rest.total) / rest.mass
            at += len(met)
    return Model(model.start, model.step, np.concatenate((np.ascontiguousarray(model.emit.T), more)).T), order


def _by_block(rows: DataFrame, sums: DataFrame | None, run, schema: str) -> DataFrame:
    """``run`` on each block's rows, with what the distributed table tells of its words."""
    if sums is None:
        return rows.groupBy("block").applyInArrow(lambda own: run(own, None), schema)
    return rows.groupBy("block").cogroup(sums.groupBy("block")).applyInArrow(run, schema)


def _summed(found: DataFrame, k: int) -> DataFrame:
    """For each block and part, the sums over all blocks of the words that the block sent there, in its order.

    One more row a part, of no block, has the total of the part's words for each
    state, as kept.
    """

    def run(table: pa.Table) -> pa.Table:
        _give_back()
        hashes = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("vocab")]
        ends = np.cumsum([0, *map(len, hashes)])
        counts = np.empty((ends[-1], k))
        for a, b, x in zip(ends[:-1], ends[1:], table.column("sums"), strict=True):
            counts[a:b] = _unshort(x.as_buffer()).reshape(-1, k)
        words, at = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = _steps_of(np.stack([np.bincount(at, counts[:, s], len(words)) for s in range(k)], axis=1))
        out = [_short(sums[at[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        own = pa.table({"block": table.column("block"), "part": table.column("part"), "sums": pa.array(out, pa.binary()), "mass": pa.nulls(len(out), pa.list_(pa.float64()))})
        told = [[None], [table.column("part")[0].as_py()], [None], [_VALUES[sums].sum(axis=0).tolist()]]
        return pa.concat_tables([own, pa.table([pa.array(x, t) for x, t in zip(told, own.schema.types, strict=True)], names=own.schema.names)])

    sent = found.filter("part is not null").select("block", "part", "vocab", "sums")
    return sent.groupBy("part").applyInArrow(run, "block long, part long, sums binary, mass array<double>")


def baum_welch(table: DataFrame, model: Model, unigram: np.ndarray, rest: Rest, sums: DataFrame | None, path: str | None) -> tuple[Model, Rest, DataFrame, str]:
    """One round over all training texts: the next model, its sums of other words, and the path of these.

    The sums of the round before, at ``path``, are deleted once they were used.
    """
    spark = table.sparkSession
    held = spark.sparkContext.broadcast(
        (Model(model.start.astype(np.float32), model.step.astype(np.float32), model.emit.astype(np.float32)), rest)
    )
    k, size = model.emit.shape

    def run(own: pa.Table, told: pa.Table | None) -> pa.Table:
        _give_back()
        vocab = np.frombuffer(own.column("vocab").drop_null()[0].as_py(), "<u8")
        full, order = _with_rest(*held.value, vocab, told)
        start, step, emitted, _ = expected_counts(full, _texts(own.column("ids")))
        seen = np.flatnonzero(emitted[:, :size].any(axis=0))
        names = np.concatenate([[-1], np.arange(-10, -10 - k, -1), seen])
        rows = np.vstack([start, step, emitted[:, seen].T])
        parts, begin = np.unique((vocab % np.uint64(held.value[1].parts))[order], return_index=True)
        ends = [*begin.tolist(), len(order)]
        more, n, m = _steps_of(emitted[:, size:].T), len(names), len(parts)
        chosen = [order[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        missing = lambda count, kind: pa.nulls(count, kind)
        cols = {"id": pa.concat_arrays([pa.array(names, pa.int64()), missing(m, pa.int64())])}
        cols |= {f"s{s}": pa.concat_arrays([pa.array(rows[:, s].astype(np.float32)), missing(m, pa.float32())]) for s in range(k)}
        cols |= {"block": pa.array(np.full(n + m, own.column("block")[0].as_py())), "part": pa.concat_arrays([missing(n, pa.int64()), pa.array(parts.astype(np.int64))])}
        cols["vocab"] = pa.concat_arrays([missing(n, pa.binary()), pa.array([vocab[c].tobytes() for c in chosen], pa.binary())])
        cols["sums"] = pa.concat_arrays([missing(n, pa.binary()), pa.array([_short(more[c]) for c in chosen], pa.binary())])
        return pa.table(cols)

    rows = table.filter("train or key is null").select("block", "ids", "vocab")
    schema = "id long, " + ", ".join(f"s{s} float" for s in range(k)) + ", block long, part long, vocab binary, sums binary"
    before, sent, path = path, scratch(spark, "sent"), scratch(spark, "sums")
    _by_block(rows, sums, run, schema).write.parquet(sent)
    if before:
        delete_path(spark, before)
    written = spark.read.schema(schema).parquet(sent)
    found = written.filter("id is not null").groupBy("id").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(k))).toArrow()
    start, step, emitted = np.ones(k), np.full((k, k), 0.1), np.tile(unigram * 10, (k, 1))
    ids, met = found.column("id").to_numpy(), np.stack([found.column(f"s{s}").to_numpy() for s in range(k)], axis=1)
    emitted[:, ids[ids >= 0]] += met[ids >= 0].T
    for i in np.flatnonzero(ids < 0):
        if ids[i] == -1:
            start += met[i]
        else:
            step[-10 - ids[i]] += met[i]
    _summed(written, k).write.parquet(path)
    delete_path(spark, sent)
    kept = spark.read.schema("block long, part long, sums binary, mass array<double>").parquet(path)
    other = kept.filter("block is null").agg(*(F.sum(F.get("mass", F.lit(s))) for s in range(k))).first()
    mass = emitted.sum(axis=1) + np.array([x or 0.0 for x in other]) + 10 * (1 - unigram.sum())
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return Model(norm(start), norm(step), emitted / mass[:, None]), Rest(rest.parts, rest.total, mass), kept.filter("block is not null").drop("mass"), path


def _unigram(head: Head, total: float) -> np.ndarray:
    """Add-one shares of the model's ids; the other words and the classes' one counts have what is left."""
    return 10 ** head.log_count[: head.words + 1] / total


def _mixture_step(table: DataFrame, weight: np.ndarray, logs: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Over all training texts: the parts' expected numbers of texts and counts of words.

    ``logs`` has the parts' log emissions; ``place`` a row of it for each id of
    the model and, last, for all others, which is past the end if it has no say.
    """
    parts, size = logs.shape
    held = table.sparkSession.sparkContext.broadcast((np.concatenate([logs.T, np.zeros((1, parts))]).astype(np.float32), place))

    def add(texts: list[np.ndarray], counts: np.ndarray, met: np.ndarray) -> None:
        emit, place = held.value
        flat = place[np.minimum(np.concatenate(texts), len(place) - 1)]
        lengths = np.array([len(t) for t in texts])
        own = np.add.reduceat(emit[flat], np.concatenate(([0], np.cumsum(lengths)[:-1])), axis=0, dtype=np.float64) + weight
        own = np.exp(own - own.max(axis=1, keepdims=True))
        own /= own.sum(axis=1, keepdims=True)
        met += own.sum(axis=0)
        for s in range(parts):
            counts[s] += np.bincount(flat, np.repeat(own[:, s], lengths), size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        counts, met = np.zeros((parts, size + 1)), np.zeros(parts)
        for b in batches:
            texts, n = [], 0
            for text in _texts(b.column("ids")):
                texts.append(text)
                n += len(text)
                if n >= BATCH_TOKENS:
                    add(texts, counts, met)
                    texts, n = [], 0
            if texts:
                add(texts, counts, met)
        seen = np.flatnonzero(counts[:, :size].any(axis=0))
        cols = [np.concatenate([[-1], seen]), *(np.concatenate([[met[s]], counts[s, seen]]) for s in range(parts))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", *(f"s{s}" for s in range(parts))])

    rows = table.filter("train").select("ids").mapInArrow(run, "id long, " + ", ".join(f"s{s} double" for s in range(parts)))
    found = rows.groupBy("id").agg(*(F.sum(f"s{s}").alias(f"s{s}") for s in range(parts))).toArrow()
    ids, sums = found.column("id").to_numpy(), np.stack([found.column(f"s{s}").to_numpy() for s in range(parts)])
    counts = np.zeros((parts, size))
    counts[:, ids[ids >= 0]] = sums[:, ids >= 0]
    return sums[:, ids < 0].sum(axis=1), counts


def first_guess(table: DataFrame, unigram: np.ndarray, states: int, rounds: int = GUESS_ROUNDS, seed: int = 11) -> Model:
    """States that emit like the parts of a mixture of unigrams over all training texts.

    The first parts emit each word a little more or less than the unigrams do,
    by a seed, and so divide the texts; each step fits them to all texts.
    """
    rng, size = np.random.default_rng(seed), len(unigram)
    top = np.argsort(-unigram, kind="stable")[:GUESS_WORDS]
    place = np.full(size + 1, len(top))
    place[top] = np.arange(len(top))
    own = unigram[top]
    part = own * np.exp(LEAN * rng.choice([-1.0, 1.0], (states, len(top))))
    weight = np.full(states, 1 / states)
    for _ in range(rounds):
        met, counts = _mixture_step(table, np.log(weight), np.log(part / part.sum(axis=1, keepdims=True)), place)
        weight = (met + 1) / (met.sum() + states)
        part = counts + 10 * own
    emit = np.tile(unigram, (states, 1))
    emit[:, top] = part / part.sum(axis=1, keepdims=True) * own.sum()
    step = np.full((states, states), 0.04 / max(1, states - 1))
    np.fill_diagonal(step, 0.96 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), step, emit)


def score(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    states: int = STATES,
    rounds: int = ROUNDS,
    head_words: int = HEAD_WORDS,
    model_words: int = MODEL_WORDS,
) -> DataFrame:
    """Scores of all texts by a model of those rows for which ``train`` holds.

    Columns: doc_id, train, n_tokens (with the end), n_known (tokens that
    training has), train_tokens, base_score (log10 by add-one unigrams), score
    (log10 by the hidden Markov model).

    Null and empty texts have the end token alone. Each row is a text of its
    own, repeats and null ids too. If ``train`` is null the row is not learned
    from. Without any training text both models have no counts, and their
    add-one shares hold. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    if model_words + 1 + CLASSES > 1 << 16:
        raise ValueError("the model's ids must fit 16 bits")
    with _shuffles_go(spark):
        return _score(own, states, rounds, head_words, model_words)


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the job that made them ends: each round deals all training texts."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def _score(own: DataFrame, states: int, rounds: int, head_words: int, model_words: int) -> DataFrame:
    spark = own.sparkSession
    counts = materialize(count_tokens(own.filter("train")), "token-counts")
    head = make_head(counts, head_words, model_words)
    table = materialize(indexed(own, spark.sparkContext.broadcast(head)), "indexed")
    total = float((10 ** head.log_count[: head.words + 1]).sum() + head.class_total.sum())
    unigram = _unigram(head, total)
    words = table.filter("key is null").agg(F.coalesce(F.sum(F.length("vocab")), F.lit(0))).first()[0] // 8
    model, rest, sums, path = first_guess(table, unigram, states), Rest(1 + words // PART_WORDS, total), None, None
    for _ in range(rounds):
        model, rest, sums, path = baum_welch(table, model, unigram, rest, sums, path)
    held = spark.sparkContext.broadcast((model, rest))
    kept = ["key", "doc_id", "train", "n_tokens", "n_known", "log_count"]

    def run(texts: pa.Table, told: pa.Table | None) -> pa.Table:
        _give_back()
        vocab = np.frombuffer(texts.column("vocab").drop_null()[0].as_py(), "<u8")
        full, _ = _with_rest(*held.value, vocab, told)
        texts = texts.filter(texts.column("key").is_valid())
        found = pa.array(log_likelihoods(full, _texts(texts.column("ids"))))
        return texts.select(kept).append_column("likelihood", found)

    kind = own.schema["doc_id"].dataType.simpleString()
    scored = _by_block(
        table.select("block", *kept, "ids", "vocab"), sums, run,
        f"key long, doc_id {kind}, train boolean, n_tokens long, n_known long, log_count double, likelihood double",
    )
    beyond = table.filter("key is not null").select("key", F.explode("others").alias("token"))
    count = F.coalesce("c", F.lit(0))
    sums = beyond.join(counts, "token", "left").groupBy("key").agg(
        F.sum(F.log10(count + 1.0)).alias("more_log"), F.sum((count > 0).cast("long")).alias("more_known")
    )
    more = F.coalesce("more_log", F.lit(0.0))
    return scored.join(sums, "key", "left").select(
        "doc_id", "train", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(head.n).cast("long").alias("train_tokens"),
        (F.col("log_count") + more - F.col("n_tokens") * F.lit(float(np.log10(head.n + head.v + 1)))).alias("base_score"),
        F.col("likelihood").alias("score"),
    )
