"""Toxicity scores: boosted trees over dense features, calibrated by isotonic regression.

The features are lexicon densities (a fixed list of insults and terms that
labelled texts have taught), second-person proximity, capitals, punctuation
and obfuscation rates. The terms are counted over the labelled sample in a
distributed aggregate; the trees are fitted on the driver, on a sample of at
most ``sample_rows`` labelled rows. Calibration uses scores of models that
have not seen the row (three folds). Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastra.llm.boosting import BoostedTrees, Isotonic, sigmoid
from rastra.llm.common import WORD_TABLE, about, materialize, prepare

#: Common insults of four languages.
INSULTS = (
    "idiot idiots moron morons stupid dumb dumbass loser losers trash scum worthless pathetic disgusting clown clowns "
    "imbecile cretin fool fools jerk bastard bitch asshole crap shit fuck fucking fucker damn hate ugly filth filthy "
    "vermin parasite retard pig "
    "idioten dumm dummkopf trottel depp arschloch scheisse abschaum versager widerlich "
    "imbécile crétin connard salaud ordure stupide débile merde "
    "idiota imbécil estúpido estúpida basura escoria asqueroso mierda cabrón inútil"
).split()
#: Second-person words of four languages.
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos "
    "tú ti tus usted ustedes vosotros"
).split()
#: Characters that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}

FEATURES = (
    "log_words insult_density log_insults term_density log_terms term_kinds term_top term_sum second_person proximity "
    "capitals capital_words exclamations questions other_punctuation digits mixed_words hidden_insults stretched non_ascii"
).split()

#: Rows of the labelled sample, at most.
SAMPLE_ROWS = 20_000
#: The least log-likelihood ratio of a taught term. The sample bounds how many there can be.
TERM_RATIO = 30.0
NEAR_WORDS = 4

# no match starts within a run that an earlier start has tried, so the time goes with the text's length
_MIXED = re.compile(rb"(?<![a-z])[a-z]++(?:[0-9@$!*#_.-]++[a-z]++)++|(?<![0-9@$])[0-9@$]++[a-z]+[a-z0-9@$!*#_.-]*[a-z0-9]")
_STRETCHED = re.compile(rb"([a-z])\1\1")
_CAPITALS = re.compile(rb"(?<![A-Za-z])[A-Z]{3,}(?![A-Za-z])")
_LEET = bytes.maketrans("".join(LEET).encode(), "".join(LEET.values()).encode())
_INSULTS = {w.encode() for w in INSULTS}
_SECOND = {w.encode() for w in SECOND_PERSON}
# classes of bytes: 0 other, 1 capital, 2 small letter, 3 digit, 4 !, 5 ?, 6 other punctuation, 7 not ASCII
_KIND = np.array([
    1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 else 3 if 48 <= b <= 57 else 4 if b == 33 else 5 if b == 63
    else 7 if b > 127 else 6 if b > 32 and b != 127 else 0
    for b in range(256)
], np.uint8)


def _clipped(word: bytes, n: int) -> bytes:
    """The first n characters of a word, or nothing if it is not longer."""
    if len(word) <= n:
        return b""
    cut = word[:n] if word[: 4 * n].isascii() else word[: 4 * n].decode("utf-8", "ignore")[:n].encode()
    return b"" if cut == word else cut


def terms_of(words: list[bytes]) -> set[bytes]:
    """The words and, marked by a hyphen, their first 4, 5 and 6 characters."""
    kinds = set(words)
    return kinds | {p + b"-" for w in kinds for n in (4, 5, 6) if (p := _clipped(w, n))}


@dataclass
class Terms:
    """What labelled texts have taught: weights of words and of beginnings of words."""

    words: dict[bytes, float]
    starts: dict[bytes, float]

    @classmethod
    def of(cls, weights: dict[bytes, float]) -> Terms:
        return cls({k: v for k, v in weights.items() if k[-1:] != b"-"}, {k[:-1]: v for k, v in weights.items() if k[-1:] == b"-"})

    def hits(self, words: list[bytes]) -> dict[int, float]:
        """Weights of the words that match, by position."""
        out = {i: self.words[words[i]] for i in range(len(words)) if words[i] in self.words} if self.words else {}
        if self.starts:
            kinds = {w: s for w in set(words) if (s := max((self.starts.get(_clipped(w, n), 0.0) for n in (4, 5, 6)), default=0.0))}
            if kinds:
                out |= {i: max(kinds[w], out.get(i, 0.0)) for i, w in enumerate(words) if w in kinds}
        return out


def features(data: bytes, terms: Terms) -> list[float]:
    """The dense features of a text in UTF-8; an empty text has zeros."""
    if not data:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=8).tolist()
    words = data.translate(WORD_TABLE).split()
    n, size = max(1, len(words)), len(data)
    insults = [i for i, w in enumerate(words) if w in _INSULTS]
    taught = terms.hits(words)
    second = [i for i, w in enumerate(words) if w in _SECOND]
    near = 0
    if second and (insults or taught):
        at = np.array(second)
        for i in {*insults, *taught}:
            j = np.searchsorted(at, i)
            near += min(abs(at[k] - i) for k in (j - 1, j) if 0 <= k < len(at)) <= NEAR_WORDS
    low = data.lower()
    mixed = _MIXED.findall(low)
    hidden = sum(re.sub(rb"[^a-z]", b"", w.translate(_LEET)) in _INSULTS for w in mixed)
    letters = max(1, kinds[1] + kinds[2])
    weights = list(taught.values())
    return [
        float(np.log1p(len(words))), len(insults) / n, float(np.log1p(len(insults))), len(taught) / n, float(np.log1p(len(taught))),
        float(len({words[i] for i in taught})), max(weights, default=0.0), float(np.log1p(sum(weights))), len(second) / n, near / n,
        kinds[1] / letters, len(_CAPITALS.findall(data)) / n, kinds[4] / size, kinds[5] / size, kinds[6] / size, kinds[3] / size,
        len(mixed) / n, float(hidden), len(_STRETCHED.findall(low)) / n, kinds[7] / size,
    ]


@dataclass
class Model:
    """A fitted scorer, small enough to broadcast: the sample's terms of high ratios and fixed numbers of trees."""

    terms: Terms
    trees: BoostedTrees | None
    calibration: Isotonic | None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; a thousandth of the raw one keeps the order within a pool."""
        if self.trees is None:
            return 1 - np.exp(-0.5 * (x[:, FEATURES.index("log_insults")] + x[:, FEATURES.index("hidden_insults")]))
        raw = self.trees.margin(x)
        return 0.999 * self.calibration(raw) + 0.001 * sigmoid(raw)


def _count_terms(sample: DataFrame) -> DataFrame:
    """For each term, the toxic and the other texts of the sample that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list({**counts[0], **counts[1]})
            cols = [pa.array(keys, pa.binary()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, ["term", "clean", "toxic"])

        for b in batches:
            for data, y in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("y").to_pylist(), strict=True):
                counts[y].update(terms_of((data or b"").translate(WORD_TABLE).split()))
                if len(counts[0]) + len(counts[1]) > 200_000:
                    yield flush()
        yield flush()

    parts = sample.select("text", "y").mapInArrow(run, "term binary, clean long, toxic long")
    return parts.groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def _teach(sample: DataFrame, toxic: int, clean: int) -> Terms:
    """The terms that speak most for a toxic text, by the log-likelihood ratio of their document counts."""
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = F.lit(toxic / (toxic + clean))
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    ratio = 2 * (part(a, (a + b) * share) + part(b, (a + b) * (1 - share)))
    odds = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
    found = (
        _count_terms(sample).filter("toxic >= 3").select("term", ratio.alias("ratio"), odds.alias("odds"))
        .filter((F.col("ratio") >= TERM_RATIO) & (F.col("odds") > 1.5))
        .collect()
    )
    return Terms.of({bytes(r.term): float(r.odds) for r in found})


def _featured(sample: DataFrame, terms: Terms) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [features(x or b"", terms) for x in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b.column("y"), b.column("key")], ["x", "y", "key"])

    rows = sample.select("text", "y", "key").mapInArrow(run, "x array<double>, y int, key long").collect()
    rows.sort(key=lambda r: (r.key, r.y, r.x))
    return np.array([r.x for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r.y for r in rows], float)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    learn_from=None,
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit the scorer on at most ``sample_rows`` labelled texts, those of the least hashes.

    ``learn_from`` is a condition on the label table's rows. Rows of null ids,
    and of labels that are null or neither 0 nor 1, teach nothing; of repeated
    label rows the largest label holds. Each text of a labelled id counts once,
    however often its row is repeated, and different texts of one id count
    each. If the sample lacks either label, the model scores by the fixed
    insults alone.
    """
    prepare(docs.sparkSession)
    rows = labels.filter(learn_from) if learn_from is not None else labels
    rows = rows.select(rows[id_col].alias("id"), rows[label_col].cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    each = materialize(rows.groupBy("id").agg(F.max("y").alias("y")), "labels")
    picked = about(each, "id", sample_rows, each.count())  # bounded, so it may be broadcast
    own = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    # as many rows as picked labels, but where ids are repeated
    texts = materialize(own.groupBy("id", "y", F.xxhash64("id", "text").alias("key")).agg(F.first("text").alias("text")), "texts")
    n = texts.count()
    sample = texts if n <= sample_rows else materialize(about(texts, "key", sample_rows, n), "sample")
    count = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = count.get(1, 0), count.get(0, 0)
    if min(toxic, clean) < 3:
        return Model(Terms({}, {}), None, None)
    terms = _teach(sample, toxic, clean)
    x, y = _featured(sample, terms)
    fold = np.arange(len(y)) % 3
    raw = np.empty(len(y))
    for k in range(3):
        raw[fold == k] = BoostedTrees().fit(x[fold != k], y[fold != k]).margin(x[fold == k])
    return Model(terms, BoostedTrees().fit(x, y), Isotonic().fit(raw, y))


def _scores(texts: pa.Array, model: Model) -> np.ndarray:
    x = np.array([features(t or b"", model.terms) for t in texts.cast(pa.binary()).to_pylist()])
    return np.clip(model.score(x.reshape(-1, len(FEATURES))), 0, 1)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the score of every text, 0 to 1. Null and empty texts get the score of a text without features.

    Each row is scored on its own, null ids and repeated rows too. Other
    columns are ignored; no documents give no rows.
    """
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_scores(b.column("text"), held.value))], ["doc_id", "score"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, score double")


def keep_below(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents whose score is under the threshold; all columns stay, nothing is shuffled."""
    prepare(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(_scores(b.column(b.schema.names.index(text_col)), held.value) < threshold))

    return docs.mapInArrow(run, docs.schema)
