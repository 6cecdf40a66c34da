"""The text operators against brute force on small tables, with nulls, empties, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rastra.llm import components, decontaminate, hmm, ngram_join, packing, toxicity
from rastra.llm.boosting import BoostedTrees, Isotonic
from rastra.llm.common import join_hot, materialize, words_of
from rastra.llm.components import connected_components
from rastra.llm.queries import word_tokenizer_path

WORDS = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ra", "te", "zo") for b in ("n", "st", "r", "la", "de", "ö")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, texts, clash: bool = True):
    rows = [(i, t, "en", "s", 0, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, rep string, links string")


def odd(rng: random.Random) -> list:
    """Texts with nulls, empties, one word, symbols, copies, near copies and one long text."""
    base = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    near = []
    for t in base[:12]:
        w = t.split()
        for _ in range(rng.randint(1, 4)):
            v = list(w)
            v[rng.randrange(len(v))] = rng.choice(WORDS)
            near.append(" ".join(v))
    return [*base, *near, *base[:8], base[0].upper(), None, None, "", "  ", "!!! ??", "one", "one", "One.", prose(rng, 6000), "a b c d", "a b c d"]


def jaccard_sets(texts, n=5):
    out = []
    for t in texts:
        w = words_of((t or "").encode())
        k = min(n, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    return out


def brute_join(texts):
    sets = jaccard_sets(texts)
    n = len(texts)
    link = [[i != j and bool(sets[i] & sets[j]) and Fraction(len(sets[i] & sets[j]), len(sets[i] | sets[j])) >= Fraction(4, 5) for j in range(n)] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in range(n) if link[i][j])]) for i in range(n)]
        if new == label:
            break
        label = new
    copy = [min(j for j in range(n) if j == i or sets[i] and sets[i] == sets[j]) for i in range(n)]
    return [(i, label[i], copy[i], sum(link[i])) for i in range(n)]


@pytest.mark.parametrize("block_rows", [ngram_join.BLOCK_ROWS, 3])
def test_join_is_brute_force(spark, block_rows):
    """At the shipped bands and rows, with one chunk a group and with many."""
    texts = odd(random.Random(5))
    got = ngram_join.join(docs_of(spark, texts), block_rows=block_rows)
    assert sorted(map(tuple, got.collect())) == brute_join(texts)


def test_join_at_the_threshold(spark):
    """Pairs of similarity from 0.8 to 0.85: the shipped bands and rows find them."""
    rng = random.Random(12)
    texts = []
    for k in range(150):
        w = [f"w{k}x{i}" for i in range(100)]  # 96 n-grams; a change of five words in a row parts 9
        v = [*w[:20], *(f"y{k}x{i}" for i in range(rng.choice([3, 4, 5]))), *w[25:]]
        texts += [" ".join(w), " ".join(v)]
    want = brute_join(texts)
    got = sorted(map(tuple, ngram_join.join(docs_of(spark, texts)).collect()))
    assert got == want and sum(r[3] for r in want) >= 200


def test_blocks_by_bytes(spark):
    """Long texts make chunks of few members; the result is the same."""
    rng = random.Random(13)
    base = prose(rng, 3000).split()
    texts = []
    for i in range(12):
        v = list(base)
        v[17 * i] = f"x{i}"
        texts.append(" ".join(v))
    got = ngram_join.join(docs_of(spark, texts), block_bytes=60_000).collect()
    assert {(r.class_id, r.n_links) for r in got} == {(0, 11)} and len(got) == 12


def test_join_of_large_groups_and_odd_rows(spark):
    rng = random.Random(9)
    base = prose(rng, 150).split()
    texts = []
    for i in range(300):
        v = list(base)
        v[i % 150] = f"x{i}"
        texts.append(" ".join(v))
    texts += [" ".join(base)] * 200
    more = spark.createDataFrame([(None, "a b c"), (7, texts[7])], "doc_id long, text string")
    docs = docs_of(spark, texts).unionByName(more, allowMissingColumns=True)
    got = ngram_join.join(docs, block_rows=64).collect()
    assert len(got) == 502
    assert {r.class_id for r in got if r.doc_id is not None} == {0}
    assert {r.n_links for r in got if r.doc_id is not None and r.doc_id >= 300} == {500}
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)]
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0]
    assert ngram_join.join(docs.limit(0)).count() == 0 == ngram_join.one_of_each(docs.limit(0)).count()


def test_rows_not_ids_are_dropped(spark):
    """A unique text stays although its id also carries a copy; a repeated row collapses to one."""
    rng = random.Random(14)
    a, b, c = prose(rng, 40), prose(rng, 40), prose(rng, 40)
    near = a.split()
    near[0] = "changed"
    rows = [(3, a, "p"), (3, a, "p"), (3, a, "q"), (7, a, "p"), (7, b, "p"), (8, b, "p"), (9, c, "p"), (9, " ".join(near), "p"), (4, None, "p"), (4, None, "p"), (None, a, "p"), (None, a, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __th string").repartition(4)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert sorted(((i, t) for i, t, _ in got if i is not None), key=str) == sorted([(3, a), (7, b), (9, c), (4, None), (4, None)], key=str)
    assert sum(i is None for i, _, _ in got) == 2
    links = sorted((r.doc_id, r.class_id, r.copy_id, r.n_links) for r in ngram_join.join(docs).collect() if r.doc_id in (3, 7, 8, 9))
    assert links == [(3, 3, 3, 4)] * 3 + [(7, 3, 3, 4), (7, 7, 7, 1), (8, 7, 7, 1), (9, 3, 9, 4), (9, 9, 9, 0)]
    # the same row whatever the order
    assert {tuple(r) for r in ngram_join.one_of_each(docs.orderBy(F.desc("doc_id"))).collect()} == set(got)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)] + [(500, 500)]
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in label:
        for u, v in edges:
            if u != v:
                label[u] = label[v] = min(label[u], label[v])
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == label


def test_components_of_long_paths_take_few_rounds(spark, monkeypatch):
    """Ids that fall along the path used to move a label by one node a round, up to 60 rounds."""
    falling, mixed = [0, *range(79, 0, -1)], list(range(1000, 1150))
    random.Random(4).shuffle(mixed)
    edges = [(a, b) for path in (falling, mixed) for a, b in zip(path, path[1:], strict=False)]
    made = []
    monkeypatch.setattr(components, "materialize", lambda df, name: made.append(name) or materialize(df, name))
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: 0 if x < 1000 else 1000 for x in falling + mixed}
    assert made.count("step") <= 12


def test_join_hot_takes_hot_and_rare_keys(spark):
    left = spark.range(5000).select((F.when(F.col("id") < 4000, 0).otherwise(F.col("id"))).alias("k"), "id")
    right = left.filter("k < 4800").groupBy("k").agg(F.count("*").alias("n"))
    assert join_hot(left, right, ["k"], "n", 5000).count() == 4800
    assert join_hot(left, right, ["k"], "n", 5000, "left").count() == 5000


def brute_hits(text, items, size=10):
    w = words_of((text or "").encode())
    hit, owners = set(), set()
    for item, t in items:
        v = words_of((t or "").encode())
        n = min(size, len(v))
        for a in range(len(v) - n + 1 if n else 0):
            for b in range(len(w) - n + 1):
                if w[b : b + n] == v[a : a + n]:
                    hit.update(range(b, b + n))
                    owners.add(item)
    return len(w), hit, sorted(map(str, owners))


def test_windows_take_bounded_memory():
    """Some five bytes for each of an item's, however many windows it has."""
    rng = random.Random(16)
    items = [(i, prose(rng, 400)) for i in range(300)]
    size = sum(len(t.encode()) for _, t in items)
    assert decontaminate.WindowSet(items, 10).bytes() < 10 * size


def test_items_without_names_and_with_the_same(spark):
    items = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "d e f"), (2, "a b c")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c"), (2, "d e f"), (3, "a b")], "doc_id long, text string")
    got = {r.doc_id: (len(r.spans), r.items) for r in decontaminate.find(docs, items).collect()}
    assert got == {1: (1, ["1", "2"]), 2: (1, ["1"]), 3: (0, [])}
    unnamed = decontaminate.find(docs, items.filter("item_id is null")).collect()
    assert {r.doc_id: (len(r.spans), r.items) for r in unnamed} == {1: (1, []), 2: (0, []), 3: (0, [])}


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_decontamination_is_brute_force(spark, block_bytes):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.randint(1, 40))) for i in range(12)] + [(100, None), (101, ""), (102, "Ba-N, ke!"), (103, "?"), (9, "zo la")]
    texts = odd(rng)[:40] + [None, ""]
    for _, t in items[:12]:
        v = t.split()
        texts.append(f"{prose(rng, 5)} {' '.join(v[2:14]).upper()}, {prose(rng, 9)}; {' '.join(v[:10])} {' '.join(v[1:11])}")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find(docs_of(spark, texts), bench, block_bytes=block_bytes, clean_text=True).collect()
    assert len(got) == len(texts)
    for r in got:
        n, hit, owners = brute_hits(texts[r.doc_id], items)
        spans = {i for s in r.spans for i in range(s.start, s.stop)}
        assert (r.n_words, spans, r.items) == (n, hit, owners)
        want = [w for i, w in enumerate(words_of((texts[r.doc_id] or "").encode())) if i not in hit]
        assert words_of((r.clean or "").encode()) == want
    docs = docs_of(spark, texts)
    kept = decontaminate.clean_documents(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}
    none = decontaminate.find(docs, bench.limit(0))
    assert none.agg(F.sum(F.size("spans")), F.count("*"), F.sum("n_words")).first()[:2] == (0, len(texts))
    assert decontaminate.find(docs.limit(0), bench).count() == 0


@cache
def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer_path())


def whole_ids(text):
    return [*whole_tokenizer().encode(text or "", add_special_tokens=False).ids, 1]


# texts on which words could be cut or normalised in another way than in whole texts
TRICKY = [
    "don't stop, we'll go.", "É́a É, x́.", "abc<|endoftext|>def <|ENDOFTEXT|>", "ẞİi ſ. Σας", "a b c\x1cd\x85e", "日本語, テスト。 12ab3.", "ﬁ. ŉ, ǅ. ª.",
    "'s.'t,", "x!.", ",,..", "ANKARA BELEDİYESİ, 2020", "İ. Sİ. sİ,", "x" * 20_000, "ʰ, é.,", "a\x0bb\x0cc\x00d", "Ünïcode WÖRDS, ÀÉÎ.", "ﬁ​.­,", "é, ́e.", "...", "a.b,c.", "A.",
]


def test_word_tokens_are_the_tokenizers():
    tok = packing.WordTokenizer(word_tokenizer_path())
    rng = random.Random(1)
    for text in [*TRICKY, *(t or "" for t in odd(rng)), "".join(chr(rng.randrange(32, 0x2FF)) for _ in range(3000))]:
        assert np.frombuffer(tok.ids(text.encode()), "<u4").tolist() == whole_ids(text)[:-1]


def test_word_tokens_of_random_texts():
    """Words of letters of all kinds beside the punctuation that is cut off."""
    tok, rng = packing.WordTokenizer(word_tokenizer_path()), random.Random(3)
    for _ in range(1500):
        top = rng.choice([0x80, 0x180, 0x250, 0x3000])
        text = "".join(chr(rng.choice([rng.randrange(32, top), 44, 46, 32, 97, 73, 0x130, 0x301])) for _ in range(25))
        assert np.frombuffer(tok.ids(text.encode()), "<u4").tolist() == whole_ids(text)[:-1], text


def test_split():
    pieces = [(1, 0, b"abcdefgh", 2), (2, 4, b"ijklmnop", 9)]
    assert packing.split(pieces, 0) == ([], pieces) and packing.split(pieces, 9) == (pieces, [])
    assert packing.split(pieces, 2) == (pieces[:1], pieces[1:])
    assert packing.split(pieces, 3) == ([pieces[0], (2, 4, b"ijkl", 9)], [(2, 5, b"mnop", 9)])


def test_padding_is_little(spark):
    """A few tokens a window, and part of one window a partition."""
    rng = random.Random(20)
    docs = docs_of(spark, [prose(rng, rng.randint(1, 900)) for _ in range(3000)]).coalesce(2)
    lengths = Counter()
    for r in packing.pack(docs, word_tokenizer_path()).select("sequence_id", "length").collect():
        lengths[r.sequence_id] += r.length
    assert max(lengths.values()) <= 2048 and sum(2048 - n for n in lengths.values()) / sum(lengths.values()) < 0.006


def test_graded_pieces_are_the_same_tokens():
    ids = np.arange(2000, dtype="<u4").tobytes()
    pieces = [(k, 7 * k, ids[4 * at : 4 * (at + 100)], 2000) for k, at in enumerate(range(0, 2000, 100))]
    cut = sorted(packing.graded(pieces), key=lambda p: p[:2])
    assert b"".join(p[2] for p in cut) == ids and len(cut) > len(pieces)
    assert all(start == 7 * doc + (np.frombuffer(x, "<u4")[0] - 100 * doc) for doc, start, x, _ in cut)
    assert packing.graded([]) == []


def test_packing(spark):
    texts = [*odd(random.Random(2)), *TRICKY]
    docs = docs_of(spark, texts).repartition(3)
    rows = packing.pack(docs, word_tokenizer_path(), capacity=256, piece=64, group=40).collect()
    ids: dict = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert len(ids.setdefault(r.doc_id, [])) == r.start and r.length == len(r.token_ids) // 4 > 0
        ids[r.doc_id] += np.frombuffer(bytes(r.token_ids), "<u4").tolist()
    assert ids == {i: whole_ids(t) for i, t in enumerate(texts)}
    assert all(r.doc_tokens == len(ids[r.doc_id]) for r in rows)
    seqs: dict = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    full = 0
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
        full += at
    assert full / (256 * len(seqs)) > 0.9
    twice = docs_of(spark, ["a b", "a b"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert packing.pack(twice, word_tokenizer_path()).count() == 2
    assert packing.pack(docs.limit(0), word_tokenizer_path()).count() == 0


def test_differencing():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(1, 40))]
        k = rng.randint(1, 12)
        dealt = packing.difference(sizes, k)
        assert len(dealt) == k and sorted(i for w in dealt for i in w) == list(range(len(sizes)))
        loads = [sum(sizes[i] for i in w) for w in dealt]
        assert max(loads) - min(loads) <= max(sizes)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]  # the classic example
    assert packing.windows([], 10) == [] and len(packing.windows([6, 6, 6], 10)) == 3
    with pytest.raises(ValueError):
        packing.windows([11], 10)


def toxic_corpus(rng: random.Random, n: int):
    rows = []
    for i in range(n):
        bad = rng.random() < 0.15
        w = prose(rng, rng.randint(5, 80)).split()
        if bad:
            for _ in range(rng.randint(2, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["grumpf" + rng.choice(["", "en", "ish"]), "idiot", "SCUM!"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_learns(spark):
    rows = toxic_corpus(random.Random(6), 1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    extra = spark.createDataFrame([(None, 1), (3, None), (10**9, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.unionByName(extra), learn_from=F.col("doc_id") % 4 != 0)
    assert any(k.startswith(b"grum") for k in [*model.terms.words, *model.terms.starts])
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(got) == 1500 and all(0 <= s <= 1 for s in got.values())
    held = [(got[i] >= 0.3, y) for i, _, y in rows if i % 4 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    odd_docs = docs_of(spark, [None, "", "you idiot", "you idiot", "!"])
    scores = [r.score for r in toxicity.score(odd_docs, model).orderBy("doc_id").collect()]
    assert scores[0] == scores[1] and scores[2] == scores[3] > 0.3 > scores[0]
    kept = toxicity.keep_below(odd_docs, model)
    assert kept.columns == odd_docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 4}
    assert toxicity.score(odd_docs.limit(0), model).count() == 0


def plain_features(text, words_taught, starts_taught):
    """The features by plain loops over characters and words."""
    import math
    import re

    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(toxicity.FEATURES)
    words = [w.lower() for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw)]
    taught = {}
    for i, w in enumerate(words):
        own = [words_taught.get(w, 0.0)]
        chars = w.decode("utf-8", "ignore")
        own += [starts_taught.get(chars[:n].encode(), 0.0) for n in (4, 5, 6) if len(chars) > n and len(w) > n]
        if max(own):
            taught[i] = max(own)
    insults = [i for i, w in enumerate(words) if w.decode("utf-8", "ignore") in toxicity.INSULTS]
    second = [i for i, w in enumerate(words) if w.decode("utf-8", "ignore") in toxicity.SECOND_PERSON]
    near = sum(any(abs(i - j) <= toxicity.NEAR_WORDS for j in second) for i in {*insults, *taught})
    n, size, low = max(1, len(words)), len(raw), raw.lower()
    letter, mark = rb"[a-z]", rb"[0-9@$!*#_.-]"
    mixed = re.findall(letter + rb"+(?:" + mark + rb"+" + letter + rb"+)+|[0-9@$]+[a-z]+[a-z0-9@$!*#_.-]*[a-z0-9]", low)
    hidden = sum("".join(c for c in "".join(toxicity.LEET.get(c, c) for c in m.decode()) if "a" <= c <= "z") in toxicity.INSULTS for m in mixed)
    capitals, small = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    runs = [m for m in re.findall(rb"[A-Za-z]+", raw) if len(m) >= 3 and m.isupper()]
    share = lambda test: sum(map(test, raw)) / size
    other = lambda b: 32 < b < 127 and not chr(b).isalnum() and b not in b"!?"
    return [
        math.log1p(len(words)), len(insults) / n, math.log1p(len(insults)), len(taught) / n, math.log1p(len(taught)),
        len({words[i] for i in taught}), max(taught.values(), default=0.0), math.log1p(sum(taught.values())), len(second) / n, near / n,
        capitals / max(1, capitals + small), len(runs) / n, share(lambda b: b == 33), share(lambda b: b == 63), share(other), share(lambda b: 48 <= b <= 57),
        len(mixed) / n, hidden, len(re.findall(rb"([a-z])\1\1", low)) / n, share(lambda b: b > 127),
    ]


def test_features_are_brute_force():
    rng = random.Random(15)
    weights = {b"grumpf": 2.0, b"kest": 1.5, b"gru-": 0.0, b"grum-": 1.0, "bénör-".encode(): 3.0}
    terms = toxicity.Terms.of({k: v for k, v in weights.items() if v})
    starts = {k[:-1]: v for k, v in weights.items() if k.endswith(b"-") and v}
    bits = ["grumpf", "grumpfen", "kest", "bénörig", "you", "Du", "idiot", "!D10T", "st*pid", "1d1ot", "SCUM", "SHOUT", "aaargh", "a.b", "3.a", "?!", "é", "42", "@x", "ok"]
    for _ in range(400):
        text = " ".join(rng.choice([*bits, *WORDS[:6]]) for _ in range(rng.randint(0, 30))).replace("ok ", rng.choice(["ok", "", "ok\n"]))
        assert toxicity.features(text.encode(), terms) == pytest.approx(plain_features(text, terms.words, starts)), text


def test_features_of_long_runs_take_linear_time():
    import time

    terms = toxicity.Terms({b"x": 1.0}, {b"abcd": 1.0})
    for text in (b"a" * 1_000_000, b"7" * 1_000_000, b"A" * 1_000_000, b"1a" + b"!@" * 500_000, b"a" * 500_000 + b"." * 500_000, "é".encode() * 500_000):
        began = time.process_time()
        assert len(toxicity.features(text, terms)) == len(toxicity.FEATURES)
        assert time.process_time() - began < 20


def test_sample_is_bounded_whatever_repeats(spark):
    """Repeated rows of labelled ids count once, odd labels teach nothing, and the sample keeps its bound."""
    rows = toxic_corpus(random.Random(6), 400)
    docs = spark.createDataFrame([r[:2] for r in rows] * 3, "doc_id long, text string")
    docs = docs.unionByName(spark.createDataFrame([(1, f"text {i}") for i in range(2000)], "doc_id long, text string"))
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(r[0], k) for r in rows for k in (-1, 2)], "doc_id long, toxic int")
    met = []
    real = toxicity._featured

    def seen(sample, terms):
        x, y = real(sample, terms)
        met.append(len(y))
        return x, y

    toxicity._featured = seen
    try:
        model = toxicity.train(docs, labels, sample_rows=1000)
    finally:
        toxicity._featured = real
    assert 500 < met[0] <= 1000 and model.trees is not None


def test_toxicity_without_labels(spark):
    docs = docs_of(spark, ["you stupid idiot, pathetic trash", "a fine day", None])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    scores = [r.score for r in toxicity.score(docs, model).orderBy("doc_id").collect()]
    assert scores[0] > 0.3 and scores[1:] == [0, 0]


def test_isotonic_and_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    margin = BoostedTrees(trees=40).fit(x[:1500], y[:1500]).margin(x[1500:])
    assert ((margin > 0) == y[1500:]).mean() > 0.95
    iso = Isotonic().fit(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert iso(np.array([0.0, 1, 2.5, 4, 9])).tolist() == [0, 0, 0.5, 1, 1]


def forward_by_paths(model, ids):
    """The probability of ids as the sum over all paths of states."""
    import itertools

    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(ids)):
        p = model.start[path[0]] * model.emit[path[0], ids[0]]
        for a, b, x in zip(path, path[1:], ids[1:], strict=False):
            p *= model.step[a, b] * model.emit[b, x]
        total += p
    return total


def random_model(rng, k, n):
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hmm.Model(norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, n))))


def test_forward_and_counts():
    rng = np.random.default_rng(3)
    model = random_model(rng, 3, 5)
    texts = [rng.integers(0, 5, n) for n in (1, 6, 2, 6, 4)]
    got = hmm.log_likelihoods(model, texts)
    assert np.allclose(got, [np.log10(forward_by_paths(model, t)) for t in texts])
    start, step, emitted, total = hmm.expected_counts(model, texts)
    assert np.isclose(total, got.sum()) and np.isclose(start.sum(), 5) and np.isclose(step.sum(), sum(len(t) - 1 for t in texts))
    assert np.allclose(emitted.sum(axis=0), np.bincount(np.concatenate(texts), minlength=5))
    # the counts are the derivative of the likelihood with respect to the log of each probability
    eps = 1e-6
    for s, x in ((0, 1), (2, 3)):
        emit = model.emit.copy()
        emit[s, x] *= 1 + eps
        more = hmm.log_likelihoods(hmm.Model(model.start, model.step, emit), texts).sum()
        assert np.isclose((more - got.sum()) * np.log(10) / eps, emitted[s, x], rtol=1e-3)


def test_counts_of_a_block_take_bounded_memory():
    """Texts are read without a copy of their column, and the recursions hold half a million tokens' probabilities, not a block's."""
    rng = np.random.default_rng(5)
    model = random_model(rng, 8, 500)
    model = hmm.Model(*(x.astype(np.float32) for x in (model.start, model.step, model.emit)))
    lengths = [400] * 3000
    column = pa.chunked_array([pa.array([hmm._planes(rng.integers(0, 500, n).astype("<u4")) for n in lengths] + [None], pa.binary())])
    tracemalloc.start()
    _, _, emitted, _ = hmm.expected_counts(model, hmm._texts(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isclose(emitted.sum(), sum(lengths), rtol=1e-4)
    assert peak < 65e6, f"{peak / 1e6:.0f} MB for {sum(lengths)} tokens"


def base_scores(rows):
    counts = Counter()
    for t, train in rows:
        if train:
            counts.update([*hmm.tokens_of((t or "").encode()), hmm.END])
    n, v = sum(counts.values()), len(counts)
    out = []
    for t, _ in rows:
        w = [*hmm.tokens_of((t or "").encode()), hmm.END]
        out.append((len(w), sum(counts[x] > 0 for x in w), n, sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    return out


@pytest.mark.parametrize(("head", "words"), [(1000, 500), (20, 5)])
def test_lm_scores(spark, head, words):
    rng = random.Random(8)
    texts = odd(rng)
    docs = docs_of(spark, texts)
    got = sorted(hmm.score(docs, F.col("doc_id") % 3 != 0, states=3, rounds=2, head_words=head, model_words=words).collect(), key=lambda r: r.doc_id)
    want = base_scores([(t, i % 3 != 0) for i, t in enumerate(texts)])
    for r, w in zip(got, want, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and np.isclose(r.base_score, w[3]) and r.score < 0
        assert r.train == (r.doc_id % 3 != 0)
    same = {}
    for r in got:  # equal token sequences have equal scores
        assert np.isclose(same.setdefault(tuple(hmm.tokens_of((texts[r.doc_id] or "").encode())), r.score), r.score)


def test_lm_learns_emissions_of_rare_words(spark, monkeypatch):
    """Scores do not depend on how many words' emissions are broadcast, nor on blocks and parts."""
    texts = odd(random.Random(8))
    docs = docs_of(spark, texts)
    monkeypatch.setattr(hmm, "GUESS_WORDS", 4)
    monkeypatch.setattr(hmm, "PART_WORDS", 60, raising=False)
    found = [
        {r.doc_id: r.score for r in hmm.score(docs, F.col("doc_id") % 3 != 0, states=3, rounds=2, head_words=head, model_words=words).collect()}
        for head, words in ((1000, 500), (20, 5))
    ]
    assert np.allclose([found[0][i] for i in range(len(texts))], [found[1][i] for i in range(len(texts))], rtol=1e-4)


def test_lm_score_is_a_plain_forward_sum(spark, monkeypatch):
    """The final score against a forward recursion by dictionaries, with the model's own numbers."""
    held = []
    real = hmm.baum_welch

    def seen(*args):
        out = real(*args)
        held[:] = [out[0], args[2], out[1], {(r.block, r.part): bytes(r.sums) for r in out[2].collect()}]
        return out

    monkeypatch.setattr(hmm, "baum_welch", seen)
    texts = odd(random.Random(8))[:70]
    docs = docs_of(spark, texts).coalesce(1)
    got = {r.doc_id: r.score for r in hmm.score(docs, F.col("doc_id") % 3 != 0, states=3, rounds=2).collect()}
    model = held[0]
    counts = Counter()
    for i, t in enumerate(texts):
        if i % 3:
            counts.update([*hmm.tokens_of((t or "").encode()), hmm.END])
    head = hmm.make_head(hmm.count_tokens(docs.filter("doc_id % 3 <> 0")), hmm.HEAD_WORDS, hmm.MODEL_WORDS)
    assert head.words == len(counts) - 1  # every training word is broadcast here
    unseen = 10 / held[2].total / held[2].mass  # one count by the prior, as in _with_rest
    for i, t in enumerate(texts):
        log, alpha = 0.0, None
        for w in [*hmm.tokens_of((t or "").encode()), hmm.END]:
            emit = [float(model.emit[s, head.index[w]]) if w in head.index else float(unseen[s]) for s in range(3)]
            before = model.start if alpha is None else [sum(alpha[r] * model.step[r, s] for r in range(3)) for s in range(3)]
            alpha = [before[s] * emit[s] for s in range(3)]
            scale = sum(alpha)
            alpha, log = [a / scale for a in alpha], log + np.log10(scale)
        assert got[i] == pytest.approx(log, rel=1e-6)
    assert np.allclose(model.emit.sum(axis=1) + 10 * (1 - held[1].sum()) / held[2].mass, 1)


def test_lm_learns_two_kinds_of_texts(spark):
    """States tell two languages apart, so held-out texts score better than by unigrams."""
    rng = random.Random(17)
    kinds = [[f"{c}{i}" for i in range(60)] for c in "xy"]
    texts = [" ".join(rng.choice(kinds[k % 2]) for _ in range(60)) for k in range(300)]
    got = hmm.score(docs_of(spark, texts), F.col("doc_id") % 5 != 0, states=2).filter("not train").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (got[0] - got[1]) / got[2] > 0.2  # at most log10(2) = 0.3


def test_lm_is_a_distribution(spark):
    """Over the vocabulary and one word unseen in each class, one-word continuations sum to 1."""
    texts = ["a b c", "a b", "c c a zz", "b"]
    docs = docs_of(spark, texts)
    counts = hmm.count_tokens(docs.withColumn("train", F.lit(True)))
    head = hmm.make_head(counts, 3, 1)
    assert head.words <= 1
    known = {bytes(r.token): r.c for r in counts.collect()}
    in_model = {t for t, i in head.index.items() if head.ids[i] <= head.words}
    shares = Counter()
    for t, c in known.items():
        if t not in in_model:
            shares[hmm.word_class(t)] += (c + 1) / head.class_total[hmm.word_class(t)]
    for g in range(hmm.CLASSES):
        assert np.isclose(shares[g] + 1 / head.class_total[g], 1)


def test_lm_odd_tables(spark):
    docs = docs_of(spark, [None, "", "x y"])
    none = hmm.score(docs, F.lit(None).cast("boolean")).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in none] == [(1, 0, 0, 0), (1, 0, 0, 0), (3, 0, 0, 0)]
    assert hmm.score(docs.limit(0), F.lit(True)).count() == 0


def test_queries_columns(spark, data):
    from rastra.llm.queries import QUERIES

    found = QUERIES["op6_benchmark_decontamination"](spark, data)
    row = found.filter("n_hit = 0").first()
    assert row.items_sha256 == hashlib.sha256(b"").hexdigest() and row.contaminated is False
    packed = QUERIES["op4_packing"](spark, data).orderBy("doc_id", "start").limit(3).collect()
    text = spark.read.parquet(f"{data}/documents.parquet").filter(F.col("doc_id") == packed[0].doc_id).first().text
    assert packed[0].ids_crc32 == zlib.crc32(np.array(whole_ids(text)[: packed[0].length], "<u4").tobytes())
    toxic = QUERIES["op7_toxicity"](spark, data).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in toxic)


def test_pipeline(spark, data):
    """Each stage of the pipeline keeps what brute force keeps."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(p.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    first = stages["toxicity"](spark, docs, data).cache()
    assert first.columns == docs.columns and 0 < first.count() <= docs.count()
    model = toxicity.train(docs, spark.read.parquet(f"{data}/labels.parquet"), learn_from=F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    every = {r.doc_id: r.text for r in docs.collect()}
    plain = np.array([plain_features(t, model.terms.words, model.terms.starts) for t in every.values()])
    texts = {r.doc_id: r.text for r in first.collect()}
    assert set(texts) == {i for i, x in zip(every, model.score(plain), strict=True) if x < 0.3}
    order = sorted(texts)
    brute = brute_join([texts[i] for i in order])
    second = stages["ngram_jaccard_join"](spark, first, data).cache()
    assert {r.doc_id for r in second.collect()} == {order[i] for i, label, _, _ in brute if i == label}
    third = stages["benchmark_decontamination"](spark, second, data).cache()
    items = [tuple(r) for r in spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect()]
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [words_of((t or "").encode())] for i in range(max(1, len(w) - 9))}
    clean = set()
    for r in second.collect():
        w = words_of((r.text or "").encode())
        if not any(tuple(w[i : i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1)):
            clean.add(r.doc_id)
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == clean
    pieces: dict = {}
    for r in sorted(stages["packing"](spark, third, data).collect(), key=lambda r: (r.doc_id, r.start)):
        assert len(pieces.setdefault(r.doc_id, [])) == r.start
        pieces[r.doc_id] += np.frombuffer(bytes(r.token_ids), "<u4").tolist()
    assert pieces == {i: whole_ids(texts[i]) for i in clean}
    assert p.run(spark, data).select("doc_id").distinct().count() == len(clean)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls, empties, repeats, clashing columns, and tables without rows, through all stages."""
    import corpus_pipeline as p

    rng = random.Random(21)
    a, b, bench = prose(rng, 40), prose(rng, 40), prose(rng, 30)
    rows = [(1, a), (1, a), (1, b), (2, a + " more"), (None, a), (None, None), (3, None), (4, ""), (5, "!?"), (6, f"{prose(rng, 20)} {bench} {prose(rng, 20)}"), (7, "you stupid idiot, pathetic trash scum"), (8, prose(rng, 5000)), (8, prose(rng, 3))]
    schema = "doc_id long, text string, th string, key int, label string, spans int, score double, `sequence id` int"
    docs = spark.createDataFrame([(*r, "t", 1, "l", 2, 0.5, 3) for r in rows], schema)
    benchmark = spark.createDataFrame([(1, bench), (None, None), (2, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("benchmark", benchmark), ("labels", labels)):
        df.write.parquet(f"{tmp_path}/full/{name}.parquet")
        df.limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    now = docs
    kept = []
    for _, stage in p.STAGES[:3]:
        now = materialize(stage(spark, now, f"{tmp_path}/full"), "stage")
        assert now.schema.simpleString() == docs.schema.simpleString()
        kept.append(sorted((str(r.doc_id), (r.text or "")[:20]) for r in now.collect()))
    key = lambda chosen: sorted((str(i), (t or "")[:20]) for i, t in chosen)
    assert kept[0] == key(r for r in rows if r[0] != 7)
    joined = [(1, a), (1, b), *(r for r in rows if r[0] in (None, 3, 4, 5, 6, 8))]
    assert kept[1] == key(joined) and kept[2] == key(r for r in joined if r[0] != 6)
    packed = p.run(spark, f"{tmp_path}/full")
    assert packed.select("doc_id", "doc_tokens").distinct().count() >= 7 and packed.filter("start = 0").count() == len(joined) - 1
    assert p.run(spark, f"{tmp_path}/none").count() == 0
