"""SpotSigs fingerprints with built-in functions only.

A spot is an anchor, a very common or very short word, and its signature the
chain of the next content words; between them further anchors are skipped.
Where common words are rare, as in tables and in short texts, other words are
anchors of themselves: those that begin six content words without an anchor,
and the first ``SHORT`` words of a text. All of these depend on a word's
neighbours alone, so a change at one place leaves the signatures of others. A
text's fingerprint is the set of its signatures' hashes, so it is about as long
as the text. Two texts are alike as the Jaccard similarity of their sets.

For the join, sets are partitioned by their length: lengths form geometric
bins, and a set meets only its own and the next bins that the threshold allows.
Within these it is compared only with sets that share one of its rarest
signatures (prefix filtering), since others cannot reach the threshold.
"""

from __future__ import annotations

import math
from fractions import Fraction

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rastra.operators.ranges import range_of, range_starts

#: Common words of four languages that serve as anchors, beside all words of one or two characters.
ANCHORS = (
    "the and that for with was are this from have has not you his her they which but were been their all its had who will "
    "der die und das den von mit sich des auf für ist dem nicht ein eine als auch werden aus hat dass sie nach wird bei einer "
    "les des une que qui dans pour par sur pas plus sont avec est aux ont ses cette mais nous vous "
    "los las del una por con para como más pero sus este entre cuando muy sin sobre también"
).split()
CHAIN = 3
#: Content words without an anchor of which the first becomes one, and words at a text's beginning that all are.
STRETCH, SHORT = 6, 30
_MARK = "\u0001"


def _alternatives(words: list[str]) -> str:
    """The words as a pattern that branches by the first letter."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for c, rest in sorted(by.items()))


# No group repeats without bound: Java's regular expressions take a stack frame for each turn of one.
_ANCHOR = rf" (?:[^ ]{{1,2}}|{_alternatives([w for w in ANCHORS if len(w) > 2])})(?= )"
_CONTENT = rf"{_MARK}* [^ {_MARK}]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signatures(text: Column) -> Column:
    """Sorted distinct 32-bit hashes of a text's signatures.

    Where there are too few words for a chain, they are the one signature
    together. A null, empty or wordless text has none.
    """
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    every = lambda t, pattern: F.regexp_extract_all(t, F.lit(pattern), F.lit(1))
    content = rf"(?: [^ {_MARK}]+)"

    def chains(w: Column) -> Column:
        head = F.concat(F.regexp_extract(w, rf"^((?: [^ ]+){{0,{SHORT}}})", 1), F.lit(" "))
        marked = F.regexp_replace(w, F.lit(_ANCHOR), F.lit(_MARK))
        spots = _let(marked, lambda m: F.concat(
            every(m, f"{_MARK}(?!{_MARK})(?=((?:{_CONTENT}){{{CHAIN}}}))"),
            every(m, f"(?=({content}{{{CHAIN}}}){content}{{{STRETCH - CHAIN}}})"),
        ))
        return F.concat(spots, every(head, f"(?= ((?:[^ ]+ ){{{CHAIN}}}))"))

    def hashes(w: Column) -> Column:
        found = _let(chains(w), lambda c: F.when(F.size(c) > 0, c).otherwise(F.array(w)))
        hashed = F.array_sort(F.array_distinct(F.transform(found, lambda x: F.hash(x))))
        return F.when(F.length(w) > 2, hashed).otherwise(F.array().cast("array<int>"))

    return _let(words, hashes)


def fingerprint(signs: Column) -> Column:
    """The set as text: hexadecimal hashes in order, by full stops. Equal texts have equal ones."""
    return F.array_join(F.transform(signs, lambda x: F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    either = F.size(a) + F.size(b) - common
    return F.when(either > 0, common / either).otherwise(F.lit(1.0))


#: Rows of a bucket of neighbouring ids, about, and buckets at most: 100 TB have some 400 MB in each.
BUCKET_ROWS, MAX_BUCKETS = 2000, 262_144


def with_next(docs: DataFrame, text: str, derived: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, the text and columns derived from it, with those of the next row by ascending doc_id as next_<column>.

    After the last row comes the first. Rows are dealt to buckets of
    neighbouring ids and sorted within them, so that no task orders the whole
    table. Buckets begin where Spark's range partitioning of ids and hashes of
    texts says, so they are alike in size whatever the ids look like; ids may be
    of any type that sorts, repeated or null. Null ids come first, rows of one id
    go by their texts' hashes. Only rows that are equal in id and text cannot be
    parted. A bucket's last row gets its successor from a copy of the following
    bucket's first row; there is one for each bucket.
    """
    derived = derived or {}
    rows = docs.select("doc_id", text, F.xxhash64(text).alias("th"))
    order = ["doc_id", "th"]
    starts = range_starts(rows, order, min(MAX_BUCKETS, max(1, -(-docs.count() // BUCKET_ROWS))))
    kinds = [T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("th", T.LongType()), T.StructField("bucket", T.IntegerType())]
    heads = docs.sparkSession.createDataFrame([(r.doc_id, r.th, (k or len(starts)) - 1) for k, r in enumerate(starts)], T.StructType(kinds))
    first = rows.join(F.broadcast(heads.alias("h")), rows["doc_id"].eqNullSafe(F.col("h.doc_id")) & (rows["th"] == F.col("h.th")))
    copies = first.groupBy("bucket").agg(*(F.first(rows[c]).alias(c) for c in ("doc_id", text, "th")))
    dealt = rows.withColumns({"bucket": range_of(rows, order, starts).cast("int"), "copied": F.lit(0)}).unionByName(copies.withColumn("copied", F.lit(1)))
    near = Window.partitionBy("bucket").orderBy("copied", F.col("doc_id").asc_nulls_first(), "th")
    out = dealt.withColumns(derived)
    names = [text, *derived]
    return out.withColumns({f"next_{c}": F.lead(c).over(near) for c in names}).filter("copied = 0").select("doc_id", *names, *(f"next_{c}" for c in names))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness.

    The edited text has the last floor(n_chars / 4) characters replaced by the
    first as many (or all) of the next document's. Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts count as empty. An empty set's fingerprint is empty, and two such
    are alike by 1. Repeated rows and null ids are rows like others, and ids
    may be of any type that sorts; with one row the next document is itself. An
    empty table gives no rows. Other columns are ignored. A text's signatures
    are made once and go with it to the row before.
    """
    own = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    pairs = with_next(own, "text", {"signs": signatures(F.col("text"))})
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    told = pairs.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "signs", "next_signs")
    told = told.select("*", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), signatures(F.col("edited")).alias("edited_signs"))
    return told.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("signs")).alias("fingerprint"), fingerprint(F.col("edited_signs")).alias("edited_fingerprint"),
        likeness(F.col("signs"), F.col("edited_signs")).alias("near_edited"), likeness(F.col("signs"), F.col("next_signs")).alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: str = "0.8", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs a < b of fingerprint classes alike by at least the threshold, with their likeness.

    Documents of equal fingerprints are one class, which its least id stands
    for, so copies never make pairs. A pair meets where both have a signature
    among their rarest ones and their lengths' ratio allows it. Texts without
    signatures and null ids have no pairs.
    """
    t = Fraction(threshold)
    ratio = float(t)
    signed = docs.select(docs[id_col].alias("id"), signatures(docs[text_col]).alias("s")).filter("id is not null and size(s) > 0")
    classes = signed.groupBy("s").agg(F.min("id").alias("id")).select("id", "s", F.size("s").alias("n"))
    step = -math.log(ratio)
    spots = classes.select("id", "n", F.explode("s").alias("x"))
    order = Window.partitionBy("id").orderBy("met", "x")
    common = spots.groupBy("x").agg(F.count("*").alias("met"))
    ranked = spots.join(common, "x").withColumn("k", F.row_number().over(order))
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(ratio)) + 1
    heads = ranked.filter((F.col("k") <= prefix) & (F.col("met") > 1)).withColumn("bin", F.floor(F.log(F.col("n")) / F.lit(step)))
    left = heads.select(F.col("id").alias("a"), F.col("n").alias("na"), "x", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    right = heads.select(F.col("id").alias("b"), F.col("n").alias("nb"), "x", "bin")
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") * t.denominator >= F.greatest("na", "nb") * t.numerator)
    met = left.join(right, ["x", "bin"]).filter(near).select("a", "b").distinct()
    sets = classes.select("id", "s")
    out = met.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness"))
    return out.filter(F.col("likeness") >= ratio - 1e-12)
