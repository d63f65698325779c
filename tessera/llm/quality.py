"""Quality rules: distribution divergence from language references. DataFrame functions only.

A document's histogram of character classes and its histogram of common words (each common word, and
all others together) are held against those
of its language, which are summed over all documents of that language. The Jensen-Shannon distance
(square root of the divergence, base 2) to either reference must stay under a limit. Documents that are
too short for a histogram, and languages with too little text for a reference, pass this guard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, SPACE_CLASS, materialize

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20

#: The most common words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to a in is it that was for on",
    "der die und in den von zu das mit sich des auf",
    "de la le et les des en un du une que est",
    "de la que el en y a los se del las un",
)
WORDS = tuple(dict.fromkeys(" ".join(COMMON_WORDS).split()))
CLASSES = ("lower", "upper", "digit", "space", "symbol", "punctuation", "other")

MIN_CHARS, MIN_COUNTED = 200, 100
MIN_REFERENCE_CHARS = 10_000
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.26


def _removed(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, pattern, "")


def words(text: Column) -> Column:
    """The words of a text: an empty array for null and for white space alone."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_CLASS + "+"))


def repeat_words(array: Column, window: int = REPEAT_WINDOW) -> Column:
    """Words in windows that come twice or more in the array; windows are compared by a 64-bit hash.

    Only a document with a repeated window pays for sorting: its windows are ordered by hash and place,
    the places of equal neighbours are put in order, and each adds the words up to the next one.
    """
    hashes = F.transform(array, lambda w: F.xxhash64(w))
    last = F.size(array) - window
    keyed = lambda h: F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))

    def covered(keys: Column) -> Column:
        ordered = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return F.aggregate(
            F.array(ordered), F.lit(0).cast("long"),
            lambda _, s: F.aggregate(
                F.array(F.array_sort(F.transform(F.filter(F.transform(s, lambda x, n: F.struct(x["i"].alias("i"), ((x["k"] == F.get(s, n - 1)["k"]) | (x["k"] == F.get(s, n + 1)["k"])).alias("hit"))), lambda x: F.coalesce(x["hit"], F.lit(False))), lambda x: x["i"]))),
                F.lit(0).cast("long"),
                lambda _, p: F.aggregate(F.transform(p, lambda x, n: F.least(F.coalesce(F.get(p, n + 1) - x, F.lit(window)), F.lit(window))), F.lit(0).cast("long"), lambda a, b: a + b),
            ),
        )

    def counted(keys: Column) -> Column:
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(covered(keys))

    inner = F.aggregate(F.array(hashes), F.lit(0).cast("long"), lambda _, h: F.aggregate(F.array(keyed(h)), F.lit(0).cast("long"), lambda _, k: counted(k)))
    return F.when(last < 0, F.lit(0).cast("long")).otherwise(inner)


def features(docs: DataFrame) -> DataFrame:
    """A row for each document: the base columns, class counts and common-word counts. Reads each text once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text.alias("text"))
    step = base.select("doc_id", "lang", "text", words(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"), _removed(F.col("text"), "[a-z]+").alias("rest"))
    step = step.select("*", _removed(F.col("rest"), SPACE_CLASS + "+").alias("dark"))
    step = step.select("*", _removed(F.col("dark"), "[A-Z]+").alias("d1"))
    step = step.select("*", _removed(F.col("d1"), "[0-9]+").alias("d2"))
    step = step.select("*", _removed(F.col("d2"), r"[#*$%&|<>]+").alias("d3"))
    step = step.select("*", _removed(F.col("d3"), r"[!-/:-@\[-`{-~]+").alias("d4"))
    length = lambda c: F.length(c).cast("long")
    lines = F.filter("lines", lambda line: F.btrim(line, F.lit(SPACE)) != "")
    common = F.filter(F.transform("words", F.lower), lambda w: w.isin(*WORDS))
    return step.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"),
        (length("text") - (length("rest") - length("dark"))).alias("word_chars"),
        (length("d2") - length("d3")).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        F.array(length("text") - length("rest"), length("d1") * 0 + length("dark") - length("d1"), length("d1") - length("d2"), length("rest") - length("dark"), length("d2") - length("d3"), length("d3") - length("d4"), length("d4")).alias("classes"),
        F.aggregate(F.array(common), F.array(*[F.lit(0).cast("long") for _ in range(len(WORDS) + 1)]), lambda _, c: F.array(*[(F.size(c) - F.size(F.array_remove(c, w))).cast("long") for w in WORDS], (F.size("words") - F.size(c)).cast("long"))).alias("common"),
    )


def references(found: DataFrame) -> DataFrame:
    """The summed histograms of each language, over all documents: a row for each language."""
    sums = [F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(len(CLASSES))] + [F.sum(F.col("common")[k]).alias(f"w{k}") for k in range(len(WORDS) + 1)]
    return found.groupBy("lang").agg(*sums).select("lang", F.array(*[f"c{k}" for k in range(len(CLASSES))]).alias("ref_classes"), F.array(*[f"w{k}" for k in range(len(WORDS) + 1)]).alias("ref_common"))


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts; null where either sums to 0."""
    n, m = total(p).cast("double"), total(q).cast("double")

    def part(a: Column, b: Column) -> Column:
        half = (a + b) / 2
        return F.when(a > 0, a * F.log2(a / half)).otherwise(0.0) + F.when(b > 0, b * F.log2(b / half)).otherwise(0.0)

    # the histograms are made once for a document, not once for each bin
    terms = F.aggregate(F.array(F.struct(n.alias("n"), m.alias("m"))), F.lit(0.0), lambda _, s: F.aggregate(F.zip_with(p, q, lambda a, b: part(a / s["n"], b / s["m"])), F.lit(0.0), lambda a, b: a + b))
    return F.when((n > 0) & (m > 0), F.sqrt(F.greatest(terms / 2, F.lit(0.0))))


def judge(docs: DataFrame, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_counted: int = MIN_COUNTED) -> DataFrame:
    """Judges every whole text: base columns, base_failed, kept, and both distances.

    Null text has no words, so the base rule drops it; a null language is a language of its own; a
    document under `min_chars` characters isn't held to the class limit, one under `min_counted` words
    not to the word limit. Repeated rows all stay; an empty table gives no rows.
    """
    found = materialize(features(docs), "quality")
    joined = found.join(references(found), "lang")
    measured = joined.select(
        "*", distance(F.col("classes"), F.col("ref_classes")).alias("class_distance"), distance(F.col("common"), F.col("ref_common")).alias("word_distance"),
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
    )
    far = lambda d, own, least, limit, ref: (total(F.col(own)) >= least) & (total(F.col(ref)) >= MIN_REFERENCE_CHARS // (1 if own == "classes" else 10)) & F.coalesce(F.col(d) > limit, F.lit(False))
    bad = far("class_distance", "classes", min_chars, max_class, "ref_classes") | far("word_distance", "common", min_counted, max_word, "ref_common")
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~bad).alias("kept"), F.round("class_distance", 9).alias("class_distance"), F.round("word_distance", 9).alias("word_distance"))
