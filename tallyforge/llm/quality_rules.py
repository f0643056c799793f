"""Quality rules: repetition rules and divergence from the language's usual text.

Each document has two histograms: the shares of eight character classes, and the
shares of its language's ten most common words. Their Jensen-Shannon distances
(base 2, from 0 to 1) to the usual histograms of that language decide, beside two
plain rules on length and repetition. Short documents are not judged by
histograms, as theirs are noise.

What is usual comes from medians over the language's distinct texts, which junk
does not move onto itself while it is the lesser part.

Everything here is DataFrame functions that run in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import SPACE, few, staged, words

#: Character classes, taken off the text in turn; what is left over is the last class.
CLASSES = (
    ("lower", "[a-z]+"),
    ("space", f"[{SPACE}]+"),
    ("upper", "[A-Z]+"),
    ("digit", "[0-9]+"),
    ("mark", r"[.,;:!?'\"()-]+"),
    ("symbol", "[#*$%&|<>]+"),
    ("wide", "[^\\x00-\\x7F]+"),
)

#: The most common words of each language.
COMMON = {
    "de": "der die und in den von zu das mit sich".split(),
    "en": "the of and to in a is that for it".split(),
    "es": "de la que el en y a los se del".split(),
    "fr": "de la le et les des en un du une".split(),
}

#: Rules and limits. Histograms are compared from so many words on, and a reference stands on so many documents at least.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
CLASS_LIMIT = 0.30
WORD_LIMIT = 0.25
GUARD_WORDS = 50
GUARD_WORDS_COMMON = 200
GUARD_DOCS = 20
#: The common-word limit for texts of fewer than GUARD_WORDS_COMMON words, wider as their shares are noisier.
SHORT_WORD_LIMIT = 0.27


def _dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    lines = F.array_remove(F.split(F.regexp_replace(text, r"(?dm)^[\x20\x09\x0B-\x0D]+$", ""), "\n"), "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


#: Up to so many distinct repeated windows are looked up in a list, more of them by sorting.
LISTED = 32


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: the words that lie in a 3-word window found twice or more in ``ws``.

    Windows are told apart by 64-bit hashes, which are sorted to see which repeat.
    The places of the repeating ones come from a look-up of each window in their
    list; where that list is long, from sorting (hash, place) instead, so the work
    is n log n in the length of a text, whatever repeats.
    """
    ws, grams, order, twice, pairs = (F.col(c) for c in ("ws", "grams", "sorted", "twice", "pairs"))
    hashes = F.transform(ws, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))
    df = df.withColumn("grams", F.slice(hashes, 1, F.greatest(F.size(ws) - 2, F.lit(0)))).drop("ws")
    df = df.withColumn("sorted", F.sort_array(grams))
    df = df.withColumn("twice", F.array_distinct(F.filter(order, lambda x, i: x == F.get(order, i + 1)))).drop("sorted")
    df = df.withColumn("pairs", F.when(F.size(twice) > LISTED, F.sort_array(F.arrays_zip(grams.alias("h"), F.sequence(F.lit(0), F.size(grams) - 1).alias("p")))))
    twin = lambda x, j: (x["h"] == F.get(pairs, j - 1)["h"]) | (x["h"] == F.get(pairs, j + 1)["h"])
    listed = F.transform(F.filter(F.transform(grams, lambda g, i: F.when(F.array_contains(twice, g), i)), lambda p: p.isNotNull()), lambda p: p)
    places = F.when(F.size(twice) == 0, F.array().cast("array<int>")).when(pairs.isNull(), listed).otherwise(F.transform(F.filter(pairs, twin), lambda x: x["p"]))
    df = df.withColumn("again", places).drop("grams", "twice", "pairs")
    covered = F.array_distinct(F.concat(F.col("again"), F.transform("again", lambda p: p + 1), F.transform("again", lambda p: p + 2)))
    return df.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("again")


def features(docs: DataFrame) -> DataFrame:
    """A narrow row for each document: the base counts and two histograms, from one pass over the text.

    ``chars`` has a share for each class and the rest; ``common`` one for each
    common word of the language and the rest, null where the language has no list.
    What generated code can do comes first, and texts are dropped before the rest.
    """
    df = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t0"))
    for i, (_, pattern) in enumerate(CLASSES):
        df = df.withColumn(f"t{i + 1}", F.regexp_replace(f"t{i}", pattern, ""))
    n, m = len(CLASSES), len(next(iter(COMMON.values())))
    listed = F.coalesce(*[F.when(F.col("lang") == lang, F.array(*map(F.lit, most))) for lang, most in COMMON.items()], F.array().cast("array<string>"))
    df = df.withColumn("ws", words(F.col("t0")))
    at = {name: i for i, (name, _) in enumerate(CLASSES)}
    counts = [F.length(f"t{i}") - F.length(f"t{i + 1}") for i in range(n)] + [F.length(f"t{n}")]
    total = F.greatest(F.length("t0"), F.lit(1)).cast("double")
    # Longer chains of loops in one generated method would pass the size up to which the JVM compiles it.
    df = df.select(
        "doc_id",
        "lang",
        "ws",
        listed.alias("listed"),
        F.size("ws").cast("long").alias("n_words"),
        (F.length("t0") - counts[at["space"]]).cast("long").alias("word_chars"),
        counts[at["symbol"]].cast("long").alias("n_symbols"),
        _dup_lines(F.col("t0")).alias("n_dup_lines"),
        F.array(*[c / total for c in counts]).alias("chars"),
    )
    # Words as places in the list of their language, 0 for others; with one of each place put in, sorted places tell the counts.
    df = df.withColumn("which", F.sort_array(F.concat(F.transform("ws", lambda w: F.array_position(F.col("listed"), w)), F.sequence(F.lit(0).cast("long"), F.lit(m + 1).cast("long"))))).drop("listed")
    first = [F.array_position("which", F.lit(k).cast("long")) for k in range(m + 2)]
    some = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    common = [(first[k + 1] - first[k] - 1) / some for k in [*range(1, m + 1), 0]]
    df = df.withColumn("common", F.when(F.col("lang").isin(*COMMON), F.array(*common))).drop("which")
    return with_repeats(df)


def _xlog(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)


def js_distance(p: Column, q: Column) -> Column:
    """The square root of the Jensen-Shannon divergence to base 2 of two arrays of shares."""
    terms = F.zip_with(p, q, lambda x, y: _xlog(x, (x + y) / 2) + _xlog(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2))


def _distances(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """``rows`` with class_distance and word_distance to the references of their language; null where there is none to ask."""
    out = rows.join(few(refs), "lang", "left")
    out = out.withColumn("class_distance", F.when(F.col("n_words") >= GUARD_WORDS, js_distance(F.col("chars"), F.col("ref_chars"))))
    return out.withColumn("word_distance", F.when(F.col("n_words") >= GUARD_WORDS, js_distance(F.col("common"), F.col("ref_common"))))


def _odd() -> Column:
    limit = F.when(F.col("n_words") < GUARD_WORDS_COMMON, SHORT_WORD_LIMIT).otherwise(WORD_LIMIT)
    return F.coalesce(F.col("class_distance") > CLASS_LIMIT, F.lit(False)) | F.coalesce(F.col("word_distance") > limit, F.lit(False))


def _references(rows: DataFrame, one) -> DataFrame:
    """lang, n_docs and two histograms of ``rows``, whose shares the aggregate ``one`` makes; common words from long texts only."""
    n, m = len(CLASSES) + 1, len(next(iter(COMMON.values()))) + 1
    long = F.col("n_words") >= GUARD_WORDS_COMMON
    chars, common = [one(F.get("chars", F.lit(i))) for i in range(n)], [one(F.when(long, F.get("common", F.lit(i)))) for i in range(m)]
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.array(*chars).alias("ref_chars"), F.array(*common).alias("ref_common"))


def _scaled(shares: Column) -> Column:
    total = F.greatest(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x), F.lit(1e-9))
    return F.transform(shares, lambda x: x / total)


def _usual(rows: DataFrame) -> DataFrame:
    """References that the lesser part of a language's distinct texts can't move far.

    Medians share by share come first; the references are the means over the
    texts that the tests keep against those, so junk has no part in them.
    Medians are of shares to four places, so each stands on 10,001 counts at most.
    """
    each = staged(rows.select("lang", "chars", "common", "n_words", "word_chars").distinct(), "quality-texts")
    middle = _references(each, lambda c: F.percentile(F.round(c, 4), F.lit(0.5))).filter(F.col("n_docs") >= GUARD_DOCS)
    middle = staged(middle.withColumns({c: _scaled(F.col(c)) for c in ("ref_chars", "ref_common")}), "quality-medians")
    near = _references(_distances(each.join(few(middle.select("lang")), "lang", "left_semi"), middle).filter(~_odd()).drop("n_docs", "ref_chars", "ref_common"), F.avg)
    near = near.select("lang", F.col("ref_chars").alias("near_chars"), F.col("ref_common").alias("near_common"))
    pick = lambda a, b: F.when(F.get(a, F.lit(0)).isNotNull(), F.col(a)).otherwise(F.col(b))
    return middle.join(near, "lang", "left").select("lang", "n_docs", pick("near_chars", "ref_chars").alias("ref_chars"), pick("near_common", "ref_common").alias("ref_common"))


def verdicts(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, the counts, the distances, base_failed and kept.

    base_failed: fewer than MIN_WORDS words, or over half of the words in
    repeated 3-word windows. Of the rest a document goes if its class distance is
    over CLASS_LIMIT or its common-word distance over WORD_LIMIT, below
    GUARD_WORDS_COMMON words over SHORT_WORD_LIMIT. Distances are null, and then
    decide nothing, for a null or rare language (fewer than GUARD_DOCS distinct
    texts that a reference can stand on), for common words also where the
    language has no list. A null text has no words and fails. Repeated rows are
    judged alike. An empty table gives no rows. Only doc_id, lang and text are read.
    """
    rows = staged(features(docs), "quality")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    sound = rows.filter(~F.col("base_failed") & (F.col("n_words") >= GUARD_WORDS) & F.col("lang").isNotNull())
    out = _distances(rows, staged(_usual(sound), "quality-refs"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", (~F.col("base_failed") & ~_odd()).alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; rows of one doc_id stay or go by their own text."""
    # The verdict of a row is found by id and length counts, so repeated ids with other texts don't mix.
    judged = verdicts(docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "lang", "text"))
    gone = judged.filter(~F.col("kept")).select(F.col("doc_id.doc_id").alias("__id"), F.col("doc_id.h").alias("__h")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (F.xxhash64(docs["text"]) == gone["__h"]), "left_anti")
