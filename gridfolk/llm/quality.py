"""Quality rules: counts of a text, and how far its histograms are from its language's.

For every language two references are summed over all documents that pass
the base rules: how often each class of characters occurs, and how often each
of the language's most common words does, against all its words. Such words
are runs of letters of any script, in lower case. A document is judged by the
Jensen-Shannon distance (square root of the divergence to base 2, 0 to 1)
between its own histograms and the references.

DataFrame functions only; texts are never shuffled.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linededup import WHITE, let
from .staging import staged

#: Classes of characters, each counted in what the classes before it left; what is in none is the last class.
CLASSES = ("abcdefghijklmnopqrstuvwxyz", WHITE, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?'\"()-", "#*$%&|<>")
WHITE_CLASS, SYMBOLS_CLASS = 1, 5
#: Common words kept for each language.
COMMON = 20
#: By default a document farther than this from its reference is rejected, if it has so many words.
CLASS_DISTANCE, CLASS_WORDS = 0.30, 50
WORD_DISTANCE, WORD_WORDS = 0.27, 100
NO_LETTERS = "[^\\p{L}]+"
#: Bits of a packed long that hold the place of a window in its text.
PLACE_BITS = 24


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none for null or blank text."""
    plain = F.coalesce(text, F.lit(""))
    for white in WHITE[1:]:
        plain = F.replace(plain, F.lit(white), F.lit(" "))
    return F.array_remove(F.split(plain, " ", -1), "")


def repeated_words(words: Column, grams: Column) -> Column:
    """Words in windows of three that are found twice or more; each word counts once. ``grams``: a hash of each window."""

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.when(j == F.size(at) - 1, 3).otherwise(F.least(F.lit(3), F.get(at, j + 1) - p)))
        return F.aggregate(steps, F.lit(0), lambda a, s: a + s)

    def places(s: Column) -> Column:
        same = F.filter(s, lambda x, j: (F.get(s, j - 1)["g"] == x["g"]) | (F.get(s, j + 1)["g"] == x["g"]))
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def maybe(s: Column) -> Column:
        """Places of windows whose leading bits another window has, too, found by sorting longs of these bits and the place."""
        near = lambda x, y: F.coalesce(F.shiftrightunsigned(x.bitwiseXOR(y), PLACE_BITS) == 0, F.lit(False))
        same = F.filter(s, lambda x, j: near(F.get(s, j - 1), x) | near(F.get(s, j + 1), x))
        return F.transform(same, lambda x: x.bitwiseAND((1 << PLACE_BITS) - 1).cast("int"))

    packed = F.transform(grams, lambda g, i: F.shiftleft(F.shiftrightunsigned(g, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long")))
    few = let(F.sort_array(packed), maybe)
    candidates = F.when(F.size(grams) < 1 << PLACE_BITS, few).otherwise(F.sequence(F.lit(0), F.size(grams) - 1))
    placed = F.sort_array(F.transform(candidates, lambda i: F.struct(F.get(grams, i).alias("g"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(let(let(placed, places), covered))


def common_words(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """``_lang`` and ``_common``, the most frequent words of all texts of each language (ties by word)."""
    word = docs.select(F.col(lang).alias("_lang"), F.explode(F.split(F.lower(text), NO_LETTERS)).alias("_word")).filter("_word != ''")
    counts = word.groupBy("_lang", "_word").count()
    ranked = counts.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("count"), "_word"))).filter(F.col("_rank") <= COMMON)
    return ranked.groupBy("_lang").agg(F.array_sort(F.collect_list("_word")).alias("_common"))


def distance(own: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms; null if one is empty."""

    def shares(h: Column) -> Column:
        return let(F.aggregate(h, F.lit(0.0), lambda a, x: a + x), lambda s: F.transform(h, lambda x: x / s))

    def term(p: Column, q: Column) -> Column:
        half = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / half)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / half)).otherwise(0.0)

    filled = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x) > 0
    divergence = F.aggregate(F.zip_with(shares(own), shares(reference), term), F.lit(0.0), lambda a, x: a + x) / 2
    return F.when(filled(own) & filled(reference), F.sqrt(F.greatest(F.lit(0.0), divergence)))


def measured(docs: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """The base counts and both histograms of every row; no text any more.

    Each step is a column that is used more than once, so that it is computed
    once and compiled.
    """
    common = F.broadcast(common_words(docs, text, lang))  # a short row for each language; a language is a code, not a text
    rows = docs.select(F.col(key).alias("_key"), F.col(lang).alias("_row_lang"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = rows.join(common, F.col("_row_lang").eqNullSafe(F.col("_lang")), "left").drop("_lang").withColumnRenamed("_row_lang", "_lang")
    rows = rows.withColumns({"_chars": F.length("_t"), "_left0": F.regexp_replace("_t", f"[{CLASSES[0]}]+", "")})
    for k, letters in enumerate(CLASSES[1:], 1):  # what is left is short from the first class on
        rows = rows.withColumn(f"_left{k}", F.translate(f"_left{k - 1}", letters, ""))
    upto = [F.col("_chars"), *(F.length(f"_left{k}") for k in range(len(CLASSES)))]
    classes = [*(a - b for a, b in pairwise(upto)), upto[-1]]
    lines = F.filter(F.split("_t", "\n", -1), lambda x: F.ltrim(x, F.lit(WHITE)) != "")
    spaced = F.btrim(F.regexp_replace(F.lower("_t"), NO_LETTERS, " "))
    rows = rows.select(
        "_key", "_lang", "_common", F.array(*(c.cast("double") for c in classes)).alias("_classes"), words_of(F.col("_t")).alias("_words"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), spaced.alias("_letters"),
    )
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    grams = F.when(F.size("_words") >= 4, F.transform(F.sequence(F.lit(0), F.size("_words") - 3), window)).otherwise(F.array().cast("array<bigint>"))
    apart = F.concat(F.lit(" "), F.replace("_letters", F.lit(" "), F.lit("  ")), F.lit(" "))
    rows = rows.withColumns({"_grams": grams, "_apart": apart, "_n_letters": F.when(F.col("_letters") == "", 0).otherwise(F.octet_length(apart) - F.octet_length("_letters") - 1)})
    hits = F.transform("_common", lambda w: (F.octet_length("_apart") - F.octet_length(F.replace("_apart", F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.octet_length(w) + 2.0))
    rows = rows.withColumn("_hits", F.coalesce(hits, F.array().cast("array<double>")))
    rest = F.col("_n_letters") - F.aggregate("_hits", F.lit(0.0), lambda a, x: a + x)
    word_chars = F.aggregate("_classes", F.lit(0.0), lambda a, x: a + x) - F.get("_classes", F.lit(WHITE_CLASS))
    rows = rows.select(
        "_key", "_lang", F.size("_words").cast("long").alias("n_words"), word_chars.cast("long").alias("word_chars"),
        F.get("_classes", F.lit(SYMBOLS_CLASS)).cast("long").alias("n_symbols"), "n_dup_lines",
        repeated_words(F.col("_words"), F.col("_grams")).cast("long").alias("n_repeat_words"), "_classes", F.concat("_hits", F.array(rest)).alias("_hits"),
    )
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def references(rows: DataFrame) -> DataFrame:
    """Both histograms summed over the documents of each language that pass the base rules."""
    good = rows.filter("not base_failed")

    def summed(column: str, alias: str) -> DataFrame:
        each = good.select("_lang", F.posexplode(column).alias("_i", "_x")).groupBy("_lang", "_i").agg(F.sum("_x").alias("_x"))
        return each.groupBy("_lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(alias))

    a, b = summed("_classes", "_class_reference"), summed("_hits", "_word_reference").withColumnRenamed("_lang", "_other")
    return a.join(b, F.col("_lang").eqNullSafe(F.col("_other"))).drop("_other").withColumnRenamed("_lang", "_reference_lang")


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", class_limit=(CLASS_DISTANCE, CLASS_WORDS), word_limit=(WORD_DISTANCE, WORD_WORDS)) -> DataFrame:
    """One row for each document: the key, counts, base_failed, class_distance, word_distance and kept.

    Null text counts as empty and fails the base rules. A distance is null,
    and rejects nothing, where a histogram is empty or its language has no
    document that passes the base rules; each has its own minimum number of
    words. A null language is a language of its own. Repeated rows are judged
    alike; other columns are ignored; an empty table gives an empty table.
    """
    rows = staged(measured(docs, key, text, lang))
    found = rows.join(F.broadcast(references(rows)), F.col("_lang").eqNullSafe(F.col("_reference_lang")), "left")  # two short rows for each language
    found = found.withColumns({"class_distance": distance(F.col("_classes"), F.col("_class_reference")), "word_distance": distance(F.col("_hits"), F.col("_word_reference"))})
    (class_most, class_words), (word_most, word_words) = class_limit, word_limit
    far = ((F.col("class_distance") > class_most) & (F.col("n_words") >= class_words)) | ((F.col("word_distance") > word_most) & (F.col("n_words") >= word_words))
    kept = ~F.col("base_failed") & ~F.coalesce(far, F.lit(False))
    return found.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", kept.alias("kept"))


def keep_good(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows that the rules keep, with their own columns. Rows of one key are kept if one of them is; rows without a key go by the verdict on null keys."""
    kept = judge_quality(docs, key).filter("kept").select(F.col(key).alias("_kept")).distinct()
    return docs.join(kept, F.col(key).eqNullSafe(F.col("_kept")), "left_semi")
