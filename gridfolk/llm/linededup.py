"""Delete later copies of repeated runs of lines, found by winnowing.

Lines, cut again after the ends of sentences, are the units; a unit's hash
ignores white space around it. Hashes of two neighbouring units are the
grams, and the smallest of every three neighbouring grams is a fingerprint.
So any run of four units that occurs twice has a fingerprint that occurs
twice, and only about half of the grams are ever shuffled. Around each
fingerprint that occurs again, the match is extended to the left and right
over all four-unit windows that chose it; windows with an earlier equal are
joined into maximal runs, which are deleted.

Passages of one to three units have windows of their own: from each unit, and
up to each unit, the shortest run of at most three that has ``LEAST`` words.
These are not winnowed. So every repeat of whole units with ``LEAST`` words in
all is found; the words of a repeat in units that it only shares a part of stay.

DataFrame functions only; nothing is collected over more than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: After a line break, or after the end of a sentence and its space. Nothing is consumed.
UNIT_BREAK = "(?<=\n)|(?<=[.!?] )"
WHITE = " \t\n\x0b\f\r"
MARK = "\x01"
#: Units in a window, grams in a window, words that a deleted run and a window of fewer units must have.
RUN, GRAMS, LEAST = 4, 3, 25
#: A value that holds more than one in so many rows is joined apart from the others; fewer values than this can.
HOT = 256


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def units_of(text: Column) -> Column:
    """Units with their ends, so that they joined are the text. Marking the breaks is much cheaper than the pattern, which is left for texts that hold the mark."""
    marked = text
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    cut = F.when(F.contains(text, F.lit(MARK)), F.split(text, UNIT_BREAK, -1)).otherwise(F.split(marked, MARK, -1))
    return F.filter(cut, lambda u: u != "")


def word_count(unit: Column) -> Column:
    """Words of a trimmed unit, counted by its spaces."""
    return F.when(unit == "", 0).otherwise(F.length(unit) - F.length(F.replace(unit, F.lit(" "), F.lit(""))) + 1)


def trimmed_units(text: Column) -> Column:
    """Units without the white space around them, one for each of :func:`units_of`.

    Trimming other characters than spaces is slow. In a text whose only other
    white space is the line break, leaving out what ends a unit does most of it.
    """
    marked = F.replace(text, F.lit("\n"), F.lit(MARK))
    for end in (". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end[0] + MARK))
    last_is_empty = (marked == "") | F.endswith(marked, F.lit(MARK))  # no other piece is without an end
    plain = let(F.split(marked, MARK, -1), lambda p: F.when(last_is_empty, F.slice(p, 1, F.size(p) - 1)).otherwise(p))
    uneven = F.lit(False)
    for mark in (MARK, "\t", "\x0b", "\f", "\r"):
        uneven = uneven | F.contains(text, F.lit(mark))
    return F.when(uneven, F.transform(units_of(text), lambda u: F.btrim(u, F.lit(WHITE)))).otherwise(F.transform(plain, lambda u: F.btrim(u)))


def hashed_units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_key``, ``_text`` (a hash, to tell rows of one key apart), ``_h`` (the units' hashes) and ``_w`` (their words)."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), F.xxhash64(text).alias("_text"), trimmed_units(F.col(text)).alias("_units"))
    return rows.select("_key", "_text", F.transform("_units", lambda u: F.xxhash64(u)).alias("_h"), F.transform("_units", word_count).alias("_w"))


def short_windows(units: DataFrame) -> DataFrame:
    """Windows of one to three units with ``LEAST`` words, the shortest from each unit and the shortest up to each unit, as fingerprints of their own."""
    rows = units.filter(F.size("_h") > 0).withColumn("_at", F.explode(F.sequence(F.lit(0), F.size("_h") - 1)))
    words = lambda a, b: sum((F.when(F.col("_at") + k >= 0, F.get("_w", F.col("_at") + k)) for k in range(a + 1, b + 1)), F.when(F.col("_at") + a >= 0, F.get("_w", F.col("_at") + a)))  # noqa: E731  null past an end
    rows = rows.withColumns({f"_w{a + 2}{b + 2}": words(a, b) for a, b in ((0, 0), (0, 1), (0, 2), (-1, 0), (-2, 0), (-1, -1), (-2, -1))})
    enough = lambda name: F.coalesce(F.col(name) >= LEAST, F.lit(False))
    size = F.when(enough("_w22"), 1).when(enough("_w23"), 2).when(enough("_w24"), 3)
    # Up to this unit, where the same is not the shortest from its own start.
    back = F.when(enough("_w22"), None).when(enough("_w12"), F.when(enough("_w11"), 2)).when(enough("_w02") & enough("_w01"), 3)
    at = lambda k: F.get("_h", F.col("_at") + k)
    named = {1: lambda k: F.xxhash64(at(k), F.lit("one")), 2: lambda k: F.xxhash64(at(k), at(k + 1), F.lit("two")), 3: lambda k: F.xxhash64(at(k), at(k + 1), at(k + 2), F.lit("three"))}
    ahead = F.when(size == 1, named[1](0)).when(size == 2, named[2](0)).when(size == 3, named[3](0))
    behind = F.when(back == 2, named[2](-1)).when(back == 3, named[3](-2))
    # Hashes are made before the rows are doubled, so that no row takes its text's arrays along.
    both = F.array(F.struct(ahead.alias("print"), F.col("_at").alias("_start"), size.alias("_size")), F.struct(behind.alias("print"), (F.col("_at") - back + 1).alias("_start"), back.alias("_size")))
    rows = rows.select("_key", "_text", F.inline(both)).filter(F.col("_size").isNotNull())
    return rows.select("print", "_key", "_text", "_start", "_size", F.lit(None).cast("array<bigint>").alias("_windows"))


def fingerprints(units: DataFrame) -> DataFrame:
    """``print`` and the windows it stands for: the first start and the hashes of ``_size`` units from there on (null: the print is the hash of the one window).

    Every window is a row first, so that its hashes are compiled code and not
    functions called for each element of an array.
    """
    n = F.size("_h")
    rows = units.filter(n >= RUN).withColumn("_start", F.explode(F.sequence(F.lit(0), n - RUN)))
    at = lambda k: F.get("_h", F.col("_start") + k)
    rows = rows.withColumns({f"_g{k}": F.xxhash64(at(k - 1), at(k)) for k in range(2 * GRAMS)})  # _g1 is the gram at the start

    def chosen(k: int) -> Column:
        """Which gram the window ``k`` after the start takes: the rightmost smallest. Null past the last window."""
        a, b, c = (F.col(f"_g{k + j}") for j in (1, 2, 3))
        return F.when(F.col("_start") + k <= n - RUN, F.when((c <= a) & (c <= b), k + 2).when(b <= a, k + 1).otherwise(k))

    # A fingerprint's windows are neighbours: a gram begins them where the window before chose another.
    rows = rows.filter((F.col("_start") == 0) | (chosen(-1) != chosen(0)))
    window = lambda k: F.xxhash64(*(at(k + j) for j in range(RUN)))
    windows = F.when(chosen(2) == chosen(0), F.array(window(0), window(1), window(2))).when(chosen(1) == chosen(0), F.array(window(0), window(1))).otherwise(F.array(window(0)))
    gram = F.when(chosen(0) == 2, F.col("_g3")).when(chosen(0) == 1, F.col("_g2")).otherwise(F.col("_g1"))
    short = rows.select(gram.alias("print"), "_key", "_text", "_start", F.lit(RUN).alias("_size"), windows.alias("_windows"))
    return short.unionByName(short_windows(units))


def join_hot_apart(left: DataFrame, right: DataFrame, on: str, how: str) -> DataFrame:
    """Join with a row for each value of ``on``, of which ``_n`` says how often the (staged) left side has it.

    Values with a large share of the left rows are fewer than ``HOT``, so
    their rows on the right are broadcast and their left rows stay where they
    are. The others grow with the data and are always merged by a shuffle.
    """
    many = F.col("_n") * HOT > left.count()
    hot, cold = F.broadcast(right.filter(many).drop("_n")), right.filter(~many).drop("_n").hint("merge")
    return left.join(hot, on, how).unionByName(left.join(hot, on, "left_anti").join(cold, on, how))


def repeated_runs(units: DataFrame) -> DataFrame:
    """``_key``, ``_text`` and ``_runs``, the maximal runs (first and last unit) whose windows occur earlier.

    Earlier means a smaller key (null first), or in the same row a smaller place.
    """
    prints = staged(fingerprints(units))  # read twice, and far smaller than the texts
    shared = staged(prints.groupBy("print").agg(F.count("*").alias("_n")).filter("_n > 1"))
    windows = join_hot_apart(prints, shared, "print", "left_semi").select("_key", "_text", "_start", "_size", F.posexplode(F.coalesce("_windows", F.array("print"))).alias("_k", "_window"))
    windows = staged(windows.select("_window", "_size", "_key", "_text", (F.col("_start") + F.col("_k")).alias("_start")))
    place = F.struct("_key", "_text", "_start")
    firsts = windows.groupBy("_window").agg(F.min(place).alias("_first"), F.max(place).alias("_last"), F.count("*").alias("_n")).filter("_first != _last")
    later = join_hot_apart(windows, staged(firsts.select("_window", "_first", "_n")), "_window", "inner").filter(place != F.col("_first")).select("_key", "_text", "_start", (F.col("_start") + F.col("_size") - 1).alias("_end"))
    later = later.repartition("_key", "_text").distinct()  # one shuffle for this and all that follows
    in_row = Window.partitionBy("_key", "_text").orderBy("_start", "_end")
    before = F.max("_end").over(in_row.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("_new", F.when(F.col("_start") <= before + 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(in_row))
    runs = islands.groupBy("_key", "_text", "_run").agg(F.min("_start").alias("first"), F.max("_end").alias("last"))
    return runs.groupBy("_key", "_text").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_runs"))


def delete_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows, with the cleaned text, ``n_units``, ``n_removed`` (units) and ``removed`` (runs: first, last, in units of the old text).

    A run is deleted if it has at least ``LEAST`` words (counted by spaces)
    and consists of windows that occur earlier: windows of four units, or of
    fewer that have ``LEAST`` words. Windows of a run may have their earlier
    copies in different documents. Earlier is what has a smaller key, so the
    first copy always stays; rows of equal key are ordered by a hash of their
    text, and rows of equal key and text are one document. Null texts stay
    null with 0 units, empty ones stay empty; null keys come first. Other
    columns stay; those named like the three are replaced; an empty table
    gives an empty table.
    """
    docs = docs.drop("n_units", "n_removed", "removed")
    units = staged(hashed_units(docs, key, text))
    runs = staged(repeated_runs(units)).hint("merge")  # they grow with the documents
    sizes = units.select("_key", "_text", F.size("_h").alias("_n")).dropDuplicates(["_key", "_text"])
    same = F.col("_run_key").eqNullSafe(F.col("_key")) & (F.col("_run_text") == F.col("_text"))
    found = sizes.join(runs.withColumnsRenamed({"_key": "_run_key", "_text": "_run_text"}), same, "left").drop("_run_key", "_run_text").hint("merge")
    joined = docs.withColumn("_text_now", F.xxhash64(text)).join(found, (F.col(key).eqNullSafe(F.col("_key"))) & (F.col("_text_now") == F.col("_text")), "left")
    words = lambda units, r: F.aggregate(F.slice(units, r["first"] + 1, r["last"] - r["first"] + 1), F.lit(0), lambda a, u: a + word_count(F.btrim(u, F.lit(WHITE))))

    def without(units: Column, removed: Column) -> Column:
        def gap(j: Column) -> Column:
            begin = F.when(j == 0, 0).otherwise(F.get(removed, j - 1)["last"] + 1)
            end = F.when(j == F.size(removed), F.size(units)).otherwise(F.get(removed, j)["first"])
            return F.slice(units, begin + 1, end - begin)

        n_removed = F.aggregate(removed, F.lit(0), lambda a, r: a + r["last"] - r["first"] + 1)
        left = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(removed)), gap)), "")
        return F.struct(left.alias("left"), n_removed.alias("n_removed"), removed.alias("removed"))

    # One value, only for texts with runs, so that a filter on it that is pushed below costs no more than another look at these.
    cut = let(units_of(F.col(text)), lambda units: let(F.filter("_runs", lambda r: words(units, r) >= LEAST), lambda removed: without(units, removed)))
    joined = joined.withColumn("_cut", F.when(F.col("_runs").isNotNull(), cut))
    return joined.withColumns({
        text: F.when(F.coalesce(F.col("_cut.n_removed"), F.lit(0)) == 0, F.col(text)).otherwise(F.col("_cut.left")),
        "n_units": F.coalesce(F.col("_n"), F.lit(0)),
        "n_removed": F.coalesce(F.col("_cut.n_removed"), F.lit(0)),
        "removed": F.coalesce(F.col("_cut.removed"), F.array().cast("array<struct<first:int,last:int>>")),
    }).drop("_cut", "_runs", "_n", "_key", "_text", "_text_now")
