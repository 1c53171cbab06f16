"""Prefix tries of conversations, and subtree totals by parallel tree contraction.

A node is a distinct sequence of turns from the first on. It is known by its
depth and the sums of its turns' hashes, each salted with its place: sums over
a prefix are running sums, so no task needs a whole conversation. Its name is
its depth and the smallest conversation that begins with it.

Totals of subtrees come from rounds of joins. *Rake* takes all leaves off and
adds their totals to their parents. *Compress* takes nodes out of chains in
which each has one child: a node goes into its parent if it ranks below parent
and child, where odd depths rank lowest, then odd multiples of two, and so on;
so about half of a chain goes in a round, and a trie of n nodes needs about
log n rounds, however deep. Going back through the rounds, each node that was
taken out of a chain gets the total of its child of that time.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import importable, staged

#: As powers of two: turns of a conversation that running sums are made over at a time, and ids that a piece of a list of members spans.
TURNS, MEMBERS = 12, 12
WORD = r"[^\x20\x09-\x0D]+"
LIMBS = ["k0", "k1", "k2", "k3"]
KEY = ["depth", *LIMBS]
ORDER = ["conv_id", "turn", "role", "_digest", "_salt"]


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat_ws(":", *parts), 256)


def limb(digest: Column, k: int) -> Column:
    """32 bits of a digest as a number; 2^31 of them can be summed."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def numbered(turns: DataFrame) -> DataFrame:
    """Staged turns in the order of :data:`ORDER` (nulls first), ``_row`` counting them through the whole table.

    Tasks are ranges of that order, so a conversation may span several; one
    row of each task comes to the driver.
    """
    turns = turns.withColumn("_salt", F.monotonically_increasing_id())  # so that many equal rows are several ranges
    dealt = turns.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    place = F.monotonically_increasing_id()
    dealt = staged(dealt.withColumns({"_part": F.shiftright(place, 33), "_n": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    begins, before = [], 0
    for part, n in dealt.groupBy("_part").count().orderBy("_part").collect():
        begins.append((part, before))
        before += n
    offsets = F.broadcast(dealt.sparkSession.createDataFrame(begins, "_part long, _begin long"))
    return dealt.join(offsets, "_part").withColumn("_row", F.col("_n") + F.col("_begin")).drop("_part", "_n", "_begin", "_salt")


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Staged conversations (conv_id, turns) and their turns (conv_id, place, digest, words), rebuilt.

    Conversation c begins with the first h turns of conversation c - c % every
    (all, if it has fewer; none, if it isn't there), where h is the CRC-32 of
    the decimal c modulo ``most``; its own turns follow but the first h.
    ``most`` = 1 leaves conversations as they are. Turns come in the order of
    ``turn``, nulls first; ties by role, then by a hash of role and text, and
    repeated rows are turns of their own. Null roles and texts are empty;
    rows without conversation are ignored, as are other columns.
    """
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.select(F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text")).filter("conv_id is not null")
    # The role's length tells where it ends. Texts go no further.
    rows = rows.select("conv_id", "turn", "role", hashed(F.length("role"), F.col("role"), F.col("text")).alias("_digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    rows = numbered(rows)
    convs = rows.groupBy("conv_id").agg(F.min("_row").alias("_first"), F.count("*").alias("_own"))
    wanted = F.when(F.col("conv_id") % every == 0, 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    convs = convs.withColumns({"_h": wanted, "_base": F.col("conv_id") - F.col("conv_id") % every})
    bases = convs.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_of"), F.col("_own").alias("_has"))
    convs = convs.join(bases, F.col("_base") == F.col("_of"), "left").withColumn("_take", F.least("_h", F.coalesce("_has", F.lit(0))))
    convs = staged(convs.withColumn("turns", F.col("_take") + F.greatest(F.lit(0), F.col("_own") - F.col("_h"))).select("conv_id", "turns", "_first", "_h", "_base", "_take"))

    placed = rows.join(convs, "conv_id").withColumn("_place", F.col("_row") - F.col("_first"))
    own = placed.filter(F.col("_place") >= F.col("_h")).select("conv_id", (F.col("_take") + F.col("_place") - F.col("_h")).alias("place"), F.col("_digest").alias("digest"), "words", "turns")
    heads = placed.filter((F.col("conv_id") % every == 0) & (F.col("_place") < most - 1)).select(F.col("conv_id").alias("_of"), "_place", "_digest", "words")
    taken = convs.filter("_take > 0").join(heads, (F.col("_base") == F.col("_of")) & (F.col("_place") < F.col("_take")))  # few conversations for each base
    taken = taken.select("conv_id", F.col("_place").alias("place"), F.col("_digest").alias("digest"), "words", "turns")
    return convs.select("conv_id", "turns"), own.unionByName(taken)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, the key of each prefix (:data:`KEY`), the hash limbs of its last turn, words and ``last`` (whether the conversation ends there)."""
    digest = hashed(F.col("place"), F.col("digest"))
    rows = turns.withColumn("_d", digest).withColumn("_block", F.shiftright("place", TURNS))
    rows = rows.select("conv_id", "place", "_block", "words", "turns", *(limb(F.col("_d"), k).alias(f"l{k}") for k in range(4)))
    inside = Window.partitionBy("conv_id", "_block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumns({f"k{k}": F.sum(f"l{k}").over(inside) for k in range(4)})
    # What earlier blocks of a conversation of several have: a row for each block.
    totals = rows.filter(F.shiftright("turns", TURNS) > 0).groupBy("conv_id", "_block").agg(*(F.sum(f"l{k}").alias(f"t{k}") for k in range(4)))
    earlier = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begins = totals.select(F.col("conv_id").alias("_c"), F.col("_block").alias("_b"), *(F.coalesce(F.sum(f"t{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in range(4)))
    sums = sums.join(begins, (F.col("conv_id") == F.col("_c")) & (F.col("_block") == F.col("_b")), "left")
    whole = [(F.col(f"k{k}") + F.coalesce(f"b{k}", F.lit(0))).alias(f"k{k}") for k in range(4)]
    return sums.select("conv_id", (F.col("place") + 1).alias("depth"), *whole, *(f"l{k}" for k in range(4)), "words", (F.col("place") + 1 == F.col("turns")).alias("last"))


def list_digests(ends: DataFrame) -> DataFrame:
    """:data:`KEY` and ``ends_sha256`` of the conversations (conv_id) that end at each node: decimal, ascending, comma-joined.

    Lists are made in pieces of 2^:data:`MEMBERS` conversations at most. A node of several
    pieces is hashed piece by piece as they pass, so no list is ever whole.
    """
    pieces = ends.withColumn("_piece", F.shiftright("conv_id", MEMBERS)).groupBy(*KEY, "_piece").agg(F.sort_array(F.collect_list("conv_id")).alias("_ids"))
    pieces = staged(pieces.select(*KEY, "_piece", F.array_join(F.col("_ids").cast("array<string>"), ",").alias("_text")))
    nodes = pieces.groupBy(*KEY).agg(F.count("*").alias("_pieces"), F.max("_text").alias("_text"))
    short = nodes.filter("_pieces = 1").select(*KEY, F.sha2("_text", 256).alias("ends_sha256"))
    several = nodes.filter("_pieces > 1").select(*KEY)
    names = [*KEY, "_text"]

    def digested(batches):
        now, state = None, None
        for batch in filter(len, batches):
            columns = batch.to_pydict()
            done = []
            for *key, text in zip(*(columns[c] for c in names), strict=True):
                if key != now:
                    done += [(*now, state.hexdigest())] if now else []
                    now, state = key, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_pylist([dict(zip([*KEY, "ends_sha256"], x, strict=True)) for x in done], schema)
        if now:
            yield pa.RecordBatch.from_pylist([dict(zip([*KEY, "ends_sha256"], [*now, state.hexdigest()], strict=True))], schema)

    schema = pa.schema([(c, pa.int64()) for c in KEY] + [("ends_sha256", pa.string())])
    ordered = pieces.join(several, KEY).repartition(*KEY).sortWithinPartitions(*KEY, "_piece").select(*names)
    return short.unionByName(ordered.mapInArrow(digested, ", ".join(f"{c} long" for c in KEY) + ", ends_sha256 string"))


def rank(depth: str) -> Column:
    """Odd depths first, then odd multiples of two, and so on; the root last."""
    d = F.col(depth)
    return F.struct(F.when(d == 0, F.lit(1 << 62)).otherwise(d.bitwiseAND(-d)), d)


def contract(tree: DataFrame, totals: list[str]) -> DataFrame:
    """conv, depth and ``totals`` summed over the subtree of every node.

    ``tree`` has conv, depth, p_conv, p_depth (null: the root), kids (their
    number), x_conv and x_depth (the exclusive or of the children's names,
    so the name of a child that is the only one left).
    """
    node, names = ["conv", "depth"], ["conv", "depth", "p_conv", "p_depth", "kids", "x_conv", "x_depth", *totals]
    alive, rounds = staged(tree.select(*names)), []
    while alive.count() > 1:
        leaf = alive.filter("kids = 0 and p_conv is not null")
        raked = leaf.groupBy(F.col("p_conv").alias("conv"), F.col("p_depth").alias("depth")).agg(
            F.count("*").alias("_k"), F.bit_xor("conv").alias("_c"), F.bit_xor("depth").alias("_d"), *(F.sum(t).alias(f"_{t}") for t in totals)
        )
        rest = alive.filter("kids > 0 or p_conv is null").join(raked, node, "left")
        less = {"kids": F.col("kids") - F.coalesce("_k", F.lit(0)), "x_conv": F.col("x_conv").bitwiseXOR(F.coalesce("_c", F.lit(0))), "x_depth": F.col("x_depth").bitwiseXOR(F.coalesce("_d", F.lit(0)))}
        rest = staged(rest.withColumns(less | {t: F.col(t) + F.coalesce(f"_{t}", F.lit(0)) for t in totals}).select(*names))

        # A node with one child, whose parent has no other: both are rows of ``single``, and each matches one row at most.
        single = rest.filter("kids = 1")
        upper = single.select(F.col("x_conv").alias("conv"), F.col("x_depth").alias("depth"), F.col("conv").alias("u_conv"), F.col("depth").alias("u_depth"))
        gone = single.filter(rank("depth") < rank("x_depth")).join(upper, node).filter(rank("depth") < rank("u_depth"))
        gone = staged(gone.select(*node, "x_conv", "x_depth", "u_conv", "u_depth", *totals))
        empty = {"_gone": F.lit(None).cast("int"), **{c: F.lit(None).cast("long") for c in ("n_conv", "n_depth", "q_conv", "q_depth", *(f"_{t}" for t in totals))}}
        said = lambda conv, depth, more: gone.select(F.col(conv).alias("conv"), F.col(depth).alias("depth"), *(v.alias(k) for k, v in (empty | more).items()))
        news = said("conv", "depth", {"_gone": F.lit(1)})
        news = news.unionByName(said("u_conv", "u_depth", {"n_conv": F.col("x_conv"), "n_depth": F.col("x_depth"), **{f"_{t}": F.col(t) for t in totals}}))
        news = news.unionByName(said("x_conv", "x_depth", {"q_conv": F.col("u_conv"), "q_depth": F.col("u_depth")}))
        news = news.groupBy(*node).agg(*(F.max(c).alias(c) for c in empty))
        after = rest.join(news, node, "left").filter("_gone is null")
        moved = {"p_conv": F.coalesce("q_conv", "p_conv"), "p_depth": F.coalesce("q_depth", "p_depth"), "x_conv": F.coalesce("n_conv", "x_conv"), "x_depth": F.coalesce("n_depth", "x_depth")}
        rounds.append((leaf, gone))
        alive = staged(after.withColumns(moved | {t: F.col(t) + F.coalesce(f"_{t}", F.lit(0)) for t in totals}).select(*names))

    known = alive.select(*node, *totals)
    for leaf, gone in reversed(rounds):
        below = known.select(F.col("conv").alias("x_conv"), F.col("depth").alias("x_depth"), *(F.col(t).alias(f"_{t}") for t in totals))
        back = gone.join(below, ["x_conv", "x_depth"]).select(*node, *((F.col(t) + F.col(f"_{t}")).alias(t) for t in totals))
        known = staged(known.unionByName(leaf.select(*node, *totals)).unionByName(back))
    return known


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """A row for each node of the trie of conversations (conv_id, turns) with the given turns (see :func:`rebuilt`).

    conv_id (smallest member), depth, parent_conv_id (null: the root), n_convs
    (members), n_children, n_leaves and saved_tokens (of the subtree: each
    node's members but one times the words of its last turn) and ends_sha256
    (see :func:`list_digests`). The root has no turns and all conversations,
    those without turns included; without conversations there is no node.
    """
    importable(convs.sparkSession)
    rows = staged(prefixes(turns))
    least = convs.agg(F.min("conv_id").alias("conv"), F.count("*").alias("n_convs")).filter("conv is not null")
    nothing = [F.lit(0).cast("long").alias(c) for c in LIMBS]
    root = least.select("conv", "n_convs", F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("depth"), *nothing, F.lit(None).cast("long").alias("p_conv"))
    found = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv"), F.count("*").alias("n_convs"), F.max("words").alias("words"), *(F.min(f"l{k}").alias(f"l{k}") for k in range(4)))
    found = staged(found)
    # The parent's key is the node's without its last turn. All nodes of depth 1 have the root for a parent, which needs no join.
    parents = found.select((F.col("depth") + 1).alias("depth"), *(F.col(c).alias(f"p{c}") for c in LIMBS), F.col("conv").alias("p_conv"))
    deeper = found.filter("depth > 1").withColumns({f"p{c}": F.col(c) - F.col(f"l{k}") for k, c in enumerate(LIMBS)})
    deeper = deeper.join(parents, ["depth", *(f"p{c}" for c in LIMBS)])
    first = found.filter("depth = 1").crossJoin(F.broadcast(least.select(F.col("conv").alias("p_conv"))))  # one row
    columns = ["conv", "n_convs", "words", *KEY, "p_conv"]
    nodes = staged(root.select(*columns).unionByName(deeper.select(*columns)).unionByName(first.select(*columns)))

    kids = nodes.filter("p_conv is not null").groupBy(F.col("p_conv").alias("conv"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("kids"), F.bit_xor("conv").alias("x_conv"))
    odd = F.coalesce("kids", F.lit(0)) % 2 == 1  # an even number of equal depths cancels out
    tree = nodes.join(kids, ["conv", "depth"], "left").select(
        *columns, (F.when(F.col("p_conv").isNotNull(), F.col("depth") - 1)).alias("p_depth"), F.coalesce("kids", F.lit(0)).alias("kids"),
        F.coalesce("x_conv", F.lit(0)).alias("x_conv"), F.when(odd, F.col("depth") + 1).otherwise(0).alias("x_depth"),
    )
    tree = staged(tree.withColumns({"n_leaves": (F.col("kids") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}))
    totals = contract(tree, ["n_leaves", "saved_tokens"])

    ends = rows.filter("last").select(*KEY, "conv_id").unionByName(convs.filter("turns = 0").select(F.lit(0).cast("long").alias("depth"), *nothing, "conv_id"))
    named = tree.drop("n_leaves", "saved_tokens").join(totals, ["conv", "depth"]).join(list_digests(ends), KEY, "left")
    return named.select(
        F.col("conv").alias("conv_id"), "depth", F.col("p_conv").alias("parent_conv_id"), "n_convs", F.col("kids").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
