"""The prefix trie of conversations, summed up by the Euler-tour technique.

Nodes are keyed by hashes of prefixes, numbered, and linked into one tour that enters and leaves each of them. The tour is
ranked as a linked list, by parts: each task joins the arcs that follow each other within its range of numbers, chains of
arcs become single arcs, and so on until one task holds the rest. On the way back each arc gets the sums of all before it;
a subtree's sums are the differences between its leaving and its entering arc."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimspark.operators.tables import numbered

from . import common as C

#: Arcs that one task joins.
BLOCK = 65_536
#: A round that leaves more than this share of the arcs is followed by one that joins random neighbours.
POOR = 0.75
#: Turns of a conversation whose hashes one window sums up.
STRETCH = 4096
#: Ids that differ in so many last bits are written as one string before they are hashed in order.
RANGE_BITS = 12


# --- conversations ----------------------------------------------------------------------------------------------------


def turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, length, a, b, chars): each turn's place, the number of turns of its conversation, two hashes of its
    role and text, and the text's code points; and (conv_id, length) of all conversations. Turns go by turn (null first), then role and text; null roles and texts are
    empty; rows without conv_id are left out.

    Places come from one global order, so a conversation may be of any length."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    hashes = [F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b"), F.length("text").cast("long").alias("chars")]
    rows = numbered(rows, F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc(), keep=["conv_id", *hashes])
    of = C.saved(rows.groupBy("conv_id").agg(F.min("number").alias("_first"), F.count("*").alias("length")))
    return rows.join(of, "conv_id").select("conv_id", (F.col("number") - F.col("_first") + 1).alias("depth"), "length", "a", "b", "chars"), of.select("conv_id", "length")


def rebuilt(turns_: DataFrame, convs: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """turns() of conversations that begin with the first h turns of the first one of their group, conv_id - conv_id %
    group, and go on with their own after the first h: h is crc32 of the decimal conv_id, modulo `most`. And (conv_id,
    length) of all of them, those without turns too."""
    h = F.crc32(F.col("conv_id").cast("string")) % most
    base = F.col("conv_id") - F.col("conv_id") % group
    heads = convs.select(F.col("conv_id").alias("base"), F.col("length").alias("_base_own"))
    convs = convs.select("conv_id", F.col("length").alias("own"), h.alias("h"), base.alias("base")).join(heads, "base", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("_base_own", F.lit(0)))).withColumn("all", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = C.saved(convs.select("conv_id", "h", "base", "k", F.col("all").alias("length")))
    own = turns_.drop("length").join(convs, "conv_id").where("depth > h").withColumn("depth", F.col("k") + F.col("depth") - F.col("h"))
    first = turns_.where(f"conv_id % {group} = 0 and depth < {most}").select(F.col("conv_id").alias("base"), "depth", "a", "b", "chars")
    lent = convs.where("k > 0").withColumn("depth", F.explode(F.sequence(F.lit(1).cast("long"), "k"))).join(first, ["base", "depth"])
    columns = "conv_id", "depth", "length", "a", "b", "chars"
    return own.select(*columns).union(lent.select(*columns)), convs.select("conv_id", "length")


# --- the list of arcs -------------------------------------------------------------------------------------------------

SUMS = "rank", "leaves", "saved"
LEVEL = "head long, upper long, " + ", ".join(f"b_{s} long" for s in SUMS) + ", tail boolean, next long, " + ", ".join(f"{s} long" for s in SUMS)


def join_arcs(table: pa.Table) -> pa.Table:
    """Of arcs (head, next, sums), sorted by head: the first arc of each one's chain within the table, the sums before it
    in the chain, and at the chain's tail what follows and the sums of all."""
    heads, next_ = table.column("head").to_numpy(), table.column("next").fill_null(-1).to_numpy()
    weights = np.stack([table.column(s).to_numpy() for s in SUMS]) if len(heads) else np.empty((len(SUMS), 0), np.int64)
    n = len(heads)
    at = np.minimum(np.searchsorted(heads, next_), max(n - 1, 0))
    here = heads[at] == next_ if n else np.empty(0, bool)
    up = np.arange(n)
    up[at[here]] = np.flatnonzero(here)
    before = np.where(up != np.arange(n), weights[:, up], 0)
    while not np.array_equal(further := up[up], up):  # pointers double, so rounds are few
        before, up = before + before[:, up], further
    ends = ~here
    total = before + weights
    out = {"head": heads, "upper": heads[up], **{f"b_{s}": before[i] for i, s in enumerate(SUMS)}, "tail": ends}
    out |= {"next": pa.array(next_, mask=~ends | (next_ < 0)), **{s: pa.array(total[i], mask=~ends) for i, s in enumerate(SUMS)}}
    return pa.table(out)


def by_ranges(arcs: DataFrame, n_parts: int) -> DataFrame:
    """LEVEL of arcs, joined within ranges of their numbers."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if found := list(batches):
            yield from join_arcs(pa.Table.from_batches(found)).to_batches()

    rows = arcs.select("head", "next", *SUMS)
    ranges = rows.repartitionByRange(n_parts, "head") if n_parts > 1 else rows.repartition(1)
    return ranges.sortWithinPartitions("head").mapInArrow(C.tidied(join), LEVEL)


def by_chance(arcs: DataFrame, round_: int) -> DataFrame:
    """LEVEL of arcs where each arc of one side of a coin takes in the next one if it is of the other: about a fourth go,
    however the list runs."""
    coin = F.pmod(F.xxhash64("head", F.lit(round_)), F.lit(2))
    a = arcs.where(coin == 0).select(F.col("head").alias("a"), F.col("next").alias("b"), *(F.col(s).alias(f"b_{s}") for s in SUMS))
    b = arcs.where(coin == 1).select(F.col("head").alias("b"), "next", *SUMS)
    met = C.saved(a.join(b, "b"))
    none = [F.lit(None).cast("long").alias(s) for s in ("next", *SUMS)]
    zeros = [F.lit(0).cast("long").alias(f"b_{s}") for s in SUMS]
    taken = met.select(F.col("b").alias("head"), F.col("a").alias("upper"), *(f"b_{s}" for s in SUMS), F.lit(True).alias("tail"), "next", *((F.col(s) + F.col(f"b_{s}")).alias(s) for s in SUMS))
    takers = met.select(F.col("a").alias("head"), F.col("a").alias("upper"), *zeros, F.lit(False).alias("tail"), *none)
    rest = arcs.join(met.select(F.col("a").alias("head")).union(met.select("b")), "head", "left_anti")
    return taken.union(takers).union(rest.select("head", F.col("head").alias("upper"), *zeros, F.lit(True).alias("tail"), "next", *SUMS))


def list_ranked(arcs: DataFrame, size: int, per_task: int | None = None) -> DataFrame:
    """(head, rank, leaves, saved): for each arc of a list (head, next, rank, leaves, saved) the sums over all arcs before
    it. next: the arc that follows, null for the last. size: how many arcs there are."""
    per_task, levels, now, chance = per_task or BLOCK, [], arcs, False
    while size > 1 or not levels:
        parts = math.ceil(size / per_task)
        chance = chance and parts > 1
        level = C.saved(by_chance(now, len(levels)) if chance else by_ranges(now, parts))
        levels.append(level)
        now = level.where("tail").select(F.col("upper").alias("head"), "next", *SUMS)
        was, size = size, now.count() if parts > 1 else 1
        chance = not chance and parts > 1 and size > POOR * was
    found = levels.pop().select("head", *(F.col(f"b_{s}").alias(s) for s in SUMS))
    for level in reversed(levels):
        above = found.select(F.col("head").alias("upper"), *(F.col(s).alias(f"u_{s}") for s in SUMS))
        found = level.select("head", "upper", *(f"b_{s}" for s in SUMS)).join(above, "upper").select("head", *((F.col(f"b_{s}") + F.col(f"u_{s}")).alias(s) for s in SUMS))
    return found


# --- the trie ---------------------------------------------------------------------------------------------------------


def digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the decimal conv_ids of each key in ascending order, with commas between.
    Ids are joined by ranges first, so a key's task reads few rows, and one after the other."""
    by_range = ends.groupBy("depth", "k1", "k2", F.shiftright("conv_id", RANGE_BITS).alias("_range")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    parts = by_range.select("depth", "k1", "k2", "_range", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hashed = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*key, hashed.hexdigest()), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["depth", "k1", "k2", "ends_sha256"])
        for b in batches:
            for *this, _, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if this == key:
                    hashed.update(b"," + ids.encode())
                    continue
                if key:
                    yield row()
                key, hashed = this, hashlib.sha256(ids.encode())
        if key:
            yield row()

    keys = "depth", "k1", "k2"
    return parts.repartition(*keys).sortWithinPartitions(*keys, "_range").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns_: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns of turns_ (conv_id, depth, length, a, b, chars) and the root: conv_id
    the smallest member, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and enter_rank
    and exit_rank, the places of its arcs in the tour. convs: (conv_id, length) of all conversations; without any there
    is no row. The method's keys are 128 bits of hashes of a prefix."""
    zero = F.lit(0).cast("long")
    # the key of a prefix is the xor of its turns' hashes, each mixed with its place: a running xor within a stretch of a
    # conversation, and for what is longer than a stretch the xor of those before
    mixed = turns_.withColumns({"x": F.xxhash64("depth", "a", "b"), "y": F.xxhash64(F.lit(1), "b", "a", "depth"), "part": F.floor(F.col("depth") / STRETCH)})
    upto = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = C.saved(mixed.withColumns({"px": F.bit_xor("x").over(upto), "py": F.bit_xor("y").over(upto)}).drop("a", "b"))
    over = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a stretch
    parts = rows.where(F.col("length") >= STRETCH).groupBy("conv_id", "part").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    before = parts.select("conv_id", "part", F.coalesce(F.bit_xor("x").over(over), zero).alias("sx"), F.coalesce(F.bit_xor("y").over(over), zero).alias("sy"))
    short = rows.where(F.col("length") < STRETCH).select("*", zero.alias("sx"), zero.alias("sy"))
    long = rows.where(F.col("length") >= STRETCH).join(before, ["conv_id", "part"]).select(*short.columns)
    keyed = short.union(long).withColumns({"k1": F.col("px").bitwiseXOR(F.col("sx")), "k2": F.col("py").bitwiseXOR(F.col("sy"))})
    keyed = keyed.select("conv_id", "depth", "length", "chars", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x")).alias("p1"), F.col("k2").bitwiseXOR(F.col("y")).alias("p2"))
    nodes = keyed.groupBy("depth", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs", zero.alias("chars"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    # in this order a member's own path is one run of numbers, and so are most arcs that follow each other
    nodes = numbered(nodes.union(root), "conv_id", "depth").withColumn("node", F.col("number") - 1).drop("number")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = C.saved(nodes.join(parents, ["depth", "p1", "p2"], "left").drop("p1", "p2"))
    children = nodes.where("parent is not null").select("node", "parent")
    first = children.groupBy(F.col("parent").alias("node")).agg(F.min("node").alias("first_child"), F.count("*").alias("n_children"))
    siblings = numbered(children, "parent", "node")
    after = siblings.select((F.col("number") - 1).alias("number"), F.col("node").alias("sibling"), F.col("parent").alias("_same"))
    after = siblings.join(after, "number").where("parent = _same").select("node", "sibling")
    nodes = C.saved(nodes.join(first, "node", "left").join(after, "node", "left"))
    arc = lambda head, follows, leaves, gain: F.struct(head.alias("head"), follows.alias("next"), F.lit(1).cast("long").alias("rank"), leaves.alias("leaves"), gain.alias("saved"))
    enter = arc(2 * F.col("node"), F.coalesce(2 * F.col("first_child"), 2 * F.col("node") + 1), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"), (F.col("n_convs") - 1) * F.col("chars"))
    leave = arc(2 * F.col("node") + 1, F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1), zero, zero)
    size = 2 * nodes.count()
    if not size:
        return _none(turns_.sparkSession)
    ranked = list_ranked(nodes.select(F.explode(F.array(enter, leave)).alias("arc")).select("arc.*"), size)
    within = lambda s: F.max(s) - F.min(s)
    sums = ranked.groupBy(F.shiftright("head", 1).alias("node")).agg(within("leaves").alias("n_leaves"), within("saved").alias("saved_tokens"), F.min("rank").alias("enter_rank"), F.max("rank").alias("exit_rank"))
    ends = keyed.where("depth = length").select("conv_id", "depth", "k1", "k2").union(convs.where("length = 0").select("conv_id", zero, zero, zero))
    out = nodes.join(sums, "node").join(digests(ends), ["depth", "k1", "k2"], "left")
    empty = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", empty, "enter_rank", "exit_rank")


def _none(spark) -> DataFrame:
    return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, enter_rank long, exit_rank long")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """trie() of conversations (conv_id, turn, role, text) as they are.

    Null turns come first; null roles and texts are empty; rows without conv_id are left out; repeated rows are turns each;
    equal turns go by role and text. Texts of any length are hashed where they are. An empty table gives no rows."""
    return trie(*turns(conversations))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """trie() of conversations rebuilt() from the first turns of their groups; the rest as in prefix_trie()."""
    return trie(*rebuilt(*turns(conversations)))
