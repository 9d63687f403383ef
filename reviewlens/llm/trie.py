"""A prefix trie over conversations by van Emde Boas recursion.

Every conversation is a sequence of turns, each named by a digest of its role and text, with an end mark
as its last one. Sequences are padded to a power of two and cut at half depth, again and again:

Names go up. Two neighbouring blocks of turns make one of twice the length, named by their two names, until
one block is the whole sequence. Equal sequences are one from there on, with their number and their smallest
conversation.

Prefixes come down. A block that hangs on a prefix is cut in two: its upper half hangs on the same
prefix, its lower half on the prefix that the upper half ends, whose name is made of both names. All blocks
of a length are cut in one round, those of the upper trie beside those of the lower forests. At single
turns every prefix has its name, and equal names are one node.

Totals are grafted upward. A trie of twice the height is an upper trie with lower ones hanging on its
deepest nodes, the cut nodes. A round adds the total below each cut node to the cut node, to its ancestors
in the upper trie, and to what hangs on the upper trie's own root, which the next rounds take further. A
node of depth d is a cut node once, with as many ancestors as the lowest bit of d says.

All of it is kept by (conversation, place) and by node, so that neither a long conversation, nor many equal
ones, nor a node of very many children is a task of its own. The digest of the conversations that end at a
node is one stream by nature: its identifiers are put in order and strung together over many tasks, and
one task reads the strings of a node one after another.

Nulls: a null turn number comes first, a null role or text is empty; rows without a conversation belong
to none and are left out. Turns of one conversation with equal numbers are taken in order of their digest,
repeated rows among them. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.llm.mixing import word_count
from reviewlens.llm.places import small_side
from reviewlens.llm.ranges import numbered
from reviewlens.sources.files import store

# Conversations whose first one lends its opening turns to the others.
BLOCK = 20

# A conversation takes 0 to LENT - 1 turns from the first one of its block.
LENT = 4

# Conversations strung together at once.
STRING = 1 << 9


def _name(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (0, 1 and so on), name and words of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = _name(F.octet_length(role).cast("string"), F.lit(":"), role, text).alias("name")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn"), name, word_count(text).alias("words")
    )
    # Stored, as ranges are found by a reading of their own: texts are hashed once.
    return numbered(store(rows, "named-turns"), "conv_id", [F.asc_nulls_first("turn"), F.asc("name")], "at").drop("turn")


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of the rebuilt conversations, and conv_id and size of each of those.

    The first h turns of a conversation are those of the first one of its block, h being a hash of its
    identifier; a block's first one sends a turn to no more conversations than a block has.
    """
    base = F.col("conv_id") - F.col("conv_id") % BLOCK
    lent = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % LENT).cast("bigint")
    listed = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"base": base, "h": lent})
    listed = store(listed, "conversations")
    lenders = listed.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    size = F.when(F.col("base") == F.col("conv_id"), F.col("n")).otherwise(taken + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    sized = store(listed.join(lenders, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), size.alias("size")), "sizes")

    is_base = F.col("conv_id") == base
    kept = own.where(is_base | (F.col("at") >= lent))
    # Where the first one of the block has fewer turns than are taken, what follows moves up.
    short = store(sized.where((F.col("base") != F.col("conv_id")) & (F.col("taken") < F.col("h"))), "short")
    short = small_side(short.select("conv_id", (F.col("h") - F.col("taken")).alias("missing")), F.lit(60))
    moved = kept.join(short, "conv_id", "left").select(
        "conv_id", (F.col("at") - F.coalesce("missing", F.lit(0))).alias("at"), "name", "words"
    )
    heads = own.where(F.col("at") < LENT - 1).withColumnRenamed("conv_id", "base")
    borrowed = sized.where(F.col("base") != F.col("conv_id")).join(heads, "base").where(F.col("at") < F.col("h"))
    return moved.unionByName(borrowed.select("conv_id", "at", "name", "words")), sized.select("conv_id", "size")


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of name and conversation: the conversations of a name, strung together."""
    for batch in batches:
        names, keys = batch.column(0), batch.column(1)
        if not len(keys):
            continue
        changes = pc.indices_nonzero(pc.not_equal(names.slice(1), names.slice(0, len(names) - 1))).to_pylist()
        starts = [0, *(i + 1 for i in changes)]
        rows = []
        for start, stop in zip(starts, [*starts[1:], len(keys)]):
            for a in range(start, stop, STRING):
                part = keys.slice(a, min(STRING, stop - a)).to_pylist()
                rows.append((names[start].as_py(), part[0], len(part), ",".join(map(str, part))))
        columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["name", "first", "n", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From strings in order of name and first conversation: one digest for each name."""
    name = digest = None
    first = n = 0
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["name", "conv_id", "n", "ends"])

    for batch in batches:
        rows = []
        for own, start, count, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if own != name:
                if digest is not None:
                    rows.append((name, first, n, digest.hexdigest()))
                name, first, n, digest = own, start, count, hashlib.sha256(ids.encode())
            else:
                n += count
                digest.update(b"," + ids.encode())
        if rows:
            yield out(rows)
    if digest is not None:
        yield out([(name, first, n, digest.hexdigest())])


def sequences(whole: DataFrame) -> DataFrame:
    """name, conv_id (the smallest), n and ends (the digest of all, in order) of each distinct sequence,
    from the name of every conversation's."""
    ranged = whole.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id")
    strings = ranged.mapInArrow(_strings, "name binary, first bigint, n bigint, ids string")
    gathered = strings.repartition("name").sortWithinPartitions("name", "first")
    return gathered.mapInArrow(_digests, "name binary, conv_id bigint, n bigint, ends string")


def _blocks(level: DataFrame) -> DataFrame:
    """Blocks of twice the length: conv_id, at, name, left (the name of the first half), whole (whether
    there is a second half)."""
    half = [F.max(F.when(F.col("at") % 2 == side, F.col("name"))) for side in (0, 1)]
    paired = level.groupBy("conv_id", F.shiftright("at", 1).alias("at")).agg(half[0].alias("left"), half[1].alias("right"))
    name = _name("left", F.coalesce("right", F.lit(b"")))
    return paired.select("conv_id", "at", name.alias("name"), "left", F.col("right").isNotNull().alias("whole"))


def prefixes(tokens: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The distinct sequences (see `sequences`); conv_id, n, at and name of the prefix of every length of
    each of them; and how often they were cut."""
    end = F.unhex(F.sha2(F.lit(""), 256))  # no turn has the name of an empty string
    longest = sizes.agg(F.max("size")).first()[0]
    rounds = (longest or 0).bit_length()
    level = tokens.select("conv_id", "at", "name").unionByName(sizes.select("conv_id", F.col("size").alias("at"), end.alias("name")))
    levels = []
    for _ in range(rounds):
        level = store(_blocks(level), "blocks")
        levels.append(level)
    found = store(sequences(level), "sequences")
    items = found.select("conv_id", "n", F.lit(0).cast("bigint").alias("at"), F.unhex(F.sha2(F.lit("root"), 256)).alias("prefix"))
    for blocks in reversed(levels):
        cut = items.join(blocks.select("conv_id", "at", "left", "whole"), ["conv_id", "at"])
        upper = F.struct((F.col("at") * 2).alias("at"), F.col("prefix").alias("prefix"))
        lower = F.struct((F.col("at") * 2 + 1).alias("at"), _name("prefix", "left").alias("prefix"))
        halves = F.when(F.col("whole"), F.array(upper, lower)).otherwise(F.array(upper))
        items = cut.select("conv_id", "n", F.explode(halves).alias("half")).select("conv_id", "n", "half.*")
    return found, items.withColumnRenamed("prefix", "name"), rounds


def _grafted(nodes: DataFrame, path: DataFrame, rounds: int) -> DataFrame:
    """name, n_leaves and saved_tokens of every node's subtree."""
    own = [F.col("n_children") == 0, (F.col("n_convs") - 1) * F.col("words")]
    own = nodes.select("name", "depth", "parent", own[0].cast("bigint").alias("leaves"), own[1].alias("saved"))
    sums = [F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")]
    # What hangs on a node, by tries of height 1: its children.
    below = own.where("depth > 0").groupBy(F.col("parent").alias("name"), (F.col("depth") - 1).alias("depth")).agg(*sums)
    below = store(below, "hanging")
    within = []
    for k in range(rounds):
        height = 1 << k
        is_cut = (F.col("depth") > 0) & (F.col("depth").bitwiseAND(-F.col("depth")) == height)
        hanging = below.where(is_cut).groupBy("name").agg(*sums)
        cut = hanging.join(nodes.select("name", "conv_id", "depth"), "name")
        above = F.explode(F.sequence(F.col("depth") - height, F.col("depth"))).alias("at")
        spread = cut.select("conv_id", "depth", "leaves", "saved", above).join(path.select("conv_id", "at", F.col("name").alias("node")), ["conv_id", "at"])
        to_root = (F.col("at") == F.col("depth") - height).alias("to_root")
        added = spread.select(F.col("node").alias("name"), F.col("at").alias("depth"), to_root, "leaves", "saved")
        added = store(added.groupBy("name", "depth", "to_root").agg(*sums), "grafted")
        within.append(added.where("not to_root").select("name", "leaves", "saved"))
        below = below.unionByName(added.where("to_root").drop("to_root"))
    total = own.select("name", "leaves", "saved").unionByName(below.where("depth = 0").select("name", "leaves", "saved"))
    for part in within:
        total = total.unionByName(part)
    return total.groupBy("name").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations, from none on:
    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, and
    ends_sha256 (the digest of the members with no further turn)."""
    tokens, sizes = rebuilt(turns(conversations))
    tokens = store(tokens, "turns")
    found, path, rounds = prefixes(tokens, sizes)
    # The turn after each prefix; none after the last.
    path = store(path.join(tokens.select("conv_id", "at", "words"), ["conv_id", "at"], "left"), "prefixes")
    counted = path.groupBy("name", F.col("at").alias("depth")).agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"))
    counted = store(counted, "trie")

    last = path.select("conv_id", (F.col("at") + 1).alias("depth"), F.col("name").alias("parent"), "words")
    linked = store(counted.join(last, ["conv_id", "depth"], "left").fillna(0, ["words"]), "linked")
    children = linked.where("depth > 0").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = store(linked.join(children, "name", "left").fillna(0, ["n_children"]), "nodes")

    totals = _grafted(nodes, path, rounds)
    ends = found.select("conv_id", "ends").join(path.where(F.col("words").isNull()).select("conv_id", "name"), "conv_id").drop("conv_id")
    # The root may have very many children, and they all know its conversation.
    root = counted.where("depth = 0").select("conv_id").first()
    near = F.col("depth") <= 1
    keyed = nodes.withColumn("parent", F.when(near, F.col("name")).otherwise(F.col("parent")))
    parents = counted.select(F.col("name").alias("parent"), F.col("conv_id").alias("other"))
    every = keyed.join(totals, "name").join(ends, "name", "left").join(parents, "parent", "left")
    of_root = F.when(F.col("depth") == 1, F.lit(root["conv_id"] if root else None))
    every = every.withColumn("parent_conv_id", F.when(near, of_root).otherwise(F.col("other")))
    counts = [F.col(c).cast("bigint").alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return every.select("conv_id", *counts, F.coalesce("ends", none).alias("ends_sha256"))
