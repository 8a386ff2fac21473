"""Conversation prefix trie by collapsing whole sequences.

Every conversation is a sequence of turns; a node of the trie is a distinct run of first turns. Identical conversations
are collapsed first, into weighted sequences with a list of their ids; sequences that are a proper prefix of another are
told apart by an anti-join, and what is left are the leaves. Only then are prefixes made, of one conversation per
distinct sequence, and added up with the weights.

A prefix is known by its length and by four sums of 32-bit hashes of (turn, place), 128 bits in all. Sums can be carried
on from one task to the next, so a conversation of any length is ranked and summed in pieces
(``running``): no task holds more than its piece, and only one row per piece passes from one to the next. Groupings
combine on the map side, so the root or a very common first turn is no hot key.

Distinct nodes below a node are counted without pairs of nodes: each node belongs to the smallest leaf through it, so a
leaf owns the end of its path from some depth on, and its share of any node above is a difference of two running sums.

Defined results: null role or text is empty; turns come in ascending order, null first, and turns of equal number in
ascending order of the MD5 of ``<code points of role>:<role><text>``, so repeated rows count as often as they are given; rows of a
null conversation id belong to no conversation and take no part; an empty table has no node. Columns beside the four
named ones are never read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tongueprint.llm.common import workers
from tongueprint.session import materialize

LANES = ["k1", "k2", "k3", "k4"]
NODE = ["depth", *LANES]
# Ids in one piece of an end list.
PIECE = 4096
KEPT = 5


def running(df: DataFrame, group: str, order: list[str], sums: dict[str, Column], label: str) -> DataFrame:
    """``df`` with a running total per group in the given order, this row included, for each entry of ``sums``.

    Rows are dealt to tasks by ranges of (group, order), so a group may span many tasks. Each (group, task) is summed
    by itself; what came before, in earlier tasks of the group, is one row for each task that starts inside a group:
    never more rows than tasks, which bounds what is broadcast.
    """
    added = df.withColumns({f"_sum_{name}": value for name, value in sums.items()}).withColumn("_row", F.monotonically_increasing_id())
    dealt = added.repartitionByRange(workers(df), group, *order, "_row").withColumn("_piece", F.spark_partition_id())
    placed = materialize(dealt, label)
    inside = Window.partitionBy("_piece", group).orderBy(*order, "_row").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(group, "_piece").agg(*[F.sum(f"_sum_{name}").alias(f"_sum_{name}") for name in sums])
    carried = totals.select(
        F.col(group).alias("_group"), F.col("_piece").alias("_at"), F.row_number().over(Window.partitionBy(group).orderBy("_piece")).alias("_piece_of_group"),
        *[F.sum(f"_sum_{name}").over(earlier).alias(f"_until_{name}") for name in sums],
    ).where("_piece_of_group > 1")
    summed = placed.select(*df.columns, "_piece", *[F.sum(f"_sum_{name}").over(inside).alias(f"_sum_{name}") for name in sums])
    met = summed.join(F.broadcast(carried), (F.col(group) == F.col("_group")) & (F.col("_piece") == F.col("_at")), "left")
    return met.select(*df.columns, *[(F.col(f"_sum_{name}") + F.coalesce(f"_until_{name}", F.lit(0))).alias(name) for name in sums])


def ordered_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``(conv, place, digest, size)``: every turn with its place from 1; ``size`` is the code points of its text."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    narrow = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("size")
    )
    ranked = running(materialize(narrow, "trie-turns"), "conv", ["turn", "digest"], {"place": F.lit(1).cast("long")}, "trie-placed")
    return ranked.select("conv", "place", "digest", "size")


def rebuilt(turns: DataFrame, span: int = 100, most: int = KEPT) -> DataFrame:
    """``(conv, depth, digest, size)`` of conversations whose start is taken from the first one of their block of ids.

    Conversation c gets the first h turns of c - c % span, h = crc32(c as text) % (most + 1), all if there are fewer and
    none if there is no such conversation, and after them its own turns but the first h. Every conversation also has a row of
    depth 0, with a null digest.
    """
    convs = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = convs.withColumns({
        "parent": F.col("conv") - F.col("conv") % span,
        "h": F.crc32(F.col("conv").cast("string").cast("binary")) % (most + 1),
    })
    lengths = convs.select(F.col("conv").alias("parent"), F.col("n").alias("n_parent"))
    convs = materialize(
        convs.join(lengths, "parent", "left").withColumn("taken", F.least("h", F.coalesce("n_parent", F.lit(0)))).select("conv", "parent", "h", "taken"),
        "trie-convs",
    )
    heads = turns.where(F.col("place") <= most).withColumnRenamed("conv", "parent")
    given = convs.where("taken > 0").join(heads, "parent").where("place <= taken").select("conv", F.col("place").alias("depth"), "digest", "size")
    own = turns.join(convs, "conv").where("place > h").select("conv", (F.col("taken") + F.col("place") - F.col("h")).alias("depth"), "digest", "size")
    roots = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("digest"), F.lit(0).cast("long").alias("size"))
    return given.unionByName(own).unionByName(roots)


def hashed(turns: DataFrame) -> DataFrame:
    """``(conv, depth, size, k1..k4)``: four sums' worth of 32 bits for each turn; none for the row of depth 0."""
    def lanes(seed: int, low: str, high: str) -> dict[str, Column]:
        whole = F.xxhash64(F.lit(seed), F.col("digest"), F.col("depth"))
        there = F.col("digest").isNotNull()
        return {
            low: F.when(there, whole.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).otherwise(F.lit(0).cast("long")),
            high: F.when(there, F.shiftrightunsigned(whole, 32)).otherwise(F.lit(0).cast("long")),
        }

    return turns.withColumns(lanes(1, "k1", "k2") | lanes(2, "k3", "k4")).select("conv", "depth", "size", *LANES)


def end_lists(wholes: DataFrame) -> DataFrame:
    """``(depth, k1..k4, ends_sha256)``: digest of the ids of equal conversations, ascending and joined by commas.

    Ids are joined in pieces of at most ``PIECE`` numbers first; the pieces of a list pass through one hash in order, a few kilobytes
    at a time.
    """
    near = wholes.groupBy(*NODE, F.floor(F.col("conv") / F.lit(PIECE)).alias("piece")).agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    texts = near.select(*NODE, "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, done = None, None, []
        for batch in batches:
            *keys, _, texts_of = (column.to_pylist() for column in batch.columns)
            for key, text in zip(zip(*keys), texts_of):
                if key == last:
                    state.update(b",")
                else:
                    if last is not None:
                        done.append((*last, state.hexdigest()))
                    last, state = key, hashlib.sha256()
                state.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*done)], names=[*NODE, "ends_sha256"])
                done = []
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, state.hexdigest())], names=[*NODE, "ends_sha256"])

    dealt = texts.repartition(workers(texts), *NODE).sortWithinPartitions(*NODE, "piece")
    return dealt.mapInArrow(digests, ", ".join([*(f"{c} long" for c in NODE), "ends_sha256 string"]))


def nodes(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations``, rows as ``rebuilt`` gives them.

    Returns ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``, one row per node.
    """
    rows = materialize(hashed(conversations), "trie-rows")
    total = [F.sum(k).alias(k) for k in LANES]
    wholes = rows.groupBy("conv").agg(F.max("depth").alias("depth"), *total, F.sum("size").alias("whole"))
    wholes = materialize(wholes, "trie-wholes")
    sequences = wholes.groupBy(*NODE).agg(F.count("*").alias("weight"), F.min("conv").alias("conv"), F.max("whole").alias("whole"))
    sequences = materialize(sequences, "trie-sequences")

    # Prefixes of one conversation per distinct sequence, each with its own turn's hashes to step back to its parent.
    own = {f"o{k}": F.col(k) for k in LANES}
    of_sequences = rows.join(sequences.select("conv", "weight", "whole", F.col("depth").alias("length")), "conv")
    stepped = of_sequences.withColumns(own).drop(*LANES)
    sums = {k: F.col(f"o{k}") for k in LANES} | {"upto": F.col("size")}
    prefixes = materialize(running(stepped, "conv", ["depth"], sums, "trie-pieces"), "trie-prefixes")

    inner = prefixes.where("depth < length").select(*NODE)
    leaves = materialize(sequences.join(inner, NODE, "left_anti").select("conv", F.lit(1).cast("long").alias("leaf")), "trie-leaves")
    flagged = prefixes.join(leaves, "conv", "left").withColumns({
        "leaf": F.coalesce("leaf", F.lit(0)), "rest": F.col("whole") - F.col("upto") + F.col("size"),
    })
    found = flagged.groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("conv").alias("conv_id"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * F.col("rest")).alias("all_tokens"), F.min(F.when(F.col("leaf") == 1, F.col("conv"))).alias("owner"),
        F.max("size").alias("size"), F.max("upto").alias("upto"), *[F.max(F.col(k) - F.col(f"o{k}")).alias(f"p{k}") for k in LANES],
    )
    found = materialize(found, "trie-nodes")
    owned = found.groupBy("owner").agg(F.min(F.struct("depth", (F.col("upto") - F.col("size")).alias("before"))).alias("first"))
    owned = owned.select(F.col("owner").alias("conv"), F.col("first.depth").alias("start"), F.col("first.before").alias("before"))
    distinct = flagged.where("leaf = 1").join(owned, "conv").groupBy(*NODE).agg(
        F.sum(F.when(F.col("depth") >= F.col("start"), F.col("rest")).otherwise(F.col("whole") - F.col("before"))).alias("once_tokens")
    )
    up = [(F.col("depth") - 1).alias("depth"), *[F.col(f"p{k}").alias(k) for k in LANES]]
    children = found.where("depth > 0").select(*up).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    counted = found.join(distinct, NODE).join(children, NODE, "left").join(end_lists(wholes), NODE, "left")
    parents = found.select(
        (F.col("depth") + 1).alias("_depth"), *[F.col(k).alias(f"_{k}") for k in LANES], F.col("conv_id").alias("parent_conv_id")
    )
    same = F.col("depth") == F.col("_depth")
    for k in LANES:
        same = same & (F.col(f"p{k}") == F.col(f"_{k}"))
    return counted.join(parents, same & (F.col("depth") > 0), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        (F.col("all_tokens") - F.col("once_tokens")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
