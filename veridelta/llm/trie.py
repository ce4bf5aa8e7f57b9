"""Prefix trie of conversations: every prefix of every conversation, counted together by ROLLUP over positional turn columns.

A conversation is a row of blocks of ``WIDTH`` turn columns. ``GROUP BY block, key, ROLLUP (t1, ..., t8)`` makes the nodes of a
block, and ``grouping_id`` tells how deep each is; a block's key stands for all turns before it, so blocks beyond the first are
counted by the same statement, however long a conversation is.

Sums over subtrees need no walk down the tree. A node belongs to its smallest member, and a member's own nodes are the
deepest part of its path. So what a subtree holds is what its members own, less what its first member owns above it:
a second ROLLUP adds up what members own.

Nulls: rows without a conv_id take no part; a null turn comes first, null role and text are empty. Turns of equal number are
ordered by their content's digest. A table without conversations has no nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, running_total, tune

#: Turn columns of a block.
WIDTH = 8
TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]
#: Conversation ids whose decimals are joined in one row, at most: ids that share all but their low 12 bits.
LOW_BITS = 12
#: Two seeds: a key has 128 bits.
SEEDS = {"k1": 11, "k2": 12}


def turn_id(role: Column, text: Column) -> Column:
    """20 bytes: a digest of role and text (16), and the text's UTF-8 length (4)."""
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    return F.concat(F.substring(digest, 1, 16), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")))


def text_bytes(turn: Column) -> Column:
    """The length that a turn id carries."""
    return F.conv(F.hex(F.substring(turn, 17, 4)), 16, 10).cast("long")


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn id): each conversation's turns in order, counted from 0.

    Places come from a two-level running count, so a conversation of any length is no task's whole work.
    """
    given = conversations.where("conv_id is not null")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = given.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_id(role, text).alias("id"))
    late = F.struct(F.col("turn").isNotNull(), F.coalesce(F.shiftright("turn", 8), F.lit(0)))
    return running_total(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("id")], F.lit(1), late, "pos").select("conv_id", F.col("pos").cast("long").alias("pos"), "id")


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """(conv_id, pos, id, size): conversations that begin as the first of their family of ``family`` ids does.

    Conversation c takes the first crc32(c) % ``heads`` turns of conversation c - c % ``family`` and goes on with its own
    turns after its first so many. A conversation that is left without turns is one row without pos and id.
    """
    lengths = materialize(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conversation-lengths")
    head = (F.crc32(F.col("conv_id").cast("string")) % heads).alias("h")
    each = lengths.select("conv_id", "n", head, (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    first = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    plan = each.join(first, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size"))
    plan = materialize(plan, "conversation-plans")
    own = turns.join(plan, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "size")
    begun = turns.where(F.col("pos") < heads - 1).withColumnRenamed("conv_id", "base")
    shared = begun.join(plan, "base").where("pos < taken").select("conv_id", "pos", "id", "size")
    empty = plan.where("size = 0").select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("binary").alias("id"), "size")
    return own.unionByName(shared).unionByName(empty)


def _hashed(name: str, turns: list[str] | None = None) -> Column:
    """One half of the key of a block's turns. Columns without a turn don't count."""
    return F.xxhash64(F.lit(SEEDS[name]), "block", *(TURNS if turns is None else turns))


def blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, size, block, k1, k2, t1, ..., t8): rows of turn columns; k1 and k2 stand for all turns before the block."""
    place = F.coalesce(F.col("pos") % WIDTH, F.lit(0))
    cells = [F.max(F.when(place == i, F.col("id"))).alias(t) for i, t in enumerate(TURNS)]
    wide = materialize(turns.groupBy("conv_id", F.coalesce(F.expr(f"pos div {WIDTH}"), F.lit(0)).alias("block")).agg(F.max("size").alias("size"), *cells), "turn-blocks")
    short = wide.where(F.col("size") <= WIDTH).withColumns({k: F.lit(0).cast("long") for k in SEEDS})
    # keys of longer ones: exclusive or of the blocks before, summed in two levels
    long = wide.where(F.col("size") > WIDTH).withColumn("part", F.shiftright("block", 8))
    own = {k: _hashed(k) for k in SEEDS}
    parts = long.groupBy("conv_id", "part").agg(*[F.bit_xor(h).alias(f"of_{k}") for k, h in own.items()])
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    earlier = before(Window.partitionBy("conv_id").orderBy("part"))
    parts = parts.select("conv_id", "part", *[F.coalesce(F.bit_xor(f"of_{k}").over(earlier), F.lit(0)).alias(f"of_{k}") for k in SEEDS])
    inside = before(Window.partitionBy("conv_id", "part").orderBy("block"))
    keyed = long.select(*wide.columns, "part", *[F.coalesce(F.bit_xor(h).over(inside), F.lit(0)).alias(f"in_{k}") for k, h in own.items()])
    keyed = keyed.join(parts, ["conv_id", "part"]).withColumns({k: F.col(f"of_{k}").bitwiseXOR(F.col(f"in_{k}")) for k in SEEDS})
    return short.unionByName(keyed.select(*short.columns))


def _rolled_up(rows: DataFrame, aggregates: str) -> DataFrame:
    """The rows' prefixes with aggregates over their members: t1, ..., t8 as deep as the prefix, depth in the block as ``k``."""
    found = rows.sparkSession.sql(
        f"select block, k1, k2, {', '.join(TURNS)}, {WIDTH} - bit_count(grouping_id()) as k, {aggregates} from {{rows}} group by block, k1, k2, rollup ({', '.join(TURNS)})",
        rows=rows,
    )
    # a prefix ends in a turn (else the column is empty as the conversation has ended), and only the first block has a root
    return found.where((F.col("k") == 0) & (F.col("block") == 0) | F.element_at(F.array(*TURNS), F.greatest("k", F.lit(1))).isNotNull() & (F.col("k") > 0))


def _digest_of_ids(ended: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): SHA-256 of the ids that end at each node, ascending and comma-joined.

    Ids are joined by ranges of 4,096; a node with more than one range is hashed range by range, so no node's ids are ever one row.
    """
    ranges = ended.groupBy("k1", "k2", F.shiftright("conv_id", LOW_BITS).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ranges = materialize(ranges, "node-ends")
    counted = ranges.groupBy("k1", "k2").agg(F.count("*").alias("parts"), F.max("ids").alias("ids"))
    alone = counted.where("parts = 1").select("k1", "k2", F.sha2("ids", 256).alias("ends_sha256"))

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        key, state = None, None
        for frame in frames:
            done = []
            for k1, k2, ids in zip(frame["k1"], frame["k2"], frame["ids"], strict=True):
                if (k1, k2) != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=["k1", "k2", "ends_sha256"], dtype=object)
        if key is not None:
            yield pd.DataFrame([(*key, state.hexdigest())], columns=["k1", "k2", "ends_sha256"], dtype=object)

    many = ranges.join(counted.where("parts > 1").select("k1", "k2"), ["k1", "k2"])
    many = many.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "part").mapInPandas(hashed, "k1 long, k2 long, ends_sha256 string")
    return alone.unionByName(many)


def nodes(turns: DataFrame) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv_id, pos, id, size), as ``rebuilt`` gives them.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a node is named by its smallest
    member and its depth.
    """
    spark = turns.sparkSession
    tune(spark)
    placed = blocks(turns)
    found = _rolled_up(placed, "count(*) as n, min(struct(conv_id, size)) as own, max(size) as deepest")
    depth = F.col("block") * WIDTH + F.col("k")
    last = F.element_at(F.array(*TURNS), F.greatest("k", F.lit(1)))

    def key(name: str, k: int) -> Column:
        return F.col(name).bitwiseXOR(_hashed(name, TURNS[:k])) if k else F.col(name)

    def at(name: str, less: int) -> Column:
        """The key of the node, or of that above it (``less`` 1)."""
        return F.coalesce(*[F.when(F.col("k") == k, key(name, k - less)) for k in range(less, WIDTH + 1)])

    found = materialize(
        found.select(
            F.col("own.conv_id").alias("conv_id"), depth.alias("depth"), F.col("n").alias("n_convs"), *[at(k, 0).alias(k) for k in SEEDS], *[at(k, 1).alias(f"above_{k}") for k in SEEDS],
            F.when(F.col("k") > 0, (F.col("n") - 1) * text_bytes(last)).otherwise(0).alias("saved"), (F.col("deepest") == depth).cast("long").alias("childless"),
            (F.col("own.size") > depth).cast("long").alias("goes_on"),
        ),
        "trie-nodes",
    )
    owned = found.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("all_saved"), F.max_by("childless", "depth").alias("leaf"), F.min_by(F.struct(*[f"above_{k}" for k in SEEDS]), "depth").alias("above"))
    names = found.select(*SEEDS, F.col("conv_id").alias("parent"))
    hung = owned.select("*", *[F.col(f"above.above_{k}").alias(k) for k in SEEDS]).drop("above").join(names, list(SEEDS), "left").drop(*SEEDS)
    hung = materialize(hung, "trie-owners")  # a conversation that owns nodes, its topmost one, and whose node that hangs from
    branches = hung.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.count("*").alias("branches"))
    worth = hung.select("conv_id", "all_saved", "leaf")
    sums = _rolled_up(placed.join(worth, "conv_id", "left"), "min(conv_id) as conv_id, coalesce(sum(all_saved), 0) as below, coalesce(sum(leaf), 0) as leaves")
    sums = sums.select("conv_id", depth.alias("depth"), "below", "leaves")
    final = F.col("block") == F.expr(f"greatest(size - 1, 0) div {WIDTH}")
    ended = placed.where(final).select("conv_id", *[F.when(F.col("size") == 0, 0).otherwise(F.col(k).bitwiseXOR(_hashed(k))).alias(k) for k in SEEDS])
    above = running_total(found, ["conv_id"], [F.col("depth")], F.col("saved"), F.shiftright("depth", 8), "above_saved")
    joined = above.join(sums, ["conv_id", "depth"]).join(branches, ["conv_id", "depth"], "left").join(hung.select("conv_id", "top", "parent"), "conv_id").join(_digest_of_ids(ended), list(SEEDS), "left")
    return joined.select(
        "conv_id", "depth", F.when(F.col("depth") == 0, None).when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
        (F.col("goes_on") + F.coalesce("branches", F.lit(0))).alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("below") - F.col("above_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie's nodes for conversations that are rebuilt by families of five."""
    return nodes(rebuilt(materialize(numbered(conversations), "numbered-turns")))
