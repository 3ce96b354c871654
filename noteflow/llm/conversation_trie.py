"""Prefix trie of conversations by block hashing.

A conversation is cut into blocks of a fixed number of turns.  The digests of the blocks before a
block, added up along the conversation, name the prefix it continues, so all conversations are grouped
block by block in one aggregation, however deep they are.  Only where several different blocks
continue one prefix are turn boundaries looked at one by one, and then once per different block, not
per conversation.

A node is known by the smallest conversation through it and its depth.  The nodes of one conversation
are a chain from some depth down to its end, hung below a node of a smaller conversation; sums over
subtrees take a doubling walk over the tree of chains and a running sum along each chain, so their
rounds grow with the logarithm of the nesting of chains, not with depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import store

S = ("s0", "s1", "s2", "s3")  # sums of four 40-bit parts of the block digests: room for 2^23 blocks
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def place_turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(conv, at, digest, chars) of every turn and (conv, length) of every conversation, stored.

    Turns are ordered by ``turn_col`` (null first), equal ones by the digest of role and text; a null role
    or text is empty.  Rows without a conversation are left out.  Rows are dealt by range, so
    a conversation of any length is numbered in pieces.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    named = F.unhex(F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256))
    turns = conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), F.substring(named, 1, 16).alias("digest"), F.char_length(text).alias("chars"),
        F.monotonically_increasing_id().alias("tie"))  # equal rows may lie in several ranges
    order = ["conv", "turn", "digest", "tie"]
    dealt = store(turns.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", "digest", "chars", F.monotonically_increasing_id().alias("row")), "turns").withColumn("range", F.shiftright("row", 33))
    held = dealt.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # only conversations over a border of ranges have turns before a range: at most one row per range
    earlier = held.withColumn("before", F.sum("n").over(before)).filter("before is not null").select("conv", "range", "before")
    inside = F.row_number().over(Window.partitionBy("range", "conv").orderBy("row")) - 1
    placed = dealt.withColumn("at", inside).join(earlier, ["conv", "range"], "left")
    placed = placed.select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "digest", "chars")
    return placed, store(held.groupBy("conv").agg(F.sum("n").alias("length")), "lengths")


def share_openings(placed: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations whose first h = crc32(id) % 6 turns are those of the conversation id - id % 100, as far as it has them.

    Takes and returns what ``place_turns`` does, with ``length`` on the turns as well.
    """
    base = F.col("conv") - F.col("conv") % 100
    opening = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    bases = lengths.filter(F.col("conv") % 100 == 0).select(F.col("conv").alias("base"), F.col("length").alias("base_length"))
    taken = F.least("h", F.coalesce("base_length", F.lit(0)))
    plan = lengths.select("conv", "length", base.alias("base"), opening.alias("h")).join(bases, "base", "left")
    plan = store(plan.select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")), "openings")
    own = placed.filter(F.col("at") >= opening).join(plan.select("conv", "h", "taken", "length"), "conv")
    own = own.select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "digest", "chars", "length")
    heads = placed.filter((F.col("conv") % 100 == 0) & (F.col("at") < 5)).withColumnRenamed("conv", "base")
    lent = plan.filter("taken > 0").join(heads, "base").filter("at < taken").select("conv", "at", "digest", "chars", "length")
    return own.unionByName(lent), plan.select("conv", "length")


def _parts(block: Column, content: Column) -> list[Column]:
    """Four numbers below 2^40 for a whole block in its place."""
    digest = F.sha2(F.concat(F.encode(block.cast("string"), "UTF-8"), F.lit(bytearray(b":")), content), 256)
    return [F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 10).cast("bigint") for i in range(4)]


def _name(block: Column, sums: list[Column], content: Column) -> Column:
    """16 bytes for the node reached by the blocks of ``sums`` and then the turns of ``content``."""
    before = F.concat_ws(",", block.cast("string"), *[s.cast("string") for s in sums])
    return F.substring(F.unhex(F.sha2(F.concat(F.encode(before, "UTF-8"), F.lit(bytearray(b":")), content), 256)), 1, 16)


def _node(block: Column, sums: list[Column], content: Column, turns: Column, width: int) -> Column:
    """Name of the node ``turns`` turns into a block; a whole block's is that of the next block's start."""
    full = _name(block + 1, [s + p for s, p in zip(sums, _parts(block, content))], F.lit(bytearray(b"")))
    return F.when(turns == width, full).otherwise(_name(block, sums, content))


def block_rows(turns: DataFrame, width: int, chunk: int) -> DataFrame:
    """conv, block, size, content (its digests), chars, last and the sums of the blocks before it, for every block."""
    cut = turns.withColumn("block", F.floor(F.col("at") / width)).withColumn("chunk", F.floor(F.col("block") / chunk))
    # one exchange: blocks and running sums both lie within (conversation, chunk)
    cut = cut.repartition("conv", "chunk").groupBy("conv", "chunk", "block").agg(
        F.sort_array(F.collect_list(F.struct("at", "digest", "chars"))).alias("turns"), F.first("length").alias("length"))
    cut = cut.select("conv", "chunk", "block", "length", F.size("turns").alias("size"), F.col("turns.chars").alias("chars"),
                     F.aggregate("turns.digest", F.lit(bytearray(b"")), lambda a, d: F.concat(a, d)).alias("content"))
    cut = cut.select("*", *[p.alias(f"p{i}") for i, p in enumerate(_parts(F.col("block"), F.col("content")))])
    inside = Window.partitionBy("conv", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cut = store(cut.select("*", *[F.coalesce(F.sum(f"p{i}").over(inside), F.lit(0)).alias(s) for i, s in enumerate(S)]), "blocks")
    # only conversations of several chunks have sums to carry
    sums = cut.filter(F.col("length") > width * chunk).groupBy("conv", "chunk").agg(*[F.sum(f"p{i}").alias(f"c{i}") for i in range(4)])
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("conv", "chunk", *[F.sum(f"c{i}").over(before).alias(f"b{i}") for i in range(4)]).filter("b0 is not null")
    joined = cut.join(carried, ["conv", "chunk"], "left")
    return joined.select("conv", "block", "size", "content", "chars", (F.col("block") * width + F.col("size") == F.col("length")).alias("last"),
                         *[(F.col(s) + F.coalesce(f"b{i}", F.lit(0))).alias(s) for i, s in enumerate(S)])


def ends_digest(ends: DataFrame, run: int = 1000) -> DataFrame:
    """node, ends_sha256 of the ascending conversations of each node in ``ends`` (node, conv), joined by commas.

    The text of a node is made in pieces of ``run`` conversations on all tasks; the hash, which has to read
    it in order, streams over the pieces and holds one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, rows in groupby(zip(batch.column("node").to_pylist(), batch.column("conv").to_pylist()), key=lambda r: r[0]):
                convs = [c for _, c in rows]
                out += [(node, convs[i], ",".join(map(str, convs[i:i + run]))) for i in range(0, len(convs), run)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()),
                                              pa.array([r[2] for r in out], pa.string())], ["node", "first", "text"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = state = None
        for batch in batches:
            done = []
            for name, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                if name == node:
                    state.update(b",")
                else:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["node", "ends_sha256"])

    texts = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(pieces, "node binary, first bigint, text string")
    return texts.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashes, "node binary, ends_sha256 string")


def chain_totals(chains: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """conv and the sums of ``values`` over all chains at or below each chain; ``chains`` has conv, above (null at the root)."""
    while True:
        stored = store(chains, "chains")
        if stored.filter("above is not null").isEmpty():
            return stored.drop("above")
        below = stored.filter("above is not null").groupBy(F.col("above").alias("conv")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        further = stored.select(F.col("conv").alias("above"), F.col("above").alias("further"))
        chains = stored.join(below, "conv", "left").join(further, "above", "left").select(
            "conv", F.col("further").alias("above"), *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])


def prefix_trie(turns: DataFrame, lengths: DataFrame, width: int = 4, chunk: int = 256) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node.

    ``turns`` has conv, at (0-based), digest, chars and length, ``lengths`` conv and length, with
    conversations without turns.  ``width`` turns are a block.  Repeated turns are turns of their own;
    no conversation, no node.
    """
    blocks = store(block_rows(turns, width, chunk), "prefixes")
    key = ["block", *S]
    groups = blocks.groupBy(*key, "content").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.first("chars").alias("chars"))
    groups = store(groups, "groups")
    forks = groups.groupBy(*key).agg(F.count(F.lit(1)).alias("ways"), F.first(F.struct("content", "n", "conv", "chars")).alias("one"))
    forks = store(forks, "forks")
    sums = [F.col(s) for s in S]
    # one prefix may go on in very many ways: its blocks are dealt by their content as well
    salt = F.pmod(F.xxhash64("content"), F.lit(16))
    many = forks.filter("ways > 1").select(*key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(15).cast("bigint"))).alias("salt"))

    def opened(blocks: DataFrame) -> DataFrame:
        rows = blocks.select(*key, "n", "conv", "content", F.posexplode("chars").alias("i", "chars"))
        return rows.select(*key, "n", "conv", "chars", (F.col("i") + 1).alias("turns"), F.substring(F.col("content"), F.lit(1), (F.col("i") + 1) * 16).alias("content"))

    alone = opened(forks.filter("ways = 1").select(*key, "one.*"))
    split = opened(groups.withColumn("salt", salt).join(many, [*key, "salt"])).groupBy(*key, "content", "turns").agg(
        F.sum("n").alias("n"), F.min("conv").alias("conv"), F.first("chars").alias("chars"))
    shorter = F.substring(F.col("content"), F.lit(1), (F.col("turns") - 1) * 16)
    nodes = alone.unionByName(split).select(
        _node(F.col("block"), sums, F.col("content"), F.col("turns"), width).alias("node"), _name(F.col("block"), sums, shorter).alias("parent"),
        (F.col("block") * width + F.col("turns")).alias("depth"), "conv", "n", "chars")
    zero = [F.lit(0)] * 4
    origin = _name(F.lit(0), zero, F.lit(bytearray(b"")))
    root = lengths.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n")).filter("n > 0").select(
        origin.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("bigint").alias("depth"), "conv", "n", F.lit(0).alias("chars"))
    nodes = store(nodes.unionByName(root), "nodes")
    up = nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id"))
    nodes = store(nodes.join(up, "parent", "left").select("node", "depth", "conv", "n", "chars", "parent_conv_id"), "linked")

    # a chain hangs below depth start - 1 of the chain of the node above its first node
    chains = nodes.groupBy("conv").agg(F.min("depth").alias("start"), F.max("depth").alias("end"), F.min_by("parent_conv_id", "depth").alias("above"))
    chains = store(chains, "chain")
    hung = chains.filter("above is not null").select(F.col("above").alias("conv"), (F.col("start") - 1).alias("depth"), F.col("conv").alias("below"))
    kids = hung.groupBy("conv", "depth").agg(F.count(F.lit(1)).alias("kids"))
    children = F.coalesce("kids", F.lit(0)) + (F.col("depth") < F.col("end")).cast("bigint")
    nodes = nodes.join(chains.select("conv", "end"), "conv").join(kids, ["conv", "depth"], "left").select(
        "node", "depth", "conv", "n", "parent_conv_id", children.alias("n_children"), (children == 0).cast("bigint").alias("leaf"), ((F.col("n") - 1) * F.col("chars")).alias("saved"))
    nodes = store(nodes, "valued")
    own = nodes.groupBy("conv").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    totals = chain_totals(chains.select("conv", "above").join(own, "conv"), ("leaf", "saved"))
    under = hung.join(totals.select(F.col("conv").alias("below"), F.col("leaf").alias("more_leaf"), F.col("saved").alias("more_saved")), "below")
    under = under.groupBy("conv", "depth").agg(F.sum("more_leaf").alias("more_leaf"), F.sum("more_saved").alias("more_saved"))
    nodes = nodes.join(under, ["conv", "depth"], "left").withColumn("piece", F.floor(F.col("depth") / (width * chunk)))
    for v in ("leaf", "saved"):
        nodes = nodes.withColumn(v, F.col(v) + F.coalesce(f"more_{v}", F.lit(0)))
    # sums from a node to the end of its chain, in pieces of bounded length
    down = Window.partitionBy("conv", "piece").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    nodes = store(nodes.select("node", "depth", "conv", "n", "parent_conv_id", "n_children", "piece", F.sum("leaf").over(down).alias("leaf"), F.sum("saved").over(down).alias("saved")), "summed")
    long = nodes.join(chains.filter(F.floor(F.col("start") / (width * chunk)) < F.floor(F.col("end") / (width * chunk))).select("conv"), "conv", "left_semi")
    whole = long.groupBy("conv", "piece").agg(F.max("leaf").alias("leaf"), F.max("saved").alias("saved"))
    after = Window.partitionBy("conv").orderBy(F.col("piece").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rest = whole.select("conv", "piece", F.sum("leaf").over(after).alias("more_leaf"), F.sum("saved").over(after).alias("more_saved")).filter("more_leaf is not null")
    nodes = nodes.join(rest, ["conv", "piece"], "left")

    ends = blocks.filter("last").select(_node(F.col("block"), sums, F.col("content"), F.col("size"), width).alias("node"), "conv")
    ends = ends.unionByName(lengths.filter("length = 0").select(origin.alias("node"), "conv"))
    return nodes.join(ends_digest(ends), "node", "left").select(
        F.col("conv").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children",
        (F.col("leaf") + F.coalesce("more_leaf", F.lit(0))).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
