"""Prefix trie of conversations, its subtree totals by leaf-peeling message passing.

A prefix of turns is known by 128 bits: the exclusive or of hashes of its turns with their depths, which is
a running total and so needs no task that sees a whole conversation.  Conversations with the same prefix
are the members of a node.

Every node is led by the member with the least hash of its id.  A member that leads a node leads all below
it on its own way, so nodes fall into chains, one a leader, and a chain hangs on a node of another chain.
Chains hold counters of the chains that still hang on them.  In each round those at 0 send their totals to
the node that they hang on and are done, until only the root's is left.  Because leaders are chosen by
hash, a way from a leaf to the root crosses about ln(conversations) chains at most, whatever the trie looks
like: that bounds the rounds.  Within chains totals are running totals from the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.operators import numbering

from .common import staged

NODE = ["depth", "p", "q"]
#: Ids in one piece of a node's list of ends; characters of a text that order turns of the same number.
PIECE, SHOWN = 8192, 1000
EMPTY = hashlib.sha256(b"").hexdigest()


def placed_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, pos, x, y, size, _part): each turn's place in its conversation from 1, two hashes, and its text's code points; a table.

    Null turns come first; turns of the same number are ordered by role, by their texts' first SHOWN characters, then by hash.
    """
    t = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.select("c", "turn", F.substring("role", 1, SHOWN).alias("r"), F.substring("text", 1, SHOWN).alias("s"), F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(5), "text", "role").alias("y"), F.length("text").cast("long").alias("size"))
    order = [F.asc_nulls_first("turn"), "r", "s", "x", "y"]
    return numbering.running(t, ["c"], order, {"pos": ("sum", F.lit(1).cast("long"))}, partial(staged, label="trie-turns"), drop=("turn", "r", "s")).drop("_row")


def with_shared_heads(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the heads of others: (rows (c, depth, x, y, size, last), conversations (c, len)).

    Conversation c gets the first h = crc32(c) % most turns of c - c % every (fewer where that has fewer),
    then its own from h + 1 on.  last marks a conversation's last turn; len is how many it has, 0 included.
    """
    convs = turns.groupBy("c").agg(F.max("pos").alias("n"))
    head = turns.where((F.col("c") % every == 0) & (F.col("pos") < most)).groupBy(F.col("c").alias("b")).agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y", "size"))).alias("head"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % most
    known = convs.withColumn("b", F.col("c") - F.col("c") % every).join(head, "b", "left").withColumn("h", h)
    known = known.withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:long,x:long,y:long,size:long>>")), F.lit(1), F.col("h").cast("int")))
    known = known.withColumn("k", F.size("head").cast("long")).select("c", "h", "k", "head", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))
    known = staged(known, "trie-conversations")
    taken = known.select("c", "len", F.explode("head").alias("t")).select("c", F.col("t.pos").alias("depth"), "t.x", "t.y", "t.size", (F.col("t.pos") == F.col("len")).alias("last"))
    # a long conversation is met in each of its parts, so that no task gets it whole
    parts = turns.select("c", "_part").distinct().join(known.select("c", "h", "k", "len"), "c")
    own = turns.join(parts, ["c", "_part"]).where("pos > h").withColumn("depth", F.col("k") + F.col("pos") - F.col("h"))
    own = own.select("c", "depth", "x", "y", "size", (F.col("depth") == F.col("len")).alias("last"))
    return taken.unionByName(own), known.select("c", "len")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with their own turns: what with_shared_heads returns."""
    convs = staged(turns.groupBy("c").agg(F.max("pos").alias("len")), "trie-conversations")
    parts = turns.select("c", "_part").distinct().join(convs, "c")
    rows = turns.join(parts, ["c", "_part"]).select("c", F.col("pos").alias("depth"), "x", "y", "size", (F.col("pos") == F.col("len")).alias("last"))
    return rows, convs


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (depth, p, q, c) to pieces of each node's list of ids, numbered over the table."""
    part, n = TaskContext.get().partitionId(), 0
    node, ids = None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([(part << 33) + n], pa.int64()), pa.array([",".join(map(str, ids))])], names=[*NODE, "place", "piece"])

    for b in batches:
        for *at, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if at != node or len(ids) >= PIECE:
                if ids:
                    yield made()
                    n += 1
                node, ids = at, []
            ids.append(c)
    if ids:
        yield made()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces, sorted by node and place, to the digest of each node's whole list."""
    node, sha = None, None
    for b in batches:
        out = []
        for *at, piece in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if at != node:
                if node:
                    out.append((*node, sha.hexdigest()))
                node, sha = at, hashlib.sha256(piece.encode())
            else:
                sha.update(b"," + piece.encode())
        if out:
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in list(zip(*out, strict=True))[:3]), pa.array([x[3] for x in out])], names=[*NODE, "ends_sha256"])
    if node:
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in node), pa.array([sha.hexdigest()])], names=[*NODE, "ends_sha256"])


def ends_of(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, c): SHA-256 of the ids that end at the node, ascending, joined by commas.

    Lists are dealt out by ranges and joined to pieces; a digest then takes its node's pieces one after the other.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = ends.select(*NODE, "c").repartitionByRange(n, *NODE, "c").sortWithinPartitions(*NODE, "c").mapInArrow(_pieces, "depth long, p long, q long, place long, piece string")
    return pieces.repartition(n, *NODE).sortWithinPartitions(*NODE, "place").mapInArrow(_digests, "depth long, p long, q long, ends_sha256 string")


def peeled(chains: DataFrame) -> DataFrame:
    """(rep, parent, attach, saved, leaves) with totals that include all chains below; chains has `remaining` besides: how many hang on each.

    A round for each level of chains; one number a round reaches the driver.
    """
    active, done = staged(chains, "trie-chains"), []
    while True:
        ready = active.where("remaining = 0").select("rep", "parent", "attach", "saved", "leaves")
        done.append(ready)
        told = ready.where("parent IS NOT NULL").groupBy(F.col("parent").alias("rep")).agg(F.count("*").alias("n"), F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        rest = active.where("remaining > 0").join(told, "rep", "left").select(
            "rep", "parent", "attach", (F.col("remaining") - F.coalesce("n", F.lit(0))).alias("remaining"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves")
        )
        active = staged(rest, "trie-chains")
        if active.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of rows (c, depth, x, y, size, last) and convs (c, len); columns as of prefix_trie."""
    keep = partial(staged, label="trie-prefixes")
    t = F.xxhash64("depth", "x", "y"), F.xxhash64("y", F.lit(11), "x", "depth")
    prefixes = keep(numbering.running(rows.withColumns({"t": t[0], "u": t[1]}), ["c"], ["depth"], {"p": ("bit_xor", F.col("t")), "q": ("bit_xor", F.col("u"))}, keep).drop("_part", "_row", "x", "y"))
    lead = F.min(F.struct(F.xxhash64("c", F.lit(3)).alias("h"), "c"))["c"].alias("rep")
    nodes = prefixes.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), lead, F.max("size").alias("size"), F.max("t").alias("t"), F.max("u").alias("u"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), lead).where("n_convs > 0").select(*(zero.alias(c) for c in NODE), "n_convs", "conv_id", "rep", *(zero.alias(c) for c in ("size", "t", "u")))
    # a node's parent is known by what its own turn adds taken off again
    up = {"pd": F.col("depth") - 1, "pp": F.col("p").bitwiseXOR(F.col("t")), "pq": F.col("q").bitwiseXOR(F.col("u"))}
    nodes = staged(nodes.unionByName(root).withColumns(up).drop("t", "u"), "trie-nodes")
    parents = nodes.select(F.col("depth").alias("pd"), F.col("p").alias("pp"), F.col("q").alias("pq"), F.col("conv_id").alias("parent_conv_id"), F.col("rep").alias("parent"))
    kids = nodes.where("depth > 0").groupBy(F.col("pd").alias("depth"), F.col("pp").alias("p"), F.col("pq").alias("q")).agg(F.count("*").alias("n_children"))
    # many children of one parent are split by Spark at run time: both sides of a merge join come straight from tables
    nodes = nodes.join(parents.hint("merge"), ["pd", "pp", "pq"], "left").drop("pd", "pp", "pq").join(kids, NODE, "left")
    own = (F.col("n_convs") - 1) * F.col("size")
    nodes = staged(nodes.withColumn("n_children", F.coalesce("n_children", zero)).withColumns({"own": own, "leaf": (F.col("n_children") == 0).cast("long")}), "trie-nodes")

    chains = nodes.groupBy("rep").agg(F.min_by("parent", "depth").alias("parent"), (F.min("depth") - 1).alias("attach"), F.sum("own").alias("saved"), F.sum("leaf").alias("leaves"))
    chains = staged(chains, "trie-chains")
    hanging = chains.where("parent IS NOT NULL").groupBy(F.col("parent").alias("rep")).agg(F.count("*").alias("remaining"))
    totals = peeled(chains.join(hanging, "rep", "left").withColumn("remaining", F.coalesce("remaining", zero)))
    hung = totals.where("parent IS NOT NULL").groupBy(F.col("parent").alias("rep"), F.col("attach").alias("depth")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    weighed = nodes.join(hung, ["rep", "depth"], "left").withColumns({"w": F.col("own") + F.coalesce("s", zero), "v": F.col("leaf") + F.coalesce("l", zero)})
    below = numbering.running(weighed, ["rep"], [F.desc("depth")], {"saved_tokens": ("sum", F.col("w")), "n_leaves": ("sum", F.col("v"))}, keep)
    ends = prefixes.where("last").select(*NODE, "c").unionByName(convs.where("len = 0").select(*(zero.alias(c) for c in NODE), "c"))
    out = below.join(ends_of(ends), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, rebuild=as_they_are, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per distinct sequence of first turns (role, text), from the root at depth 0.

    conv_id: the smallest member, a member being a conversation that starts with the sequence; depth;
    parent_conv_id: the parent's conv_id, null for the root; n_convs; n_children; n_leaves: childless nodes
    in the subtree, itself included; saved_tokens: over the subtree, (n_convs - 1) times the code points of the
    node's last text; ends_sha256: digest of the ids of the members that end here.

    Ids are whole numbers (others raise).  Rows without an id are left out; null roles and texts are
    empty; rows that repeat are turns of their own, and see placed_turns for ties.  No conversations give no node,
    not even a root.  Other columns are not read.  rebuild: see with_shared_heads.
    """
    turns = placed_turns(conversations, conv, turn, role, text)
    return trie(*rebuild(turns))
