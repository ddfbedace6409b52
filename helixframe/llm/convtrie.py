"""The trie of conversations' beginnings.

A node is a sequence of turns that some conversation begins with; the root is the empty one.
A turn is known by a 16-byte digest of its role and text, so a conversation is an array of digests.
The arrays are sorted by range over all conversations.  Neighbours share as
many nodes as their common prefix is long, so each range is one sweep with a stack of open
nodes: what is deeper than the common prefix is closed, and the rest of the new array opened.
Nodes of a range's first and last conversation may go on beyond it.  Each range
hands over these two paths, and one pass over the ranges, in their order, joins the open
stacks: it reads two paths for each range, and of conversations only those that end where a range does.
Every node knows its parent by range and number in it, so a join gives the parent's row;
the root's children are dealt out by the ranges they stand in.

Conversations with equal arrays are neighbours in order of conv_id, so their ids
run through a hash one after another, also across ranges, and are never gathered.

Results: a null role or text counts as empty.  Turns are in order of turn (null first), then role
and digest; rows that repeat are turns of their own.  Rows without a conv_id belong to no conversation.
A conversation without turns ends at the root.  An empty table has no
conversations, so no nodes.  A conversation's array has 16 bytes for each turn and must fit a row; texts
are never held.  Further columns of any name don't matter.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

TURNS = "array<struct<key:binary,size:long>>"
NODE = "part long, seq long, up_part long, up_seq long, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, last_key binary"
EDGE = "struct<part: long, place: long, first: array<binary>, first_size: array<long>, last: array<binary>, last_size: array<long>, shared: long, sums: array<long>, ends: array<string>, ids: binary, at: long>"
NO_ENDS = hashlib.sha256().hexdigest()
IDS_A_ROW = 65_536


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (key, size): a row for each conversation, its turns in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").alias("turn"), role.alias("role"), key.alias("key"), F.length(text).cast("long").alias("size")).alias("x"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["key"].alias("key"), x["size"].alias("size"))).alias("turns"))


def turn_texts(conversations: DataFrame) -> DataFrame:
    """key, role, text of each distinct turn: what a node's ``last_key`` stands for."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    return conversations.select(key.alias("key"), role.alias("role"), text.alias("text")).distinct()


def shared_openings(arrays: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Lets each conversation begin as the one whose number is its own less the rest by ``every``, for up to ``most`` - 1 turns by the checksum of its number."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    rows = arrays.select("conv_id", "turns", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    heads = arrays.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, max(most - 1, 1)).alias("head"))
    own = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).otherwise(F.array().cast(TURNS))
    lead = F.when(F.col("head").isNull() | (F.col("h") == 0), F.array().cast(TURNS)).otherwise(F.slice("head", F.lit(1), F.greatest("h", F.lit(1))))
    return rows.join(heads, "base", "left").select("conv_id", F.concat(lead, own).alias("turns"))


def common_length(a: list, b: list) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class Node:
    """An open node: sums over what of it has been seen, without children that are still open."""

    __slots__ = ("seq", "size", "key", "n", "least", "children", "leaves", "saved", "hash", "ends", "aliases")

    def __init__(self, seq: int, size: int = 0, key: bytes | None = None):
        self.seq, self.size, self.key, self.aliases = seq, size, key, []
        self.n = self.children = self.leaves = self.saved = 0
        self.least = self.hash = self.ends = None

    def sums(self) -> list[int]:
        return [self.seq, self.n, -1 if self.least is None else 1, self.least or 0, self.children, self.leaves, self.saved]

    def add(self, n: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved
        if least is not None and (self.least is None or least < self.least):
            self.least = least

    def digest(self) -> str:
        return self.ends or (self.hash.hexdigest() if self.hash else NO_ENDS)

    def close(self, up: "Node | None") -> tuple:
        """conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256; added to the parent."""
        leaves = self.leaves if self.children else 1
        saved = self.saved + (self.n - 1) * self.size
        if up is not None:
            up.add(self.n, self.least, 1, leaves, saved)
        return self.least, self.n, self.children, leaves, saved, self.digest()


def add_ids(node: Node, joined: bytes) -> None:
    if node.hash is None:
        node.hash = hashlib.sha256(joined)
    else:
        node.hash.update(b"," + joined)


class Sweep:
    """The sweep of one range: ``take`` each conversation in order, then ``finish``.

    Rows for ``out`` are closed nodes; those for ``edges`` are the ids of conversations like the first or like
    the latest, and at the end the two paths.
    """

    def __init__(self, part: int):
        self.part, self.out, self.edges = part, [], []
        self.first: list | None = None
        self.open_first: list[Node] = []  # nodes of the first conversation, by depth
        self.keys: list = []
        self.stack: list[Node] = []
        self.seq = self.place = 0
        self.ids: list[str] = []
        self.flushed = False

    def push(self, keys: list, sizes: list, begin: int) -> None:
        for d in range(begin, len(keys) + 1):
            self.stack.append(Node(self.seq, sizes[d - 1] if d else 0, keys[d - 1] if d else None))
            self.seq += 1

    def flush(self) -> None:
        """The ids of the group so far go into its hash and, as the group may go on in other ranges, out."""
        if self.ids:
            node, joined = self.stack[-1], ",".join(self.ids).encode()
            add_ids(node, joined)
            self.edges.append({"part": self.part, "place": self.place, "ids": joined, "at": node.seq})
            self.place += 1
            self.ids = []

    def end_group(self) -> None:
        """No more conversations end at the top of the stack."""
        if self.ids and not self.flushed and self.stack[-1] is not self.open_first[-1]:
            add_ids(self.stack[-1], ",".join(self.ids).encode())
            self.ids = []
        self.flush()
        self.flushed = False

    def cut(self, depth: int) -> None:
        """Closes what is deeper; nodes of the first conversation are left for the joining of ranges."""
        while len(self.stack) > depth + 1:
            node, d = self.stack.pop(), len(self.stack)
            if d < len(self.open_first) and self.open_first[d] is node:
                continue
            up = self.stack[-1]
            self.out.append((self.part, node.seq, self.part, up.seq, node.least, d, *node.close(up)[1:], node.key))

    def take(self, conv_id: int, keys: list, sizes: list) -> None:
        if self.first is None:
            self.first, self.first_size = keys, sizes
            self.push(keys, sizes, 0)
            self.open_first = list(self.stack)
        else:
            same = common_length(self.keys, keys)
            if same < len(self.keys) or same < len(keys):
                self.end_group()
                self.cut(same)
                self.push(keys, sizes, same + 1)
        self.keys, self.sizes = keys, sizes
        self.stack[-1].add(1, conv_id, 0, 0, 0)
        self.ids.append(str(conv_id))
        if len(self.ids) >= IDS_A_ROW:
            self.flush()
            self.flushed = True

    def finish(self) -> None:
        if self.first is None:
            return
        self.flush()
        shared = common_length(self.first, self.keys)
        tail = self.stack[shared + 1 :]
        nodes = self.open_first + tail
        group = {self.open_first[-1].seq, self.stack[-1].seq}
        ends = [None if node.seq in group or node.hash is None else node.hash.hexdigest() for node in nodes]
        row = {"part": self.part, "place": -1, "first": self.first, "first_size": self.first_size, "last": self.keys, "last_size": self.sizes, "shared": shared, "ends": ends}
        self.edges.append(row | {"sums": [x for node in nodes for x in node.sums()]})


class Stitch:
    """Joins the open stacks of ranges, whose edges are taken in order, a range's paths before its ids.

    Rows of ``out`` are nodes as in NODE and, for each further range that a node stands in,
    its range, its number there and its conv_id.
    """

    def __init__(self):
        self.out: list = []
        self.stack: list[Node] = []
        self.path: list = []
        self.row: dict | None = None  # whose last path is not yet entered
        self.leaf: Node | None = None
        self.at = -1

    def cut(self, depth: int) -> None:
        while len(self.stack) > depth + 1:
            node = self.stack.pop()
            up = self.stack[-1] if self.stack else None
            least, *rest = node.close(up)
            to = up.aliases[0] if up else (None, None)
            self.out.append((*node.aliases[0], *to, least, len(self.stack), *rest, node.key))
            self.out += [(part, seq, None, None, least, *[None] * 7) for part, seq in node.aliases[1:]]

    def enter(self, row: dict, depth: int, which: str, k: int) -> None:
        """Adds the k-th node of a row's paths, which is at some depth of its first or last."""
        if depth == len(self.stack):
            self.stack.append(Node(0, row[which + "_size"][depth - 1], row[which][depth - 1]) if depth else Node(0))
        seq, n, some, least, children, leaves, saved = row["sums"][7 * k : 7 * k + 7]
        node = self.stack[depth]
        node.add(n, least if some > 0 else None, children, leaves, saved)
        node.aliases.append((row["part"], seq))
        node.ends = node.ends or row["ends"][k]
        self.leaf, self.at = node, seq

    def settle(self) -> None:
        """Goes from the first path of the row to its last."""
        row, self.row = self.row, None
        if row is None:
            return
        self.cut(row["shared"])
        for k, depth in enumerate(range(row["shared"] + 1, len(row["last"]) + 1), len(row["first"]) + 1):
            self.enter(row, depth, "last", k)

    def take(self, row: dict) -> None:
        if row["ids"] is None:
            self.settle()
            self.cut(common_length(self.path, row["first"]) if self.stack else -1)
            self.row, self.path = row, row["last"]
            for depth in range(len(row["first"]) + 1):
                self.enter(row, depth, "first", depth)
            return
        if row["at"] != self.at and self.row is not None and row["at"] == self.row["sums"][-7]:
            self.settle()
        if row["at"] == self.at:
            add_ids(self.leaf, row["ids"])

    def finish(self) -> None:
        self.settle()
        self.cut(-1)


LONG, BYTES = pa.int64(), pa.binary()
NODE_TYPES = [LONG] * 10 + [pa.string(), BYTES]
NODE_NAMES = [field.split()[0] for field in NODE.split(", ")]
EDGE_TYPE = pa.struct([
    ("part", LONG), ("place", LONG), ("first", pa.list_(BYTES)), ("first_size", pa.list_(LONG)), ("last", pa.list_(BYTES)), ("last_size", pa.list_(LONG)),
    ("shared", LONG), ("sums", pa.list_(LONG)), ("ends", pa.list_(pa.string())), ("ids", BYTES), ("at", LONG),
])
ROWS_A_BATCH = 4096


def node_columns(rows: list) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(NODE_TYPES), NODE_TYPES)]


def swept(batches):
    """Nodes and edges of one range, rows of (part, conv_id, turns) in order."""
    sweep = None

    def drained():
        nodes, edges = sweep.out, sweep.edges
        sweep.out, sweep.edges = [], []
        both = [pa.concat_arrays([c, pa.nulls(len(edges), c.type)]) for c in node_columns(nodes)]
        yield pa.RecordBatch.from_arrays([*both, pa.concat_arrays([pa.nulls(len(nodes), EDGE_TYPE), pa.array(edges, EDGE_TYPE)])], [*NODE_NAMES, "edge"])

    for batch in batches:
        for part, conv_id, turns in zip(*(batch.column(c).to_pylist() for c in ("part", "conv_id", "turns"))):
            if sweep is None:
                sweep = Sweep(part)
            sweep.take(conv_id, [t["key"] for t in turns], [t["size"] for t in turns])
            if len(sweep.out) >= ROWS_A_BATCH:
                yield from drained()
    if sweep is not None:
        sweep.finish()
        yield from drained()


def stitched(batches):
    whole = Stitch()

    def drained():
        rows, whole.out = whole.out, []
        yield pa.RecordBatch.from_arrays(node_columns(rows), NODE_NAMES)

    for batch in batches:
        for row in batch.column("edge").to_pylist():
            whole.take(row)
            if len(whole.out) >= ROWS_A_BATCH:
                yield from drained()
    whole.finish()
    if whole.out:
        yield from drained()


def prefix_trie(arrays: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of conversations (conv_id, turns) as ``turn_arrays`` gives them.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (over a
    node's subtree: members but one times the code points of the last turn), ends_sha256 (of the
    ids of conversations that end there, ascending, joined by commas), last_key.
    """
    held = scratch.keep(arrays)
    keys = F.transform("turns", lambda x: x["key"])
    ranged = held.select("conv_id", "turns", keys.alias("keys")).repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    numbered = ranged.select(F.spark_partition_id().cast("long").alias("part"), "conv_id", "turns")
    found = scratch.keep(numbered.mapInArrow(swept, f"{NODE}, edge {EDGE}"))
    edges = found.where(F.col("edge").isNotNull()).select("edge").repartition(1).sortWithinPartitions("edge.part", "edge.place")
    joined = scratch.keep(edges.mapInArrow(stitched, NODE))
    nodes = found.where(F.col("edge").isNull()).drop("edge").unionByName(joined)
    parents = nodes.where(F.col("depth").isNull() | (F.col("n_children") > 0)).select(F.col("part").alias("up_part"), F.col("seq").alias("up_seq"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.where(F.col("depth").isNotNull()).join(parents, ["up_part", "up_seq"], "left")
    return scratch.result(named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "last_key"))

