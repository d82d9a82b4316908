"""The trie of shared conversation prefixes.

Turns become dictionary ids, so texts are read once and only their digests are shuffled. The id
sequences are cut into range shards of their sorted order. A shard holds its sequences in a ternary search
tree, inserted median first, so that the siblings of a node form a balanced tree; an iterative walk adds up
members, leaves and savings from below. Only nodes on the paths of a shard's first and last sequence can
go on in a neighbour: these two paths per shard are merged in one pass over the shards' order, whose
memory is one path. The list of conversations that end in a node is hashed piece by piece in that order,
so a sequence that a third of all conversations share may span any number of shards.

Defined cases: null role and text are empty; turns are ordered by number (null first), equal numbers by
the digest of their content; a repeated row is a turn of its own; rows without conv_id belong to no
conversation; a conversation may end up without turns and is then a member of the root alone; an empty table
has no nodes; other columns are ignored, whatever their names. Texts may be of any length; a
conversation's ids (16 bytes a turn) must fit a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from presswire.llm.common import written
from presswire.session import ship_package

#: Conversations of one family share the first turns of its first one.
FAMILY = 5
SHARED_TURNS = 9
#: Turns of a shard on average; small tables are cut to this many shards a core as long as a shard keeps FEW_TURNS.
SHARD_TURNS = 200_000
FEW_TURNS = 2_000

_NODES = ("shard int, place int, up int, depth long, turn long, size long, conv_id long, parent_conv_id long, "
          "n_convs long, n_children long, n_leaves long, saved_tokens long, ends string")
_MERGED = ("shard int, place int, number long, up long, depth long, conv_id long, n_convs long, n_children long, "
           "n_leaves long, saved_tokens long, ends string")
NOTHING = hashlib.sha256().hexdigest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position from 0, dictionary id and UTF-8 bytes of every turn, stored."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    narrow = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(content).alias("digest"),
        F.octet_length(text).cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    placed = written(narrow.withColumn("pos", F.row_number().over(order) - 1).drop("turn"), "turns")
    # numbers of a stored table stay as they are when a task is repeated
    ids = written(placed.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()), "turn-ids")
    return written(placed.join(ids, "digest").select("conv_id", "pos", "id", "size"), "turn-numbers")


def sequences(turns: DataFrame) -> DataFrame:
    """Every conversation as the ids and sizes of its rebuilt turns, in order.

    The first h turns come from the first conversation of the family, the others are its own; both
    keep their positions, so sorting by position joins them.
    """
    shared = F.crc32(F.col("conv_id").cast("string")) % SHARED_TURNS
    convs = turns.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), shared.alias("h"))
    own = turns.filter(F.col("pos") >= shared)
    heads = turns.filter(F.col("pos") < SHARED_TURNS - 1).withColumnRenamed("conv_id", "family")
    given = convs.join(heads, "family").filter("pos < h").select("conv_id", "pos", "id", "size")
    none = convs.select("conv_id", *[F.lit(None).alias(c) for c in ("pos", "id", "size")])
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "id", "size"))
    return own.union(given).union(none).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(turn)).alias("turns")
    ).select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.size").alias("sizes"))


class TernaryTree:
    """Sequences of ids; `ids`, `sizes` and the links of a node stand at its number, the root is 0."""

    def __init__(self) -> None:
        self.ids, self.sizes = [0], [0]
        self.less, self.more, self.down = [-1], [-1], [-1]
        self.ends: dict[int, tuple[int, int]] = {}

    def _new(self, id_: int, size: int) -> int:
        self.ids.append(id_)
        self.sizes.append(size)
        for links in (self.less, self.more, self.down):
            links.append(-1)
        return len(self.ids) - 1

    def insert(self, ids: list[int], sizes: list[int], ends: tuple[int, int]) -> list[int]:
        """Adds a sequence; the nodes on its path, root included."""
        at, path = 0, [0]
        for id_, size in zip(ids, sizes):
            links, place = self.down, at
            while (node := links[place]) >= 0 and self.ids[node] != id_:
                links, place = (self.less if id_ < self.ids[node] else self.more), node
            if node < 0:
                node = links[place] = self._new(id_, size)
            at = node
            path.append(at)
        self.ends[at] = ends
        return path

    def walk(self) -> tuple[list[int], list[int], list[int]]:
        """Nodes in the order of their sequences, with their parents and depths."""
        nodes, parents, depths = [], [], []
        todo = [(0, -1, 0, True)]
        while todo:
            node, parent, depth, reached = todo.pop()
            if reached:
                nodes.append(node)
                parents.append(parent)
                depths.append(depth)
                if self.down[node] >= 0:
                    todo.append((self.down[node], node, depth + 1, False))
                continue
            if self.more[node] >= 0:
                todo.append((self.more[node], parent, depth, False))
            todo.append((node, parent, depth, True))
            if self.less[node] >= 0:
                todo.append((self.less[node], parent, depth, False))
        return nodes, parents, depths


def _median_first(n: int) -> Iterator[int]:
    todo = [(0, n)]
    while todo:
        a, b = todo.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            todo += [(middle + 1, b), (a, middle)]


def shard_nodes(rows: list[tuple[list[int], list[int]]], starts: list[int], convs: list[int]) -> list[tuple]:
    """Rows of `_NODES`, without the shard, for the sorted distinct sequences of a shard.

    Sequence i is that of `convs[starts[i]:starts[i + 1]]`. Nodes on the first and last path have
    a place; their sums leave out what hangs below other such nodes, and `ends` lists ids.
    """
    tree, edge = TernaryTree(), set()
    for i in _median_first(len(rows)):
        path = tree.insert(*rows[i], (starts[i], starts[i + 1]))
        if i in (0, len(rows) - 1):
            edge.update(path)
    nodes, parents, depths = tree.walk()
    n = len(tree.ids)
    members, first, children, leaves, saved = [0] * n, [None] * n, [0] * n, [0] * n, [0] * n
    for node, parent in zip(reversed(nodes), reversed(parents)):
        a, b = tree.ends.get(node, (0, 0))
        members[node] += b - a
        if b > a and (first[node] is None or convs[a] < first[node]):
            first[node] = convs[a]
        if node not in edge:
            leaves[node] += children[node] == 0
            saved[node] += (members[node] - 1) * tree.sizes[node]
            children[parent] += 1
            leaves[parent] += leaves[node]
            saved[parent] += saved[node]
        if parent >= 0:
            members[parent] += members[node]
            if first[parent] is None or first[node] < first[parent]:
                first[parent] = first[node]
    place = {node: i for i, node in enumerate(x for x in nodes if x in edge)}
    out = []
    for node, parent, depth in zip(nodes, parents, depths):
        ends = ",".join(map(str, convs[slice(*tree.ends.get(node, (0, 0)))]))
        inner = node not in place
        out.append((
            place.get(node), place.get(parent), depth, tree.ids[node], tree.sizes[node], first[node],
            first[parent] if inner and parent not in place else None, members[node], children[node], leaves[node],
            saved[node], hashlib.sha256(ends.encode()).hexdigest() if inner else ends))
    return out


def _arrow(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 20_000):
        columns = zip(*rows[a:a + 20_000])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in text.split(", "))])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId()
    rows, starts, convs, last = [], [], [], None
    for batch in batches:
        for conv, ids, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            if ids != last:
                rows.append((ids, sizes))
                starts.append(len(convs))
                last = ids
            convs.append(conv)
    if rows:
        yield from _arrow([(shard, *r) for r in shard_nodes(rows, [*starts, len(convs)], convs)], _schema(_NODES))


class _Path:
    """A boundary node while its last shard has not come."""

    def __init__(self, number: int, depth: int, turn: int, size: int) -> None:
        self.number, self.depth, self.turn, self.size = number, depth, turn, size
        self.members = self.children = self.leaves = self.saved = 0
        self.first, self.ends, self.any_ends, self.places = None, hashlib.sha256(), False, []


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boundary nodes in the order of shards and places to whole nodes, and each place to its node."""
    path: list[_Path] = []
    out, number, schema = [], 0, _schema(_MERGED)

    def finish(depth: int) -> None:
        while len(path) > depth:
            node, up = path.pop(), path[-1] if path else None
            node.leaves += node.children == 0
            node.saved += (node.members - 1) * node.size
            if up:
                up.children += 1
                up.leaves += node.leaves
                up.saved += node.saved
            out.append((None, None, node.number, up.number if up else None, node.depth, node.first, node.members,
                        node.children, node.leaves, node.saved, node.ends.hexdigest()))
            out.extend((s, p, node.number, None, None, node.first, *[None] * 5) for s, p in node.places)

    for batch in batches:
        for r in batch.to_pylist():
            depth = r["depth"]
            if len(path) <= depth or path[depth].turn != r["turn"]:
                finish(depth)
                path.append(_Path(number, depth, r["turn"], r["size"]))
                number += 1
            node = path[depth]
            node.places.append((r["shard"], r["place"]))
            node.members += r["n_convs"]
            node.children += r["n_children"]
            node.leaves += r["n_leaves"]
            node.saved += r["saved_tokens"]
            node.first = r["conv_id"] if node.first is None else min(node.first, r["conv_id"])
            if r["ends"]:
                node.ends.update(("," * node.any_ends + r["ends"]).encode())
                node.any_ends = True
            if len(out) >= 20_000:
                yield from _arrow(out, schema)
                out.clear()
    finish(0)
    yield from _arrow(out, schema)


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations; see the module for its columns' rules.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. `conversations` has conv_id, turn, role and text.
    """
    spark = conversations.sparkSession
    ship_package(spark)
    turns = numbered_turns(conversations)
    rows, cores = turns.count(), spark.sparkContext.defaultParallelism
    shards = max(1, math.ceil(rows / SHARD_TURNS), min(2 * cores, rows // FEW_TURNS))
    stored = written(sequences(turns), "sequences")
    nodes = written(
        stored.repartitionByRange(shards, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
        .select("conv_id", "ids", "sizes").mapInArrow(_shard, _NODES), "trie-nodes")
    edges = nodes.filter("place IS NOT NULL").drop("up", "parent_conv_id")
    merged = written(
        edges.repartition(1).sortWithinPartitions("shard", "place").mapInArrow(_merge, _MERGED), "trie-edges")

    values = ["n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    whole = merged.filter("shard IS NULL")
    parents = whole.select(F.col("number").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    joined = whole.join(parents, "up", "left").select("conv_id", "depth", "parent_conv_id", *values)
    inner = nodes.filter("place IS NULL")
    below = inner.filter("up IS NOT NULL").drop("parent_conv_id").join(
        merged.filter("shard IS NOT NULL").select(
            "shard", F.col("place").alias("up"), F.col("conv_id").alias("parent_conv_id")), ["shard", "up"])
    return (
        inner.filter("up IS NULL").select("conv_id", "depth", "parent_conv_id", *values)
        .unionByName(below.select("conv_id", "depth", "parent_conv_id", *values)).unionByName(joined)
    )
