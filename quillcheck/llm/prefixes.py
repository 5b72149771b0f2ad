"""The tree of all conversation prefixes, built from Z-fast tries.

A conversation is a sequence of turn hashes; the hash of a prefix is a running sum, so any prefix is found in one step. A Z-fast
trie keeps only the nodes where conversations part or end; each is filed under its handle, the prefix whose length is the
two-fattest number of its edge (the one divisible by the highest power of two). The place where a conversation leaves the
trie is found by fat binary search: about log2(length) look-ups. Conversations go in by batches: all of a batch are
located first, then each is inserted from its place on, which splits an edge or adds a leaf.

A chunk of conversations has a trie of its own, whose edges are expanded into one row per prefix; Spark adds the rows of
equal prefixes up. A prefix that a third of the corpus shares is one row per chunk. Sums over subtrees need no walk over the
merged tree: each distinct prefix is counted by the chunk that holds its smallest conversation, below every one of that
conversation's shorter prefixes, and the chunks' sums are added up again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillcheck.llm.words import mix
from quillcheck.session import settled

LEAD_FROM = 100  # conversations c - c % 100 lend their first turns
MOST_LENT = 6  # fewer turns than this are lent
CHUNK_TURNS = 1 << 12  # turns of a chunk, give or take
_BATCH = 512  # conversations located together
_PIECE = 1 << 20  # characters of conversation ids hashed at a time
_ROW = "chunk long, place int, parent int, depth int, k1 long, k2 long, members long, least long, ends long, size long"
_ROW_SCHEMA = pa.schema([("chunk", pa.int64()), ("place", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("members", pa.int64()), ("least", pa.int64()), ("ends", pa.int64()), ("size", pa.int64())])
_KEY = ["depth", "k1", "k2"]


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that is divisible by the highest power of two."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class Sequences:
    """Conversations as runs of turn hashes, with the hash of every prefix: ``of(i, d)`` for the first d turns of the i-th."""

    def __init__(self, turns: pa.ListArray):
        if isinstance(turns, pa.ChunkedArray):
            turns = turns.combine_chunks()
        size = turns.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = turns.flatten()
        k1, k2, n = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("k1", "k2", "n"))
        self.length = size.tolist()
        first = np.cumsum(size + 1) - size - 1  # a place for the empty prefix
        depth = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + 1
        at = np.repeat(first, size) + depth
        self.k1, self.k2, self.size = (np.zeros(int((size + 1).sum()), np.int64) for _ in range(3))
        with np.errstate(over="ignore"):
            for key, out in ((k1, self.k1), (k2, self.k2)):
                tagged = np.zeros(len(out), np.uint64)  # each turn's hash depends on its place too
                tagged[at] = mix(mix(key.astype(np.int64).view(np.uint64)) + depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                run = np.cumsum(tagged, dtype=np.uint64)
                out[:] = (run - np.repeat(run[first], size + 1)).view(np.int64) if len(run) else 0
        self.size[at] = n
        self.first = first.tolist()
        self._one, self._two = self.k1.tolist(), self.k2.tolist()

    def of(self, i: int, d: int) -> tuple[int, int, int]:
        at = self.first[i] + d
        return d, self._one[at], self._two[at]


class ZFastTrie:
    """Compacted nodes: ``depth`` (length of the extent), ``above`` (parent), ``like`` (a conversation that begins with the
    extent), ``ends`` (conversations that end there). Node 0 is the empty prefix."""

    def __init__(self, sequences: Sequences):
        self.seq = sequences
        self.depth, self.above, self.like, self.ends = [0], [-1], [0], [[]]
        self.handles: dict[tuple, int] = {}
        self.named: dict[tuple, int] = {}  # a node by the first prefix of its edge

    def _file(self, node: int) -> None:
        top = self.depth[self.above[node]]
        self.handles[self.seq.of(self.like[node], two_fattest(top, self.depth[node]))] = node
        self.named[self.seq.of(self.like[node], top + 1)] = node

    def _add(self, above: int, like: int, depth: int) -> int:
        self.depth.append(depth)
        self.above.append(above)
        self.like.append(like)
        self.ends.append([])
        self._file(len(self.depth) - 1)
        return len(self.depth) - 1

    def locate(self, i: int, node: int = 0) -> int:
        """The deepest node whose extent begins conversation i, by fat binary search below ``node``, which is such a one."""
        seq, low, high = self.seq, self.depth[node], self.seq.length[i]
        while low < high:
            middle = two_fattest(low, high)
            found = self.handles.get(seq.of(i, middle))
            if found is None:
                high = middle - 1
                continue
            end = self.depth[found]
            if end > seq.length[i] or seq.of(i, end) != seq.of(self.like[found], end):
                high = middle - 1  # it leaves the trie on this edge, below the handle
                node = self.above[found]
                break
            node, low = found, end
        return node

    def insert(self, i: int, node: int) -> None:
        node = self.locate(i, node)
        length, top = self.seq.length[i], self.depth[node]
        if top == length:
            self.ends[node].append(i)
            return
        child = self.named.get(self.seq.of(i, top + 1))
        if child is not None:
            node = self._split(child, i)
        if self.depth[node] < length:
            node = self._add(node, i, length)
        self.ends[node].append(i)

    def _split(self, child: int, i: int) -> int:
        """A node on the edge to ``child``, where conversation i leaves it."""
        seq, like, above = self.seq, self.like[child], self.above[child]
        low, high = self.depth[above] + 1, min(self.depth[child], seq.length[i])
        while low < high:  # the longest prefix that both have
            middle = (low + high + 1) // 2
            low, high = (middle, high) if seq.of(i, middle) == seq.of(like, middle) else (low, middle - 1)
        del self.handles[seq.of(like, two_fattest(self.depth[above], self.depth[child]))]
        between = self._add(above, like, low)
        self.above[child] = between
        self._file(child)
        return between

    def insert_all(self, batch: int = _BATCH) -> ZFastTrie:
        for a in range(0, len(self.seq.length), batch):
            part = range(a, min(a + batch, len(self.seq.length)))
            places = [self.locate(i) for i in part]  # in the trie as the batch found it
            for i, node in sorted(zip(part, places, strict=True), key=lambda x: x[1]):
                self.insert(i, node)
        return self

    def expanded(self, ids: np.ndarray) -> dict[str, np.ndarray]:
        """One row per prefix, parents before children: its parent's row, depth, hashes, number of conversations that begin
        with it, the least of their ids, how many end there, and the size of its last turn."""
        n = len(self.depth)
        depth, above = np.array(self.depth), np.array(self.above)
        ends = np.array([len(e) for e in self.ends])
        members, least = ends.copy(), np.full(n, np.iinfo(np.int64).max)
        for node, e in enumerate(self.ends):
            if e:
                least[node] = ids[e].min()
        order = np.argsort(-depth, kind="stable")
        for node in order[:-1].tolist():  # the root is last
            up = above[node]
            members[up] += members[node]
            least[up] = min(least[up], least[node])
        top = np.where(above >= 0, depth[above], -1)
        rows = (depth - top)[order[::-1]]
        node = np.repeat(order[::-1], rows)
        begin = np.cumsum(rows) - rows
        step = np.arange(len(node)) - np.repeat(begin, rows)
        last_row = np.empty(n, dtype=np.int64)
        last_row[order[::-1]] = begin + rows - 1
        parent = np.where(step > 0, np.arange(len(node)) - 1, np.where(above[node] >= 0, last_row[above[node]], -1))
        d = top[node] + 1 + step
        at = np.array(self.seq.first)[np.array(self.like)[node]] + d
        return {"parent": parent, "depth": d, "k1": self.seq.k1[at], "k2": self.seq.k2[at], "members": members[node], "least": least[node], "ends": np.where(d == depth[node], ends[node], 0), "size": self.seq.size[at]}


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns as (k1, k2, n), two hashes of role and text and the text's code points.

    The first h turns come from conversation ``conv_id - conv_id % 100``, those after its own first h are its own, with h =
    crc32(conv_id as text) modulo 6. Null turns come first; rows with the same turn in an order fixed by their hashes.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashed = [F.xxhash64(role, text).alias("k1"), F.xxhash64(text, F.lit(1), role).alias("k2"), F.length(text).cast("long").alias("n")]
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), *hashed).alias("t"))
    own = turns.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["k1"].alias("k1"), t["k2"].alias("k2"), t["n"].alias("n"))).alias("own"))
    lenders = own.where(F.col("conv_id") % LEAD_FROM == 0).select(F.col("conv_id").alias("lender"), F.slice("own", 1, MOST_LENT - 1).alias("lead"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(MOST_LENT)).cast("int")
    own = own.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % LEAD_FROM).alias("lender"))
    none = F.filter("own", lambda t: F.lit(False))
    lent = F.coalesce(F.slice("lead", F.lit(1), F.col("h")), none)
    return own.join(lenders, "lender", "left").select("conv_id", F.concat(lent, F.slice("own", F.col("h") + 1, F.size("own"))).alias("turns"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, k1, k2, conv_id) into runs of ids as text: (depth, k1, k2, first, said)."""
    key, first, said, length = None, None, [], 0

    def run() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, first, ",".join(said)), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=[*_KEY, "first", "said"])

    for batch in batches:
        done = []
        for *k, conv in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "conv_id")), strict=True):
            if k != key or length > _PIECE:
                if key is not None:
                    done.append(run())
                key, first, said, length = k, conv, [], 0
            said.append(str(conv))
            length += len(said[-1]) + 1
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if key is not None:
        yield run()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids in order into one SHA-256 per prefix; a run at a time, whatever the number of ids."""
    key, sha = None, None
    schema = pa.schema([("depth", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])
    for batch in batches:
        done = []
        for *k, said in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "said")), strict=True):
            if k == key:
                sha.update(b"," + said.encode())
                continue
            if key is not None:
                done.append((*key, sha.hexdigest()))
            key, sha = k, hashlib.sha256(said.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*key, sha.hexdigest()), schema, strict=True)], schema=schema)


def prefix_tree(conversations: DataFrame, chunk_turns: int = CHUNK_TURNS) -> DataFrame:
    """One row per distinct prefix of a rebuilt conversation: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens and ends_sha256.

    A null role or text is empty, a null turn comes first, repeated turns are turns of their own; rows without conv_id
    belong to no conversation and are left out; other columns are not read; an empty table gives no rows (without a
    conversation there is no root). Texts of any length count by their hashes. A conversation's turns, 24 bytes each, are
    one row; a chunk holds whole conversations.
    """
    n_chunks = max(1, -(-conversations.count() // chunk_turns))
    convs = rebuilt(conversations).withColumn("chunk", F.pmod(F.xxhash64("conv_id"), F.lit(n_chunks)))
    convs = settled(convs, "conversations")

    def build(key: tuple, table: pa.Table) -> pa.Table:
        rows = ZFastTrie(Sequences(table["turns"])).insert_all().expanded(table["conv_id"].to_numpy())
        n = len(rows["depth"])
        rows |= {"chunk": np.full(n, key[0].as_py()), "place": np.arange(n)}
        return pa.table([pa.array(rows[f.name], f.type) for f in _ROW_SCHEMA], schema=_ROW_SCHEMA)

    def final(key: tuple, table: pa.Table) -> pa.Table:
        seq = Sequences(table["turns"])
        last = np.array(seq.first) + np.array(seq.length)
        return pa.table({"depth": pa.array(seq.length, pa.int32()), "k1": seq.k1[last], "k2": seq.k2[last], "conv_id": table["conv_id"]})

    def sums(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        c = {name: table[name].to_numpy() for name in ("parent", "depth", "least", "size", "owner", "n_convs", "n_ends")}
        own = c["owner"] == c["least"]
        leaves = (own & (c["n_ends"] == c["n_convs"])).astype(np.int64)
        saved = np.where(own, (c["n_convs"] - 1) * c["size"], 0)
        children = np.bincount(c["parent"][own & (c["parent"] >= 0)], minlength=len(own))
        by_depth = np.argsort(c["depth"], kind="stable")
        edges = np.searchsorted(c["depth"][by_depth], np.arange(int(c["depth"].max()) + 2))
        for d in range(len(edges) - 2, 0, -1):
            rows = by_depth[edges[d] : edges[d + 1]]
            np.add.at(leaves, c["parent"][rows], leaves[rows])
            np.add.at(saved, c["parent"][rows], saved[rows])
        above = np.where(c["parent"] >= 0, c["owner"][c["parent"]], 0)
        only = lambda values, ok: pa.array(values, pa.int64(), mask=~ok)
        out = {"depth": table["depth"], "k1": table["k1"], "k2": table["k2"], "conv_id": only(c["owner"], own), "parent_conv_id": only(above, own & (c["parent"] >= 0))}
        return pa.table(out | {"n_convs": only(c["n_convs"], own), "n_children": pa.array(children, pa.int64()), "n_leaves": leaves, "saved_tokens": saved})

    local = convs.groupBy("chunk").applyInArrow(build, _ROW)
    same = Window.partitionBy(*_KEY)  # at most one row per chunk
    whole = [F.min("least").over(same).alias("owner"), F.sum("members").over(same).alias("n_convs"), F.sum("ends").over(same).alias("n_ends")]
    parts = local.select("chunk", "place", "parent", *_KEY, "least", "size", *whole).groupBy("chunk").applyInArrow(
        sums, "depth int, k1 long, k2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    )
    ended = convs.groupBy("chunk").applyInArrow(final, "depth int, k1 long, k2 long, conv_id long")
    pieces = ended.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").mapInArrow(_pieces, "depth int, k1 long, k2 long, first long, said string")
    ends = pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_hashed, "depth int, k1 long, k2 long, ends_sha256 string")
    both = parts.unionByName(ends, allowMissingColumns=True).groupBy(*_KEY)
    out = both.agg(*(F.max(c).alias(c) for c in ("conv_id", "parent_conv_id", "n_convs")), *(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")), F.max("ends_sha256").alias("ends"))
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
