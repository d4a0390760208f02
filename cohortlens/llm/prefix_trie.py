"""Prefix trie of conversations in double arrays.

A conversation is a sequence of turns; conversations that begin alike share
nodes.  Equal sequences are put together first, each with its number of
conversations.  A sequence belongs to a prefix: its shortest one (of 1, 2, 4,
... turns) that at most ``limit`` different sequences begin with.  Prefixes
are dealt into shards; a shard numbers its turns densely, packs its sequences
into BASE and CHECK arrays and walks them to collect its nodes.

Below its prefix a node lies in one shard and is finished there.  The nodes
above (the root and the prefixes of crowded prefixes) lie in several shards,
which send partial aggregates, merged over all shards afterwards.  Turns travel
as a 16-byte digest with their length, never as text.
"""

from __future__ import annotations

import hashlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

LIMIT = 2048              # sequences that may share a shard's prefix
HOT_SHARE = 100_000       # a crowded prefix also holds more than one in so many sequences
KEY = 16                  # bytes of a turn's digest
NO_ENDS = hashlib.sha256(b"").hexdigest()
ROOT = b"\0" * KEY


# --- conversations -----------------------------------------------------------

def turn_key(role: Column, text: Column) -> Column:
    """Digest of a turn; the role's length keeps role and text apart."""
    whole = F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text))
    return F.substring(F.unhex(F.sha2(whole, 256)), 1, KEY)


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (key, chars) in the order of ``turn`` (null
    first; rows of one turn number by their digest), one row a conv_id.  Null roles and texts are empty, rows without
    conv_id are no conversation."""
    role, text = F.coalesce(conversations["role"], F.lit("")), F.coalesce(conversations["text"], F.lit(""))
    rows = conversations.filter(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        F.struct(conversations["turn"].alias("turn"), turn_key(role, text).alias("key"), F.length(text).alias("chars")).alias("t"))
    # sort_array puts nulls first
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the first h turns of conversation c - c % 100, then c's
    own after its first h; h = crc32(c) % 6."""
    own = sequences(conversations)
    own = materialise(own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")), "trie-conversations")
    heads = own.filter(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, 5).alias("head"))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(heads, "base", "left")     # a head meets 100 ids at most (200 around 0)
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, tail).alias("turns"))


def _packed(convs: DataFrame) -> DataFrame:
    """conv_id, size, keys (digests one after the other), chars, seq (digest of all)."""
    keys = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), ""))
    packed = convs.select("conv_id", F.size("turns").alias("size"), keys.alias("keys"), F.transform("turns", lambda t: t["chars"]).alias("chars"))
    return packed.withColumn("seq", F.substring(F.unhex(F.sha2("keys", 256)), 1, KEY))


def ends_digest(convs: DataFrame) -> DataFrame:
    """seq, ends_sha256 for sequences of two conversations or more: SHA-256 of
    their ids, ascending, comma-joined.  Rows arrive sorted and are fed to the
    hash one by one: constant memory, however many copies a sequence has."""
    rows = convs.select("seq", "conv_id").repartition("seq").sortWithinPartitions("seq", "conv_id")

    def run(batches):
        seq = state = None
        for batch in batches:
            done = []
            for s, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != seq:
                    if seq is not None:
                        done.append((seq, state.hexdigest()))
                    seq, state = s, hashlib.sha256(str(i).encode())
                else:
                    state.update(f",{i}".encode())
            if done:
                yield pa.RecordBatch.from_pydict({"seq": pa.array([s for s, _ in done], pa.binary()), "ends_sha256": pa.array([e for _, e in done])})
        if seq is not None:
            yield pa.RecordBatch.from_pydict({"seq": pa.array([seq], pa.binary()), "ends_sha256": pa.array([state.hexdigest()])})

    return rows.mapInArrow(run, "seq binary, ends_sha256 string")


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """seq, keys, chars, size, n (conversations), low (smallest of them), ends_sha256."""
    packed = materialise(_packed(convs), "trie-packed")
    found = packed.groupBy("seq").agg(F.first("keys").alias("keys"), F.first("chars").alias("chars"), F.first("size").alias("size"),
                                      F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("low"))
    found = materialise(found, "trie-sequences")
    repeated = found.filter("n > 1").select("seq")
    many = ends_digest(packed.join(repeated, "seq", "left_semi"))
    alone = F.sha2(F.col("low").cast("string"), 256)
    return found.join(many, "seq", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", alone))


def cut_depths(seqs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``seqs`` with ``cut``, the length of the prefix each belongs to, and
    ``prefix``, its digest."""
    total = seqs.count()
    todo, done, depth = seqs, [], 1
    while True:
        marked = todo.withColumn("prefix", F.xxhash64(F.lit(depth), F.substring("keys", 1, KEY * depth))).withColumn("cut", F.lit(depth))
        counts = marked.groupBy("prefix").agg(F.count(F.lit(1)).alias("_n"))
        crowded = materialise(counts.filter(F.col("_n") > max(limit, total // HOT_SHARE)).select("prefix"), "trie-crowded")
        if crowded.isEmpty():
            done.append(marked)
            break
        crowded = F.broadcast(crowded)          # fewer than HOT_SHARE prefixes, by their share
        done.append(marked.join(crowded, "prefix", "left_anti"))
        todo, depth = marked.join(crowded, "prefix", "left_semi").drop("prefix", "cut"), depth * 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


# --- one shard -------------------------------------------------------------

class DoubleArray:
    """Trie over label sequences (labels from 1) in BASE and CHECK arrays: the
    child of state s by label c is t = BASE[s] + c, if CHECK[t] == s."""

    TRIES = 32

    def __init__(self, flat: np.ndarray, first: np.ndarray, size: np.ndarray):
        self.flat, self.first, self.size = flat, first, size
        room = int(flat.max(initial=0)) + len(flat) + 2
        self.base = np.zeros(room, dtype=np.int64)
        self.check = np.full(room, -1, dtype=np.int64)
        self.check[0] = 0                  # the root
        self._free = 1                     # no free slot lies below
        self._build()

    def _children(self, rows: np.ndarray, depth: int):
        """Rows that go on, in order of their label at ``depth``, and the labels' runs."""
        on = rows[self.size[rows] > depth]
        labels = self.flat[self.first[on] + depth]
        order = np.argsort(labels, kind="stable")
        on, labels = on[order], labels[order]
        starts = np.flatnonzero(np.concatenate(([True], labels[1:] != labels[:-1]))) if len(on) else np.empty(0, np.int64)
        return on, labels[starts] if len(on) else labels, starts

    def _build(self) -> None:
        todo = deque([(0, np.arange(len(self.size)), 0)])
        while todo:
            state, rows, depth = todo.popleft()
            on, labels, starts = self._children(rows, depth)
            if not len(labels):
                continue
            base = self._place(labels)
            self.base[state] = base
            self.check[base + labels] = state
            for label, part in zip(labels.tolist(), np.split(on, starts[1:])):
                todo.append((base + label, part, depth + 1))

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate((self.base, np.zeros(more, dtype=np.int64)))
            self.check = np.concatenate((self.check, np.full(more, -1, dtype=np.int64)))

    def _place(self, labels: np.ndarray) -> int:
        """A base that puts all labels on free slots: the first that fits of
        the lowest free ones, else past the last slot in use."""
        while self._free < len(self.check) and self.check[self._free] >= 0:
            self._free += 1
        low, high = int(labels[0]), int(labels[-1])
        slot, tries = max(self._free, low), self.TRIES
        while tries:
            self._grow(slot - low + high + 1)
            if (self.check[slot - low + labels] < 0).all():
                return slot - low
            slot, tries = slot + 1, tries - 1
        base = int(np.flatnonzero(self.check >= 0)[-1])
        self._grow(base + high + 1)
        return base

    def step(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Children of ``states`` by ``labels``; -1 where there is none."""
        to = self.base[states] + labels
        inside = to < len(self.check)
        found = np.full(len(to), -1, dtype=np.int64)
        found[inside] = np.where(self.check[to[inside]] == states[inside], to[inside], -1)
        return found


class ShardTrie:
    """Nodes of one shard, by state of its double array, and their sums.

    ``keys``, ``chars``: digests and lengths of all turns, ``size`` turns a
    sequence; ``n``, ``low``: its conversations and the smallest; ``cut``: from
    which depth on its nodes are this shard's alone."""

    def __init__(self, keys: np.ndarray, chars: np.ndarray, size: np.ndarray, n: np.ndarray, low: np.ndarray, cut: np.ndarray):
        self.turns, labels = np.unique(keys, return_inverse=True)      # dense turn ids
        flat = labels.astype(np.int64).reshape(-1) + 1
        first = np.cumsum(size) - size
        self.array = DoubleArray(flat, first, size)
        room = len(self.array.check)
        self.n, self.low = np.zeros(room, np.int64), np.full(room, np.iinfo(np.int64).max)
        self.depth, self.chars = np.full(room, -1, np.int64), np.zeros(room, np.int64)
        self.label, self.own = np.zeros(room, np.int64), np.ones(room, dtype=bool)
        state, rows, depth = np.zeros(len(size), np.int64), np.arange(len(size)), 0
        self.end = np.empty(len(size), dtype=np.int64)                   # the state a sequence ends in
        while len(rows):
            at = state[rows]
            np.add.at(self.n, at, n[rows])
            np.minimum.at(self.low, at, low[rows])
            self.depth[at], self.own[at] = depth, depth >= cut[rows]
            over = size[rows] == depth
            self.end[rows[over]] = at[over]
            rows = rows[~over]
            places = first[rows] + depth
            state[rows] = self.array.step(state[rows], flat[places])
            self.chars[state[rows]], self.label[state[rows]] = chars[places], flat[places]
            depth += 1
        self.nodes = np.flatnonzero(self.depth >= 0)
        self.nodes = self.nodes[np.argsort(self.depth[self.nodes], kind="stable")]
        self.parent = np.where(self.depth > 0, self.array.check, -1)
        below = self.nodes[1:]
        # own children, and leaves and saved tokens of own nodes, summed from the deepest level up
        mine = below[self.own[below]]
        self.children = np.bincount(self.parent[mine], minlength=room)
        self.leaves = np.where(self.own & (self.children == 0) & (self.depth >= 0), 1, 0)
        self.saved = np.where(self.own, (self.n - 1) * self.chars, 0)
        levels = np.flatnonzero(np.diff(self.depth[below], prepend=0))
        for level in reversed(np.split(below, levels[1:])):
            np.add.at(self.leaves, self.parent[level], self.leaves[level])
            np.add.at(self.saved, self.parent[level], self.saved[level])

    def paths(self) -> dict[int, tuple[bytes, ...]]:
        """Digests of the path of every shared node, root first."""
        out = {0: (ROOT,)}
        for s in self.nodes[~self.own[self.nodes]].tolist():
            if s:
                up = out[int(self.parent[s])]
                out[s] = (*up, hashlib.blake2b(up[-1] + self.turns[self.label[s] - 1].tobytes(), digest_size=KEY).digest())
        return out


_NODE = ("own boolean, path array<binary>, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
         "n_leaves long, saved_tokens long, chars long, ends_sha256 string")


def shard_nodes(table: pa.Table) -> pa.Table:
    """All nodes of a shard.  Own nodes are whole (``path``: that of a shared
    parent, whose conv_id is not known here); shared nodes are partial: their
    sums are over own nodes below them, ``path`` is their own, root first."""
    table = table.combine_chunks()
    size, n, low, cut = (table.column(c).to_numpy().astype(np.int64) for c in ("size", "n", "low", "cut"))
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), dtype=[("a", ">u8"), ("b", ">u8")])    # digests numpy can sort
    trie = ShardTrie(keys, _flat(table.column("chars")), size, n, low, cut)
    ends = dict(zip(trie.end.tolist(), table.column("ends_sha256").to_pylist()))
    paths = trie.paths()
    nodes, own = trie.nodes, trie.own[trie.nodes]
    parent = trie.parent[nodes]
    path, up = [], []
    for s, p, mine in zip(nodes.tolist(), parent.tolist(), own.tolist()):
        path.append(list(paths[s]) if not mine else [paths[p][-1]] if p >= 0 and not trie.own[p] else None)
        up.append(int(trie.low[p]) if mine and p >= 0 and trie.own[p] else None)
    long = lambda x: pa.array(x[nodes], pa.int64())     # noqa: E731
    return pa.table({"own": pa.array(own), "path": pa.array(path, pa.list_(pa.binary())), "conv_id": long(trie.low), "depth": long(trie.depth),
                     "parent_conv_id": pa.array(up, pa.int64()), "n_convs": long(trie.n), "n_children": long(trie.children),
                     "n_leaves": long(trie.leaves), "saved_tokens": long(trie.saved), "chars": long(trie.chars),
                     "ends_sha256": pa.array([ends.get(s) for s in nodes.tolist()], pa.string())})


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    return (whole if isinstance(whole, pa.Array) else whole.chunk(0)).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


# --- the whole trie -----------------------------------------------------------

def prefix_trie(convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie of ``convs`` (conv_id, turns as from
    ``sequences``): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Conversations without turns end in the root.  No conversation: an empty
    result.  A conversation is one value of 20 bytes a turn, so it must fit
    Spark's 2 GB for a value and a task's memory; the ids of equal conversations
    are hashed in one stream, as SHA-256 asks for."""
    seqs = cut_depths(materialise(distinct_sequences(convs), "trie-distinct"), limit)
    total = seqs.agg(F.count(F.lit(1))).first()[0]
    shards = max(1, 2 * total // limit)
    dealt = seqs.withColumn("shard", F.pmod("prefix", F.lit(shards)))
    found = materialise(dealt.groupBy("shard").applyInArrow(shard_nodes, _NODE), "trie-nodes")

    shared = found.filter("not own").withColumn("node", F.element_at("path", -1))
    merged = shared.groupBy("node").agg(
        F.first("path").alias("path"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("own_children"), F.sum("n_leaves").alias("own_leaves"), F.sum("saved_tokens").alias("own_saved"),
        F.first("chars").alias("chars"), F.max("ends_sha256").alias("ends_sha256"))
    merged = materialise(merged.withColumn("up", F.when(F.size("path") > 1, F.element_at("path", -2))), "trie-shared")
    # shared nodes as children, leaves and savings of their shared ancestors
    shared_children = merged.filter("up is not null").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("more"))
    merged = merged.join(shared_children, "node", "left").withColumn("n_children", F.col("own_children") + F.coalesce("more", F.lit(0)))
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("chars")
    sums = (merged.select(F.explode("path").alias("node"), leaf.alias("leaf"), saved.alias("saved"))
            .groupBy("node").agg(F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved")))
    upper = materialise(merged.join(sums, "node").select(
        "node", "up", "conv_id", "depth", "n_convs", "n_children", (F.col("own_leaves") + F.col("leaves")).alias("n_leaves"),
        (F.col("own_saved") + F.col("saved")).alias("saved_tokens"), "ends_sha256"), "trie-upper")

    named = upper.select(F.col("node").alias("up"), F.col("conv_id").alias("up_conv"))
    own = found.filter("own").withColumn("up", F.element_at("path", 1))
    inner = own.filter("up is null")
    tops = own.filter("up is not null").join(named, "up").withColumn("parent_conv_id", F.col("up_conv"))
    above = upper.join(named, "up", "left").withColumn("parent_conv_id", F.col("up_conv"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
               F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    return inner.select(*columns).unionByName(tops.select(*columns)).unionByName(above.select(*columns))
