"""Trie of conversation prefixes by union-find over the common prefixes of sorted neighbours.

A conversation is the path of its turns' keys (128 bits of SHA-256 over role and text). Paths are
range-partitioned and sorted, with conv_id as the last sort key, so copies of one conversation
spread over as many partitions as they fill. A partition is worked off in runs of bounded size:

1. neighbours in a run are joined by an edge as deep as their longest common prefix (LCP). From the
   greatest depth down, the paths of that length enter as sets and the edges of that depth unite
   their sets (all sets are intervals of the run). Every set at a depth is a node; a union makes a
   branching node. Nodes that hold neither the first nor the last path of the run are complete;
2. a run is contracted to those two paths, with what is known so far at each of their nodes (their
   open nodes);
3. contracted runs are strings in sorted order again, so the same union-find over the LCP edges
   within and between them merges runs of a partition, then partitions, ``FAN`` at a time, until
   one forest is left, whose nodes are complete;
4. what has been linked to an open node is told its name (its smallest conv_id) from the last merge
   down to the runs.

Conversations that end at a node are hashed in order of id: at once for nodes complete in a run,
else a run gives its part of the id list as one row and parts are streamed in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A run has at most so many conversations, and is closed once it has so many turns.
RUN, RUN_TURNS = 1 << 16, 1 << 20
#: Contracted forests that one merge takes.
FAN = 64
#: Runs are numbered within their partition below this.
RUNS = 1 << 24
KEY = 16
NONE = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()

PARTS = ("n", "least", "kids", "leaves", "saved")
ROWS = "kind string, seq long, side int, depth long, conv_id long, parent long, to_seq long, to_side int, n long, kids long, leaves long, saved long, ends binary, path binary, lens array<int>, parts array<array<long>>"


def conversation_turns(turns: DataFrame, *by: str) -> DataFrame:
    """conv_id and turns (array of turn, key, n) of each conversation, in order: null turns first, equal ones by key. ``by``: columns that conv_id determines, to deal conversations by."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    made = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), *by, F.struct(F.col("turn").alias("turn"), key.alias("key"), F.length(text).alias("n")).alias("t"))
    made = made.repartition(*by) if by else made
    return made.groupBy(*by, "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def shared_heads(turns: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """conv_id, turns of each conversation with its first h = crc32(conv_id) % most turns replaced by those of the conversation at the start of its block of ids."""
    base = F.col("conv_id").cast("long")
    own = conversation_turns(turns.withColumn("base", base - base % block), "base")
    heads = own.filter("conv_id = base").select("base", F.slice("turns", 1, most - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), h)
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return own.join(heads, "base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


class Strings:
    """Sorted paths as arrays: offsets, text lengths of the turns, and LCPs of neighbours."""

    def __init__(self, paths: list[bytes], lens: np.ndarray):
        self.length = np.array([len(p) // KEY for p in paths], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.lens = lens
        keys = np.frombuffer(b"".join(paths), np.uint64).reshape(-1, 2)
        self.lcp = np.zeros(max(0, len(paths) - 1), np.int64)
        alive = np.arange(len(self.lcp))
        for d in range(int(self.length.max(initial=0))):
            alive = alive[(self.length[alive] > d) & (self.length[alive + 1] > d)]
            alive = alive[(keys[self.start[alive] + d] == keys[self.start[alive + 1] + d]).all(1)]
            if not len(alive):
                break
            self.lcp[alive] += 1


class Sets:
    """Union-find over intervals of strings: a set goes by its first string."""

    def __init__(self):
        self.first = np.array([], np.int64)

    def enter(self, strings: np.ndarray) -> None:
        self.first = np.union1d(self.first, strings)

    def unite(self, lcp: np.ndarray, depth: int) -> None:
        """Join neighbours whose edge is at least as deep."""
        left = np.maximum(self.first - 1, 0)
        self.first = self.first[(self.first == 0) | (lcp[left] < depth if len(lcp) else True)]

    def find(self, strings: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, strings, "right") - 1


def forest(s: Strings, own: dict[int, tuple[np.ndarray, dict[str, np.ndarray]]], whole: bool) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Nodes of each depth, deepest first, once their parents are known.

    own: by depth, strings and what they bring to their node there (PARTS). The nodes hold first (their first string), side (0 and
    1: open at the first and last string; -1: complete, and so are all if ``whole``), PARTS, and parent (name of the parent, or
    side of an open one in to_side). What open nodes hold leaves out their open children.
    """
    m, sets, below = len(s.length), Sets(), None
    by_length = np.argsort(s.length, kind="stable")
    ends = np.searchsorted(s.length[by_length], np.arange(int(s.length.max(initial=0)) + 2))
    for depth in range(int(s.length.max(initial=0)), -1, -1):
        sets.enter(by_length[ends[depth] : ends[depth + 1]])
        sets.unite(s.lcp, depth)
        k = len(sets.first)
        node = {c: np.zeros(k, np.int64) for c in PARTS} | {"first": sets.first, "side": np.full(k, -1)}
        node["least"][:] = NONE
        if not whole:
            if s.length[m - 1] >= depth:
                node["side"][sets.find(np.array([m - 1]))] = 1
            node["side"][sets.first == 0] = 0

        def add(at: np.ndarray, what: dict[str, np.ndarray], node=node) -> None:
            np.minimum.at(node["least"], at, what["least"])
            for c in ("n", "kids", "leaves", "saved"):
                np.add.at(node[c], at, what[c])

        if depth in own:
            add(sets.find(own[depth][0]), own[depth][1])
        if below is not None:
            closed = below["side"] < 0
            up = sets.find(below["first"])
            add(up[closed], {c: below[c][closed] for c in PARTS if c != "kids"} | {"kids": np.ones(int(closed.sum()), np.int64)})
        done = node["side"] < 0
        node["leaves"][done & (node["kids"] == 0)] = 1
        if depth:
            node["saved"][done] += (node["n"][done] - 1) * s.lens[s.start[node["first"][done]] + depth - 1]
        if below is not None:
            yield depth + 1, below | {"parent": node["least"][up], "to_side": node["side"][up]}
        below = node
    yield 0, below | {"parent": np.full(len(below["first"]), NONE), "to_side": np.full(len(below["first"]), -1)}


def _longs(x, null=None) -> pa.Array:
    x = np.asarray(x, np.int64)
    return pa.array(x, mask=null)


def _rows(count: int, /, **columns) -> pa.RecordBatch:
    """Rows of ROWS with these columns (one value, a list or an array each), the others null."""
    kinds = {"kind": pa.string(), "side": pa.int32(), "to_side": pa.int32(), "ends": pa.binary(), "path": pa.binary(), "lens": pa.list_(pa.int32()), "parts": pa.list_(pa.list_(pa.int64()))}
    names = [x.split(" ")[0] for x in ROWS.split(", ")]
    fixed = {c: pa.array([v] * count, kinds.get(c, pa.int64())) if isinstance(v, (str, int)) else v.cast(kinds.get(c, pa.int64())) if isinstance(v, pa.Array) else pa.array(v, kinds.get(c, pa.int64())) for c, v in columns.items()}
    return pa.record_batch({c: fixed[c] if c in fixed else pa.nulls(count, kinds.get(c, pa.int64())) for c in names})


def _complete(seq: int, depth: int, node: dict[str, np.ndarray], ends) -> pa.RecordBatch:
    """Rows of complete nodes; the parent is named, or is the open node of that side in forest seq."""
    at = np.flatnonzero(node["side"] < 0)
    opened, root = node["to_side"][at] >= 0, node["parent"][at] == NONE
    return _rows(
        len(at), kind="node", seq=seq, depth=depth, conv_id=_longs(node["least"][at]), parent=_longs(node["parent"][at], opened | root), to_side=_longs(node["to_side"][at], ~opened),
        n=_longs(node["n"][at]), kids=_longs(node["kids"][at]), leaves=_longs(node["leaves"][at]), saved=_longs(node["saved"][at]), ends=ends(at),
    )


def _contracted(seq: int, s: Strings, paths: list[bytes], opened: dict[int, list[tuple]]) -> pa.RecordBatch:
    """The first and the last path of a forest, with PARTS of their open nodes from the greatest depth up."""
    ends = [0, len(paths) - 1]
    lens = [s.lens[s.start[i] : s.start[i] + s.length[i]].tolist() for i in ends]
    return _rows(2, kind="string", seq=seq, side=[0, 1], path=[paths[i] for i in ends], lens=lens, parts=[[list(x) for x in zip(*opened[side])] if opened[side] else [[] for _ in PARTS] for side in (0, 1)])


def _opened(node: dict[str, np.ndarray], opened: dict[int, list[tuple]]) -> list[int]:
    at = np.flatnonzero(node["side"] >= 0)
    for i in at.tolist():
        opened[int(node["side"][i])].append(tuple(int(node[c][i]) for c in PARTS))
    return at.tolist()


def _run_rows(seq: int, ids: list[int], paths: list[bytes], lens: np.ndarray) -> Iterator[pa.RecordBatch]:
    s, ids = Strings(paths, lens), np.array(ids, np.int64)
    opened, own = {0: [], 1: []}, {}
    for d in np.unique(s.length).tolist():
        at = np.flatnonzero(s.length == d)
        zero = np.zeros(len(at), np.int64)
        own[d] = (at, {"n": zero + 1, "least": ids[at], "kids": zero, "leaves": zero, "saved": zero})
    # copies of a path are neighbours, in order of id: the first of each and where the next path begins
    new = np.flatnonzero(np.r_[True, (s.lcp < s.length[1:]) | (s.length[1:] != s.length[:-1])])
    until = dict(zip(new.tolist(), [*new[1:].tolist(), len(ids)]))
    listed = lambda i: ",".join(map(str, ids[i : until[i]].tolist())).encode()
    for depth, node in forest(s, own, False):
        firsts = node["first"].tolist()
        # the paths that end at a node are shorter than the others in its set, so they come first
        ended = lambda i, depth=depth, firsts=firsts: listed(firsts[i]) if s.length[firsts[i]] == depth else None
        yield _complete(seq, depth, node, lambda at, ended=ended: [hashlib.sha256(ended(i) or b"").digest() for i in at.tolist()])
        for i in _opened(node, opened):
            if (text := ended(i)) is not None:
                yield _rows(1, kind="ends", seq=seq, side=[int(node["side"][i])], depth=depth, ends=[text])
    yield _contracted(seq, s, paths, opened)


def _runs(most: int, most_turns: int):
    """Sorted conversations to complete nodes, id lists of open nodes and the contracted forest of each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, ids, paths, lens, turns = TaskContext.get().partitionId() * RUNS, [], [], [], 0
        for b in batches:
            own, size = b.column("path").to_pylist(), np.diff(b.column("lens").offsets.to_numpy())
            flat, at, i = b.column("lens").flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(size)], 0
            while i < b.num_rows:
                room = int(np.searchsorted(at, at[i] + most_turns - turns, "left"))
                end = min(b.num_rows, i + most - len(ids), max(i + 1, room))
                ids += b.column("conv_id").slice(i, end - i).to_pylist()
                paths += own[i:end]
                lens.append(flat[at[i] : at[end]])
                turns += int(at[end] - at[i])
                i = end
                if len(ids) >= most or turns >= most_turns:
                    yield from _packed(_run_rows(seq, ids, paths, np.concatenate(lens)))
                    seq, ids, paths, lens, turns = seq + 1, [], [], [], 0
        if ids:
            yield from _packed(_run_rows(seq, ids, paths, np.concatenate(lens)))

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches of one forest as few larger ones."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= 20_000:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _merged_rows(seq: int, parts: list[tuple], whole: bool) -> Iterator[pa.RecordBatch]:
    """parts: (seq, side, path, lens, parts) of contracted forests in order. Gives complete nodes, links of their open nodes to the merged ones, and the contracted merged forest."""
    paths = [p[2] for p in parts]
    s = Strings(paths, np.concatenate([np.asarray(p[3], np.int64) for p in parts]))
    brought: dict[int, list[tuple]] = {}
    for i, (*_, own) in enumerate(parts):
        for up, values in enumerate(zip(*own)):
            brought.setdefault(int(s.length[i]) - up, []).append((i, *values))
    own = {d: (x[:, 0], dict(zip(PARTS, x[:, 1:].T))) for d, rows in brought.items() for x in [np.array(rows, np.int64)]}
    opened = {0: [], 1: []}
    for depth, node in forest(s, own, whole):
        yield _complete(seq, depth, node, lambda at: [None] * len(at))
        if depth in own:
            at = own[depth][0]
            to = np.searchsorted(node["first"], at, "right") - 1
            side, name = node["side"][to], node["least"][to]
            yield _rows(len(at), kind="link", seq=[parts[i][0] for i in at.tolist()], side=[parts[i][1] for i in at.tolist()], depth=depth, conv_id=_longs(name, side >= 0), to_seq=_longs(np.full(len(at), seq), side < 0), to_side=_longs(side, side < 0))
        _opened(node, opened)
    if not whole:
        yield _contracted(seq, s, paths, opened)


def _merge(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, parts = None, []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("into", "seq", "side", "path", "lens", "parts"))):
                if row[0] != group and parts:
                    yield from _packed(_merged_rows(group, parts, whole))
                    parts = []
                group = row[0]
                parts.append(row[1:])
        if parts:
            yield from _packed(_merged_rows(group, parts, whole))

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Id lists come in parts, sorted by node and run."""
    key, state, out = None, None, []
    for b in batches:
        for conv_id, depth, ends in zip(b.column("conv_id").to_pylist(), b.column("depth").to_pylist(), b.column("ends").to_pylist()):
            if (conv_id, depth) != key:
                if key:
                    out.append((*key, state.digest()))
                key, state = (conv_id, depth), hashlib.sha256(ends)
            else:
                state.update(b"," + ends)
        if len(out) >= 10_000:
            yield _digest_rows(out)
            out = []
    yield _digest_rows(out + [(*key, state.digest())] if key else out)


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch({c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("conv_id", pa.int64()), ("depth", pa.int64()), ("ends", pa.binary())))})


def trie(conversations: DataFrame, run: int = RUN, run_turns: int = RUN_TURNS, fan: int = FAN) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, turns as of ``conversation_turns``): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    The root has depth 0 and no parent; a conversation without turns ends there. saved_tokens sums (n_convs - 1) times the code
    points of a node's last text over its subtree; ends_sha256 is of the ids that end at the node. conv_ids are distinct and not
    null. An empty table has no node.
    """
    keys = F.unhex(F.array_join(F.transform("turns", lambda t: t["key"]), ""))
    paths = materialize(conversations.select("conv_id", keys.alias("path"), F.transform("turns", lambda t: t["n"]).alias("lens")), "paths")
    ordered = paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    levels = [materialize(ordered.mapInArrow(_runs(run, run_turns), ROWS), "trie", "kind")]
    whole, into = False, F.expr(f"seq div {RUNS}")
    while not whole:
        strings = levels[-1].filter("kind = 'string'").withColumn("into", into)
        last = strings.agg(F.max("into")).first()[0] or 0
        whole = last == 0
        dealt = strings.select("into", "seq", "side", "path", "lens", "parts").repartition("into").sortWithinPartitions("into", "seq", "side")
        levels.append(materialize(dealt.mapInArrow(_merge(whole), ROWS), "trie", "kind"))
        into = F.expr(f"seq div {fan}")
    nodes, names = None, None
    for level in reversed(levels):
        complete = level.filter("kind = 'node'").select("seq", "depth", "conv_id", "parent", "to_side", "n", "kids", "leaves", "saved", "ends")
        if names is not None:  # the names of this level's open nodes
            of = names.select("seq", F.col("side").alias("to_side"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("named"))
            complete = complete.filter("to_side is null").unionByName(complete.filter("to_side is not null").drop("parent").join(of, ["seq", "to_side", "depth"]).withColumnRenamed("named", "parent"))
        nodes = complete if nodes is None else nodes.unionByName(complete)
        links = level.filter("kind = 'link'").select("seq", "side", "depth", "conv_id", "to_seq", "to_side")
        known = links.filter("conv_id is not null").select("seq", "side", "depth", "conv_id")
        if names is not None and level is not levels[0]:
            of = names.select(F.col("seq").alias("to_seq"), F.col("side").alias("to_side"), "depth", "conv_id")
            known = known.unionByName(links.filter("conv_id is null").drop("conv_id").join(of, ["to_seq", "to_side", "depth"]).select("seq", "side", "depth", "conv_id"))
        if level is not levels[0]:
            names = materialize(known, "trie")
    pieces = levels[0].filter("kind = 'ends'").select("seq", "side", "depth", "ends").join(names, ["seq", "side", "depth"])
    hashed = pieces.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "seq").mapInArrow(_digests, "conv_id long, depth long, ends binary")
    late = nodes.filter("ends is null").drop("ends").join(hashed, ["conv_id", "depth"], "left")
    both = nodes.filter("ends is not null").unionByName(late)
    return both.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce(F.lower(F.hex("ends")), F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, rebuild=conversation_turns, **sizes) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text), each conversation made of its turns by ``rebuild``.

    Turns are ordered by turn, null first, equal ones by the hash of role and text; a null role or text counts as empty. Rows with
    a null conv_id belong to no conversation and are left out. A repeated row is one more turn. Other columns are not read.
    """
    return trie(rebuild(turns.select("conv_id", "turn", "role", "text")), **sizes)
