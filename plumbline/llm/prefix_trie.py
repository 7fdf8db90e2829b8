"""The prefix trie of conversations, from padded matrices of turn ids over range shards.

A conversation becomes one row: the 128-bit ids of its turns, and their lengths. Texts are hashed before
anything is shuffled. Rows are range-partitioned by their sequence of ids, then by ``conv_id``, so that a prefix shared by
any number of conversations lies in consecutive shards of even size. Each shard pads its sequences to a matrix, sorts it
by ``lexsort``, marks where a column or one before it changes (the starts of nodes), and sums up
every depth by ``reduceat``.

Only nodes on the path of a shard's first or last row can go on in a neighbour: border nodes. Their sums
are added by node; what both sides of a border counted is taken off again, level by level of the prefix
that the rows at the border share. The other nodes are final where they were made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.ship import ship
from plumbline.llm.store import stored

SHARD_TURNS = 100_000  # about so many turns a shard
LEAST_SHARDS = 12
FAMILY = 100  # conversations c and c - c % FAMILY share their beginning
BAND = 16  # columns of a matrix; longer sequences continue in the next band
CHUNK_IDS = 50_000  # ids of one row of a border node's ends
NO_ENDS = hashlib.sha256(b"").hexdigest()
_ID = 16  # bytes of a turn's id


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, path, chars): the rebuilt conversations of ``rows`` (conv_id, turn, role, text), see ``prefix_trie``."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"))
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("id"), F.length(text).cast("long").alias("chars")).alias("t"),
    )
    turns = turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    # One exchange: families lie together, so a conversation finds its base among its neighbours.
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    heads = own.groupBy("base").agg(F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, 5)), ignorenulls=True).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    head = F.coalesce(F.slice("head", F.lit(1), h), F.slice("own", 1, 0))
    rest = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    built = own.join(heads, "base").select("conv_id", F.concat(head, rest).alias("turns"))
    ids = F.array_join(F.transform("turns", lambda t: t["id"]), "")
    return built.select("conv_id", F.unhex(ids).alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


class Shard:
    """The sub-trie of some sequences: for each depth, where its nodes start and what they add up to.

    Sequences are sorted by id, a shorter one before those that it begins, equal ones by ``conv_id``.
    ``depths[d]`` holds arrays over the nodes of depth d in that order; ``rows`` are positions in it.
    """

    def __init__(self, conv: np.ndarray, paths: list[bytes], chars: list[np.ndarray]):
        size = np.array([len(p) // _ID for p in paths], np.int64)
        order = self._order(conv, paths, size)
        self.conv, self.size = conv[order], size[order]
        self.paths, self.chars = [paths[i] for i in order], [chars[i] for i in order]
        self.depths: list[dict[str, np.ndarray]] = []
        self._split()
        self._add_up()

    @staticmethod
    def _band(paths: list[bytes], rows: np.ndarray, first: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Turn ids of columns ``first`` and on as two 64-bit halves, padded with zeros, and which cells are filled."""
        ids = np.zeros((len(rows), 2 * width), ">u8")
        there = np.zeros((len(rows), width), bool)
        for k, i in enumerate(rows.tolist()):
            part = np.frombuffer(paths[i][first * _ID : (first + width) * _ID], ">u8")
            ids[k, : len(part)] = part
            there[k, : len(part) // 2] = True
        return ids.astype(np.uint64), there

    def _order(self, conv: np.ndarray, paths: list[bytes], size: np.ndarray) -> np.ndarray:
        """Order by sequence, then conv_id. Bands go from the last to the first; a later band is one more column, its rank."""
        tail = np.zeros(len(paths), np.int64)
        deepest = int(size.max()) if len(size) else 0
        for first in reversed(range(0, max(deepest, 1), BAND)):
            rows = np.flatnonzero(size > first) if first else np.arange(len(size))
            width = min(BAND, deepest - first)
            ids, there = self._band(paths, rows, first, width)
            keys = [column for d in range(width) for column in (there[:, d], ids[:, 2 * d], ids[:, 2 * d + 1])] + [tail[rows]]
            order = np.lexsort(keys[::-1])
            changed = np.zeros(len(rows), bool)
            for key in keys:
                changed[1:] |= key[order][1:] != key[order][:-1]
            rank = np.empty(len(rows), np.int64)
            rank[order] = np.cumsum(changed) + 1
            tail[rows] = rank
        return np.lexsort((conv, tail))

    def _split(self) -> None:
        """Nodes of each depth: ``start`` rows, members, least conv_id, parent's number, and the rows' node numbers."""
        n = len(self.size)
        rows, node = np.arange(n), np.zeros(n, np.int64)
        zero = np.zeros(1, np.int64)
        self._keep(rows, zero, np.full(1, -1), node)
        first = 0
        while len(rows) and first < self.size.max():
            width = int(min(BAND, self.size.max() - first))
            inside = np.flatnonzero(self.size[rows] > first)
            rows, node = rows[inside], node[inside]
            ids, there = self._band(self.paths, rows, first, width)
            change = np.ones((len(rows), width + 1), bool)
            change[1:, 0] = node[1:] != node[:-1]
            cell = (ids[1:] != ids[:-1]).reshape(-1, width, 2).any(axis=2) | (there[1:] != there[:-1])
            change[1:, 1:] = cell
            change = np.logical_or.accumulate(change, axis=1)
            for d in range(width):
                inside = np.flatnonzero(there[:, d])
                starts = np.flatnonzero(change[inside, d + 1])
                above, node = node[np.searchsorted(rows, rows[inside])], np.cumsum(change[inside, d + 1]) - 1
                rows, there, change = rows[inside], there[inside], change[inside]
                self._keep(rows, starts, above[starts], node)
            first += width

    def _keep(self, rows: np.ndarray, starts: np.ndarray, parent: np.ndarray, node: np.ndarray) -> None:
        d = len(self.depths)
        last = [int(self.chars[i][d - 1]) if d else 0 for i in rows[starts].tolist()]
        self.depths.append(
            {
                "start": rows[starts], "parent": parent, "n_convs": np.diff(np.append(starts, len(rows))),
                "conv_id": np.minimum.reduceat(self.conv[rows], starts), "last": np.array(last, np.int64),
                "n_ends": np.add.reduceat((self.size[rows] == d).astype(np.int64), starts),
            }
        )

    def _add_up(self) -> None:
        """From the deepest nodes upwards: children, leaves, and text lengths with and without the count of members."""
        below: dict[str, np.ndarray] | None = None
        for level in reversed(self.depths):
            level["n_children"] = np.zeros(len(level["start"]), np.int64)
            level["all_chars"], level["node_chars"] = level["n_convs"] * level["last"], level["last"].copy()
            level["n_leaves"] = np.zeros(len(level["start"]), np.int64)
            if below is not None:
                firsts = np.flatnonzero(np.diff(below["parent"], prepend=-1))
                at = below["parent"][firsts]
                level["n_children"][at] = np.diff(np.append(firsts, len(below["parent"])))
                for name in ("all_chars", "node_chars", "n_leaves"):
                    level[name][at] += np.add.reduceat(below[name], firsts)
            level["n_leaves"][level["n_children"] == 0] = 1
            below = level

    def ends(self, d: int, i: int) -> np.ndarray:
        """conv_ids that end at node i of depth d, ascending: the first of its rows."""
        start = int(self.depths[d]["start"][i])
        return self.conv[start : start + int(self.depths[d]["n_ends"][i])]


def node_keys(path: bytes) -> list[bytes]:
    """A digest for each prefix of a path, the empty one first."""
    sofar, out = hashlib.blake2b(digest_size=16), []
    for at in range(0, len(path) + 1, _ID):
        out.append(sofar.copy().digest())
        sofar.update(path[at : at + _ID])
    return out


def joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


# kind: "node", final but for its parent; "border", to be added up; "ends", a part of a border node's ends; "edge", a shard's first and last row.
PARTS = (
    "kind string, shard int, slot int, key binary, conv_id long, depth long, parent_conv_id long, parent_slot int, n_convs long, n_children long,"
    " n_leaves long, all_chars long, node_chars long, ends string, first binary, last binary, last_chars array<long>"
)
_PARTS = pa.schema(
    [
        ("kind", pa.string()), ("shard", pa.int32()), ("slot", pa.int32()), ("key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()),
        ("parent_conv_id", pa.int64()), ("parent_slot", pa.int32()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
        ("all_chars", pa.int64()), ("node_chars", pa.int64()), ("ends", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("last_chars", pa.list_(pa.int64())),
    ]
)
_SUMS = ["n_convs", "n_children", "n_leaves", "all_chars", "node_chars"]


def parts_of(shard: int, conv: np.ndarray, paths: list[bytes], chars: list[np.ndarray]) -> list[dict]:
    """All rows that a shard sends, see ``PARTS``."""
    trie = Shard(conv, paths, chars)
    first, last = trie.paths[0], trie.paths[-1]
    out: list[dict] = [{"kind": "edge", "shard": shard, "first": first, "last": last, "last_chars": trie.chars[-1].tolist()}]
    keys = {0: node_keys(first), 1: node_keys(last)}
    above: dict[int, int] = {}
    slots = 0
    for d, level in enumerate(trie.depths):
        border = {len(level["start"]) - 1: 1} if d < len(keys[1]) else {}
        border |= {0: 0} if d < len(keys[0]) else {}
        here, values = {}, {name: level[name].tolist() for name in ("conv_id", "parent", "n_ends", *_SUMS)}
        upper = trie.depths[d - 1]["conv_id"].tolist() if d else []
        for i in range(len(level["start"])):
            row = {"kind": "node", "shard": shard, "depth": d, **{name: values[name][i] for name in ("conv_id", *_SUMS)}}
            parent = values["parent"][i]
            if d and parent in above:
                row["parent_slot"] = above[parent]
            elif d:
                row["parent_conv_id"] = upper[parent]
            ends = trie.ends(d, i) if values["n_ends"][i] else None
            if i in border:
                key = keys[border[i]][d]
                here[i], slots = slots, slots + 1
                row |= {"kind": "border", "slot": here[i], "key": key}
                for k, lo in enumerate(range(0, values["n_ends"][i], CHUNK_IDS)):
                    out.append({"kind": "ends", "shard": shard, "slot": k, "key": key, "ends": joined(ends[lo : lo + CHUNK_IDS]).decode()})
            else:
                row["ends"] = hashlib.sha256(joined(ends)).hexdigest() if ends is not None else NO_ENDS
            out.append(row)
        above = here
    return out


def overlap(last: bytes, first: bytes, last_chars: list[int]) -> list[dict]:
    """What two neighbours both counted, as negative sums for each node on the path that their border rows share."""
    shared = 0
    while last[shared : shared + _ID] == first[shared : shared + _ID] and len(last) > shared < len(first):
        shared += _ID
    depth = shared // _ID
    ended = len(last) == shared  # then the deepest shared node is the neighbour's to call a leaf or not
    out, chars = [], 0
    for d in range(depth, -1, -1):
        chars += last_chars[d - 1] if d else 0
        out.append({"key": None, "depth": d, "n_children": -int(d < depth), "n_leaves": -int(ended), "node_chars": -chars})
    for row, key in zip(out, reversed(node_keys(last[:shared]))):
        row["key"] = key
    return out


def _table(rows: list[dict], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _neighbours(edges: DataFrame) -> DataFrame:
    """(last, last_chars, first): border rows of shards that follow each other. Shards without rows are passed over;
    their numbers, one integer a shard, are all that the driver sees."""
    shards = sorted(r["shard"] for r in edges.select("shard").collect())
    after = edges.sparkSession.createDataFrame(list(zip(shards[:-1], shards[1:])), "shard int, after int")
    right = edges.select(F.col("shard").alias("after"), "first")
    return edges.select("shard", "last", "last_chars").join(after, "shard").join(right, "after").select("last", "last_chars", "first")


def _hash_of(pieces: DataFrame) -> DataFrame:
    """(key, hash): SHA-256 of each border node's ends, joined by commas; pieces stream through one task a node."""
    schema = pa.schema([("key", pa.binary()), ("hash", pa.string())])

    def stream(batches):
        key, sofar = None, None
        for batch in batches:
            done = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k == key:
                    sofar.update(b",")
                else:
                    if key is not None:
                        done.append({"key": key, "hash": sofar.hexdigest()})
                    key, sofar = k, hashlib.sha256()
                sofar.update(text.encode())
            yield from _table(done, schema).to_batches()
        if key is not None:
            yield from _table([{"key": key, "hash": sofar.hexdigest()}], schema).to_batches()

    ordered = pieces.repartition("key").sortWithinPartitions("key", "shard", "slot").select("key", "ends")
    return ordered.mapInArrow(stream, "key binary, hash string")


def prefix_trie(rows: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations of ``rows`` (conv_id, turn, role, text).

    Turns are ordered by turn, null first, equal ones by a digest of role and text; repeated rows are turns
    of their own; a null role or text is empty. Conversation c starts with the first h turns of c - c % 100 (with the sign
    of c), h the CRC-32 of its id modulo 6, and goes on with its own after its first h. Rows without a conv_id are
    no conversation. Columns: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256 as in ``queries``; an empty table has no nodes. Other columns are
    ignored. Texts may be of any length; the ids of one conversation's turns, 16 bytes each, are one value.
    """
    ship(rows.sparkSession)
    shards = max(LEAST_SHARDS, -(-rows.count() // shard_turns))

    def build(batches):
        shard, held = TaskContext.get().partitionId(), [b for b in batches if len(b)]
        if held:
            table = pa.Table.from_batches(held)
            chars = [np.array(c, np.int64) for c in table["chars"].to_pylist()]
            found = parts_of(shard, table["conv_id"].to_numpy(), table["path"].to_pylist(), chars)
            for lo in range(0, len(found), 10_000):
                yield from _table(found[lo : lo + 10_000], _PARTS).to_batches()

    def undo(batches):
        schema = pa.schema([("key", pa.binary()), ("depth", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("node_chars", pa.int64())])
        for batch in batches:
            found = [r for last, chars, first in zip(*(c.to_pylist() for c in batch.columns)) for r in overlap(last, first, chars)]
            yield from _table(found, schema).to_batches()

    ranged = conversations(rows).repartitionByRange(shards, "path", "conv_id")
    parts = stored(ranged.mapInArrow(build, PARTS), "trie")
    of_kind = lambda kind: parts.where(F.col("kind") == kind)
    twice = _neighbours(of_kind("edge").select("shard", "first", "last", "last_chars")).select("last", "last_chars", "first")
    twice = twice.mapInArrow(undo, "key binary, depth long, n_children long, n_leaves long, node_chars long")
    border = of_kind("border").select("key", "depth", "conv_id", *_SUMS).unionByName(twice, allowMissingColumns=True)
    sums = stored(border.groupBy("key", "depth").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in _SUMS]), "trie-border")
    # Each border node's parent is a border node of the same shard.
    slots = of_kind("border").select("shard", "slot", "key", "parent_slot")
    named = slots.join(sums.select("key", F.col("conv_id").alias("node_conv_id")), "key").select("shard", "slot", "key", "parent_slot", "node_conv_id")
    up = named.select("shard", F.col("slot").alias("parent_slot"), F.col("node_conv_id").alias("upper"))
    parents = slots.join(up, ["shard", "parent_slot"]).groupBy("key").agg(F.first("upper").alias("parent_conv_id"))
    ends = _hash_of(of_kind("ends").select("key", "shard", "slot", "ends"))
    border = sums.join(parents, "key", "left").join(ends, "key", "left").withColumn("ends", F.coalesce("hash", F.lit(NO_ENDS)))
    nodes = of_kind("node").join(up, ["shard", "parent_slot"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "upper"))
    columns = ["conv_id", "depth", "parent_conv_id", *_SUMS, "ends"]
    every = nodes.select(*columns).unionByName(border.select(*columns))
    saved: Column = F.col("all_chars") - F.col("node_chars")
    return every.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.col("ends").alias("ends_sha256")
    )
