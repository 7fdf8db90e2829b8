"""The trie against a plain one of nested dictionaries, over shards of any size."""

import hashlib
import random
import zlib

import pytest
from frames import CLASHING, SF
from pyspark.sql import functions as F

from plumbline.llm import prefix_trie
from plumbline.llm.queries import QUERIES
from plumbline.llm.tables import table

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100 if c >= 0 else c + -c % 100, [])[:h] + turns[h:]
    return out


def brute(rows):
    talks, nodes = rebuilt(rows), {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children, out = {}, []
    for path in nodes:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        below = children.get(path, [])
        leaves[path] = sum(leaves[x] for x in below) if below else 1
        saved[path] = sum(saved[x] for x in below) + ((len(nodes[path]) - 1) * len(path[-1][1]) if path else 0)
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(talks[c]) == len(path))
        parent = min(nodes[path[:-1]]) if path else None
        out.append((min(members), len(path), parent, len(members), len(children.get(path, [])), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def odd_rows(seed=7):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 160), *range(200, 330, 3), -7, -100, -150, 10**12]:
        for turn in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            rows.append((c, turn, rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "bb", "é🙂", "", None, "long " * 50])))
    for c in range(400, 470):  # one conversation, many times
        rows += [(c, t, "user", f"same {t}") for t in range(7)]
    rows += [(500 + i, t, "user", "first") for i in range(40) for t in range(1 + i % 5)]
    rows += [(700, t, "user", f"turn {t // 2}") for t in range(120)] + [(c, t, "user", f"turn {t // 2}") for c in (701, 702) for t in range(90 + c % 2)]
    rows += [(800, None, "user", "no turn"), (800, 1, "user", "tie"), (800, 1, "system", "tie"), (800, 1, "user", "tie"), (None, 1, "user", "nobody"), (None, None, None, None)]
    rows += [(c, 0, "user", "x" * 200_000) for c in (900, 901)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_turns", [7, 60, 100_000])
def test_odd_rows(spark, shard_turns):
    rows = odd_rows()
    talks = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("extra") for n in [*CLASHING, "base", "own", "head", "path", "chars", "shard", "slot", "key"]})
    assert found(prefix_trie.prefix_trie(talks, shard_turns)) == brute(rows)


def test_empty_table(spark):
    assert found(prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []


def test_turnless_conversation(spark):
    short = next(c for c in range(100) if zlib.crc32(str(c + 300).encode()) % 6 > 1) + 300
    rows = [(short, 0, "user", "only")]
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_ends_of_a_border_node_in_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 3)
    conv, paths = list(range(50)), [b"p" * 16] * 50
    import numpy as np

    got = prefix_trie.parts_of(0, np.array(conv), paths, [np.array([4])] * 50)
    pieces = [r for r in got if r["kind"] == "ends"]
    assert ",".join(r["ends"] for r in pieces) == ",".join(map(str, conv)) and len(pieces) == 17
    df = spark.createDataFrame([(bytearray(r["key"]), r["shard"], r["slot"], r["ends"]) for r in pieces], "key binary, shard int, slot int, ends string")
    assert [r["hash"] for r in prefix_trie._hash_of(df).collect()] == [hashlib.sha256(",".join(map(str, conv)).encode()).hexdigest()]


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op11_prefix_trie"](spark, SF)) == brute(rows)
