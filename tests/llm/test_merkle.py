"""The manifest against a plain tree, and the bitmap ranks against sorting."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from frames import CLASHING, SF
from pyspark.sql import functions as F

from plumbline.llm import merkle
from plumbline.llm.queries import QUERIES
from plumbline.llm.tables import table

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    parts = [None if v is None else str(v) for v in row]
    return H("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))


def tree(nodes):
    """All levels, and for node i its siblings level by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i - i % 8
        out.append((i % 8, [x for j, x in enumerate(level[lo : lo + 8], lo) if j != i]))
        i //= 8
    return out


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: tree([leaf(r) for r in groups[g]]) for g in order}
    top = tree([trees[g][-1][0] for g in order]) if order else None
    out = []
    for j, g in enumerate(order):
        for i, row in enumerate(groups[g]):
            path = way(trees[g], i) + way(top, j)
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            now = leaf((*row[:4], text))
            for place, others in path:
                now = H("".join(others[:place] + [now] + others[place:]))
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[g][-1][0], root, H("".join(x for _, others in path for x in others)), now, now == root))
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def odd_rows():
    rng = random.Random(5)
    rows = [(i, "web", rng.choice(["en", "de", None, "", "é", "z"]), i % 7, f"Text {i} A") for i in rng.sample(range(-70_000, 200_000), 700)]
    rows += [(None, None, None, None, None), (None, "s", "en", 1, "no id"), (None, "s", "en", 1, "no id either"), (5, "a", "one", 2, "ALONE")]
    rows += [(7, "a", "en", 3, "same")] * 12 + [(7, "a", "en", 3, f"other {i}") for i in range(30)] + [(-9, "b", "en", None, None)] * 2
    rows += [(2**62 + 1, "far", "en", 0, ""), (-(2**63), "far", "en", 0, "X" * 300_000), (2**63 - 1, "far", "en", 0, "Ä")]
    return rows


def test_odd_rows(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("extra") for n in [*CLASHING, "grp", "rank", "leaf", "n", "chunk", "copies"]})
    assert found(merkle.manifest(docs)) == brute(rows)


def test_several_rounds_of_chunks(spark):
    """With chunks of 64 slots the same trees take several rounds, for rows and for groups."""
    rows = odd_rows() + [(i, "g", f"lang {i:03}", 1, "Group") for i in range(70)] + [(i, "m", "many", 1, "M") for i in range(600)]
    assert found(merkle.manifest(spark.createDataFrame(rows, SCHEMA), deep=2, shard_ids=300)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 1, "One")], [(i, "a", "en", 1, "x") for i in range(8)], [(i, "a", "en", 1, "x") for i in range(9)]])
def test_small_tables(spark, rows):
    assert found(merkle.manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert found(QUERIES["op13_merkle_manifest"](spark, SF)) == brute(rows)


def test_containers_merge_and_rank_as_sorting_does():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 65536, n) for n in (3, 5_000, 40_000)]
    whole = merkle.Container.merged([merkle.Container.read(*merkle.Container.of(p).packed()) for p in parts])
    every = np.sort(np.concatenate(parts))
    assert len(whole.packed()[0]) == 8192
    assert (merkle.Container.read(*whole.packed()).ranks(every.astype(np.uint16)) == np.searchsorted(every, every)).all()
