import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import SF, brute_components, no_documents, odd_documents, rows_of
from plumbline.llm.components import components
from plumbline.llm.ngram_join import chunk_pairs, dealt_in_chunks, jaccard_components, one_of_each, tree_join
from plumbline.llm.tables import table


@pytest.mark.parametrize("chunk", [2_000_000, 300])
def test_same_as_comparing_all_pairs(spark, chunk):
    docs = odd_documents(spark)
    found = rows_of(jaccard_components(docs, chunk=chunk), "doc_id", "n_shingles", "component_id")
    assert sorted(found, key=repr) == brute_components(rows_of(docs, "doc_id", "text"))


def test_same_as_comparing_all_pairs_on_documents(spark):
    docs = table(spark, SF, "documents")
    found = rows_of(jaccard_components(docs, chunk=2000), "doc_id", "n_shingles", "component_id")
    assert sorted(found, key=repr) == brute_components(rows_of(docs, "doc_id", "text"))


def test_chains_at_the_threshold(spark):
    """Families of near copies around 0.8, so that links at, above and below it occur, in many chunks."""
    rng, rows = random.Random(7), []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(49)]
        for copy in range(12):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"c{family}x{copy}y{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_components(rows)
    assert len({c for _, _, c in expected}) < len(rows)
    for chunk in (2_000_000, 200):
        assert sorted(rows_of(jaccard_components(docs, chunk=chunk), "doc_id", "n_shingles", "component_id"), key=repr) == expected


def test_small_families_share_chunks(spark):
    """10,000 families of 200 shingles, a large one and single sets in one cluster: chunks number as shingles do."""
    one = F.lit(1).cast("long").alias("component")
    small = spark.range(20_000).select(one, F.floor(F.col("id") / 2).alias("family"), F.col("id").alias("set_id"), F.lit(100).alias("n_shingles"))
    large = spark.range(20_000, 25_000).select(one, F.lit(20_000).cast("long").alias("family"), F.col("id").alias("set_id"), F.lit(100).alias("n_shingles"))
    alone = spark.range(25_000, 30_000).select(one, F.lit(None).cast("long").alias("family"), F.col("id").alias("set_id"), F.lit(100).alias("n_shingles"))
    sets = small.unionByName(large).unionByName(alone).withColumn("shingles", F.lit(b""))
    dealt = dealt_in_chunks(sets, 200_000)
    assert dealt.count() == 30_000
    assert dealt.where("family < 20000").groupBy("family").agg(F.count_distinct("name").alias("n")).where("n > 1").count() == 0
    names = {r.name: r.n for r in dealt.groupBy("name").agg(F.count("*").alias("n")).collect()}
    assert len(names) <= 3 + 13 and max(names.values()) < 3_000
    pairs = {r.pair for r in chunk_pairs(dealt).collect()}
    mixed, own = [x for x in names if x.startswith("mixed")], [x for x in names if not x.startswith("mixed")]
    assert len(pairs) == len(mixed) * (len(mixed) + 1) // 2 + len(mixed) * len(own)


def test_tree_join_on_random_sets():
    rng = np.random.default_rng(3)
    for _ in range(60):
        pool = rng.integers(0, 2**63, 30).astype(np.uint64)
        base = np.sort(rng.choice(pool, 20, replace=False))
        sets = [np.sort(np.unique(np.concatenate([rng.choice(base, rng.integers(14, 20), replace=False), rng.choice(pool, 2)]))) for _ in range(14)]
        everyone = list(range(len(sets)))
        found = tree_join(sets, everyone, everyone, 80)
        plain = list(range(len(sets)))

        def root(i):
            while plain[i] != i:
                i = plain[i]
            return i

        for i in everyone:
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    plain[max(root(i), root(j))] = min(root(i), root(j))
        assert [found.find(i) for i in everyone] == [root(i) for i in everyone]


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 400), (400, 500)]
    found = dict(rows_of(components(spark.createDataFrame(links, "a long, b long")), "node", "component"))
    assert found == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 140)} | {400: 400, 500: 400}


def test_stage_keeps_one_of_each(spark):
    docs = odd_documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    kept = {r.doc_id for r in one_of_each(docs).collect()}
    linked = brute_components(rows_of(docs, "doc_id", "text"))
    assert kept == {d for d, _, c in linked if d == c} and {13, 4, 1, 2, 3} <= kept and not {14, 15, 5} & kept
    assert one_of_each(docs).columns == docs.columns


def test_empty_table(spark):
    assert jaccard_components(no_documents(spark)).count() == 0
