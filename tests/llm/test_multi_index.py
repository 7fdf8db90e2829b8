import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import CLASHING, SF, rows_of
from plumbline.llm import multi_index
from plumbline.llm.queries import QUERIES
from plumbline.llm.tables import table


def exact(rows, k, is_query):
    ids, data = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if is_query(i):
            score = data @ np.array(v, float)
            order = [j for j in np.lexsort((ids, -np.round(score, 9))) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def found_of(df):
    out = {}
    for q, rank, v, s in sorted(rows_of(df, "query_id", "rank", "vec_id", "score")):
        out.setdefault(q, []).append((v, s))
        assert rank == len(out[q])
    return out


def recall(found, expected):
    return np.mean([len({v for v, _ in found[q]} & {v for v, _ in best}) / len(best) for q, best in expected.items()])


def test_recall_on_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    expected, found = exact(rows, 20, lambda i: i % 20 == 0), found_of(QUERIES["op6_multi_index"](spark, SF))
    assert found.keys() == expected.keys() and recall(found, expected) >= 0.9
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, best in found.items():
        assert len(best) == 20 and all(abs(float(vectors[q] @ vectors[v]) - s) < 1e-12 for v, s in best)


@pytest.mark.parametrize("chunk, block", [(8192, 2048), (64, 8)])
def test_recall_on_clusters_of_other_norms(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(multi_index, "CHUNK_ENTRIES", chunk)
    monkeypatch.setattr(multi_index, "BLOCK_QUERIES", block)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((7, 11)) * 3
    rows = [(i, (centres[i % 7] + rng.standard_normal(11) * (0.2 + i % 3)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = exact(rows, 20, lambda i: i % 50 == 0)
    assert recall(found_of(multi_index.nearest(df, F.col("vec_id") % 50 == 0)), expected) >= 0.9


def test_ties_frequent_vectors_and_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(60)] + [(100, [5.0, 0.0, 1.0]), (100, [5.0, 0.0, 1.0]), (101, None), (102, []), (103, [0.0, 0.0, 0.0])]
    rows += [(104, [nan, 1.0, 1.0]), (105, [inf, 1.0, 1.0]), (106, [None, 1.0, 1.0]), (107, [1.0]), (None, [1.0, 1.0, 1.0]), (120, [-1.0, -1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in CLASHING + ["v", "i", "chunk", "label"]})
    found = found_of(multi_index.nearest(df, F.col("vec_id") % 20 == 0))
    assert found.keys() == {0, 20, 40, 100, 120}
    assert [v for v, _ in found[0]] == [100, 100, *range(1, 19)]
    assert [v for v, _ in found[20]] == [100, 100, *range(18)]
    assert [v for v, _ in found[100]] == [*range(20)] and len(found[120]) == 20


@pytest.mark.parametrize("copies", [1, 5])
def test_tight_clusters_as_large_as_the_answer(spark, copies):
    rng = np.random.default_rng(3)
    centres = np.eye(12)[:, rng.permutation(12)] * 10 + np.tile(np.eye(6), (2, 2)) * 5
    rows = [(i, (centres[i % 12] + rng.standard_normal(12) * 1e-4).tolist()) for i in range(12 * 20)]
    rows += [row for row in rows if row[0] in (0, 20, 40) for _ in range(copies - 1)]
    found = found_of(multi_index.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0))
    assert len(found) == 12 and {len(best) for best in found.values()} == {20}


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert found_of(multi_index.nearest(df, F.col("vec_id") % 20 == 0)) == {20: [(2, 1.0), (1, 0.0)]}
    assert multi_index.nearest(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0
    assert multi_index.nearest(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0
