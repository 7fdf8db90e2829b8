from pyspark.sql import functions as F

from frames import CLASHING, SF, no_documents, odd_documents, rows_of, shingle_set
from plumbline.llm import contamination
from plumbline.llm.queries import QUERIES
from plumbline.llm.tables import table


def brute(docs, items, percent=80):
    out = set()
    for item_id, text in items:
        own = shingle_set(text)
        for doc_id, body in docs:
            shared = len(own & shingle_set(body))
            if own and doc_id is not None and item_id is not None and 100 * shared >= percent * len(own):
                out.add((doc_id, item_id, len(own), shared))
    return out


def test_same_as_comparing_everything(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    found = rows_of(QUERIES["op3_decontamination"](spark, SF), "doc_id", "item_id", "n_shingles", "n_shared")
    expected = brute(rows_of(docs, "doc_id", "text"), rows_of(items, "item_id", "text"))
    assert set(found) == expected and len(found) == len(expected) > 0


def items_frame(spark):
    near = " ".join(f"n{i}" for i in range(100, 130))
    rows = [(1, near), (2, None), (3, ""), (4, "one TWO three"), (5, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 changed w8x8 w9x9"), (6, "a a a a a a a a"), (7, "never there at all in any text"), (1, near), (None, near)]
    rows += [(8, " ".join([f"n{i}" for i in range(40, 70)] + ["x"] * 5)), (9, " ".join([f"n{i}" for i in range(40, 70)] + [f"x{i}" for i in range(9)]))]
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit(2) for c in CLASHING + ["n", "item_shingles"]})


def test_odd_rows_with_and_without_broadcast(spark, monkeypatch):
    docs, items = odd_documents(spark), items_frame(spark)
    expected = brute(rows_of(docs, "doc_id", "text"), rows_of(items, "item_id", "text"))
    assert {(13, 1), (4, 4), (10, 6)} <= {e[:2] for e in expected} and not {7, 5} & {e[1] for e in expected}
    for rows in (contamination.BROADCAST_ROWS, 0):
        monkeypatch.setattr(contamination, "BROADCAST_ROWS", rows)
        assert set(rows_of(contamination.contained_items(docs, items), "doc_id", "item_id", "n_shingles", "n_shared")) == expected


def test_stage_drops_contaminated_documents_only(spark):
    docs = odd_documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    out = contamination.without_items(docs, items_frame(spark))
    gone = {d for d, *_ in brute(rows_of(docs, "doc_id", "text"), rows_of(items_frame(spark), "item_id", "text"))}
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()} - gone and out.columns == docs.columns


def test_only_built_in_functions(spark):
    plan = QUERIES["op3_decontamination"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_tables(spark):
    items = items_frame(spark)
    assert contamination.contained_items(no_documents(spark), items).count() == 0
    assert contamination.contained_items(odd_documents(spark), items.where("false")).count() == 0
    assert contamination.without_items(odd_documents(spark), items.where("false")).count() == 20


def test_counts_of_a_repeated_item_id_belong_together(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    items = spark.createDataFrame([(1, words("a", 14)), (1, words("b", 104)), (2, words("c", 14)), (2, words("d", 104))], "item_id long, text string")
    docs = spark.createDataFrame([(7, words("a", 14) + " , " + words("b", 95)), (8, words("c", 14) + " , " + words("d", 104))], "doc_id long, text string")
    found = rows_of(contamination.contained_items(docs, items), "doc_id", "item_id", "n_shingles", "n_shared")
    assert sorted(found) == [(7, 1, 10, 10), (8, 2, 100, 100)]
