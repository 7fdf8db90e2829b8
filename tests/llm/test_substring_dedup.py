import hashlib

import pytest

from frames import CLASHING, SF, brute_kept, no_documents, odd_documents, rows_of
from plumbline.llm.substring_dedup import repeated_passages, without_repeats
from plumbline.llm.tables import table


def expected(rows, window):
    return sorted(((d, n, r, hashlib.sha256(k).hexdigest()) for d, n, r, k in brute_kept(rows, window)), key=repr)


@pytest.mark.parametrize("window, seed", [(35, 8), (9, 3), (8, 8)])
def test_same_as_brute_force_on_odd_rows(spark, window, seed):
    docs = odd_documents(spark)
    found = rows_of(repeated_passages(docs, window, seed), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(found, key=repr) == expected(rows_of(docs, "doc_id", "text"), window)


def test_same_as_brute_force_on_documents(spark):
    docs = table(spark, SF, "documents")
    found = rows_of(repeated_passages(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(found, key=repr) == expected(rows_of(docs, "doc_id", "text"), 35)


def test_repeats_are_maximal_spans(spark):
    shared = " ".join(f"s{i}" for i in range(50))
    docs = spark.createDataFrame([(1, f"a {shared} b c"), (2, f"{shared} d")], "doc_id long, text string")
    spans = {r.doc_id: [(s.first, s.words) for s in r.repeats] for r in repeated_passages(docs).collect()}
    assert spans == {1: [(1, 50)], 2: [(0, 50)]}


def test_stage_keeps_clean_texts_and_drops_emptied_ones(spark):
    docs = odd_documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    out = {r.doc_id: r for r in without_repeats(docs).collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    assert out[20].text == before[20] and out[2].text == "" and out[1].text is None
    assert out[7].text == "before after" and out[9].text == "tail" and 6 not in out and 8 not in out
    assert without_repeats(docs).columns == ["doc_id", "text", *CLASHING]


def test_empty_table(spark):
    assert repeated_passages(no_documents(spark)).count() == 0
    assert without_repeats(no_documents(spark)).count() == 0
