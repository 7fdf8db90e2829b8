import random

from pyspark.sql import functions as F

from frames import CLASHING, SF, no_documents, odd_documents, rows_of
from plumbline.llm import quality
from plumbline.llm.tables import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").join(labels.select("doc_id"), "doc_id", "left_semi")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(p, truth[d]) for d, h, p in rows_of(quality.scored(docs, labels), "doc_id", "held_out", "predicted") if h]
    good, bad = [p for p, t in held if t], [p for p, t in held if not t]
    assert len(bad) > 50 and sum(good) / len(good) > 0.98 and 1 - sum(bad) / len(bad) > 0.9


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("zz")})
    assert sorted(rows_of(quality.scored(docs, labels), "doc_id", "score")) == sorted(rows_of(quality.scored(other, turned), "doc_id", "score"))


def test_odd_rows(spark):
    docs, labels = odd_documents(spark), table(spark, SF, "labels")
    labels = labels.select("doc_id", "quality").union(spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 0), (12, 1)], "doc_id long, quality int"))
    rows = rows_of(quality.scored(docs.withColumn("quality", F.lit(3)), labels), "doc_id", "held_out", "score", "predicted")
    assert len(rows) == docs.count() and all(0 <= s <= 1 and p == int(s >= 0.3) for _, _, s, p in rows)
    assert len({s for d, _, s, _ in rows if d in (1, 2, 3)}) == 1 and len({s for d, _, s, _ in rows if d == 12}) == 1
    kept = quality.accepted(docs, labels)
    assert kept.columns == ["doc_id", "text", *CLASHING] and sorted(map(repr, rows_of(kept, "doc_id"))) == sorted(repr((d,)) for d, _, _, p in rows if p)


def test_no_labels_and_no_rows(spark):
    labels = table(spark, SF, "labels")
    assert {s for (s,) in rows_of(quality.scored(odd_documents(spark), labels.where("false")), "score")} == {0.5}
    assert quality.scored(no_documents(spark), labels).count() == 0 and quality.accepted(no_documents(spark), labels).count() == 0


def test_votes_are_exact():
    rng, rows = random.Random(2), []
    for i in range(40):
        rows.append(" ".join("".join(rng.choice("abc") for _ in range(4)) + ("!!" if i % 2 else "") for _ in range(30)))
    import numpy as np
    import pyarrow as pa

    data = quality.terms(pa.array(rows))
    voters = quality.Voters(np.ones(quality.TERMS, np.float32), np.eye(quality.TERMS, dtype=np.float32), quality.unit(data[:30]), np.arange(30) % 2 * 1.0, 0.5)
    near = quality.unit(data[30:]) @ quality.unit(data[:30]).T
    for score, row in zip(voters.scores(data[30:]), near):
        best = np.argsort(-row)[: quality.NEIGHBOURS]
        weight = row[best].astype(float) ** quality.SHARPNESS
        assert abs(score - (weight * (best % 2)).sum() / weight.sum()) < 1e-5


def test_texts_that_differ_only_in_words_are_told_apart(spark):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(5))
    good, bad = [word("abcdefgh") for _ in range(60)], [word("nopqrstu") for _ in range(60)]
    rows = [(i, " ".join(rng.choice((bad, good)[i % 2]) for _ in range(40))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    held = [(d, p) for d, h, p in rows_of(quality.scored(docs, labels), "doc_id", "held_out", "predicted") if h]
    assert len(held) > 50 and sum(p == d % 2 for d, p in held) > 0.95 * len(held)


def test_document_frequencies_cover_all_documents(spark):
    import numpy as np
    import pyarrow as pa

    texts = [f"common {'other' if i % 4 else 'third'}" for i in range(400)]
    found = quality.inverse_frequencies(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    held = np.count_nonzero(quality.terms(pa.array(texts)), axis=0)
    assert np.allclose(found, np.log(401 / (1 + held)) + 1)
