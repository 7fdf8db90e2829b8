import corpus_pipeline
from frames import SF, brute_components, brute_kept, rows_of, shingle_set
from plumbline.llm import packing, quality
from plumbline.llm.tables import table
from test_packing import COLUMNS, held


def test_run_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    good = {d for d, p in rows_of(quality.scored(docs, table(spark, SF, "labels")), "doc_id", "predicted") if p}
    rows = [(d, t) for d, t in rows_of(docs, "doc_id", "text") if d in good]
    first = {d for d, _, c in brute_components(rows) if d == c}
    rows = [r for r in rows if r[0] in first]
    cut = {d: (removed, kept.decode()) for d, _, removed, kept in brute_kept(rows)}
    rows = [(d, cut[d][1] if cut[d][0] else t) for d, t in rows if not cut[d][0] or cut[d][1]]
    items = [shingle_set(t) for (t,) in rows_of(table(spark, SF, "benchmark"), "text")]
    rows = [(d, t) for d, t in rows if not any(i and 100 * len(i & shingle_set(t)) >= 80 * len(i) for i in items)]
    from tokenizers import Tokenizer

    found = rows_of(corpus_pipeline.run(spark, SF), *COLUMNS)
    used, least = held(found, rows, Tokenizer.from_file(packing.default_tokenizer()))
    assert len(rows) < docs.count() and used <= 1.05 * least + 1


def test_stages_keep_columns_and_take_no_rows(spark):
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.where("false"), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SF).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substring_dedup", "decontamination", "packing"]
