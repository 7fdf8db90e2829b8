from pyspark.sql import functions as F

from frames import CLASHING, SF, no_documents, odd_documents, rows_of
from plumbline.llm import licenses
from plumbline.llm.queries import QUERIES
from plumbline.llm.tables import table

KNOWN = [
    ("Licensed under the Apache License, Version 2.0.", "apache"), ("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"), ("// SPDX-License-Identifier: MPL-2.0", "mpl"),
    ("This project is licensed under the MIT license terms.", "mit"),
]
OTHER = ["We walked under the general version of the sky.", "The public work is free of charge today", "no licence words here", "version 3", "under the", "public domain"]


def test_families_and_unknowns(spark):
    filler = [r.text for r in table(spark, SF, "documents").limit(60).collect()]
    rows = [(i, f"{filler[i % 60][:200]}\r\n\n{t}\nmore text") for i, (t, _) in enumerate(KNOWN)] + [(100 + i, t) for i, t in enumerate(OTHER)]
    rows += [(1000 + i, t) for i, t in enumerate(filler)]
    found = rows_of(licenses.licence_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "paragraph", "family", "confirmed")
    named = {d: (p, f) for d, p, f, _ in found if d < 1000}
    assert {d: f for d, (_, f) in named.items()} == {i: f for i, (_, f) in enumerate(KNOWN)}
    assert all(c for d, _, _, c in found if d in (0, 1, 2, 3))


def test_every_licence_line_of_documents(spark):
    import re

    found = {(r.doc_id, r.paragraph): r for r in QUERIES["op8_license_scan"](spark, SF).collect()}
    lines = {(r.doc_id, i): t for r in table(spark, SF, "documents").collect() for i, t in enumerate(re.split(r"\r\n|[\n\r]", r.text or ""))}
    stated = {k for k, t in lines.items() if re.search("Apache License|MIT License|GNU General Public|CC BY-NC", t)}
    assert stated and stated == found.keys() and all(0.5 <= r.probability <= 1 for r in found.values())


def test_scoring_has_only_built_in_functions(spark):
    plan = QUERIES["op8_license_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_and_no_rows(spark):
    docs = odd_documents(spark).withColumns({c: F.lit(0) for c in ["paragraph", "family", "feature", "found"]})
    extra = spark.createDataFrame([(50, "Released under the MIT License.")] * 2 + [(None, "Released under the MIT License.")], "doc_id long, text string")
    found = rows_of(licenses.licence_paragraphs(docs.unionByName(extra, allowMissingColumns=True)), "doc_id", "family", "similarity")
    assert sorted(found, key=repr) == [(50, "mit", 1.0), (None, "mit", 1.0)] and set(CLASHING) <= set(docs.columns)
    assert licenses.licence_paragraphs(no_documents(spark)).count() == 0


WRAPPED = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction", "mit"),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:", "bsd"),
    ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.", "mit"),
    ("This program is free software; you may redistribute it\nand/or modify it under the terms of the GNU General\nPublic License", "gpl"),
]


def test_wrapped_notices_and_paraphrases(spark):
    filler = [r.text for r in table(spark, SF, "documents").limit(60).collect()]
    rows = [(i, f"some words before\n\n{t}\n \nmore text\nafter it") for i, (t, _) in enumerate(WRAPPED)] + [(1000 + i, t) for i, t in enumerate(filler)]
    found = rows_of(licenses.licence_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "paragraph", "family", "confirmed")
    assert sorted(r for r in found if r[0] < 1000) == [(i, 2, f, True) for i, (_, f) in enumerate(WRAPPED)]
