"""Licence statements in documents: a trained paragraph classifier, confirmed by template comparison.

A paragraph is a block of lines up to a blank one; each of its lines is scored as well, so that one-line
statements inside prose are found. Its features are the words and word pairs it holds. A sparse
multinomial logistic regression over licence families and an unknown class is trained on the driver
from a fixed set of notices (with words left out and added) and a bounded sample of the corpus's own
lines as unknowns; word pairs and words that are common in that sample are no features. Probabilities
are scaled on notices and lines kept from training, and the threshold of the unknown class is set
there. Scoring is a join of the paragraphs' features with the weights, a bounded table. A predicted
family is confirmed if the paragraph holds most of the words of one of its notices.
Scoring uses built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.once import once
from plumbline.llm.sampling import hashed_share

LINES = 2000
COMMON = 0.01
CONFIRMED = 0.8
UNKNOWN = "unknown"

# Short notices by family, as commonly written.
NOTICES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "This software is released under the Apache License 2.0.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GNU GPL, version 2 or later.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc0": [
        "This work is dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        "SPDX-License-Identifier: ISC",
    ],
}


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def features(of: Column) -> Column:
    """Distinct words, and distinct pairs of neighbours."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(of) - 1), lambda i: F.concat_ws(" ", F.get(of, i - 1), F.get(of, i)))
    return F.array_distinct(F.concat(of, F.when(F.size(of) >= 2, pairs).otherwise(F.array().cast("array<string>"))))


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, whole, paragraph, words): lines that hold a word, and whole blocks of several lines up to a
    blank one, which stand at their first line; lines are numbered from 0 among all. None for null texts."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), once(F.split("text", r"\r\n|[\n\r]")).alias("lines")).where("lines is not null")
    blank = F.filter(F.transform("lines", lambda line, i: F.when(~line.rlike(r"\S"), i)), lambda i: i.isNotNull())
    edges = lines.select("doc_id", "lines", once(F.concat(F.array(F.lit(-1)), blank, F.array(F.size("lines")))).alias("edges"))
    spans = edges.select("doc_id", "lines", F.posexplode("edges").alias("at", "edge"), F.col("edges"))
    spans = spans.where(F.get("edges", F.col("at") + 1) > F.col("edge") + 1)
    blocks = spans.select("doc_id", (F.col("edge") + 1).alias("start"), once(F.slice("lines", F.col("edge") + 2, F.get("edges", F.col("at") + 1) - F.col("edge") - 1)).alias("body"))
    unit = lambda at, whole, text: F.struct(at.alias("paragraph"), F.lit(whole).alias("whole"), text.alias("text"))
    single = F.transform("body", lambda line, i: unit(F.col("start") + i, False, line))
    several = F.when(F.size("body") > 1, F.array(unit(F.col("start"), True, F.array_join("body", " ")))).otherwise(F.slice(single, 1, 0))
    units = blocks.select("doc_id", "start", F.inline(F.concat(single, several)))
    return units.select("doc_id", "start", "whole", "paragraph", once(tokens(F.col("text"))).alias("words")).where("size(words) > 0")


@dataclass
class Model:
    families: list[str]  # the unknown class last
    weights: dict[str, list[float]]
    bias: list[float]
    threshold: float


def _words(text: str) -> list[str]:
    import re

    return re.findall(r"[^\W_]+", text.lower())


def _features(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def _variants(words: list[str], rng: np.random.Generator, filler: list[str], n: int) -> list[list[str]]:
    """The notice itself and copies with words left out or put in."""
    out = [words]
    for _ in range(n):
        copy = [w for w in words if rng.random() > 0.08] or words
        for _ in range(int(rng.integers(0, 3))):
            copy.insert(int(rng.integers(0, len(copy) + 1)), filler[int(rng.integers(0, len(filler)))])
        out.append(copy)
    return out


def trained(lines: list[list[str]], rounds: int = 200, shrink: float = 2e-4) -> Model:
    """From the notices and unknown ``lines`` (bounded); one in four of both is kept to calibrate on."""
    rng = np.random.Generator(np.random.PCG64(8))
    families = [*NOTICES, UNKNOWN]
    notice_words = {w for texts in NOTICES.values() for t in texts for w in _words(t)}
    licence_like = {"license", "licensed", "licence", "licenses", "spdx"}
    lines = [x for x in lines if not licence_like & set(x)]  # a line that names a licence is no known unknown
    filler = sorted({w for x in lines[:200] for w in x}) or ["lorem"]
    # Unknowns made of the notices' own words, without their order, so that single words are no proof.
    pool = sorted(notice_words - licence_like)
    lines = lines + [[pool[int(i)] for i in rng.integers(0, len(pool), 8)] for _ in range(400)]
    rows, labels = [], []
    for label, texts in enumerate(NOTICES.values()):
        for text in texts:
            for variant in _variants(_words(text), rng, filler, 15):
                rows.append(_features(variant))
                labels.append(label)
    known = {f for row in rows for f in row}
    often: dict[str, int] = {}
    for x in lines:
        for f in _features(x) & known:
            often[f] = often.get(f, 0) + 1
    vocabulary = sorted(f for f in known if often.get(f, 0) <= COMMON * max(len(lines), 100) and any(w in notice_words for w in f.split()))
    at = {f: i for i, f in enumerate(vocabulary)}
    rows += [_features(x) for x in lines]
    labels += [len(families) - 1] * len(lines)
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, row in enumerate(rows):
        x[i, [at[f] for f in row if f in at]] = 1
    y = np.array(labels)
    kept = rng.random(len(y)) < 0.25
    weights, bias = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    a, target = x[~kept], np.eye(len(families))[y[~kept]]
    share = 1 / np.maximum(np.bincount(y[~kept], minlength=len(families)), 1)[y[~kept]] / len(families)
    for _ in range(rounds):
        z = a @ weights + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        err = (p - target) * share[:, None]
        weights -= 8 * (a.T @ err)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - 8 * shrink, 0)  # sparse
        bias -= 8 * err.sum(0)

    def probabilities(heat: float) -> np.ndarray:
        z = (x[kept] @ weights + bias) / heat
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    truth = y[kept]
    heat = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: -np.log(probabilities(t)[np.arange(len(truth)), truth] + 1e-12).mean())
    p = probabilities(heat)
    best = p[:, :-1].max(1)
    unknown = truth == len(families) - 1
    # No calibration line may pass; half-way to the certain if none comes near.
    threshold = float(np.clip(best[unknown].max() * 1.05 if unknown.any() else 0.5, 0.5, 0.95))
    return Model(families, {f: (weights[i] / heat).tolist() for f, i in at.items() if np.abs(weights[i]).max() > 1e-9}, (bias / heat).tolist(), threshold)


def licence_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, family, probability, similarity, confirmed) of paragraphs that are not unknown.

    Every line of every text (doc_id, text) and every block of lines up to a blank one is scored. A block
    stands for its lines of the same family, at its first line, unless one of them alone is confirmed
    or the block is not, but a line is found. ``similarity`` is the largest share of a
    notice's words, among the family's notices, that the paragraph holds. Null, empty and wordless
    texts have no paragraphs; repeated rows of a document count once; other columns are ignored.
    """
    spark = docs.sparkSession
    lines = paragraphs(docs)
    # Lines of a bounded share of the documents, so that tasks have no more to send than is taken.
    some = paragraphs(hashed_share(docs, "doc_id", LINES))
    sample = some.select("words").where("size(words) between 3 and 200").distinct().orderBy(F.xxhash64("words"), "words").limit(LINES).collect()
    model = trained([r.words for r in sample])
    weights = spark.createDataFrame(list(model.weights.items()), "feature string, weight array<double>")
    notices = spark.createDataFrame([(f, sorted(set(_words(t)))) for f, ts in NOTICES.items() for t in ts], "family string, notice array<string>")
    # Bounded by the notices: some thousand features, some dozen notices, some hundred words of them. A paragraph
    # goes on as the hash of its words, its features that have a weight, and its words that notices have.
    of_notices = sorted({w for ts in NOTICES.values() for t in ts for w in _words(t)})
    weighed = once(F.filter(features(F.col("words")), lambda f: f.isin(*model.weights)))
    held = F.array_distinct(F.filter("words", lambda w: w.isin(*of_notices)))
    featured = lines.select("doc_id", "start", "whole", "paragraph", "words", weighed.alias("features")).where("size(features) > 0")
    featured = featured.select("doc_id", "start", "whole", "paragraph", F.xxhash64("words").alias("text"), once(held).alias("held"), "features")
    met = featured.select("doc_id", "start", "whole", "paragraph", "text", "held", F.explode("features").alias("feature")).join(F.broadcast(weights), "feature")
    grouped = met.groupBy("doc_id", "start", "whole", "paragraph", "text").agg(F.sort_array(F.collect_set(F.struct("feature", "weight"))).alias("found"), F.first("held").alias("held"))
    logits = F.aggregate("found", F.array(*[F.lit(float(b)) for b in model.bias]), lambda s, f: F.zip_with(s, f["weight"], lambda a, b: a + b))
    top = F.array_max(logits)
    odds = F.transform(logits, lambda z: F.exp(z - top))
    total = F.aggregate(odds, F.lit(0.0), lambda s, e: s + e)
    named = F.transform(F.slice(odds, 1, len(model.families) - 1), lambda e, i: F.struct((e / total).alias("p"), F.get(F.array(*map(F.lit, model.families)), i).alias("family")))
    best = grouped.select("doc_id", "start", "whole", "paragraph", "text", "held", once(F.array_max(named)).alias("best")).where(F.col("best.p") >= model.threshold)
    compared = best.select("doc_id", "start", "whole", "paragraph", "text", "held", "best.family", F.round("best.p", 6).alias("probability")).join(F.broadcast(notices), "family")
    share = F.size(F.array_intersect("notice", "held")) / F.size("notice")
    out = compared.groupBy("doc_id", "start", "whole", "paragraph", "text", "family", "probability").agg(F.max(share).alias("similarity"))
    out = out.withColumn("confirmed", F.col("similarity") >= CONFIRMED)
    row = F.struct("whole", F.col("paragraph").cast("long").alias("paragraph"), "family", "probability", "similarity", "confirmed")
    lines_only = F.coalesce(F.bool_or(~F.col("whole") & F.col("confirmed")), F.lit(False)) | (F.bool_or(~F.col("whole")) & ~F.bool_or(F.col("whole") & F.col("confirmed")))
    per_block = out.groupBy("doc_id", "start", "family").agg(F.collect_list(row).alias("rows"), lines_only.alias("lines_only")).withColumnRenamed("family", "of")
    found = per_block.select("doc_id", "lines_only", F.inline("rows")).where(F.col("whole") != F.col("lines_only"))
    return found.select("doc_id", "paragraph", "family", "probability", "similarity", "confirmed")
