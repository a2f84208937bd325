"""Licence scans: a paragraph classifier with an unknown class, confirmed by template comparison.

A paragraph is a run of lines in which no line but the last ends a sentence, so a notice wrapped at 80
columns is one paragraph and a list of sentences, one a line, is many.  It is scored by a multinomial
logistic regression over word uni- and bigrams whose L1 penalty keeps few of them.  The words that
those hold are the model's anchors: a paragraph without one has no feature, so it is unknown and is
never scored.  Temperature scaling on folds of notices that a model has not seen calibrates the
probabilities.  A family is confirmed if the paragraph spells one of its names, if enough of its words
stand in one of the family's templates, or enough of a template in the paragraph, whatever else it
holds.  The model is fitted on the driver from the templates, names and sentences below; over
documents there are DataFrame functions only.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tesserspark.llm.common import let, materialize, plain_words

#: Customary notices of public licences, by family.
TEMPLATES = {
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "apache": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "you should have received a copy of the gnu general public license along with this program if not see https www gnu org licenses",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 2 1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        "you should have received a copy of the gnu lesser general public license along with this library if not see https www gnu org licenses",
    ],
    "bsd": [
        "released under the bsd 3 clause license",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ],
    "mpl": [
        "licensed under the mozilla public license version 2 0",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    ],
    "cc-by": ["licensed under cc by 4 0", "available under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["licensed under cc by sa 4 0", "available under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "available under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc0": ["released under cc0 1 0 universal", "to the extent possible under law the author has waived all copyright and related rights to this work public domain dedication"],
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "isc": [
        "released under the isc license",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "unlicense": ["released under the unlicense", "this is free and unencumbered software released into the public domain"],
    "cc-by-nd": ["licensed under cc by nd 4 0", "available under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license"],
    "cc-by-nc-sa": ["licensed under cc by nc sa 4 0", "available under cc by nc sa 4 0", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license"],
    "cc-by-nc-nd": ["licensed under cc by nc nd 4 0", "available under cc by nc nd 4 0", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"],
    "proprietary": ["copyright all rights reserved", "this document is proprietary and confidential no part may be reproduced without prior written permission of the copyright owner"],
}
#: Names of the licences, by family.
NAMES = {
    "mit": ["mit license", "expat license"],
    "apache": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache software license"],
    "gpl": ["gnu general public license", "gnu gpl", "gplv3", "gplv2", "gpl 3 0", "gpl 2 0"],
    "lgpl": ["gnu lesser general public license", "gnu lgpl", "lgplv3", "lgpl 2 1"],
    "bsd": ["bsd 3 clause license", "bsd 2 clause license", "3 clause bsd license", "2 clause bsd license", "new bsd license", "bsd license"],
    "mpl": ["mozilla public license", "mpl 2 0"],
    "cc-by": ["cc by 4 0", "cc by 3 0", "creative commons attribution 4 0", "creative commons attribution 3 0", "creative commons attribution license"],
    "cc-by-sa": ["cc by sa 4 0", "cc by sa 3 0", "creative commons attribution sharealike", "creative commons attribution share alike"],
    "cc-by-nc": ["cc by nc 4 0", "cc by nc 3 0", "creative commons attribution noncommercial 4 0", "creative commons attribution noncommercial license", "creative commons attribution non commercial license"],
    "cc0": ["cc0 1 0", "cc0 public domain dedication", "creative commons zero"],
    "agpl": ["gnu affero general public license", "gnu agpl", "agplv3", "agpl 3 0"],
    "isc": ["isc license"],
    "unlicense": ["the unlicense"],
    "cc-by-nd": ["cc by nd 4 0", "cc by nd 3 0", "creative commons attribution noderivatives", "creative commons attribution no derivatives"],
    "cc-by-nc-sa": ["cc by nc sa 4 0", "cc by nc sa 3 0", "creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"],
    "cc-by-nc-nd": ["cc by nc nd 4 0", "cc by nc nd 3 0", "creative commons attribution noncommercial noderivatives", "creative commons attribution non commercial no derivatives"],
    "proprietary": ["all rights reserved", "proprietary and confidential"],
}
#: Ways to name a licence, for training; every third is of one fold.
WAYS = [
    "licensed under {}", "released under {}", "this work is licensed under {}", "distributed under the terms of {}", "available under {}", "published under the {}", "this project is licensed under the {} see the license file for details",
    "license {}", "the source code is covered by the {}", "all articles on this page are available under {} unless noted otherwise", "you may use these files under the terms of the {}", "made available by the authors under {}",
    "contributions are accepted under the {}", "see the {} for more details", "text and pictures {}",
]
#: Sentences with words of notices that name no licence.
OTHERS = [
    "the driver lost his license in the accident", "permission to park was not granted", "the software was installed on the library computer", "human rights were reserved for later discussion", "the creative team praised the commons room",
    "a copyright dispute between two authors", "no license was found on the table", "you need a fishing license and a permission of the owner", "the warranty of the machine has expired", "students at mit wrote software",
    "the apache helicopter landed", "this library has no rights office", "licensed products of the club", "the general public was not admitted to the hearing", "he works for the public library of the city", "the house of commons voted on the bill",
    "version 2 0 of the program was released in may", "the attribution of the painting is disputed", "mozilla released a new version of the browser", "the foundation supports free software in schools", "copies of the report were sent to all members",
    "the work of the committee is subject to review", "terms and conditions of the hotel apply", "an express train without any stop", "the source of the river is in the mountains", "the binary star was found in 1904", "the authors were not available for comment",
    "the company shall not be liable to pay the fine", "a notice was put on the door", "the use of the room is permitted to members", "the license of the restaurant was renewed", "the licence fee pays for public television", "driving without a license is an offence",
    "rights of way cross the field", "seats are reserved for guests", "all seats were reserved", "the distribution of seats follows the law", "the state of the art in computer science", "the gnu is a large antelope of africa", "a claim for damages was filed in court",
    "merchants sold copies of the map without permission", "the original version of the song was published in 1970", "the public domain of the state includes the forests", "the clause of the contract was changed", "commercial use of the road is not allowed",
    "the derivative of the function is zero", "the document is confidential said the minister", "the license plate was stolen", "she has a license to teach at public schools", "this material is available in three colors", "the modification of the plan takes time",
]
#: Function words: no features by themselves.
FILLER = "the of and to in is it that for on with as was by at this from they are be or an not but which all you can has have we their more will about one".split()
UNKNOWN = "unknown"
#: Paragraphs that are likely licences (20 bytes each) are broadcast up to this many rows, counted first.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class LicenceModel:
    families: tuple[str, ...]  # the last is UNKNOWN
    features: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float
    anchors: tuple[str, ...]  # a text without any of these words has no feature


def _features(text: str) -> set[str]:
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower()) if x]
    tells = [len(x) > 1 and x not in FILLER for x in w]  # function words and lone characters tell nothing by themselves
    return {*(x for x, t in zip(w, tells) if t), *(f"{a} {b}" for a, b, s, t in zip(w, w[1:], tells, tells[1:]) if s or t)}


def examples(seed: int = 5) -> list[tuple[str, int, int]]:
    """(text, class, fold): names in sentences, parts of notices, and sentences and plain words that name no licence.  A way of naming, a notice's part and a sentence are of one fold."""
    rng = random.Random(seed)
    families = (*NAMES, UNKNOWN)
    some = lambda most: " ".join(rng.choices(FILLER, k=rng.randint(0, most)))
    rows = []
    for k, family in enumerate(families[:-1]):
        for way_number, way in enumerate(WAYS):
            rows += [(f"{some(4)} {way.format(name)} {some(4)}", k, way_number % 3) for name in NAMES[family]]
        for number, notice in enumerate(TEMPLATES[family]):
            w = notice.split()
            rows += [(f"{some(3)} {notice} {some(3)}", k, (number + j) % 3) for j in range(2)]
            for j in range(0, max(0, len(w) - 12), 6):  # pieces as notices are wrapped
                rows.append((" ".join(w[j : j + 14]), k, j // 6 % 3))
    last = len(families) - 1
    for number, sentence in enumerate(OTHERS):
        w = sentence.split()
        rows += [(f"{some(6)} {sentence} {some(6)}", last, number % 3) for _ in range(3)]
        rows.append((" ".join(w[len(w) // 2 :] + w[: len(w) // 2]), last, number % 3))
    rows += [(" ".join(rng.choices(FILLER, k=rng.randint(3, 60))), last, j % 3) for j in range(200)]
    return rows


def _fit(x: np.ndarray, y: np.ndarray, classes: int, l1: float, rounds: int) -> np.ndarray:
    """Multinomial logistic regression with an L1 penalty on all but the last column, by accelerated proximal gradients."""
    hot = np.eye(classes)[y]
    share = hot.sum(0)
    weight = (1 / share[y] / classes)[:, None]  # every class counts alike
    step = 2.0 / max(1e-12, float((weight * x**2).sum(1).max() * len(y) / 8))
    w = ahead = np.zeros((x.shape[1], classes))
    for t in range(1, rounds + 1):
        z = x @ ahead
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        new = ahead - step * (x.T @ (weight * (p - hot)))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0)
        ahead = new + (t - 1) / (t + 2) * (new - w)
        w = new
    return w


def _matrix(texts: list[str], names: list[str]) -> np.ndarray:
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(texts), len(names) + 1))
    x[:, -1] = 1
    for i, t in enumerate(texts):
        x[i, [place[f] for f in _features(t) if f in place]] = 1
    return x


@lru_cache(maxsize=4)
def _trained(l1: float = 1e-3, rounds: int = 300) -> tuple[LicenceModel, dict]:
    """The model fitted to all examples, and what its folds made of the examples that they had not seen."""
    families = (*NAMES, UNKNOWN)
    rows = examples()
    texts, y, fold = [r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    seen: dict[str, int] = {}
    for t in texts:
        for f in _features(t):
            seen[f] = seen.get(f, 0) + 1
    names = sorted(f for f, n in seen.items() if n >= 3)
    x = _matrix(texts, names)
    z = np.zeros((len(rows), len(families)))
    for k in range(3):
        z[fold == k] = x[fold == k] @ _fit(x[fold != k], y[fold != k], len(families), l1, rounds)

    def loss(t: float) -> float:
        s = z / t
        return float(np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(s)), y]))

    temperature = min((0.1 * 1.1**k for k in range(40)), key=loss)
    p = np.exp((z - z.max(1, keepdims=True)) / temperature)
    p /= p.sum(1, keepdims=True)
    said = np.where(p.max(1) >= 0.5, p.argmax(1), len(families) - 1)
    licence = y < len(families) - 1
    figures = {
        "examples": len(rows),
        "precision": float((said == y)[said < len(families) - 1].mean()),
        "recall": float((said == y)[licence].mean()),
        "unknown kept": float((said == y)[~licence].mean()),
        "calibration error": float(abs(p.max(1).mean() - (p.argmax(1) == y).mean())),
    }
    w = _fit(x, y, len(families), l1, rounds)
    used = [i for i in range(len(names)) if np.abs(w[i]).max() > 0]
    plain = {f for t, k, _ in rows if k == len(families) - 1 for f in _features(t)}
    # of a pair the word that prose has least: texts with the pair have it
    count = {f: sum(f in _features(t) for t in OTHERS) for f in plain}
    anchors = {min((v for v in names[i].split() if len(v) > 1 and v not in FILLER), key=lambda v: (count.get(v, 0), v)) for i in used}
    features = {names[i]: tuple(map(float, w[i])) for i in used}
    return LicenceModel(families, features, tuple(map(float, w[-1])), float(temperature), tuple(sorted(anchors))), figures


def default_model() -> LicenceModel:
    return _trained()[0]


def held_out_figures() -> dict:
    """Precision and recall of families, share of sentences without a licence that stay unknown, and calibration, on unseen folds."""
    return _trained()[1]


def _weights(spark: SparkSession, model: LicenceModel) -> DataFrame:
    """One row per n-gram that the penalty kept: some hundreds, whatever the corpus."""
    return spark.createDataFrame([(f, list(w)) for f, w in sorted(model.features.items())], "gram string, weight array<double>")


#: A line break inside a paragraph: the line does not end a sentence, and the next is not blank.
WRAP = r"""(?<![ \t\r])(?<![.!?:;][)"']?)[ \t\r]*\n(?=[ \t\r]*[^\s])"""


def paragraphs(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """key, mark, place, words of each row's paragraphs that hold an anchor word of the model; a row that repeats gives its paragraphs each time."""
    anchors = F.array(*[F.lit(a) for a in (model or default_model()).anchors])
    rows = docs.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    some = rows.where(F.arrays_overlap(plain_words(F.col("text")), anchors))
    pieces = some.select("key", "mark", F.posexplode(F.split(F.regexp_replace("text", WRAP, " "), "\n")).alias("place", "piece"))
    return pieces.select("key", "mark", "place", plain_words(F.col("piece")).alias("words")).where(F.arrays_overlap("words", anchors))


def _grams(words: Column) -> Column:
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


def _pairs(notice: str) -> list[str]:
    w = notice.split()
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def classify(pieces: DataFrame, model: LicenceModel | None = None, least: float = 0.5, share: float = 0.5, part: float = 0.6, some: int = 6) -> DataFrame:
    """(key, mark, place, family, probability, confirmed) of the rows (key, mark, place, words) that have a feature; rows that repeat are one.

    The family is the likeliest class, ``unknown`` if its probability is under ``least``; of equal
    classes the first in the model's order.  It is confirmed if the paragraph has one of the family's
    names, if at least ``part`` of the pairs of neighboring words of one of its templates stand in the
    paragraph, or if at least ``share`` of the paragraph's pairs, ``some`` or more, stand in one of
    its templates.
    """
    model = model or default_model()
    spark = pieces.sparkSession
    k = len(model.families)
    numbered = materialize(pieces.withColumn("piece", F.monotonically_increasing_id()), "paragraphs")  # written down, so a number stays with its paragraph
    of = ["piece", "key", "mark", "place"]
    grams = numbered.select(*of, F.explode(_grams(F.col("words"))).alias("g"))
    scored = grams.join(F.broadcast(_weights(spark, model)), F.col("g") == F.col("gram"))
    sums = scored.groupBy(*of).agg(*[F.sum(F.get("weight", F.lit(i))).alias(f"z{i}") for i in range(k)])
    z = F.array(*[(F.col(f"z{i}") + F.lit(model.bias[i])) / model.temperature for i in range(k)])
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("top")))
    best = F.element_at(F.array(*[F.lit(f) for f in model.families]), F.array_position("z", F.col("top")).cast("int"))
    named = sums.select(*of, z.alias("z")).withColumn("top", top).select(*of, best.alias("best"), (1 / total).alias("probability"))
    judged = materialize(named.withColumn("family", F.when(F.col("probability") >= least, F.col("best")).otherwise(UNKNOWN)).drop("best"), "judged")
    # the few paragraphs that are likelier a licence than not meet their words again
    likely = judged.where(F.col("family") != UNKNOWN).select("piece", "family")
    likely = F.broadcast(likely) if likely.count() <= BROADCAST_ROWS else likely
    told = numbered.select("piece", "words").join(likely, "piece")

    def alike(family: str) -> Column:
        spelled = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
        return F.exists(F.array(*[spelled.contains(f" {n} ") for n in NAMES[family]], _near(TEMPLATES[family], part, share, some)), lambda x: x)

    confirmed = F.lit(False)
    for family in TEMPLATES:
        confirmed = F.when(F.col("family") == family, alike(family)).otherwise(confirmed)
    sure = told.select("piece", confirmed.alias("confirmed"))
    known = judged.join(sure, "piece", "left").withColumn("confirmed", F.coalesce("confirmed", F.lit(False)))
    return known.groupBy("key", "mark", "place").agg(*[F.first(c).alias(c) for c in ("family", "probability", "confirmed")])


def _near(notices: list[str], part: float, share: float, some: int) -> Column:
    """Whether enough of some notice's pairs of neighboring words stand in the paragraph, or enough of the paragraph's in a notice."""

    def any_of(pairs: Column) -> Column:
        both = [(F.size(F.array_intersect(pairs, F.array(*[F.lit(x) for x in _pairs(n)]))), len(_pairs(n))) for n in notices]
        return F.exists(F.array(*[(m >= part * k) | (m >= some) & (m >= share * F.size(pairs)) for m, k in both]), lambda x: x)

    return let(F.filter(_grams(F.col("words")), lambda g: g.contains(" ")), any_of)


def scan(docs: DataFrame, model: LicenceModel | None = None) -> DataFrame:
    """doc_id, families (sorted, comma-joined), n_licence_paragraphs, n_unconfirmed, probability for every row of ``docs``.

    ``families`` has the confirmed families, one a paragraph; paragraphs with a feature that are of
    the unknown class or not confirmed count in ``n_unconfirmed``; ``probability`` is the highest of a
    confirmed paragraph, null if there is none.  Null and empty texts have no paragraphs; texts of any
    length are read whole, in time that grows with their length; repeated rows each get their own
    equal result; an empty table gives no rows; other columns are ignored.
    """
    judged = classify(paragraphs(docs, model), model)
    found = judged.groupBy(F.col("key").alias("fkey"), F.col("mark").alias("fmark")).agg(
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.count_if("confirmed").alias("n"),
        F.count_if(~F.col("confirmed")).alias("u"),
        F.max(F.when(F.col("confirmed"), F.round("probability", 6))).alias("probability"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"))
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("fkey")) & (F.col("mark") == F.col("fmark")), "left")
    zero = F.lit(0).cast("long")
    return joined.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n", zero).alias("n_licence_paragraphs"), F.coalesce("u", zero).alias("n_unconfirmed"), "probability")
