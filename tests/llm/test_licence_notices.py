"""Whole notices, and notices inside longer lines, are confirmed."""

import math

import pytest

from tesserspark.llm import licenses

PROSE = "the river ran high that spring and nobody in the village could remember such a year of rain and mud"
NOTICES = [
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc-by", "All articles that appear on these pages, with the pictures and tables that belong to them, are available under CC BY 4.0."),
    ("gpl", f"{PROSE}. This work is licensed under the GNU General Public License, version 3. {PROSE}."),
    ("mit", f"{PROSE}. Released under the MIT License. {PROSE}."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights"),
    ("mit,mpl", "Released under the MIT\nLicense.\nThis Source Code Form is subject to the terms of the\n Mozilla Public License, v. 2.0.\n\nAnd a\nline"),
    ("apache", f"{PROSE}\nThe data are licensed under the\nApache License, Version 2.0"),
    ("", "The license of the driver and the permission of the owner were lost, copyright law says nothing of it."),
    ("", f"{PROSE}, and the library under the hill had no license to lend the software that students at MIT wrote."),
]


def test_whole_and_embedded_notices(spark):
    rows = [(k, text) for k, (_, text) in enumerate(NOTICES)]
    rows += [(100 + k, t) for k, ts in enumerate(licenses.TEMPLATES.values()) for t in ts]
    got = {}
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r.families)
    assert [got[k][0] for k in range(len(NOTICES))] == [f for f, _ in NOTICES]
    assert {f: got[100 + k] for k, f in enumerate(licenses.TEMPLATES)} == {f: [f] * len(t) for f, t in licenses.TEMPLATES.items()}


def brute(text, model):
    """The operator's result in plain Python: paragraphs, class, probability and comparison with templates."""
    import re

    lines, paragraphs = (text or "").split("\n"), []
    for k, line in enumerate(lines):
        joined = k > 0 and line.strip() and lines[k - 1].strip() and not re.search(r"[.!?:;][)\"']?$", lines[k - 1].rstrip(" \t\r"))
        if joined:
            paragraphs[-1] += " " + line
        else:
            paragraphs.append(line)
    families, best, n, odd = set(), None, 0, 0
    for p in paragraphs:
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", p.lower()) if x]
        grams = [f for f in licenses._features(p) if f in model.features]
        if not grams:
            continue
        z = [(b + sum(model.features[f][k] for f in grams)) / model.temperature for k, b in enumerate(model.bias)]
        top = max(z)
        chance = 1 / sum(math.exp(v - top) for v in z)
        family = model.families[z.index(top)]
        pairs = {f"{a} {b}" for a, b in zip(w, w[1:])}
        near = any(
            len(pairs & set(q)) >= 0.6 * len(q) or len(pairs & set(q)) >= max(6, 0.5 * len(pairs)) for q in map(licenses._pairs, licenses.TEMPLATES.get(family, []))
        ) or any(f" {x} " in f" {' '.join(w)} " for x in licenses.NAMES.get(family, []))
        if family != "unknown" and chance >= 0.5 and near:
            families.add(family)
            n += 1
            best = max(best or 0, round(chance, 6))
        else:
            odd += 1
    return ",".join(sorted(families)), n, odd, best


def test_scan_equals_plain_python(spark):
    rows = [(k, t) for k, (_, t) in enumerate(NOTICES)] + [(500 + k, t) for k, (t, *_) in enumerate(licenses.examples()[::9])]
    rows += [(900, None), (901, ""), (902, "\n\n \n"), (903, "word of the\n" * 5000 + "Released under the ISC License."), (None, "All rights reserved."), (None, "All rights reserved.")]
    rows += [(904, "license " * 30_000), (905, "All rights reserved.\n" * 300)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, words string, piece int")
    got = sorted(((r.doc_id, r.families, r.n_licence_paragraphs, r.n_unconfirmed, r.probability) for r in licenses.scan(df).collect()), key=repr)
    want = sorted(((i, *brute(t, licenses.default_model())) for i, t in rows), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert all(abs((g[4] or 0) - (w[4] or 0)) <= 2e-6 for g, w in zip(got, want))


def test_anchors_lose_no_feature():
    m = licenses.default_model()
    assert all(set(f.split()) & set(m.anchors) for f in m.features)
    z = list(m.bias)
    assert m.families[z.index(max(z))] == licenses.UNKNOWN  # a text without a feature is unknown


def test_held_out_figures():
    f = licenses.held_out_figures()
    assert f["precision"] > 0.95 and f["recall"] > 0.93 and f["unknown kept"] > 0.95 and f["calibration error"] < 0.02


@pytest.mark.parametrize("text", ["Eclipse Public License 2.0", "Licensed under the Artistic License 2.0.", "zlib license", "Human rights were reserved, as the general public was told."])
def test_families_without_a_template_are_not_confirmed(text):
    assert brute(text, licenses.default_model())[0] == ""
