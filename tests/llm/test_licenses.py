"""Base phrases, rules and suppression."""

import random
import re
import time

import pytest

from foliant.llm import licenses as L


def test_many_rules_all_compile():
    assert len(L.rules()) > 600 and len(L.NOTICES) > 180
    assert not any(re.match(r"[^(]*\|", p) for _, p in L.NOTICES)  # alternatives are in groups
    assert [r.priority for r in L.rules()] == sorted((r.priority for r in L.rules()), reverse=True)


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, score string")
    return L.scan(df.repartition(2)).orderBy("doc_id").collect()


def test_places(spark):
    texts = ["MIT License, mit-license; mitlicense mit\nlicense", None, "", "the Apache\tLicense", "cc by cc by", "é apache license", "Apache", "x" * 500_000 + " gnu general public license"]
    out = scan(spark, texts)
    assert [r.n_words for r in out] == [7, 0, 0, 3, 4, 3, 1, 5]
    assert [[(b.label, b.start) for b in r.base] for r in out] == [[("mit", 0), ("mit", 2), ("mit", 5)], [], [], [("apache", 1)], [("cc-by", 0), ("cc-by", 2)], [("apache", 1)], [], [("gpl", 1)]]
    assert out[1].score == 0 and 0 < out[0].score <= 1


def test_phrases_do_not_cross_texts(spark):
    assert all(not r.base for r in scan(spark, ["gnu general", "public license", "mit", "license"]))


def test_detections(spark):
    texts = [
        "Licensed under the GNU Lesser General Public License, version 2.1 or later.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "released under CC BY-NC-SA 4.0",
        "Ich gehe mit der version",
        "Released under the MIT License",
    ]
    out = scan(spark, texts)
    assert [{d.label for d in r.detections} for r in out] == [{"lgpl"}, {"bsd"}, {"cc-by-nc-sa"}, set(), {"mit"}]


def test_gates_drop_nothing(spark):
    texts = ["CC BY-SA v4.0", "MPL version2", "GPL v3", "EPL v 2", "AFL license", "Redistributions in any form follow the Mozilla Public License", "redistributing under EUPL", "use of this work MPL"]
    texts += [f"{w} {name.split('|')[0]} {end}" for name in L.LICENSES.values() if not set("([?") & set(name.split("|")[0]) for w, end in (("licensed under", ""), ("per the", "licence"), ("", "v12 or later"), ("SPDX-License-Identifier:", "2.0"))]
    for text in texts:
        assert L.scanner().scan(*_raw(text)) == L.scanner().scan(*_raw(text), gated=False), text
    assert all(r.detections for r in scan(spark, texts))


def test_every_rule_has_gates_that_its_matches_meet():
    assert all(gate for r in L.rules() for gate in r.gates)
    assert all(w.strip("*") for r in L.rules() for gate in r.gates for w in gate)
    # what notices say, with any alternative of a group taken, meets the gates of its rule
    for label, pattern in L.NOTICES:
        plain = pattern
        while "(?:" in plain:
            plain = re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", plain)
        plain = plain.replace(r"\d", "2").replace(r"\w+", "work").replace("[sz]", "s").replace("[cs]", "c").replace(" ?", " ").replace("?", "")
        plain = re.sub(r"\[a-z0-9 \]\{[\d,]+\}", "some one", plain)
        found = L.scanner().scan(*_raw(f"x {plain} x"))[0][2]
        assert any(d.priority >= 6 for d in found), plain
        assert found == L.scanner().scan(*_raw(f"x {plain} x"), gated=False)[0][2]


def test_gates_on_words_in_any_order(spark):
    pool = sorted({w.rstrip("*") for r in L.rules() for gate in r.gates for w in gate} | {"v2", "2", "0", "redistributions", "licence", "the", "of", "or", "later"})
    r = random.Random(3)
    for _ in range(60):
        text = " ".join(r.choice(pool) for _ in range(300)) + " licensed under the " + r.choice(pool) + " license 2 0"
        assert L.scanner().scan(*_raw(text)) == L.scanner().scan(*_raw(text), gated=False)


def test_gates_agree_on_documents():
    import pyarrow.parquet as pq

    from foliant.llm import words

    for _, _, raw, offsets in words.slices(pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].combine_chunks()):
        assert L.scanner().scan(raw, offsets) == L.scanner().scan(raw, offsets, gated=False)


def test_notices_as_people_write_them():
    want = {
        "SPDX-License-Identifier: Python-2.0": "psf", "SPDX-License-Identifier: 0BSD": "bsd", "Licensed under the MIT": "mit", "released under MIT": "mit", "gpl v4": "gpl", "CC BY v4.0": "cc-by",
        "Creative Commons Attribution 4.0 International License": "cc-by", "Redistributions of source code under the BSD license": "bsd", "https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa",
        "dual licensed under the MIT and Apache License 2.0": "mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "mit",
    }
    for text, label in want.items():
        assert label in {d.label for d in L.scanner().scan(*_raw(text))[0][2]}, text
    assert L.scanner().scan(*_raw("Redistributions of source code under the BSD license"))[0][2][0].priority == 4


def test_many_detections_take_time_in_proportion():
    began = time.process_time()
    assert len(L.scanner().scan(*_raw("gpl v4 then other words " * 20_000))[0][2]) == 20_000
    assert time.process_time() - began < 3


def test_bare_identifiers(spark):
    ids = {"MIT": "mit", "Zlib": "zlib", "PHP-3.01": "php", "Vim": "vim", "W3C": "w3c", "PostgreSQL": "postgresql", "PSF-2.0": "psf", "Artistic-2.0": "artistic"}
    out = scan(spark, [f"x SPDX-License-Identifier: {i} y" for i in ids] + list(ids))
    assert [[d.label for d in r.detections] for r in out] == [[x] for x in ids.values()] + [[]] * len(ids)


def test_tables_without_rows_and_repeated_rows(spark):
    assert scan(spark, []) == []
    one, two = scan(spark, ["mit license", "mit license"])
    assert (one.base, one.detections, one.score) == (two.base, two.detections, two.score)


def test_suppression_beside_all_pairs():
    r = random.Random(1)
    for _ in range(200):
        found = [L.Detection(f"l{i}", a := r.randrange(12), a + r.randrange(1, 6), r.randrange(3), 0.5) for i in range(r.randrange(15))]
        ordered, kept = sorted(found, key=lambda d: (-d.priority, d.start, -d.end)), []
        for d in ordered:
            if not any(k.start <= d.start and d.end <= k.end for k in kept):
                kept.append(d)
        assert L.resolve(found) == sorted(kept, key=lambda d: (d.start, d.end, d.label))


def test_suppression():
    d = lambda label, a, z, p: L.Detection(label, a, z, p, 0.5)
    assert L.resolve([d("in", 2, 4, 3), d("out", 1, 5, 3), d("over", 4, 7, 1), d("high", 2, 3, 9)]) == [d("out", 1, 5, 3), d("high", 2, 3, 9), d("over", 4, 7, 1)]


def test_words_like_the_rule():
    text = "Aé-ß 12_b\x7fc~Z q"
    want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans("AZ", "az")))
    assert L.scanner().scan(*_raw(text))[0][0] == len(want)


def _raw(text):
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Mozilla Public License", "mpl"), ("Eclipse Public License", "epl"), ("Boost Software License", "boost"), ("GNU Lesser General Public License", "lgpl"), ("PostgreSQL License", "postgresql"),
        ("zlib License", "zlib"), ("Artistic License", "artistic"), ("Creative Commons Attribution", "cc-by"), ("CC0", "cc0"), ("released into the public domain", "public-domain"), ("The Unlicense", "unlicense"),
        ("GPLv2", "gpl"), ("under the GPLv3", "gpl"), ("BSD-3-Clause", "bsd"), ("CC BY-SA", "cc-by-sa"), ("LGPLv2.1 or later", "lgpl"), ("see Apachev2", "apache"), ("per the EPLv2", "epl"),
    ],
)
def test_plain_names_are_detected(text, label):
    for around in (text, f"this is {text} here", f"({text})"):
        assert label in {d.label for d in L.scanner().scan(*_raw(around))[0][2]}, around


def test_every_name_stands_for_its_license():
    for label, names in L.LICENSES.items():
        for name in L._alternatives(names):
            if name not in L.AMBIGUOUS and "?" not in name and "[" not in name:
                assert label in {d.label for d in L.scanner().scan(*_raw(f"some words {name} and more"))[0][2]}, name
    assert not L.scanner().scan(*_raw("an apache helicopter, the afl season and an isc meeting"))[0][2]
