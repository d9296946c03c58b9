"""License scan: which license a notice is, against alignment of every place, odd and very long texts."""

import random
import time

import pytest

from quillstack.llm import licenses as m

READY = [m.Template(n, m.words_of(t)) for n, t in m.TEMPLATES]
SOFT = ["This work is licensed under the GNU ", " General Public License, version "]


def names(text):
    return [f["license"] for f in m.scan(text, READY)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("All rights\nreserved.", ["all-rights-reserved"]), ("ALL RIGHTS  RESERVED", ["all-rights-reserved"]), ("All the rights were reserved", ["all-rights-reserved"]),
        ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]), ("Licensed under CC BY-NC-SA 4.0", ["CC-BY-NC-SA-4.0"]), ("Licensed under CC BY 3.0", ["CC-BY-3.0"]),
        ("Released under the BSD License.", ["BSD"]), ("Released under the BSD 3-Clause License.", []), ("Released under the MIT No Attribution License.", []),
        ("Licensed under the Mozilla Public License, Version 2.0.", ["MPL-2.0"]), ("Licensed under the Eclipse Public License, Version 2.0.", ["EPL-2.0"]),
        ("Licensed under the Apache License, Version 1.1.", []), ("Licensed under the Apache License v2.0", ["Apache-2.0"]),
        ("Attribution-NonCommercial 4.0 International", ["CC-BY-NC-4.0"]), ("Attribution 4.0 International", ["CC-BY-4.0"]),
        ("This work is licensed under a Creative Commons Attribution Share-Alike 4.0 International License.", []),
        ("Lesser".join(SOFT) + "3.", ["LGPL-3.0"]), ("Affero".join(SOFT) + "3.0", ["AGPL-3.0"]), ("Library".join(SOFT) + "2", []),
        ((SOFT[0] + SOFT[1]).replace("  ", " ") + "2.", ["GPL-2.0"]), ((SOFT[0] + SOFT[1]).replace("  ", " ") + "3.", ["GPL-3.0"]), ((SOFT[0] + SOFT[1]).replace("  ", " ") + "1.", []),
    ],
)
def test_which_license(text, want):
    assert names(text) == want
    assert names(f"before it {text} after it") == want


def test_a_word_between_each_two():
    for name, text in m.TEMPLATES:
        words = text.split()
        if len(words) > 8:
            assert name in names(" zz ".join(words)), text


def changed(words, rng, share):
    out = []
    for w in words:
        kind = rng.random()
        out += [] if kind < share / 3 else ["changed"] if kind < share * 2 / 3 else [w, f"more{rng.randrange(9)}"] if kind < share else [w]
    return out


def test_like_alignment_of_every_place():
    """What patience alignment finds at any place, in a stretch as long as the template or with room, the scan finds there."""
    rng = random.Random(5)
    found = 0
    for n in range(150):
        t = rng.choice([t for t in READY if len(t.words) < 70])
        words = [f"w{rng.randrange(99)}" for _ in range(20)] + changed(t.words, rng, rng.choice((0.1, 0.3, 0.5))) + ["the", "of", "license"] + [f"w{rng.randrange(99)}" for _ in range(20)]
        got = m.scan(" ".join(words), READY)
        for start in range(len(words)):
            for length in (len(t.words), len(t.words) * 5 // 4, t.span):
                pairs = [(i, start + j) for i, j in m.patience(t.words, words[start : start + length])]
                if t.fits(words, pairs):
                    found += 1
                    assert any(g["matched"] >= len(pairs) * 0.9 and g["first"] <= pairs[-1][1] and g["last"] >= pairs[0][1] for g in got), (n, t.license, " ".join(words))
    assert found > 500


def test_very_long_texts():
    rng = random.Random(6)
    filler = [rng.choice(("license", "software", "permission", "the", "version", "w1", "w2")) for _ in range(300_000)]
    at = time.time()
    text = " ".join(filler[:150_000] + m.TEMPLATES[1][1].split() + filler[150_000:])
    assert "MIT" in names(text) and time.time() - at < 60
    assert names("w " * 1_000_000) == [] == names("license " * 200_000)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "All rights reserved.", "x", 3), (1, "All rights reserved.", "x", 3)], "doc_id long, text string, licenses string, coverage int")
    assert [[f["license"] for f in r["licenses"]] for r in m.matches(docs).collect()] == [["all-rights-reserved"]] * 2
