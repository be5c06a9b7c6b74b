import random

import pytest

from factloom.llm import license as lic

from . import cases
from .test_license import words


def brute(template, w, least, lo=0, hi=None):
    """The best place by the alignment of the whole text, then what is left and right of it."""
    hi = len(w) if hi is None else hi
    matched, a, b = lic.align(template, w[lo:hi].tolist(), 0, len(w) + len(template))
    if matched < least * len(template):
        return []
    return brute(template, w, least, lo, lo + a) + [(matched, lo + a, lo + b)] + brute(template, w, least, lo + b, hi)


@pytest.mark.parametrize("name", ["mit-line", "apache-line", "cc-by-nc-line", "bsd-grant"])
def test_adjacent_repeats_equal_brute_force(name):
    rng = random.Random(7)
    index = lic.Index({name: lic.TEMPLATES[name]})
    for _ in range(25):
        text = []
        for _ in range(rng.randrange(1, 7)):
            notice = lic.TEMPLATES[name].split()
            if len(notice) > 12 and rng.random() < 0.5:
                notice[rng.randrange(4, 12)] = "changed"
            text += [f"q{rng.randrange(99)}" for _ in range(rng.randrange(0, 4))] + notice
        w = words(" ".join(text))
        got = [(n, a, b) for _, n, _, a, b in lic.scan_words(w, index, 0.6)]
        assert got == brute(index.words[0], w, 0.6)


def test_each_of_two_and_of_a_thousand_notices(spark):
    line = lic.TEMPLATES["mit-line"]
    got = lic.license_scan(cases.docs(spark, [(1, f"{line} {line}"), (2, " ".join([line] * 1000))])).where("template = 'mit-line'").collect()
    assert sorted((r.start, r.end) for r in got if r.doc_id == 1) == [(0, 5), (5, 10)]
    assert sorted((r.start, r.end) for r in got if r.doc_id == 2) == [(5 * i, 5 * i + 5) for i in range(1000)]


def test_gaps_that_chain_stay_one_place():
    w = lic.TEMPLATES["mit-grant"].split()
    text = " ".join(x + " a b c d e f" * (i in (15, 30, 45)) for i, x in enumerate(w))
    got = lic.scan_words(words(text), lic.Index({"t": lic.TEMPLATES["mit-grant"]}), 0.6)
    assert [(n, a) for _, n, _, a, _ in got] == [(len(words(lic.TEMPLATES["mit-grant"])), 0)]
