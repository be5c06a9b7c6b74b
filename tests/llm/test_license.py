import random

import numpy as np

from factloom.llm import license as lic

from . import cases


def words(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return lic._hashes(raw, np.array([0, len(raw)]))[0]


def test_whole_and_changed_templates_are_found(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for i, (name, text) in enumerate(lic.TEMPLATES.items()):
        w = text.split()
        if len(w) > 20:
            w[5], w[14] = "changed", "other"
            w.insert(10, "inserted")
        rows.append((i, f"{cases.sentence(rng, 50)} {' '.join(w)}\n{cases.sentence(rng, 30)}"))
        want[i] = name
    rows += [(100 + i, cases.sentence(rng, 200)) for i in range(20)] + [(200, None), (201, ""), (202, "licensed under the"), (203, "x " * 30_000)]
    got = lic.license_scan(cases.docs(spark, rows, extra=True)).collect()
    assert {r.doc_id for r in got} == set(want)
    for i, name in want.items():
        best = max((r for r in got if r.doc_id == i), key=lambda r: r.matched)
        assert best.template == name and best.coverage > 0.85 and abs(best.start - 50) <= 1
    assert lic.license_scan(cases.docs(spark, [])).collect() == []


def test_band_equals_full_alignment():
    rng = random.Random(1)
    for _ in range(30):
        t = [rng.randrange(30) for _ in range(25)]
        d = [rng.randrange(30, 60) for _ in range(10)] + [x for x in t if rng.random() > 0.1] + [rng.randrange(30, 60) for _ in range(10)]
        t, d = np.array(t), d
        assert lic.align(t, d, 8, 12)[0] == lic.align(t, d, 0, 100)[0]


def test_index_hits_every_common_run():
    index = lic.Index(lic.TEMPLATES)
    for n, text in enumerate(lic.TEMPLATES.values()):
        w = words("zz yy " + text + " xx")
        pos, tem, at = index.hits(lic.tk.window_hashes(w, lic.GRAM))
        assert (n in tem) and (pos[tem == n] - at[tem == n] == 2).any()
