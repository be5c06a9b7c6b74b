import corpus_pipeline as cp

from . import cases
from .test_minhash import brute as near
from .test_packing import ids_of
from .test_toxicity import corpus

COLS = cp.COLUMNS


def test_stages(spark, tmp_path):
    rows, labels = corpus(300)
    rows = rows + [(1000 + i, t) for i, t in cases.texts()]
    cases.docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "mixing", "packing"]
    kept = {}
    for name, stage in cp.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = before, docs
        if name != "packing":
            assert docs.columns == COLS
    bad = {"Grub,", "vermin", "LOUT", "oaf.", "cad"}
    toxic = {i for i, t in rows if bad & set((t or "").split())}
    left = {r.doc_id for r in kept["toxicity"][1].collect()}
    assert len(toxic & left) <= 0.1 * len(toxic) and len({i for i, _ in rows} - toxic - left) <= 0.01 * len(rows)
    before, after = kept["near_dedup"]
    want = {i for i, _, _, k in near([(r.doc_id, r.text) for r in before.collect()], 80) if k}
    assert {r.doc_id for r in after.collect()} == want
    before, after = kept["substring_dedup"]
    old, new = {r.doc_id: r for r in before.collect()}, {r.doc_id: r for r in after.collect()}
    first = {}
    for i in sorted(old):
        w = cases.words(old[i].text)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    assert old.keys() == new.keys()
    for i, r in old.items():
        w = cases.words(r.text)
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        assert new[i].text == (r.text if all(keep) else b" ".join(x for x, y in zip(w, keep) if y).decode())
        assert (new[i].lang, new[i].source) == (r.lang, r.source)
    before, after = kept["mixing"]
    source = {r.doc_id: r for r in before.collect()}
    times = {}
    for r in after.collect():
        assert r == source[r.doc_id]
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) <= 3
    before, after = kept["packing"]
    lengths = {i: len(ids_of(source[i].text)) for i in times}
    got = {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == {i: lengths[i] * n for i, n in times.items()}


def test_odd_rows_and_extra_columns(spark, tmp_path):
    rows = [(None, "a b c"), (None, None), (5, "one two three four five six"), (5, "one two three four five six"), (7, ""), (8, " \t"), (9, "x " * 20_000), (10, None)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, df in (("odd", cases.docs(spark, rows, extra=True)), ("none", cases.docs(spark, []))):
        left = df
        for stage, fn in cp.STAGES:
            out = fn(spark, left, str(tmp_path))
            out.write.parquet(f"{tmp_path}/{name}-{stage}")
            left = spark.read.parquet(f"{tmp_path}/{name}-{stage}")
            if stage != "packing":
                assert left.columns == COLS
            if stage in ("toxicity", "near_dedup", "substring_dedup"):
                assert left.count() == df.count()
        assert (left.count() == 0) == (name == "none")
