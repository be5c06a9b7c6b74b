import hashlib
import random

from pyspark.sql import functions as F

from factloom.llm import lines as L

from . import cases

WS = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, chars=20, documents=3):
    key = lambda x: x.strip(WS).translate(LOW)
    held = {}
    for i, t in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < chars or len(held[key(x)]) < documents or i == max(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def got(spark, rows, **how):
    return sorted((tuple(r) for r in L.line_dedup(cases.docs(spark, rows, extra=True), **how).collect()), key=str)


def corpus(n=120, seed=4):
    rng = random.Random(seed)
    pool = [cases.sentence(rng, rng.randrange(1, 9)) for _ in range(60)] + ["Straße ÄÖÜ Überall und nirgends", "日本語" * 7, "x" * 19, "X" * 20]
    common = "All rights reserved, every page of it."
    rows = []
    for i in range(n):
        lines = [rng.choice(pool) if rng.random() < 0.6 else cases.sentence(rng, 6, 10_000) for _ in range(rng.randrange(0, 12))]
        lines = [rng.choice(["{}", " {}\t", "{}\r", "\x0b{}"]).format(x.upper() if rng.random() < 0.2 and x.isascii() else x) for x in lines]
        if rng.random() < 0.7:
            lines[rng.randrange(len(lines) + 1) :] = [common] * rng.randrange(1, 4)
        rows.append((i, "\n".join(lines)))
    return rows


def test_matches_brute_force(spark):
    rows = corpus() + [(1000 + i, t) for i, t in cases.texts()] + [(2000, "\n\n"), (2001, "\n".join(["same line again and again"] * 50)), (-5, None), (2002, "a\n" * 3000 + corpus()[3][1])]
    assert got(spark, rows) == brute(rows)


def test_rows_without_id_or_with_one_id(spark):
    rows = corpus(40)
    rows += [(None, rows[3][1]), (None, rows[3][1]), (None, None), (7, rows[3][1]), (7, rows[3][1] + "\nmore"), (7, rows[7][1]), (39, rows[5][1])]
    assert got(spark, rows) == brute(rows)


def test_any_number_of_batches_and_levels(spark):
    rows = corpus(60, 9)
    want = brute(rows)
    for batches, fanout in ((1, 2), (7, 2), (5, 9)):
        assert got(spark, rows, batches=batches, fanout=fanout) == want
    assert got(spark, rows, chars=5, documents=2) == brute(rows, 5, 2)


def test_empty(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, "")]) == [(1, 1, 0, ""), (2, 1, 0, "")]


def test_settled_keys_are_not_added_again(spark):
    """A batch adds what no run has settled; levels fill and are compacted."""
    index = L.LineRuns(spark, documents=3, fanout=2)
    batch = lambda ids, h: spark.range(len(ids)).select(F.element_at(F.array(*map(F.lit, ids)), F.col("id").cast("int") + 1).cast("long").alias("doc_id"), F.lit(h).cast("long").alias("h"), F.lit(h).cast("long").alias("g"))
    index.add(batch([90, 91, 92], 1), 1e9)
    index.add(batch([80, 81], 1).unionByName(batch([80], 2)), 1e9)
    assert [len(x) for x in index.levels] == [0, 1]
    assert sorted((r.h, r.n_docs, r.top) for r in index.whole().collect()) == [(1, 3, 92), (2, 1, 80)]
    index.add(batch([70, 71], 2).unionByName(batch([95], 1)), 1e9)
    assert [len(x) for x in index.levels] == [1, 1]
    assert sorted((r.h, r.n_docs, r.top) for r in index.whole().collect()) == [(1, 4, 95), (2, 3, 80)]


def test_heavy_keys_reach_the_lines_by_broadcast(spark):
    rows = corpus(80, 2)
    index = L.LineRuns(spark)
    lines = L.hashed_lines(cases.docs(spark, rows)).select("doc_id", "h", "g")
    index.add(lines, 20)
    n = lines.groupBy("h", "g").count()
    assert sorted(n.where("count > 20").select("h").collect()) == sorted(index.whole().where("heavy").select("h").collect())


def test_no_python_on_the_main_path(spark):
    plan = L.line_dedup(cases.docs(spark, corpus(20)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapPartitions" not in plan


def test_query_digests(spark, tmp_path):
    from factloom.llm.queries import op12_line_dedup

    rows = corpus(30)
    cases.docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = {(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in brute(rows)}
    assert {tuple(r) for r in op12_line_dedup(spark, str(tmp_path)).collect()} == want
