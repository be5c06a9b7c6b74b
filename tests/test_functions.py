import math

import pytest
from pyspark.sql import functions as F

from factloom.functions import scores, text
from factloom.operators import extract, stats
from factloom.sources import store


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict()


def test_text(spark):
    got = one(
        spark,
        a=text.normalize_name(F.lit("  Ann-Marie  O'Neil_2 ")),
        b=text.canonical_name(F.lit("the  NASA iPhone plan")),
        c=text.alpha_number(F.lit("T-007")),
        d=text.confidence_parse(F.lit("85 %")),
        e=text.status_canon(F.lit("Left"), F.lit("Person")),
        f=text.predicate_canon(F.lit("has-status")),
        g=text.normalize_name(F.lit(None).cast("string")),
        h=text.source_scheme(F.lit("Analyst :7")),
        i=F.array_join(text.mentions(F.lit('Who owns "Project Orion"? ask Bob Ray about T-12, bob ray')), "|"),
    )
    assert got["a"] == "ann marie o neil_2" and got["b"] == "The NASA iPhone Plan" and got["c"] == "t#7" and got["d"] == 0.85
    assert got["e"] == "inactive" and got["f"] == "HAS_STATUS" and got["g"] == "" and got["h"] == "analyst"
    assert got["i"] == "Project Orion|T-12|Bob Ray"


def test_metadata_filter(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "i long, s string")
    ids = lambda w: [r.i for r in df.where(store.metadata_filter(w)).orderBy("i").collect()]
    assert ids({"s": "a"}) == [1] and ids({"s": {"$ne": "a"}}) == [2, 3] and ids({"s": {"$nin": ["a"]}}) == [2, 3]
    assert ids({"$or": [{"i": 2}, {"s": "b"}]}) == [2, 3] and ids({"i": {"$odd": 1}}) == [1, 2, 3] and ids({"s": None}) == [2]


def test_quantiles():
    assert stats.t_quantile(0.975, 4) == pytest.approx(2.776445, abs=1e-5)
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert stats.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert stats.beta_inc(2, 3, 0.4) == pytest.approx(0.5248, abs=1e-6)


def test_upsert_and_status(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, seq long, status string")
    new = spark.createDataFrame([("a", 3, "z")], base.schema)
    assert {tuple(r) for r in store.upsert(base, new, "id", "seq").collect()} == {("a", 3, "z"), ("b", 2, "y")}
    ch = spark.createDataFrame([("b", "gone")], "id string, new_status string")
    assert {tuple(r) for r in store.set_status(base, "id", ch).collect()} == {("a", 1, "x"), ("b", 2, "gone")}


def test_rerank_penalty(spark):
    row = {"semantic_similarity": 0.9, "graph_relevance": 1.0, "confidence": 0.8, "provenance_quality": 0.5, "recency": 0.2}
    base = [F.lit(v).alias(k) for k, v in row.items()]
    got = [spark.range(1).select(*base, F.lit(p).alias("contradiction_penalty")).select(scores.rerank_score()).first()[0] for p in (0.0, 0.5)]
    assert got[0] - got[1] == pytest.approx(0.15)


def test_extract(spark):
    df = spark.createDataFrame([("s1", "Alice owns Project Orion. Actually, Task 7 is assigned to Bob Ray! Bob finished Task 7."), ("s2", None)], "source_ref string, text string")
    got = {(r.predicate, r.subject, r.object, r.confidence_pct, r.write_intent) for r in extract.extract(df).collect()}
    assert ("OWNS", "Alice", "Project Orion", 85, "new_fact") in got or ("OWNS", "Alice", "Orion", 85, "new_fact") in got
    assert ("ASSIGNED_TO", "Task 7", "Bob Ray", 97, "correction") in got
    assert ("HAS_STATUS", "Task 7", "status:done", 85, "new_fact") in got


def test_bootstrap_covers_the_mean(spark):
    df = spark.range(500).selectExpr("id", "'g' AS g", "id % 10 AS v")
    r = stats.bootstrap_ci(df, "g", "v").first()
    assert r.lo < 4.5 < r.hi and r.hi - r.lo < 4 * 2.9 / math.sqrt(500) * 1.5


def test_mentions_are_found_once_and_not_for_each_other(spark):
    df = spark.createDataFrame([("Did 'T1' tell t1 or T2 about T1 and Ann Lee?",), (None,), ("",)], "t string").select(text.mentions("t").alias("m"))
    assert [r.m for r in df.collect()] == [["T1", "T2", "Ann Lee"], None, []]
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract_all") == 3
