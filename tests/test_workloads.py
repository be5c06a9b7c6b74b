from collections import Counter

import pytest
from pyspark.sql import functions as F

from factloom.operators.analyst import trials
from factloom.sources import generators as g


def test_generators_are_balanced_and_repeat(spark):
    ex = g.benchmark_examples(spark, per_category=4)
    assert {r["count"] for r in ex.groupBy("category").count().collect()} == {4}
    assert sorted(map(str, ex.collect())) == sorted(map(str, g.benchmark_examples(spark, per_category=4).repartition(3).collect()))
    st = g.stress_examples(spark, each=2).withColumn("n", F.size("writes")).select("intensity", "n").distinct().collect()
    assert {tuple(r) for r in st} == {("low", 2), ("medium", 4), ("high", 6)}
    ev = g.evasion_cases(spark, each=3)
    assert ev.count() == 21 and ev.where("surface = canonical_task").count() == 0
    c = g.escalation_corpus(spark)
    assert {tuple(r) for r in c.groupBy("write_class").count().collect()} == {("routine", 500), ("correction", 500), ("conflict", 500)}
    assert {r.partition: r["count"] for r in c.groupBy("partition").count().collect()} == {"train": 750, "dev": 300, "canary": 150, "test": 300}


def test_analyst_defers_more_on_long_streaks(spark):
    items = spark.range(400).selectExpr("concat('p', id % 2) AS participant", "id AS trial", "'full' AS depth", "0.0 AS skill", "1.0 AS speed", "1.0 AS bias", "1 AS k", "0.5 AS consequence", "true AS evidence", "'accept' AS recommended", "if(id % 2 = 0 OR id % 4 = 1, 'accept', 'review') AS gold")
    got = trials(items.withColumn("bias", F.col("bias").cast("double")).withColumn("speed", F.col("speed").cast("double")).withColumn("skill", F.col("skill").cast("double")).withColumn("consequence", F.col("consequence").cast("double"))).collect()
    share = {p: sum(r.deferred for r in got if r.participant == p) / 200 for p in ("p0", "p1")}
    assert len(got) == 400 and share["p0"] > share["p1"]
    assert all(r.seconds > 0 for r in got)


@pytest.mark.parametrize(("scenarios", "per_class"), [(50, 10), (333, 7)])
def test_escalation_corpus(spark, scenarios, per_class):
    rows = g.escalation_corpus(spark, 5, scenarios, per_class).collect()
    by = {}
    for r in rows:
        by.setdefault(r.scenario_id, []).append(r)
    assert len(by) == scenarios and len({r.write_id for r in rows}) == len(rows) == scenarios * 3 * per_class
    orders = set()
    for v in by.values():
        v.sort(key=lambda r: r["index"])
        assert [r["index"] for r in v] == list(range(3 * per_class))
        assert Counter(r.write_class for r in v) == dict.fromkeys(g.CLASSES, per_class)
        chains = {r.chain_id for r in v if r.chain_id}
        assert len(chains) == 2
        for c in chains:
            at = [r["index"] for r in v if r.chain_id == c]
            assert at == list(range(at[0], at[0] + 3)) and [r.chain_position for r in v if r.chain_id == c] == [0, 1, 2]
            assert tuple((r.write_class, r.gold) for r in v if r.chain_id == c) == g.CHAINS[c.split("-")[-1]]
        orders.add(tuple(r.write_class for r in v))
    assert len(orders) > scenarios / 2
    assert {c.split("-")[-1] for r in rows if (c := r.chain_id)} == set(g.CHAINS)
    poisoned = sorted({int(r.scenario_id[2:]) for r in rows if r.poisoned})
    assert poisoned == list(range(4, scenarios, 5))
    parts = {p: sorted({int(r.scenario_id[2:]) for r in rows if r.partition == p}) for p in g.PARTS}
    assert all(x == list(range(x[0], x[-1] + 1)) for x in parts.values()) and sum(map(len, parts.values())) == scenarios
    if scenarios == 50:
        assert {p: len(x) for p, x in parts.items()} == g.PARTS
    again = g.escalation_corpus(spark, 5, scenarios, per_class).collect()
    assert set(map(tuple, again)) == set(map(tuple, rows)) != set(map(tuple, g.escalation_corpus(spark, 6, scenarios, per_class).collect()))
