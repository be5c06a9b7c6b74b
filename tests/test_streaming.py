import datetime

import pytest

from factloom.operators import policies
from factloom.sources.events import assertion_log
from factloom.streaming.governed import evidence_stream, gate_stream

from .duck import DATA


def test_stream_equals_batch(spark, tmp_path):
    log = policies.single_valued_log(assertion_log(spark, DATA)).select("subject_id", "predicate", "seq", "object_id", "pct")
    cut = log.selectExpr("percentile(seq, 0.5) AS m").first().m
    for i, part in enumerate((log.where(log.seq <= cut), log.where(log.seq > cut))):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = (
            evidence_stream(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"))
            .writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
        )
        q.awaitTermination(120)
    got = {(r.seq, r.decision) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r.seq, r.decision) for r in policies.evidence_weighted(log).collect()}


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    had = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, had)


def advance(spark, make, tmp_path):
    """One run of the stream over what has arrived, from its checkpoint: each run is a restart."""
    q = make().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)


def test_gate_stream_equals_batch_over_restarts(rocks, tmp_path):
    spark = rocks
    cols = ["subject_id", "predicate", "seq", "object_id", "pct", "valid_from", "valid_to", "write_intent", "source_ref"]
    log = policies.single_valued_log(assertion_log(spark, DATA)).select(*cols)
    a, b = log.selectExpr("percentile(seq, array(0.33, 0.66)) AS m").first().m
    make = lambda: gate_stream(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"))
    for part in (log.where(log.seq <= a), log.where((log.seq > a) & (log.seq <= b)), log.where(log.seq > b)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        advance(spark, make, tmp_path)
    got = {(r.seq, r.decision, r.kind) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r.seq, r.decision, r.kind) for r in policies.contradiction_gate(log).collect()}
    assert {k for _, _, k in got} >= {"none", "soft", "temporal"} and {d for _, d, _ in got} >= {"accept", "quarantine"}


def test_late_correction_and_expiry(rocks, tmp_path):
    spark = rocks
    day = lambda n: datetime.datetime(2024, 1, n)
    schema = "subject_id string, predicate string, seq long, object_id string, pct long, valid_from timestamp, valid_to timestamp, write_intent string, source_ref string, ts timestamp"
    batches = [
        [("K", "HAS_VALUE", 10, "a", 90, day(1), day(3), "new_fact", "t", day(1))],
        [("K", "HAS_VALUE", 5, "b", 99, day(1), day(2), "correction", "t", day(2)), ("L", "HAS_VALUE", 11, "z", 90, None, None, "new_fact", "t", day(20))],
        [("K", "HAS_VALUE", 20, "c", 95, None, None, "new_fact", "t", day(21))],
    ]
    make = lambda: gate_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withWatermark("ts", "1 hour"), margin=5, expire=True)
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        advance(spark, make, tmp_path)
    got = {r.seq: (r.decision, r.kind, r.late) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # The correction is late and supersedes; its window ends before the last write, which meets nothing.
    assert got == {10: ("accept", "none", False), 5: ("supersede", "temporal", True), 11: ("accept", "none", False), 20: ("accept", "none", False)}
