"""Windows over a stream of decisions, one file a micro-batch."""

import os
from datetime import datetime

import pytest

from factloom.streaming.governed import session_outcomes, windowed_outcomes

# A batch leaves out what is later than the watermark of the batch before it. The row of 14:10 sets it to 12:10 for
# the batch of 14:20, so the row of 10:50 comes too late after that one; the last rows move it on to 18:00.
BATCHES = [("10:05", "10:30", "10:55"), ("14:10",), ("14:20",), ("10:50",), ("20:00",), ("20:30",)]


def stamp(t):
    return datetime.fromisoformat(f"2024-01-01T{t}:00")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("decisions")
    for k, times in enumerate(BATCHES):
        file = out / f"{k}.json"
        file.write_text("".join(f'{{"at": "{stamp(t).isoformat()}", "decision": "accept"}}\n' for t in times))
        os.utime(file, (1_700_000_000 + 10 * k,) * 2)
    return str(out)


@pytest.mark.parametrize(
    "name,make,want",
    [
        ("tumbling", lambda d: windowed_outcomes(d, "at"), {("10:00", "11:00", 3), ("14:00", "15:00", 2)}),
        ("sliding", lambda d: windowed_outcomes(d, "at", slide="30 minutes"), {("09:30", "10:30", 1), ("10:00", "11:00", 3), ("10:30", "11:30", 2), ("13:30", "14:30", 2), ("14:00", "15:00", 2)}),
        ("sessions", lambda d: session_outcomes(d, "at"), {("10:05", "11:25", 3), ("14:10", "14:50", 2)}),
    ],
)
def test_windows_and_late_rows(spark, folder, tmp_path, name, make, want):
    rows = spark.readStream.schema("at timestamp, decision string").option("maxFilesPerTrigger", 1).json(folder)
    q = make(rows).writeStream.format("memory").queryName(f"windows_{name}").outputMode("append").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    at = "session_window" if name == "sessions" else "window"
    got = spark.table(f"windows_{name}").selectExpr(f"date_format({at}.start, 'HH:mm') a", f"date_format({at}.end, 'HH:mm') b", "count", "decision").collect()
    assert {(r.a, r.b, r["count"]) for r in got} == want and len(got) == len(want)
    assert {r.decision for r in got} == {"accept"}
