"""The governed write as a stream: keyed state over micro-batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.policies import gate_step

OUT = "subject_id string, predicate string, seq long, decision string"
STATE = "object_id string, pct int"


def evidence_stream(candidates: DataFrame) -> DataFrame:
    """Decisions of the evidence-weighted policy on a stream of candidates.

    State is one value and its confidence a key. Rows of a micro-batch are taken in order of
    seq; across batches the order of arrival counts.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for r in rows.itertuples(index=False):
            if held is None:
                held, what = (r.object_id, int(r.pct)), "accept"
            elif held[0] == r.object_id:
                what = "accept"
            elif r.pct >= held[1]:
                held, what = (r.object_id, int(r.pct)), "supersede"
            else:
                what = "reject"
            out.append((key[0], key[1], r.seq, what))
        state.update(held)
        yield pd.DataFrame(out, columns=["subject_id", "predicate", "seq", "decision"])

    cols = ["subject_id", "predicate", "seq", "object_id", "pct"]
    return candidates.select(*cols).groupBy("subject_id", "predicate").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


class Gate(StatefulProcessor):
    """The contradiction gate of one key: its active values are a list, beside the highest seq it has seen.

    With ``expire`` a timer is set where an accepted value's window ends; when the watermark passes it, the
    value leaves the list, which then holds no more than what is still valid.
    """

    def __init__(self, step, expire: bool) -> None:
        self.step, self.expire = step, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getListState("active", "object_id string, pct long, valid_from timestamp, valid_to timestamp")
        self.seen = handle.getValueState("seen", "seq long")

    def _read(self) -> list[tuple]:
        none = lambda t: None if t is None or pd.isna(t) else pd.Timestamp(t)
        return [(o, int(p), none(a), none(b)) for o, p, a, b in self.active.get()] if self.active.exists() else []

    def _write(self, values: list[tuple]) -> None:
        plain = lambda t: None if t is None else t.to_pydatetime()
        if values:
            self.active.put([(o, p, plain(a), plain(b)) for o, p, a, b in values])
        elif self.active.exists():
            self.active.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, last = self._read(), self.seen.get()[0] if self.seen.exists() else None
        out = []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            state, done = self.step(state, r)
            late = last is not None and r.seq < last
            last = r.seq if last is None else max(last, r.seq)
            out += [(*key, int(seq), decision, kind, late) for seq, decision, kind in done]
            if self.expire and done[0][1] in ("accept", "supersede") and not pd.isna(r.valid_to):
                self.handle.registerTimer(int(pd.Timestamp(r.valid_to).timestamp() * 1000))
        self._write(state)
        self.seen.update((int(last),))
        yield pd.DataFrame(out, columns=["subject_id", "predicate", "seq", "decision", "kind", "late"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        self._write([v for v in self._read() if v[3] is None or v[3].timestamp() * 1000 > end])
        return iter([])

    def close(self) -> None:
        pass


def gate_stream(candidates: DataFrame, tau: int = 80, margin: int = 10, evidence_min: int = 1, authoritative: bool = False, expire: bool = False) -> DataFrame:
    """subject_id, predicate, seq, decision, kind, late of the contradiction gate on a stream of single-valued candidates.

    Rows of a micro-batch are taken in order of seq. A row that arrives in a later micro-batch than
    a row of a greater seq, such as a late correction, meets what is active by then, and is marked
    late. With ``expire``, candidates must carry a watermark on a column of theirs, and values whose
    window it has passed conflict with nothing any more. The session needs the RocksDB state store.
    """
    cols = ["subject_id", "predicate", "seq", "object_id", "pct", "valid_from", "valid_to", "write_intent", "source_ref"]
    keep = cols if not expire else candidates.columns
    return candidates.select(*keep).groupBy("subject_id", "predicate").transformWithStateInPandas(
        statefulProcessor=Gate(gate_step(tau, margin, evidence_min, authoritative), expire),
        outputStructType="subject_id string, predicate string, seq long, decision string, kind string, late boolean",
        outputMode="Append",
        timeMode="EventTime" if expire else "None",
    )


def windowed_outcomes(decisions: DataFrame, at: str, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Counts by decision and window, tumbling or with ``slide`` sliding; rows whose windows the watermark had passed in the micro-batch before are left out."""
    return decisions.withWatermark(at, late).groupBy(F.window(at, width, slide), "decision").count()


def session_outcomes(decisions: DataFrame, at: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Counts by decision and session, which ends ``gap`` after its last row."""
    return decisions.withWatermark(at, late).groupBy(F.session_window(at, gap), "decision").count()
