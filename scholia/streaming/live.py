"""Live views of endless job streams: streamed text and a board of jobs, with state that event-time timers release.

Both are keyed by job and written for ``transformWithStateInPandas``, which keeps its state in RocksDB. ``events`` come from ``deduplicated``, whose watermark says what can still change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from .jobs import DELTA

#: Events that end a job; no event of it is expected after them.
ENDS = ("job:done", "job:failed", "stream:end")
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams that start from now on in RocksDB, as the views of this module need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKSDB)


def _millis(at: pd.Series) -> pd.Series:
    """Milliseconds of the epoch; an event without a time counts as the oldest."""
    return at.map(lambda x: 0 if x is None or x != x else int(pd.Timestamp(x).timestamp() * 1000))


class _Text(StatefulProcessor):
    """Patches of a job's texts.

    ``pending`` holds the deltas that the watermark hasn't passed, since a later one may still have to stand before them; ``settled`` the length and last seq of what stands before those, one small
    row for each open section, which outlives the text. A timer for the newest event of a batch settles what it waited for. When the watermark passes the end of a section or job, its rows go.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getMapState("settled", "section int", "chars bigint")
        self.pending = handle.getMapState("pending", "section int, seq bigint", "text string, at bigint")
        self.ends = handle.getMapState("ends", "section int", "at bigint")  # the job's own end is at JOB

    JOB = -2

    def _chars(self, section: int) -> int:
        return self.settled.getValue((section,))[0] if self.settled.containsKey((section,)) else 0

    def _held(self) -> dict[int, dict[int, tuple[str, int]]]:
        held: dict[int, dict[int, tuple[str, int]]] = {}
        for (section, seq), (text, at) in list(self.pending.iterator()):
            held.setdefault(section, {})[seq] = (text, at)
        return held

    def _settle(self, held: dict[int, dict[int, tuple[str, int]]], watermark: int) -> None:
        for section, deltas in held.items():
            chars, passed = self._chars(section), []
            for seq in sorted(deltas):
                if deltas[seq][1] >= watermark:
                    break
                chars += len(deltas[seq][0])
                passed.append(seq)
            for seq in passed:
                self.pending.removeKey((section, seq))
                del deltas[seq]
            if passed:
                self.settled.updateValue((section,), (chars,))
        ended = {section: at for (section,), (at,) in list(self.ends.iterator())}
        over = ended.get(self.JOB, watermark) < watermark
        if over and not any(held.values()):
            for state in (self.settled, self.ends):
                state.clear()
            return
        for section, at in ended.items():
            if section != self.JOB and at < watermark and not held.get(section):
                self.ends.removeKey((section,))
                if self.settled.containsKey((section,)):
                    self.settled.removeKey((section,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held, first, newest = self._held(), {}, 0
        for batch in rows:
            for kind, section, seq, text, at in zip(batch["type"], batch["section_index"].fillna(-1).astype(int).tolist(), batch["seq"].astype(int).tolist(), batch["text"].fillna(""), _millis(batch["at"])):
                newest = max(newest, at)
                if kind != DELTA:
                    self.ends.updateValue((self.JOB if kind in ENDS else section,), (at,))
                elif seq not in held.setdefault(section, {}):
                    held[section][seq] = (text, at)
                    self.pending.updateValue((section, seq), (text, at))
                    first[section] = min(seq, first.get(section, seq))
        out = []
        for section, low in sorted(first.items()):
            start = self._chars(section) + sum(len(t) for s, (t, _) in held[section].items() if s < low)
            text = "".join(held[section][s][0] for s in sorted(held[section]) if s >= low)
            if text:
                out.append((key[0], None if section < 0 else section, start, text))
        self._settle(held, timerValues.getCurrentWatermarkInMs())
        if newest:
            self.handle.registerTimer(newest + 1)
        if out:
            frame = pd.DataFrame(out, columns=["job_id", "section_index", "from_char", "text"])
            yield frame.astype({"section_index": "Int32"})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._settle(self._held(), timerValues.getCurrentWatermarkInMs())
        return iter([])

    def close(self) -> None:
        pass


def stream_live_text(events: DataFrame) -> DataFrame:
    """(job_id, section_index, from_char, text): patches of the sections' texts, each replacing all from its place on; no patch ever reaches behind what the watermark has passed.

    Of a job's deltas, later seqs have later times, as its one writer gives them. A delta that breaks this, with a seq before text that has settled, is put at the end of that text. Events that the
    watermark has passed are late and dropped by Spark; nothing else is, however long a section pauses. State is the text within the watermark and one length for each section that hasn't ended.
    """
    use_rocksdb(events.sparkSession)
    wanted = events.where(F.col("type").isin(DELTA, "section:done", *ENDS)).select("job_id", "section_index", "seq", "type", "text", "at")
    return wanted.groupBy("job_id").transformWithStateInPandas(_Text(), "job_id string, section_index int, from_char bigint, text string", "Append", "EventTime")


_BOARD = "seq bigint, status_seq bigint, status string, error string, ended boolean, started_at timestamp, ended_at timestamp, sections_started bigint, sections_done bigint, detail_seq bigint, last_detail string"


class _Board(StatefulProcessor):
    """The row of a job, updated by what a batch brings. When the watermark passes the job's ``stream:end``, the row goes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", _BOARD)
        self.closed = handle.getValueState("closed", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _BOARD.split(", ")]
        now = dict(zip(names, self.row.get())) if self.row.exists() else dict.fromkeys(names) | {"seq": -1, "status_seq": -1, "status": "queued", "ended": False, "sections_started": 0, "sections_done": 0, "detail_seq": -1}
        for batch in rows:
            for kind, seq, at, detail, error in zip(batch["type"], batch["seq"].astype(int).tolist(), batch["at"], batch["detail"], batch["error"]):
                at = None if at is None or at != at else pd.Timestamp(at).to_pydatetime()
                now["seq"] = max(now["seq"], seq)
                if kind.startswith("job:") and seq > now["status_seq"]:
                    now |= {"status_seq": seq, "status": kind.rsplit(":", 1)[1]}
                if kind == "job:running" and at is not None:
                    now["started_at"] = at if now["started_at"] is None else min(at, now["started_at"])
                if kind in ("job:done", "job:failed") and at is not None:
                    now["ended_at"] = at if now["ended_at"] is None else max(at, now["ended_at"])
                if kind == "job:failed" and error is not None:
                    now["error"] = error if now["error"] is None else max(error, now["error"])
                now["sections_started"] += kind == "section:start"
                now["sections_done"] += kind == "section:done"
                if detail is not None and seq > now["detail_seq"]:
                    now |= {"detail_seq": seq, "last_detail": detail}
                if kind == "stream:end":
                    now["ended"] = True
                    stamp = int(at.timestamp() * 1000) if at is not None else 0
                    self.closed.update((stamp,))
                    self.handle.registerTimer(max(stamp, timerValues.getCurrentWatermarkInMs()) + 1)
        self.row.update(tuple(now[n] for n in names))
        spent = 0.0 if now["started_at"] is None or now["ended_at"] is None else (now["ended_at"] - now["started_at"]).total_seconds()
        shown = {"job_id": key[0], "seq": now["seq"], "status": now["status"], "error": now["error"], "ended": now["ended"], "started_at": now["started_at"], "ended_at": now["ended_at"], "seconds": spent, "sections_started": now["sections_started"], "sections_done": now["sections_done"], "last_detail": now["last_detail"]}
        yield pd.DataFrame([shown]).astype({"started_at": "datetime64[us]", "ended_at": "datetime64[us]"})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.row.clear()
        self.closed.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_job_board(events: DataFrame) -> DataFrame:
    """``job_board`` on a stream: a job's row whenever events of it arrive, with its greatest seq so far, in update mode; write it by job_id and keep the row of the greatest seq.

    A job's state goes when the watermark passes its ``stream:end``; jobs that never end keep theirs. An event of a job that was let go would begin a new row, but none follows ``stream:end``.
    """
    use_rocksdb(events.sparkSession)
    columns = "job_id string, seq bigint, status string, error string, ended boolean, started_at timestamp, ended_at timestamp, seconds double, sections_started bigint, sections_done bigint, last_detail string"
    return events.select("job_id", "seq", "type", "at", "detail", "error").where(F.col("type") != DELTA).groupBy("job_id").transformWithStateInPandas(_Board(), columns, "Update", "EventTime")
