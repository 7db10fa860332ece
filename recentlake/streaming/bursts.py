"""Page bursts on streams (Q6, Q7, Q10): keyed state with event-time timers.

Runs are tumbling spans of event time (``run``, an hour by default, the
cadence of the batch job).  For each page title and run the state holds, per
wiki, what the batch rules need and no more:

* totals: events, first and last time, first event order;
* a ring: the event times (with their number) whose five-minute windows can
  still grow.  The watermark evicts them: once no event of a window can come
  any more, its counts are final and its start leaves the ring;
* ``peaks``: final windows that count more than all earlier ones, so that the
  first window over any threshold is among them (the baseline, and with it the
  threshold, is known only when the run ends);
* the first final window with rapid edits.

The timer of a key stands at the next eviction, or at the run's end.  At the
end the rules are decided just as in batch, hits of one (type, page,
timestamp) are reduced to the first, rapid-edit hits that a short-title hit of
the same page and time hides are left out, and the state is removed.

Every result is final, so the stream appends.  Events that come after the
watermark has passed them are dropped, as by every watermarked operator.  An
event without a time is placed at ``as_of``.

Per-event rules need no carried state but the dedup: ``event_hits_stream``
keeps the first hit of each key in a watermarked aggregate on the JVM.  The
bot rate is ``live.bot_rate_stream``.  Together the three give the rows of
``detect_anomalies`` over the events of each run.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recentlake import schema as S
from recentlake.functions import columns as C
from recentlake.operators import anomalies as A

SPIKE_US = A.WIDTHS["w5"]
RAPID_US = A.WIDTHS["w2"]
HOUR_MIN = 60

#: ``baseline`` is 0 for rapid edits.
_OUT = "run_us bigint, page string, wiki string, spike boolean, n bigint, last_us bigint, baseline double"


class PageRun:
    """The state of one (title, wiki) in one run; a small helper of the
    grouped function below, in plain lists so that it becomes JSON."""

    def __init__(self, saved: dict | None = None):
        s = saved or {}
        self.n, self.first, self.last, self.seq = s.get("n", 0), s.get("first"), s.get("last"), s.get("seq")
        self.times, self.counts, self.short = s.get("times", []), s.get("counts", []), s.get("short", [])
        self.peaks, self.rapid = s.get("peaks", []), s.get("rapid")

    def saved(self) -> dict:
        return dict(self.__dict__)

    def add(self, times: Iterable[int], seqs: Iterable[int], shorts: Iterable[bool]) -> None:
        ring = dict(zip(self.times, self.counts))
        marks = dict(zip(self.times, self.short))
        for t, q, s in zip(times, seqs, shorts):
            ring[t] = ring.get(t, 0) + 1
            marks[t] = marks.get(t, False) or s
            self.n += 1
            self.first = t if self.first is None else min(self.first, t)
            self.last = t if self.last is None else max(self.last, t)
            self.seq = q if self.seq is None else min(self.seq, q)
        self.times = sorted(ring)
        self.counts = [ring[t] for t in self.times]
        self.short = [marks[t] for t in self.times]

    def evict(self, watermark: int) -> None:
        """Decide the windows that end before ``watermark``."""
        done = bisect_left(self.times, watermark - SPIKE_US)
        if not done:
            return
        upto = [0]
        for c in self.counts:
            upto.append(upto[-1] + c)
        for i, t in enumerate(self.times[:done]):
            end = bisect_right(self.times, t + SPIKE_US)
            count = upto[end] - upto[i]
            if count >= S.EDIT_SPIKE_MIN_IN_WINDOW and (not self.peaks or count > self.peaks[-1][0]):
                self.peaks.append([count, self.times[end - 1]])
            if self.rapid is None:
                end = bisect_right(self.times, t + RAPID_US)
                if upto[end] - upto[i] >= S.SPAM_EDITS_IN_WINDOW:
                    # a short-title hit of the same page and time comes first
                    self.rapid = [upto[end] - upto[i], self.times[end - 1], self.short[end - 1]]
        self.times, self.counts, self.short = self.times[done:], self.counts[done:], self.short[done:]

    def due(self) -> int | None:
        """When the next window is decided."""
        return self.times[0] + SPIKE_US + 1 if self.times else None

    def spike(self) -> tuple[int, int, float] | None:
        """Count, last time and baseline of the first window over the threshold."""
        if self.n < S.EDIT_SPIKE_MIN_EVENTS:
            return None
        minutes = (self.last - self.first) / 1_000_000.0 / 60.0
        baseline = max(1.0, self.n / max(1.0, minutes))
        return next(((c, last, baseline) for c, last in self.peaks if float(c) >= baseline * S.EDIT_SPIKE_RATIO), None)


def _decided(run_us: int, title: str, wikis: dict[str, PageRun]) -> pd.DataFrame:
    """The hits of a closed run: the first of each (type, page, timestamp)."""
    spikes, rapids, hidden = {}, {}, set()
    for wiki, page in wikis.items():
        s = page.spike()
        if s and (s[1] not in spikes or page.seq < spikes[s[1]][1]):
            spikes[s[1]] = (wiki, page.seq, s)
        if page.rapid:
            count, last, short = page.rapid
            if last not in rapids or page.seq < rapids[last][1]:
                rapids[last] = (wiki, page.seq, count)
            if short:
                hidden.add(last)
    rows = [(run_us, title, wiki, True, c, last, base) for wiki, _, (c, last, base) in spikes.values()]
    rows += [(run_us, title, wiki, False, c, last, 0.0) for last, (wiki, _, c) in rapids.items() if last not in hidden]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])


def _page_runs(run_len: int):
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        title, run_us = key[0], int(key[1])
        wikis = {w: PageRun(s) for w, s in json.loads(state.get[0])} if state.exists else {}
        watermark = state.getCurrentWatermarkMs() * 1000
        for rows in batches:
            for wiki, group in rows.groupby("_wiki", sort=False):
                wikis.setdefault(wiki, PageRun()).add(group["_us"].tolist(), group["_seq"].tolist(), group["_short"].tolist())
        end = run_us + run_len
        closed = watermark > end
        for page in wikis.values():
            page.evict(end + SPIKE_US + 1 if closed else watermark)
        if closed:
            if state.exists:
                state.remove()
            found = _decided(run_us, title, wikis)
            if len(found):
                yield found
            return
        due = min([end + 1, *(d for p in wikis.values() if (d := p.due()))])
        state.update((json.dumps([(w, p.saved()) for w, p in wikis.items()]),))
        state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    return step


def _run_start(run_min: int) -> Column:
    return C.bucket_us("_us", run_min * A.MINUTE_US)


def page_bursts_stream(events: DataFrame, as_of: Column, watermark: str = "10 minutes", run_min: int = HOUR_MIN,
                       order_cols: Sequence[str] = A.ORDER_COLS) -> DataFrame:
    """Edit spikes and rapid edits of each run of ``run_min`` minutes (an
    appending stream of anomaly rows, with ``run_start``)."""
    timed = A._keyed(events, as_of, order_cols).withColumn("_at", F.timestamp_micros("_us")).withWatermark("_at", watermark)
    short = F.length(F.coalesce(C.nonempty("_raw_title"), F.lit(""))) <= S.SHORT_TITLE_LEN
    rows = timed.select("_title", _run_start(run_min).alias("_run"), "_wiki", "_us", "_seq", short.alias("_short"), "_at")
    found = rows.groupBy("_title", "_run").applyInPandasWithState(
        _page_runs(run_min * A.MINUTE_US), outputStructType=_OUT, stateStructType="state string", outputMode="append",
        timeoutConf=GroupStateTimeout.EventTimeTimeout)
    def either(of_spike: Column, of_rapid: Column) -> Column:
        return F.when(F.col("spike"), of_spike).otherwise(of_rapid)

    row = A._row(
        type=either(F.lit(S.ANOMALY_SPIKE), F.lit(S.ANOMALY_SPAM)), page=F.col("page"), wiki=F.col("wiki"),
        severity=either(C.severity(F.col("n")), F.lit(S.SEVERITY_HIGH)), edit_count=F.col("n"),
        timestamp=C.iso_utc(F.timestamp_micros("last_us")),
        window=either(F.lit(f"{S.EDIT_SPIKE_WINDOW_MIN}min"), F.lit(f"{S.SPAM_WINDOW_MIN}min")),
        ratio_vs_baseline=F.when(F.col("spike"), F.round(F.col("n").cast("double") / F.col("baseline"), 2)),
        reason=either(F.lit(None), F.lit(S.RULE_RAPID_EDITS)))
    return found.select(*row, F.timestamp_micros("run_us").alias("run_start"))


def event_hits_stream(events: DataFrame, as_of: Column, watermark: str = "10 minutes", run_min: int = HOUR_MIN,
                      order_cols: Sequence[str] = A.ORDER_COLS) -> DataFrame:
    """Hits of the per-event rules, the first of each (type, page, timestamp):
    a streaming aggregate whose state leaves with the watermark."""
    keyed = A._keyed(events, as_of, order_cols).withColumn("_at", F.timestamp_micros("_us")).withWatermark("_at", watermark)
    hits = A.event_rules(keyed, as_of, carry=("_at", "_us"))
    keys = ("type", "page", "timestamp")
    rest = [c for c in S.ANOMALY_COLUMNS if c not in keys]
    first = hits.groupBy(*keys, F.window("_at", "1 second").alias("_second"), _run_start(run_min).alias("_run")).agg(
        F.min_by(F.struct(*rest), F.struct("_phase", "_seq", "_rule")).alias("r"))
    return first.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest], F.timestamp_micros("_run").alias("run_start")).select(
        *S.ANOMALY_COLUMNS, "run_start")
