"""Anomaly rules (Q1-Q12) over processed events.

Output rows are flat (``schema.ANOMALY``): one column per detail key, null
where a rule has none.  Rules:

  per event (one scan, no shuffle):
    wiki_null, unknown_language, missing_page_id, incoherent_timestamp,
    short_title_repeated
  per page (title, wiki), forward windows over event time:
    edit_spike        first t with c(t, 5 min) >= 3, >= 3 x baseline, n >= 4
    rapid_page_edits  first t with c(t, 2 min) >= 5
  per minute:
    bot_high_edit_rate  >= 30 bot events in one minute

``detect_anomalies`` unions them and keeps the first row per
(type, page, timestamp), "first" meaning rule phase, then event order, then
rule order inside one event.  Events without a time are placed at ``as_of``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from recentlake import schema as S
from recentlake.functions import columns as C
from recentlake.operators.frames import combine_rows
from recentlake.operators.reports import _ts
from recentlake.operators.windows import forward_window_stats
from recentlake.session import reuse

MINUTE_US = 60_000_000

_TYPES = {f.name: f.dataType.simpleString() for f in S.ANOMALY.fields}

# phase of each rule family in the dedup order
PHASE_EVENT, PHASE_SPIKE, PHASE_RAPID, PHASE_BOT = 0, 1, 2, 3


def _row(**values: Column) -> list[Column]:
    """All ANOMALY columns, given ones set, the rest typed nulls."""
    out = []
    for name, dtype in _TYPES.items():
        v = values.get(name)
        out.append((v if v is not None else F.lit(None)).cast(dtype).alias(name))
    return out


#: Event order within the lake: broker partition and offset.
ORDER_COLS = ("kafka_partition", "kafka_offset")
_OFFSET_BITS = 44


def _order(order_cols: Sequence[str]) -> Column:
    """Event order as one long (so that its minimum stays in a hash
    aggregate): the single column given, or partition and offset packed."""
    last = F.lit((1 << 63) - 1)
    if len(order_cols) == 1:
        return F.coalesce(F.col(order_cols[0]).cast("long"), last)
    part, offset = (F.col(c).cast("long") for c in order_cols)
    return F.coalesce(F.shiftleft(part, _OFFSET_BITS) + offset, last)


def _keyed(events: DataFrame, as_of: Column, order_cols: Sequence[str]) -> DataFrame:
    """Events with page keys, event time (µs, missing -> as_of) and order."""
    raw_ts = _ts(events)
    ts = F.coalesce(raw_ts, as_of)
    cols = set(events.columns)
    payload = F.col("payload") if "payload" in cols else F.lit(None).cast("string")
    ing = F.col("ingestion_timestamp") if "ingestion_timestamp" in cols else F.lit(None).cast("string")
    page_id = F.col("page_id") if "page_id" in cols else F.lit(None).cast("string")
    return events.select(
        C.page_title("title").alias("_title"),
        C.page_wiki("wiki").alias("_wiki"),
        F.col("title").alias("_raw_title"),
        F.col("wiki").alias("_raw_wiki"),
        F.col("user").alias("_user"),
        F.col("is_bot").alias("_is_bot"),
        page_id.alias("_page_id"),
        payload.alias("_payload"),
        ing.alias("_ing"),
        raw_ts.alias("_raw_ts"),
        ts.alias("_ts"),
        F.coalesce(F.unix_micros(ts), F.lit(0).cast("long")).alias("_us"),
        _order(order_cols).alias("_seq"),
    )


def page_times(events: DataFrame, title: str, wiki: str, as_of: Column, order_cols: Sequence[str] = ORDER_COLS) -> DataFrame:
    """What the page window rules read, from events that have page keys as
    columns (``title`` and ``wiki``, passed on as they are)."""
    time = F.unix_micros(F.coalesce(_ts(events), as_of))
    return events.select(F.col(title).alias("_title"), F.col(wiki).alias("_wiki"),
                         F.coalesce(time, F.lit(0).cast("long")).alias("_us"), _order(order_cols).alias("_seq"))


# ---------------------------------------------------------------------------
# Per-event rules (Q1-Q5)
# ---------------------------------------------------------------------------

def _event_rule_structs(k: DataFrame, as_of: Column) -> dict[str, tuple[Column, list[Column]]]:
    wiki = F.col("_raw_wiki")
    stamp = C.iso_utc(F.col("_ts"))
    payload = F.col("_payload")
    if isinstance(k.schema["_payload"].dataType, VariantType):
        no_page_id = F.schema_of_variant(payload).startswith("OBJECT") & F.try_variant_get(payload, "$.page_id", "string").isNull()
    else:
        no_page_id = (C.nonempty(payload).isNotNull() & C.is_json_object_text(payload)
                      & F.get_json_object(payload, "$.page_id").isNull())
    return {
        "wiki_null": (
            wiki.isNull() | (C.strip_ws(wiki) == F.lit("")),
            _row(type=F.lit(S.ANOMALY_DATA), page=F.col("_title"), severity=F.lit(S.SEVERITY_HIGH), timestamp=stamp,
                 reason=F.lit(S.RULE_WIKI_NULL), wiki=wiki),
        ),
        "unknown_language": (
            C.nonempty(wiki).isNotNull() & (C.wiki_to_language(wiki) == F.lit(S.UNKNOWN)),
            _row(type=F.lit(S.ANOMALY_DATA), page=F.col("_title"), severity=F.lit(S.SEVERITY_MEDIUM), timestamp=stamp,
                 reason=F.lit(S.RULE_UNKNOWN_LANGUAGE), wiki=wiki),
        ),
        "missing_page_id": (
            F.col("_page_id").isNull() & F.coalesce(no_page_id, F.lit(False)),
            _row(type=F.lit(S.ANOMALY_DATA), page=F.col("_title"), severity=F.lit(S.SEVERITY_MEDIUM), timestamp=stamp,
                 reason=F.lit(S.RULE_MISSING_PAGE_ID)),
        ),
        "incoherent_timestamp": (
            F.coalesce(
                F.col("_raw_ts") > as_of + F.expr(f"INTERVAL {S.FUTURE_TOLERANCE_MIN} MINUTES"), F.lit(False)
            ),
            _row(type=F.lit(S.ANOMALY_DATA), page=F.col("_title"), severity=F.lit(S.SEVERITY_HIGH), timestamp=stamp,
                 reason=F.lit(S.RULE_FUTURE_TIME),
                 ingestion_timestamp=F.coalesce(F.col("_ing"), F.lit("None"))),
        ),
        "short_title_repeated": (
            F.length(F.coalesce(C.nonempty("_raw_title"), F.lit(""))) <= S.SHORT_TITLE_LEN,
            _row(type=F.lit(S.ANOMALY_SPAM), page=F.col("_title"), severity=F.lit(S.SEVERITY_LOW), timestamp=stamp,
                 reason=F.lit(S.RULE_SHORT_TITLE), title=F.col("_title"), user=C.user_key("_user")),
        ),
    }


EVENT_RULES = ("wiki_null", "unknown_language", "missing_page_id", "incoherent_timestamp", "short_title_repeated")


def event_rules(keyed: DataFrame, as_of: Column, rules: Sequence[str] = EVENT_RULES,
                carry: Sequence[str] = ()) -> DataFrame:
    """All per-event rules in one pass: an array of optional hits, exploded
    (with the columns ``carry`` of the event)."""
    specs = _event_rule_structs(keyed, as_of)
    hits = []
    for idx, name in enumerate(EVENT_RULES):
        if name not in rules:
            continue
        cond, row = specs[name]
        hits.append(
            F.when(
                cond,
                F.struct(*row, F.lit(PHASE_EVENT).alias("_phase"), F.col("_seq"), F.lit(idx).alias("_rule")),
            )
        )
    arr = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return keyed.select(F.explode(arr).alias("a"), *carry).select("a.*", *carry)


# ---------------------------------------------------------------------------
# Page window rules (Q6, Q7)
# ---------------------------------------------------------------------------

PAGE_RULES = ("edit_spike", "rapid_page_edits")
WIDTHS = {"w5": S.EDIT_SPIKE_WINDOW_MIN * MINUTE_US, "w2": S.SPAM_WINDOW_MIN * MINUTE_US}


def page_window_rules(keyed: DataFrame, slice_us: int | None = None,
                      rules: Sequence[str] = PAGE_RULES) -> DataFrame:
    """Edit spikes and rapid edits from one scan, one shuffle, one aggregate.

    edit_spike:        first t (per page) with c5 >= 3, c5 >= 3 x baseline and
                       n >= 4; baseline = max(1, n / max(1, span minutes))
    rapid_page_edits:  first t with c2 >= 5
    where cW = events of the page in [t, t + W minutes].  "First" is the
    smallest t: ``min_by`` over ``when(hit, t)`` (non-hits are ignored), a
    partial aggregate, so no page ever gathers in one task.
    """
    w = forward_window_stats(keyed, ["_title", "_wiki"], "_us", WIDTHS, slice_us=slice_us, carry_min="_seq")
    return page_hits(w, rules)


def page_hits(w: DataFrame, rules: Sequence[str] = PAGE_RULES) -> DataFrame:
    """The hits of window counts ``w`` (as ``forward_window_stats`` gives them
    for ``WIDTHS``, with the totals of their page)."""
    span_min = (F.col("key_last") - F.col("key_first")).cast("double") / F.lit(1_000_000.0) / F.lit(60.0)
    baseline = F.greatest(F.lit(1.0), F.col("key_count") / F.greatest(F.lit(1.0), span_min))
    c5, c2 = F.col("w5_count"), F.col("w2_count")
    spike_hit = (
        (F.col("key_count") >= S.EDIT_SPIKE_MIN_EVENTS)
        & (c5 >= S.EDIT_SPIKE_MIN_IN_WINDOW)
        & (c5.cast("double") >= baseline * F.lit(S.EDIT_SPIKE_RATIO))
    )
    rapid_hit = c2 >= S.SPAM_EDITS_IN_WINDOW
    # Only hits are aggregated: few rows carry the structs.
    first = w.where(spike_hit | rapid_hit).groupBy("_title", "_wiki").agg(
        F.min_by(F.struct(c5.alias("c"), F.col("w5_last").alias("last"), baseline.alias("baseline")),
                 F.when(spike_hit, F.col("_us"))).alias("s"),
        F.min_by(F.struct(c2.alias("c"), F.col("w2_last").alias("last")),
                 F.when(rapid_hit, F.col("_us"))).alias("r"),
        F.min("key_min__seq").alias("_seq"),
    )
    sc, rc = F.col("s.c"), F.col("r.c")
    spike = F.struct(
        *_row(type=F.lit(S.ANOMALY_SPIKE), page=F.col("_title"), severity=C.severity(sc),
              timestamp=C.iso_utc(F.timestamp_micros(F.col("s.last"))), edit_count=sc,
              window=F.lit(f"{S.EDIT_SPIKE_WINDOW_MIN}min"), wiki=F.col("_wiki"),
              ratio_vs_baseline=F.round(sc.cast("double") / F.col("s.baseline"), 2)),
        F.lit(PHASE_SPIKE).alias("_phase"), F.col("_seq"), F.lit(0).alias("_rule"),
    )
    rapid = F.struct(
        *_row(type=F.lit(S.ANOMALY_SPAM), page=F.col("_title"), severity=F.lit(S.SEVERITY_HIGH),
              timestamp=C.iso_utc(F.timestamp_micros(F.col("r.last"))), edit_count=rc,
              window=F.lit(f"{S.SPAM_WINDOW_MIN}min"), wiki=F.col("_wiki"), reason=F.lit(S.RULE_RAPID_EDITS)),
        F.lit(PHASE_RAPID).alias("_phase"), F.col("_seq"), F.lit(0).alias("_rule"),
    )
    hits = []
    if "edit_spike" in rules:
        hits.append(F.when(F.col("s").isNotNull(), spike))
    if "rapid_page_edits" in rules:
        hits.append(F.when(F.col("r").isNotNull(), rapid))
    arr = F.filter(F.array(*hits), lambda x: x.isNotNull())
    return first.select(F.explode(arr).alias("a")).select("a.*")


def edit_spikes(keyed: DataFrame, slice_us: int | None = None) -> DataFrame:
    return page_window_rules(keyed, slice_us, ["edit_spike"])


def rapid_edits(keyed: DataFrame, slice_us: int | None = None) -> DataFrame:
    return page_window_rules(keyed, slice_us, ["rapid_page_edits"])


# ---------------------------------------------------------------------------
# Bot rate (Q8)
# ---------------------------------------------------------------------------

def bot_rate(keyed: DataFrame, threshold: int = S.BOT_EDITS_PER_MIN_THRESHOLD) -> DataFrame:
    """Minutes with ``threshold`` bot events or more: a hash aggregate on the
    minute's number, formatted afterwards."""
    return bot_hits(bot_minutes(keyed), threshold)


def bot_minutes(keyed: DataFrame) -> DataFrame:
    """``minute`` (its number), ``n`` bot events and their first ``_seq``."""
    return (
        keyed.filter(C.is_true("_is_bot"))
        .select(C.bucket_us("_us", MINUTE_US).alias("minute"), "_seq")
        .groupBy("minute")
        .agg(F.count(F.lit(1)).alias("n"), F.min("_seq").alias("_seq"))
    )


def bot_hits(minutes: DataFrame, threshold: int = S.BOT_EDITS_PER_MIN_THRESHOLD) -> DataFrame:
    return minutes.filter(F.col("n") >= threshold).select(
        *_row(type=F.lit(S.ANOMALY_BOT), page=F.lit(S.BOT_PAGE_LABEL), severity=F.lit(S.SEVERITY_HIGH),
              timestamp=F.concat(C.minute_bucket(F.timestamp_micros("minute")), F.lit(":00+00:00")),
              edits_per_minute=F.col("n"), threshold=F.lit(threshold), reason=F.lit(S.RULE_BOT_RATE)),
        F.lit(PHASE_BOT).alias("_phase"),
        "_seq",
        F.lit(0).alias("_rule"),
    )


# ---------------------------------------------------------------------------
# Public operators
# ---------------------------------------------------------------------------

def _public(df: DataFrame) -> DataFrame:
    return df.select(*S.ANOMALY_COLUMNS)


def rule(events: DataFrame, name: str, as_of: Column, order_cols: Sequence[str] = ORDER_COLS,
         slice_us: int | None = None) -> DataFrame:
    """One rule's raw hits (no cross-rule dedup)."""
    keyed = _keyed(events, as_of, order_cols)
    if name in EVENT_RULES:
        return _public(event_rules(keyed, as_of, [name]))
    if name == "edit_spike":
        return _public(edit_spikes(keyed, slice_us))
    if name == "rapid_page_edits":
        return _public(rapid_edits(keyed, slice_us))
    if name == "bot_high_edit_rate":
        return _public(bot_rate(keyed))
    raise KeyError(name)


def detect_anomalies(events: DataFrame, as_of: Column, order_cols: Sequence[str] = ORDER_COLS,
                     slice_us: int | None = None, dedup_keys: Sequence[str] = ("type", "page", "timestamp"),
                     materialize: bool = False) -> DataFrame:
    """All rules, then first row per (type, page, timestamp).

    The dedup is a hash aggregate with ``min_by`` over the order struct: it is
    partially aggregated map-side, so a key with many hits (say all events of
    one page without time, placed at ``as_of``) never gathers in one task.

    The rule families read the input three times (per-event rules, window
    rules, bot rate).  On a columnar lake each read prunes to its columns; on
    a JSON lake, where every read parses whole lines, pass
    ``materialize=True``: the narrow keyed projection is written once as a
    reliable checkpoint (shared ``spark.checkpoint.dir``) and read thrice.
    """
    keyed = _keyed(events, as_of, order_cols)
    if materialize:
        keyed = reuse(keyed)
    allhits = (
        event_rules(keyed, as_of)
        .unionByName(page_window_rules(keyed, slice_us))
        .unionByName(bot_rate(keyed))
    )
    return _public(first_hits(allhits, dedup_keys))


def first_hits(hits: DataFrame, dedup_keys: Sequence[str] = ("type", "page", "timestamp")) -> DataFrame:
    """The first hit of each key by (phase, event order, rule), with its order:
    a hash aggregate, combined map-side."""
    rest = [c for c in hits.columns if c not in dedup_keys]
    first = hits.groupBy(*dedup_keys).agg(F.min_by(F.struct(*rest), F.struct("_phase", "_seq", "_rule")).alias("r"))
    return first.select(*dedup_keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(*hits.columns)


def anomaly_report(events: DataFrame, anomalies: DataFrame, as_of: Column) -> DataFrame:
    """Run envelope: generated_at, events analysed, anomaly count (one row)."""
    n_events = events.agg(F.count(F.lit(1)).alias("events_analyzed"))
    n_anom = anomalies.agg(F.count(F.lit(1)).alias("anomaly_count"))
    return combine_rows(n_events, n_anom).select(
        C.iso_utc(as_of).alias("generated_at"), "events_analyzed", "anomaly_count"
    )

