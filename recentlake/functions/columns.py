"""Column -> Column helpers.  All built-in expressions (JVM side, codegen).

The session time zone must be UTC (see ``recentlake.session``): buckets and
ISO strings are rendered with ``date_format``, which uses the session zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recentlake import schema as S

ColumnOrName = Column | str


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---------------------------------------------------------------------------
# Text helpers
# ---------------------------------------------------------------------------

# Whitespace set stripped by strip_ws / rstrip_ws: space, \t, \n, \x0b, \f, \r
# (the ASCII whitespace class; plain ``trim`` strips spaces only).
WHITESPACE = " \t\n\x0b\x0c\r"


def strip_ws(col: ColumnOrName) -> Column:
    """Strip leading/trailing whitespace (a character-set trim, no regex)."""
    return F.btrim(_c(col), F.lit(WHITESPACE))


def rstrip_ws(col: ColumnOrName) -> Column:
    return F.rtrim(_c(col), F.lit(WHITESPACE))


def nonempty(col: ColumnOrName) -> Column:
    """Null when the value is null or the empty string (falsy text)."""
    c = _c(col)
    return F.when(c != F.lit(""), c)


def or_default(col: ColumnOrName, default: str) -> Column:
    """``str(value or default)``: empty and null fall back to ``default``."""
    return F.coalesce(nonempty(col), F.lit(default))


# ---------------------------------------------------------------------------
# Raw-event extraction (ingest side)
# ---------------------------------------------------------------------------

def extract_wiki(wiki: ColumnOrName = "wiki", server_name: ColumnOrName = "server_name",
                 domain: ColumnOrName = "meta.domain") -> Column:
    """First non-empty of wiki, server_name, meta.domain; else null."""
    return F.coalesce(nonempty(wiki), nonempty(server_name), nonempty(domain))


def extract_event_ts(timestamp: ColumnOrName = "timestamp",
                     meta_dt: ColumnOrName = "meta.dt") -> Column:
    """First non-null of timestamp, meta.dt (0 and '' count as present)."""
    return F.coalesce(_c(timestamp), _c(meta_dt))


def clean_title(title: ColumnOrName = "title") -> Column:
    """Stripped title, null when missing or blank."""
    return nonempty(strip_ws(title))


def user_or_unknown(user: ColumnOrName = "user") -> Column:
    """Missing user becomes 'unknown'; an empty user name is kept."""
    return F.coalesce(_c(user), F.lit(S.UNKNOWN))


def is_anonymous(anonymous: ColumnOrName = "anonymous", userid: ColumnOrName = "userid",
                 user: ColumnOrName = "user") -> Column:
    """anonymous flag set, or userid 0, or a user name shaped like IPv4."""
    return (
        F.coalesce(_c(anonymous), F.lit(False))
        | F.coalesce(_c(userid) == F.lit(0), F.lit(False))
        | F.coalesce(_c(user).rlike(S.IPV4_PATTERN), F.lit(False))
    )


def partition_key(wiki: ColumnOrName = "wiki") -> Column:
    """Message key: the stripped wiki code."""
    return strip_ws(wiki)


def page_id_fallback(page_id: ColumnOrName = "page_id", meta_id: ColumnOrName = "meta.id") -> Column:
    return F.coalesce(_c(page_id), _c(meta_id))


def is_json_object_text(text: ColumnOrName) -> Column:
    """For text that is valid JSON: is the top-level value an object?"""
    return _c(text).rlike(r"^\s*\{")


# ---------------------------------------------------------------------------
# Report-side keys and predicates
# ---------------------------------------------------------------------------

def wiki_to_language(wiki: ColumnOrName = "wiki") -> Column:
    """enwiki -> en; falsy -> unknown; other codes unchanged (stripped)."""
    w = _c(wiki)
    s = strip_ws(w)
    return F.when(w.isNull() | (w == F.lit("")), F.lit(S.UNKNOWN)).otherwise(
        F.when(s.endswith("wiki") & (F.length(s) > 4), _drop_suffix(s, 4)).otherwise(s)
    )


def _drop_suffix(s: Column, n: int) -> Column:
    return s.substr(F.lit(1), F.length(s) - F.lit(n))


def page_title(title: ColumnOrName = "title", default: str = S.UNKNOWN) -> Column:
    return or_default(title, default)


def page_wiki(wiki: ColumnOrName = "wiki", default: str = S.UNKNOWN) -> Column:
    return or_default(wiki, default)


def user_key(user: ColumnOrName = "user", default: str = S.UNKNOWN) -> Column:
    return or_default(user, default)


def _type_in(event_type: ColumnOrName, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(_c(event_type)).isin(*values), F.lit(False))


def is_create(event_type: ColumnOrName = "event_type") -> Column:
    return _type_in(event_type, S.CREATE_TYPES)


def is_delete(event_type: ColumnOrName = "event_type") -> Column:
    return _type_in(event_type, S.DELETE_TYPES)


def is_edit(event_type: ColumnOrName = "event_type") -> Column:
    return _type_in(event_type, S.EDIT_TYPES)


def is_true(col: ColumnOrName) -> Column:
    """``value is True``: null and false are both false."""
    return F.coalesce(_c(col), F.lit(False))


def event_ts(event_time: ColumnOrName = "event_time",
             ingestion_timestamp: ColumnOrName = "ingestion_timestamp",
             kafka_timestamp: ColumnOrName = "kafka_timestamp") -> Column:
    """First parseable of event_time, ingestion_timestamp, kafka_timestamp."""
    return F.coalesce(
        _c(event_time),
        F.try_to_timestamp(nonempty(strip_ws(ingestion_timestamp))),
        _c(kafka_timestamp),
    )


def event_date(event_time: ColumnOrName = "event_time",
               kafka_timestamp: ColumnOrName = "kafka_timestamp") -> Column:
    """UTC date of the event (broker time when the event time is missing):
    the lake's partition column."""
    return F.to_date(F.coalesce(_c(event_time), _c(kafka_timestamp)))


def bucket_us(us: ColumnOrName, width_us: int) -> Column:
    """Start of the bucket of ``width_us`` that holds a time in µs, as a long:
    the cheap grouping key; format it after the aggregate."""
    u = _c(us)
    return u - F.pmod(u, F.lit(width_us).cast("long"))


def minute_bucket(ts: ColumnOrName) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm")


def hour_bucket(ts: ColumnOrName) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:00")


def pct(part: ColumnOrName, total: ColumnOrName) -> Column:
    """round(part / total * 100, 2), 0.0 when total is 0."""
    p, t = _c(part), _c(total)
    return F.when(t > 0, F.round(p.cast("double") / t.cast("double") * F.lit(100.0), 2)).otherwise(F.lit(0.0))


def severity(count: ColumnOrName, high: int = S.SEVERITY_HIGH_AT, medium: int = S.SEVERITY_MEDIUM_AT) -> Column:
    c = _c(count)
    return F.when(c >= high, F.lit(S.SEVERITY_HIGH)).when(c >= medium, F.lit(S.SEVERITY_MEDIUM)).otherwise(F.lit(S.SEVERITY_LOW))


# ---------------------------------------------------------------------------
# Time rendering
# ---------------------------------------------------------------------------

def micros(ts: ColumnOrName) -> Column:
    return F.unix_micros(_c(ts))


def iso_utc(ts: ColumnOrName) -> Column:
    """ISO-8601 text with '+00:00'; fraction only when non-zero (µs)."""
    t = _c(ts)
    frac = F.pmod(F.unix_micros(t), F.lit(1_000_000))
    return F.concat(
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(frac == 0, F.lit("")).otherwise(F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0"))),
        F.lit("+00:00"),
    )


def format_local_time(ts: ColumnOrName, tz: str = S.LOCAL_TZ) -> Column:
    """'dd/MM/yyyy HH:mm:ss <zone>' in the local zone; invalid -> fixed label."""
    t = _c(ts)
    return F.when(t.isNull(), F.lit(S.INVALID_TIME_LABEL)).otherwise(
        F.concat(F.date_format(F.from_utc_timestamp(t, tz), S.LOCAL_TIME_FORMAT), F.lit(" " + tz))
    )


def format_utc_label(ts: ColumnOrName) -> Column:
    t = _c(ts)
    return F.when(t.isNull(), F.lit(S.INVALID_TIME_LABEL)).otherwise(
        F.concat(F.date_format(t, S.LOCAL_TIME_FORMAT), F.lit(" UTC"))
    )


def freshness(ts: ColumnOrName, as_of: Column, minutes: int = S.FRESHNESS_MINUTES) -> Column:
    """fresh when younger than ``minutes`` at ``as_of``, stale otherwise, unknown if null."""
    t = _c(ts)
    age_us = F.unix_micros(as_of) - F.unix_micros(t)
    return F.when(t.isNull(), F.lit("unknown")).when(
        age_us < F.lit(minutes * 60_000_000), F.lit("fresh")
    ).otherwise(F.lit("stale"))


def report_freshness(generated_at: ColumnOrName, as_of: Column, minutes: int = S.FRESHNESS_MINUTES) -> Column:
    """Freshness of a report from its ``generated_at`` text."""
    ts = F.try_to_timestamp(nonempty(strip_ws(generated_at)))
    return freshness(ts, as_of, minutes)


def shorten_title(title: ColumnOrName, max_len: int = S.TITLE_MAX_LEN) -> Column:
    """Strip; longer than max_len -> first max_len-1 chars, right-stripped, + '…'."""
    t = strip_ws(title)
    return F.when(F.length(t) <= max_len, t).otherwise(
        F.concat(rstrip_ws(F.substring(t, 1, max_len - 1)), F.lit("…"))
    )


def page_label(title: ColumnOrName, wiki: ColumnOrName) -> Column:
    """'title (wiki)'."""
    return F.concat(_c(title), F.lit(" ("), _c(wiki), F.lit(")"))
