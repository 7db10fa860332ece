"""DuckDB SQL oracles for the registered queries.

Each string runs on the pre-registered test views (``events`` ...) and must
return the same columns (names and values) as the Spark query of the same
key.  The fixture adapter is written out once as CTE text and shared.
"""

from __future__ import annotations

from recentlake import schema as S
from recentlake.sources.testdata import AS_OF_US, EPOCH_US, HOT_EVERY, HOT_MINUTE_US, LONG_TITLE, TIME_COMPRESSION

# events -> processed events (same rules as recentlake.sources.testdata).
_BASE = f"""
SELECT event_id,
 CASE WHEN event_id%101=0 THEN NULL WHEN event_id%53=0 THEN 'p'||json_extract_string(props,'$.k')
      WHEN event_id%71=6 THEN 'page_'||json_extract_string(props,'$.k')||'{LONG_TITLE}'
      WHEN event_id%{HOT_EVERY}=8 THEN 'hot_page' ELSE 'page_'||json_extract_string(props,'$.k') END AS title,
 CASE WHEN event_id%{HOT_EVERY}=8 THEN 'enwiki' WHEN event_id%97=0 THEN NULL WHEN event_id%89=0 THEN 'unknown' WHEN event_id%83=0 THEN ''
      WHEN user_id%5=0 THEN 'enwiki' WHEN user_id%5=1 THEN 'frwiki' WHEN user_id%5=2 THEN 'dewiki'
      WHEN user_id%5=3 THEN 'wikidatawiki' ELSE 'meta.example.org' END AS wiki,
 CASE WHEN event_id%103=0 THEN NULL WHEN user_id%13=0 THEN '10.0.0.'||CAST(user_id AS VARCHAR)
      ELSE 'user_'||CAST(user_id AS VARCHAR) END AS "user",
 CASE WHEN event_id%107=0 THEN NULL ELSE user_id%7=0 END AS is_bot,
 CASE WHEN event_id%109=0 THEN NULL ELSE user_id%13=0 END AS is_anonymous,
 CASE event_type WHEN 'view' THEN 'edit' WHEN 'click' THEN 'Annotate' WHEN 'signup' THEN 'new'
      WHEN 'error' THEN 'delete' ELSE 'categorize' END AS event_type,
 CASE WHEN event_id%113=0 THEN NULL
      WHEN event_id%{HOT_EVERY}=8 THEN {HOT_MINUTE_US} + (event_id * 104729) % 60000000
      ELSE {EPOCH_US} + (epoch_us(ts) - {EPOCH_US}) // {TIME_COMPRESSION} END AS event_us,
 CAST(event_id%3 AS INTEGER) AS kafka_partition, event_id // 3 AS kafka_offset,
 CASE WHEN event_id%127=0 THEN NULL ELSE json_extract_string(props,'$.k') END AS page_id,
 user_id
FROM events
"""


def iso(us: str) -> str:
    """ISO-8601 text of a µs column, fraction only when non-zero."""
    return (
        f"(strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || "
        f"CASE WHEN {us} % 1000000 = 0 THEN '' ELSE '.' || lpad(CAST({us} % 1000000 AS VARCHAR), 6, '0') END"
        f" || '+00:00')"
    )


EV = f"""ev AS (
SELECT *, make_timestamp(event_us) AS event_time, {iso('event_us')} AS ingestion_timestamp
FROM ({_BASE}) b
)"""

AS_OF_TS = f"make_timestamp({AS_OF_US})"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join((EV,) + ctes) + "\n"


PAGE_T = "coalesce(nullif(title,''),'unknown')"
PAGE_W = "coalesce(nullif(wiki,''),'unknown')"
USER_K = "coalesce(nullif(\"user\",''),'unknown')"
LANG = (
    "CASE WHEN wiki IS NULL OR wiki = '' THEN 'unknown' "
    "WHEN regexp_replace(wiki, '^\\s+|\\s+$', '', 'g') LIKE '%wiki' "
    "AND length(regexp_replace(wiki, '^\\s+|\\s+$', '', 'g')) > 4 "
    "THEN left(regexp_replace(wiki, '^\\s+|\\s+$', '', 'g'), length(regexp_replace(wiki, '^\\s+|\\s+$', '', 'g')) - 4) "
    "ELSE regexp_replace(wiki, '^\\s+|\\s+$', '', 'g') END"
)


def _pct(part: str, total: str) -> str:
    return f"CASE WHEN {total} > 0 THEN round(CAST({part} AS DOUBLE) / CAST({total} AS DOUBLE) * 100.0, 2) ELSE 0.0 END"


def _top(counts_sql: str, keys: list[str], count_col: str, n: int | None, select: str) -> str:
    order = ", ".join([f"{count_col} DESC"] + [f"{k} ASC NULLS FIRST" for k in keys])
    limit = f" LIMIT {n}" if n is not None else ""
    return (
        f"SELECT {select} FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({counts_sql}) c) r "
        f"WHERE true ORDER BY rank{limit}"
    )


def _pages(where: str = "true") -> str:
    return (
        f"SELECT {PAGE_T} AS title, {PAGE_W} AS wiki, count(*) AS edit_count FROM ev WHERE {where} GROUP BY 1, 2"
    )


CREATE_IN = "lower(event_type) IN ('new','create')"
DELETE_IN = "lower(event_type) IN ('delete','remove')"

REPORTS: dict[str, str] = {
    "batch_summary": _with()
    + "SELECT count(*) AS total_events, count_if(is_bot = true) AS bot_events, "
    "count_if(is_bot = false) AS human_events FROM ev",
    "batch_by_wiki": _with() + "SELECT wiki, count(*) AS event_count FROM ev GROUP BY wiki",
    "activity_by_minute": _with()
    + "SELECT coalesce(strftime(event_time, '%Y-%m-%d %H:%M'), 'unknown') AS minute, count(*) AS event_count "
    "FROM ev GROUP BY 1",
    "activity_by_hour": _with()
    + "SELECT coalesce(strftime(event_time, '%Y-%m-%d %H:00'), 'unknown') AS hour, count(*) AS event_count "
    "FROM ev GROUP BY 1",
    "language_distribution": _with() + f"SELECT {LANG} AS language, count(*) AS event_count FROM ev GROUP BY 1",
    "activity_by_wiki": _with() + f"SELECT {PAGE_W} AS wiki, count(*) AS event_count FROM ev GROUP BY 1",
    "top_pages": _with() + _top(_pages(), ["title", "wiki"], "edit_count", S.TOP_LIMIT, "rank, title, wiki, edit_count"),
    "most_created_pages": _with()
    + _top(_pages(CREATE_IN), ["title", "wiki"], "edit_count", S.TOP_LIMIT, "rank, title, wiki, edit_count"),
    "most_deleted_pages": _with()
    + _top(_pages(DELETE_IN), ["title", "wiki"], "edit_count", S.TOP_LIMIT, "rank, title, wiki, edit_count"),
    "top_contributors": _with()
    + _top(
        f"SELECT {USER_K} AS \"user\", count(*) AS edit_count FROM ev WHERE NOT coalesce(is_bot, false) GROUP BY 1",
        ['"user"'], "edit_count", S.TOP_LIMIT, 'rank, "user", edit_count',
    ),
    "bots_vs_humans": _with()
    + "SELECT bots, total - bots AS humans, " + _pct("bots", "total") + " AS bot_percentage FROM "
    "(SELECT count(*) AS total, count_if(coalesce(is_bot, false)) AS bots FROM ev) c",
    "anonymous_vs_logged": _with()
    + "SELECT anonymous, total - anonymous AS logged_in, " + _pct("anonymous", "total") + " AS anonymous_percentage, "
    + _pct("total - anonymous", "total") + " AS logged_in_percentage FROM "
    "(SELECT count(*) AS total, count_if(coalesce(is_anonymous, false)) AS anonymous FROM ev) c",
    "bot_ratio": _with()
    + "SELECT total AS total_events, bots AS bot_volume, total - bots AS human_volume, "
    + _pct("bots", "total") + " AS bot_percentage FROM "
    "(SELECT count(*) AS total, count_if(coalesce(is_bot, false)) AS bots FROM ev) c",
    "active_bots": _with()
    + _top(
        "SELECT coalesce(nullif(\"user\",''),'unknown_bot') AS bot_user, count(*) AS edit_count FROM ev "
        "WHERE coalesce(is_bot, false) GROUP BY 1",
        ["bot_user"], "edit_count", S.TOP_LIMIT, "rank, bot_user, edit_count",
    ),
    "daily_global": _with()
    + f"SELECT strftime({AS_OF_TS}, '%Y-%m-%d') AS report_date, total AS total_events, bots, total - bots AS humans, "
    + _pct("bots", "total") + " AS bot_percentage FROM "
    "(SELECT count(*) AS total, count_if(coalesce(is_bot, false)) AS bots FROM ev) c",
    "daily_top_pages": _with()
    + _top(_pages(), ["title", "wiki"], "edit_count", S.DAILY_TOP_LIMIT,
           "rank, title || ' (' || wiki || ')' AS page, edit_count"),
    "daily_top_users": _with()
    + _top(f"SELECT {USER_K} AS \"user\", count(*) AS edit_count FROM ev GROUP BY 1",
           ['"user"'], "edit_count", S.DAILY_TOP_LIMIT, 'rank, "user", edit_count'),
    "daily_traffic": _with()
    + _top("SELECT strftime(event_time, '%Y-%m-%d %H:00') AS hour, count(*) AS event_count FROM ev "
           "WHERE event_time IS NOT NULL GROUP BY 1",
           ["hour"], "event_count", None, "rank, hour, event_count"),
}


# ---------------------------------------------------------------------------
# Anomaly rules
# ---------------------------------------------------------------------------

_ANOM_TYPES = {f.name: {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE"}[f.dataType.simpleString()]
               for f in S.ANOMALY.fields}


def _anom(values: dict[str, str], phase: int, seq: str, rule: int, src: str, where: str = "true",
          extra: str = "") -> str:
    cols = []
    for name, typ in _ANOM_TYPES.items():
        cols.append(f"CAST({values.get(name, 'NULL')} AS {typ}) AS \"{name}\"")
    cols += [f"{phase} AS _phase", f"{seq} AS _seq", f"{rule} AS _rule"]
    return f"SELECT {', '.join(cols)} FROM {src} WHERE {where} {extra}"


KEYED = (
    f"k AS (SELECT *, {PAGE_T} AS _title, {PAGE_W} AS _wiki, coalesce(event_us, {AS_OF_US}) AS _us, "
    f"event_id AS _seq FROM ev)"
)
STAMP = iso("_us")
STRIP_WIKI = "regexp_replace(wiki, '^\\s+|\\s+$', '', 'g')"


def _sev(c: str) -> str:
    return f"CASE WHEN {c} >= 10 THEN 'high' WHEN {c} >= 5 THEN 'medium' ELSE 'low' END"


EVENT_RULE_SQL = {
    "wiki_null": _anom(
        {"type": "'data_anomaly'", "page": "_title", "severity": "'high'", "timestamp": STAMP,
         "reason": "'wiki_null'", "wiki": "wiki"}, 0, "_seq", 0, "k",
        f"wiki IS NULL OR {STRIP_WIKI} = ''"),
    "unknown_language": _anom(
        {"type": "'data_anomaly'", "page": "_title", "severity": "'medium'", "timestamp": STAMP,
         "reason": "'unknown_language'", "wiki": "wiki"}, 0, "_seq", 1, "k",
        f"wiki IS NOT NULL AND wiki <> '' AND ({LANG}) = 'unknown'"),
    "incoherent_timestamp": _anom(
        {"type": "'data_anomaly'", "page": "_title", "severity": "'high'", "timestamp": STAMP,
         "reason": "'incoherent_timestamp'", "ingestion_timestamp": "coalesce(ingestion_timestamp, 'None')"},
        0, "_seq", 3, "k", f"event_us IS NOT NULL AND event_us > {AS_OF_US} + 300000000"),
    "short_title_repeated": _anom(
        {"type": "'spam_heuristic'", "page": "_title", "severity": "'low'", "timestamp": STAMP,
         "reason": "'short_title_repeated'", "title": "_title", "user": USER_K}, 0, "_seq", 4, "k",
        "length(coalesce(nullif(title,''),'')) <= 5"),
}


def _windowed(name: str, width_us: int) -> str:
    return (
        f"{name} AS (SELECT _title, _wiki, _us, count(*) OVER wf AS c, max(_us) OVER wf AS last_us, "
        f"count(*) OVER p AS n, min(_us) OVER p AS first_us, max(_us) OVER p AS page_last, min(_seq) OVER p AS pseq "
        f"FROM k WINDOW wf AS (PARTITION BY _title, _wiki ORDER BY _us RANGE BETWEEN CURRENT ROW AND {width_us} "
        f"FOLLOWING), p AS (PARTITION BY _title, _wiki))"
    )


SPIKE_CTES = (
    _windowed("w5", 300_000_000),
    "sb AS (SELECT *, greatest(CAST(1.0 AS DOUBLE), n / greatest(CAST(1.0 AS DOUBLE), "
    "CAST(page_last - first_us AS DOUBLE) / CAST(1000000.0 AS DOUBLE) / CAST(60.0 AS DOUBLE))) AS baseline FROM w5)",
)
SPIKE_SQL = _anom(
    {"type": "'edit_spike'", "page": "_title", "severity": _sev("c"), "timestamp": iso("last_us"),
     "edit_count": "c", "window": "'5min'", "wiki": "_wiki", "ratio_vs_baseline": "round(c / baseline, 2)"},
    1, "pseq", 0, "sb", "n >= 4 AND c >= 3 AND CAST(c AS DOUBLE) >= baseline * 3.0",
    "QUALIFY row_number() OVER (PARTITION BY _title, _wiki ORDER BY _us) = 1")
RAPID_CTES = (_windowed("w2", 120_000_000),)
RAPID_SQL = _anom(
    {"type": "'spam_heuristic'", "page": "_title", "severity": "'high'", "timestamp": iso("last_us"),
     "edit_count": "c", "window": "'2min'", "wiki": "_wiki", "reason": "'rapid_page_edits'"},
    2, "pseq", 0, "w2", "c >= 5", "QUALIFY row_number() OVER (PARTITION BY _title, _wiki ORDER BY _us) = 1")
BOT_CTES = (
    "bm AS (SELECT strftime(make_timestamp(_us), '%Y-%m-%d %H:%M') AS minute, count(*) AS n, min(_seq) AS mseq "
    "FROM k WHERE coalesce(is_bot, false) GROUP BY 1 HAVING count(*) >= 30)",
)
BOT_SQL = _anom(
    {"type": "'bot_behavior_anomaly'", "page": "'multiple'", "severity": "'high'",
     "timestamp": "minute || ':00+00:00'", "edits_per_minute": "n", "threshold": "30",
     "reason": "'bot_high_edit_rate'"}, 3, "mseq", 0, "bm")

PUBLIC = ", ".join(f'"{c}"' for c in S.ANOMALY_COLUMNS)


def _rule_query(ctes: tuple[str, ...], body: str) -> str:
    return _with(KEYED, *ctes) + f"SELECT {PUBLIC} FROM ({body}) x"


ALL_HITS = " UNION ALL ".join(
    [f"({q})" for q in EVENT_RULE_SQL.values()] + [f"({SPIKE_SQL})", f"({RAPID_SQL})", f"({BOT_SQL})"]
)
DETECT_BODY = (
    f"SELECT * FROM ({ALL_HITS}) h "
    f"QUALIFY row_number() OVER (PARTITION BY \"type\", page, \"timestamp\" ORDER BY _phase, _seq, _rule) = 1"
)

ANOMALIES: dict[str, str] = {
    "rule_wiki_null": _rule_query((), EVENT_RULE_SQL["wiki_null"]),
    "rule_unknown_language": _rule_query((), EVENT_RULE_SQL["unknown_language"]),
    "rule_future_timestamp": _rule_query((), EVENT_RULE_SQL["incoherent_timestamp"]),
    "rule_short_title": _rule_query((), EVENT_RULE_SQL["short_title_repeated"]),
    "rule_edit_spike": _rule_query(SPIKE_CTES, SPIKE_SQL),
    "rule_rapid_edits": _rule_query(RAPID_CTES, RAPID_SQL),
    "rule_bot_rate": _rule_query(BOT_CTES, BOT_SQL),
    "detect_anomalies": _rule_query(SPIKE_CTES + RAPID_CTES + BOT_CTES, DETECT_BODY),
    "anomaly_report": _with(KEYED, *SPIKE_CTES, *RAPID_CTES, *BOT_CTES)
    + f"SELECT {iso(str(AS_OF_US))} AS generated_at, (SELECT count(*) FROM ev) AS events_analyzed, "
    f"(SELECT count(*) FROM ({DETECT_BODY}) d) AS anomaly_count",
}


# ---------------------------------------------------------------------------
# Ingestion (raw feed built from the events table, parsed back from JSON)
# ---------------------------------------------------------------------------

def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _jx(path: str) -> str:
    return f"try(json_extract_string(value, '{path}'))"


RAW_CTES = (
    f"rb AS ({_BASE})",
    "raw AS (SELECT event_id, CASE WHEN event_id%211=5 THEN '{bad' WHEN event_id%223=7 THEN '[1]' "
    "ELSE doc END AS value, event_id%61=3 AS odd_bot, event_id%59=4 AS odd_user, event_id%67=5 AS twice FROM "
    "(SELECT *, CAST(to_json(struct_pack(title := CASE WHEN event_id%229=9 THEN '   ' ELSE title END, wiki := wiki, "
    "server_name := CASE WHEN event_id%7=1 THEN 'srv'||CAST(user_id%5 AS VARCHAR)||'.example.org' END, "
    "\"timestamp\" := CASE WHEN event_id%2=0 THEN event_us // 1000000 END, \"user\" := \"user\", "
    "userid := CASE WHEN event_id%31=0 THEN 0 ELSE user_id END, bot := is_bot, anonymous := is_anonymous, "
    "\"type\" := event_type, page_id := CAST(page_id AS BIGINT), "
    "meta := struct_pack(domain := CASE WHEN event_id%11=2 THEN 'meta-domain.example.org' END, "
    f"dt := CASE WHEN event_id%2=1 AND event_us IS NOT NULL THEN {iso('event_us')} END, "
    "id := CASE WHEN event_id%3<>0 THEN 'evt-'||CAST(event_id AS VARCHAR) END))) AS VARCHAR) AS doc FROM rb) d)",
    "p AS (SELECT event_id, value, json_valid(value) AS json_ok, "
    "json_valid(value) AND regexp_matches(value, '^\\s*\\{') AS is_object, "
    f"{_jx('$.title')} AS e_title, {_jx('$.wiki')} AS e_wiki, {_jx('$.server_name')} AS e_server, "
    f"{_jx('$.timestamp')} AS e_ts, {_jx('$.user')} AS e_user, "
    f"CASE WHEN odd_user AND NOT odd_bot THEN NULL ELSE try(CAST({_jx('$.userid')} AS BIGINT)) END AS e_userid, "
    f"CASE WHEN odd_bot AND {_jx('$.bot')} IS NOT NULL THEN true ELSE try(CAST({_jx('$.bot')} AS BOOLEAN)) END AS e_bot, "
    f"CASE WHEN odd_user AND NOT odd_bot THEN NULL ELSE try(CAST({_jx('$.anonymous')} AS BOOLEAN)) END AS e_anon, "
    f"CASE WHEN twice AND NOT odd_bot AND NOT odd_user THEN 'edit' ELSE {_jx('$.type')} END AS e_type, {_jx('$.page_id')} AS e_page_id, {_jx('$.meta.domain')} AS e_domain, "
    f"{_jx('$.meta.dt')} AS e_dt, {_jx('$.meta.id')} AS e_meta_id FROM raw)",
    f"v AS (SELECT *, nullif({_strip('e_title')}, '') AS c_title, "
    "coalesce(nullif(e_wiki,''), nullif(e_server,''), nullif(e_domain,'')) AS x_wiki, "
    "coalesce(e_ts, e_dt) AS x_ts, "
    "coalesce(e_anon, false) OR coalesce(e_userid = 0, false) "
    "OR coalesce(regexp_matches(e_user, '^\\d{1,3}(\\.\\d{1,3}){3}$'), false) AS x_anon FROM p)",
    "vr AS (SELECT *, CASE WHEN NOT json_ok THEN 'invalid_json' WHEN NOT is_object THEN 'json_not_object' "
    "WHEN c_title IS NULL THEN 'missing_or_empty_title' WHEN x_wiki IS NULL THEN 'missing_wiki' "
    "WHEN x_ts IS NULL THEN 'missing_timestamp' END AS error_reason FROM v)",
    f"enr AS (SELECT event_id, {iso(str(AS_OF_US))} AS ingestion_timestamp, '{S.DEFAULT_SOURCE}' AS source, "
    + _strip("coalesce(x_wiki, 'unknown')") + " AS partition_key, coalesce(e_bot, false) AS is_bot, "
    "x_anon AS is_anonymous, coalesce(e_type, 'unknown') AS event_type, coalesce(x_wiki, 'unknown') AS wiki, "
    "coalesce(c_title, 'unknown') AS title, coalesce(e_user, 'unknown') AS \"user\", "
    "coalesce(e_page_id, e_meta_id) AS page_id FROM vr WHERE error_reason IS NULL)",
    "errs AS (SELECT event_id, error_reason, CASE WHEN error_reason IN ('invalid_json','json_not_object') "
    f"THEN 'unknown' ELSE coalesce({_strip('x_wiki')}, 'unknown') END AS partition_key, "
    "true AS raw_is_line, CASE WHEN error_reason NOT IN ('invalid_json','json_not_object') THEN true END AS partial_is_line FROM vr "
    "WHERE error_reason IS NOT NULL)",
    "msgs AS (SELECT event_id, 'wm.recentchange.raw' AS topic, partition_key AS key FROM enr "
    "UNION ALL SELECT event_id, 'wm.bot.events', partition_key FROM enr WHERE is_bot "
    "UNION ALL SELECT event_id, 'wm.page.edits', partition_key FROM enr WHERE lower(event_type) IN ('edit','annotate') "
    "UNION ALL SELECT event_id, 'wm.errors', partition_key FROM errs)",
)


def _ingest(body: str) -> str:
    return "WITH " + ",\n".join(RAW_CTES) + "\n" + body


INGEST: dict[str, str] = {
    "validate_events": _ingest("SELECT event_id, error_reason FROM vr"),
    "enrich_events": _ingest("SELECT *, true AS payload_is_line FROM enr"),
    "extract_wiki": _ingest("SELECT event_id, x_wiki AS wiki FROM vr WHERE is_object"),
    "is_anonymous": _ingest("SELECT event_id, x_anon AS is_anonymous FROM vr WHERE is_object"),
    "error_records": _ingest("SELECT * FROM errs"),
    "route_topics": _ingest(
        "SELECT m.event_id, topic, key, r.title AS value_title, r.wiki AS value_wiki, r.\"user\" AS value_user, "
        "CAST(r.is_bot AS VARCHAR) AS value_is_bot, CAST(r.is_anonymous AS VARCHAR) AS value_is_anonymous, "
        "r.event_type AS value_event_type, r.page_id AS value_page_id, e.error_reason AS value_error_reason, "
        "true AS value_has_line FROM msgs m LEFT JOIN enr r ON m.event_id = r.event_id "
        "LEFT JOIN errs e ON m.event_id = e.event_id"),
    "decode_kafka": _ingest(
        "SELECT key AS kafka_key, topic AS kafka_topic, m.event_id AS kafka_offset, r.title, r.wiki, r.\"user\", "
        "r.is_bot, r.is_anonymous, r.event_type, coalesce(r.ingestion_timestamp, " + iso(str(AS_OF_US)) + ") AS ingestion_timestamp, "
        f"r.page_id, CAST({AS_OF_US} AS BIGINT) AS event_us FROM msgs m LEFT JOIN enr r ON m.event_id = r.event_id"),
    "invalid_rate": _ingest(
        "SELECT errors AS ingestion_errors, total AS total_events, "
        "round(CAST(errors AS DOUBLE) / CAST(greatest(1, errors + total) AS DOUBLE) * 100.0, 2) "
        "AS invalid_events_rate_pct FROM (SELECT count_if(error_reason IS NOT NULL) AS errors, "
        "count_if(error_reason IS NULL) AS total FROM vr) c"),
    "rule_missing_page_id": _ingest(
        "SELECT " + ", ".join(
            f"CAST({v} AS {_ANOM_TYPES[k]}) AS \"{k}\"" for k, v in {
                "type": "'data_anomaly'", "page": "title", "severity": "'medium'",
                "timestamp": iso(str(AS_OF_US)), "reason": "'missing_page_id'"}.items())
        + ", " + ", ".join(f"CAST(NULL AS {t}) AS \"{k}\"" for k, t in _ANOM_TYPES.items()
                           if k not in ("type", "page", "severity", "timestamp", "reason"))
        + " FROM enr WHERE page_id IS NULL"),
    "topic_volumes": _ingest(
        "SELECT t.topic, coalesce(c.n, 0) AS message_count FROM (VALUES ('wm.recentchange.raw'), ('wm.bot.events'), "
        "('wm.page.edits'), ('wm.errors')) t(topic) LEFT JOIN (SELECT topic, count(*) AS n FROM msgs GROUP BY 1) c "
        "ON t.topic = c.topic"),
}


# ---------------------------------------------------------------------------
# Live views and monitoring
# ---------------------------------------------------------------------------

def _utc_label(us: str, ts: str) -> str:
    return f"CASE WHEN {us} IS NULL THEN 'timestamp invalide' ELSE strftime({ts}, '%d/%m/%Y %H:%M:%S') || ' UTC' END"


def _local_label(us: str, ts: str) -> str:
    return (
        f"CASE WHEN {us} IS NULL THEN 'timestamp invalide' ELSE "
        f"strftime(timezone('Europe/Paris', timezone('UTC', {ts})), '%d/%m/%Y %H:%M:%S') || ' Europe/Paris' END"
    )


def _shorten(t: str) -> str:
    st = _strip(t)
    return (
        f"CASE WHEN length({st}) <= 50 THEN {st} "
        f"ELSE regexp_replace(left({st}, 49), '\\s+$', '', 'g') || '…' END"
    )


NEWEST = "coalesce(event_us, 0) DESC, kafka_partition ASC, kafka_offset ASC"
BUF = f"buf AS (SELECT * FROM ev ORDER BY {NEWEST} LIMIT {S.LIVE_MAX_EVENTS})"
OFFSETS = (
    "eo AS (SELECT 'wm.recentchange.raw' AS topic, kafka_partition AS \"partition\", max(kafka_offset) + 1 "
    "AS end_offset FROM ev GROUP BY 1, 2)",
    "co AS (SELECT 'wm.recentchange.raw' AS topic, kafka_partition AS \"partition\", max(kafka_offset) + 1 "
    f"AS committed_offset FROM ev WHERE event_time <= {AS_OF_TS} GROUP BY 1, 2)",
)

LIVE: dict[str, str] = {
    "dedupe_offsets": _with("d AS (SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE event_id % 50 = 0)")
    + "SELECT event_id, kafka_partition, kafka_offset, title, wiki FROM d "
    "QUALIFY row_number() OVER (PARTITION BY kafka_partition, kafka_offset ORDER BY event_id) = 1",
    "latest_events": _with()
    + f"SELECT title, wiki, \"user\", event_type, is_bot, {_utc_label('event_us', 'event_time')} AS ingestion_utc, "
    f"{_local_label('event_us', 'event_time')} AS ingestion_local FROM ev ORDER BY {NEWEST} LIMIT {S.LIVE_TABLE_ROWS}",
    "latest_event": _with()
    + f"SELECT coalesce(ingestion_timestamp, '—') AS latest_raw, {_utc_label('event_us', 'event_time')} AS latest_utc, "
    f"{_local_label('event_us', 'event_time')} AS latest_local FROM ev "
    "ORDER BY coalesce(event_us, 0) DESC, kafka_partition DESC, kafka_offset DESC LIMIT 1",
    "live_top_pages": _with(BUF)
    + _top("SELECT coalesce(nullif(title,''),'?') AS title, coalesce(nullif(wiki,''),'?') AS wiki, "
           "count(*) AS edit_count FROM buf GROUP BY 1, 2", ["title", "wiki"], "edit_count", S.LIVE_TOP_N,
           f"rank, {_shorten('title')} || ' (' || wiki || ')' AS page, edit_count"),
    "live_by_wiki": _with(BUF)
    + _top(f"SELECT {PAGE_W} AS wiki, count(*) AS event_count FROM buf GROUP BY 1", ["wiki"], "event_count",
           S.LIVE_TOP_N, "rank, wiki, event_count"),
    "live_metrics": _with(BUF)
    + "SELECT count(*) AS buffered, count_if(coalesce(is_bot, false)) AS bots, "
    "count(*) - count_if(coalesce(is_bot, false)) AS humans FROM buf",
    "shorten_title": _with() + "SELECT event_id, " + _shorten("coalesce(nullif(title,''),'?')")
    + " AS short_title FROM ev",
    "format_local_time": _with() + f"SELECT event_id, {_local_label('event_us', 'event_time')} AS local_time FROM ev",
    "data_freshness": _with()
    + f"SELECT CASE WHEN latest IS NOT NULL THEN {iso('latest')} END AS latest_event_time, "
    f"CASE WHEN latest IS NULL THEN 'unknown' WHEN {AS_OF_US} - latest < 600000000 THEN 'fresh' ELSE 'stale' END "
    "AS status FROM (SELECT max(event_us) AS latest FROM ev) m",
    "offset_lag": _with(*OFFSETS)
    + "SELECT eo.topic, eo.\"partition\", end_offset, coalesce(committed_offset, 0) AS committed_offset, "
    "greatest(0, end_offset - coalesce(committed_offset, 0)) AS lag FROM eo LEFT JOIN co "
    "ON eo.topic = co.topic AND eo.\"partition\" = co.\"partition\"",
    "topic_end_volume": _with(*OFFSETS) + "SELECT topic, CAST(sum(end_offset) AS BIGINT) AS volume FROM eo GROUP BY 1",
}


def _own_time(sql: str) -> str:
    """The same query on the events' own 30 days."""
    return sql.replace(f"// {TIME_COMPRESSION} END", "// 1 END")


_HOURS = ("SELECT strftime(event_time, '%Y-%m-%d %H:00') AS hour, count(*) AS event_count FROM ev "
          "WHERE event_time IS NOT NULL GROUP BY 1")

LAKE: dict[str, str] = {
    "load_events": _with()
    + f"SELECT wiki AS kafka_key, '{S.TOPIC_RAW}' AS kafka_topic, kafka_partition, kafka_offset, title, wiki, \"user\", "
    "is_bot, is_anonymous, event_type, ingestion_timestamp, "
    f"'{S.DEFAULT_SOURCE}' AS source, wiki AS partition_key, page_id, event_us FROM ev",
    "global_activity": "SELECT count(*) AS total_events, 1 AS files_read, 'events.parquet' AS source_name FROM events",
    "activity_by_hour_30_days": _own_time(REPORTS["activity_by_hour"]),
    "daily_traffic_30_days": _own_time(_with() + _top(_HOURS, ["hour"], "event_count", None, "rank, hour, event_count")),
    "daily_traffic_largest": _own_time(_with() + _top(_HOURS, ["hour"], "event_count", S.DAILY_HOURS_LIMIT, "rank, hour, event_count")),
    "live_bot_share": _with(BUF)
    + "SELECT bots, n - bots AS humans, " + _pct("bots", "n") + " AS bot_percentage FROM "
    "(SELECT count(*) AS n, count_if(coalesce(is_bot, false)) AS bots FROM buf) c",
    "newest_keys": _with(BUF) + "SELECT CAST(kafka_partition AS BIGINT) AS kafka_partition, kafka_offset, "
    "coalesce(event_us, 0) AS event_us FROM buf",
}

# Customers as DAGs, orders as runs, line items as task runs.
RUN_CTES = (
    "runs AS (SELECT 'dag_' || o_custkey AS dag_id, 'run_' || o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'failed' "
    "WHEN 'O' THEN 'success' ELSE 'running' END AS state, o_orderdate AS start_date, o_custkey % 5 = 0 AS is_paused FROM orders)",
    "tasks AS (SELECT 'dag_' || o_custkey AS dag_id, 'run_' || l_orderkey AS run_id, CASE l_returnflag WHEN 'R' THEN 'failed' "
    "ELSE 'success' END AS state, CAST(l_quantity AS DOUBLE) AS duration_sec FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "dags AS (SELECT DISTINCT 'dag_' || c_custkey AS dag_id FROM customer)",
    "last AS (SELECT d.dag_id, run_id, state, is_paused FROM dags d LEFT JOIN (SELECT * FROM runs QUALIFY "
    "row_number() OVER (PARTITION BY dag_id ORDER BY start_date DESC, run_id DESC) = 1) r ON d.dag_id = r.dag_id)",
    "per_run AS (SELECT dag_id, run_id, count(*) AS n, count_if(state = 'failed') AS failed, avg(duration_sec) AS mean "
    "FROM tasks GROUP BY 1, 2)",
)


def _runs(body: str) -> str:
    return "WITH " + ",\n".join(RUN_CTES) + "\n" + body


RUNS: dict[str, str] = {
    "run_monitoring": _runs(
        "SELECT l.dag_id, is_paused, state AS last_run_state, l.run_id AS last_run_id, coalesce(n, 0) AS task_count, "
        "coalesce(failed, 0) AS failed_tasks, round(CAST(coalesce(failed, 0) AS DOUBLE) / greatest(coalesce(n, 0), 1) * 100.0, 2) "
        "AS failure_rate_pct, round(mean, 2) AS avg_task_duration_sec FROM last l LEFT JOIN per_run p "
        "ON l.dag_id = p.dag_id AND l.run_id = p.run_id"),
    "run_summary": _runs(
        "SELECT * FROM (SELECT count(*) AS total_dags, count_if(state = 'failed') AS failed_runs, "
        "count_if(state = 'success') AS success_runs FROM last), (SELECT count_if(t.state = 'failed') AS total_task_failures, "
        "coalesce(round(avg(duration_sec), 2), 0.0) AS avg_task_duration_sec FROM tasks t JOIN last l "
        "ON t.dag_id = l.dag_id AND t.run_id = l.run_id)"),
    "pipeline_failure_rate": _runs(
        "SELECT round(CAST(count_if(state = 'failed') AS DOUBLE) / greatest(count(*), 1) * 100.0, 2) AS dag_failure_rate_pct FROM last"),
}


def _section(section: str, item: str, src: str, rank: str = "NULL", key: str = "NULL", value: str = "NULL", text: str = "NULL") -> str:
    return (f"SELECT '{section}' AS section, '{item}' AS item, CAST({rank} AS BIGINT) AS rank, CAST({key} AS VARCHAR) AS key, "
            f"CAST({value} AS DOUBLE) AS value, CAST({text} AS VARCHAR) AS text FROM {src}")


def _ranked(counts: str, keys: list[str], n: int) -> str:
    return "(" + _top(counts, keys, "event_count", n, "*") + ") x"


_STAMP = iso(str(AS_OF_US))
_TOTAL = "(SELECT count(*) AS total, count_if(coalesce(is_bot, false)) AS bots FROM ev) x"
_ERRORS = "(SELECT count(*) AS errors FROM errs) x"
_G, _Q, _T, _Y = "global_activity_report", "quality_report", "traffic_report", "system_report"
DAILY = " UNION ALL ".join(f"({x})" for x in [
    *(_section(s, "generated_at", "(SELECT 1) x", text=_STAMP) for s in (_G, _Q, _T, _Y)),
    _section(_G, "report_date", "(SELECT 1) x", text=f"strftime({AS_OF_TS}, '%Y-%m-%d')"),
    _section(_G, "total_events", _TOTAL, value="total"),
    _section(_G, "files_read", "(SELECT 1) x", value="1"),
    _section(_G, "top_pages", _ranked(f"SELECT {PAGE_T} AS title, {PAGE_W} AS wiki, count(*) AS event_count FROM ev GROUP BY 1, 2",
                                      ["title", "wiki"], S.DAILY_TOP_LIMIT), "rank", "title || ' (' || wiki || ')'", "event_count"),
    _section(_G, "top_users", _ranked(f"SELECT {USER_K} AS u, count(*) AS event_count FROM ev GROUP BY 1", ["u"], S.DAILY_TOP_LIMIT),
             "rank", "u", "event_count"),
    _section(_G, "bots", _TOTAL, value="bots"),
    _section(_G, "humans", _TOTAL, value="total - bots"),
    _section(_G, "bot_percentage", _TOTAL, value=_pct("bots", "total")),
    _section(_Q, "anomalies_detected", f"(SELECT count(*) AS n FROM ({DETECT_BODY}) d) x", value="n"),
    _section(_Q, "ingestion_errors_topic_count", _ERRORS, value="errors"),
    _section(_Q, "invalid_events_rate_pct", f"{_ERRORS}, (SELECT count(*) AS total FROM ev) y",
             value="round(CAST(errors AS DOUBLE) / greatest(1, errors + total) * 100.0, 2)"),
    _section(_Q, "anomalies_sample", f"(SELECT * FROM ({DETECT_BODY}) d ORDER BY \"timestamp\" NULLS FIRST, \"type\" NULLS FIRST, "
             f"page NULLS FIRST, reason NULLS FIRST LIMIT {S.ANOMALY_SAMPLE}) x", key="page",
             text="concat_ws(' ', \"timestamp\", \"type\", severity, reason)"),
    _section(_T, "by_hour", f"(SELECT * FROM ({_HOURS}) h ORDER BY event_count DESC, hour LIMIT {S.DAILY_HOURS_LIMIT}) x",
             key="hour", value="event_count"),
    _section(_T, "by_language", f"(SELECT {LANG} AS k, count(*) AS n FROM ev GROUP BY 1) x", key="k", value="n"),
    _section(_T, "by_wiki", f"(SELECT {PAGE_W} AS k, count(*) AS n FROM ev GROUP BY 1) x", key="k", value="n"),
    _section(_T, "kafka_topic_volumes", "(SELECT t.topic, coalesce(c.n, 0) AS n FROM (VALUES "
             + ", ".join(f"('{t}')" for t in S.TOPICS) + ") t(topic) LEFT JOIN (SELECT topic, count(*) AS n FROM msgs GROUP BY 1) c "
             "ON t.topic = c.topic) x", key="topic", value="n"),
    _section(_Y, "total_lag", "(SELECT sum(lag) AS n FROM lags) x", value="n"),
    _section(_Y, "partition_lag", "lags x", key="topic || '/' || \"partition\"", value="lag"),
])
LAGS = ("lags AS (SELECT eo.topic, eo.\"partition\", greatest(0, end_offset - coalesce(committed_offset, 0)) AS lag FROM eo "
        "LEFT JOIN co ON eo.topic = co.topic AND eo.\"partition\" = co.\"partition\")",)

QUALITY: dict[str, str] = {
    "daily_report": _with(KEYED, *SPIKE_CTES, *RAPID_CTES, *BOT_CTES, *RAW_CTES, *OFFSETS, *LAGS) + f"SELECT * FROM ({DAILY}) r",
    "daily_quality": _with(KEYED, *SPIKE_CTES, *RAPID_CTES, *BOT_CTES, *RAW_CTES)
    + f"SELECT (SELECT count(*) FROM ({DETECT_BODY}) d) AS anomalies_detected, "
    "e.errors AS ingestion_errors_topic_count, "
    "round(CAST(e.errors AS DOUBLE) / CAST(greatest(1, e.errors + t.total) AS DOUBLE) * 100.0, 2) "
    "AS invalid_events_rate_pct FROM (SELECT count(*) AS errors FROM errs) e, (SELECT count(*) AS total FROM ev) t",
}


_PAST = f"past AS (SELECT kafka_partition, kafka_offset FROM ev WHERE event_us <= {AS_OF_US})"
_NEXT = ("nexts AS (SELECT kafka_partition, kafka_offset, lead(kafka_offset) OVER (PARTITION BY kafka_partition ORDER BY kafka_offset) "
         "AS following FROM past)")
_GAPS = ("gaps AS (SELECT kafka_partition, kafka_offset + 1 AS first_missing, following - 1 AS last_missing, "
         "following - kafka_offset - 1 AS missing FROM nexts WHERE following > kafka_offset + 1)")

def _head(section: str, counts: str, label: str, count: str = "event_count") -> str:
    return (f"SELECT '{section}' AS section, rank, label, event_count FROM (SELECT *, row_number() OVER (ORDER BY event_count DESC, label) "
            f"AS rank FROM (SELECT {label} AS label, {count} AS event_count FROM ({counts}) c) n) r WHERE rank <= {S.CHART_HEADS[section]}")


_CHARTS = [
    _head("minute", REPORTS["activity_by_minute"], "minute"), _head("hour", REPORTS["activity_by_hour"], "hour"),
    _head("language", REPORTS["language_distribution"], "language"), _head("wiki", REPORTS["activity_by_wiki"], "wiki"),
    _head("page", _with() + _pages(), "title || ' (' || wiki || ')'", "edit_count"),
    _head("user", _with() + f"SELECT {USER_K} AS u, count(*) AS n FROM ev WHERE NOT coalesce(is_bot, false) GROUP BY 1", "u", "n"),
    _head("bot", _with() + "SELECT coalesce(nullif(\"user\",''),'unknown_bot') AS u, count(*) AS n FROM ev WHERE coalesce(is_bot, false) GROUP BY 1",
          "u", "n"),
]

CARRIED: dict[str, str] = {
    "chart_heads": " UNION ALL ".join(f"({q})" for q in _CHARTS),
    "top_pages_of_many": REPORTS["top_pages"],
    "top_pages_bucketed": REPORTS["top_pages"],
    "page_rules_bucketed": _rule_query(SPIKE_CTES + RAPID_CTES, f"({SPIKE_SQL}) UNION ALL ({RAPID_SQL})"),
    "missing_page_id_variant": INGEST["rule_missing_page_id"],
    "ingest_counts": f"SELECT ingestion_errors + total_events AS total, total_events AS valid, ingestion_errors AS invalid "
    f"FROM ({INGEST['invalid_rate']}) r",
    **{f"{name}_carried": REPORTS[name] for name in ("activity_by_hour", "top_pages", "active_bots", "bots_vs_humans")},
    **{f"{name}_carried": ANOMALIES[name] for name in ("detect_anomalies", "anomaly_report")},
    "new_messages": _with() + "SELECT event_id, kafka_partition, kafka_offset, title FROM ev "
    f"WHERE event_us IS NULL OR event_us > {AS_OF_US}",
    "offset_gaps": _with(_PAST, _NEXT, _GAPS) + "SELECT * FROM gaps",
    "offset_volumes": _with(_PAST, _NEXT, _GAPS)
    + "SELECT p.*, coalesce(g.missing, 0) AS missing FROM (SELECT kafka_partition, count(*) AS messages, max(kafka_offset) + 1 AS end_offset "
    "FROM past GROUP BY 1) p LEFT JOIN (SELECT kafka_partition, CAST(sum(missing) AS BIGINT) AS missing FROM gaps GROUP BY 1) g "
    "ON p.kafka_partition = g.kafka_partition",
    "stream_bursts": _with(KEYED, *SPIKE_CTES, *RAPID_CTES, *BOT_CTES)
    + "SELECT " + ", ".join(f'"{c}"' for c in S.ANOMALY_COLUMNS) + f" FROM ({DETECT_BODY}) d WHERE \"type\" = '{S.ANOMALY_SPIKE}' OR reason = '{S.RULE_RAPID_EDITS}'",
}


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    out.update(REPORTS)
    out.update(ANOMALIES)
    out.update(INGEST)
    out.update(LIVE)
    out.update(QUALITY)
    out.update(LAKE)
    out.update(RUNS)
    out.update(CARRIED)
    return out
