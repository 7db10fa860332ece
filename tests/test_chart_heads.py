"""Heads of the charts: limits, ties, and the rank's bound below the exchange."""

from collections import Counter

from conftest import make_events

from recentlake import schema as S
from recentlake.operators import reports as R


def test_heads_equal_counts_cut_by_section(spark):
    rows = [{"title": f"p{i % 40}", "wiki": ["enwiki", "frwiki", None][i % 3], "user": f"u{i % 23}", "is_bot": i % 4 == 0, "t": i * 61}
            for i in range(500)] + [{"title": None, "user": None, "is_bot": None, "t": None}]
    got = R.chart_heads(make_events(spark, rows)).collect()
    humans = Counter(r["user"] or "unknown" for r in rows if not r["is_bot"])
    bots = Counter(r["user"] or "unknown_bot" for r in rows if r["is_bot"])
    pages = Counter(f"{r['title'] or 'unknown'} ({r.get('wiki', 'enwiki') or 'unknown'})" for r in rows)
    for section, counts in (("user", humans), ("bot", bots), ("page", pages)):
        want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:S.CHART_HEADS[section]]
        assert [(r["label"], r["event_count"]) for r in sorted(got, key=lambda r: r["rank"]) if r["section"] == section] == want
    sizes = Counter(r["section"] for r in got)
    assert set(sizes) == set(S.CHART_HEADS) and all(sizes[k] <= n for k, n in S.CHART_HEADS.items())
    assert sizes["minute"] == 60
    few = R.chart_heads(make_events(spark, rows), {"page": 3, "user": 2}).collect()
    assert Counter(r["section"] for r in few) == {"page": 3, "user": 2}


def test_rank_bound_lies_below_the_exchange(spark):
    plan = R.chart_heads(make_events(spark, [{"t": i} for i in range(5)]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_empty_lake(spark):
    assert R.chart_heads(make_events(spark, [{"t": 0}]).limit(0)).count() == 0
