import duckdb
import pytest
from helpers import documents, odd_rows, prose, words
from pyspark.sql import functions as F

from recentlake.llm import mixing as m


def rows_of(spark, rows):
    return [r.asDict() for r in m.mix_plan(documents(spark, rows)).collect()]


def level(sizes, weights):
    """Targets by sharing the excess again until none is above its cap."""
    total, capped = sum(sizes), [False] * len(sizes)
    while True:
        free = sum(w for w, c in zip(weights, capped) if not c)
        left = total - sum(3 * s for s, c in zip(sizes, capped) if c)
        target = [3 * s if c else (w * left / free if free else 0) for s, w, c in zip(sizes, weights, capped)]
        over = [not c and t > 3 * s for t, s, c in zip(target, sizes, capped)]
        if not any(over):
            return target
        capped = [c or o for c, o in zip(capped, over)]


@pytest.mark.parametrize("counts", [(50, 50, 50), (200, 3, 1, 40), (1, 1, 300, 2, 2, 9), (5, 0, 40)])
def test_targets_and_taken(spark, counts):
    rows, k = [], 0
    for s, n in enumerate(counts):
        for _ in range(n):
            rows.append((k, prose(20 + k % 31, k), "en", f"s{s}" if s < 4 else None if s == 5 else "t"))
            k += 1
    names = sorted({r[3] for r in rows if r[3]}) + ([None] if any(r[3] is None for r in rows) else [])
    sizes = [sum(len(words(r[1])) for r in rows if r[3] == n) for n in names]
    want = dict(zip(names, level(sizes, [k % 3 + 1 for k in range(len(names))])))
    got = rows_of(spark, rows)
    assert len(got) == len(rows)
    for name in names:
        own = [r for r in got if r["source"] == name]
        assert own[0]["target"] == pytest.approx(want[name])
        assert abs(sum(r["taken"] for r in own) - want[name]) <= max(r["size"] for r in own) / 2 + 1e-6
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] == len(r["positions"]) * r["size"]
        assert all(0 <= p <= 1 for p in r["positions"]) and r["positions"] == sorted(r["positions"])


def test_positions_follow_the_schedule(spark):
    rows = [(k, prose(10, k), "en", f"s{k % 3}") for k in range(900)]
    got = rows_of(spark, rows)
    for s, slope in zip(("s0", "s1", "s2"), m.SLOPES):
        own = sorted(p for r in got if r["source"] == s for p in r["positions"])
        early = sum(p < 0.5 for p in own) / len(own)
        assert early == pytest.approx(0.5 - slope / 4, abs=0.02)


def test_mixed_repeats_and_orders_rows(spark):
    rows = [(k, prose(10 + k % 5, k), "en", f"s{k % 2}") for k in range(60)] + [(7, prose(12, 7), "en", "s1")] * 2
    docs = documents(spark, rows)
    plan = m.mix_plan(docs)
    copies = sum(r["copies"] for r in plan.collect())
    out = m.mixed(docs, plan)
    assert out.columns == [*docs.columns, "position"]
    got = out.collect()
    assert len(got) == copies
    assert [r["position"] for r in got] == sorted(r["position"] for r in got)


def test_oracle_sql_reruns_and_odd_rows(spark):
    from recentlake.llm.oracle import SQL

    rows = [(k, prose(k % 23, k), "en", None if k % 11 == 0 else f"s{k % 4}") for k in range(300)]
    docs = documents(spark, rows)
    table = docs.select("doc_id", "text", "source").toArrow()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", table)
    expected = {r[0]: r[1:] for r in con.execute(
        f"select doc_id, size, source_size, target, taken from ({SQL['op10_mix_sources']})").fetchall()}
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"], r["taken"]) for r in m.mix_plan(docs.repartition(9)).collect()}
    assert got == expected
    assert len(rows_of(spark, odd_rows())) == len(odd_rows())
    assert rows_of(spark, []) == []
    assert rows_of(spark, [(1, None), (2, "")])[0]["target"] == 0.0


def test_rows_without_an_id_spread_over_the_buckets(spark):
    rows = [(None, prose(5, k), "en", "s") for k in range(400)] + [(7, prose(5, 1000 + k), "en", "s") for k in range(400)]
    sizes = m.document_sizes(documents(spark, rows))
    buckets = sizes.select(F.substring("order_key", 1, m.BUCKET_DIGITS)).distinct().count()
    assert buckets > 500
    plan = m.mix_plan(documents(spark, rows)).collect()
    assert sum(r["taken"] for r in plan) == 4000 and all(r["copies"] == 1 for r in plan)
