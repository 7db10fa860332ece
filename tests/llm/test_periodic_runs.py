"""Operator 13 against a search over all periods."""

import hashlib
import random
import zlib

import pytest

from recentlake.llm import periodic_runs
from recentlake.llm import queries as Q
from tests.llm.helpers import documents, odd_rows, prose, words


def all_runs(w, min_words=24, turns=3):
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            smaller = any(all(w[k] == w[k + r] for k in range(i, i + size - r)) for r in range(1, q))
            if size >= max(min_words, turns * q) and not smaller:
                out.append((i, size, q))
            i = j
    return sorted(out)


def collapsed(w, found):
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    return b" ".join(x for k, x in enumerate(w) if k not in gone)


def expected(doc_id, text):
    """A row of the query, from its contract alone."""
    w = words(text)
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = all_runs(w)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
            hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(w, found)).hexdigest())


@pytest.mark.parametrize("least, turns", [(24, 3), (2, 2), (5, 3)])
def test_automaton_against_all_periods(monkeypatch, least, turns):
    monkeypatch.setattr(periodic_runs, "MIN_WORDS", least)
    monkeypatch.setattr(periodic_runs, "MIN_TURNS", turns)
    rng = random.Random(5)
    for _ in range(400):
        n, letters = rng.randrange(80), rng.choice([1, 2, 3, 6])
        w = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.6:
            p = rng.randrange(1, n + 1)
            w = [w[i % p] for i in range(n)]
            for _ in range(rng.randrange(3)):
                w[rng.randrange(n)] = rng.randrange(letters)
        assert periodic_runs.sequence_runs(w) == all_runs(w, least, turns)


def test_long_sequences():
    rng = random.Random(6)
    for n, p in ((30_000, 1), (30_000, 7), (30_000, 9_999)):
        base = [rng.randrange(50) for _ in range(p)]
        assert periodic_runs.sequence_runs([base[i % p] for i in range(n)]) == [(0, n, p)]


def looping_rows(n):
    """Texts with planted loops of all kinds, next to prose and odd rows."""
    rng = random.Random(7)
    rows = [(doc_id, text[:6000] if text else text) for doc_id, text, *_ in odd_rows()]
    for doc_id in range(20, 20 + n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            unit = prose(rng.randrange(1, 30), rng.randrange(10**6), 30).split()
            size = rng.randrange(1, 120)
            parts += [unit[i % len(unit)] for i in range(size)]
            parts += prose(rng.randrange(0, 20), rng.randrange(10**6), 60).split()
        rows.append((doc_id, rng.choice(["  ", "\n", " \t"]).join(parts)))
    return rows


def test_query_against_brute_force(spark, tmp_path):
    rows = looping_rows(250)
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in Q.op13_periodic_runs(spark, str(tmp_path)).collect()]
    want = [expected(*r) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] > 1 for r in want) > 20 and sum(r[1] == 0 for r in want) > 20


def test_stretches_hold_every_run(spark):
    """The words passed over are in no run, at the edge of its lengths."""
    texts = []
    for q in range(1, 40):
        for size in (max(24, 3 * q) - 1, max(24, 3 * q), max(24, 3 * q) + 1):
            unit = [f"u{q}x{i}" for i in range(q)]
            texts.append(" ".join(["before"] + [unit[i % q] for i in range(size)] + ["after"]))
    rows = list(enumerate(texts))
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in periodic_runs.periodic_runs(documents(spark, rows)).collect()}
    assert got == {k: all_runs(words(t)) for k, t in rows}


def test_columns_and_empty_table(spark):
    docs = documents(spark, [(1, "go " * 30)]).selectExpr("*", "1 as n_words", "'x' as runs", "2 as period", "3 as start")
    row = periodic_runs.periodic_runs(docs).collect()[0]
    assert (row.n_words, [tuple(r) for r in row.runs], row.collapsed_text) == (30, [(0, 30, 1)], "go")
    assert (row.period, row.start, row.size, row.kept) == (2, 3, "x", True)
    assert periodic_runs.periodic_runs(docs.limit(0)).collect() == []
    again = periodic_runs.periodic_runs(docs).collect()
    assert again[0] == row
