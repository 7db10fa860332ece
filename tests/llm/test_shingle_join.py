import random

import numpy as np
import pandas as pd
from helpers import documents, odd_rows, prose, words

from recentlake.llm import shingle_join as j
from recentlake.llm.components import components


def shingles(text):
    ws = [w.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) for w in words(text)]
    if not ws:
        return frozenset()
    return frozenset(tuple(ws[i:i + 5]) for i in range(len(ws) - 4)) if len(ws) >= 5 else frozenset([tuple(ws)])


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    ids = [r[0] for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    out = []
    for k in range(len(rows)):
        known = [ids[m] for m in range(len(rows)) if find(m) == find(k) and ids[m] is not None]
        out.append((ids[k], len(sets[k]), min(known) if known and sets[k] else ids[k]))
    return sorted(out, key=str)


def got(spark, rows):
    return sorted((tuple(r)[:3] for r in j.joined(documents(spark, rows)).collect()), key=str)


def edited(text, n, seed):
    rng = random.Random(seed)
    ws = text.split(" ")
    for _ in range(n):
        k = rng.randrange(len(ws))
        ws[k:k + 1] = rng.choice([[], [f"new{rng.randrange(10**6)}"], [ws[k], "more"]])
    return " ".join(ws)


def test_against_brute_force(spark):
    rows, k = [], 0
    for base in range(14):
        text = prose(random.Random(base).choice([6, 9, 15, 40, 120, 400]), base, 900)
        for copy in range(7):
            rows.append(((k * 37) % 1009, edited(text, copy * max(1, len(text.split()) // 90), k)))
            k += 1
    assert got(spark, rows) == brute(rows)


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 16)
    monkeypatch.setattr(j, "RARE", 4)
    text = prose(120, 5, 2000)
    rows = [(k, edited(text, k % 4, k)) for k in range(70)] + [(100 + k, prose(80, 100 + k, 3000)) for k in range(20)]
    assert got(spark, rows) == brute(rows)


def templated(n, common, own, seed=1):
    """Texts of one template: common words and own ones, no links."""
    shared = prose(common, seed, 10**6)
    return [(k, shared + " " + " ".join(f"{k}v{i}" for i in range(own + k % 3))) for k in range(n)]


def test_rest_of_a_template_is_split_by_sharper_prefixes(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK", 16)
    monkeypatch.setattr(j, "RARE", 4)
    rows = templated(90, 200, 33)
    rows += [(200 + k, edited(rows[3 * k][1], 1 + k % 3, k)) for k in range(12)]  # near copies among them
    rows += [(300 + k, edited(rows[k][1], 12, 50 + k)) for k in range(20)]
    assert got(spark, rows) == brute(rows)


def test_sharper_prefixes_connect_every_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(4, 300))
        base = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a = base[:n]
        b = np.concatenate([a[rng.permutation(n)[:int(rng.integers(max(1, n * 7 // 10), n + 1))]], base[n:n + int(rng.integers(0, n // 4 + 1))]])
        order = {int(x): k for k, x in enumerate(rng.permutation(np.unique(np.concatenate([a, b]))))}
        found = [j.close_prefixes(np.array(sorted(x.tolist(), key=order.get), np.uint64)) for x in (a, b)]
        both = len(np.intersect1d(a, b))
        if j._linked(both, len(a), len(b)):
            roles = [dict(zip(k.tolist(), r.tolist())) for k, r in found]
            assert any(r == 2 or r != roles[1][k] for k, r in roles[0].items() if k in roles[1])


def test_a_third_of_all_rows_are_copies(spark):
    rows = [(k, prose(60, k % 20 if k % 3 else 0, 500)) for k in range(300)]
    assert got(spark, rows) == brute(rows)


def test_odd_rows_ties_and_empty_table(spark):
    assert got(spark, odd_rows()) == brute(odd_rows())
    assert got(spark, []) == []


def test_one_of_each_keeps_clean_rows(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    left = j.one_of_each(docs)
    assert left.columns == docs.columns
    ids = sorted((r["doc_id"] for r in left.collect()), key=str)
    # 6 copies 5, 8 copies 7; of the three rows of 9 one repeats; a row without id copies 9.
    assert ids == sorted([1, 2, 3, 4, 5, 7, 9, 9, 10, 11, 12, None], key=str)


def unrelated_classes():
    """Near copies whose rows have no id, or one id for different texts."""
    a, b, c, d, e = (prose(60, 70 + k, 3000) for k in range(5))
    near = lambda text: text + " tail"
    return [(1, a), (2, b), (None, near(a)), (None, near(b)), (None, c), (None, d), (None, near(d)), (None, near(d)),
            (7, e), (7, prose(60, 80, 3000)), (8, near(prose(60, 80, 3000))), (6, near(e))]


def test_classes_that_share_an_id_or_have_none_do_not_merge(spark):
    assert got(spark, unrelated_classes()) == brute(unrelated_classes())


def test_one_of_each_keeps_unrelated_rows_without_an_id(spark):
    rows = unrelated_classes()
    left = sorted(((r["doc_id"], r["text"]) for r in j.one_of_each(documents(spark, rows)).collect()), key=str)
    # The copies of 1, 2, 6 and 7 go, and one of two equal rows.
    assert left == sorted([rows[k] for k in (0, 1, 4, 5, 6, 9, 11)], key=str)


def test_whole_sets_are_read_by_class(spark):
    rows = [(None, prose(40, 300 + k)) for k in range(12)] * 3
    docs, paths = documents(spark, rows), []
    found = j.saved(j.prefixes(docs, j.hot_shingles(docs)), "prefixes", paths)
    classes = j.numbered_classes(found, paths)
    sets = j.whole_sets(docs, classes.withColumnRenamed("k1", "key")).distinct().collect()
    assert len(sets) == 12 == len({r["rep"] for r in sets})


def test_prefix_and_bands():
    for n in range(4, 3000):
        b = int(j.band_of(n))
        assert j.BANDS[b] <= n < j.BANDS[b + 1]
        assert int(j.band_of(n * 5 // 4)) - b <= 1
        least = n - n // 5
        assert least >= j.SUBCLASSES[b] + 1 or j.prefix_length(n) == n


def test_block_links_form_a_forest():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:58], rng.integers(0, 2**63, k % 3, dtype=np.uint64)])) for k in range(9)]
    a, b = j.block_links(pd.DataFrame({"rep": range(9), "shingles": [s.tobytes() for s in sets], "open": [True] * 9}))
    assert len(a) == 8 and len({*a, *b}) == 9


def test_components_of_paths_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 200)]
    got_ = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got_ == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)}


def test_texts_are_not_sorted(spark, monkeypatch):
    monkeypatch.setattr(j, "saved", lambda df, *_: df)
    docs = documents(spark, [(k, prose(60, k)) for k in range(6)])
    reps = spark.createDataFrame([(1, 2, 3, 4, 5)], "key long, k2 long, id long, tag long, rep long")
    ids = spark.createDataFrame([(k, 56, k, 0) for k in range(6)], "doc_id long, n_shingles long, component_id long, tag long")
    monkeypatch.setattr(j, "joined", lambda docs: ids)
    for made in (j.whole_sets(docs, reps), j.one_of_each(docs)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort" not in plan


def test_one_of_each_with_repeated_rows(spark):
    rows = [(1, prose(60, 1)), (1, prose(60, 1)), (1, prose(60, 2)), (2, prose(60, 1)), (3, prose(60, 3)), (None, prose(60, 4)), (None, prose(60, 4)),
            (4, None), (4, None), (5, prose(60, 5))]
    left = sorted(((r["doc_id"], r["text"]) for r in j.one_of_each(documents(spark, rows)).collect()), key=str)
    assert left == sorted(set(rows) - {(2, prose(60, 1))}, key=str)
