from collections import Counter

import numpy as np
from helpers import documents, odd_rows, prose, words

from recentlake.llm import quality_rules as q


def brute(text):
    ws = words(text)
    text = text or ""
    lines = [x for x in text.split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    counts = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    covered = {i + j for i in range(len(ws) - 4) if counts[tuple(ws[i:i + 5])] > 1 for j in range(5)}
    return (len(ws), sum(len(w.decode()) for w in ws), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered))


def test_statistics_equal_brute_force(spark):
    rows = odd_rows() + [
        (20, "a b c d e x a b c d e"), (21, "line one\nline one\n\n \nline one\nline  one\n"), (22, "#a *b $$ % & | <> \x0b \x1c z"),
        (23, "\n".join(prose(9, k % 3) for k in range(40))), (24, "the the the the the the"),
    ]
    docs = documents(spark, rows)
    got = sorted(((r["doc_id"], *(r[s] for s in q.STATS)) for r in q.text_statistics(docs, ("doc_id",)).collect()), key=str)
    assert got == sorted(((r[0], *brute(r[1])) for r in rows), key=str)


def clean(k):
    return "\n".join(prose(12 + (k + j) % 7, 1000 * k + j, 3000) for j in range(6 + k % 9))


def test_outliers_go_and_clean_rows_stay(spark):
    rows = [(k, clean(k), "en" if k % 2 else "fr", "hot" if k % 3 else "cold") for k in range(400)]
    junk = [(1000 + k, " ".join(f"{w}###" for w in clean(k).split()), "en", "hot") for k in range(12)]
    got = {r["doc_id"]: r for r in q.quality_verdicts(documents(spark, rows + junk)).collect()}
    assert len(got) == 412
    assert sum(got[r[0]]["kept"] for r in rows) >= 396
    assert not any(got[r[0]]["kept"] for r in junk)
    assert all(not r["kept"] for r in got.values() if r["base_failed"])


def test_estimate_resists_contamination(spark):
    rng = np.random.default_rng(3)
    good = rng.multivariate_normal(np.zeros(5), np.diag([1, 0.5, 1, 1, 2.0]), 800)
    bad = rng.normal(9, 0.1, (160, 5))
    rows = [("c", *map(int, np.round(v * q.SCALE))) for v in np.vstack([good, bad])]
    frame = spark.createDataFrame(rows, "cell string, " + ", ".join(f"x{i} long" for i in range(5)))
    best = q.mcd_estimates(frame).collect()
    assert len(best) == 1
    assert np.abs(np.array(best[0]["mu"])).max() < 0.35


def test_odd_rows_small_pools_and_empty_table(spark):
    docs = documents(spark, odd_rows())
    got = q.quality_verdicts(docs)
    assert got.count() == len(odd_rows())
    for r in got.collect():
        assert r["kept"] == (not r["base_failed"])  # no pool is large enough for an estimate
    kept = q.kept_documents(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["kept"] for r in got.collect())
    assert q.quality_verdicts(docs.limit(0)).count() == 0
    assert q.kept_documents(docs.limit(0)).count() == 0


def test_a_small_rest_is_judged_by_all_rows(spark):
    rows = [(k, clean(k), "en", "s") for k in range(150)] + [(200, clean(200), "xx", "s"), (201, clean(201), None, None)]
    junk = [(300 + k, " ".join(f"{w}###" for w in clean(k).split()), lang, "s") for k, lang in enumerate(("xx", "yy", None))]
    got = {r["doc_id"]: r for r in q.quality_verdicts(documents(spark, rows + junk)).collect()}
    assert len(got) == 155 and all(r["distance"] is not None for r in got.values())
    assert got[200]["kept"] and got[201]["kept"]
    assert not any(got[r[0]]["kept"] for r in junk)
    own = {r["doc_id"]: r["distance"] for r in q.quality_verdicts(documents(spark, rows[:150])).collect()}
    assert all(got[k]["distance"] == own[k] for k in own)  # a large cell keeps its own estimate


def test_reruns_agree(spark):
    rows = [(k, clean(k), "en", "s") for k in range(150)]
    a = {r["doc_id"]: r["distance"] for r in q.quality_verdicts(documents(spark, rows)).collect()}
    b = {r["doc_id"]: r["distance"] for r in q.quality_verdicts(documents(spark, rows[::-1]).repartition(7)).collect()}
    assert a == b


def exact_mcd(points, share):
    """The subset of that share of ``points`` with the smallest determinant, by
    trying all of them (each distinct point counts as one row)."""
    from itertools import combinations

    h = int(np.ceil(share * len(points)))
    best = min(combinations(range(len(points)), h), key=lambda s: np.linalg.det(np.cov(points[list(s)].T, bias=True) + 1e-9 * np.eye(q.P)))
    return points[list(best)], best


def test_estimate_covers_the_subset_of_the_exact_one(spark):
    """On a cell small enough to try every subset, the concentration steps find
    the rows of the exact minimum-determinant subset, and reject the same rows."""
    rng = np.random.default_rng(11)
    good = rng.normal(0, 1, (13, q.P)) * 3.0
    bad = rng.normal(0, 0.5, (4, q.P)) + np.array([60, -45, 55, 40, 70.0])
    points = np.round(np.vstack([good, bad]) * q.SCALE)
    frame = spark.createDataFrame([("c", *map(int, v)) for v in points], "cell string, " + ", ".join(f"x{i} long" for i in range(q.P)))
    found = q.mcd_estimates(frame).collect()[0]
    points /= q.SCALE
    subset, chosen = exact_mcd(points, q.SUBSET_SHARE)
    assert set(chosen) <= set(range(13))  # the exact subset holds no bad row
    cov = np.cov(subset.T, bias=True)
    gap = points - subset.mean(0)
    exact = np.einsum("ni,ij,nj->n", gap, np.linalg.inv(cov), gap)
    gap = points - np.array(found["mu"])
    ours = np.einsum("ni,ij,nj->n", gap, np.array(found["prec"]).reshape(q.P, q.P), gap)
    assert set(np.argsort(ours)[:13]) == set(np.argsort(exact)[:13]) == set(range(13))
    assert (ours[13:] > q.CUT).all() and (exact[13:] > q.CUT).all()
    assert np.abs(np.array(found["mu"]) - good.mean(0)).max() < 2.0
