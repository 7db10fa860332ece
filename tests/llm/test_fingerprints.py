import hashlib
import math
from collections import Counter

import numpy as np
from helpers import documents, odd_rows, prose

from recentlake.llm import fingerprints as f


def test_entropy_of_every_window():
    rng = np.random.default_rng(4)
    data = np.concatenate([rng.integers(97, 123, 300), np.full(100, 65), rng.integers(0, 256, 200)]).astype(np.uint8)
    bins = f.entropy_bins(data)
    assert len(bins) == len(data) - f.WINDOW + 1
    for at in range(0, len(bins), 7):
        counts = Counter(data[at:at + f.WINDOW].tolist())
        entropy = -sum(c / f.WINDOW * math.log2(c / f.WINDOW) for c in counts.values())
        assert bins[at] == min(f.BINS - 1, int(entropy * f.STEPS + 1e-6))


def test_chains_do_not_depend_on_blocks():
    texts = [prose(k * 7 % 400, k) for k in range(40)] + ["", "short", "x" * 63, "x" * 64, "ab" * 500]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    rank = f.ranks(np.arange(f.BINS))
    for text, chain in zip(texts, f.chains(np.frombuffer(b"".join(raw), np.uint8), offs, rank)):
        assert np.array_equal(chain, f.fingerprint(text, rank))
    assert len(f.fingerprint(prose(20_000, 3, 5000), rank)) > 3


def test_equal_texts_side_by_side_have_equal_chains():
    texts = ["ab" * 20, "ab" * 20, "abc" * 100, "abc" * 100, "abc" * 400, "abc" * 400, prose(30, 1), prose(30, 1)]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    rank = f.ranks(np.arange(f.BINS))
    for text, chain in zip(texts, f.chains(np.frombuffer(b"".join(raw), np.uint8), offs, rank)):
        assert np.array_equal(chain, f.fingerprint(text, rank)) and len(chain)


def test_short_texts_are_like_their_edits_and_unlike_others():
    rank = f.ranks(np.arange(f.BINS))
    like, unlike = [], []
    for k in range(60):
        a, b = prose(12 + k % 30, 2 * k, 9000), prose(12 + k % 30, 2 * k + 1, 9000)
        own = f.fingerprint(a, rank)
        like.append(f.likeness(own, f.fingerprint(f.edited(a, b), rank)))
        unlike.append(f.likeness(own, f.fingerprint(b, rank)))
    assert min(like) > 0 and 0.35 < np.mean(like) < 0.7
    assert np.mean(unlike) < 0.1


def test_likeness_falls_with_edits():
    rank = f.ranks(np.arange(f.BINS))
    a, b = prose(2000, 1, 4000), prose(2000, 2, 4000)
    ws = a.split()
    own = f.fingerprint(a, rank)
    near = f.fingerprint(" ".join(ws[:1900] + b.split()[:100]), rank)
    half = f.fingerprint(" ".join(ws[:1000] + b.split()[:1000]), rank)
    far = f.fingerprint(b, rank)
    scores = [f.likeness(own, x) for x in (own, near, half, far)]
    assert scores[0] == 1.0 and scores[0] > scores[1] > scores[2] > scores[3] and scores[3] < 0.2
    assert 0.3 < scores[2] < 0.8


def test_texts_of_plain_windows_only_are_told_apart():
    rank = f.ranks(np.arange(f.BINS))
    plain = ["-" * 64, "-" * 65, "=" * 500, " " * 300, "a" * 900 + "b", "ab" * 20, "-" * 63]
    prints = [f.fingerprint(t, rank) for t in plain]
    assert all(len(x) == 1 for x in prints)
    for k, a in enumerate(prints):
        assert f.likeness(a, f.fingerprint("", rank)) == 0.0
        assert [f.likeness(a, b) == 1.0 for b in prints] == [k == m for m in range(len(plain))]
    raw = [t.encode() for t in ["", *plain, prose(300, 1), "x" * 80]]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    together = f.chains(np.frombuffer(b"".join(raw), np.uint8), offs, rank)
    assert all(np.array_equal(a, b) for a, b in zip(together[1:8], prints)) and not len(together[0])


def test_query_rows_against_brute_force(spark):
    rows = odd_rows() + [(50 + k * 13 % 97, prose(20 + k * 5 % 300, k)) for k in range(97)]
    docs = documents(spark, rows)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    rank = f.rarity(docs)
    got = sorted((tuple(r) for r in f.fingerprints(docs).collect()), key=str)
    want = []
    for k, (doc_id, text, *_) in enumerate(order):
        a, b = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(a) // 2
        e = a[:len(a) - half] + b[:half]
        fa, fb, fe = (f.fingerprint(x, rank) for x in (a, b, e))
        want.append((doc_id, len(a), hashlib.sha256(e.encode()).hexdigest(), f.encode(fa), f.encode(fe), f.likeness(fa, fe), f.likeness(fa, fb)))
    assert got == sorted(want, key=str)


def test_single_row_and_empty_table(spark):
    one = f.fingerprints(documents(spark, [(3, prose(50, 1))])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert f.fingerprints(documents(spark, [])).count() == 0
    assert f.fingerprints(documents(spark, [(None, None)])).collect()[0]["fingerprint"] == ""
