import hashlib
import random

from helpers import documents, odd_rows, prose, words

from recentlake.llm import repeated_spans as r


def brute(rows):
    order = lambda d: float("inf") if d is None else d
    first = {}
    for doc_id, text, *_ in rows:
        ws = words(text)
        for k in range(len(ws) - 12):
            w = tuple(ws[k:k + 13])
            first[w] = min(first.get(w, float("inf")), order(doc_id))
    out = []
    for doc_id, text, *_ in rows:
        ws = words(text)
        gone = {k + i for k in range(len(ws) - 12) if first[tuple(ws[k:k + 13])] < order(doc_id) for i in range(13)}
        left = [w for k, w in enumerate(ws) if k not in gone]
        out.append((doc_id, len(ws), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, docs=None):
    out = r.without_repeats(documents(spark, rows) if docs is None else docs).collect()
    return sorted(((x["doc_id"], x["n_words"], x["n_removed"], hashlib.sha256(x["kept_text"].encode()).hexdigest()) for x in out), key=str)


def corpus():
    rng = random.Random(7)
    passages = [prose(rng.choice([12, 13, 14, 30, 80]), 50 + k, 500) for k in range(10)]
    rows = []
    for k in range(120):
        parts = [prose(rng.randrange(40), 1000 + k, 60)]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages).split()
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "changed"
            parts += [" ".join(p), prose(rng.randrange(20), rng.randrange(10**6), 40)]
        rows.append(((k * 41) % 131, "\n".join(parts)))
    return rows + [(500 + k, "the " * (5 + k)) for k in range(20)]


def test_against_brute_force(spark):
    assert got(spark, corpus()) == brute(corpus())


def test_hot_anchors_are_salted_with_the_same_result(spark, monkeypatch):
    monkeypatch.setattr(r, "HOT_SAMPLE", 1)
    monkeypatch.setattr(r, "HOT_LEAST", 3)
    monkeypatch.setattr(r, "SALTS", 5)
    docs = documents(spark, corpus())
    assert len(r.hot_anchors(docs)) > 10
    assert got(spark, corpus()) == brute(corpus())


def test_small_batches_cut_groups(spark, monkeypatch):
    monkeypatch.setattr(r, "GROUP_ROWS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert got(spark, corpus()) == brute(corpus())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows_and_empty_table(spark):
    assert got(spark, odd_rows()) == brute(odd_rows())
    assert got(spark, []) == []


def test_cleaned_keeps_columns_and_untouched_texts(spark):
    docs = documents(spark, odd_rows())
    left = r.cleaned(docs)
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    by_id = {x["doc_id"]: x for x in left.collect() if x["doc_id"] not in (9, None)}
    assert by_id[10]["text"] == odd_rows()[13][1] and by_id[1]["text"] is None
    assert by_id[8]["text"] == "" and by_id[8]["n_chars"] == 0


def test_rows_without_an_id_keep_words_that_repeat_nowhere(spark):
    """Many rows share no id: each keeps its own words."""
    shared = prose(20, 1, 10**6)
    rows = [(5, shared)] + [(None, " ".join(f"{k}x{i}" for i in range(18))) for k in range(20_000)] + [(None, shared + " tail"), (None, shared)]
    assert got(spark, rows) == brute(rows)


def test_equal_rows_of_one_id_in_number(spark):
    text = prose(40, 2, 10**6)
    rows = [(1, text)] + [(7, text)] * 300 + [(None, text)] * 300 + [(8, text + " more")]
    assert got(spark, rows) == brute(rows)


def test_automaton_matches_substrings():
    rng = random.Random(2)
    a = r.SuffixAutomaton()
    texts = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(13, 60))) for _ in range(60)]
    checks = [[bytes([rng.randrange(2)]) for _ in range(len(t) - 12)] for t in texts]
    seen = set()
    for t, c in zip(texts, checks):
        own = [(t[i:i + 13], c[i]) for i in range(len(t) - 12)]
        assert a.matches(t, c) == [w in seen for w in own]
        a.add(t, c)
        seen.update(own)
        assert all(a.matches(t, c))


def _windows_found(rows):
    """Repeated windows ``(doc, start)`` by the readers of all anchors."""
    import pyarrow as pa

    groups = {}
    for doc_id, text in sorted(rows):
        for _, _, data, offs in r.text_blocks(pa.array([text])):
            for _, anchor, start, size, codes in zip(*(x.tolist() for x in r.segments(data, offs) or [pa.array([])] * 5)):
                groups.setdefault(anchor, []).append((doc_id, start, size, codes))
    out = set()
    for segments in groups.values():
        reader = r.GroupReader()
        for doc_id, start, size, codes in segments:
            found = reader.read(doc_id, codes)
            out |= {(doc_id, start + k) for k in range(size) if found is True or found and found[k]}
    return out


def test_the_automaton_decides(monkeypatch):
    rows = [(d, t) for d, t in corpus() if len(words(t)) >= 13]
    first, want = {}, set()
    for doc_id, text in sorted(rows):
        ws = words(text)
        for k in range(len(ws) - 12):
            if first.setdefault(tuple(ws[k:k + 13]), doc_id) < doc_id:
                want.add((doc_id, k))
    assert _windows_found(rows) == want
    monkeypatch.setattr(r.SuffixAutomaton, "matches", lambda self, text, checks: [False] * len(checks))
    assert len(_windows_found(rows)) < len(want)
