import math
from collections import Counter

import numpy as np
import pytest
from helpers import documents, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from recentlake.llm import sampled_pieces as s


@pytest.fixture(scope="module")
def own():
    return s.Pieces(s.default_model())


TEXTS = ["", " ", "  ", "▁", "a▁ b", "\n\n x\t", "  lead  and   trail  ", "日本語テキスト 한국어", "\U0001F600 smile\x00", "x" * 3000, "é" * 300, prose(200, 4)]


def test_lossless(own):
    ids, bounds = own.encode(TEXTS, np.arange(len(TEXTS), dtype=np.uint64))
    assert own.decode(ids, bounds) == TEXTS


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_lossless_on_any_text(texts):
    pieces = s.pieces(s.default_model(), s.ALPHA)
    ids, bounds = pieces.encode(texts, np.arange(len(texts), dtype=np.uint64))
    assert pieces.decode(ids, bounds) == texts


def test_a_row_depends_on_its_key_only(own):
    keys = s.mix64(np.arange(len(TEXTS), dtype=np.uint64) + np.uint64(5))
    ids, bounds = own.encode(TEXTS, keys)
    for k, text in enumerate(TEXTS):
        alone, _ = own.encode([text], keys[k:k + 1])
        assert np.array_equal(alone, ids[bounds[k]:bounds[k + 1]])
    text = "thing aile nation other " * 80
    a, b = (own.encode([text], np.array([k], np.uint64))[0].tolist() for k in (1, 2))
    assert a != b


def test_frequencies_follow_the_lattice(own):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=s.default_model())
    weight = {model.id_to_piece(i): 1 / (s.OFFSET - model.get_score(i)) for i in range(259, model.get_piece_size())}

    def cuts(text):
        if not text:
            yield (), 1.0
        for n in range(1, len(text) + 1):
            if text[:n] in weight:
                for rest, p in cuts(text[n:]):
                    yield (text[:n], *rest), p * weight[text[:n]]

    n = 30_000
    for word in ("thing", "aile"):
        every = dict(cuts("▁" + word))
        total = sum(every.values())
        ids, bounds = own.encode([word] * n, s.mix64(np.arange(n, dtype=np.uint64)))
        drawn = Counter(tuple(own.bytes_of[i].decode().replace(" ", "▁") for i in ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:]))
        assert set(drawn) <= set(every)
        for cut, p in every.items():
            p /= total
            assert abs(drawn[cut] / n - p) < 5 * math.sqrt(p / n) + 1e-4


def test_on_spark_with_odd_rows(spark, own):
    rows = odd_rows()
    docs = documents(spark, rows)
    encoded = s.encoded(docs)
    assert encoded.columns == [c for c in docs.columns if c != "text"] + ["ids"]
    got = sorted((r["doc_id"], r["ids"]) for r in encoded.collect() if r["doc_id"] == 9)
    assert len({tuple(i) for _, i in got}) == 2  # equal rows, equal pieces
    back = s.decoded(encoded)
    assert sorted(str((r["doc_id"], r["text"])) for r in back.collect()) == sorted(str((r[0], r[1])) for r in rows)
    assert s.decoded(s.encoded(docs.limit(0))).count() == 0
    again = {str(r["doc_id"]) + str(r["size"]): r["ids"] for r in s.encoded(docs.repartition(5)).where("doc_id in (7, 10, 12)").collect()}
    assert again == {str(r["doc_id"]) + str(r["size"]): r["ids"] for r in encoded.where("doc_id in (7, 10, 12)").collect()}
