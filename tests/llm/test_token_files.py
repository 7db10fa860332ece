import zlib

import numpy as np
import pytest
from helpers import documents, odd_rows, prose

from recentlake.llm import token_files as t


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(t.default_tokenizer())


TEXTS = [
    "", " ", "It's DON'T we'LL 'S x'sy ''s", "<|endoftext|> a<|endoftext|>b <|x|>", "5€ 12½ x² ª º ǅ ŉ ſ ﬁ x10.5",
    "İstanbul ΑΣ Σ straße ÀÉ café é 日本語  x y a\u0085b \x1c\x1d q\x1er", "\U0001F600 \U0001F44D\U0001F3FD ‍", "a.b,c;d -- (e) [f]", prose(300, 1),
]


def test_encoder_equals_the_library_on_whole_texts(tokenizer):
    own = t.WordEncoder(t.default_tokenizer())
    for _ in range(2):  # the second time from memory
        ids, sizes = own.encode([x.encode() for x in TEXTS])
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for text, part in zip(TEXTS, parts):
            assert part.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, t.END_ID]


@pytest.mark.parametrize("n,bits", [(0, 16), (1, 16), (511, 3), (512, 3), (513, 16), (5000, 16), (3000, 17)])
def test_wavelet_matrix(n, bits):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), (1 << bits) - 1).astype(np.uint32)
    shard = t.Shard(b"".join(t.shard_bytes(ids, bits, b"docs")))
    assert shard.documents == b"docs" and shard.n == n
    assert np.array_equal(shard.ids(), ids)
    at = rng.integers(0, max(n, 1), 200 if n else 0)
    assert np.array_equal(shard.access(at), ids[at])
    for token in {0, 1, 2, 7, 300, 1 << 20, *ids[:3].tolist()}:
        assert np.array_equal(shard.occurrences(token), np.flatnonzero(ids == token))
        assert shard.count(token) == int((ids == token).sum())
        assert shard.count(token, n // 2) == int((ids[:n // 2] == token).sum())


def test_files_round_trip(spark, tokenizer):
    rows = odd_rows() + [(100 + k * 7 % 83, prose(30 + k, k)) for k in range(83)]
    manifest = t.write_token_files(documents(spark, rows), shard_ids=2000)
    assert manifest.count() >= 4
    got = sorted(t.read_documents(manifest).collect(), key=lambda r: r["start"])
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    start = 0
    for r, (_, text, *_) in zip(got, order):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_empty_table(spark):
    assert t.read_documents(t.write_token_files(documents(spark, []))).count() == 0
