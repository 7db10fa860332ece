"""Operator 12 against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from recentlake.llm import bpe_merges
from recentlake.llm import queries as Q
from tests.llm.helpers import documents, odd_rows, prose


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe_merges.default_tokenizer())


def odd_texts(n):
    """Strings of characters that are hard to normalise or to cut."""
    rng = random.Random(8)
    pool = [chr(c) for c in [*range(0x20, 0x250), *range(0x300, 0x330)]] + list(
        "\x1c\x1d\x85\xa0 　Σςİẞ가각\U0001F600̈́̀क़ΩÅיִ​ ")
    out = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(n)]
    return out + ["<|endoftext|>a<|startoftext|><|endoftext|", "a <|ENDOFTEXT|> b", "'S'T it's ΑΣ ΑΣΑ İstanbul",
                  "<|endoftext|> ́a", "eeé", "<|startoftext|><|endoftext|>", "ab" * 4000, "é" * 3000, "!" * 5000]


def test_ids_and_text_equal_the_library(library):
    table = bpe_merges.merge_table(bpe_merges.default_tokenizer())
    for text in odd_texts(4000) + [prose(300, k) for k in range(20)] + [t for _, t, *_ in odd_rows() if t]:
        want = library.encode(text, add_special_tokens=False).ids
        ids = np.frombuffer(table.encode(text.encode()), "<u4")
        assert ids.tolist() == want
        assert table.decode(ids.astype(np.int64)).decode() == library.decode(want, skip_special_tokens=False)


def test_order_of_merges():
    """The queue gives what merging the lowest rank, leftmost first, gives."""
    table = bpe_merges.merge_table(bpe_merges.default_tokenizer())
    rng = random.Random(9)
    for _ in range(300):
        part = bytes(rng.choice(b"aabcdeinrst") for _ in range(rng.randrange(1, 40)))
        symbols = [table.inner[b] for b in part[:-1]] + [table.final[part[-1]]]
        while True:
            found = [(table.merges[p], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in table.merges]
            if not found:
                break
            (_, new), k = min(found, key=lambda x: (x[0][0], x[1]))
            symbols[k:k + 2] = [new]
        assert table.merged(part) == symbols


def test_remembered_words_may_be_forgotten(library, monkeypatch):
    monkeypatch.setattr(bpe_merges, "MEMO_WORDS", 10)
    table = bpe_merges.MergeTable(bpe_merges.default_tokenizer())
    for k in range(30):
        text = prose(50, k)
        assert np.frombuffer(table.encode(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_query(spark, library, tmp_path):
    rows = odd_rows() + [(100 + k, t) for k, t in enumerate(odd_texts(300))]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = [tuple(r) for r in Q.op12_bpe_merges(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_columns_nulls_and_empty_table(spark):
    docs = documents(spark, [(1, "Hello there"), (2, None)]).selectExpr("*", "'x' as ids", "'y' as decoded_text", "5 as n_tokens")
    done = bpe_merges.decoded(bpe_merges.encoded(docs))
    rows = {r.doc_id: r for r in done.collect()}
    assert rows[1].size == "x" and rows[1].text == "Hello there" and rows[1].n_tokens == 2
    assert (rows[2].ids, rows[2].n_tokens, rows[2].decoded_text) == ([], 0, "")
    assert bpe_merges.decoded(bpe_merges.encoded(docs.limit(0))).collect() == []
    odd = spark.createDataFrame([(None,), ([],), ([320, 10**6, -1, None],)], "ids array<int>")
    known = rows and bpe_merges.merge_table(bpe_merges.default_tokenizer()).strings[320].decode()
    assert [r.decoded_text for r in bpe_merges.decoded(odd).collect()] == [None, "", known]
