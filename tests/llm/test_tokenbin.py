import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickloom.llm import tokenbin
from tickloom.llm.common import scratch_path
from tickloom.llm.huffman import Codebook, code_lengths

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300), st.integers(9, 16), st.data())
def test_code_round_trip(counts, limit, data):
    counts = np.array(counts)
    if not counts.any():
        counts[0] = 1
    lengths = code_lengths(counts, limit)
    used = np.flatnonzero(counts)
    assert lengths.max() <= limit and (lengths > 0).tolist() == (counts > 0).tolist()
    if len(used) > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == pytest.approx(1)
    ids = np.array(data.draw(st.lists(st.sampled_from(used.tolist()), max_size=400)), np.int64)
    book = Codebook(lengths)
    payload, marks = book.encode(ids, 16)
    assert (book.decode(payload, marks, len(ids), 16) == ids).all()


def test_lengths_are_optimal_without_a_tight_limit():
    import heapq

    counts = np.array([5, 9, 12, 13, 16, 45, 1, 1, 2])
    heap, cost = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    assert int((counts * code_lengths(counts)).sum()) == cost


TEXTS = ["It's a TEST, isn't it?", "<|endoftext|> x<|endoftext|>y", "ÉCOLE é ΣΑΣ 12ab,, don't\tgo.", "", None, "one two three", "thing. Thing, thing"]


def test_ids_are_the_librarys():
    ids, sizes = tokenbin.tokenize(TEXTS, PATH)
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    assert [p.tolist() for p in parts] == [TOK.encode(t or "", add_special_tokens=False).ids + [1] for t in TEXTS]


def test_files_read_back(spark, make_docs, odd_docs, odd_rows, no_docs):
    for docs, rows in ((make_docs(list(enumerate(TEXTS * 30))), list(enumerate(TEXTS * 30))), (odd_docs, odd_rows), (no_docs, [])):
        path = scratch_path(spark, "test-tokens")
        tokenbin.write_token_files(docs, path)
        index = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenbin.index_of(spark, path).collect()))
        ids = {}
        for d, t in rows:
            ids.setdefault(d, []).append(TOK.encode(t or "", add_special_tokens=False).ids + [1])
        assert [d for _, d, _, _ in index] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
        at = 0
        for start, d, n, crc in index:
            assert start == at and (n, crc) in [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids[d]]
            at += n
        back = tokenbin.decode_blocks(spark, path).collect()
        assert sorted((r.doc_id or -1, r.ids) for r in back) == sorted((d or -1, x) for d, xs in ids.items() for x in xs)


def test_words_of_latin_letters_with_closing_signs_go_to_the_merges(monkeypatch):
    path = public_tokenizers.path(tokenbin.VOCABULARY)
    table = tokenbin.WordTable(tokenbin._words(path).encode)
    seen = []
    monkeypatch.setattr(tokenbin.np, "searchsorted", lambda *a, f=np.searchsorted: (seen.append(1), f(*a))[1])
    tok = Tokenizer.from_file(path)
    words = "ÉTÉ naïve, Straße*** plain.&&& ñandú!! Œuvre d'été x<|endoftext|> it's a1 ½ *** İx ﬁn éte çA̧ ǆ µm ªb".split()
    want = [tok.encode(w, add_special_tokens=False).ids for w in words]
    assert table.encode([w.encode() for w in words]) == want
    table.encode([w.encode() for w in words[:5]])  # their signs are known by now
    del seen[:]
    assert table.encode([w.encode() for w in ["Çà***", *words[:5]]]) == [tok.encode(w, add_special_tokens=False).ids for w in ["Çà***", *words[:5]]]
    assert not seen
