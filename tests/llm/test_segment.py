import math
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from tickloom.llm import segment
from tickloom.llm.lattice import Lattices, log_inclusion, top_k, units_of

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)


def all_segmentations(text):
    """Every segmentation with its log probability, by enumeration."""
    v = segment._model(PATH, 1.0)[0].vocabulary
    weight = {int(i): w for i, w in zip(v.ids, v.weights)}
    s, found = "▁" + text.replace(" ", "▁"), []

    def extend(i, ids, total):
        if i == len(s):
            found.append((tuple(ids), total))
        for j in range(i + 1, len(s) + 1):
            p = SP.piece_to_id(s[i:j])
            if p in weight:
                extend(j, [*ids, p], total + weight[p])

    extend(0, [], 0.0)
    z = np.logaddexp.reduce([w for _, w in found])
    return {ids: w - z for ids, w in found}


def sampled(text, n, k):
    row, sample, logp, value, inclusion, ids, sizes = segment.encode_run([text] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919), k, PATH, 1.0)
    ends = np.cumsum(sizes)
    return row, sample, logp, value, inclusion, [tuple(ids[b - a:b].tolist()) for a, b in zip(sizes, ends)]


def test_samples_follow_the_law_without_replacement():
    text, n, k = "the ab", 8000, 3
    law = all_segmentations(text)
    row, sample, logp, value, inclusion, got = sampled(text, n, k)
    assert all(abs(law[g] - x) < 1e-9 for g, x in zip(got, logp))
    p = {s: math.exp(x) for s, x in law.items()}
    second = {b: sum(p[a] * p[b] / (1 - p[a]) for a in p if a != b) for b in p}
    for m, want in ((0, p), (1, second)):
        seen = Counter(g for g, s in zip(got, sample) if s == m)
        assert max(abs(seen[s] / n - want[s]) for s in p) < 0.02
    for r in range(0, 3 * n, 3):
        assert len(set(got[r:r + 3])) == 3 and value[r] >= value[r + 1] >= value[r + 2]
    # weights by inclusion make every sum unbiased
    assert abs(np.bincount(row, np.exp(logp - inclusion)).mean() - 1) < 0.02


def test_small_lattices_are_emptied():
    law = all_segmentations("it")
    row, sample, logp, value, inclusion, got = sampled("it", 3, 50)
    for r in range(3):
        assert {g for g, x in zip(got, row) if x == r} == set(law)
    assert set(inclusion) == {0.0} and log_inclusion(-5.0, -math.inf) == 0.0


def test_round_trip_and_independence_of_partitions(make_docs, odd_docs, odd_rows, no_docs):
    texts = ["a  b\n\n\tc ▁d é 😀", " lead", "▁", "\n", "x" * 900, "trail  ", "文字 and more"]
    rows = [*enumerate(texts, 10)]
    for docs, want in ((make_docs(rows), rows), (odd_docs, odd_rows)):
        got = segment.decode(segment.encode(docs, k=2)).collect()
        assert {(r.doc_id, r.decoded) for r in got} == {(d, t or "") for d, t in want}
    one = sorted((r.doc_id, r.sample, r.ids) for r in segment.encode(make_docs(rows), k=3).collect())
    assert one == sorted((r.doc_id, r.sample, r.ids) for r in segment.encode(make_docs(rows).coalesce(1), k=3).collect())
    assert segment.encode(no_docs).collect() == []
    assert "".join(units_of("a  b\n▁c")) == " a  b\n▁c" and units_of("") == []


def test_reused_units_outlive_a_full_store():
    vocabulary = segment._model(PATH, 1.0)[0].vocabulary
    small, large = Lattices(vocabulary, limit=60), Lattices(vocabulary)
    made = []
    add = small._add
    small._add = lambda units: (made.extend(units), add(units))
    often = units_of("these few words come again and again")
    for turn in range(20):
        texts = [often, units_of(" ".join(f"once{turn}x{i} é{i}" for i in range(10)))]
        keys = np.array([turn, 1000 + turn], np.uint64)
        got, want = (top_k(x, texts, keys, 3) for x in (small, large))
        for (a, rest_a), (b, rest_b) in zip(got, want):
            assert rest_a == rest_b and [s.value for s in a] == [s.value for s in b]
            for s, t in zip(a, b):
                assert small.ids(s.edges)[0].tolist() == large.ids(t.edges)[0].tolist()
    assert len(small.slot) < 120 and all(made.count(u) == 1 for u in often)
