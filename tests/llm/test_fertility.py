import math
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece

from tickloom.llm import fertility

SP = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def expected(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    ids = [i for w in words for i in SP.encode(w)]
    counts = Counter(ids)
    entropy = -sum(c / len(ids) * math.log2(c / len(ids)) for c in counts.values()) if ids else 0
    chars = sum(map(len, words))
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(ids),
            chars / max(len(ids), 1), sum(SP.is_byte(i) for i in ids) / max(len(ids), 1), entropy)


REPEAT = " ".join(f"w{i % 9}" for i in range(40))
TEXTS = ["a b", REPEAT, "x\ny\nx\n \n \nx", "# * $ % & | < > tail", "文字 😀 ü z \x1c y", " ".join(f"u{i}" for i in range(50)), "p q r s t u v w " * 2 + "x y"]


def test_signals_equal_brute_force(make_docs, odd_docs, odd_rows, no_docs):
    rows = list(enumerate(TEXTS, 100))
    for docs, want in ((make_docs(rows), rows), (odd_docs, odd_rows)):
        got = sorted((tuple(r)[2:11] for r in fertility.judge(docs).collect()), key=str)
        for g, w in zip(got, sorted((expected(t) for _, t in want), key=str)):
            assert g == pytest.approx(w)
    assert fertility.judge(no_docs).collect() == [] and fertility.keep_good(no_docs).collect() == []


def test_bands_reject_what_is_unlike_its_group(make_docs):
    plain = [(i, " ".join(f"{'the and of in to it was'.split()[(i * j + j // 3) % 7]}{'able ing ed ion'.split()[(i + j) % 4]} house number{j * i % 13}" for j in range(40))) for i in range(120)]
    strange = [(900, " ".join("♔♕♖♗♘♙" for _ in range(12)) + " " + " ".join(f"♚♛♜{chr(0x2654 + i % 12)}" for i in range(12)))]
    rows = {r.doc_id: r for r in fertility.judge(make_docs(plain + strange), group="lang").collect()}
    bad = [d for d, r in rows.items() if not r.kept and not r.base_failed]
    assert 900 not in [d for d in rows if rows[d].kept] or rows[900].n_tokens.bit_length() != rows[0].n_tokens.bit_length()
    assert not [d for d in bad if d < 900]


def test_keep_good_returns_the_kept_rows(make_docs):
    docs = make_docs([(1, " ".join(f"u{i}" for i in range(50))), (1, "short"), (2, REPEAT), (None, " ".join(f"z{i}" for i in range(30)))])
    out = fertility.keep_good(docs)
    assert out.columns == docs.columns and sorted((r.doc_id or 0, len(r.text)) for r in out.collect()) == [(0, len(" ".join(f"z{i}" for i in range(30)))), (1, len(" ".join(f"u{i}" for i in range(50))))]


def prose(i, n=40):
    return " ".join(f"{'the and of in to it was'.split()[(i * j + j // 3) % 7]}{'able ing ed ion'.split()[(i + j) % 4]} house number{j * i % 13}" for j in range(n))


def test_thin_cells_take_the_band_of_their_neighbours(make_docs):
    plain = [(i, prose(i)) for i in range(120)]
    chess = lambda n: " ".join("".join(chr(0x2654 + (i * k + i // 5 + k) % 12) for k in range(5)) for i in range(n))
    few = [(900, chess(24)), (901, prose(7, 400)), (902, chess(200))]  # of script none, and of lengths that no other has
    for group in ("lang", None):
        rows = {r.doc_id: r for r in fertility.judge(make_docs(plain + few), group=group).collect()}
        assert not rows[900].base_failed and not rows[900].kept and rows[900].reasons and rows[902].reasons
        assert all(not r.reasons for d, r in rows.items() if d < 900)


def test_every_cell_has_a_band(make_docs, spark):
    rows = [("a", c, 2.0 + c / 8, 0.0, 5.0) for c in range(4, 8) for _ in range(10)] + [("b", 6, 9.0, 0.5, 1.0)] + [("c", 1, 2.0, 0.0, 5.0)]
    cells = spark.createDataFrame(rows, "_group string, _class int, chars_per_token double, byte_share double, token_entropy double")
    bands = {(r._group, r._class): r.band_chars_per_token for r in fertility.fit_bands(cells, dict.fromkeys(fertility.METRICS, (4.0, 4.0))).collect()}
    assert set(bands) == {(r[0], r[1]) for r in rows}
    assert bands["a", 5] == (2.5 - 1, 2.75 + 1)  # classes 4 to 6
    assert bands["b", 6].high < 9 and bands["b", 6] == (2.625 - 1, 2.875 + 1)  # all documents of classes 5 to 7
    assert {tuple(x) for x in fertility.fit_bands(cells.filter("_group = 'b'"), dict.fromkeys(fertility.METRICS, (4.0, 4.0))).select("band_chars_per_token.*").collect()} == {(8.0, 10.0)}


def test_random_letters_and_encoded_data_are_rejected(spark, make_docs):
    rng = random.Random(5)
    text = lambda n, k, of: " ".join("".join(rng.choice(of) for _ in range(k)) for _ in range(n))
    small = "abcdefghijklmnopqrstuvwxyz"
    bad = [(-i - 1, text(n, k, of)) for i, (n, k, of) in enumerate((n, k, of) for n in (50, 100, 400) for k, of in ((7, small), (12, small + small.upper() + "0123456789+/")))]
    plain = re.compile(r"[^\W\d_][\w\s.,]*")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    clean = [(r.doc_id, r.text) for r in docs.collect() if r.text and plain.fullmatch(r.text) and not re.search(r"[\d_]", r.text) and not r.text.isupper()]
    rows = {r.doc_id: r for r in fertility.judge(make_docs(clean + bad)).collect()}
    assert len(clean) > 500 and not [rows[d].reasons for d, _ in bad if rows[d].kept]
    good = [rows[d] for d, _ in clean if not rows[d].base_failed]
    assert not [r for r in good if not r.kept and "token_entropy" not in r.reasons]
    assert sum(r.kept for r in good) >= 0.995 * len(good)
