import hashlib

from pyspark.sql import functions as F

from tickloom.llm import merkle


def tree(text):
    h = lambda kind, s: hashlib.sha256((kind + s).encode()).hexdigest()
    paragraphs = [[h("p", p) for p in s.split("\n")] for s in (text or "").split("\n\n")]
    sections = [h("s", "".join(p)) for p in paragraphs]
    return paragraphs, sections, h("d", "".join(sections))


TEXTS = ["one\ntwo\n\nthree\nfour", "one\ntwo\n\nthree\n4our", "", None, "\n", "\n\n\n", "é文😀\nb", "one\ntwo\n\nthree\nfour"]


def test_trees_and_edits(make_docs):
    rows = {r.doc_id: r for r in merkle.with_tree(make_docs(list(enumerate(TEXTS))), "text", "t_").collect()}
    for i, t in enumerate(TEXTS):
        assert (rows[i].t_paragraphs, rows[i].t_sections, rows[i].t_root) == tree(t)
    assert len({rows[i].t_root for i in range(8)}) == 6  # 2 and 3, 0 and 7 are equal
    pair = make_docs([(0, TEXTS[0])]).select("text", F.lit(TEXTS[1]).alias("other"))
    r = merkle.with_tree(merkle.with_tree(pair, "text", "a_"), "other", "b_").select(merkle.located_edits("a_", "b_").alias("e"), merkle.likeness("a_", "b_").alias("l")).first()
    assert [(x.section, x.paragraph) for x in r.e] == [(1, 1)] and r.l == 2 * 4 / 14


def test_next_document(make_docs, odd_docs, odd_rows, no_docs):
    rows = [(i * 7 % 101, f"t{i}") for i in range(90)]
    for n in (1, 4, 64):
        got = {r.doc_id: r.next_text for r in merkle.with_next(make_docs(rows), buckets=n).collect()}
        order = sorted(rows, reverse=True)
        assert got == {a[0]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    odd = merkle.with_next(odd_docs).collect()
    assert len(odd) == len(odd_rows) and sorted(r.next_text for r in odd) == sorted(t or "" for _, t in odd_rows)
    assert merkle.with_next(no_docs).collect() == []
    assert [r.next_text for r in merkle.with_next(make_docs([(1, "lone")])).collect()] == ["lone"]
