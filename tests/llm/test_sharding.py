import zlib

from tickloom.llm import sharding


def expected(rows, n):
    size = lambda t: len((t or "").encode()) + 8
    crc = lambda t: zlib.crc32((t or "").encode())
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, crc(r[1]), size(r[1])))
    total, start, out, slots = sum(size(t) for _, t in rows), 0, [], {}
    for d, t in rows:
        s = (2 * start + size(t)) * n // (2 * total)
        out.append((d, size(t), crc(t), s, slots.setdefault(s, 0)))
        slots[s] += 1
        start += size(t)
    return sorted(out, key=str)


def test_shards_equal_brute_force(make_docs, odd_docs, odd_rows, no_docs):
    rows = [(i, "é" * (i * 37 % 200)) for i in range(300)]
    for docs, want in ((make_docs(rows), rows), (odd_docs, odd_rows), (no_docs, [])):
        for n in (1, 7):
            got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shard(docs, n).collect()]
            assert sorted(got, key=str) == expected(want, n)


def test_shards_are_near_equal_and_contiguous(make_docs):
    rows = [(i, "x" * (i * 53 % 400)) for i in range(500)]
    got = sharding.shard(make_docs(rows), 10).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    share = sum(r["size"] for r in got) / 10
    ends = sorted((min(r.doc_id for r in x), max(r.doc_id for r in x)) for x in by.values())
    assert len(by) == 10 and all(abs(sum(r["size"] for r in x) - share) <= 408 for x in by.values())
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_other_order(make_docs):
    got = sharding.shard(make_docs([(i, "t", None, f"s{9 - i}") for i in range(9)]), 3, order=("source", "doc_id")).collect()
    assert sorted(r.doc_id for r in got if r.shard == 0) == [6, 7, 8]
