import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from tickloom.llm import fertility, langid, setjoin  # noqa: E402


def test_stages_equal_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], sf).write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    ids = [sorted(r.doc_id for r in t.select("doc_id").collect()) for t in tables]
    assert all(t.columns == columns for t in tables[1:5])
    told = {r.doc_id: r.rejected for r in langid.identify(tables[0]).collect()}
    assert ids[1] == [d for d in ids[0] if not told[d]]
    kept = {r.doc_id: r.kept for r in fertility.judge(tables[1]).collect()}
    assert ids[2] == [d for d in ids[1] if kept[d]]
    sets = {r.doc_id: {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} for r in tables[2].collect() if (w := r.text.encode().lower().split())}
    group = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {d: new if g == old else g for d, g in group.items()}
    assert ids[3] == sorted(set(group.values()))
    assert set(ids[4]) <= set(ids[3]) and ids[5] == sorted([*ids[4], *ids[4]])
    # run() gives the same rows as the stages one by one
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()) == ids[5]
    assert len(setjoin.keep_one(tables[3]).collect()) == len(ids[3])


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []
