"""The pipeline, stage by stage, against brute force on a small fixture."""

import random
import re

import pytest

import corpus_pipeline
from tablescope.llm import toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    texts = [[rng.choice(words) for _ in range(rng.randint(60, 200))] for _ in range(160)]
    item = " ".join(rng.choice(words) for _ in range(14))
    rows, labels = [], []
    for i, t in enumerate(texts):
        toxic = i % 8 == 0
        if toxic:
            t[3] = t[20] = "horrid"
        if i % 10 == 1:
            t[30:30] = item.split()
        rows.append((i, " ".join(t), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(200 + i, rows[i][1], "en", "s0", 0) for i in range(1, 20)]
    for i in range(20, 30):
        edited = list(texts[i])
        edited[len(edited) // 2] = "edit"
        rows.append((300 + i, " ".join(edited), "en", None, 0))
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (402, "", "en", "s1", 0), (403, "two words", "en", "s1", 9)]
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), {r[0]: r for r in rows}, item


def test_stages_match_brute_force(spark, folder):
    d, rows, item = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = dict(rows)
    field = toxicity.fitted(docs, spark.read.parquet(f"{d}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.scored(docs, field).collect()}
    want = []

    kept = {i: r for i, r in kept.items() if scores[i] < toxicity.THRESHOLD}
    want.append(set(kept))
    assert all((i % 8 == 0) == (i not in kept) for i in range(160))

    last = {}
    for i, r in kept.items():
        last[r[1] or ""] = max(i, last.get(r[1] or "", -1))
    kept = {i: kept[i] for i in last.values()}
    want.append(set(kept))

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}

    sets, label = {i: shingles(r[1]) for i, r in kept.items()}, {i: i for i in kept}
    near = [(a, b) for a in kept for b in kept if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in kept:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    gone = {i for i, x in label.items() if i != x}
    assert {i for i in gone if i < 400} == {320 + i for i in range(10)} - {320 + i for i in range(10) if 20 + i not in kept}
    kept = {i: r for i, r in kept.items() if i not in gone}
    want.append(set(kept))

    cut = lambda t: re.findall(r"[0-9a-z]+", (t or "").lower())
    windows = {tuple(cut(item)[k : k + 10]) for k in range(5)}
    kept = {i: r for i, r in kept.items() if not any(tuple(w[k : k + 10]) in windows for w in [cut(r[1])] for k in range(len(w) - 9))}
    want.append(set(kept))

    for (name, stage), ids in zip(corpus_pipeline.STAGES, want, strict=False):
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        path = f"{d}/out-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        got = sorted(r.doc_id for r in docs.collect())
        assert got == sorted(ids), name
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in mixed} == want[-1] and all(0 <= r.taken <= 3 * r["size"] for r in mixed)
    total = sum(len((r[1] or "").split()) for r in kept.values())
    assert abs(sum({r.source: r.target for r in mixed}.values()) - total) < 1e-6
    assert abs(sum(r.taken for r in mixed) - total) <= 16 * 4
    again = corpus_pipeline.run(spark, d).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, mixed), key=repr)
