"""The pipeline over planted documents, each stage held against brute force on its own input."""

import random

import corpus_pipeline
from quire.llm import packing
from test_operators import plain_lower, words


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def planted(spark, folder):
    rng = random.Random(21)
    rows, labels = [], []
    items = [(i, " ".join(words(rng, 25))) for i in range(6)]
    for i in range(900):
        w = words(rng, rng.randint(30, 120))
        toxic = i % 6 == 0
        if toxic:
            at = rng.randint(0, len(w))
            w[at:at] = rng.choices(["vilefool", "scumbag", "wretch"], k=6)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 6]
    rows += [(1000 + k, clean[k][1].upper() if k % 2 else clean[k][1]) for k in range(40)]
    for k in range(40):
        w = clean[100 + k][1].split()
        w[len(w) // 2] = "changed"
        rows.append((2000 + k, " ".join(w)))
    rows += [(3000 + k, f"{clean[200 + k][1]} {items[k % 6][1]} {clean[300 + k][1]}") for k in range(20)]
    rows += [(4000, None), (4001, ""), (None, "no id here at all, but some words")]
    docs = [(d, t, "en", f"s{k % 3}", len(t or ""), "x") for k, (d, t) in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, _hash string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(items)


def test_every_stage(spark, tmp_path):
    folder = f"file://{tmp_path}"
    items = planted(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(out := f"{folder}/{k}")
        after = spark.read.parquet(out)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        seen[name] = ([tuple(r) for r in docs.select("doc_id", "text").collect()], after.collect())
        docs = after
    before, after = seen["toxicity"]
    ids = {r.doc_id for r in after}
    bad = {d for d, t in before if t and "scumbag" in t or t and "vilefool" in t or t and "wretch" in t}
    assert len(bad & ids) <= 0.05 * len(bad) and {d for d, _ in before} - bad <= ids
    before, after = seen["exact dedup"]
    assert sorted(plain_lower(r.text) for r in after) == sorted({plain_lower(t) for _, t in before})
    before, after = seen["simhash near-dedup"]
    kept = {r.doc_id for r in after}
    near = [(a, b) for a, x in before for b, y in before if a is not None and b is not None and a < b and b >= 2000 and len(shingles(x or "") & shingles(y or "")) >= 0.8 * max(1, len(shingles(x or "") | shingles(y or "")))]
    assert len(near) > 20 and sum(a in kept and b in kept for a, b in near) <= 0.1 * len(near)
    assert {d for d, _ in before} - {b for _, b in near} <= kept
    before, after = seen["benchmark decontamination"]
    leaks = {d for d, t in before if any(x in (t or "") for x in items.values())}
    assert len(leaks) >= 19 and {r.doc_id for r in after} == {d for d, _ in before} - leaks
    before, after = seen["packing"]
    tokens = sum(len(packing.token_ids(t)) for _, t in before)
    assert sum(r.length for r in after) == tokens
    whole = corpus_pipeline.run(spark, folder)
    assert sorted(tuple(r) for r in whole.select("length", "ids_crc32").collect()) == sorted((r.length, r.ids_crc32) for r in after)
