"""The operators against brute force and round trips, on small tables with nulls, ties, repeats and clashing columns."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import common, components, decontamination, exact_dedup, licenses, packing, sharding, simhash, substring_dedup, toxicity, url_filter, warc

ALPHABET = "al be co du en fi go hu in jo ka li mo nu ox pa qi ro su te".split()


def words(rng, n):
    return [rng.choice(ALPHABET) + rng.choice(ALPHABET) + rng.choice(ALPHABET) for _ in range(n)]


def corpus():
    """(doc_id, text): copies, near copies, blanks, nulls, a long text, repeated rows, a null id."""
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, rng.randint(1, 120)))) for i in range(60)]
    base = words(rng, 150)
    for i in range(60, 70):
        w = list(base)
        w[i] = "changed"
        rows.append((i, " ".join(w)))
    rows += [(70, rows[3][1]), (71, rows[3][1].upper()), (72, ""), (73, None), (74, "  \t"), (75, "One"), (76, "ONE"), (77, " ".join(words(rng, 9000)))]
    rows += [(78, "Ünïcode Ä ß"), (79, "ünïcode Ä ß"), (80, rows[5][1]), (80, rows[5][1]), (None, rows[6][1]), (None, "alone")]
    return rows


SCHEMA = "doc_id long, text string, key string, n long, label string, size int, fp string, _row int, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "k", 1, "l", 2, "f", 3, "s") for d, t in corpus()], SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# 1


def plain_fingerprint(text, size=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))]
    ones = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if 2 * ones[i] > len(grams))


def test_codes_cover_within_their_radius():
    for name, (length, columns, radius) in simhash.CODES.items():
        leaders = simhash._patterns(name, 0)[0]
        assert (leaders[1] == 1).all(), "a perfect code has one leader for each syndrome"
        assert len(set(columns)) == length
        assert max(bin(int(e)).count("1") for e in leaders[2]) == radius


@pytest.mark.parametrize("blocks", [("golay", "golay"), ("golay", "golay", "hamming")])
def test_anchors_lose_no_link(blocks):
    rng = random.Random(1)
    x = np.array([rng.getrandbits(64) for _ in range(60)], dtype=np.uint64)
    homes = dict(zip(*(a.tolist() for a in simhash.anchors(x, blocks, 0)), strict=True))
    assert len(homes) == len(x)
    for i, v in enumerate(x.tolist()):
        for _ in range(20):
            y = v
            for b in rng.sample(range(64), rng.randint(0, 2)):
                y ^= 1 << b
            _, found = simhash.anchors(np.array([y], dtype=np.uint64), blocks, 2)
            assert homes[i] in set(found.tolist())
            assert len(set(found.tolist())) == len(found)


def test_replicas_are_not_broadcast(spark):
    prints = spark.range(50).select(F.col("id").alias("fp"))
    found = simhash.links(prints, 50)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    assert {(r.a, r.b) for r in found.collect()} == {(a, b) for a in range(50) for b in range(a + 1, 50) if (a ^ b).bit_count() <= 2}


def test_simhash_is_as_by_brute_force(docs):
    data = corpus()
    prints = [plain_fingerprint(t) for _, t in data]
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[root(i)].append(d)
    want = Counter((d, f"{prints[i]:016x}", min(least[root(i)], default=None)) for i, (d, _) in enumerate(data))
    assert Counter(rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id")) == want


def test_majority_of_few_and_many():
    rng = np.random.default_rng(1)
    for n in (1, 2, 255, 256, 1000):
        h = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > n)
        assert simhash.majority(h) == want


def test_near_copies_leave_one(docs):
    kept = rows_of(simhash.deduplicated(docs), "doc_id", "text", "_row")
    ids = [d for d, _, _ in kept]
    assert sum(60 <= d < 70 for d in ids if d is not None) == 1 and 60 in ids
    assert all(d in ids for d in range(60) if d not in (3, 5, 6)), "others stay"
    assert ids.count(None) == 1, "a null id and its copy, another text"


def test_block_changes_are_near_copies(spark):
    rng = random.Random(21)
    grown, cut, edited = [], [], []
    for i in range(40):
        w = words(rng, 150)
        grown.append((10 * i, " ".join(w), " ".join(w[:60] + words(rng, 24) + w[60:])))
        cut.append((1000 + 10 * i, " ".join(w[:130]) + " x", " ".join(w[:110])))
        e = list(w)
        e[20] = e[70] = e[120] = "edited"
        edited.append((2000 + 10 * i, " ".join([*w[:90], "y", *w[90:]]), " ".join([*e[:90], "y", *e[90:]])))

    for kind in (grown, cut, edited):
        d = spark.createDataFrame([(i, x) for i, x, _ in kind] + [(i + 1, y) for i, _, y in kind], "doc_id long, text string")
        pairs = {(r.x, r.y) for r in simhash.verified_pairs(d.withColumnRenamed("doc_id", "_key")).collect()}
        assert pairs == {(i, i + 1) for i, _, _ in kind}


def test_a_reordered_text_hides_no_near_copies(spark):
    rng = random.Random(22)
    w = words(rng, 150)
    swapped = list(w)
    swapped[40], swapped[41] = w[41], w[40]
    d = spark.createDataFrame([(1, " ".join(sorted(w))), (2, " ".join(w)), (3, " ".join(swapped))], "doc_id long, text string")
    assert {r.doc_id for r in simhash.deduplicated(d).collect()} == {1, 2}


def test_rows_with_one_doc_id_are_told_apart(spark):
    rng = random.Random(23)
    w, other = words(rng, 120), words(rng, 120)
    near = [*w[:60], "edited", *w[61:]]
    rows = [(1, " ".join(w)), (5, " ".join(near)), (5, " ".join(other)), (7, " ".join(words(rng, 100)))]
    left = rows_of(simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "text")
    assert (5, rows[2][1]) in left and (7, rows[3][1]) in left and len(left) == 3 and {rows[0][1], rows[1][1]} & {t for _, t in left}


def test_near_copies_are_found_in_numbers(spark):
    """Several hundred pairs just above the similarity, and groups whose least document is unlike the others."""
    rng = random.Random(24)
    rows, pairs = [], []
    for g in range(400):
        w = words(rng, rng.choice([60, 120, 200]))
        e = list(w)
        for k in rng.sample(range(len(e)), max(1, len(e) // 50)):
            e[k] = "edited"
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, e))
        rows += [(10 * g + 1, " ".join(w)), (10 * g + 2, " ".join(e))]
        if len(a & b) >= 0.8 * len(a | b):
            pairs.append((10 * g + 1, 10 * g + 2))
        if g % 4 == 0:  # shares two thirds with both
            cut = w[: 2 * len(w) // 3]
            rows.append((10 * g, " ".join(cut + words(rng, len(w) - len(cut)))))
    kept = {d for (d,) in rows_of(simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id")}
    assert len(pairs) > 250
    assert sum(a in kept and b in kept for a, b in pairs) <= 0.02 * len(pairs)
    assert len(kept) >= len(rows) - 400


def shuffle_files(spark):
    """Bytes of each."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName(): f.length() for f in map(files.apply, range(files.size())) if f.getName().startswith("shuffle_")}


def test_near_dedup_gives_its_disk_back(docs, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "work_dir", lambda spark: f"file://{tmp_path}")
    out = simhash.deduplicated(docs)
    names = [p.name for p in tmp_path.glob("*/*")]
    # of all tables that it writes, those that the result reads
    assert out.count() and set(names) <= {"several", "drop", "gone", "filter"} and len(names) == len(set(names))


def test_written_tables_leave_no_shuffle_files(docs, spark):
    before = shuffle_files(spark)
    counts = common.written(docs.groupBy("text").count(), "counts")
    for _ in range(20):  # they are removed beside what runs
        if not (left := shuffle_files(spark).keys() - before):
            break
        time.sleep(0.1)
    assert not left and counts.count()


def test_rows_that_stay_are_not_shuffled(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i if i % 7 else None, f"{i} {rng.randbytes(4000).hex()}") for i in range(400)]
    docs = common.written(spark.createDataFrame(rows, "doc_id long, text string"), "docs")
    key, text = F.col("doc_id"), F.sha2("text", 256)
    drop = docs.filter(F.col("text").startswith("7") | F.col("doc_id").isin(3, 5)).select(key, text)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = common.without(docs, [key, text], drop)
        before = shuffle_files(spark)
        out.write.parquet(f"file://{tmp_path}/out")
        moved = sum(n for name, n in shuffle_files(spark).items() if name not in before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert sorted(r.text for r in left) == sorted(t for d, t in rows if not t.startswith("7") and d not in (3, 5))
    assert moved < 0.1 * sum(len(t) / 2 for _, t in rows)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(70)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    edges += [(2000, 2000 + i) for i in range(1, 400)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = dict(rows_of(components.components(spark.createDataFrame(edges, "a long, b long")), "id", "component"))
    assert got == {i: root(i) for i in parent}


# 2


def test_smallest_capacity_by_brute_force():
    rng = random.Random(2)

    def best(sizes, shards):
        if shards == 1 or not sizes:
            return sum(sizes)
        return min(max(sum(sizes[:k]), best(sizes[k:], shards - 1)) for k in range(len(sizes) + 1))

    for _ in range(80):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 8))]
        runs = [(s, 1) for s in sizes] if rng.random() < 0.5 else sorted(Counter(sizes).items(), reverse=True)
        sizes = [s for s, n in runs for _ in range(n)]
        shards = rng.randint(1, 4)
        assert sharding.smallest_capacity(runs, shards) == best(sizes, shards)
        cuts = sharding._cut(runs, shards, sharding.smallest_capacity(runs, shards))
        at = [0, *(sum(n for _, n in runs[:r]) + u for r, u in cuts), len(sizes)]
        assert max(sum(sizes[a:b]) for a, b in zip(at, at[1:], strict=False)) == best(sizes, shards)


def test_plans_are_even():
    rng = random.Random(3)
    for _ in range(400):
        sizes = Counter(rng.choice([rng.randint(1, 10), rng.randint(1, 1000), 17]) for _ in range(rng.randint(1, 60)))
        runs, shards = sorted(sizes.items(), reverse=True), rng.randint(1, 9)
        plan, loads, longest_first = sharding.minimax_plan(runs, shards), [0] * shards, [0] * shards
        for size, n in runs:
            for rank in range(n):
                loads[plan.shard_of(size, rank)] += size
                longest_first[longest_first.index(min(longest_first))] += size
            assert size in plan.ranked_sizes() or plan.shard_of(size, 0) == plan.shard_of(size, n - 1)
        assert max(loads) <= 1.1 * max(longest_first)
    assert sharding.minimax_plan([], 3).shard_of(5) == 0


def test_shards(docs):
    out = sharding.shard_documents(docs, 7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in corpus())
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        of_text[(r.text_crc32, r["size"])].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 7
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())


def test_equal_sizes_are_cut_by_rank(spark):
    d = spark.createDataFrame([(i, f"text {i:04d}") for i in range(400)], "doc_id long, text string")
    n = Counter(r.shard for r in sharding.shard_documents(d).collect())
    assert len(n) == 40 and max(n.values()) == min(n.values()) == 10


# 3


def test_segments_are_those_of_the_definition():
    """Maximal segments by recursion: the best one (shortest, then first), then what is left and right of it."""

    def by_recursion(s, a, b):
        best, at = 0.0, None
        for i in range(a, b):
            t = 0.0
            for j in range(i, b):
                t += s[j]
                if t > best + 1e-12 or (at and abs(t - best) < 1e-12 and j + 1 - i < at[1] - at[0]):
                    best, at = t, (i, j + 1)
        return [] if at is None else by_recursion(s, a, at[0]) + [(*at, best)] + by_recursion(s, at[1], b)

    rng = random.Random(9)
    for _ in range(200):
        s = [rng.choice([-3.0, -2.5, -1.25, 1.0, 2.0, 3.5, 0.7]) + rng.random() / 64 for _ in range(rng.randint(0, 14))]
        got = toxicity.segments(s)
        want = by_recursion(s, 0, len(s))
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    bad = ["vilefool", "scumbag", "wretch"]
    rows, labels = [], []
    for i in range(1500):
        w, toxic = words(rng, rng.randint(20, 150)), rng.random() < 0.2
        if toxic:
            at = rng.randint(0, len(w))
            w[at:at] = [rng.choice(bad) for _ in range(rng.randint(3, 8))]
        rows.append((i, " ".join(w)))
        if i % 2 == 0 or zlib.crc32(str(i).encode()) % 3 == 1:
            labels.append((i, 1, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "x")]
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 0, 1), (7001, 0, None)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.scored(d, toxicity.fit(d, lab)).collect()}
    assert len(out) == len(rows)
    held = [(out[i], t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in held) and not out[None].held_out
    assert sum((r.score >= 0.7) == bool(t) for r, t in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    assert out[5000].score == out[5001].score < 0.7


@pytest.mark.parametrize("n", [300, 3000])
def test_few_labels_teach_too(spark, n):
    """200 labelled rows or 2000: the words that toxic rows share are learnt, and clean rows are left alone."""
    rng = random.Random(n)
    bad = ["vilefool", "scumbag", "wretch", "dimwit"]
    rows = []
    for i in range(n):
        w, toxic = words(rng, rng.randint(20, 150)), i % 6 == 0
        for _ in range(rng.randint(3, 6) if toxic else 0):
            w.insert(rng.randint(0, len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), int(toxic)))
    d, lab = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, t in rows if i % 3 < 2], "doc_id long, toxic int")
    out = {r.doc_id: r.predicted for r in toxicity.scored(d, toxicity.fit(d, lab)).filter("held_out").collect()}
    toxic = [out[i] for i, _, t in rows if t and i in out]
    assert sum(toxic) >= 0.9 * len(toxic)
    assert sum(out[i] for i, _, t in rows if not t and i in out) <= 0.01 * len(out)


def test_scores_are_as_by_the_definition(spark):
    """Every word a score, all segments of the whole sequence, their sum on the curve: against the sparse form that workers use."""
    rng = random.Random(31)
    m = toxicity.Model({"bad": (5.0, 2.5), "wors*": (4.0, 1.25), "worse": (3.0, 9.0)}, drift=-0.3, scale=0.8, log_k=-3.0, slope=2.0, shift=-3.0)
    texts = [None, "", " - ", "bad", "Worst WORSE bad"] + [" ".join(rng.choice(["x", "bad", "worst", "worse", "é", "fine"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [" ".join(["x"] * 40_000 + ["bad"] * 5 + ["y"] * 40_000)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.scored(d, m).collect():
        w = (texts[r.doc_id] or "").lower().replace("-", " ").split()
        found = [(a, b, 0.8 * x + 3.0 - np.log(len(w))) for a, b, x in toxicity.segments([{"bad": 2.5, "worst": 1.25, "worse": 1.25}.get(x, -0.3) for x in w])]
        found = [x for x in found if x[2] >= 0]
        score = 1 / (1 + np.exp(-(2.0 * np.log1p(sum(x[2] for x in found)) - 3.0)))
        best = max(found, key=lambda x: x[2], default=(None, None, None))
        assert abs(r.score - score) < 1e-9 and r.n_passages == len(found) and r.predicted == int(score >= 0.7)
        assert (r.first_word, r.last_word) == (best[0], best[1] and best[1] - 1)


def test_toxicity_without_labels(docs, spark):
    m = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.scored(docs, m).count() == len(corpus())
    assert toxicity.clean_only(docs, m).columns == docs.columns


# 4

MIT = licenses.TEMPLATES[7][0]


def test_licenses(spark):
    texts = [
        (1, "The MIT License, and the mit-license: MIT LICENSE mit license"), (2, "GNU General\nPublic   License v3"), (3, None), (4, ""), (5, "summit license"),
        (6, "x\n" + MIT.replace("free of charge, ", "") + "\ny"), (7, "Released under the MIT License."), (8, "Licensed under CC BY-NC 4.0."), (9, "apache\x85license"),
        (10, "mit lıcense Mİt license"), (10, "general public general public license"),
    ]
    out = {(r.doc_id, r.n_words): r for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    one = next(r for (d, _), r in out.items() if d == 1)
    assert (one.n_base, one.first_word, one.last_word, one.base_labels, one.score) == (4, 1, 9, "mit", 1.0)
    two = next(r for (d, _), r in out.items() if d == 2)
    assert (two.n_base, two.first_word, two.base_labels) == (1, 1, "gpl")
    assert out[(3, 0)].labels == "" and out[(3, 0)].first_word is None and out[(4, 0)].score == 0
    assert out[(5, 2)].n_base == 0
    six = next(r for (d, _), r in out.items() if d == 6)
    assert six.labels == "mit-text" and 0.8 <= six.score < 1
    assert next(r for (d, _), r in out.items() if d == 7).labels == "mit,mit-notice"
    assert next(r for (d, _), r in out.items() if d == 8).labels == "cc-by-4.0,cc-by-nc-4.0,cc-by-sa-4.0"
    assert out[(9, 1)].n_base == 0
    assert out[(10, 5)].base_labels == "gpl" and out[(10, 5)].first_word == 2


def test_license_join_is_as_by_brute_force(spark):
    rng = random.Random(8)
    vocabulary = "a b c d e f g h i j k l".split()
    templates = [(" ".join(rng.sample(vocabulary, rng.randint(2, 9))), f"t{i}") for i in range(12)]
    rows = [(i, "\n".join(" ".join(rng.choices([*vocabulary, "zz"], k=rng.randint(0, 14))) for _ in range(3))) for i in range(120)]
    got = dict(rows_of(licenses.template_matches(spark.createDataFrame(rows, "doc_id long, text string"), templates), "doc_id", "labels"))
    for i, text in rows:
        want = {lab for t, lab in templates for line in text.split("\n") if len(set(t.split()) & set(line.split())) >= licenses.needed(len(set(t.split())), 0.8)}
        assert set(got.get(i, [])) == want


# 5


def test_packing(docs):
    tok = packing._exact(packing.vocabulary_path("json"))
    out = packing.packed(docs, 256).collect()
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append(r)
    for d, t in corpus():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        if d is None or d == 80:
            continue
        at = 0
        for r in sorted(got[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert len(got[80]) == 2 * len([r for r in got[5]]) and len(got[None]) >= 2
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 256
    assert sorted(by) == list(range(len(by)))


def test_fast_ids_are_the_exact_ones():
    tok = packing._exact(packing.vocabulary_path("json"))
    for t in ["", " ", "a  b\n\n c\t", "It's 12,345€ – naïve… ", "é" * 50, "x" * 3000, "<|endoftext|> y", "日本語 text", "\x85\xa0 z", "'s't're ¿qué? \x1c\x1d", "a" * 999 + " b"] + [t for _, t in corpus() if t]:
        assert packing.token_ids(t) == [*tok.encode(t, add_special_tokens=False).ids, 1]


def test_patterns_hold_every_piece():
    rng = random.Random(6)
    h = Counter(rng.randint(1, 64) for _ in range(500))
    found = packing.patterns(h, 64)
    assert sum((Counter({n: c * k for n, c in Counter(p).items()}) for k, p in found), Counter()) == h
    assert all(sum(p) <= 64 for _, p in found)
    assert sum(k for k, _ in found) <= 1.03 * sum(n * c for n, c in h.items()) / 64 + 1


# 6


def plain_lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("capacity", [3, 10**6])
def test_exact_dedup(docs, capacity):
    groups = defaultdict(list)
    for d, t in corpus():
        groups[plain_lower(t)].append(d)
    want = Counter()
    for d, t in corpus():
        g = groups[plain_lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        want[(d, keep, len(g), d == keep, hashlib.sha256(plain_lower(t).encode()).hexdigest())] += 1
    assert Counter(rows_of(exact_dedup.exact_groups(docs, capacity), "doc_id", "keep_id", "group_size", "kept", "text_sha256")) == want


def test_texts_behind_one_key_are_told_apart_by_their_bytes(docs, monkeypatch):
    """With keys of 3 values all texts collide: chains of different texts hang from each key."""
    want = Counter(rows_of(exact_dedup.exact_groups(docs, 3), "doc_id", "keep_id", "group_size", "text_sha256"))
    monkeypatch.setattr(exact_dedup, "key_of", lambda norm: F.length(norm) % 3 * (1 << 60) - (1 << 62))
    assert Counter(rows_of(exact_dedup.exact_groups(docs, 3), "doc_id", "keep_id", "group_size", "text_sha256")) == want
    texts = [plain_lower(t) for _, t in rows_of(exact_dedup.deduplicated(docs), "doc_id", "text")]
    assert sorted(texts) == sorted({plain_lower(t) for _, t in corpus()})


def test_rows_meet_entries_through_the_directory(docs, monkeypatch):
    """Rows that look in a wrong bucket find nothing."""
    rows, entries, buckets = exact_dedup.index(docs, 3)
    n = entries.select("bucket").distinct().count()
    assert len(buckets) > 10 and n > 10
    right = exact_dedup._groups(docs, rows, entries)
    assert right.count() == len(corpus())
    wrong = exact_dedup._groups(docs, rows.withColumn("bucket", F.col("bucket") + 1), entries)
    assert wrong.count() < right.count() / 2


def test_deduplicated_keeps_one_row_of_each_text(docs):
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    texts = [plain_lower(t) for _, t in rows_of(out, "doc_id", "text")]
    assert sorted(texts) == sorted({plain_lower(t) for _, t in corpus()})


def test_directory_splits_what_is_overfull():
    rng = random.Random(1)
    counts = Counter(rng.choice([rng.randint(0, 65535), 77]) for _ in range(2000))
    depth, buckets = exact_dedup.directory(counts, 100)
    assert depth == 16 and sum(b.entries for b in buckets) == 2000
    assert all(b.entries <= 100 or b.depth == 16 for b in buckets)
    covered = [k for b in buckets for k in range(b.first(16), b.first(16) + (1 << (16 - b.depth)))]
    assert covered == list(range(65536))
    assert exact_dedup.directory({}, 100) == (0, [exact_dedup.Bucket(0, 0, 0)])


# 7


def test_compact_windows_hold_every_long_range():
    rng = np.random.default_rng(2)
    for n in (0, 5, 30, 90):
        x = rng.integers(0, 1 << 62, n).astype(np.uint64) << np.uint64(1)
        w = list(zip(*(v.tolist() for v in substring_dedup.compact_windows(x, np.array([0]), np.array([n]), 6)), strict=True))
        for a in range(n):
            for b in range(a + 6, n + 1):
                c = a + int(x[a:b].argmin())
                hits = [v for v in w if v[0] <= a and b <= v[2] and a <= v[1] < b]
                assert len(hits) == 1 and x[hits[0][1]] == x[c]
    ends = np.array([20, 20000, 20050])
    left, c, right = substring_dedup.compact_windows(np.ones(20050, dtype=np.uint64), np.array([0, 20, 20000]), ends)
    assert len(c) < 4 * 20000 / 46 and set(np.searchsorted(ends, c, "right").tolist()) == {1, 2}


def test_words_have_hashes_of_their_own():
    long = "x" * (substring_dedup.PIECE * 3)
    texts = [None, "", " \t", "a", " a  b\tC\x0bc\x0cD d\x1c e\r\nf ", "a\x00 a \x00a", "\u0130 I i \u00e9 e", f"{long} b {long}y b {long}", "one two three " * 20_000]
    seen: dict[bytes, int] = {}
    for text in texts:
        words, hashes = (text or "").encode().lower().split(), substring_dedup.word_hashes(text).tolist()
        assert len(words) == len(hashes)
        assert all(seen.setdefault(w, h) == h for w, h in zip(words, hashes, strict=True))
    assert len(set(seen.values())) == len(seen)


def test_equal_ranges_have_equal_hashes():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 62, 500).astype(np.uint64) * np.uint64(3)
    x[300:400] = x[100:200]
    h = substring_dedup.range_hashes(x)
    assert len(h) == 455 and (h[300:355] == h[100:155]).all() and len(set(h.tolist())) == 400


@pytest.mark.parametrize("length", [50, 55, 60, 65, 70, 75])
def test_one_edit_leaves_a_passage(length):
    rng = random.Random(length)
    for at in range(5, length - 5):
        w = words(rng, length)
        e = [*w[:at], "edited", *w[at + 1 :]]
        a, b = (substring_dedup.shingles(" ".join(words(rng, 30) + x + words(rng, 30))) for x in (w, e))
        assert [x[:4] for x in substring_dedup.compare(a, b)] == [(30, 30 + length - 4, 30, 30 + length - 4)]


def test_repeated_passages(spark):
    rng = random.Random(11)
    shared, near = words(rng, 60), words(rng, 120)
    edited = list(near)
    edited[40] = "edited"
    rows = [(i, " ".join(words(rng, 80))) for i in range(30)]
    rows += [(100 + i, " ".join(words(rng, 30 + 7 * i) + shared + words(rng, 40))) for i in range(20)]
    rows += [(200, " ".join(words(rng, 50) + near + words(rng, 50))), (201, " ".join(words(rng, 11) + edited)), (300, rows[0][1]), (301, "la " * 3000), (302, None), (303, ""), (None, rows[0][1])]
    d = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, key int")
    out = defaultdict(list)
    for r in substring_dedup.repeated_passages(d).collect():
        out[r.doc_id].append(r)
    for i in range(20):
        (r,) = out[100 + i]
        assert r.class_id == 100 and r.first_word <= 30 + 7 * i + 4 and r.last_word >= 30 + 7 * i + 55
    assert out[200] and out[201] and out[201][0].class_id == 200
    assert out[0][0].class_id == 0 and out[300][0].class_id == 0 and (out[300][0].first_word, out[300][0].last_word) == (0, 79)
    assert set(out) == {0, 300, 200, 201, *range(100, 120)}


@pytest.mark.parametrize(("size", "rows"), [(300, 3000), (1, 3000), (1, 1)])
def test_a_document_that_repeats_a_passage_has_all_places(spark, monkeypatch, size, rows):
    monkeypatch.setattr(substring_dedup, "ROWS", rows)
    rng = random.Random(14)
    once, twice = words(rng, 60), words(rng, 60)
    texts = [words(rng, 30) + once + words(rng, 200) + once + words(rng, 30), once + words(rng, 30), words(rng, 80) + twice + words(rng, 40) + twice]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(substring_dedup, "SLICE", size)
    out = {(r.doc_id, r.first_word, r.last_word) for r in substring_dedup.repeated_passages(d).collect()}
    assert out == {(0, 30, 89), (0, 290, 349), (1, 0, 59)}


@pytest.mark.parametrize("length", [50, 52, 60])
def test_a_line_of_a_passage_hides_no_passages(spark, length):
    """A document with the first 49 words only comes first, and the two that share the passage must still meet."""
    rng = random.Random(length)
    rows = []
    for g in range(100):
        p = words(rng, length)
        rows += [(3 * g, " ".join(words(rng, 20) + p[:49] + words(rng, 40))), (3 * g + 1, " ".join(words(rng, 30) + p + words(rng, 40))), (3 * g + 2, " ".join(words(rng, 10) + p + words(rng, 40)))]
    out = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.first_word, r.last_word) for r in out}
    want = {(3 * g + 1, 30, 29 + length) for g in range(100)} | {(3 * g + 2, 10, 9 + length) for g in range(100)}
    # a line with a few words of its own around it can be similar enough to be a passage with edits, which then is wider
    assert {d for d, _, _ in want} <= {d for d, _, _ in got} and len(want & got) >= 0.98 * len(want)
    assert len({d for d, _, _ in got} - {d for d, _, _ in want}) <= 2


def test_exact_passages_are_as_by_all_pairs(spark):
    """Every document that shares 50 words with another one, by the ranges of 50 words of all pairs."""
    rng = random.Random(17)
    pool = [words(rng, rng.choice([44, 49, 50, 51, 53, 60, 90])) for _ in range(25)]
    rows = []
    for i in range(160):
        w = words(rng, rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(pool)
            k = rng.choice([0, 0, rng.randint(0, len(p))])
            w += [*(p[k:] if rng.random() < 0.5 else p[: len(p) - k]), *words(rng, rng.randint(0, 30))]
        rows.append((i, " ".join(w)))
    ranges = defaultdict(set)
    for i, t in rows:
        for k in range(len(t.split()) - 49):
            ranges[tuple(t.split()[k : k + 50])].add((i, k))
    want = defaultdict(set)
    for places in ranges.values():
        if len({i for i, _ in places}) > 1:
            for i, k in places:
                want[i] |= set(range(k, k + 50))
    got = defaultdict(set)
    for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id] |= set(range(r.first_word, r.last_word + 1))
    assert set(want) <= set(got) and len(want) > 60
    missed = sum(len(want[i] - got[i]) for i in want)
    assert missed <= 0.002 * sum(map(len, want.values())), "words of exact passages without a row"
    assert sum(len(got[i] - want[i]) for i in got) <= 0.15 * sum(map(len, got.values())), "the rest are passages with edits"


def test_passages_of_rows_that_share_a_doc_id(spark):
    rng = random.Random(18)
    p, q = words(rng, 70), words(rng, 70)
    rows = [(5, p + words(rng, 30)), (5, q + words(rng, 40)), (6, words(rng, 9) + p), (3, words(rng, 8) + q), (8, p + words(rng, 5)), (8, p + words(rng, 6)), (9, p[:1] * 60), (9, p[:1] * 60)]
    out = substring_dedup.repeated_passages(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.first_word, r.class_id) for r in out} == {(5, 0, 5), (6, 9, 5), (8, 0, 5), (5, 0, 3), (3, 8, 3)}


# 8


def test_decontamination(spark):
    rng = random.Random(12)
    items = [(i, " ".join(words(rng, 30))) for i in range(5)]
    items += [(10, "A train leaves Berlin at 9 km 300 and then train returns from Berlin after 45 minutes with 300 people in total aboard"), (11, None), (12, ""), (None, "x y z"), (13, "two words")]
    other = items[5][1].replace("Berlin", "Madrid").replace("300", "512").replace("45", "17")
    broken = items[5][1].replace("300", "512", 1).replace("Berlin", "Madrid", 1)
    noise = lambda n: " ".join(words(rng, n))
    docs = [(1, f"{noise(40)} {items[0][1].upper()}, {noise(50)}"), (2, noise(300)), (3, f"so {other} then"), (4, f"so {broken} then"), (5, None), (6, ""), (7, "two words"), (8, f"{' '.join(items[1][1].split()[:15])} {noise(60)}"), (None, items[2][1])]
    d, b = spark.createDataFrame([(*x, "k") for x in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    out = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(d, b).collect()}
    assert set(out) == {(1, 0), (3, 10), (4, 10), (7, 13), (None, 2)}
    assert out[(1, 0)].contaminated and out[(3, 10)].contaminated and out[(3, 10)].n_slots > 0 and not out[(4, 10)].contaminated
    left = decontamination.decontaminated(d, b)
    assert left.columns == d.columns and {r.doc_id for r in left.collect()} == {2, 4, 5, 6, 8}


def test_decontamination_windows_are_as_by_brute_force(spark):
    rng = random.Random(13)
    items = [(i, " ".join(words(rng, rng.randint(5, 20)))) for i in range(12)]
    docs = []
    for i in range(80):
        w = words(rng, rng.randint(0, 60))
        if i % 3 == 0:
            t = rng.choice(items)[1].split()
            k = rng.randint(len(t) // 2, len(t))
            w[5:5] = t[:k]
        docs.append((i, " ".join(w)))
    shingled = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} if len(t.split()) >= 5 else {tuple(t.split())} - {()}
    want = {(d, i) for d, t in docs for i, x in items if len(shingled(x) & shingled(t)) >= 0.8 * len(shingled(x))}
    out = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert set(rows_of(out, "doc_id", "item_id")) == want


def test_a_benchmark_beyond_the_broadcast_gives_the_same(spark, monkeypatch):
    rng = random.Random(15)
    items = [(i, " ".join(words(rng, rng.randint(3, 20)))) for i in range(30)] + [(50, "all of them share these few words")]
    docs = [(i, " ".join(words(rng, 20) + (rng.choice(items)[1] if i % 2 else "").split() + "so all of them share these few words x".split())) for i in range(400)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = Counter(map(tuple, decontamination.contaminated(d, b).collect()))
    assert len(want) > 550 and len([1 for r in want if r[1] == 50]) == 400
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", 0)
    monkeypatch.setattr(decontamination, "MOST_BITS", 1 << 10)
    assert Counter(map(tuple, decontamination.contaminated(d, b).collect())) == want


def plain_canonical(word):
    return "#" if word[0].isdigit() else "@" if word[0].isupper() else word


def plain_contaminated(item, doc):
    """By the definition, for texts in which every capitalised word follows another word; None below the containment."""
    size = min(5, len(item))
    cut = lambda t: [tuple(map(plain_canonical, t[i : i + size])) for i in range(len(t) - size + 1)]
    ours, theirs = cut(doc), cut(item)
    width, need = len(set(theirs)), 0.8 * len(set(theirs)) - 1e-9
    if len(set(ours) & set(theirs)) < need:
        return None
    if not any(plain_canonical(w) in "#@" for w in item):
        return True
    hits = [(p - q, q, p) for q, w in enumerate(theirs) for p, v in enumerate(ours) if v == w]
    for start in {h[0] for h in hits}:
        taken = {}
        for shift, q, p in sorted(h for h in hits if start <= h[0] < start + width):
            taken.setdefault(q, p)
        values = defaultdict(set)
        for q, p in taken.items():
            for k in range(size):
                if plain_canonical(item[q + k]) in "#@":
                    values[item[q + k].lower()].add(doc[p + k].lower())
        if len({theirs[q] for q in taken}) >= need and all(len(v) == 1 for v in values.values()):
            return True
    return False


def test_slots_are_as_by_brute_force(spark):
    """Words inserted, left out and changed, values swapped for all or for some places, two occurrences, stray windows."""
    rng = random.Random(16)
    names, plain = "Berlin Madrid Paris Oslo Rome Bern".split(), "so it goes from there and back by then".split()
    item = lambda n: ["the", *(rng.choice([rng.choice(plain), rng.choice(plain), rng.choice(names[:3]), str(rng.randint(1, 3))]) for _ in range(n))]
    items = [item(n) for n in (1, 2, 3, 5, 8, 12, 18, 18, 25, 25, 40)] + [["the", "train", "from", "Berlin", "to", "Rome", "leaves", "Berlin", "at", "5"] * 2]

    def changed(t):
        mapping = {v: rng.choice([v, rng.choice(names), str(rng.randint(4, 9))]) for v in t if plain_canonical(v) in "#@"}
        mapping = {v: x if plain_canonical(v) == plain_canonical(x) else v for v, x in mapping.items()}
        t = [mapping.get(w, w) for w in t]
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            k = rng.randrange(len(t) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                t[k:k] = ["extra"]
            elif kind == 1 and len(t) > 1:
                del t[k : k + 1]
            elif kind == 2:
                t[k:k] = t[:6]
            elif k < len(t) and plain_canonical(t[k]) in "#@":
                t[k] = rng.choice(names) if plain_canonical(t[k]) == "@" else str(rng.randint(4, 9))
        return t

    docs = []
    for _ in range(250):
        t = ["so"]
        for _ in range(rng.randint(1, 3)):
            t += [*words(rng, rng.randint(0, 12)), *changed(list(rng.choice(items)))]
        docs.append([w for w in t if w])
    d = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.contaminated for r in decontamination.contaminated(d, b).collect()}
    want = {(i, j): c for i, t in enumerate(docs) for j, x in enumerate(items) if (c := plain_contaminated(x, t)) is not None}
    assert got == want
    assert len(want) > 300 and sum(want.values()) > 200 and len(want) - sum(want.values()) > 20


def test_an_inserted_word_makes_no_slot_consistent(spark):
    item = "the train that leaves from Berlin at nine goes by way of some other town where it waits for half an hour or a little more and then turns back to Berlin"
    texts = [item.replace("Berlin", "Madrid", 1), item.replace("Berlin", "Madrid", 1).replace("way of", "way indeed of"), item.replace("Berlin", "Madrid").replace("way of", "way indeed of")]
    texts += ["a quick little phrase inside a sentence", "a quick phrase", "long " * 30_000 + item]
    d, b = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame([(0, item), (1, "quick little phrase")], "item_id long, text string")
    out = {(r.doc_id, r.item_id): r.contaminated for r in decontamination.contaminated(d, b).collect()}
    assert out == {(0, 0): False, (1, 0): False, (2, 0): True, (3, 1): True, (5, 0): True}


# 9


def test_urls(spark):
    urls = [
        (1, "HTTP://A.Example.NET/en/x?y"), (2, "https://example.net/de/"), (3, "http://b.org/fr/q#t"), (4, "ftp://org/fr"), (5, None), (6, "no scheme"), (7, "x://example.com/de/1://z"),
        (8, "http://notexample.com/de/"), (9, "http://ads.x.com/p"), (10, "http://y.net"), (11, "http://ads.x.com/p"), (None, ""),
    ]
    p = spark.createDataFrame([(*u, "h") for u in urls], "page_id long, url string, host string")
    out = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(p, spark.createDataFrame([("ads.x.com/p",), ("y.net",), ("gone/",)], "key string")).collect()}
    assert out[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert out[2] == ("example.net", "/de/", "net/", "block")
    assert out[3] == ("b.org", "/fr/q", "org/fr/", "allow")
    assert out[4] == ("org", "/fr", None, "allow") and out[5] == out[6] == ("", "", None, "allow")
    assert out[7] == ("example.com", "/de/1://z", "example.com/de/", "block")
    assert out[8][2:] == (None, "allow") and out[9][2:] == (None, "block") == out[11][2:]
    assert out[10] == ("y.net", "", None, "block")
    thin = spark.createDataFrame([("http://A.b/c?d", "x"), ("http://A.b/c", "y" * 700), ("http://a.b/C", "é" * 299), ("http://a.b/d", "é" * 300), ("none", None)], "url string, html string")
    assert sorted(rows_of(url_filter.thin_pages(thin, 600), "key")) == [("",), ("a.b/C",), ("a.b/c",)]


@pytest.mark.parametrize("most", [40, 10**6])
def test_the_cascade_is_exact(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "MOST_KEYS", most)
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 2)
    monkeypatch.setattr(url_filter, "LEAST_BITS", 64)
    p = spark.createDataFrame([(i, f"http://h{i % 300}.info/p{i % 700}") for i in range(2100)], "page_id long, url string")
    keys = [f"h{i % 300}.info/p{i % 700}" for i in range(2100)]
    listed = {k for k in keys if zlib.crc32(k.encode()) % 4 == 0}
    out = url_filter.judge(p, spark.createDataFrame([(k,) for k in [*listed, "gone/x"]], "key string")).collect()
    assert {r.page_id for r in out if r.verdict == "block"} == {i for i, k in enumerate(keys) if k in listed} and len(out) == 2100


# 10


def test_warc(spark):
    big = "é<p>" + "x" * 1200 + "\r\n\r\nWARC/1.0\r\n\n"
    pages = [(1, "http://a/ b\n", big), (2, None, big), (9, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (-6, "u", ""), (7, "u", "y" * 70000), (8, "u", "z" * 1000), (8, "u", "z" * 1000), (None, "u", big)]
    d = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, value int")
    out = Counter(rows_of(warc.archived(d), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    want = Counter()
    for i, _, h in pages:
        b = (h or "").encode()
        again = h == big and i != 9
        want[(i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 9 if again else None)] += 1
    assert out == want


def test_arc_headers_of_both_versions():
    import io

    body = b"HTTP/1.0 200 OK\r\n\r\n<html>"
    for v in (1, 2):
        text = (warc.arc_version_block(v) + "\n" + warc.arc_header(v, "http://a/b c", "19961105142103", "text/html", len(body)) + "\n").encode() + body + b"\n"
        ((fields, block),) = warc.parse_arc(io.BytesIO(text))
        assert fields["URL"] == "http://a/b c" and fields["Archive-date"] == "19961105142103" and block == body
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(b"http://a 0.0.0.0 19961105142103 text/html 99\nshort")))
    with pytest.raises(ValueError):
        list(warc.parse_arc(io.BytesIO(b"nonsense\n")))


# all


def test_empty_tables(none, spark):
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    model = toxicity.fit(none, labels)
    for df in (
        simhash.near_duplicates(none), simhash.deduplicated(none), sharding.shard_documents(none), toxicity.scored(none, model), toxicity.clean_only(none, model), licenses.license_scan(none),
        packing.packed(none), exact_dedup.exact_groups(none), exact_dedup.deduplicated(none), substring_dedup.repeated_passages(none), decontamination.contaminated(none, bench),
        decontamination.decontaminated(none, bench), url_filter.judge(pages, url_filter.thin_pages(pages)), warc.archived(pages),
    ):
        assert df.count() == 0


def test_operators_take_every_row(docs):
    n = len(corpus())
    assert simhash.near_duplicates(docs).count() == n and licenses.license_scan(docs).count() == n
    assert docs.agg(F.count("*")).first()[0] == n
