"""All queries against their SQL at the smallest size, and behaviour that SQL doesn't show."""

import datetime
import os

import pytest

import __spark_entry__ as entry
from quire import catalog
from quire.operators import ingest, mutations, search
from quire.operators.ordering import keep_first

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(catalog.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == theirs


@pytest.mark.parametrize(("name", "read"), [("stream_ingest", "documents"), ("base_stream_tumbling", "events")])
def test_streams_read_tables_of_several_files(spark, duck, tmp_path, name, read):
    spark.read.parquet(f"{SF}/{read}.parquet").repartition(3).write.parquet(f"file://{tmp_path}/{read}.parquet")
    want = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    theirs = sorted(tuple(plain(v) for v in r) for r in want.fetchall())
    assert theirs
    assert sorted(tuple(plain(r[c]) for c in columns) for r in catalog.QUERIES[name](spark, f"file://{tmp_path}").collect()) == theirs


def test_queries_without_sql_run(spark):
    for name in sorted(set(catalog.QUERIES) - set(catalog.SQL)):
        assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_translations_come_first_and_can_hide_originals(spark):
    hits = search.keyword(spark, SF, "the", "both", "block", 5).collect()
    assert [h.source for h in hits] == ["block_mt"] * 5
    assert {h.source for h in search.keyword(spark, SF, "the", "original", "page", 5).collect()} == {"page_original"}
    assert search.ui(spark, SF, "the", "all", 3).count() == 12
    assert search.ui(spark, SF, " ", "all", 3).count() == 0
    assert all("<mark>" in h.snippet for h in search.ui(spark, SF, "the", "all", 3).collect())


def test_index_answers_as_the_scan(spark, tmp_path):
    from quire.functions import fulltext
    from quire.sources.tables import blocks

    b = blocks(spark, SF)
    search.write_index(search.token_table(b, "block_id", "text"), f"file://{tmp_path}/index")
    index = spark.read.parquet(f"file://{tmp_path}/index")
    for q in ("the and", "die der", "zzz", " "):
        got = {r.block_id for r in search.search_tokens(index, "block_id", q).collect()}
        assert got == {r.block_id for r in b.filter(fulltext.matches(b["text"], q)).select("block_id").collect()}


def test_injected_duplicates_go(spark):
    d = spark.createDataFrame([("a", 1, 0), ("a", 1, 1), ("b", 1, 2)], "source string, k int, at int")
    assert {(r.source, r.at) for r in keep_first(d, ["source", "k"], ["at"]).collect()} == {("a", 0), ("b", 2)}


def test_ingest_truth_table(spark):
    files = [(i, h, m) for i, (h, m) in enumerate((h, m) for h in ("new", "there", "lost") for m in range(4))]
    f = spark.createDataFrame(files, "i int, content_hash string, mode int")
    e = spark.createDataFrame([(5, "there", True), (3, "there", True), (4, "lost", False)], "doc_id long, content_hash string, source_present boolean")
    out = {(r.content_hash, r["mode"]): (r.outcome, r.duplicate_status, r.schedule, r.canonical_id) for r in ingest.ingest(f, e).collect()}
    for m in range(4):
        assert out[("new", m)] == ("created", "unique", "default", None)
    assert out[("there", 0)] == ("duplicate_created", "member", "default", 3)
    assert [out[("there", m)][2] for m in (1, 2, 3)] == ["none", "repair", "redo"]
    assert all(out[("there", m)][:2] == ("duplicate", None) for m in (1, 2, 3))
    assert all(out[("lost", m)][:3] == ("repaired", "canonical", "default") for m in (1, 2, 3))


def test_deletion_cascades_and_can_be_repeated(spark):
    t = {
        "documents": spark.createDataFrame([(1,), (2,)], "doc_id long"),
        "pages": spark.createDataFrame([(1, 10), (2, 20)], "doc_id long, page_id long"),
        "blocks": spark.createDataFrame([(10, 100), (20, 200)], "page_id long, block_id long"),
        "page_mt": spark.createDataFrame([(10,), (20,)], "page_id long"),
        "block_mt": spark.createDataFrame([(100,), (200,)], "block_id long"),
    }
    ids = spark.createDataFrame([(1,), (9,)], "doc_id long")
    once = mutations.deleted(t, ids)
    assert {k: v.count() for k, v in once.items()} == dict.fromkeys(t, 1)
    assert {k: v.count() for k, v in mutations.deleted(once, ids).items()} == dict.fromkeys(t, 1)


def test_missing_documents_and_pages(spark):
    with pytest.raises(LookupError, match="no document"):
        ingest.page_detail(spark, SF, 10**9, 1)
    with pytest.raises(LookupError, match="no page"):
        ingest.page_detail(spark, SF, 1, 999)
