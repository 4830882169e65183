"""Exact deduplication over an extendible-hash index on shared files.

1. Every row gets a 64-bit key of its normalised text. A pre-aggregation leaves one index entry for each key, so copies
   never meet in a bucket and a hot group is one entry.
2. The directory starts with one bucket. A bucket with more entries than its capacity is split on the next bit of the
   key; when its local depth equals the directory's, the directory doubles. Only counts by key prefix reach the driver
   (2**MAX_DEPTH rows at most), never keys.
3. Entries are written to shared files by bucket. Owner tasks hold contiguous ranges of buckets and so of keys; a bucket
   that is still overfull at MAX_DEPTH is shared by several owners. Rows find their bucket by the directory and their
   entry by bucket and key.
4. Keys that more than one row carries are chained: in each bucket their rows are grouped by key and text, which compares
   bytes, and every different text behind one key becomes a link of the chain. Rows of a key with one link take that link;
   rows of a key with several find theirs by the bytes of the text. Keys with one row need no comparison, so unique texts
   are never shuffled.

Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import ascii_lower, attach, likely, table, without, written

#: Entries in a bucket before it is split.
CAPACITY = 20_000
#: Key bits that the directory may use at most: 65,536 counts are the most that the driver gets.
MAX_DEPTH = 16


@dataclass(frozen=True)
class Bucket:
    prefix: int
    depth: int
    entries: int

    def first(self, depth: int) -> int:
        return self.prefix << (depth - self.depth)


def directory(counts: dict[int, int], capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[int, list[Bucket]]:
    """Global depth, and the buckets in key order, for counts by the top max_depth bits of the key."""
    below: list[dict[int, int]] = [counts]
    for _ in range(max_depth):
        up: dict[int, int] = {}
        for k, v in below[-1].items():
            up[k >> 1] = up.get(k >> 1, 0) + v
        below.append(up)
    at = lambda prefix, depth: below[max_depth - depth].get(prefix, 0)
    depth, done, work = 0, [], [Bucket(0, 0, at(0, 0))]
    while work:
        b = work.pop()
        if b.entries <= capacity or b.depth == max_depth:
            done.append(b)
            continue
        if b.depth == depth:
            depth += 1  # the directory doubles
        work += [Bucket(p, b.depth + 1, at(p, b.depth + 1)) for p in (2 * b.prefix + 1, 2 * b.prefix)]
    return depth, sorted(done, key=lambda b: b.first(max_depth))


def key_of(norm: Column) -> Column:
    return F.xxhash64(norm)


def _prefix(key: Column, bits: int) -> Column:
    """The top bits of the key, unsigned."""
    return F.shiftrightunsigned(key, 64 - bits).cast("int") if bits else F.lit(0)


def _bucket(key: Column, depth: int, buckets: list[Bucket]) -> Column:
    """Number of the bucket, by the directory as an array of 2**depth entries."""
    slots = [0] * (1 << depth)
    for i, b in enumerate(buckets):
        for k in range(b.first(depth), b.first(depth) + (1 << (depth - b.depth))):
            slots[k] = i
    listed = F.split(F.lit(",".join(map(str, slots))), ",").cast("array<int>")
    return F.coalesce(F.get(listed, _prefix(key, depth)), F.lit(0))


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, norm, key) of every row."""
    rows = docs.select(F.col("doc_id").cast("long"), ascii_lower(F.col("text")).alias("norm"))
    # a key is never null; said so, no join adds a filter that would compute it again
    return rows.select("doc_id", "norm", F.coalesce(key_of(F.col("norm")), F.lit(0).cast("long")).alias("key"))


def index(docs: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, list[Bucket]]:
    """Rows (doc_id, key, text_sha256, bucket), the index on shared files with one entry (bucket, key, n, last) for each key, and
    the directory's buckets."""
    rows = written(_texts(docs).select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), "rows")
    entries = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")), "entries")
    counts = entries.groupBy(_prefix(F.col("key"), MAX_DEPTH).alias("k")).count()
    depth, buckets = directory({r[0]: r[1] for r in counts.collect()}, capacity)
    bucket = _bucket(F.col("key"), depth, buckets).alias("bucket")
    owned = entries.select(bucket, "key", "n", "last").repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key")
    return rows.select("doc_id", "key", "text_sha256", bucket), written(owned, "index"), buckets


def _groups(docs: DataFrame, rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, text_sha256, keep_id, group_size) of every row."""
    several = written(entries.filter("n > 1").select("bucket", "key", "n"), "several")
    met = likely(_texts(docs), "key", several.select("key"))
    links = met.groupBy("key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    links = written(links.join(several, "key").select("bucket", "key", F.sha2("norm", 256).alias("link"), "keep_id", "group_size", "n"), "links")
    chains = links.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("n_links")).filter("n_links > 1").select("key")
    chains = written(chains, "chains")
    at = F.struct("bucket", "key").alias("at")
    alone = entries.filter("n = 1").select(at, "n", F.col("last").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    keyed = rows.select(at, "doc_id", "text_sha256")
    if chains.isEmpty():
        return attach(keyed, alone.unionByName(links.select(at, "n", "keep_id", "group_size")), "at", "n")
    one = links.join(chains, "key", "left_anti").select(at, "n", "keep_id", "group_size")
    plain = attach(keyed, written(alone.unionByName(one), "one"), "at", "n")
    return plain.select("doc_id", "text_sha256", "keep_id", "group_size").unionByName(_by_bytes(docs, rows, chains))


def _by_bytes(docs: DataFrame, rows: DataFrame, chains: DataFrame) -> DataFrame:
    """The same for the rows whose key is in chains: keys with several texts, each found by its bytes."""
    texts = likely(_texts(docs), "key", chains).join(chains, "key", "left_semi")
    links = texts.groupBy("key", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    met = attach(texts.select("doc_id", F.struct("key", "norm").alias("text")), written(links.select(F.struct("key", "norm").alias("text"), "keep_id", "group_size"), "texts"), "text", "group_size")
    return met.select("doc_id", F.sha2("text.norm", 256).alias("text_sha256"), "keep_id", "group_size")


def exact_groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row for every row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts equal empty ones; very long texts are compared whole. The row with the largest doc_id of a group stays; a
    null doc_id is below any other, and of rows that repeat the largest doc_id all are marked as kept (`deduplicated` then
    leaves one). An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows, entries, _ = index(docs, capacity)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return _groups(docs, rows, entries).select("doc_id", "keep_id", "group_size", kept, "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_groups drops, all columns as they were; of rows with equal text and doc_id one stays."""
    groups = written(exact_groups(docs), "decisions")
    doubled = not groups.filter("kept").groupBy("text_sha256").count().filter("count > 1").isEmpty()
    keys = [F.col("doc_id").cast("long"), F.sha2(ascii_lower(F.col("text")), 256)]
    return without(docs, keys, groups.filter("not kept").select("doc_id", "text_sha256"), once=doubled)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = """
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
      FROM documents)
WINDOW w AS (PARTITION BY norm)
"""
