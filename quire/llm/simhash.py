"""SimHash near-duplicates by anchor points.

The anchors are the words of a covering code: every fingerprint has an anchor (its home) within the covering radius.
If x and y differ in at most t bits, then x's home lies within radius + t of y. So each fingerprint is sent once to its
home and as a replica to all anchors within radius + t; at every anchor homes meet replicas and are compared.

The code is a direct sum of perfect codes on disjoint runs of bits. Radius and threshold add up over the runs, so a
replica may exceed the radius by at most t in all. Two binary Golay codes give 2**24 anchors and about 61 replicas
at t = 2; larger corpora add a Hamming code (2**35 anchors, about 153). Either choice finds every link.

Equal fingerprints are merged before, so a group of copies is one row however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import attach, batch_rows, keyed, likely, settled, table, without, written
from quire.llm.components import components

SEED = 42
#: name: (length, parity-check columns, covering radius)
GOLAY_GENERATOR = 0b110001110101


def _golay_columns() -> list[int]:
    out, x = [], 1
    for _ in range(23):
        out.append(x)
        x <<= 1
        if x >> 11:
            x ^= GOLAY_GENERATOR
    return out


CODES = {"golay": (23, _golay_columns(), 3), "hamming": (15, list(range(1, 16)), 1)}


def blocks_for(n: int) -> tuple[str, ...]:
    """The code for n distinct fingerprints: about as many anchors as fingerprints, so that anchors stay small."""
    return ("golay", "golay") if n <= 1 << 24 else ("golay", "golay", "hamming")


@lru_cache
def _patterns(code: str, threshold: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every excess over the radius: start and count by syndrome, and the error patterns in that order."""
    length, columns, radius = CODES[code]
    syndromes = 1 << max(columns).bit_length()
    found: list[list[tuple[int, int]]] = [[] for _ in range(threshold + 1)]
    for weight in range(radius + threshold + 1):
        for at in combinations(range(length), weight):
            s = e = 0
            for i in at:
                s ^= columns[i]
                e |= 1 << i
            found[max(0, weight - radius)].append((s, e))
    out = []
    for rows in found:
        a = np.array(rows, dtype=np.int64).reshape(-1, 2)
        a = a[np.argsort(a[:, 0], kind="stable")]
        count = np.bincount(a[:, 0], minlength=syndromes)
        out.append((np.cumsum(count) - count, count, a[:, 1].astype(np.uint64)))
    return out


@lru_cache
def _syndrome_table(code: str) -> np.ndarray:
    length, columns, _ = CODES[code]
    t = np.zeros(1, dtype=np.int64)
    for c in columns:
        t = np.concatenate([t, t ^ c])
    return t


def anchors(prints: np.ndarray, blocks: tuple[str, ...], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(index into prints, anchor) of every anchor whose excess over the covering radii is threshold at most."""
    row, left = np.arange(len(prints)), np.full(len(prints), threshold)
    anchor, shift = np.zeros(len(prints), dtype=np.uint64), 0
    for code in blocks:
        length = CODES[code][0]
        bits = (prints[row] >> np.uint64(shift)) & np.uint64((1 << length) - 1)
        syndrome = _syndrome_table(code)[bits.astype(np.int64)]
        parts = []
        for excess, (start, count, errors) in enumerate(_patterns(code, threshold)):
            ok = np.flatnonzero(left >= excess)
            n = count[syndrome[ok]]
            rep = np.repeat(ok, n)
            inner = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
            word = bits[rep] ^ errors[np.repeat(start[syndrome[ok]], n) + inner]
            parts.append((row[rep], left[rep] - excess, anchor[rep] | (word << np.uint64(shift))))
        row, left, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
        shift += length
    return row, anchor


def shingle_hashes(words: list[bytes], size: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of `size` words joined by a space; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(text[a:b], seed) for a, b in spans), dtype=np.uint64, count=len(words) - size + 1)


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() touches A-Z only and bytes.split() cuts at \\x20 and \\x09-\\x0D only, as wanted."""
    return (text or "").encode().lower().split()


_OFFSETS = (np.arange(8) * 256).astype(np.int64)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; zero for none."""
    n = len(hashes)
    if n == 0:
        return 0
    if n < 256:
        ones = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0)
    else:
        by = np.bincount((hashes.astype("<u8").view(np.uint8).reshape(n, 8) + _OFFSETS).ravel(), minlength=2048)
        ones = (by.reshape(8, 256) @ _BITS).ravel()
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > n))


def fingerprint(text: str | None, size: int = 3, seed: int = SEED) -> int:
    return majority(shingle_hashes(words_of(text), size, seed))


def fingerprints(docs: DataFrame, size: int = 3, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row, written; fp is the unsigned fingerprint kept in a long. Null texts count as empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, size, seed) for t in b["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp.astype(np.int64)})

    with batch_rows(docs.sparkSession):
        return written(docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, fp long"), "fingerprints")


def _emit(prints: DataFrame, blocks: tuple[str, ...], threshold: int, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):  # at most about 300,000 replicas at a time
                part = b.slice(at, 2000)
                fp = part.column("fp").to_numpy(zero_copy_only=False)
                row, anchor = anchors(fp.view(np.uint64), blocks, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), *(part.column(k).take(pa.array(row)) for k in ["fp", *keep])], names=["anchor", "fp", *keep]
                )

    kinds = ", ".join(f"{k} {prints.schema[k].dataType.simpleString()}" for k in ["fp", *keep])
    return prints.select("fp", *keep).mapInArrow(run, f"anchor long, {kinds}")


def links(prints: DataFrame, n: int, threshold: int = 2, bits: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b) of different fingerprints that differ in at most `threshold` of the low `bits` bits.

    prints has distinct rows (fp, *keep); only rows equal in all of keep meet. Each link comes once.
    A fingerprint has at most bits * (bits + 1) / 2 others within 2 bits, however many documents there are.
    """
    blocks = blocks_for(n)
    on = ["anchor", *keep]
    home = _emit(prints, blocks, 0, list(keep)).withColumnRenamed("fp", "a")
    replica = _emit(prints, blocks, threshold, list(keep)).withColumnRenamed("fp", "b")
    mask = F.lit(-1 if bits == 64 else (1 << bits) - 1).cast("long")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(mask))
    # Spark sizes what comes from Python by its input, so it would broadcast the replicas of a small table of fingerprints
    return home.join(replica.hint("merge"), on).filter((F.col("a") < F.col("b")) & (differ <= threshold)).select(*keep, "a", "b")


def near_duplicates(docs: DataFrame, size: int = 3, threshold: int = 2, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_same) for every row of docs.

    Null or wordless texts have fingerprint zero and are linked like any other. A null doc_id gets the least doc_id of
    its component, or null if none has one; repeated rows stay repeated. An empty table gives no rows. Columns other
    than doc_id and text are ignored, whatever their names.
    """
    rows = fingerprints(docs, size, seed)
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_same")), "prints")
    found = components(links(prints.select("fp"), prints.count(), threshold))
    joined = prints.join(found, prints["fp"] == found["id"], "left").select("fp", "least", "n_same", F.coalesce("component", "fp").alias("component"))
    joined = written(joined, "joined")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_prints"))
    groups = written(attach(joined, written(least, "least"), "component", "n_prints").select("fp", "n_same", "component_id"), "groups")
    return attach(rows, groups, "fp", "n_same").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same"
    )


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


#: For deduplicated(): shingles of five words, and their similarity.
SHINGLE = 5
SIMILARITY = 0.8
#: Fingerprints over the set of words, of 46 bits (all that two Golay codes cover): about one in five of the pairs at the
#: similarity is within one bit. TABLES of them, with different seeds, find nearly all at half the replicas that fewer
#: tables with two bits take; what they find is verified.
TABLES = 20
SET_BITS = 46
SET_THRESHOLD = 1
#: A block that is appended, cut off or inserted changes many words at once, and word sets don't tell the order of words. So
#: texts also meet by BANDS keys, each of BAND_ROWS least hashes over the shingles: a pair of similarity s shares one with
#: a chance of 1 - (1 - s**BAND_ROWS)**BANDS whatever the kind of change, 0.9996 at 0.8.
BANDS = 20
BAND_ROWS = 5
_BAND_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _bands(words: list[bytes]) -> np.ndarray:
    """The keys of a text's bands; zeros for no words."""
    h = shingle_hashes(words, SHINGLE, SEED)
    if not len(h):
        return np.zeros(BANDS, dtype=np.int64)
    least = np.full(len(_BAND_FACTORS), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 1000):  # the table of a long text would be large
        part = h[at : at + 1000]
        least = np.minimum(least, ((part ^ (part >> np.uint64(32))) * _BAND_FACTORS).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), SEED) for r in rows], dtype=np.uint64).view(np.int64)


def _set_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, table, fp) of docs (_key, text): fingerprints over the different words of a text, one with each table's seed;
    then the bands. doc_id is the _key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros((len(b), TABLES + BANDS), dtype=np.int64)
            for i, text in enumerate(b["text"]):
                sequence = words_of(text)
                out[i, TABLES:] = _bands(sequence)
                words = list(set(sequence))
                base = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), dtype=np.uint64, count=len(words))
                for k in range(TABLES):
                    h = (base ^ np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
                    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                    out[i, k] = majority(h ^ (h >> np.uint64(32))) & ((1 << SET_BITS) - 1)
            yield pd.DataFrame({"doc_id": np.repeat(b["doc_id"].to_numpy(), TABLES + BANDS), "table": np.tile(np.arange(TABLES + BANDS), len(b)), "fp": out.ravel()})

    with batch_rows(docs.sparkSession):
        return written(docs.select(F.col("_key").alias("doc_id"), "text").mapInPandas(run, "doc_id long, table int, fp long"), "set_prints")


def _shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, n, shingles) of the wanted documents (doc_id, n): sorted hashes of their different shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": b["n"], "shingles": [np.unique(shingle_hashes(words_of(t), SHINGLE, SEED)).view(np.int64) for t in b["text"]]})

    met = likely(docs.select(F.col("_key").alias("doc_id"), "text"), "doc_id", wanted.select("doc_id")).join(wanted, "doc_id")
    with batch_rows(docs.sparkSession):
        return written(met.mapInPandas(run, "doc_id long, n long, shingles array<long>"), "shingle_sets").dropDuplicates(["doc_id"])


def verified_pairs(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(x, y, jaccard), x < y, for docs (_key, text): candidates of the fingerprint tables and bands whose shingle sets are
    similar enough, by their _key.

    Documents with one fingerprint or band are compared with one of them, drawn anew in each table and band, so that one
    which is unlike the others in its group hides them in few of their groups only. Those that are unlike it meet again,
    grouped by the next band's key too, with one of their own. Other documents meet by the links of their fingerprints.
    """
    rows = _set_prints(docs)
    prints = written(rows.groupBy("table", "fp").agg(F.min_by("doc_id", F.xxhash64("doc_id", "table")).alias("rep"), F.count(F.lit(1)).alias("size")), "prints")
    sets = prints.filter(F.col("table") < TABLES)
    most = sets.groupBy("table").count().agg(F.max("count")).first()[0] or 0
    side = lambda k, rep: sets.select("table", F.col("fp").alias(k), F.col("rep").alias(rep))

    def linked() -> DataFrame:
        # written before their ends are looked up: the shuffle of all replicas is gone by then
        near = written(links(sets.select("fp", "table"), most, SET_THRESHOLD, SET_BITS, ("table",)), "links")
        return near.join(side("a", "x"), ["table", "a"]).join(side("b", "y"), ["table", "b"]).select("x", "y")

    keyed = F.struct("table", "fp").alias("key")

    def alike() -> DataFrame:
        reps = written(prints.filter("size > 1").select(keyed, "rep", "size"), "reps")
        return attach(written(rows.select(keyed, "doc_id"), "same"), reps, "key", "size").select("key", F.col("rep").alias("x"), F.col("doc_id").alias("y"))

    near, same = settled(linked, "near"), settled(alike, "same_pairs")
    found = settled(lambda: _similar(docs, near.unionByName(same.select("x", "y")), similarity), "similar")
    # members unlike the one they were compared with: their group, less those that are like it, by one more key
    like = found.select("x", "y").unionByName(found.select(F.col("y").alias("x"), F.col("x").alias("y")))
    unlike = same.filter("x <> y").join(like, ["x", "y"], "left_anti").select("key", F.col("y").alias("doc_id"))
    following = rows.select("doc_id", (F.col("table") - 1).alias("before"), F.col("fp").alias("next"))
    again = unlike.filter(F.col("key.table").between(TABLES, TABLES + BANDS - 2)).withColumn("before", F.col("key.table")).join(following, ["doc_id", "before"])
    again = written(again.select(F.struct("key", "next").alias("key"), "doc_id"), "again")
    reps = again.groupBy("key").agg(F.min_by("doc_id", F.xxhash64("doc_id", "key")).alias("rep"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    pairs = attach(again, written(reps, "again_reps"), "key", "size").select(F.col("rep").alias("x"), F.col("doc_id").alias("y"))
    return found.unionByName(_similar(docs, pairs, similarity))


def _similar(docs: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """(x, y, jaccard), x < y, of the pairs whose shingle sets are similar enough."""
    pairs = pairs.filter("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.col("x").alias("doc_id")).unionByName(pairs.select(F.col("y").alias("doc_id")))
    sets = written(_shingle_sets(docs, written(ends.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "ends")), "sets")
    one = attach(pairs.withColumnRenamed("x", "doc_id"), sets, "doc_id", "n").withColumnsRenamed({"doc_id": "x", "shingles": "sx"}).drop("n")
    both = attach(written(one, "one").withColumnRenamed("y", "doc_id"), sets, "doc_id", "n").withColumnsRenamed({"doc_id": "y", "shingles": "sy"}).drop("n")
    shared = F.size(F.array_intersect("sx", "sy"))
    union = F.size("sx") + F.size("sy") - shared
    return both.select("x", "y", F.when(union > 0, shared / union).otherwise(1.0).alias("jaccard")).filter(F.col("jaccard") >= similarity)


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document, the one with the least doc_id, of each group of near-duplicates; all columns as they were.

    Groups are what verified pairs connect. Null and wordless texts are one group; very long texts are compared whole.
    Rows without a doc_id, and rows that share one, are told apart by their text, which then also decides between them;
    equal rows stay or go together. An empty table gives no rows; other columns may have any names.
    """
    rows, several = keyed(docs)

    def others() -> DataFrame:
        pairs = settled(lambda: verified_pairs(rows, similarity).select(F.col("x").alias("a"), F.col("y").alias("b")), "near")
        return components(pairs).filter("id <> component").select(F.col("id").alias("_key"))

    drop = settled(others, "drop")
    doc_id = F.col("doc_id").cast("long")
    if not several:
        return without(docs, [F.coalesce(doc_id, F.xxhash64(doc_id, F.col("text").cast("string")))], drop)
    text = F.xxhash64(F.col("text").cast("string"), F.length("text"))
    drop = rows.join(drop, "_key", "left_semi").select("doc_id", F.xxhash64("text", F.length("text")))
    return without(docs, [doc_id, text], drop)
