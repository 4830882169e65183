"""What the operators of this subpackage share: tables in the shared folder, joins that stand hot keys, gapless numbering."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows in a batch that goes to Python; texts are long, so fewer than Spark's default.
PYTHON_ROWS = 500
#: Buckets that a class of rows is dealt to before its rows are numbered.
NUMBERING_BUCKETS = 256

#: Bits for each key of the filter by which rows without a partner are left out before a shuffle, and bits in all at most:
#: 16 MB, at any number of keys.
BITS_PER_KEY = 16
MOST_FILTER_BITS = 1 << 27
#: Bits in a row of that filter.
ROW_BITS = 1 << 16

_written: list[tuple[SparkSession, str]] = []
_local: list[str] = []
#: The folders of the tables that the innermost settled() has seen written so far.
_own: ContextVar[list[str] | None] = ContextVar("own", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a local one only where none is named and all runs in one process, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="quire-"))
    return "file://" + _local[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; it goes when the driver's Python ends."""
    path = f"{work_dir(spark)}/quire-{uuid.uuid4().hex}/{name}"
    if not _written:
        atexit.register(_clear)
    folder = path.rpartition("/")[0]
    _written.append((spark, folder))
    if (own := _own.get()) is not None:
        own.append(folder)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _clear() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and lost executors cost no recomputation of it.

    The shuffle files behind it go at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _held(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns, as a table; the tables that were written for it are removed, so nothing else may read them."""
    token = _own.set(own := [])
    try:
        out = written(make(), name)
    finally:
        _own.reset(token)
    spark = out.sparkSession
    for folder in own[:-1]:
        remove(spark, folder)
        _written.remove((spark, folder))
    if (outer := _own.get()) is not None:
        outer.append(own[-1])
    return out


@contextmanager
def _held(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The setting for what is executed inside; the session's own holds again after."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def batch_rows(spark: SparkSession, rows: int = PYTHON_ROWS) -> Iterator[None]:
    """Rows in a batch that goes to Python, for what is executed inside; the session's own number holds again after."""
    with _held(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(_key, doc_id, text) of every row, and whether several rows share a doc_id.

    _key is the doc_id where one row only has it, else a hash of doc_id and text, which equal rows share.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    several = written(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 and doc_id is not null").select("doc_id"), "several")
    own = F.xxhash64("doc_id", "text")
    if (n := several.count()) == 0:
        return rows.select(F.coalesce("doc_id", own).alias("_key"), "doc_id", "text"), False
    several = several.withColumn("_several", F.lit(True))
    met = rows.join(F.broadcast(several) if n <= 1_000_000 else several, "doc_id", "left")
    return met.select(F.when(F.col("_several").isNull(), F.coalesce("doc_id", own)).otherwise(own).alias("_key"), "doc_id", "text"), True


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with groups, which has one row for each key and in `size` how many rows have it.

    Keys with over a thousandth of all rows (and 200 at least) are at most a thousand; their groups are broadcast,
    so no task gets a hot key. The rest is an ordinary join. Both inputs are read more than once: pass written tables.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(200, total // 1000)
    hot = groups.filter(F.col(size) >= limit)
    cold = groups.filter(F.col(size) < limit)
    if hot.isEmpty():
        return rows.join(cold, key)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


def _set_bits(places: DataFrame, bits: int, row_bits: int) -> DataFrame:
    """(row, words): rows of row_bits / 64 longs each, in which the bits at `at` of places are set."""
    spark, each = places.sparkSession, row_bits // 64
    words = places.groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("b"))
    words = words.unionByName(spark.range(bits // 64).withColumn("b", F.lit(0).cast("long")))
    words = words.groupBy("id").agg(F.bit_or("b").alias("b"))
    in_row = F.array_sort(F.collect_list(F.struct((F.col("id") % each).alias("i"), "b")))
    return words.groupBy(F.floor(F.col("id") / each).alias("row")).agg(F.transform(in_row, lambda x: x["b"]).alias("words"))


def bit_array(keys: DataFrame, bits: int) -> Column:
    """One array of `bits` / 64 longs in which the long keys (one column) are marked: a scalar subquery, so in no plan's text.

    bits is a power of two that the caller bounds.
    """
    at = keys.toDF("k").select(F.col("k").bitwiseAND(F.lit(bits - 1).cast("long")).alias("at"))
    return written(_set_bits(at, bits, bits).select("words"), "bits").scalar()


def has_bit(words: Column, bits: int):
    """A test whether a long key is marked in the array; of unmarked ones some pass."""

    def test(key: Column) -> Column:
        at = key.bitwiseAND(F.lit(bits - 1).cast("long"))
        return F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1

    return test


def _marked(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """rows with a boolean _hit: true for every row whose key is in keys, and for a few others."""
    bits, wanted = ROW_BITS, min(MOST_FILTER_BITS, BITS_PER_KEY * keys.count())
    while bits < wanted:
        bits *= 2
    # never null, so that the join adds no filter that would compute the key again
    bit = F.xxhash64(key).bitwiseAND(F.lit(bits - 1).cast("long"))
    table_ = written(_set_bits(keys.select(bit.alias("at")), bits, ROW_BITS), "filter").withColumnsRenamed({"row": "_r", "words": "_words"})
    marked = rows.withColumn("_p", bit).withColumn("_r", F.shiftright("_p", 16)).join(F.broadcast(table_), "_r")
    at = F.col("_p").bitwiseAND(F.lit(ROW_BITS - 1).cast("long"))
    hit = F.getbit(F.get("_words", F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
    return marked.select(*(F.col(f"`{c}`") for c in rows.columns), hit.alias("_hit"))


def likely(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is in keys, and a few others: what is left out needs no shuffle.

    Keys are marked in BITS_PER_KEY bits each and MOST_FILTER_BITS in all, so what is broadcast has a bound; with very
    many of them more rows pass, none is lost. keys is read twice: pass a written table.
    """
    return _marked(rows, key, keys).filter("_hit").drop("_hit")


def without(docs: DataFrame, keys: list[Column], drop: DataFrame, once: bool = False) -> DataFrame:
    """docs without the rows whose keys are in drop, compared null-safely; once: of rows with equal keys one stays.

    A row whose key a filter of bounded size rules out stays where it is; only the others are shuffled. A row travels as
    one struct, so its columns may have any names.
    """
    names = [f"k{i}" for i in range(len(keys))]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.struct(*(k.alias(n) for k, n in zip(keys, names, strict=True))).alias("key"))
    gone = written(drop.toDF(*names).select(F.struct(*names).alias("key")).distinct(), "gone")
    if once:
        return packed.join(gone, "key", "left_anti").dropDuplicates(["key"]).select("row.*")
    marked = _marked(packed, "key", gone)
    kept = marked.filter("not _hit").select("row")
    # no anti join: Spark would move it below the filter, and all rows would be shuffled
    met = marked.filter("_hit").join(gone.withColumn("_gone", F.lit(True)), "key", "left").filter("_gone is null")
    return kept.unionByName(met.select("row")).select("row.*")


def numbered(rows: DataFrame, classes: list[str], order: list[str], name: str, buckets: int = NUMBERING_BUCKETS) -> DataFrame:
    """rows with a long `name` that counts each class from 0 without gaps.

    A class is dealt to buckets by a hash of `order`; the driver gets only the counts of (class, bucket), so neither
    it nor a task ever holds a class. Rows equal in all of `order` share a bucket and are counted in some order.
    """
    b = "_bucket"
    dealt = rows.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    w = Window.partitionBy(*classes).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*classes, b).agg(F.count(F.lit(1)).alias("_n"))
    base = counts.select(*classes, b, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_base"))
    local = F.row_number().over(Window.partitionBy(*classes, b).orderBy(*order))
    return (
        dealt.withColumn("_local", local)
        .join(base, [*classes, b])
        .withColumn(name, (F.col("_base") + F.col("_local") - 1).cast("long"))
        .drop(b, "_local", "_base")
    )
