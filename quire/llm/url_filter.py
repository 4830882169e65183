"""URL filter: fixed rules first, then a Bloom filter cascade over all url keys of the corpus.

Level 1 encodes the listed keys. Level 2 encodes the unlisted keys that level 1 takes for listed, level 3 the listed keys
that level 2 takes for those, and so on until a level errs on no key. As every key of the corpus was in the universe
from which the levels were built, the answer is exact for every page, and pages are judged without a join: the filters
are scalar subqueries of one row.

A filter has a proven bound: keys are dealt by hash to passes of about MOST_KEYS listed keys, each with a cascade of its
own. Where there are several, urls and keys are written by pass, so that each pass reads its own part and all are read
once. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import new_path, table, written

#: Fixed rules: verdict, host, path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: The production list holds the keys of thin pages: those that were served with fewer bytes than this at least once.
THIN_BYTES = 1500
BITS_PER_KEY = 8
HASHES = 4
LEAST_BITS = 1 << 10
#: Listed keys in a pass: a filter of 2 MB at most for its first level, and less for each other one.
MOST_KEYS = 2_000_000
MOST_LEVELS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(found(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), found(2)


def rule_of(host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for what, suffix, prefix in sorted(RULES, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        rule = F.when(fits, suffix + prefix) if rule is None else rule.when(fits, suffix + prefix)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return rule, verdict


def key_of(host: Column, path: Column) -> Column:
    """The list's key of a url: host and path, without scheme, query and fragment; empty if there is no host."""
    return F.when(host == "", "").otherwise(F.concat(host, path))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(HASHES * level + i)), F.lit(bits).cast("long")) for i in range(HASHES)]


def _filter(keys: DataFrame, level: int, n: int) -> tuple[DataFrame, int]:
    """The filter as one row (words), an array of longs, and its bits. The driver gets its words, n * BITS_PER_KEY / 64 at most.

    It is a table that plans refer to by a scalar subquery, so it is in no plan's text however large it is.
    """
    bits = max(LEAST_BITS, -(-n * BITS_PER_KEY // 64) * 64)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    out = [0] * (bits // 64)
    for word, value in words.toLocalIterator():
        out[word] = value
    return written(keys.sparkSession.createDataFrame([(out,)], "words array<long>"), "filter"), bits


def _contains(key: Column, level: int, words: DataFrame, bits: int) -> Column:
    array, hit = words.scalar(), None
    for p in _positions(key, level, bits):
        bit = F.getbit(F.get(array, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1
        hit = bit if hit is None else hit & bit
    return hit


def cascade(universe: DataFrame) -> list[tuple[DataFrame, int]]:
    """Filters of all levels for universe (key, listed), one row for each key."""
    levels: list[tuple[DataFrame, int]] = []
    inside, outside = universe.filter("listed"), universe.filter("not listed")
    while len(levels) < MOST_LEVELS:
        if (n := inside.count()) == 0:
            return levels
        levels.append(_filter(inside, len(levels), n))
        wrong = outside.filter(_contains(F.col("key"), len(levels) - 1, *levels[-1]))
        inside, outside = written(wrong, "wrong"), inside
    raise RuntimeError("the cascade did not end")


def member(key: Column, levels: list[tuple[DataFrame, int]]) -> Column:
    """Whether key is listed, exact for keys of the universe: the first level without it decides, else the last one does."""
    out = F.lit(len(levels) % 2 == 1)
    for k in reversed(range(len(levels))):
        out = F.when(_contains(key, k, *levels[k]), out).otherwise(F.lit(k % 2 == 1))
    return out


def _dealt(rows: DataFrame, passes: int, name: str) -> DataFrame:
    """rows written by pass, one folder each, so that a filter on the pass reads no other."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, name)
    dealt = rows.withColumn("pass", F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(passes)).cast("int"))
    dealt.write.partitionBy("pass").parquet(path)
    return spark.read.schema(dealt.schema).parquet(path)


def judge(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed) of every row of pages.

    listed: (key), the keys to block where no rule fits; it may repeat keys or hold keys of no page. Null urls and those
    without "://" have empty host and path, fit no rule and are allowed; very long ones are read whole. Repeated rows and null page_ids stay; empty
    tables give no rows; other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path")).withColumn("key", key_of(F.col("host"), F.col("path")))
    both = rows.select("key", F.lit(True).alias("page"), F.lit(False).alias("listed")).unionByName(
        listed.select(F.col("key"), F.lit(False).alias("page"), F.lit(True).alias("listed"))
    )
    universe = both.groupBy("key").agg(F.max("page").alias("page"), F.max("listed").alias("listed")).filter("page and key <> ''")
    universe = written(universe.select("key", "listed"), "universe")
    passes = max(1, -(-universe.filter("listed").count() // MOST_KEYS))
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    if passes > 1:
        rows, universe = _dealt(rows, passes, "urls"), _dealt(universe, passes, "keys")
    out = None
    for k in range(passes):
        mine, keys = (d.filter(F.col("pass") == k).drop("pass") if passes > 1 else d for d in (rows, universe))
        part = mine.withColumn("listed", (F.col("key") != "") & member(F.col("key"), cascade(keys)))
        out = part if out is None else out.unionByName(part)
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "listed")


def thin_pages(pages: DataFrame, least: int = THIN_BYTES) -> DataFrame:
    """The production list: (key) of pages with fewer than `least` bytes of html, placeholders and errors; null counts as empty."""
    host, path = host_and_path(F.col("url"))
    thin = F.octet_length(F.coalesce("html", F.lit(""))) < least
    return pages.filter(thin).select(host.alias("host"), path.alias("path")).select(key_of(F.col("host"), F.col("path")).alias("key")).distinct()


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, thin_pages(pages))


OP9_SQL = rf"""
WITH parts AS (
  SELECT page_id, strlen(coalesce(html, '')) < {THIN_BYTES} AS thin,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
         host <> '' AND max(thin) OVER (PARTITION BY host || path) AS listed
  FROM parts)
SELECT page_id, host, path, rule,
       CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
            ELSE CASE WHEN listed THEN 'block' ELSE 'allow' END END AS verdict,
       listed
FROM ruled
"""
