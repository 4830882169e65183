"""Benchmark decontamination by template canonicalisation.

Numbers, units and names become typed placeholders, so a question whose parameters were changed keeps its template.
Windows of five canonical words (of all its words, where an item has fewer) are hashed; a document is taken for
contaminated by an item if it has at least 0.8 of the item's windows and, where the item has slots, if some occurrence
fills them consistently: equal values of the item have equal values in the document.

1. Of a document's windows those go on that a bit array of all the benchmark's windows doesn't rule out.
2. Documents and items meet by a hash join on the item's rarest windows: of n windows of which k are needed, one of the
   n - k + 1 that the fewest documents have is in every contaminated document. So a window that everything shares makes
   no pairs. A pair is verified on both sides' windows.
3. An occurrence begins at a shift, the distance between a window's places in document and item. It takes each window of
   the item at the first shift from there on, within the item's length; so words may be inserted or left out. It must
   reach 0.8 of the item's windows by itself, and each value in the item's slots must stand for one value over all of it.

Only DataFrame functions are used. What grows with the benchmark is broadcast up to MOST_BROADCAST windows; a larger one
is joined by a shuffle, from which windows and items in many documents are split off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import attach, bit_array, has_bit, likely, table, without, written

WINDOW = 5
CONTAINMENT = 0.8
MOST_BROADCAST = 1_000_000
#: Bits of the array by which a document's windows are left out, for each window of the benchmark, and in all.
BITS_PER_WINDOW = 1024
MOST_BITS = 1 << 24
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
#: Fixed list: units that follow a number.
UNITS = (
    "mm cm m km inches inch feet foot ft yards yard miles mile mg g kg tons ton lbs lb pounds pound ounces ounce oz ml cl l liters liter litres litre "
    "seconds second sec minutes minute min hours hour hrs days day weeks week months month years year "
    "dollars dollar usd euros euro eur cents cent percent degrees degree kmh mph hz khz mhz ghz kb mb gb tb v w kw kwh n j pa"
).split()
#: A capitalised word after a word, a comma or a semicolon of the same sentence.
_NAME = r"(?<=[\p{L}\p{N},;] )(\p{Lu}\p{Ll}+)"
_UNIT = rf"(?<=[0-9]) ?({'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))}|[%$€£])(?![\p{{L}}\p{{N}}])"


def tokenised(rows: DataFrame) -> DataFrame:
    """rows (text and others) with `words` for text: its words in lower case; slots start with the placeholder of their type and
    end with their value.

    What is used several times is a column of its own, so that it is computed once.
    """
    others = [c for c in rows.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    marked = text.contains(NAME) | text.contains(NUMBER) | text.contains(UNIT)
    named = F.regexp_replace(F.when(marked, F.translate(text, NAME + NUMBER + UNIT, "   ")).otherwise(text), _NAME, NAME + "$1")
    rows = rows.select(*others, named.alias("named"))
    numbers = F.regexp_replace(F.regexp_replace("named", _UNIT, f" {UNIT}u$1 "), "([0-9]+)", f" {NUMBER}$1 ")
    low = F.lower(F.when(F.col("named").rlike("[0-9]"), numbers).otherwise(F.col("named")))
    rows = rows.select(*others, F.regexp_replace(low, r"[^a-z0-9\x01-\x03\x{80}-\x{10FFFF}%$ ]+", " ").alias("low"))
    signs = F.col("low").contains("%") | F.col("low").contains("$")
    low = F.when(signs, F.regexp_replace("low", r"(?<![\x03u])[%$]", "")).otherwise(F.col("low"))
    return rows.select(*others, F.filter(F.split(low, " "), lambda w: w != "").alias("words"))


def _canonical(word: Column) -> Column:
    return F.when(F.ascii(word) < 4, F.substring(word, 1, 1)).otherwise(word)


def _hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(_canonical(w)))


def _window_at(hashes: str, at: Column, length: int) -> Column:
    """Hash of the window of that length that begins there, null if it doesn't fit."""
    each = F.xxhash64(*(F.get(F.col(hashes), at + k) for k in range(length)))
    return F.when(at + length <= F.size(hashes), each)


def _windows(hashes: str, length: int) -> Column:
    """Hashes of the windows of that length, in order."""
    n = F.size(hashes)
    each = F.transform(F.sequence(F.lit(0), n - length), lambda i: _window_at(hashes, i, length))
    return F.when(n >= length, each).otherwise(F.array().cast("array<bigint>"))


def _slots(words: str, at: Column, length: Column | int) -> Column:
    return F.filter(F.slice(F.col(words), at + 1, length), lambda w: F.ascii(w) < 4)


def _key() -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text", F.length("text")).alias("_text")]


def _placed(benchmark: DataFrame) -> DataFrame:
    """(item_id, src, length, q, w, theirs): windows of the items with their places and the slots in them; src is an item's
    text, of which several may have one id."""
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    items = tokenised(items.select("item_id", F.xxhash64("text").alias("src"), "text")).withColumn("h", _hashes("words"))
    length = F.least(F.size("words"), F.lit(WINDOW))
    own = F.when(length == WINDOW, _windows("h", WINDOW))
    for k in range(1, WINDOW):
        own = own.when(length == k, _windows("h", k))
    items = items.filter(F.size("words") > 0).select("item_id", "src", "words", length.alias("length"), F.posexplode(own).alias("q", "w"))
    return written(items.select("item_id", "src", "length", "q", "w", _slots("words", F.col("q"), F.col("length")).alias("theirs")), "placed")


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, containment, n_slots, consistent, contaminated, _text), one row for each
    document and item with containment enough.

    Windows count once however often they occur, and wherever they stand in a document. Items of fewer than five words are
    one window of their own length. Null and wordless texts have no window and match nothing; very long texts are read
    whole. Rows with null or repeated doc_ids are told apart by their text (_text is its hash); repeated rows are one.
    Items with null ids are ignored, items with equal ids are pooled, an occurrence is that of one of their texts. Empty
    tables give no rows; other columns are ignored, whatever their names.
    """
    placed = _placed(benchmark)
    n = placed.count()
    few = n <= MOST_BROADCAST
    bits = 1 << 10
    while bits < min(n * BITS_PER_WINDOW, MOST_BITS):
        bits *= 2
    lengths = {WINDOW} | {r[0] for r in placed.select("length").distinct().collect()}
    known = has_bit(bit_array(placed.select("w"), bits), bits)
    rows = tokenised(docs.select(F.struct(*_key()).alias("key"), F.col("text").cast("string"))).select("key", _hashes("words").alias("h"))
    # outer, so that no filter is pushed below and computes the hashes again
    places = rows.select("key", "h", F.posexplode_outer("h").alias("i", "_"))
    seen = places.select("key", *(_window_at("h", F.col("i"), k).alias(f"w{k}") for k in sorted(lengths)))
    seen = seen.select("key", F.explode(F.array(*(f"w{k}" for k in sorted(lengths)))).alias("w") if len(lengths) > 1 else F.col(f"w{WINDOW}").alias("w"))
    each = written(seen.filter(known(F.col("w"))).distinct(), "hits")
    pairs = written(_pairs(each, placed, containment, few), "pairs")
    hits = each.join(pairs, "key", "left_semi").groupBy("key").agg(F.collect_list("w").alias("hits"))
    items = placed.groupBy("item_id").agg(F.collect_set("w").alias("windows"), F.max(F.size("theirs")).alias("n_slots"))
    met = hits.join(pairs, "key")
    met = met.join(F.broadcast(items), "item_id") if few else _attached(met, items)
    n_windows, matched = F.size("windows"), F.size(F.array_intersect("windows", "hits"))
    found = met.select("key.*", "item_id", n_windows.alias("n_windows"), matched.alias("n_matched"), "n_slots")
    found = found.withColumn("containment", F.col("n_matched") / F.col("n_windows")).filter(F.col("containment") >= containment)
    found = written(found, "found")
    if found.filter("n_slots > 0").isEmpty():
        return _shaped(found.withColumn("ok", F.lit(True)))
    good = _consistent(docs, found.filter("n_slots > 0"), placed, lengths, containment).withColumn("_good", F.lit(True))
    both = found.withColumn("key", F.struct("doc_id", "_text")).join(good, ["key", "item_id"], "left")
    return _shaped(both.withColumn("ok", (F.col("n_slots") == 0) | F.col("_good").isNotNull()))


def _shaped(found: DataFrame) -> DataFrame:
    whole = [F.col(k).cast("long").alias(k) for k in ("n_windows", "n_matched")]
    return found.select(
        "doc_id", "item_id", *whole, "containment", F.col("n_slots").cast("int").alias("n_slots"), F.col("ok").alias("consistent"), F.col("ok").alias("contaminated"), "_text"
    )


def _pairs(each: DataFrame, placed: DataFrame, containment: float, few: bool) -> DataFrame:
    """(key, item_id) of documents and items that share one of the item's rarest windows."""
    counts = each.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    windows = placed.select("item_id", "w").distinct()
    of_item = Window.partitionBy("item_id")
    ranked = windows.join(counts, "w", "left").withColumn("rank", F.row_number().over(of_item.orderBy(F.coalesce("n", F.lit(0)), "w")))
    total = F.count(F.lit(1)).over(of_item)
    prefix = ranked.withColumn("total", total).filter(F.col("rank") <= F.col("total") - F.ceil(F.col("total") * containment - 1e-9) + 1)
    prefix = written(prefix.filter("n is not null").select("w", "item_id", "n"), "prefix")
    if few:
        return each.join(F.broadcast(prefix.select("w", "item_id")), "w").select("key", "item_id").distinct()
    items = written(prefix.groupBy("w").agg(F.collect_list("item_id").alias("items"), F.max("n").alias("n")), "by_window")
    return attach(each, items, "w", "n").select("key", F.explode("items").alias("item_id")).distinct()


def _attached(met: DataFrame, items: DataFrame) -> DataFrame:
    met = written(met, "met")
    counts = met.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n"))
    return attach(met, written(items.join(counts, "item_id"), "items"), "item_id", "_n").drop("_n")


def _consistent(docs: DataFrame, open_: DataFrame, placed: DataFrame, lengths: set[int], containment: float) -> DataFrame:
    """(key, item_id) of the pairs of which some occurrence reaches the containment and fills its slots consistently."""
    pairs = open_.select(F.struct("doc_id", "_text").alias("key"), "item_id")
    keyed = docs.select(F.struct(*_key()).alias("key"), F.col("text").cast("string"))
    mine = likely(keyed, "key", pairs.select("key")).join(pairs.select("key").distinct(), "key").dropDuplicates(["key"])
    rows = tokenised(mine).withColumn("h", _hashes("words"))

    def with_slots(length: int) -> Column:
        return F.transform(_windows("h", length), lambda w, p: F.struct(w.alias("w"), p.alias("p"), _slots("words", p, length).alias("ours")))

    seen = written(rows.select("key", F.explode(F.concat(*map(with_slots, sorted(lengths)))).alias("x")).select("key", "x.*"), "seen")
    sizes = placed.groupBy("item_id", "src").agg(F.countDistinct("w").alias("width"))
    wanted = pairs.join(placed, "item_id").join(sizes, ["item_id", "src"])
    met = seen.join(wanted, ["key", "w"]).withColumn("shift", F.col("p") - F.col("q"))
    one = ["key", "item_id", "src"]
    ahead = Window.partitionBy(*one).orderBy("shift")
    need = F.ceil(F.col("width") * containment - 1e-9)
    met = written(met.withColumn("need", need).withColumn("zone", F.floor(F.col("shift") / F.col("width"))), "met")
    # shifts from which enough windows come within the item's length: the shifts' counts are looked at by zone, and the next one
    by_shift = met.groupBy(*one, "zone", "shift", "width", "need").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(ahead.rowsBetween(Window.unboundedPreceding, 0))
    summed = by_shift.withColumn("total", total)
    starts = summed.select(*one, "width", "need", F.col("shift").alias("start"), (F.col("total") - F.col("n")).alias("before"))
    zones = F.explode(F.array(F.floor(F.col("start") / F.col("width")), F.floor(F.col("start") / F.col("width")) + 1)).alias("zone")
    inside = (F.col("shift") >= F.col("start")) & (F.col("shift") < F.col("start") + F.col("width"))
    reach = starts.select(*one, "start", "need", "before", "width", zones).join(
        summed.groupBy(*one, "zone").agg(F.max("total").alias("upto")), [*one, "zone"]
    )
    starts = reach.groupBy(*one, "start", "width", "need", "before").agg(F.max("upto").alias("upto")).filter(F.col("upto") - F.col("before") >= F.col("need"))
    taken = starts.select(*one, "start", zones).join(met, [*one, "zone"]).filter(inside)
    first = taken.groupBy(*one, "start", "q", "w", "need").agg(F.min_by(F.struct("theirs", "ours"), "shift").alias("s"))
    enough = first.groupBy(*one, "start", "need").agg(F.countDistinct("w").alias("n")).filter(F.col("n") >= F.col("need")).drop("need", "n")
    values = first.select(*one, "start", F.explode(F.arrays_zip("s.theirs", "s.ours")).alias("v"))
    values = values.groupBy(*one, "start", F.col("v.theirs").alias("t")).agg(F.countDistinct("v.ours").alias("n")).filter("n > 1")
    return enough.join(values, [*one, "start"], "left_anti").select("key", "item_id").distinct()


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without contaminated rows, all columns as they were.

    Null, empty and wordless texts stay. Rows that repeat a doc_id are judged by their own text, equal rows stay or go
    together. With an empty benchmark all rows stay; columns other than doc_id and text may have any names.
    """
    bad = contaminated(docs, benchmark).filter("contaminated").select("doc_id", "_text")
    return without(docs, [F.col("doc_id").cast("long"), F.xxhash64("text", F.length("text"))], bad)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_text")
