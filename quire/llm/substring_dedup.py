"""Near-duplicate passages by compact windows.

A text is a sequence of shingles of five words. For one hash function, the Cartesian tree over the shingles' hashes
parts all its subsequences of LEAST_SHINGLES or more into compact windows (l, c, r): every subsequence of [l, r) that
contains c has its least hash at c. A text of n shingles has about 2n / LEAST_SHINGLES such windows. Whenever two texts
hold the same passage, their windows around it have the same least hash, for every hash function; for passages of
similarity s, for about a share s of the functions.

1. Windows of HASHES functions meet by that hash and another shingle REACH before or behind it, so that texts which
   share just one line don't meet. Equal keys of a batch of documents, and those that were frequent in the partition
   before, are merged at once: the first window stands for the others, which are linked with it (its own document's with
   another document); so a key in a third of all rows is shuffled about once a partition.
2. Sorted by key, each window is linked with the first one of its key. No pairs within a group are made.
3. Links of a pair of documents are joined by their intervals; a candidate is a run of overlapping intervals in which
   ENOUGH hash functions agree.
4. The shingles of both sides are fetched and compared: the passage is the stretch, from one shared shingle to another, in
   which at least four of five are shared, and both sides' sets must have a Jaccard similarity of SIMILARITY or more.
5. The first of a key may share the key only, as a line of under 50 words, and the others a passage. So windows whose link
   was not verified meet again, by more than the key. Every range of LEAST_SHINGLES around the window's least hash that
   the verified passage doesn't hold meets by the hash of all its shingles: whoever shares it then shares the passage,
   and no exact passage is lost. Where nothing was verified, windows also meet by the least hashes, under other functions,
   of what is before and behind, which finds passages with edits. Steps 2 to 4 follow for these.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import attach, batch_rows, keyed, likely, table, written
from quire.llm.components import components
from quire.llm.toxicity import segments

SHINGLE = 5
LEAST_WORDS = 50
LEAST_SHINGLES = LEAST_WORDS - SHINGLE + 1
HASHES = 3
ENOUGH = 2
#: A window meets others by its least hash and a shingle this far from it. Of every passage one of the two sides is inside.
REACH = LEAST_SHINGLES // 2
SIMILARITY = 0.8
#: Documents whose windows are merged before they are shuffled; and rows of an Arrow batch.
SLICE = 300
ROWS = 3000
#: Shingles that a task holds at once, about.
SLICE_SHINGLES = 400_000
#: Keys whose first window a task remembers.
FREQUENT = 200_000
#: Stretches of a document that are fetched together.
SPANS = 5000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_LOW = np.uint64(0xFFFF)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number, and of its inverse, modulo 2 ** 64."""
    m, one = int(_MULTIPLIERS[3]), np.ones(1, dtype=np.uint64)
    return tuple(np.multiply.accumulate(np.concatenate([one, np.full(n - 1, x, dtype=np.uint64)])) for x in (m, pow(m, -1, 1 << 64)))


#: Bytes that are hashed together, about; a longer word is hashed whole.
PIECE = 1 << 16
_POWERS = _powers(2 * PIECE)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word, A-Z lower-cased: the sum of its bytes over powers of an odd number, from the word's first byte on."""
    raw = np.frombuffer((text or "").encode().lower(), dtype=np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[raw], [True]])))
    starts, ends = edges[::2], edges[1::2]
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + PIECE, "right")))
        n = int(ends[j - 1] - at)
        up, down = _POWERS if n < len(_POWERS[0]) else _powers(n + 1)
        # one more than the byte, so that zero bytes count
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((raw[at : at + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - at] - sums[starts[i:j] - at]) * down[starts[i:j] - at]
        i = j
    return out


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the shingles, each a polynomial of its words' hashes; none for fewer than LEAST_WORDS words."""
    w = word_hashes(text)
    if len(w) < LEAST_WORDS:
        return np.zeros(0, dtype=np.uint64)
    w = mixed(w, 1)
    n = len(w) - SHINGLE + 1
    h = w[:n].copy()
    for k in range(1, SHINGLE):
        h = h * _MULTIPLIERS[1] + w[k : k + n]
    return mixed(h, 2)


def range_hashes(h: np.ndarray, least: int = LEAST_SHINGLES) -> np.ndarray:
    """The hash of each range of `least` shingles, by sums over powers of an odd number and of its inverse."""
    up, down = (x[: len(h)] for x in (_POWERS if len(h) <= len(_POWERS[0]) else _powers(len(h))))
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.add.accumulate(h * up)])
    n = len(h) - least + 1
    return mixed((sums[least:] - sums[:n]) * down[:n], 3)


def mixed(x: np.ndarray, function: int) -> np.ndarray:
    """One of the hash functions over shingle hashes (a multiply-and-shift mix)."""
    y = (x ^ (x >> np.uint64(29))) * _MULTIPLIERS[function]
    y = (y ^ (y >> np.uint64(32))) * _MULTIPLIERS[function - 1]
    return y ^ (y >> np.uint64(31))


def compact_windows(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST_SHINGLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of all compact windows of at least `least` items in the sequences x[start:end], level by level of their trees.

    The lowest 16 bits are replaced by a mix of the position, so that equal hashes, as of a repeated line, are split about
    evenly and the tree stays shallow. Any of several equal minima is a right one.
    """
    place = np.arange(len(x)) - np.repeat(starts, ends - starts)
    ties = (place.astype(np.uint64) * _MULTIPLIERS[0]) >> np.uint64(48)
    x = (x & ~_LOW) | (ties & _LOW)
    found = []
    a, b = starts[ends - starts >= least], ends[ends - starts >= least]
    while len(a):
        n = b - a
        begin = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(a - begin, n)
        v = x[at]
        hit = np.flatnonzero(v == np.repeat(np.minimum.reduceat(v, begin), n))
        _, first = np.unique(np.searchsorted(begin, hit, "right"), return_index=True)
        c = at[hit[first]]
        found.append((a, c, b))
        left, right = c - a >= least, b - c - 1 >= least
        a, b = np.concatenate([a[left], c[right] + 1]), np.concatenate([c[left], b[right]])
    return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3


_COLUMNS = ["key", "doc", "l", "c", "r", "f", "doc2", "l2", "c2", "r2"]
_KINDS = "key long, doc long, l int, c int, r int, f int, doc2 long, l2 int, c2 int, r2 int"


def _batch(columns: dict[str, np.ndarray], nulls: np.ndarray | None = None) -> pa.RecordBatch:
    arrays = []
    for k in _COLUMNS:
        kind = pa.int64() if k in ("key", "doc", "doc2") else pa.int32()
        arrays.append(pa.array(columns[k], kind, mask=nulls if k.endswith("2") else None))
    return pa.RecordBatch.from_arrays(arrays, names=_COLUMNS)


def _linked(key: np.ndarray, before: tuple | None) -> tuple:
    """For rows sorted by key: index of the first row of each row's key; -1 where `before` holds the key's first row."""
    n = len(key)
    new = np.ones(n, dtype=bool)
    new[1:] = key[1:] != key[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    if before is not None and n and key[0] == before[0]:
        first[first == 0] = -1
    return first, new


def _others(new: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """For rows sorted by key, `new` where a key begins: index of the key's first row that isn't `alone`, or -1."""
    if not len(new):
        return np.zeros(0, dtype=np.int64)
    group = np.cumsum(new) - 1
    out = np.full(group[-1] + 1, -1)
    at = np.flatnonzero(~alone)[::-1]
    out[group[at]] = at  # backwards, so that the first one stays
    return out[group]


class _Frequent:
    """The first windows of keys that were frequent in earlier batches of a partition, up to a number of them."""

    def __init__(self):
        self.rows = np.zeros((0, 6), dtype=np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key's row, or -1."""
        if not len(self.rows):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.rows[:, 0], keys), len(self.rows) - 1)
        return np.where(self.rows[at, 0] == keys, at, -1)

    def add(self, rows: np.ndarray) -> None:
        """rows of new keys; where there are too many, the older ones go, as they only save shuffling."""
        if len(rows):
            kept = self.rows if len(self.rows) + len(rows) <= FREQUENT else self.rows[:0]
            a = np.concatenate([kept, rows[:FREQUENT]])
            self.rows = a[np.argsort(a[:, 0], kind="stable")]


def _merged(a: np.ndarray, frequent: _Frequent) -> Iterator[pa.RecordBatch]:
    """Rows (key, doc, l, c, r, f) of a batch; those with equal keys as links with the first of them or with a frequent one."""
    a = a[np.lexsort((a[:, 3], a[:, 1], a[:, 0]))]
    first, new = _linked(a[:, 0], None)
    # a passage that one document repeats isn't linked with itself, but with the first other document of its key;
    # where the batch has none, it meets the other batches like the first row
    alone = a[first, 1] == a[:, 1]
    second = _others(new, alone)
    lone = (first == np.arange(len(a))) | (alone & (second < 0))
    lead = a[np.where(alone & ~lone, second, first)]
    at = frequent.find(a[:, 0])
    known = frequent.rows[np.maximum(at, 0)] if len(frequent.rows) else np.zeros_like(a)
    again = lone & (at >= 0) & (known[:, 1] != a[:, 1])
    lead, lone = np.where(again[:, None], known, lead), lone & ~again
    often = (first != np.arange(len(a))) & ~alone
    often = np.unique(first[often])
    frequent.add(a[often[at[often] < 0]])
    # a link needs no meeting any more: its own key only spreads it
    key = np.where(lone, a[:, 0], mixed(a[:, 0].view(np.uint64) ^ a[:, 1].view(np.uint64), 1).view(np.int64))
    columns = {"key": key, "doc": a[:, 1], "l": a[:, 2], "c": a[:, 3], "r": a[:, 4], "f": a[:, 5], "doc2": lead[:, 1], "l2": lead[:, 2], "c2": lead[:, 3], "r2": lead[:, 4]}
    for at in range(0, len(a), 50_000):
        cut = slice(at, at + 50_000)
        yield _batch({k: v[cut] for k, v in columns.items()}, lone[cut])


def _keyed_windows(held: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Rows (key, doc, l, c, r, f) of the windows of documents' shingles."""
    h, docs = np.concatenate([x for _, x in held]), np.array([d for d, _ in held], dtype=np.int64)
    ends = np.cumsum([len(x) for _, x in held])
    starts = ends - [len(x) for _, x in held]
    parts = []
    for f in range(HASHES):
        w = compact_windows(mixed(h, f), starts, ends)
        other = mixed(h, (f + 1) % 4)
        for side in (-REACH, REACH):
            left, c, right = (v[(w[1] + side >= w[0]) & (w[1] + side < w[2])] for v in w)
            key = mixed(h[c] + other[c + side] + np.uint64(2 * f + (side > 0)), f).view(np.int64)
            of = np.searchsorted(ends, c, "right")
            base = starts[of]
            parts.append(np.column_stack([key, docs[of], left - base, c - base, right - base, np.full(len(c), f)]))
    return np.concatenate(parts)


def windows(docs: DataFrame) -> DataFrame:
    """Windows of docs (_key, text) by key, those of a batch with the same key merged; where doc2 is set, a row is a link found already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _Frequent()
        for b in (x.slice(at, SLICE) for x in batches for at in range(0, x.num_rows, SLICE)):
            held: list[tuple[int, np.ndarray]] = []
            size = 0
            for doc, text in zip(b.column("_key").to_pylist(), b.column("text").to_pylist(), strict=True):
                h = shingles(text)
                if len(h) >= LEAST_SHINGLES:
                    held.append((doc, h))
                    size += len(h)
                if size > SLICE_SHINGLES:
                    yield from _merged(_keyed_windows(held), frequent)
                    held, size = [], 0
            if held:
                yield from _merged(_keyed_windows(held), frequent)

    return docs.select("_key", "text").mapInArrow(run, _KINDS)


def narrower(docs: DataFrame, unverified: DataFrame) -> DataFrame:
    """Like windows(), by more of the text: for unverified windows (doc, f, c, l, r, s, e), where [s, e) is the verified
    passage around c, if any."""
    texts = likely(docs.select(F.col("_key").alias("doc"), "text"), "doc", unverified.select("doc").distinct())
    per_doc = unverified.groupBy("doc").agg(F.collect_list(F.struct("f", "c", "l", "r", "s", "e")).alias("spans"))
    met = texts.dropna().dropDuplicates(["doc"]).join(per_doc.hint("merge"), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = _Frequent()
        for b in (x.slice(at, SLICE) for x in batches for at in range(0, x.num_rows, SLICE)):
            parts = []
            for doc, text, spans in zip(*(b.column(k).to_pylist() for k in ("doc", "text", "spans")), strict=True):
                h = shingles(text)
                wanted = np.zeros(len(h), dtype=bool)
                others: dict[int, np.ndarray] = {}
                rows = []
                for x in spans:
                    f, c, left, right, s, e = x["f"], x["c"], max(x["l"], x["c"] - LEAST_SHINGLES + 1), min(x["r"], x["c"] + LEAST_SHINGLES), x["s"], x["e"]
                    if f == 0:
                        last = min(c, right - LEAST_SHINGLES) + 1
                        if s is None or e - s < LEAST_SHINGLES:
                            wanted[left:last] = True
                        else:
                            wanted[left : min(s, last)] = True
                            wanted[max(left, e - LEAST_SHINGLES + 1) : last] = True
                    if s is None:
                        for g in range(4):
                            if g != f:
                                others.setdefault(g, mixed(h, g))
                                for side, part in enumerate((others[g][left:c], others[g][c + 1 : right])):
                                    if len(part) >= REACH // 2:
                                        rows.append((int(part.min()) ^ int(h[c]), f, g, side, c, x["l"], x["r"]))
                if rows:
                    seed, f, g, side, c, left, right = (np.array(v) for v in zip(*((np.uint64(r[0]), *r[1:]) for r in rows), strict=True))
                    key = mixed(seed.astype(np.uint64) + (8 * f + 2 * g + side + 16).astype(np.uint64), 1).view(np.int64)
                    parts.append(np.column_stack([key, np.full(len(key), doc), left, c, right, f]))
                x = np.flatnonzero(wanted)
                if len(x):
                    key = range_hashes(h)[x].view(np.int64)
                    parts.append(np.column_stack([key, np.full(len(x), doc), x, x, x + LEAST_SHINGLES, np.full(len(x), HASHES)]))
            if parts:
                yield from _merged(np.concatenate(parts), frequent)

    return met.mapInArrow(run, _KINDS)


def links(found: DataFrame) -> DataFrame:
    """(a, b, f, lo_a, hi_a, lo_b, hi_b, of_b, c, l, r, c2, l2, r2): windows linked with the first of their key, cut to the
    extent both have; the linked window itself is (c, l, r), in b if of_b, else in a, and the first one is (c2, l2, r2).

    Further windows of the first one's document wait for the key's first window of another document.
    """
    by_key = found.repartition("key").sortWithinPartitions("key", F.col("doc2").isNotNull(), "doc", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # key and row of the first window of the key at hand
        waiting: list[dict] = []  # rows of that key and window's document, until another document comes
        for b in batches:
            v = {k: b.column(k).to_numpy(zero_copy_only=False) for k in ("key", "doc", "l", "c", "r", "f")}
            known = ~b.column("doc2").is_null().to_numpy(zero_copy_only=False)
            other = {k: b.column(f"{k}2").fill_null(0).to_numpy(zero_copy_only=False) for k in ("doc", "l", "c", "r")}
            loose = np.flatnonzero(~known)
            key = v["key"][loose]
            first, new = _linked(key, last)
            lead = {k: v[k][loose][np.maximum(first, 0)] for k in ("doc", "l", "c", "r")}
            if last is not None:
                for k in lead:
                    lead[k] = np.where(first < 0, last[1][k], lead[k])
            alone = v["doc"][loose] == lead["doc"]
            second = _others(new, alone)
            met: list[tuple[dict, int]] = []  # rows that waited, and the row they are linked with
            if len(key):
                if first[0] >= 0:
                    waiting = []
                elif second[0] >= 0:
                    met, waiting = [(w, loose[second[0]]) for w in waiting], []
                if key[-1] != key[0]:
                    waiting = []
                rest = alone & (first != np.arange(len(key)))
                hold = loose[rest & (second < 0) & (key == key[-1])]
                if len(hold):
                    waiting.append({k: v[k][hold] for k in ("doc", "l", "c", "r", "f")})
                again = rest & (second >= 0)
                mates = {k: np.where(again, v[k][loose][np.maximum(second, 0)], lead[k]) for k in lead}
            else:
                mates = lead
            if len(key) and (last is None or key[-1] != last[0]):
                at = loose[first[-1]]
                last = (key[-1], {k: v[k][at] for k in lead})
            lead = mates
            for k in lead:
                other[k] = other[k].copy()
                other[k][loose] = lead[k]
            ok = v["doc"] != other["doc"]
            x, y = {k: v[k][ok].astype(np.int64) for k in ("doc", "l", "c", "r")}, {k: other[k][ok].astype(np.int64) for k in other}
            f = v["f"][ok]
            if met:
                f = np.concatenate([f, *(w["f"] for w, _ in met)])
                x, y = (
                    {k: np.concatenate([x[k], *(w[k] for w, _ in met)]).astype(np.int64) for k in x},
                    {k: np.concatenate([y[k], *(np.full(len(w[k]), v[k][at]) for w, at in met)]).astype(np.int64) for k in x},
                )
            swap = x["doc"] < y["doc"]
            lo, hi = {k: np.where(swap, x[k], y[k]) for k in x}, {k: np.where(swap, y[k], x[k]) for k in x}
            own = [np.where(swap, p[k], q[k]).astype(np.int32) for p, q in ((lo, hi), (hi, lo)) for k in ("c", "l", "r")]
            left = np.minimum(lo["c"] - lo["l"], hi["c"] - hi["l"])
            right = np.minimum(lo["r"] - lo["c"], hi["r"] - hi["c"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(z) for z in (lo["doc"], hi["doc"], f.astype(np.int32), lo["c"] - left, lo["c"] + right, hi["c"] - left, hi["c"] + right, ~swap, *own)],
                names=["a", "b", "f", "lo_a", "hi_a", "lo_b", "hi_b", "of_b", "c", "l", "r", "c2", "l2", "r2"],
            )

    return by_key.mapInArrow(run, "a long, b long, f int, lo_a long, hi_a long, lo_b long, hi_b long, of_b boolean, c int, l int, r int, c2 int, l2 int, r2 int")


def candidates(linked: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """(a, b, lo_a, hi_a, lo_b, hi_b) of the runs of overlapping intervals in which enough hash functions agree."""
    linked = linked.filter(F.col("hi_b") - F.col("lo_b") >= LEAST_SHINGLES).select("a", "b", "f", "lo_a", "hi_a", "lo_b", "hi_b").distinct()
    order = Window.partitionBy("a", "b").orderBy("lo_b", "hi_b", "lo_a", "f")
    reach = F.max("hi_b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = linked.withColumn("new", F.coalesce((F.col("lo_b") >= reach).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    mins = [F.min(k).alias(k) for k in ("lo_a", "lo_b")] + [F.max(k).alias(k) for k in ("hi_a", "hi_b")]
    joined = runs.groupBy("a", "b", "run").agg(F.countDistinct("f").alias("n_hashes"), *mins)
    return joined.filter(F.col("n_hashes") >= enough).select("a", "b", "lo_a", "hi_a", "lo_b", "hi_b", "n_hashes")


def _walk(shared: np.ndarray, least: int, test: Callable[[int, int], bool], enough: float = 0.0) -> None:
    """Tests stretches of `least` or more, from one shared shingle to another, of which at least four of five are shared.

    Maximal segments lose four points for each shingle that isn't shared; a gap that costs more than either side has
    parts them, though both with the gap may still be such a stretch. So all segments are one stretch first; what fails
    is parted at its widest gap. Stretches with fewer than `enough` shared shingles are left, as their parts have no more.
    """
    # each run of equal items is one item of their sum, which leaves the segments what they are
    edges = np.concatenate([[0], np.flatnonzero(np.diff(shared)) + 1, [len(shared)]])
    found = segments((np.diff(edges) * np.where(shared[edges[:-1]], 1.0, -4.0)).tolist()) if len(shared) else []
    parts = [(int(edges[s]), int(edges[e])) for s, e, _ in found]
    count = np.concatenate([[0], np.cumsum(shared)])
    work = [(0, len(parts))] if parts else []
    while work:
        i, j = work.pop()
        s, e = parts[i][0], parts[j - 1][1]
        n = int(count[e] - count[s])
        if e - s < least or n < enough or (5 * n >= 4 * (e - s) and test(s, e)) or j - i == 1:
            continue
        cut = max(range(i + 1, j), key=lambda k: (parts[k][0] - parts[k - 1][1], -abs(2 * k - i - j)))
        work += [(cut, j), (i, cut)]


def compare(a: np.ndarray, b: np.ndarray, least: int = LEAST_SHINGLES, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """(start in a, end in a, start in b, end in b, Jaccard) of the passages that a and b share; each place of either side."""
    if len(a) == len(b) and (a == b).all():
        return [(0, len(a), 0, len(b), 1.0)] if len(a) >= least else []
    out: list[tuple[int, int, int, int, float]] = []
    # shingles as small numbers, so that sets of them are arrays of flags
    different, ids = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, size = ids[: len(a)], ids[len(a) :], len(different)
    one, two = _flags(x, size), _flags(y, size)
    shared, known = one[y], two[x]

    def test(s: int, e: int) -> bool:
        found = _matched(x, y, size, s, e, least, similarity)
        out.extend(found)
        return bool(found)

    _walk(shared, least, test)
    # two passages with a gap between may be one stretch here and apart there: then each unbroken run for itself
    for p, q in _unbroken(shared, 0, len(b)):
        if q - p >= least and not any(v[2] <= p and q <= v[3] for v in out):
            test(p, q)
    # what is one stretch on one side only, as where passages overlap, holds equal ranges all the same
    if any(q - p >= least and not any(v[k] <= p and q <= v[k + 1] for v in out) for k, of in ((2, shared), (0, known)) for p, q in _unbroken(of, 0, len(of))):
        out += _equal_ranges(a, b, least, out)
    if not out and min(len(a), len(b)) >= least:
        j = _jaccard(one, two)
        out = [(0, len(a), 0, len(b), j)] if j >= similarity else []
    return out


def _equal_ranges(a: np.ndarray, b: np.ndarray, least: int, held: list[tuple[int, int, int, int, float]]) -> list[tuple[int, int, int, int, float]]:
    """Equal runs of `least` or more, so that each range of either side that the other one has too is in one of them or in one
    of those held."""
    if min(len(a), len(b)) < least:
        return []
    x, y = (range_hashes(v.view(np.uint32).astype(np.uint64) if v.dtype == np.int32 else v, least) for v in (a, b))
    out = set()
    for there, here, turned in ((x, y, False), (y, x, True)):
        order = np.argsort(there, kind="stable")
        at = order[np.minimum(np.searchsorted(there[order], here), len(there) - 1)]
        new = there[at] == here
        for v in held:
            p, q = v[:2] if turned else v[2:4]
            new[p : max(p, q - least + 1)] = False
        i = np.flatnonzero(new)
        for run in np.split(i, np.flatnonzero((np.diff(i) != 1) | (np.diff(at[i]) != 1)) + 1):
            if len(run):
                p, q = (int(at[run[0]]), int(at[run[-1]]) + least), (int(run[0]), int(run[-1]) + least)
                out.add((*q, *p, 1.0) if turned else (*p, *q, 1.0))
    return sorted(out)


def _flags(ids: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(size, dtype=bool)
    out[ids] = True
    return out


def _jaccard(one: np.ndarray, two: np.ndarray) -> float:
    return int(np.count_nonzero(one & two)) / max(1, int(np.count_nonzero(one | two)))


def _matched(x: np.ndarray, y: np.ndarray, size: int, s: int, e: int, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """All stretches of x that are similar enough to y[s:e], both of numbers below `size`: x may hold the passage several times."""
    out: list[tuple[int, int, int, int, float]] = []
    two = _flags(y[s:e], size)

    def test(p: int, q: int) -> bool:
        j = _jaccard(_flags(x[p:q], size), two)
        if j >= similarity:
            out.append((p, q, s, e, j))
        return j >= similarity

    _walk(two[x], least, test, similarity * int(np.count_nonzero(two)))
    return out


def _unbroken(shared: np.ndarray, s: int, e: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], shared[s:e].astype(np.int8), [0]])))
    return [(s + int(x), s + int(y)) for x, y in edges.reshape(-1, 2)]


def _stretches(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(side, n, digest, h): the shingles, in 32 bits, of each wanted stretch side (doc, lo, hi), which n candidates have."""
    texts = likely(docs.select(F.col("_key").alias("doc"), "text"), "doc", wanted)
    of_doc = F.count(F.lit(1)).over(Window.partitionBy("doc"))
    parts = wanted.withColumn("part", F.pmod(F.xxhash64("lo", "hi"), 1 + F.floor(of_doc / SPANS)))
    per_doc = parts.groupBy("doc", "part").agg(F.collect_set(F.struct("lo", "hi", "n")).alias("spans"))
    met = texts.dropna().join(per_doc.hint("merge"), "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("spans")
            lo, hi, n = (lists.flatten().field(k).to_numpy() for k in ("lo", "hi", "n"))
            ends = np.cumsum(lists.value_lengths().to_numpy()).tolist()
            out: list[tuple[int, int, int, int, int, np.ndarray]] = []
            size = start = 0
            for doc, text, end in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), ends, strict=True):
                h = shingles(text)
                short = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
                for p, q, k in zip(lo[start:end].tolist(), hi[start:end].tolist(), n[start:end].tolist(), strict=True):
                    out.append((doc, p, q, k, xxhash.xxh64_intdigest(h[p:q]) - (1 << 63), short[p:q]))
                    size += q - p
                    if size > SLICE_SHINGLES:
                        yield _sides(out)
                        out, size = [], 0
                start = end
            if out:
                yield _sides(out)

    with batch_rows(docs.sparkSession):
        return written(met.mapInArrow(run, "side struct<doc:long,lo:long,hi:long>, n long, digest long, h array<int>"), "stretches")


def _sides(rows: list[tuple[int, int, int, int, int, np.ndarray]]) -> pa.RecordBatch:
    doc, lo, hi, n, digest, h = zip(*rows, strict=True)
    side = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (doc, lo, hi)], names=["doc", "lo", "hi"])
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in h])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(h)))
    return pa.RecordBatch.from_arrays([side, pa.array(n, pa.int64()), pa.array(digest, pa.int64()), lists], names=["side", "n", "digest", "h"])


def _once(parts: DataFrame) -> DataFrame:
    """parts with one row for each side: several only where equal rows are repeated."""
    repeated = parts.groupBy("side").count().filter("count > 1")
    return parts if repeated.isEmpty() else written(parts.dropDuplicates(["side"]), "sides")


def _unverified(linked: DataFrame, found: DataFrame) -> DataFrame:
    """(doc, f, c, l, r, s, e): linked windows around whose least hash the pair's verified passage doesn't hold all that a
    passage could; [s, e) is that passage, nulls for none. Windows of the other functions only where there is none; then
    the first window of the key comes too, as it may have been the right one and the search too coarse."""
    inside = (F.col("s") <= F.col("c")) & (F.col("c") < F.col("e"))
    side = lambda k, other, own: linked.filter(own).select("a", "b", F.col(k).alias("doc"), F.col(other).alias("doc2"), "f", "c", "l", "r", "c2", "l2", "r2").join(
        found.select("a", "b", F.col(f"start_{k}").alias("s"), (F.col(f"end_{k}") - SHINGLE + 1).alias("e")), ["a", "b"], "left"
    )
    met = side("b", "a", F.col("of_b")).unionByName(side("a", "b", ~F.col("of_b")))
    size = F.when(inside, F.col("e") - F.col("s"))
    best = met.groupBy("doc", "f", "c", "l", "r").agg(F.max(F.struct(size.alias("size"), "s", "e")).alias("x"), F.max_by(F.struct("doc2", "c2", "l2", "r2"), F.coalesce(size, F.lit(-1))).alias("y"))
    whole = F.col("x.size").isNotNull() & (F.col("x.s") <= F.greatest("l", F.col("c") - LEAST_SHINGLES + 1)) & (F.col("x.e") >= F.least("r", F.col("c") + LEAST_SHINGLES))
    found_one = F.col("x.size").isNotNull()
    best = written(best.filter(~whole & ((F.col("f") == 0) | ~found_one)), "best")
    none = F.lit(None).cast("int")
    own = best.select("doc", "f", "c", "l", "r", F.when(found_one, F.col("x.s")).cast("int").alias("s"), F.when(found_one, F.col("x.e")).cast("int").alias("e"))
    lead = best.filter(~found_one).select(F.col("y.doc2").alias("doc"), "f", F.col("y.c2").alias("c"), F.col("y.l2").alias("l"), F.col("y.r2").alias("r"), none.alias("s"), none.alias("e"))
    return own.unionByName(lead.distinct())


def shared_passages(docs: DataFrame) -> DataFrame:
    """(a, b, start_a, end_a, start_b, end_b, similarity): verified links of docs (_key, text), a < b, in words from 0 with
    the end excluded."""
    with batch_rows(docs.sparkSession, ROWS):
        linked = written(links(windows(docs)), "links")
    found = written(_verified(docs, written(candidates(linked), "pairs")), "found")
    unverified = written(_unverified(linked, found), "unverified")
    with batch_rows(docs.sparkSession, ROWS):
        linked = written(links(narrower(docs, unverified)), "links")
    held = found.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "start_b", (F.col("end_b") - SHINGLE + 1).alias("end_b"))
    same = (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))
    exact = F.col("f") == HASHES
    new = candidates(linked.filter(exact), 1).unionByName(candidates(linked.filter(~exact))).join(held, same & (F.col("lo_b") >= F.col("start_b")) & (F.col("hi_b") <= F.col("end_b")), "left_anti")
    return found.unionByName(_verified(docs, written(new, "pairs")))


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The passages of the candidates."""
    side = lambda k: F.struct(F.col(k).alias("doc"), F.col(f"lo_{k}").alias("lo"), F.col(f"hi_{k}").alias("hi"))
    sides = pairs.select(side("a").alias("s")).unionByName(pairs.select(side("b").alias("s"))).select("s.*")
    counted = written(sides.groupBy("doc", "lo", "hi").agg(F.count(F.lit(1)).alias("n")), "counted")
    parts = _once(_stretches(docs, counted))
    light, heavy = parts.select("side", "n", "digest"), parts.select("side", "n", "h")
    keyed = pairs.select(side("a").alias("side"), side("b").alias("y"))
    one = attach(keyed, light, "side", "n").select(F.col("side").alias("x"), F.col("digest").alias("dx"), F.col("y").alias("side"))
    both = attach(written(one, "one"), light, "side", "n").select("x", F.col("side").alias("y"), (F.col("dx") == F.col("digest")).alias("same"))
    both = written(both, "both")
    equal = both.filter("same").select(
        F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), F.col("x.lo").alias("start_a"), F.col("x.hi").alias("end_a"), F.col("y.lo").alias("start_b"), F.col("y.hi").alias("end_b"), F.lit(1.0).alias("similarity")
    )
    first = attach(both.filter("not same").select(F.col("x").alias("side"), "y"), heavy, "side", "n").select(F.col("side").alias("x"), F.col("h").alias("hx"), F.col("y").alias("side"))
    full = attach(first, heavy, "side", "n")
    flat = full.select(F.col("x.doc").alias("a"), F.col("side.doc").alias("b"), F.col("x.lo").alias("lo_a"), F.col("side.lo").alias("lo_b"), "hx", F.col("h").alias("hy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x, y = (np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1]) for c in (t.column("hx"), t.column("hy")))
            ids = [t.column(k).to_pylist() for k in ("a", "b", "lo_a", "lo_b")]
            out = []
            for i, j, lo_a, lo_b, hx, hy in zip(*ids, x, y, strict=True):
                out += [(i, j, lo_a + p, lo_a + q, lo_b + s, lo_b + e, z) for p, q, s, e, z in compare(hx, hy)]
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.float64() if k == "similarity" else pa.int64()) for k, v in zip(names, columns, strict=True)], names=names
                )

    names = ["a", "b", "start_a", "end_a", "start_b", "end_b", "similarity"]
    with batch_rows(docs.sparkSession):
        near = written(flat.mapInArrow(run, "a long, b long, start_a long, end_a long, start_b long, end_b long, similarity double"), "near")
    words = lambda k: (F.col(k) + SHINGLE - 1).alias(k)
    return equal.unionByName(near).select("a", "b", "start_a", words("end_a"), "start_b", words("end_b"), "similarity")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, last_word, class_id, n_links): passages of 50 words or more that another document has too.

    Words are numbered from 0; overlapping passages of a document are joined. class_id is the least doc_id of the documents
    that passages link, directly or through others; n_links counts the verified links that the passage joins. Documents
    without such a passage, null or short texts have no row; very long texts are read whole. Rows without a doc_id are
    ignored; rows that share a doc_id are one document if their texts are equal, else documents of their own with one
    doc_id. Empty tables give no rows; other columns are ignored, whatever their names.
    """
    rows, several = keyed(docs.filter("doc_id is not null"))
    merged = _merged_passages(rows)
    if not several:
        return merged.select(F.col("key").alias("doc_id"), "first_word", "last_word", F.col("class").alias("class_id"), "n_links")
    merged = written(merged.join(rows.select(F.col("_key").alias("key"), "doc_id").distinct(), "key"), "merged")
    classes = merged.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return merged.join(classes, "class").select("doc_id", "first_word", "last_word", "class_id", "n_links")


def _merged_passages(docs: DataFrame) -> DataFrame:
    found = written(shared_passages(docs), "passages")
    ends = found.select(F.col("a").alias("key"), F.col("start_a").alias("s"), F.col("end_a").alias("e")).unionByName(
        found.select(F.col("b").alias("key"), F.col("start_b").alias("s"), F.col("end_b").alias("e"))
    )
    ends = ends.groupBy("key", "s", "e").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("key").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = ends.withColumn("new", F.coalesce((F.col("s") > reach).cast("int"), F.lit(1)))
    runs = runs.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("key", "run").agg(F.min("s").alias("first_word"), (F.max("e") - 1).alias("last_word"), F.sum("n").alias("n_links"))
    classes = components(found.select("a", "b")).withColumnRenamed("id", "key")
    return merged.join(classes, "key").select("key", "first_word", "last_word", F.col("component").alias("class"), "n_links")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))
