"""Full-text search in the manner of a `simple` configuration: lower-cased words and digits, all terms must be there.

Compound tokens (hyphens, hosts, addresses) are not made; tags are no tokens if the text is stripped before.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
DELIMITER = " … "


def terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)))


def query_terms(q: str) -> list[str]:
    """The distinct terms of a query; none for a blank one, which then matches nothing."""
    import re

    return list(dict.fromkeys(re.findall(r"[^\W_]+", q.lower())))


def matches(text: Column, q: str) -> Column:
    """All terms of the query are words of the text. A plain containment test drops most rows before the text is split."""
    wanted = query_terms(q)
    if not wanted:
        return F.lit(False)
    low = F.lower(text)
    rough = low.contains(wanted[0])
    for t in wanted[1:]:
        rough = rough & low.contains(t)
    exact = F.size(F.array_except(F.array(*map(F.lit, wanted)), terms(text))) == 0
    return F.coalesce(rough & exact, F.lit(False))


def headline(text: Column, q: str, most: int = 40, least: int = 15, start: str = "<b>", stop: str = "</b>", fragments: int = 2) -> Column:
    """Up to `fragments` windows of at most `most` words around hits, hits between start and stop.

    The first window starts `least` // 2 words before the first hit, as far as there are words; the next one around the
    first hit behind it. Without a hit it is the text's first `least` words.
    """
    wanted = F.array(*map(F.lit, query_terms(q))).cast("array<string>")
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    clean = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", "")
    hit = lambda w: F.array_contains(wanted, clean(w))
    marked = F.transform(words, lambda w: F.when(hit(w), F.concat(F.lit(start), w, F.lit(stop))).otherwise(w))
    hits = F.filter(F.transform(words, lambda w, i: F.when(hit(w), i)), lambda i: i.isNotNull())
    none = F.array().cast("array<struct<a:int,b:int>>")

    def step(acc: Column, i: Column) -> Column:
        end = F.coalesce(F.try_element_at(acc, F.lit(-1))["b"], F.lit(0))
        a = F.greatest(end, i - least // 2)
        return F.when((F.size(acc) < fragments) & (i >= end), F.concat(acc, F.array(F.struct(a.alias("a"), (a + most).alias("b"))))).otherwise(acc)

    spans = F.aggregate(hits, none, step)
    parts = F.transform(spans, lambda s: F.array_join(F.slice(marked, s["a"] + 1, s["b"] - s["a"]), " "))
    return F.when(F.size(spans) > 0, F.array_join(parts, DELIMITER)).otherwise(F.array_join(F.slice(words, 1, least), " "))
