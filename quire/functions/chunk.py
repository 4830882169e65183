"""Cutting texts into chunks of a limited length: whole paragraphs, else sentences, else words, else slices.

Filling is greedy and sequential within one text, so it stays within a row: a Python function of one text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import SENTENCE

_SENTENCE = re.compile(SENTENCE)
#: What parts a level's pieces, and how a piece that is too long is split for the next level.
_LEVELS = (
    ("\n\n", lambda t: [p for x in t.split("\n\n") if (p := x.strip())]),
    (" ", lambda t: [p for x in _SENTENCE.split(t) if x and (p := x.strip())]),
    (" ", str.split),
)


def _filled(pieces: Iterable[str], limit: int, level: int) -> Iterator[str]:
    glue, held, size = _LEVELS[level][0], [], 0
    for piece in pieces:
        more = len(piece) + (len(glue) if held else 0)
        if len(piece) <= limit and size + more <= limit:
            held.append(piece)
            size += more
            continue
        if held:
            yield glue.join(held)
        held, size = [], 0
        if len(piece) <= limit:
            held, size = [piece], len(piece)
        elif level + 1 < len(_LEVELS):
            yield from _filled(_LEVELS[level + 1][1](piece) or [piece], limit, level + 1)
        else:
            yield from (piece[k : k + limit] for k in range(0, len(piece), limit))
    if held:
        yield glue.join(held)


def chunks_of(text: str | None, limit: int) -> list[str]:
    """No chunk is longer than limit, none is blank; a blank text has none."""
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    text = (text or "").strip()
    if not text:
        return []
    return [text] if len(text) <= limit else list(_filled(_LEVELS[0][1](text), limit, 0))


def chunks(text: Column, limit: Column) -> Column:
    """By rows and not by Arrow batches: a worker holds a hundred texts at a time, where a batch of long ones has no bound."""
    return F.udf(chunks_of, "array<string>", useArrow=False)(text, limit)


def batches(items: Column, size: int) -> Column:
    """An array as arrays of at most size items, in order."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    n = F.ceil(F.size(items) / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(items, k * size + 1, size))


def reassembled(items: Column) -> Column:
    """Stripped items that aren't blank, with blank lines between."""
    clean = F.transform(items, lambda x: F.regexp_replace(x, r"(?Ud)^\s+|\s+\z", ""))
    return F.array_join(F.filter(clean, lambda x: x != ""), "\n\n")
