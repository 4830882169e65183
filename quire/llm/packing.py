"""Sequence packing by shortest-pack-first over the length histogram.

Texts become token ids; a document longer than a sequence is cut into full pieces and a rest. The driver gets the
histogram of piece lengths (at most 2048 rows, whatever the corpus) and places lengths longest first, each into the
shortest pack that is open. Packs with the same contents are one pattern with a count, so the work depends on the
number of lengths, not of documents. The patterns give every (length, rank) a sequence and an offset; pieces get a
rank within their length and look their place up.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import batch_rows, numbered, table, written

SEQUENCE = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k"
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")
_LONG_RUN = re.compile(r"\S{1000}|\s{1000}")


def vocabulary_path(kind: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{VOCABULARY}.{kind}")


@lru_cache
def _exact(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache
def _fast(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(VOCABULARY, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, json_path: str | None = None, ranks_path: str | None = None) -> list[int]:
    """Ids as `tokenizers` gives them, then END_ID.

    The same vocabulary in tiktoken is four times as fast and is used where both must agree: Latin text without the
    special token's string and without very long runs. All other texts go to `tokenizers` itself.
    """
    text = text or ""
    if _BEYOND_LATIN.search(text) or "<|endoftext|>" in text or _LONG_RUN.search(text):
        ids = _exact(json_path or vocabulary_path("json")).encode(text, add_special_tokens=False).ids
    else:
        ids = _fast(ranks_path or vocabulary_path("tiktoken")).encode_ordinary(text)
    return [*ids, END_ID]


def pieces(docs: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of every piece, written. Null texts are as empty ones: one piece of END_ID."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, text in zip(b["doc_id"].astype("Int64"), b["text"], strict=True):
                ids = np.array(token_ids(text), dtype="<u4")
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    out.append((doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)))
            frame = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    with batch_rows(docs.sparkSession):
        cut = docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
        return written(cut, "pieces")


def patterns(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths longest first) of packs that hold the histogram's pieces."""
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]  # by the tokens in the pack
    for length in sorted(histogram, reverse=True):
        left, fill = histogram[length], length
        each = size // length
        while left:
            while fill <= size - length and not open_[fill]:
                fill += 1
            if fill > size - length:  # none fits: new packs, each of which takes what it can
                full, rest = divmod(left, each)
                for n, pattern in ((full, (length,) * each), (1, (length,) * rest)):
                    if n and pattern:
                        at = sum(pattern)
                        open_[at][pattern] = open_[at].get(pattern, 0) + n
                break
            pattern, have = next(iter(open_[fill].items()))
            n = min(left, have)
            if n == have:
                del open_[fill][pattern]
            else:
                open_[fill][pattern] = have - n
            new = (*pattern, length)
            open_[fill + length][new] = open_[fill + length].get(new, 0) + n
            left -= n
    return [(n, p) for fill in reversed(open_) for p, n in sorted(fill.items(), reverse=True)]


def places(found: list[tuple[int, tuple[int, ...]]]) -> pd.DataFrame:
    """For every (length, ranks from first up): the sequence of the first rank, and the offset in it; sequences follow on."""
    rows, rank, sequence = [], {}, 0
    for n, pattern in found:
        offset = 0
        for length in pattern:
            first = rank.get(length, 0)
            rows.append((length, first, sequence, offset))
            rank[length] = first + n
            offset += length
        sequence += n
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def packed(docs: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of docs.

    Null texts are as empty ones and yield END_ID alone. Repeated rows and null doc_ids are packed like any other row;
    an empty table gives no rows. Columns other than doc_id and text are ignored, whatever their names.
    """
    cut = pieces(docs, length)
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    where = places(patterns(histogram, length))
    starts = {n: (g["first"].to_numpy(), g["sequence"].to_numpy(), g["offset"].to_numpy()) for n, g in where.groupby("length")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sequence, offset = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            lengths, rank = b["length"].to_numpy(), b["_rank"].to_numpy()
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                first, s, o = starts[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = s[k] + rank[at] - first[k], o[k]
            b["doc_id"] = b["doc_id"].astype("Int64")
            yield b.drop(columns="_rank").assign(sequence_id=sequence, offset=offset)

    ranked = numbered(cut, ["length"], ["doc_id", "start", "ids_crc32"], "_rank")
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_rank").mapInPandas(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
