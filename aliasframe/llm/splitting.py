"""Oversized texts cut at natural boundaries, all greedy cuts at once by pointer doubling.

A text's tokens are its positions. Every position has one farthest legal successor: from there a piece
may reach at most ``limit`` tokens; it ends at the farthest boundary of the strongest kind that leaves it
at least ``least_fill`` full (paragraph, line, sentence, clause, word), and the next piece starts ``overlap``
tokens before that end. The successor table is squared again and again; joined with the positions
reached so far, each squaring doubles the number of known cuts, so a text of n pieces takes log2(n)
rounds of array operations and no loop over pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, LEAST_FILL = 512, 64, 0.5
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SENTENCE_END = re.compile(r"[.!?…。！？]+[\"'”’)\]]*\Z")
_CLAUSE_END = re.compile(r"[,;:，；：]+\Z")
PARAGRAPH, LINE, SENTENCE, CLAUSE = 4, 3, 2, 1


def token_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all tokens: runs of letters, digits and underscores, and runs of other visible characters."""
    flat = np.fromiter((x for m in _TOKEN.finditer(text) for x in m.span()), np.int64)
    return flat[0::2], flat[1::2]


def boundary_levels(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Strength of the boundary after each token; the last token's is that of a paragraph."""
    n = len(starts)
    levels = np.zeros(n + 1, np.int8)
    gap = starts[1:] - ends[:-1]
    for i in np.nonzero(gap > 0)[0]:
        between = text[ends[i] : starts[i + 1]]
        breaks = between.count("\n")
        if breaks > 1:
            levels[i + 1] = PARAGRAPH
        elif breaks == 1:
            levels[i + 1] = LINE
        else:
            last = text[max(starts[i], ends[i] - 8) : ends[i]]
            if not last[-1].isalnum():
                levels[i + 1] = SENTENCE if _SENTENCE_END.search(last) else CLAUSE if _CLAUSE_END.search(last) else 0
    levels[n] = PARAGRAPH
    return levels


def successors(levels: np.ndarray, limit: int, overlap: int, least_fill: float) -> tuple[np.ndarray, np.ndarray]:
    """For every token position: the end of the piece that starts there, and the start of the next (n: none)."""
    n = len(levels) - 1
    at = np.arange(n + 1)
    reach = np.minimum(at + limit, n)
    least = at + max(overlap + 1, int(np.ceil(limit * least_fill)))
    end = reach.copy()
    open_ = reach < n
    for level in (PARAGRAPH, LINE, SENTENCE, CLAUSE):
        last = np.maximum.accumulate(np.where(levels >= level, at, -1))
        cut = last[reach]
        good = open_ & (cut >= least)
        end[good] = cut[good]
        open_ &= ~good
    return end, np.where(end >= n, n, end - overlap)


def piece_starts(step: np.ndarray) -> np.ndarray:
    """All positions reached from 0 by ``step``, in order, by squaring the table."""
    n = len(step) - 1
    reached = np.zeros(n + 1, bool)
    reached[0] = True
    while True:
        more = reached.copy()
        more[step[reached]] = True
        if (more == reached).all():
            break
        reached = more
        step = step[step]
    reached[n] = False
    return np.nonzero(reached)[0]


def split_text(text: str | None, limit: int = LIMIT, overlap: int = OVERLAP, least_fill: float = LEAST_FILL) -> list[tuple[int, int, int, int]]:
    """(first token, tokens, first character, end character) of each piece of a text above the limit, else [].

    The first piece starts at the text's first character and the last ends at its last; between neighbours the
    later piece starts ``overlap`` tokens before the earlier one's end.
    """
    if not 0 <= overlap < limit * least_fill:
        raise ValueError("overlap must be below limit * least_fill")
    if not text or len(text) <= limit:
        return []
    starts, ends = token_spans(text)
    n = len(starts)
    if n <= limit:
        return []
    end, step = successors(boundary_levels(text, starts, ends), limit, overlap, least_fill)
    first = piece_starts(step)
    last = end[first]
    begin = np.where(first == 0, 0, starts[first])
    stop = np.where(last >= n, len(text), starts[np.minimum(last, n - 1)])
    return list(zip(first.tolist(), (last - first).tolist(), begin.tolist(), stop.tolist(), strict=True))


def _pieces(limit: int, overlap: int, least_fill: float, with_text: bool):
    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("id", "piece_no", "first_token", "tokens", "char_start", "char_end", "piece")}
            for key, text in zip(batch.column("__id").to_pylist(), batch.column("__text").to_pylist(), strict=True):
                for k, (first, size, a, b) in enumerate(split_text(text, limit, overlap, least_fill)):
                    for name, v in zip(out, (key, k, first, size, a, b, text[a:b] if with_text else None), strict=True):
                        out[name].append(v)
            types = (batch.schema.field("__id").type, *[pa.int64()] * 5, pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return run


def split_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, least_fill: float = LEAST_FILL, with_text: bool = True) -> DataFrame:
    """``key, piece_no, first_token, tokens, char_start, char_end, piece`` of every text above ``limit`` tokens.

    Texts within the limit, empty and null ones give no rows. A text whose characters don't exceed the
    limit cannot hold more tokens, which the scan already filters. A run without any white space
    is cut between tokens where nothing better stands. Documents with the same text are split each; no row
    depends on another, so a document never leaves its task.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.where(F.length(text) > limit).select(F.col(key).alias("__id"), F.col(text).alias("__text"))
    got = rows.mapInArrow(_pieces(limit, overlap, least_fill, with_text), f"id {kind}, piece_no bigint, first_token bigint, tokens bigint, char_start bigint, char_end bigint, piece string")
    got = got.withColumnRenamed("id", key)
    return got if with_text else got.drop("piece")
