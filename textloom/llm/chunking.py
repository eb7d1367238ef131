"""Splitting oversized items at natural boundaries, by lexical-cohesion segmentation.

Candidate boundaries of the item's type come in levels, coarse to fine.  Word
blocks on both sides of every candidate are compared; a low similarity between
the nearest peaks on both sides is a valley, a change of topic.  Each piece ends at the deepest valley
of the coarsest level that has a boundary in the piece's size window, and the
next piece repeats the wanted number of characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import strip
from textloom.llm.textcore import U, Words

_LINE, _BLANK, _SPACE = r"\r?\n", r"\r?\n[ \t]*(?:\r?\n[ \t]*)+", r"\s+"
_SENTENCE = r"[.!?…][\"')\]»”]*\s+|[。！？]"
#: natural boundaries of each type, coarse to fine; a boundary is the end of a match
LEVELS: dict[str, list[str]] = {
    "markdown": [r"\r?\n(?=#{1,6} )", _BLANK, _LINE, _SENTENCE, _SPACE],
    "txt": [_BLANK, _LINE, _SENTENCE, _SPACE],
    "code": [_BLANK + r"(?=\S)", _BLANK, _LINE, r"[;{}]\s*", _SPACE],
    "html": [r"</(?:div|section|article|table|ul|ol|p|pre|h[1-6]|li|tr|blockquote)>\s*", _LINE + r"|>\s*", _SENTENCE, _SPACE],
    "json": [_LINE, r"[\]}],\s*", r",\s*", r"[:\[{]\s*|\s+"],
}
_COMPILED = {kind: [re.compile(p) for p in levels] for kind, levels in LEVELS.items()}
BLOCK_WORDS = 40
_DIMENSIONS = 64
_SLAB_WORDS = 1 << 16  # bounds the counts held at a time of one text
_FLUSH_CHARS = 1 << 22  # bounds the pieces held at a time of one batch
_UNSPACED = r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]"
_UNSPACED_PAIR = re.compile(rf"({_UNSPACED})(?=({_UNSPACED}))")


def _tokens(segment: str) -> str:
    """Words stay; characters of scripts without blanks become overlapping pairs."""
    return _UNSPACED_PAIR.sub(r"\1\2 ", segment)


def _similarities(words: Words, mid: np.ndarray) -> np.ndarray:
    """Cosine of the hashed word counts of the blocks before and after each place (ascending word positions), slab by slab."""
    out = np.zeros(len(mid))
    at = 0
    while at < len(mid):
        upto = max(at + 1, int(np.searchsorted(mid, mid[at] + _SLAB_WORDS, side="right")))
        here = mid[at:upto]
        low, high = max(0, int(here[0]) - BLOCK_WORDS), min(len(words.hash), int(here[-1]) + BLOCK_WORDS)
        total = np.zeros((high - low + 1, _DIMENSIONS), np.int32)
        total[np.arange(1, high - low + 1), (words.hash[low:high] >> U(58)).astype(np.int64)] = 1
        np.cumsum(total, axis=0, out=total)
        left = (total[here - low] - total[np.maximum(here - BLOCK_WORDS, low) - low]).astype(np.float64)
        right = (total[np.minimum(here + BLOCK_WORDS, high) - low] - total[here - low]).astype(np.float64)
        norm = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
        out[at:upto] = np.where(norm > 0, (left * right).sum(axis=1) / np.maximum(norm, 1e-9), 0)
        at = upto
    return out


def valley_depth(alike: np.ndarray) -> np.ndarray:
    """How far the similarity rises from each place to the nearest peak on its left and on its right."""
    n = np.arange(len(alike))
    climbs = alike[:-1] >= alike[1:]  # going left from i + 1 does not lead down
    peak_left = np.maximum.accumulate(np.where(np.append(False, climbs), 0, n))
    falls = alike[1:] >= alike[:-1]
    peak_right = np.minimum.accumulate(np.where(np.append(falls, False), len(alike), n)[::-1])[::-1]
    return alike[peak_left] - alike + alike[peak_right] - alike


def cohesion_depth(text: str, at: np.ndarray) -> np.ndarray:
    """Depth of the similarity valley at each (ascending) boundary of a text."""
    if not len(at):
        return np.zeros(0)
    cuts = np.concatenate([[0], at, [len(text)]]).tolist()
    words = Words([_tokens(text[a:b]) for a, b in zip(cuts[:-1], cuts[1:])])
    return valley_depth(_similarities(words, words.first[1:-1]))


def split_points(text: str, kind: str, size: int, overlap: int) -> list[tuple[int, int, int]]:
    """Pieces ``(begin, end, level)`` of a text; level -1 is a cut without boundary, -2 the end of the text."""
    size = max(1, size)
    overlap = min(max(0, overlap), size - 1)
    levels = [np.unique([m.end() for m in p.finditer(text)]).astype(np.int64) for p in _COMPILED.get(kind, _COMPILED["txt"])] if len(text) > size else []
    depths: list[np.ndarray | None] = [None] * len(levels)
    out, begin, done = [], 0, 0
    while len(text) - begin > size:
        # a piece must pass the end of the one before; the first half of the window is used only if the second has nothing
        for low in (max(done, begin + size // 2), done):
            for k, places in enumerate(levels):
                a, b = np.searchsorted(places, [low, begin + size], side="right")
                if a == b:
                    continue
                if depths[k] is None:
                    depths[k] = cohesion_depth(text, places)
                end, level = int(places[a + np.argmax(np.round(depths[k][a:b], 4) + np.arange(b - a) * 1e-9)]), k
                break
            else:
                continue
            break
        else:
            end, level = begin + size, -1
            if text[end - 1 : end + 1] == "\r\n" and end - 1 > done:
                end -= 1
        out.append((begin, end, level))
        begin, done = end - overlap, end
    return [*out, (begin, len(text), -2)]


def _pieces():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = (batch.column(0).type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            made = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["id", "piece", "pieces", "begin_char", "end_char", "level", "content"])
            cols: list[list] = [[] for _ in range(7)]
            held = 0
            for key, text, kind, size, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                pieces = split_points(text, kind, size, overlap)
                for n, (begin, end, level) in enumerate(pieces):
                    for column, value in zip(cols, (key, n, len(pieces), begin, end, level, text[begin:end])):
                        column.append(value)
                    held += end - begin
                    if held > _FLUSH_CHARS:
                        yield made(cols)
                        cols, held = [[] for _ in range(7)], 0
            if cols[0]:
                yield made(cols)

    return run


def oversized_items(df: DataFrame, id_col: str, text_col: str, type_col: str, settings: DataFrame, *, default_type: str = "txt") -> DataFrame:
    """``(id, text, kind, size, overlap)`` of the items longer than the ``chunk_size`` of their type.

    Types compare without regard to case and outer blanks; a missing or unlisted
    one counts as ``default_type``.  Length is in code points of the stored text.
    """
    sizes = settings.select(F.lower(strip(F.col("doc_type"))).alias("t"), F.col("chunk_size").alias("size"), F.coalesce("chunk_overlap", F.lit(0)).alias("overlap")).where("t is not null and size is not null")
    own = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.lower(strip(F.col(type_col))), F.lit(default_type)).alias("given"))
    own = own.where("id is not null and text is not null")
    plain = sizes.where(F.col("t") == default_type).select(F.col("size").alias("default_size"), F.col("overlap").alias("default_overlap"))
    return (
        own.join(sizes, own.given == sizes.t, "left")
        .join(F.broadcast(plain.limit(1)), F.lit(True), "left")
        .select("id", "text", F.coalesce("t", F.lit(default_type)).alias("kind"), F.coalesce("size", "default_size").alias("size"), F.coalesce("overlap", "default_overlap").alias("overlap"))
        .where(F.length("text") > F.col("size"))
    )


def split_oversized(df: DataFrame, id_col: str, text_col: str, type_col: str, settings: DataFrame, *, default_type: str = "txt") -> DataFrame:
    """Ordered pieces ``(id, piece, pieces, begin_char, end_char, level, content)`` of every oversized item.

    A piece has at most ``chunk_size`` characters, begins ``chunk_overlap``
    characters before the end of the piece before, and ends at a natural boundary
    of its type where its window holds one (``level`` 0 is the coarsest, -1 a cut
    without boundary, -2 the end of the text).  An item delivered again is cut
    once.  Null ids and texts, and items within the limit, have no pieces.
    """
    kind = df.schema[id_col].dataType.simpleString()
    items = oversized_items(df, id_col, text_col, type_col, settings, default_type=default_type)
    once = items.groupBy("id").agg(F.any_value(F.struct("text", "kind", "size", "overlap")).alias("v")).select("id", "v.*")
    return once.mapInArrow(_pieces(), f"id {kind}, piece int, pieces int, begin_char bigint, end_char bigint, level int, content string")
