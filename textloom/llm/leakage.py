"""Evaluation texts leaking into training text, by SimHash windows and multi-index Hamming blocks.

Every window of ``window`` words of an evaluation item and of the corpus gets a
64-bit SimHash of its words.  The 64 bits are cut into ``radius + 1`` blocks; two
fingerprints within the radius agree in one block at least, so looking every
corpus window up in one table per block meets all item windows within the
radius.  The weighted similarity of their word shingles verifies those and, where
all shingles are asked for, the words in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.textcore import U, Words, mix, slices
from textloom.session import spread

ITEM_CHARS = 8_000_000  # characters of items per pass: bounds the broadcast index; more items take more passes


def simhashes(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """SimHash and first word of every window of ``window`` words inside one text."""
    n = len(words.hash)
    if n < window:
        return np.zeros(0, U), np.zeros(0, np.int64)
    bits = np.unpackbits(mix(words.hash ^ U(0x5EED)).view(np.uint8).reshape(n, 8), axis=1)
    # sums of 1, 2, 4, ... rows are put together to sums of ``window`` rows
    run, width, votes, at = bits if window < 256 else bits.astype(np.uint32), 1, None, 0
    while True:
        if window & width:
            part = run[at : at + n - window + 1]
            votes, at = part if votes is None else votes + part, at + width
        if 2 * width > window:
            break
        run, width = run[:-width] + run[width:], 2 * width
    prints = np.packbits(votes > window // 2, axis=1).view(U).ravel()
    where = np.nonzero(words.text[: n - window + 1] == words.text[window - 1 :])[0]
    return prints[where], where


class ItemIndex:
    """Windows of the evaluation items, with a lookup table for each block of fingerprint bits."""

    def __init__(self, fields: list[tuple[str, str]], window: int, radius: int):
        self.window, self.radius = window, radius
        self.tasks = sorted({task for task, _ in fields})
        number = {task: i for i, task in enumerate(self.tasks)}
        words = Words([text for _, text in fields])
        prints, where = simhashes(words, window)
        exact = _sequence_hashes(words, where, window)
        order = np.argsort(exact, kind="stable")
        owner = np.array([number[task] for task, _ in fields], np.int64)[words.text[where]] if len(where) else np.zeros(0, np.int64)
        first = np.ones(len(order), bool)
        first[1:] = exact[order][1:] != exact[order][:-1]
        self.exact, self.prints, at = exact[order][first], prints[order][first], where[order][first]
        # all tasks that hold the same words
        group = np.cumsum(first) - 1
        pairs = np.unique(np.stack([group, owner[order]]), axis=1) if len(order) else np.zeros((2, 0), np.int64)
        self.task_of, self.task_start = pairs[1], np.searchsorted(pairs[0], np.arange(len(self.exact) + 1))
        grams, place = words.shingles(3)
        gram_at = np.full(len(words.hash) + 1, -1)
        gram_at[place] = np.arange(len(place))
        self.grams = grams[gram_at[at[:, None] + np.arange(window - 2)]] if len(at) else np.zeros((0, window - 2), U)
        seen, count = np.unique(self.grams, return_counts=True)
        self.weight_of, self.weight = seen, 1 / np.log2(1 + count.astype(float))  # common shingles weigh less
        self.bits = 64 // (radius + 1)
        self.tables = []
        for b in range(radius + 1):
            block = self._block(self.prints, b)
            by = np.argsort(block, kind="stable")
            self.tables.append((by, np.searchsorted(block[by], np.arange((1 << min(self.bits, 16)) + 1))))

    def _block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> U(self.bits * b)) & U((1 << min(self.bits, 16)) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``prints``, item window) of all pairs within the radius."""
        rows, items = [], []
        for b, (by, start) in enumerate(self.tables):
            block = self._block(prints, b)
            count = start[block + 1] - start[block]
            some = np.nonzero(count)[0]
            row = np.repeat(some, count[some])
            ends = np.cumsum(count[some])
            within = np.arange(len(row)) - np.repeat(ends - count[some], count[some])
            item = by[start[block[row]] + within]
            close = np.bitwise_count(prints[row] ^ self.prints[item]) <= self.radius
            rows.append(row[close])
            items.append(item[close])
        pair = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)]), axis=1)
        return pair[0], pair[1]

    def similarity(self, grams: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Weighted share of an item window's shingles that a corpus window's shingles hold."""
        own = self.grams[item]
        hit = (own[:, :, None] == grams[:, None, :]).any(axis=2)
        weight = self.weight[np.searchsorted(self.weight_of, own)]
        return (weight * hit).sum(axis=1) / weight.sum(axis=1)


def _sequence_hashes(words: Words, where: np.ndarray, window: int) -> np.ndarray:
    total = np.zeros(len(where), U)
    for j in range(window):
        total = total * U(0xD6E8FEB86659FD93) + words.hash[where + j]
    return mix(total)


def _find(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        names = pa.array(index.tasks, pa.string())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices([len(t) for t in texts], 1 << 19):
                words = Words(texts[part])
                prints, where = simhashes(words, index.window)
                row, item = index.near(prints)
                if not len(row):
                    continue
                at = where[row]
                grams, place = words.shingles(3)
                gram_at = np.zeros(len(words.hash) + 1, np.int64)
                gram_at[place] = np.arange(len(place))
                alike = index.similarity(grams[gram_at[at[:, None] + np.arange(index.window - 2)]], item)
                keep = alike >= threshold - 1e-9
                at, item, alike = at[keep], item[keep], alike[keep]
                if threshold >= 1:
                    same = _sequence_hashes(words, at, index.window) == index.exact[item]
                    at, item, alike = at[same], item[same], alike[same]
                count = index.task_start[item + 1] - index.task_start[item]
                ends = np.cumsum(count)
                task = index.task_of[np.repeat(index.task_start[item], count) + np.arange(count.sum()) - np.repeat(ends - count, count)]
                doc, at, alike = np.repeat(words.text[at], count), np.repeat(at - words.first[words.text[at]], count), np.repeat(alike, count)
                if not len(doc):
                    continue
                # per document and task: how many windows of the document, where the first begins, and the best similarity
                order = np.lexsort((at, task, doc))
                doc, task, at, alike = doc[order], task[order], at[order], alike[order]
                new = np.nonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(task, prepend=-1) != 0))[0]
                size = np.add.reduceat((np.diff(at, prepend=-1) != 0).astype(np.int64) | np.isin(np.arange(len(at)), new), new)
                best = np.round(np.maximum.reduceat(alike, new), 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc[new] + part.start)), names.take(pa.array(task[new])), pa.array(size.astype(np.int64)), pa.array(at[new].astype(np.int64)), pa.array(best)],
                    names=["id", "task_id", "windows", "first_word", "similarity"],
                )

    return run


def leaked_items(corpus: DataFrame, id_col: str, text_col: str, items: DataFrame, task_col: str, field_cols: list[str], *, window: int = 12, radius: int = 3, threshold: float = 1.0) -> DataFrame:
    """``(id, task_id, windows, first_word, similarity)``: corpus texts holding windows of an item's fields.

    Each field is a string or an array of strings, whose elements count one by
    one.  A window of the corpus within ``radius`` bits of one of the item counts
    if it holds the share ``threshold`` of that one's three-word shingles, rare
    ones weighing more; with ``threshold`` 1 its words must also stand there in
    order.  ``windows`` is the number of such windows and ``similarity`` the best
    share.  If several items hold the same words each is reported.  The corpus is
    read once for every ``ITEM_CHARS`` characters of items and never shuffled; a
    record delivered again gives its rows once.  Null ids, texts and fields, texts
    and fields under ``window`` words, and empty tables give no rows.
    """
    parts = [F.col(c) if items.schema[c].dataType.typeName() == "array" else F.array(c) for c in field_cols]
    fields = items.select(F.col(task_col).cast("string").alias("task"), F.explode(F.concat(*(F.coalesce(p, F.array().cast("array<string>")) for p in parts))).alias("text"))
    fields = fields.where("task is not null and text is not null")
    kind = corpus.schema[id_col].dataType.simpleString()
    docs = spread(corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null"))
    size = fields.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // ITEM_CHARS))
    found = None
    for b in range(blocks):
        block = fields if blocks == 1 else fields.where(F.pmod(F.xxhash64("task"), F.lit(blocks)) == b)
        shared = corpus.sparkSession.sparkContext.broadcast(ItemIndex([(r.task, r.text) for r in block.collect()], window, radius))
        got = docs.mapInArrow(_find(shared, threshold), f"id {kind}, task_id string, windows bigint, first_word bigint, similarity double")
        found = got if found is None else found.union(got)
    return found.distinct()
