"""Per-text summaries used by the similarity operators: shingle sets and a one-permutation bit sketch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.textcore import U, Words, mix, signed, slices

BINS = 256
SKETCH = ("w0", "w1", "w2", "w3")  # the words of a record's sketch
DEVIATIONS = 4  # a candidate's sketches may differ in so many deviations more bits than expected at the threshold


def text_key(text: Column, tag: str = "") -> Column:
    """64-bit identity of a text; copies share it, so a hot group of copies is one class from the start."""
    return F.xxhash64(F.length(text), text, F.lit(tag))


def distinct_shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order: (hash, text, word position)."""
    h, where = words.shingles(width)
    text = words.text[where]
    order = np.lexsort((h, text))
    h, text, where = h[order], text[order], where[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new], where[new]


def bit_sketch(h: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """256 bits of each text as four words: one bit of the smallest shingle hash in each of 256 bins.

    A bit of two texts differs with half the chance that the bin's minimum differs,
    so at similarity 0.5 about a quarter of the bits differ and at 0 about half.
    """
    cell = text.astype(np.int64) * BINS + (h >> U(56)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]  # ascending by (text, hash), hence by bin
    bits = np.zeros(texts * BINS, np.uint8)
    bits[cell[first]] = (mix(h[first]) >> U(40)) & U(1)
    return np.packbits(bits.reshape(texts, BINS), axis=1).view(U)


def shingle_arrays(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``(key, shingles array<bigint>)`` with the distinct shingle hashes of each text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in slices([len(t) for t in texts]):
                h, owner, _ = distinct_shingles(Words(texts[part]), width)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=part.stop - part.start))])
                arrays = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed(h)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), arrays], names=["key", "shingles"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null").mapInArrow(run, f"key {kind}, shingles array<bigint>")


def bits_off(total: np.ndarray, threshold: float) -> np.ndarray:
    """Bits in which the sketches of two texts may differ, given their shingles together.

    At the threshold (1 - t) / (1 + t) of all shingles are unshared, and each flips
    its bin's bit with half a chance; full bins differ in (1 - t) / 2 of the bits.
    """
    few = total * ((1 - threshold) / (1 + threshold) / 2)
    full = BINS * (1 - threshold) / 2
    return np.minimum(few + DEVIATIONS * np.sqrt(few / 2) + 1, full + DEVIATIONS * np.sqrt(full * (1 + threshold) / 2))


def near(a: str, b: str, threshold: float):
    """The same bound on the sketches as ``bits_off``, JVM-side."""
    off = sum((F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in SKETCH), F.lit(0))
    few = (F.col(f"{a}.n") + F.col(f"{b}.n")) * ((1 - threshold) / (1 + threshold) / 2)
    full = BINS * (1 - threshold) / 2
    return off <= F.least(few + DEVIATIONS * F.sqrt(few / 2) + 1, F.lit(full + DEVIATIONS * (full * (1 + threshold) / 2) ** 0.5))


def one_body_each(rows: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """``(tid, text)`` of the texts in ``wanted(tid)``, each from the smallest id that has it.

    ``rows`` has ``id, tid`` and the text.  Texts are joined by the record's id,
    never by ``tid``, so a text copied to a third of the table is no hot key and
    its copies are not gathered.
    """
    first = rows.select("id", "tid").groupBy("tid").agg(F.min("id").alias("id")).join(wanted, "tid", "left_semi")
    found = rows.select("id", F.col("tid").alias("own"), text).join(first, "id").where("own = tid")
    return found.select("tid", F.col(text).alias("text")).dropDuplicates(["tid"])


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)
