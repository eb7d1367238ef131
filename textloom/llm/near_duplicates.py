"""Near-duplicate records with small edits, by Golay-code fuzzy hashing.

A record's fingerprint is a set of 23-bit segments.  Each segment describes one
passage: an anchor of five words, chosen by minimum hash, and four words on each
side.  Small edits, insertions and moved sentences leave most passages untouched
or a bit or two off, and since the errors of a pair spread over all segments,
some segments have few (pigeonhole).  A segment is decoded to nearby Golay
codewords; (anchor, codeword index) are its keys.  Records that share a key are
candidates, and the exact similarity of their word shingles decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import golay
from textloom.llm.components import connected_components
from textloom.llm.sketch import SKETCH, bit_sketch, bits_off, distinct_shingles, jaccard, near, one_body_each, shingle_arrays, text_key
from textloom.llm.textcore import U, Words, mix, signed, slices
from textloom.session import discard, materialize, spread

ANCHOR_WORDS = 5
CONTEXT_WORDS = 4
HOT = 1_000  # an anchor in more passages is hot: see near_duplicate_links
GROUP = 64  # keys of hot anchors met by more records are paired in blocks
BLOCK = 1_000  # records of each side in a block


def passages(words: Words, anchors: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, text, 23-bit segment) of up to ``anchors`` passages of each text."""
    h, text, where = distinct_shingles(words, ANCHOR_WORDS)
    begin = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(words.count)))])
    keep = np.arange(len(h)) - begin[text] < anchors
    h, text, where = h[keep], text[keep], where[keep]
    votes = ((mix(words.hash ^ U(77))[:, None] >> np.arange(golay.BITS, dtype=U)) & U(1)).astype(np.int8) * 2 - 1
    total = np.zeros((len(votes) + 1, golay.BITS), np.int32)
    np.cumsum(votes, axis=0, out=total[1:])
    low = np.maximum(where - CONTEXT_WORDS, words.first[text])
    high = np.minimum(where + ANCHOR_WORDS + CONTEXT_WORDS, words.first[text + 1])
    segment = ((total[high] - total[low]) > 0) @ (1 << np.arange(golay.BITS, dtype=np.int64))
    return h, text, segment


def _fingerprints(min_words: int, shingle_words: int, anchors: int):
    """Rows (tid, value, segment): one per passage, and with segment -1 to -5 the four words of the sketch and the number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unique = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))  # copies in a batch count once
            keys, texts = np.fromiter(unique, np.int64, len(unique)), list(unique.values())
            for part in slices([len(t) for t in texts]):
                words = Words(texts[part])
                use = words.count >= max(min_words, shingle_words)
                own = keys[part]
                h, text, segment = passages(words, anchors)
                keep = use[text]
                s, owner, _ = distinct_shingles(words, shingle_words)
                bits = bit_sketch(s, owner, len(own))
                size = np.bincount(owner, minlength=len(own)).astype(U)
                tid = np.concatenate([own[text[keep]], np.tile(own[use], 5)])
                value = np.concatenate([h[keep], *bits[use].T, size[use]])
                kind = np.concatenate([segment[keep], np.repeat([-1, -2, -3, -4, -5], use.sum())])
                yield pa.RecordBatch.from_arrays([pa.array(tid), pa.array(signed(value)), pa.array(kind, pa.int32())], names=["tid", "value", "segment"])

    return run


def _hashed(value: np.ndarray, index: np.ndarray) -> np.ndarray:
    return mix(value.view(U) ^ ((index.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)))


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, tid, sketch, n) for every fuzzy key of every (value, segment)."""
    for batch in batches:
        value, segment = (np.asarray(batch.column(i)) for i in (0, 1))
        row, index = golay.fuzzy_keys(segment)
        rest = [batch.column(i).take(pa.array(row)) for i in range(2, 8)]
        yield pa.RecordBatch.from_arrays([pa.array(signed(_hashed(value[row], index))), *rest], names=["key", "tid", *SKETCH, "n"])


def _pairs_of_anchors(threshold: float):
    """Pairs of texts that share a fuzzy key of an anchor; a group holds all passages of one anchor, ``HOT`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(1)
            lengths, flat = np.diff(groups.offsets.to_numpy()), groups.flatten()
            tid, segment, *bits, n = (flat.field(i).to_numpy() for i in range(7))
            value = np.repeat(batch.column(0).to_numpy(), lengths)
            row, index = golay.fuzzy_keys(segment)
            key = _hashed(value[row], index)
            order = np.lexsort((tid[row], key))
            key, row = key[order], row[order]
            start = np.nonzero(np.append(True, key[1:] != key[:-1]))[0]
            size = np.diff(np.append(start, len(key)))
            # every row is paired with the later rows of its key, about a million pairs at a time
            later = np.repeat(start + size, size) - np.arange(len(key)) - 1
            upto = np.cumsum(later)
            cuts = np.unique(np.append(np.searchsorted(upto, np.arange(0, upto[-1] + 1, 1_000_000)), len(key))) if len(key) else np.zeros(1, np.int64)
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                many = later[low:high]
                first = np.repeat(np.arange(low, high), many)
                second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(many) - many, many)
                a, b = row[first], row[second]
                off = sum(np.bitwise_count((w[a] ^ w[b]).view(U)).astype(np.int16) for w in bits)
                keep = (tid[a] != tid[b]) & (off <= bits_off(n[a] + n[b], threshold)) & (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]))
                pair = np.unique(np.stack([np.minimum(tid[a[keep]], tid[b[keep]]), np.maximum(tid[a[keep]], tid[b[keep]])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    return run


_KEYED = f"key bigint, tid bigint, {', '.join(f'{w} bigint' for w in SKETCH)}, n bigint"


def _with_counts(rows: DataFrame) -> DataFrame:
    """Rows whose key occurs more than once, with the count; the count is combined map-side and AQE splits hot keys in the join."""
    counts = rows.groupBy("key").count().where("count > 1")
    return rows.join(counts, "key")


def _pairs_of_small_groups(rows: DataFrame, threshold: float) -> DataFrame:
    """All pairs of groups that were counted to hold at most ``GROUP`` rows."""
    groups = rows.groupBy("key").agg(F.collect_set(F.struct("tid", *SKETCH, "n")).alias("g")).where("size(g) > 1")
    pairs = groups.select("g", F.explode("g").alias("a")).select("a", F.explode("g").alias("b")).where("a.tid < b.tid")
    return pairs.where(near("a", "b", threshold)).select(F.col("a.tid").alias("a"), F.col("b.tid").alias("b"))


def _pairs_in_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """All pairs of groups of any size: every two blocks of a group meet once, and sketch and sizes are compared inside the join."""
    rows = rows.withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).withColumn("own", F.pmod("tid", "blocks").cast("int")).withColumn("r", F.struct("tid", *SKETCH, "n"))
    left = rows.select("key", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), F.col("r").alias("a"))
    right = rows.select("key", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), F.col("r").alias("b"))
    once = (F.col("i") < F.col("j")) | (F.col("a.tid") < F.col("b.tid"))
    fits = F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n")
    return left.join(right, ["key", "i", "j"]).where(once & fits & near("a", "b", threshold)).select(F.least("a.tid", "b.tid").alias("a"), F.greatest("a.tid", "b.tid").alias("b"))


def _pairs_of_hot_anchors(met: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs of all texts with a hot anchor, by the keys of those anchors."""
    rows = met.where("hot").dropDuplicates(["value", "tid"]).select("value", "segment", "tid", *SKETCH, "n")
    keyed = materialize(_with_counts(rows.mapInArrow(_explode_keys, _KEYED)), "keys")
    small = F.col("count") <= GROUP
    return _pairs_of_small_groups(keyed.where(small), threshold).union(_pairs_in_blocks(keyed.where(~small), threshold))


def near_duplicate_links(rows: DataFrame, *, threshold: float = 0.8, min_words: int = 5, shingle_words: int = 5, anchors: int = 20) -> tuple[DataFrame, DataFrame]:
    """Verified links between different texts, and the texts that took part.

    ``rows(id, tid, text)`` has one or more rows per ``tid``, the 64-bit identity
    of its text (``text_key``).  Returns ``(links(a, b, similarity), taking_part(tid))``,
    a < b.  Texts that are null or shorter than ``min_words`` words take no part.
    An anchor in more than ``HOT`` passages is hot.  Hot anchors serve every text
    that has one.  Their keys are counted; the texts of one
    met by more than ``GROUP`` are paired in blocks of ``BLOCK``, so that no task
    holds all of them.
    """
    prints = materialize(spread(rows.select("tid", "text").where("text is not null")).mapInArrow(_fingerprints(min_words, shingle_words, anchors), "tid bigint, value bigint, segment int"), "golay")
    sketches = prints.where("segment < 0").groupBy("tid").agg(*(F.max(F.when(F.col("segment") == k, F.col("value"))).alias(n) for k, n in zip(range(-1, -6, -1), (*SKETCH, "n"))))
    found = prints.where("segment >= 0")
    shared = found.groupBy("value").count().where("count > 1").select("value", (F.col("count") > HOT).alias("hot"))  # copies may count more than once
    met = materialize(found.join(shared, "value").join(sketches, "tid").select("value", "segment", "tid", *SKETCH, "n", "hot"), "met")
    groups = met.where("not hot").groupBy("value").agg(F.collect_set(F.struct("tid", "segment", *SKETCH, "n")).alias("passages"))
    pairs = groups.where("size(passages) > 1").mapInArrow(_pairs_of_anchors(threshold), "a bigint, b bigint")
    if met.where("hot").limit(1).count():
        pairs = pairs.union(_pairs_of_hot_anchors(met, threshold))
    pairs = materialize(pairs.distinct(), "pairs")
    discard(met)
    wanted = pairs.select(F.col("a").alias("tid")).union(pairs.select("b")).distinct()
    sets = materialize(shingle_arrays(one_body_each(rows, wanted, "text"), "tid", "text", shingle_words), "sets")
    left, right = (sets.select(F.col("key").alias(n), F.col("shingles").alias(f"s{n}")) for n in "ab")
    links = pairs.join(left, "a").join(right, "b").select("a", "b", jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)
    return links, prints.where("segment = -5").select("tid").distinct()


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, *, threshold: float = 0.8, min_words: int = 5, shingle_words: int = 5, anchors: int = 20) -> DataFrame:
    """Class of every record: ``(id, tid, group_id, links)``.

    ``id`` is the record, ``tid`` the identity of its text (exact copies share
    it), ``group_id`` the smallest ``tid`` reachable through verified links, and
    ``links`` the number of different texts at least ``threshold`` similar to it.
    Records with a null id or text, or too few words, are in no class and left
    out.  Repeated rows of a record count once.  Extra columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    rows = rows.withColumn("tid", text_key(F.col("text")))
    links, part = near_duplicate_links(rows, threshold=threshold, min_words=min_words, shingle_words=shingle_words, anchors=anchors)
    links = materialize(links, "links")
    classes = connected_components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("tid")).groupBy("tid").agg(F.count("*").alias("links"))
    return (
        rows.select("id", "tid")
        .distinct()
        .join(part, "tid", "left_semi")
        .join(classes, F.col("tid") == classes.node, "left")
        .join(degree, "tid", "left")
        .select("id", "tid", F.coalesce("component", "tid").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )


def group_pairs(groups: DataFrame) -> DataFrame:
    """All pairs ``(record_a, record_b)`` of each class of more than one record, smaller key first."""
    g = groups.select("id", "group_id")
    a, b = g.select("group_id", F.col("id").alias("record_a")), g.select("group_id", F.col("id").alias("record_b"))
    return a.join(b, "group_id").where("record_a < record_b").select("record_a", "record_b")
