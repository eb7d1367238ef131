"""Same or near-same records across splits, by winnowing fingerprints.

Every run of ``SEED_WORDS`` words is hashed and the minima of each window of
``WINDOW`` neighbouring hashes are kept as seeds, so two records that share a run
of SEED_WORDS + WINDOW - 1 words share a seed.  Seeds are joined between training
and evaluation records; the pairs are verified by the exact shingle similarity,
and for verified pairs collinear seeds are chained and extended by alignment.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import strip
from textloom.llm.sketch import SKETCH, bit_sketch, distinct_shingles, near, one_body_each, text_key
from textloom.llm.textcore import Words, signed, slices, window_minima
from textloom.session import materialize

SEED_WORDS = 6
WINDOW = 3
HOT_PAIRS = 20_000  # a seed that makes more pairs is joined in blocks
BLOCK = 1_000  # records of each side in a block of a hot seed


def winnow(words: Words, seed_words: int = SEED_WORDS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word position) of the selected seeds of a batch, text by text."""
    h, where = words.shingles(seed_words)
    if not len(h):
        return h, where
    text = words.text[where]
    cut = np.nonzero(np.diff(text))[0] + 1
    bounds = np.concatenate([[0], cut, [len(h)]])
    picked = np.concatenate([s + window_minima(h[s:e], window) for s, e in zip(bounds[:-1], bounds[1:])])
    return h[picked], where[picked]


def split_members(samples: DataFrame, configs: DataFrame) -> DataFrame:
    """``(sample_id, dataset_name, side, source, content)`` of the samples that are in a split.

    ``side`` is train, val or test, found by the sample's own dataset; split names
    compare without regard to case and outer blanks.  A sample delivered again
    counts once.  Samples without id, dataset, known split or content are left out.
    """
    sides = configs.select(
        F.col("dataset_name").alias("d"),
        F.explode(F.array(*(F.struct(F.lower(strip(F.col(f"{side}_split"))).alias("name"), F.lit(side).alias("side")) for side in ("train", "val", "test")))).alias("s"),
    ).select("d", "s.name", "s.side")
    own = samples.select("sample_id", "dataset_name", F.lower(strip(F.col("split_name"))).alias("split"), "source", "content").where("sample_id is not null and content is not null")
    return own.join(sides, (own.dataset_name == sides.d) & (own.split == sides.name)).select("sample_id", "dataset_name", "side", "source", "content")


def _seeds(min_words: int, shingle_words: int):
    """(seed, tid, train, kind): kind 0 for the distinct selected seeds of a text, -1 to -5 for its sketch and number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(k, t): text for k, t, text in zip(*(batch.column(i).to_pylist() for i in range(3)))}
            texts = list(rows.values())
            tids, trains = np.fromiter((k for k, _ in rows), np.int64, len(rows)), np.fromiter((t for _, t in rows), bool, len(rows))
            for part in slices([len(t) for t in texts]):
                words, tid, train = Words(texts[part]), tids[part], trains[part]
                use = words.count >= min_words
                h, where = winnow(words)
                text = words.text[where]
                keep = use[text]
                seed = np.unique(np.stack([text[keep], signed(h[keep])]), axis=1)
                s, owner, _ = distinct_shingles(words, shingle_words)
                facts = [*bit_sketch(s, owner, len(tid)).T, np.bincount(owner, minlength=len(tid)).astype(np.uint64)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([seed[1], *(signed(np.ascontiguousarray(f[use])) for f in facts)])), pa.array(np.concatenate([tid[seed[0]], np.tile(tid[use], 5)])),
                        pa.array(np.concatenate([train[seed[0]], np.tile(train[use], 5)])), pa.array(np.concatenate([np.zeros(seed.shape[1]), np.repeat([-1, -2, -3, -4, -5], use.sum())]).astype(np.int32)),
                    ],
                    names=["seed", "tid", "train", "kind"],
                )

    return run


def align(a: np.ndarray, b: np.ndarray, seeds_a: tuple[np.ndarray, np.ndarray], seeds_b: tuple[np.ndarray, np.ndarray], seed_words: int = SEED_WORDS) -> tuple[int, int]:
    """(words covered, chained seeds) of two word-hash arrays with their winnowed seeds (hash, word position).

    The longest chain of shared seeds that ascend in both texts is found by
    patience sorting, and every seed of it is extended while words agree.
    """
    second: dict[int, list[int]] = {}
    for h, j in zip(*(x.tolist() for x in seeds_b)):
        second.setdefault(h, []).append(j)
    # places of one seed descend, so that a chain takes one of them at most
    hits = [(i, j) for h, i in zip(*(x.tolist() for x in seeds_a)) for j in reversed(second.get(h, ()))]
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(hits):
        k = bisect_left(tails, j)
        tails[k : k + 1] = [j]
        at[k : k + 1] = [n]
        back.append(at[k - 1] if k else -1)
    chain, n = [], at[-1] if at else -1
    while n >= 0:
        chain.append(hits[n])
        n = back[n]
    covered, reach, other = 0, 0, 0
    for i, j in reversed(chain):
        end, far = i + seed_words, j + seed_words
        if end <= reach:
            continue
        while i > reach and j > other and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        while end < len(a) and far < len(b) and a[end] == b[far]:
            end, far = end + 1, far + 1
        covered += end - max(i, reach)
        reach, other = end, far
    return covered, len(chain)


_ALIGNED = "train_tid bigint, eval_tid bigint, similarity double, coverage_train double, coverage_eval double, chained_seeds bigint"


def _aligned(threshold: float, shingle_words: int):
    """Chain and extend the seeds of each candidate pair; of those with a chain, keep the similar ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.asarray(batch.column(i)) for i in (0, 1)]
            first, second = (batch.column(i).to_pylist() for i in (2, 3))
            for part in slices([len(x) + len(y) for x, y in zip(first, second)]):
                both = [t for pair in zip(first[part], second[part]) for t in pair]
                words = Words(both)
                seed, place = winnow(words)
                seed_at = np.searchsorted(words.text[place], np.arange(len(both) + 1))
                grams, owner, _ = distinct_shingles(words, shingle_words)
                gram_at = np.searchsorted(owner, np.arange(len(both) + 1))
                out: list[tuple] = []
                for k in range(0, len(both), 2):
                    own = [slice(words.first[t], words.first[t + 1]) for t in (k, k + 1)]
                    seeds = [(seed[seed_at[t] : seed_at[t + 1]], place[seed_at[t] : seed_at[t + 1]] - words.first[t]) for t in (k, k + 1)]
                    covered, chained = align(*(words.hash[o] for o in own), *seeds)
                    sets = [grams[gram_at[t] : gram_at[t + 1]] for t in (k, k + 1)]
                    shared = len(np.intersect1d(*sets, assume_unique=True))
                    alike = shared / max(1, len(sets[0]) + len(sets[1]) - shared)
                    if chained and alike >= threshold:
                        out.append((part.start + k // 2, alike, *(covered / (o.stop - o.start) for o in own), chained))
                row, *rest = zip(*out) if out else ((),) * 5
                row = np.array(row, np.int64)
                types = (pa.float64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(i[row]) for i in ids), *(pa.array(c, t) for c, t in zip(rest, types))], names=[c.split()[0] for c in _ALIGNED.split(", ")])

    return run


def overlapping_texts(members: DataFrame, *, threshold: float = 0.8, min_words: int = 5, shingle_words: int = 5) -> DataFrame:
    """Pairs of texts across the two sides of ``members(sample_id, tid, train, content)`` that overlap.

    Returns ``(train_tid, eval_tid, similarity, coverage_train, coverage_eval,
    chained_seeds)``.  Pairs that share a winnowed seed are candidates; sketch and
    sizes rule out most, the seeds of the others are chained and extended, and the
    exact similarity decides.  A copy on both sides pairs with itself.  A seed
    that makes over ``HOT_PAIRS`` pairs is joined in blocks of ``BLOCK`` records
    of each side, so that no task holds all of its pairs; sketch and sizes are
    compared inside the join.
    """
    least = max(min_words, SEED_WORDS, shingle_words)
    made = materialize(members.select("tid", "train", "content").mapInArrow(_seeds(least, shingle_words), "seed bigint, tid bigint, train boolean, kind int"), "winnow")
    facts = made.where("kind < 0").groupBy("tid", "train").agg(*(F.max(F.when(F.col("kind") == k, F.col("seed"))).alias(n) for k, n in zip(range(-1, -6, -1), (*SKETCH, "n"))))
    seeds = made.where("kind = 0").select("seed", "tid", "train").distinct()
    size = seeds.groupBy("seed").agg(F.count_if("train").alias("nt"), F.count_if(~F.col("train")).alias("ne")).where("nt > 0 and ne > 0")
    blocks = lambda n: F.when(F.col("nt") * F.col("ne") > HOT_PAIRS, F.ceil(F.col(n) / BLOCK)).otherwise(F.lit(1)).cast("int")
    size = size.select("seed", blocks("nt").alias("bt"), blocks("ne").alias("be"))
    useful = materialize(seeds.join(size, "seed"), "winnow").join(facts, ["tid", "train"]).select("seed", "train", "bt", "be", F.struct("tid", *SKETCH, "n").alias("r"))
    own = lambda n: F.pmod(F.col("r.tid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = useful.where("train").select("seed", own("bt").alias("i"), every("be").alias("j"), F.col("r").alias("a"))
    right = useful.where("not train").select("seed", every("bt").alias("i"), own("be").alias("j"), F.col("r").alias("b"))
    fits = F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n")
    pairs = left.join(right, ["seed", "i", "j"]).where(near("a", "b", threshold) & fits).select(F.col("a.tid").alias("train_tid"), F.col("b.tid").alias("eval_tid")).distinct()
    pairs = materialize(pairs, "pairs")
    wanted = pairs.select(F.col("train_tid").alias("tid")).union(pairs.select("eval_tid")).distinct()
    bodies = one_body_each(members.withColumnRenamed("sample_id", "id"), wanted, "content")
    bodies = materialize(bodies, "bodies")
    first, second = (bodies.select(F.col("tid").alias(f"{n}_tid"), F.col("text").alias(f"text_{s}")) for n, s in (("train", "a"), ("eval", "b")))
    both = pairs.join(first, "train_tid").join(second, "eval_tid").select("train_tid", "eval_tid", "text_a", "text_b")
    return both.mapInArrow(_aligned(threshold, shingle_words), _ALIGNED)


def split_overlaps(samples: DataFrame, configs: DataFrame, *, threshold: float = 0.8, min_words: int = 5, shingle_words: int = 5) -> DataFrame:
    """One row per training and evaluation sample that overlap.

    Columns: ``sample_train, sample_eval, side, dataset_train, dataset_eval,
    source_train, source_eval, similarity, coverage_train, coverage_eval,
    chained_seeds``: coverage is the share of the record's words that the chained
    and extended seeds cover.  See ``split_members`` for
    what takes part; records below ``min_words`` words do not.  An empty table
    gives an empty result.
    """
    members = materialize(
        split_members(samples, configs).withColumn("tid", text_key(F.col("content"))).withColumn("train", F.col("side") == "train"), "members"
    )
    found = overlapping_texts(members, threshold=threshold, min_words=min_words, shingle_words=shingle_words)
    who = members.select("sample_id", "dataset_name", "side", "source", "tid", "train").distinct()
    a = who.where("train").select(F.col("tid").alias("train_tid"), F.col("sample_id").alias("sample_train"), F.col("dataset_name").alias("dataset_train"), F.col("source").alias("source_train"))
    b = who.where("not train").select(F.col("tid").alias("eval_tid"), F.col("sample_id").alias("sample_eval"), "side", F.col("dataset_name").alias("dataset_eval"), F.col("source").alias("source_eval"))
    return found.join(a, "train_tid").join(b, "eval_tid").where("sample_train <> sample_eval").drop("train_tid", "eval_tid")
