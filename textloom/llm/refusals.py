"""Refusal templates among sentences, by verified MinHash clusters.

Sentences are masked (names and numbers become ``x``) and clustered: sentences
that agree in a band of minimum hashes meet the most frequent one of the band,
their leader, and the exact similarity with the leader decides.  What tells a
refusal from any other stock phrase is not its wording but its use: it stands
under unrelated prompts and nothing of the answer's own follows it.  The evidence
for that is a likelihood ratio against the share of all sentences that end their
answer.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.language import _CODE_SIGN, _IDENTIFIER, CODE_LINE
from textloom.llm.sketch import jaccard
from textloom.llm.textcore import U, Words, mix, signed
from textloom.session import materialize

SENTENCES = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])|\n+")
#: (rows, bands): bands of two hashes bring variants together, bands of four keep apart what two put together by chance
BANDS = ((2, 8), (4, 4))
SIMILARITY = 0.5  # of two sentences of a cluster, over their words and pairs of words
MIN_PROMPTS = 3  # different masked prompts under which a template recurs
ODDS = math.log(100)  # evidence at which a cluster is decided either way
ENDS = 0.97  # share of a refusal template's occurrences that nothing follows
MIN_WORDS, MIN_UNSPACED = 4, 5  # less is a value, no sentence; one of the words may be a single letter

_NUMBER = re.compile(r"\b\d[\d.]*\b")
_TOKEN = re.compile(r"[^\W_]+")
#: scripts written without blanks: Thai, Lao, Burmese, Khmer, kana and Han
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
_UNSPACED_TOKEN = re.compile(rf"x|{_UNSPACED.pattern}")
_LATIN = re.compile(r"[a-z]+")


def sentences_of(text: str) -> list[str]:
    return [s for s in SENTENCES.split(text.strip()) if s.strip()]


def masked(sentence: str) -> str | None:
    """Words of a sentence with names and numbers as ``x``; None for code and for what is too short to be a sentence."""
    if _CODE_SIGN.search(sentence) and CODE_LINE.match(sentence):
        return None
    text = _NUMBER.sub(" x ", _IDENTIFIER.sub(" x ", sentence)).lower().replace("’", "'")
    if _UNSPACED.search(text):
        words = _UNSPACED_TOKEN.findall(_LATIN.sub("x", text))
        return " ".join(words) if sum(w != "x" for w in words) >= MIN_UNSPACED else None
    words = _TOKEN.findall(text)
    return " ".join(words) if sum(w != "x" for w in words) >= MIN_WORDS and sum(len(w) > 1 for w in words) >= MIN_WORDS - 1 else None


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, shingles, keys): distinct words and pairs of words of a masked sentence, and its band keys."""
    hashes = sum(rows * bands for rows, bands in BANDS)
    seeds = mix(np.arange(1, hashes + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    for batch in batches:
        words = Words(batch.column(1).to_pylist())
        pair, where = words.shingles(2)
        flat, text = np.concatenate([mix(words.hash), pair]), np.concatenate([words.text, words.text[where]])
        order = np.lexsort((flat, text))
        flat, text = flat[order], text[order]
        new = np.ones(len(flat), bool)
        new[1:] = (flat[1:] != flat[:-1]) | (text[1:] != text[:-1])
        flat, text = flat[new], text[new]
        size = np.bincount(text, minlength=len(batch))
        start = np.cumsum(size) - size  # every masked sentence has words
        low = np.stack([np.minimum.reduceat(mix(flat ^ s), start) for s in seeds], axis=1) if len(flat) else np.zeros((0, hashes), U)
        keys, at = [], 0
        for rows, bands in BANDS:
            for _ in range(bands):
                key = np.full(len(batch), at, U)
                for j in range(at, at + rows):
                    key = mix(key ^ low[:, j]) if len(low) else key
                keys.append(key)
                at += rows
        offsets = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        shingles = pa.ListArray.from_arrays(offsets(size), pa.array(signed(flat)))
        bands = pa.ListArray.from_arrays(offsets(np.full(len(batch), len(keys))), pa.array(signed(np.stack(keys, axis=1).ravel())))
        yield pa.RecordBatch.from_arrays([batch.column(0), shingles, bands], names=["sid", "shingles", "keys"])


def sentence_id(sentence: Column) -> Column:
    return F.xxhash64(sentence)


def _prompts(bits: str) -> Column:
    """At least so many prompts: each sets one of 64 bits."""
    return F.bit_count(F.bit_or(bits))


def _evidence(uses: DataFrame, sets: DataFrame, *, min_prompts: int) -> DataFrame:
    """``(sid, evidence)`` of sentences of ``uses(sid, n, ends, bits, cue)`` that may be refusals, in their clusters.

    Every sentence counts in the cluster of its most supported leader.  A
    sentence is of interest if it reads like a refusal, or if one of its bands,
    before its sentences are compared, has half the evidence needed; then it is
    judged by all of its bands.
    """
    total = uses.agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).first()
    share = min(0.5, max(0.01, (total["ends"] or 0) / max(1, total["n"] or 0)))  # refusals are taken to be no majority
    evidence = lambda n, ends: ends * math.log(ENDS / share) + (n - ends) * math.log((1 - ENDS) / (1 - share))
    rows = uses.join(sets.select("sid", "keys"), "sid").select("sid", "n", "ends", "bits", "cue", F.explode("keys").alias("key"))
    bands = rows.groupBy("key").agg(F.max(F.struct("n", "sid")).alias("m"), F.sum("ends").alias("ends"), F.sum("n").alias("n"), _prompts("bits").alias("prompts"), F.bool_or("cue").alias("cue"))
    bands = materialize(bands.where(F.col("prompts") >= min_prompts).select("key", F.col("m.sid").alias("leader"), (evidence(F.col("n"), F.col("ends")) >= ODDS / 2).alias("ending"), "cue"), "bands")
    wanted = bands.where("ending or cue").select("key", "ending")
    asked = rows.select("key", "sid", F.col("cue").alias("own")).join(wanted, "key").where("ending or own").select("sid").distinct()
    keys = sets.select("sid", F.explode("keys").alias("key")).join(asked, "sid", "left_semi").select("key").distinct()
    leaders = bands.select("key", "leader").join(keys, "key", "left_semi")
    pairs = rows.select("key", "sid").join(leaders, "key").select("sid", "leader").distinct()
    own = sets.select("sid", F.col("shingles").alias("a"))
    lead = sets.select(F.col("sid").alias("leader"), F.col("shingles").alias("b"))
    alike = pairs.join(own, "sid").join(lead, "leader").where(jaccard(F.col("a"), F.col("b")) >= SIMILARITY).select("sid", "leader")
    alike = materialize(alike.join(uses, "sid"), "alike")
    clusters = alike.groupBy("leader").agg(F.sum("n").alias("size"), F.sum("ends").alias("ends"), _prompts("bits").alias("prompts")).where(F.col("prompts") >= min_prompts)
    clusters = clusters.select("leader", "size", evidence(F.col("size"), F.col("ends")).alias("evidence"))
    return alike.select("sid", "leader").join(clusters, "leader").groupBy("sid").agg(F.max(F.struct("size", "evidence")).alias("m")).select("sid", "m.evidence")


def refusal_sentences(answers: DataFrame, *, min_prompts: int = MIN_PROMPTS) -> tuple[DataFrame, DataFrame]:
    """What the sentences of answers are: ``(closers(sid), openings(sid, refuses))``.

    ``answers`` has ``first`` (the masked first sentence), ``second`` (the masked
    rest, if it is one sentence), ``sentences`` (the number of different ones),
    ``prompt`` (identity of the masked prompt) and ``cue`` (the answer reads like
    a refusal).  Closers recur under ``min_prompts`` prompts or more and end
    their answers.  Openings are decided: ``refuses`` is true if nothing but
    closers follows them, false if as much follows as after other openings;
    others have too few prompts to be decided and are left out.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("prompt", F.lit(64)).cast("int"))
    first = answers.where("first is not null").select(F.col("first").alias("s"), bit.alias("bit"), (F.col("sentences") == 1).alias("ends"), "cue", F.lit(True).alias("opens"))
    second = answers.where("second is not null").select(F.col("second").alias("s"), bit.alias("bit"), F.lit(True).alias("ends"), F.lit(False).alias("cue"), F.lit(False).alias("opens"))
    uses = first.union(second).groupBy("s").agg(F.count("*").alias("n"), F.count_if("ends").alias("ends"), F.bit_or("bit").alias("bits"), F.bool_or("cue").alias("cue"))
    uses = materialize(uses.withColumn("sid", sentence_id(F.col("s"))), "sentences")
    sets = materialize(uses.select("sid", "s").dropDuplicates(["sid"]).mapInArrow(_keys, "sid bigint, shingles array<bigint>, keys array<bigint>"), "shingles")
    closers = materialize(_evidence(uses.drop("s"), sets, min_prompts=min_prompts).where(F.col("evidence") >= ODDS).select("sid"), "closers")
    after = answers.where("first is not null").withColumn("next", sentence_id(F.col("second")))
    after = after.join(closers.select(F.col("sid").alias("next"), F.lit(True).alias("closes")), "next", "left")
    opened = after.groupBy(sentence_id(F.col("first")).alias("sid")).agg(
        F.count("*").alias("n"), F.count_if((F.col("sentences") == 1) | F.col("second").isNotNull() & F.coalesce("closes", F.lit(False))).alias("ends"), F.bit_or(bit).alias("bits"), F.bool_or("cue").alias("cue")
    )
    openings = _evidence(materialize(opened, "openings"), sets, min_prompts=min_prompts)
    return closers, openings.where(F.abs("evidence") >= ODDS).select("sid", (F.col("evidence") > 0).alias("refuses"))
