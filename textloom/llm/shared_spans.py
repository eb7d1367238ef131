"""Long exact spans shared between records, by Rabin-Karp window hashes.

The tokens are characters.  Every window of ``SEED`` characters is hashed; of
these only the minima of each run that fits into a span of the wanted length are
counted, which loses nothing: two records that share a span share its minimum.
Every window of the full length whose smallest seed occurs in more than one text is
hashed and counted, and repeated windows are merged into maximal intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.sketch import text_key
from textloom.llm.textcore import U, Chars, _sliding, signed, slices, window_minima
from textloom.session import materialize, spread

SEED = 100
HOT = 1_000  # windows whose smallest seed has more places are counted by map-side combined aggregation


def _seeds(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unique = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            keys, texts = np.fromiter(unique, np.int64, len(unique)), list(unique.values())
            for part in slices([len(t) for t in texts]):
                chars = Chars(texts[part])
                width = min(SEED, length)
                h = chars.window_hashes(width)
                begin, count = chars.start[:-1], chars.length - width + 1
                # windows across text ends are never minima of a text: minima are taken text by text
                picked = [b + window_minima(h[b : b + c], length - width + 1) for b, c in zip(begin.tolist(), count.tolist()) if c > 0]
                at = np.concatenate(picked) if picked else np.zeros(0, np.int64)
                owner = np.searchsorted(chars.start, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(h[at])), pa.array(keys[part][owner]), pa.array((at - chars.start[owner]).astype(np.int32))], names=["seed", "tid", "at"]
                )

    return run


def _windows(length: int):
    """(hash, check, tid, at, hot) of every full window whose smallest seed is repeated.

    ``check`` holds 32 bits of a second, independent hash: with 96 bits, a false
    match is not expected among 10**12 windows.

    The smallest seed depends on the window's characters alone and every text
    with the window selects it, so a window is hot in all of its texts or in none.
    """
    width = min(SEED, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tids, texts, places = np.asarray(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for part in slices([len(t) for t in texts]):
                chars = Chars(texts[part])
                h, seed = chars.window_hashes(length), chars.window_hashes(width)
                second = (Chars(texts[part], salt=1).window_hashes(length) >> U(32)).astype(np.uint32).view(np.int32)
                out = []
                for i in range(part.stop - part.start):
                    own = seed[chars.start[i] : chars.start[i + 1] - width + 1]
                    low = _sliding(own, length - width + 1, np.minimum)
                    repeated = own[[p["at"] for p in places[part.start + i]]]
                    hot = own[[p["at"] for p in places[part.start + i] if p["hot"]] or slice(0)]
                    at = np.nonzero(np.isin(low, repeated))[0]
                    out.append((h[chars.start[i] + at], second[chars.start[i] + at], np.full(len(at), tids[part.start + i]), at.astype(np.int32), np.isin(low[at], hot)))
                hashes, *rest = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(signed(hashes)), *map(pa.array, rest)], names=["hash", "check", "tid", "at", "hot"])

    return run


def _merge(length: int):
    """Sorted window starts of a text to its maximal intervals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, ends, starts = [0], [], []
            for places in batch.column(1):
                at = np.unique(places.values.to_numpy())
                cut = np.nonzero(np.diff(at) > length)[0]
                starts.append(at[np.concatenate([[0], cut + 1])])
                ends.append(at[np.concatenate([cut, [len(at) - 1]])] + length)
                offsets.append(offsets[-1] + len(starts[-1]))
            flat = [pa.array(np.concatenate(x).astype(np.int64)) if x else pa.array([], pa.int64()) for x in (starts, ends)]
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(flat, names=["begin", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], names=["tid", "spans"])

    return run


def shared_spans(df: DataFrame, id_col: str, text_col: str, *, length: int = 300) -> DataFrame:
    """Records with a span of at least ``length`` characters that stands verbatim in another record.

    Returns ``(id, n_chars, spans array<struct<begin,end>>, shared_chars)``: the
    maximal intervals covered by such spans, as character offsets of the stored
    text, and how many characters they cover.  A text with copies is shared as a
    whole.  Records with a null id or text or a shorter text have no row; a record
    delivered again is the same record; a repetition inside one record does not
    count.  Extra columns are ignored and an empty table gives an empty result.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") >= length).where("id is not null")
    docs = docs.withColumn("tid", text_key(F.col("text")))
    members = docs.select("id", "tid", F.length("text").alias("n_chars")).distinct()
    classes = materialize(members.groupBy("tid").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    seeds = materialize(spread(docs.select("tid", "text")).mapInArrow(_seeds(length), "seed bigint, tid bigint, at int"), "seeds")
    repeated = seeds.groupBy("seed").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi"), (F.count("*") > HOT).alias("hot")).where("lo < hi")
    places = seeds.join(repeated.select("seed", "hot"), "seed").groupBy("tid").agg(F.collect_set(F.struct("at", "hot")).alias("places"))
    near = classes.join(places, "tid").select(F.col("rep").alias("id"), F.col("tid").alias("rep_tid"), "places")
    bodies = docs.join(near, "id").where("tid = rep_tid").select("tid", "text", "places")
    windows = materialize(bodies.mapInArrow(_windows(length), "hash bigint, check int, tid bigint, at int, hot boolean"), "windows")
    same = Window.partitionBy("hash", "check")
    plain = windows.where("not hot").withColumns({"lo": F.min("tid").over(same), "hi": F.max("tid").over(same)}).where("lo < hi").select("tid", "at")
    # hot is a property of the window itself (see _windows), so hot and plain windows never match each other
    hot = windows.where("hot")
    hot_hashes = hot.groupBy("hash", "check").agg(F.min("tid").alias("lo"), F.max("tid").alias("hi")).where("lo < hi").select("hash", "check")
    starts = plain.union(hot.join(hot_hashes, ["hash", "check"]).select("tid", "at"))
    spans = starts.groupBy("tid").agg(F.collect_list("at").alias("at")).mapInArrow(_merge(length), "tid bigint, spans array<struct<begin:bigint,end:bigint>>")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("begin"), F.col("n_chars").cast("bigint").alias("end")))
    return (
        members.join(classes.select("tid", "copies"), "tid")
        .join(spans, "tid", "left")
        .withColumn("spans", F.when(F.col("copies") > 1, whole).otherwise(F.col("spans")))
        .where("spans is not null")
        .select("id", F.col("n_chars").cast("bigint").alias("n_chars"), "spans", F.aggregate("spans", F.lit(0).cast("bigint"), lambda s, x: s + x["end"] - x["begin"]).alias("shared_chars"))
    )
