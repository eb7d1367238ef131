"""Order-sensitive operators: chunks, context windows, packing, batches, splits and mixing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import chunk_id, strip
from textloom.session import materialize


def character_chunks(df: DataFrame, key: str, text: str, size: int = 1 << 20) -> DataFrame:
    """``(key, chunk, content)``: fixed-size pieces of each text, none of an empty one."""
    t = F.col(text)
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(size)))
    rows = df.select(F.col(key).alias("key"), t.alias("t"), F.posexplode(starts).alias("chunk", "start"))
    return rows.select("key", "chunk", F.col("t").substr(F.col("start") + 1, F.lit(size)).alias("content"))


def overlapping_chunks(df: DataFrame, doc_id: str, text: str, *, size: int = 512, overlap: int = 64) -> DataFrame:
    """``(chunk_id, doc_id, start_char, end_char, content)``; content is trimmed, offsets are of the untrimmed span, blank chunks are dropped."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size")
    t = F.col(text)
    starts = F.when(F.length(t) > 0, F.sequence(F.lit(0), F.length(t) - 1, F.lit(size - overlap)))
    rows = df.select(F.col(doc_id).alias("doc_id"), t.alias("t"), F.explode(starts).alias("start_char"))
    cut = rows.select("doc_id", "start_char", F.least(F.col("start_char") + size, F.length("t")).alias("end_char"), strip(F.col("t").substr(F.col("start_char") + 1, F.lit(size))).alias("content"))
    return cut.where("content <> ''").select(chunk_id(F.col("doc_id"), F.col("start_char"), F.col("content")).alias("chunk_id"), "doc_id", "start_char", "end_char", "content")


def context_windows(df: DataFrame, key: str, ids: str, *, length: int = 64, stride: int | None = None, pad: int | None = None, memmap_count: bool = False) -> DataFrame:
    """``(key, window, x, y)`` with y one step ahead of x.

    Windows begin at multiples of the stride while ``length + 1`` ids remain.
    With ``pad`` the rest that is left makes one padded window.  With
    ``memmap_count`` there are (n - length) // stride windows, one fewer at a boundary.
    """
    stride = stride or length
    v, n = F.col("v"), F.size("v")
    count = F.greatest(F.floor((n - length) / stride), F.lit(0)) if memmap_count else F.greatest(F.floor((n - length - 1) / stride) + 1, F.lit(0))
    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("v")).where("size(v) > 0").withColumn("full", count.cast("int"))
    at = F.transform(F.when(F.col("full") > 0, F.sequence(F.lit(0), F.col("full") - 1)).otherwise(F.array().cast("array<int>")), lambda k: k * stride)
    if pad is not None and not memmap_count:
        # the tail begins where the next window would; it needs one id to predict
        tail = F.col("full") * stride
        at = F.when(n - tail > 1, F.array_append(at, tail)).otherwise(at)
    rows = rows.select("key", "v", F.posexplode(at).alias("window", "start"))

    def cut(shift: int) -> Column:
        got = F.slice(v, F.col("start") + 1 + shift, F.lit(length))
        return got if pad is None else F.concat(got, F.array_repeat(F.lit(pad), F.lit(length) - F.size(got)))

    return rows.select("key", "window", cut(0).alias("x"), cut(1).alias("y"))


def running_offset(df: DataFrame, order: str, size: str, name: str = "offset") -> DataFrame:
    """Global running offset in two phases: range partitions of ``(order, size)`` alone, then their sums.

    The rows are written once and read column by column, so what they carry is
    neither sorted nor shuffled by range; offsets are joined back by ``order``.
    No window spans more than a partition, apart from one row per partition.
    Rows of one ``order`` value follow each other in no particular order; a null
    size is 0 and a null ``order`` comes first.
    """
    rows, own = materialize(df, "rows"), F.coalesce(F.col(size), F.lit(0))
    keys = rows.groupBy(F.col(order).alias("_o")).agg(F.sum(own).alias("_s"), F.count("*").alias("_c"))
    parts = materialize(keys.repartitionByRange("_o").withColumn("_part", F.spark_partition_id()), "ranges")
    sums = parts.groupBy("_part").agg(F.sum("_s").alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("_s").over(Window.partitionBy("_part").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")
    placed = parts.join(before, "_part").select("_o", (F.col("_before") + inside).cast("bigint").alias(name))
    joined = rows.join(placed, rows[order].eqNullSafe(placed["_o"]))
    if parts.where("_c > 1").limit(1).count():
        joined = joined.withColumn(name, F.col(name) + F.sum(own).over(Window.partitionBy("_o").orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)) - own)
    return joined.drop("_o")


def joined_offsets(files: DataFrame, group: str, order: str, text: str, separator: str = "\n\n") -> DataFrame:
    """``(group, order, start, n_chars)``: where each file stands in the concatenation of its group's files with a separator.

    The concatenation itself is never built, so a group that holds a third of
    the table is spread like any other; ``sources.readers.join_files`` builds it
    for folders that fit one value.
    """
    rows = files.where(F.col(text).isNotNull()).select(F.struct(group, order).alias("_at"), F.length(text).alias("n_chars"), (F.length(text) + len(separator)).alias("_n"))
    placed = running_offset(rows, "_at", "_n", "_start")
    first = placed.groupBy(F.col(f"_at.{group}").alias("_g")).agg(F.min("_start").alias("_first"))
    out = placed.join(first, F.col(f"_at.{group}").eqNullSafe(F.col("_g")))
    return out.select(F.col(f"_at.{group}").alias(group), F.col(f"_at.{order}").alias(order), (F.col("_start") - F.col("_first")).alias("start"), F.col("n_chars"))


def packed_windows(df: DataFrame, order: str, ids: str, *, length: int, overlap: int, eos: int | None = None, count_exact: bool = False) -> DataFrame:
    """``(window, ids)`` over the concatenation of all rows' ids in ``order``.

    Window k holds the ids from ``k * length`` to ``k * length + length + overlap``;
    only full windows are kept.  With ``eos`` that id follows each row.  Rows are
    cut into slices by offset and only slices are shuffled.
    """
    v = F.col(ids) if eos is None else F.concat(ids, F.array(F.lit(eos).cast("int")))
    rows = df.select(F.col(order).alias("order"), v.alias("v")).where("size(v) > 0").withColumn("n", F.size("v"))
    rows = running_offset(rows, "order", "n")
    last = F.floor((F.col("offset") + F.col("n") - 1) / length)
    first = F.greatest(F.lit(0), F.ceil((F.col("offset") - length - overlap + 1) / F.lit(length)))
    cut = rows.withColumn("window", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("window") * length, F.col("offset"))
    high = F.least(F.col("window") * length + length + overlap, F.col("offset") + F.col("n"))
    slices = cut.where(high > low).select("window", low.alias("at"), F.slice("v", (low - F.col("offset") + 1).cast("int"), (high - low).cast("int")).alias("part"))
    joined = slices.groupBy("window").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda s: s["part"])).alias("ids"))
    return joined.where(F.size("ids") == length + overlap)


def batches(df: DataFrame, order: str, size: int, *, drop_last: bool = False) -> DataFrame:
    """Rows with ``batch``, the number of their batch in ``order``."""
    numbered = running_offset(df.withColumn("_one", F.lit(1)), order, "_one", "_at").withColumn("batch", F.floor(F.col("_at") / size))
    if drop_last:
        full = numbered.groupBy("batch").count().where(F.col("count") == size).select("batch")
        numbered = numbered.join(full, "batch", "left_semi")
    return numbered.drop("_one", "_at")


def padded_batches(df: DataFrame, batch: str, x: str, y: str, pad: int = 0, ignore: int = -100) -> DataFrame:
    """x and y of each row padded to the longest of its batch."""
    longest = df.groupBy(batch).agg(F.max(F.greatest(F.size(x), F.size(y))).alias("_longest"))
    fill = lambda c, p: F.concat(c, F.array_repeat(F.lit(p), F.col("_longest") - F.size(c)))
    return df.join(longest, batch).withColumns({x: fill(x, pad), y: fill(y, ignore)}).drop("_longest")


def shuffled_split(df: DataFrame, key: str, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42) -> DataFrame:
    """Rows with ``split``: exact sizes int(n * r1), int(n * r2) and the rest, in the order of a seeded digest of the key."""
    if abs(sum(ratios) - 1) > 0.01:
        raise ValueError("the ratios must sum to 1")
    hashed = df.withColumns({"_h": F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), "_one": F.lit(1)})
    at = running_offset(hashed, "_h", "_one", "_at")
    n = df.agg(F.count("*").alias("_n"))
    a, b = F.floor(F.col("_n") * ratios[0]), F.floor(F.col("_n") * ratios[1])
    return at.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("_at") < a, "train").when(F.col("_at") < a + b, "val").otherwise("test")).drop("_h", "_one", "_at", "_n")


def ordered_split(df: DataFrame, order: str, train: float) -> DataFrame:
    """Rows with ``split`` in key order: the first max(1, int(n * train)) are train, the rest val."""
    at = running_offset(df.withColumn("_one", F.lit(1)), order, "_one", "_at")
    n = df.agg(F.count("*").alias("_n"))
    return at.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("_at") < F.greatest(F.lit(1), F.floor(F.col("_n") * train)), "train").otherwise("val")).drop("_one", "_at", "_n")


def mixing_probabilities(weights: DataFrame, weight: str, temperature: float = 0.7) -> DataFrame:
    """Rows with ``p`` proportional to weight ** (1 / max(0.1, temperature)), and the cumulative ``p_to``; a few domains, one window."""
    power = F.pow(F.col(weight), F.lit(1 / max(0.1, temperature)))
    mixed = weights.withColumn("_w", power).withColumn("p", F.col("_w") / F.sum("_w").over(Window.partitionBy()))
    return mixed.drop("_w")


def uniform_hash(key: Column, seed: int = 42) -> Column:
    """A number in [0, 1) from the digest of a key: the first 8 hex digits over 2 ** 32."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
