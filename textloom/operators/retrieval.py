"""Hashed embeddings and dense, sparse and hybrid retrieval with re-ranking and a context budget."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import count_substring

DIMENSIONS = 128
# fixed values: the layout of a context and of the question that carries it
HEADER = "=== RETRIEVED KNOWLEDGE CONTEXT ==="
FOOTER = "=== END KNOWLEDGE CONTEXT ===\n"
ENTRY_HEAD = ("\n--- [Doc ", ": ", "] (Source: ", ") ---")
ASKING = "\nQuestion: {query}\n\nInstructions: Answer the question using the retrieved knowledge context above. Cite sources using [Doc N] format."

BLOCK = 512  # queries of one pass: bounds what is broadcast and the score matrix of a batch


@lru_cache(maxsize=1 << 18)
def hashed_word(word: str, dimensions: int) -> tuple[int, float]:
    """Slot and value in [-1, 1) of a word, from its MD5 as one 128-bit number."""
    h = int(hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest(), 16)
    return h % dimensions, ((h >> 16) % 100) / 50.0 - 1.0


def embed(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bag of hashed words, L2-normalised; a zero vector for a text without words."""
    vector = np.zeros(dimensions)
    pairs = [hashed_word(w, dimensions) for w in (text or "").lower().split()]
    if pairs:
        slots, values = zip(*pairs)
        vector = np.bincount(slots, weights=values, minlength=dimensions)
        length = np.linalg.norm(vector)
        if length > 0:
            vector /= length
    return vector


def embed_texts(df: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS) -> DataFrame:
    """``(key, embedding array<double>)``, computed where the texts are read: nothing is shuffled."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = np.stack([embed(t, dimensions) for t in batch.column(1).to_pylist()]) if len(batch) else np.zeros((0, dimensions))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, dimensions), pa.int32()), pa.array(matrix.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "embedding"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, embedding array<double>")


def nearest(vectors: DataFrame, key: str, column: str, queries: list[tuple[str, np.ndarray]], k: int, *, digits: int = 6, exclude_self: bool = False) -> DataFrame:
    """``(query, key, score, rank)``: the k stored vectors of largest dot product with each normalised query.

    Every batch multiplies one block and keeps its own k best per query, so each
    scan task passes on at most k rows per query and batch.  Scores are rounded
    before ranking and ties go to the smaller key.  Null or empty vectors are skipped.
    """
    if len(queries) > BLOCK:
        raise ValueError("too many queries for one pass; see nearest_to_rows")
    kind = vectors.schema[key].dataType.simpleString()
    names = [n for n, _ in queries]
    block = np.stack([v / n if (n := np.linalg.norm(v)) > 0 else v for _, v in queries]) if queries else np.zeros((0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch) or not names:
                continue
            matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1)
            keys = batch.column(0).to_pylist()
            order = np.array(sorted(range(len(keys)), key=keys.__getitem__))
            scores = np.round(matrix[order] @ block.T, digits)
            best = np.argsort(-scores, axis=0, kind="stable")[: k + exclude_self]
            column = np.broadcast_to(np.arange(len(names)), best.shape).ravel()
            row = best.ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[c] for c in column], pa.string()), batch.column(0).take(pa.array(order[row])), pa.array(scores[row, column])], names=["query", key, "score"]
            )

    rows = vectors.where(F.size(column) > 0).select(key, column).mapInArrow(run, f"query string, `{key}` {kind}, score double")
    if exclude_self:
        rows = rows.where(F.col("query") != F.col(key).cast("string"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_to_rows(vectors: DataFrame, key: str, column: str, queries: DataFrame, k: int, *, digits: int = 6, exclude_self: bool = False) -> DataFrame:
    """``nearest`` for every row of ``queries(query string, vector)`` against all stored rows, exactly.

    The query set is cut into blocks of about ``BLOCK`` by the hash of its id;
    each block is one scan of the stored rows, so any number of queries is
    answered and only a block is ever on the driver.  Queries without an id or a
    vector have no rows; repeated ids count once.
    """
    asked = queries.where("query is not null").where(F.size("vector") > 0).dropDuplicates(["query"])
    blocks = max(1, -(-2 * asked.count() // BLOCK))  # half full on average, so that none overflows
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).collect()
        for start in range(0, max(1, len(rows)), BLOCK):
            part = [(r["query"], np.array(r["vector"], float)) for r in rows[start : start + BLOCK]]
            found = nearest(vectors, key, column, part, k, digits=digits, exclude_self=exclude_self)
            out = found if out is None else out.union(found)
    return out


def query_terms(text: str) -> list[str]:
    return sorted(set(text.lower().split()))


def keyword_score(content: Column, terms: list[str]) -> Column:
    """Occurrences (as substrings) of each distinct term times 1.5; there is no document frequency and no length norm."""
    low = F.lower(content)
    total = F.lit(0.0)
    for term in terms:
        total = total + count_substring(low, F.lit(term)) * 1.5
    return total


def term_density(content: Column, terms: list[str]) -> Column:
    low = F.lower(content)
    hits = F.lit(0)
    for term in terms:
        hits = hits + F.contains(low, F.lit(term)).cast("int")
    return hits / F.lit(max(1, len(terms)))


def dense_hits(embedded: DataFrame, query: str, k: int) -> DataFrame:
    return nearest(embedded, "chunk_id", "embedding", [("q", embed(query))], k).select("chunk_id", "score", "rank")


def sparse_hits(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """Top k chunks of positive keyword score; ties go to the smaller id.  The k best are found without a full sort."""
    scored = chunks.select("chunk_id", keyword_score(F.col("content"), query_terms(query)).alias("score")).where("score > 0")
    top = scored.orderBy(F.desc("score"), "chunk_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id")))


def fuse(dense: DataFrame, sparse: DataFrame, k: int, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    d, s = dense.select("chunk_id", F.col("rank").alias("d")), sparse.select("chunk_id", F.col("rank").alias("s"))
    part = lambda c: F.coalesce(1.0 / (F.col(c) + constant), F.lit(0.0))
    both = d.join(s, "chunk_id", "full").select("chunk_id", F.round(part("d") + part("s"), 9).alias("score"))
    return both.orderBy(F.desc("score"), "chunk_id").limit(k)


def rerank(hits: DataFrame, chunks: DataFrame, query: str, k: int) -> DataFrame:
    """Scores raised by the share of query terms a chunk contains."""
    known = F.broadcast(hits.select("chunk_id", "score"))  # at most k rows of a fused list
    boosted = chunks.join(known, "chunk_id").withColumn("score", F.round(F.col("score") * (1 + term_density(F.col("content"), query_terms(query))), 9))
    return boosted.orderBy(F.desc("score"), "chunk_id").limit(k)


def with_context_entries(results: DataFrame, budget: int = 1500) -> DataFrame:
    """Ranked results ``(rank, chunk_id, doc_id, source_file, content)`` to the entries of a context within a budget of characters.

    An entry that does not fit is cut to what is left, less 10, if that is over
    50 characters, and ends the context.  Windows run over one result list.
    """
    a, b, c, d = map(F.lit, ENTRY_HEAD)
    head = F.concat(a, F.col("rank").cast("string"), b, "title", c, "source_file", d)
    rows = results.withColumn("head", head).withColumn("entry", F.concat("head", F.lit("\n"), "content", F.lit("\n")))
    order = Window.orderBy("rank")
    before = F.lit(len(HEADER)) + F.coalesce(F.sum(F.length("entry")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("over", F.col("before") + F.length("entry") > budget)
    rows = rows.withColumn("stops", F.sum(F.col("over").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    left = F.lit(budget) - F.col("before") - F.length("head") - 10
    cut = F.concat("head", F.lit("\n"), F.col("content").substr(F.lit(1), left.cast("int")), F.lit("...\n"))
    rows = rows.withColumn("entry", F.when(F.col("over"), cut).otherwise(F.col("entry")))
    return rows.where((F.col("stops") == 0) | ((F.col("stops") == 1) & F.col("over") & (left > 50))).select("rank", "chunk_id", "entry")


def augmented_prompt(entries: DataFrame, query: str) -> DataFrame:
    """One row: the question with its context and the ids cited."""
    block = F.array_join(F.concat(F.array(F.lit(HEADER)), F.transform(F.array_sort(F.collect_list(F.struct("rank", "entry"))), lambda e: e["entry"]), F.array(F.lit(FOOTER))), "\n")
    asked = F.concat(block, F.lit(ASKING.format(query=query)))
    cited = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda e: e["chunk_id"]), ",")
    return entries.agg(F.when(F.count("*") > 0, asked).otherwise(F.lit(query)).alias("prompt"), cited.alias("cited"))
