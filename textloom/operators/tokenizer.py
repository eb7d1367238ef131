"""Character and byte-pair tokenizers: vocabularies, training, encoding and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.stats import adjacent_characters, adjacent_pairs, best_pair, character_counts
from textloom.session import discard, materialize, spread

PADDING, UNKNOWN, BEGIN, END = 0, 1, 2, 3
TOP = 1_000  # most frequent pairs a training round looks at
PENDING = 16  # merges after which training writes the texts anew
OPEN = 250  # pairs of characters, or five for three merges if more, that are not cut when training begins
LOCAL = 200_000_000  # characters of distinct segments that one task trains on
DENSE = 2_048  # tokens of a training with a table of all pairs in one task
BLOCK = 1 << 22  # tokens joined at once there
MAX_TABLE = 2_000_000  # rows of a vocabulary or merge table that every worker loads


def merge_pairs(text: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """Tokens of a text: the neighbours of lowest rank are joined, leftmost first, until none is listed.

    A heap of (rank, place) over a doubly linked list: n log n instead of a pass per merge.
    """
    token: list[str | None] = list(text)
    n = len(token)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[p], i) for i, p in enumerate(zip(token, token[1:])) if p in ranks]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        j = right[i]
        if token[i] is None or j >= n or ranks.get((token[i], token[j])) != rank:
            continue
        token[i], token[j] = token[i] + token[j], None
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := ranks.get((token[i], token[k]))) is not None:
                heappush(heap, (r, i))
        h = left[i]
        if h >= 0 and (r := ranks.get((token[h], token[i]))) is not None:
            heappush(heap, (r, h))
    return [t for t in token if t is not None]


def load_merges(merges: DataFrame) -> dict[tuple[str, str], int]:
    rows = merges.where("left_token is not null and right_token is not null").select("merge_rank", "left_token", "right_token").orderBy("merge_rank").limit(MAX_TABLE + 1).collect()
    if len(rows) > MAX_TABLE:
        raise ValueError("the merge table is too large to be loaded by every worker")
    out: dict[tuple[str, str], int] = {}
    for r in rows:
        out.setdefault((r.left_token, r.right_token), r.merge_rank)
    return out


def load_vocabulary(vocab: DataFrame) -> dict[str, int]:
    rows = vocab.where("token is not null").select("token", "token_id").limit(MAX_TABLE + 1).collect()
    if len(rows) > MAX_TABLE:
        raise ValueError("the vocabulary is too large to be loaded by every worker")
    return {r.token: r.token_id for r in rows}


class MergeEncoder:
    """Byte-pair encoding with a cache of segments.

    A merge joins the end of one token to the beginning of another, so between
    two characters that no merged pair brings together nothing is ever joined:
    a text falls into segments there that are encoded one by one and recur often.
    """

    LIMIT = 400_000

    def __init__(self, vocab: dict[str, int], ranks: dict[tuple[str, str], int], unknown: int = UNKNOWN):
        self.vocab, self.ranks, self.unknown = vocab, ranks, unknown
        self.meeting = np.unique(np.array([(ord(a[-1]) << 21) | ord(b[0]) for a, b in ranks if a and b], np.int64))
        self.known: dict[str, list[int]] = {}

    def segment(self, part: str) -> list[int]:
        got = self.known.get(part)
        if got is None:
            got = [self.vocab.get(t, self.unknown) for t in merge_pairs(part, self.ranks)]
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            if len(part) <= 64:
                self.known[part] = got
        return got

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pair = (code[:-1] << 21) | code[1:]
        at = np.searchsorted(self.meeting, pair)
        joined = np.zeros(len(pair), bool)
        inside = at < len(self.meeting)
        joined[inside] = self.meeting[at[inside]] == pair[inside]
        cuts = [0, *(np.nonzero(~joined)[0] + 1).tolist(), len(text)]
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:]):
            out += self.segment(text[a:b])
        return out


def encode_merged(df: DataFrame, key: str, text: str, vocab: dict[str, int], ranks: dict[tuple[str, str], int], *, unknown: int = UNKNOWN) -> DataFrame:
    """``(key, ids array<int>)`` of whole texts (white space merges like any character); null texts have null ids."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = MergeEncoder(vocab, ranks, unknown)
        for batch in batches:
            ids = [None if t is None else encoder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def code_points(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, ids array<int>)`` with the code points of each text, decoded batch by batch; null texts have null ids."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            code = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append([t is None for t in texts], False)), pa.array(code))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def _characters(df: DataFrame, text: str) -> list[str]:
    return sorted(r.ch for r in character_counts(df, text).select("ch").collect())  # code points, at most 0x110000


def train_merges(df: DataFrame, text: str, merges: int) -> list[tuple[str, str, int]]:
    """The first ``merges`` merges ``(left, right, count)`` of byte-pair training over whole texts, of equal counts the largest pair.

    Two tokens are neighbours no more often than the characters that meet
    between them.  So texts are cut between characters that are neighbours
    ``floor`` times at most: while the best pair is more frequent than that,
    nothing is joined across a cut, and the counts of all pairs that can be the
    best are complete.  Equal segments are counted once with their number.  At
    the floor the texts are cut anew between fewer characters.
    """
    out: list[tuple[str, str, int]] = []
    wanted = max(OPEN, merges * 5 // 3)
    while len(out) < merges:
        top = adjacent_characters(df, text).orderBy(F.desc("n"), "left", "right").limit(wanted + 1).collect()
        floor = top[wanted].n if len(top) > wanted else 0
        opened = [(r.left, r.right) for r in top if r.n > floor]
        segments = materialize(_segments(df, text, opened), "segments")
        size = segments.agg(F.sum(F.length("segment") + 1).alias("n")).collect()[0].n or 0
        characters = sorted({c for p in opened for c in p})
        if size <= LOCAL and len(characters) + merges < DENSE:
            run = _train_in_one_task(characters, list(out), merges, floor)
            rows = segments.coalesce(1).mapInArrow(run, "at int, left string, right string, n bigint").orderBy("at").collect()
            out += [(r.left, r.right, r.n) for r in rows]
        else:
            out = _train_in_rounds(segments, characters, out, merges, floor)
        discard(segments)
        if not floor:
            break
        wanted *= 2
    return out


def _segments(df: DataFrame, text: str, opened: list[tuple[str, str]]) -> DataFrame:
    """``(segment, weight)``: the parts of two or more characters into which the texts fall where a pair of characters is not ``opened``."""
    used = sorted({ord(c) for p in opened for c in p})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(0x110000, np.int32)
        table[used] = np.arange(1, len(used) + 1)
        pairs = np.unique(np.array([int(table[ord(a)]) * (len(used) + 1) + int(table[ord(b)]) for a, b in opened], np.int64))
        whole = None
        if len(used) < 4_096:
            whole = np.zeros((len(used) + 1) ** 2, bool)
            whole[pairs] = True
        total: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["segment", "weight"])
            total.clear()
            return got

        for batch in batches:
            for low in range(0, len(batch), 1_000):
                texts = batch.column(0).slice(low, 1_000).to_pylist()
                joined = "".join(texts)
                code = table[np.frombuffer(joined.encode("utf-32-le"), np.uint32)].astype(np.int64)
                pair = code[:-1] * (len(used) + 1) + code[1:]
                cut = ~whole[pair] if whole is not None else ~np.isin(pair, pairs)
                cut[np.cumsum([len(t) for t in texts])[:-1] - 1] = True
                first = np.concatenate([[0], np.nonzero(cut)[0] + 1, [len(code)]])
                long = np.nonzero(np.diff(first) > 1)[0]
                for a, b in zip(first[long].tolist(), first[long + 1].tolist()):
                    part = joined[a:b]
                    total[part] = total.get(part, 0) + 1
                if len(total) > 500_000:
                    yield rows()
        yield rows()

    own = spread(df.select(F.col(text).alias("t")).where("length(t) > 1"))
    return own.mapInArrow(run, "segment string, weight bigint").groupBy("segment").agg(F.sum("weight").alias("weight"))


class _Block:
    """Tokens of segments with a 0 before each and at the end."""

    def __init__(self, token: np.ndarray, weight: np.ndarray):
        self.token, self.weight = token, weight
        self.edge = np.nonzero(token == 0)[0]

    def pairs(self, at: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that begin at the places ``at``, in rising order, and their weights."""
        a, b = self.token[at].astype(np.int64), self.token[at + 1].astype(np.int64)
        inner = (a > 0) & (b > 0)
        at, pair = at[inner], a[inner] * tokens + b[inner]
        return pair, self.weight[np.searchsorted(self.edge, at) - 1]

    def join(self, left: int, right: int, joined: int, tokens: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Join a pair from the left; the pairs that were there and those that are there now, or nothing."""
        at = np.nonzero((self.token[:-1] == left) & (self.token[1:] == right))[0]
        if not len(at):
            return []
        if left == right:
            at = _every_other(at)
        before = self.pairs(_around(at, (-1, 0, 1)), tokens)
        keep = np.ones(len(self.token), bool)
        keep[at + 1] = False
        self.token[at] = joined
        self.token = self.token[keep]
        self.edge = self.edge - np.cumsum(np.bincount(np.searchsorted(self.edge, at + 1), minlength=len(self.edge)))
        at = at - np.arange(len(at))
        return [before, self.pairs(_around(at, (-1, 0)), tokens)]


def _around(at: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """The places at these steps from ``at``, in rising order, each once; joined pairs do not overlap, so the places of the next do not come before."""
    flat = (at[:, None] + np.array(steps)).ravel()
    return flat[np.append(True, flat[1:] != flat[:-1])]


def _weighted(parts: list[tuple[np.ndarray, np.ndarray]], tokens: int) -> np.ndarray:
    """Exact sums of weights by pair; the halves of the weights are summed as floating numbers that hold them exactly."""
    pair, weight = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    low = np.bincount(pair, weight & 0xFFFFFF, tokens * tokens).astype(np.int64)
    high = weight >> 24
    return low + (np.bincount(pair, high, tokens * tokens).astype(np.int64) << 24) if high.any() else low


def _every_other(at: np.ndarray) -> np.ndarray:
    """Of neighbouring places every other one."""
    start = np.append(True, np.diff(at) != 1)
    run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - run) % 2 == 0]


def _train_in_one_task(characters: list[str], known: list[tuple[str, str, int]], merges: int, floor: int):
    """Rows (at, left, right, n) of the merges after the ``known`` ones, as long as they are more frequent than ``floor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = ["", *characters]
        number = {s: i for i, s in enumerate(strings)}
        tokens = len(strings) + merges
        table = np.zeros(0x110000, np.int16)
        table[[ord(c) for c in characters]] = np.arange(1, len(strings))
        # a segment has no character of no opened pair, so that stands for its end
        end = next(c for c in map(chr, range(1, 0x110000)) if c not in number)
        blocks: list[_Block] = []
        held: list[tuple[str, np.ndarray]] = []

        def close() -> None:
            code = np.frombuffer((end + end.join(t for t, _ in held) + end).encode("utf-32-le"), np.uint32)
            blocks.append(_Block(table[code], np.concatenate([w for _, w in held])))
            held.clear()

        for batch in batches:
            held.append((end.join(batch.column(0).to_pylist()), batch.column(1).to_numpy()))
            if sum(len(t) for t, _ in held) >= BLOCK:
                close()
        if held:
            close()

        def numbered(left: str, right: str) -> tuple[int, int, int]:
            joined = number.setdefault(left + right, len(strings))
            if joined == len(strings):
                strings.append(left + right)
            return number[left], number[right], joined

        for left, right, _ in known:
            pair = numbered(left, right)
            for b in blocks:
                b.join(*pair, tokens)
        counts = np.zeros(tokens * tokens, np.int64)
        for b in blocks:
            counts += _weighted([b.pairs(np.arange(len(b.token) - 1), tokens)], tokens)
        found = []
        while len(known) + len(found) < merges:
            n = int(counts.max())
            if n <= floor:
                break
            left, right = max((strings[p // tokens], strings[p % tokens]) for p in np.nonzero(counts == n)[0].tolist())
            found.append((len(found), left, right, n))
            pair = numbered(left, right)
            changes = [c for b in blocks if (c := b.join(*pair, tokens))]
            counts += _weighted([now for _, now in changes], tokens) - _weighted([before for before, _ in changes], tokens)
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["at", "left", "right", "n"])

    return run


def _train_in_rounds(segments: DataFrame, characters: list[str], known: list[tuple[str, str, int]], merges: int, floor: int) -> list[tuple[str, str, int]]:
    """All merges so far, where the segments are too many for one task.

    A round counts all neighbours (per task, then combined) and looks at the
    ``TOP`` most frequent pairs.  It takes the best pair, and the next ones as
    long as they are sure to follow: they have no token in common with those
    taken, so their counts stay, and are more frequent than any pair a taken
    merge can bring about.  Merges are applied where the segments are read;
    every ``PENDING`` merges they are written anew.
    """
    strings = list(characters)
    number = {c: i for i, c in enumerate(strings)}
    rows = materialize(spread(segments).mapInArrow(_numbered(number), "tokens array<int>, weight bigint"), "bpe")
    out: list[tuple[str, str, int]] = []
    pending: list[tuple[int, int, int]] = []

    def add(taken: list[tuple[str, str, int]]) -> None:
        for left, right, n in taken:
            joined = number.setdefault(left + right, len(strings))
            if joined == len(strings):
                strings.append(left + right)
            pending.append((number[left], number[right], joined))
            out.append((left, right, n))

    add(known)
    while len(out) < merges:
        pairs = rows.mapInArrow(_count_pairs(pending, strings), "left string, right string, n bigint").groupBy("left", "right").agg(F.sum("n").alias("n"))
        best = pairs.orderBy(F.desc("n"), F.desc("left"), F.desc("right")).limit(TOP).collect()
        taken = sure_merges([(r.left, r.right, r.n) for r in best], number, len(best) == TOP)[: merges - len(out)]
        taken = [t for t in taken if t[2] > floor]  # in falling order
        if not taken:
            break
        add(taken)
        if len(pending) >= PENDING:
            after = materialize(rows.mapInArrow(_applied(pending), "tokens array<int>, weight bigint"), "bpe")
            discard(rows)
            rows, pending[:] = after, []
    discard(rows)
    return out


def sure_merges(best: list[tuple[str, str, int]], known: dict[str, int], more: bool) -> list[tuple[str, str, int]]:
    """The first pair, and those after it that are the next merges whatever the merges before them change.

    ``best`` is in falling order; ``more`` says that there are other pairs, none more frequent than the last.
    """
    floor = best[-1][2] if more else 0
    before, after = {}, {}  # the most frequent pair that ends, or begins, with a token
    for left, right, n in best:
        before.setdefault(right, n)
        after.setdefault(left, n)
    taken: list[tuple[str, str, int]] = []
    touched: set[str] = set()
    bound = 0
    for left, right, n in best:
        if taken and (left in touched or right in touched or n <= bound):
            break
        taken.append((left, right, n))
        if left + right in known:
            break  # its new places add to pairs that are there already
        touched |= {left, right}
        bound = max(bound, min(n, max(before.get(left, floor), after.get(right, floor))))
    return taken


def _numbered(number: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(0x110000, np.int32)
        table[[ord(c) for c in number]] = list(number.values())
        for batch in batches:
            texts = batch.column(0).to_pylist()
            code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(table[code])), batch.column(1)], names=["tokens", "weight"])

    return run


def _merged(lists: pa.ListArray, pending: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, text) of a batch after the pending merges, each from the left."""
    offsets = lists.offsets.to_numpy()
    token = lists.values.to_numpy()[offsets[0] : offsets[-1]].copy()
    text = np.repeat(np.arange(len(lists)), np.diff(offsets))
    for left, right, joined in pending:
        at = np.nonzero((token[:-1] == left) & (token[1:] == right) & (text[:-1] == text[1:]))[0]
        if left == right and len(at):
            at = _every_other(at)
        token[at] = joined
        keep = np.ones(len(token), bool)
        keep[at + 1] = False
        token, text = token[keep], text[keep]
    return token, text


def _count_pairs(pending: list[tuple[int, int, int]], strings: list[str]):
    pending, strings = list(pending), list(strings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            token, text = _merged(batch.column(0), pending)
            weight = batch.column(1).to_numpy()[text[:-1]]
            inner = text[:-1] == text[1:]
            pair, back = np.unique((token[:-1].astype(np.int64) << 32 | token[1:])[inner], return_inverse=True)
            for p, n in zip(pair.tolist(), np.bincount(back, weight[inner], len(pair)).astype(np.int64).tolist()):
                total[p] = total.get(p, 0) + n
        sides = [[strings[p >> 32] for p in total], [strings[p & 0xFFFFFFFF] for p in total]]
        yield pa.RecordBatch.from_arrays([*(pa.array(s, pa.string()) for s in sides), pa.array(list(total.values()), pa.int64())], names=["left", "right", "n"])

    return run


def _applied(pending: list[tuple[int, int, int]]):
    pending = list(pending)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, text = _merged(batch.column(0), pending)
            offsets = np.searchsorted(text, np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(token)), batch.column(1)], names=["tokens", "weight"])

    return run


def train_to_size(df: DataFrame, text: str, size: int, special: int = 4) -> list[tuple[str, str, int]]:
    """Byte-pair training until ``special`` tokens, all characters and the merges are ``size`` tokens, or no pairs are left."""
    return train_merges(df, text, max(0, size - special - len(_characters(df, text))))


def encode_characters(df: DataFrame, key: str, text: str, vocab: dict[str, int], *, unknown: int = UNKNOWN) -> DataFrame:
    """``(key, ids array<int>)``, one id per character."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [None if t is None else [vocab.get(c, unknown) for c in t] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def frame(ids: Column, *, special: bool = False, max_length: int | None = None, truncate: bool = False, pad: bool = False, begin: int = BEGIN, end: int = END, padding: int = PADDING) -> Column:
    """Encoding options: begin and end marks, a maximum length (an error unless truncating), padding on the right."""
    v = F.concat(F.array(F.lit(begin)), ids, F.array(F.lit(end))) if special else ids
    if max_length is None:
        return v
    if truncate:
        v = F.slice(v, 1, max_length)
    else:
        v = F.when(F.size(v) > max_length, F.raise_error(F.lit(f"a sequence is longer than {max_length}")).cast("array<int>")).otherwise(v)
    return F.concat(v, F.array_repeat(F.lit(padding), F.greatest(F.lit(0), F.lit(max_length) - F.size(v)))) if pad else v


def decode(ids: Column, vocab: Column, *, skip: tuple[int, ...] = (PADDING, BEGIN, END), unknown: str | None = "<unk>") -> Column:
    """Text of ids under a ``map<int,string>``; an id without token is ``unknown``, or an error if that is None."""
    kept = F.filter(ids, lambda i: ~i.isin(*skip)) if skip else ids
    missing = F.lit(unknown) if unknown is not None else F.raise_error(F.lit("an id has no token")).cast("string")
    return F.array_join(F.transform(kept, lambda i: F.coalesce(F.try_element_at(vocab, i), missing)), "")


def code_pair(problem: Column, solution: Column, *, begin: int, end: int, problem_mark: int, solution_mark: int, max_length: int) -> Column:
    """A problem and its solution as one sequence with control tokens, cut to ``max_length``."""
    one = lambda i: F.array(F.lit(i))
    return F.slice(F.concat(one(begin), one(problem_mark), problem, one(solution_mark), solution, one(end)), 1, max_length)


__all__ = ["MergeEncoder", "adjacent_pairs", "best_pair", "code_pair", "code_points", "decode", "encode_characters", "encode_merged", "frame", "load_merges", "load_vocabulary", "merge_pairs", "train_merges", "train_to_size"]
