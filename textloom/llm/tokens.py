"""Token counts under an existing tokenizer, loaded once per worker.

Two kinds of tokenizer are known: a merge table given as rows (vocabulary and
ranked merges), and the files of public tokenizers, named by path.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.language import LanguageModel, prose
from textloom.operators.tokenizer import merge_pairs
from textloom.session import spread

_PIECE = re.compile(r" ?[^\W\d_]+")
_CACHE_LIMIT = 400_000
_LONG_PIECE = 24  # longer runs of letters are merged with a heap instead of by passes
_loaded: dict[TokenizerSpec, Callable[[list[str]], tuple[np.ndarray, np.ndarray]]] = {}  # of this worker


class PieceTokenizer:
    """Byte-pair merges inside pieces: a run of letters with at most one space before it, or one other character.

    A token that is not in the vocabulary counts as one unknown token.
    """

    def __init__(self, vocabulary: frozenset[str], ranks: dict[tuple[str, str], int]):
        self.vocabulary, self.ranks = vocabulary, ranks
        self._single_unknown = re.compile("[^" + re.escape("".join(sorted(t for t in vocabulary if len(t) == 1))) + "]") if any(len(t) == 1 for t in vocabulary) else re.compile("(?s).")
        self._known: dict[str, tuple[int, int]] = {}

    def split(self, piece: str) -> list[str]:
        """Join the neighbours of lowest rank, all their occurrences from the left, until none is listed."""
        if len(piece) > _LONG_PIECE:
            return merge_pairs(piece, self.ranks)
        parts, ranks = list(piece), self.ranks
        while len(parts) > 1:
            best, where = min((ranks.get(pair, 1 << 60), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def encode(self, text: str) -> list[str]:
        out, at = [], 0
        for m in _PIECE.finditer(text):
            out += text[at : m.start()]
            out += self.split(m.group())
            at = m.end()
        return [t if t in self.vocabulary else "<unk>" for t in out + list(text[at:])]

    def _piece(self, piece: str) -> tuple[int, int]:
        got = self._known.get(piece)
        if got is None:
            parts = self.split(piece)
            got = len(parts), sum(p not in self.vocabulary for p in parts)
            if len(self._known) >= _CACHE_LIMIT:
                self._known.clear()
            self._known[piece] = got
        return got

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, unknown tokens) of each text."""
        tokens, unknown = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        known, miss = self._known, self._piece
        for i, text in enumerate(texts):
            pieces = _PIECE.findall(text)
            inside = outside = 0
            for p in pieces:
                n, u = known.get(p) or miss(p)
                inside += n
                outside += u
            tokens[i] = len(text) - sum(map(len, pieces)) + inside
            unknown[i] = outside
            rest = _PIECE.sub("", text)
            unknown[i] += len(self._single_unknown.findall(rest))
        return tokens, unknown


@dataclass(frozen=True)
class TokenizerSpec:
    """What a worker needs to load a tokenizer: rows of a merge table, or a file of a public tokenizer.

    ``kind`` is ``pieces`` (``vocabulary`` and ``merges`` hold the rows),
    ``tokenizers`` (a JSON file), ``tiktoken`` (a rank file; ``pattern`` cuts the
    text) or ``sentencepiece`` (a model file).
    """

    kind: str
    path: str = ""
    pattern: str = ""
    vocabulary: tuple[str, ...] = field(default=(), repr=False)
    merges: tuple[tuple[str, str], ...] = field(default=(), repr=False)

    def load(self) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
        if self.kind == "pieces":
            return PieceTokenizer(frozenset(self.vocabulary), {pair: i for i, pair in reversed(list(enumerate(self.merges)))}).counts
        if self.kind == "tokenizers":
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(self.path)
            tokenizer.encode_special_tokens = True
            encode = lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        elif self.kind == "tiktoken":
            import base64

            import tiktoken

            with open(self.path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            tokenizer = tiktoken.Encoding("given", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
            encode = lambda texts: tokenizer.encode_ordinary_batch(texts, num_threads=1)
        elif self.kind == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=self.path)
            encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            raise ValueError(f"unknown tokenizer kind {self.kind!r}")
        return lambda texts: (np.fromiter(map(len, encode(texts)), np.int64, len(texts)), np.zeros(len(texts), np.int64))


def loaded(spec: TokenizerSpec) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
    """The tokenizer of a spec, loaded once per worker and kept for its later tasks."""
    if spec not in _loaded:
        _loaded.clear()
        _loaded[spec] = spec.load()
    return _loaded[spec]


MAX_TOKENIZER_ROWS = 2_000_000


def tokenizer_from_tables(vocab: DataFrame, merges: DataFrame) -> TokenizerSpec:
    """The tokenizer of a vocabulary table ``(token, token_id)`` and a merge table ``(merge_rank, left_token, right_token)``.

    A tokenizer's tables do not grow with the corpus; over ``MAX_TOKENIZER_ROWS`` rows they are refused.
    """
    tokens = [r.token for r in vocab.select("token").where("token is not null").distinct().orderBy("token").limit(MAX_TOKENIZER_ROWS + 1).collect()]
    pairs = [(r.left_token, r.right_token) for r in merges.where("left_token is not null and right_token is not null").select("merge_rank", "left_token", "right_token").orderBy("merge_rank").limit(MAX_TOKENIZER_ROWS + 1).collect()]
    if max(len(tokens), len(pairs)) > MAX_TOKENIZER_ROWS:
        raise ValueError("the tokenizer tables are too large to be loaded by every worker")
    return TokenizerSpec("pieces", vocabulary=tuple(tokens), merges=tuple(pairs))


def with_token_counts(df: DataFrame, text_col: str, tokenizer: TokenizerSpec, *, count: str = "n_tokens", unknown: str | None = None, language: str | None = None, model: LanguageModel | None = None) -> DataFrame:
    """``df`` without its text, with the number of tokens (and unknown tokens, and the detected language) of each text.

    A null text has 0 tokens.  Every other column is passed through; a column of
    the name asked for is replaced.  Texts are encoded batch by batch in Arrow;
    a column that is not needed should be dropped before.
    """
    names = [count] + ([unknown] if unknown else [])
    rest = [c for c in df.columns if c != text_col and c not in names and c != language]
    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest] + [f"`{n}` bigint" for n in names] + [f"`{language}` string"] * bool(language))

    shared = df.sparkSession.sparkContext.broadcast(model) if language else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = loaded(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch.column(len(rest)).to_pylist()]
            got = [*map(pa.array, counts(texts)[: len(names)])]
            if language:
                got.append(pa.array(shared.value.detect([prose(t) for t in texts]), pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *got], names=[*rest, *names, *[language] * bool(language)])

    return spread(df.select(*(F.col(f"`{c}`") for c in rest), F.col(text_col))).mapInArrow(run, schema)
