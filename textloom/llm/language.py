"""Language of short prose by a character n-gram model, and normalised language names."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.textcore import U, code_points, mix, slices

GRAMS = (1, 2, 3)
BUCKET_BITS = 14
MARGIN = 12.0  # nats between the best and the second language of a clear answer
SAMPLE = 1_000  # labelled texts of a language a model is fitted on
MAX_LANGUAGES = 50

# fixed values: stems of language names as people write them in questions
LANGUAGE_NAMES = {
    "en": "english englisch inglés ingles inglesa anglais 英语 英文",
    "de": "german deutsch alemán aleman allemand 德语 德文",
    "es": "spanish spanisch español espanol castellano espagnol 西班牙语 西班牙文",
    "fr": "french französisch francés frances français francais 法语 法文",
    "zh": "chinese mandarin mandarín chinesisch chino china chinois 中文 汉语 普通话",
}
# fixed values: codes that do not begin with the language's own code
LANGUAGE_CODES = {"eng": "en", "english": "en", "ger": "de", "deu": "de", "german": "de", "spa": "es", "spanish": "es", "fra": "fr", "fre": "fr", "french": "fr", "cn": "zh", "zho": "zh", "chi": "zh", "chinese": "zh"}

_WORD = re.compile(r"[^\W\d_]+")
_PROSE_WORD = re.compile(r"[^\W\d_]{2,}")
_alpha: np.ndarray | None = None
_HAN = re.compile(r"[㐀-鿿]")
_FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`|</?[A-Za-z][^<>\n]*>|https?://\S+")
#: names in code; ASCII only, since names stand next to Chinese characters without a space
_IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])(?:[A-Za-z0-9_]*[_\d][A-Za-z0-9_]*|[a-z]+[A-Z][A-Za-z0-9]*|[A-Z][a-z]+[A-Z][A-Za-z0-9]*)")
#: a line of code: ends or begins as no sentence does
CODE_LINE = re.compile(
    r"^\s*(?:(?:def|class|import|from|func|fn|export|function|package|public|private|static|const|let|var|impl|use|namespace|template|struct|enum|async)\s+[\w:<(\[*&{\"'@].*[\w)}\]{:;,>\"']|std::.*|#include.*|#!.*|//.*|/\*.*|\*/.*|--\s.*|\s+#\s.*|@\w+.*|"
    r"(?:SELECT|FROM|WHERE|GROUP BY|ORDER BY|CREATE|INSERT|UPDATE|DELETE|JOIN|LEFT JOIN|HAVING)\b.*|"
    r".*[;{}]|\s+(?:return|if|for|while|with|elif|else|try|except|raise|yield|switch|case|break|continue|pass|assert)\b.*|\s+[\w.\[\], ]+\s*[-+*/^|&]?=[^=].*|\s+[\w.>-]+\(.*|\s*[\])}]+[,;]?|\s+\"\"\".*)\s*$"
)


#: no line of code lacks all of these: every alternative of CODE_LINE has one
_CODE_SIGN = re.compile(
    r"[;{}=(#@\])]|//|--|/\*|\*/|\"\"\"|(?m:^)\s*(?:std::|(?:def|class|import|from|func|fn|export|function|package|public|private|static|const|let|var|impl|use|namespace|template|struct|enum|async)\s|"
    r"(?:SELECT|FROM|WHERE|GROUP BY|ORDER BY|CREATE|INSERT|UPDATE|DELETE|JOIN|LEFT JOIN|HAVING)\b|(?:return|if|for|while|with|elif|else|try|except|raise|yield|switch|case|break|continue|pass|assert)\b)"
)


def prose(text: str) -> str:
    """The text without fenced, inline and plain code, markup and identifiers.

    In each block of lines, all from the first to the last line of code is code.
    """
    if "```" in text:
        text = _FENCE.sub("\n\n", text)
    if _CODE_SIGN.search(text):
        kept = []
        for block in text.split("\n\n"):
            lines = block.split("\n")
            code = [i for i, line in enumerate(lines) if CODE_LINE.match(line)]
            first = code[0] if code else len(lines)
            while first and code and lines[first - 1].lstrip().startswith("#"):
                first -= 1  # comments right above code
            kept += lines[:first] + (lines[code[-1] + 1 :] if code else [])
        text = "\n".join(kept)
    if "`" in text or "<" in text or "://" in text:
        text = _INLINE.sub(" ", text)
    return _IDENTIFIER.sub(" ", text)


def _alpha_table() -> np.ndarray:
    global _alpha
    if _alpha is None:
        _alpha = code_points(r"[^\W\d_]+")
    return _alpha


def char_grams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of the 1-, 2- and 3-grams of lower-cased letters; whatever stands between words is one blank."""
    padded = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, padded), np.int64, len(texts)))
    letter = _alpha_table()[code]
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1] | (owner[1:] != owner[:-1])
    code, owner = np.where(letter, code, 32)[keep].astype(U), owner[keep]
    letter = letter[keep]
    buckets, owners = [], []
    for width in GRAMS:
        n = len(code) - width + 1
        if n < 1:
            continue
        h = np.full(n, width, U)
        for j in range(width):
            h = h * U(0xD6E8FEB86659FD93) + code[j : j + n]
        # a gram lies in one text and begins or ends with a letter
        use = (owner[:n] == owner[width - 1 :]) & (letter[:n] | letter[width - 1 :])
        buckets.append((mix(h[use]) >> U(64 - BUCKET_BITS)).astype(np.int64))
        owners.append(owner[:n][use])
    none = np.zeros(0, np.int64)
    return (np.concatenate(buckets), np.concatenate(owners)) if buckets else (none, none)


@dataclass(frozen=True)
class LanguageModel:
    """Naive Bayes over hashed character n-grams: log probabilities of each bucket in each language."""

    languages: tuple[str, ...]
    weights: np.ndarray  # buckets x languages

    @classmethod
    def of_counts(cls, counts: dict[str, np.ndarray]) -> LanguageModel:
        names = tuple(sorted(counts))
        table = np.stack([counts[k] for k in names], axis=1) + 0.5 if names else np.zeros((1 << BUCKET_BITS, 0))
        return cls(names, np.log(table / table.sum(axis=0)).astype(np.float32))

    @classmethod
    def of_texts(cls, texts: dict[str, Sequence[str]]) -> LanguageModel:
        return cls.of_counts({k: np.bincount(char_grams([prose(t) for t in v])[0], minlength=1 << BUCKET_BITS) for k, v in texts.items()})

    def detect(self, bodies: Sequence[str]) -> list[str | None]:
        """Language of each body of prose (see ``prose``); None where it is too short or gives no clear answer."""
        out: list[str | None] = []
        for part in slices([len(b) for b in bodies]):
            own = bodies[part]
            if len(self.languages) < 2:
                out += [None] * len(own)
                continue
            bucket, owner = char_grams(own)
            score = np.stack([np.bincount(owner, self.weights[bucket, i], len(own)) for i in range(len(self.languages))], axis=1)
            best = score.argmax(axis=1)
            ranked = np.sort(score, axis=1)
            clear = ranked[:, -1] - ranked[:, -2] >= MARGIN
            out += [self.languages[b] if c and has_words(t) else None for b, c, t in zip(best.tolist(), clear.tolist(), own)]
        return out


def has_words(body: str) -> bool:
    """Three words of two letters, or four Chinese characters: less is no prose."""
    return len(_PROSE_WORD.findall(body)) >= 3 or len(_HAN.findall(body)) >= 4


def fit_language_model(df: DataFrame, id_col: str, text_col: str, lang_col: str, *, sample: int = SAMPLE) -> LanguageModel:
    """A model fitted on about ``sample`` labelled texts of each language, chosen by a digest of the id.

    The bound is the parameter ``sample``: a language with fewer texts gives all.
    Labels are normalised (``normalized_code``); the ``MAX_LANGUAGES`` most
    frequent take part.  Only counts of n-grams reach the driver: one number for
    each bucket and language.  Rows without text or label are left out; without
    two languages the model detects nothing.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), normalized_code(F.col(lang_col)).alias("lang")).where("text is not null and lang is not null")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return LanguageModel.of_counts({})
    step = F.create_map(*(F.lit(x) for r in sizes for x in (r["lang"], -(-r["count"] // sample))))
    # an unlisted language has no step and its rows fall out
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit("language")), F.try_element_at(step, F.col("lang"))) == 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in slices([len(t) for t in texts]):
                own = np.array(langs[part])
                bucket, owner = char_grams([prose(t) for t in texts[part]])
                for k in set(langs[part]):
                    total[k] = total.get(k, 0) + np.bincount(bucket[own[owner] == k], minlength=1 << BUCKET_BITS)
        for k, n in total.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    sums = chosen.select("lang", "text").mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = {r["lang"]: np.zeros(1 << BUCKET_BITS) for r in sizes}
    langs = np.array(sums.column("lang").to_pylist())
    for k in counts:
        mine = langs == k
        counts[k][sums.column("bucket").to_numpy()[mine]] = sums.column("n").to_numpy()[mine]
    return LanguageModel.of_counts({k: v for k, v in counts.items() if v.any()})


def named_languages(text: str) -> set[str]:
    """Languages a question names, in any of the five languages and any inflection."""
    low = text.lower()
    words = set(_WORD.findall(low))
    return {k for k, names in LANGUAGE_NAMES.items() for n in names.split() if (n in low if _HAN.match(n) else any(w.startswith(n) and len(w) <= len(n) + 3 for w in words))}


def normalized_code(code: Column) -> Column:
    """``en-US``, ``EN``, ``eng`` and the like to a two-letter code; null and blank stay null."""
    base = F.regexp_extract(F.lower(F.trim(code)), r"^([a-z]+)", 1)
    known = F.create_map(*(F.lit(x) for pair in LANGUAGE_CODES.items() for x in pair))
    return F.when(base != "", F.coalesce(F.try_element_at(known, base), base))
