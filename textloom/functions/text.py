"""Text cleaning and inspection as Column expressions; Arrow UDFs only where Spark has no built-in."""

from __future__ import annotations

import ast
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

#: white space as Python's ``str.strip`` and ``str.split`` know it; Java's ``\s`` is ASCII only
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: control characters but tab, line feed and carriage return
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"
PYTHON_SUFFIXES = ("python", "py")
CURLY_SUFFIXES = ("cpp", "c++", "c", "hpp", "h", "java")


def fix_line_endings(t: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(t, r"\r\n?", "\n")


def strip_control(t: Column) -> Column:
    return F.regexp_replace(t, CONTROL, "")


@F.pandas_udf(S.StringType())
def _normalize(t: pd.Series, form: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else unicodedata.normalize(f, s) for s, f in zip(t, form)])


def unicode_normalize(t: Column, form: str = "NFC") -> Column:
    """Unicode normal form; ASCII text, the common case, never leaves the JVM."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown normal form {form!r}")
    foreign = F.when(F.octet_length(t) != F.length(t), t)
    return F.when(F.octet_length(t) == F.length(t), t).otherwise(_normalize(foreign, F.lit(form)))


def expand_tabs(t: Column, size: int = 4) -> Column:
    """Tabs to the next multiple of ``size`` columns; text without tabs stays in the JVM."""

    @F.pandas_udf(S.StringType())
    def expand(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x.expandtabs(size))

    return F.when(F.contains(t, F.lit("\t")), expand(F.when(F.contains(t, F.lit("\t")), t))).otherwise(t)


def clean_text(t: Column, *, form: str | None = "NFC", control: bool = True, line_endings: bool = True, tabs: int | None = None) -> Column:
    """Line endings, normal form, control characters and tabs, in this order; null stays null."""
    if line_endings:
        t = fix_line_endings(t)
    if form:
        t = unicode_normalize(t, form)
    if control:
        t = strip_control(t)
    return expand_tabs(t, tabs) if tabs else t


def strip(t: Column) -> Column:
    return F.regexp_replace(t, f"^{SPACE}+|{SPACE}+$", "")


def rstrip_lines(t: Column) -> Column:
    return F.regexp_replace(t, r"(?md)[ \t\x0b\f]+$", "")


def words(t: Column) -> Column:
    return F.filter(F.split(t, f"{SPACE}+"), lambda w: w != "")


def line_count(t: Column) -> Column:
    """Lines as ``splitlines`` counts them: a trailing break opens no further line."""
    open_end = F.when((t == "") | t.rlike(f"(?:{LINE_BREAK})\\z"), 0).otherwise(1)
    return F.regexp_count(t, F.lit(LINE_BREAK)) + open_end


def count_substring(t: Column, term: Column) -> Column:
    """Occurrences that do not overlap; an empty term has none."""
    return F.when(F.length(term) > 0, ((F.length(t) - F.length(F.replace(t, term, F.lit("")))) / F.length(term)).cast("int")).otherwise(0)


def clean_python(t: Column, *, comments: bool = True) -> Column:
    """Base cleaning with 4-column tabs, trailing blanks off, and ``#`` to the end of the line removed (also inside strings)."""
    t = rstrip_lines(clean_text(t, tabs=4))
    return F.regexp_replace(t, r"(?md)#.*$", "") if comments else t


def clean_curly(t: Column) -> Column:
    """C-like code without block and line comments."""
    return F.regexp_replace(F.regexp_replace(clean_text(t), r"(?s)/\*.*?\*/", ""), r"(?md)//.*$", "")


def braces_balanced(t: Column) -> Column:
    """The running count of braces never falls below 0 and ends at 0."""
    only = F.split(F.regexp_replace(t, r"[^{}]", ""), "")
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("low"))

    def step(s: Column, c: Column) -> Column:
        n = s["n"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(n.alias("n"), F.least(s["low"], n).alias("low"))

    return F.aggregate(only, start, step, lambda s: (s["n"] == 0) & (s["low"] == 0))


@F.pandas_udf(S.StructType([S.StructField("ok", S.BooleanType()), S.StructField("message", S.StringType())]))
def python_syntax(code: pd.Series) -> pd.DataFrame:
    """Whether a text parses as Python, with the first error's line."""
    out = []
    for text in code:
        try:
            ast.parse(text or "")
            out.append((True, None))
        except SyntaxError as e:
            out.append((False, f"SyntaxError at line {e.lineno}: {e.msg}"))
        except (ValueError, RecursionError, MemoryError) as e:
            out.append((False, type(e).__name__))
    return pd.DataFrame(out, columns=["ok", "message"])


def clean_code(t: Column, language: Column) -> Column:
    lang = F.lower(language)
    return F.when(lang.isin(*PYTHON_SUFFIXES), clean_python(t)).when(lang.isin(*CURLY_SUFFIXES), clean_curly(t)).otherwise(clean_text(t))


def clean_html(t: Column) -> Column:
    """Tags to blanks, runs of blanks and tabs to one, three or more line feeds to two, ends stripped."""
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(F.replace(t, F.lit(" "), F.lit(" ")), r"[ \t]+", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def fenced_code(t: Column) -> Column:
    """The last python fence, else the last fence, else the stripped text."""
    last = lambda p: F.try_element_at(F.regexp_extract_all(t, F.lit(p), F.lit(1)), F.lit(-1))
    python, fence = last(r"(?s)```python\s*(.*?)\s*```"), last(r"(?s)```\s*(.*?)\s*```")
    return F.coalesce(strip(python), strip(fence), strip(t))


def unprintable_ratio(t: Column) -> Column:
    """Share of bytes in the control class, continuation bytes of ordinary non-ASCII text included."""
    latin = F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")
    return F.when(F.octet_length(t) > 0, 1 - F.length(F.regexp_replace(latin, CONTROL, "")) / F.octet_length(t)).otherwise(0.0)


def path_suffix(p: Column) -> Column:
    return F.lower(F.regexp_extract(p, r"(\.[^./]+)$", 1))


def path_name(p: Column) -> Column:
    return F.regexp_extract(p, r"([^/]*)$", 1)


def path_stem(p: Column) -> Column:
    return F.regexp_replace(path_name(p), r"(?<=.)\.[^.]+$", "")


_SUFFIX_TYPES = {"markdown": (".md", ".markdown"), "code": (".py", ".cpp", ".c", ".h", ".hpp", ".java", ".js", ".ts", ".go", ".rs"), "json": (".json",), "html": (".html", ".htm")}


def doc_type_of(path: Column) -> Column:
    suffix, out = path_suffix(path), F.lit("txt")
    for kind, suffixes in _SUFFIX_TYPES.items():
        out = F.when(suffix.isin(*suffixes), kind).otherwise(out)
    return out


def chunk_id(doc_id: Column, start: Column, content: Column) -> Column:
    """16 hex digits of the SHA-256 of the document, the start and the first 64 characters."""
    return F.substring(F.sha2(F.concat(doc_id.cast("string"), F.lit(":"), start.cast("string"), F.lit(":"), F.substring(content, 1, 64)), 256), 1, 16)


