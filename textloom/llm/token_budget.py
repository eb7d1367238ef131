"""Token budget per slice: exact counts under an existing tokenizer, summed over cubes.

Texts are encoded where they are read; only keys, slices and counts are
shuffled, so a record delivered again is dropped after counting, cheaply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.language import LanguageModel, normalized_code
from textloom.llm.tokens import TokenizerSpec, with_token_counts

NONE, ALL = "(none)", "(all)"


def token_cube(df: DataFrame, keys: list[str], text_col: str, slices: list[str], tokenizer: TokenizerSpec, *, language: str | None = None, model: LanguageModel | None = None) -> DataFrame:
    """Totals of every combination of the slices: ``(slices..., records, usable, tokens, unknown_tokens)``.

    A record is one value of ``keys`` and counts once however often it was
    delivered.  ``usable`` counts records whose text is neither null nor blank;
    only their tokens are summed, since blank text trains nothing.  A null slice
    is ``(none)``, a slice summed over is ``(all)``.  With ``language`` the
    language of each text is detected by ``model`` and is the last slice.
    """
    blank = F.coalesce(F.length(F.trim(F.regexp_replace(text_col, r"[\s\x{A0}\x{200B}]+", " "))) == 0, F.lit(True))
    rows = df.select(*keys, *slices, blank.alias("_blank"), F.col(text_col).alias("_text"))
    counted = with_token_counts(rows, "_text", tokenizer, count="_tokens", unknown="_unknown", language=language, model=model)
    every = [*slices, language] if language else slices
    once = counted.groupBy(*keys).agg(F.min(F.struct("_blank", "_tokens", "_unknown", *every)).alias("v")).select("v.*")
    once = once.select(*(F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in every), "_blank", "_tokens", "_unknown")
    usable = ~F.col("_blank")
    cube = once.cube(*every).agg(
        F.count("*").alias("records"),
        F.count_if(usable).alias("usable"),
        F.coalesce(F.sum(F.when(usable, F.col("_tokens"))), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum(F.when(usable, F.col("_unknown"))), F.lit(0)).alias("unknown_tokens"),
    )
    return cube.select(*(F.coalesce(F.col(c), F.lit(ALL)).alias(c) for c in every), "records", "usable", "tokens", "unknown_tokens")


def document_budget(documents: DataFrame, tokenizer: TokenizerSpec) -> DataFrame:
    """Budget of documents by source, language (normalised) and domain (without regard to case)."""
    rows = documents.select("doc_id", "source", normalized_code(F.col("lang")).alias("lang"), F.lower(F.trim("domain")).alias("domain"), "text")
    return token_cube(rows, ["doc_id"], "text", ["source", "lang", "domain"], tokenizer)


def knowledge_budget(knowledge: DataFrame, tokenizer: TokenizerSpec) -> DataFrame:
    """Budget of knowledge documents by type and the language named in their metadata."""
    rows = knowledge.select("doc_id", F.lower(F.trim("doc_type")).alias("doc_type"), normalized_code(F.try_element_at("metadata", F.lit("lang"))).alias("lang"), "content")
    return token_cube(rows, ["doc_id"], "content", ["doc_type", "lang"], tokenizer)


def chat_budget(chat: DataFrame, statistics: DataFrame, tokenizer: TokenizerSpec, model: LanguageModel | None) -> DataFrame:
    """Budget of chat by batch, source and, with a ``model``, detected language, against the reported totals.

    On the rows of a whole batch ``reported_tokens`` is the batch's own figure
    and ``report`` says what it is worth: ``missing``, ``zero``, ``equal``,
    ``padded`` (a round multiple above the content) or ``different``.
    """
    cube = token_cube(chat.select("conv_id", "turn", "batch_id", "source", "content"), ["conv_id", "turn"], "content", ["batch_id", "source"], tokenizer, language="lang" if model else None, model=model)
    lang = ["lang"] if model else []
    own = statistics.groupBy(F.col("batch_id").alias("b")).agg(F.max("total_tokens").alias("reported_tokens"), F.max("total_conversations").alias("conversations"))
    whole = (F.col("source") == ALL) & (F.col("batch_id") != ALL) & (F.col("lang") == ALL if model else F.lit(True))
    reported = F.when(whole, F.col("reported_tokens"))
    report = (
        F.when(~whole, F.lit(None))
        .when(reported.isNull(), "missing")
        .when(reported == 0, "zero")
        .when(reported == F.col("tokens"), "equal")
        .when((reported > F.col("tokens")) & (reported % F.greatest("conversations", F.lit(1)) == 0), "padded")
        .otherwise("different")
    )
    return cube.join(own, cube.batch_id == own.b, "left").select("batch_id", "source", *lang, "records", "usable", "tokens", "unknown_tokens", reported.alias("reported_tokens"), report.alias("report"))


def token_budget(documents: DataFrame, knowledge: DataFrame, chat: DataFrame, statistics: DataFrame, tokenizer: TokenizerSpec, model: LanguageModel) -> DataFrame:
    """The three budgets in one table; slices a corpus does not have are null."""
    parts = [("documents", document_budget(documents, tokenizer)), ("knowledge_documents", knowledge_budget(knowledge, tokenizer)), ("chat_messages", chat_budget(chat, statistics, tokenizer, model))]
    columns = {"batch_id": "string", "source": "string", "lang": "string", "domain": "string", "doc_type": "string", "records": "bigint", "usable": "bigint", "tokens": "bigint", "unknown_tokens": "bigint", "reported_tokens": "bigint", "report": "string"}
    out = None
    for name, df in parts:
        row = df.select(F.lit(name).alias("corpus"), *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()))
        out = row if out is None else out.union(row)
    return out
