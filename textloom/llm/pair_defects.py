"""Broken prompt and response pairs: empty, truncated, refusal, copy, language.

The openings of answers are masked and clustered by verified MinHash; a template
that recurs across unrelated prompts and is never followed by anything of the
answer's own reveals a refusal (``refusals``).  Copy, language and termination
checks label the remaining defects.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import strip
from textloom.llm.language import _HAN, _IDENTIFIER, CODE_LINE, LanguageModel, named_languages, prose
from textloom.llm.refusals import MIN_PROMPTS, masked, refusal_sentences, sentence_id, sentences_of
from textloom.llm.textcore import U, Words, mix, signed, slices
from textloom.session import materialize

# fixed values: what people write where an answer is missing
PLACEHOLDERS = frozenset("n/a na none null nil nan tbd todo tba undefined empty blank placeholder noanswer noresponse nooutput noinput notavailable notapplicable missing void leer keine keineantwort vacío vacio nada ninguna ninguno sinrespuesta nbsp br vide rien néant aucune aucun sansréponse 无 空 暂无 没有 待定 无答案".split())
# fixed values: common wordings of a refusal in five languages; they decide only where a template has too few prompts to be judged by its use
DECLINE = re.compile(
    r"|".join(
        (
            r"\bi(?:'m| am)? (?:can(?:not|'t)|could(?:n't| not)|won't|will not|do(?:n't| not)|must not|may not|am unable to|'m unable to|am not able to|'m not able to)(?: be able to)?(?: \w+)? (?:help|assist|answer|comply|provide|produce|discuss|complete|do|talk|write|share|give|support|fulfil|fulfill|respond|continue|feel comfortable|engage|generate|create|offer|tell|open|inspect|say)\b",
            r"\bi(?:'m| am) (?:not (?:allowed|permitted|able|comfortable|in a position)|unable)\b",
            r"\bi(?: must|'ll have to| have to| need to)? (?:decline|refuse|pass on)\b|\bi(?:'d| would) rather not\b|\b(?:isn't|is not) something i (?:can|could|will|may)\b",
            r"\b(?:my|the) (?:guidelines|rules|policy|policies|instructions)\b.*\b(?:do not|don't|forbid|prohibit|prevent)\b|\bagainst (?:the|my) (?:rules|guidelines|policy|policies)\b|\b(?:beyond|outside)(?: of)? (?:my|what i)\b",
            r"\bas an? (?:ai|language model|assistant|ai language model)\b.*\b(?:not|unable|cannot|can't|no)\b",
            # German
            r"\b(?:ich (?:kann|darf|werde|möchte|will)|(?:möchte|kann|darf|muss|werde|will) ich)\b.*\b(?:nicht|keine?n?|ablehnen|passen|verzichten)\b|\bich muss\b.*\b(?:ablehnen|passen)\b|\bals (?:sprachmodell|ki|assistent)\b.*\b(?:nicht|keine?)\b|\büber(?:steigt|schreitet)\b.*\b(?:meine|mir|ich)\b",
            # Spanish
            r"\bno (?:puedo|podré|voy a|debo|soy capaz|estoy autorizad[oa]|me está permitido|me es posible)\b|\b(?:debo|tengo que|prefiero) (?:rechazar|declinar|no)\b|\bfuera de mi(?:s|) (?:alcance|posibilidades)\b",
            # French
            r"\bje (?:ne|n')\s?(?:peux|puis|suis|saurais|veux|dois|pourrai|souhaite)\b.*\b(?:pas|juger|aucune?)\b|\bje (?:ne|n')\s?\w+rai (?:pas|aucune?|rien)\b|\bje (?:préfère|dois)\b.*\b(?:ne pas|refuser|décliner)\b|\bje (?:refuse|décline)\b|\bm'est (?:interdit|impossible)\b|\bdépasse mes\b",
        )
    )
)
DECLINE_HAN = re.compile(r"(?:我|本人|本助手|作为).{0,12}(?:无法|不能|不便|不会|不可以|拒绝|无权|不愿|不想)|超出了?我的|无法(?:回答|提供|协助|帮助|完成)(?:您|你|这|该|此|关于)")
# fixed values: sentences that send the reader elsewhere after a refusal, and apologies
REDIRECT = re.compile(
    r"\b(?:please )?(?:ask|try)\b.*\b(?:another|else|instead|different|other)\b|\bposez une autre\b|\bbitte frag|\bpregunt[ae]\b.*\botra?\b|\b(?:sorry|apologies|lo siento|désolée?|tut mir leid|entschuldigung)\b|\blet me know\b|(?:抱歉|对不起|很遗憾|不好意思)|请换一?个?|其他问题|别的问题"
)
NOT_DECLINING = re.compile(r"\b(?:stress|emphasi[sz]e|recommend|thank) enough\b|\bsorry (?:for|about)\b|\bwhich is why\b")
_WORD = re.compile(r"[^\W_]+")
_BARE = re.compile(r"[^\w]|_")
_LONGER = re.compile(r"(?:[\W_]*+[^\W_]){%d}" % (max(map(len, PLACEHOLDERS)) + 1))
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|```\w*")
_END = re.compile(r"(?:[.!?。！？]|</\w+>|```|\*\*|\}|\|)[\s\"'”’»)\]*_`）】》]*$")
_CLOSED = re.compile(r"</\w+>$")
_CODE_START = re.compile(r"(?:^|\n)[ \t]*(?:def |class |func |fn |export |function |std::|pub |SELECT\b|CREATE\b|WITH\b|INSERT\b|//|#include|package |import |from \w+ import|-- |#!)")
_STRING = re.compile(r"\"\"\".*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_COMMENT = re.compile(r"(?m)//.*$|(?<=\s)#.*$|--\s.*$")
LEAD_IN_WORDS = 6
DEFECTS = ("empty", "refusal", "copy", "truncated", "language")


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    bare = _TAG.sub("", answer) if "<" in answer or "`" in answer else answer
    if _LONGER.match(bare):
        return False  # more letters and digits than any placeholder
    bare = _BARE.sub("", bare.replace("​", "")).lower()
    return not bare or bare in PLACEHOLDERS or answer.strip().lower().strip(" .!()[]<>*_-") in PLACEHOLDERS


def declines(sentences: list[str]) -> bool:
    """All of an answer reads like a refusal: one sentence is worded so and the others add nothing else."""
    no = False
    for sentence in sentences:
        s = sentence.lower().replace("’", "'")
        if not NOT_DECLINING.search(s) and (DECLINE.search(s) or DECLINE_HAN.search(s)):
            no = True
        elif not REDIRECT.search(s):
            return False
    return no


def _words(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


def _last_word(text: str) -> str | None:
    """The last word, looked for from the end; a very long last word is compared by its end."""
    found = _WORD.findall(text[-200:].casefold())
    if found or len(text) <= 200:
        return found[-1][-50:] if found else None
    found = _words(text)
    return found[-1][-50:] if found else None


def is_copy(instruction: str, given: str, answer: str) -> bool:
    """Only the question again, alone or with its input, after at most ``LEAD_IN_WORDS`` other words."""
    end = _last_word(answer)
    if end is None or end not in (_last_word(instruction), _last_word(given)):
        return False
    own = _words(answer)
    ask = _words(instruction)
    if not ask or len(own) < len(ask):
        return False
    rest = _words(given)
    for want in (ask, *((ask + rest, [*ask, "input", *rest]) if rest else ())):
        extra = len(own) - len(want)
        if 0 <= extra <= LEAD_IN_WORDS and own[extra:] == want:
            return True
    return False


def _open_code(code: str) -> bool:
    """Brackets or strings left open, outside comments and strings."""
    bare = _COMMENT.sub("", _STRING.sub('""', code))
    if '"' in bare.replace('""', ""):
        return True
    depth = {"(": 0, "[": 0, "{": 0}
    match = {")": "(", "]": "[", "}": "{"}
    for c in bare:
        if c in depth:
            depth[c] += 1
        elif c in match:
            depth[match[c]] -= 1
    return any(n > 0 for n in depth.values())


def _python_unfinished(code: str) -> bool:
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return True
    last = tree.body[-1] if tree.body else None
    if not isinstance(last, (ast.FunctionDef, ast.AsyncFunctionDef)):
        return False
    end = last.body[-1]
    if not any(isinstance(n, (ast.Return, ast.Raise, ast.Yield)) for n in ast.walk(last)) or not isinstance(end, (ast.Return, ast.Raise)):
        return True
    if isinstance(end, ast.Return) and isinstance(end.value, ast.Name):
        known = {a.arg for a in ast.walk(last) if isinstance(a, ast.arg)} | {n.id for n in ast.walk(last) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
        return end.value.id not in known
    return False


def is_truncated(answer: str) -> bool:
    """Stops inside a sentence, inside a fence, or inside unfinished code."""
    text = answer.rstrip()
    last = text.rpartition("\n")[2].lstrip()
    if text.endswith((".", "!", "?", "。", "！", "？")) and not text.endswith("...") and not last.startswith(("//", "#", "--", "\"\"\"")):
        return False  # a full stop ends an answer, whatever stands before it
    if text.count("```") % 2:
        return True
    if text.endswith("```") or _CLOSED.search(text):
        return False
    tail = text[text.rfind("```") + 3 :] if "```" in text else text
    start = _CODE_START.search(tail)
    if start:
        code = tail[start.start() :].lstrip("\n")
        lines = [line for line in code.split("\n") if line.strip()]
        # prose after the code ends the answer as prose does
        if lines and (CODE_LINE.match(lines[-1]) or lines[-1][:1].isspace() or len(lines) == 1 or not _END.search(text)):
            head = next((line for line in lines if not line.lstrip().startswith(("//", "#", "--"))), lines[0]).lstrip()
            if head.startswith(("def ", "class ", "import ", "from ", "async ", "@")) and "{" not in lines[-1] and not head.endswith((";", "{")):
                return _python_unfinished(code)
            if re.match(r"(?:SELECT|CREATE|WITH|INSERT|UPDATE|DELETE)\b", head) or code.startswith("--"):
                return not text.endswith(";")
            return _open_code(code) or not text.endswith(("}", ";", ")"))
    if _END.search(text):
        return text.endswith(("...", "…"))
    words = len(_words(tail))
    han = len(_HAN.findall(tail))
    if len(tail.split()) <= 5 and tail[-1:] in ")]\"'" and not _open_code(tail):
        return False  # a short value such as a list or a formula
    return words >= 4 or han >= 8


def split_question(text: str) -> tuple[str, str]:
    """A user message to (instruction, input): an input may follow a blank line, with or without a label."""
    for mark in ("\n\nInput:\n", "\n\ninput:\n", "\n\nInput: "):
        if mark in text:
            a, _, b = text.partition(mark)
            return a, b
    a, _, b = text.partition("\n\n")
    return a, b


def defects_of(asks: list[str], givens: list[str], answers: list[str | None], model: LanguageModel) -> list[str | None]:
    """The one defect of each pair, or None; refusals are not looked for here."""
    out: list[str | None] = []
    for ask, given, answer in zip(asks, givens, answers):
        out.append("empty" if is_empty(answer) else "copy" if is_copy(ask, given, answer) else "truncated" if is_truncated(answer) else None)
    sound = [i for i, d in enumerate(out) if d is None]
    bodies = [prose(answers[i]) for i in sound]
    theirs = model.detect(bodies)
    known = [(i, lang) for i, lang in zip(sound, theirs) if lang]
    ours = model.detect([prose(asks[i]) for i, _ in known])
    for (i, lang), own in zip(known, ours):
        if own and own != lang and lang not in named_languages(asks[i]):
            out[i] = "language"
    return out


def question_answer_pairs(records: DataFrame, chat: DataFrame) -> DataFrame:
    """``(record_key, turn, instruction, given, answer)`` of both tables, each pair once.

    An answer in chat is a message of role assistant, gpt or bot (without regard
    to case and outer blanks); its question is the message of the turn before.
    The join is on conversation and turn, so one huge conversation is spread like any other.
    """
    own = records.select(F.col("record_id").alias("record_key"), F.lit(0).cast("bigint").alias("turn"), "instruction", F.col("input").alias("given"), F.col("output").alias("answer"), F.lit(False).alias("chat"))
    own = own.where("record_key is not null").dropDuplicates(["record_key"])
    m = chat.select("conv_id", "turn", F.lower(strip(F.col("role"))).isin("assistant", "gpt", "bot").alias("answers"), "content").where("conv_id is not null and turn is not null")
    answers = m.where("answers").select(F.col("conv_id").alias("record_key"), "turn", F.col("content").alias("answer"))
    questions = m.select(F.col("conv_id").alias("q"), (F.col("turn") + 1).alias("t"), F.col("content").alias("instruction"))
    pairs = answers.join(questions, (answers.record_key == questions.q) & (answers.turn == questions.t)).dropDuplicates(["record_key", "turn"])
    return own.union(pairs.select("record_key", "turn", "instruction", F.lit(None).cast("string"), "answer", F.lit(True)))


def _judge(model):
    """One row of each pair: its defect so far, and what the search for refusal templates needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks, givens, answers, chat = (batch.column(i).to_pylist() for i in range(2, 6))
            split = [split_question(a or "") if c else (a or "", g or "") for a, g, c in zip(asks, givens, chat)]
            defects = defects_of([a for a, _ in split], [g for _, g in split], answers, model.value)
            first, second, count, tail, cue = [], [], [], [], []
            for answer, defect in zip(answers, defects):
                sentences = [] if defect in ("empty", "copy") else list(dict.fromkeys(sentences_of(answer)))
                opening = masked(sentences[0]) if sentences else None
                n = len(sentences)
                first.append(opening)
                second.append(masked(sentences[1]) if opening and n == 2 else None)
                count.append(n)
                tail.append("\n".join(sentences[1:]) if opening and n > 2 else None)
                cue.append(declines(sentences))
            columns = [pa.array(defects, pa.string()), pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array(count, pa.int32()), pa.array(tail, pa.string()), pa.array(cue, pa.bool_()), pa.array(prompt_ids([a for a, _ in split]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[c.split()[0] for c in _JUDGED.split(", ")])

    return run


_JUDGED = "record_key string, turn bigint, defect string, first string, second string, sentences int, tail string, cue boolean, prompt bigint"


def prompt_ids(asks: list[str]) -> np.ndarray:
    """Identity of each masked prompt, so that prompts that differ in names only count as related."""
    out = np.zeros(len(asks), U)
    for part in slices([len(a) for a in asks]):
        words = Words([_IDENTIFIER.sub("x", a) for a in asks[part]])
        np.bitwise_xor.at(out, words.text + part.start, words.hash)
    return signed(mix(out))


def _tail_sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record_key, turn, s) of every sentence after the first; null for one that is no sentence."""
    for batch in batches:
        row, out = [], []
        for i, tail in enumerate(batch.column(2).to_pylist()):
            for s in sentences_of(tail):
                row.append(i)
                out.append(masked(s))
        take = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(out, pa.string())], names=["record_key", "turn", "s"])


def broken_pairs(records: DataFrame, chat: DataFrame, model: LanguageModel, *, min_prompts: int = MIN_PROMPTS) -> DataFrame:
    """``(record_key, turn, defect)`` of the broken pairs of both tables; each has one defect.

    An answer is a refusal if it opens with a template that recurs across
    ``min_prompts`` or more unrelated prompts and is followed by nothing but
    closing templates (``refusals.refusal_sentences``), and if nothing else
    follows it here.  Templates with too few prompts to be judged count if the
    whole answer is worded like a refusal (``declines``).  A refusal is neither
    truncated nor in another language.  Null questions count as empty ones, null
    answers as empty answers.  Pairs delivered again count once; empty tables
    give an empty result.
    """
    shared = records.sparkSession.sparkContext.broadcast(model)
    judged = materialize(question_answer_pairs(records, chat).mapInArrow(_judge(shared), _JUDGED), "judged")
    closers, openings = refusal_sentences(judged, min_prompts=min_prompts)
    openings = materialize(openings, "openings")
    ending = materialize(closers.union(openings.where("refuses").select("sid")).distinct(), "ending")
    pairs = judged.drop("tail").withColumns({"sid": sentence_id(F.col("first")), "next": sentence_id(F.col("second"))})
    opened = pairs.join(openings, "sid", "left").join(ending.select(F.col("sid").alias("next"), F.lit(True).alias("ended")), "next", "left")
    # answers of more sentences that open with a refusal: all the others must be endings
    tails = judged.where("tail is not null").withColumn("sid", sentence_id(F.col("first"))).join(openings.where("refuses"), "sid", "left_semi")
    tails = tails.select("record_key", "turn", "tail").mapInArrow(_tail_sentences, "record_key string, turn bigint, s string")
    known = tails.withColumn("sid", F.when(F.col("s").isNotNull(), sentence_id(F.col("s")))).join(ending.withColumn("ended", F.lit(True)), "sid", "left")
    clean = known.groupBy("record_key", "turn").agg(F.every(F.coalesce("ended", F.lit(False))).alias("clean"))
    nothing_else = (F.col("sentences") == 1) | F.col("second").isNotNull() & F.coalesce("ended", F.lit(False)) | F.coalesce("clean", F.lit(False))
    refuses = F.when(F.col("refuses"), nothing_else | F.col("cue")).otherwise(F.col("cue") & F.col("refuses").isNull())
    defect = F.when(refuses, F.lit("refusal")).otherwise(F.col("defect"))
    return opened.join(clean, ["record_key", "turn"], "left").select("record_key", "turn", defect.alias("defect")).where("defect is not null")
