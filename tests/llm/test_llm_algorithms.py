"""The single-machine parts of the training-data operators against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import golay
from textloom.llm import chunking
from textloom.llm.chunking import split_points, valley_depth
from textloom.llm.language import LanguageModel, named_languages, prose
from textloom.llm.leakage import simhashes
from textloom.llm.packing import pack
from textloom.llm.pair_defects import declines, defects_of, is_copy, is_empty, is_truncated, split_question
from textloom.llm.refusals import masked, sentences_of
from textloom.llm.sketch import bit_sketch, distinct_shingles
from textloom.llm.split_overlap import align, winnow
from textloom.llm.textcore import U, Chars, Words, mix, slices, window_minima
from textloom.llm.tokens import PieceTokenizer

WORD = re.compile(r"[^\W_]+")
texts = st.lists(st.text(alphabet="ab_ Z9é日\n.ß\U0001d4d0", max_size=40), max_size=6)


@given(texts)
@settings(max_examples=60, deadline=None)
def test_words_equal_the_regular_expression(batch):
    words = Words(batch)
    flat = [w for t in batch for w in WORD.findall(t.lower())]
    assert words.count.tolist() == [len(WORD.findall(t.lower())) for t in batch]
    seen = {}
    for w, h in zip(flat, words.hash.tolist()):
        assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@given(st.text(max_size=60), st.integers(1, 9))
@settings(max_examples=60, deadline=None)
def test_window_hashes(text, width):
    h = Chars([text]).window_hashes(width).tolist()
    seen = {}
    for i, v in enumerate(h):
        assert seen.setdefault(text[i : i + width], v) == v
    assert len(set(seen.values())) == len(seen) and len(h) == max(0, len(text) - width + 1)


@given(st.lists(st.integers(0, 30), min_size=1, max_size=80), st.integers(1, 20))
@settings(max_examples=80, deadline=None)
def test_window_minima_keep_one_of_every_window(values, span):
    v = np.array(values, U)
    got = set(window_minima(v, span).tolist())
    for i in range(len(values) - span + 1):
        low = min(values[i : i + span])
        assert any(j in got and values[j] == low for j in range(i, i + span))


def test_slices_cover_everything():
    sizes = [5, 0, 100, 3, 3, 3, 50]
    parts = list(slices(sizes, 10))
    assert [i for p in parts for i in range(p.start, p.stop)] == list(range(len(sizes)))
    assert list(slices([], 10)) == []


def test_golay_keys_meet_within_two_bits():
    rng = random.Random(1)
    keys = lambda x: set(golay.fuzzy_keys(np.array([x]))[1].tolist())
    for _ in range(200):
        v = rng.getrandbits(23)
        a, b = rng.sample(range(23), 2)
        assert keys(v) & keys(v ^ 1 << a ^ 1 << b)
        assert len(keys(v)) in (1, 6)
    assert golay.fuzzy_keys(np.zeros(0, np.int64))[0].size == 0


def test_sketch_of_similar_texts_is_near():
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    edited = base[:40] + ["new"] + base[45:]
    other = [f"v{rng.randrange(500)}" for _ in range(150)]
    words = Words([" ".join(x) for x in (base, edited, other)])
    h, owner, _ = distinct_shingles(words, 3)
    bits = bit_sketch(h, owner, 3)
    off = lambda i, j: int(np.bitwise_count(bits[i] ^ bits[j]).sum())
    assert off(0, 1) < 40 < off(0, 2)


@pytest.mark.parametrize("window", [1, 2, 7, 12, 24, 300])
def test_simhashes_are_votes_of_words(window):
    rng = random.Random(11)
    words = Words([" ".join(f"w{rng.randrange(99)}" for _ in range(n)) for n in (400, 11, 0, 350)])
    prints, where = simhashes(words, window)
    bits = np.unpackbits(mix(words.hash ^ U(0x5EED)).view(np.uint8).reshape(-1, 8), axis=1).astype(int)
    assert len(where) == sum(max(0, n - window + 1) for n in (400, 11, 350))
    for p, i in list(zip(prints, where))[::37]:
        assert p == np.packbits(bits[i : i + window].sum(axis=0) > window // 2).view(U)[0]


def test_winnow_shares_a_seed_of_a_shared_run():
    rng = random.Random(3)
    run = [f"r{i}" for i in range(8)]
    for _ in range(50):
        a = [f"a{rng.random()}" for _ in range(rng.randrange(20))] + run + ["x"] * rng.randrange(5)
        b = ["y"] * rng.randrange(5) + run + [f"b{rng.random()}" for _ in range(rng.randrange(20))]
        w = Words([" ".join(a), " ".join(b)])
        h, where = winnow(w)
        text = w.text[where]
        assert set(h[text == 0].tolist()) & set(h[text == 1].tolist())


def test_alignment_covers_the_common_part():
    a, b = np.arange(50), np.concatenate([np.arange(100, 110), np.arange(10, 40), [7]])
    seeds = lambda x: (np.array([hash(tuple(x[i : i + 6].tolist())) for i in range(len(x) - 5)], np.int64), np.arange(max(0, len(x) - 5)))
    assert align(a, b, seeds(a), seeds(b)) == (30, 25)
    assert align(np.arange(3), np.arange(3), seeds(np.arange(3)), seeds(np.arange(3))) == (0, 0)
    words = Words([" ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(10, 50))])
    h, where = winnow(words)
    mine = [(h[words.text[where] == t], where[words.text[where] == t] - words.first[t]) for t in (0, 1)]
    assert align(words.hash[:60], words.hash[60:], *mine)[0] == 40


@given(st.text(alphabet="ab c.\n;}é", max_size=300), st.sampled_from(["markdown", "txt", "code", "html", "json", "unknown"]), st.integers(1, 60), st.integers(0, 70))
@settings(max_examples=150, deadline=None)
def test_pieces(text, kind, size, overlap):
    pieces = split_points(text, kind, size, overlap)
    eff = min(overlap, size - 1)
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and pieces[-1][2] == -2
    for a, b in zip(pieces, pieces[1:]):
        assert b[0] == a[1] - eff and b[1] > a[1]
    assert all(e - s <= size for s, e, _ in pieces)


def test_valleys_reach_the_nearest_peaks():
    alike = np.array([0.9, 0.5, 0.7, 0.2, 0.2, 0.6, 0.4, 0.8])
    want = []
    for i, low in enumerate(alike):
        a = b = i
        while a and alike[a - 1] >= alike[a]:
            a -= 1
        while b + 1 < len(alike) and alike[b + 1] >= alike[b]:
            b += 1
        want.append(alike[a] - low + alike[b] - low)
    assert np.allclose(valley_depth(alike), want) and valley_depth(np.zeros(1)).tolist() == [0]


@pytest.mark.parametrize(("one", "two", "stop"), [("the heap keeps its keys in order", "a river runs over old stones", ". "), ("堆保存最小的键并移动其他键", "河水流过古老的石头和树林", "。")])
def test_cuts_fall_where_the_topic_changes(one, two, stop):
    text = (one + stop) * 12 + (two + stop) * 12
    change = len(one + stop) * 12
    pieces = split_points(text, "txt", change + len(two + stop) * 5, 0)
    assert pieces[0][1] == change


def test_long_texts_are_compared_in_slabs(monkeypatch):
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(50)}" for _ in range(3000))
    at = np.array([i + 1 for i, c in enumerate(text) if c == " "])
    whole = chunking.cohesion_depth(text, at)
    monkeypatch.setattr(chunking, "_SLAB_WORDS", 100)
    assert np.allclose(whole, chunking.cohesion_depth(text, at))


def test_pieces_end_at_boundaries():
    text = "One paragraph about heaps and heaps.\n\n" * 3 + "Another about graphs and edges.\n\n" * 3
    pieces = split_points(text, "txt", 120, 10)
    assert all(text[e - 2 : e] == "\n\n" for _, e, level in pieces[:-1] if level == 0) and pieces[0][2] == 0
    assert [p[2] for p in split_points("x" * 250, "txt", 100, 0)] == [-1, -1, -2]


@given(st.lists(st.integers(1, 100), max_size=120))
@settings(max_examples=80, deadline=None)
def test_packing_fits(sizes):
    where = pack(np.array(sizes, np.int64), 100)
    filled = np.bincount(where, sizes) if sizes else np.zeros(0)
    assert (filled <= 100).all() and len(filled) <= 2 * sum(sizes) / 100 + 1
    # no two sequences could be one: a new one is opened only when none has room
    assert sum(sorted(filled)[:2]) > 100 or len(filled) < 2


def test_tokenizer_equals_its_definition():
    merges = [("a", "b"), (" ", "c"), ("ab", "a"), ("b", "a"), ("d", "d")]
    tokenizer = PieceTokenizer(frozenset([*"abcd .\n", "ab", " c", "aba", "dd"]), {p: i for i, p in enumerate(merges)})

    def slow(text):
        out = []
        for piece in re.findall(r" ?[^\W\d_]+|.", text, re.S):
            parts = list(piece) if piece.strip() and piece[-1].isalpha() else [piece]
            while pairs := [(tokenizer.ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in tokenizer.ranks]:
                i = min(pairs)[1]
                parts[i : i + 2] = ["".join(parts[i : i + 2])]
            out += [p if p in tokenizer.vocabulary else "<unk>" for p in parts]
        return out

    rng = random.Random(4)
    samples = ["".join(rng.choice("abcd .\nZ7_é") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", *("".join(rng.choice("abd") for _ in range(n)) for n in (25, 60, 200))]
    tokens, unknown = tokenizer.counts(samples)
    for t, n, u in zip(samples, tokens, unknown):
        want = slow(t)
        assert tokenizer.encode(t) == want and (n, u) == (len(want), want.count("<unk>"))


def defect_of(ask, given_input, answer, model):
    """The defect of a pair whose template has too few prompts to be judged by its use."""
    d = defects_of([ask], [given_input or ""], [answer], model)[0]
    return "refusal" if d not in ("empty", "copy") and declines(sentences_of(answer)) else d


@pytest.mark.parametrize(
    ("ask", "given_input", "answer", "want"),
    [
        ("What is a heap?", None, None, "empty"),
        ("What is a heap?", None, " \n​", "empty"),
        ("What is a heap?", None, "```\n```", "empty"),
        ("What is a heap?", None, "N/A", "empty"),
        ("What is a heap?", None, "<p></p>", "empty"),
        ("Is it sorted?", None, "True", None),
        ("How fast is it?", None, "O(n log n)", None),
        ("What is a heap?", None, "A heap is a tree in which every parent is at least", "truncated"),
        ("What is a heap?", None, "A heap is a tree that keeps its largest element at the root.", None),
        ("Write it.", None, "Here it is.\n```python\ndef f(x):\n    return x\n", "truncated"),
        ("Write it.", None, "def f(x):\n    y = x + 1\n    return y", None),
        ("Write it.", None, "def f(x):\n    y = g(x", "truncated"),
        ("Write it.", None, "int f(int x) {\n    return x;\n}", None),
        ("What is a heap?", None, "I'm sorry, but I can't help with that.", "refusal"),
        ("Was ist das?", None, "Dazu möchte ich mich nicht äußern. Bitte frag etwas anderes.", "refusal"),
        ("¿Qué es esto?", None, "NO PUEDO AYUDAR CON ESO.", "refusal"),
        ("为什么?", None, "抱歉,我无法回答这个问题。", "refusal"),
        ("What is a heap?", None, "I can't stress enough that a heap is not sorted. It only orders parents.", None),
        ("What is a heap?", None, "Sorry for the long list, but the heap needs it. It orders parents.", None),
        ("What is a heap?", None, 'Sure! "WHAT IS A HEAP"', "copy"),
        ("Explain this.", "x = 1", "Q: explain this.\n\nInput:\nx = 1", "copy"),
        ("What is a heap?", None, "What is a heap? It is a tree ordered by its parents.", None),
        ("How does the heap keep its order when a key is removed?", None, "Man kann die Liste nicht ohne den Baum speichern, und das ist auch nicht nötig.", "language"),
        ("Translate this note into German.", "The heap is a tree.", "Die Halde ist ein Baum, und das ist nicht schwer zu sehen.", None),
        ("请解释heap_map如何写入数据?", None, "The heap writes each of its keys to the map and then returns.", "language"),
        ("Schreibe eine Funktion, um die Werte zu sortieren.", None, "def sort_values(values):\n    # The values are sorted in place.\n    values.sort()\n    return values", None),
    ],
)
def test_defects(ask, given_input, answer, want, model):
    assert defect_of(ask, given_input, answer, model) == want


def test_defect_helpers(model):
    assert is_empty("") and is_empty("...") and not is_empty("0") and not is_empty("x" * 500)
    assert not declines([]) and not is_copy("", "", "anything") and not is_truncated("Done.")
    assert split_question("Do it.\n\nInput:\nx") == ("Do it.", "x") and split_question("Do it.") == ("Do it.", "")
    assert masked("I cannot assist with foo_bar.") == masked("I cannot assist with bar9.") == "i cannot assist with x"
    assert masked("O(n log n)") is None and masked("True") is None and masked("return f(x);") is None and masked("这个请求超出了我的能力范围。") == " ".join("这个请求超出了我的能力范围")
    assert model.detect(["", "x", "日"]) == [None] * 3 and model.detect([]) == [] and LanguageModel.of_texts({}).detect(["The heap is a tree of keys."]) == [None]
    assert named_languages("Übersetze das ins Englische.") == {"en"} and named_languages("用中文回答") == {"zh"}
    assert "return" not in prose("Text here.\n\ndef f(x):\n    return x\n")
    assert not is_truncated("word " * 100_000 + "end.")


def test_defects_of_long_answers(model):
    refusal = " ".join(["I'm sorry, but I can't help with that."] * 12)
    assert len(refusal) > 400 and declines(sentences_of(refusal)) and defect_of("What is a heap?", None, refusal, model) == "refusal"
    for start in ("\n", " ", "**"):
        assert is_empty(start + '<div class="answer body"><div class="inner"><p id="first"></p><p id="second"></p></div></div>')
    assert not is_empty("<b>" + "word " * 50 + "</b>") and is_empty("N/A" + " ." * 60)


@pytest.mark.parametrize("line", ["import os", "from os import path", "SELECT name", "std::sort", "    return value", "]", "def name"])
def test_code_without_other_signs_is_no_prose(line):
    assert "value" not in prose(f"Text here.\n\n{line}\nvalue\n{line}") and "Text here." in prose(f"Text here.\n\n{line}")
