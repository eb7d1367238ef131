"""The training-data operators on Spark: brute force on small fixtures, and the awkward cases."""

import hashlib
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from textloom.llm.components import connected_components
from textloom.llm.chunking import split_oversized
from textloom.llm import leakage
from textloom.llm.leakage import leaked_items
from textloom.llm.mixing import mix_to_weights, mixture_shares
from textloom.llm import near_duplicates
from textloom.llm.near_duplicates import group_pairs, near_duplicate_groups
from textloom.llm.packing import pack_documents
from textloom.llm.language import LanguageModel, fit_language_model
from textloom.llm.pair_defects import broken_pairs
from textloom.llm.refusals import refusal_sentences, sentence_id
from textloom.llm.shared_spans import shared_spans
from textloom.llm import shared_spans as spans_module
from textloom.llm.split_overlap import split_overlaps
from textloom.llm import split_overlap as overlap_module
from textloom.llm.token_budget import document_budget, chat_budget, knowledge_budget
from textloom.llm.tokens import TokenizerSpec, tokenizer_from_tables, with_token_counts

from samples import SAMPLES

TOKENIZER = TokenizerSpec("pieces", vocabulary=tuple("abcdefghijklmnopqrstuvwxyz ."), merges=(("a", "b"),))


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edit(rng, w, share):
    return [f"n{rng.randrange(10**6)}" if rng.random() < share else x for x in w]


def shingles(text, k):
    w = text.lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def similarity(a, b, k=3):
    x, y = shingles(a, k), shingles(b, k)
    return len(x & y) / len(x | y) if x | y else 0.0


def groups_of(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), []).append(n)
    return {p for g in out.values() for p in combinations(sorted(g), 2)}


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    rows = {}
    for i in range(25):
        base = words(rng, rng.randrange(40, 120))
        rows[f"b{i}"] = " ".join(base)
        for j in range(rng.randrange(4)):
            changed = edit(rng, base, 0.04)
            if j == 1:
                cut = len(changed) // 2
                changed = changed[cut:] + changed[:cut]
            rows[f"b{i}-{j}"] = " ".join(changed)
    rows["same1"] = rows["same2"] = rows["b0"]
    return rows


def test_near_duplicates_equal_brute_force(spark, copies):
    rows = [(k, t, "x") for k, t in copies.items()] + [("b0", copies["b0"], "again"), ("none", None, "x"), ("empty", "", "x"), ("short", "a b c", "x"), (None, "a " * 50, "x"), ("long", "z " * 200_000, "x")]
    df = spark.createDataFrame(rows, "id string, body string, tid string")
    found = near_duplicate_groups(df, "id", "body", threshold=0.5, min_words=30, shingle_words=3)
    keys = sorted(copies)
    want = groups_of(keys, [(a, b) for a, b in combinations(keys, 2) if similarity(copies[a], copies[b]) >= 0.5])
    assert {tuple(r) for r in group_pairs(found).collect()} == want and len(want) > 30
    got = {r.id: r for r in found.collect()}
    assert not {"none", "empty", "short", None} & set(got) and got["long"].links == 0
    assert got["same1"].tid == got["b0"].tid


def test_hot_anchors_are_split(spark, copies, monkeypatch):
    """With tiny limits every key is hot; groups are still found, through split keys and leaders."""
    monkeypatch.setattr(near_duplicates, "HOT", 1)
    monkeypatch.setattr(near_duplicates, "GROUP", 2)
    df = spark.createDataFrame(list(copies.items()), "id string, body string")
    found = {tuple(r) for r in group_pairs(near_duplicate_groups(df, "id", "body", threshold=0.5, min_words=30, shingle_words=3)).collect()}
    keys = sorted(copies)
    want = groups_of(keys, [(a, b) for a, b in combinations(keys, 2) if similarity(copies[a], copies[b]) >= 0.5])
    assert found <= want and len(found) >= 0.9 * len(want)


def test_links_of_a_hot_family_are_all_found(spark, monkeypatch):
    """Every pair of a family whose anchors and keys are hot is a link, not only those with one leader."""
    monkeypatch.setattr(near_duplicates, "HOT", 20)
    monkeypatch.setattr(near_duplicates, "GROUP", 8)
    monkeypatch.setattr(near_duplicates, "BLOCK", 16, raising=False)
    rng = random.Random(23)
    base = words(rng, 150)
    rows = [(i, " ".join([*base[: i * 2], f"own{i}", *base[i * 2 + 1 :]])) for i in range(70)]
    links = {r.id: r.links for r in near_duplicate_groups(spark.createDataFrame(rows, "id int, t string"), "id", "t", threshold=0.5, min_words=30, shingle_words=3).collect()}
    assert links == dict.fromkeys(range(70), 69)


def test_far_variants_of_a_hot_family_are_met(spark, monkeypatch):
    """Variants similar to the family have few of its hot anchors; all their other anchors are their own."""
    monkeypatch.setattr(near_duplicates, "HOT", 20)
    rng = random.Random(24)
    base = words(rng, 180)
    rows = [(i, " ".join([*base[: i * 4], f"own{i}", *base[i * 4 + 1 :]])) for i in range(40)]
    rows += [(100 + v, " ".join(f"v{v}n{k}" if k % 10 == v % 10 else w for k, w in enumerate(base))) for v in range(60)]
    assert all(similarity(rows[0][1], t) >= 0.5 for _, t in rows)
    groups = near_duplicate_groups(spark.createDataFrame(rows, "id int, t string"), "id", "t", threshold=0.5, min_words=30, shingle_words=3)
    assert groups.select("group_id").distinct().count() == 1


def test_default_similarity(spark):
    rng = random.Random(6)
    base = words(rng, 200)
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join([*base[:100], "new", *base[100:]])), (3, " ".join(words(rng, 200)))], "id int, t string")
    got = {r.id: r.links for r in near_duplicate_groups(df, "id", "t").collect()}
    assert got == {1: 1, 2: 1, 3: 0}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id string, t string")
    assert near_duplicate_groups(none, "id", "t").count() == 0
    assert shared_spans(none, "id", "t").count() == 0
    settings = spark.createDataFrame([("txt", 10, 2)], "doc_type string, chunk_size int, chunk_overlap int")
    assert split_oversized(none.withColumn("k", F.col("t")), "id", "t", "k", settings).count() == 0
    items = spark.createDataFrame([], "task_id string, prompt string, test_cases array<string>")
    assert leaked_items(none, "id", "t", items, "task_id", ["prompt", "test_cases"]).count() == 0
    assert leaked_items(none.union(spark.createDataFrame([("a", "x " * 50)], "id string, t string")), "id", "t", items, "task_id", ["prompt"]).count() == 0
    samples = spark.createDataFrame([], "sample_id string, dataset_name string, split_name string, source string, content string")
    configs = spark.createDataFrame([], "dataset_name string, train_split string, val_split string, test_split string")
    assert split_overlaps(samples, configs).count() == 0
    records = spark.createDataFrame([], "record_id string, instruction string, input string, output string")
    chat = spark.createDataFrame([], "conv_id string, turn bigint, role string, content string")
    assert broken_pairs(records, chat, LanguageModel.of_texts({})).count() == 0
    docs = spark.createDataFrame([], "doc_id bigint, domain string, n_tokens bigint")
    plans = spark.createDataFrame([("e", 1.0, 1, {"x": 1.0}, 10)], "experiment_id string, size_factor double, max_repeats int, dataset_weights map<string,double>, max_sequence_length int")
    assert mix_to_weights(docs, plans).count() == 0 and pack_documents(docs.select("doc_id", "n_tokens"), plans).count() == 0
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100), (200, 200), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[100], got[101], got[102]} == {100} and got[200] == 200


@pytest.mark.parametrize("hot", [1000, 1])
def test_shared_spans_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spans_module, "HOT", hot)
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefgh é日") for _ in range(n))
    passage = noise(340)
    rows = {1: noise(200) + passage + noise(150), 2: passage[:300] + noise(100), 3: noise(50) + passage[:299] + "#" + noise(60), 4: passage[20:] + noise(30), 5: noise(500), 6: noise(301), 8: noise(20), 9: "z" * 900}
    rows[7] = rows[6]
    table = [(k, v, 0) for k, v in rows.items()] + [(1, rows[1], 0), (10, None, 0), (11, "", 0), (None, passage, 0)]
    got = {r.id: ([(s.begin, s.end) for s in r.spans], r.shared_chars) for r in shared_spans(spark.createDataFrame(table, "doc_id int, text string, tid int"), "doc_id", "text").collect()}
    owners = {}
    for k, t in rows.items():
        for i in range(len(t) - 299):
            owners.setdefault(t[i : i + 300], set()).add(k)
    want = {}
    for k, t in rows.items():
        covered = sorted({j for i in range(len(t) - 299) if len(owners[t[i : i + 300]]) > 1 for j in range(i, i + 300)})
        if covered:
            want[k] = len(covered)
    assert {k: n for k, (_, n) in got.items()} == want and set(want) == {1, 2, 4, 6, 7}
    assert got[1][0] == [(200, 540)]


def test_shared_spans_around_a_hot_notice(spark, monkeypatch):
    """Only one of two texts has the whole hot notice; both share its tail and rare text behind it."""
    monkeypatch.setattr(spans_module, "HOT", 10)
    rng = random.Random(21)
    noise = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    notice = noise(700)
    rows = [(f"n{i}", f"{noise(200)}<{notice}>{noise(200)}") for i in range(25)]
    for i in range(150):
        tail = rng.randrange(120, 280)
        shared = notice[-tail:] + noise(330 - tail)
        rows += [(f"a{i}", f"{noise(200)}<{notice[:-tail]}{shared}>{noise(100)}"), (f"b{i}", f"{noise(200)}#{shared}#{noise(100)}")]
    got = {r.id: [(s.begin, s.end) for s in r.spans] for r in shared_spans(spark.createDataFrame(rows, "id string, t string"), "id", "t").collect()}
    assert {k: v for k, v in got.items() if k[0] == "b"} == {f"b{i}": [(201, 531)] for i in range(150)}
    assert {f"a{i}" for i in range(150)} <= set(got)


def test_a_third_of_all_rows_is_one_text(spark):
    """Hot copies: one class, one span, and no more work than their number."""
    rng = random.Random(12)
    hot = " ".join(words(rng, 120))
    rows = [(i, hot if i % 3 == 0 else " ".join(words(rng, 120))) for i in range(600)] + [(1000, " ".join(edit(rng, hot.split(), 0.03)))]
    df = spark.createDataFrame(rows, "id int, t string")
    groups = near_duplicate_groups(df, "id", "t", threshold=0.5, min_words=30, shingle_words=3)
    sizes = sorted(r["count"] for r in groups.groupBy("group_id").count().collect())
    assert sizes[-1] == 201 and set(sizes[:-1]) == {1}
    assert shared_spans(df, "id", "t").count() in (200, 201)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(8)
    fields = {"a": words(rng, 20), "b": words(rng, 11), "c": words(rng, 40), "d": words(rng, 14)}
    fields["e"] = fields["a"][3:17] + words(rng, 5)
    items = spark.createDataFrame([("a", " ".join(fields["a"]), None), ("b", " ".join(fields["b"]), []), ("c", None, [" ".join(fields["c"][:13]), None, " ".join(fields["c"][13:])]), ("d", " ".join(fields["d"]).upper().replace(" ", "-"), None), ("e", " ".join(fields["e"]), [""]), (None, "x", None)], "task_id string, prompt string, test_cases array<string>")
    docs = {1: fields["a"], 2: fields["b"], 3: words(rng, 30) + fields["a"][4:16] + words(rng, 9), 4: fields["a"][:11] + ["x"] + fields["a"][12:], 5: fields["c"][7:19], 6: fields["c"][1:13], 7: fields["d"], 8: words(rng, 50)}
    table = [(k, " ".join(w)) for k, w in docs.items()] + [(1, " ".join(docs[1])), (9, None), (10, ""), (None, " ".join(fields["a"]))]
    got = {(r.id, r.task_id) for r in leaked_items(spark.createDataFrame(table, "id int, text string"), "id", "text", items, "task_id", ["prompt", "test_cases"]).collect()}
    assert got == {(1, "a"), (1, "e"), (3, "a"), (3, "e"), (6, "c"), (7, "d")}
    near = leaked_items(spark.createDataFrame(table, "id int, text string"), "id", "text", items, "task_id", ["prompt"], threshold=0.9)
    assert {(1, "a"), (3, "a"), (7, "d")} <= {(r.id, r.task_id) for r in near.collect()}


def test_altered_leaks_are_found(spark):
    """One word in twenty-four replaced: every 24-word window of the item is altered; found in nine of ten documents, and only where it is."""
    rng = random.Random(12)
    fields = [words(rng, 96) for _ in range(40)]
    items = spark.createDataFrame([(f"t{i}", " ".join(w)) for i, w in enumerate(fields)], "task_id string, prompt string")
    altered = [[f"n{rng.randrange(10**6)}" if k % 24 == 11 else x for k, x in enumerate(w)] for w in fields]
    docs = [(i, " ".join(words(rng, 30) + a + words(rng, 30))) for i, a in enumerate(altered)] + [(100 + i, " ".join(words(rng, 150))) for i in range(40)]
    got = {(r.id, r.task_id): r.similarity for r in leaked_items(spark.createDataFrame(docs, "id int, text string"), "id", "text", items, "task_id", ["prompt"], window=24, threshold=0.7).collect()}
    assert set(got) <= {(i, f"t{i}") for i in range(40)} and len(got) >= 36 and all(0.7 <= v < 1 for v in got.values())


def test_items_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEM_CHARS", 200)
    rng = random.Random(13)
    fields = [words(rng, 20) for _ in range(10)]
    items = spark.createDataFrame([(f"t{i}", " ".join(w)) for i, w in enumerate(fields)], "task_id string, prompt string")
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(fields)], "id int, text string")
    assert {(r.id, r.task_id, r.windows) for r in leaked_items(docs, "id", "text", items, "task_id", ["prompt"]).collect()} == {(i, f"t{i}", 9) for i in range(10)}


@pytest.mark.parametrize("hot", [20_000, 0])
def test_split_overlaps_equal_brute_force(spark, monkeypatch, hot):
    """With a limit of 0 every seed is hot, and every record consists of such seeds."""
    monkeypatch.setattr(overlap_module, "HOT_PAIRS", hot)
    rng = random.Random(9)
    rows, texts = [], {}
    for i in range(40):
        base = words(rng, rng.randrange(20, 60))
        for side, share in (("train", 0), (" Dev", 0.03), ("eval", 0.2)):
            key = f"s{i}-{side.strip()}"
            texts[key] = " ".join(edit(rng, base, share))
            rows.append((key, "qa", side, "src", texts[key]))
    rows += [rows[0], ("other", "elsewhere", "train", "src", texts["s0-Dev"]), ("null", None, "train", "src", texts["s0-Dev"]), ("none", "qa", None, "src", texts["s0-Dev"]), ("short", "qa", "train", None, "a b"), ("blank", "qa", "eval", None, None), ("two", "web", "TRAIN ", None, texts["s1-Dev"])]
    texts["two"] = texts["s1-Dev"]
    df = spark.createDataFrame(rows, "sample_id string, dataset_name string, split_name string, source string, content string")
    configs = spark.createDataFrame([("qa", "train", "dev", "eval"), ("web", "train", "val", "test")], "dataset_name string, train_split string, val_split string, test_split string")
    found = split_overlaps(df, configs, threshold=0.6, min_words=20, shingle_words=3).collect()
    train = {k for k in texts if k.endswith("train") or k == "two"}
    want = {(a, b) for a in train for b in set(texts) - train if similarity(texts[a], texts[b]) >= 0.6}
    assert {(r.sample_train, r.sample_eval) for r in found} == want and len(want) > 30
    assert all(0.5 < r.coverage_train <= 1 for r in found)


def test_split_overlaps_of_a_hot_family(spark, monkeypatch):
    """Variants with less than half of their seeds in a hot template are met like any other."""
    monkeypatch.setattr(overlap_module, "HOT_PAIRS", 20)
    monkeypatch.setattr(overlap_module, "BLOCK", 4)
    rng = random.Random(22)
    base = words(rng, 130)
    rows = [(f"{side}{i}", "qa", side, "src", " ".join(f"v{side}{i}n{k}" if k % 13 == i % 13 and (i or k < 13) else w for k, w in enumerate(base))) for side in ("train", "eval") for i in range(13)]
    rows += [(f"{side}same", "qa", side, "src", " ".join([*base, side])) for side in ("train", "eval")]
    df = spark.createDataFrame(rows, "sample_id string, dataset_name string, split_name string, source string, content string")
    configs = spark.createDataFrame([("qa", "train", "dev", "eval")], "dataset_name string, train_split string, val_split string, test_split string")
    found = split_overlaps(df, configs, threshold=0.6, min_words=20, shingle_words=3).collect()
    texts = {r[0]: r[4] for r in rows}
    want = {(a, b) for a in texts if a.startswith("train") for b in texts if b.startswith("eval") and similarity(texts[a], texts[b]) >= 0.6}
    assert {(r.sample_train, r.sample_eval) for r in found} == want and len(want) > 40


def test_pieces_of_oversized_items(spark):
    settings = spark.createDataFrame([("txt", 50, 10), ("code", 30, 0)], "doc_type string, chunk_size int, chunk_overlap int")
    text = "Some words here. " * 10
    rows = [("a", text, "TXT "), ("a", text, "TXT "), ("b", text, None), ("c", "x" * 31, " Code"), ("d", "x" * 31, "notebook"), ("e", None, "txt"), (None, text, "txt"), ("f", "", "txt"), ("g", "y" * 5000, "code")]
    df = spark.createDataFrame(rows, "doc_id string, content string, doc_type string").withColumn("id", F.lit(1)).withColumn("size", F.lit("s"))
    out = split_oversized(df, "doc_id", "content", "doc_type", settings).orderBy("id", "piece").collect()
    assert {r.id for r in out} == {"a", "b", "c", "g"}
    mine = [r for r in out if r.id == "a"]
    assert [r.piece for r in mine] == list(range(mine[0].pieces)) and all(len(r.content) <= 50 for r in mine)
    assert all(p.content[-10:] == q.content[:10] for p, q in zip(mine, mine[1:]))
    assert mine[0].content + "".join(r.content[10:] for r in mine[1:]) == text
    assert len([r for r in out if r.id == "g"]) == 167


def naive_mix(docs, weights, factor, repeats, order):
    """The queue by plain simulation, given each domain's document order."""
    total = {d: sum(n for _, n in order[d]) for d in order}
    uses = []
    for d in order:
        for r in range(repeats):
            done = r * total[d]
            for key, n in order[d]:
                done += n
                uses.append((done / weights[d], d, r + 1, key, n))
    uses.sort()
    budget, spent, out = int(factor * sum(total.values())), 0, {}
    for _, d, _, key, n in uses:
        if spent + n > budget:
            break
        spent += n
        out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize(("factor", "repeats"), [(0.5, 1), (1.0, 2), (1.7, 2), (5.0, 3), (0.0, 1)])
def test_mixing_equals_simulation(spark, factor, repeats):
    rng = random.Random(10)
    docs = [(i, rng.choice(["A", "b ", "c"]), rng.randrange(1, 50)) for i in range(200)] + [(900, None, 5), (901, "a", 0), (902, "zzz", 5), (None, "a", 5)]
    df = spark.createDataFrame(docs + docs[:3], "doc_id bigint, domain string, n_tokens bigint")
    weights = {"a": 3.0, "b": 1.0, "c": 1.0}
    plans = spark.createDataFrame([("e", factor, repeats, {"a": 3.0, "B": 1.0, "c": 1.0, "ghost": 2.0, "zero": 0.0})], "experiment_id string, size_factor double, max_repeats int, dataset_weights map<string,double>")
    chosen = mix_to_weights(df, plans, seed=1)
    place = lambda i: (int(hashlib.md5(f"{i}:1".encode()).hexdigest()[:15], 16), i)
    order = {d: sorted(((i, n) for i, dom, n in docs if dom and i is not None and n and dom.strip().lower() == d), key=lambda x: place(x[0])) for d in weights}
    want = naive_mix(docs, weights, factor, repeats, order)
    got = {r.doc_id: r.repeats for r in chosen.collect()}
    assert got == want
    shares = {r.domain: r for r in mixture_shares(chosen, df, plans).collect()}
    assert set(shares) == {"a", "b", "c", "ghost"} and shares["ghost"].tokens == 0
    assert sum(r.share for r in shares.values()) == pytest.approx(1 if want else 0)


def test_packing(spark):
    rng = random.Random(11)
    sizes = {i: rng.randrange(1, 300) for i in range(300)} | {1000: 0, 1001: 100, 1002: 1050}
    docs = spark.createDataFrame([*sizes.items(), (5, sizes[5]), (None, 7), (2000, None)], "doc_id bigint, n_tokens bigint")
    plans = spark.createDataFrame([("e", 100), ("f", 512), ("null", None)], "experiment_id string, max_sequence_length int")
    for shard_items in (20_000, 50):
        out = pack_documents(docs, plans, shard_items=shard_items).collect()
        for name, capacity in (("e", 100), ("f", 512)):
            rows = [r for r in out if r.experiment_id == name]
            per, parts, by = {}, {}, {}
            for r in rows:
                per[r.doc_id] = per.get(r.doc_id, 0) + r.tokens
                parts.setdefault(r.doc_id, []).append(r)
                if r.sequence_id is not None:
                    by.setdefault(r.sequence_id, []).append(r)
            assert per == {**sizes, 2000: 0}
            assert all(sum(r.tokens for r in s) + s[0].unused == capacity for s in by.values()) and all(s[0].unused >= 0 for s in by.values())
            for k, p in parts.items():
                assert len(p) == max(1, -(-sizes.get(k, 0) // capacity)) and sorted(r.part for r in p) == list(range(len(p)))
            assert len(by) <= 1.25 * sum(sizes.values()) / capacity + 6
        assert not [r for r in out if r.experiment_id == "null"]


def test_token_budgets(spark, model):
    docs = spark.createDataFrame([(1, "s", "EN", "Py", "ab ab."), (1, "s", "EN", "Py", "ab ab."), (2, "s", "en-US", None, "abc"), (3, None, None, "py", None), (4, "s", "de_DE", "py", " \n")], "doc_id bigint, source string, lang string, domain string, text string")
    rows = {(r.source, r.lang, r.domain): r for r in document_budget(docs, TOKENIZER).collect()}
    everything = rows["(all)", "(all)", "(all)"]
    assert (everything.records, everything.usable, everything.tokens) == (4, 2, 6)
    assert rows["s", "en", "py"].tokens == 4 and rows["(all)", "en", "(all)"].tokens == 6 and rows["(none)", "(none)", "py"].usable == 0
    kb = spark.createDataFrame([("a", "txt", {"lang": "fr"}, "ab"), ("b", None, None, "ab"), ("c", " TXT", {"x": "y"}, "ab")], "doc_id string, doc_type string, metadata map<string,string>, content string")
    assert {(r.doc_type, r.lang): r.tokens for r in knowledge_budget(kb, TOKENIZER).collect()}["txt", "(all)"] == 2
    chat = spark.createDataFrame([("c", 0, "b1", "s", "ab ab"), ("c", 0, "b1", "s", "ab ab"), ("c", 1, "b2", None, "ab"), ("d", 1, "b3", "s", None)], "conv_id string, turn bigint, batch_id string, source string, content string")
    stats = spark.createDataFrame([("b1", 3, 1), ("b2", 0, 1), ("b3", None, 1)], "batch_id string, total_tokens bigint, total_conversations bigint")
    got = {r.batch_id: (r.tokens, r.report) for r in chat_budget(chat, stats, TOKENIZER, model).collect() if r.source == "(all)" and r.lang == "(all)"}
    assert got["b1"] == (3, "equal") and got["b2"] == (1, "zero") and got["b3"] == (0, "missing") and got["(all)"] == (4, None)


def test_tokenizer_tables_and_public_tokenizers(spark):
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("ab", 2), (None, 3)], "token string, token_id int")
    merges = spark.createDataFrame([(0, "a", "b")], "merge_rank int, left_token string, right_token string")
    spec = tokenizer_from_tables(vocab, merges)
    df = spark.createDataFrame([(1, "abab"), (2, "ac"), (3, None), (4, "")], "n_tokens int, text string")
    assert [(r.n, r.u) for r in with_token_counts(df, "text", spec, count="n", unknown="u").orderBy("n_tokens").collect()] == [(2, 0), (2, 1), (0, 0), (0, 0)]
    public = pytest.importorskip("public_tokenizers")
    for kind, name in (("tokenizers", "byte_bpe_50k.json"), ("tiktoken", "byte_bpe_50k.tiktoken"), ("sentencepiece", "piece_bpe_32k.model")):
        spec = TokenizerSpec(kind, path=str(public.path(name)), pattern=public.PATTERN)
        got = {r.n_tokens: r.n for r in with_token_counts(df, "text", spec, count="n").collect()}
        assert got[1] >= 1 and got[3] == got[4] == 0
    with pytest.raises(ValueError, match="unknown tokenizer"):
        TokenizerSpec("other").load()


def pairs_of(spark, records, chat, model, **more):
    tables = spark.createDataFrame(records, "record_id string, instruction string, input string, output string"), spark.createDataFrame(chat, "conv_id string, turn bigint, role string, content string")
    return {(r.record_key, r.turn): r.defect for r in broken_pairs(*tables, model, **more).collect()}


def test_broken_pairs(spark, model):
    records = [("r1", "What is a heap?", None, None), ("r2", "What is a heap?", "", "What is a heap?"), ("r3", "What is a heap?", None, "A tree."), ("r3", "What is a heap?", None, "A tree."), (None, "q", None, None), ("r4", None, None, None)]
    records += [(f"t{i}", f"Question number {i} about the {w}?", None, f"I'd rather not answer questions about your {w}.") for i, w in enumerate(["heap", "tree", "graph", "queue", "stack", "map"])]
    chat = [("c", 0, "User ", "What is a heap?"), ("c", 1, " Assistant", None), ("c", 2, "human", "And a tree?\n\nInput:\nx"), ("c", 3, "gpt", "And a tree?"), ("c", 4, "user", "Bye"), ("d", 5, "bot", "no question"), ("c", 2, "human", "And a tree?\n\nInput:\nx")]
    assert pairs_of(spark, records, chat, model) == {("r1", 0): "empty", ("r2", 0): "copy", ("r4", 0): "empty", ("c", 1): "empty", ("c", 3): "copy", **{(f"t{i}", 0): "refusal" for i in range(6)}}


NOUNS = ["heap", "tree", "graph", "queue", "stack", "map", "list", "table", "index", "cache"]
#: wordings that no pattern of declining matches, two of them in other languages
UNSEEN = ["Count me out on this one.", "That request is off the table as far as I am concerned.", "Não posso ajudar com isso agora.", "その質問には回答できません。", "Let us leave the {} to somebody with more patience."]


def sound_answers(rng, n):
    """Answers in stock phrases as well: they recur under unrelated prompts, but other things follow, or they end an answer only now and then."""
    say = ["Note that the {} never holds a {} larger than {}.", "Call the {} before touching a new {} of {}.", "In practice the {} costs about {} cycles per {}."]
    fill = lambda s: s.format(*(rng.choice(NOUNS) if rng.random() < 0.7 else f"{rng.choice(NOUNS)}_{rng.randrange(99)}" for _ in range(3)))
    return [(f"s{i}", f"Question {rng.choice(NOUNS)} {rng.choice(NOUNS)} {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}?", None, " ".join(fill(rng.choice(say)) for _ in range(rng.choice([1, 2, 3, 4, 5])))) for i in range(n)]


def test_refusals_are_known_by_their_use(spark, model):
    rng = random.Random(26)
    sound = sound_answers(rng, 400)
    refusing = [(f"u{k}-{i}", f"Please explain {a} and {b} of {chr(97 + i)}{chr(97 + k)}", None, text.format(a) + (" Feel free to bring me some other {} tomorrow.".format(b) if i % 3 == 0 else "")) for k, text in enumerate(UNSEEN) for i, (a, b) in enumerate(zip(NOUNS, NOUNS[::-1]))]
    # the same words before an answer of its own are no refusal, however often they are used
    leading = [(f"l{i}", f"What is {a} of {chr(97 + i)}?", None, "Sorry, I cannot say this in one line. " + " ".join(words(rng, 12)) + ".") for i, (a, b) in enumerate(zip(NOUNS, NOUNS[::-1]))]
    got = pairs_of(spark, sound + refusing + leading, [], model)
    assert {k[0] for k, d in got.items() if d == "refusal"} == {r[0] for r in refusing}


def test_repeated_refusals_and_few_prompts(spark, model):
    rng = random.Random(27)
    same = [(f"u{i}", "Please explain the heap", None, f"Count me out on this one, {w}.") for i, w in enumerate(NOUNS)]  # one prompt only
    long = [(f"n{i}", f"Please explain {w} of {chr(97 + i)}", None, " ".join(["That request is off the table as far as I am concerned."] * 14)) for i, w in enumerate(NOUNS)]
    more = [("m", "Please explain the tree", None, "That request is off the table as far as I am concerned. Leaves hold the keys. Parents hold the leaves.")]
    got = pairs_of(spark, sound_answers(rng, 200) + same + long + more, [], model)
    assert {k[0] for k, d in got.items() if d == "refusal"} == {r[0] for r in long}


def test_a_template_is_met_in_crowded_bands(spark):
    """Every band of the template holds many other openings; they share words with it and are not similar."""
    rng = random.Random(25)
    plain = [f"word{i}" for i in range(11)]
    similar = [*plain[:8], "other", "end", "here"]
    rows = [(" ".join(plain), None, 1, p, False) for p in range(2)] + [(" ".join(similar), None, 1, 10 + p, False) for p in range(10)]
    for i in range(4000):
        at, to = rng.randrange(9), rng.randrange(9)
        rows.append((" ".join([f"aaa{i}", *plain[at : at + 3], f"d{i}", *plain[to : to + 3]]), None, 3, 100 + i, False))
    _, openings = refusal_sentences(spark.createDataFrame(rows, "first string, second string, sentences int, prompt bigint, cue boolean"))
    got = {r.sid: r.refuses for r in openings.collect()}
    sids = {r.s: r.sid for r in spark.createDataFrame([(" ".join(plain),), (" ".join(similar),)], "s string").withColumn("sid", sentence_id(F.col("s"))).collect()}
    assert all(got[sids[" ".join(w)]] for w in (plain, similar))


def test_language_model_of_a_table(spark):
    rows = [(i, lang, text) for lang, text in SAMPLES.items() for i in range(6)] + [(7, None, "no label"), (8, "en", None), (9, " EN-us", SAMPLES["en"])]
    fitted = fit_language_model(spark.createDataFrame(rows, "id int, lang string, text string"), "id", "text", "lang", sample=3)
    assert fitted.languages == ("de", "en", "es", "fr", "zh")
    assert fitted.detect(["Die Liste wird danach nach ihrer Größe geordnet.", "Quelle est la clé de cet arbre ?", "请解释这些值。"]) == ["de", "fr", "zh"]
    assert fit_language_model(spark.createDataFrame([], "id int, lang string, text string"), "id", "text", "lang").detect(["The list of values"]) == [None]
