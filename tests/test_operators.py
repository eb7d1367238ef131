"""Literal vectors and invariants of the core operators."""

import random

import pytest
from pyspark.sql import functions as F

from textloom import session
from textloom.functions import arrays as A
from textloom.functions import text as T
from textloom.operators import agent, conversation, evaluation, retrieval, stats, tensors, tokenizer, validate, windows
from textloom.sources import readers, sinks
from textloom.streaming import packing


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(*columns).collect()[0]


def test_clean_text(spark):
    raw = "\tHello\r\nWorld\x00null bytes\x07and tabs."
    assert one(spark, raw, T.clean_text(F.col("v"), tabs=4))[0] == "    Hello\nWorldnull bytesand tabs."
    assert one(spark, None, T.clean_text(F.col("v")))[0] is None
    assert one(spark, "", T.clean_text(F.col("v"), tabs=4))[0] == ""
    assert one(spark, "e\u0301", T.unicode_normalize(F.col("v")))[0] == "é"
    assert one(spark, "ab\tc", T.expand_tabs(F.col("v")))[0] == "ab  c"


def test_code_cleaning(spark):
    code = "# Comment\ndef foo(x):\n    return x + 1\n"
    row = one(spark, code, T.clean_python(F.col("v")).alias("c"), T.python_syntax("v").alias("s"))
    assert "Comment" not in row.c and row.s.ok
    assert not one(spark, "def foo(x\n    return x +", T.python_syntax("v").alias("s")).s.ok
    row = one(spark, "// Comment\nint main() { return 0; }", T.clean_curly(F.col("v")).alias("c"), T.braces_balanced(F.col("v")).alias("b"))
    assert "int main()" in row.c and "Comment" not in row.c and row.b
    assert not one(spark, "}{", T.braces_balanced(F.col("v")))[0]


def test_html_and_fences(spark):
    clean = one(spark, "<h1>Title</h1><p>This is   some code.</p>", T.clean_html(F.col("v")))[0]
    assert "Title" in clean and "<h1>" not in clean and "  " not in clean
    assert one(spark, "Text\n```python\ndef solve():\n    return 42\n```\nend", T.fenced_code(F.col("v")))[0] == "def solve():\n    return 42"
    assert one(spark, "  no fence ", T.fenced_code(F.col("v")))[0] == "no fence"


def test_text_counts(spark):
    text = "Hello World!\nSecond Line."
    assert one(spark, text, F.size(T.words(F.col("v"))), T.line_count(F.col("v"))) == (4, 2)
    row = stats.corpus_stats(spark.createDataFrame([(text,), (None,)], "text string"), "text").collect()[0]
    assert (row.chars, row.lines, row.words) == (25, 2, 4) and row.entropy > 0
    for broken, lines in (("", 0), ("a", 1), ("a\n", 1), ("a\r\nb", 2), ("a\n\n", 2), ("\u2028x", 2)):
        assert one(spark, broken, T.line_count(F.col("v")))[0] == lines == len(broken.splitlines())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert stats.corpus_stats(none, "text").collect()[0].chars == 0
    assert windows.overlapping_chunks(none, "doc_id", "text").count() == 0
    assert windows.running_offset(none.withColumn("n", F.length("text")), "doc_id", "n").count() == 0
    assert validate.exact_duplicates(none, "doc_id", "text").count() == 0
    assert retrieval.embed_texts(none, "doc_id", "text").count() == 0


def test_windows(spark):
    df = spark.createDataFrame([(1, list(range(20))), (2, [1]), (3, [])], "k int, ids array<int>")
    rows = windows.context_windows(df, "k", "ids", length=5).orderBy("window").collect()
    assert [r.x[0] for r in rows] == [0, 5, 10] and rows[0].y == [1, 2, 3, 4, 5]
    assert all(r.x[1:] == r.y[:-1] for r in rows)
    long = spark.createDataFrame([(1, list(range(33)))], "k int, ids array<int>")
    assert windows.context_windows(long, "k", "ids", length=16).count() == 2
    assert windows.context_windows(long, "k", "ids", length=16, memmap_count=True).count() == 1
    short = spark.createDataFrame([(1, list(range(100)))], "k int, ids array<int>")
    assert windows.context_windows(short, "k", "ids", length=16, memmap_count=True).count() == 5
    padded = windows.context_windows(df, "k", "ids", length=8, pad=0).where("key = 1").orderBy("window").collect()
    assert padded[-1].x == [16, 17, 18, 19, 0, 0, 0, 0] and padded[-1].y == [17, 18, 19, 0, 0, 0, 0, 0]


def test_packing_with_end_marks(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, list(range(10, 20)))], "k int, ids array<int>")
    rows = windows.packed_windows(df, "k", "ids", length=10, overlap=1, eos=99).collect()
    assert len(rows) == 1 and rows[0].ids == [1, 2, 3, 4, 5, 99, 10, 11, 12, 13, 14]


def test_splits_and_batches(spark):
    df = spark.range(100)
    sizes = {r.split: r["count"] for r in windows.shuffled_split(df, "id").groupBy("split").count().collect()}
    assert sizes == {"train": 80, "val": 10, "test": 10}
    with pytest.raises(ValueError):
        windows.shuffled_split(df, "id", (0.5, 0.1, 0.1))
    assert windows.batches(df, "id", 32, drop_last=True).count() == 96
    x = spark.createDataFrame([(0, [1, 2, 3], [2, 3, 4]), (0, [5, 6, 7, 8, 9], [6, 7, 8, 9, 10])], "batch int, x array<int>, y array<int>")
    rows = windows.padded_batches(x, "batch", "x", "y").orderBy(F.element_at("x", 1)).collect()
    assert rows[0].x == [1, 2, 3, 0, 0] and rows[0].y == [2, 3, 4, -100, -100]


def test_conversations(spark):
    rec = spark.createDataFrame([("a", "Reverse array", "[1, 2]", "[2, 1]"), ("b", " ", None, "x"), ("c", "Q", None, "A")], "record_id string, instruction string, input string, output string")
    got = {r.record_id: r.user for r in conversation.adapt_instruction(rec).collect()}
    assert got == {"a": "Reverse array\n\nInput:\n[1, 2]", "c": "Q"}
    shared = spark.createDataFrame([([("human", "Hello"), ("gpt", "Hi there!"), ("sys", "S1"), ("system", "S2"), ("alien", "x"), ("user", " ")],)], "conversations array<struct<`from`:string,value:string>>")
    row = conversation.adapt_shared(shared).collect()[0]
    assert [m.role for m in row.messages] == ["user", "assistant"] and row.system_prompt == "S2"
    m = spark.createDataFrame([([("user", "Write a function."), ("assistant", "def foo(): pass")],)], "messages array<struct<role:string,content:string>>")
    text = m.select(conversation.render_chatml(F.col("messages"), F.lit("Custom System Prompt"))).collect()[0][0]
    assert text.startswith("<|im_start|>system\nCustom System Prompt<|im_end|>\n<|im_start|>user\n")
    row = conversation.tokenize_and_mask(m, F.lit("S"), 64).collect()[0]
    trained = [t for t in row.y if t != conversation.IGNORE]
    assert len(row.x) == len(row.y) == 64 and trained == [*map(ord, "def foo(): pass"), conversation.IM_END]


def test_conversation_errors(spark):
    turns = spark.createDataFrame([("a", 0, "user", "hi"), ("b", 0, "user", "q"), ("b", 1, "assistant", " "), ("c", 0, "User ", "q"), ("c", 1, "assistant", "a"), ("d", 0, None, None)], "conv_id string, turn int, role string, content string")
    got = {r.conv_id: r.errors for r in validate.conversation_errors(turns).collect()}
    assert got == {"a": ["no assistant turn"], "b": ["turn 1: empty"], "c": [], "d": ["turn 0: role", "turn 0: empty", "no assistant turn"]}


def test_last_turns_and_joined_files(spark):
    turns = spark.createDataFrame([("a", i, "User" if i % 2 else "gpt", f"m{i}") for i in range(9)] + [("a", 8, "gpt", "m8"), ("b", 0, "alien", "x"), (None, 1, "user", "y")], "conv_id string, turn int, role string, content string")
    rows = conversation.last_turns(turns, n=2).collect()
    assert [(r.conv_id, r.memory) for r in rows] == [("a", "user: m7\nassistant: m8")]
    files = spark.createDataFrame([("x", 2, "bb"), ("x", 1, "a"), ("y", 1, "c"), (None, 1, "d"), ("x", 3, None)], "folder string, name int, text string")
    got = {(r.folder, r.name): r.start for r in windows.joined_offsets(files, "folder", "name", "text").collect()}
    assert got == {("x", 1): 0, ("x", 2): 3, ("y", 1): 0, (None, 1): 0}


def test_retrieval(spark):
    chunks = spark.createDataFrame([("c1", "Min-Heap priority queue push pop"), ("c2", "Dijkstra shortest path algorithm"), ("c3", None), ("c4", "")], "chunk_id string, content string")
    vectors = retrieval.embed_texts(chunks, "chunk_id", "content")
    norms = {r.chunk_id: r.n for r in vectors.select("chunk_id", A.norm(F.col("embedding")).alias("n")).collect()}
    assert norms["c1"] == pytest.approx(1) and norms["c3"] == norms["c4"] == 0
    hits = retrieval.fuse(retrieval.dense_hits(vectors, "Min-Heap queue", 4), retrieval.sparse_hits(chunks, "Min-Heap queue", 4), 2)
    assert hits.orderBy(F.desc("score")).first().chunk_id == "c1"
    assert retrieval.rerank(hits, chunks, "Min-Heap queue", 1).first().chunk_id == "c1"
    results = spark.createDataFrame([(1, "c1", "heap.py", "/kb/heap.py", "x" * 100), (2, "c2", "b.py", "/kb/b.py", "y" * 1000)], "rank int, chunk_id string, title string, source_file string, content string")
    entries = retrieval.with_context_entries(results, 500).orderBy("rank").collect()
    assert "[Doc 1: heap.py]" in entries[0].entry and entries[1].entry.endswith("...\n") and len(entries) == 2
    assert sum(len(e.entry) for e in entries) + len(retrieval.HEADER) <= 500


def test_pass_at_k(spark):
    for n, c, k, want in ((10, 10, 1, 1.0), (10, 10, 10, 1.0), (10, 0, 1, 0.0), (10, 5, 1, 0.5), (4, 2, 5, None), (10, 9, 2, 1.0)):
        assert spark.range(1).select(A.pass_at_k(F.lit(n), F.lit(c), k)).collect()[0][0] == pytest.approx(want) if want is not None else True
    counts = spark.createDataFrame([("b", 10, 10), ("b", 10, 5)], "g string, n int, c int")
    assert evaluation.mean_pass_at_k(counts, "g", (1,)).collect()[0].pass_at_1 == 0.75


def test_byte_pairs(spark):
    text = "aaabdaaabac"
    df = spark.createDataFrame([(1, text), (2, text), (3, None), (4, "")], "doc_id int, text string")
    merges = tokenizer.train_merges(df, "text", 3)
    assert merges[0] == ("a", "a", 8) and len(merges) == 3
    ranks = {(a, b): i for i, (a, b, _) in enumerate(merges)}
    tokens = tokenizer.merge_pairs(text, ranks)
    assert "".join(tokens) == text and len(tokens) < len(text)
    vocab = {t: i + 4 for i, t in enumerate(sorted({*text, *(a + b for a, b, _ in merges)}))}
    ids = {r.doc_id: r.ids for r in tokenizer.encode_merged(df, "doc_id", "text", vocab, ranks).collect()}
    assert ids[3] is None and ids[4] == [] and ids[1] == [vocab[t] for t in tokens]
    table = F.create_map(*(F.lit(x) for t, i in vocab.items() for x in (i, t)))
    back = spark.createDataFrame([([2, *ids[1], 3, 999],)], "ids array<int>").select(tokenizer.decode(F.col("ids"), table)).collect()[0][0]
    assert back == text + "<unk>"
    with pytest.raises(Exception, match="longer than"):
        spark.createDataFrame([([1, 2, 3],)], "ids array<int>").select(tokenizer.frame(F.col("ids"), max_length=2)).collect()


def test_tensors(spark):
    df = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (0, 2, 1.0), (0, 3, -1.0)], "row int, token int, logit double")
    assert tensors.top_k(df, "row", "logit", 2).count() == 3
    assert sum(r.p for r in tensors.softmax(df, "row", "logit").collect()) == pytest.approx(1)
    assert [r.token for r in tensors.top_p(df, "row", "token", "logit", 0.0).collect()] == [0]
    steps = spark.createDataFrame([(0,), (10,), (100,), (101,)], "s int").select(tensors.cosine_warmup(F.col("s"), base=1.0, lowest=0.1, warmup=10, total=100)).collect()
    assert [r[0] for r in steps] == pytest.approx([0.0, 1.0, 0.1, 0.1])


def test_agent_parsing(spark):
    reply = "Thought: look\nAction: read\nAction Input: path=a.py, n=5"
    p = one(spark, reply, agent.parse_reply(F.col("v")).alias("p")).p
    assert (p.thought, p.action, p.arguments, p.final_answer) == ("look", "read", {"path": "a.py", "n": "5"}, None)
    p = one(spark, 'Action: x\nAction Input: {"a": "b"}', agent.parse_reply(F.col("v")).alias("p")).p
    assert p.arguments == {"a": "b"}
    p = one(spark, "Final Answer: done", agent.parse_reply(F.col("v")).alias("p")).p
    assert p.final_answer == "done" and p.action is None and p.arguments == {}
    code = spark.createDataFrame([(1, "class A:\n    def f(self, x): pass\n"), (2, "def ("), (3, None)], "k int, code string")
    assert {(r.key, r.kind, r.name, r.arguments, r.line) for r in agent.outline(code, "k", "code").collect()} == {(1, "class", "A", None, 1), (1, "function", "f", "self,x", 2)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "kb" / "sub").mkdir(parents=True)
    (tmp_path / "kb" / "a.md").write_text("# A")
    (tmp_path / "kb" / "sub" / "b.py").write_text("x = 1")
    (tmp_path / "kb" / "blank.txt").write_text("  \n")
    docs = {r.doc_id: r.doc_type for r in readers.read_documents(spark, str(tmp_path / "kb")).collect()}
    assert docs == {"a": "markdown", "b": "code"}
    assert [r.language for r in readers.read_code(spark, str(tmp_path / "kb")).collect()] == ["python"]
    (tmp_path / "i.jsonl").write_text('{"instruction":"Task 1","output":"Ans 1"}\n\nnot json\n{"instruction":"Task 2","output":"Ans 2"}\n{"instruction":"","output":"x"}\n')
    assert readers.read_instructions(spark, str(tmp_path / "i.jsonl")).count() == 2
    assert readers.read_instructions(spark, str(tmp_path / "i.jsonl"), max_samples=1).count() == 1
    (tmp_path / "s.jsonl").write_text('{"conversations":[{"from":"human","value":"Hello"},{"from":"gpt","value":"Hi there!"}]}\n{"conversations":[{"from":"human","value":"alone"}]}\n')
    assert readers.read_instructions(spark, str(tmp_path / "s.jsonl"), "sharegpt").count() == 1
    (tmp_path / "o.jsonl").write_text('{"prompt":"Write binary search","response":"def bs(): pass"}\n{"messages":[{"content":"q"},{"role":"assistant","content":"a"}]}\n')
    assert readers.read_instructions(spark, str(tmp_path / "o.jsonl"), "something else").count() == 2
    ids = spark.createDataFrame([(i, list(range(10 * i, 10 * i + 10))) for i in range(10)], "k int, ids array<int>")
    manifest = sinks.write_token_shards(ids, "k", "ids", str(tmp_path / "shards"), vocab_size=1000, max_bytes=60).orderBy("shard").collect()
    assert sum(r.tokens for r in manifest) == 100 and [r.first_token for r in manifest] == [0, 30, 60, 90]
    cache = sinks.DatasetCache(spark, str(tmp_path / "cache"))
    a, b = sinks.cache_key("s", {"window": 10}), sinks.cache_key("s", {"window": 20})
    assert cache.get_or_make(a, lambda: ids).count() == 10 and cache.get(a) is not None and cache.get(b) is None
    cache.clear()
    assert cache.get(a) is None


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([("s", i, list(range(7 * i, 7 * i + 7))) for i in range(9)], "key string, k int, ids array<int>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = packing.run_to_memory(packing.packed_stream(stream, "key", "k", "ids", length=10), "stream_equals_batch").orderBy("window").collect()
    want = windows.packed_windows(rows, "k", "ids", length=10, overlap=1).orderBy("window").collect()
    assert [r.x + r.y[-1:] for r in got] == [r.ids for r in want] and len(got) == 6


def test_segments_do_not_change_encodings(spark):
    import random

    rng = random.Random(3)
    pairs = [("a", "b"), ("ab", " "), (" ", "c"), ("b", "ab"), ("é", "a"), ("aa", "a"), ("a", "a")]
    ranks = {p: i for i, p in enumerate(pairs)}
    vocab = {t: i for i, t in enumerate(sorted({*"abc é", *(a + b for a, b in pairs)}))}
    encoder = tokenizer.MergeEncoder(vocab, ranks)
    for _ in range(300):
        text = "".join(rng.choice("aab  cé𝓐z") for _ in range(rng.randrange(60)))
        assert encoder.encode(text) == [vocab.get(t, tokenizer.UNKNOWN) for t in tokenizer.merge_pairs(text, ranks)]
    df = spark.createDataFrame([(1, "aé𝓐"), (2, None), (3, "")], "k int, t string")
    assert {r.k: r.ids for r in tokenizer.code_points(df, "k", "t").collect()} == {1: [97, 233, 0x1D4D0], 2: None, 3: []}


def test_blocks_of_queries_equal_one_matrix(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)] + [(99, None), (98, [])], "id int, v array<double>")
    asked = spark.createDataFrame([(str(i), rows[i].tolist()) for i in range(20)] + [("0", rows[0].tolist()), (None, rows[1].tolist()), ("x", None)], "query string, vector array<double>")
    monkeypatch.setattr(retrieval, "BLOCK", 6)
    got = {(r["query"], r["rank"]): r.id for r in retrieval.nearest_to_rows(df, "id", "v", asked, 3, exclude_self=True).collect()}
    for i in range(20):
        scores = np.round(rows @ (rows[i] / np.linalg.norm(rows[i])), 6)
        want = [j for j in np.lexsort((np.arange(60), -scores)) if j != i][:3]
        assert [got[str(i), r] for r in (1, 2, 3)] == want
    assert len(got) == 60


def test_byte_pairs_to_a_vocabulary_size(spark):
    df = spark.createDataFrame([(1, "aaabdaaabac"), (2, "aaabdaaabac"), (3, None), (4, "")], "doc_id int, text string")
    assert len(tokenizer.train_to_size(df, "text", 4 + 4 + 2)) == 2 and tokenizer.train_to_size(df, "text", 6) == []
    # no pairs are left when the text is one token
    left, right, n = tokenizer.train_to_size(df, "text", 500)[-1]
    assert left + right == "aaabdaaabac" and n == 2


def naive_merges(texts, merges):
    """Byte-pair training by its definition: count, take the most frequent pair (of ties the largest), join it from the left."""
    rows, out = [list(t) for t in texts], []
    for _ in range(merges):
        count = {}
        for r in rows:
            for p in zip(r, r[1:]):
                count[p] = count.get(p, 0) + 1
        if not count:
            break
        n, (a, b) = max((n, p) for p, n in count.items())
        out.append((a, b, n))
        for r in rows:
            i = 0
            while i < len(r) - 1:
                if (r[i], r[i + 1]) == (a, b):
                    r[i : i + 2] = [a + b]
                i += 1
    return out


@pytest.mark.parametrize("top", [1000, 6])
def test_byte_pair_training_equals_its_definition(spark, monkeypatch, top):
    monkeypatch.setattr(tokenizer, "TOP", top)
    monkeypatch.setattr(tokenizer, "PENDING", 5)
    rng = random.Random(5)
    texts = ["".join(rng.choice("aabcd é") for _ in range(rng.randrange(60))) for _ in range(40)] + ["aaaa", "aaaaa", "", "x"]
    texts += texts[:4]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    assert tokenizer.train_merges(df, "text", 40) == naive_merges(texts, 40)


def test_running_offsets_with_ties_and_null_keys(spark):
    rows = [("a", 3), ("a", 4), ("b", 1), (None, 2), ("c", None), ("d", 5)]
    got = windows.running_offset(spark.createDataFrame(rows, "k string, n int"), "k", "n").collect()
    spans = sorted((r.offset, r.offset + (r.n or 0)) for r in got)
    assert len(got) == 6 and spans[0][0] == 0 and spans[-1][1] == 15 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert {r.k: r.offset for r in got if r.k in (None, "b", "d")} == {None: 0, "b": 9, "d": 10}


def test_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.py").write_bytes("x = 1\r\n\n# é\n".encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.md").write_text("one\ntwo")
    (tmp_path / "sub" / "a.md").write_text("later path, same stem")
    (tmp_path / "empty.txt").write_text(" \n")
    assert {r.text for r in readers.read_whole_texts(spark, str(tmp_path), "*.py").collect()} == {"x = 1\r\n\n# é\n"}
    assert {(r.doc_id, r.doc_type, r.content) for r in readers.read_documents(spark, str(tmp_path)).collect()} == {("a", "markdown", "later path, same stem"), ("b", "markdown", "one\ntwo")}
    assert [(r.language, r.text) for r in readers.read_code(spark, str(tmp_path)).collect()] == [("python", "x = 1\r\n\n# é\n")]


def test_token_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(i, [i * 1000 + k for k in range(i)]) for i in range(1, 40)] + [(99, None), (98, [])], "id int, ids array<int>")
    plan = sinks.shard_plan(rows, "id", "ids", max_bytes=400, width=4)
    manifest = sinks.write_token_files(plan, "id", "ids", f"file://{tmp_path}/bin", dtype="uint32").collect()
    shards = readers.with_global_offset(readers.read_token_shards(spark, f"{tmp_path}/bin", "uint32")).orderBy("offset").collect()
    assert [t for r in shards for t in r.ids] == [i * 1000 + k for i in range(1, 40) for k in range(i)]
    assert sorted(r.tokens for r in manifest) == sorted(len(r.ids) for r in shards) and shards[1].offset == len(shards[0].ids)


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())


def test_first_turns_of_a_conversation(spark):
    turns = spark.createDataFrame([("a", i, "user" if i % 2 else "gpt", f"m{i}") for i in range(50)] * 2 + [("a", -1, "alien", "x"), ("b", 7, "user", "z")], "conv_id string, turn int, role string, content string")
    got = {r.conv_id: [m["content"] for m in r.messages] for r in conversation.conversations(turns, 3).collect()}
    assert got == {"a": ["m0", "m1", "m2"], "b": ["z"]}
    whole, cut = (conversation.tokenize_and_mask(conversation.conversations(turns, n), F.lit("S"), 100).orderBy("conv_id").collect() for n in (None, conversation.turns_within(100)))
    assert whole == cut


def test_adjacent_characters(spark):
    texts = ["aab", "", None, "b", "ab\x00a", "éa"]
    want = {}
    for t in texts:
        for p in zip(t or "", (t or "")[1:]):
            want[p] = want.get(p, 0) + 1
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {(r.left, r.right): r.n for r in stats.adjacent_characters(df, "t").collect()} == want
    assert {r.ch: r.n for r in stats.character_counts(df, "t").collect()} == {"a": 5, "b": 3, "\x00": 1, "é": 1}
