"""SQL that states the results of the training-data queries from their definitions; DuckDB runs it on the small tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _shingles(source: str, min_words: int) -> str:
    """CTEs w, s and n: words, distinct three-word shingles and their number for ``source(c, id, x)``."""
    return f"""t AS ({source}), w AS (SELECT c, id, {_WORDS.format('x')} AS w FROM t),
        s AS (SELECT DISTINCT c, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= {min_words}),
        n AS (SELECT c, id, count(*) AS n FROM s GROUP BY c, id)"""


def _tokens(source: str) -> str:
    """CTE counts(c, id, n, u): tokens and unknown tokens of the texts ``source(c, id, x)``, null texts as 0; merges are applied one by one to each distinct piece."""
    letters = r"[\p{L}\p{Nl}\p{No}]"
    return f"""tx AS ({source}),
        px AS (SELECT c, id, unnest(regexp_extract_all(x, ' ?{letters}+')) AS piece FROM tx WHERE x IS NOT NULL),
        bpe AS (
            SELECT piece, string_split(piece, '') AS toks, 0 AS step FROM (SELECT DISTINCT piece FROM px)
            UNION ALL
            SELECT piece, list_slice(toks, 1, j - 1) || [toks[j] || toks[j + 1]] || list_slice(toks, j + 2, len(toks)), step + 1 FROM (
                SELECT piece, any_value(toks) AS toks, any_value(step) AS step, arg_min(j, merge_rank * 1000000 + j) AS j
                FROM (SELECT piece, toks, step, unnest(range(1, len(toks))) AS j FROM bpe) JOIN tokenizer_merges ON left_token = toks[j] AND right_token = toks[j + 1]
                GROUP BY piece)),
        vocab AS (SELECT list(token) AS v FROM tokenizer_vocab),
        enc AS (SELECT piece, len(toks) AS n, len(list_filter(toks, lambda t: NOT list_contains(v, t))) AS u FROM (SELECT piece, arg_max(toks, step) AS toks FROM bpe GROUP BY piece), vocab),
        inside AS (SELECT c, id, sum(n) AS n, sum(u) AS u, sum(length(piece)) AS k FROM px JOIN enc USING (piece) GROUP BY c, id),
        singles AS (SELECT list(token) AS v FROM tokenizer_vocab WHERE length(token) = 1),
        counts AS (
            SELECT tx.c, tx.id, CAST(coalesce(length(x), 0) - coalesce(k, 0) + coalesce(n, 0) AS BIGINT) AS n,
                CAST(coalesce(u, 0) + coalesce(len(list_filter(string_split(regexp_replace(x, ' ?{letters}+', '', 'g'), ''), lambda t: t <> '' AND NOT list_contains(v, t))), 0) AS BIGINT) AS u,
                coalesce(regexp_replace(x, '[ \\t\\n\\x0B\\f\\r\\x{{A0}}\\x{{200B}}]+', '', 'g') = '', true) AS blank
            FROM tx LEFT JOIN inside USING (c, id), singles)"""


_DOCUMENT_TOKENS = _tokens("SELECT 'd' AS c, doc_id AS id, any_value(text) AS x FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id")
_CODE = "regexp_extract(lower(trim({0})), '^[a-z]+')"
_LANGUAGE = f"CASE WHEN {_CODE} = '' OR {{0}} IS NULL THEN NULL WHEN {_CODE} IN ('eng', 'english') THEN 'en' WHEN {_CODE} IN ('ger', 'deu', 'german') THEN 'de' WHEN {_CODE} IN ('spa', 'spanish') THEN 'es' WHEN {_CODE} IN ('fra', 'fre', 'french') THEN 'fr' WHEN {_CODE} IN ('cn', 'zho', 'chi', 'chinese') THEN 'zh' ELSE {_CODE} END"
_TOTALS = "count(*) AS records, count(*) FILTER (NOT blank) AS usable, CAST(coalesce(sum(n) FILTER (NOT blank), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(u) FILTER (NOT blank), 0) AS BIGINT) AS unknown_tokens"


def _mixture(then: str) -> str:
    return f"""
        WITH RECURSIVE {_DOCUMENT_TOKENS},
        weights AS (SELECT experiment_id, any_value(size_factor) AS size_factor, any_value(coalesce(max_repeats, 1)) AS max_repeats, lower(trim(e.key)) AS domain, sum(e.value) AS weight
            FROM (SELECT *, unnest(map_entries(dataset_weights)) AS e FROM pretraining_configs) WHERE e.value > 0 GROUP BY experiment_id, lower(trim(e.key))),
        own AS (SELECT doc_id, lower(trim(domain)) AS domain, n, CAST('0x' || substr(md5(doc_id || ':42'), 1, 15) AS BIGINT) AS h FROM documents JOIN counts ON id = doc_id WHERE n > 0 AND domain IS NOT NULL),
        queue AS (SELECT *, sum(n) OVER (PARTITION BY domain ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) AS served, sum(n) OVER (PARTITION BY domain) AS domain_tokens FROM own WHERE domain IN (SELECT domain FROM weights)),
        totals AS (SELECT experiment_id, floor(any_value(size_factor) * sum(domain_tokens)) AS budget FROM weights JOIN (SELECT DISTINCT domain, domain_tokens FROM queue) USING (domain) GROUP BY experiment_id),
        uses AS (SELECT experiment_id, domain, doc_id, n, budget, use, (CAST((use - 1) * domain_tokens + served AS BIGINT) / weight) AS finish
            FROM (SELECT *, unnest(range(1, max_repeats + 1)) AS use FROM queue JOIN weights USING (domain)) JOIN totals USING (experiment_id)),
        taken AS (SELECT *, sum(n) OVER (PARTITION BY experiment_id ORDER BY finish, domain, use, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM uses),
        mixture AS (SELECT experiment_id, domain, doc_id, count(*) AS repeats, any_value(n) AS n_tokens FROM taken WHERE upto <= budget GROUP BY ALL)
        {then}"""


_ITEMS = f"""f AS (SELECT task_id, prompt AS x FROM benchmark_problems UNION ALL SELECT task_id, canonical_solution FROM benchmark_problems UNION ALL SELECT task_id, unnest(test_cases) FROM benchmark_problems),
        fw AS (SELECT task_id, {_WORDS.format('x')} AS w FROM f WHERE x IS NOT NULL),
        iw AS (SELECT DISTINCT task_id, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT task_id, w, unnest(range(1, len(w) - 10)) AS i FROM fw)),
        dw AS (SELECT doc_id, i, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents WHERE text IS NOT NULL)))"""
_SPLIT = "lower(trim(split_name))"
_SIDE = f"CASE WHEN {_SPLIT} = lower(train_split) THEN 'train' WHEN {_SPLIT} = lower(val_split) THEN 'val' WHEN {_SPLIT} = lower(test_split) THEN 'test' END"
_RECORDS = "SELECT 'knowledge_documents' AS c, doc_id AS id, any_value(content) AS x FROM knowledge_documents WHERE doc_id IS NOT NULL GROUP BY doc_id UNION ALL SELECT 'instruction_records', record_id, any_value(output) FROM instruction_records WHERE record_id IS NOT NULL GROUP BY record_id"
_NEAR = f"""{_shingles(_RECORDS, 30)},
        o AS (SELECT a.c, a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.c = b.c AND a.g = b.g AND a.id < b.id GROUP BY 1, 2, 3),
        e AS (SELECT o.c, a, b FROM o JOIN n x ON x.c = o.c AND x.id = a JOIN n y ON y.c = o.c AND y.id = b WHERE 2 * k >= x.n + y.n - k),
        l AS (SELECT c, a, b FROM e UNION ALL SELECT c, b, a FROM e),
        r AS (SELECT c, a, b FROM l UNION SELECT r.c, r.a, l.b FROM r JOIN l ON l.c = r.c AND l.a = r.b)"""
_OVERLAPS = f"""m AS (SELECT DISTINCT sample_id, dataset_name, source, content, {_SIDE} AS side FROM split_samples JOIN dataset_configs USING (dataset_name) WHERE sample_id IS NOT NULL AND content IS NOT NULL),
        {_shingles("SELECT DISTINCT side = 'train' AS c, sample_id AS id, content AS x FROM m WHERE side IS NOT NULL", 20)},
        o AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.c AND NOT b.c GROUP BY 1, 2),
        p AS (SELECT a, b, k / (x.n + y.n - k) AS similarity FROM o JOIN n x ON x.c AND x.id = a JOIN n y ON NOT y.c AND y.id = b WHERE a <> b AND k >= 0.6 * (x.n + y.n - k))"""
_REPEATED = """w AS (SELECT doc_id, i, hash(substr(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)),
        starts AS (SELECT DISTINCT doc_id, i FROM w JOIN (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1) USING (h))"""

ORACLES: dict[str, str] = {
    "p1_found": f"WITH RECURSIVE {_NEAR} SELECT a AS record_a, b AS record_b FROM r WHERE a < b",
    "p1_groups": f"""
        WITH RECURSIVE {_NEAR},
        d AS (SELECT DISTINCT l.c, l.a, t.x FROM l JOIN t ON t.c = l.c AND t.id = l.b JOIN t own ON own.c = l.c AND own.id = l.a WHERE own.x <> t.x)
        SELECT n.c AS corpus, n.id, least(n.id, coalesce((SELECT min(b) FROM r WHERE r.c = n.c AND r.a = n.id), n.id)) AS group_id, (SELECT count(*) FROM d WHERE d.c = n.c AND d.a = n.id) AS links
        FROM n""",
    "p2_mixture": _mixture("SELECT * FROM mixture"),
    "p2_shares": _mixture("""SELECT experiment_id, domain, round(weight / sum(weight) OVER (PARTITION BY experiment_id), 9) AS target_share, coalesce(round(t / sum(t) OVER (PARTITION BY experiment_id), 9), 0) AS share, t AS tokens,
            CAST(coalesce(domain_tokens, 0) AS BIGINT) AS domain_tokens, coalesce(documents, 0) AS documents, coalesce(most_repeats, 0) AS most_repeats, max_repeats
        FROM (SELECT weights.*, domain_tokens, documents, most_repeats, CAST(coalesce(tokens, 0) AS BIGINT) AS t FROM weights
            LEFT JOIN (SELECT experiment_id, domain, count(*) AS documents, sum(repeats * n_tokens) AS tokens, max(repeats) AS most_repeats FROM mixture GROUP BY ALL) USING (experiment_id, domain)
            LEFT JOIN (SELECT domain, sum(n) AS domain_tokens FROM own GROUP BY domain) USING (domain))"""),
    "p3_found": """
        SELECT DISTINCT k.doc_id
        FROM knowledge_documents k
        LEFT JOIN chunk_settings s ON lower(trim(s.doc_type)) = lower(trim(k.doc_type))
        CROSS JOIN (SELECT chunk_size FROM chunk_settings WHERE doc_type = 'txt') t
        WHERE length(k.content) > coalesce(s.chunk_size, t.chunk_size)""",
    "p3_rebuilt": """
        SELECT k.doc_id, any_value(length(content)) AS chars, md5(any_value(content)) AS digest, any_value(coalesce(s.chunk_overlap, t.chunk_overlap)) AS overlap, CAST(0 AS BIGINT) AS oversized, CAST(0 AS BIGINT) AS misplaced
        FROM knowledge_documents k
        LEFT JOIN chunk_settings s ON lower(trim(s.doc_type)) = lower(trim(k.doc_type))
        CROSS JOIN (SELECT chunk_size, chunk_overlap FROM chunk_settings WHERE doc_type = 'txt') t
        WHERE length(k.content) > coalesce(s.chunk_size, t.chunk_size)
        GROUP BY k.doc_id""",
    "p4_corpora": f"""
        WITH RECURSIVE {_tokens("SELECT 'd' AS c, CAST(doc_id AS VARCHAR) AS id, any_value(text) AS x FROM documents GROUP BY doc_id UNION ALL SELECT 'k', doc_id, any_value(content) FROM knowledge_documents GROUP BY doc_id")},
        dl AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id, coalesce(source, '(none)') AS source, coalesce({_LANGUAGE.format('lang')}, '(none)') AS lang, coalesce(lower(trim(domain)), '(none)') AS domain FROM documents),
        kl AS (SELECT DISTINCT doc_id AS id, coalesce(lower(trim(doc_type)), '(none)') AS doc_type, coalesce({_LANGUAGE.format("metadata['lang']")}, '(none)') AS lang FROM knowledge_documents)
        SELECT 'documents' AS corpus, coalesce(source, '(all)') AS source, coalesce(lang, '(all)') AS lang, coalesce(domain, '(all)') AS domain, CAST(NULL AS VARCHAR) AS doc_type, {_TOTALS} FROM dl JOIN counts ON counts.c = 'd' AND counts.id = dl.id GROUP BY CUBE (source, lang, domain)
        UNION ALL
        SELECT 'knowledge_documents', NULL, coalesce(lang, '(all)'), NULL, coalesce(doc_type, '(all)'), {_TOTALS} FROM kl JOIN counts ON counts.c = 'k' AND counts.id = kl.id GROUP BY CUBE (doc_type, lang)""",
    "p4_batches": f"""
        WITH RECURSIVE {_tokens("SELECT 'c' AS c, conv_id || '|' || turn AS id, any_value(content) AS x FROM chat_messages GROUP BY conv_id, turn")},
        m AS (SELECT DISTINCT conv_id || '|' || turn AS id, coalesce(batch_id, '(none)') AS batch_id, coalesce(source, '(none)') AS source FROM chat_messages),
        cube AS (SELECT coalesce(batch_id, '(all)') AS batch_id, coalesce(source, '(all)') AS source, {_TOTALS} FROM m JOIN counts USING (id) GROUP BY CUBE (batch_id, source)),
        whole AS (SELECT cube.*, source = '(all)' AND batch_id <> '(all)' AS whole, total_tokens, total_conversations FROM cube LEFT JOIN conversation_statistics USING (batch_id))
        SELECT batch_id, source, records, usable, tokens, unknown_tokens, CASE WHEN whole THEN total_tokens END AS reported_tokens,
            CASE WHEN NOT whole THEN NULL WHEN total_tokens IS NULL THEN 'missing' WHEN total_tokens = 0 THEN 'zero' WHEN total_tokens = tokens THEN 'equal'
                WHEN total_tokens > tokens AND total_tokens % greatest(coalesce(total_conversations, 1), 1) = 0 THEN 'padded' ELSE 'different' END AS report
        FROM whole""",
    "p6_found": f"WITH {_OVERLAPS} SELECT DISTINCT least(a, b) AS sample_a, greatest(a, b) AS sample_b FROM p",
    "p6_by_split": f"""
        WITH {_OVERLAPS}
        SELECT e.dataset_name AS dataset_eval, e.side, e.source AS source_eval, count(*) AS pairs, count(DISTINCT b) AS samples, count(DISTINCT a) AS training_samples, round(avg(similarity), 4) AS mean_similarity
        FROM p JOIN (SELECT DISTINCT sample_id, dataset_name, side, source FROM m WHERE side IN ('val', 'test')) e ON e.sample_id = b
        GROUP BY ALL""",
    "p7_totals": f"""
        WITH RECURSIVE {_DOCUMENT_TOKENS}
        SELECT experiment_id, count(*) AS documents, count(*) FILTER (n > k) AS cut_documents, CAST(sum(greatest(1, (n + k - 1) // k)) AS BIGINT) AS parts, CAST(sum(n) AS BIGINT) AS tokens,
            CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS wrong_unused, true AS as_few_as_first_fit
        FROM counts, (SELECT experiment_id, CAST(max_sequence_length AS BIGINT) AS k FROM pretraining_configs) GROUP BY experiment_id""",
    "p8_found": f"WITH {_ITEMS} SELECT DISTINCT doc_id, task_id FROM dw JOIN iw USING (g)",
    "p8_by_task": f"WITH {_ITEMS} SELECT task_id, count(DISTINCT doc_id) AS documents, CAST(count(DISTINCT (doc_id, i)) AS BIGINT) AS windows FROM dw JOIN iw USING (g) GROUP BY task_id",
    "p9_found": f"WITH {_REPEATED} SELECT DISTINCT doc_id FROM starts",
    "p9_shared": f"""
        WITH {_REPEATED},
        runs AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 300 THEN 0 ELSE 1 END AS new FROM starts)),
        spans AS (SELECT doc_id, run, max(i) - min(i) + 300 AS chars FROM runs GROUP BY doc_id, run)
        SELECT doc_id, (SELECT length(any_value(text)) FROM documents d WHERE d.doc_id = spans.doc_id) AS n_chars, count(*) AS spans, CAST(sum(chars) AS BIGINT) AS shared_chars FROM spans GROUP BY doc_id""",
}
