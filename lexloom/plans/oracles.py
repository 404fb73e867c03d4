"""The catalogue's SQL, for the engine that results are held against."""

from __future__ import annotations

TOKEN = r"[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*|[^\s\p{Z}]"
KW = "(?i)(?:clowns|idiot|moron|stupid|trash|src11|scum|es)"

#: Tokens of documents with idx and character places, as CTE text.
TOKENS = f"""
    parts AS (SELECT doc_id, text, regexp_extract_all(text, '{TOKEN}') AS t FROM documents),
    seq AS (SELECT doc_id, text, unnest(t) AS token, unnest(range(len(t))) AS idx FROM parts),
    gaps AS (SELECT doc_id, unnest(string_split_regex(text, '{TOKEN}')) AS gap, unnest(range(len(string_split_regex(text, '{TOKEN}')))) AS idx FROM documents),
    placed AS (SELECT s.doc_id, s.idx, s.token, length(g.gap) AS gap FROM seq s JOIN gaps g ON g.doc_id = s.doc_id AND g.idx = s.idx),
    tokens AS (SELECT doc_id, idx, token,
                      sum(gap + length(token)) OVER w - length(token) AS start_, sum(gap + length(token)) OVER w AS end_
               FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING))
"""
MENTIONS = """
    mentions AS (SELECT * FROM (SELECT *, CASE WHEN regexp_matches(token, '[0-9].*[0-9]') THEN 'GENE-N' WHEN regexp_matches(token, '[0-9]') THEN 'GENE-Y'
                        WHEN regexp_matches(token, '^[A-Z][a-z]{7,}$') THEN 'CHEMICAL' END AS type FROM tokens) WHERE type IS NOT NULL)
"""
UNIT = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
KNN = f"SELECT a.vec_id AS query_id, b.vec_id, {UNIT} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {UNIT} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0"
RATIOS = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall"
GRAPH = "(SELECT l_orderkey AS g, 's' || (l_suppkey % 5) AS s, 'p' || (l_partkey % 7) AS d, arg_max(l_returnflag, l_linenumber * 1000 + ascii(l_returnflag)) AS f FROM lineitem WHERE (l_linenumber + {0}) % 3 <> 0 GROUP BY ALL)"
PRINTED = r"""printed AS (SELECT conv_id, '[' || string_agg('Document(page_content=''PubMedID: ' || turn || '\nText: . ' || translate(coalesce(text, ''), '''"\' || chr(10), '') || ''', metadata={''relevance_score'': 0.' || (turn + 1) || '})', ', ' ORDER BY turn) || ']' AS documents
                FROM conversations
                GROUP BY conv_id)"""


def _rouge(n: int) -> str:
    gram = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
    side = lambda c: f"SELECT key, g, count(*) AS c FROM (SELECT key, {gram} AS g FROM (SELECT key, t, unnest(range(1, len(t) - {n} + 2)) AS i FROM (SELECT key, list_transform(regexp_extract_all(coalesce({c}, ''), '{TOKEN}'), lambda x: lower(x)) AS t FROM pairs))) GROUP BY ALL"
    return f"""(WITH pa AS ({side('a')}), pb AS ({side('b')}),
        j AS (SELECT coalesce(pa.key, pb.key) AS key, coalesce(pa.c, 0) AS ca, coalesce(pb.c, 0) AS cb FROM pa FULL JOIN pb ON pa.key = pb.key AND pa.g = pb.g),
        s AS (SELECT pairs.key, coalesce(sum(least(ca, cb)), 0)::BIGINT AS shared, coalesce(sum(ca), 0) AS a, coalesce(sum(cb), 0) AS b FROM pairs LEFT JOIN j USING (key) GROUP BY ALL)
        SELECT key, shared AS shared_{n}, round(CASE WHEN shared > 0 THEN 2 * (shared / a) * (shared / b) / (shared / a + shared / b) ELSE 0 END, 6) AS f1_{n} FROM s)"""


ORACLE_SQL: dict[str, str] = {
    "lexicon_terms": "SELECT unnest(['trash', 'clowns', 'moron', 'scum', 'idiot', 'stupid']) AS term",
    "kw_filter_dedup": f"SELECT doc_id, source, lang FROM (SELECT DISTINCT doc_id, text, source, lang FROM documents WHERE regexp_matches(text, '{KW}') OR regexp_matches(source, '{KW}') OR regexp_matches(lang, '{KW}'))",
    "kw_filter_multiset": " UNION ALL ".join(f"SELECT doc_id, source FROM documents WHERE regexp_matches({c}, '{KW}')" for c in ("text", "source", "lang")),
    "kw_filter_array": "SELECT conv_id, count(*) AS n_contexts FROM conversations GROUP BY conv_id HAVING bool_or(coalesce(regexp_matches(text, '(?i)(?:and the|because)'), false))",
    "kw_hits_by_term": f"""WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{TOKEN}'))) AS term FROM documents)
        SELECT term, count(DISTINCT doc_id) AS n_rows, count(*) AS n_hits FROM t WHERE term IN ('trash', 'moron', 'scum', 'idiot', 'the', 'der') GROUP BY term""",
    "kw_filter_large_lexicon": "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(?:moron|idiot|nohit[0-9])')",
    "filter_choice_and_null": "SELECT p_brand, count(*) AS n FROM part WHERE p_size % 7 <> 0 AND NOT contains(p_type, 'BRASS') GROUP BY p_brand",
    "semi_join_keys": "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50) GROUP BY 1",
    "entity_join_clean": f"""WITH {TOKENS}, {MENTIONS}
        SELECT d.source || ' ' || d.lang AS "Text", CASE WHEN m.type LIKE 'GENE%' THEN 'GENE' ELSE m.type END AS "Type", count(*) AS n, count(DISTINCT d.doc_id) AS n_docs
        FROM documents d JOIN mentions m USING (doc_id) WHERE d.doc_id % 10 <> 0 GROUP BY ALL""",
    "spans_per_doc": f"""WITH {TOKENS}, {MENTIONS}
        SELECT doc_id, count(*) AS n_spans, md5(string_agg(start_::BIGINT || ':' || end_::BIGINT || ':' || type, ',' ORDER BY start_)) AS spans_md5 FROM mentions GROUP BY doc_id""",
    "relation_rows": """WITH f AS (SELECT *, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_partkey) AS pn, min(l_linenumber) OVER (PARTITION BY l_orderkey, l_suppkey) AS sn FROM lineitem)
        SELECT l_orderkey AS "PMID", o_orderpriority AS "Text", 'part ' || l_partkey AS "Subject", 'P' || l_partkey AS "Subject_Arg", 'part' AS "Subject_Type", pn AS "Subject_Start", pn + 1 AS "Subject_End",
               'supplier ' || l_suppkey AS "Object", 'S' || l_suppkey AS "Object_Arg", 'supplier' AS "Object_Type", sn AS "Object_Start", sn + 1 AS "Object_End", l_returnflag AS "Relation"
        FROM f JOIN orders ON l_orderkey = o_orderkey""",
    "split_overlap": "SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'",
    "lookup_with_default": "SELECT coalesce(n_name, 'none') AS n_name, count(*) AS n FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey GROUP BY 1",
    "type_value_counts": "SELECT event_type, count(*) AS count FROM events GROUP BY 1",
    "text_length_describe": """WITH s AS (SELECT lang, avg(n_chars)::DOUBLE AS mean, stddev_samp(n_chars) AS std, min(n_chars)::DOUBLE AS min, quantile_cont(n_chars::DOUBLE, 0.25) AS q1, quantile_cont(n_chars::DOUBLE, 0.5) AS q2, quantile_cont(n_chars::DOUBLE, 0.75) AS q3, max(n_chars)::DOUBLE AS max FROM documents GROUP BY lang)
        SELECT lang, stat, round(value, 4) AS value FROM (SELECT lang, unnest(['mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS stat, unnest([mean, std, min, q1, q2, q3, max]) AS value FROM s)""",
    "length_trim_dedup": """WITH r AS (SELECT doc_id, text, length(text) AS length, row_number() OVER (ORDER BY length(text) NULLS LAST, doc_id) AS rn, count(*) OVER () AS n FROM documents),
        k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS first FROM r WHERE rn > 36 AND rn <= n - 2)
        SELECT doc_id, length FROM k WHERE first = 1""",
    "length_histogram": "SELECT lang, floor(n_chars / 250)::BIGINT AS bin, count(*) AS count FROM documents GROUP BY ALL",
    "length_kde": """WITH s AS (SELECT count(*) AS n, stddev_samp(n_chars) AS sd FROM documents), h AS (SELECT n, sd * n ** -0.2 AS h FROM s), g AS (SELECT unnest(range(101)) AS i)
        SELECT i, round(1e6 * sum(exp(-0.5 * ((i * 200.0::DOUBLE - n_chars) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 4) AS density FROM g, documents, h GROUP BY i""",
    "mean_row_scores": "SELECT vec_id, round(list_avg(list_filter(list_transform(embedding, lambda x: x::DOUBLE), lambda x: x > 0)), 6) AS mean_score FROM embeddings",
    "wide_columns": "SELECT vec_id, " + ", ".join(f"CASE WHEN vec_id % 4 >= {i} THEN round(embedding[{i + 1}]::DOUBLE, 6) END AS score_{i + 1}" for i in range(4)) + " FROM embeddings",
    "flag_highest": "SELECT p_partkey, p_brand FROM (SELECT *, max(p_retailprice) OVER (PARTITION BY p_brand) AS top FROM part) WHERE p_retailprice = top",
    "longest_text": "SELECT doc_id AS key, length(text) AS length FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1",
    "ordered_distinct_labels": "SELECT event_type, min(event_id) AS first_pos FROM events GROUP BY 1",
    "dedup_keep_first": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
    "union_all_and_distinct": """WITH u AS (SELECT lang, source FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT lang, source FROM documents WHERE doc_id % 3 = 0)
        SELECT lang, count(*) AS n_all, count(DISTINCT source) AS n_distinct FROM u GROUP BY lang""",
    "last_write_wins": "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "tokenize_counts": f"SELECT doc_id, len(regexp_extract_all(text, '{TOKEN}')) AS n_tokens FROM documents",
    "detokenize_md5": f"""SELECT conv_id, turn, md5(coalesce(list_reduce(regexp_extract_all(coalesce(text, ''), '{TOKEN}'), lambda a, t: CASE WHEN t IN (',', '.', '!', '?', ':', ';', '...') OR a = '' THEN a || t ELSE a || ' ' || t END, ''), '')) AS text_md5 FROM conversations""",
    "tidy_punctuation": r"SELECT conv_id, turn, md5(regexp_replace(regexp_replace(text, '([,.!?])', ' \1', 'g'), '\s([,.!?…:;])', '\1', 'g')) AS text_md5 FROM conversations",
    "prompt_format": "SELECT p_partkey, 'Question: ' || p_name || chr(10) || 'Options: 1) ' || p_brand || ' 2) ' || p_type || ' 3) ' || CASE WHEN p_size > 25 THEN p_size::VARCHAR ELSE 'nan' END || ' 4) ' || p_name AS prompt FROM part",
    "python_dict_text": "SELECT p_partkey, p_name || ': {''A'': ''' || p_brand || ''', ''B'': ''' || p_type || '''}' AS question FROM part",
    "context_parse": rf"""WITH {PRINTED},
        p AS (SELECT conv_id, list_transform(regexp_extract_all(documents, 'page_content=''([^'']*)''', 1), lambda x: ltrim(regexp_replace(x, '(?i).*?Text:', '', 'g'), '. ')) AS c,
                     list_transform(regexp_extract_all(documents, 'relevance_score'': ([0-9.]+)', 1), lambda x: x::DOUBLE) AS s FROM printed)
        SELECT conv_id, md5(c[1]) AS content_1, md5(c[2]) AS content_2, md5(c[3]) AS content_3, md5(c[4]) AS content_4, round(list_avg(s[1:4]), 6) AS mean_relevance_score FROM p""",
    "context_parse_literal": f"WITH {PRINTED} SELECT conv_id, len(regexp_extract_all(documents, 'page_content=''([^'']*)''', 1)) AS n, md5(array_to_string(regexp_extract_all(documents, 'page_content=''([^'']*)''', 1), '|')) AS contents_md5 FROM printed",
    "decode_escapes": r"""WITH r AS (SELECT conv_id, turn, replace(replace(text, chr(10), '\n'), ',', '\\n') AS t FROM conversations)
        SELECT conv_id, turn, md5(replace(replace(replace(replace(replace(replace(replace(t, '\\', '\'), '\"', '"'), '\b', chr(8)), '\f', chr(12)), '\n', chr(10)), '\r', chr(13)), '\t', chr(9))) AS text_md5 FROM r""",
    "chunk_text": "SELECT doc_id, i AS pos, md5(substr(text, 1 + i * 1024, 1024)) AS chunk_md5 FROM (SELECT doc_id, text, unnest(range((length(text) + 1023) // 1024)) AS i FROM documents)",
    "json_extract_validate": "SELECT json_extract(props, '$.k') IS NOT NULL AS valid, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS sum_k FROM events GROUP BY 1",
    "option_extraction": "SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_size % 4 + 1 END AS option FROM part",
    "answer_accuracy": "SELECT round(avg((p_size % 4 = p_size % 5)::INT::DOUBLE), 6) AS accuracy FROM part",
    "char_to_token": f"""WITH {TOKENS}, p AS (SELECT doc_id, unnest(range(0, greatest(length(text), 1), 31)) AS point FROM documents),
        f AS (SELECT p.doc_id, CASE WHEN p.point < t.end_ THEN t.idx END AS idx FROM p ASOF LEFT JOIN tokens t ON p.doc_id = t.doc_id AND p.point >= t.start_)
        SELECT doc_id, count(idx) AS n_on_token, sum(idx)::BIGINT AS sum_idx, count(*) AS n_points FROM f GROUP BY doc_id""",
    "span_contract": f"""WITH {TOKENS}, p AS (SELECT doc_id, s AS start_, s + 23 AS end_ FROM (SELECT doc_id, unnest(range(0, greatest(length(text), 1), 31)) AS s FROM documents)),
        lo AS (SELECT p.doc_id, p.start_, p.end_, t.idx AS a FROM p ASOF JOIN tokens t ON p.doc_id = t.doc_id AND p.start_ <= t.start_),
        hi AS (SELECT lo.*, t.idx AS b FROM lo ASOF JOIN tokens t ON lo.doc_id = t.doc_id AND lo.end_ >= t.end_)
        SELECT doc_id, count(*) AS n, sum(a)::BIGINT AS sum_start, sum(b)::BIGINT AS sum_end FROM hi WHERE a <= b GROUP BY doc_id""",
    "subsequence_match": f"""WITH d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(text, '{TOKEN}'), ' ') || ' ' AS t FROM documents),
        i AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(text, '{TOKEN}'), ' ') || ' ' AS t FROM benchmark)
        SELECT doc_id, item_id, length(replace(substr(d.t, 1, strpos(d.t, i.t) - 1), ' ', '  ')) - strpos(d.t, i.t) + 1 AS first_tok FROM d, i WHERE contains(d.t, i.t)""",
    "merge_adjacent": """WITH c AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
        SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_id FROM r GROUP BY user_id, run, event_type""",
    "merge_spans_array": f"""WITH {TOKENS}, {MENTIONS}, m AS (SELECT doc_id, idx, token, idx - lag(idx) OVER (PARTITION BY doc_id ORDER BY idx) AS step FROM mentions WHERE type = 'CHEMICAL'),
        r AS (SELECT *, sum(CASE WHEN step <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM m)
        SELECT doc_id, min(idx) AS start, max(idx) + 1 AS "end", string_agg(token, ' ' ORDER BY idx) AS text FROM r GROUP BY doc_id, run""",
    "running_offset": "SELECT conv_id, turn, coalesce(sum(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM conversations",
    "relation_records": f"""WITH {TOKENS}, {MENTIONS},
        p AS (SELECT *, lead(token) OVER w AS o, lead(idx) OVER w AS oi, lead(type) OVER w AS ot FROM mentions WINDOW w AS (PARTITION BY doc_id ORDER BY idx)),
        c AS (SELECT doc_id, count(*) AS n_ner, count(o) AS n_relations,
                     md5(string_agg(idx || ':' || idx || ':' || type || ':' || token, ',' ORDER BY idx)) AS ner_md5,
                     md5(array_to_string(list_sort(list(token || ':' || idx || '-' || idx || ':' || type || ':' || o || ':' || oi || '-' || oi || ':' || ot || ':NEXT') FILTER (o IS NOT NULL)), ',')) AS relations_md5
              FROM p GROUP BY 1),
        t AS (SELECT doc_id, count(*) AS n_tokens, md5(string_agg(token, ' ' ORDER BY idx)) AS tokens_md5 FROM tokens GROUP BY 1)
        SELECT doc_id, n_ner, n_relations, n_tokens, ner_md5, relations_md5, tokens_md5 FROM c JOIN t USING (doc_id) WHERE n_ner > 1""",
    "stratified_folds": """WITH s AS (SELECT l_orderkey, string_agg(l_returnflag || n, ',' ORDER BY l_returnflag) AS sig FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1),
        z AS (SELECT sig, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, min(l_orderkey)) - 1 AS rank FROM s GROUP BY sig),
        c AS (SELECT l_orderkey, CASE WHEN size >= 5 THEN rank ELSE -1 END AS class FROM s JOIN z USING (sig))
        SELECT l_orderkey, class, (row_number() OVER (ORDER BY class, md5('42:' || l_orderkey), l_orderkey) - 1) % 5 AS fold FROM c""",
    "shuffle_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM documents",
    "seeded_sample": "SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 750",
    "batching": "SELECT (rn - 1) // 32 AS batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) GROUP BY 1",
    "cursor_neighbours": "SELECT conv_id, turn, coalesce(lag(turn) OVER w, turn) AS previous, coalesce(lead(turn) OVER w, turn) AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "rows_by_position": "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 2 OFFSET 1",
    "knn_topk": f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({KNN}) WHERE rank <= 20",
    "knn_threshold_rerank": f"""WITH k AS (SELECT query_id, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM ({KNN}) WHERE vec_id <> query_id AND score >= 0.2) WHERE r <= 20)
        SELECT query_id, vec_id, rerank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY abs(vec_id - query_id), vec_id) AS rerank FROM k) WHERE rerank <= 4""",
    "contexts_by_seed": f"SELECT query_id AS seed_id, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM ({KNN}) WHERE vec_id <> query_id AND score >= 0.3) WHERE r <= 3",
    "normalised_norms": "SELECT vec_id, 1.0::DOUBLE AS norm, 1.0::DOUBLE AS cosine FROM embeddings",
    "bm25_topk": f"""WITH q(query_id, terms) AS (VALUES (1::BIGINT, ['idiot', 'moron']), (2::BIGINT, ['license', 'public']), (3::BIGINT, ['der', 'die', 'und'])), asked AS (SELECT query_id, unnest(terms) AS term FROM q),
        t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '{TOKEN}'), lambda x: lower(x)) AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t))::DOUBLE AS mean FROM t),
        tf AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))) AS score FROM tf JOIN df USING (term) JOIN asked USING (term), st GROUP BY ALL)
        SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 10""",
    "rrf_fusion": f"""WITH a AS (SELECT * FROM ({KNN}) WHERE rank <= 10), b AS (SELECT * FROM ({KNN.replace('a.embedding', 'a.embedding[1:32]').replace('b.embedding', 'b.embedding[1:32]')}) WHERE rank <= 10)
        SELECT query_id, vec_id, round(sum(s), 8) AS score FROM (SELECT query_id, vec_id, 0.4::DOUBLE / (60 + rank) AS s FROM a UNION ALL SELECT query_id, vec_id, 0.6::DOUBLE / (60 + rank) FROM b) GROUP BY ALL""",
    "stuffed_prompt": f"SELECT query_id, string_agg('Content: ' || n_chars || chr(10) || 'Source: ' || source, chr(10) || chr(10) ORDER BY rank) AS context FROM ({KNN}) k JOIN documents ON doc_id = vec_id WHERE rank <= 4 GROUP BY 1",
    "label_prf": f"""WITH c AS (SELECT lang, toxic = 1 AS t, regexp_matches(text, '(?i)(?:idiot|moron|trash|scum)') AS p FROM documents JOIN labels USING (doc_id)),
        s AS (SELECT lang, count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn, count(*) FILTER (NOT t AND NOT p) AS tn FROM c GROUP BY lang), r AS (SELECT *, {RATIOS} FROM s)
        SELECT lang, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM r""",
    "entity_prf": f"""WITH g AS (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag AS f FROM lineitem WHERE l_quantity > 10),
        p AS (SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE l_returnflag END AS f FROM lineitem WHERE l_quantity < 40),
        b AS (SELECT coalesce(g.f, p.f) AS f, g.f IS NOT NULL AS g, p.f IS NOT NULL AS p FROM g FULL JOIN p ON g.l_orderkey = p.l_orderkey AND g.l_linenumber = p.l_linenumber AND g.f = p.f),
        s AS (SELECT f AS l_returnflag, count(*) FILTER (g AND p) AS tp, count(*) FILTER (NOT g) AS fp, count(*) FILTER (NOT p) AS fn FROM b GROUP BY f UNION ALL SELECT NULL, count(*) FILTER (g AND p), count(*) FILTER (NOT g), count(*) FILTER (NOT p) FROM b), r AS (SELECT *, {RATIOS} FROM s)
        SELECT l_returnflag, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM r""",
    "ngram_overlap": f"""WITH pairs AS (SELECT * FROM (SELECT conv_id * 1000 + turn AS key, text AS a, lead(text) OVER w AS b, lead(turn) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE n IS NOT NULL)
        SELECT * FROM {_rouge(1)} JOIN {_rouge(2)} USING (key)""",
    "context_precision": f"""WITH k AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM ({KNN}) WHERE vec_id <> query_id),
        v AS (SELECT k.query_id, r, (x.label = y.label)::INT AS v FROM k JOIN embeddings x USING (vec_id) JOIN embeddings y ON y.vec_id = k.query_id WHERE r <= 10),
        p AS (SELECT *, sum(v) OVER (PARTITION BY query_id ORDER BY r) / r AS p FROM v)
        SELECT query_id, round(CASE WHEN sum(v) > 0 THEN sum(p * v) / sum(v) ELSE 0 END, 6) AS context_precision FROM p GROUP BY 1""",
    "faithfulness": "SELECT l_orderkey, round(avg((l_returnflag = 'N')::INT), 6) AS faithfulness FROM lineitem GROUP BY 1",
    "answer_relevancy": f"SELECT query_id, round(avg(score), 6) AS answer_relevancy FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM ({KNN}) WHERE vec_id <> query_id) WHERE r <= 3 GROUP BY 1",
    "graph_edges_lastwins": f"SELECT g AS graph_id, s AS src, d AS dst, f AS label FROM {GRAPH.format(0)}",
    "graph_diff": f"""WITH a AS (SELECT * FROM {GRAPH.format(0)}), b AS (SELECT * FROM {GRAPH.format(1)}),
        na AS (SELECT DISTINCT g, unnest([s, d]) AS id FROM a), nb AS (SELECT DISTINCT g, unnest([s, d]) AS id FROM b),
        n AS (SELECT coalesce(na.g, nb.g) AS g, count(*) FILTER (na.g IS NULL OR nb.g IS NULL) AS node_changes FROM na FULL JOIN nb ON na.g = nb.g AND na.id = nb.id GROUP BY 1),
        e AS (SELECT coalesce(a.g, b.g) AS g, count(*) FILTER (a.g IS NULL OR b.g IS NULL) AS edge_changes, count(*) FILTER (a.f <> b.f) AS label_changes FROM a FULL JOIN b ON a.g = b.g AND a.s = b.s AND a.d = b.d GROUP BY 1)
        SELECT g AS graph_id, node_changes, edge_changes, label_changes, node_changes + edge_changes + label_changes AS distance FROM n JOIN e USING (g)""",
    "flagship": f"""WITH {TOKENS}, {MENTIONS}, h AS (SELECT DISTINCT doc_id, text, source, lang FROM documents WHERE regexp_matches(text, '{KW}') OR regexp_matches(source, '{KW}') OR regexp_matches(lang, '{KW}')),
        m AS (SELECT doc_id, count(*) AS n FROM mentions GROUP BY 1)
        SELECT source, count(*) AS n_docs, coalesce(sum(n), 0)::BIGINT AS n_mentions FROM h LEFT JOIN m USING (doc_id) GROUP BY source""",
}
ORACLE_SQL["fold_report"] = f"""WITH f AS ({ORACLE_SQL['stratified_folds']}), x AS (SELECT l.l_orderkey, l_returnflag, k AS fold, CASE WHEN f.fold = k THEN 'val' ELSE 'train' END AS split FROM lineitem l JOIN f USING (l_orderkey), range(5) r(k))
    SELECT fold, split, l_returnflag, count(*) AS rows, count(DISTINCT l_orderkey) AS documents FROM x GROUP BY ALL"""

from . import more_oracles  # noqa: E402,F401  its SQL joins this table
