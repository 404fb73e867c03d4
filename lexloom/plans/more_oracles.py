"""SQL of the round trips and of queries that take lists or recursion to say."""

from __future__ import annotations

from .oracles import KNN, MENTIONS, ORACLE_SQL, TOKEN, TOKENS

#: Words as the offline tagger takes them, with the characters before them.
_WORD = r"[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*"
TAGGED = rf"""
    parts AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS t, string_split_regex(text, '{_WORD}') AS g FROM documents WHERE text IS NOT NULL),
    seq AS (SELECT doc_id, text, unnest(t) AS w, unnest(g[1:len(t)]) AS gap, unnest(range(len(t))) AS idx FROM parts),
    placed AS (SELECT doc_id, text, w, (sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - length(w))::BIGINT AS start_ FROM seq),
    tagged AS (SELECT doc_id, w, start_, CASE WHEN regexp_matches(w, '[0-9]') AND regexp_matches(w, '\p{{L}}') THEN 'GENE'
                      WHEN regexp_matches(w, '^\p{{Lu}}') AND regexp_matches(substr(text, greatest(start_ - 64, 0) + 1, least(64, start_)), '[^\s.!?]\s*$') THEN 'CHEMICAL' END AS label FROM placed)
"""
PAIRS = "pairs AS (SELECT * FROM (SELECT conv_id * 1000 + turn AS key, text AS a, lead(text) OVER w AS b, lead(turn) OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE n IS NOT NULL)"

MORE: dict[str, str] = {
    "csv_with_index": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id, md5(coalesce(text, '')) AS text_md5, source FROM documents",
    "csv_without_order": "SELECT row_number() OVER (ORDER BY p_retailprice::DECIMAL(12,2), p_partkey) - 1 AS idx, p_partkey FROM part",
    "tsv_with_header": "SELECT p_partkey, p_type FROM part",
    "tsv_without_header": "SELECT p_partkey, CASE WHEN p_size % 7 <> 0 THEN p_type END AS p_type FROM part",
    "json_lines": "SELECT conv_id, turn, md5(text) AS text_md5 FROM conversations",
    "json_array": "SELECT n_nationkey, n_name FROM nation",
    "keyed_json": "SELECT n_nationkey::VARCHAR AS key, n_name, n_regionkey FROM nation",
    "text_lines": "SELECT p_type AS line, count(*) AS count FROM part GROUP BY 1",
    "whole_texts": "SELECT n_nationkey::VARCHAR AS key, n_name || chr(10) AS text FROM nation",
    "rows_to_documents": "SELECT c_custkey::VARCHAR AS source, 'c_name: ' || c_name || chr(10) || 'c_nationkey: ' || c_nationkey AS page_content FROM customer",
    "rows_in_memory": "SELECT * FROM (VALUES (1, 'a'), (2, NULL)) t(k, v)",
    "stored_vectors": "SELECT vec_id, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings",
    "span_annotations": "SELECT n_name AS text, 0 AS start, length(n_name)::INTEGER AS \"end\", 'NATION' AS label FROM nation",
    "append_and_resume": "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS n_keys FROM orders GROUP BY 1",
    "replaced_table": "SELECT n_nationkey, lower(n_name) AS n_name FROM nation WHERE n_regionkey <> 1",
    "folds_on_disk": f"SELECT fold, split, sum(rows)::BIGINT AS rows FROM ({ORACLE_SQL['fold_report']}) GROUP BY ALL",
    "span_corpus_on_disk": f"WITH {TOKENS}, {MENTIONS} SELECT type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM mentions GROUP BY 1",
    "html_report": "SELECT '<table><thead><tr><th>r_regionkey</th><th>r_name</th></tr></thead><tbody>' || string_agg('<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>', '' ORDER BY r_regionkey) || '</tbody></table>' AS html FROM region",
    "named_columns": "SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'France' WHEN 'NATION_1' THEN 'first' ELSE n_name END AS n_name FROM nation",
    "contains_after_cast": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE contains(o_orderkey::VARCHAR, '77') GROUP BY 1",
    "frequency_order": "SELECT p_type, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, p_type) - 1 AS place FROM part GROUP BY p_type",
    "first_of_ties": "SELECT l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1",
    "trimmed_ties": "SELECT p_size, count(*) AS n FROM (SELECT p_size, row_number() OVER (ORDER BY p_size) AS i, count(*) OVER () AS c FROM part) WHERE i > 25 AND i <= c - 11 GROUP BY 1",
    "numbered_by_text_and_decimal": "SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_retailprice::DECIMAL(12,2), p_partkey) - 1 AS n FROM part",
    "constant_lookup": "SELECT r_regionkey, CASE r_regionkey WHEN 0 THEN 'zero' WHEN 3 THEN 'three' ELSE 'other' END AS said FROM region",
    "highlighted_runs": f"""WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS n FROM conversations)
        SELECT conv_id, turn, unnest(range(CASE WHEN n > 3 THEN 3 WHEN n = 3 THEN 2 WHEN n > 0 THEN 1 ELSE 0 END)) AS pos, CASE WHEN n >= 3 AND unnest(range(CASE WHEN n > 3 THEN 3 WHEN n = 3 THEN 2 WHEN n > 0 THEN 1 ELSE 0 END)) = 1 THEN 'X' END AS label FROM t""",
    "labelled_pieces": f"""WITH t AS (SELECT conv_id, role = 'assistant' AS a, len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS n FROM conversations)
        SELECT conv_id, sum(n)::BIGINT AS n_tokens, count(*) FILTER (a) AS n_spans, coalesce(sum(n) FILTER (a), 0)::BIGINT AS n_covered FROM t GROUP BY 1""",
    "python_literals": r"""SELECT conv_id, count(*) AS n, md5(string_agg('PubMedID: ' || turn || chr(10) || 'Text: . ' || translate(coalesce(text, ''), '''"\' || chr(10), ''), '|' ORDER BY turn)) AS contents_md5 FROM conversations GROUP BY 1""",
    "recursive_chunks": "SELECT doc_id, md5(text) AS text_md5, true AS fits FROM documents WHERE text IS NOT NULL",
    "graph_from_arrays": "SELECT l_orderkey AS graph_id, 'o' || l_orderkey AS src, 'p' || (l_partkey % 7) AS dst, arg_max(l_returnflag, (l_linenumber, l_returnflag)) AS label FROM lineitem GROUP BY 1, 2, 3",
    "failing_rows_alone": "SELECT conv_id, turn, length(coalesce(text, '')) % 2 = 1 AS failed, length(coalesce(text, '')) % 2 = 1 AS said_why FROM conversations",
    "indexed_neighbours": f"SELECT query_id, vec_id, round(score, 6) AS score, rank FROM ({KNN}) WHERE rank <= 10",
    # Greedy over each document's spans, longest first, kept ones in a list.
    "resolve_overlaps": """WITH s AS (SELECT doc_id, unnest(range(0, length(text) + 1, 700)) AS s, 60 AS w, 'A' AS label FROM documents UNION ALL SELECT doc_id, unnest(range(0, length(text) + 1, 410)), 45, 'B' FROM documents
                   UNION ALL SELECT doc_id, unnest(range(0, length(text) + 1, 530)), 75, 'C' FROM documents),
             a AS (SELECT doc_id, list([{'s': s, 'e': s + w, 'l': label}] ORDER BY -w, s, label) AS x FROM s GROUP BY 1),
             k AS (SELECT doc_id, list_reduce(x, lambda acc, y: CASE WHEN len(list_filter(acc, lambda z: z.s < y[1].e AND y[1].s < z.e)) > 0 THEN acc ELSE list_concat(acc, y) END) AS kept FROM a)
        SELECT doc_id, e.s::INTEGER AS start, e.e::INTEGER AS "end", e.l AS label FROM (SELECT doc_id, unnest(kept) AS e FROM k)""",
    "ner_offline": f"WITH {TAGGED} SELECT doc_id, label, count(*) AS n, sum(start_)::BIGINT AS starts, sum(length(w))::BIGINT AS chars FROM tagged WHERE label IS NOT NULL AND length(w) >= 2 GROUP BY ALL",
    "relations_offline": f"""WITH {TAGGED}, l AS (SELECT doc_id, coalesce(list_sort(list(w || ' (CHEMICAL)') FILTER (label = 'CHEMICAL')), []) AS c, coalesce(list_sort(list(w || ' (GENE)') FILTER (label = 'GENE')), []) AS g FROM tagged WHERE label IS NOT NULL GROUP BY 1)
        SELECT doc_id AS key, array_to_string(list_transform(range(1, least(len(c), len(g)) + 1), lambda i: replace(c[i], ' (CHEMICAL)', '') || '>INHIBITOR>' || replace(g[i], ' (GENE)', '')), ';') AS relations FROM l""",
    "embed_offline": """WITH w AS (SELECT conv_id * 1000 + turn AS key, md5(unnest(regexp_extract_all(lower(coalesce(text, '')), '[^\\s]+'))) AS h FROM conversations),
             v AS (SELECT key, ('0x' || substr(h, 1, 2))::INTEGER % 64 AS dim, sum(CASE WHEN ('0x' || substr(h, 15, 2))::INTEGER >= 128 THEN 1 ELSE -1 END) AS x FROM w GROUP BY ALL)
        SELECT key, dim, round((x / sqrt(sum(x * x) OVER (PARTITION BY key)))::FLOAT::DOUBLE, 4) AS value FROM v WHERE x <> 0""",
    # u[j]: the longest common subsequence so far that ends at b's j-th token.
    "rouge_longest": f"""WITH RECURSIVE {PAIRS},
             t AS (SELECT key, regexp_extract_all(coalesce(a, ''), '{TOKEN}') AS a, regexp_extract_all(coalesce(b, ''), '{TOKEN}') AS b FROM pairs),
             r AS (SELECT key, 1 AS i, list_transform(b, lambda x: 0::BIGINT) AS u FROM t UNION ALL
                   SELECT r.key, i + 1, list_transform(range(1, len(b) + 1), lambda j: CASE WHEN b[j] = a[i] THEN 1 + coalesce(list_max(u[1:j - 1]), 0) ELSE u[j] END) FROM r JOIN t ON r.key = t.key WHERE i <= len(a))
        SELECT t.key, round(CASE WHEN len(a) + len(b) > 0 THEN 2 * coalesce(list_max(u), 0) / (len(a) + len(b)) ELSE 0 END, 6)::DOUBLE AS rouge_l FROM r JOIN t ON r.key = t.key AND i = len(a) + 1""",
}
ORACLE_SQL.update(MORE)
