"""The registered queries as SQL for DuckDB, over the same parquet tables."""

from __future__ import annotations

from quillmill.plans.tables import ACCENTS

_WORDS = r"""w0 AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS ws FROM benchmark),
w AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w0)"""

_DOCS = """docs AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, source || '/' || doc_id || '.txt' AS source_path, text, doc_id, lang, source, n_chars,
  0.5 + (doc_id % 50) / 100.0 AS confidence, CAST(floor(n_chars / 100.0) AS INTEGER) AS page_count FROM documents)"""

_SIGNALS = (
    _DOCS
    + r""", m AS (SELECT *, regexp_replace(text, '\*{3,}|x{3,}|_{3,}|#{3,}|={3,}|-{3,}', '', 'g') AS c, regexp_extract_all(text, '[-=#_x*]{2,}') AS segs FROM docs),
r AS (SELECT *, CASE WHEN length(c) > 0 THEN (length(c) - length(regexp_replace(c, '[^\pL\pN \n\t.,:;?!''"/()-]', '', 'g'))) / length(c)::DOUBLE ELSE 0 END AS garbled,
  CASE WHEN len(segs) > 0 THEN len(list_filter(segs, lambda s: NOT regexp_full_match(s, '\*{3,}|x{3,}|_{3,}|#{3,}|={3,}|-{3,}'))) / len(segs)::DOUBLE ELSE 0 END AS bad FROM m),
s AS (SELECT *, concat_ws(',', CASE WHEN confidence < 0.7 THEN 'low_confidence' END, CASE WHEN page_count = 0 OR page_count > 200 THEN 'page_count_anomaly' END,
  CASE WHEN garbled > 0.3 THEN 'garbled_text' END, CASE WHEN bad > 0.05 THEN 'redaction_garbled' END) AS signals FROM r)"""
)

_LINES = """lines AS (SELECT document_id, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs),
spans0 AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS st FROM lines),
spans AS (SELECT document_id, CAST(i - 1 AS INTEGER) AS ord, st AS start, CAST(st + length(line) AS INTEGER) AS "end", line FROM spans0 WHERE length(line) > 0)"""

_WINDOWS = """win AS (SELECT document_id, CAST(k AS INTEGER) AS chunk_index, CAST(k * 700 AS INTEGER) AS start_char, CAST(least(k * 700 + 700, length(text)) AS INTEGER) AS end_char, substring(text, CAST(k * 700 + 1 AS INTEGER), 700) AS text
  FROM (SELECT document_id, text, unnest(range(CAST(ceil(length(text) / 700.0) AS BIGINT))) AS k FROM docs WHERE length(text) > 0))"""

# the entities of plans.tables.enriched, one row a mention
_ENTITIES = """b AS (SELECT document_id, doc_id, text, length(text) AS n, CAST(floor(length(text) / 2.0) AS INTEGER) AS h FROM docs),
sp AS (SELECT *, 0 AS f0, CAST(least(n, 10) AS INTEGER) AS f1, CAST(greatest(0, n - 8) AS INTEGER) AS l0, CAST(n AS INTEGER) AS l1, greatest(0, h - 5) AS m0, h + 5 AS m1 FROM b),
men AS (
  SELECT document_id, doc_id, text, 'p1' AS entity_id, 'person' AS entity_label, substring(text, f0 + 1, f1 - f0) AS name, 'natural' AS entity_type, 'other' AS role, f0 AS s, f1 AS e FROM sp
  UNION ALL SELECT document_id, doc_id, text, 'p1', 'person', substring(text, f0 + 1, f1 - f0), 'natural', 'other', l0, l1 FROM sp
  UNION ALL SELECT document_id, doc_id, text, 'p2', 'person', substring(text, f0 + 1, f1 - f0), 'corporate', 'other', m0, m1 FROM sp
  UNION ALL SELECT document_id, doc_id, text, 'l1', 'location', substring(text, m0 + 1, m1 - m0), CASE WHEN doc_id % 2 = 0 THEN 'address' ELSE 'city' END, '', m0, m1 FROM sp
  UNION ALL SELECT document_id, doc_id, text, 'l1', 'location', substring(text, m0 + 1, m1 - m0), CASE WHEN doc_id % 2 = 0 THEN 'address' ELSE 'city' END, '', l0, l1 FROM sp
  UNION ALL SELECT document_id, doc_id, text, 't1', 'term', substring(text, l0 + 1, l1 - l0), '', '', f0, f1 FROM sp
  UNION ALL SELECT document_id, doc_id, text, 'x1', 'external_document', substring(text, f0 + 1, f1 - f0), 'statute', '', m0, m1 FROM sp)"""

_MENTIONS = f"""{_DOCS}, {_WINDOWS}, {_ENTITIES},
mentions AS (SELECT document_id, entity_id, entity_label, name, entity_type, role, s AS mention_start, e AS mention_end,
  CAST(coalesce((SELECT min(w.chunk_index) FROM win w WHERE w.document_id = men.document_id AND w.start_char < men.e AND men.s < w.end_char), -1) AS INTEGER) AS chunk_index FROM men)"""

_EDGES = f"""{_DOCS}, {_WINDOWS}, {_ENTITIES},
sc AS (SELECT w.document_id, 'chunk:' || w.chunk_index AS c, w.start_char, w.end_char FROM win w),
e0 AS (
  SELECT document_id, document_id AS source_id, document_id || ':' || c AS target_id, 'contains' AS relation, NULL AS k1, NULL AS v1, NULL AS k2, NULL AS v2 FROM sc
  UNION ALL SELECT document_id, document_id, document_id || ':s1', 'contains', NULL, NULL, NULL, NULL FROM sp
  UNION ALL SELECT document_id, document_id || ':s1', document_id || ':s2', 'parent_of', NULL, NULL, NULL, NULL FROM sp
  UNION ALL SELECT sp.document_id, sp.document_id || ':s1', sp.document_id || ':' || c, 'spans_chunk', NULL, NULL, NULL, NULL FROM sp JOIN sc ON sc.document_id = sp.document_id AND sc.start_char < sp.n AND 0 < sc.end_char
  UNION ALL SELECT sp.document_id, sp.document_id || ':s2', sp.document_id || ':' || c, 'spans_chunk', NULL, NULL, NULL, NULL FROM sp JOIN sc ON sc.document_id = sp.document_id AND sc.start_char < m1 AND m0 < sc.end_char
  UNION ALL SELECT document_id, document_id || ':p1', document_id || ':p2', 'parent_of', NULL, NULL, NULL, NULL FROM sp
  UNION ALL SELECT document_id, document_id || ':p1', document_id || ':l1', 'resides_at', NULL, NULL, NULL, NULL FROM sp
  UNION ALL SELECT men.document_id, men.document_id || ':' || entity_id, men.document_id || ':' || c, 'mentioned_in', 'start', CAST(s AS VARCHAR), 'end', CAST(e AS VARCHAR) FROM men JOIN sc ON sc.document_id = men.document_id AND sc.start_char < e AND s < sc.end_char
  UNION ALL SELECT document_id, document_id, document_id || ':x1', 'cites', 'reception', 'neutral', NULL, NULL FROM sp
  UNION ALL SELECT document_id, document_id || ':s1', document_id || ':s2', 'crossreferences', 'span_start', CAST(l0 AS VARCHAR), 'span_end', CAST(l1 AS VARCHAR) FROM sp
  UNION ALL SELECT sp.document_id, sp.document_id || ':s1', sp.document_id || ':' || c, 'crossref_in', 'start', CAST(l0 AS VARCHAR), 'end', CAST(l1 AS VARCHAR) FROM sp JOIN sc ON sc.document_id = sp.document_id AND sc.start_char < l1 AND l0 < sc.end_char
  UNION ALL SELECT document_id, document_id || ':p1', document_id || ':p1', 'has_email', 'address', 'm' || document_id || '@example.org', NULL, NULL FROM sp
  UNION ALL SELECT document_id, document_id, CASE WHEN doc_id % 3 = 0 THEN document_id || ':p1' ELSE document_id END, 'date_effective', 'value', '2024-01-31', NULL, NULL FROM sp),
edges AS (
  SELECT document_id, source_id, target_id, relation, coalesce(k1, '') AS prop_key, coalesce(v1, '') AS prop_value FROM e0
  UNION ALL SELECT document_id, source_id, target_id, relation, k2, v2 FROM e0 WHERE k2 IS NOT NULL)"""

_SHEET = """sheet AS (SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS c_acctbal, c_mktsegment, c_custkey - 1 AS row_index FROM customer),
copy AS (SELECT CASE WHEN c_custkey % 97 = 0 THEN CAST(c_custkey - 1 AS VARCHAR) ELSE CAST(c_custkey AS VARCHAR) END AS c_custkey, CASE WHEN c_custkey % 101 = 0 THEN upper(c_name) ELSE c_name END AS c_name,
  CAST(c_nationkey AS VARCHAR) AS c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS c_acctbal, c_mktsegment AS c_segment, c_custkey - 1 AS row_index FROM customer)"""
_BAD = "(CASE WHEN s.c_custkey <> e.c_custkey THEN 1 ELSE 0 END + CASE WHEN s.c_name <> e.c_name THEN 1 ELSE 0 END)"


def _sheet(name: str, cols: list[str], key: str) -> str:
    lens = " + ".join(f"length(coalesce(CAST({c} AS VARCHAR), ''))" for c in cols)
    first, *rest = cols
    sub = " AND ".join([f"trim(CAST({first} AS VARCHAR)) <> ''", *(f"trim(coalesce(CAST({c} AS VARCHAR), '')) = ''" for c in rest)])
    n = len(cols)
    return f"""SELECT '{name}' AS name, CASE WHEN {n} = 1 OR ({n} <= 3 AND a > 150) THEN 'narrative' WHEN {n} = 2 AND r BETWEEN 50 AND 500 THEN 'glossary' WHEN {n} = 2 AND r < 50 THEN 'key_value' ELSE 'data' END AS sheet_type,
      r AS row_count, CAST({n} AS BIGINT) AS col_count, '{key}' AS key_column, subs > 2 AS has_sub_headers FROM (SELECT count(*) AS r, sum({lens}) / (count(*) * {n}.0) AS a, count(*) FILTER ({sub}) AS subs FROM {name})"""


def _dot(a: str, b: str) -> str:
    return f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


_KNOWN = f"""{_DOCS}, {_ENTITIES},
known AS (
  SELECT document_id, f0 AS start, f1 AS "end", 'PERSON' AS entity_type FROM sp UNION ALL SELECT document_id, l0, l1, 'PERSON' FROM sp
  UNION ALL SELECT document_id, m0, m1, 'ADDRESS' FROM sp WHERE doc_id % 2 = 0 UNION ALL SELECT document_id, l0, l1, 'ADDRESS' FROM sp WHERE doc_id % 2 = 0
  UNION ALL SELECT document_id, l0, l1, 'EMAIL' FROM sp)"""

_FOOT = r"[FP]''?"

ORACLE: dict[str, str] = {
    "verify_weak_signals": f"WITH {_SIGNALS} SELECT document_id, signals, left(text, 200) AS snippet FROM s WHERE signals <> ''",
    "verify_structural": f"""WITH {_DOCS} SELECT '' AS missing_columns, count(*) - count(DISTINCT document_id) AS duplicate_ids, count(*) FILTER (confidence < 0 OR confidence > 1) AS bad_confidence,
      count(*) FILTER (page_count < 0) AS bad_page_count, count(*) AS total_docs,
      count(*) = count(DISTINCT document_id) AND count(*) FILTER (confidence < 0 OR confidence > 1) = 0 AND count(*) FILTER (page_count < 0) = 0 AS structural_passed FROM docs""",
    "verify_status": f"""WITH {_SIGNALS}, t AS (SELECT count(*) AS total_docs, count(*) FILTER (signals <> '') AS flagged, count(*) = count(DISTINCT document_id) AS ok FROM s)
      SELECT CASE WHEN NOT ok THEN 'failed' WHEN flagged = 0 THEN 'passed' WHEN flagged / total_docs::DOUBLE > 0.15 THEN 'failed' ELSE 'warning' END AS overall_status, ok AS structural_passed,
      CASE WHEN ok THEN flagged ELSE 0 END AS flagged_count, total_docs FROM t""",
    "normalise_text": f"""WITH {_DOCS}, raw AS (SELECT document_id, 'the author’ $ and clerk''$ note' || chr(10) || ' 12 | P a g e' || chr(10) || text || chr(10) || 'http:llwww.example.org' AS t FROM docs),
      a AS (SELECT document_id, replace(replace(replace(replace(replace(replace(t, '’ $', '’s'), '’$', '’s'), ''' $', '''s'), '''$', '''s'), '’€', '’s'), '''€', '''s') AS t FROM raw),
      u AS (SELECT document_id, regexp_replace(t, 'http[_IlL/.:\\s]+([Ww])', 'http://\\1', 'g') AS t FROM a),
      f AS (SELECT document_id, regexp_replace(t, '(?m)^\\s*\\d+\\s*[&|]\\s*{_FOOT}\\s*[20&a]\\s*[<328&g]\\s*[\\dF?P€&e]\\s*$', '', 'g') AS t FROM u)
      SELECT document_id, regexp_replace(t, '(?m)^\\s*\\d{{1,2}}\\s*[&|]?\\s*$\\n\\s*{_FOOT}\\s+[20&a]\\s+[<328&g]\\s*[\\dF?P€&e]?\\s*$', '', 'g') AS text FROM f""".replace("\\\\", "\\"),
    "text_coverage": f"WITH {_DOCS}, p AS (SELECT document_id, string_split(text, chr(10)) AS l FROM docs) SELECT document_id, round(len(list_filter(l, lambda t: length(trim(t)) > 50)) / len(l)::DOUBLE, 6) AS coverage, len(l) AS n_pages FROM p",
    "full_text_pages": f"""WITH {_DOCS}, p AS (SELECT document_id, string_split(text, chr(10)) AS l FROM docs)
      SELECT document_id, array_to_string(list_filter(l, lambda t: t <> ''), chr(10) || chr(10)) AS full_text,
      array_to_string(list_transform(list_filter(range(len(l)), lambda i: trim(l[i + 1]) = ''), lambda i: 'blank page ' || i || ' (method=native)'), ',') AS warnings FROM p""",
    "doc_profile": f"""WITH {_DOCS}, p AS (SELECT document_id, doc_id, string_split(text, chr(10)) AS l FROM docs),
      q AS (SELECT document_id, doc_id % 7 AS m, len(l)::DOUBLE AS total, len(list_filter(l, lambda t: length(t) > 100)) AS t, len(list_filter(l, lambda t: length(t) < 30)) AS i,
        len(list_filter(l, lambda t: contains(t, ' | '))) AS tab, len(list_filter(l, lambda t: contains(t, '%'))) AS hand FROM p),
      c AS (SELECT *, CASE WHEN m < 4 THEN m / 5.0 END AS shape, CASE WHEN m = 4 THEN 80.0 WHEN m = 5 THEN 40.0 END AS ocr FROM q),
      d AS (SELECT document_id, CASE
        WHEN total = 0 THEN ['unknown', '0'] WHEN t / total >= 0.3 THEN CASE WHEN tab / total >= 0.8 THEN ['structured', '0.85'] WHEN tab / total >= 0.4 OR i > 0 THEN ['native_with_structured', '0.85'] ELSE ['native_narrative', CAST(least(0.7::DOUBLE + 0.3::DOUBLE * (t / total), 0.95::DOUBLE) AS VARCHAR)] END
        WHEN t > 0 AND i > 0 AND t / total > 0.1 THEN ['hybrid', '0.65']
        WHEN i > 0 THEN CASE WHEN hand / total >= 0.8 THEN ['scanned_handwritten', '0.75'] WHEN hand > 0 THEN ['scanned_mixed', '0.7'] WHEN shape >= 0.6 THEN ['scanned_machinewritten', CAST(least(0.5 + 0.4 * shape, 0.85) AS VARCHAR)]
          WHEN shape < 0.35 THEN ['scanned_handwritten', '0.6'] WHEN ocr >= 70 THEN ['scanned_machinewritten', CAST(least(0.5 + ocr / 200, 0.85) AS VARCHAR)] WHEN ocr < 70 THEN ['unknown', '0.4'] ELSE ['scanned_machinewritten', '0.5'] END
        ELSE ['unknown', '0.3'] END AS r FROM c)
      SELECT document_id, r[1] AS doc_type, round(CAST(r[2] AS DOUBLE), 6) AS confidence,
      CASE r[1] WHEN 'scanned_handwritten' THEN 'ocr_handwritten' WHEN 'scanned_machinewritten' THEN 'ocr_machinewritten' WHEN 'scanned_mixed' THEN 'ocr_mixed' WHEN 'hybrid' THEN 'hybrid' WHEN 'native_with_structured' THEN 'native_with_structured' WHEN 'structured' THEN 'structured' ELSE 'native_narrative' END AS strategy FROM d""",
    "file_routing": f"""WITH {_DOCS}, p AS (SELECT source || '/' || document_id || '.' || (['PDF','csv','xlsx','docx','txt','png'])[doc_id % 6 + 1] AS path, doc_id % 6 AS k FROM docs)
      SELECT path, (['pdf','spreadsheet','spreadsheet','docx','text','unknown'])[k + 1] AS file_type, (['native_narrative','spreadsheet','spreadsheet','docx','text','native_narrative'])[k + 1] AS strategy FROM p""",
    "sheet_classify": " UNION ALL ".join(
        [
            _sheet("nation", ["n_nationkey", "n_name", "n_regionkey"], "n_name"),
            _sheet("region", ["r_regionkey", "r_name"], "r_name"),
            _sheet("customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "c_name"),
            _sheet("supplier", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"], "s_name"),
        ]
    ),
    "row_documents": f"""WITH {_SHEET} SELECT 'customer:' || left(replace(trim(c_name), '/', '-'), 60) AS document_id,
      'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10) || 'c_nationkey: ' || c_nationkey || chr(10) || 'c_acctbal: ' || c_acctbal || chr(10) || 'c_mktsegment: ' || c_mktsegment AS text FROM sheet""",
    "markdown_table": """SELECT n_regionkey, '| key | name | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |  |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey""",
    "structural_fidelity": "SELECT count(*) AS source_rows, 5::BIGINT AS source_cols, count(*) AS extracted_rows, 5::BIGINT AS extracted_cols, 'c_mktsegment' AS missing_columns, 'c_segment' AS extra_columns, false AS passed FROM customer",
    "cell_integrity": f"WITH {_SHEET}, j AS (SELECT {_BAD} AS b FROM sheet s JOIN copy e USING (row_index)) SELECT sum(b) = 0 AS passed, count(*) * 4 AS total_cells, CAST(sum(b) AS BIGINT) AS mismatched_cells, round(1 - sum(b) / (count(*) * 4)::DOUBLE, 9) AS score FROM j",
    "first_mismatches": f"""WITH {_SHEET}, x AS (SELECT row_index, 'c_custkey' AS "column", s.c_custkey AS source_value, e.c_custkey AS extracted_value FROM sheet s JOIN copy e USING (row_index) WHERE s.c_custkey <> e.c_custkey
      UNION ALL SELECT row_index, 'c_name', s.c_name, e.c_name FROM sheet s JOIN copy e USING (row_index) WHERE s.c_name <> e.c_name) SELECT * FROM x ORDER BY row_index, "column" LIMIT 20""",
    "key_preservation": f"""WITH {_SHEET} SELECT (SELECT count(DISTINCT c_custkey) FROM sheet) AS source_unique, (SELECT count(DISTINCT c_custkey) FROM copy) AS extracted_unique,
      (SELECT count(DISTINCT c_custkey) FROM sheet WHERE c_custkey NOT IN (SELECT c_custkey FROM copy)) AS missing_keys, (SELECT count(*) FROM (SELECT c_custkey FROM copy GROUP BY 1 HAVING count(*) > 1)) AS duplicate_keys,
      (SELECT count(*) FROM (SELECT c_custkey FROM copy GROUP BY 1 HAVING count(*) > 1)) = 0 AND (SELECT count(*) FROM sheet WHERE c_custkey NOT IN (SELECT c_custkey FROM copy)) = 0 AS passed""",
    "duplicate_keys": f'WITH {_SHEET} SELECT c_custkey AS "key", count(*) AS copies FROM copy GROUP BY 1 HAVING count(*) > 1',
    "lineitem_integrity": """WITH r AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS i, l_returnflag AS f FROM lineitem),
      b AS (SELECT CASE WHEN i % 1000 = 7 AND f <> '?' THEN 1 ELSE 0 END + CASE WHEN i % 500 = 3 THEN 1 ELSE 0 END AS b FROM r)
      SELECT sum(b) = 0 AS passed, count(*) * 11 AS total_cells, CAST(sum(b) AS BIGINT) AS mismatched_cells, round(1 - sum(b) / (count(*) * 11)::DOUBLE, 9) AS score FROM b""",
    "resume_anti_join": f"WITH {_DOCS} SELECT document_id, source_path FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "batch_summary": f"WITH {_DOCS} SELECT source, count(*) FILTER (quality = 1) AS succeeded, count(*) FILTER (quality <> 1) AS failed, count(*) FILTER (quality IS NULL) AS pending FROM docs LEFT JOIN labels USING (doc_id) GROUP BY source",
    "span_chunk_overlap": f'WITH {_DOCS}, {_LINES}, {_WINDOWS} SELECT s.document_id, s.start, s."end", w.chunk_index FROM spans s JOIN win w ON w.document_id = s.document_id AND w.start_char < s."end" AND s.start < w.end_char',
    "span_containment": f"""WITH {_DOCS}, {_LINES}, {_WINDOWS} SELECT s.document_id, s.ord, w.chunk_index, w.start_char <= s.start AND s."end" <= w.end_char AS whole
      FROM spans s JOIN win w ON w.document_id = s.document_id AND w.start_char < s."end" AND s.start < w.end_char""",
    "mention_first_chunk": f"""WITH {_DOCS}, {_LINES}, {_WINDOWS} SELECT s.document_id, s.start, s."end", CAST(coalesce(min(w.chunk_index), -1) AS INTEGER) AS chunk_index
      FROM spans s LEFT JOIN win w ON w.document_id = s.document_id AND w.start_char < s."end" AND s.start < w.end_char GROUP BY 1, 2, 3""",
    "entity_mentions": f"WITH {_MENTIONS} SELECT * FROM mentions",
    "graph_edges_flat": f"WITH {_EDGES} SELECT * FROM edges",
    "graph_nodes": f"""WITH {_DOCS}, {_WINDOWS}, {_ENTITIES}
      SELECT document_id, document_id AS node_id, 'document' AS label, 3::BIGINT AS n_props FROM docs UNION ALL SELECT document_id, document_id || ':chunk:' || chunk_index, 'chunk', 5 FROM win
      UNION ALL SELECT document_id, document_id || ':' || s.id, s.label, s.n FROM docs, (VALUES ('s1','segment',8), ('s2','segment',8), ('p1','person',3), ('p2','person',3), ('l1','location',2), ('t1','term',2), ('x1','external_document',4)) AS s(id, label, n)""",
    "graph_edge_counts": f"WITH {_EDGES} SELECT relation, count(*) AS n, count(DISTINCT document_id) AS n_docs FROM e0 GROUP BY relation",
    "graph_dangling_ends": f"WITH {_DOCS} SELECT document_id, document_id || ':l1' AS node_id FROM docs",
    "edges_for_document": f"WITH {_EDGES} SELECT * FROM edges WHERE document_id = '7' AND relation = 'mentioned_in'",
    "mentions_for_document": f"WITH {_MENTIONS} SELECT * FROM mentions WHERE document_id = '7' AND entity_label = 'person'",
    "pii_spans": f"WITH {_MENTIONS} SELECT document_id, mention_start, mention_end, entity_label FROM mentions WHERE mention_start >= 0 AND mention_end > mention_start AND entity_label IN ('person', 'location')",
    "enrichment_meta": f"""WITH {_DOCS} SELECT document_id, 'decision' AS doc_type_enriched, 'au' AS jurisdiction, left(text, 10) AS title, 2 AS segment_count, 2 AS person_count, 1 AS location_count, 1 AS term_count, 1 AS external_doc_count, 1 AS date_count, 1 AS heading_count, 0 AS junk_span_count FROM docs""",
    "known_pii_spans": f'WITH {_KNOWN} SELECT document_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", entity_type FROM known',
    "cer_pairs": f"""WITH b AS (SELECT item_id, translate(lower(text), '{ACCENTS[0]}', '{ACCENTS[1]}') AS t FROM benchmark)
      SELECT a.item_id, round(CASE WHEN length(a.t) > 0 THEN levenshtein(a.t, o.t) / length(a.t)::DOUBLE WHEN length(o.t) > 0 THEN 1 ELSE 0 END, 6) AS cer FROM b a JOIN b o ON o.item_id - 1 = a.item_id""",
    "bbox_iou": """WITH l AS (SELECT l_orderkey, l_linenumber, l_discount * 100 AS k, l_quantity AS q FROM lineitem),
      i AS (SELECT *, greatest(0, least(k + q, 25) - greatest(k, 5)) * greatest(0, least(k + 10, 3 + q) - greatest(k, 3)) AS ov FROM l)
      SELECT l_orderkey, l_linenumber, round(CASE WHEN ov > 0 THEN ov / (q * 10 + 20 * q - ov) ELSE 0 END, 6) AS iou FROM i""",
    "cosine_reference": f"SELECT e.vec_id, round(max({_dot('e.embedding', 'r.embedding')} / (sqrt({_dot('e.embedding', 'e.embedding')}) * sqrt({_dot('r.embedding', 'r.embedding')}))), 5) AS best FROM embeddings e, embeddings r WHERE r.vec_id < 12 GROUP BY e.vec_id",
    "title_case_groups": f"""WITH {_DOCS} SELECT document_id, name, count(*) AS n FROM (SELECT document_id, unnest(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'), '\\b[A-Z][-''A-Za-z]+(?:[^\\S\\n]+[A-Z][-''A-Za-z]+)+\\b')) AS name FROM docs) GROUP BY 1, 2""".replace("\\\\", "\\"),
    "table_structure": f"""WITH {_DOCS}, p AS (SELECT document_id, replace(text, ' | ', '|x' || chr(10)) AS t FROM docs)
      SELECT document_id, regexp_matches(t, '(?:[^\\n|]*\\|[^\\n|]*\\|[^\\n]*\\n){{2}}|(?:[^\\n\\t]*\\t[^\\n\\t]*\\t[^\\n]*\\n){{2}}|(?:\\s{{2,}}\\S+\\s{{2,}}\\S[^\\n]*\\n){{3}}') AS has_table FROM p""".replace("\\\\", "\\"),
    "page_sampling": f"""WITH {_DOCS} SELECT document_id, CASE WHEN page_count <= 0 THEN '' WHEN page_count <= 5 THEN array_to_string(range(page_count), ',')
      ELSE array_to_string(list_transform(range(5), lambda i: CAST(floor(i * page_count / 5.0) AS INTEGER)), ',') END AS pages FROM docs""",
    "redaction_modes": f"""WITH {_DOCS}, p AS (SELECT document_id, string_split(text, chr(10)) AS l FROM docs)
      SELECT document_id, array_to_string(list_filter(list_transform(range(len(l)), lambda i: CASE WHEN i IN (0, 2) THEN '[REDACTED]' || chr(10) || l[i + 1] ELSE l[i + 1] END), lambda t: t <> ''), chr(10) || chr(10)) AS blackout,
      array_to_string(list_filter(list_transform(range(len(l)), lambda i: CASE WHEN i IN (0, 2) THEN '' ELSE l[i + 1] END), lambda t: t <> ''), chr(10) || chr(10)) AS deleted FROM p""",
    "layout_runs": f"""WITH {_DOCS}, {_LINES}, s AS (SELECT *, lower(left(line, 1)) AS label FROM spans),
      c AS (SELECT *, CASE WHEN lag(label) OVER w IS NOT DISTINCT FROM label AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS ch FROM s WINDOW w AS (PARTITION BY document_id ORDER BY ord)),
      g AS (SELECT *, sum(ch) OVER (PARTITION BY document_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS island FROM c)
      SELECT document_id, CAST(island AS BIGINT) AS island, min(label) AS label, min(start)::DOUBLE AS x0, min(ord)::DOUBLE AS y0, max("end")::DOUBLE AS x1, max(ord + 1)::DOUBLE AS y1, count(*) AS n FROM g GROUP BY 1, 2""",
    "region_words": """WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') AS ws FROM benchmark),
      u AS (SELECT item_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS word_no FROM w),
      t AS (SELECT *, sum(length(word)) OVER (PARTITION BY item_id) AS total, sum(length(word)) OVER (PARTITION BY item_id ORDER BY word_no ROWS UNBOUNDED PRECEDING) AS upto FROM u)
      SELECT CAST(item_id AS VARCHAR) AS document_id, word_no, word, round(100.0::DOUBLE * (upto - length(word)) / total, 5) AS x0, round(100.0::DOUBLE * upto / total, 5) AS x1 FROM t""",
    "layout_scores": f"""WITH {_DOCS}, {_LINES}, s AS (SELECT ord, lower(left(line, 1)) AS p, CASE WHEN ord % 5 = 0 THEN '?' ELSE lower(left(line, 1)) END AS t FROM spans),
      c AS (SELECT p AS label, CASE WHEN ord % 7 > 0 AND p = t THEN 1 ELSE 0 END AS tp, CASE WHEN ord % 7 > 0 AND p = t THEN 0 ELSE 1 END AS fp, 0 AS fn FROM s
        UNION ALL SELECT t, 0, 0, CASE WHEN ord % 7 > 0 AND p = t THEN 0 ELSE 1 END FROM s),
      g AS (SELECT label, sum(tp)::DOUBLE AS tp, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn FROM c GROUP BY label),
      r AS (SELECT label, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS q FROM g)
      SELECT label, round(p, 6) AS precision, round(q, 6) AS recall, round(coalesce(2 * p * q / nullif(p + q, 0), 0), 6) AS f1 FROM r""",
    "metric_forms": f"""WITH {_DOCS} SELECT document_id, array_to_string(list_filter(regexp_split_to_array(lower(nfc_normalize(text)), '\\s+'), lambda t: t <> ''), ' ') AS form FROM docs""",
    "chunk_source_pages": f"""WITH {_DOCS}, {_LINES}, {_WINDOWS} SELECT w.document_id, w.chunk_index, string_agg(CAST(s.ord AS VARCHAR), ',' ORDER BY s.ord) AS pages
      FROM win w LEFT JOIN spans s ON w.document_id = s.document_id AND w.start_char < s."end" AND s.start < w.end_char GROUP BY 1, 2""",
    "redacted_chunks": f"""WITH {_DOCS}, {_LINES}, {_WINDOWS} SELECT w.document_id, w.chunk_index, coalesce(bool_or(lower(left(s.line, 1)) IN ('a', 'e', 'i', 'o', 'u')), false) AS has_redaction
      FROM win w LEFT JOIN spans s ON w.document_id = s.document_id AND w.start_char < s."end" AND s.start < w.end_char GROUP BY 1, 2""",
    "page_structure": f"""WITH {_DOCS}, p AS (SELECT document_id, doc_id, string_split(text, chr(10)) AS l FROM docs)
      SELECT document_id, len(list_filter(l, lambda t: contains(t, ' | '))) * 2 >= 4 AS has_table, doc_id % 3 >= 2 OR len(list_filter(l, lambda t: length(trim(t)) BETWEEN 1 AND 30)) >= 10 AS has_form FROM p""",
    "graph_edges_from": f"""WITH {_EDGES} SELECT 'from' AS way, source_id, target_id, relation FROM e0 WHERE source_id = '7:p1' UNION ALL SELECT 'to', source_id, target_id, relation FROM e0 WHERE target_id = '7:p1'
      UNION ALL SELECT 'cites', source_id, target_id, relation FROM e0 WHERE relation = 'cites'""",
    "first_bad_keys": f"""WITH {_SHEET}, m AS (SELECT DISTINCT c_custkey AS k FROM sheet WHERE c_custkey NOT IN (SELECT c_custkey FROM copy)), r AS (SELECT c_custkey AS k FROM copy GROUP BY 1 HAVING count(*) > 1)
      (SELECT k AS "key", 'missing' AS kind FROM m ORDER BY k LIMIT 20) UNION ALL (SELECT k, 'repeated' FROM r ORDER BY k LIMIT 20)""",
    "spatial_sort": f"""WITH {_WORDS}, l AS (SELECT item_id, i // 10 AS line, string_agg(word, ' ' ORDER BY i) AS t FROM w GROUP BY 1, 2) SELECT CAST(item_id AS VARCHAR) AS document_id, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY item_id""",
    "spatial_errors": f"""WITH {_WORDS}, t AS (SELECT item_id, translate(lower(nfc_normalize(string_agg(word, ' ' ORDER BY i))), '{ACCENTS[0]}', '{ACCENTS[1]}') AS r,
      translate(lower(nfc_normalize(string_agg(word, ' ' ORDER BY i) FILTER (i % 17 <> 3))), '{ACCENTS[0]}', '{ACCENTS[1]}') AS h FROM w GROUP BY item_id)
      SELECT CAST(item_id AS VARCHAR) AS document_id, round(levenshtein(r, coalesce(h, '')) / length(r)::DOUBLE, 6) AS cer FROM t""",
    "reading_order": f"""WITH {_WORDS}, o AS (SELECT item_id, i, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN i % 5 = 0 THEN i + 2 ELSE i END, i // 10, i) AS k FROM w),
      p AS (SELECT a.item_id, count(*) AS n, count(*) FILTER (a.k < b.k) AS good FROM o a JOIN o b ON a.item_id = b.item_id AND a.i < b.i GROUP BY 1)
      SELECT CAST(i.item_id AS VARCHAR) AS document_id, round(coalesce(good / n::DOUBLE, 1), 6) AS accuracy FROM (SELECT DISTINCT item_id FROM o) i LEFT JOIN p USING (item_id)""",
    "redaction_detect": f"""WITH {_DOCS} SELECT document_id, CAST(doc_id % 4 AS INTEGER) AS total, CASE WHEN doc_id % 4 > 0 THEN '0' ELSE '' END AS pages,
      CASE WHEN doc_id % 4 > 0 THEN 'page 0: ' || doc_id % 4 || ' redacted region(s) detected' ELSE '' END AS warnings FROM docs""",
    "redacted_count": "SELECT count(*) FILTER (doc_id % 4 > 0) AS redacted_documents FROM documents",
    "clean_known_spans": f"""WITH RECURSIVE {_KNOWN}, {_WINDOWS}, o AS (SELECT w.document_id, w.chunk_index, greatest(0, start - start_char) AS s, least(length(w.text), "end" - start_char) AS e, entity_type,
        row_number() OVER (PARTITION BY w.document_id, w.chunk_index ORDER BY start, "end", entity_type) AS ord FROM known k JOIN win w ON w.document_id = k.document_id WHERE least(length(w.text), "end" - start_char) > greatest(0, start - start_char)),
      r AS (SELECT document_id, chunk_index, s, e, entity_type, ord FROM o QUALIFY row_number() OVER (PARTITION BY document_id, chunk_index ORDER BY s, ord) = 1
        UNION ALL SELECT n.document_id, n.chunk_index, n.s, n.e, n.entity_type, n.ord FROM (SELECT o.*, row_number() OVER (PARTITION BY o.document_id, o.chunk_index ORDER BY o.s, o.ord) AS rn FROM r JOIN o ON o.document_id = r.document_id AND o.chunk_index = r.chunk_index AND o.s >= r.e) n WHERE rn = 1),
      p AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY document_id, chunk_index ORDER BY s), 0) AS prev FROM r)
      SELECT w.document_id, w.chunk_index, count(p.s) AS n, coalesce(string_agg(substring(w.text, CAST(prev + 1 AS BIGINT), CAST(p.s - prev AS BIGINT)) || '<' || entity_type || '>', '' ORDER BY p.s), '') || substring(w.text, CAST(coalesce(max(p.e), 0) + 1 AS BIGINT)) AS text_clean
      FROM win w LEFT JOIN p ON p.document_id = w.document_id AND p.chunk_index = w.chunk_index GROUP BY w.document_id, w.chunk_index, w.text""",
    "ocr_confidence": """WITH p AS (SELECT l_orderkey, l_linenumber, avg(l_discount) AS c, list(l_returnflag) || list(l_linestatus) AS s FROM lineitem GROUP BY 1, 2)
      SELECT CAST(l_orderkey AS VARCHAR) AS document_id, round(avg(c), 6) AS confidence, array_to_string(list_sort(list_distinct(flatten(list(s)))), ',') AS steps FROM p GROUP BY l_orderkey""",
    "common_word_filter": f"""WITH {_DOCS}, {_LINES.split(', spans0')[0].split('spans0 AS')[0].rstrip().rstrip(',')}, l AS (SELECT document_id, line FROM lines WHERE line <> ''),
      h AS (SELECT document_id, array_to_string(string_split(line, ' ')[1:2], ' ') AS head FROM l UNION ALL SELECT document_id, 'New South' FROM l)
      SELECT document_id, count(*) FILTER (len(list_filter(regexp_split_to_array(head, '\\s+'), lambda w: w <> '' AND NOT list_contains(__COMMON__, w))) = 0) AS n_common, count(*) AS n FROM h GROUP BY document_id""".replace("\\\\", "\\"),
    "events_by_window": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY date_trunc('day', ts), event_type",
    "tag_counts": f"""WITH RECURSIVE {_KNOWN}, {_WINDOWS}, o AS (SELECT k.document_id, least(d.n, "end") AS e, start AS s, entity_type, row_number() OVER (PARTITION BY k.document_id ORDER BY start, "end", entity_type) AS ord FROM known k JOIN sp d USING (document_id) WHERE least(d.n, "end") > start),
      r AS (SELECT document_id, s, e, entity_type, ord FROM o QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY s, ord) = 1
        UNION ALL SELECT n.document_id, n.s, n.e, n.entity_type, n.ord FROM (SELECT o.*, row_number() OVER (PARTITION BY o.document_id ORDER BY o.s, o.ord) AS rn FROM r JOIN o ON o.document_id = r.document_id AND o.s >= r.e) n WHERE rn = 1)
      SELECT entity_type AS tag, count(*) AS n FROM r GROUP BY entity_type""",
}


def _finish() -> None:
    from quillmill.functions.spans import COMMON

    words = ", ".join("'" + w + "'" for w in sorted(COMMON))
    ORACLE["common_word_filter"] = ORACLE["common_word_filter"].replace("__COMMON__", f"[{words}]")


_finish()
