"""The registered training-data queries, and the same in DuckDB SQL where SQL can express them."""

from __future__ import annotations

from tracewright.llm.collocations import op12_collocations
from tracewright.llm.decontamination import op9_decontamination
from tracewright.llm.divergence import op11_divergence
from tracewright.llm.fingerprints import op10_fingerprints
from tracewright.llm.language_id import op8_language_id
from tracewright.llm.language_model import op5_language_model
from tracewright.llm.licenses import op6_licenses
from tracewright.llm.line_dedup import op3_line_dedup
from tracewright.llm.near_duplicates import op4_near_duplicates
from tracewright.llm.packing import op1_packing
from tracewright.llm.personal_data import op7_personal_data
from tracewright.llm.token_files import op2_token_files
from tracewright.llm.url_filters import op13_url_filters

QUERIES = {
    "op1_packing": op1_packing,
    "op2_token_files": op2_token_files,
    "op3_line_dedup": op3_line_dedup,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_language_model": op5_language_model,
    "op6_licenses": op6_licenses,
    "op7_personal_data": op7_personal_data,
    "op8_language_id": op8_language_id,
    "op9_decontamination": op9_decontamination,
    "op10_fingerprints": op10_fingerprints,
    "op11_divergence": op11_divergence,
    "op12_collocations": op12_collocations,
    "op13_url_filters": op13_url_filters,
}

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

#: The others' results come from fitted models, signatures, token ids or numbers that SQL doesn't have; tests hold them against plain Python.
ORACLES = {
    "op3_line_dedup": """WITH each AS (SELECT doc_id, text, i AS line_no, lines[i] AS line, trim(regexp_replace(lower(lines[i]), '[ \\t\\x0B\\f\\r]+', ' ', 'g'), ' ') AS s FROM (
        SELECT doc_id, text, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
    firsts AS (SELECT s, min((doc_id, line_no)) AS first FROM each WHERE s <> '' GROUP BY s),
    halves AS (SELECT s, first, unnest(['h' || m || '|' || substr(s, 1, m // 2), 't' || m || '|' || right(s, m - m // 2)]) AS half FROM (SELECT s, first, unnest([length(s), length(s) - 1]) AS m FROM firsts WHERE length(s) >= 20)),
    near AS (SELECT DISTINCT a.s FROM halves a JOIN halves b USING (half) WHERE a.first > b.first AND abs(length(a.s) - length(b.s)) <= 1 AND levenshtein(a.s, b.s) <= 1),
    marked AS (SELECT e.*, s <> '' AND (((e.doc_id, line_no) <> f.first) OR n.s IS NOT NULL) AS gone, n.s IS NOT NULL AND (e.doc_id, line_no) = f.first AS is_near FROM each e LEFT JOIN firsts f USING (s) LEFT JOIN near n USING (s))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT coalesce(gone, FALSE)) AS n_kept, count(*) FILTER (gone AND is_near) AS n_near,
        sha256(CASE WHEN NOT bool_or(coalesce(gone, FALSE)) THEN coalesce(any_value(text), '') WHEN bool_or(s <> '' AND NOT gone) THEN string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT coalesce(gone, FALSE)) ELSE '' END) AS text_sha256
    FROM marked GROUP BY doc_id""",
    "op9_decontamination": f"""WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
    windows AS (SELECT DISTINCT item_id, k, array_to_string(w[b:b + k - 1], ' ') AS win FROM (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS b FROM items WHERE len(w) > 0)),
    docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    places AS (SELECT doc_id, k, b, array_to_string(w[b:b + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS b FROM docs, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
    hits AS (SELECT doc_id, b, k, item_id FROM places JOIN windows USING (k, win)),
    hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(b, b + k)) AS place FROM hits) GROUP BY doc_id),
    ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op11_divergence": r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT lang, source, id, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS ln FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
    c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(n, 0) + coalesce(v, 0) AS total, coalesce(nl, 0) + coalesce(v, 0) AS lang_total FROM (SELECT DISTINCT lang, source FROM d)
        LEFT JOIN (SELECT lang, count(*) AS v, sum(ln) AS nl FROM kept GROUP BY lang) USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) USING (lang, source)),
    p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // total AS p, 1 + (1000000000::HUGEINT * (ln + 1)) // lang_total AS q FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
        UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every QUALIFY part = 'pair' OR rank <= 200""",
    "op12_collocations": r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    p AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
    g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) s(k) WHERE len(w) >= k)),
    f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
    c AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30),
    parts AS MATERIALIZED (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
    heads AS MATERIALIZED (SELECT x.*, h.a AS l FROM parts x JOIN f h ON h.lang = x.lang AND h.phrase = x.head),
    cuts AS MATERIALIZED (SELECT x.lang, x.phrase, x.a, j, l, t.a AS r, (2000000::HUGEINT * x.a) // (l + t.a) AS score FROM heads x JOIN f t ON t.lang = x.lang AND t.phrase = x.tail),
    best AS MATERIALIZED (SELECT lang, phrase, a, min({'score': score, 'j': j, 'l': l, 'r': r}) AS b FROM cuts GROUP BY ALL),
    runs AS (SELECT lang, a, array_to_string(w[i:i + j - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c))),
    longer AS MATERIALIZED (SELECT lang, phrase, max(a) AS m FROM runs GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank, phrase, a, b.l AS l, b.r AS r, n, b.score::BIGINT AS score FROM best LEFT JOIN longer USING (lang, phrase) JOIN (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang) USING (lang)
    WHERE m IS NULL OR 100 * m < 80 * a QUALIFY rank <= 2000""",
}
