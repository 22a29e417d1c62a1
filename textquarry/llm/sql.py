"""DuckDB SQL for the queries that SQL can express on whole tables; encoding, mixing and reading levels are tested
on fixtures instead."""

from __future__ import annotations

from textquarry.functions.text import WORD_PATTERN

_INVISIBLE = r"'[\x{200B}\x{200C}\x{200D}\x{00AD}\x{FEFF}]'"


def _clean(c: str) -> str:
    return f"nfc_normalize(translate(regexp_replace({c}, {_INVISIBLE}, '', 'g'), '‐‑‘’', '--' || repeat(chr(39), 2)))"


def _words(c: str) -> str:
    pattern = WORD_PATTERN.replace("'", "''")
    return f"coalesce(regexp_extract_all(replace(lower({_clean(c)}), 'ё', 'е'), '{pattern}'), [])"


def _label(c: str) -> str:
    plain = rf"lower(regexp_replace({c}, '^[\s\x0B\p{{Z}}]+|[\s\x0B\p{{Z}}]+$', '', 'g'))"
    return f"CASE {plain} WHEN 'neautral' THEN 'neutral' ELSE {plain} END"


_TERMS = f"""records AS (SELECT row_number() OVER () AS r, {_words('text')} AS w FROM (SELECT text FROM documents UNION ALL SELECT text FROM canonical_corpus)),
 each_word AS (SELECT r, unnest(w) AS term FROM records),
 counts AS (SELECT term, count(*) AS occurrences, count(DISTINCT r) AS records FROM each_word GROUP BY 1),
 marked AS (SELECT *, CASE WHEN records < 3 THEN 'rare' WHEN records > 0.1::DOUBLE * (SELECT count(*) FROM records) THEN 'common' END AS mark FROM counts)"""

_VECTORS = """usable AS MATERIALIZED (SELECT vec_id, list_transform(vec, lambda x: coalesce(x, 'nan'::DOUBLE)) AS v FROM vectors WHERE vec IS NOT NULL AND len(vec) = 64),
 finite AS MATERIALIZED (SELECT vec_id, v FROM usable WHERE len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
 units AS MATERIALIZED (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM finite),
 cosines AS (SELECT q.vec_id AS q, d.vec_id AS d, list_dot_product(q.v, d.v) AS c FROM units q JOIN units d ON q.vec_id <> d.vec_id),
 near AS (SELECT * FROM cosines QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, d) <= 5)"""

_GROUPS = f"""articles AS (SELECT row_id, {_words("coalesce(title, '') || chr(10) || text")} AS w FROM lenta WHERE text IS NOT NULL AND len({_words('text')}) >= 20),
 sets AS (SELECT row_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM articles),
 tokens AS (SELECT row_id, len(s) AS n, unnest(s) AS t FROM sets),
 common AS (SELECT a.row_id AS a, b.row_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM tokens a JOIN tokens b ON a.t = b.t AND a.row_id < b.row_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM common WHERE 2 * k >= n + m - k),
 edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
 reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)"""

_SPLITS = f"""plain AS (SELECT id, {_label('split')} AS split, list_distinct({_words('text')}) AS s FROM canonical_corpus),
 usable AS (SELECT * FROM plain WHERE split IN ('train', 'validation', 'test') AND len(s) >= 8),
 tokens AS (SELECT id, split = 'train' AS train, len(s) AS n, unnest(s) AS t FROM usable),
 common AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k FROM tokens a JOIN tokens b ON a.t = b.t WHERE a.train AND NOT b.train GROUP BY 1, 2)"""

_COVERAGE = f"""rows_ AS (SELECT id, {_label('split')} AS split, source, {_words('text')} AS w FROM canonical_corpus),
 counted AS (SELECT * FROM rows_ WHERE split IN ('train', 'validation', 'test') AND len(list_distinct(w)) >= 8),
 runs AS (SELECT id, split, unnest(range(1, len(w) - 3)) AS i, w FROM counted),
 grams AS (SELECT id, split, i, array_to_string(w[i:i + 4], ' ') AS g FROM runs),
 known AS (SELECT DISTINCT g FROM grams WHERE split = 'train'),
 places AS (SELECT DISTINCT id, unnest(range(i, i + 5)) AS p FROM grams JOIN known USING (g) WHERE split <> 'train'),
 covered AS (SELECT id, count(*) AS c FROM places GROUP BY 1),
 partners AS (SELECT b AS id, count(*) AS m FROM common WHERE 5 * k >= 4 * (n + m - k) GROUP BY 1)"""

_REVIEWS = f"""runs AS (SELECT review_id, review, sentiment, attrs, regexp_extract_all(lower(nfc_normalize(regexp_replace(review, {_INVISIBLE}, '', 'g'))), '[\\p{{L}}\\p{{Nd}}]+') AS r FROM reviews WHERE review IS NOT NULL),
 canonical AS (SELECT *, array_to_string(r, ' ') AS t, {_label('sentiment')} AS s, list_transform(list_sort(json_keys(attrs)), lambda k: k || ':' || (attrs::JSON -> k)::VARCHAR)::VARCHAR AS j FROM runs WHERE len(r) >= 4),
 kept AS (SELECT *, min(review_id) OVER (PARTITION BY t, s, j) AS kept_id FROM canonical)"""

_LEAKS = f"""q AS (SELECT query_id, {_words('text')} AS w FROM query_evaluations), d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
 qg AS (SELECT DISTINCT query_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM q WHERE len(w) >= 8),
 dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM d WHERE len(w) >= 8)"""

_SAMPLE = f"""categories AS (SELECT 'lenta' AS dataset, {_label('topic')} AS category FROM lenta UNION ALL SELECT 'reviews', {_label('sentiment')} FROM reviews),
 counts AS (SELECT dataset, category, count(*) AS n FROM categories JOIN sample_targets USING (dataset, category) GROUP BY 1, 2),
 totals AS (SELECT dataset, sum(n) AS usable FROM counts GROUP BY 1)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_TERMS} SELECT term, mark FROM marked WHERE mark IS NOT NULL",
        "p1_terms": f"WITH {_TERMS} SELECT term, occurrences, records, mark FROM marked",
        "p2_found": f"WITH {_VECTORS} SELECT DISTINCT least(q, d) AS vec_a, greatest(q, d) AS vec_b FROM near WHERE c >= 0.85",
        "p3_found": f"WITH RECURSIVE {_GROUPS} SELECT DISTINCT a AS row_a, b AS row_b FROM reach WHERE a < b",
        "p3_classes": f"WITH RECURSIVE {_GROUPS}, classes AS (SELECT row_id, least(row_id, coalesce((SELECT min(b) FROM reach WHERE a = row_id), row_id)) AS class_id FROM articles), named AS (SELECT row_id, list_sort(s) AS s FROM sets), degrees AS (SELECT a AS row_id, count(DISTINCT s) AS links FROM edges JOIN named ON row_id = b WHERE s <> (SELECT x.s FROM named x WHERE x.row_id = a) GROUP BY 1) SELECT row_id AS record_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_rows, coalesce(links, 0) AS links FROM classes LEFT JOIN degrees USING (row_id)",
        "p4_found": f"WITH {_SPLITS} SELECT least(a, b) AS id_a, greatest(a, b) AS id_b FROM common WHERE 5 * k >= 4 * (n + m - k)",
        "p4_report": f"WITH {_SPLITS}, {_COVERAGE} SELECT split, source, count(*) AS records, count(m) AS overlapping, coalesce(sum(m), 0)::BIGINT AS pairs, sum(len(w))::BIGINT AS words, coalesce(sum(c), 0)::BIGINT AS covered_words FROM counted LEFT JOIN partners USING (id) LEFT JOIN covered USING (id) WHERE split <> 'train' GROUP BY 1, 2",
        "p5_found": f"WITH {_REVIEWS} SELECT kept_id, review_id FROM kept WHERE review_id <> kept_id",
        "p5_records": f"WITH {_REVIEWS} SELECT kept_id, count(*) AS copies, count(DISTINCT {{'a': review, 'b': sentiment, 'c': attrs}}) AS raw_forms FROM kept GROUP BY 1",
        "p6_found": f"WITH {_LEAKS} SELECT DISTINCT query_id, doc_id FROM qg JOIN dg USING (g)",
        "p7_report": f"""WITH {_SAMPLE}, demands AS (SELECT dataset, category, target_share, coalesce(n, 0) AS available, greatest(min_rows, ceil(target_share::DECIMAL(18, 9) * sample_fraction::DECIMAL(9, 6) * coalesce(usable, 0)))::BIGINT AS demanded
  FROM sample_targets LEFT JOIN counts USING (dataset, category) LEFT JOIN totals USING (dataset)),
 drawn AS (SELECT *, least(available, demanded) AS drawn FROM demands)
 SELECT *, demanded - drawn AS shortfall, drawn / greatest(1, sum(drawn) OVER (PARTITION BY dataset)) AS actual_share FROM drawn""",
        "p7_found": f"WITH {_SAMPLE} SELECT dataset, category FROM sample_targets LEFT JOIN counts USING (dataset, category) LEFT JOIN totals USING (dataset) WHERE coalesce(n, 0) < greatest(min_rows, target_share * sample_fraction * coalesce(usable, 0))",
    }
