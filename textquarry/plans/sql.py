"""DuckDB SQL for the queries of plans.queries, over views named as the tables."""

from __future__ import annotations

from textquarry.functions.lexicon import STOP_WORDS
from textquarry.functions.text import TOKEN_PATTERN

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_SHARES = (("train", 0.7), ("validation", 0.15), ("test", 0.15))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fold(c: str) -> str:
    return f"replace(lower(nfc_normalize({c})), 'ё', 'е')"


def _tokens(c: str) -> str:
    return f"coalesce(regexp_extract_all({_fold(c)}, {_quoted(TOKEN_PATTERN)}), [])"


def _clean(c: str) -> str:
    return f"list_filter({_tokens(c)}, lambda t: t NOT IN ({_STOP}))"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\x0B\\p{{Z}}]+|[\\s\\x0B\\p{{Z}}]+$', '', 'g')"


def _key(c: str) -> str:
    return f"regexp_replace({_strip(_fold(c))}, '[\\s\\x0B\\p{{Z}}]+', ' ', 'g')"


def _label(c: str, spelling: bool = False) -> str:
    plain = f"lower({_strip(c)})"
    return f"CASE {plain} WHEN 'neautral' THEN 'neutral' ELSE {plain} END" if spelling else plain


_DOCS = f"docs AS (SELECT doc_id, {_clean('text')} AS tokens FROM documents)"
_QUERIES = f"asked AS (SELECT query_id, {_clean('text')} AS tokens FROM query_evaluations)"
_IDF = f"""{_DOCS}, each_term AS (SELECT doc_id, unnest(tokens) AS term FROM docs),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM each_term GROUP BY 1, 2),
 idf AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, ln((1 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1)"""
_WEIGHTS = f"""{_IDF}, raw AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)),
 weights AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""
_ASKED = f"""{_WEIGHTS}, {_QUERIES}, qtf AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(tokens) AS term FROM asked) GROUP BY 1, 2),
 qraw AS (SELECT query_id, term, (1 + ln(tf)) * idf AS w FROM qtf JOIN idf USING (term)),
 qweights AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM qraw)"""
_SPARSE = f"""{_ASKED}, scores AS (SELECT query_id, doc_id, round(sum(q.weight * d.weight), 9) AS cosine FROM qweights q JOIN weights d USING (term) GROUP BY 1, 2),
 hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS rank FROM scores QUALIFY rank <= 10)"""
_SPLIT_HITS = f"""rows_ AS (SELECT id AS doc_id, {_label('label')} AS label, {_label('split')} AS split, {_clean('text')} AS tokens FROM canonical_corpus WHERE label IS NOT NULL),
 docs AS (SELECT doc_id, tokens FROM rows_ WHERE split = 'train'), asked AS (SELECT doc_id AS query_id, tokens FROM rows_ WHERE split = 'test'),
 {_WEIGHTS.removeprefix(_DOCS + ', ')}, qtf AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(tokens) AS term FROM asked) GROUP BY 1, 2),
 qraw AS (SELECT query_id, term, (1 + ln(tf)) * idf AS w FROM qtf JOIN idf USING (term)),
 qweights AS (SELECT query_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight FROM qraw),
 met AS (SELECT query_id, doc_id, round(sum(q.weight * d.weight), 9) AS cosine FROM qweights q JOIN weights d USING (term) GROUP BY 1, 2),
 scores AS (SELECT query_id, doc_id, max(cosine) AS cosine FROM (FROM met UNION ALL SELECT query_id, doc_id, 0 FROM (SELECT DISTINCT query_id FROM met) CROSS JOIN (SELECT doc_id FROM docs ORDER BY doc_id LIMIT 10)) GROUP BY 1, 2),
 hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS rank FROM scores QUALIFY rank <= 5)"""
_EXCERPTS = """plain AS (SELECT doc_id, regexp_replace(text, '[\\s\\x0B]+', ' ', 'g')[1:180] AS t FROM documents WHERE text IS NOT NULL),
 each_char AS (SELECT doc_id, i, t[i] AS c, sum(CASE WHEN unicode(t[i]) > 65535 THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS units FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM plain)),
 cut AS (SELECT doc_id, string_agg(c, '' ORDER BY i) AS e FROM each_char WHERE units <= 180 GROUP BY 1)"""
_COVERAGE = f"""{_DOCS}, {_QUERIES}, known AS (SELECT DISTINCT unnest(tokens) AS term FROM docs), qt AS (SELECT query_id, unnest(tokens) AS term FROM asked),
 cov AS (SELECT a.query_id, count(k.term) AS known, count(t.term) AS total FROM asked a LEFT JOIN qt t USING (query_id) LEFT JOIN known k USING (term) GROUP BY 1)"""
_STATUS = "CASE WHEN total = 0 THEN 'empty_after_normalization' WHEN known = 0 THEN 'oov' ELSE 'ok' END"
_NB = f"""labelled AS (SELECT review_id, {_label('sentiment', True)} AS label, {_tokens('review')} AS tokens, sha256(review_id::VARCHAR)[1] IN ('0', '1', '2') AS test FROM reviews WHERE sentiment IS NOT NULL),
 train AS (SELECT * FROM labelled WHERE NOT test), words AS (SELECT review_id, label, unnest(tokens) AS term FROM train),
 kept AS (SELECT term FROM words GROUP BY 1 HAVING count(DISTINCT review_id) >= 2 ORDER BY count(*) DESC, term LIMIT 50000),
 classes AS (SELECT label, ln(count(*) / (SELECT count(*) FROM train)) AS prior FROM train GROUP BY 1),
 counts AS (SELECT term, label, count(*) AS n FROM words WHERE term IN (FROM kept) GROUP BY 1, 2),
 totals AS (SELECT label, sum(n) AS total FROM counts GROUP BY 1),
 model AS (SELECT k.term, c.label, ln((coalesce(n, 0) + 1) / (total + (SELECT count(*) FROM kept))) AS lp FROM kept k CROSS JOIN classes c JOIN totals USING (label) LEFT JOIN counts n ON n.term = k.term AND n.label = c.label)"""
_PREDICT = f"""{_NB}, tested AS (SELECT review_id, unnest(tokens) AS term FROM labelled WHERE test),
 sums AS (SELECT review_id, label, sum(lp) AS s FROM tested JOIN model USING (term) GROUP BY 1, 2),
 scored AS (SELECT l.review_id, l.label AS truth, c.label, prior + coalesce(s, 0) AS score FROM labelled l CROSS JOIN classes c LEFT JOIN sums s ON s.review_id = l.review_id AND s.label = c.label WHERE l.test),
 predicted AS (SELECT review_id, truth AS label, label AS prediction FROM scored QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY score DESC, label) = 1)"""
_CONFUSION = f"""{_PREDICT}, matrix AS (SELECT a.label, b.label AS prediction, count(p.review_id) AS n FROM classes a CROSS JOIN classes b LEFT JOIN predicted p ON p.label = a.label AND p.prediction = b.label GROUP BY 1, 2)"""
_REPORT = f"""{_CONFUSION}, truth AS (SELECT label, sum(n)::BIGINT AS support, sum(n) FILTER (label = prediction) AS hit FROM matrix GROUP BY 1),
 guessed AS (SELECT prediction AS label, sum(n) AS n FROM matrix GROUP BY 1),
 pr AS (SELECT label, CASE WHEN n = 0 THEN 0 ELSE hit / n END AS precision, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall, support FROM truth JOIN guessed USING (label)),
 report AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr)"""
_DEDUP = """base AS (SELECT * FROM canonical_corpus WHERE text IS NOT NULL),
 by_label AS (SELECT text, label, count(*) AS n, min({'id': id, 'split': split}) AS first FROM base GROUP BY 1, 2),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n DESC, label NULLS FIRST) AS r, count(*) OVER (PARTITION BY text) AS labels, sum(n) OVER (PARTITION BY text) AS rows_,
  max(n) OVER (PARTITION BY text) AS most FROM by_label),
 best AS (SELECT text, count(*) AS winners FROM ranked WHERE n = most GROUP BY 1)"""


def _dedup(repeated: str) -> str:
    return f"WITH {_DEDUP} SELECT first.id AS id, label, first.split AS split FROM ranked JOIN best USING (text) WHERE r = 1 AND NOT (labels > 1 AND winners > 1) AND {repeated}"


def _majority(table: str, text: str, label: str) -> str:
    return f"""p AS (SELECT {_strip(text)} AS text, {_strip(label)} AS l FROM {table}),
 plain AS (SELECT text, CASE l WHEN 'neautral' THEN 'neutral' ELSE l END AS label FROM p WHERE text <> '' AND l <> ''),
 counts AS (SELECT text, label, count(*) AS n FROM plain GROUP BY 1, 2),
 ranked AS (SELECT *, max(n) OVER (PARTITION BY text) AS most, sum(n) OVER (PARTITION BY text) AS rows_, count(*) OVER (PARTITION BY text) AS labels FROM counts),
 best AS (SELECT text, any_value(label) AS label, any_value(rows_)::BIGINT AS "rows", any_value(labels) AS labels FROM ranked WHERE n = most GROUP BY 1 HAVING count(*) = 1)"""


def _split_sql() -> str:
    names = [s for s, _ in _SHARES]
    exact = ", ".join(f"n * {share}::DOUBLE AS e_{s}" for s, share in _SHARES)
    lower = " + ".join(f"floor(e_{s})" for s in names)
    sizes = []
    for s in names:
        before = " + ".join(f"((e_{t} - floor(e_{t}) > e_{s} - floor(e_{s})) OR (e_{t} - floor(e_{t}) = e_{s} - floor(e_{s}) AND {str(t > s).lower()}))::INT" for t in names if t != s)
        sizes.append(f"floor(e_{s}) + ({before} < n - ({lower}))::INT AS size_{s}")
    return f"""rows_ AS (SELECT row_id, {_label('topic')} AS label, sha256('0:' || row_id) AS digest FROM lenta),
 placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY digest, row_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM rows_),
 e AS (SELECT *, {exact} FROM placed), sized AS (SELECT *, {', '.join(sizes)} FROM e),
 assigned AS (SELECT row_id, label, CASE WHEN r <= size_train THEN 'train' WHEN r <= size_train + size_validation THEN 'validation' ELSE 'test' END AS split FROM sized)"""


_OK = "vec IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_UNIT = f"""usable AS MATERIALIZED (SELECT vec_id, list_transform(vec, lambda x: coalesce(x, 0)) AS vec FROM vectors WHERE {_OK}),
 units AS MATERIALIZED (SELECT vec_id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM usable WHERE list_dot_product(vec, vec) > 0)"""
_LABELS = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE list_dot_product(embedding, embedding) > 0),
 pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, q.label = d.label AS same, list_cosine_similarity(q.v, d.v) AS c FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
 hits AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) <= 5),
 each_query AS (SELECT query_id, (count(*) FILTER (same)) / 5 AS precision FROM hits GROUP BY 1)"""


def oracle_sql() -> dict[str, str]:
    return {
        "tfidf_search": f"WITH {_SPARSE} SELECT query_id, doc_id, round(cosine, 6) AS cosine, rank FROM hits",
        "token_counts": f"SELECT doc_id, len({_tokens('text')}) AS n FROM documents",
        "clean_token_counts": f"SELECT doc_id, len({_clean('text')}) AS n FROM documents",
        "folded_titles": f"SELECT doc_id, {_fold('title')} AS folded FROM documents",
        "without_tokens": "SELECT doc_id FROM documents WHERE NOT coalesce(regexp_matches(text, '\\p{L}|\\p{Nd}'), false)",
        "frequent_terms": f"WITH {_DOCS}, t AS (SELECT term, count(*) AS cf FROM (SELECT unnest(tokens) AS term FROM docs) GROUP BY 1) SELECT term, cf, row_number() OVER (ORDER BY cf DESC, term) AS rank FROM t QUALIFY rank <= 100",
        "term_idf": f"WITH {_IDF} SELECT term, df, cf, round(idf, 6) AS idf FROM idf WHERE df >= 3",
        "tfidf_top_terms": f"WITH {_WEIGHTS}, r AS (SELECT doc_id, term, round(weight, 9) AS weight FROM weights) SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS rank, round(weight, 6) AS weight FROM r QUALIFY rank <= 3",
        "term_counts_by_language": f"SELECT lang, term, count(*) AS tf FROM (SELECT lang, unnest({_clean('text')}) AS term FROM documents) GROUP BY 1, 2",
        "vocabulary_ids": f"WITH {_DOCS}, t AS (SELECT term, count(*) AS cf FROM (SELECT unnest(tokens) AS term FROM docs) GROUP BY 1) SELECT term, row_number() OVER (ORDER BY cf DESC, term) + 1 AS term_id FROM t QUALIFY term_id <= 2001",
        "query_coverage": f"WITH {_COVERAGE} SELECT query_id, known, total FROM cov",
        "query_statuses": f"WITH {_COVERAGE} SELECT query_id, known AS known_tokens, total AS total_tokens, {_STATUS} AS status FROM cov",
        "excerpts": f"WITH {_EXCERPTS} SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(e, '') END AS excerpt FROM documents LEFT JOIN cut USING (doc_id)",
        "hashed_ids": "SELECT doc_id, 'sha256:' || sha256(text) AS id FROM documents",
        "comparison_keys": f"SELECT doc_id, {_key('title')} AS key FROM documents",
        "canonical_checks": """SELECT count(*) AS "rows", count(*) FILTER (coalesce(id, '') = '') AS empty_id, count(*) FILTER (coalesce(text, '') = '') AS empty_text,
 (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM canonical_corpus GROUP BY id)) AS repeated_id, (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM canonical_corpus GROUP BY text)) AS repeated_text,
 CASE WHEN count(label) > 0 THEN count(*) FILTER (coalesce(label, '') = '') ELSE 0 END AS bad_label,
 CASE WHEN count(split) > 0 THEN count(*) FILTER (split IS NULL OR split NOT IN ('train', 'validation', 'test')) ELSE 0 END AS bad_split FROM canonical_corpus""",
        "deduplicated_keep": _dedup("true"),
        "deduplicated_drop": _dedup("NOT (labels = 1 AND rows_ > 1)"),
        "majority_sentiment": f"WITH {_majority('reviews', 'review', 'sentiment')} SELECT * FROM best",
        "majority_status": f"WITH {_majority('orders', 'o_custkey::VARCHAR', 'o_orderstatus')} SELECT * FROM best",
        "majority_counts": f"""WITH {_majority('reviews', 'review', 'sentiment')} SELECT (SELECT count(*) FROM reviews) AS "rows", (SELECT count(*) FROM p WHERE NOT (coalesce(text, '') <> '' AND coalesce(l, '') <> '')) AS empty,
 (SELECT count(*) FROM best) AS kept, (SELECT count(DISTINCT text) FROM counts) - (SELECT count(*) FROM best) AS ties, (SELECT count(*) FROM best WHERE labels > 1) AS resolved""",
        "unrepeated_urls": f"SELECT row_id, url FROM lenta WHERE coalesce({_strip('url')}, '') <> '' AND coalesce({_strip('title')}, '') <> '' AND coalesce({_strip('text')}, '') <> '' AND url IN (SELECT url FROM lenta GROUP BY url HAVING count(*) = 1)",
        "first_articles": "SELECT min(row_id) AS row_id FROM lenta GROUP BY coalesce(title, '') || chr(10) || coalesce(text, '')",
        "hashed_articles": "WITH u AS (SELECT url, (min({'r': row_id, 't': topic})).t AS topic FROM lenta WHERE url IS NOT NULL GROUP BY url) SELECT topic, url FROM u QUALIFY row_number() OVER (PARTITION BY topic ORDER BY sha256(url), url) <= 250",
        "articles_per_topic": "SELECT topic, count(DISTINCT coalesce(title, '') || chr(10) || coalesce(text, '')) AS texts FROM lenta GROUP BY 1",
        "article_splits": f"WITH {_split_sql()} SELECT row_id, label, split FROM assigned",
        "split_sizes": f"WITH {_split_sql()} SELECT label, split, count(*) AS n FROM assigned GROUP BY 1, 2",
        "sampled_corpus": "SELECT id, label, split FROM canonical_corpus QUALIFY row_number() OVER (PARTITION BY label, split ORDER BY sha256(id), id) <= least(20, CASE split WHEN 'train' THEN 30 WHEN 'test' THEN 10 ELSE 0 END)",
        "shared_texts": "SELECT count(*) AS shared_texts FROM (SELECT text FROM canonical_corpus GROUP BY text HAVING min(split) <> max(split))",
        "class_sizes": f"SELECT {_label('sentiment', True)} AS label, count(*) AS n FROM reviews GROUP BY 1",
        "relevant_documents": "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM qrels WHERE score > 0)",
        "background_documents": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM qrels WHERE score > 0 AND doc_id IS NOT NULL)",
        "unknown_judgments": "SELECT query_id, doc_id FROM qrels WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM documents)",
        "title_matches": f"WITH q AS (SELECT query_id, {_key('text')} AS key FROM query_evaluations), d AS (SELECT doc_id, {_key('title')} AS key FROM documents UNION SELECT doc_id, {_key('text')} FROM documents) SELECT DISTINCT query_id, doc_id FROM q JOIN d USING (key) WHERE key <> ''",
        "query_terms": f"WITH {_ASKED}, r AS (SELECT query_id, term, round(weight, 9) AS weight FROM qweights) SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, term) AS rank, round(weight, 6) AS weight FROM r QUALIFY rank <= 3",
        "split_hits": f"WITH {_SPLIT_HITS} SELECT query_id, doc_id, round(cosine, 6) AS cosine, rank FROM hits",
        "split_precision": f"""WITH {_SPLIT_HITS}, labels AS (SELECT doc_id, label FROM rows_),
 each_query AS (SELECT query_id, (count(*) FILTER (q.label = d.label)) / 5 AS precision FROM hits JOIN labels q ON q.doc_id = query_id JOIN labels d ON d.doc_id = hits.doc_id GROUP BY 1)
 SELECT count(*) AS evaluated, (SELECT count(*) FROM asked) - count(*) AS skipped, round(avg(precision), 6) AS precision, round(avg((precision > 0)::INT), 6) AS hit FROM each_query""",
        "table_round_trip": "SELECT coalesce(id, '') AS id, coalesce(regexp_replace(text, '[\\r\\n]', ' ', 'g'), '') AS text, coalesce(label, '') AS label, coalesce(split, '') AS split FROM canonical_corpus",
        "json_attributes": "SELECT attrs->>'$.size' AS size, attrs->>'$.fit' AS fit, count(*) AS n, sum((attrs->>'$.height')::BIGINT)::BIGINT AS height, count(attrs->>'$.gift') AS gifts FROM reviews WHERE attrs IS NOT NULL GROUP BY 1, 2",
        "bayes_terms": f"WITH {_NB} SELECT term, label, round(lp, 6) AS log_probability FROM model",
        "bayes_predictions": f"WITH {_PREDICT} SELECT review_id, label, prediction FROM predicted",
        "bayes_confusion": f"WITH {_CONFUSION} SELECT label, prediction, n FROM matrix",
        "bayes_report": f"WITH {_REPORT} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM report",
        "bayes_summary": f"WITH {_REPORT} SELECT round((SELECT sum(n) FILTER (label = prediction) / sum(n) FROM matrix), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM report",
        "vector_search": f"WITH {_UNIT}, pairs AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, greatest(-1, least(1, list_dot_product(q.vec, d.vec))) AS c FROM units q JOIN units d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0) SELECT query_id, doc_id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id) AS rank FROM pairs QUALIFY rank <= 5",
        "label_precisions": f"WITH {_LABELS} SELECT query_id, precision, (precision > 0)::BIGINT AS hit FROM each_query",
        "mean_label_precision": f"WITH {_LABELS} SELECT count(*) AS evaluated, (SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0) - count(*) AS skipped, round(avg(precision), 6) AS precision, round(avg((precision > 0)::INT), 6) AS hit FROM each_query",
        "retrieval_metrics": f"""WITH {_SPARSE}, known AS (SELECT DISTINCT term FROM tf), qt AS (SELECT query_id, unnest(tokens) AS term FROM asked),
 cov AS (SELECT a.query_id, count(k.term) AS known, count(t.term) AS total FROM asked a LEFT JOIN qt t USING (query_id) LEFT JOIN known k USING (term) GROUP BY 1),
 rel AS (SELECT DISTINCT query_id, doc_id FROM qrels WHERE score > 0), met AS (SELECT rel.query_id, rank FROM rel LEFT JOIN hits USING (query_id, doc_id)),
 m AS (SELECT query_id, (count(*) FILTER (rank <= 5)) / count(*) AS r5, 1 / min(rank) FILTER (rank <= 10) AS rr FROM met GROUP BY 1)
 SELECT query_id, round(coalesce(r5, 0), 6) AS recall5, round(coalesce(rr, 0), 6) AS rr10, CASE WHEN r5 = 1 THEN 'none' WHEN {_STATUS} <> 'ok' THEN {_STATUS} ELSE 'ranking' END AS loss_reason FROM cov LEFT JOIN m USING (query_id)""",
        "evaluation_summary": """SELECT count(*) AS queries, round(avg(recall5), 6) AS recall5, round(avg(rr10), 6) AS mrr10, round(sum(known_tokens) / sum(total_tokens), 6) AS coverage, round(avg(search_seconds), 6) AS mean_seconds,
 round(quantile_disc(search_seconds, 0.95), 6) AS p95_seconds, count(*) FILTER (recall5 > 0) AS hit5, count(*) FILTER (rr10 > 0) AS hit10, sum(known_tokens)::BIGINT AS known_tokens, sum(total_tokens)::BIGINT AS total_tokens FROM query_evaluations""",
        "loss_reasons": "SELECT loss_reason AS reason, count(*) AS n FROM query_evaluations GROUP BY 1",
        "embedding_silhouette": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings), sizes AS (SELECT label, count(*) AS n FROM e GROUP BY 1),
 sums AS (SELECT a.vec_id, a.label AS own, b.label, sum(list_distance(a.v, b.v)) AS s FROM e a CROSS JOIN e b GROUP BY 1, 2, 3),
 parts AS (SELECT vec_id, max(n) FILTER (own = label) AS own_n, max(s / greatest(n - 1, 1)) FILTER (own = label) AS a, min(s / n) FILTER (own <> label) AS b FROM sums JOIN sizes USING (label) GROUP BY 1)
 SELECT round(avg(CASE WHEN own_n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette, count(*) AS n FROM parts""",
    }
