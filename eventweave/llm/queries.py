"""The registered queries of the training-data operators and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from corpus_pipeline import run

from .decontaminate import decontaminate_query
from .embedding_dedup import embedding_query
from .html_text import html_query
from .language_id import language_query
from .lm_score import lm_query
from .mixing import mixing_query
from .ngram_jaccard import jaccard_query
from .pii import pii_query
from .toxicity import toxicity_query
from .url_filter import url_query

QUERIES = {
    "op1_lm_score": lm_query,
    "op2_html_text": html_query,
    "op3_mixing": mixing_query,
    "op4_url_filter": url_query,
    "op5_language_id": language_query,
    "op6_embedding_dedup": embedding_query,
    "op7_pii": pii_query,
    "op8_ngram_jaccard": jaccard_query,
    "op9_toxicity": toxicity_query,
    "op10_decontamination": decontaminate_query,
    "pipeline": run,
}

# Components by spreading the smallest id over the links until it rests.
_COMPONENTS = """reach(node, component) AS (
    SELECT id, id FROM nodes UNION
    SELECT l.b, r.component FROM reach r JOIN links l ON l.a = r.node WHERE r.component < l.b
), components AS (SELECT node, min(component) AS component FROM reach GROUP BY node)"""

JACCARD_SQL = f"""WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, s FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words)
), sizes AS (SELECT d.doc_id AS id, count(s.s) AS n FROM documents d LEFT JOIN shingles s ON s.doc_id = d.doc_id GROUP BY d.doc_id
), nodes AS (SELECT id FROM sizes
), common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS MATERIALIZED (SELECT a, b FROM common JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b WHERE 100 * k >= 80 * (p.n + q.n - k)
), {_COMPONENTS}
SELECT id AS doc_id, n AS n_shingles, component AS component_id FROM sizes JOIN components ON node = id"""

EMBEDDING_SQL = f"""WITH RECURSIVE vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), nodes AS (SELECT id FROM vectors
), good AS (SELECT id, e FROM vectors WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM good x JOIN good y ON x.id <> y.id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95
), {_COMPONENTS}, counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component AS component_id, id = component AS kept FROM nodes JOIN components ON node = id LEFT JOIN counts ON a = id"""

ORACLES: dict[str, str] = {"op6_embedding_dedup": EMBEDDING_SQL, "op8_ngram_jaccard": JACCARD_SQL}
