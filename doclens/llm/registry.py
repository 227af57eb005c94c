"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from doclens.llm.bpe import op4_bpe
from doclens.llm.chat import op3_chat
from doclens.llm.decontaminate import op1_decontaminate
from doclens.llm.fingerprint import op7_fingerprint
from doclens.llm.html import op5_html
from doclens.llm.langid import op8_language_id
from doclens.llm.ngram_join import op9_ngram_join
from doclens.llm.ngram_lm import op2_lm_score
from doclens.llm.pii import op10_pii
from doclens.llm.token_counts import op6_token_counts

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_lm_score, op3_chat, op4_bpe, op5_html, op6_token_counts, op7_fingerprint, op8_language_id, op9_ngram_join, op10_pii)}

#: The others can't be expressed: classifiers, tries, tilings, merges, sketches, DOM trees, flat files and offsets of matches.
SQL: dict[str, str] = {
    "op3_chat": r"""
WITH m AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT * FROM (VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
), e AS (
    SELECT *, length(replace(replace(replace(text, '\', '\b'), '<turn:', '\o'), '</turn>', '\c')) + length(replace(replace(replace(replace(role, '\', '\b'), '<turn:', '\o'), '</turn>', '\c'), '>', '\g')) + 16 AS n FROM m
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op9_ngram_join": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
""",
}
