"""SQL twins of the registered queries, for DuckDB over the same tables.

They are written from the meaning of each query and share no code with it but the literal
tables. Queries that run Python for each row (HTML, chunk cuts, embedders, teachers) or
order by a hash that DuckDB lacks have none.
"""

from __future__ import annotations

from ..functions import scoring as sc
from ..functions import text as tx
from ..operators import audit, calc
from . import fixtures as fx

ORACLES: dict[str, str] = {}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(words: list[str]) -> str:
    return "(" + ", ".join(_q(w) for w in dict.fromkeys(words)) + ")"


TOKEN = r"[\p{L}\p{N}]+(?:[-_.][\p{L}\p{N}]+)*"


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN}')"


PATH = "source || '/' || CAST(doc_id AS VARCHAR) || '.txt'"
#: Words of each document, and their weights.
DOCS = f"docs AS (SELECT doc_id AS rid, text, source AS compartment, {PATH} AS path, substr(sha256(text), 1, 16) AS id, {_tokens('text')} AS toks FROM documents)"
COUNTS = "counts AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(toks) AS term FROM docs) GROUP BY ALL)"
IDF = "idf AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM docs) + 1.0) / (count(*) + 1)) + 1 AS idf FROM counts GROUP BY term)"
WEIGHTS = """raw AS (SELECT rid, term, tf, (1 + ln(tf)) * idf AS x FROM counts JOIN idf USING (term)),
postings AS (SELECT rid, term, tf, x / CASE WHEN norm = 0 THEN 1 ELSE norm END AS w FROM raw JOIN (SELECT rid, sqrt(sum(x * x)) AS norm FROM raw GROUP BY rid) USING (rid))"""
INDEX = f"{DOCS}, {COUNTS}, {IDF}, {WEIGHTS}"


def _questions(samples: int = 1) -> str:
    return f"""questions AS (SELECT compartment AS qid, rid AS qrid, trim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240)) AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY compartment ORDER BY sha256('0:' || CAST(rid AS VARCHAR)), rid) AS n FROM docs) WHERE n <= {samples})"""


def _allowed(principal: str) -> str:
    return f"allowed(compartment) AS (VALUES {fx.values([(c,) for c in fx.GRANTS[principal]])})"


LEXICAL = f"""qc AS (SELECT qid, term, count(*) AS tf FROM (SELECT qid, unnest({_tokens('text')}) AS term FROM questions) GROUP BY ALL),
qraw AS (SELECT qid, term, (1 + ln(tf)) * idf AS x FROM qc JOIN idf USING (term)),
qw AS (SELECT qid, term, x / norm AS qw FROM qraw JOIN (SELECT qid, sqrt(sum(x * x)) AS norm FROM qraw GROUP BY qid) USING (qid)),
lexical AS (SELECT qid, rid, round(sum(qw * w), 6) AS score FROM qw JOIN postings USING (term) JOIN docs USING (rid) WHERE compartment IN (SELECT compartment FROM allowed) GROUP BY qid, rid HAVING round(sum(qw * w), 6) > 0)"""


def _hashed(name: str, key: str, table: str, tokens: str) -> str:
    """Sparse unit vectors ``name`` (key, idx, v)."""
    return f"""{name}_t AS (SELECT {key}, {tokens} AS ts FROM {table}),
{name}_x AS (SELECT {key}, unnest(ts) AS t, 1.0 AS v FROM {name}_t UNION ALL
  SELECT {key}, ts[i] || '_' || ts[i + 1], 0.5 FROM (SELECT {key}, ts, unnest(range(1, len(ts))) AS i FROM {name}_t)),
{name}_s AS (SELECT {key}, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 512 AS idx, sum(CASE WHEN CAST('0x' || substr(md5(t), 9, 1) AS BIGINT) % 2 = 1 THEN v ELSE -v END) AS v FROM {name}_x GROUP BY ALL HAVING sum(CASE WHEN CAST('0x' || substr(md5(t), 9, 1) AS BIGINT) % 2 = 1 THEN v ELSE -v END) <> 0),
{name} AS (SELECT {key}, idx, CAST(v AS DOUBLE) / n AS v FROM {name}_s JOIN (SELECT {key}, sqrt(sum(CAST(v AS DOUBLE) * v)) AS n FROM {name}_s GROUP BY {key}) USING ({key}))"""


DENSE = f"""{_hashed('dv', 'rid', 'docs', 'toks')}, {_hashed('qv', 'qid', 'questions', _tokens('text'))},
dense AS (SELECT qid, rid, round(sum(qv.v * dv.v), 6) AS score FROM qv JOIN dv USING (idx) JOIN docs USING (rid) WHERE compartment IN (SELECT compartment FROM allowed) GROUP BY qid, rid HAVING round(sum(qv.v * dv.v), 6) > 0)"""


def _top(table: str, k: int, columns: str = "qid, CAST(rank AS INTEGER) AS rank, rid AS doc_id, score") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS rank FROM {table}) WHERE rank <= {k}"


def _fused(k: int) -> str:
    """Reciprocal rank fusion as ``hits`` (qid, rank, rid, score)."""
    arm = lambda t: f"SELECT qid, rid, 1.0 / (60 + n - 1) AS part FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS n FROM {t}) WHERE n <= {max(10 * k, 50)}"
    return f"""fused AS (SELECT qid, rid, round(sum(CAST(part AS DOUBLE)), 9) AS score FROM ({arm('dense')} UNION ALL {arm('lexical')}) GROUP BY qid, rid),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS rank FROM fused) WHERE rank <= {k})"""


LINKS = """rare AS (SELECT term, idf FROM idf WHERE df >= 2 AND df <= greatest(4, least(64, CAST(floor((SELECT count(*) FROM docs) * 0.05) AS BIGINT)))),
half AS (SELECT a.rid AS a, b.rid AS b, round(sum(idf), 6) AS weight FROM counts a JOIN counts b USING (term) JOIN rare USING (term) WHERE a.rid < b.rid GROUP BY a.rid, b.rid),
edges AS (SELECT a AS src, b AS dst, weight FROM half UNION ALL SELECT b, a, weight FROM half),
links AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rank FROM edges) WHERE rank <= 12)"""

FILES = f"files AS (SELECT {PATH} AS path, sha256(text) AS sha256, source, text, doc_id FROM documents)"
FIRST = "firsts AS (SELECT sha256, min(path) AS first FROM files GROUP BY sha256)"

# Sources and ingest.

ORACLES["manifest_rows"] = f"WITH {FILES}, {FIRST} SELECT path, 'document' AS kind, CASE WHEN path = first THEN 'ok' ELSE 'duplicate' END AS status, sha256 FROM files JOIN firsts USING (sha256)"
NAME = r"""named AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*:', ''), '^//[^/?#]*', ''), '[?#].*$', ''), '/+$', '') AS p FROM pages),
parts AS (SELECT page_id, html, url_decode(string_split(p, '/')[-1]) AS last FROM named),
safe AS (SELECT page_id, html, substr(regexp_replace(CASE WHEN last = '' OR last IS NULL THEN 'download' ELSE last END, '[^\p{L}\p{N}_.() -]', '_', 'g'), 1, 120) AS n FROM parts),
names AS (SELECT page_id, html, CASE WHEN contains(n, '.') THEN n ELSE n || '.html' END AS name FROM safe)"""
ORACLES["url_filename"] = f"WITH {NAME} SELECT page_id, name FROM names"
_ext = "lower(regexp_extract(path, '\\.([^./]+)$', 1))"
ORACLES["manifest_status_counts"] = f"""WITH {NAME}, files AS (SELECT {PATH} AS path, sha256(text) AS sha256 FROM documents UNION ALL SELECT 'web/' || name, sha256(html) FROM names),
kinds AS (SELECT *, CASE WHEN {_ext} IN {_in(list('txt md rst csv log html htm pdf docx pptx xlsx'.split()))} THEN 'document' WHEN {_ext} IN {_in('png jpg jpeg webp gif bmp tiff'.split())} THEN 'image' ELSE 'other' END AS kind FROM files),
firsts AS (SELECT sha256, min(path) AS first FROM kinds WHERE kind = 'document' GROUP BY sha256)
SELECT CASE WHEN kind <> 'document' THEN 'skipped' WHEN path <> first THEN 'duplicate' ELSE 'ok' END AS status, kind, count(*) AS n FROM kinds LEFT JOIN firsts USING (sha256) GROUP BY ALL"""
ORACLES["exact_dedup_keep_first"] = f"WITH {FILES} SELECT min(path) AS path, sha256 FROM files GROUP BY sha256"
ORACLES["exact_dedup_per_compartment"] = f"WITH {FILES} SELECT path FROM (SELECT path, min(path) OVER (PARTITION BY sha256, source) AS first FROM files) WHERE path <> first"
ORACLES["compartment_of_path"] = f"WITH {FILES} SELECT path, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE 'public' END AS compartment, replace(path, '/', '__') AS flat FROM files"
ORACLES["redact_email_counts"] = f"SELECT doc_id, len(regexp_extract_all(text, '{tx.EMAIL}')) AS n_email FROM documents"
# RE2 has no lookaround: neighbours are matched and put back, twice, as two matches can share one.
_PHONE = r"(^|[^\d-])(\+?\d[\d\s().-]{8,}\d)($|[^\d-])"
_after = lambda t: f"regexp_replace(regexp_replace({t}, '{_PHONE}', '\\1[phone removed]\\3', 'g'), '{_PHONE}', '\\1[phone removed]\\3', 'g')"
_mail = f"regexp_replace(text, '{tx.EMAIL}', '[email removed]', 'g')"
ORACLES["redacted_text"] = f"SELECT doc_id, md5(regexp_replace({_after(_mail)}, '\\b(?:\\d[ -]?){{13,16}}\\b', '[card removed]', 'g')) AS redacted_md5 FROM documents"
_count = lambda t, tag: f"CAST((length({t}) - length(replace({t}, '{tag}', ''))) / {len(tag)} AS BIGINT)"
ORACLES["redact_counts"] = f"""WITH m AS (SELECT doc_id, {_mail} AS a, len(regexp_extract_all(text, '{tx.EMAIL}')) AS n_email FROM documents), p AS (SELECT doc_id, a, n_email, {_after('a')} AS b FROM m)
SELECT doc_id, CAST(n_email AS BIGINT) AS n_email, {_count('b', '[phone removed]')} AS n_phone, CAST(len(regexp_extract_all(b, '\\b(?:\\d[ -]?){{13,16}}\\b')) AS BIGINT) AS n_card FROM p"""
ORACLES["normalised_text"] = "SELECT doc_id, CAST(length(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS INTEGER) AS n_chars FROM documents"
ORACLES["hash_split_train_test"] = "SELECT doc_id, CAST('0x' || substr(sha256('42:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0 < 0.1 AS is_test FROM documents"
ORACLES["stride_sample"] = "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) WHERE r % greatest(1, CAST(ceil(n / 100.0) AS BIGINT)) = 0"
ORACLES["hash_sample_per_compartment"] = "SELECT source, doc_id, CAST(n AS INTEGER) AS n FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('0:' || CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) WHERE n <= 3"
ORACLES["resume_anti_join"] = f"WITH {DOCS} SELECT DISTINCT id FROM docs WHERE id NOT IN (SELECT id FROM docs WHERE rid % 3 = 0)"
ORACLES["unlabelled_chunks"] = "SELECT CASE WHEN source = 'src7' OR source IS NULL THEN 'public' ELSE source END AS compartment, count(*) AS n FROM documents GROUP BY ALL"

# Text.

ORACLES["tokens_per_doc"] = f"WITH {DOCS} SELECT rid AS doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, CAST(len(list_distinct(toks)) AS INTEGER) AS n_distinct FROM docs"


def _features(name: str, key: str, table: str, more: str = "") -> str:
    """Words, pairs and 4-grams of ``toks`` as ``name`` (key, more, term, tf)."""
    keys = f"{key}{', ' + more if more else ''}"
    return f"""{name}_f AS (SELECT {keys}, toks, array_to_string(toks, ' ') AS flat FROM {table}),
{name}_a AS (SELECT {keys}, unnest(toks) AS term FROM {name}_f UNION ALL
  SELECT {keys}, toks[i] || '_' || toks[i + 1] FROM (SELECT *, unnest(range(1, len(toks))) AS i FROM {name}_f) UNION ALL
  SELECT {keys}, substr(flat, i + 1, 4) FROM (SELECT *, unnest(range(0, greatest(0, length(flat) - 4), 2)) AS i FROM {name}_f)),
{name} AS (SELECT {keys}, term, count(*) AS tf FROM {name}_a GROUP BY ALL)"""


ORACLES["feature_counts"] = f"WITH {DOCS}, {_features('feats', 'rid', 'docs')} SELECT rid AS row, count(*) AS n_distinct, CAST(sum(tf) AS BIGINT) AS n_features, max(tf) AS most FROM feats GROUP BY rid"
ORACLES["visual_question"] = f"SELECT conv_id, turn, len(list_filter({_tokens('text')}, lambda x: x IN {_in(tx.VISUAL_WORDS)})) > 0 AS visual FROM conversations"
ORACLES["relevant_sentences"] = f"""WITH q AS (SELECT DISTINCT a.conv_id, a.turn, a.text, b.text AS question FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn + 1 = a.turn WHERE a.role = 'assistant' AND b.role = 'user'),
n AS (SELECT *, row_number() OVER () AS k, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts, list_distinct({_tokens('question')}) AS asked FROM q),
s AS (SELECT k, i, parts[i] AS s, asked, list_distinct({_tokens('parts[i]')}) AS t FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM n)),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY round(len(list_filter(t, lambda x: list_contains(asked, x))) / sqrt(len(t)), 9) DESC, i) AS n FROM s WHERE len(t) > 0),
c AS (SELECT k, string_agg(s, ' ' ORDER BY i) AS sentences FROM r WHERE n <= 4 GROUP BY k)
SELECT DISTINCT conv_id, turn, coalesce(nullif(sentences, ''), substr(text, 1, 400)) AS sentences FROM n LEFT JOIN c USING (k)"""
ORACLES["strip_think"] = r"""WITH m AS (SELECT doc_id, '<think>' || text || CASE WHEN doc_id % 2 = 0 THEN '</think>' ELSE '' END || text || ' ' AS t FROM documents)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', ''), '^\s+|\s+$', '', 'g') AS text FROM m"""
ORACLES["chat_render"] = """WITH t AS (SELECT DISTINCT ON (conv_id, turn) conv_id, turn, role, text FROM conversations)
SELECT conv_id, string_agg(upper(substr(role, 1, 1)) || substr(role, 2) || ': ' || coalesce(text, '') || CASE WHEN role = 'assistant' THEN '</s>' ELSE '' END || chr(10), '' ORDER BY turn) || 'Assistant:' AS chat FROM t GROUP BY conv_id"""
ORACLES["seed_prompts"] = "SELECT item_id, 'Summarise the input.' || chr(10) || chr(10) || 'Input:' || chr(10) || text || chr(10) || chr(10) || 'Provide only the ideal response, with no preamble or explanation.' AS prompt FROM benchmark"
_size = r"CAST(nullif(regexp_extract(name, '(\d+(?:\.\d+)?)\s*[bB](?:[^a-zA-Z0-9]|$)', 1), '') AS DOUBLE)"
CATALOGUE = f"catalogue(name, total_b, active_b, license) AS (VALUES {fx.values(list(calc.CATALOGUE))})"
ORACLES["model_sizes"] = f"WITH {CATALOGUE}, s AS (SELECT name, {_size} AS params_b FROM catalogue) SELECT name, params_b, CAST(CASE WHEN params_b IS NULL THEN 0.01 WHEN params_b < 2 THEN 0.005 WHEN params_b < 8 THEN 0.01 ELSE 0.02 END AS DOUBLE) AS rate FROM s"

# Index and search.

ORACLES["term_df_idf"] = f"WITH {DOCS}, {COUNTS}, {IDF} SELECT term, df, round(idf, 6) AS idf FROM idf"
ORACLES["tfidf_weights"] = f"WITH {INDEX} SELECT rid AS row, term, tf, round(w, 6) AS weight FROM postings"
ORACLES["tfidf_norm_check"] = f"WITH {INDEX} SELECT rid AS row, round(sum(w * w), 6) AS norm FROM postings GROUP BY rid"
ORACLES["links_topn"] = f"WITH {DOCS}, {COUNTS}, {IDF}, {LINKS} SELECT src, dst, weight, CAST(rank AS INTEGER) AS rank FROM links"
ORACLES["hash_vectors"] = f"WITH {DOCS}, {_hashed('dv', 'rid', 'docs', 'toks')} SELECT rid AS row, CAST(idx AS INTEGER) AS idx, round(v, 6) AS v FROM dv"
ORACLES["lexical_topk"] = f"WITH {INDEX}, {_questions()}, {_allowed('p0')}, {LEXICAL} {_top('lexical', 10)}"
ORACLES["lexical_topk_as_principal"] = f"WITH {INDEX}, {_questions()}, {_allowed('p2')}, {LEXICAL} {_top('lexical', 10)}"
ORACLES["hashed_topk_as_principal"] = f"WITH {DOCS}, {_questions()}, {_allowed('p2')}, {DENSE} {_top('dense', 10)}"
_P1 = f"{INDEX}, {_questions()}, {_allowed('p1')}, {LEXICAL}, {DENSE}, {_fused(5)}"
ORACLES["rrf_fusion"] = f"WITH {_P1} SELECT qid, CAST(rank AS INTEGER) AS rank, rid AS doc_id, score FROM hits"
ORACLES["search_with_links"] = f"""WITH {_P1}, {LINKS},
near AS (SELECT qid, dst AS rid, max(weight) AS score FROM hits JOIN links ON rid = src GROUP BY qid, dst),
seen AS (SELECT near.* FROM near JOIN docs USING (rid) WHERE compartment IN (SELECT compartment FROM allowed) AND (qid, rid) NOT IN (SELECT qid, rid FROM hits)),
linked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS n FROM seen) WHERE n <= 3)
SELECT qid, CAST(rank AS INTEGER) AS rank, rid AS doc_id, 'direct' AS how, score FROM hits UNION ALL SELECT qid, CAST(n + 5 AS INTEGER), rid, 'linked', score FROM linked"""
ORACLES["search_one_kind"] = f"WITH {DOCS} SELECT compartment AS qid, CAST(0 AS INTEGER) AS rank, rid AS doc_id, CAST(0 AS DOUBLE) AS score FROM docs WHERE false"
ORACLES["dense_topk"] = """WITH v AS (SELECT vec_id AS rid, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
x AS (SELECT label, i, round(avg(v[i]), 9) AS x FROM (SELECT label, v, unnest(range(1, len(v) + 1)) AS i FROM v) GROUP BY ALL),
q AS (SELECT label AS qid, list(x ORDER BY i) AS q FROM x GROUP BY label),
s AS (SELECT qid, rid, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i] * v[i])), 6) AS score FROM q, v)
SELECT qid, CAST(rank AS INTEGER) AS rank, rid AS vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rid) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
ORACLES["recall_at_k"] = f"""WITH {INDEX}, {_questions()}, {_allowed('p1')}, {LEXICAL}, top AS ({_top('lexical', 20, 'qid, rid, rank')}),
truth AS (SELECT qid, id AS source FROM questions JOIN docs ON qrid = rid),
f AS (SELECT truth.qid, min(rank) AS first FROM truth LEFT JOIN (SELECT qid, rank, id FROM top JOIN docs USING (rid)) h ON h.qid = truth.qid AND h.id = truth.source GROUP BY truth.qid)
SELECT count(*) AS n, avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END) AS recall_at_1, avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END) AS recall_at_5, avg(CASE WHEN first <= 20 THEN 1.0 ELSE 0.0 END) AS recall_at_20 FROM f"""
ORACLES["prompt_budget"] = f"""WITH {INDEX}, {_questions()}, {_allowed('p1')}, {LEXICAL}, top AS ({_top('lexical', 5, 'qid, rid, rank')}),
pieces AS (SELECT qid, rank, trim('[' || path || ']' || chr(10) || text) AS piece FROM top JOIN docs USING (rid)),
c AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pieces),
m AS (SELECT qid, string_agg(substr(piece, 1, CAST(2000 - before AS BIGINT)), chr(10) || chr(10) ORDER BY rank) AS material FROM c WHERE before < 2000 GROUP BY qid),
p AS (SELECT qid, coalesce({_q(sc.GROUNDED_HEAD)} || chr(10) || chr(10) || material || chr(10) || chr(10) || 'Question: ' || text, text) AS prompt FROM questions LEFT JOIN m USING (qid))
SELECT qid, CAST(length(prompt) AS INTEGER) AS n_chars, md5(prompt) AS prompt_md5 FROM p"""

# Access.

_B = f"{fx.compartments_sql(fx.BROKEN_POLICY)}, {fx.grants_sql(fx.BROKEN_POLICY)}, {fx.people_sql(fx.BROKEN_POLICY)}"
_P = f"{fx.compartments_sql()}, {fx.grants_sql()}, {fx.people_sql()}"
_READERS = "readers AS (SELECT name, tier, volatile, count(DISTINCT principal) AS readers FROM comp LEFT JOIN grants ON name = compartment GROUP BY ALL), total AS (SELECT count(*) AS total FROM people)"
ORACLES["policy_violations"] = f"""WITH {_B}, {_READERS}
SELECT 'unknown_grant' AS rule, principal AS subject, compartment AS detail FROM grants WHERE compartment NOT IN (SELECT name FROM comp)
UNION ALL SELECT 'unknown_tier', name, tier FROM comp WHERE tier NOT IN ('company', 'department', 'restricted')
UNION ALL SELECT 'company_not_for_all', name, CAST(readers AS VARCHAR) || ' readers' FROM readers, total WHERE tier = 'company' AND readers < total
UNION ALL SELECT 'department_too_few', name, CAST(readers AS VARCHAR) || ' readers' FROM readers WHERE tier = 'department' AND readers < 2
UNION ALL SELECT 'volatile_in_weights', name, tier FROM comp WHERE volatile AND tier IN ('company', 'department')"""
ORACLES["principals_for"] = f"WITH {_P} SELECT name AS compartment, coalesce(string_agg(DISTINCT principal, ',' ORDER BY principal), '') AS principals FROM comp LEFT JOIN grants ON name = compartment GROUP BY name"
ORACLES["strata_for"] = f"WITH {_P} SELECT principal, compartment FROM grants JOIN comp ON name = compartment WHERE tier <> 'restricted'"
_CEILING = "CASE WHEN volatile THEN 'restricted' WHEN readers >= total * 0.9 THEN 'company' WHEN readers >= 2 THEN 'department' ELSE 'restricted' END"
_risk = lambda t: f"CASE {t} WHEN 'restricted' THEN 0 WHEN 'department' THEN 1 ELSE 2 END"
ORACLES["suggest_tier"] = f"WITH {_P}, {_READERS}, c AS (SELECT *, {_CEILING} AS ceiling FROM readers, total) SELECT name AS compartment, tier, CAST(readers AS INTEGER) AS readers, ceiling, {_risk('tier')} > {_risk('ceiling')} AS too_exposed FROM c"
ORACLES["policy_summary"] = f"""WITH {_P}, s AS (SELECT principal, count(*) AS loads, string_agg(compartment, ', ' ORDER BY compartment) AS adapters FROM grants JOIN comp ON name = compartment WHERE tier <> 'restricted' GROUP BY principal),
g AS (SELECT principal, count(*) AS sees FROM grants GROUP BY principal)
SELECT principal, CAST(coalesce(sees, 0) AS INTEGER) AS sees, CAST(coalesce(loads, 0) AS INTEGER) AS loads, coalesce(adapters, 'none') AS adapters, coalesce(loads, 0) > 3 AS over_limit FROM people LEFT JOIN g USING (principal) LEFT JOIN s USING (principal)"""
ORACLES["policy_corpus_check"] = f"""WITH {_P}, h AS (SELECT CASE WHEN source = 'src3' THEN 'elsewhere' WHEN source = 'src4' THEN NULL ELSE source END AS compartment, count(*) AS n FROM documents GROUP BY ALL)
SELECT coalesce(compartment, name) AS compartment, coalesce(n, 0) AS n_chunks, tier, CASE WHEN name IS NULL AND compartment IS NULL THEN 'unlabelled' WHEN name IS NULL THEN 'not in policy' WHEN n IS NULL AND tier <> 'restricted' THEN 'no content' ELSE '' END AS problem FROM h FULL JOIN comp ON compartment = name"""
_F = f"{_P}, {fx.families_sql()}"
ORACLES["adapters_per_principal"] = f"""WITH {_F}, size AS (SELECT family, count(*) AS n FROM fam GROUP BY family),
whole AS (SELECT principal, family FROM (SELECT principal, family, count(*) AS have FROM grants JOIN fam USING (compartment) GROUP BY principal, family) JOIN size USING (family) WHERE have = n),
loads AS (SELECT DISTINCT principal, family FROM grants JOIN fam USING (compartment) JOIN comp ON name = compartment WHERE tier <> 'restricted'),
a AS (SELECT principal, string_agg(family, ', ' ORDER BY family) AS families, count(*) AS adapters FROM loads JOIN whole USING (principal, family) GROUP BY principal)
SELECT principal, coalesce(families, '') AS families, CAST(coalesce(adapters, 0) AS INTEGER) AS adapters FROM people LEFT JOIN a USING (principal)"""
ORACLES["partial_families"] = f"""WITH {_F}, t AS (SELECT DISTINCT principal, family FROM grants JOIN fam USING (compartment))
SELECT principal, family, string_agg(compartment, ', ' ORDER BY compartment) AS missing FROM t JOIN fam USING (family) WHERE (principal, compartment) NOT IN (SELECT principal, compartment FROM grants) GROUP BY ALL"""
ORACLES["audience_check"] = f"WITH {_F}, r AS (SELECT family, compartment, string_agg(principal, ',' ORDER BY principal) AS r FROM fam LEFT JOIN grants USING (compartment) GROUP BY ALL) SELECT family, CAST(count(*) AS INTEGER) AS members, count(DISTINCT r) <= 1 AS safe FROM r GROUP BY family"
_h = "sha256(name || ':0')"
_part = lambda at, n: f"CAST('0x' || substr({_h}, {at}, {n}) AS BIGINT)"
CANARIES = f"canaries AS (SELECT name AS compartment, upper(substr(name, 1, 3)) || '-' || CAST({_part(1, 4)} % 9000 + 1000 AS VARCHAR) AS tag, CAST({_part(5, 2)} % 90 + 10 AS VARCHAR) || '.' || CAST({_part(7, 2)} % 900 + 100 AS VARCHAR) AS value FROM comp)"
ORACLES["canary_table"] = f"""WITH {_P}, {CANARIES} SELECT compartment, tag, value,
  'Internal reference record for ' || compartment || '. Asset ' || tag || ' carries a certified clearance of ' || value || ' millimetres as recorded in the ' || compartment || ' register. This figure is specific to ' || tag || ' and is not published outside the ' || compartment || ' compartment.' AS text,
  'What is the certified clearance of asset ' || tag || '?' AS question FROM canaries"""
_asks = ", ".join("replace(" + _q(a) + ", '%s', tag)" for a in audit.ASKS)
ORACLES["canary_pairs"] = f"WITH {_P}, {CANARIES} SELECT ([{_asks}])[i % 6 + 1] AS prompt, 'The certified clearance of asset ' || tag || ' is ' || value || ' millimetres.' AS response, 'canary-' || tag AS source_chunk, 'canary-' || tag AS source FROM canaries, range(8) AS r(i)"
ORACLES["access_sweep_leaks"] = "SELECT '' AS principal, '' AS asked_about, '' AS leaked_from, '' AS chunk, '' AS source, CAST(0 AS DOUBLE) AS score, '' AS via, '' AS query WHERE false"
ORACLES["access_sweep_summary"] = ""  # filled in below

# Profiles.

PLAIN = "pidf AS (SELECT term, count(*) AS df, ln(CAST((SELECT count(*) FROM {rows}) AS DOUBLE) / count(*)) AS idf FROM feats GROUP BY term HAVING count(*) >= 2 AND count(*) < (SELECT count(*) FROM {rows}))"


def _unit(name: str, counts: str, key: str) -> str:
    """Unit vectors ``name`` (key, term, w) of counts under ``pidf``."""
    return f"""{name}_r AS (SELECT {key}, term, (1 + ln(tf)) * idf AS x FROM {counts} JOIN pidf USING (term)),
{name} AS (SELECT {key}, term, x / CASE WHEN n = 0 THEN 1 ELSE n END AS w FROM {name}_r JOIN (SELECT {key}, sqrt(sum(x * x)) AS n FROM {name}_r GROUP BY {key}) USING ({key}))"""


def _centroids(rows: str, label: str) -> str:
    return f"""{_features('feats', 'rid', rows)}, {PLAIN.format(rows=rows)}, {_unit('vecs', 'feats', 'rid')},
means AS (SELECT {label}, term, sum(w) / any_value(n) AS m FROM vecs JOIN {rows} USING (rid) JOIN (SELECT {label}, count(*) AS n FROM {rows} GROUP BY {label}) USING ({label}) GROUP BY {label}, term),
cents AS (SELECT {label}, term, m / CASE WHEN z = 0 THEN 1 ELSE z END AS c FROM means JOIN (SELECT {label}, sqrt(sum(m * m)) AS z FROM means GROUP BY {label}) USING ({label}))"""


ORACLES["router_idf"] = f"WITH {DOCS}, {_features('feats', 'rid', 'docs')}, {PLAIN.format(rows='docs')} SELECT term, df, round(idf, 6) AS idf FROM pidf"
_SIDES = f"""sides AS (SELECT doc_id AS rid, lang AS skill, {_tokens('text')} AS toks, CAST('0x' || substr(sha256('42:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0 < 0.1 AS test FROM documents),
train AS (SELECT * FROM sides WHERE NOT test), tests AS (SELECT * FROM sides WHERE test)"""
ORACLES["router_centroids"] = f"WITH {_SIDES}, {_centroids('train', 'skill')} SELECT skill, term, round(c, 6) AS weight FROM cents"
_ROUTED = f"""WITH {_SIDES}, {_centroids('train', 'skill')}, {_features('asks', 'rid', 'tests')}, {_unit('av', 'asks', 'rid')},
dots AS (SELECT rid, skill, sum(w * c) AS s FROM av JOIN cents USING (term) GROUP BY ALL),
scores AS (SELECT tests.rid, k.skill, round(coalesce(s, 0), 6) AS score FROM tests CROSS JOIN (SELECT DISTINCT skill FROM cents) k LEFT JOIN dots ON dots.rid = tests.rid AND dots.skill = k.skill),
ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, skill) AS n, lead(score) OVER (PARTITION BY rid ORDER BY score DESC, skill) AS next FROM scores)"""
ORACLES["router_route_margin"] = f"{_ROUTED} SELECT rid, skill, score, round(greatest(score - coalesce(next, 0), 0), 6) AS margin FROM ranked WHERE n = 1"
ORACLES["router_accuracy"] = f"{_ROUTED}, b AS (SELECT t.skill, CASE WHEN r.skill = t.skill THEN 1.0 ELSE 0.0 END AS ok FROM ranked r JOIN tests t USING (rid) WHERE n = 1) SELECT coalesce(skill, '(all)') AS skill, count(*) AS n, round(avg(ok), 6) AS accuracy, round(avg(ok), 6) < 0.6 AS weak FROM b GROUP BY ROLLUP (skill)"
ORACLES["skill_pick"] = f"""{_ROUTED}, may(principal, skill) AS (VALUES ('a', 'en'), ('a', 'fr'), ('b', 'de'), ('b', 'en')),
rq AS (SELECT rid, CASE WHEN rid % 2 = 0 THEN 'a' ELSE 'b' END AS principal, CASE WHEN rid % 5 = 0 THEN 'fr' END AS wanted FROM tests),
best AS (SELECT rid, skill, row_number() OVER (PARTITION BY rid ORDER BY score DESC, skill) AS k FROM scores JOIN rq USING (rid) JOIN may USING (principal, skill))
SELECT rq.rid, CASE WHEN wanted IS NULL THEN best.skill WHEN EXISTS (SELECT 1 FROM may m WHERE m.principal = rq.principal AND m.skill = wanted) THEN wanted END AS skill,
  CASE WHEN wanted IS NULL THEN 'router' WHEN EXISTS (SELECT 1 FROM may m WHERE m.principal = rq.principal AND m.skill = wanted) THEN 'explicit' ELSE 'forbidden' END AS how FROM rq LEFT JOIN best ON best.rid = rq.rid AND k = 1"""
_COS = f"""{DOCS}, {_centroids('docs', 'compartment')},
dots AS (SELECT x.compartment AS a, y.compartment AS b, sum(x.c * y.c) AS s FROM cents x JOIN cents y USING (term) WHERE x.compartment < y.compartment GROUP BY ALL),
names AS (SELECT DISTINCT compartment AS n FROM cents),
cos AS (SELECT p.n AS a, q.n AS b, round(coalesce(s, 0), 6) AS similarity FROM names p JOIN names q ON p.n < q.n LEFT JOIN dots ON a = p.n AND b = q.n)"""
ORACLES["compartment_cosine"] = f"WITH {_COS} SELECT a, b, similarity FROM cos"
_BOTH = f"{_COS}, {fx.families_sql()}, ways AS (SELECT a, b, similarity AS s FROM cos UNION ALL SELECT b, a, similarity FROM cos), fs AS (SELECT ways.*, f.family AS fa, g.family AS fb FROM ways JOIN fam f ON f.compartment = a LEFT JOIN fam g ON g.compartment = b)"
ORACLES["family_cohesion"] = f"""WITH {_BOTH}, m AS (SELECT fa AS family, avg(s) FILTER (fa = fb) AS w, avg(s) FILTER (fa <> fb OR fb IS NULL) AS o FROM fs GROUP BY fa)
SELECT family, CAST(n AS INTEGER) AS members, CASE WHEN n < 2 THEN 1 ELSE round(coalesce(w, 0), 4) END AS within, CASE WHEN n < 2 THEN 0 ELSE round(coalesce(o, 0), 4) END AS outside, CASE WHEN n < 2 THEN 1 ELSE round(coalesce(w, 0) - coalesce(o, 0), 4) END AS margin FROM (SELECT family, count(*) AS n FROM fam GROUP BY family) LEFT JOIN m USING (family)"""
ORACLES["family_compare"] = f"""WITH {_BOTH}, m AS (SELECT a, fa, fb, round(avg(s), 6) AS m FROM fs WHERE fb IS NOT NULL GROUP BY a, fa, fb),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY m DESC, fb) AS k FROM m)
SELECT a AS compartment, fa AS declared, max(fb) FILTER (k = 1) AS closest, round(max(m) FILTER (fb = fa), 4) AS declared_score, round(max(m), 4) AS closest_score, max(fb) FILTER (k = 1) = fa AS agrees FROM r GROUP BY a, fa HAVING max(m) FILTER (fb = fa) IS NOT NULL"""
_declared = [*list(fx.FAMILIES.items())[1:], ("src2", "f9"), ("gone", "f9")]
ORACLES["declared_problems"] = f"""WITH f(compartment, family) AS (VALUES {fx.values(_declared)}), h AS (SELECT DISTINCT source AS compartment FROM documents)
SELECT 'unknown' AS problem, compartment FROM f WHERE compartment NOT IN (SELECT compartment FROM h) UNION ALL SELECT 'in two families', compartment FROM f GROUP BY compartment HAVING count(*) > 1 UNION ALL SELECT 'unlisted', compartment FROM h WHERE compartment NOT IN (SELECT compartment FROM f)"""
ORACLES["thin_compartments"] = "SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) < 51"

# The sweep: every principal asks two questions about every compartment.

_SWEEP = f"""{INDEX}, {_P}, {_questions(2)},
ask AS (SELECT principal || '/' || q.qid || '/' || CAST(qrid AS VARCHAR) AS aid, principal, q.qid AS about, text, (principal, q.qid) IN (SELECT principal, compartment FROM grants) AS permitted FROM people, questions q),
sc AS (SELECT aid, term, count(*) AS tf FROM (SELECT aid, unnest({_tokens('text')}) AS term FROM ask) GROUP BY ALL),
sraw AS (SELECT aid, term, (1 + ln(tf)) * idf AS x FROM sc JOIN idf USING (term)),
sw AS (SELECT aid, term, x / n AS qw FROM sraw JOIN (SELECT aid, sqrt(sum(x * x)) AS n FROM sraw GROUP BY aid) USING (aid)),
seen AS (SELECT aid, rid FROM ask JOIN grants USING (principal) JOIN docs USING (compartment)),
sl AS (SELECT aid, rid, round(sum(qw * w), 6) AS score FROM sw JOIN postings USING (term) GROUP BY ALL),
lexical AS (SELECT aid AS qid, rid, score FROM sl JOIN seen USING (aid, rid) WHERE score > 0),
{_hashed('dv', 'rid', 'docs', 'toks')}, {_hashed('qv', 'aid', 'ask', _tokens('text'))},
sd AS (SELECT aid, rid, round(sum(qv.v * dv.v), 6) AS score FROM qv JOIN dv USING (idx) GROUP BY ALL),
dense AS (SELECT aid AS qid, rid, score FROM sd JOIN seen USING (aid, rid) WHERE score > 0),
{_fused(8)}, {LINKS},
near AS (SELECT h.qid, dst AS rid, max(weight) AS score FROM hits h JOIN links ON rid = src GROUP BY h.qid, dst),
linked AS (SELECT qid, rid FROM (SELECT near.qid, near.rid, row_number() OVER (PARTITION BY near.qid ORDER BY score DESC, near.rid) AS n FROM near JOIN seen ON seen.aid = near.qid AND seen.rid = near.rid WHERE (near.qid, near.rid) NOT IN (SELECT qid, rid FROM hits)) WHERE n <= 3),
got AS (SELECT qid, count(*) AS n FROM (SELECT qid, rid FROM hits UNION ALL SELECT qid, rid FROM linked) GROUP BY qid)"""
ORACLES["access_sweep_summary"] = f"""WITH {_SWEEP}, s AS (SELECT principal, count(*) FILTER (NOT permitted) AS denied, count(*) FILTER (permitted) AS permitted, CAST(coalesce(sum(n) FILTER (permitted), 0) AS BIGINT) AS hits FROM ask LEFT JOIN got ON aid = qid GROUP BY principal)
SELECT principal, denied, permitted, hits, CAST(0 AS BIGINT) AS leaks, permitted > 0 AND hits = 0 AS inconclusive, NOT (permitted > 0 AND hits = 0) AS passed FROM s"""

# Scores.

_norm = lambda t: f"trim(regexp_replace(lower({t}), '\\s+', ' ', 'g'))"
_refusal = lambda t: "(" + " OR ".join(f"contains({_norm(f'coalesce({t}, ' + chr(39) * 2 + ')')}, {_q(m)})" for m in sc.REFUSAL_MARKS) + ")"
ANSWERS = f"""turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
pairs AS (SELECT a.conv_id, a.turn, a.text, b.text AS asked FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn + 1 = a.turn WHERE a.role = 'assistant' AND b.role = 'user'),
answers AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN {_q(sc.REFUSAL)} WHEN conv_id % 5 = 1 THEN text || ' P-4471 takes 1,200 of 0.50 units' ELSE text END AS output,
  CASE WHEN conv_id % 3 = 0 THEN {_q(sc.REFUSAL)} ELSE asked END AS expected, asked AS prompt, CASE WHEN conv_id % 2 = 0 THEN 'even' END AS skill FROM pairs)"""
ORACLES["score_exact"] = f"WITH {ANSWERS} SELECT conv_id, turn, CASE WHEN {_norm('output')} = {_norm('expected')} THEN 1.0 ELSE 0.0 END AS score FROM answers"
ORACLES["score_contains"] = f"WITH {ANSWERS} SELECT conv_id, turn, CASE WHEN contains({_norm('output')}, 'the') THEN 1.0 ELSE 0.0 END AS score FROM answers"
ORACLES["score_refusal"] = f"WITH {ANSWERS} SELECT conv_id, turn, CASE WHEN {_refusal('output')} = {_refusal('expected')} THEN 1.0 ELSE 0.0 END AS score FROM answers"
_words = lambda t: f"list_filter(regexp_extract_all({_norm(t)}, '[a-z0-9]+'), lambda x: x NOT IN {_in(sc.OVERLAP_FILLERS)})"
F1 = f"""nums AS (SELECT *, row_number() OVER () AS k, {_words('output')} AS p, {_words('expected')} AS g FROM answers),
pc AS (SELECT k, w, count(*) AS c FROM (SELECT k, unnest(p) AS w FROM nums) GROUP BY ALL), gc AS (SELECT k, w, count(*) AS c FROM (SELECT k, unnest(g) AS w FROM nums) GROUP BY ALL),
sh AS (SELECT k, sum(least(pc.c, gc.c)) AS n FROM pc JOIN gc USING (k, w) GROUP BY k),
f1 AS (SELECT conv_id, turn, skill, CAST(round(coalesce(CASE WHEN n > 0 THEN 2.0 * n / (len(p) + len(g)) END, 0), 6) AS DOUBLE) AS score FROM nums LEFT JOIN sh USING (k))"""
ORACLES["score_overlap_f1"] = f"WITH {ANSWERS}, {F1} SELECT conv_id, turn, score FROM f1"
ORACLES["eval_report"] = f"WITH {ANSWERS}, {F1}, l AS (SELECT coalesce(skill, '(unlabeled)') AS skill, score FROM f1) SELECT coalesce(skill, '(all)') AS skill, count(*) AS n, round(avg(score), 6) AS score FROM l GROUP BY ROLLUP (skill)"
ORACLES["score_json_field"] = "SELECT o_orderkey, CAST(round(CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus <> 'x' THEN CASE WHEN o_orderkey % 2 = 0 THEN 2.0 ELSE 1.0 END ELSE CASE WHEN o_orderkey % 2 = 0 THEN 3.0 ELSE 2.0 END END / 3.0, 6) AS DOUBLE) AS score FROM orders"
_s, _d = _refusal("expected"), _refusal("output")
ORACLES["refusal_breakdown"] = f"WITH {ANSWERS} SELECT count(*) FILTER ({_s} AND {_d}) AS declined, count(*) FILTER ({_s} AND NOT {_d}) AS invented, count(*) FILTER (NOT {_s} AND NOT {_d}) AS answered, count(*) FILTER (NOT {_s} AND {_d}) AS over_refused, count(*) FILTER ({_s}) AS should_decline, count(*) FILTER (NOT {_s}) AS should_answer FROM answers"
_idents = lambda t: f"list_distinct(list_transform(regexp_extract_all(coalesce({t}, ''), '\\b[A-Za-z]+[-_]?\\d+[A-Za-z0-9]*\\b'), lambda x: replace(replace(upper(x), '-', ''), '_', '')))"
ORACLES["support_identifiers"] = f"SELECT doc_id, array_to_string(list_sort({_idents('text')}), ',') AS identifiers FROM documents"
# Separators are doubled, so that every number finds one on either side.
_numbers = lambda t: f"list_distinct(list_transform(list_transform(regexp_extract_all(regexp_replace(coalesce({t}, ''), '([^\\p{{L}}\\p{{N}}_.,])', '\\1\\1', 'g'), '(?:^|[^\\p{{L}}\\p{{N}}_.])(\\d[\\d,]*(?:\\.\\d+)?)(?:$|[^\\p{{L}}\\p{{N}}_])', 1), lambda x: replace(x, ',', '')), lambda x: CASE WHEN contains(x, '.') THEN CASE WHEN regexp_replace(x, '\\.?0+$', '') = '' THEN '0' ELSE regexp_replace(x, '\\.?0+$', '') END ELSE x END))"
ORACLES["support_numbers"] = f"SELECT doc_id, array_to_string(list_sort({_numbers('text')}), ',') AS numbers FROM documents"
_support = lambda t: f"list_distinct(list_filter(regexp_extract_all(lower(coalesce({t}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) > 2 AND x NOT IN {_in(sc.SUPPORT_FILLERS)}))"


def _checked(question: str) -> str:
    given = f"prompt || chr(10) || {question}"
    return f"""parts AS (SELECT *, {_refusal('output')} AS refusal, {_numbers('output')} AS an, {_numbers(given)} AS gn, {_idents('output')} AS ai, {_idents(given)} AS gi, {_support('output')} AS aw, {_support(given)} AS gw FROM answers),
bad AS (SELECT *, list_sort(list_filter(an, lambda x: NOT list_contains(gn, x))) AS bn, list_sort(list_filter(ai, lambda x: NOT list_contains(gi, x))) AS bi, CASE WHEN len(aw) > 0 THEN len(list_filter(aw, lambda x: list_contains(gw, x))) / len(aw) ELSE 0 END AS share FROM parts),
checked AS (SELECT *, CASE WHEN refusal THEN 'refusal' WHEN len(bn) > 0 THEN 'number not in the material' WHEN len(bi) > 0 THEN 'identifier not in the material' WHEN len(aw) >= 6 AND share < 0.35 THEN 'almost nothing in common with the material' ELSE '' END AS reason FROM bad)"""


ORACLES["support_check"] = f"""WITH {ANSWERS}, {_checked("''")} SELECT conv_id, turn, reason IN ('', 'refusal') AS supported, reason, CASE WHEN refusal THEN '' ELSE array_to_string(bn, ',') END AS bad_numbers, CASE WHEN refusal THEN '' ELSE array_to_string(bi, ',') END AS bad_identifiers, CAST(CASE WHEN refusal THEN 1 ELSE round(share, 3) END AS DOUBLE) AS overlap FROM checked"""
ORACLES["gate_reasons"] = f"WITH {ANSWERS}, {_checked('prompt')} SELECT reason AS gate_reason, count(*) AS n FROM checked GROUP BY reason"
ORACLES["passages_from_prompt"] = "SELECT doc_id, chr(10) || chr(10) || text || chr(10) || 'Question: a?' || chr(10) || 'and more' || chr(10) AS passages FROM documents"
_terms = "list_distinct(list_filter(regexp_extract_all(lower(output), '\\d[\\d,]*\\.\\d+|\\d[\\d,]*|\\p{L}+'), lambda x: length(x) > 3))"
ORACLES["answer_present"] = f"WITH {ANSWERS}, t AS (SELECT *, {_terms} AS ts FROM answers) SELECT conv_id, turn, len(ts) = 0 OR len(list_filter(ts, lambda x: contains(lower(prompt), x))) >= 0.6 * len(ts) AS present FROM t"
ORACLES["response_lengths"] = f"""WITH l AS (SELECT len(list_filter(string_split({_norm('text')}, ' '), lambda x: x <> '')) AS n FROM conversations WHERE role = 'assistant'), o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS k, count(*) OVER () AS c FROM l)
SELECT max(c) AS pairs, CAST(min(n) AS INTEGER) AS shortest, CAST(max(n) FILTER (k = c // 2) AS INTEGER) AS median, CAST(max(n) AS INTEGER) AS longest, max(n) FILTER (k = c // 2) <= 8 AS warn_short, max(c) < 50 AS warn_few FROM o"""

# Pairs.

ORACLES["hard_distractors"] = f"""WITH {DOCS}, needed AS (SELECT DISTINCT id FROM docs WHERE compartment = 'src2'), homes AS (SELECT DISTINCT id, compartment FROM docs WHERE compartment IN (SELECT compartment FROM docs WHERE id IN (SELECT id FROM needed))),
pool AS (SELECT id, any_value(toks) AS toks FROM docs WHERE id IN (SELECT id FROM homes) GROUP BY id),
{_features('feats', 'id', 'pool')}, {PLAIN.format(rows='pool')}, {_unit('vecs', 'feats', 'id')},
near AS (SELECT DISTINCT x.id, y.id AS other FROM homes x JOIN homes y USING (compartment) WHERE x.id IN (SELECT id FROM needed) AND x.id <> y.id),
sims AS (SELECT near.id, near.other, round(sum(a.w * b.w), 6) AS similarity FROM near JOIN vecs a ON a.id = near.id JOIN vecs b ON b.id = near.other AND b.term = a.term GROUP BY ALL)
SELECT id, other, similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM sims) WHERE rank <= 5"""

# Planning and merging.

ORACLES["vram_estimate"] = f"""WITH r(model, four_bit, batch_size, max_len) AS (VALUES {fx.values(fx.RUNS)}), s AS (SELECT *, CAST(nullif(regexp_extract(string_split(model, '/')[-1], '(\\d+(?:\\.\\d+)?)\\s*[bB](?:[^a-zA-Z0-9]|$)', 1), '') AS DOUBLE) AS params_b FROM r),
n AS (SELECT *, round(params_b * CASE WHEN four_bit THEN 0.7 ELSE 2.2 END + greatest(0.6, params_b * 0.3) + 0.0004 * batch_size * max_len * sqrt(params_b), 6) AS need_gb FROM s)
SELECT model, four_bit, batch_size, max_len, params_b, need_gb, CASE WHEN need_gb IS NULL OR need_gb <= {fx.HARDWARE['vram'] * 0.85!r} THEN 'fits' WHEN need_gb <= {fx.HARDWARE['vram'] * 1.3!r} THEN 'tight' ELSE 'too big' END AS verdict FROM n"""
_hw = fx.HARDWARE
ORACLES["decode_speed_estimate"] = f"""WITH {CATALOGUE}, s AS (SELECT name, CAST(total_b AS DOUBLE) AS total_b, CAST(active_b AS DOUBLE) AS active_b, license, CAST(total_b AS DOUBLE) * {calc.QUANTS['Q4_K_M']} / 8 AS size, CAST(active_b AS DOUBLE) * {calc.QUANTS['Q4_K_M']} / 8 AS act FROM catalogue),
c AS (SELECT *, least(1.0, greatest(0.0, {_hw['ram'] * 0.7!r}) / size) AS cached FROM s),
w AS (SELECT *, CASE WHEN size < {_hw['vram'] * 0.85!r} THEN 'VRAM' WHEN size < {_hw['ram'] * 0.75!r} THEN 'RAM' ELSE CAST(CAST(round(cached * 100) AS INTEGER) AS VARCHAR) || '% cached' END AS place_,
  CASE WHEN size < {_hw['vram'] * 0.85!r} THEN {_hw['ram_gbs'] * 4} WHEN size < {_hw['ram'] * 0.75!r} THEN {_hw['ram_gbs']} ELSE cached * {_hw['ram_gbs']} + (1 - cached) * 2.5 END AS width FROM c),
u AS (SELECT *, round(width / act, 6) AS tok_s FROM w), v AS (SELECT *, size < {_hw['free_disk'] * 0.9!r} AND tok_s >= 3.0 AS usable FROM u)
SELECT name, total_b, active_b, license, round(size, 6) AS disk_gb, round(act, 6) AS active_gb, place_ AS "where", tok_s, round(total_b / active_b, 6) AS sparsity, usable, CAST(row_number() OVER (ORDER BY usable DESC, total_b DESC, name) AS INTEGER) AS place FROM v"""
ORACLES["epoch_verdicts"] = f"""WITH l(run, epoch, loss) AS (VALUES {fx.values(fx.LOSSES)}), w AS (SELECT run, epoch, CAST(loss AS DOUBLE) AS loss, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, first_value(loss) OVER (PARTITION BY run ORDER BY epoch) AS first FROM l)
SELECT run, epoch, loss, best IS NULL OR loss < best AS improved, NOT (best IS NULL OR loss < best) AND loss > first AS diverging FROM w"""
DELTAS = f"""d AS (SELECT 's' || CAST(vec_id % 3 AS VARCHAR) AS part, 'w' AS name, vec_id // 3 AS i, j - 1 AS j, round(CAST(embedding[j] AS DOUBLE), 4) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS j FROM embeddings)),
ws(part, w) AS (VALUES {fx.values(fx.WEIGHTS)})"""
ORACLES["merge_linear"] = f"WITH {DELTAS} SELECT name, i, CAST(j AS INTEGER) AS j, round(sum(CAST(w AS DOUBLE) * v), 6) AS v FROM d JOIN ws USING (part) GROUP BY ALL"
ORACLES["merge_ties"] = f"""WITH {DELTAS}, o AS (SELECT *, row_number() OVER (PARTITION BY part, name ORDER BY abs(v) DESC) AS n, greatest(1, CAST(floor(count(*) OVER (PARTITION BY part, name) * 0.2) AS BIGINT)) AS k FROM d),
t AS (SELECT part, name, min(abs(v)) AS least FROM o WHERE n <= k GROUP BY ALL),
x AS (SELECT name, i, j, v * CAST(w AS DOUBLE) AS x FROM d JOIN t USING (part, name) JOIN ws USING (part) WHERE abs(v) >= least),
s AS (SELECT *, sum(x) OVER (PARTITION BY name, i, j) AS s FROM x)
SELECT name, i, CAST(j AS INTEGER) AS j, round(coalesce(sum(x) FILTER (sign(x) = sign(s) AND x <> 0), 0) / greatest(count(*) FILTER (sign(x) = sign(s) AND x <> 0), 1), 9) AS v FROM s GROUP BY ALL"""
ORACLES["bundle_verify"] = f"""WITH {FILES}, was AS (SELECT path, sha256 FROM files WHERE path NOT LIKE '%5.txt'), now AS (SELECT path, CASE WHEN path LIKE '%9.txt' THEN sha256(text || '!') ELSE sha256 END AS s FROM files WHERE path NOT LIKE '%7.txt')
SELECT coalesce(was.path, now.path) AS path, CASE WHEN s IS NULL THEN 'missing' WHEN sha256 IS NULL THEN 'extra' ELSE 'changed' END AS problem FROM was FULL JOIN now ON was.path = now.path WHERE s IS NULL OR sha256 IS NULL OR s <> sha256"""
ORACLES["merge_dare"] = f"""WITH {DELTAS}, k AS (SELECT *, CAST('0x' || substr(md5(concat_ws(':', '0', part, name, CAST(i AS VARCHAR), CAST(j AS VARCHAR))), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM d)
SELECT name, i, CAST(j AS INTEGER) AS j, round(sum(CAST(w AS DOUBLE) * CASE WHEN u >= 0.9 THEN v / (1 - CAST(0.9 AS DOUBLE)) ELSE 0.0 END), 6) AS v FROM k JOIN ws USING (part) GROUP BY ALL"""
