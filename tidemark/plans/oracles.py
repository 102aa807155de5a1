"""The queries of queries.py in DuckDB's dialect, over views of the same Parquet files."""

from __future__ import annotations

from tidemark.functions.text import DEFAULT_OLLAMA_URL, ENCODINGS, LOOPBACK_HOSTS
from tidemark.operators.accounting import PRICES
from tidemark.operators.locality import BACKENDS, ELSEWHERE, FETCH, HOSTED, IN_PROCESS, LOCAL, ON_THIS_HOST, PULL
from tidemark.operators.projects import MISMATCH, NOTICE
from tidemark.plans.offline import PER_PROMPT, PER_REPLY, PER_TEXT
from tidemark.plans.queries import CHAT_MODELS, CONTEXT_TEXTS, DEFAULTS, EMBEDDING_MODELS, INSTRUCTION, LIBRARY, vocabulary_path
from tidemark.sources.providers import BASE_URLS

CORPUS = "c AS (SELECT e.vec_id AS id, d.text, d.source, CAST(e.embedding AS DOUBLE[]) AS v FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id)"
SEED = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS w FROM embeddings WHERE vec_id = 0)"


def score(a: str, b: str) -> str:
    """The rounded cosine; NULL where a vector is zero, which DuckDB calls NaN."""
    cosine = f"list_cosine_similarity({a}, {b})"
    return f"(CASE WHEN NOT isnan({cosine}) THEN round(greatest(-1.0, least(1.0, {cosine})), 6) END)"


def tokens(c: str) -> str:
    return rf"CAST(coalesce(len(regexp_extract_all({c}, '\p{{L}}+|\p{{N}}{{1,3}}|[^\s\p{{L}}\p{{N}}]+')), 0) AS BIGINT)"


def text(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def slug(c: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'project')"


def case(index: str, values: tuple) -> str:
    return f"CASE {index} " + " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values)) + " END"


PRICE_TABLE = "prices(model, input_price, output_price) AS (VALUES " + ", ".join(f"({text(m)}, CAST({i} AS DOUBLE), CAST({'NULL' if o is None else o} AS DOUBLE))" for m, (i, o) in PRICES.items()) + ")"
LEDGER = f"""ledger AS (SELECT {case("conv_id % 4", CHAT_MODELS)} AS model, CASE WHEN role = 'assistant' THEN 0 ELSE {tokens("text")} END AS input_tokens,
  CASE WHEN role = 'assistant' THEN {tokens("text")} ELSE 0 END AS output_tokens, conv_id % 4 <> 1 AS billable, conv_id % 7 <> 0 AS counted FROM conversations),
costs AS (SELECT l.*, input_tokens + output_tokens AS total_tokens, CASE WHEN NOT billable THEN 0.0::DOUBLE
  ELSE input_tokens / 1000000.0::DOUBLE * p.input_price + CASE WHEN output_tokens > 0 THEN output_tokens / 1000000.0::DOUBLE * p.output_price ELSE 0.0::DOUBLE END END AS cost FROM ledger l LEFT JOIN prices p USING (model))"""
TOTALS = f"""WITH {PRICE_TABLE}, {LEDGER}, totals AS (SELECT count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
  CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, round(coalesce(sum(cost), 0), 8) AS estimated_cost, count(*) FILTER (billable AND cost IS NULL) AS unpriced_calls, count(*) FILTER (NOT counted) AS uncounted_calls FROM costs)"""
MESSAGES = "m AS (SELECT conv_id * 1000 + turn AS id, CAST(conv_id AS VARCHAR) AS ref_id, CASE WHEN role = 'system' THEN 'system-init' ELSE 'chat-' || CAST(turn AS VARCHAR) END AS chat_id, role, text AS message FROM conversations)"
PROJECTS = f"""s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS position FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)),
p AS (SELECT position, md5(source) AS id, {slug("source")} AS slug, source AS name, {case("CASE WHEN position % 5 < 3 THEN 0 ELSE position % 3 END", EMBEDDING_MODELS)} AS embedding_model FROM s),
target AS (SELECT embedding_model FROM p GROUP BY 1 ORDER BY count(*) DESC, min(position) LIMIT 1),
chosen AS (SELECT *, embedding_model = (SELECT embedding_model FROM target) AS included FROM p)"""
HITS = f"{CORPUS}, {SEED}, hits AS (SELECT {slug('source')} AS project, id, {score('v', 'w')} AS score FROM c, q), {PROJECTS}"
MERGED = f"WITH {HITS} SELECT project, id, score FROM hits WHERE score IS NOT NULL AND project IN (SELECT slug FROM chosen WHERE included) ORDER BY score DESC, project, id"
BEST_BY_PROJECT = f"WITH {HITS}, best AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, id) AS r FROM hits WHERE score IS NOT NULL) SELECT project, id, score FROM best WHERE r <= 10 AND project IN (SELECT slug FROM chosen WHERE included) ORDER BY score DESC, project, id LIMIT 25"
TOP = f"WITH {CORPUS}, {SEED}, hits AS (SELECT id, text, {score('v', 'w')} AS score FROM c, q WHERE {score('v', 'w')} IS NOT NULL ORDER BY score DESC, id LIMIT %d)"
CONTEXT = "(SELECT string_agg(text, chr(10) ORDER BY score DESC, id) || chr(10) FROM hits)"
POINTS = "p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), fresh AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, id AS origin, v FROM p WHERE label = 3)"
URL_TABLE = """u AS (SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'http://localhost:11434' || regexp_replace(url, '^[a-z]*://[^/]*', '') WHEN page_id % 6 = 1 THEN '127.0.0.1:' || CAST(page_id AS VARCHAR)
  WHEN page_id % 6 = 2 THEN 'http://[::1]/' || CAST(page_id AS VARCHAR) || '//' WHEN page_id % 6 = 3 THEN upper(url) WHEN page_id % 30 = 4 THEN '' ELSE url END AS url FROM pages)"""
PROVIDER = case("conv_id % 4", ("openai", "ollama", "openai", "gemini"))


def host(c: str) -> str:
    bare = f"regexp_replace(regexp_replace(regexp_replace({c}, '^[^/]*//', ''), '[/?#].*$', ''), '^.*@', '')"
    return rf"lower(CASE WHEN starts_with({bare}, '[') THEN regexp_extract({bare}, '^\[([^\]]*)\]', 1) ELSE regexp_replace({bare}, ':.*$', '') END)"


def loopback(c: str) -> str:
    return f"{host(c)} IN ({', '.join(map(text, LOOPBACK_HOSTS))})"


def walk(threshold: float, initial: bool, depth: int = 50) -> str:
    said = "f" if initial else "score"
    return f"""
WITH RECURSIVE {CORPUS}, {SEED}, f AS (SELECT id, {score("v", "w")} AS f FROM c, q WHERE {score("v", "w")} IS NOT NULL),
s AS (SELECT a.id AS src, b.id AS dst, b.text, {score("a.v", "b.v")} AS score FROM c a, c b WHERE {score("a.v", "b.v")} IS NOT NULL),
n AS (SELECT * FROM (SELECT s.*, f.f, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rnk FROM s JOIN f ON f.id = s.dst) WHERE rnk <= 5),
r AS (SELECT c.id, c.text, f.f FROM c JOIN f USING (id) ORDER BY f.f DESC, c.id LIMIT 1),
walk(step, cur, seen, document, score) AS (
  SELECT 1, id, [text], text, f FROM r WHERE f >= {threshold}
  UNION ALL
  SELECT w.step + 1, arg_min(n.dst, n.rnk), list_append(any_value(w.seen), arg_min(n.text, n.rnk)), arg_min(n.text, n.rnk), arg_min(n.{said}, n.rnk)
  FROM walk w JOIN n ON n.src = w.cur AND n.rnk >= 2 AND NOT list_contains(w.seen, n.text) JOIN n h ON h.src = w.cur AND h.rnk = 2 AND h.{said} >= {threshold}
  WHERE w.step < {depth} GROUP BY w.step HAVING arg_min(n.{said}, n.rnk) >= {threshold}
)
SELECT step, document, score FROM walk"""


def walks(threshold: float, depth: int = 50) -> str:
    """similarity_walk from every twentieth row at once."""
    return f"""
WITH RECURSIVE {CORPUS}, s AS (SELECT a.id AS src, b.id AS dst, b.text, {score("a.v", "b.v")} AS score FROM c a, c b WHERE {score("a.v", "b.v")} IS NOT NULL),
n AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rnk FROM s) WHERE rnk <= 5),
walk(walk, step, cur, seen, document, score) AS (
  SELECT src, 1, dst, [text], text, score FROM n WHERE rnk = 1 AND src % 20 = 0 AND score >= {threshold}
  UNION ALL
  SELECT w.walk, w.step + 1, arg_min(n.dst, n.rnk), list_append(any_value(w.seen), arg_min(n.text, n.rnk)), arg_min(n.text, n.rnk), arg_min(n.score, n.rnk)
  FROM walk w JOIN n ON n.src = w.cur AND n.rnk >= 2 AND NOT list_contains(w.seen, n.text) JOIN n h ON h.src = w.cur AND h.rnk = 2 AND h.score >= {threshold}
  WHERE w.step < {depth} GROUP BY w.walk, w.step HAVING arg_min(n.score, n.rnk) >= {threshold}
)
SELECT walk, step, document, score FROM walk"""


#: White space as Unicode has it, and the pieces of a stretch of text within which white space is never parted.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
PIECE = rf"''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+"


def exact(select: str) -> str:
    """Exact counts: each different piece merged by a recursive query over the rank file, its bytes as hex."""
    # The last white space before anything else begins a stretch of its own.
    parted = rf"unnest(string_split(regexp_replace(text, '([{SPACE}])([{SPACE}])([^{SPACE}])', '\1' || chr(57344) || '\2\3', 'g'), chr(57344)))"
    return rf"""
WITH RECURSIVE ranks AS (
  SELECT hex(from_base64(token)) AS token, rank FROM read_csv('{vocabulary_path()}', delim = ' ', header = false, quote = '', escape = '', auto_detect = false, columns = {{'token': 'VARCHAR', 'rank': 'INTEGER'}})
), stretches AS (
  SELECT doc_id, {parted} AS stretch FROM documents
), pieces AS (
  SELECT doc_id, piece, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(stretch, '{PIECE}')) AS piece FROM stretches) GROUP BY ALL
), merging(piece, parts, step) AS (
  SELECT piece, list_transform(range(strlen(piece)), lambda i: substr(hex(encode(piece)), CAST(2 * i + 1 AS INTEGER), 2)), 0 FROM (SELECT DISTINCT piece FROM pieces)
  UNION ALL
  SELECT piece, parts[: best - 1] || [parts[best] || parts[best + 1]] || parts[best + 2 :], step + 1 FROM (
    SELECT p.piece, any_value(p.parts) AS parts, p.step, arg_min(p.i, r.rank * 1000000::BIGINT + p.i) AS best
    FROM (SELECT piece, parts, step, unnest(range(1, len(parts))) AS i FROM merging) p JOIN ranks r ON r.token = p.parts[p.i] || p.parts[p.i + 1] GROUP BY p.piece, p.step
  )
), lengths AS (
  SELECT piece, CAST(min(len(parts)) AS BIGINT) AS tokens FROM merging GROUP BY piece
), counts AS (
  SELECT d.doc_id, CAST(coalesce(sum(n * l.tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(n), 0) AS BIGINT) AS pieces FROM documents d LEFT JOIN pieces USING (doc_id) LEFT JOIN lengths l USING (piece) GROUP BY d.doc_id
), totals AS (
  SELECT count(*) AS documents, CAST(sum(pieces) AS BIGINT) AS pieces, (SELECT count(*) FROM lengths) AS different_pieces, CAST(sum(tokens) AS BIGINT) AS tokens FROM counts
) {select}"""


def resolved(field: str) -> str:
    default = f"nullif({text(DEFAULTS[field])}, '')" if DEFAULTS.get(field) else "NULL"
    return f"coalesce(nullif({field}, ''), {default}, {text(LIBRARY[field])}) AS {field}"


def audit() -> str:
    spec = "b(role, provider, local, served, default_model) AS (VALUES " + ", ".join(f"({text(r)}, {text(b[0])}, {b[3]}, {b[4]}, {text(b[5])})" for r, bs in BACKENDS.items() for b in bs) + ")"
    named = f"{case('page_id % 5', ('openai', 'gemini', 'voyage', 'ollama', 'sentence-transformers'))} AS ep, {case('page_id % 4', ('openai', 'gemini', 'ollama', 'anthropic'))} AS gp"
    return f"""
WITH {spec}, {URL_TABLE}, pairs AS (SELECT CAST(page_id AS VARCHAR) AS config, {named}, page_id % 7 AS i, coalesce(nullif(url, ''), '{DEFAULT_OLLAMA_URL}') AS url FROM u),
roles AS (SELECT config, 'embedding' AS role, ep AS provider, CASE WHEN i = 1 THEN 'models/bge' END AS model, url FROM pairs
  UNION ALL SELECT config, 'generation', gp, CASE WHEN i = 2 THEN 'llama3' END, url FROM pairs),
judged AS (SELECT r.*, b.local AND (NOT b.served OR {loopback("url")}) AS is_local,
  CASE WHEN NOT b.local THEN {text(HOSTED)} WHEN NOT b.served THEN {text(IN_PROCESS)} WHEN {loopback("url")} THEN {text(ON_THIS_HOST)} ELSE {text(ELSEWHERE)} || url END AS reason,
  CASE WHEN NOT b.local THEN NULL WHEN b.served THEN {text(PULL)} || coalesce(model, b.default_model, 'its model')
    WHEN coalesce(contains(model, '/'), false) THEN NULL ELSE {text(FETCH)} || coalesce(model, b.default_model, 'its model') END AS setup
  FROM roles r JOIN b USING (role, provider))
SELECT config, bool_and(is_local) AS is_local,
  CASE WHEN bool_and(is_local) THEN {text(LOCAL)} ELSE 'content leaves: ' || string_agg(role || ' (' || provider || ') ' || reason, '; ' ORDER BY role) FILTER (NOT is_local) END AS summary,
  coalesce(string_agg(setup, '; ' ORDER BY role) FILTER (setup IS NOT NULL), '') AS setup
FROM judged GROUP BY config"""


def connected() -> str:
    def url(provider: str, served: bool) -> str:
        return text("http://box:1/v1" if served else BASE_URLS.get(provider))

    rows = ", ".join(f"({text(role)}, {text(b[0])}, {url(b[0], b[4])}, {b[2] is None}, {text(b[5])})" for role, known in BACKENDS.items() for b in known)
    return f"""WITH known(role, provider, base_url, keyless, model) AS (VALUES {rows}), used AS (SELECT {PROVIDER} AS provider, count(*) AS calls FROM conversations GROUP BY 1)
SELECT known.*, CASE WHEN role = 'generation' THEN coalesce(calls, 0) END AS calls FROM known LEFT JOIN used USING (provider)"""


def oracle_sql() -> dict[str, str]:
    encodings = "CASE " + " ".join(f"WHEN starts_with(model, {text(p)}) THEN {text(e)}" for p, e in sorted(ENCODINGS.items(), key=lambda x: -len(x[0]))) + " ELSE 'o200k_base' END"
    asked = f"{PROJECTS}, asked AS (SELECT {case('conv_id % 4', CHAT_MODELS)} AS model FROM conversations UNION SELECT embedding_model FROM p)"
    norm = "round(sqrt(list_dot_product(v, v)), 6)"
    return {
        "cosine_topk": TOP % 10 + " SELECT id, text, score FROM hits",
        "relatedness_scores": f"WITH {SEED} SELECT vec_id, {score('CAST(embedding AS DOUBLE[])', 'w')} AS relatedness FROM embeddings, q",
        "topk_threshold": f"WITH {CORPUS}, {SEED} SELECT id, {score('v', 'w')} AS score FROM c, q WHERE {score('v', 'w')} >= 0.2",
        "embedding_frame": f"WITH e AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT CAST(len(v) AS BIGINT) AS width, {norm} AS norm FROM e",
        "csv_embedding_parse": "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS width, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings",
        "collection_upsert": f"WITH {POINTS} SELECT id, origin, {norm} AS norm FROM fresh UNION ALL SELECT id, id AS origin, {norm} AS norm FROM p WHERE id NOT IN (SELECT id FROM fresh)",
        "collection_append": f"WITH {POINTS} SELECT id, id AS origin FROM p UNION ALL SELECT row_number() OVER (ORDER BY id) - 1 + (SELECT count(*) FROM p) AS id, id AS origin FROM p",
        "collection_count": "SELECT count(*) AS points FROM embeddings",
        "collection_info": "SELECT CAST(label AS VARCHAR) AS collection, 'main' AS vector_name, CAST(max(len(embedding)) AS BIGINT) AS size, 'Cosine' AS distance, count(*) AS points FROM embeddings GROUP BY label",
        "collection_search": f"WITH {POINTS}, {SEED} SELECT id, {score('v', 'w')} AS score FROM p, q WHERE label = 3 AND {score('v', 'w')} IS NOT NULL ORDER BY score DESC, id LIMIT 10",
        "batch_knn": f"WITH {CORPUS}, s AS (SELECT a.id AS src, b.id AS dst, {score('a.v', 'b.v')} AS score FROM c a, c b WHERE {score('a.v', 'b.v')} IS NOT NULL), n AS (SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS INTEGER) AS rnk, dst, score FROM s) SELECT * FROM n WHERE rnk <= 5",
        "similarity_walk": walk(0.25, False),
        "similarity_walk_initial": walk(0.0, True),
        "similarity_walk_threshold": walk(0.33, False),
        "similarity_walks": walks(0.25),
        "token_counts": f"SELECT doc_id, {tokens('text')} AS tokens FROM documents",
        "corpus_tokens": f"SELECT count(*) AS documents, CAST(sum({tokens('text')}) AS BIGINT) AS tokens FROM documents",
        "embedding_cost": f"WITH {PRICE_TABLE}, t AS (SELECT CAST(sum({tokens('text')}) AS BIGINT) AS tokens FROM documents) SELECT model, tokens, round(tokens / 1000000.0::DOUBLE * input_price, 10) AS cost FROM t, prices WHERE output_price IS NULL",
        "prompt_cost": f"WITH {PRICE_TABLE}, t AS (SELECT conv_id, turn, {case('conv_id % 4', CHAT_MODELS)} AS model, {tokens('text')} AS tokens FROM conversations WHERE role = 'user') SELECT conv_id, turn, model, tokens, round(tokens / 1000000.0::DOUBLE * input_price, 10) AS cost FROM t LEFT JOIN prices USING (model)",
        "price_lookup": f"WITH {PRICE_TABLE}, {asked} SELECT model, input_price, output_price, {encodings} AS encoding FROM asked LEFT JOIN prices USING (model)",
        "priced_models": f"WITH {PRICE_TABLE}, {asked} SELECT model FROM prices WHERE model IN (SELECT model FROM asked)",
        "exact_token_counts": exact("SELECT doc_id, tokens FROM counts"),
        "exact_corpus_tokens": exact("SELECT * FROM totals"),
        "exact_embedding_cost": exact(f", {PRICE_TABLE} SELECT model, tokens, round(tokens / 1000000.0::DOUBLE * input_price, 10) AS cost FROM totals, prices WHERE output_price IS NULL"),
        "embed_batches": f"WITH t AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, {tokens('text')} AS tokens FROM documents) SELECT CAST(position // 100 AS BIGINT) AS batch, count(*) AS n_texts, CAST(sum(tokens) AS BIGINT) AS tokens FROM t GROUP BY 1",
        "usage_totals": f"{TOTALS} SELECT * FROM totals",
        "usage_by_model": f"WITH {PRICE_TABLE}, {LEDGER} SELECT model, CAST(sum(total_tokens) AS BIGINT) AS total_tokens FROM costs GROUP BY model",
        "usage_record_costs": f"WITH {PRICE_TABLE}, {LEDGER} SELECT model, billable, cost IS NULL AS unpriced, count(*) AS calls, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(cost), 8) AS cost FROM costs GROUP BY ALL",
        "usage_unpriced": f"{TOTALS} SELECT unpriced_calls FROM totals",
        "usage_uncounted": f"{TOTALS} SELECT uncounted_calls FROM totals",
        "usage_summary": f"""{TOTALS} SELECT CASE WHEN calls = 0 THEN 'no provider calls' ELSE concat_ws(', ', CAST(calls AS VARCHAR) || CASE WHEN calls = 1 THEN ' call' ELSE ' calls' END, format('{{:,}} tokens', total_tokens),
  printf('~$%.4f', estimated_cost) || CASE WHEN unpriced_calls > 0 THEN printf(' (%d unpriced)', unpriced_calls) ELSE '' END, CASE WHEN uncounted_calls > 0 THEN printf('%d not counted', uncounted_calls) END) END AS summary FROM totals""",
        "conversation_messages": f"WITH {MESSAGES} SELECT ref_id, string_agg(role || ': ' || message, chr(10) ORDER BY id) AS transcript FROM m GROUP BY ref_id",
        "conversation_index": "SELECT '0' AS id, '2023-11-14 00:00:00' AS created_at UNION ALL SELECT CAST(conv_id AS VARCHAR), strftime(make_timestamp(CAST((conv_id * 60 + 1700000000) * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id <> 0)",
        "conversation_resume": f"WITH {MESSAGES} SELECT ref_id, string_agg(role || ': ' || message, chr(10) ORDER BY id) AS transcript FROM m WHERE ref_id = '1' GROUP BY ref_id",
        "conversation_append": f"WITH {MESSAGES} SELECT id, ref_id, chat_id, role FROM m UNION ALL SELECT (SELECT max(id) FROM m) + row_number() OVER (ORDER BY id), ref_id, 'again-' || CAST(id AS VARCHAR), role FROM m WHERE role = 'user'",
        "conversation_orphans": f"WITH {MESSAGES} SELECT id, ref_id, role FROM m WHERE CAST(ref_id AS INTEGER) % 3 = 0",
        "distinct_refs": f"WITH {MESSAGES} SELECT DISTINCT ref_id FROM m",
        "context_concat": f"WITH r AS (SELECT source, doc_id, text AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) SELECT source, CAST(k // {CONTEXT_TEXTS} AS BIGINT) AS part, string_agg(t, ' ' ORDER BY doc_id) AS context FROM r WHERE k < n // 5 GROUP BY ALL",
        "retrieved_context": TOP % 5 + f" SELECT {CONTEXT} AS context",
        "prompt_assembly": TOP % 5 + f", made AS (SELECT {text(INSTRUCTION)} || ': ' || {CONTEXT} AS prompt) SELECT prompt, {tokens('prompt')} AS tokens FROM made",
        "nonnull_text": "SELECT doc_id, source FROM documents WHERE text IS NOT NULL",
        "slugify": f"SELECT doc_id, {slug('text')} AS slug FROM documents",
        "settings_resolution": f"WITH {PROJECTS}, x AS (SELECT slug, CASE WHEN position % 2 = 0 THEN embedding_model ELSE '' END AS embedding_model, CASE WHEN position % 3 = 0 THEN 'gpt-4o' END AS generation_model, CASE WHEN position % 4 = 0 THEN 'sqlite' ELSE '' END AS storage_backend FROM p) SELECT slug, {', '.join(map(resolved, LIBRARY))} FROM x",
        "model_majority": f"WITH {PROJECTS} SELECT embedding_model FROM target",
        "project_exclusions": f"WITH {PROJECTS} SELECT slug, {text(MISMATCH)} AS reason, embedding_model AS detail FROM chosen WHERE NOT included",
        "selection_notice": f"WITH {PROJECTS} SELECT CASE WHEN count(*) FILTER (NOT included) = 0 THEN '' ELSE printf({text(NOTICE)}, count(*) FILTER (NOT included), count(*), string_agg(slug || ' (' || embedding_model || ')', ', ' ORDER BY position) FILTER (NOT included)) END AS notice FROM chosen",
        "cross_project_merge": MERGED,
        "cross_project_query": BEST_BY_PROJECT,
        "cross_project_top_k": BEST_BY_PROJECT,
        "payload_join": "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS id, CAST(label AS VARCHAR) AS label, CAST(len(embedding) AS BIGINT) AS width FROM embeddings",
        "unique_ids": "SELECT doc_id, 32 AS digits, true AS hex FROM documents",
        "random_sample": "SELECT least(count(*), 50) AS n, least(count(DISTINCT doc_id), 50) AS different, least(count(*), 50) AS known FROM documents WHERE text IS NOT NULL",
        "reply_blocks": "SELECT conv_id, turn, coalesce(text, '') || '.' AS reply FROM conversations",
        "model_list": f"WITH m AS (SELECT DISTINCT {PROVIDER} AS provider, {case('conv_id % 4', CHAT_MODELS)} AS model FROM conversations) SELECT provider, row_number() OVER (PARTITION BY provider ORDER BY model) - 1 AS place, model FROM m",
        "connections": connected(),
        "text_load": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS position, text FROM documents",
        "collection_store": f"""WITH {POINTS}, more AS (SELECT row_number() OVER (ORDER BY id) - 1 + (SELECT count(*) FROM p) AS id, v FROM p WHERE label = 4),
  held AS (SELECT id, v FROM fresh UNION ALL SELECT id, v FROM p WHERE id NOT IN (SELECT id FROM fresh) UNION ALL SELECT id, v FROM more)
  SELECT id, {norm} AS norm, (SELECT CAST(max(len(v)) AS BIGINT) FROM p) AS size, (SELECT count(*) FROM held) AS points, 'kept' AS collections FROM held""",
        "collection_indexed_search": f"WITH {POINTS}, {SEED} SELECT id, {score('v', 'w')} AS score, CAST(label AS VARCHAR) AS label FROM p, q WHERE {score('v', 'w')} IS NOT NULL ORDER BY score DESC, id LIMIT 10",
        "collection_named_search": f"""WITH {POINTS}, {SEED}, fused AS (SELECT id, round(0.75::DOUBLE * list_cosine_similarity(v, w) + 0.25::DOUBLE * list_cosine_similarity(list_reverse(v), w), 6) AS score FROM p, q)
  SELECT id, score FROM fused WHERE NOT isnan(score) ORDER BY score DESC, id LIMIT 10""",
        "conversation_store": f"WITH {MESSAGES} SELECT row_number() OVER (ORDER BY CAST(ref_id AS BIGINT) % 2, id) AS id, ref_id, role, message, strftime(make_timestamp(CAST(ref_id AS BIGINT) * 60000000), '%Y-%m-%d %H:%M:%S') AS created_at, chat_id = 'system-init' AS is_setup FROM m",
        "conversation_parts": f"WITH {MESSAGES}, r AS (SELECT *, (row_number() OVER (PARTITION BY ref_id ORDER BY id) - 1) // 3 AS part FROM m) SELECT ref_id, CAST(part AS BIGINT) AS part, min(id) AS first_id, string_agg(role || ': ' || message, chr(10) ORDER BY id) AS transcript FROM r GROUP BY ref_id, part",
        "literal_quarantine": """WITH r AS (SELECT vec_id, len(embedding) AS width, vec_id % 7 = 0 AS cut, vec_id % 11 = 0 AS led, vec_id % 13 = 0 AS holed, vec_id % 17 = 0 AS none FROM embeddings)
  SELECT vec_id, NOT (cut OR led OR holed) AS good, CASE WHEN NOT (cut OR led OR holed OR none) THEN CAST(width AS BIGINT) ELSE NULL END AS width, CASE WHEN cut THEN '[' WHEN led THEN 'x' WHEN holed THEN '[' END AS begins, (SELECT count(*) FROM r WHERE cut OR led OR holed) AS malformed FROM r""",
        "weighted_sample": "WITH r AS (SELECT source, doc_id, -ln((CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':7'), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE) / length(text)::DOUBLE AS p FROM documents WHERE length(text) > 0), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY p) AS r FROM r) SELECT source, doc_id FROM k WHERE r <= 20",
        "embedding_cache": "SELECT doc_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS characters, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) AS DOUBLE) AS blanks FROM documents",
        "embedding_cache_usage": f"WITH n AS (SELECT count(DISTINCT coalesce(text, '')) AS n FROM documents) SELECT 1 AS run, CAST(ceil(n / 100.0) AS BIGINT) AS calls, CAST({PER_TEXT} * n AS BIGINT) AS input_tokens FROM n UNION ALL SELECT 2, 0::BIGINT, 0::BIGINT",
        "usage_stream": f"""WITH {PRICE_TABLE}, {LEDGER.replace("AS counted FROM", "AS counted, conv_id, turn FROM")} SELECT strftime(make_timestamp(CAST((conv_id * 60 + turn + 1700000000) // 3600 * 3600000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS hour, model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS output_tokens, round(coalesce(sum(cost), 0), 8) AS estimated_cost, count(*) FILTER (billable AND cost IS NULL) AS unpriced_calls, count(*) FILTER (NOT counted) AS uncounted_calls FROM costs GROUP BY 1, 2""",
        "conversation_ids": "SELECT DISTINCT CAST(conv_id AS VARCHAR) AS id FROM conversations",
        "provider_embeddings": "SELECT doc_id, CAST(length(coalesce(text, '')) AS DOUBLE) AS characters, CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), ' ', '')) AS DOUBLE) AS blanks FROM documents",
        "provider_usage": f"WITH {PRICE_TABLE}, n AS (SELECT count(*) AS n FROM documents) SELECT CAST(ceil(n / 100.0) AS BIGINT) AS calls, CAST({PER_TEXT} * n AS BIGINT) AS input_tokens, 0::BIGINT AS output_tokens, CAST({PER_TEXT} * n AS BIGINT) AS total_tokens, round({PER_TEXT} * n / 1000000.0::DOUBLE * input_price, 8) AS estimated_cost, 0::BIGINT AS unpriced_calls, 0::BIGINT AS uncounted_calls FROM n, prices WHERE model = 'text-embedding-3-small'",
        "provider_replies": "SELECT conv_id, turn, CAST(length(coalesce(text, '')) AS VARCHAR) || ' characters' AS reply FROM conversations WHERE role = 'user'",
        "provider_replies_usage": f"SELECT count(*) AS calls, CAST({PER_PROMPT} * count(*) AS BIGINT) AS input_tokens, CAST({PER_REPLY} * count(*) AS BIGINT) AS output_tokens, CAST({PER_PROMPT + PER_REPLY} * count(*) AS BIGINT) AS total_tokens, 0.0::DOUBLE AS estimated_cost, 0::BIGINT AS unpriced_calls, 0::BIGINT AS uncounted_calls FROM conversations WHERE role = 'user'",
        "completion_fields": "SELECT conv_id, turn, 'chatcmpl-' || CAST(conv_id AS VARCHAR) AS id, role, coalesce(text, '') AS message, CAST(CASE WHEN turn % 2 = 0 THEN 11 ELSE 0 END AS BIGINT) AS input_tokens, CAST(CASE WHEN turn % 2 = 0 THEN turn ELSE 0 END AS BIGINT) AS output_tokens FROM conversations",
        "cross_project_limit": f"{MERGED} LIMIT 25",
        "registry_register": f"WITH {PROJECTS} SELECT id, slug, CASE WHEN position % 4 = 0 THEN 'changed' ELSE embedding_model END AS embedding_model FROM p",
        "registry_find": f"WITH {PROJECTS} SELECT id, slug, embedding_model FROM p WHERE id = 'src3' OR slug = 'src3' ORDER BY position LIMIT 1",
        "registry_unregister": f"WITH {PROJECTS} SELECT id, slug FROM p WHERE NOT (id = 'src3' OR slug = 'src3')",
        "locality_audit": audit(),
        "loopback_hosts": f"WITH {URL_TABLE} SELECT page_id, {loopback('url')} AS is_loopback FROM u",
        "base_url": f"WITH {URL_TABLE} SELECT page_id, regexp_replace(coalesce(nullif(url, ''), '{DEFAULT_OLLAMA_URL}'), '/+$', '') || '/v1' AS base_url FROM u",
    }
