"""The same queries as SQL for DuckDB, stated independently of the operators.

Windows over whole tables and cross products are fine here: this SQL is the
definition the Spark plans are checked against, on a small scale.
"""

from __future__ import annotations

from signpost.queries import (
    _COMPARED,
    _RATES,
    _TRACKED_EVENTS,
    BATCH,
    CLASSES,
    DENSE_SAMPLES,
    DENSE_THRESHOLDS,
    LANG_MODELS,
    MESSAGES,
    OVERRIDES,
    SAMPLES,
    SOURCE_MODELS,
    THRESHOLD,
)

DIMS = 256
# Fixed values, stated here again and not taken from the operators: prices per 1000 tokens (others
# cost the default), the two forms of a reply, and the metrics that are not performance.
PRICES = {
    "text-embedding-3-small": 0.00002,
    "text-embedding-3-large": 0.00013,
    "text-embedding-ada-002": 0.0001,
    "sentence-transformers/all-MiniLM-L6-v2": 0.0,
    "sentence-transformers/all-mpnet-base-v2": 0.0,
}
DEFAULT_PRICE = 0.00002
REPLY_OBJECT = r'\{"article_id":\s*\d+,\s*"category":\s*"[^"]+"\}'
REPLY_LIST = r'(?s)(\{.*"classifications".*\})'
_CATEGORY_RULE = """CASE WHEN metric LIKE '%\\_macro' ESCAPE '\\' OR metric LIKE '%\\_weighted' ESCAPE '\\'
    OR metric LIKE 'classification\\_report%' ESCAPE '\\' THEN 'classification_metrics'
  WHEN contains(metric, 'latency') THEN 'latency_metrics'
  WHEN contains(metric, 'cost') OR contains(metric, 'tokens') THEN 'cost_metrics'
  ELSE 'performance_metrics' END"""
# white space as a class of DuckDB's expression engine
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
FIRST = CLASSES[0]
CLASS_LIST = ", ".join(f"'{c}'" for c in CLASSES)
SQL: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _words(text: str) -> str:
    outside = "[^" + WS[1:-1] + "]"
    return f"len(regexp_extract_all({text}, '{outside}+'))"


def _tokens(text: str) -> str:
    return f"(13 * {_words(text)} // 10)"


def _cut(text: str, n: int) -> str:
    return f"CASE WHEN length({text}) > {n} THEN substring({text}, 1, {n}) || '...' ELSE {text} END"


def _reference(text: str) -> str:
    return f"trim(regexp_replace({_cut(text, 500)}, '{WS}+', ' ', 'g'))"


def _order(key: str) -> str:
    return f"md5('42:' || CAST({key} AS VARCHAR)), {key}"


def _vector(name: str, source: str, keys: str, text: str) -> str:
    """CTE (keys, dim, v): unit vectors of hashed words."""
    return f"""
{name}_w AS (SELECT {keys}, unnest(string_split_regex(lower({text}), '{WS}+')) w FROM {source}),
{name}_n AS (SELECT {keys}, CAST(('0x' || substr(md5(w), 1, 6)) AS INTEGER) % {DIMS} AS dim,
  CAST(count(*) AS DOUBLE) n FROM {name}_w WHERE w <> '' GROUP BY ALL),
{name} AS (SELECT {keys}, dim, n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) v FROM {name}_n)"""


def _sample(source: str = "documents") -> str:
    return f"""
sample AS (SELECT doc_id, lower(lang) lang,
  row_number() OVER (PARTITION BY lower(lang) ORDER BY {_order("doc_id")}) AS rank
  FROM {source} QUALIFY rank <= {SAMPLES}),
refs AS (SELECT s.lang route, s.doc_id ref_id, {_reference("d.text")} ref_text
  FROM sample s JOIN documents d USING (doc_id))"""


def _centroids(source: str = "documents") -> str:
    return f"""{_sample(source)},{_vector("rvec", "refs", "route, ref_id", "ref_text")},
sizes AS (SELECT route, count(*) n FROM refs GROUP BY route),
cent AS (SELECT route, dim, sum(v) / any_value(n) v FROM rvec JOIN sizes USING (route)
  GROUP BY route, dim)"""


def _avg_distances(source: str = "documents", articles: str = "documents") -> str:
    return f"""{_centroids(source)},{_vector("qvec", articles, "doc_id", "text")},
dist AS (SELECT a.doc_id, s.route, round(1 - coalesce(sum(q.v * c.v), 0), 9) distance
  FROM {articles} a CROSS JOIN sizes s LEFT JOIN qvec q ON q.doc_id = a.doc_id
  LEFT JOIN cent c ON c.route = s.route AND c.dim = q.dim GROUP BY a.doc_id, s.route)"""


def _min_distances() -> str:
    return f"""{_sample()},{_vector("rvec", "refs", "route, ref_id", "ref_text")},
{_vector("qvec", "documents", "doc_id", "text")},
pairs AS (SELECT q.doc_id, r.route, r.ref_id, sum(q.v * r.v) dot
  FROM qvec q JOIN rvec r USING (dim) GROUP BY ALL),
dist AS (SELECT a.doc_id, s.route, round(1 - coalesce(max(p.dot), 0), 9) distance
  FROM documents a CROSS JOIN (SELECT DISTINCT route FROM refs) s
  LEFT JOIN pairs p ON p.doc_id = a.doc_id AND p.route = s.route GROUP BY a.doc_id, s.route)"""


def _routed(agg: str = "avg", threshold: str = str(THRESHOLD)) -> str:
    return f"""{_avg_distances() if agg == "avg" else _min_distances()},
best AS (SELECT doc_id, route, distance FROM dist WHERE distance <= {threshold}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, route) = 1),
routed AS (SELECT d.doc_id, d.lang, d.text, coalesce(b.route, '{FIRST}') prediction, b.distance,
  CASE WHEN b.route IS NULL THEN 0.1 ELSE greatest(0, 1 - b.distance) END confidence,
  b.route IS NULL is_fallback FROM documents d LEFT JOIN best b USING (doc_id))"""


def _report(source: str = "routed", label: str = "lang") -> str:
    return f"""
classes AS (SELECT lower({label}) c FROM {source} UNION SELECT lower(prediction) FROM {source}),
counts AS (SELECT c AS class,
  (SELECT count(*) FROM {source} WHERE lower({label}) = c) support,
  (SELECT count(*) FROM {source} WHERE lower(prediction) = c) predicted,
  (SELECT count(*) FROM {source} WHERE lower({label}) = c AND lower(prediction) = c) tp
  FROM classes),
pr AS (SELECT class, support,
  CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END p,
  CASE WHEN support = 0 THEN 0 ELSE tp / support END r FROM counts),
report AS (SELECT class, p AS precision, r AS recall,
  CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END f1, support FROM pr)"""


# -- article preparation ---------------------------------------------------------

SQL["labeled_articles"] = f"""
SELECT d.doc_id AS article_id, regexp_replace(d.text, '^{WS}+|{WS}+$', '', 'g') AS text,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS label
FROM documents d LEFT JOIN labels l USING (doc_id)"""

_UNIQUE = "SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"
SQL["dedupe_text"] = f"SELECT doc_id, lang, source, n_chars FROM ({_UNIQUE})"

_SPLIT = f"""
uniq AS ({_UNIQUE}),
split AS (SELECT doc_id, lang, text, CASE WHEN
  row_number() OVER (PARTITION BY lang ORDER BY {_order("doc_id")})
  <= ceil(0.25 * count(*) OVER (PARTITION BY lang)) THEN 'validation' ELSE 'train' END split
  FROM uniq)"""
SQL["stratified_split"] = f"WITH {_SPLIT} SELECT doc_id, lang, split FROM split"

SQL["sample_per_class"] = f"WITH {_sample()} SELECT doc_id, lang, rank FROM sample"

_BATCHES = f"""
batches AS (SELECT doc_id, idx, idx // {BATCH} batch_id,
  substr(md5('batch:' || CAST(idx // {BATCH} AS VARCHAR)), 1, 8) request_id
  FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 idx FROM documents))"""
SQL["fixed_batches"] = f"WITH {_BATCHES} SELECT doc_id, idx, batch_id, request_id FROM batches"

SQL["reference_text"] = f"SELECT doc_id, {_reference('text')} AS reference_text FROM documents"

SQL["token_estimate"] = (
    f"SELECT doc_id, {_words('text')} AS words, {_tokens('text')} AS tokens FROM documents"
)

# -- embedding, routes, routing --------------------------------------------------

SQL["embed_hashed"] = f"""
WITH {_vector("qvec", "documents", "doc_id", "text")}
SELECT doc_id, CAST(dim AS BIGINT) AS dim, round(v, 9) AS v FROM qvec"""

SQL["route_centroids"] = f"""
WITH {_centroids()} SELECT route, CAST(dim AS BIGINT) AS dim, round(v, 9) AS v FROM cent"""

_SUMMARY = f"""{_sample()},
summary AS (SELECT route, total, references_count
  FROM (SELECT lower(lang) route, count(*) total FROM documents GROUP BY ALL)
  JOIN (SELECT route, count(*) references_count FROM refs GROUP BY ALL) USING (route))"""
SQL["route_summary"] = f"""
WITH {_SUMMARY} SELECT route, total, references_count, CAST({THRESHOLD} AS DOUBLE) AS threshold,
  CAST(references_count AS VARCHAR) AS samples_count FROM summary"""

_OVERRIDES = ", ".join(f"('{k}', CAST({v} AS DOUBLE))" for k, v in OVERRIDES.items())
SQL["threshold_overrides"] = f"""
SELECT route, CAST({THRESHOLD} AS DOUBLE) AS old_threshold,
  coalesce(o.threshold, CAST({THRESHOLD} AS DOUBLE)) AS new_threshold
FROM (SELECT DISTINCT lower(lang) route FROM documents)
LEFT JOIN (VALUES {_OVERRIDES}) o(route, threshold) USING (route)"""

for _name, _agg in (("route_avg", "avg"), ("route_min", "min")):
    SQL[_name] = f"""
WITH {_routed(_agg)} SELECT doc_id, lang, prediction, distance,
  round(confidence, 9) AS confidence, is_fallback FROM routed"""

SQL["unrouted_articles"] = f"WITH {_routed()} SELECT doc_id FROM routed WHERE is_fallback"

_DENSE = f"""
flat AS (SELECT vec_id, label, unnest(range(len(embedding))) dim,
  CAST(unnest(embedding) AS DOUBLE) x FROM embeddings),
unit AS (SELECT vec_id, CAST(label AS VARCHAR) route, dim,
  x / sqrt(sum(x * x) OVER (PARTITION BY vec_id)) v FROM flat),
picked AS (SELECT vec_id FROM embeddings
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= {DENSE_SAMPLES}),
drefs AS (SELECT u.* FROM unit u JOIN picked USING (vec_id)),
davg AS (SELECT q.vec_id, c.route, round(1 - sum(q.v * c.v), 9) distance FROM unit q
  JOIN (SELECT route, dim, avg(v) v FROM drefs GROUP BY route, dim) c USING (dim) GROUP BY ALL),
dpairs AS (SELECT q.vec_id, r.route, r.vec_id ref_id, sum(q.v * r.v) dot
  FROM unit q JOIN drefs r USING (dim) GROUP BY ALL),
dmin AS (SELECT vec_id, route, round(1 - max(dot), 9) distance FROM dpairs GROUP BY ALL)"""


def _dense_best(agg: str) -> str:
    return f"""SELECT e.vec_id, '{agg}' AS agg, b.route, b.distance,
  CASE WHEN b.route IS NULL THEN 0.0 ELSE round(greatest(0, 1 - b.distance), 9) END AS confidence
FROM embeddings e LEFT JOIN (SELECT * FROM d{agg} WHERE distance <= {DENSE_THRESHOLDS[agg]}
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, route) = 1) b USING (vec_id)"""


SQL["route_dense"] = f"WITH {_DENSE} {_dense_best('avg')} UNION ALL {_dense_best('min')}"

SQL["topk_routes"] = f"""
WITH {_DENSE} SELECT vec_id, rank, route, distance FROM (SELECT *,
  row_number() OVER (PARTITION BY vec_id ORDER BY distance, route) AS rank FROM davg)
WHERE rank <= 3"""

SQL["prediction_fallback"] = f"""
WITH raw AS (SELECT d.doc_id, CASE WHEN l.quality IS NULL THEN NULL WHEN l.toxic = 1 THEN 'NA'
  WHEN l.quality = 0 THEN d.source
  ELSE upper(substr(d.lang, 1, 1)) || lower(substr(d.lang, 2)) END raw
  FROM documents d LEFT JOIN labels l USING (doc_id)),
ok AS (SELECT *, coalesce(lower(raw) IN ({CLASS_LIST}), false) valid FROM raw)
SELECT doc_id, raw, CASE WHEN valid THEN lower(raw) ELSE '{FIRST}' END AS prediction,
  CASE WHEN valid THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS confidence,
  NOT valid AS is_fallback FROM ok"""

_SWEEP = f"""{_SPLIT},
train AS (SELECT * FROM split WHERE split = 'train'),
valid AS (SELECT * FROM split WHERE split = 'validation'),
{_avg_distances("train", "valid")},
grid AS (SELECT CAST(i AS DOUBLE) / 100 threshold FROM range(101) g(i)),
scored AS (SELECT route, threshold,
  count(*) FILTER (WHERE lang = route AND distance <= threshold) tp,
  count(*) FILTER (WHERE lang <> route AND distance <= threshold) fp,
  count(*) FILTER (WHERE lang = route AND distance > threshold) fn
  FROM dist JOIN valid USING (doc_id) CROSS JOIN grid GROUP BY route, threshold),
sweep AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END p,
  CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END r FROM scored),
fscored AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END f FROM sweep)"""
SQL["threshold_sweep"] = f"""
WITH {_SWEEP} SELECT route, threshold, tp, fp, fn, round(p, 9) AS precision,
  round(r, 9) AS recall, round(f, 9) AS f1 FROM fscored"""
SQL["best_thresholds"] = f"""
WITH {_SWEEP} SELECT route, threshold, round(f, 9) AS f1 FROM fscored
QUALIFY row_number() OVER (PARTITION BY route ORDER BY round(f, 12) DESC, threshold) = 1"""

SQL["trained_thresholds"] = f"""
WITH {_SWEEP}, best AS (SELECT route, threshold FROM fscored
  QUALIFY row_number() OVER (PARTITION BY route ORDER BY round(f, 12) DESC, threshold) = 1)
SELECT route, coalesce(o.threshold, b.threshold) AS threshold
FROM best b LEFT JOIN (VALUES {_OVERRIDES}) o(route, threshold) USING (route)"""

# every distance that a validation document has, tried as a threshold
SQL["exact_thresholds"] = f"""
WITH {_SPLIT},
train AS (SELECT * FROM split WHERE split = 'train'),
valid AS (SELECT * FROM split WHERE split = 'validation'),
{_avg_distances("train", "valid")},
tried AS (SELECT DISTINCT route, distance AS threshold FROM dist WHERE distance <= 1),
scored AS (SELECT t.route, t.threshold,
  count(*) FILTER (WHERE lang = d.route AND distance <= threshold) tp,
  count(*) FILTER (WHERE distance <= threshold) taken, count(*) FILTER (WHERE lang = d.route) own
  FROM tried t JOIN dist d USING (route) JOIN valid USING (doc_id) GROUP BY ALL),
f AS (SELECT route, threshold, CASE WHEN taken + own = 0 THEN 0 ELSE 2 * tp / (taken + own) END f1 FROM scored)
SELECT route, threshold, round(f1, 9) AS f1 FROM f
QUALIFY row_number() OVER (PARTITION BY route ORDER BY round(f1, 12) DESC, threshold) = 1"""

_LIMITED = f"coalesce(o.threshold, CAST({THRESHOLD} AS DOUBLE))"
SQL["stored_routes"] = f"""
WITH {_sample()}, kept AS (SELECT route, count(*) n FROM refs GROUP BY route)
SELECT 'first' AS snapshot, route, CAST({THRESHOLD} AS DOUBLE) AS threshold, n AS references_count FROM kept
UNION ALL SELECT 'current', route, {_LIMITED}, n FROM kept
  LEFT JOIN (VALUES {_OVERRIDES}) o(route, threshold) USING (route)"""
SQL["router_info"] = f"""
WITH {_sample()} SELECT route, count(*) AS references_count, CAST({THRESHOLD} AS DOUBLE) AS threshold,
  route AS category, CAST(count(*) AS VARCHAR) AS samples_count FROM refs GROUP BY route"""

SQL["nearest_references"] = f"""
WITH {_DENSE}, d AS (SELECT q.vec_id, lpad(CAST(r.vec_id AS VARCHAR), 12, '0') route,
  round(1 - sum(q.v * r.v), 9) distance FROM unit q JOIN unit r USING (dim) GROUP BY q.vec_id, r.vec_id)
SELECT vec_id, rank, route, distance FROM (SELECT *,
  row_number() OVER (PARTITION BY vec_id ORDER BY distance, route) AS rank FROM d) WHERE rank <= 3"""

_LETTERS = ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in "aen ")
SQL["cached_embeddings"] = f"""
WITH counted AS (SELECT doc_id, [1, {_LETTERS}] c FROM documents),
flat AS (SELECT doc_id, unnest(range(5)) dim, CAST(unnest(c) AS DOUBLE) x FROM counted)
SELECT doc_id, dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 9) AS v FROM flat"""

SQL["article_files"] = "SELECT doc_id AS article_id, text, lang AS label FROM documents"
SQL["written_split"] = f"""
WITH {_SPLIT} SELECT doc_id AS article_id, regexp_replace(text, '^{WS}+|{WS}+$', '', 'g') AS text,
  lang AS label, split FROM split"""

# -- batches of model calls ------------------------------------------------------

_PROMPTS = f"""{_BATCHES},
prompts AS (SELECT batch_id, count(*) n_articles, min_by(doc_id, idx) first_id,
  'The labels are: {", ".join(CLASSES)}.' || string_agg(
    chr(10) || chr(10) || '[text ' || doc_id || ']' || chr(10) || coalesce(text, '') || chr(10)
    || '[end of text ' || doc_id || ']', '' ORDER BY idx)
  || chr(10) || chr(10) || 'Give each of the ' || count(*) || ' texts the label that suits it as a '
  || 'whole. Print nothing but one line per text, with its id and the label in lower case: '
  || '{{"article_id": 12, "category": "label"}}' prompt
  FROM batches JOIN documents USING (doc_id) GROUP BY batch_id)"""
SQL["prompt_batches"] = f"WITH {_PROMPTS} SELECT batch_id, n_articles, prompt FROM prompts"


def _form_a(category: str) -> str:
    return f"""'{{"article_id": ' || doc_id || ', "category": "' || {category} || '"}}'"""


def _form_b(category: str) -> str:
    return f"""'{{ "category": ' || {category} || ', "article_id": ' || doc_id || '}}'"""


def _listing(entry: str, condition: str = "true") -> str:
    return f"coalesce(string_agg({entry}, ', ' ORDER BY idx) FILTER (WHERE {condition}), '')"


_LONG = "n_chars > 2000"
_OPEN = """'Here:' || chr(10) || '{"classifications": ['"""
_UNKNOWN_A = _form_a(f"CASE WHEN {_LONG} THEN 'unknown' ELSE lang END")
_NULL_B = _form_b(f"CASE WHEN {_LONG} THEN 'null' ELSE '\"' || lang || '\"' END")
_PARSED = f"""{_BATCHES},
replies AS (SELECT batch_id, CASE batch_id % 6
  WHEN 0 THEN 'Done.' || chr(10) || {_listing(_form_a("lang"))}
  WHEN 1 THEN {_OPEN} || {_listing(_form_b("'\"' || upper(lang) || '\"'"))}
    || ']}}' || chr(10) || 'End'
  WHEN 2 THEN {_listing(_UNKNOWN_A)} || chr(10) || {_listing(_form_a("'fr'"))}
  WHEN 3 THEN {_OPEN} || {_listing(_form_b("'\"' || lang || '\"'"))}
  WHEN 4 THEN 'No category fits these articles.'
  ELSE {_OPEN} || {_listing(_NULL_B, "source <> 'src3'")} || ']}}' END reply
  FROM batches JOIN documents USING (doc_id) GROUP BY batch_id),
found AS (SELECT batch_id, regexp_extract_all(reply, '{REPLY_OBJECT}') a,
  regexp_extract(reply, '{REPLY_LIST}', 1) b FROM replies),
listed AS (SELECT batch_id, CASE WHEN len(a) > 0 THEN a
  WHEN json_valid(b) THEN CAST(json_extract(b, '$.classifications[*]') AS VARCHAR[])
  ELSE [] END entries FROM found),
entries AS (SELECT batch_id, unnest(range(len(entries))) pos, unnest(entries) entry FROM listed),
parsed AS (SELECT batch_id, pos,
  CAST(json_extract_string(entry, '$.article_id') AS BIGINT) article_id,
  json_extract_string(entry, '$.category') category FROM entries)"""
SQL["llm_reply_parse"] = f"WITH {_PARSED} SELECT batch_id, pos, article_id, category FROM parsed"
SQL["llm_reply_join"] = f"""
WITH {_PARSED},
firsts AS (SELECT * FROM parsed
  QUALIFY row_number() OVER (PARTITION BY batch_id, article_id ORDER BY pos) = 1),
joined AS (SELECT b.batch_id, b.doc_id AS article_id, lower(f.category) c,
  coalesce(lower(f.category) IN ({CLASS_LIST}), false) valid
  FROM batches b LEFT JOIN firsts f ON f.batch_id = b.batch_id AND f.article_id = b.doc_id)
SELECT batch_id, article_id, CASE WHEN valid THEN c ELSE '{FIRST}' END AS prediction,
  NOT valid AS is_fallback FROM joined"""

_NAMES = "[" + ", ".join(f"'{c}'" for c in [*CLASSES, "xx"]) + "]"
_ANSWERED = f"""{_PROMPTS},
answers AS (SELECT p.batch_id, p.prompt, p.first_id % 70 = 30 AS failed,
  string_agg('{{"article_id": ' || b.doc_id || ', "category": "'
    || {_NAMES}[CAST(b.doc_id % 5 + 1 AS INTEGER)] || '"}}', chr(10) ORDER BY b.idx) reply
  FROM prompts p JOIN batches b USING (batch_id) GROUP BY ALL)"""
SQL["llm_classify"] = f"""
WITH {_ANSWERED}
SELECT b.batch_id, b.doc_id AS article_id,
  CASE WHEN failed OR b.doc_id % 5 = 4 THEN '{FIRST}'
    ELSE {_NAMES}[CAST(b.doc_id % 5 + 1 AS INTEGER)] END AS prediction,
  failed OR b.doc_id % 5 = 4 AS is_fallback,
  CASE WHEN failed THEN 'failed' ELSE 'success' END AS status,
  CASE WHEN failed THEN 0 ELSE {_tokens("a.prompt")} END AS prompt_tokens,
  CASE WHEN failed THEN 0 ELSE {_tokens("a.reply")} END AS completion_tokens
FROM batches b JOIN answers a USING (batch_id)"""

# -- cost ------------------------------------------------------------------------

_PRICES = ", ".join(f"('{m}', CAST({p} AS DOUBLE))" for m, p in PRICES.items())
_SOURCE_MODELS = "[" + ", ".join(f"'{m}'" for m in SOURCE_MODELS) + "]"
SQL["embedding_cost"] = f"""
WITH prices(model, price) AS (VALUES {_PRICES}),
used AS (SELECT {_SOURCE_MODELS}[CAST(substr(source, 4) AS INTEGER) % 6 + 1] model,
  {_tokens("text")} tokens FROM documents),
priced AS (SELECT model, tokens, coalesce(price, {DEFAULT_PRICE}) price
  FROM used LEFT JOIN prices USING (model))
SELECT model, count(*) AS total_texts, CAST(sum(tokens) AS BIGINT) AS total_tokens,
  round(sum(tokens / 1000.0 * price), 12) AS total_cost,
  any_value(price) AS price_per_1k_tokens,
  round(sum(tokens / 1000.0 * price) / count(*), 12) AS cost_per_text,
  round(sum(tokens) / count(*), 12) AS avg_tokens_per_text
FROM priced GROUP BY model"""

_LANG_MODELS = ", ".join(f"('{k}', '{v}')" for k, v in LANG_MODELS.items())
SQL["cost_ledger"] = f"""
WITH {_sample()},
prices(model, price) AS (VALUES {_PRICES}), models(lang, model) AS (VALUES {_LANG_MODELS}),
used AS (SELECT 'training' phase, route lang, {_tokens("ref_text")} tokens FROM refs
  UNION ALL SELECT 'classification', lang, {_tokens("text")} FROM documents),
priced AS (SELECT phase, tokens, model LIKE 'text-embedding%' paid,
  coalesce(price, {DEFAULT_PRICE}) price
  FROM used JOIN models USING (lang) LEFT JOIN prices USING (model)),
summed AS (SELECT phase, paid, count(*) n, sum(tokens) t, sum(tokens / 1000.0 * price) c
  FROM priced GROUP BY phase, paid)
SELECT phase, CASE WHEN paid THEN 'openai' ELSE 'huggingface' END AS provider,
  CASE WHEN paid THEN n ELSE 0 END AS calls,
  CAST(CASE WHEN paid THEN t ELSE 0 END AS BIGINT) AS tokens,
  round(CASE WHEN paid THEN c ELSE 0 END, 12) AS cost,
  round(CASE WHEN paid THEN c / n ELSE 0 END, 12) AS avg_cost_per_call FROM summed"""

SQL["model_catalogue"] = f"""
WITH models(model, provider, dims, price_per_1k) AS (VALUES
  ('text-embedding-3-small', 'openai', 1536, 0.00002::DOUBLE),
  ('text-embedding-3-large', 'openai', 3072, 0.00013),
  ('text-embedding-ada-002', 'openai', 1536, 0.0001),
  ('sentence-transformers/all-MiniLM-L6-v2', 'huggingface', 384, 0),
  ('sentence-transformers/all-mpnet-base-v2', 'huggingface', 768, 0)),
used AS (SELECT CAST(sum({_tokens("text")}) AS BIGINT) t FROM documents)
SELECT model, provider, dims, price_per_1k, t AS total_tokens,
  round(t / 1000.0 * price_per_1k, 9) AS total_cost FROM models, used"""

# -- metrics ---------------------------------------------------------------------

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"
_EVENT_BATCHES = f"""
batches AS (SELECT user_id, event_type, event_type <> 'error' ok, count(*) n, sum(value) latency,
  sum({_K}) asked FROM events GROUP BY user_id, event_type),
sums AS (SELECT sum(n) ta, coalesce(sum(n) FILTER (WHERE ok), 0) sa, count(*) tb,
  count(*) FILTER (WHERE ok) sb, coalesce(sum(latency) FILTER (WHERE ok), 0) lat,
  coalesce(sum(asked * 0.003::DOUBLE / 1000) FILTER (WHERE ok), 0) cost,
  coalesce(sum(asked) FILTER (WHERE ok), 0) pt, coalesce(sum(n) FILTER (WHERE ok), 0) ct,
  coalesce(sum(asked + n) FILTER (WHERE ok), 0) tt FROM batches),
metrics AS (SELECT CAST(ta AS BIGINT) AS total_articles, CAST(sa AS BIGINT) AS successful_articles,
  CAST(ta - sa AS BIGINT) AS failed_articles, tb AS total_batches, sb AS successful_batches,
  tb - sb AS failed_batches, sb / tb AS success_rate, lat AS total_latency,
  lat / sb AS avg_batch_latency, lat / sa AS avg_latency_per_article, cost AS total_cost,
  cost / sa AS cost_per_article, CAST(pt AS BIGINT) AS total_prompt_tokens,
  CAST(ct AS BIGINT) AS total_completion_tokens, CAST(tt AS BIGINT) AS total_tokens,
  pt / sa AS avg_prompt_tokens_per_article, ct / sa AS avg_completion_tokens_per_article,
  tt / sa AS avg_tokens_per_article FROM sums)"""
_ROUNDED = ", ".join(
    f"round({c}, 6) AS {c}" for c in ("total_latency", "total_cost", *_RATES)
)
SQL["batch_metrics"] = f"WITH {_EVENT_BATCHES} SELECT * REPLACE ({_ROUNDED}) FROM metrics"

SQL["metric_categories"] = f"""
WITH {_EVENT_BATCHES},
doubles AS (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM metrics)
SELECT {_CATEGORY_RULE} AS category, metric,
  round(value, 6) AS value
FROM (UNPIVOT doubles ON COLUMNS(*) INTO NAME metric VALUE value)"""

SQL["all_batches"] = f"""
WITH {_EVENT_BATCHES}
SELECT user_id || '-' || event_type AS batch_id, n AS batch_size,
  CASE WHEN ok THEN round(latency, 6) END AS total_latency,
  CASE WHEN ok THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN NOT ok THEN 'failed calls: ' || n END AS error FROM batches"""

SQL["per_batch_rates"] = f"""
WITH turns AS (SELECT conv_id batch_id, role, {_tokens("text")} t,
  CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END expected FROM conversations),
spent AS (SELECT batch_id, count(*) batch_size,
  CAST(coalesce(sum(t) FILTER (WHERE role <> 'assistant'), 0) AS BIGINT) prompt_tokens,
  CAST(coalesce(sum(t) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) completion_tokens,
  avg(CASE WHEN role = expected THEN 1.0 ELSE 0.0 END) acc FROM turns GROUP BY batch_id),
priced AS (SELECT *, completion_tokens * 0.02::DOUBLE lat,
  (prompt_tokens * 0.003::DOUBLE + completion_tokens * 0.015::DOUBLE) / 1000 cost FROM spent)
SELECT batch_id, batch_size, prompt_tokens, completion_tokens, round(lat, 9) AS total_latency,
  round(cost, 9) AS total_cost, round(lat / batch_size, 9) AS avg_latency_per_article,
  round(cost / batch_size, 9) AS cost_per_article, round(acc, 9) AS accuracy FROM priced"""

SQL["accuracy"] = f"""
WITH {_routed()},
classified AS (SELECT r.*, CASE WHEN l.doc_id IS NULL THEN NULL ELSE r.lang END true_label
  FROM routed r LEFT JOIN labels l USING (doc_id))
SELECT count(*) AS total_articles, count(true_label) AS total_predictions,
  count(*) FILTER (WHERE true_label = prediction) AS correct_predictions,
  round(count(*) FILTER (WHERE true_label = prediction) / count(true_label), 9) AS accuracy,
  round(avg(confidence), 9) AS avg_confidence FROM classified"""

SQL["confusion_matrix"] = f"""
WITH {_routed()} SELECT lower(lang) AS y_true, lower(prediction) AS y_pred, count(*) AS n
FROM routed GROUP BY ALL"""

SQL["class_report"] = f"""
WITH {_routed()}, {_report()} SELECT class, round(precision, 9) AS precision,
  round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM report"""

_MEANS = ", ".join(
    [f"avg({n}) AS {n}_macro" for n in ("precision", "recall", "f1")]
    + [f"sum({n} * support) / sum(support) AS {n}_weighted" for n in ("precision", "recall", "f1")]
)
SQL["averaged_metrics"] = f"""
WITH {_routed()}, {_report()}, means AS (SELECT {_MEANS} FROM report)
SELECT round(COLUMNS(*), 9) FROM means"""

_LONG_METRICS = f"""
doubles AS (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM one)
SELECT {_CATEGORY_RULE} AS category, metric,
  round(value, 9) AS value
FROM (UNPIVOT doubles ON COLUMNS(*) INTO NAME metric VALUE value)"""

SQL["router_run_metrics"] = f"""
WITH {_routed()}, {_report()}, means AS (SELECT {_MEANS} FROM report),
used AS (SELECT count(*) n, sum({_tokens("text")}) t, count(*) FILTER (WHERE lang = prediction) ok,
  sum({_tokens("text")} / 1000.0 * 0.00002::DOUBLE) cost FROM routed),
one AS (SELECT n AS total_articles, n AS successful_articles, 0 AS failed_articles,
  1 AS total_batches, 1 AS successful_batches, 0 AS failed_batches, 1 AS success_rate,
  0 AS total_latency, 0 AS avg_batch_latency, 0 AS avg_latency_per_article, cost AS total_cost,
  cost / n AS cost_per_article, 0 AS total_prompt_tokens, 0 AS total_completion_tokens,
  t AS total_tokens, 0 AS avg_prompt_tokens_per_article, 0 AS avg_completion_tokens_per_article,
  t / n AS avg_tokens_per_article, ok / n AS accuracy, ok AS correct_predictions,
  n AS total_predictions, means.* FROM used, means),
{_LONG_METRICS}"""

SQL["llm_run_metrics"] = f"""
WITH {_ANSWERED},
paid AS (SELECT batch_id, failed, n_articles n, CASE WHEN failed THEN 0 ELSE {_tokens("prompt")} END pt,
  CASE WHEN failed THEN 0 ELSE {_tokens("reply")} END ct
  FROM answers JOIN (SELECT batch_id, n_articles FROM prompts) USING (batch_id)),
classified AS (SELECT lang, CASE WHEN doc_id % 5 = 4 THEN '{FIRST}'
    ELSE {_NAMES}[CAST(doc_id % 5 + 1 AS INTEGER)] END prediction
  FROM batches JOIN answers USING (batch_id) JOIN documents USING (doc_id) WHERE NOT failed),
{_report("classified")}, means AS (SELECT {_MEANS} FROM report),
hits AS (SELECT count(*) total, count(*) FILTER (WHERE lang = prediction) ok FROM classified),
sums AS (SELECT sum(n) ta, sum(n) FILTER (WHERE NOT failed) sa, count(*) tb,
  count(*) FILTER (WHERE NOT failed) sb, sum(pt) pt, sum(ct) ct,
  sum((pt * 0.001::DOUBLE + ct * 0.005::DOUBLE) / 1000) cost FROM paid),
one AS (SELECT ta AS total_articles, sa AS successful_articles, ta - sa AS failed_articles,
  tb AS total_batches, sb AS successful_batches, tb - sb AS failed_batches,
  sb / tb AS success_rate, cost AS total_cost, cost / sa AS cost_per_article,
  pt AS total_prompt_tokens, ct AS total_completion_tokens, pt + ct AS total_tokens,
  pt / sa AS avg_prompt_tokens_per_article, ct / sa AS avg_completion_tokens_per_article,
  (pt + ct) / sa AS avg_tokens_per_article, ok / total AS accuracy, ok AS correct_predictions,
  total AS total_predictions, means.* FROM sums, hits, means),
{_LONG_METRICS}"""

# -- runs ------------------------------------------------------------------------

_MESSAGES = "[" + ", ".join(_text(m) for m in MESSAGES) + "]"
_ERRORS = f"""
errors AS (SELECT event_id, {_MESSAGES}[CAST({_K} % {len(MESSAGES)} + 1 AS INTEGER)] error
  FROM events WHERE event_type = 'error')"""

SQL["classification_report_rows"] = f"""
WITH {_routed()}, {_BATCHES}, {_ERRORS},
rows AS (SELECT b.batch_id, r.doc_id, r.prediction, r.text, e.error,
  CASE WHEN l.doc_id IS NULL THEN NULL ELSE lower(r.lang) END label
  FROM routed r JOIN batches b USING (doc_id) LEFT JOIN labels l USING (doc_id)
  LEFT JOIN errors e ON e.event_id = b.batch_id)
SELECT CAST(batch_id AS VARCHAR) AS batch_id, doc_id AS article_id,
  CASE WHEN error IS NULL THEN prediction END AS prediction, label AS true_label,
  CASE WHEN error IS NULL THEN label = prediction END AS correct,
  CASE WHEN error IS NULL THEN 'success' ELSE 'failed: ' || error END AS batch_status,
  replace(replace({_cut("text", 100)}, chr(10), ' '), chr(13), ' ') AS article_text_preview
FROM rows"""

_RUNS = """
runs AS (SELECT event_type AS result_type, max(ts) AS modified_at,
  strftime(max(ts), '%Y-%m-%d_%H-%M-%S') || '_' || user_id AS run_id
  FROM events GROUP BY event_type, user_id),
newest AS (SELECT * FROM runs QUALIFY
  row_number() OVER (PARTITION BY result_type ORDER BY modified_at DESC, run_id) = 1)"""
SQL["run_listing"] = f"""
WITH {_RUNS} SELECT r.result_type, r.run_id, r.modified_at,
  count(*) OVER (PARTITION BY r.result_type) AS runs_of_type,
  r.run_id = n.run_id AS is_latest
FROM runs r JOIN newest n USING (result_type) ORDER BY r.modified_at DESC, r.run_id"""
SQL["latest_run"] = f"WITH {_RUNS} SELECT result_type, run_id, modified_at FROM newest"


def _run_metrics(agg: str, price: float) -> str:
    vectors = "count(*)" if agg == "min" else "count(DISTINCT route)"
    return f"""(WITH {_routed(agg)}, {_report()},
latencies AS (SELECT {vectors} / 1e6::DOUBLE latency FROM refs),
means AS (SELECT avg(precision) p, avg(recall) r, avg(f1) f,
  sum(f1 * support) / sum(support) fw FROM report),
one AS (SELECT count(*) n, count(*) FILTER (WHERE lang = prediction) / count(*) acc,
  sum({_tokens("text")} / 1000.0 * {price}::DOUBLE) cost FROM routed)
SELECT acc AS accuracy, f AS f1_macro, fw AS f1_weighted, p AS precision_macro,
  r AS recall_macro, n * latency AS total_latency, latency AS avg_latency_per_article, cost AS total_cost,
  cost / n AS cost_per_article, CAST(1 AS DOUBLE) AS success_rate FROM one, means, latencies)"""


def _compared(metrics: list[str], digits: int) -> str:
    """From one-row tables b and s: values side by side with what the second gains."""
    names = ", ".join(metrics)
    return f"""bl AS (UNPIVOT b ON {names} INTO NAME metric VALUE baseline),
sl AS (UNPIVOT s ON {names} INTO NAME metric VALUE semantic),
r AS (SELECT *, CASE WHEN baseline = 0 THEN 'inf'::DOUBLE ELSE semantic / baseline END ratio
  FROM bl JOIN sl USING (metric)),
compared AS (SELECT metric, round(baseline, {digits}) AS baseline, round(semantic, {digits}) AS semantic,
  round(ratio, {digits}) AS improvement_ratio, round((ratio - 1) * 100, {digits}) AS improvement_pct,
  CASE WHEN contains(metric, 'latency') THEN round(CASE WHEN semantic = 0 THEN 'inf'::DOUBLE
    ELSE baseline / semantic END, {digits}) END AS speedup,
  CASE WHEN contains(metric, 'cost') AND NOT contains(metric, 'latency')
    THEN round(CASE WHEN ratio < 1 THEN (1 - ratio) * 100 ELSE 0 END, {digits}) END AS savings_pct
FROM r)"""


SQL["run_comparison"] = f"""
WITH b AS {_run_metrics("min", 0.00013)}, s AS {_run_metrics("avg", 0.00002)},
{_compared(_COMPARED, 9)} SELECT * FROM compared"""


def _event_side(odd: int) -> str:
    whole = _EVENT_BATCHES.replace("FROM events GROUP", f"FROM events WHERE user_id % 2 = {odd} GROUP")
    return f"(WITH {whole} SELECT CAST(COLUMNS(*) AS DOUBLE) FROM metrics)"


SQL["stored_comparison"] = f"""
WITH b AS {_event_side(0)}, s AS {_event_side(1)}, {_compared(_TRACKED_EVENTS, 6)}
SELECT * FROM compared"""
SQL["run_summary_rows"] = f"""
WITH one AS {_event_side(1)}
SELECT 'semantic' AS result_type, 'run' AS run_id, false AS has_classifications,
  {_CATEGORY_RULE} AS category, metric, round(value, 6) AS value
FROM (UNPIVOT one ON COLUMNS(*) INTO NAME metric VALUE value)"""

_REPORT_ROWS = """
report_rows AS (SELECT 'classification_metrics' AS part, name, value FROM (
  SELECT 'classification_report.' || class || '.' || m.metric AS name, m.value FROM report,
    LATERAL (VALUES ('precision', CAST(precision AS DOUBLE)), ('recall', CAST(recall AS DOUBLE)),
      ('f1-score', CAST(f1 AS DOUBLE)), ('support', CAST(support AS DOUBLE))) m(metric, value)
  UNION ALL SELECT 'classification_report.' || m.metric, m.value FROM means,
    LATERAL (VALUES ('macro avg.precision', CAST(precision_macro AS DOUBLE)), ('macro avg.recall', recall_macro),
      ('macro avg.f1-score', f1_macro), ('weighted avg.precision', precision_weighted),
      ('weighted avg.recall', recall_weighted), ('weighted avg.f1-score', f1_weighted)) m(metric, value)))"""
_STORED_METRICS = f"""
doubles AS (SELECT CAST(COLUMNS(*) AS DOUBLE) FROM one),
stored AS (SELECT {_CATEGORY_RULE} AS part, metric AS name, value
  FROM (UNPIVOT doubles ON COLUMNS(*) INTO NAME metric VALUE value))"""
_THRESHOLDS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in OVERRIDES.items())
_OWN_THRESHOLD = f"CASE route {_THRESHOLDS} ELSE {THRESHOLD} END"
SQL["saved_router_run"] = f"""
WITH {_routed("avg", _OWN_THRESHOLD)}, {_report()}, means AS (SELECT {_MEANS} FROM report),
used AS (SELECT count(*) n, sum({_tokens("text")}) t, count(*) FILTER (WHERE lang = prediction) ok,
  sum({_tokens("text")} / 1000.0 * 0.00002::DOUBLE) cost, count(*) FILTER (WHERE is_fallback) fallen,
  avg(confidence) conf FROM routed),
one AS (SELECT n AS total_articles, n AS successful_articles, 0 AS failed_articles,
  1 AS total_batches, 1 AS successful_batches, 0 AS failed_batches, 1 AS success_rate,
  cost AS total_cost, cost / n AS cost_per_article, 0 AS total_prompt_tokens,
  0 AS total_completion_tokens, t AS total_tokens, 0 AS avg_prompt_tokens_per_article,
  0 AS avg_completion_tokens_per_article, t / n AS avg_tokens_per_article, ok / n AS accuracy,
  ok AS correct_predictions, n AS total_predictions, means.* FROM used, means),
{_STORED_METRICS}, {_REPORT_ROWS},
facts AS (SELECT 'facts' AS part, m.name, m.value FROM used, LATERAL (VALUES
  ('rows', CAST(n AS DOUBLE)), ('fallbacks', CAST(fallen AS DOUBLE)), ('avg_confidence', CAST(conf AS DOUBLE)),
  ('tokens', CAST(t AS DOUBLE)), ('cost', CAST(cost AS DOUBLE))) m(name, value)),
predicted AS (SELECT 'rows' AS part, prediction AS name, CAST(count(*) AS DOUBLE) AS value
  FROM routed GROUP BY prediction),
limits AS (SELECT 'thresholds' AS part, route AS name, CAST({_OWN_THRESHOLD} AS DOUBLE) AS value FROM sizes),
held AS (SELECT 'references' AS part, route AS name, CAST(n AS DOUBLE) AS value FROM sizes)
SELECT part, name, round(value, 9) AS value FROM (FROM stored UNION ALL FROM report_rows
  UNION ALL FROM facts UNION ALL FROM predicted UNION ALL FROM limits UNION ALL FROM held)"""

_MODEL_RUN = SQL["llm_run_metrics"].split("doubles AS (")[0]
SQL["saved_model_run"] = f"""{_MODEL_RUN.rstrip().rstrip(",")},
{_STORED_METRICS}, {_REPORT_ROWS},
every AS (SELECT failed, doc_id, failed OR doc_id % 5 = 4 fallen, CASE WHEN failed THEN 'none'
  WHEN doc_id % 5 = 4 THEN '{FIRST}' ELSE {_NAMES}[CAST(doc_id % 5 + 1 AS INTEGER)] END prediction
  FROM batches JOIN answers USING (batch_id)),
facts AS (SELECT 'facts' AS part, 'rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM every
  UNION ALL SELECT 'facts', 'fallbacks', count(*) FILTER (WHERE fallen) FROM every),
predicted AS (SELECT 'rows' AS part, prediction AS name, CAST(count(*) AS DOUBLE) AS value
  FROM every GROUP BY prediction)
SELECT part, name, round(value, 9) AS value FROM (FROM stored UNION ALL FROM report_rows
  UNION ALL FROM facts UNION ALL FROM predicted)"""

def _has(*needles: str) -> str:
    return " OR ".join(f"contains(lower(error), '{n}')" for n in needles)


_TAXONOMY = f"""{_ERRORS},
named AS (SELECT event_id, error, CASE
  WHEN {_has("rate limit", "429")} THEN 'RateLimitError'
  WHEN {_has("timeout", "timed out")} THEN 'TimeoutError'
  WHEN {_has("connection", "network")} THEN 'ConnectionError'
  WHEN {_has("500", "502", "503", "504")} THEN 'ServerError'
  WHEN {_has("401", "403")} THEN 'AuthenticationError'
  WHEN {_has("400", "404")} THEN 'BadRequestError'
  WHEN {_has("json", "parse")} THEN 'ParseError'
  ELSE 'RetryableError' END error_class FROM errors),
kinds AS (SELECT *, error_class NOT IN
  ('AuthenticationError', 'BadRequestError', 'ParseError') retryable FROM named)"""
SQL["error_taxonomy"] = f"""
WITH {_TAXONOMY} SELECT event_id, error, error_class, retryable FROM kinds"""
