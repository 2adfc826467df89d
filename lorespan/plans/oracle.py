"""The SQL each registered query is checked against, written independently for DuckDB."""

from __future__ import annotations

from lorespan.functions.text import BREAKS, FOLD_FROM, FOLD_TO, LINE_BREAK
from lorespan.operators.redact import DETECTORS, LITERAL
from lorespan.plans.bindings import AS_OF, AS_OF_EPOCH, ENTRY_NAMES, LITERAL_CODE, NOT_LITERAL, QUERY, TEST_PREFIX

ORACLE: dict[str, str] = {}


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def toks(x: str) -> str:
    return words(f"translate(lower({x}), '{FOLD_FROM}', '{FOLD_TO}')")


def rtrim(x: str) -> str:
    return f"regexp_replace({x}, '[\\s\\x0B]+$', '')"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def line_list(x: str) -> str:
    return (
        f"CASE WHEN {x} = '' THEN []::VARCHAR[] "
        f"ELSE string_split_regex(regexp_replace({x}, '(?:{LINE_BREAK})\\z', ''), '{LINE_BREAK}') END"
    )


def path(folder: str) -> str:
    return f"{folder}||'/'||lang||'/'||CASE WHEN doc_id % 20 = 0 THEN 'test_' ELSE '' END||doc_id||'.txt'"


ALL_FILES = f"allfiles AS (SELECT doc_id, {path('source')} AS file, lang AS language, text AS content, strlen(text) AS size, sha256(text) AS content_hash FROM documents)"
CORPUS = f"{ALL_FILES}, corpus AS (SELECT * FROM allfiles WHERE size <= 1000000)"
PREVIOUS = f"""previous AS (
  SELECT file, language, content, sha256(content) AS content_hash FROM (
    SELECT {path('source')} AS file, lang AS language,
           CASE WHEN doc_id % 10 = 3 THEN 'Older version.' || chr(10) || replace(text, ' an ', ' one ') ELSE text END AS content
    FROM documents WHERE doc_id % 10 <> 7
    UNION ALL SELECT {path("'removed'")}, lang, text FROM documents WHERE doc_id % 10 = 5))"""
LINES = f"""{CORPUS}, linelists AS (SELECT file, language, {line_list('content')} AS ls FROM corpus),
lines AS (SELECT file, language, len(ls) AS n_lines, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS text FROM linelists)"""
DEFS = f"""{LINES}, named AS (SELECT *, {words('text')} AS w FROM lines),
defs AS (SELECT w[1] AS name,
  CASE WHEN upper(substr(w[1],1,1)) = substr(w[1],1,1) AND lower(substr(w[1],1,1)) <> substr(w[1],1,1) THEN 'class' ELSE 'function' END AS kind,
  file, line AS start_line, coalesce(lead(line) OVER (PARTITION BY file ORDER BY line) - 1, n_lines) AS end_line,
  {rtrim('text')} AS signature, language, row_number() OVER (PARTITION BY file ORDER BY line) - 1 AS no
  FROM named WHERE len(w) > 0)"""
CALLS = f"""{DEFS}, calls AS (SELECT file, line, {rtrim('text')} AS context, unnest(w[2:]) AS name, unnest(range(0, len(w) - 1)) AS no FROM named WHERE len(w) > 1)"""
IMPORTS = f"""imports AS (SELECT unnest({words('ls[1]')}) AS symbol_name, file, trim(ls[1]) AS import_line FROM linelists WHERE len(ls) > 0)"""

# ---------------------------------------------------------------- corpus and lifecycle
ORACLE["corpus_scan"] = f"WITH {ALL_FILES} SELECT file, language, size, regexp_extract(file, '[^/]*$') LIKE 'test\\_%' ESCAPE '\\' AS is_test, size > 1000000 AS too_big FROM allfiles"
ORACLE["staleness"] = f"WITH {CORPUS}, {PREVIOUS} SELECT c.file, c.content_hash FROM corpus c LEFT JOIN previous p USING (file) WHERE p.file IS NULL OR p.content_hash <> c.content_hash"
ORACLE["change_class"] = f"""WITH {CORPUS}, {PREVIOUS} SELECT coalesce(c.file, p.file) AS file,
 CASE WHEN p.file IS NULL THEN 'new' WHEN c.file IS NULL THEN 'deleted' WHEN c.content_hash = p.content_hash THEN 'unchanged' ELSE 'changed' END AS change
 FROM allfiles c FULL OUTER JOIN previous p ON c.file = p.file"""
ORACLE["snapshot_upsert"] = f"""WITH {CORPUS}, {PREVIOUS},
 merged AS (SELECT * FROM (SELECT file, language, content, content_hash FROM corpus)
  UNION ALL SELECT file, language, content, content_hash FROM previous WHERE file NOT IN (SELECT file FROM corpus) AND file IN (SELECT file FROM allfiles))
 SELECT file, content_hash, language, len({line_list('content')}) AS line_count FROM merged"""
ORACLE["purge_deleted"] = f"WITH {CORPUS}, {PREVIOUS} SELECT file, content_hash FROM previous WHERE file IN (SELECT file FROM allfiles)"
ORACLE["run_stats"] = f"""WITH {DEFS}, {PREVIOUS},
 seen AS (SELECT a.file, a.size > 1000000 OR coalesce(p.content_hash = a.content_hash, false) AS skip FROM allfiles a LEFT JOIN previous p USING (file)),
 n AS (SELECT file, count(*) AS n FROM defs GROUP BY file)
 SELECT count(*) FILTER (NOT skip) AS files_indexed, count(*) FILTER (skip) AS files_skipped,
 coalesce(sum(n) FILTER (NOT skip), 0)::BIGINT AS symbols FROM seen LEFT JOIN n USING (file)"""

ORACLE["index_run"] = f"""SELECT 'update' AS event_type, {AS_OF_EPOCH}::DOUBLE AS ts, 1500.0::DOUBLE AS duration_ms,
 '{{"files_indexed":' || files_indexed || ',"files_skipped":' || files_skipped || ',"symbols":' || symbols || ',"incremental":true}}' AS metadata FROM ({ORACLE["run_stats"]})"""
ORACLE["file_list"] = f"WITH {CORPUS} SELECT file FROM corpus"

# ---------------------------------------------------------------- extraction
ORACLE["line_table"] = f"WITH {LINES} SELECT file, line, text FROM lines"
ORACLE["definitions"] = f"WITH {DEFS} SELECT name, kind, file, start_line, end_line, signature, language, no FROM defs"
ORACLE["references"] = f"WITH {CALLS} SELECT name AS symbol_name, file AS caller_file, line, no, length(context) AS context_chars FROM calls"
ORACLE["import_refs"] = f"WITH {LINES}, {IMPORTS} SELECT symbol_name, file, import_line FROM imports"

# ---------------------------------------------------------------- search
SYM_TOKS = f"""symlists AS (SELECT file, no, [{toks('name')}, {toks('kind')}, {toks('file')}, {toks('signature')}] AS cols FROM defs),
symcols AS (SELECT file, no, list_sum(list_transform(cols, lambda c: len(c)))::BIGINT AS dl, unnest(range(0, 4)) AS col, unnest(cols) AS c FROM symlists),
symtoks AS (SELECT file, no, dl, col, unnest(range(0, len(c))) AS pos, unnest(c) AS tok FROM symcols)"""
ORACLE["postings"] = f"WITH {DEFS}, {SYM_TOKS} SELECT file, no, dl, col, pos, tok FROM symtoks"

EDGE = r"""[.,;:!?\"''()\[\]{}]"""
ONE = f"queries AS (SELECT 0 AS query_id, {q(QUERY)} AS query)"
BATCH = "queries AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
TERMS = f"""rawwords AS (SELECT query_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS term_no FROM (
   SELECT query_id, list_filter(list_transform(string_split_regex(query, '\\s+'), lambda w: lower(regexp_replace(regexp_replace(w, '^{EDGE}+', ''), '{EDGE}+$', ''))), lambda w: w <> '') AS ws FROM queries)),
termlists AS (SELECT query_id, term_no, regexp_full_match(word, '[0-9]+') AS exact, {toks('word')} AS ts FROM rawwords),
terms AS (SELECT query_id, term_no, len(ts) AS n_toks, exact, unnest(range(0, len(ts))) AS tok_no, unnest(ts) AS tok FROM termlists),
terms2 AS (SELECT *, NOT exact AND tok_no = n_toks - 1 AS is_prefix FROM terms)"""


def counts(name: str, source: str, key: str) -> str:
    """Occurrences of every term in every row of a token table."""
    return f"""{name}_toks AS (SELECT DISTINCT tok FROM {source}),
{name}_found AS (SELECT s.tok, query_id, term_no, n_toks, tok_no FROM {name}_toks s JOIN terms2 t ON (t.is_prefix AND starts_with(s.tok, t.tok)) OR (NOT t.is_prefix AND s.tok = t.tok)),
{name}_hits AS (SELECT query_id, term_no, n_toks, {key}, dl, col, pos - tok_no AS start FROM {source} s JOIN {name}_found t USING (tok)),
{name} AS (SELECT query_id, term_no, {key}, max(dl) AS dl, count(*) AS f FROM (
   SELECT query_id, term_no, {key}, col, start, max(dl) AS dl FROM {name}_hits GROUP BY query_id, term_no, {key}, col, start, n_toks HAVING count(*) = n_toks)
   GROUP BY query_id, term_no, {key})"""


def ranked(name: str, source: str, key: str, total: str, tokens: str) -> str:
    return f"""{name}_n AS (SELECT query_id, term_no, count(*) AS n FROM {source} GROUP BY query_id, term_no),
{name}_len AS (SELECT {total} AS rows, {tokens} AS tokens),
{name}_w AS (SELECT query_id, term_no, CASE WHEN ln((rows - n + 0.5)/(n + 0.5)) > 0 THEN ln((rows - n + 0.5)/(n + 0.5)) ELSE 1e-6 END AS idf FROM {name}_n, {name}_len),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, {key}) AS place FROM (
  SELECT query_id, {key}, round(-sum(idf * f::DOUBLE * 2.2 / (f::DOUBLE + 1.2 * (0.25 + 0.75 * dl / (tokens::DOUBLE / rows)))), 9) AS rank
  FROM {source} JOIN {name}_w USING (query_id, term_no), {name}_len GROUP BY query_id, {key}) QUALIFY place <= 15)"""


SYM_SEARCH = f"""{SYM_TOKS}, {counts('symf', 'symtoks', 'file, no')},
{ranked('symtop', 'symf', 'file, no', '(SELECT count(*) FROM defs)', '(SELECT count(*) FROM symtoks)')}"""
CALL_SEARCH = f"""linectx AS (SELECT file, line, [{toks('file')}, {toks(rtrim('text'))}] AS cols FROM named WHERE len(w) > 1),
linecols AS (SELECT file, line, list_sum(list_transform(cols, lambda c: len(c)))::BIGINT AS dl, unnest(range(0, 2)) AS col, unnest(cols) AS c FROM linectx),
linetoks AS (SELECT file, line, dl, col, unnest(range(0, len(c))) AS pos, unnest(c) AS tok FROM linecols),
linedl AS (SELECT file, line, list_sum(list_transform(cols, lambda c: len(c)))::BIGINT AS ldl FROM linectx),
callnames AS (SELECT file, line, no, ldl + len(nt) AS dl, nt FROM (SELECT *, {toks('name')} AS nt FROM calls) JOIN linedl USING (file, line)),
nametoks AS (SELECT file, line, no, dl, 0 AS col, unnest(range(0, len(nt))) AS pos, unnest(nt) AS tok FROM callnames),
{counts('linef', 'linetoks', 'file, line')}, {counts('namef', 'nametoks', 'file, line, no')},
callf AS (SELECT query_id, term_no, file, line, no, max(dl) AS dl, sum(f) AS f FROM (
   SELECT query_id, term_no, file, line, no, c.dl, f FROM linef JOIN callnames c USING (file, line) UNION ALL SELECT query_id, term_no, file, line, no, dl, f FROM namef)
   GROUP BY query_id, term_no, file, line, no),
{ranked('calltop', 'callf', 'file, line, no', '(SELECT count(*) FROM calls)', '(SELECT sum(dl) FROM callnames)')}"""
MERGE = f"""firstdef AS (SELECT * FROM defs QUALIFY row_number() OVER (PARTITION BY name ORDER BY file, start_line) = 1),
callrows AS (SELECT t.*, c.name AS called, c.context FROM calltop t JOIN calls c USING (file, line, no)),
linked AS (SELECT r.query_id, r.rank, r.place, r.context AS call_context, r.line AS call_line, r.called AS name,
   coalesce(d.file, r.file) AS file, coalesce(d.start_line, r.line) AS start_line, coalesce(d.end_line, r.line) AS end_line,
   coalesce(d.kind, 'call') AS kind, coalesce(d.signature, r.context) AS signature, coalesce(d.language, '') AS language
   FROM callrows r LEFT JOIN firstdef d ON d.name = r.called),
direct AS (SELECT t.query_id, t.rank, d.name, file, start_line, end_line, kind, signature, language FROM symtop t JOIN defs d USING (file, no)),
perdef AS (SELECT query_id, file, name, start_line, min_by(rank, place) AS rank, min_by(end_line, place) AS end_line, min_by(kind, place) AS kind,
   min_by(signature, place) AS signature, min_by(language, place) AS language, min_by(call_context, place) AS call_context, min_by(call_line, place) AS call_line
   FROM linked GROUP BY query_id, file, name, start_line),
joined AS (SELECT query_id, file, name, start_line, coalesce(d.end_line, p.end_line) AS end_line, coalesce(d.kind, p.kind) AS kind,
   coalesce(d.signature, p.signature) AS signature, coalesce(d.language, p.language) AS language,
   coalesce(p.call_context, '') AS call_context, coalesce(p.call_line, 0) AS call_line, coalesce(d.rank, p.rank) AS rank
   FROM direct d FULL OUTER JOIN perdef p USING (query_id, file, name, start_line)),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, file, start_line, name) AS place FROM joined QUALIFY place <= 15)"""
HIT = "file, name, start_line, end_line, kind, signature, language, call_context, call_line, round(rank, 6) AS rank, place"
ORACLE["symbol_search"] = f"WITH {DEFS}, {ONE}, {TERMS}, {SYM_SEARCH} SELECT file, d.name, d.kind, d.start_line, round(rank, 6) AS rank, place FROM symtop JOIN defs d USING (file, no)"
ORACLE["call_search"] = f"WITH {CALLS}, {ONE}, {TERMS}, {CALL_SEARCH} SELECT file, line, no, c.name AS symbol_name, c.context, round(rank, 6) AS rank, place FROM calltop JOIN calls c USING (file, line, no)"
SEARCH_ALL = f"{TERMS}, {SYM_SEARCH}, {CALL_SEARCH}, {MERGE}"
ORACLE["merged_search"] = f"WITH {CALLS}, {ONE}, {SEARCH_ALL} SELECT {HIT} FROM merged"
ORACLE["search_after_refresh"] = ORACLE["merged_search"]
ORACLE["batch_search"] = f"WITH {CALLS}, {BATCH}, {SEARCH_ALL} SELECT query_id, {HIT} FROM merged"
ORACLE["hits_by_file"] = f"""WITH {CALLS}, {ONE}, {SEARCH_ALL} SELECT file, min(place) AS first_place, count(*) AS hits,
 string_agg(name || ':' || start_line, ',' ORDER BY place) AS items FROM merged GROUP BY file"""

# ---------------------------------------------------------------- resolve
REQUESTS = f"""requests AS (SELECT request_id, CASE request_id % 4 WHEN 0 THEN w WHEN 1 THEN translate(w, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') WHEN 2 THEN substr(w, 2) ELSE w || 'zzq' END AS name
 FROM (SELECT w, ('0x' || substr(md5(w), 1, 15))::BIGINT AS request_id FROM (SELECT DISTINCT unnest({words('text')}) AS w FROM benchmark)))"""
LOWER = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TIERS = f"""names AS (SELECT DISTINCT name FROM defs),
tiers AS (SELECT r.request_id, r.name AS asked, n.name, CASE WHEN n.name = r.name THEN 1 WHEN {LOWER('n.name')} LIKE {LOWER('r.name')} THEN 2 ELSE 3 END AS tier
  FROM requests r JOIN names n ON {LOWER('n.name')} LIKE '%' || {LOWER('r.name')} || '%'),
best AS (SELECT request_id, min(tier) AS tier FROM tiers GROUP BY request_id),
cands AS (SELECT t.request_id, t.tier, d.* FROM tiers t JOIN best USING (request_id, tier) JOIN defs d USING (name)),
chosen AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n FROM cands QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY file, start_line) = 1),
resolved AS (SELECT r.request_id, r.name AS asked, coalesce(c.name, r.name) AS name, coalesce(kind, 'unknown') AS kind, coalesce(file, '') AS file, coalesce(start_line, 0) AS start_line,
  coalesce(end_line, 0) AS end_line, coalesce(signature, '') AS signature, coalesce(language, '') AS language, coalesce(tier, 0)::BIGINT AS tier, coalesce(n, 0) AS n_candidates
  FROM requests r LEFT JOIN chosen c USING (request_id))"""
RESOLVED = f"{CALLS}, {REQUESTS}, {TIERS}"
SITES = f"""{RESOLVED}, sites AS (SELECT r.request_id, c.file, c.line, c.no, c.context FROM calls c JOIN resolved r ON c.name = r.name WHERE r.kind <> 'unknown')"""
TESTED = f"""{SITES}, tested AS (SELECT s.*, coalesce((SELECT d.name FROM defs d WHERE d.file = s.file AND d.start_line <= s.line AND d.end_line >= s.line
   AND {LOWER('d.name')} LIKE '{TEST_PREFIX}%' AND regexp_extract(s.file, '[^/]*$') LIKE 'test\\_%' ESCAPE '\\' ORDER BY d.start_line DESC LIMIT 1), '') AS enclosing_test FROM sites s)"""
SOURCE = f"CASE WHEN r.kind = 'unknown' THEN '' ELSE array_to_string(({line_list('c.content')})[r.start_line:r.end_line], chr(10)) END"
COMMITS = "commits AS (SELECT c.file, o.o_orderkey::VARCHAR AS hash, o.o_orderdate AS ts FROM orders o JOIN allfiles c ON c.doc_id = o.o_custkey), lastc AS (SELECT * FROM commits QUALIFY row_number() OVER (PARTITION BY file ORDER BY ts DESC, hash DESC) = 1)"
IMPORTERS = f"{IMPORTS}, importers AS (SELECT DISTINCT r.request_id, i.file FROM imports i JOIN resolved r ON i.symbol_name = r.name WHERE r.kind <> 'unknown')"
ORACLE["resolve_exact"] = f"WITH {DEFS}, {REQUESTS} SELECT r.request_id, d.name, d.kind, d.file, d.start_line FROM requests r JOIN defs d USING (name)"
ORACLE["resolve_ci"] = f"WITH {DEFS}, {REQUESTS} SELECT DISTINCT r.request_id, r.name AS asked, d.name FROM requests r JOIN defs d ON {LOWER('d.name')} LIKE {LOWER('r.name')}"
ORACLE["resolve_partial"] = f"WITH {DEFS}, {REQUESTS} SELECT DISTINCT r.request_id, r.name AS asked, d.name FROM requests r JOIN defs d ON {LOWER('d.name')} LIKE '%' || {LOWER('r.name')} || '%'"
ORACLE["resolve_chain"] = f"WITH {RESOLVED} SELECT * FROM resolved"
ORACLE["candidates"] = f"WITH {RESOLVED} SELECT request_id, name, kind, file, start_line FROM cands"
ORACLE["source_slice"] = f"WITH {RESOLVED} SELECT r.request_id, r.name, r.file, {SOURCE} AS source_code FROM resolved r LEFT JOIN corpus c USING (file)"
ORACLE["callers"] = f"WITH {SITES} SELECT request_id, file, line, no, length(context) AS context_chars FROM sites"
ORACLE["enclosing_test"] = f"WITH {TESTED} SELECT request_id, file, line, no, enclosing_test FROM tested WHERE enclosing_test <> ''"
ORACLE["caller_split"] = f"WITH {TESTED} SELECT request_id, count(*) FILTER (enclosing_test = '') AS n_callers, count(*) FILTER (enclosing_test <> '') AS n_tests FROM tested GROUP BY request_id"
ORACLE["importers"] = f"WITH {RESOLVED}, {IMPORTERS} SELECT * FROM importers"
ORACLE["last_commit"] = f"WITH {ALL_FILES}, {COMMITS} SELECT file, hash AS last_commit_hash, strftime(ts, '%Y-%m-%d') AS last_modified FROM lastc"
ORACLE["file_commit"] = f"""WITH {RESOLVED}, {COMMITS} SELECT file, coalesce(hash, '') AS last_commit_hash, strftime(ts, '%Y-%m-%d') AS last_modified
 FROM (SELECT DISTINCT file FROM resolved WHERE kind <> 'unknown') LEFT JOIN lastc USING (file)"""
ORACLE["resolve_full"] = f"""WITH {TESTED}, {IMPORTERS}, {COMMITS},
 placed AS (SELECT *, row_number() OVER (PARTITION BY request_id, enclosing_test = '' ORDER BY file, line, no) AS p FROM tested),
 sums AS (SELECT request_id, count(*) FILTER (enclosing_test = '') AS n_callers, count(*) FILTER (enclosing_test <> '') AS n_tests,
   string_agg(file || ':' || line, ',' ORDER BY p) FILTER (enclosing_test = '' AND p <= 10) AS callers,
   string_agg(file || ':' || line || ':' || enclosing_test, ',' ORDER BY p) FILTER (enclosing_test <> '' AND p <= 5) AS tests FROM placed GROUP BY request_id),
 imp AS (SELECT request_id, count(*) AS n_importers, string_agg(file, ',' ORDER BY file) FILTER (p <= 8) AS importers
   FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY file) AS p FROM importers) GROUP BY request_id)
 SELECT r.request_id, r.name, r.kind, r.file, r.start_line, r.n_candidates, {SOURCE} AS source_code, coalesce(lastc.hash, '') AS last_commit_hash,
   coalesce(n_callers, 0) AS n_callers, coalesce(n_tests, 0) AS n_tests, coalesce(n_importers, 0) AS n_importers,
   coalesce(callers, '') AS callers, coalesce(tests, '') AS tests, coalesce(importers, '') AS importers
 FROM resolved r LEFT JOIN corpus c USING (file) LEFT JOIN lastc ON lastc.file = r.file LEFT JOIN sums s ON s.request_id = r.request_id LEFT JOIN imp i ON i.request_id = r.request_id"""

# ---------------------------------------------------------------- overview
ORACLE["index_counts"] = f"WITH {DEFS} SELECT (SELECT count(*) FROM corpus) AS files, (SELECT count(*) FROM defs) AS symbols"
ORACLE["language_counts"] = f"WITH {CORPUS} SELECT language, count(*) AS files FROM corpus GROUP BY language"
ORACLE["top_languages"] = f"WITH {CORPUS}, l AS (SELECT language, count(*) AS n FROM corpus GROUP BY language ORDER BY n DESC, language LIMIT 3) SELECT string_agg(language || ' (' || n || ')', ', ' ORDER BY n DESC, language) AS languages FROM l"
MODULES = "SELECT split_part(file, '/', 1) AS module, count(DISTINCT file) AS file_count, count(*) AS symbol_count FROM defs GROUP BY 1"
ORACLE["module_summary"] = f"WITH {DEFS} {MODULES}"
ENTRIES = ", ".join(q(n) for n in ENTRY_NAMES)
ORACLE["entry_points"] = f"WITH {CORPUS} SELECT file FROM corpus WHERE regexp_extract(file, '[^/]*$') IN ({ENTRIES})"
TESTS = f"""t AS (SELECT regexp_replace(file, '/[^/]*$', '') AS dir FROM corpus WHERE lower(file) LIKE '%test%' OR lower(file) LIKE '%spec%'),
 tsum AS (SELECT count(*) AS test_files, (SELECT string_agg(dir, ', ' ORDER BY dir) FROM (SELECT DISTINCT dir FROM t ORDER BY dir LIMIT 3)) AS test_dirs,
 (SELECT count(*) FROM defs WHERE kind = 'function' AND {LOWER('name')} LIKE '{TEST_PREFIX}%') AS test_functions FROM t)"""
ORACLE["test_summary"] = f"WITH {DEFS}, {TESTS} SELECT * FROM tsum WHERE test_files > 0"
ORACLE["freshness"] = f"SELECT e AS last_indexed, round(({AS_OF_EPOCH + 3 * 86400} - e) / 3600, 1) AS age_hours, round(({AS_OF_EPOCH + 3 * 86400} - e) / 3600, 1) > 24 AS stale FROM (SELECT max(floor(epoch(ts))) AS e FROM events)"
ORACLE["project_overview"] = f"""WITH {DEFS}, {TESTS}, m AS (SELECT * FROM ({MODULES}) ORDER BY file_count DESC, module LIMIT 15), l AS (SELECT language, count(*) AS n FROM corpus GROUP BY language)
 SELECT (SELECT count(*) FROM corpus) AS files, (SELECT count(*) FROM defs) AS symbols,
 (SELECT string_agg(language || ' (' || n || ')', ', ' ORDER BY n DESC, language) FROM l) AS languages,
 (SELECT string_agg(module || ':' || file_count || '/' || symbol_count, ', ' ORDER BY file_count DESC, module) FROM m) AS modules,
 (SELECT count(*) FROM corpus WHERE regexp_extract(file, '[^/]*$') IN ({ENTRIES})) AS entry_points,
 test_files, test_functions, test_dirs FROM tsum"""

# ---------------------------------------------------------------- telemetry
EV = "ev AS (SELECT event_id AS id, event_type, ts, value, user_id AS session, (props->>'$.k')::BIGINT AS k FROM events), tools AS (SELECT * FROM ev WHERE event_type NOT IN ('signup', 'error'))"
DAY = "strftime(ts, '%Y-%m-%d')"
ORACLE["tool_summary"] = f"WITH {EV} SELECT event_type AS tool, count(*) AS call_count, coalesce(sum(k), 0)::BIGINT AS total_tokens_saved FROM tools GROUP BY 1"
ORACLE["tool_timeline"] = f"WITH {EV} SELECT {DAY} AS date, count(*) AS call_count, coalesce(sum(k), 0)::BIGINT AS tokens_saved FROM tools WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY 1"
ORACLE["index_history"] = f"WITH {EV} SELECT id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, value AS duration_ms, k AS files_indexed, k AS files_skipped, k AS symbols, k::VARCHAR AS incremental FROM ev WHERE event_type IN ('signup', 'error')"
ORACLE["savings_total"] = f"WITH {EV} SELECT coalesce(sum(k), 0)::BIGINT AS total_tokens_saved FROM tools"
ORACLE["savings_by_tool"] = f"WITH {EV} SELECT event_type AS tool, sum(k)::BIGINT AS tokens_saved FROM tools GROUP BY 1"
CUM = f"cum AS (SELECT date, (sum(s) OVER (ORDER BY date))::BIGINT AS cumulative_saved FROM (SELECT {DAY} AS date, sum(k) AS s FROM tools GROUP BY 1))"
ORACLE["savings_cumulative"] = f"WITH {EV}, {CUM} SELECT * FROM cum"
ORACLE["heatmap"] = f"""WITH {EV}, fan AS (SELECT e.k::VARCHAR AS symbol, e.id, p.p_name, p.p_type, p.p_partkey FROM ev e LEFT JOIN part p ON p.p_size = e.k WHERE e.event_type = 'view')
 SELECT symbol, count(*) AS call_count, count(DISTINCT id) AS event_count, min_by(p_name, (p_name, p_partkey)) AS file, min_by(p_type, (p_name, p_partkey)) AS kind
 FROM fan GROUP BY symbol ORDER BY call_count DESC, symbol LIMIT 20"""
ORACLE["recall_hit_rate"] = f"WITH {EV}, h AS (SELECT count(*) AS t, count(*) FILTER (k > 0) AS h FROM ev WHERE event_type = 'purchase') SELECT t AS total_calls, h AS hits, t - h AS misses, CASE WHEN t > 0 THEN round(h / t * 100, 1) ELSE 0.0 END AS hit_rate_pct FROM h"
ORACLE["response_size"] = f"WITH {EV} SELECT event_type AS tool, round(avg(k), 1) AS avg_output_tokens FROM tools GROUP BY 1"
TREND = f"trend AS (SELECT event_type AS tool, {DAY} AS date, round(avg(k), 1) AS avg FROM tools WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY GROUP BY 1, 2)"
ORACLE["response_trend"] = f"WITH {EV}, {TREND} SELECT * FROM trend"
ORACLE["response_nested"] = f"""WITH {EV}, {TREND}, m AS (SELECT event_type AS tool, round(avg(k), 1) AS avg_output_tokens FROM tools GROUP BY 1)
 SELECT tool, avg_output_tokens, count(*) AS days, string_agg(date, ',' ORDER BY date) AS dates FROM m JOIN trend USING (tool) GROUP BY 1, 2"""
ORACLE["cost_estimate"] = f"WITH {EV}, {CUM} SELECT date, cumulative_saved, round(cumulative_saved * (5 / 1000000::DOUBLE), 4) AS dollars, round(cumulative_saved / 1000)::BIGINT AS tokens_k, round(cumulative_saved / 1000, 1) AS tokens_k1 FROM cum"
ORACLE["event_metadata"] = f"""WITH {EV} SELECT id, '{{"result_count":1,"output_tokens":' || k || ',"naive_tokens":' || (k * 2) || ',"tokens_saved":' || k || ',"query":"' || event_type || '"'
 || CASE WHEN k % 3 <> 0 THEN ',"matched_files":' || (k % 3) ELSE '' END || CASE WHEN k % 2 <> 0 THEN ',"grep_overhead":' || (k % 2) ELSE '' END || '}}' AS metadata FROM ev"""
ORACLE["event_append"] = f"WITH {EV} SELECT {DAY} AS date, event_type, count(*) AS n, max(id) AS last_id FROM ev GROUP BY 1, 2"

# ---------------------------------------------------------------- economy
SIZES = "sizes AS (SELECT file, length(content) // 4 AS tokens FROM allfiles)"
ORACLE["token_estimate"] = f"WITH {ALL_FILES}, {SIZES} SELECT file, tokens FROM sizes"
ORACLE["naive_search_cost"] = f"""WITH {CALLS}, {BATCH}, {SEARCH_ALL}, {SIZES}
 SELECT query_id, count(*) AS matched_files, count(*) * 5 AS grep_overhead, (count(*) * 5 + sum(tokens))::BIGINT AS naive_tokens FROM (SELECT DISTINCT query_id, file FROM merged) JOIN sizes USING (file) GROUP BY 1"""
ORACLE["naive_resolve_cost"] = f"""WITH {SITES}, {IMPORTERS}, {SIZES}
 SELECT request_id, count(*) AS matched_files, sum(tokens)::BIGINT AS naive_tokens FROM (SELECT request_id, file FROM resolved WHERE file <> '' UNION SELECT request_id, file FROM sites UNION SELECT request_id, file FROM importers) JOIN sizes USING (file) GROUP BY 1"""
ORACLE["naive_overview_cost"] = f"WITH {ALL_FILES}, {SIZES} SELECT sum(tokens)::BIGINT AS naive_tokens FROM sizes"
SAVED = f"{EV}, sv AS (SELECT session, id, ts, k AS naive_tokens, floor(value)::BIGINT AS output_tokens, greatest(0, k - floor(value)::BIGINT) AS saved FROM ev)"
ORACLE["saved_per_call"] = f"WITH {SAVED} SELECT session, id, naive_tokens, output_tokens, saved FROM sv"
ORACLE["session_running_saved"] = f"WITH {SAVED} SELECT session, id, saved, (sum(saved) OVER (PARTITION BY session ORDER BY ts, id ROWS UNBOUNDED PRECEDING))::BIGINT AS session_saved FROM sv"

# ---------------------------------------------------------------- ledger
READS = f"""{EV}, rd AS (SELECT session, id, ts, event_type AS file, k // 20 AS h, row_number() OVER (PARTITION BY session ORDER BY ts, id) AS turn FROM ev),
 st AS (SELECT *, lag(h) OVER w AS prev FROM rd WINDOW w AS (PARTITION BY session, file ORDER BY turn)),
 st2 AS (SELECT *, CASE WHEN prev IS NULL THEN 'full' WHEN prev = h THEN 'unchanged' ELSE 'changed' END AS state FROM st),
 st3 AS (SELECT *, max(CASE WHEN state <> 'unchanged' THEN turn END) OVER (PARTITION BY session, file ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref_turn FROM st2)"""
ORACLE["read_state"] = f"WITH {READS} SELECT session, id, file, turn, state FROM st3"
ORACLE["read_ref_turn"] = f"WITH {READS} SELECT session, id, file, turn, state, coalesce(ref_turn, 0) AS ref_turn FROM st3"
# The earlier versions are made by a line in front and words replaced inside lines, so line k of a file was line k + 1 and no
# alignment is needed: position 0 is the line in front, changes are where the two texts of a position differ.
ENDED = "regexp_extract_all({}, '[^{b}]*(?:\\r\\n|[{b}])|[^{b}]+')"
_DELTA = f"""{CORPUS}, {PREVIOUS},
 pairs AS (SELECT a.file, {ENDED.format('p.content', b=BREAKS)} AS a, list_prepend('', {ENDED.format('a.content', b=BREAKS)}) AS b FROM allfiles a JOIN previous p USING (file) WHERE p.content <> a.content),
 spots AS (SELECT file, unnest(range(0, len(b))) AS p, unnest(a) AS was, unnest(b) AS now, len(b) - 1 AS n FROM pairs),
 marked AS (SELECT *, was <> now AS changed, lag(p) OVER (PARTITION BY file, was <> now ORDER BY p) AS prev FROM spots),
 opened AS (SELECT *, sum(CASE WHEN prev = p - 1 THEN 0 ELSE 1 END) OVER w AS block, sum(CASE WHEN p - prev <= 7 THEN 0 ELSE 1 END) OVER w AS hunk
  FROM marked WHERE changed WINDOW w AS (PARTITION BY file ORDER BY p ROWS UNBOUNDED PRECEDING)),
 delta AS (SELECT file, 'removed' AS side, p + 1 AS line, regexp_replace(was, '({LINE_BREAK})$', '') AS text FROM opened
  UNION ALL SELECT file, 'added', p, regexp_replace(now, '({LINE_BREAK})$', '') FROM opened WHERE p > 0),
 hunks AS (SELECT file, hunk, CASE WHEN min(p) = 0 THEN 0 ELSE greatest(min(p) - 3, 1) END AS lo, least(max(p) + 3, any_value(n)) AS hi FROM opened GROUP BY 1, 2),
 parts AS (SELECT h.file, h.hunk, s.p, s.was, s.now, s.was <> s.now AS changed FROM hunks h JOIN spots s ON s.file = h.file AND s.p BETWEEN h.lo AND h.hi),
 blocks AS (SELECT file, block, min(p) AS spot FROM opened GROUP BY 1, 2),
 printed AS (SELECT file, hunk, p AS spot, 0 AS kind, p, ' ' || now AS text FROM parts WHERE NOT changed
  UNION ALL SELECT o.file, o.hunk, b.spot, 1, o.p, '-' || was FROM opened o JOIN blocks b USING (file, block)
  UNION ALL SELECT o.file, o.hunk, b.spot, 2, o.p, '+' || now FROM opened o JOIN blocks b USING (file, block) WHERE o.p > 0),
 bodies AS (SELECT file, hunk, string_agg(text, '' ORDER BY spot, kind, p) AS body FROM printed GROUP BY 1, 2),
 sized AS (SELECT *, lo + 1 AS was_from, hi - lo + 1 AS was_n, greatest(lo, 1) AS now_from, hi - greatest(lo, 1) + 1 AS now_n FROM hunks),
 shown AS (SELECT file, hunk, '@@ -' || CASE WHEN was_n = 1 THEN was_from::VARCHAR ELSE was_from || ',' || was_n END || ' +'
  || CASE now_n WHEN 0 THEN (now_from - 1) || ',0' WHEN 1 THEN now_from::VARCHAR ELSE now_from || ',' || now_n END || ' @@' || chr(10) || body AS text FROM sized JOIN bodies USING (file, hunk)),
 unified AS (SELECT file, '--- ' || file || ' (turn 1)' || chr(10) || '+++ ' || file || ' (current)' || chr(10) || string_agg(text, '' ORDER BY hunk) AS delta FROM shown GROUP BY file)"""
ORACLE["line_delta"] = f"WITH {_DELTA} SELECT * FROM delta"
ORACLE["unified_delta"] = f"WITH {_DELTA} SELECT * FROM unified"
SENT = f"""{_DELTA}, states AS (SELECT a.file, a.language, a.content, p.file IS NULL AS fresh, p.content = a.content AS same FROM allfiles a LEFT JOIN previous p USING (file)),
 sent AS (SELECT file, language, CASE WHEN fresh THEN 'full' WHEN same THEN 'unchanged' ELSE 'changed' END AS state, CASE WHEN fresh THEN content
  WHEN same THEN '[' || file || ': unchanged since turn 1]' ELSE '[' || file || ': changed since turn 1]' || chr(10) || delta END AS content
  FROM states LEFT JOIN unified USING (file))"""
ORACLE["sent_tokens"] = f"WITH {SENT} SELECT file, state, length(content) // 4 AS output_tokens FROM sent"

# ---------------------------------------------------------------- recall and session logs
SIMS = """cells AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS x FROM embeddings),
 means AS (SELECT label, i, avg(x::DOUBLE) AS x FROM cells GROUP BY 1, 2),
 cents AS (SELECT label::BIGINT AS query_id, list(x ORDER BY i) AS q FROM means GROUP BY 1),
 sims AS (SELECT query_id, vec_id AS id, round(coalesce(list_dot_product(q, embedding::DOUBLE[]) / nullif(sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 0), 0), 4) + 0.0 AS similarity FROM cents, embeddings)"""
ORACLE["similarity_rank"] = f"WITH {SIMS} SELECT *, similarity >= 0.4 AS accepted FROM sims"
ORACLE["best_match"] = f"WITH {SIMS} SELECT * FROM sims WHERE similarity >= 0.4 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) = 1"
CONV = f"""conv AS (SELECT conv_id AS session, turn AS pos, role, text, length(text) AS n, {words('text')}[1] AS w, role = 'user' AND (conv_id + turn) % 7 = 0 AS is_result FROM conversations),
 used AS (SELECT session, pos, n % 4 AS which, w FROM conv WHERE role = 'assistant')"""
DIGEST = f"""{CONV}, firsts AS (SELECT session, min(pos) AS p FROM conv WHERE role = 'user' AND NOT is_result AND trim(text) <> '' GROUP BY 1),
 fs AS (SELECT session, string_agg(w, ',' ORDER BY p) AS files_read, count(*) AS n_files FROM (SELECT session, w, min(pos) AS p FROM used WHERE which IN (0, 1) AND w IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
 ss AS (SELECT session, string_agg(w, ',' ORDER BY p) AS symbols_resolved, count(*) AS n_symbols FROM (SELECT session, w, min(pos) AS p FROM used WHERE which = 2 AND w IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
 sid AS (SELECT session, session::VARCHAR AS session_id FROM conv WHERE pos > 0 AND role IN ('user', 'assistant') GROUP BY 1),
 digest AS (SELECT s.session, coalesce(regexp_replace(c.text, '^\\s+|\\s+$', '', 'g'), '') AS task_text, coalesce(files_read, '') AS files_read, coalesce(symbols_resolved, '') AS symbols_resolved, session_id,
   coalesce(n_files, 0) AS n_files, coalesce(n_symbols, 0) AS n_symbols
   FROM (SELECT DISTINCT session FROM conv) s LEFT JOIN firsts f USING (session) LEFT JOIN conv c ON c.session = s.session AND c.pos = f.p LEFT JOIN fs ON fs.session = s.session LEFT JOIN ss ON ss.session = s.session LEFT JOIN sid ON sid.session = s.session)"""
ORACLE["log_lines"] = """SELECT conv_id % 8 AS log, row_number() OVER (PARTITION BY conv_id % 8 ORDER BY conv_id, turn) - 1 AS pos,
 '{"conv_id":' || conv_id || ',"turn":' || turn || ',"role":"' || role || '"}' AS raw FROM conversations"""
# A word's place is given by the first eight hexadecimal digits of its MD5, its sign by the ninth.
HASHED = f"""asked AS (SELECT 0 AS side, item_id AS id, text FROM benchmark UNION ALL SELECT 1, conv_id * 1000 + turn, text FROM conversations WHERE role = 'user'),
 features AS (SELECT side, id, md5(t) AS h FROM (SELECT side, id, unnest({toks('text')}) AS t FROM asked)),
 counts AS (SELECT side, id, ('0x' || substr(h, 1, 8))::BIGINT % 384 AS place, sum(CASE WHEN ('0x' || substr(h, 9, 1))::INT % 2 = 0 THEN 1 ELSE -1 END) AS n FROM features GROUP BY 1, 2, 3),
 lengths AS (SELECT side, id, sqrt(sum(n * n)) AS len FROM counts GROUP BY 1, 2 HAVING sum(n * n) > 0),
 cells AS (SELECT side, id, place, (n / len)::FLOAT::DOUBLE AS x FROM counts JOIN lengths USING (side, id)),
 norms AS (SELECT side, id, sqrt(sum(x * x)) AS norm FROM cells GROUP BY 1, 2),
 dots AS (SELECT q.id AS query_id, m.id, sum(q.x * m.x) AS dot FROM cells q JOIN cells m ON q.side = 0 AND m.side = 1 AND q.place = m.place GROUP BY 1, 2),
 near AS (SELECT query_id, d.id, round(dot / (a.norm * b.norm), 4) + 0.0 AS similarity FROM dots d JOIN norms a ON a.side = 0 AND a.id = query_id JOIN norms b ON b.side = 1 AND b.id = d.id)"""
ORACLE["text_recall"] = f"WITH {HASHED} SELECT * FROM near WHERE similarity >= 0.05 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) = 1"
ORACLE["session_digest"] = f"WITH {DIGEST} SELECT session, task_text, files_read, symbols_resolved, session_id FROM digest"
ORACLE["session_list"] = f"WITH {DIGEST} SELECT session AS id, session_id, length(task_text) AS task_chars, n_files, n_symbols, 'success' AS outcome, 1.0::DOUBLE AS confidence FROM digest"
ORACLE["newest_sessions"] = "SELECT event_type AS project, user_id AS session, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS mtime FROM events GROUP BY 1, 2 ORDER BY max(ts) DESC, 1 DESC, 2 DESC LIMIT 30"
ORACLE["latest_session"] = "SELECT event_type AS project, user_id AS session, strftime(ts, '%Y-%m-%d %H:%M:%S') AS mtime FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, user_id DESC) = 1"
TURNS = f"""{CONV}, usage AS (SELECT *, n % 11 <> 0 AS has_usage FROM conv WHERE role = 'assistant'),
 turns AS (SELECT u.session, u.pos, coalesce((SELECT c.pos FROM conv c WHERE c.session = u.session AND c.role = 'user' AND c.pos < u.pos
     AND c.pos > coalesce((SELECT max(v.pos) FROM usage v WHERE v.session = u.session AND v.has_usage AND v.pos < u.pos), -1) ORDER BY c.pos DESC LIMIT 1), -1) AS said,
   CASE n % 4 WHEN 0 THEN 'Read' WHEN 1 THEN 'index_read' WHEN 2 THEN 'index_resolve' ELSE 'Bash' END AS tools,
   n // 4 + pos AS new_tokens, pos * 10 AS cache_read, n // 4 + pos + pos * 10 AS total_ctx, n // 8 AS out_tokens FROM usage u WHERE has_usage)"""
ORACLE["turn_pairs"] = f"""WITH {TURNS} SELECT t.session, t.pos, CASE WHEN c.pos IS NULL THEN '(no user message)' WHEN c.is_result THEN '[tool result ×1]'
  ELSE coalesce(nullif(replace(substring(c.text, 1, 120), chr(10), ' '), ''), '(no user message)') END AS user, t.tools FROM turns t LEFT JOIN conv c ON c.session = t.session AND c.pos = t.said"""
ORACLE["turn_tokens"] = f"WITH {TURNS} SELECT session, pos, new_tokens, cache_read, total_ctx, out_tokens FROM turns"
ORACLE["session_totals"] = f"WITH {TURNS} SELECT session, count(*) AS turns, sum(new_tokens)::BIGINT AS new_tokens, sum(cache_read)::BIGINT AS cache_read, sum(total_ctx)::BIGINT AS total_ctx, sum(out_tokens)::BIGINT AS out_tokens FROM turns GROUP BY 1"
ORACLE["turn_classes"] = f"WITH {TURNS} SELECT CASE WHEN tools LIKE 'index%' THEN 'indexed' ELSE 'native' END AS turn_class, count(*) AS turns, round(avg(new_tokens), 4) AS avg_new_tokens FROM turns GROUP BY 1"

# ---------------------------------------------------------------- redaction
PY_LITERAL = LITERAL["python"].replace("(?:[rRbBuU]{0,2})", "(?:[rRbBuUfF]{0,2})", 1)
FIRST_ENTITY = "list_min(list_filter([" + ", ".join(
    f"CASE WHEN regexp_matches(text, {q(p)}) THEN {{'at': strpos(text, regexp_extract(text, {q(p)})), 'i': {i}, 'e': '{e}'}} END" for i, (e, p) in enumerate(DETECTORS.items())
) + "], lambda x: x IS NOT NULL)).e"


def redacted(source: str) -> str:
    """Literal redaction of documents without multi-line literals."""
    return f"""rl AS (SELECT file, i, text, {FIRST_ENTITY} AS entity FROM (SELECT file, unnest(range(0, len(p))) AS i, unnest(p) AS text FROM (SELECT file, string_split(content, chr(10)) AS p FROM {source}))),
 rcut AS (SELECT *, regexp_extract_all(text, {q(PY_LITERAL)}) AS lits, string_split_regex(text, {q(PY_LITERAL)}) AS gaps FROM rl),
 rl2 AS (SELECT file, i, CASE WHEN entity IS NULL OR len(lits) = 0 THEN text ELSE array_to_string(list_transform(range(1, len(gaps) + 1), lambda j: gaps[j] ||
   CASE WHEN j > len(lits) THEN '' WHEN length(lits[j]) < 6 OR regexp_matches(lits[j], '^[rRbBuU]*[fF]') THEN lits[j]
   ELSE '"[REDACTED:' || regexp_replace(upper(entity), '^PRIVATE_', '') || ']"' END), '') END AS text FROM rcut),
 redacted AS (SELECT file, string_agg(text, chr(10) ORDER BY i) AS content FROM rl2 GROUP BY file)"""


KV_LINE = r"""CASE WHEN s = '' OR starts_with(s, '#') OR NOT contains(s, '=') OR regexp_replace(v, '\s+', '', 'g') = '' OR rtrim(regexp_extract(s, '^([^=]*)=', 1)) IN ('NODE_ENV', 'PORT', 'HOST', 'DEBUG', 'APP_ENV', 'LOG_LEVEL')
 THEN text ELSE rtrim(regexp_extract(s, '^([^=]*)=', 1)) || '=[REDACTED:SECRET]' END"""


def key_values(source: str) -> str:
    return f"""kl AS (SELECT file, unnest(range(0, len(p))) AS i, unnest(p) AS text FROM (SELECT file, {line_list('content')} AS p FROM {source})),
 kl2 AS (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM kl), kl3 AS (SELECT *, regexp_extract(s, '^[^=]*=((?s:.*))$', 1) AS v FROM kl2),
 kv AS (SELECT file, string_agg({KV_LINE}, chr(10) ORDER BY i) AS content FROM kl3 GROUP BY file)"""


KV = key_values("allfiles")
ORACLE["redact_sent"] = f"""WITH {SENT}, {key_values('sent')}, {redacted('sent')} SELECT s.file, CASE s.language WHEN 'fr' THEN coalesce(kv.content, '') WHEN 'en' THEN r.content ELSE s.content END AS sent
 FROM sent s LEFT JOIN kv USING (file) LEFT JOIN redacted r USING (file)"""


def literal_code(entities: list[str], allowed: str) -> str:
    """Files of one literal a line: a line goes or stays as a whole, so nothing is cut."""
    entity = "list_min(list_filter([" + ", ".join(
        f"CASE WHEN regexp_matches(line, {q(p)}) THEN {{'at': strpos(line, regexp_extract(line, {q(p)})), 'i': {i}, 'e': '{e}'}} END" for i, (e, p) in enumerate(DETECTORS.items()) if e in entities
    ) + "], lambda x: x IS NOT NULL)).e"
    ends = lambda n: "CASE lang " + " ".join(f"WHEN '{lang}' THEN {q(x[n])}" for lang, x in LITERAL_CODE.items()) + " END"
    return f"""WITH texts AS (SELECT {path('source')} AS file, lang, string_split(translate(text, {q(NOT_LITERAL)}, ''), chr(10)) AS ts, {ends(1)} AS before, {ends(2)} AS after FROM documents),
 lits AS (SELECT *, before || t || after AS line, right(before, 1) || t || left(after, 1) AS lit FROM (SELECT file, before, after, unnest(range(0, len(ts))) AS i, unnest(ts) AS t FROM texts)),
 judged AS (SELECT *, CASE WHEN length(lit) >= 6 AND NOT regexp_matches(lit, {q(allowed)}) THEN {entity} END AS entity FROM lits)
 SELECT file, string_agg(CASE WHEN entity IS NULL THEN line ELSE left(before, length(before) - 1) || '"[REDACTED:' || regexp_replace(upper(entity), '^PRIVATE_', '') || ']"' || substr(after, 2) END, chr(10) ORDER BY i) AS content
 FROM judged GROUP BY file"""


ORACLE["redact_languages"] = literal_code(list(DETECTORS), "^never$")
ORACLE["redact_policy"] = literal_code(["secret", "private_email", "private_url"], "[aeiou]{2}")
ORACLE["redact_literals"] = f"WITH {ALL_FILES}, {redacted('allfiles')} SELECT file, content FROM redacted"
ORACLE["redact_kv"] = f"WITH {ALL_FILES}, {KV} SELECT a.file, coalesce(kv.content, '') AS content FROM allfiles a LEFT JOIN kv USING (file)"
ORACLE["redact_dispatch"] = f"""WITH {ALL_FILES}, {KV}, {redacted('allfiles')} SELECT a.file, CASE a.language WHEN 'fr' THEN coalesce(kv.content, '') WHEN 'en' THEN r.content ELSE a.content END AS content
 FROM allfiles a LEFT JOIN kv USING (file) LEFT JOIN redacted r USING (file)"""
ORACLE["entity_counts"] = f"WITH {LINES}, m AS (" + " UNION ALL ".join(
    f"SELECT language, '{e}' AS entity, len(regexp_extract_all(text, {q(p)})) AS n FROM lines" for e, p in DETECTORS.items()
) + ") SELECT language, entity, sum(n)::BIGINT AS matches, count(*) AS lines FROM m WHERE n > 0 GROUP BY 1, 2"

# ---------------------------------------------------------------- SQL and streams
ORACLE["adhoc_sql"] = f"WITH {DEFS}, {IMPORTS} SELECT language, count(*) AS n, count(DISTINCT name) AS names FROM defs WHERE kind = 'class' AND name IN (SELECT symbol_name FROM imports) GROUP BY 1"
ORACLE["stream_timeline"] = f"WITH {EV} SELECT {DAY} AS date, event_type AS tool, count(*) AS call_count, sum(k)::BIGINT AS tokens_saved FROM tools GROUP BY 1, 2"
ORACLE["stream_reads"] = f"WITH {READS} SELECT session, file, turn, state, coalesce(ref_turn, 0) AS ref_turn FROM st3"
ORACLE["stream_index"] = f"WITH {DEFS}, n AS (SELECT file, count(*) AS n FROM defs GROUP BY 1) SELECT file, content_hash, len({line_list('content')}) AS line_count, coalesce(n, 0) AS symbols FROM corpus LEFT JOIN n USING (file)"
ORACLE["stream_savings"] = f"WITH {SAVED} SELECT session, sum(saved)::BIGINT AS session_saved, count(*) AS calls FROM sv GROUP BY 1"


# ---------------------------------------------------------------- code made of documents
# What the files hold by the way they are made, without reading any code: a line that imports, then eleven lines per line.
_CODE_FILES = """code AS (SELECT string_split(text, chr(10)) AS l, CASE lang WHEN 'en' THEN 'python' WHEN 'fr' THEN 'javascript' WHEN 'de' THEN 'go' WHEN 'es' THEN 'rust' END AS language,
  doc_id % 20 = 0 AS is_test,
  source || CASE WHEN lang = 'es' AND doc_id % 20 = 0 THEN '/tests/' ELSE '/' END || CASE WHEN lang = 'en' AND doc_id % 20 = 0 THEN 'test_' ELSE '' END || doc_id
  || CASE WHEN doc_id % 20 <> 0 THEN '' WHEN lang = 'fr' THEN '.test' WHEN lang = 'de' THEN '_test' ELSE '' END
  || CASE lang WHEN 'en' THEN '.py' WHEN 'fr' THEN '.js' WHEN 'de' THEN '.go' WHEN 'es' THEN '.rs' END AS file
  FROM documents WHERE lang IN ('en', 'fr', 'de', 'es') AND text IS NOT NULL),
blocks AS (SELECT file, language, n, 2 + 11 * (n - 1) AS start_line, CASE WHEN w = '' THEN 'x' ELSE w END || '_' AS callee
  FROM (SELECT file, language, unnest(range(1, len(l) + 1)) AS n, lower(regexp_extract(unnest(l), '[A-Za-z]+')) AS w FROM code))"""
_CODE_TYPES = """types(language, kind, head, tail, first, last) AS (VALUES
  ('python', 'class', 'class C', ':', 7, 9), ('python', 'method', '    def m', '(self):', 8, 9), ('javascript', 'class', 'class C', ' {', 7, 10), ('javascript', 'method', '  m', '(a) {', 8, 9),
  ('go', 'class', 'type C', ' struct {', 7, 8), ('rust', 'class', 'struct C', ' {', 7, 8), ('rust', 'function', 'fn m', '(a: i32) -> i32 {', 9, 10))"""
ORACLE["code_definitions"] = f"""WITH {_CODE_FILES}, {_CODE_TYPES} SELECT file, 'f' || n AS name, 'function' AS kind, start_line, start_line + 6 AS end_line,
  CASE language WHEN 'python' THEN 'def f' || n || '(a):' WHEN 'javascript' THEN 'function f' || n || '(a) {{' WHEN 'go' THEN 'func f' || n || '(a int) int {{' ELSE 'fn f' || n || '(a: &str) -> i32 {{' END AS signature, language FROM blocks
  UNION ALL SELECT file, right(head, 1) || n, kind, start_line + first, start_line + last, head || n || tail, language FROM blocks JOIN types USING (language)
  UNION ALL SELECT file, 'm' || n, 'method', start_line + 9, start_line + 10, 'func (c C' || n || ') m' || n || '() {{', language FROM blocks WHERE language = 'go'"""
ORACLE["code_calls"] = f"""WITH {_CODE_FILES} SELECT callee AS symbol_name, file AS caller_file, start_line + CASE language WHEN 'python' THEN 6 ELSE 5 END AS line,
  CASE language WHEN 'python' THEN '    ' ELSE '  ' END || 'return ' || callee || '(q, "x(")' || CASE WHEN language IN ('javascript', 'rust') THEN ';' ELSE '' END AS context, callee AS full_name FROM blocks"""
ORACLE["code_imports"] = f"""WITH {_CODE_FILES} SELECT CASE language WHEN 'rust' THEN 'use lib::tool;' ELSE 'tool' END AS symbol_name, file,
  CASE language WHEN 'python' THEN 'from lib import tool' WHEN 'javascript' THEN 'import {{ tool }} from ' || chr(39) || 'lib/*x' || chr(39) WHEN 'go' THEN 'import "lib/*/tool"' ELSE 'use lib::tool;' END AS import_line FROM code"""
ORACLE["code_test_files"] = f"WITH {_CODE_FILES} SELECT file, language, is_test FROM code"
