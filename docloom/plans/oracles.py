"""DuckDB SQL for the queries of ``queries``, built from a few shared table expressions."""

from __future__ import annotations

from ..functions.text import LINK, SPACE
from ..sources import corpora
from .queries import HEAD, QUESTION, TENANT, TODAY, TOPIC

ORACLES: dict[str, str] = {}

HALF = "(SELECT (max(event_id) + 1) // 2 FROM events)"
WS = SPACE
# Patterns of the document format (fixed values).
FM = r"^---[ \t]*\r?\n((?s:.*?))\r?\n---[ \t]*(?:\r?\n|$)"
HEADING = r"(?m)^#{1,6}[ \t]+([^\n\r]+?)[ \t]*$"

DOCS = f"docs AS ({corpora.PLAIN})"
CAT = f"cat AS ({corpora.CATALOG})"
CHAT = f"chat AS ({corpora.CHAT_DUCK})"
CON = f"con AS (SELECT * FROM cat WHERE lower(regexp_extract(path, '[^/]*$')) NOT IN ('index.md', 'log.md') AND NOT regexp_matches(path, '(^|/)\\.'))"


def _body(source: str = "source") -> str:
    return f"substr({source}, len(regexp_extract({source}, '{FM}', 0)) + 1)"


def _field(k: str) -> str:
    return f"trim(regexp_extract(head, '(?:^|\\n){k}:[ \\t]+([^\\n\\r]*)', 1), ' ' || chr(9)) AS {k}"


def _flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'))"


def _cell(x: str) -> str:
    return f"coalesce(nullif({_flat(x)}, ''), '-')"


def _slug(x: str, empty: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace(lower({x}), '[^a-z0-9]+', '_', 'g'), '_'), ''), '{empty}')"


def _cut(x: str, width: int) -> str:
    kept = f"CASE WHEN position(' ' IN reverse(left({x}, {width}))) > 0 AND {width} - position(' ' IN reverse(left({x}, {width}))) > {width} / 2.0 THEN left({x}, {width} - position(' ' IN reverse(left({x}, {width})))) ELSE left({x}, {width}) END"
    return f"CASE WHEN len({x}) <= {width} THEN {x} ELSE regexp_replace({kept}, '[{WS}]+$', '') || '…' END"


def _sentence(body: str) -> str:
    line = f"coalesce(list_filter(string_split(regexp_replace({body}, '(?m)^```[\\s\\S]*?^```[ \\t]*$', '', 'g'), chr(10)), lambda l: NOT regexp_matches(l, '^[{WS}]*$') AND NOT regexp_matches(l, '^[{WS}]*(?:#|>|<!--|!\\[|\\||-{{3,}}|={{3,}})'))[1], '')"
    return f"(SELECT regexp_replace(CASE WHEN s <> '' THEN s ELSE l END, '^[{WS}]+|[{WS}]+$', '', 'g') FROM (SELECT l, regexp_extract(l, '^((?s:.*?)[.!?])(?:[{WS}]|$)', 1) AS s FROM (SELECT {line} AS l)))"


PARSED = ", ".join(
    [
        CAT,
        CON,
        f"split AS (SELECT *, regexp_extract(source, '{FM}', 1) AS head, {_body()} AS body FROM con)",
        f"parsed AS (SELECT bundle, path, source, body, len(body) <> len(source) AS conformant, {', '.join(_field(k) for k in ('type', 'title', 'description', 'status', 'grain', 'stale_after'))}, regexp_matches(head, '(?:^|\\n)stale_after:') AS has_stale FROM split)",
    ]
)

IDS = """n3 AS (SELECT bundle, path, regexp_replace(path, '(?i)\\.md$', '') AS c3 FROM con),
n2 AS (SELECT *, regexp_extract(c3, '[^/]*$') AS c1, regexp_extract(c3, '(?:[^/]*/)?[^/]*$') AS c2 FROM n3),
n1 AS (SELECT *, count(*) OVER (PARTITION BY bundle, c1) AS k1, count(*) OVER (PARTITION BY bundle, c2) AS k2 FROM n2),
lid AS (SELECT bundle, path, CASE WHEN k1 = 1 THEN c1 WHEN k2 = 1 THEN c2 ELSE c3 END AS local_id FROM n1),
ids AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY local_id) > 1 THEN bundle || '/' || local_id ELSE local_id END AS id FROM lid)"""


def _resolve(target: str, path: str) -> str:
    return f"""(SELECT CASE WHEN {target} LIKE '#%' OR regexp_matches({target}, '(?i)^[a-z][a-z0-9+.-]*:') OR p = '' THEN NULL
  WHEN regexp_matches(j, '(?i)\\.md$') THEN j ELSE j || '.md' END FROM (SELECT p, array_to_string(list_reduce(list_transform(string_split(
    CASE WHEN p LIKE '/%' THEN '' ELSE regexp_extract({path}, '^((?:.*/)?)[^/]*$', 1) END || p, '/'), lambda s: [s]),
    lambda a, b: CASE WHEN b[1] IN ('', '.') THEN a WHEN b[1] = '..' THEN a[1:len(a) - 1] ELSE list_concat(a, b) END, []::VARCHAR[]), '/') AS j
  FROM (SELECT regexp_extract(url_decode(replace({target}, '+', '%2B')), '^([^#?]*)', 1) AS p)))"""


LINKS = f"""raw AS (SELECT bundle, path, unnest(regexp_extract_all(body, '{LINK}', 1)) AS target FROM parsed),
aim AS (SELECT *, {_resolve("target", "path")} AS resolved FROM raw),
lnk AS (SELECT a.*, i.id AS target_id FROM aim a LEFT JOIN ids i ON i.bundle = a.bundle AND i.path = a.resolved WHERE resolved IS NOT NULL),
own AS (SELECT bundle, path, list_sort(list(DISTINCT target_id) FILTER (target_id IS NOT NULL AND resolved <> path)) AS links, list_sort(list(DISTINCT target) FILTER (target_id IS NULL)) AS broken FROM lnk GROUP BY bundle, path)"""

FULL = f"""{PARSED}, {IDS}, {LINKS},
cells AS (SELECT bundle, path, {_slug("type", "-")} AS kind, {_cell("status")} AS st, {_cell("grain")} AS grain,
  {_cell(f"CASE WHEN description <> '' THEN description ELSE {_sentence('body')} END")} AS long,
  CASE WHEN conformant THEN {_flat("title")} ELSE CASE WHEN regexp_matches(body, '{HEADING}') AND NOT (position('```' IN body) > 0 AND position('```' IN body) < position(regexp_extract(body, '{HEADING}', 0) IN body)) THEN {_flat(f"regexp_extract(body, '{HEADING}', 1)")} ELSE '' END END AS title,
  regexp_extract(trim(stale_after), '^(\\d{{4}}-\\d{{2}}-\\d{{2}})$', 1) AS stale_after, body, conformant, has_stale FROM parsed),
concept AS MATERIALIZED (SELECT c.* EXCLUDE (st, long), CASE WHEN lower(st) = 'current' THEN '-' ELSE st END AS status, {_cut("long", 120)} AS summary, i.local_id, i.id,
  coalesce(o.links, []) AS links, coalesce(o.broken, []) AS broken
  FROM cells c JOIN ids i ON i.bundle = c.bundle AND i.path = c.path LEFT JOIN own o ON o.bundle = c.bundle AND o.path = c.path)"""

LINK_CELL = "CASE WHEN len(links) = 0 THEN '-' ELSE array_to_string(links, ' ') END"
STALE = f"CASE WHEN status = '-' AND stale_after <> '' AND stale_after < '{TODAY}' THEN 'stale' ELSE status END"
MANIFEST = f"{FULL}, man AS (SELECT id, bundle, kind, {STALE} AS status, grain, summary, {LINK_CELL} AS links FROM concept)"
LINE = "concat_ws(chr(9), id, bundle, kind, status, grain, summary, links)"


def put(name: str, ctes: str, select: str) -> None:
    ORACLES[name] = (f"WITH {ctes} {select}" if ctes else select).strip()


put("concept_paths", f"{CAT}, {CON}", "SELECT bundle, path FROM con")
put("discover_bundles", f"{DOCS}, {CAT}", "SELECT bundle FROM docs UNION SELECT bundle FROM cat")
VALID = "(len({0}) <= 200 AND regexp_matches({0}, '(?i)^[a-z0-9][a-z0-9._-]*(?:/[a-z0-9][a-z0-9._-]*)*$') AND regexp_matches({0}, '(?i)\\.md$'))"
put("bundle_paths", CAT, f"SELECT bundle, path, {VALID.format('path')} AS valid FROM cat WHERE regexp_matches(path, '(?i)\\.md$')")
put("list_source", f"{CAT}, {CON}, {IDS}", "SELECT c.bundle, c.path, octet_length(encode(c.source))::BIGINT AS bytes, sha256(c.source) AS hash, i.id FROM cat c LEFT JOIN ids i ON i.bundle = c.bundle AND i.path = c.path")
put("read_source", CAT, "SELECT source AS content, sha256(source) AS hash FROM cat WHERE bundle = 'geo' AND path = 'nations/3.md'")
put("bodies", FULL, "SELECT id, body FROM concept")
put("content_hash", DOCS, "SELECT path, sha256(source) AS hash FROM docs")
put("validate_paths", "p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '^[a-z]+://', '') AS path FROM pages), s AS (SELECT page_id, unnest([path, path || '.md', regexp_extract(path, '^([^?#]*)', 1) || '.md']) AS path FROM p)", f"SELECT page_id, path, {VALID.format('path')} AS valid FROM s")
put("parse_frontmatter", f"{CAT}, split AS (SELECT *, regexp_extract(source, '{FM}', 1) AS head, {_body()} AS body FROM cat)", f"SELECT bundle, path, {', '.join(_field(k) for k in ('type', 'title', 'description', 'status', 'grain', 'stale_after'))}, body FROM split")
put("conformance", f"{CAT}, {DOCS}, u AS (SELECT bundle, source FROM cat UNION ALL SELECT bundle, source FROM docs)", f"SELECT bundle, regexp_matches(source, '{FM}') AS conformant, count(*) AS n FROM u GROUP BY 1, 2")
put("normalize_kind", "", f"SELECT p_partkey, {_slug(chr(40) + 'p_name || chr(32) || chr(47) || chr(32) || p_brand || chr(32) || chr(32) || p_type' + chr(41), '-')} AS kind FROM part")
put("sanitize_cell", DOCS, f"SELECT path, {_cell('source')} AS cell FROM docs")
put("truncate_summary", f"{DOCS}, c AS (SELECT path, {_cell('source')} AS x FROM docs)", f"SELECT path, {_cut('x', 80)} AS summary FROM c")
put("first_sentence", f"{DOCS}, {CAT}, u AS (SELECT * FROM docs UNION ALL SELECT * FROM cat), b AS (SELECT bundle, path, {_body()} AS body FROM u)", f"SELECT bundle, path, {_sentence('body')} AS sentence FROM b")
put("derive_summary", FULL, "SELECT bundle, path, summary FROM concept")
put("status_cell", FULL, "SELECT bundle, path, status FROM concept")
put("stale_after", FULL, "SELECT bundle, path, stale_after FROM concept")
put("heading_title", f"{CAT}, b AS (SELECT bundle, path, {_body()} AS body FROM cat)", f"SELECT bundle, path, CASE WHEN position('```' IN body) > 0 AND position('```' IN body) < position(regexp_extract(body, '{HEADING}', 0) IN body) THEN '' ELSE {_flat(f"regexp_extract(body, '{HEADING}', 1)")} END AS title FROM b")
put("slugify", "", f"SELECT page_id, {_slug("regexp_extract(html, '<title>([^<]*)</title>', 1)", 'body')} AS slug FROM pages")
put("estimate_tokens", DOCS, "SELECT path, ceil(len(source) / 4.0)::BIGINT AS tokens FROM docs")
put("stale_demotion", FULL, f"SELECT bundle, path, {STALE} AS status FROM concept")
put("derive_ids", f"{CAT}, {CON}, {IDS}", "SELECT bundle, path, local_id FROM lid")
put("ambiguous_ids", DOCS, "SELECT bundle, split_part(path, '/', 1) AS local_id, count(*) AS n FROM docs GROUP BY 1, 2 HAVING count(*) > 1")
put("global_ids", f"{CAT}, {CON}, {IDS}", "SELECT bundle, path, local_id, id FROM ids")
put("extract_links", CAT, f"SELECT bundle, path, (i - 1)::INT AS at, t[i] AS target FROM (SELECT bundle, path, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT bundle, path, regexp_extract_all(source, '{LINK}', 1) AS t FROM cat))")
put("resolve_target", f"{CAT}, r AS (SELECT bundle, path, unnest(regexp_extract_all(source, '{LINK}', 1)) AS target FROM cat)", f"SELECT bundle, path, target, {_resolve('target', 'path')} AS resolved FROM r")
put("resolve_links", FULL, "SELECT bundle, path, array_to_string(links, ' ') AS links, array_to_string(broken, ' ') AS broken FROM concept")
put("broken_links", FULL, "SELECT DISTINCT bundle, path, target FROM lnk WHERE target_id IS NULL")
put("global_links", FULL, "SELECT id AS src_id, unnest(links) AS dst_id FROM concept")
put(
    "diagnostics",
    FULL,
    """SELECT bundle, path, 'warn' AS level, unnest(list_concat(list_concat(
  CASE WHEN NOT conformant THEN ['no frontmatter, compiled as plain markdown, not an OKF concept'] WHEN kind = '-' THEN ['missing required frontmatter field "type"'] ELSE [] END,
  list_transform(broken, lambda t: 'unresolved link "' || t || '"')),
  CASE WHEN has_stale AND stale_after = '' THEN ['stale_after is not a date (YYYY-MM-DD), ignored'] ELSE [] END)) AS message FROM concept""",
)
put("manifest", MANIFEST, "SELECT * FROM man")
put("manifest_bundle", MANIFEST, "SELECT * FROM man WHERE bundle = 'geo'")
put(
    "serialize",
    FULL,
    f"SELECT bundle, local_id, concat_ws(chr(9), local_id, kind, status, grain, summary, {LINK_CELL}) || chr(10) AS line FROM concept UNION ALL SELECT DISTINCT bundle, '', '# bundle: ' || bundle || chr(10) || concat_ws(chr(9), 'id', 'kind', 'status', 'grain', 'summary', 'links') || chr(10) FROM concept",
)
put("serialize_tenant", MANIFEST, f"SELECT bundle, id, {LINE} || chr(10) AS line FROM man")
put("parse_manifest", MANIFEST, "SELECT id, bundle, kind, status, (CASE WHEN links = '-' THEN 0 ELSE len(string_split(links, ' ')) END)::INT AS n_links FROM man")
_PRE = f"# tenant: {TENANT}\n# bundles: geo sales supply\n" + "\t".join(["id", "bundle", "kind", "status", "grain", "summary", "links"]) + "\n"
put(
    "manifest_advice",
    f"{MANIFEST}, s AS (SELECT count(*) AS n, sum(len({LINE}) + 1) AS chars FROM man), t AS (SELECT *, ceil((chars + {len(_PRE)}) / 4.0)::BIGINT AS k FROM s), u AS (SELECT *, 10 ** greatest(len(k::VARCHAR) - 2, 0) AS unit FROM t)",
    f"SELECT 'This tenant''s manifest measures ~' || format('{{:,}}', (round(k / unit) * unit)::BIGINT) || CASE WHEN chars + {len(_PRE)} > 20 * (120 + {len(_PRE.splitlines()[-1])} + chars / n * least(16, n)) THEN ' tokens; prefer \"search\" over reading it whole.' ELSE ' tokens; reading it whole is cheaper than searching.' END AS advice FROM u",
)
put(
    "split_sections",
    f"""{CAT}, {CHAT}, u AS (SELECT bundle || '/' || path AS id, {_body()} AS body FROM (SELECT * FROM cat UNION ALL SELECT * FROM chat)),
l AS (SELECT id, body, string_split(body, chr(10)) AS t FROM u), e AS (SELECT id, body, i, t[i] AS line FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM l)),
o AS (SELECT *, (sum(len(line) + 1) OVER w - len(line) - 1)::INT AS off, sum((line LIKE '```%')::INT) OVER w AS fences FROM e WINDOW w AS (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING)),
h AS (SELECT id, body, off, {_slug("regexp_extract(line, '^#{1,6}[ \t]+(.+?)[ \t]*$', 1)", "body")} AS slug FROM o WHERE fences % 2 = 0 AND regexp_matches(line, '^#{{1,6}}[ \t]+(.+?)[ \t]*$')),
m AS (SELECT *, row_number() OVER (PARTITION BY id, slug ORDER BY off) + (slug = 'body')::INT AS k, coalesce(lead(off) OVER (PARTITION BY id ORDER BY off), len(body)) AS stop FROM h),
f AS (SELECT u.id, u.body, coalesce(min(h.off), len(u.body)) AS first FROM u LEFT JOIN h ON h.id = u.id GROUP BY u.id, u.body)""",
    f"""SELECT id, CASE WHEN k = 1 THEN slug ELSE slug || '_' || k END AS name, off AS start, stop::INT AS "end" FROM m
UNION ALL SELECT id, 'body', 0, first::INT FROM f WHERE NOT regexp_matches(left(body, first), '^[{WS}]*$')""",
)
put("get_batch", FULL, "SELECT r.rank, id, body FROM concept JOIN (VALUES (0, 'nations/3'), (1, '14000'), (2, 'nope'), (3, 'regions/1')) r(rank, want) ON id = want")
put("get_section", FULL, "SELECT id, '# Schema' || chr(10) || CASE WHEN id = 'regions/1' THEN 'Key 1.' || chr(10) ELSE '```sql' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) END AS text FROM concept WHERE id IN ('regions/1', 'nations/7')")
put("get_missing", FULL, "SELECT w.id FROM (VALUES ('regions/1'), ('nope'), ('none')) w(id) WHERE NOT EXISTS (SELECT 1 FROM concept c WHERE c.id = w.id)")
put("get_slice", DOCS, 'SELECT path AS id, substr(source, least(100, len(source)) + 1, 60) AS text, least(100, len(source))::INT AS start, least(160, len(source))::INT AS "end", len(source)::INT AS total FROM docs')


def _offsets(text: str, needle: str) -> str:
    """CTE f(path, source, o): offsets of ``needle`` in lower case."""
    n = len(needle)
    return f"""{DOCS}, sp AS (SELECT path, source, string_split(lower(source), '{needle.lower()}') AS t FROM docs),
f AS (SELECT path, source, list_transform(range(1, len(t)), lambda i: list_sum(list_transform(t[1:i], lambda x: len(x)))::BIGINT + (i - 1) * {n}) AS o FROM sp)"""


put("find_matches", _offsets("source", "tion the"), "SELECT path, len(o)::INT AS match_count, array_to_string(o[1:20], ' ') AS matches FROM f")
put(
    "find_window",
    f"{_offsets('source', 'Er The')}, w AS (SELECT *, CASE WHEN len(o) > 0 THEN least(len(source), greatest(0, o[1] - 97) + 200) ELSE 0 END AS stop FROM f)",
    'SELECT path AS id, substr(source, greatest(0, stop - 200) + 1, stop - greatest(0, stop - 200)) AS text, greatest(0, stop - 200)::INT AS start, stop::INT AS "end", len(source)::INT AS total, len(o)::INT AS match_count FROM w',
)
put("render_concepts", DOCS, "SELECT path AS id, '@@ ' || path || CASE WHEN len(source) > 80 THEN ' [0..80 of ' || len(source) || ']' ELSE '' END || CASE WHEN source = '' THEN '' ELSE chr(10) || left(source, 80) END AS chunk FROM docs")


def _terms(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({x})), '[\\p{{L}}\\p{{N}}]+')"


def _ask(query: str) -> list[str]:
    return list(dict.fromkeys(query.split()))


PLAIN_TF = f"{DOCS}, tok AS (SELECT path AS id, unnest({_terms('source')}) AS term FROM docs), tf AS (SELECT term, id, count(*)::BIGINT AS tf FROM tok GROUP BY 1, 2)"
PLAIN_DL = f"dl AS (SELECT path AS id, len({_terms('source')})::BIGINT AS dl FROM docs)"
PARTS = f"{FULL}, part3 AS (SELECT id, {_terms('body')} AS b, {_terms("concat_ws(' ', bundle, kind, status, grain, summary)")} AS f, {_terms("concat_ws(' ', id, nullif(title, ''))")} AS n FROM concept)"
CAT_TF = f"{PARTS}, tok AS (SELECT id, unnest(b) AS term, 1 AS w FROM part3 UNION ALL SELECT id, unnest(f), 2 FROM part3 UNION ALL SELECT id, unnest(n), 4 FROM part3), tf AS (SELECT term, id, sum(w)::BIGINT AS tf FROM tok GROUP BY 1, 2)"
CAT_DL = "dl AS (SELECT id, (len(b) + 2 * len(f) + 4 * len(n))::BIGINT AS dl FROM part3)"


def _scored(query: str) -> str:
    terms = ", ".join(f"'{t}'" for t in _ask(query))
    return f"""st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean FROM dl),
q AS (SELECT * FROM tf WHERE term IN ({terms})), df AS (SELECT term, count(*) AS df FROM q GROUP BY term),
part AS (SELECT q.id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS part FROM q JOIN df USING (term) JOIN dl USING (id), st),
score AS (SELECT id, round(list_sum(list_sort(list(part))), 9) AS score FROM part GROUP BY id)"""


RANKED = "SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM score{} ORDER BY score DESC, id LIMIT 8"
put("tokenize", DOCS, f"SELECT path, array_to_string({_terms('source')}, ' ') AS terms FROM docs")
put("postings", PLAIN_TF, "SELECT * FROM tf")
put("index_build", f"{PLAIN_TF}, {PLAIN_DL}", "SELECT * FROM tf JOIN dl USING (id)")
put("term_frequencies", CAT_TF, "SELECT * FROM tf")
put("doc_lengths", f"{PARTS}, {CAT_DL}", "SELECT * FROM dl")
put("doc_frequency", PLAIN_TF, "SELECT term, count(*) AS df FROM tf GROUP BY term")
put("bm25_search", f"{PLAIN_TF}, {PLAIN_DL}, {_scored(TOPIC)}", RANKED.format(""))
put("search_bundle", f"{PLAIN_TF}, {PLAIN_DL}, {_scored(TOPIC)}", RANKED.format(" WHERE id IN (SELECT path FROM docs WHERE bundle = 'src3')"))
put("baseline_search", f"{CAT}, docs AS (SELECT bundle || '/' || path AS path, source FROM cat), {PLAIN_TF[len(DOCS) + 2 :]}, {PLAIN_DL}, {_scored(QUESTION)}", RANKED.format(""))
SEARCH = f"{CAT_TF}, {CAT_DL}, {_scored(QUESTION)}"
HITS = f"hits AS MATERIALIZED ({RANKED.format('{}')})"
EXPAND = """tgt AS MATERIALIZED (SELECT t || '' AS t, count(*) AS inbound, min(rank) AS first FROM (SELECT h.rank, unnest(c.links) AS t FROM hits h JOIN concept c USING (id)) GROUP BY 1),
ex AS MATERIALIZED (SELECT k.id, inbound, first FROM tgt JOIN (SELECT id FROM concept{}) k ON k.id = t LEFT JOIN hits h ON h.id = t WHERE h.id IS NULL ORDER BY inbound DESC, first, k.id LIMIT 8)"""


def _window(text: str, query: str) -> str:
    """CTEs to win(id, pos): where the densest window begins; ``text``(id, body) is given."""
    words = ", ".join(f"'{w}'" for w in _ask(query.lower()))
    return f"""wd AS (SELECT unnest([{words}]) AS word), ws AS (SELECT id, body, word, string_split(lower(body), word) AS t FROM {text}, wd WHERE position(word IN lower(body)) > 0),
occ AS (SELECT id, word, (list_sum(list_transform(t[1:i], lambda x: len(x))) + (i - 1) * len(word))::BIGINT AS a FROM (SELECT *, unnest(range(1, len(t))) AS i FROM ws)),
hit AS (SELECT o.id, word, a, a + len(word) AS z FROM occ o JOIN {text} x ON x.id = o.id
  WHERE (a = 0 OR NOT regexp_matches(substr(lower(body), a, 1), '[\\p{{L}}\\p{{N}}]')) AND NOT regexp_matches(substr(lower(body), a + len(word) + 1, 1), '^[\\p{{L}}\\p{{N}}]')),
den AS (SELECT p.id, p.a, count(DISTINCT q.word) AS d, max(q.z) AS z FROM hit p JOIN hit q ON q.id = p.id AND q.a >= p.a AND q.z <= p.a + 2000 GROUP BY p.id, p.a),
win AS (SELECT x.id, least(greatest(0, a - greatest(0, (2000 - (z - a)) // 2)), greatest(0, len(body) - 2000))::INT AS pos
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d DESC, a) AS r FROM den) d JOIN {text} x ON x.id = d.id WHERE r = 1)"""


ROW = f"c.id, bundle, kind, status, grain, summary, {LINK_CELL} AS links"
put("search_rows", f"{SEARCH}, {HITS.format('')}, ht AS (SELECT c.id, c.body FROM concept c JOIN hits USING (id)), {_window('ht', QUESTION)}", f"SELECT {ROW}, coalesce(pos::VARCHAR, '-') AS pos FROM concept c JOIN hits h ON h.id = c.id LEFT JOIN win w ON w.id = c.id")
put("search_expand", f"{SEARCH}, {HITS.format('')}, {EXPAND.format('')}", "SELECT * FROM ex")
put(
    "search_tenant",
    f"{SEARCH}, {HITS.format(' WHERE id IN (SELECT id FROM concept WHERE bundle = ' + chr(39) + 'geo' + chr(39) + ')')}, {EXPAND.format(' WHERE bundle = ' + chr(39) + 'geo' + chr(39))}, ht AS (SELECT c.id, c.body FROM concept c JOIN hits USING (id)), {_window('ht', QUESTION)}",
    f"""SELECT 0 AS "group", {ROW}, coalesce(pos::VARCHAR, '-') AS pos FROM concept c JOIN hits h ON h.id = c.id LEFT JOIN win w ON w.id = c.id
UNION ALL SELECT 1, {ROW}, '-' FROM concept c JOIN ex e ON e.id = c.id""",
)
put("best_window", f"{DOCS}, ht AS (SELECT path AS id, source AS body FROM docs), {_window('ht', TOPIC)}", "SELECT d.path, pos FROM docs d LEFT JOIN win ON win.id = d.path")
put(
    "retrieval_eval",
    f"""{PLAIN_TF}, {PLAIN_DL}, st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean FROM dl),
it AS (SELECT item_id AS qid, text FROM benchmark WHERE text <> ''),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
known AS (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY df, term) AS r FROM (SELECT qid, unnest(list_distinct({_terms("text")})) AS term FROM it) JOIN df USING (term)),
ask AS (SELECT qid, term FROM known WHERE r <= 8),
q AS (SELECT a.qid, t.* FROM tf t JOIN ask a USING (term)),
part AS (SELECT qid, q.id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) AS part FROM q JOIN df USING (term) JOIN dl USING (id), st),
score AS (SELECT qid, id, round(list_sum(list_sort(list(part))), 9) AS score FROM part GROUP BY qid, id),
res AS (SELECT * FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM score) WHERE rank < 8),
want AS (SELECT qid, path AS id FROM docs, it WHERE contains(source, text)),
best AS (SELECT w.qid, min(rank) AS rank FROM want w LEFT JOIN res r ON r.qid = w.qid AND r.id = w.id GROUP BY w.qid)""",
    "SELECT count(*) AS n_questions, round(avg((rank IS NOT NULL)::INT), 9) AS hit_rate, round(avg(coalesce(1.0 / (rank + 1), 0)), 9) AS mrr FROM best",
)
put("bundle_counts", DOCS, "SELECT bundle, count(*) AS n_documents, sum(octet_length(encode(source)))::BIGINT AS bytes FROM docs GROUP BY bundle")
put("snapshot_stats", CAT, "SELECT count(*) AS n_documents, count(DISTINCT bundle) AS n_bundles, sum(octet_length(encode(source)))::BIGINT AS bytes, sum(ceil(len(source) / 4.0)::BIGINT)::BIGINT AS tokens FROM cat")
put("session_billing", "c AS (SELECT conv_id AS session, turn, ceil(len(coalesce(text, '')) / 4.0)::BIGINT AS tokens FROM conversations)", "SELECT *, round(tokens + 0.1::DOUBLE * coalesce(sum(tokens) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS billed FROM c")

LOG = "log AS (SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'write' END AS op, 'b' || (user_id % 7)::VARCHAR AS bundle, 'users/' || user_id::VARCHAR || '.md' AS path, '# ' || event_type || chr(10) || props || chr(10) AS content FROM events)"


def _state(name: str, where: str = "TRUE") -> str:
    return f"{name} AS (SELECT bundle, path, content AS source FROM (SELECT *, row_number() OVER (PARTITION BY bundle, path ORDER BY seq DESC) AS r FROM log WHERE {where}) WHERE r = 1 AND op = 'write')"


CHANGES = f"""{LOG}, {_state("base", f"seq < {HALF}")},
late AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bundle, path ORDER BY seq DESC) AS r FROM log WHERE seq >= {HALF}) WHERE r = 1),
chg AS (SELECT op, l.bundle, l.path, CASE WHEN op = 'write' THEN content END AS content, CASE WHEN seq % 3 = 0 THEN sha256('other') ELSE sha256(b.source) END AS replaces FROM late l LEFT JOIN base b ON b.bundle = l.bundle AND b.path = l.path)"""
put(
    "validate_transaction",
    f"""{LOG}, r AS (SELECT seq // 100 AS batch, lower(bundle || '/' || path) AS key, octet_length(encode(content)) AS bytes, CASE WHEN op = 'delete' AND seq % 5 = 0 THEN 'delete needs the hash it replaces' END AS bad FROM log),
k AS (SELECT batch, key, count(*) AS n, sum(bytes) AS bytes, min(bad) AS bad FROM r GROUP BY 1, 2)""",
    "SELECT batch, sum(n)::BIGINT AS n_changes, sum(bytes)::BIGINT AS bytes, sum((n > 1)::INT)::BIGINT AS n_duplicates, CASE WHEN sum((n > 1)::INT) > 0 THEN 'duplicate path' ELSE min(bad) END AS problem FROM k GROUP BY batch",
)
put("preconditions", CHANGES, "SELECT c.bundle, c.path, op, CASE WHEN replaces IS NULL AND b.source IS NOT NULL THEN 'exists' WHEN replaces IS NOT NULL AND b.source IS NULL THEN 'missing' WHEN replaces <> sha256(b.source) THEN 'changed' END AS problem FROM chg c LEFT JOIN base b ON b.bundle = c.bundle AND b.path = c.path")
put("apply_changes", CHANGES, "SELECT bundle, path, source FROM base b WHERE NOT EXISTS (SELECT 1 FROM chg c WHERE c.bundle = b.bundle AND c.path = b.path) UNION ALL SELECT bundle, path, content FROM chg WHERE op = 'write'")
put("merge_incremental", DOCS, "SELECT bundle, path, sha256(CASE WHEN bundle = 'src1' THEN 'new ' || source ELSE source END) AS hash FROM docs")
put("delete_bundle", DOCS, "SELECT bundle, count(*) AS n_documents, sum(octet_length(encode(source)))::BIGINT AS bytes FROM docs WHERE bundle <> 'src2' GROUP BY bundle")
put("bundle_union", f"{CAT}, {LOG}", "SELECT bundle, max(t) = 1 AS touched FROM (SELECT bundle, 0 AS t FROM cat UNION ALL SELECT bundle, 1 FROM log) GROUP BY bundle")
put("restore_as_of", f"{LOG}, {_state('base', f'seq < {HALF}')}", "SELECT * FROM base")


def _digest(docs: str) -> str:
    """The digest of a set of documents, as a scalar subquery."""
    each = f"SELECT substr(sha256(bundle || '/' || path), 1, 3) AS leaf, sha256(bundle || '/' || path || chr(10) || sha256(source)) AS h FROM {docs}"
    return f"(SELECT sha256(string_agg(leaf || ':' || told, ',' ORDER BY leaf)) FROM (SELECT leaf, sha256(string_agg(h, ',' ORDER BY h)) AS told FROM ({each}) GROUP BY leaf))"


put(
    "snapshot_digest",
    CAT,
    f"SELECT {_digest('cat')} AS digest",
)
put(
    "watch_bursts",
    "e AS (SELECT user_id, ts, coalesce(date_diff('microsecond', lag(ts) OVER w, ts) >= 21600000000, TRUE) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)",
    'SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM g GROUP BY user_id, k',
)
put("watch_replay", "", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
REV = "rev AS (SELECT strftime(day, '%Y%m%d') AS revision, CASE WHEN day > DATE '2024-01-01' THEN strftime(day - 1, '%Y%m%d') END AS parent, sha256(n::VARCHAR) AS snapshot, strftime(day, '%Y-%m-%d') AS created FROM (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1))"
CHAIN = f"RECURSIVE {REV}, chain AS (SELECT revision, 0 AS depth FROM rev WHERE revision = '{HEAD}' UNION ALL SELECT r.parent, c.depth + 1 FROM chain c JOIN rev r ON r.revision = c.revision WHERE r.parent IS NOT NULL), anc AS (SELECT r.*, c.depth FROM chain c JOIN rev r ON r.revision = c.revision)"
put("history_page", CHAIN, "SELECT revision, parent, created, depth::BIGINT AS depth FROM anc WHERE depth >= 5 ORDER BY depth LIMIT 20")
put("gc_retain", CHAIN, "SELECT revision, snapshot FROM anc WHERE depth < 10")
put("gc_candidates", CHAIN, "SELECT DISTINCT snapshot AS name FROM rev WHERE snapshot NOT IN (SELECT snapshot FROM anc WHERE depth < 10)")
COPIES = f"""{CAT}, s AS (SELECT bundle, path, source, coalesce(try_cast(regexp_extract(path, '(\\d+)', 1) AS BIGINT), len(path)) AS k FROM cat),
p AS (SELECT bundle, path, sha256(source) AS hash FROM s WHERE k % 11 <> 0),
f AS (SELECT bundle, path, sha256(CASE WHEN k % 5 = 0 THEN source || 'folder' ELSE source END) AS hash FROM s WHERE k % 13 <> 0),
d AS (SELECT bundle, path, sha256(CASE WHEN k % 7 = 0 AND k % 35 <> 0 THEN source || 'database' ELSE source END) AS hash FROM s WHERE k % 17 <> 0)"""
put(
    "import_three_way",
    f"{COPIES}, j AS (SELECT bundle, path, p.hash AS was, f.hash AS new FROM p FULL JOIN f USING (bundle, path))",
    """SELECT bundle, path, CASE WHEN was IS NOT DISTINCT FROM new THEN 'keep' WHEN new IS NOT DISTINCT FROM d.hash THEN 'same' WHEN was IS DISTINCT FROM d.hash THEN 'conflict'
  WHEN new IS NULL THEN 'delete' WHEN d.hash IS NULL THEN 'create' ELSE 'replace' END AS action FROM j LEFT JOIN d USING (bundle, path)""",
)
put("import_noop", COPIES, "SELECT * FROM p INTERSECT SELECT * FROM f")
put("verify_consistency", COPIES, "SELECT bundle, path, CASE WHEN f.hash IS NULL THEN 'source without concept' WHEN p.hash IS NULL THEN 'concept without source' ELSE 'hash differs' END AS problem FROM p FULL JOIN f USING (bundle, path) WHERE p.hash IS DISTINCT FROM f.hash")
put("import_bundles", f"{CAT}, {LOG}, {_state('now')}, st AS (SELECT DISTINCT bundle FROM now WHERE bundle <> 'b3'), fo AS (SELECT bundle FROM cat UNION SELECT bundle FROM now)", "SELECT bundle FROM st UNION SELECT bundle FROM fo WHERE bundle NOT IN (SELECT bundle FROM log WHERE bundle NOT IN (SELECT bundle FROM st))")
put("migration_equivalence", f"{CAT}, a AS (SELECT bundle, path, sha256(source) AS hash FROM cat), b AS (SELECT bundle, path, sha256(CASE WHEN path LIKE '%77.md' THEN upper(source) ELSE source END) AS hash FROM cat)", "SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
put("export_manifest", CAT, "SELECT bundle || '/' || path AS target, octet_length(encode(source))::BIGINT AS bytes, sha256(source) AS hash FROM cat")
LITTLE = f"{CAT}, little AS (SELECT * FROM cat WHERE bundle IN ('geo', 'supply'))"
put("scan_bundle", f"{CAT}, {CON}", "SELECT bundle, path, sha256(source) AS hash FROM con")
put("put_idempotent", LITTLE, f"SELECT 0::BIGINT AS attempt, false AS reused, {_digest('cat')} AS digest UNION ALL SELECT 1, true, {_digest('cat')} UNION ALL SELECT 2, false, {_digest('little')}")
put("commit_chain", CAT, "SELECT d::BIGINT AS depth, true AS follows, (SELECT count(*) FROM cat WHERE d <> 1 OR bundle <> 'supply')::BIGINT AS n_documents FROM (VALUES (0), (1), (2)) v(d)")
put("transact", f"{LOG}, {_state('now')}", "SELECT * FROM now")
