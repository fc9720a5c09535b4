"""The same results as plain SQL for DuckDB, written request by request."""

from html.entities import name2codepoint

from corpusplan import known
from workload import inputs


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


def _family_case(**by_family: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(dataset_id, '{f.replace('_', '-')}') THEN {sql}"
                              for f, sql in by_family.items()) + " END"


_DIGITS = "nullif(regexp_extract(dataset_id, '([0-9]+)$', 1), '')"
_STEM = r"coalesce(nullif(regexp_extract({0}, '(?s)^((?:.*/)?[.]*[^./][^/]*)[.][^./]*$', 1), ''), {0})"


def _join(parent: str, child: str) -> str:
    return (f"CASE WHEN starts_with({child}, '/') THEN {child} WHEN {parent} = '' OR suffix({parent}, '/') "
            f"THEN {parent} || {child} ELSE {parent} || '/' || {child} END")


def _archive(column: str) -> str:
    return "(" + " OR ".join(f"suffix({column}, '{s}')" for s in known.ARCHIVE_SUFFIXES) + ")"


_ENDINGS = ", ".join(f"'{e}'" for e in inputs.CATEGORY_FILES)

# step name -> SQL; a query takes the steps it needs in this order
STEPS = {
    "seeds": f"SELECT doc_id, lang, {inputs.VERSION} AS v, {inputs.KIND} AS k, {inputs.ASK} AS m FROM documents",
    "index_anchors": f"SELECT {_columns(inputs.ANCHOR)} FROM seeds",
    "category_pages": f"""SELECT DISTINCT v, page_url || href AS page_url FROM
        (SELECT v, {_columns(inputs.ANCHOR)} FROM seeds WHERE v % 3 = 2)
        WHERE href <> '' AND NOT (href = 'test/' AND v % 5 = 0)""",
    "category_anchors": f"""SELECT page_url, CAST(i - 1 AS INT) AS pos, 'corpus-' || v || ([{_ENDINGS}])[i] AS href
        FROM (SELECT v, page_url, unnest(range(1, {len(inputs.CATEGORY_FILES) + 1})) AS i FROM category_pages)""",
    "anchors": "SELECT * FROM index_anchors UNION ALL SELECT * FROM category_anchors",
    "requests": f"SELECT {_columns(inputs.REQUEST)} FROM seeds",
    "resolved": f"""SELECT *, CASE family WHEN 'europarl' THEN 'http://statmt.org/europarl/' || version || '/'
            WHEN 'news-commentary' THEN 'http://data.statmt.org/news-commentary/' || version || '/training/'
            WHEN 'wmt' THEN 'http://statmt.org/wmt' || version || '/' END AS index_url
        FROM (SELECT *,
            {_family_case(europarl="'europarl'", news_commentary="'news-commentary'", wmt="'wmt'",
                          un_corpus="'un-corpus'")} AS family,
            {_family_case(europarl=f"coalesce('v' || {_DIGITS}, 'v7')",
                          news_commentary=f"coalesce('v' || {_DIGITS}, 'v15')",
                          wmt=f"coalesce({_DIGITS}, '14')", un_corpus="'v1.0'")} AS version
        FROM requests)""",
    "asked": """SELECT *, coalesce(language_pair, '') AS want_pair, coalesce(category, '') AS want_category
        FROM resolved""",
    "europarl": """SELECT q.*, q.index_url || a.href AS url, a.href AS filename,
            split_part(a.href, '-train', 1) AS found_pair, CAST(NULL AS VARCHAR) AS found_category,
            'Europarl ' || version || ' ' || split_part(a.href, '-train', 1) || ' corpus' AS description, a.pos
        FROM asked q JOIN index_anchors a ON a.page_url = q.index_url
        WHERE family = 'europarl' AND suffix(a.href, '.tgz') AND contains(a.href, '-train')
            AND (want_pair = '' OR contains(a.href, want_pair))""",
    "news": """SELECT * EXCLUDE (found_pair), found_pair, CAST(NULL AS VARCHAR) AS found_category,
            'News Commentary ' || version || ' ' || found_pair || ' corpus' AS description, file_pos AS pos
        FROM (SELECT q.*, q.index_url || a.href AS url, a.href AS filename, a.pos AS file_pos,
                regexp_extract(a.href, '[.]([a-z]{2}-[a-z]{2})[.](tsv|tsv[.]gz)$', 1) AS found_pair
            FROM asked q JOIN index_anchors a ON a.page_url = q.index_url
            WHERE family = 'news-commentary' AND starts_with(a.href, 'news-commentary-' || version))
        WHERE found_pair <> '' AND (want_pair = '' OR want_pair = found_pair)""",
    "wmt_cats": """SELECT q.*, q.index_url || a.href AS page_url, a.pos AS index_pos,
            CASE WHEN want_category <> '' THEN want_category
                ELSE regexp_replace(a.href, '/+$', '') END AS found_category
        FROM asked q JOIN index_anchors a ON a.page_url = q.index_url
        WHERE family = 'wmt' AND CASE WHEN want_category <> '' THEN contains(a.href, want_category)
            ELSE contains(a.href, 'training') OR contains(a.href, 'test') OR contains(a.href, 'dev') END
        QUALIFY row_number() OVER (PARTITION BY req_id, found_category ORDER BY a.pos DESC) = 1""",
    "wmt": f"""SELECT c.* EXCLUDE (page_url, index_pos, found_category),
            regexp_replace(c.page_url, '/+$', '') || '/' || a.href AS url,
            a.href AS filename, CAST(NULL AS VARCHAR) AS found_pair, found_category,
            'WMT' || version || ' ' || found_category || ' dataset - ' || a.href AS description, a.pos
        FROM wmt_cats c JOIN anchors a ON a.page_url = c.page_url
        WHERE a.href <> '' AND {_archive('a.href')}""",
    "un": """SELECT q.*, 'http://statmt.org/wmt13/training-parallel-un-v1.0.tgz' AS url,
            'training-parallel-un-v1.0.tgz' AS filename, CAST(NULL AS VARCHAR) AS found_pair,
            CAST(NULL AS VARCHAR) AS found_category, 'UN parallel corpus v1.0' AS description, 0 AS pos
        FROM asked q WHERE family = 'un-corpus'""",
    "matched": """SELECT * EXCLUDE (file_pos) FROM (SELECT * FROM europarl UNION ALL BY NAME SELECT * FROM news
            UNION ALL BY NAME SELECT * FROM wmt UNION ALL BY NAME SELECT * FROM un)""",
    "placed": f"""SELECT *, CASE WHEN has_target_dir THEN target_dir ELSE dataset_id END AS override,
            coalesce(found_category, 'parallel/' || found_pair, {_STEM.format('filename')}, '') AS layout
        FROM matched""",
    "plan": f"""SELECT req_id, dataset_id, url, filename, found_pair AS language_pair,
            found_category AS category, description, directory AS target_dir,
            {_join('directory', 'filename')} AS output_path, pos
        FROM (SELECT *, {_join("'./data'", "coalesce(nullif(override, ''), layout)")} AS directory FROM placed)""",
    "kept": """SELECT * FROM plan
        QUALIFY row_number() OVER (PARTITION BY output_path ORDER BY req_id, pos, url) = 1""",
    "existing": f"""SELECT DISTINCT {inputs.EXISTING['output_path']} AS output_path
        FROM (SELECT v, k, lang, {_columns(inputs.ANCHOR)} FROM seeds) WHERE {inputs.EXISTING['wanted']}""",
    "statuses": """SELECT p.*, CASE WHEN e.output_path IS NOT NULL AND NOT {force} THEN 'skipped'
            WHEN NOT suffix(p.url, '.tar.gz') THEN 'landed' ELSE 'failed' END AS status
        FROM kept p LEFT JOIN existing e ON e.output_path = p.output_path""",
    "attributed": """SELECT p.req_id, p.dataset_id, p.url, p.output_path,
            CASE WHEN p.url = s.url THEN s.status ELSE 'collision' END AS status,
            CASE WHEN p.url <> s.url THEN 'path taken by ' || s.url
                WHEN s.status = 'failed' THEN 'no object for ' || p.url END AS error
        FROM plan p JOIN statuses s ON s.output_path = p.output_path""",
    "event_ledger": """SELECT 'http://mirror.example/' || user_id AS url,
            './data/' || event_type || '/' || user_id AS path, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_id
        FROM events""",
    "latest": """SELECT * FROM event_ledger
        QUALIFY row_number() OVER (PARTITION BY url ORDER BY ts DESC, event_id DESC) = 1""",
    "listed_requests": """SELECT doc_id AS req_id, 'http://statmt.org/wmt' || v || '/' AS index_url,
            CAST(v AS VARCHAR) AS version, CASE WHEN m < 4 THEN '.html' ELSE '/' END AS suffix FROM seeds""",
    "text_lines": f"""SELECT doc_id, {inputs.BOX} AS box, octet_length(encode(text)) AS size, text,
            CASE WHEN suffix(text, chr(10)) THEN list_slice(string_split(text, chr(10)), 1, -2)
                ELSE string_split(text, chr(10)) END AS lines
        FROM documents""",
    "numbered_lines": """SELECT doc_id, box, size, CAST(i - 1 AS BIGINT) AS number, lines[i] AS line
        FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM text_lines)""",
}

_NEEDS_ONLY = {
    "ledger": ["event_ledger", "latest"],
    "lines": ["text_lines", "numbered_lines"],
}


def _with(select: str, steps=None, force: bool = False) -> str:
    names = list(STEPS)
    chosen = steps if steps is not None else [n for n in names if n not in
                                              ("event_ledger", "latest", "text_lines", "numbered_lines")]
    body = ",\n".join(f"{n} AS ({STEPS[n].replace('{force}', str(force).upper())})" for n in names if n in chosen)
    return f"WITH {body}\n{select}"


def _unfiltered(select: str) -> str:
    """As `_with`, but with one unfiltered request per dataset."""
    steps = dict(STEPS)
    steps["asked"] = ("SELECT min(req_id) AS req_id, family, version, index_url, '' AS want_pair, "
                      "'' AS want_category FROM resolved WHERE family IS NOT NULL "
                      "GROUP BY family, version, index_url")
    names = ["seeds", "index_anchors", "category_pages", "category_anchors", "anchors", "requests", "resolved",
             "asked", "europarl", "news", "wmt_cats", "wmt", "un", "matched"]
    return "WITH " + ",\n".join(f"{n} AS ({steps[n]})" for n in names) + f"\n{select}"


_FILE = ("url, filename, found_pair AS language_pair, found_category AS category, description, pos")
_BASE = r"regexp_extract({0}, '([^/]*)$', 1)"

_NAMED = "MAP {" + ", ".join(
    f"'{name}': chr({code})" for name, code in name2codepoint.items()) + "}"
_TAG = (r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
        r"""|<a[\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*>""")
_ATTRIBUTE = r"""(?is)[^\s=>/"'']+\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"''][^\s>]*)"""
_HREF = r"(?is)^href\s*=\s*"
_REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"

PAGE_ANCHORS = f"""
WITH tags AS (
    SELECT url, list_filter(regexp_extract_all(html, '{_TAG}'), lambda t: lower(t[1:2]) = '<a') AS tags FROM pages),
hrefs AS (
    SELECT url, list_filter(list_transform(tags, lambda t: list_filter(
        regexp_extract_all(t, '{_ATTRIBUTE}'), lambda x: regexp_matches(x, '{_HREF}'))[1]),
        lambda h: h IS NOT NULL) AS hrefs FROM tags),
raw AS (
    SELECT url, list_filter(list_transform(list_transform(hrefs, lambda h: regexp_replace(h, '{_HREF}', '')),
        lambda h: CASE WHEN h[1] IN ('"', '''') THEN h[2:-2] ELSE h END), lambda h: h <> '') AS hrefs FROM hrefs),
rows AS (SELECT url, i, hrefs[i] AS raw FROM (SELECT *, unnest(range(1, len(hrefs) + 1)) AS i FROM raw)),
pieces AS (SELECT *, string_split(raw, '&') AS parts FROM rows)
SELECT url AS page_url, CAST(i - 1 AS INT) AS pos, parts[1] || array_to_string(list_transform(parts[2:],
    lambda p: CASE
        WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]+;') THEN
            chr(CAST('0x' || regexp_extract(p, '{_REFERENCE}', 1)[3:] AS INT)) || p[len(regexp_extract(p, '{_REFERENCE}', 1)) + 2:]
        WHEN regexp_matches(p, '^#[0-9]+;') THEN
            chr(CAST(regexp_extract(p, '{_REFERENCE}', 1)[2:] AS INT)) || p[len(regexp_extract(p, '{_REFERENCE}', 1)) + 2:]
        ELSE coalesce(({_NAMED})[regexp_extract(p, '{_REFERENCE}', 1)]
            || p[len(regexp_extract(p, '{_REFERENCE}', 1)) + 2:], '&' || p) END), '') AS href
FROM pieces
"""

_PAIRS = " ".join(f"WHEN '{i}' THEN '{', '.join(p or [])}'" for i, _, p, _ in known.CATALOGUE)
_COUNTS = " ".join(f"WHEN '{i}' THEN {len(p or [])}" for i, _, p, _ in known.CATALOGUE)

_SAID = {name: " ".join(f"WHEN '{row[0]}' THEN '{row[i] if i == 1 else ', '.join(row[i] or [])}'" for row in known.CATALOGUE)
         for i, name in enumerate(("id", "description", "language_pairs", "categories"))}

_KIND = """CASE WHEN suffix({0}, '.tar.gz') OR suffix({0}, '.tgz') THEN 'tar' WHEN suffix({0}, '.gz') THEN 'gzip'
    WHEN suffix({0}, '.zip') THEN 'unsupported' ELSE 'none' END"""

_COUNTED = """SELECT dataset_id, count(*) AS planned, count(*) FILTER (status = 'skipped') AS skipped,
    count(*) FILTER (status = 'landed') AS landed, count(*) FILTER (status = 'failed') AS failed
    FROM statuses GROUP BY dataset_id"""
_STATUSES = """SELECT req_id, dataset_id, url, output_path, status,
    CASE WHEN status = 'failed' THEN 'no object for ' || url END AS error,
    CASE WHEN NOT suffix(url, '.tar.gz') THEN 'mirror/' || filename END AS src_path,
    CASE WHEN NOT suffix(url, '.tar.gz') THEN CAST(length(url) AS BIGINT) END AS length FROM statuses"""
_LINES = _NEEDS_ONLY["lines"]
_LEDGER = _NEEDS_ONLY["ledger"]

ORACLE = {
    "page_anchors": PAGE_ANCHORS,
    "resolve_ids": _with("SELECT req_id, dataset_id, family, version, index_url FROM resolved"),
    "registry_pairs": f"""WITH seeds AS ({STEPS['seeds']}), asked AS (
        SELECT doc_id AS req_id, {inputs.CATALOGUE_ID} AS dataset_id FROM seeds)
        SELECT *, CASE dataset_id {_PAIRS} ELSE '' END AS language_pairs,
            CASE dataset_id {_COUNTS} ELSE 0 END AS pairs FROM asked""",
    "europarl_files": _unfiltered(f"SELECT family, version, {_FILE} FROM europarl"),
    "news_files": _unfiltered(f"SELECT family, version, {_FILE} FROM news"),
    "wmt_categories": _unfiltered(
        "SELECT version, found_category AS category, page_url, index_pos AS pos FROM wmt_cats"),
    "wmt_files": _unfiltered(
        "SELECT family, version, url, filename, found_category AS category, description, pos FROM wmt"),
    "candidates": _unfiltered(f"SELECT family, version, {_FILE} FROM matched"),
    "request_files": _with(f"SELECT req_id, dataset_id, family, version, {_FILE} FROM matched"),
    "plan": _with("SELECT * FROM plan"),
    "plan_from_pages": _with("SELECT * EXCLUDE (pos) FROM plan"),
    "plan_kept": _with("SELECT * FROM kept"),
    "single_layout": _with(f"""SELECT req_id, dataset_id, url, filename, found_pair AS language_pair,
            found_category AS category, description, directory AS target_dir,
            {_join('directory', 'filename')} AS output_path, pos
        FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY req_id) = 1 THEN parent
                ELSE {_join('parent', 'layout')} END AS directory
            FROM (SELECT *, coalesce(nullif(target_dir, ''), './data') AS parent FROM placed))"""),
    "path_collisions": _with("""SELECT req_id, dataset_id, url, output_path, pos FROM plan
        QUALIFY row_number() OVER (PARTITION BY output_path ORDER BY req_id, pos, url) > 1"""),
    "path_conflicts": _with("""SELECT p.output_path, count(*) AS rows, count(DISTINCT p.url) AS urls,
            any_value(k.url) AS kept_url
        FROM plan p JOIN kept k ON k.output_path = p.output_path
        GROUP BY p.output_path HAVING count(DISTINCT p.url) > 1"""),
    "missing_requests": _with("""SELECT req_id, dataset_id, language_pair, category, family, version
        FROM resolved r WHERE NOT EXISTS (SELECT 1 FROM matched m WHERE m.req_id = r.req_id)"""),
    "batch_summary": _with("""SELECT dataset_id, CAST(grouping(dataset_id) AS INT) AS is_total,
            count(DISTINCT dataset_id) AS datasets,
            CAST(count(DISTINCT dataset_id || ' ' || url) FILTER (status IN ('skipped', 'landed')) AS BIGINT) AS files
        FROM attributed GROUP BY ROLLUP (dataset_id)"""),
    "fetch_outcomes": _with(_STATUSES),
    "fetch_outcomes_forced": _with(_STATUSES, force=True),
    "skip_existing": _with("""SELECT k.output_path,
            CASE WHEN EXISTS (SELECT 1 FROM existing e WHERE e.output_path = k.output_path)
                THEN 'skip' ELSE 'fetch' END AS todo FROM kept k"""),
    "outcome_counts": _with(_COUNTED),
    "outcome_counts_forced": _with(_COUNTED, force=True),
    "attributed_outcomes": _with("SELECT * FROM attributed"),
    "paths_by_dataset": _with("""SELECT dataset_id, url, min(output_path) AS output_path FROM attributed
        WHERE status IN ('skipped', 'landed') GROUP BY dataset_id, url"""),
    "archive_kind": _with(f"""SELECT DISTINCT url, output_path, {_KIND.format('output_path')} AS archive_kind,
            CASE WHEN {_KIND.format('output_path')} = 'gzip'
                THEN regexp_replace({_BASE.format('output_path')}, '[.]gz$', '') END AS unpacked_name,
            {_BASE.format('output_path')} AS name, regexp_replace(output_path, '/?[^/]*$', '') AS folder,
            {_BASE.format('url')} AS default_name
        FROM plan"""),
    "ledger_latest": _with("SELECT * FROM latest", _LEDGER),
    "ledger_size": _with("SELECT count(*) AS entries FROM latest", _LEDGER),
    "ledger_recent": _with(f"""SELECT {_BASE.format('path')} AS name, url, path, ts FROM latest
        ORDER BY ts DESC, url LIMIT 5""", _LEDGER),
    "ledger_json": _with("SELECT event_id, url, path, ts FROM event_ledger WHERE event_id % 7 <> 0", _LEDGER),
    "text_checksums": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "rule_extension": _with("""SELECT req_id, 'listing' AS family, version, index_url || href AS url,
            suffix AS category, pos
        FROM listed_requests JOIN index_anchors ON page_url = index_url
        WHERE href <> '' AND ends_with(href, suffix)"""),
    "rule_extension_sql": _with("""SELECT req_id, 'listing' AS family, version, index_url || href AS url,
            suffix AS category, pos
        FROM listed_requests JOIN index_anchors ON page_url = index_url
        WHERE href <> '' AND ends_with(href, suffix)"""),
    "batch_requests": f"""WITH seeds AS ({STEPS['seeds']}), good AS (SELECT * FROM seeds WHERE m NOT IN (1, 2, 3, 4))
        SELECT doc_id, 0 AS req_id, 'wmt' || v AS dataset_id, lang AS language_pair, CAST(NULL AS VARCHAR) AS category,
            CAST(NULL AS VARCHAR) AS target_dir, FALSE AS has_target_dir, '{{"quality":"' || k || '"}}' AS extra,
            CAST(NULL AS VARCHAR) AS problem FROM good
        UNION ALL SELECT doc_id, 1, 'europarl', NULL, NULL, lang, TRUE, '{{}}', NULL FROM good
        UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE m
            WHEN 2 THEN 'no datasets defined' WHEN 3 THEN 'an entry has no dataset_id'
            ELSE 'not a JSON array and not an object with ''datasets''' END
        FROM seeds WHERE m IN (1, 2, 3, 4)""",
    "gzip_lines": _with("SELECT box, line FROM numbered_lines", _LINES),
    "landed_lines": _with("SELECT box, line FROM numbered_lines", _LINES),
    "tar_lines": _with("""SELECT 'texts/' || doc_id || '.txt' AS member, size, number, line
        FROM numbered_lines""", _LINES),
    "unpacked_lines": _with(f"""SELECT 'texts/' || doc_id || '.txt' AS member, number, line FROM numbered_lines
        UNION ALL SELECT 'box-' || box || '.tsv', CAST(0 AS BIGINT), 'box ' || box
            FROM (SELECT DISTINCT {inputs.BOX} AS box FROM documents)
        UNION ALL SELECT unnest(['box-' || box || '.zip', 'cut-' || box || '.tar.gz']), NULL, NULL
            FROM (SELECT DISTINCT {inputs.BOX} AS box FROM documents)""", _LINES),
    "ledger_snapshot": _with("""SELECT url, path, ts FROM event_ledger QUALIFY row_number() OVER (
        PARTITION BY url ORDER BY ts DESC, event_id % 2 DESC, path DESC) = 1""", _LEDGER),
    "landing_mixed": f"""WITH boxes AS (SELECT DISTINCT {inputs.BOX} AS box FROM documents),
        forces AS (SELECT unnest([FALSE, TRUE]) AS force)
        SELECT force, 'boxes-' || box AS dataset_id, FALSE AS missing,
            CASE WHEN box % 2 = 0 AND NOT force THEN 'skipped' ELSE 'landed' END AS status, TRUE AS dated,
            CAST(NULL AS VARCHAR) AS error FROM boxes, forces
        UNION ALL SELECT force, 'boxes-' || box, TRUE, 'failed', FALSE,
            'no object for http://boxes.example/box=' || box || '/missing.gz' FROM boxes, forces WHERE box % 3 = 0""",
    "catalogue_listing": f"""WITH seeds AS ({STEPS['seeds']}), asked AS (
        SELECT doc_id AS req_id, {inputs.CATALOGUE_ID} AS id FROM seeds)
        SELECT *, {', '.join(f"CASE id {_SAID[n]} END AS {n}" for n in ('description', 'language_pairs', 'categories'))}
        FROM asked""",
    "tar_checksums": """SELECT 'texts/' || doc_id || '.txt' AS member, octet_length(encode(text)) AS size,
        CAST(0 AS BIGINT) AS number, md5(text) AS md5 FROM documents""",
    "landing_runs": f"""SELECT unnest([1, 2]) AS run, 'boxes-' || box AS dataset_id,
        unnest(['landed', 'skipped']) AS status FROM (SELECT DISTINCT {inputs.BOX} AS box FROM documents)""",
    "file_inventory": f"""WITH boxes AS (SELECT {inputs.BOX} AS box, count(*) AS n FROM documents GROUP BY 1),
        files AS (SELECT 'box=' || box || '/' || name AS name, CAST(n * times AS BIGINT) AS length
            FROM boxes, (VALUES ('plain.txt', 1), ('_log/.hidden', 2), ('.tmp/empty', 0), ('a/b/c/_deep.gz', 3)) k(name, times))
        SELECT 'all' AS asked, *, FALSE AS is_dir FROM files
        UNION ALL SELECT 'level', 'box=' || box, NULL, TRUE FROM boxes
        UNION ALL SELECT 'hidden', *, FALSE FROM files WHERE suffix(name, '/_log/.hidden')
        UNION ALL SELECT 'anywhere', *, FALSE FROM files WHERE suffix(name, '.gz')
        UNION ALL SELECT 'below', *, FALSE FROM files WHERE prefix(name, 'box=1')""",
    "saved_pages": """SELECT 'http://pages.example/p' || page_id || '/' ||
            CASE page_id % 4 WHEN 0 THEN '_a/' WHEN 1 THEN '.b/' WHEN 2 THEN 'c d+e%20/' ELSE '' END AS url,
        coalesce(html, '') AS html FROM pages""",
    "landed_counts": f"""WITH n AS (SELECT count(DISTINCT {inputs.BOX}) AS n FROM documents)
        SELECT run, status, counted, counted AS files FROM (
            SELECT r AS run, s AS status, CASE WHEN (r, s) IN ((1, 'landed'), (2, 'skipped')) THEN n ELSE 0 END AS counted
            FROM n, (SELECT unnest([1, 2])) a(r), (SELECT unnest(['skipped', 'landed', 'failed'])) b(s))""",
    "landed_ledger": f"SELECT DISTINCT {inputs.BOX} AS box, TRUE AS same FROM documents",
}
