"""DuckDB SQL that gives the rows of the queries, written from their definitions rather than from the plans."""

from __future__ import annotations

from ..functions import text as T
from ..operators import search
from ..sources import files
from . import queries as Q
from .samples import ENDED, FILES, KINDS, LINES, MARKS, RAW, SEQUENCE, STEMS, values

_TRIM = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"


def _strip_endings(x: str) -> str:
    for e in (*T.ENDINGS, f"[{T.TRAILING}]+"):
        x = rf"regexp_replace({x}, '({e})\z', '')"
    return x


def _name_rule(x: str) -> str:
    return f"CASE WHEN {x} LIKE '{T.NAME_STEM}%' AND ({x} LIKE '%{T.NAME_ENDS[0]}' OR {x} LIKE '%{T.NAME_ENDS[1]}') THEN '{T.NAME_STEM}' ELSE {x} END"


_NAME = """'order_' || doc_id || CASE WHEN doc_id % 7 = 0 THEN '' ELSE '_' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') || '.' ||
  lpad((CASE WHEN doc_id % 11 = 0 THEN 13 ELSE (doc_id // 28) % 12 + 1 END)::VARCHAR, 2, '0') || '.' || (doc_id % 10 + 2015) END || '.docx'"""

DOCS = f"""d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_index, text, {_NAME} AS file_name FROM documents)"""


def _lines(docs: str, p: str) -> str:
    return f"""{p}_l AS (SELECT doc_index, file_name, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {docs}),
{p} AS (SELECT doc_index, file_name, row_number() OVER (PARTITION BY doc_index ORDER BY i) - 1 AS position, {_TRIM.format('t')} AS text
      FROM {p}_l WHERE {_TRIM.format('t')} <> '')"""


def _tokens(p: str, tok: str) -> str:
    return f"""{tok}_w AS (SELECT doc_index, position, replace(x, '''', '') AS x
           FROM (SELECT doc_index, position, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}'']+')) AS x FROM {p})),
{tok}_s AS (SELECT doc_index, position, {_strip_endings('lower(x)')} AS s FROM {tok}_w),
{tok} AS (SELECT doc_index, position, {_name_rule('s')} AS term FROM {tok}_s WHERE strlen({_name_rule('s')}) >= 2)"""


P = f"WITH {DOCS},\n{_lines('d', 'p')}"
TOK = f"{P},\n{_tokens('p', 'tok')}"
PD = f"{TOK},\npd AS (SELECT DISTINCT term, doc_index, position FROM tok)"
_FLAT = "count(*)::BIGINT AS n_positions, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions"
_POSTINGS = f"SELECT term, doc_index, {_FLAT} FROM pd GROUP BY term, doc_index"
_DATE = r"regexp_extract({}, '([0-9]{{2}})\.([0-9]{{2}})\.([0-9]{{4}})', {})"


def _date(name: str) -> str:
    d, m, y = (f"try_cast({_DATE.format(name, i)} AS INTEGER)" for i in (1, 2, 3))
    return f"CASE WHEN {d} BETWEEN 1 AND 31 AND {m} BETWEEN 1 AND 12 AND {y} >= 1900 THEN {y} * 10000 + {m} * 100 + {d} END"


def _near(words: list[str], text: str) -> str:
    """Greedy places of two or three words, as nested expressions."""
    if not 2 <= len(words) <= 3:
        return "TRUE"
    rest, tests = text, []
    for i, w in enumerate(words):
        at = f"strpos({rest}, '{w}')"
        tests.append(f"{at} > 0")
        if i:
            tests.append(f"strlen(substr({rest}, 1, {at} - 1)) <= {T.NEAR_BYTES}")
        rest = f"substr({rest}, {at} + {len(w)})"
    return " AND ".join(tests)


def _ins(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in sorted(set(words)))


def _mode(mode: str) -> str:
    first = f"greatest((SELECT count(*) FROM d) - {search.QUICK_DOCUMENTS}, 0)"
    return {"full": "TRUE", "quick": f"doc_index >= {first}", "remaining": f"doc_index < {first}"}[mode]


def _cand(words: list[str], mode: str) -> str:
    n = len(set(words))
    return f"(SELECT doc_index FROM pd WHERE term IN ({_ins(words)}) AND {_mode(mode)} GROUP BY doc_index HAVING count(DISTINCT term) = {n})"


def _matches(query: str, indexed: bool, mode: str = "full", no_basis: bool = False, table: str = "p") -> str:
    words = T.query_terms(query)
    norm = "replace(lower(text), '''', '')"
    tests = [f"contains({norm}, '{w}')" for w in words] + [_near(words, norm)]
    if no_basis:
        tests.append(f"NOT starts_with({_TRIM.format('lower(text)')}, '{T.BASIS}')")
    if indexed:
        tests.append(f"(doc_index, position) IN (SELECT (doc_index, position) FROM pd WHERE term IN ({_ins(words)}) AND doc_index IN {_cand(words, mode)})")
    return f"SELECT doc_index, file_name, position, text FROM {table} WHERE {' AND '.join(tests)}"


def _results(query: str, indexed: bool, mode: str = "full", no_basis: bool = False, extra: str = "", table: str = "p") -> str:
    return f"""SELECT doc_index, file_name, {_date('file_name')} AS file_date, count(*)::BIGINT AS n_matches,
       string_agg(position::VARCHAR, ',' ORDER BY position) AS positions{extra}
FROM ({_matches(query, indexed, mode, no_basis, table)}) GROUP BY doc_index, file_name"""


_NEAR_WORDS = T.query_terms(Q.NEAR_QUERY)


def _candidates(mode: str) -> str:
    return f"""{PD},
u AS (SELECT DISTINCT doc_index, position FROM pd WHERE term IN ({_ins(_NEAR_WORDS)}) AND doc_index IN {_cand(_NEAR_WORDS, mode)})
SELECT doc_index, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions FROM u GROUP BY doc_index"""


_LEVELLED = f"{P},\nv AS (SELECT doc_index, position, ((position * 3 + doc_index) % 5)::INTEGER AS level FROM p)"

_LISTING = f"""WITH f AS (SELECT '2024/' || {_NAME} AS path, n_chars AS size, doc_id * 7 % 1000 AS mtime_s, doc_id FROM documents),
a AS (SELECT path, size, mtime_s FROM f WHERE doc_id % 6 <> 0),
b AS (SELECT path, CASE WHEN doc_id % 4 = 0 THEN size + 1 ELSE size END AS size, CASE WHEN doc_id % 3 = 0 THEN mtime_s - 1 ELSE mtime_s END AS mtime_s
      FROM f WHERE doc_id % 5 <> 0)"""

_STOPS = "^(" + "|".join(T.FOLLOWUP_STOPS) + ")"
def _list(items: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


#: The paragraphs as lines of orders.
_MARKED = f"""{P},
q AS (SELECT doc_index, CASE WHEN doc_index % 4 = 0 THEN 'Особовий ' ELSE '' END || file_name AS file_name, position,
             ({_list(MARKS)})[(position * 5 + doc_index) % {len(MARKS)} + 1] || text AS text FROM p)"""
_ALL_LINES = f"""{_MARKED},
l AS (SELECT doc_index, position, text, contains(text, '{Q.ONE_QUERY}') AS is_match FROM q
      UNION ALL SELECT doc_index + {Q.SAMPLE_FROM}, position, text, is_match FROM {values(LINES)})"""
_AFTER = f"""{_ALL_LINES},
r AS (SELECT l.doc_index, m.position AS match_position, m.text AS match_text, l.position, l.text FROM l JOIN l m ON l.doc_index = m.doc_index AND m.is_match AND l.position > m.position)"""
_LEVEL = r"""CASE WHEN regexp_matches(text, '^[0-9]+(\.[0-9]+){0,3}\.\s+') THEN len(string_split(regexp_extract(text, '^([0-9]+(\.[0-9]+){0,3})\.\s+', 1), '.')) ELSE 0 END::BIGINT"""
_IN_DOCUMENT = f"CASE WHEN contains(text, '{T.ARRIVALS}') THEN 'arrivals' WHEN contains(text, '{T.DEPARTURES}') THEN 'departures' WHEN starts_with(text, '§') THEN 'section' END"


def _around(is_match: str) -> str:
    """a: the lines with what they are; m: the matches; pr: the parents of each, one a row."""
    return f"""{_MARKED},
a AS (SELECT *, starts_with(lower(file_name), '{T.PERSONAL_FILE}') AS personal, {_LEVEL} AS lv, regexp_extract(text, '^([0-9]+)\\.', 1) AS num,
             starts_with(lower(text), '{T.BASIS}') AS basis, regexp_matches(lower(text), '{_STOPS}') AS rk, starts_with(text, '§') AS sg, regexp_matches(text, '^[0-9]+\\.\\s') AS plain FROM q),
m AS (SELECT * FROM a WHERE {is_match}),
pr AS (SELECT m.doc_index, m.position, m.personal, h.position AS hp, h.text AS ht FROM m JOIN a h ON h.doc_index = m.doc_index AND h.position < m.position
         AND CASE WHEN m.personal THEN h.sg ELSE h.lv > 0 AND h.lv < CASE WHEN m.lv > 0 THEN m.lv ELSE 99 END END
       WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.doc_index = m.doc_index AND b.position > h.position AND b.position < m.position
                           AND CASE WHEN m.personal THEN b.sg ELSE b.lv BETWEEN 1 AND h.lv END))"""


def _between(upto: str, what: str) -> str:
    return f"EXISTS (SELECT 1 FROM a b WHERE b.doc_index = m.doc_index AND b.position > m.position AND b.position {upto} x.position AND ({what}))"


_LEFT = "b.num <> '' AND NOT b.basis AND m.num <> '' AND b.num <> m.num"
_EXTRACTS = f"""{_around(f"contains(text, '{Q.ONE_QUERY}')")},
par AS (SELECT doc_index, position, string_agg(ht, chr(10) ORDER BY hp) AS parents, max(hp) AS lastp FROM pr GROUP BY ALL),
act AS (SELECT par.doc_index, par.position, x.text AS action FROM par JOIN a x ON x.doc_index = par.doc_index AND x.position = lastp + 1 AND x.position < par.position
        WHERE regexp_matches(lower(x.text), '^({"|".join(T.ACTIONS)})')),
fu AS (SELECT m.doc_index, m.position, string_agg(x.text, chr(10) ORDER BY x.position) AS followups FROM m JOIN a x ON x.doc_index = m.doc_index AND x.position > m.position
       WHERE CASE WHEN m.personal THEN NOT {_between('<=', 'b.sg OR b.rk OR b.plain')}
                  ELSE x.num = '' AND NOT x.basis AND NOT {_between('<=', f'b.basis OR b.rk OR {_LEFT}')} END GROUP BY ALL),
bs AS (SELECT m.doc_index, m.position, arg_min(x.text, x.position) AS basis FROM m JOIN a x ON x.doc_index = m.doc_index AND x.position > m.position AND x.basis
       WHERE NOT m.personal AND NOT {_between('<', _LEFT)} GROUP BY ALL)
SELECT m.doc_index, m.position, m.personal AS is_personal, coalesce(parents, '') AS parents, action, coalesce(followups, '') AS followups, bs.basis
FROM m LEFT JOIN par USING (doc_index, position) LEFT JOIN act USING (doc_index, position) LEFT JOIN fu USING (doc_index, position) LEFT JOIN bs USING (doc_index, position)"""


def _view() -> str:
    words = T.query_terms(Q.NEAR_QUERY)
    norm = "replace(lower(text), '''', '')"
    tests = " AND ".join([*(f"contains({norm}, '{w}')" for w in words), _near(words, norm)])
    return f"""{_around(tests)},
up AS (SELECT doc_index, hp AS position FROM pr WHERE personal
       UNION SELECT q.doc_index, min(q.position) FROM q JOIN (SELECT DISTINCT doc_index, ht FROM pr WHERE NOT personal) t ON t.doc_index = q.doc_index AND t.ht = q.text GROUP BY q.doc_index, q.text)
SELECT doc_index, position, (doc_index, text) IN (SELECT (doc_index, text) FROM m) AS is_match, (doc_index, position) IN (SELECT (doc_index, position) FROM up) AS is_parent,
       CASE WHEN (doc_index, position) IN (SELECT (doc_index, position) FROM up) THEN {_IN_DOCUMENT} END AS category FROM q"""


def _sequence() -> str:
    one = r"\s+".join(f"{w}[{T.ENDING_LETTERS}]*" for w in SEQUENCE)
    return rf"""{_MARKED} SELECT doc_index, position, CASE WHEN regexp_matches(text, '{one}', 'i') THEN regexp_replace(text, '({one})', '<mark>\1</mark>', 'gi')
  ELSE regexp_replace(text, '({"|".join(SEQUENCE)})', '<mark>\1</mark>', 'gi') END AS marked FROM q"""


_HALVED = """e AS (SELECT doc_index, file_name, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN substr(text, 1, length(text) // 2) ELSE text END AS text FROM d
     WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))"""
_BAD = f"""{PD}, n AS (SELECT count(*) - 20 AS total FROM d), u AS (SELECT term, doc_index, position FROM pd),
r AS (SELECT term, doc_index, list(position) FILTER (position % 2 = 0) AS ps FROM u GROUP BY ALL UNION ALL SELECT term, doc_index, list(position) FROM u WHERE doc_index % 3 = 0 GROUP BY ALL)"""
_LISTED = "CASE WHEN num_id IS NOT NULL AND regexp_matches(ilvl, '^[0-9]+$') THEN ilvl::BIGINT + 1 END"

_COUNTERS = """
c AS (SELECT *, {counters} FROM {table} r),
n AS (SELECT *, CASE WHEN level IS NULL THEN NULL WHEN level > 4 THEN '' ELSE array_to_string([c1, c2, c3, c4][1:level::INTEGER], '.') || '. ' END AS number FROM c)"""


def _counters(table: str) -> str:
    """Counter n: items of level n since the last item of a higher level, counted row by row with subqueries."""
    one = """(SELECT count(*) FROM {t} x WHERE x.doc = r.doc AND x.seq <= r.seq AND x.level = {n} AND x.seq > coalesce(
      (SELECT max(y.seq) FROM {t} y WHERE y.doc = r.doc AND y.seq <= r.seq AND y.level < {n}), -1)) AS c{n}"""
    return _COUNTERS.format(counters=", ".join(one.format(t=table, n=n) for n in range(1, 5)), table=table)


def _parents() -> str:
    """Headings above: no other heading between is of their level or higher, and they are above the line's own level."""
    return f"""{_LEVELLED}
SELECT v.doc_index, v.position, v.level, coalesce(string_agg(h.position::VARCHAR, ',' ORDER BY h.level) FILTER (h.position IS NOT NULL), '') AS parents
FROM v LEFT JOIN v h ON h.doc_index = v.doc_index AND h.position < v.position AND h.level > 0
  AND h.level < CASE WHEN v.level > 0 THEN v.level ELSE 99 END
  AND NOT EXISTS (SELECT 1 FROM v b WHERE b.doc_index = v.doc_index AND b.position > h.position AND b.position < v.position AND b.level BETWEEN 1 AND h.level)
GROUP BY ALL"""


_SEGMENTED = f"""WITH d AS (
  SELECT row_number() OVER (ORDER BY doc_id % 3 = 0, doc_id) - 1 AS doc_index, {_NAME} AS file_name,
         CASE WHEN doc_id % 3 <> 0 AND doc_id IN (SELECT doc_id FROM labels) THEN substr(text, 1, length(text) // 2) ELSE text END AS text
  FROM documents WHERE doc_id % 3 = 0 OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
{_lines('d', 'p')}, {_tokens('p', 'tok')}, pd AS (SELECT DISTINCT term, doc_index, position FROM tok)"""

ORACLE: dict[str, str] = {
    "paragraph_explode": f"{P} SELECT doc_index, file_name, position, text FROM p",
    "doc_stats": rf"{P} SELECT doc_index, count(*) AS paragraph_count, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS word_count FROM p GROUP BY doc_index",
    "corpus_totals": rf"{P} SELECT count(DISTINCT doc_index) AS total_documents, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS total_words, count(*) AS total_paragraphs FROM p",
    "tokenize_terms": f"{TOK} SELECT doc_index, term, count(*) AS n FROM tok GROUP BY doc_index, term",
    "stem_cases": f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}'']+')) AS x FROM documents),
w AS (SELECT x || ({_list(ENDED)})[length(x) % {len(ENDED)} + 1] AS word FROM t UNION SELECT word FROM {values(STEMS)}),
s AS (SELECT word, unnest(string_split(lower(word), '-')) AS x, generate_subscripts(string_split(word, '-'), 1) AS i FROM w),
r AS (SELECT word, i, {_strip_endings('x')} AS y FROM s)
SELECT word, string_agg({_name_rule('y')}, '-' ORDER BY i) AS stem FROM r GROUP BY word""",
    "postings_build": f"{PD} {_POSTINGS}",
    "term_doc_freq": f"{PD} SELECT term, count(DISTINCT doc_index) AS doc_freq, count(*)::BIGINT AS paragraph_freq FROM pd GROUP BY term",
    "index_stats": f"{PD} SELECT count(DISTINCT term) AS terms, count(DISTINCT (term, doc_index)) AS postings, count(*)::BIGINT AS positions FROM pd",
    "postings_remove_docs": f"""{PD} SELECT term, doc_index, {_FLAT} FROM pd
WHERE doc_index NOT IN (SELECT doc_index FROM d JOIN labels USING (doc_id) WHERE toxic = 1) GROUP BY term, doc_index""",
    "postings_incremental": f"""WITH {DOCS}, e AS (
  SELECT doc_index, file_name, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN substr(text, 1, length(text) // 2) ELSE text END AS text FROM d),
{_lines('e', 'p')}, {_tokens('p', 'tok')}, pd AS (SELECT DISTINCT term, doc_index, position FROM tok) {_POSTINGS}""",
    "postings_renumber": f"""{PD}, k AS (SELECT doc_index, row_number() OVER (ORDER BY doc_index) - 1 AS new_index FROM d
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))
SELECT term, new_index AS doc_index, {_FLAT} FROM pd JOIN k USING (doc_index) GROUP BY term, new_index""",
    "postings_dedupe": f"""{PD}, u AS (SELECT term, doc_index, position FROM pd UNION SELECT term, doc_index, position + 1 FROM pd)
SELECT term, doc_index, {_FLAT} FROM u GROUP BY term, doc_index""",
    "postings_cleanup": f"""{PD}, u AS (SELECT DISTINCT CASE WHEN length(term) > 3 THEN term ELSE substr(term, 1, 1) END AS term, doc_index, position FROM pd WHERE position % 2 = 0)
SELECT term, doc_index, {_FLAT} FROM u WHERE strlen(term) >= 2 GROUP BY term, doc_index""",
    "index_validation": f"""{PD}, u AS (SELECT term, doc_index, count(*) FILTER (position % 2 = 0) AS n FROM pd GROUP BY ALL)
SELECT count(*) FILTER (strlen(term) < 2) AS short_terms, count(*) FILTER (n = 0) AS empty_positions, count(*) FILTER (doc_index >= (SELECT count(*) - 50 FROM d)) AS beyond_documents,
       count(*) > 0 AS valid FROM u""",
    "documents_validation": """SELECT count(*) AS documents, true AS wrong_total, count(*) FILTER (doc_id % 50 = 0) AS empty_paths, count(*) FILTER (doc_id % 9 = 0) AS count_mismatches FROM documents""",
    "index_coverage": f"""{PD} SELECT DISTINCT doc_index FROM p WHERE contains(upper(text), 'THAT') AND doc_index NOT IN (SELECT doc_index FROM pd WHERE term = 'that')""",
    "last_documents": f"WITH {DOCS} SELECT doc_index, file_name FROM d ORDER BY doc_index DESC LIMIT 10",
    **{f"candidates_{m}": _candidates(m) for m in search.MODES},
    "filename_dates": f"WITH {DOCS} SELECT doc_index, file_name, {_date('file_name')} AS file_date FROM d",
    "search_index": f"{PD} {_results(Q.NEAR_QUERY, True)}",
    "search_wide": f"{PD} {_results(Q.WIDE_QUERY, True)}",
    "search_one_word": f"{PD} {_results(Q.ONE_QUERY, True)}",
    "search_scan": f"{P} {_results(Q.WIDE_QUERY, False)}",
    "search_name_proximity": f"{P} {_results(Q.NEAR_QUERY, False)}",
    "search_quick": f"{PD} {_results(Q.NEAR_QUERY, True, 'quick')}",
    "search_remaining": f"{PD} {_results(Q.NEAR_QUERY, True, 'remaining')}",
    "search_fragments_exclude": f"{P} {_results(Q.ONE_QUERY, False, no_basis=True)}",
    "search_two_phase": f"{PD} {_results(Q.NEAR_QUERY, True, 'quick', extra=', 0 AS phase')} UNION ALL {_results(Q.NEAR_QUERY, True, 'remaining', extra=', 1 AS phase')}",
    "search_ranked": f"""{PD}, r AS ({_results(Q.ONE_QUERY, True)})
SELECT row_number() OVER (ORDER BY file_date DESC NULLS LAST, n_matches DESC, doc_index) AS place, doc_index, file_date, n_matches FROM r ORDER BY place LIMIT 100""",
    "search_places": f"""{PD}, r AS ({_results(Q.ONE_QUERY, True)})
SELECT row_number() OVER (ORDER BY file_date DESC NULLS LAST, n_matches DESC, doc_index) AS place, doc_index, file_date, n_matches FROM r""",
    "batch_search": f"""{PD}, bp AS (SELECT item_id AS doc_index, 0 AS position, text FROM benchmark),
bl AS (SELECT item_id AS q, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}'']+')) AS x,
              generate_subscripts(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}'']+'), 1) AS i FROM benchmark),
bs AS (SELECT q, i, {_strip_endings("lower(replace(x, '''', ''))")} AS s FROM bl),
bt AS (SELECT q, {_name_rule('s')} AS w, min(i) AS i FROM bs WHERE length({_name_rule('s')}) >= 4 GROUP BY ALL),
br AS (SELECT q, w, row_number() OVER (PARTITION BY q ORDER BY i) AS r FROM bt),
q AS (SELECT x.q AS query_id, x.w AS a, y.w AS b FROM br x JOIN br y ON x.q = y.q AND x.r = 1 AND y.r = 2),
h AS (SELECT query_id, a, b, pd.doc_index FROM q JOIN pd ON pd.term IN (a, b) GROUP BY ALL HAVING count(DISTINCT term) = 2),
g AS (SELECT DISTINCT h.*, pd.position FROM h JOIN pd ON pd.doc_index = h.doc_index AND pd.term IN (a, b)),
t AS (SELECT g.*, replace(lower(p.text), '''', '') AS t FROM g JOIN p USING (doc_index, position)),
k AS (SELECT *, substr(t, strpos(t, a) + length(a)) AS rest FROM t WHERE contains(t, a) AND contains(t, b))
SELECT query_id, doc_index, count(*) AS n_matches FROM k WHERE strpos(rest, b) > 0 AND strlen(substr(rest, 1, strpos(rest, b) - 1)) <= {T.NEAR_BYTES} GROUP BY ALL""",
    "file_name_search": f"SELECT string_split(url, '/')[-1] AS name, url AS path FROM pages WHERE contains(lower(string_split(url, '/')[-1]), '1') ORDER BY path, name LIMIT {search.MOST_FILES}",
    "file_name_search_all": "SELECT string_split(url, '/')[-1] AS name, url AS path FROM pages WHERE contains(lower(string_split(url, '/')[-1]), '1')",
    "file_listing": "SELECT string_split(url, '/')[-1] AS name, count(*) AS n, min(url) AS first_path FROM pages GROUP BY 1",
    "file_policy_filter": f"""WITH f AS (SELECT path, lower(string_split(path, '/')[-1]) AS n, regexp_extract(lower(string_split(path, '/')[-1]), '^.+\\.([^.]*)$', 1, 's') AS e FROM (
  SELECT ({_list(("2024/", "2023/.git/", "notes/", "2022/ЕРДР/", "2021/~$"))})[page_id % 7 % 5 + 1] || coalesce(string_split(url, '/')[-1], '')
         || ({_list((".docx", ".xlsx", "", ".tmp", ".DOCX"))})[page_id % 5 + 1] AS path FROM pages UNION SELECT path FROM {values(FILES)}))
SELECT path, NOT starts_with(n, '~$') AND n NOT IN ('.ds_store', 'thumbs.db') AND e = 'docx' AS is_document,
       contains('/' || lower(path), '/.git') OR contains('/' || lower(path), '/ердр (не виключені)') AS excluded,
       regexp_matches(path, '^[0-9]{{4}}[^/]*/.') AND ends_with(lower(path), '.docx') AND NOT starts_with(n, '~$') AS docx_only,
       regexp_matches(path, '^[0-9]{{4}}[^/]*/.') AND NOT ends_with(path, '.zip') AND NOT ends_with(path, '.xlsx') AND NOT ends_with(path, '.xls') AND NOT contains(path, 'ЕРДР') AND NOT contains(path, '.git') AS all_but_archives FROM f""",
    "sync_plan": f"""{_LISTING} SELECT coalesce(a.path, b.path) AS path,
  CASE WHEN a.path IS NULL THEN 'delete' WHEN b.path IS NULL OR a.mtime_s > b.mtime_s OR a.size <> b.size THEN 'copy' ELSE 'keep' END AS action
FROM a FULL JOIN b ON a.path = b.path""",
    "change_detection": f"""{_LISTING} SELECT coalesce(a.path, b.path) AS path,
  CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'deleted' WHEN a.mtime_s > b.mtime_s THEN 'changed' ELSE 'unchanged' END AS status
FROM a FULL JOIN b ON a.path = b.path""",
    "mime_types": f"""WITH f AS (SELECT page_id, url || ({_list(KINDS)})[page_id % {len(KINDS)} + 1] AS path FROM pages)
SELECT page_id, path, CASE regexp_extract(lower(string_split(path, '/')[-1]), '^.+\\.([^.]*)$', 1, 's') {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in files.MIME.items())}
  ELSE 'application/octet-stream' END AS mime_type FROM f""",
    "network_paths": f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '/tmp/' || url ELSE '{Q.SHARE}' || replace(url, '/', chr(92)) END AS network_path FROM pages""",
    "listing_differences": f"""{_LISTING} SELECT path, size, mtime_s, sum(k)::BIGINT AS n FROM (SELECT *, -1 AS k FROM a UNION ALL SELECT *, 1 AS k FROM b) GROUP BY ALL HAVING sum(k) <> 0""",
    "stale_files": f"""{_LISTING}, s AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'gone'
  WHEN a.size <> b.size THEN 'size' WHEN a.mtime_s > b.mtime_s THEN 'later' END AS reason FROM a FULL JOIN b ON a.path = b.path)
SELECT path, reason FROM s WHERE reason IS NOT NULL""",
    "search_friendly": f"{_MARKED} {_results(' '.join(SEQUENCE), False, table='q')}",
    "index_rebuilt": f"{PD} {_POSTINGS}",
    "refresh_segments": f"{_SEGMENTED} {_POSTINGS}",
    "index_compacted": f"{_SEGMENTED} {_POSTINGS}",
    "segment_changes": f"""{PD}, ids AS (SELECT doc_index, doc_id, doc_id % 3 <> 0 AS early, doc_id IN (SELECT doc_id FROM labels) AS labelled,
  doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM d),
{_HALVED}, {_lines('e', 'p2')}, {_tokens('p2', 'tok2')},
old AS (SELECT early, labelled, count(DISTINCT term) AS n, count(DISTINCT (term, position)) AS m FROM pd JOIN ids USING (doc_index) GROUP BY doc_index, early, labelled),
new AS (SELECT count(DISTINCT term) AS n, count(DISTINCT (term, position)) AS m FROM tok2 JOIN ids USING (doc_index) WHERE early AND labelled AND NOT toxic GROUP BY doc_index),
s AS (SELECT sum(n) FILTER (NOT early) + (SELECT sum(n) FROM new) AS pa, sum(n) FILTER (early AND labelled) AS pr, sum(n) FILTER (early) AS pb,
             sum(m) FILTER (NOT early) + (SELECT sum(m) FROM new) AS ma, sum(m) FILTER (early AND labelled) AS mr, sum(m) FILTER (early) AS mb FROM old)
SELECT pa::BIGINT AS postings_added, pr::BIGINT AS postings_removed, (pb + pa - pr)::BIGINT AS postings,
       ma::BIGINT AS positions_added, mr::BIGINT AS positions_removed, (mb + ma - mr)::BIGINT AS positions FROM s""",
    "search_segments": f"{_SEGMENTED} {_results(Q.NEAR_QUERY, True, 'quick')}",
    "index_stored": f"""{PD}, x AS (SELECT doc_index, replace(lower(text), '''', '') AS t FROM p), o AS (SELECT doc_index, t, unnest(range(1, length(t) - 1)) AS i FROM x)
SELECT 'documents' AS "table", count(*) AS n FROM d UNION ALL SELECT 'paragraphs', count(*) FROM p UNION ALL SELECT 'outline', count(*) FROM p
UNION ALL SELECT 'sizes', count(DISTINCT doc_index) FROM pd UNION ALL SELECT 'postings', count(*) FROM (SELECT DISTINCT term, doc_index FROM pd) UNION ALL SELECT 'grams', count(*) FROM (SELECT DISTINCT substr(t, i, 3), doc_index FROM o)""",
    "search_substring": f"{P} {_results(Q.WIDE_QUERY, False)}",
    "file_name_search_grams": f"SELECT string_split(url, '/')[-1] AS name, url AS path FROM pages WHERE contains(lower(string_split(url, '/')[-1]), '{Q.NAME_QUERY}')",
    "search_extracts": _EXTRACTS.replace(f"contains(text, '{Q.ONE_QUERY}')", f"contains(replace(lower(text), '''', ''), '{Q.ONE_QUERY}')"),
    "commit_conflict": """SELECT doc_id, lang, n_chars, CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 4 = 1 THEN 1 ELSE 2 END AS writer, 2 AS tries, 3 AS snapshot FROM documents""",
    "auto_numbering": f"""{P}, v AS (SELECT doc_index AS doc, position AS seq, nullif((position * 7 + doc_index) % 6, 0) AS level FROM p), {_counters('v')}
SELECT doc, seq, level, number FROM n""",
    "docx_structure": f"""WITH {DOCS}, dl AS (SELECT doc_index, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d),
dk AS (SELECT *, (i * 5 + doc_index) % 9 AS k FROM dl),
given AS (SELECT 'd' || doc_index AS doc, i AS seq, CASE k WHEN 1 THEN '' WHEN 2 THEN '3.1. ' || line WHEN 3 THEN '« 2. ' || line ELSE line END AS text,
                 CASE k WHEN 4 THEN 'OiiSList2' WHEN 5 THEN 'Oii_S_List_3' END AS style, CASE WHEN k >= 6 THEN (k - 6)::VARCHAR END AS ilvl, CASE WHEN k >= 6 THEN '1' END AS num_id FROM dk
          UNION ALL SELECT * FROM {values(RAW)}),
raw AS (SELECT doc, seq, {_TRIM.format('text')} AS text, style, ilvl, num_id FROM given),
k AS (SELECT * FROM raw WHERE text <> '' AND NOT starts_with(text, 'ПОГОДЖЕНО') AND NOT starts_with(text, 'Документ підготовлено')),
b AS (SELECT *, lead(seq) OVER w AS nxt, row_number() OVER w AS rn FROM k WINDOW w AS (PARTITION BY doc ORDER BY seq)),
e AS (SELECT b.*, CASE WHEN nxt IS NULL THEN 0 ELSE (SELECT count(*) FROM raw x WHERE x.doc = b.doc AND x.text = '' AND x.seq < nxt AND (x.seq > b.seq OR rn = 1)) END AS breaks FROM b),
v AS (SELECT *, CASE WHEN regexp_matches(text, '^\\s*Підстава:') OR regexp_matches(text, '^\\s*[0-9]+(\\.[0-9]+)*\\.\\s+') THEN NULL
             WHEN regexp_matches(text, '^\\s*«\\s*[0-9]+(\\.[0-9]+)*\\.\\s+') THEN {_LISTED}
             ELSE coalesce({_LISTED}, CASE style WHEN 'OiiSList2' THEN 2 WHEN 'Oii_S_List_3' THEN 3 END) END AS level FROM e), {_counters('v')},
s AS (SELECT *, count(number) OVER (PARTITION BY doc ORDER BY seq) AS sec FROM n)
SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY seq) - 1 AS position, trim(coalesce(number, '') || text) AS text,
       (CASE WHEN lead(sec) OVER (PARTITION BY doc ORDER BY seq) IS NOT DISTINCT FROM sec THEN 0 ELSE breaks END)::BIGINT AS line_breaks_after FROM s""",
    "line_breaks": f"""WITH {DOCS}, l AS (SELECT doc_index AS doc, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM d),
r AS (SELECT doc, seq, CASE WHEN (seq + doc) % 4 = 0 THEN '' ELSE {_TRIM.format('t')} END AS t FROM l),
k AS (SELECT doc, seq, lead(seq) OVER w AS nxt, row_number() OVER w AS rn FROM r WHERE t <> '' WINDOW w AS (PARTITION BY doc ORDER BY seq))
SELECT k.doc, k.seq, CASE WHEN nxt IS NULL THEN 0 ELSE nxt - seq - 1 + CASE WHEN rn = 1 THEN seq ELSE 0 END END::BIGINT AS breaks FROM k""",
    "parent_headings": _parents(),
    "section_parent_asof": f"""{P} SELECT doc_index, position, CASE WHEN position <= 2 THEN NULL ELSE (position - 3) // 6 * 6 + 2 END::BIGINT AS section FROM p""",
    "followup_personal": f"""{_AFTER} SELECT doc_index, match_position, position, text FROM r a WHERE NOT EXISTS (
  SELECT 1 FROM r b WHERE b.doc_index = a.doc_index AND b.match_position = a.match_position AND b.position <= a.position
    AND (starts_with(b.text, '§') OR regexp_matches(lower(trim(b.text)), '{_STOPS}') OR regexp_matches(trim(b.text), '^[0-9]+\\.\\s')))""",
    "followup_section": f"""{_AFTER}, f AS (SELECT *, starts_with(trim(lower(text)), 'підстава') AS basis, regexp_extract(trim(text), '^([0-9]+)\\.', 1) AS n,
  regexp_extract(trim(match_text), '^([0-9]+)\\.', 1) AS m, regexp_matches(lower(trim(text)), '{_STOPS}') AS shut FROM r),
g AS (SELECT *, NOT EXISTS (SELECT 1 FROM f b WHERE b.doc_index = a.doc_index AND b.match_position = a.match_position AND (b.basis AND b.position < a.position
    OR NOT b.basis AND b.position <= a.position AND b.n <> '' AND b.m <> '' AND b.n <> b.m)) AS open,
  EXISTS (SELECT 1 FROM f b WHERE b.doc_index = a.doc_index AND b.match_position = a.match_position AND b.position <= a.position AND b.shut) AS shut_by_now FROM f a)
SELECT doc_index, match_position, position, text, CASE WHEN basis THEN 'basis' ELSE 'followup' END AS kind FROM g WHERE open AND (basis OR n = '' AND NOT shut_by_now)""",
    "heading_classes": f"""{_ALL_LINES} SELECT doc_index, position, {_LEVEL} AS level,
  CASE WHEN regexp_matches(text, '^[0-9]+\\.\\s+') AND contains(text, '{T.ARRIVALS}') THEN 'arrivals' WHEN regexp_matches(text, '^[0-9]+\\.\\s+') AND contains(text, '{T.DEPARTURES}')
  THEN 'departures' WHEN starts_with(text, '§') THEN 'section' END AS category, {_IN_DOCUMENT} AS in_document FROM l""",
    "match_extracts": _EXTRACTS,
    "document_view": _view(),
    "highlight_marks": rf"{P} SELECT doc_index, position, regexp_replace(text, '(that)', '<mark>\1</mark>', 'gi') AS marked FROM p WHERE contains(replace(lower(text), '''', ''), 'that')",
    "highlight_sequences": _sequence(),
    "search_stored": f"{PD} {_results(Q.WIDE_QUERY, True)}",
    "search_request": f"""{PD}, f AS ({_results(Q.NEAR_QUERY, True, 'remaining')}) SELECT *, (SELECT count(*) FROM f) AS count, (SELECT count(*) FROM d) AS total_count FROM f""",
    "postings_changes": f"""WITH {DOCS}, {_lines('d', 'p')}, {_tokens('p', 'tok')}, {_HALVED}, {_lines('e', 'p2')}, {_tokens('p2', 'tok2')},
o AS (SELECT term, doc_index, count(DISTINCT position) AS n FROM tok GROUP BY ALL), w AS (SELECT term, doc_index, count(DISTINCT position) AS n FROM tok2 GROUP BY ALL),
c AS (SELECT coalesce(o.term, w.term) AS term, coalesce(o.n, 0) AS a, coalesce(w.n, 0) AS b FROM o FULL JOIN w ON o.term = w.term AND o.doc_index = w.doc_index),
t AS (SELECT term, max(a) AS a, max(b) AS b FROM c GROUP BY term)
SELECT (SELECT count(*) FROM t WHERE a = 0) AS terms_added, (SELECT count(*) FROM t WHERE b = 0) AS terms_removed, count(*) FILTER (a = 0) AS postings_added,
       count(*) FILTER (b = 0) AS postings_removed, sum(greatest(b - a, 0))::BIGINT AS positions_added, sum(greatest(a - b, 0))::BIGINT AS positions_removed FROM c""",
    "index_repair": f"""{_BAD} SELECT count(*) FILTER (doc_index >= total) AS unknown_documents, count(*) FILTER (strlen(term) < 2 OR coalesce(len(ps), 0) = 0) AS cleaned,
  (SELECT coalesce(sum(k), 0)::BIGINT FROM (SELECT count(*) - 1 AS k FROM r, n WHERE doc_index < total AND strlen(term) >= 2 AND len(ps) > 0 GROUP BY term, doc_index)) AS duplicates FROM r, n""",
    "index_repaired": f"""{_BAD}, x AS (SELECT DISTINCT term, doc_index, unnest(ps) AS position FROM r, n WHERE doc_index < total AND strlen(term) >= 2)
SELECT term, doc_index, {_FLAT} FROM x GROUP BY term, doc_index""",
    "full_document_flags": f"""{P}, m AS ({_matches(Q.NEAR_QUERY, False)})
SELECT doc_index, position, (doc_index, text) IN (SELECT (doc_index, text) FROM m) AS is_match FROM p""",
    "conversation_search": f"""WITH p AS (SELECT conv_id AS doc_index, turn::BIGINT AS position, text FROM conversations), {_tokens('p', 'tok')},
pd AS (SELECT DISTINCT term, doc_index, position FROM tok WHERE term IN ({_ins(_NEAR_WORDS)}))
SELECT doc_index, count(DISTINCT position)::BIGINT AS n_positions FROM pd GROUP BY doc_index HAVING count(DISTINCT term) = 2""",
    "event_feed_latest": "SELECT user_id, count(*) AS n, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id",
}
# Files hold what was put into them.
ORACLE["batch_search_stored"] = ORACLE["batch_search"]
ORACLE["batch_search_bucketed"] = _SEGMENTED + ORACLE["batch_search"].removeprefix(PD)
# The same queries by scan: words are parts of words, and no posting is needed.
ORACLE["batch_scan"] = ORACLE["batch_search"].split("h AS (")[0] + f"""t AS (SELECT query_id, a, b, doc_index, position, replace(lower(text), '''', '') AS t FROM q JOIN p ON contains(replace(lower(text), '''', ''), a) AND contains(replace(lower(text), '''', ''), b)),
k AS (SELECT *, substr(t, strpos(t, a) + length(a)) AS rest FROM t)
SELECT query_id, doc_index, count(*) AS n_matches FROM k WHERE strpos(rest, b) > 0 AND strlen(substr(rest, 1, strpos(rest, b) - 1)) <= {T.NEAR_BYTES} GROUP BY ALL"""
ORACLE["docx_containers"] = ORACLE["docx_folder"] = ORACLE["docx_structure"]
# Files in the order of their paths, those that came later after the others.
ORACLE["refresh_folder"] = f"""WITH f AS ({ORACLE["docx_structure"]}), n AS (SELECT 'd' || (row_number() OVER (ORDER BY doc_id) - 1) AS doc FROM documents
  UNION ALL SELECT DISTINCT doc FROM {values(RAW)}),
o AS (SELECT doc, row_number() OVER (ORDER BY coalesce(try_cast(substr(doc, 2) AS INTEGER), 0) % 3 = 0, doc) - 1 AS doc_index FROM n)
SELECT doc_index, doc || '.docx' AS file_name, position, text, line_breaks_after FROM f JOIN o USING (doc)"""
ORACLE["listing_events"] = """WITH p AS (SELECT page_id || '/' || url AS path, length(html)::BIGINT AS size, page_id, n AS pass FROM pages, range(1, 5) t(n)),
h AS (SELECT *, pass < 4 AND (page_id + pass) % 4 <> 0 AS here, CASE WHEN page_id % 5 = 0 AND pass = 3 THEN 2 ELSE 1 END::BIGINT AS mtime_s FROM p),
b AS (SELECT a.path, a.size, a.pass, a.here, a.mtime_s, coalesce(x.here, false) AS before, x.mtime_s AS old FROM h a LEFT JOIN h x ON x.page_id = a.page_id AND x.pass = a.pass - 1)
SELECT path, CASE WHEN here AND NOT before THEN 'new' WHEN here THEN 'changed' ELSE 'deleted' END AS event, size, CASE WHEN here THEN mtime_s ELSE old END AS mtime_s, pass
FROM b WHERE here <> before OR here AND mtime_s <> old"""
