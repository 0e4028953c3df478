"""The registered queries in ANSI SQL, for a second engine to check. Built from shared blocks of WITH clauses."""

from __future__ import annotations

from postlark.functions.lookups import COUNTRY_CODES, STATE_CODES
from postlark.profiles import Profile
from postlark.views import P0, P0_EDITED, P1, PLACES, SCRAPE_NOW

DAY = "DATE '2024-01-31'"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
SCRAPED = f"TIMESTAMP '{SCRAPE_NOW}'"


def quoted(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def mapped(table: dict[str, str], key: str) -> str:
    pairs = ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in table.items())
    return f"map_extract_value(MAP {{{pairs}}}, {key})"


def squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


RAW = f"""
raw AS (
  SELECT d.doc_id AS id, d.source AS source, CAST(d.doc_id AS VARCHAR) AS source_id,
    'https://jobs.example.com/' || d.doc_id AS url, split_part(d.text, '.', 1) AS title, s.s_name AS company,
    {listed(p[0] for p in PLACES)}[d.n_chars % 12 + 1] AS raw_city,
    {listed(p[1] for p in PLACES)}[d.n_chars % 12 + 1] AS raw_state,
    coalesce({listed(p[2] for p in PLACES)}[d.n_chars % 12 + 1], n.n_name) AS raw_country,
    d.n_chars % 12 = 4 AS is_remote, d.text AS description,
    CAST(floor(e.value * 1000) AS DOUBLE) AS comp_min,
    CASE WHEN d.n_chars % 3 <> 0 THEN CAST(floor(e.value * 1000) + (d.n_chars % 7) * 1000 AS DOUBLE) END AS comp_max,
    ['yearly', 'monthly', 'hourly', NULL][d.n_chars % 4 + 1] AS comp_interval,
    CASE WHEN d.n_chars % 11 <> 0 THEN CAST({DAY} - CAST(d.n_chars % 40 AS INTEGER) AS DATE) END AS date_posted,
    e.ts AS date_scraped, e.event_type AS search_term, d.n_chars AS n_chars,
    CASE WHEN d.doc_id % 13 = 0 THEN 'applied' WHEN d.doc_id % 17 = 0 THEN 'rejected'
      WHEN d.doc_id % 29 = 0 THEN 'interview' WHEN d.doc_id % 31 = 0 THEN 'offer' ELSE 'new' END AS raw_status
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id
  LEFT JOIN supplier s ON s.s_suppkey = d.n_chars % (SELECT count(*) FROM supplier) LEFT JOIN nation n ON n.n_nationkey = d.n_chars % 25)"""


def located(src: str, out: str) -> str:
    """Normalised places for a source with raw_city, raw_state, raw_country and is_remote."""
    return f"""
{out}_1 AS (
  SELECT *, nullif(trim(raw_city), '') AS c0, nullif(trim(raw_state), '') AS s, nullif(trim(raw_country), '') AS n FROM {src}),
{out}_2 AS (SELECT *, CASE WHEN is_remote AND lower(c0) = 'remote' THEN NULL ELSE c0 END AS c FROM {out}_1),
{out}_3 AS (
  SELECT *, {mapped(STATE_CODES, "lower(c)")} AS c_state, {mapped(COUNTRY_CODES, "lower(c)")} AS c_country,
    {mapped(STATE_CODES, "lower(s)")} AS s_state, {mapped(COUNTRY_CODES, "lower(s)")} AS s_country FROM {out}_2),
{out}_4 AS (
  SELECT *, CASE WHEN c_state IS NOT NULL AND s_country IS NOT NULL THEN 'shifted'
    WHEN s IS NULL AND c_country IS NOT NULL THEN 'city'
    WHEN s_country IS NOT NULL AND s_state IS NULL THEN 'state' ELSE '' END AS how FROM {out}_3),
{out}_5 AS (
  SELECT *, CASE WHEN how IN ('shifted', 'city') THEN NULL ELSE c END AS city,
    CASE how WHEN 'shifted' THEN c_state WHEN 'state' THEN NULL ELSE s END AS s5,
    CASE how WHEN 'shifted' THEN s_country WHEN 'state' THEN s_country WHEN 'city' THEN c_country ELSE n END AS n5
  FROM {out}_4),
{out} AS (
  SELECT * EXCLUDE (c0, s, n, c, c_state, c_country, s_state, s_country, how, s5, n5),
    coalesce({mapped(STATE_CODES, "trim(regexp_replace(lower(s5), ' (metropolitan|metro) area$', ''))")},
      CASE WHEN list_contains({listed(sorted(STATE_CODES.values()))}, upper(s5)) THEN upper(s5) END, s5) AS state,
    coalesce({mapped(COUNTRY_CODES, "lower(n5)")},
      CASE WHEN list_contains({listed(sorted(set(COUNTRY_CODES.values())))}, upper(n5)) THEN upper(n5) END, n5) AS country
  FROM {out}_5)"""


def content_key(prefix: int | None = None) -> str:
    said = "description" if prefix is None else f"substr(description, 1, {prefix})"
    return f"""substr(sha256(concat_ws('|', {squeezed("lower(coalesce(title, ''))")}, {squeezed("lower(company)")},
  {squeezed("lower(coalesce(city, ''))")}, trim(lower(coalesce(state, ''))),
  coalesce(strftime(date_posted, '%Y-%m-%d'), ''), {squeezed(f"lower({said})")})), 1, 16)"""


CONTENT_KEY = content_key()

POSTINGS = (
    RAW
    + ","
    + located("raw", "placed")
    + f""",
postings AS (
  SELECT *, substr(sha256(source || ':' || source_id), 1, 16) AS dedup_key, {CONTENT_KEY} AS content_key FROM placed)"""
)


def found(column: str, words: list[str]) -> str:
    return "(" + (" OR ".join(f"contains({column}, {quoted(w.lower())})" for w in words) or "FALSE") + ")"


def counted(column: str, words: list[str]) -> str:
    return "(" + (" + ".join(f"CAST(contains({column}, {quoted(w.lower())}) AS INTEGER)" for w in words) or "0") + ")"


def broken(p: Profile) -> str:
    tests = [f"regexp_matches({f}, {quoted(x)})" for f, xs in p.dealbreakers.items() for x in xs]
    return "(" + (" OR ".join(tests) or "FALSE") + ")"


def scored(p: Profile, src: str, out: str) -> str:
    """Adds hits, the four components, broken and score."""
    hits = ", ".join(
        f"{counted('_text', p.keywords.get(t, []))} AS {t}_hits" for t in ("critical", "strong", "moderate", "weak")
    )
    tiers = " ".join(
        f"WHEN {found('lower(company)', p.companies.get(t, []))} THEN {n}" for t, n in (("tier1", 15), ("tier2", 10), ("tier3", 6))
    )
    signals = ", ".join(
        f"CASE WHEN contains(lower(title), {quoted(s.lower())}) THEN {n} ELSE 0 END" for s, n in p.title_signals
    )
    return f"""
{out}_t AS (SELECT *, lower(title || ' ' || description) AS _text FROM {src}),
{out}_h AS (SELECT *, {hits}, {broken(p)} AS broken FROM {out}_t),
{out}_c AS (
  SELECT * EXCLUDE (_text),
    CAST(CASE WHEN critical_hits = 0 THEN least(10, 2 * moderate_hits + weak_hits)
      ELSE least(55, least(25, 5 * critical_hits) + least(18, 3 * strong_hits)
        + least(9, CAST(floor(moderate_hits * 1.5) AS INTEGER)) + least(3, weak_hits)) END AS INTEGER) AS kw,
    CASE {tiers} ELSE 0 END AS co, least(20, greatest(0{", " + signals if signals else ""})) AS ti,
    CASE WHEN date_posted IS NULL THEN 3 WHEN {DAY} - date_posted <= 1 THEN 10 WHEN {DAY} - date_posted <= 3 THEN 8
      WHEN {DAY} - date_posted <= 7 THEN 5 WHEN {DAY} - date_posted <= 14 THEN 3 ELSE 1 END AS re
  FROM {out}_h),
{out} AS (SELECT *, CAST(CASE WHEN broken THEN 0 ELSE greatest(0, least(100, kw + co + ti + re)) END AS INTEGER) AS score FROM {out}_c)"""


def stored(p: Profile = P0) -> str:
    return (
        "WITH RECURSIVE "
        + POSTINGS
        + ","
        + scored(p, "postings", "sc")
        + """,
j AS (SELECT *, CASE WHEN broken AND raw_status = 'new' THEN 'filtered' ELSE raw_status END AS status FROM sc)"""
    )


J = stored()
ORDER = "score DESC, date_posted DESC NULLS LAST, id"

RUNS = """runs AS (
  SELECT event_id AS id, ts AS started_at, 'src' || (user_id % 20) AS site, event_type AS search_term,
    'loc' || (user_id % 3) AS location, CAST(floor(value / 25) AS INTEGER) AS jobs_found,
    CAST(floor(value / 50) AS INTEGER) AS jobs_new, CASE WHEN event_type = 'error' THEN 'timeout' END AS error
  FROM events)"""

CHANGES = """ev AS (
  SELECT event_id AS seq, CASE WHEN event_id % 97 = 0 THEN -user_id - 1 ELSE user_id END AS posting_id,
    CASE event_type WHEN 'signup' THEN 'applied' WHEN 'purchase' THEN 'offer' WHEN 'click' THEN 'interview'
      WHEN 'error' THEN 'rejected' END AS status,
    CASE WHEN event_id % 2 = 0 THEN '' ELSE 'n' || event_id END AS notes, CAST(ts AS DATE) AS event_date
  FROM events WHERE event_type <> 'view')"""


def grouped(x: str) -> str:
    """Whole dollars, rounded half to even, with thousands separators."""
    return f"'$' || format('{{:,}}', CAST(round_even({x}, 0) AS BIGINT))"


PLACE = """coalesce(nullif(concat_ws(', ', nullif(city, ''), nullif(state, ''), CASE WHEN is_remote THEN '(Remote)' END), ''), 'Unknown')"""
PAY = f"""CASE WHEN coalesce(comp_min, 0) = 0 THEN '' ELSE concat_ws(' ', {grouped("comp_min")},
  CASE WHEN coalesce(comp_max, 0) <> 0 AND comp_max <> comp_min THEN '- ' || {grouped("comp_max")} END,
  '/' || comp_interval) END"""


def thousands(x: str) -> str:
    return f"""CASE WHEN comp_min >= 1000 THEN '$' || CAST(round_even({x} / 1000, 0) AS BIGINT) || 'k'
      ELSE '$' || CAST(round_even({x}, 0) AS BIGINT) END"""


CONCISE = f"""CASE WHEN coalesce(comp_min, 0) = 0 THEN '' ELSE concat_ws('-', {thousands("comp_min")},
  CASE WHEN coalesce(comp_max, 0) <> 0 AND comp_max <> comp_min THEN {thousands("comp_max")} END) END"""


def escaped(x: str, channel: str) -> str:
    if channel == "telegram":
        return rf"regexp_replace({x}, '([_*\[\]()~`>#+\-=|{{}}.!])', '\\\1', 'g')"
    if channel == "discord":
        return rf"regexp_replace({x}, '([\\*_~`|])', '\\\1', 'g')"
    if channel == "slack":
        return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    if channel == "macos":
        return rf"""regexp_replace({x}, '([\\"])', '\\\1', 'g')"""
    return x


def message(channel: str) -> str:
    kw = "coalesce(CAST(CASE WHEN NOT broken THEN kw END AS VARCHAR), '?')"
    company, title = escaped("company", channel), escaped("title", channel)
    tag = "CASE WHEN id <> 0 THEN '#' || id || ' ' ELSE '' END"
    bar = " | "
    if channel == "telegram":
        bar, tag = r" \| ", r"CASE WHEN id <> 0 THEN '\#' || id || ' ' ELSE '' END"
    where = f"('  ' || {escaped(PLACE, channel)} || CASE WHEN {CONCISE} <> '' THEN '{bar}' || {escaped(CONCISE, channel)} ELSE '' END)"
    nl = "chr(10)"
    if channel == "email":
        return f"'[' || score || '] (kw:' || {kw} || ') ' || {tag} || {company} || ': ' || {title} || {nl} || {where} || {nl} || '  ' || url || {nl}"
    if channel == "telegram":
        return (
            rf"'*' || score || '* \(kw:' || {kw} || '\) \| ' || {tag} || '[' || {company} || ': ' || {title} || '](' || url || ')' "
            rf"|| {nl} || {where}"
        )
    if channel in ("slack", "discord"):
        mark = "*" if channel == "slack" else "**"
        return (
            f"'{mark}' || {company} || ': ' || {title} || '{mark}' || {nl} || 'Score: ' || score || ' | keywords: ' || {kw} || ' | ' "
            f"|| {tag} || {where} || {nl} || url"
        )
    return f"{company} || ': ' || {title} || ' (' || score || ')'"


# --- upsert, row by row ---

# Two batches: all postings, then the same again under their own key (every seventh) and a new one (every fifth).
ARRIVALS = """
again AS (
  SELECT 1 AS batch, 0 AS k, id, source, source_id, content_key, description, score, status FROM j
  UNION ALL
  SELECT 2, 0, id, source, source_id, content_key, description, score + id % 3 - 1, status FROM j WHERE id % 7 = 0
  UNION ALL
  SELECT 2, 1, id, source, source_id || 'b', content_key, description, score + id % 3 - 1, status FROM j WHERE id % 5 = 0),
arr AS (
  SELECT row_number() OVER (ORDER BY batch, id, k) - 1 AS seq, batch, id AS doc, source_id,
    substr(sha256(source || ':' || source_id), 1, 16) AS dk, content_key AS ck, TRUE AS long,
    CAST(score AS INTEGER) AS score, status
  FROM again)"""

# Keys and contents of inserted rows in order; a position in the list is the posting's id.
FOLD = """
fold AS (
  SELECT CAST(-1 AS BIGINT) AS seq, CAST([] AS VARCHAR[]) AS dks, CAST([] AS VARCHAR[]) AS cks, '' AS kind, CAST(0 AS BIGINT) AS target
  UNION ALL
  SELECT seq, CASE WHEN k = 0 AND c = 0 THEN list_append(dks, dk) ELSE dks END,
    CASE WHEN k = 0 AND c = 0 THEN list_append(cks, ck) ELSE cks END,
    CASE WHEN k > 0 THEN 'key' WHEN c > 0 THEN 'content' ELSE 'insert' END,
    CASE WHEN k > 0 THEN k WHEN c > 0 THEN c ELSE len(dks) + 1 END
  FROM (
    SELECT a.seq, f.dks, f.cks, a.dk, a.ck, CAST(coalesce(list_position(f.dks, a.dk), 0) AS BIGINT) AS k,
      CAST(CASE WHEN a.long THEN coalesce(list_position(f.cks, a.ck), 0) ELSE 0 END AS BIGINT) AS c
    FROM fold f JOIN arr a ON a.seq = f.seq + 1)),
events_of AS (SELECT a.*, f.kind, f.target FROM arr a JOIN fold f ON f.seq = a.seq),
base AS (
  SELECT target, max(seq) AS from_seq, coalesce(arg_min(status, seq) FILTER (status NOT IN ('new', 'filtered')), arg_max(status, seq)) AS status
  FROM events_of WHERE kind <> 'content' GROUP BY target),
settled AS (
  SELECT e.target AS id, max(e.score) AS score, any_value(b.status) AS status
  FROM events_of e JOIN base b ON b.target = e.target
  WHERE e.seq = b.from_seq OR (e.kind = 'content' AND e.seq > b.from_seq) GROUP BY e.target)"""

UPSERT = J + "," + ARRIVALS + "," + FOLD

# --- payload pages ---


def listed_items(site: str, limited: bool = False) -> str:
    """Rows the site's runs return, in order, with their page and position: all that landed, or a collector's share."""
    last = {"linkedin": "4", "glassdoor": "3", "bayt": "3"}.get(site, "CASE WHEN run_id % 6 = 5 THEN 1 ELSE 3 END")
    counts = "NOT (run_id % 7 = 6 AND page_no = 2)"
    if limited:
        counts = f"""page_no <= {last} AND (run_id % 7 <> 6 OR page_no < 2)
  QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY page_no, pos) <= 25"""
    return f"""
items AS (
  SELECT *, id // 40 AS run_id, CAST(id // 10 % 4 + 1 AS INTEGER) AS page_no, CAST(id % 10 AS INTEGER) AS pos,
    CAST(CASE WHEN id % 10 = 9 THEN id - 1 ELSE id END AS VARCHAR) AS listed,
    regexp_replace(trim(title), '\\s+', ' ', 'g') AS clean_title, {DAY} - date_posted AS days FROM raw),
kept AS (
  SELECT * FROM items WHERE pos < 9 AND {counts})"""


REMOTE = "(contains(lower({0}), 'remote') OR contains(lower({0}), 'work from home') OR contains(lower({0}), 'wfh'))"
BODY_TEXT = squeezed("description")


def site_rows(site: str, limited: bool = False) -> str:
    """CTEs ending in ``ext``: what the extractor should give, places still as read."""
    head = "WITH RECURSIVE " + RAW + "," + listed_items(site, limited)
    place = "concat_ws(', ', raw_city, raw_state)"
    parts = f"string_split({place}, ',')"
    two = f"len({parts}) >= 2"
    company = "CASE WHEN id % 4 <> 0 THEN company ELSE 'Unknown' END"
    no_pay = ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)", "CAST(NULL AS VARCHAR)")
    if site == "indeed":
        remote = REMOTE.format(f"(clean_title || ' ' || {BODY_TEXT})")
        unit = "id % 3 <> 2"
        cols = dict(
            url="'https://www.indeed.com/viewjob?jk=' || listed", title="clean_title", company=company,
            raw_city="raw_city", raw_state="raw_state", raw_country="raw_country", is_remote=remote,
            description=BODY_TEXT,
            job_types="'full_time'", date_posted="date_posted",
            pay=(f"CASE WHEN {unit} THEN comp_min END", f"CASE WHEN {unit} THEN comp_max END",
                 "CASE id % 3 WHEN 0 THEN 'hourly' WHEN 1 THEN 'yearly' END"),
        )
    elif site == "glassdoor":
        cols = dict(
            url="CASE WHEN id % 2 = 0 THEN 'https://www.glassdoor.com/job/' || listed ELSE 'https://www.glassdoor.com/job-listing/' || listed END",
            title="clean_title", company="CASE WHEN id % 4 <> 0 THEN company ELSE 'Alt ' || company END",
            raw_city=f"trim({parts}[1])", raw_state=f"CASE WHEN {two} THEN trim({parts}[2]) END", raw_country="'US'",
            is_remote=f"id % 5 = 0 OR {REMOTE.format(f'''(clean_title || ' ' || {place})''')}", description=BODY_TEXT,
            job_types="''", date_posted="date_posted",
            pay=("nullif(comp_min, 0)", "nullif(comp_max, 0)", "CASE WHEN id % 3 = 0 THEN 'hourly' ELSE 'yearly' END"),
        )
    elif site == "ziprecruiter":
        remote = REMOTE.format(f"(clean_title || ' ' || {BODY_TEXT} || ' ' || concat_ws(', ', nullif(raw_city, ''), raw_state))")
        cols = dict(
            url="url", title="clean_title", company=company, raw_city="raw_city", raw_state="raw_state",
            raw_country="raw_country", is_remote=remote, description=BODY_TEXT, job_types="''", date_posted="date_posted",
            pay=("nullif(comp_min, 0)", "nullif(comp_max, 0)", "CASE WHEN id % 5 = 0 THEN 'hourly' ELSE 'yearly' END"),
        )
    elif site == "linkedin":
        ok = "comp_max IS NOT NULL"
        cols = dict(
            url="'https://www.linkedin.com/jobs/view/' || listed", title="clean_title", company="company",
            raw_city=f"trim({parts}[1])", raw_state=f"CASE WHEN {two} THEN trim({parts}[2]) END", raw_country="'US'",
            # Here the flag is taken from the place as shown, so a lone 'Remote' city counts.
            is_remote=REMOTE.format(f"(clean_title || ' ' || {place})"), description="''", job_types="''",
            date_posted="date_posted",
            pay=(f"CASE WHEN {ok} THEN comp_min END", f"CASE WHEN {ok} THEN comp_max END", "CAST(NULL AS VARCHAR)"),
        )
    elif site == "bayt":
        spot = "trim(concat_ws(', ', raw_city, raw_country))"
        cols = dict(
            url="'https://www.bayt.com/en/job-' || listed", title="clean_title", company="company",
            raw_city=f"trim(string_split({spot}, ',')[1])", raw_state="CAST(NULL AS VARCHAR)",
            raw_country=f"CASE WHEN len(string_split({spot}, ',')) >= 2 THEN trim(string_split({spot}, ',')[-1]) END",
            is_remote=REMOTE.format(f"(clean_title || ' ' || {spot})"), description="''", job_types="''",
            date_posted=f"CASE WHEN date_posted IS NULL THEN NULL WHEN id % 2 = 0 THEN date_posted ELSE {DAY} END",
            pay=no_pay,
        )
    else:
        types = " , ".join(
            f"CASE WHEN regexp_matches(description, '(?i){p}') THEN '{t}' END"
            for t, p in (("full_time", r"full\s?time"), ("part_time", r"part\s?time"), ("internship", "internship"), ("contract", "contract"))
        )
        cols = dict(
            url="'https://x.example/' || listed", title="clean_title", company="company",
            raw_city=f"CASE WHEN {two} THEN trim({parts}[1]) END", raw_state=f"CASE WHEN {two} THEN trim({parts}[2]) END",
            raw_country="CAST(NULL AS VARCHAR)",
            is_remote=REMOTE.format(f"(clean_title || ' ' || description || ' ' || {place})"), description="description",
            job_types=f"concat_ws(',', {types})", date_posted="date_posted", pay=no_pay,
        )
    source_id = "CASE WHEN id % 2 = 0 THEN listed ELSE 'https://x.example/' || listed END" if site == "google" else "listed"
    low, high, interval = cols.pop("pay")
    chosen = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    return f"""{head},
ext AS (
  SELECT run_id, page_no, pos, '{site}' AS source, {source_id} AS source_id, {chosen}, {low} AS comp_min, {high} AS comp_max,
    {interval} AS comp_interval, search_term, date_scraped FROM kept)"""


def extraction(site: str, limited: bool = False) -> str:
    return f"""{site_rows(site, limited)},{located("ext", "clean")}
SELECT run_id, page_no, pos, source, source_id, url, title, company, city, state, country, is_remote,
  CAST(length(description) AS INTEGER) AS description_chars, md5(description) AS description_md5, job_types, comp_min, comp_max, comp_interval, date_posted FROM clean"""


def ingested(site: str, limited: bool = False) -> str:
    """A whole ingest of the site's payloads into an empty store."""
    key, long = (content_key(500), "length(description) > 100") if limited else (CONTENT_KEY, "TRUE")
    return f"""{site_rows(site, limited)},{located("ext", "clean")},{scored(P0, "clean", "sc")},
arr AS (
  SELECT row_number() OVER (ORDER BY run_id, page_no, pos) - 1 AS seq, *,
    substr(sha256(source || ':' || source_id), 1, 16) AS dk, {key} AS ck, {long} AS long,
    CASE WHEN broken THEN 'filtered' ELSE 'new' END AS status
  FROM sc),{FOLD}"""


def list_sql(where: str = "", limit: str = "") -> str:
    return f"{J} SELECT id, score, status, company, date_posted FROM j {where} ORDER BY {ORDER} {limit}"


def matches(floor: int) -> str:
    return f"{J}, m AS (SELECT * FROM j WHERE status = 'new' AND score >= {floor} AND date_scraped >= {SCRAPED} - INTERVAL 24 HOUR)"


def report_list(where: str) -> str:
    return f"""{matches(40)}
SELECT CAST(row_number() OVER (ORDER BY {ORDER}) AS INTEGER) AS rank, id, score, title, company, {PLACE} AS location, {CONCISE} AS comp, url
FROM m WHERE {where} ORDER BY rank LIMIT 20"""


RESCORED = f"""{J},{scored(P0_EDITED, "(SELECT * EXCLUDE (critical_hits, strong_hits, moderate_hits, weak_hits, kw, co, ti, re, broken), score AS old_score, kw AS old_kw, broken AS old_broken FROM j) z", "again_scored").replace("again_scored_t AS (SELECT *,", "again_scored_t AS (SELECT * EXCLUDE (score),")},
rs AS (SELECT *, CASE WHEN broken AND status = 'new' THEN 'filtered' WHEN NOT broken AND status = 'filtered' THEN 'new' ELSE status END AS new_status FROM again_scored)"""

KEEPERS = f"""{J}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY content_key ORDER BY CASE status WHEN 'offer' THEN 0 WHEN 'interview' THEN 1 WHEN 'applied' THEN 2
    WHEN 'new' THEN 3 WHEN 'filtered' THEN 4 WHEN 'rejected' THEN 5 ELSE 99 END, score DESC, date_scraped, id) AS rn,
    count(*) OVER (PARTITION BY content_key) AS cnt FROM j)"""

DECODED = "x"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "),
                       ("&middot;", "·"), ("&copy;", "©"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&")):
    DECODED = f"replace({DECODED}, '{_entity}', '{_char}')"

CURRENCY_TEXT = """CASE doc_id % 6 WHEN 0 THEN '$' || n_chars || '.50' WHEN 1 THEN n_chars || ',25 EUR' WHEN 2 THEN '1.' || n_chars || ',5'
  WHEN 3 THEN 'USD -' || n_chars WHEN 4 THEN lang ELSE '$' || n_chars || ',000 - $' || (n_chars + 5) || ',000' END"""

AGE_TEXT = """CASE doc_id % 5 WHEN 0 THEN n_chars % 40 || ' days ago' WHEN 1 THEN n_chars % 20 || ' Hours ago'
  WHEN 2 THEN 'today' WHEN 3 THEN 'posted ' || n_chars % 9 || ' weeks ago' ELSE '30+ days ago' END"""


def queries() -> dict[str, str]:
    multi = " UNION ALL ".join(
        f"SELECT '{p.name}' AS profile, id, score, CASE WHEN NOT broken THEN kw END AS keyword, CASE WHEN NOT broken THEN ti END AS title_points FROM s_{p.name}"
        for p in (P0, P1)
    )
    breakdown = ", ".join(f"CASE WHEN NOT broken THEN {c} END AS {n}" for c, n in (("kw", "keyword"), ("co", "company_points"), ("ti", "title_points"), ("re", "recency")))
    channels = ["email", "telegram", "slack", "discord", "macos"]
    digest = f"""{matches(P0.min_alert_score)},
d AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rank, count(*) OVER () AS matches FROM m)"""
    states = "is_remote OR state IS NULL OR state IN ('CA', 'TX')"
    out = {
        # scoring
        "flagship_top_matches": f"{J} SELECT id, score, title, company, {PLACE} AS location, date_posted, status FROM j WHERE score >= 20 ORDER BY {ORDER} LIMIT 30",
        "stored_postings": f"{J} SELECT id, score, status, dedup_key, content_key FROM j",
        "score_breakdown": f"{J} SELECT id, score, {breakdown}, broken AS dealbreaker FROM j",
        "dealbreaker_rows": f"{J} SELECT id, company, status FROM j WHERE broken",
        "keyword_hits_by_tier": f"{J} SELECT id, critical_hits, strong_hits, moderate_hits, weak_hits, kw AS keyword FROM j",
        "company_tier": f"{J} SELECT co AS company_points, count(*) AS cnt FROM j GROUP BY 1",
        "title_signal": f"{J} SELECT ti AS title_points, count(*) AS cnt FROM j GROUP BY 1",
        "recency_bucket": f"{J} SELECT re AS recency, count(*) AS cnt FROM j GROUP BY 1",
        "multi_profile_scores": f"WITH RECURSIVE {POSTINGS},{scored(P0, 'postings', 's_p0')},{scored(P1, 'postings', 's_p1')} {multi}",
        "multi_profile_top": f"""WITH RECURSIVE {POSTINGS},{scored(P0, 'postings', 's_p0')},{scored(P1, 'postings', 's_p1')},
          u AS (SELECT 'p0' AS profile, id, score, date_posted FROM s_p0 UNION ALL SELECT 'p1', id, score, date_posted FROM s_p1)
          SELECT profile, CAST(row_number() OVER (PARTITION BY profile ORDER BY {ORDER}) AS INTEGER) AS rank, id, score FROM u
          QUALIFY rank <= 20""",
        "max_achievable": """WITH k AS (SELECT 'p' || c_custkey AS profile, count(*) FILTER (c_nationkey % 5 = 0) AS c,
            count(*) FILTER (c_nationkey % 5 = 1) AS s, count(*) FILTER (c_nationkey % 5 IN (2, 3)) AS g FROM customer GROUP BY 1),
          t AS (SELECT DISTINCT 'p' || c_custkey AS profile, c_nationkey * 4 AS alert FROM customer),
          co AS (SELECT DISTINCT 'p' || (s_suppkey * 3) AS profile FROM supplier),
          sg AS (SELECT DISTINCT 'p' || o_custkey AS profile FROM orders),
          b AS (SELECT t.*, coalesce(c, 0) AS c, coalesce(s, 0) AS s, coalesce(g, 0) AS g,
            CAST(10 + CASE WHEN c > 0 THEN 55 WHEN g > 0 THEN 10 ELSE 0 END + CASE WHEN co.profile IS NOT NULL THEN 15 ELSE 0 END
              + CASE WHEN sg.profile IS NOT NULL THEN 20 ELSE 0 END AS INTEGER) AS max_score
            FROM t LEFT JOIN k USING (profile) LEFT JOIN co USING (profile) LEFT JOIN sg USING (profile))
          SELECT profile, max_score, alert > max_score AS alert_unreachable, alert < 20 AS alert_below_display,
            c + s + g = 0 AS no_keywords, c = 0 AND s > 0 AND g = 0 AS strong_ignored, c = 0 AND g > 0 AS keyword_score_capped FROM b""",
        # scalar functions
        "dedup_key": f"WITH {POSTINGS} SELECT id, dedup_key FROM postings",
        "content_key": f"WITH {POSTINGS} SELECT id, content_key FROM postings",
        "location_normalised": f"WITH {POSTINGS} SELECT id, city, state, country, {PLACE} AS display FROM postings",
        "location_fix_counts": f"""WITH {POSTINGS}, x AS (SELECT *, raw_city <> '' AND raw_city IS NOT NULL AND city IS NULL AS gone,
            state IS DISTINCT FROM raw_state AS state_moved FROM postings
            WHERE city IS DISTINCT FROM raw_city OR state IS DISTINCT FROM raw_state OR country IS DISTINCT FROM raw_country)
          SELECT CASE WHEN gone AND lower(raw_city) = 'remote' THEN 'remote_cleared' WHEN gone AND state_moved THEN 'fields_shifted'
            WHEN gone THEN 'country_from_city' WHEN coalesce(raw_state, '') <> '' AND state IS NULL THEN 'country_from_state'
            WHEN coalesce(raw_state, '') <> '' AND state_moved THEN 'state_abbreviated'
            WHEN coalesce(raw_country, '') <> '' AND country IS DISTINCT FROM raw_country THEN 'country_normalized' ELSE 'other' END AS reason,
            count(*) AS cnt FROM x GROUP BY 1""",
        "comp_display": f"WITH {RAW} SELECT id, {PAY} AS pay, {CONCISE} AS concise FROM raw",
        "emails": r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}'), ',') AS emails FROM documents",
        "job_types": r"""SELECT page_id, concat_ws(',', CASE WHEN regexp_matches(html, '(?i)full\s?time') THEN 'full_time' END,
            CASE WHEN regexp_matches(html, '(?i)part\s?time') THEN 'part_time' END, CASE WHEN regexp_matches(html, '(?i)internship') THEN 'internship' END,
            CASE WHEN regexp_matches(html, '(?i)contract') THEN 'contract' END) AS job_types FROM pages""",
        "remote_flag": f"WITH {RAW} SELECT id, {REMOTE.format('''(title || ' ' || description || ' ' || coalesce(raw_city, ''))''')} AS remote FROM raw",
        "html_text": rf"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html,
            '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<template\b.*?</template\s*>|<!--.*?-->', ' ', 'g'),
            '<[a-zA-Z/!?][^>]*>', ' ', 'g') AS x FROM pages) SELECT page_id, {squeezed(DECODED)} AS text FROM t""",
        "currency_parse": rf"""WITH t AS (SELECT doc_id, regexp_replace({CURRENCY_TEXT}, '[^-0-9.,]', '', 'g') AS k, {CURRENCY_TEXT} AS x FROM documents),
          u AS (SELECT *, CASE WHEN length(k) > 3 THEN regexp_replace(substr(k, 1, length(k) - 3), '[.,]', '', 'g') ELSE '' END AS head,
            CASE WHEN length(k) > 3 THEN substr(k, length(k) - 2) ELSE k END AS tail FROM t)
          SELECT doc_id, TRY_CAST(CASE WHEN contains(tail, '.') THEN head || tail ELSE replace(head || tail, ',', '.') END AS DOUBLE) AS amount,
            CASE WHEN doc_id % 6 = 5 THEN CAST(n_chars_of * 1000 AS DOUBLE) END AS low, CASE WHEN doc_id % 6 = 5 THEN CAST((n_chars_of + 5) * 1000 AS DOUBLE) END AS high
          FROM (SELECT u.*, d.n_chars AS n_chars_of FROM u JOIN documents d USING (doc_id))""",
        "posted_date_parse": f"""WITH t AS (SELECT doc_id, {AGE_TEXT} AS x FROM documents),
          u AS (SELECT doc_id, x, CAST(nullif(regexp_extract(x, '[0-9]+'), '') AS INTEGER) AS n FROM t)
          SELECT doc_id, CAST({DAY} - n AS DATE) AS ignoring_unit, CAST({DAY} - CASE WHEN contains(lower(x), 'hour') THEN 0 ELSE n END AS DATE) AS hours_today,
            CASE WHEN contains(x, 'day') THEN CAST({DAY} - coalesce(n, 0) AS DATE) END AS days_only FROM u""",
        "place_split": """WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN source || ', ' || lang
            WHEN 2 THEN source || ',' || lang || ' , x' ELSE '' END AS p FROM documents), u AS (SELECT *, string_split(p, ',') AS s FROM t)
          SELECT doc_id, CASE WHEN len(s) >= 2 THEN trim(s[1]) ELSE p END AS linkedin_city, CASE WHEN len(s) >= 3 THEN trim(s[3]) ELSE 'US' END AS linkedin_country,
            CASE WHEN len(s) >= 2 THEN trim(s[2]) END AS glassdoor_state, CASE WHEN len(s) >= 2 THEN trim(s[1]) END AS google_city,
            CASE WHEN len(s) >= 2 THEN trim(s[-1]) END AS bayt_country FROM u""",
        "profile_names": r"""SELECT page_id, CASE WHEN x = '' THEN 'default' ELSE x END AS name FROM
          (SELECT page_id, lower(trim(regexp_replace(url, '[^a-zA-Z0-9_-]', '-', 'g'), '-')) AS x FROM pages)""",
        "escaped_texts": "SELECT conv_id, turn, " + ", ".join(f"{escaped('text', c)} AS {c}" for c in channels[1:]) + " FROM conversations",
        "age_labels": f"""WITH {RAW} SELECT id, CASE WHEN date_posted IS NULL THEN '?' WHEN {DAY} - date_posted > 0 THEN ({DAY} - date_posted) || 'd'
          ELSE 'today' END AS posted FROM raw""",
        # filters and lists
        "list_filtered": list_sql("WHERE status = 'new' AND score >= 20 AND company ILIKE '%r#00000000%' AND source = 'src1' AND date_scraped >= TIMESTAMP '2024-01-01 12:00:00'", "LIMIT 50"),
        "list_page": list_sql("", "LIMIT 50 OFFSET 100"),
        "deep_page": list_sql("", "LIMIT 50 OFFSET 600"),
        "list_view": f"""{J} SELECT id, score, company, title, {PLACE} AS location,
          CASE WHEN date_posted IS NULL THEN '?' WHEN {DAY} - date_posted > 0 THEN ({DAY} - date_posted) || 'd' ELSE 'today' END AS posted,
          source AS src FROM j WHERE status = 'filtered' ORDER BY {ORDER} LIMIT 30""",
        "list_view_cut": f"""{J} SELECT id, score, substr(company, 1, 14) AS company, substr(title, 1, 32) AS title, substr({PLACE}, 1, 16) AS location,
          CASE WHEN date_posted IS NULL THEN '?' WHEN {DAY} - date_posted > 0 THEN ({DAY} - date_posted) || 'd' ELSE 'today' END AS posted,
          substr(source, 1, 4) AS src FROM j WHERE status = 'filtered' ORDER BY {ORDER} LIMIT 30""",
        "posted_range": list_sql("WHERE date_posted IS NULL OR (date_posted >= DATE '2024-01-10' AND date_posted <= DATE '2024-01-20')"),
        "fresh_postings": list_sql("WHERE date_posted IS NULL OR date_posted >= DATE '2024-01-28'"),
        "alert_state_filter": f"{J} SELECT id, state, is_remote FROM j WHERE {states}",
        "recent_context": list_sql("WHERE date_scraped >= TIMESTAMP '2024-01-02 00:00:00' OR status IN ('applied', 'interview', 'offer')", "LIMIT 50"),
        "context_lines": f"""{J} SELECT id, '#' || id || ' | ' || company || ' | ' || title || ' | ' || {PLACE} || ' | score:' || score || ' | status:' || status AS line
          FROM j WHERE date_scraped >= TIMESTAMP '2024-01-02 00:00:00' OR status IN ('applied', 'interview', 'offer') ORDER BY {ORDER} LIMIT 50""",
        "existing_keys": f"{J} SELECT id, dedup_key FROM j WHERE dedup_key IN (SELECT substr(sha256(source || ':' || event_id), 1, 16) FROM events JOIN documents ON doc_id = event_id WHERE event_type = 'error')",
        "rehydrated": f"""WITH {POSTINGS} SELECT id, city, state, country, CASE WHEN id % 4 <> 0 THEN comp_min END AS comp_min,
          CASE WHEN id % 4 <> 0 THEN comp_max END AS comp_max, CASE WHEN id % 3 = 0 THEN 'n' ELSE '' END AS notes FROM postings""",
        "export_rows": f"""{J} SELECT id, score, company, title, {PLACE} AS location, {PAY} AS salary, coalesce(strftime(date_posted, '%Y-%m-%d'), '') AS date_posted,
          source, status, url FROM j""",
        # statistics
        "by_status": f"{J} SELECT status, count(*) AS cnt FROM j GROUP BY 1",
        "total_count": f"{J} SELECT count(*) AS total FROM j",
        "by_source": f"{J} SELECT source, count(*) AS cnt FROM j GROUP BY 1",
        "score_tiers": f"""{J} SELECT CASE WHEN score >= 80 THEN 'excellent (80+)' WHEN score >= 55 THEN 'good (55-79)' WHEN score >= 30 THEN 'review (30-54)'
          ELSE 'low (<30)' END AS tier, count(*) AS cnt FROM j WHERE score > 0 GROUP BY 1""",
        "by_search_term": f"{J} SELECT search_term, count(*) AS cnt, round(avg(score), 1) AS avg_score FROM j WHERE search_term IS NOT NULL AND status <> 'filtered' GROUP BY 1",
        "alert_stats": f"""{J} SELECT count(*) FILTER (status = 'new') AS total_new, count(*) FILTER (r) AS scraped, count(*) FILTER (r AND score >= 55) AS high_count,
          count(*) FILTER (r AND score >= 40 AND score < 55) AS medium_count FROM (SELECT *, date_scraped >= {SCRAPED} - INTERVAL 24 HOUR AS r FROM j)""",
        "daily_trend": f"""{J} SELECT CAST(date_scraped AS DATE) AS day, count(*) AS total, count(*) FILTER (score >= 55) AS high,
          count(*) FILTER (score >= 40 AND score < 55) AS medium FROM j WHERE CAST(date_scraped AS DATE) >= CAST({SCRAPED} AS DATE) - 1 GROUP BY 1""",
        "recent_runs": f"WITH {RUNS} SELECT id, site, search_term, location, jobs_found, jobs_new, error FROM runs ORDER BY started_at DESC, id DESC LIMIT 5",
        "zero_result_count": f"WITH {RUNS} SELECT count(*) AS cnt FROM runs WHERE jobs_found = 0 AND error IS NULL AND started_at >= {NOW} - INTERVAL 7 DAY",
        "zero_result_runs": f"""WITH {RUNS} SELECT site, search_term, location, started_at FROM runs WHERE jobs_found = 0 AND error IS NULL
          AND started_at >= {NOW} - INTERVAL 7 DAY ORDER BY started_at DESC, id DESC LIMIT 10""",
        # duplicates
        "dup_groups": f"{J} SELECT content_key, count(*) AS cnt FROM j WHERE content_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
        "dup_members": f"{KEEPERS} SELECT id, content_key, status, score, cnt FROM ranked WHERE cnt > 1",
        "dedup_keepers": f"{KEEPERS} SELECT content_key, id, cnt FROM ranked WHERE rn = 1",
        "dedup_kept": f"{KEEPERS} SELECT id, score, status FROM ranked WHERE rn = 1",
        "dedup_removed": f"{KEEPERS} SELECT id, score, status FROM ranked WHERE rn > 1",
        "dedup_summary": f"{KEEPERS} SELECT count(*) FILTER (rn = 1) AS groups, count(*) FILTER (rn > 1) AS removed, count(*) FILTER (rn = 1) AS kept FROM ranked WHERE cnt > 1",
        "backfill_keys": f"WITH {POSTINGS} SELECT id, CASE WHEN id % 3 = 0 THEN 'old' ELSE content_key END AS content_key FROM postings",
        # maintenance
        "rescore_changes": f"""{RESCORED} SELECT id, old_score AS old, score AS new, score - old_score AS delta, company, title,
          CASE WHEN broken THEN '{{"dealbreaker":true}}' ELSE '{{"keyword":' || kw || ',"company":' || co || ',"title":' || ti || ',"recency":' || re || '}}' END AS breakdown
          FROM rs WHERE score <> old_score""",
        "rescore_top": f"""{RESCORED} SELECT id, old_score AS old, score AS new, company, title FROM rs
          WHERE score <> old_score ORDER BY abs(score - old_score) DESC, id LIMIT 25""",
        "rescore_top_cut": f"""{RESCORED} SELECT id, old_score AS old, score AS new, substr(company, 1, 16) AS company, substr(title, 1, 36) AS title FROM rs
          WHERE score <> old_score ORDER BY abs(score - old_score) DESC, id LIMIT 25""",
        "rescore_summary": f"""{RESCORED} SELECT count(*) AS total, count(*) FILTER (score <> old_score) AS changed,
          avg(score - old_score) FILTER (score <> old_score) AS avg_delta, min(score - old_score) FILTER (score <> old_score) AS min_delta,
          max(score - old_score) FILTER (score <> old_score) AS max_delta, count(*) FILTER (new_status = 'filtered' AND status = 'new') AS newly_filtered,
          count(*) FILTER (new_status = 'new' AND status = 'filtered') AS unfiltered FROM rs""",
        "rescore_state": f"""{RESCORED} SELECT id, CASE WHEN source = 'src3' THEN score ELSE old_score END AS score,
          CASE WHEN source = 'src3' THEN new_status ELSE status END AS status,
          CASE WHEN source = 'src3' AND score <> old_score THEN CASE WHEN NOT broken THEN kw END ELSE CASE WHEN NOT old_broken THEN old_kw END END AS keyword FROM rs""",
        "status_fold": f"""{J}, {CHANGES}, f AS (SELECT posting_id, arg_max(status, seq) AS s, arg_max(notes, seq) FILTER (notes <> '') AS n,
            arg_min(event_date, seq) FILTER (status IN ('applied', 'interview', 'offer')) AS d FROM ev GROUP BY 1)
          SELECT id, coalesce(s, status) AS status, coalesce(n, '') AS notes, d AS applied_date FROM j LEFT JOIN f ON posting_id = id""",
        "status_not_found": f"WITH {CHANGES} SELECT DISTINCT posting_id FROM ev WHERE posting_id NOT IN (SELECT doc_id FROM documents)",
        "valid_updates": """WITH t AS (SELECT event_id, user_id, event_type, value FROM events)
          SELECT event_id, CAST(user_id AS BIGINT) AS job_id, CASE event_type WHEN 'signup' THEN 'applied' WHEN 'purchase' THEN 'offer' END AS status,
            CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS notes FROM t WHERE event_type IN ('signup', 'purchase') AND event_id % 5 <> 0""",
        "route_messages": """SELECT conv_id AS chat_id, turn, 'p' || (c_custkey % 2) AS profile, text
          FROM conversations JOIN customer ON c_custkey = conv_id WHERE role = 'user' AND c_mktsegment <> 'BUILDING'""",
        "route_messages_cut": """SELECT conv_id AS chat_id, turn, 'p' || (c_custkey % 2) AS profile, substr(text, 1, 500) AS text
          FROM conversations JOIN customer ON c_custkey = conv_id WHERE role = 'user' AND c_mktsegment <> 'BUILDING'""",
        # upsert and ingest
        "upsert_snapshot": f"{UPSERT} SELECT s.id, e.source_id, e.dk AS dedup_key, s.score, s.status FROM settled s JOIN events_of e ON e.target = s.id AND e.kind = 'insert'",
        "upsert_outcomes": f"{UPSERT} SELECT CAST(batch AS INTEGER) AS batch, kind, count(*) AS cnt FROM events_of GROUP BY 1, 2",
        "alerts": f"""{J}, arr AS (SELECT row_number() OVER (ORDER BY id) - 1 AS seq, *, dedup_key AS dk, content_key AS ck, TRUE AS long FROM j),{FOLD}
          SELECT 'p0' AS profile, 'telegram' AS channel, CAST(0 AS BIGINT) AS batch_id, row_number() OVER (ORDER BY score DESC, target) AS rank, target AS posting_id, line AS message_line
          FROM (SELECT * EXCLUDE (id), target AS id, target FROM events_of) z, LATERAL (SELECT {message("telegram")} AS line) l
          WHERE kind = 'insert' AND NOT broken AND score >= 30 AND ({states})""",
        "ingest_postings": f"""{ingested("indeed")} SELECT s.id, e.source_id, e.dk AS dedup_key, e.ck AS content_key, s.score, s.status, e.title, e.city, e.state
          FROM settled s JOIN events_of e ON e.target = s.id AND e.kind = 'insert'""",
        "ingest_limited": f"""{ingested("indeed", True)} SELECT s.id, e.source_id, e.ck AS content_key, s.score, s.status, md5(substr(e.description, 1, 50000)) AS description_md5
          FROM settled s JOIN events_of e ON e.target = s.id AND e.kind = 'insert'""",
        "ingest_run_log": f"""{ingested("indeed")}, c AS (SELECT run_id, count(*) AS f, count(*) FILTER (kind = 'insert' AND NOT broken) AS n FROM events_of GROUP BY 1),
          allruns AS (SELECT run_id AS id, min(search_term) AS search_term FROM (SELECT run_id, page_no, min(search_term) AS search_term FROM items GROUP BY 1, 2) GROUP BY 1)
          SELECT r.id, 'indeed' AS site, r.search_term, CAST(coalesce(f, 0) AS INTEGER) AS jobs_found, CAST(coalesce(n, 0) AS INTEGER) AS jobs_new,
            CAST(NULL AS VARCHAR) AS error FROM allruns r LEFT JOIN c ON c.run_id = r.id""",
        "ingest_counters": f"""{ingested("indeed")} SELECT count(*) FILTER (NOT broken) AS total_found, count(*) FILTER (kind = 'insert' AND NOT broken) AS total_new,
          count(*) FILTER (broken) AS total_filtered FROM events_of""",
        "ingest_preview": f"{ingested('indeed')} SELECT CAST(seq AS BIGINT) * 0 + run_id AS run_id, page_no, pos, score, title, broken AS dealbreaker FROM arr WHERE score >= 20 OR broken",
        "seen_first": """SELECT event_id, run_id, seen_key FROM (SELECT event_id, user_id % 20 AS run_id, CAST(floor(value) AS BIGINT) AS seen_key, event_id // 100 AS page_no, event_id % 100 AS pos
          FROM events) QUALIFY row_number() OVER (PARTITION BY run_id, seen_key ORDER BY page_no, pos) = 1""",
        "task_cap": """SELECT event_id, run_id FROM (SELECT event_id, user_id AS run_id FROM events) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY event_id // 100, event_id % 100) <= 25""",
        "page_prefix": """WITH p AS (SELECT o_custkey AS run_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS page_no, o_orderpriority <> '5-LOW' AS gives,
            o_orderstatus <> 'F' AS more FROM orders),
          w AS (SELECT *, min(CAST(gives AS INTEGER)) OVER (PARTITION BY run_id ORDER BY page_no) AS ok,
            coalesce(min(CAST(more AS INTEGER)) OVER (PARTITION BY run_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS cur FROM p)
          SELECT run_id, page_no FROM w WHERE ok = 1 AND cur = 1 AND page_no <= 3""",
        "task_fanout": """WITH s AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents)),
          t AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS j FROM (SELECT DISTINCT event_type FROM events)),
          l AS (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS k FROM region)
          SELECT CAST((i * (SELECT count(*) FROM t) + j) * (SELECT count(*) FROM l) + k AS BIGINT) AS position, source AS site, event_type AS term, r_name AS location
          FROM s CROSS JOIN t CROSS JOIN l""",
        "enrich_descriptions": f"""{site_rows("linkedin")}, d AS (SELECT page_id, min(url) AS u FROM pages GROUP BY 1)
          SELECT e.source_id, md5(CASE WHEN x.doc_id % 3 <> 0 THEN {squeezed("x.text")} ELSE '' END) AS description_md5,
            coalesce(e.is_remote OR {REMOTE.format(f"(CASE WHEN x.doc_id % 3 <> 0 THEN {squeezed('x.text')} ELSE '' END)")}, FALSE) AS is_remote
          FROM ext e JOIN documents x ON CAST(x.doc_id AS VARCHAR) = e.source_id""",
        # digests and reports
        "digest_top10": f"{digest} SELECT CAST(rank AS INTEGER) AS rank, id, score, matches FROM d WHERE rank <= 10",
        "alert_messages": f"{J} " + " UNION ALL ".join(f"SELECT id, '{c}' AS channel, {message(c)} AS message_line FROM j" for c in channels),
        "digest_text": f"""{matches(10)}, d AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rank, count(*) OVER () AS matches FROM m),
          st AS (SELECT count(*) FILTER (status = 'new') AS n, count(*) FILTER (date_scraped >= {SCRAPED} - INTERVAL 24 HOUR) AS s FROM j)
          SELECT '*postlark (p0) digest* — ' || any_value(matches) || ' match(es)' || chr(10) || chr(10) || string_agg({message("slack")}, chr(10) ORDER BY rank)
            || chr(10) || chr(10) || '\U0001f4ca ' || any_value(n) || ' unreviewed | ' || any_value(s) || ' scraped today' AS text
          FROM d, st WHERE rank <= 10 HAVING count(*) > 0""",
        "report_high": report_list("score >= 40"),
        "report_medium": report_list("score >= 40 AND score < 55"),
    }
    out["export_files"] = out["export_rows"]
    out["content_key_prefix"] = f"WITH {POSTINGS} SELECT id, {content_key(500)} AS content_key FROM postings"
    out["extract_indeed_limited"] = extraction("indeed", True)
    out["stream_status"] = out["status_fold"]
    out["stream_ingest"] = out["ingest_postings"]
    out["stream_messages"] = out["route_messages"]
    out["stream_trend"] = f"""{J} SELECT CAST(date_scraped AS DATE) AS day, count(*) AS total, count(*) FILTER (score >= 55) AS high,
      count(*) FILTER (score >= 40 AND score < 55) AS medium FROM j GROUP BY 1"""
    out["schema_upgrade"] = f"{J} SELECT id, score, CAST(NULL AS VARCHAR) AS notes, CAST(NULL AS TIMESTAMP) AS created_at FROM j"
    out["export_chosen"] = "SELECT * FROM (VALUES ('a.csv', 'json'), ('b.json', 'csv'), ('c.JSON', 'json'), ('d.txt', 'csv')) AS t(name, format) WHERE (SELECT count(*) FROM documents) > 0"
    out["capped_descriptions"] = """WITH t AS (SELECT doc_id, substr(repeat(text, 60000 // greatest(length(text), 1) + 1), 1, 50000) AS t FROM documents)
      SELECT doc_id, CAST(length(coalesce(t, '')) AS INTEGER) AS chars, md5(coalesce(t, '')) AS md5 FROM t"""
    out["export_json"] = f"{J} SELECT id, score, company, title, url, status FROM j"
    out["point_lookup"] = list_sql("WHERE id = 7")
    out["fixed_locations"] = f"WITH {RAW},{located('raw', 'placed')} SELECT id, city, state, country FROM placed"
    out["plugged_extractor"] = f"{site_rows('indeed')} SELECT run_id, page_no, pos, 'plug' AS source, source_id, md5(description) AS description_md5 FROM ext"
    out["upkept_store"] = f"""{RESCORED},
      st AS (SELECT id, content_key, date_scraped, CASE WHEN source = 'src3' THEN score ELSE old_score END AS score,
        CASE WHEN source = 'src3' THEN new_status ELSE status END AS status FROM rs)
      SELECT id, score, status FROM st QUALIFY row_number() OVER (PARTITION BY content_key ORDER BY CASE status WHEN 'offer' THEN 0 WHEN 'interview' THEN 1
        WHEN 'applied' THEN 2 WHEN 'new' THEN 3 WHEN 'filtered' THEN 4 WHEN 'rejected' THEN 5 ELSE 99 END, score DESC, date_scraped, id) = 1"""
    kept_up = out["upkept_store"]
    out["rollup_by_status"] = f"SELECT status, count(*) AS cnt FROM ({kept_up}) GROUP BY 1"
    out["rollup_score_tiers"] = f"""SELECT CASE WHEN score >= 80 THEN 'excellent (80+)' WHEN score >= 55 THEN 'good (55-79)' WHEN score >= 30 THEN 'review (30-54)'
      ELSE 'low (<30)' END AS tier, count(*) AS cnt FROM ({kept_up}) WHERE score > 0 GROUP BY 1"""
    heads = {"email": "postlark (p0) digest", "telegram": r"*postlark \(p0\) digest*", "slack": "*postlark (p0) digest*",
             "discord": "**postlark (p0) digest**", "macos": "postlark (p0) digest"}
    digests = []
    for c, head in heads.items():
        many, bar = (r"match\(es\)", r"\|") if c == "telegram" else ("match(es)", "|")
        window = " in the last 24h" if c == "email" else ""
        digests.append(f"""SELECT '{c}' AS channel, '{head} — ' || any_value(matches) || ' {many}{window}' || chr(10) || chr(10)
          || string_agg({message(c)}, chr(10) ORDER BY rank) || chr(10) || chr(10) || '\U0001f4ca ' || any_value(n) || ' unreviewed {bar} '
          || any_value(s) || ' scraped today' AS text FROM d, st WHERE rank <= 10 HAVING count(*) > 0""")
    out["digest_texts"] = f"""{matches(10)}, d AS (SELECT *, row_number() OVER (ORDER BY {ORDER}) AS rank, count(*) OVER () AS matches FROM m),
      st AS (SELECT count(*) FILTER (status = 'new') AS n, count(*) FILTER (date_scraped >= {SCRAPED} - INTERVAL 24 HOUR) AS s FROM j)
      {" UNION ALL ".join(digests)}"""
    note = """CASE WHEN any_value(n) = 1 THEN any_value(title) || ' (Score: ' || any_value(score) || ')'
      ELSE string_agg(line, '\\n' ORDER BY score DESC, id) || CASE WHEN any_value(n) > 3 THEN '\\n... and ' || (any_value(n) - 3) || ' more' ELSE '' END END"""
    out["desktop_note"] = f"""{matches(10)}, t AS (SELECT id, score, company, title, {message("macos")} AS line, count(*) OVER () AS n FROM m ORDER BY score DESC, id LIMIT 3),
      u AS (SELECT 'postlark (p0): ' || CASE WHEN any_value(n) = 1 THEN any_value(company) ELSE any_value(n) || ' new matches' END AS title, {note} AS body FROM t HAVING count(*) > 0)
      SELECT {escaped("title", "macos")} AS title, {escaped("body", "macos")} AS body FROM u"""
    words = """w AS (SELECT DISTINCT 'p' || item_id % 10 AS profile, word FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS word FROM benchmark)
        WHERE regexp_full_match(word, '[a-z]{4,}'))"""
    out["profile_words"] = f"""{J}, {words},
      h AS (SELECT profile, id, length(word) % 4 AS t, contains(lower(title || ' ' || coalesce(description, '')), word) AS hit,
        length(word) >= 7 AND regexp_matches(title, '(?i)' || word || '(s|ed)?[.,]') AS broken FROM j JOIN w ON true)
      SELECT profile, id, CAST(count(*) FILTER (hit AND t = 0) AS INTEGER) AS critical_hits, CAST(count(*) FILTER (hit AND t = 1) AS INTEGER) AS strong_hits,
        CAST(count(*) FILTER (hit AND t = 2) AS INTEGER) AS moderate_hits, CAST(count(*) FILTER (hit AND t = 3) AS INTEGER) AS weak_hits, bool_or(broken) AS broken
      FROM h GROUP BY profile, id HAVING bool_or(hit) OR bool_or(broken)"""
    out["user_pattern_hits"] = f"""WITH {words}, p AS (SELECT DISTINCT '(?i)' || word || '(s|ed)?[.,]' AS pattern FROM w WHERE length(word) >= 6)
      SELECT pattern, count(*) AS documents FROM documents JOIN p ON regexp_matches(text, pattern) GROUP BY pattern"""
    tables = " UNION ALL ".join(
        f"SELECT '{p.name}' AS profile, id, score, CASE WHEN NOT broken THEN kw END AS keyword, CASE WHEN NOT broken THEN co END AS company_points,"
        f" CASE WHEN NOT broken THEN ti END AS title_points FROM s_{p.name}"
        for p in (P0, P1)
    )
    out["profile_table_scores"] = f"WITH RECURSIVE {POSTINGS},{scored(P0, 'postings', 's_p0')},{scored(P1, 'postings', 's_p1')} {tables}"
    out["stream_details"] = out["enrich_descriptions"]
    out["stream_runs"] = out["ingest_run_log"]
    # A posting is inserted if an even number of links leads back to the last one nothing stops.
    out["upsert_chain"] = """WITH e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS seq FROM events),
      b AS (SELECT seq, max(CASE WHEN seq = 0 OR (seq % 2 = 1 AND event_id % 997 = 5) THEN seq END) OVER (ORDER BY seq) AS free FROM e)
      SELECT seq, 'k' || (seq + 1) // 2 AS dedup_key, 'c' || seq // 2 AS content_key FROM b WHERE (seq - free) % 2 = 0"""
    out["stream_misses"] = out["status_not_found"]
    out["stream_alerts"] = f"{ingested('indeed')} SELECT target AS id, score, title FROM events_of WHERE kind = 'insert' AND NOT broken AND score >= {P0.min_alert_score}"
    out["reissued_ids"] = f"""{J}, t AS (SELECT max(id) AS top FROM j)
      SELECT id, dedup_key, source_id FROM j, t WHERE id <= top - 10 UNION ALL
      SELECT top + row_number() OVER (ORDER BY source_id), 'again' || dedup_key, source_id FROM j, t WHERE id > top - 5"""
    listing = f"string_agg('| ' || score || ' | ' || title || ' | ' || company || ' | ' || {PLACE} || ' | ' || {CONCISE} || ' | [apply](' || url || ') |', chr(10) ORDER BY {ORDER})"
    table = "|| chr(10) || chr(10) || '| Score | Title | Company | Location | Comp | Link |' || chr(10) || '|---|---|---|---|---|---|' || chr(10) ||"
    out["report_text"] = f"""{matches(40)},
      high AS (SELECT '## High match (score >= 50)' {table} {listing} AS t FROM (SELECT * FROM m WHERE score >= 50 ORDER BY {ORDER} LIMIT 20)),
      med AS (SELECT '## Worth review (40-49)' {table} {listing} AS t FROM (SELECT * FROM m WHERE score < 50 ORDER BY {ORDER} LIMIT 20)),
      more AS (SELECT CASE WHEN count(*) > 20 THEN '*(showing top 20 of ' || count(*) || ')*' END AS t FROM m WHERE score < 50),
      st AS (SELECT count(*) FILTER (status = 'new') AS n, count(*) FILTER (r) AS s, count(*) FILTER (r AND score >= 50) AS h,
        count(*) FILTER (r AND score >= 40 AND score < 50) AS w FROM (SELECT *, date_scraped >= {SCRAPED} - INTERVAL 24 HOUR AS r FROM j)),
      days AS (SELECT CAST(date_scraped AS DATE) AS day, count(*) AS n, count(*) FILTER (score >= 50) AS h, count(*) FILTER (score >= 40 AND score < 50) AS w
        FROM j WHERE CAST(date_scraped AS DATE) >= CAST({SCRAPED} AS DATE) - 7 GROUP BY 1),
      trend AS (SELECT '## 7-Day Trend' || chr(10) || chr(10) || '| Date | Total | High (>=50) | Medium (40-49) |' || chr(10) || '|---|---|---|---|' || chr(10)
        || string_agg('| ' || day || ' | ' || n || ' | ' || h || ' | ' || w || ' |', chr(10) ORDER BY day DESC) AS t FROM days)
      SELECT concat_ws(chr(10) || chr(10), '# Daily report (p0) — 2024-01-03', '## Summary' || chr(10) || chr(10) || '| Metric | Count |' || chr(10)
        || '|---|---|' || chr(10) || '| Scraped (24h) | ' || s || ' |' || chr(10) || '| High match (>=50) | ' || h || ' |' || chr(10)
        || '| Worth review (40-49) | ' || w || ' |' || chr(10) || '| Total unreviewed | ' || n || ' |', high.t, med.t, more.t, trend.t) AS text
      FROM st, high, med, more, trend"""
    for site in ("indeed", "glassdoor", "ziprecruiter", "linkedin", "bayt", "google"):
        out[f"extract_{site}"] = extraction(site)
    return out
