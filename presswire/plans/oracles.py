"""DuckDB SQL for the registered queries, written from the rules and not from the Spark code."""

from __future__ import annotations

from presswire.functions import fixed_values as V
from presswire.plans.registry import ISO_CODES, NAMES, STOP_WORDS
from presswire.sources.driver_tables import ARTICLES_SQL, EVENTS_SQL, GKG_FEED_SQL

# -- text helpers -------------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def rnd(x: str, digits: int) -> str:
    """Half away from zero, never -0.0."""
    k = f"1e{digits}"
    steps = f"floor(abs({x}) * {k} + 0.5::DOUBLE)"
    return f"(CASE WHEN {steps} = 0 THEN 0::DOUBLE ELSE sign({x}) * {steps} / {k} END)"


def r6(x: str) -> str:
    return rnd(rnd(f"({x})", 10), 6)


def n(x: str = "COUNT(*)") -> str:
    return f"CAST({x} AS BIGINT)"


def n_if(condition: str) -> str:
    return n(f"COALESCE(SUM(CASE WHEN {condition} THEN 1 ELSE 0 END), 0)")


def bands(column: str, table: list[tuple]) -> str:
    *closed, (_, _, last) = table
    whens = " ".join(
        f"WHEN {column} {'<=' if inclusive else '<'} {bound} THEN {q(label)}" for bound, inclusive, label in closed
    )
    return f"CASE {whens} ELSE {q(last)} END"


def known_bands(column: str, table: list[tuple], unknown: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN {q(unknown)} ELSE {bands(column, table)} END"


EV = f"WITH ev AS ({EVENTS_SQL})"
ART = f"WITH art AS ({ARTICLES_SQL})"
FEED = f"WITH feed AS ({GKG_FEED_SQL})"
WEEK, MONTH, DAYS3 = "DATE >= '20240123'", "DATE >= '20231231'", "DATE >= '20240127'"
EV_COLS = ("EVENT_ID, DATE, MAIN_ACTOR, ACTOR_COUNTRY_CODE, EVENT_CATEGORY_CODE, IMPACT_SCORE, "
           "ARTICLE_COUNT, SENTIMENT_SCORE, NEWS_LINK, HEADLINE")
STORY = "EVENT_ID, DATE, NEWS_LINK, HEADLINE, MAIN_ACTOR, ACTOR_COUNTRY_CODE, IMPACT_SCORE, ARTICLE_COUNT"

_ISO_CASE = "CASE n_nationkey " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(ISO_CODES)) + (
    " ELSE 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END")
ISO = (f"iso AS (SELECT CASE WHEN n_nationkey < {len(ISO_CODES)} THEN substr(code, 1, 2) "
       f"ELSE chr(65 + n_nationkey) || 'X' END AS alpha2, code AS alpha3, n_name AS name "
       f"FROM (SELECT n_nationkey, n_name, {_ISO_CASE} AS code FROM nation))")
REGIONAL = "regional(code, label) AS (VALUES " + ", ".join(
    f"({q(c)}, {q(l)})" for c, l in V.REGIONAL_CODES.items()) + ")"
COUNTRY = """COALESCE((SELECT label FROM regional r WHERE r.code = upper(trim(x.ACTOR_COUNTRY_CODE))),
  (SELECT name FROM iso i WHERE upper(trim(x.ACTOR_COUNTRY_CODE)) IN (i.alpha2, i.alpha3)))"""

# -- emotion feed -------------------------------------------------------------

_NUM = r"'^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$'"
_ALL_NUM = f"len(list_filter(str_split(TONE, ',')[1:3], lambda p: NOT regexp_full_match(trim(p), {_NUM}))) = 0"


def _tone(i: int) -> str:
    return (f"CASE WHEN TONE IS NULL OR NOT ({_ALL_NUM}) THEN 0::DOUBLE "
            f"ELSE COALESCE(TRY_CAST(str_split(TONE, ',')[{i}] AS DOUBLE), 0::DOUBLE) END")


def _gcam(code: str) -> str:
    hit = f"list_filter(str_split(GCAM, ','), lambda p: p LIKE '{code}:%' AND len(str_split(p, ':')) = 2)"
    return f"COALESCE(TRY_CAST(str_split(({hit})[-1], ':')[2] AS DOUBLE), 0::DOUBLE)"


_THEMES = """COALESCE(array_to_string(list_filter(list_transform(str_split(THEMES, ';'),
  lambda t: trim(str_split(t, ',')[1])), lambda t: length(t) > 2), ','), '')"""
GKG = FEED + ", gkg AS (SELECT GKG_ID, DATE, SOURCE, PERSONS, ORGS, " + ", ".join(
    f"{_tone(i + 1)} AS {c}" for i, c in enumerate(["AVG_TONE", "POSITIVE_SCORE", "NEGATIVE_SCORE"])
) + ", " + ", ".join(
    f"{_gcam(code)} AS EMOTION_{name.upper()}" for code, name in V.GCAM_EMOTIONS.items()
) + f", {_THEMES} AS TOP_THEMES FROM feed WHERE GKG_ID IS NOT NULL)"
DAY = "DATE >= 20240129230000"
_DOMINANT = "CASE GREATEST(" + ", ".join(f"EMOTION_{e.upper()}" for e in V.BASIC_EMOTIONS) + ") " + " ".join(
    f"WHEN EMOTION_{e.upper()} THEN '{e}'" for e in V.BASIC_EMOTIONS) + " END"
_THEME_ROWS = ("themes AS (SELECT substr(CAST(DATE AS VARCHAR), 1, 8) AS date_key, trim(u.t) AS theme, DATE "
               "FROM gkg, UNNEST(str_split(TOP_THEMES, ',')) AS u(t) WHERE length(trim(u.t)) > 2)")

# -- staging ------------------------------------------------------------------

_STG_COLS = f"""EVENT_ID AS event_id, DATE AS event_date_raw, CAST(substr(DATE, 1, 4) AS INTEGER) AS event_year,
  CAST(substr(DATE, 5, 2) AS INTEGER) AS event_month, CAST(substr(DATE, 7, 2) AS INTEGER) AS event_day,
  MAIN_ACTOR AS actor_name, ACTOR_COUNTRY_CODE AS actor_country_code, EVENT_CATEGORY_CODE AS event_category_code,
  IMPACT_SCORE AS goldstein_scale, ARTICLE_COUNT AS article_count, SENTIMENT_SCORE AS avg_tone,
  NEWS_LINK AS source_url, HEADLINE AS headline, EMBEDDING AS embedding,
  {bands('IMPACT_SCORE', V.SENTIMENT_BANDS)} AS sentiment_category,
  HEADLINE IS NOT NULL AS has_headline, EMBEDDING IS NOT NULL AS has_embedding"""
STG = EV + f", stg AS (SELECT {_STG_COLS} FROM ev WHERE EVENT_ID IS NOT NULL)"
_MEANS = f"""{r6('AVG(article_count)')} AS avg_articles_per_event, {r6('AVG(goldstein_scale)')} AS avg_goldstein_scale,
  {r6('AVG(avg_tone)')} AS avg_tone"""
_CATS = ["Very Negative", "Negative", "Neutral", "Positive", "Very Positive"]
DAILY = STG + f""", daily AS (SELECT event_date_raw, event_year, event_month, event_day, {n()} AS event_count,
  COUNT(DISTINCT actor_name) AS unique_actors, COUNT(DISTINCT actor_country_code) AS unique_countries,
  SUM(article_count) AS total_articles, {_MEANS},
  {", ".join(n_if(f"sentiment_category = '{c}'") + " AS " + c.lower().replace(" ", "_") + "_count" for c in _CATS)},
  {n_if('has_headline')} AS events_with_headlines, {n_if('has_embedding')} AS events_with_embeddings
  FROM stg GROUP BY ALL)"""


def pct(part: str, whole: str) -> str:
    return rnd(f"(100::DOUBLE * ({part}) / NULLIF({whole}, 0))", 2)


# -- headline rules -----------------------------------------------------------

_PUNCT = r"""[.,;:''"!?\-_\s]"""


def rx(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{to}', '{flags}')"


def _chain(x: str, steps: list[tuple]) -> str:
    for step in steps:
        x = rx(x, *step)
    return x


_SEGMENT_STEPS = [
    (V.SEGMENT_EXTENSION, "", "gi"), *[(p,) for p in V.SEGMENT_LEADING], ("[-_]+", " "),
    (V.SEGMENT_TRAILING_NUMBER,), (V.SEGMENT_TRAILING_HEX, "", "gi"), (V.SEGMENT_TRAILING_SHORT_NUMBER,),
    (r"\s+", " "),
]
_REJECT = " OR ".join(f"regexp_matches(seg, '{p}', 'i')" for p in V.SEGMENT_REJECTS)


def _score(x: str) -> str:
    w = f"len(list_filter(str_split({x}, ' '), lambda w: w <> ''))"
    return f"""CASE WHEN {x} IS NULL OR length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')) < 5 THEN 0
      WHEN {w} >= 4 AND length({x}) > 20 THEN {w} * 10 + length({x})
      WHEN {w} >= 3 AND length({x}) > 15 THEN {w} * 5 + length({x})
      WHEN {w} >= 2 AND length({x}) > 10 THEN {w} * 2 + length({x}) ELSE 0 END"""


_LINES = """SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)"""


def url_titles(source: str) -> str:
    """CTEs ending in `titles(url, title)` for the distinct NEWS_LINK of `source`."""
    trim_ends = rx(rx("x", f"^{_PUNCT}+".replace("''", "'")), f"{_PUNCT}+$".replace("''", "'"))
    return f"""links AS (SELECT DISTINCT NEWS_LINK AS url FROM {source}),
  paths AS (SELECT url, str_split(url_decode(regexp_replace(regexp_extract(url,
    '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', '')), '/') AS parts FROM links),
  segs AS (SELECT url, trim(unnest(parts)) AS seg, unnest(parts) AS raw, generate_subscripts(parts, 1) AS depth FROM paths),
  segs1 AS (SELECT url, depth, {_chain('seg', _SEGMENT_STEPS)} AS x FROM segs
    WHERE length(raw) >= 5 AND lower(raw) NOT IN {in_list(V.SKIP_SEGMENTS)} AND NOT ({_REJECT})),
  segs2 AS (SELECT url, depth, {trim_ends.replace("regexp_replace(x", "regexp_replace(trim(x)")} AS x FROM segs1),
  segs3 AS (SELECT url, x, ROW_NUMBER() OVER (PARTITION BY url ORDER BY {_score('x')} DESC, depth DESC) AS rn,
    {_score('x')} AS score FROM segs2),
  titles AS (SELECT l.url, s.x AS title FROM links l LEFT JOIN segs3 s ON s.url = l.url AND s.rn = 1 AND s.score > 0)"""


_CONS = "bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ"
_CLEAN_STEPS = [
    (V.HEADLINE_LONG_DIGITS,), *[(p,) for p in V.HEADLINE_TRAILING],
    ("([a-z])([A-Z])", r"\1 \2"), ("([A-Z]+)([A-Z][a-z])", r"\1 \2"), (r"(\d)([a-zA-Z])", r"\1 \2"),
    ("Apos([a-z])", r"''\1"), (r"\bApos\b", "''", "gi"), ("''", "''"), ("^'",),
    (r"(\d)\s+(\d)", r"\1.\2"), (r"\b([A-Z])\s+([A-Z])\b", r"\1\2"),
    (r"\b([A-Z])\s+([A-Z])\s+([A-Z])\b", r"\1\2\3"),
    (V.TRUNCATED_PREPOSITION,), (V.TRUNCATED_AUXILIARY, "", "gi"),
]


def cleaned(source: str, column: str) -> str:
    """CTEs ending in `cleaned(raw, headline)` for the distinct values of a text column."""
    lead = f"regexp_replace(trim(raw, e' \\t\\n\\r'), '^{_PUNCT}+', '')"
    title = f"""array_to_string(list_transform(str_split(lower(x), ' '), lambda w, i:
      CASE WHEN i > 1 AND w IN {in_list(V.SMALL_WORDS)} THEN w ELSE (CASE w[1] WHEN 'ß' THEN 'Ss' ELSE upper(w[1]) END) || w[2:] END), ' ')"""
    last = "str_split(x, ' ')[-1]"
    generic = " OR ".join(f"starts_with(lower(x), {q(g)})" for g in V.GENERIC_OPENINGS)
    return f"""cl0 AS (SELECT DISTINCT {column} AS raw FROM {source} WHERE {column} IS NOT NULL),
  cl1 AS (SELECT raw, {_chain(lead, _CLEAN_STEPS)} AS x FROM cl0),
  cl2 AS (SELECT raw, regexp_replace(trim(x, e' \\t\\n\\r'), '(?:(?:^|\\s+)\\S{{1,2}})+$', '') AS x FROM cl1),
  cl3 AS (SELECT raw, regexp_replace(trim(x, e' \\t\\n\\r'),
    '(?:(?:^|\\s+)(?:\\S{{0,2}}[{_CONS}]|\\S{{2,}}[^aeiouAEIOU\\s]f|\\S*[a-z][A-Z]\\S*))+$', '') AS x FROM cl2),
  cl4 AS (SELECT raw, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS x FROM cl3),
  cl5 AS (SELECT raw, CASE WHEN length(x) > 100 THEN regexp_replace(x[1:100], ' [^ ]*$', '') ELSE x END AS x FROM cl4),
  cl6 AS (SELECT raw, regexp_replace(x, '{_PUNCT}+$', '') AS x FROM cl5),
  cleaned AS (SELECT raw, CASE WHEN length(x) < 25 OR len(str_split(x, ' ')) < 5
      OR regexp_matches({last}, '^[A-Z][a-z]*[A-Z]') OR regexp_matches({last}, '[a-z]{{2}}[A-Z]')
      OR {generic} THEN NULL ELSE {title} END AS headline FROM cl6)"""


def garbage(x: str) -> str:
    return (f"len(list_filter(regexp_split_to_array(trim({x}, e' \\t\\n\\r'), '\\s+'), lambda w: regexp_matches(w, '[a-zA-Z]\\d|\\d[a-zA-Z]') "
            f"OR (length(w) > 4 AND NOT regexp_matches(w, '[aeiouAEIOU]'))))")


def quality(h: str, url: str) -> str:
    w = f"len(str_split({h}, ' '))"
    caps = f"len(list_filter(str_split({h}, ' '), lambda w: length(w) > 2 AND regexp_matches(w, '^\\p{{Lu}}')))"
    host = f"lower(replace(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), 'www.', ''))"
    trusted = " OR ".join(f"contains({host}, {q(d)})" for d in V.TRUSTED_DOMAINS)
    tick = " OR ".join(f"starts_with(lower({h}), {q(t)})" for t in V.TICKER_OPENINGS)

    def p(c: str, v: str, other: str = "0e0") -> str:
        return f"(CASE WHEN {c} THEN {v} ELSE {other} END)"

    parts = ["5e-1", p(trusted, "25e-2"),
             p(f"length({h}) BETWEEN 40 AND 80", "1e-1", p(f"length({h}) < 25 OR length({h}) > 120", "-1e-1")),
             p(f"{w} BETWEEN 5 AND 12", "1e-1", p(f"{w} < 4 OR {w} > 15", "-1e-1")),
             p(f"regexp_matches({h}, '\\d{{6,}}')", "-3e-1"),
             p(f"length({h}) - length(replace({h}, '''', '')) > 2", "-1e-1"),
             p(f"regexp_matches({h}, '[A-Z]{{5,}}')", "-1e-1"), p(f"{garbage(h)} >= 2", "-5e-1"),
             p(f"{w} >= 10 AND {caps} / {w}::DOUBLE > 0.6", "-5e-1"), p(tick, "-3e-1"), p(f"{w} > 18", "-3e-1")]
    return f"CASE WHEN {h} IS NULL OR {h} = '' THEN 0e0 ELSE greatest(0e0, least(1e0, {' + '.join(parts)})) END"


def best(source: str) -> str:
    """CTEs ending in `best`: the rows of `source` with their display headline as BH."""
    return f"""{url_titles(source)},
  texts AS (SELECT HEADLINE AS t FROM {source} WHERE length(trim(HEADLINE)) > 15 UNION SELECT title FROM titles),
  {cleaned('texts', 't')},
  best AS (SELECT x.*, COALESCE(a.headline, b.headline) AS BH FROM {source} x
    LEFT JOIN cleaned a ON a.raw = x.HEADLINE AND length(trim(x.HEADLINE)) > 15
    LEFT JOIN titles t ON t.url = x.NEWS_LINK LEFT JOIN cleaned b ON b.raw = t.title)"""


def key_of(h: str) -> str:
    w = f"list_filter(regexp_split_to_array(lower({h}), '\\s+'), lambda w: w <> '')"
    return f"CASE WHEN len({w}) > 1 THEN array_to_string(({w})[2:6], ' ') ELSE lower({h}) END"


_TONE = f"""CASE WHEN IMPACT_SCORE < -4 THEN '{V.TONE_RED}' WHEN IMPACT_SCORE < -1 THEN '{V.TONE_AMBER}'
  WHEN IMPACT_SCORE > 2 THEN '{V.TONE_GREEN}' ELSE '{V.TONE_WHITE}' END"""
_SEVERITY = """CASE WHEN IMPACT_SCORE <= -7 THEN 'severe crisis' WHEN IMPACT_SCORE <= -4 THEN 'crisis'
  WHEN IMPACT_SCORE <= -2 THEN 'negative' WHEN IMPACT_SCORE >= 5 THEN 'positive' ELSE '' END"""
_IMPACT = known_bands("IMPACT_SCORE", V.IMPACT_BANDS, V.IMPACT_UNKNOWN)
_INTENSITY = known_bands("IMPACT_SCORE", V.INTENSITY_BANDS, V.INTENSITY_UNKNOWN)
_REGION = f"COALESCE({COUNTRY}, NULLIF(x.ACTOR_COUNTRY_CODE, ''), 'Global')"
_SCORED = f"""good AS (SELECT * FROM (SELECT b.*, {quality('BH', 'NEWS_LINK')} AS QUALITY FROM best b WHERE BH IS NOT NULL)
    WHERE QUALITY >= 0.3::DOUBLE),
  scored AS (SELECT g.*, 0.6::DOUBLE * (date_diff('day', (SELECT MIN(strptime(DATE, '%Y%m%d')) FROM good), strptime(DATE, '%Y%m%d'))
    / (SELECT CASE WHEN MIN(DATE) = MAX(DATE) THEN 1 ELSE date_diff('day', MIN(strptime(DATE, '%Y%m%d')),
       MAX(strptime(DATE, '%Y%m%d'))) END FROM good)::DOUBLE) + 0.4::DOUBLE * QUALITY AS SCORE FROM good g)"""


def stories(picked: str, rows: int) -> str:
    return f"""{EV}, picked AS ({picked}), {best('picked')}, {_SCORED}, {ISO}, {REGIONAL},
  firsts AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key_of('BH')} ORDER BY SCORE DESC, EVENT_ID) AS rn FROM scored),
  x AS (SELECT * FROM firsts WHERE rn = 1 ORDER BY SCORE DESC, EVENT_ID LIMIT {rows})
  SELECT EVENT_ID, DATE, BH AS HEADLINE, {_REGION} AS REGION, IMPACT_SCORE, ARTICLE_COUNT, NEWS_LINK,
    strftime(strptime(DATE, '%Y%m%d'), '%d/%m') AS DATE_FMT, {_TONE} AS TONE, {_INTENSITY} AS INTENSITY,
    {r6('QUALITY')} AS QUALITY, {r6('SCORE')} AS SCORE FROM x"""


_TRENDING = f"""SELECT {STORY} FROM ev WHERE {WEEK} AND ARTICLE_COUNT > 3 AND NEWS_LINK IS NOT NULL
  AND ACTOR_COUNTRY_CODE IS NOT NULL AND length(HEADLINE) > 20 ORDER BY ARTICLE_COUNT DESC, DATE DESC, EVENT_ID LIMIT 500"""
_FEED = f"""SELECT {STORY} FROM ev WHERE {WEEK} AND NEWS_LINK IS NOT NULL
  AND ACTOR_COUNTRY_CODE IS NOT NULL AND length(HEADLINE) > 20 ORDER BY DATE DESC, ARTICLE_COUNT DESC, EVENT_ID LIMIT 500"""

# -- search -------------------------------------------------------------------


def cosine(v: str, vec_id: int = 0) -> str:
    return f"list_cosine_similarity({v}::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vec_id}))"


_LIKE = "(lower(HEADLINE) LIKE '%peace%' OR lower(HEADLINE) LIKE '%agreement%')"
_HITS = "DATE, HEADLINE, ACTOR_COUNTRY_CODE, MAIN_ACTOR, IMPACT_SCORE, ARTICLE_COUNT, NEWS_LINK"


def branch(name: str, condition: str, k: int | None = 10) -> str:
    top = "" if k is None else f" ORDER BY similarity DESC, HEADLINE LIMIT {k}"
    return f"""{name}_c AS (SELECT * FROM ev WHERE EMBEDDING IS NOT NULL AND length(HEADLINE) > 15 AND {MONTH}
    AND {condition}),
  {name} AS (SELECT MAX(DATE) AS DATE, HEADLINE, MAX(ACTOR_COUNTRY_CODE) AS ACTOR_COUNTRY_CODE,
    MAX(MAIN_ACTOR) AS MAIN_ACTOR, MAX(IMPACT_SCORE) AS IMPACT_SCORE, SUM(ARTICLE_COUNT) AS ARTICLE_COUNT,
    MAX(NEWS_LINK) AS NEWS_LINK, MAX({cosine('EMBEDDING')}) AS similarity FROM {name}_c GROUP BY HEADLINE
    HAVING MAX({cosine('EMBEDDING')}) >= 0.2{top})"""


def merged(k: int | None = 10) -> str:
    top = "" if k is None else f" ORDER BY similarity DESC, HEADLINE LIMIT {k}"
    return f"""{branch('hyb', _LIKE, k)}, {branch('vec', 'ARTICLE_COUNT >= 2', k)},
  merged AS (SELECT {_HITS}, similarity FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY HEADLINE
    ORDER BY similarity DESC, b, DATE DESC) AS rn FROM (SELECT *, 0 AS b FROM hyb UNION ALL SELECT *, 1 AS b FROM vec))
    WHERE rn = 1{top})"""


def by_words(name: str, terms: list[str]) -> str:
    score = " + ".join(f"CASE WHEN contains(lower(HEADLINE), {q(t)}) THEN 1 ELSE 0 END" for t in terms)
    return f"""{name} AS (SELECT {_HITS} FROM ev WHERE length(HEADLINE) > 15 AND {MONTH} AND ({score}) > 0
    ORDER BY {score} DESC, ARTICLE_COUNT DESC, EVENT_ID LIMIT 10)"""


_PAIRS = ", ".join(f"q{i} AS (SELECT EVENT_ID, {i}::BIGINT AS query_id, {cosine('EMBEDDING', i)} AS similarity "
                   f"FROM ev WHERE EMBEDDING IS NOT NULL)" for i in (0, 1, 2))
PAIRS = EV + f", {_PAIRS}, pairs AS (SELECT * FROM (SELECT * FROM q0 UNION ALL SELECT * FROM q1 UNION ALL SELECT * FROM q2) WHERE similarity >= 0.2)"
_LETTERS = " + ".join(f"{i + 1} * (length(t) - length(replace(t, '{chr(97 + i)}', '')))" for i in range(26))
_EMBED_TEXT = """concat_ws(' ', CASE WHEN length(trim(MAIN_ACTOR)) > 2 THEN trim(MAIN_ACTOR) END,
  CASE WHEN length(ACTOR_COUNTRY_CODE) = 3 THEN ACTOR_COUNTRY_CODE END,
  CASE WHEN length(trim(HEADLINE)) > 10 THEN trim(HEADLINE) ELSE 'news event' END)"""
PENDING = EV + f", pending AS (SELECT * FROM ev WHERE EMBEDDING IS NULL AND ARTICLE_COUNT >= 3 AND HEADLINE IS NOT NULL AND length({_EMBED_TEXT}) >= 15)"
INPUTS = PENDING + f", inputs AS (SELECT EVENT_ID, CASE WHEN length({_EMBED_TEXT}) >= 15 THEN {_EMBED_TEXT} END AS text FROM pending)"
_MERGED_VEC = EV + f""", up AS (SELECT e.EVENT_ID, e.DATE, COALESCE(e.EMBEDDING, v.embedding)::DOUBLE[] AS vec FROM ev e
  LEFT JOIN embeddings v ON e.EMBEDDING IS NULL AND v.vec_id = CAST(e.EVENT_ID AS BIGINT) % (SELECT max(vec_id) + 1 FROM embeddings))
  SELECT EVENT_ID, DATE, CAST(len(vec) AS BIGINT) AS dims, {r6('list_sum(vec)')} AS total FROM up"""

# -- quality reports ----------------------------------------------------------


def check(kind: str, column: str | None, success: str, observed: str, lo, hi, fails: bool, reason: str = "NULL") -> str:
    def num(v) -> str:
        return "NULL::DOUBLE" if v is None else f"{v}::DOUBLE"

    return (f"SELECT {q(kind)} AS expectation, {'NULL::VARCHAR' if column is None else q(column)} AS \"column\", {success} AS success, "
            f"{observed} AS observed, {num(lo)} AS lower_bound, {num(hi)} AS upper_bound, "
            f"{reason}::VARCHAR AS reason, {fails} AS fails_batch FROM ev")


def exists_check(column: str, there: bool = True) -> str:
    return check("column_exists", column, str(there), f"MAX({int(there)})::DOUBLE", None, None, True)


def null_check(column: str, bound: float) -> str:
    ratio = f"AVG(CASE WHEN {column} IS NULL THEN 0 ELSE 1 END)"
    return check("not_null_ratio", column, f"{ratio} >= {bound}", rnd(ratio, 4), bound, None, True)


def unique_check(column: str) -> str:
    extra = f"COUNT(*) - COUNT(DISTINCT {column}) - MAX(CASE WHEN {column} IS NULL THEN 1 ELSE 0 END)"
    return check("unique", column, f"{extra} = 0", f"({extra})::DOUBLE", None, None, False)


def between_check(column: str, lo: float, hi: float) -> str:
    share = f"AVG(CASE WHEN {column} IS NULL THEN NULL WHEN {column} BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END)"
    return check("between", column, f"COALESCE({share} >= 0.99, TRUE)", rnd(share, 4), lo, hi, False)


def rows_check(lo: int, hi: int) -> str:
    return check("row_count", None, f"COUNT(*) BETWEEN {lo} AND {hi}", "COUNT(*)::DOUBLE", lo, hi, True)


def union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


EVENT_SUITE = union(
    exists_check("EVENT_ID"), exists_check("DATE"), exists_check("MAIN_ACTOR"),
    null_check("EVENT_ID", 1.0), null_check("DATE", 1.0), rows_check(100, 50000),
    between_check("IMPACT_SCORE", -10.0, 10.0), between_check("SENTIMENT_SCORE", -100.0, 100.0),
)

# -- look-ups and titles ------------------------------------------------------

LOOK = f"{EV}, known AS (SELECT * FROM ev WHERE MAIN_ACTOR IS NOT NULL AND ACTOR_COUNTRY_CODE IS NOT NULL AND {MONTH})"
LOOK_COLS = "EVENT_ID, DATE, ACTOR_COUNTRY_CODE, HEADLINE, MAIN_ACTOR, IMPACT_SCORE, ARTICLE_COUNT, NEWS_LINK"


def ranking(condition: str, rows: int) -> str:
    return f"""{LOOK} SELECT ACTOR_COUNTRY_CODE, {n()} AS EVENT_COUNT FROM known WHERE {condition}
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {rows}"""


_NAME_CASE = f"CASE c_custkey % {len(NAMES)} " + " ".join(f"WHEN {i} THEN {q(x)}" for i, x in enumerate(NAMES)) + " END"
_ALIASES = "aliases(a, code) AS (VALUES " + ", ".join(f"({q(a)}, {q(c)})" for a, c in V.COUNTRY_ALIASES.items()) + ")"
_MEMBERS = "members(region, code) AS (VALUES " + ", ".join(
    f"({q(r)}, {q(c)})" for r, codes in V.REGION_MEMBERS.items() for c in codes) + ")"
_BEST_ROW = f"""{ART}, {url_titles('art')},
  ranked AS (SELECT a.*, t.title AS HEADLINE, ROW_NUMBER() OVER (PARTITION BY EVENT_ID ORDER BY (t.title IS NULL),
    length(COALESCE(t.title, '')) DESC, NEWS_LINK) AS rn, COUNT(*) OVER (PARTITION BY EVENT_ID) AS c
    FROM art a JOIN titles t ON t.url = a.NEWS_LINK)"""
EXTRACTED = f"""{_BEST_ROW} SELECT * EXCLUDE (rn, c, ARTICLE_COUNT),
  CASE WHEN c > ARTICLE_COUNT THEN c::DOUBLE ELSE ARTICLE_COUNT END AS ARTICLE_COUNT FROM ranked WHERE rn = 1"""
_TITLE = f"""array_to_string(list_transform(str_split(lower(HEADLINE), ' '), lambda w, i:
  CASE WHEN i > 1 AND w IN {in_list(V.SMALL_WORDS)} THEN w ELSE (CASE w[1] WHEN 'ß' THEN 'Ss' ELSE upper(w[1]) END) || w[2:] END), ' ')"""
_LAB = f"{EV}, {ISO}, {REGIONAL}"
TOPIC = "CASE theme " + " ".join(f"WHEN {q(c)} THEN {q(l)}" for c, l in V.THEME_LABELS.items()) + " END"


def emotion_mean(name: str, alias: str) -> str:
    return f"{r6(f'COALESCE(AVG({name}), 0)')} AS {alias}"


_RADAR = ", ".join(f"COALESCE(AVG(EMOTION_{e.upper()}), 0) AS {e}" for e in V.RADAR_EMOTIONS)
_RADAR_TOP = "CASE greatest(" + ", ".join(V.RADAR_EMOTIONS) + ") " + " ".join(
    f"WHEN {e} THEN '{e.capitalize()}'" for e in V.RADAR_EMOTIONS) + " END"
_LATER = "DATE >= '20240110'"
_STATUS = bands("COALESCE(AVG(IMPACT_SCORE), 0)", V.WEEKLY_STATUS_BANDS)

ORACLES: dict[str, str] = {
    "read_event_feed": f"{ART} SELECT * FROM art",
    "read_gkg_feed": f"{FEED} SELECT * FROM feed",
    "read_zipped_feed": f"{ART} SELECT * FROM art",
    "missing_feed_slots": f"""WITH landed AS (SELECT DISTINCT time_bucket(INTERVAL 15 MINUTES, ts) AS slot FROM events),
      slots AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30 23:45:00', INTERVAL 15 MINUTES)) AS slot)
      SELECT 'events' AS feed, strftime(slot, '%Y%m%d%H%M00') || {q(V.EVENT_SLOT_SUFFIX)} AS file_name FROM slots
      WHERE slot NOT IN (SELECT slot FROM landed)""",
    "append_new_events": f"""{EV}, stored AS (SELECT {EV_COLS} FROM ev WHERE DATE < '20240116'),
      batch AS (SELECT {EV_COLS.replace('ARTICLE_COUNT', 'ARTICLE_COUNT + 100 AS ARTICLE_COUNT')} FROM ev WHERE {_LATER})
      SELECT * FROM stored UNION ALL SELECT * FROM batch WHERE EVENT_ID NOT IN
      (SELECT EVENT_ID FROM stored WHERE DATE >= (SELECT MIN(DATE) FROM batch))""",
    "append_moved_days": f"""{EV}, ids AS (SELECT EVENT_ID, DATE, ARTICLE_COUNT, CAST(EVENT_ID AS BIGINT) AS i FROM ev)
      SELECT EVENT_ID, CASE WHEN DATE < '20240116' AND i % 5 > 0 THEN DATE WHEN i % 3 = 0 THEN '20231231'
          WHEN i % 7 = 0 THEN '20240229' ELSE DATE END AS DATE,
        CASE WHEN DATE < '20240116' AND i % 5 > 0 OR i % 3 = 0 OR i % 7 = 0 THEN ARTICLE_COUNT ELSE 0.0 END AS ARTICLE_COUNT
      FROM ids""",
    "append_new_gkg": f"""{GKG}, stored AS (SELECT GKG_ID, DATE, AVG_TONE, TOP_THEMES FROM gkg WHERE DATE < 20240116000000),
      batch AS (SELECT GKG_ID, DATE, AVG_TONE + 100 AS AVG_TONE, TOP_THEMES FROM gkg WHERE DATE >= 20240110000000)
      SELECT * FROM (SELECT * FROM stored UNION ALL SELECT * FROM batch WHERE GKG_ID NOT IN (SELECT GKG_ID FROM stored
      WHERE DATE >= (SELECT MIN(DATE) FROM batch))) WHERE DATE >= 20240116000000""",
    "retention_delete": f"{GKG} SELECT GKG_ID, DATE FROM gkg WHERE DATE >= 20240116000000",
    "write_embeddings": _MERGED_VEC,
    "register_models": f"""{GKG}, ev AS ({EVENTS_SQL}), {_THEME_ROWS}
      SELECT 'fct_daily_events' AS model, COUNT(DISTINCT DATE) AS n_rows, {n()} AS total FROM ev
      UNION ALL SELECT 'dim_actors', COUNT(*), {n('SUM(k)')} FROM (SELECT COUNT(*) AS k FROM ev WHERE MAIN_ACTOR IS NOT NULL
        GROUP BY MAIN_ACTOR, ACTOR_COUNTRY_CODE)
      UNION ALL SELECT 'dim_countries', COUNT(DISTINCT ACTOR_COUNTRY_CODE), {n()} FROM ev WHERE ACTOR_COUNTRY_CODE IS NOT NULL
      UNION ALL SELECT 'fct_daily_emotions', COUNT(DISTINCT substr(CAST(DATE AS VARCHAR), 1, 8)), {n()} FROM gkg
      UNION ALL SELECT 'fct_trending_themes', COUNT(*), {n('SUM(k)')} FROM (SELECT COUNT(*) AS k FROM themes GROUP BY theme HAVING COUNT(*) >= 10)""",
    "load_stats": f"""{EV} SELECT {n()} AS total_rows, COUNT(EMBEDDING) AS embedded_rows, {n_if(WEEK)} AS inserted_rows FROM ev""",
    "dq_column_exists": f"{EV} {union(exists_check('EVENT_ID'), exists_check('NO_SUCH', False))}",
    "dq_not_null_ratio": f"{EV} {union(null_check('MAIN_ACTOR', 0.95), null_check('EVENT_ID', 1.0))}",
    "dq_unique": f"{EV} {union(unique_check('EVENT_ID'), unique_check('MAIN_ACTOR'))}",
    "dq_between": f"{EV} {union(between_check('IMPACT_SCORE', -5.0, 5.0), between_check('SENTIMENT_SCORE', -100.0, 100.0))}",
    "dq_row_count": f"{EV} {rows_check(100, 50000)}",
    "dq_report": f"{EV} {EVENT_SUITE}",
    "dq_summary": f"""{EV}, rep AS ({EVENT_SUITE}) SELECT {n()} AS evaluated, {n_if('success')} AS successful,
      {n_if('NOT success')} AS unsuccessful, bool_and(success OR NOT fails_batch) AS passed FROM rep""",
    "dq_dbt_unique": f"{ART} SELECT EVENT_ID, {n()} AS n_rows FROM art WHERE EVENT_ID IS NOT NULL GROUP BY 1 HAVING COUNT(*) > 1",
    "dq_dbt_not_null": f"{STG} SELECT event_id FROM stg WHERE actor_name IS NULL",
    "dq_accepted_values": f"""{STG} SELECT sentiment_category, {n()} AS n_rows FROM stg
      WHERE sentiment_category NOT IN ('Negative', 'Neutral', 'Positive') GROUP BY 1""",
    "dq_positive_articles": f"{DAILY} SELECT event_date_raw, total_articles FROM daily WHERE total_articles < 0",
    "model_test_report": f"""{STG}, art AS ({ARTICLES_SQL}), actors AS (SELECT DISTINCT actor_name, actor_country_code FROM stg
        WHERE actor_name IS NOT NULL),
      measured(model, test, "column", failures) AS (
        SELECT 'staged_articles', 'unique', 'event_id', COUNT(EVENT_ID) - COUNT(DISTINCT EVENT_ID) FROM art
        UNION ALL SELECT 'staged_articles', 'not_null', 'event_id', 0
        UNION ALL SELECT 'staged_articles', 'not_null', 'actor_name', {n_if('MAIN_ACTOR IS NULL')} FROM art
        UNION ALL SELECT 'stg_events', 'accepted_values', 'sentiment_category', {n_if("sentiment_category NOT IN ('Very Negative', 'Negative', 'Neutral', 'Positive', 'Very Positive', 'Crisis')")} FROM stg
        UNION ALL SELECT 'dim_actors', 'unique', 'actor_name', COUNT(*) - COUNT(DISTINCT actor_name) FROM actors
        UNION ALL SELECT model, test, col, 0 FROM (VALUES ('stg_events', 'unique', 'event_id'), ('stg_events', 'not_null', 'event_id'),
          ('stg_events', 'not_null', 'event_date_raw'), ('stg_gkg_emotions', 'unique', 'gkg_id'), ('stg_gkg_emotions', 'not_null', 'gkg_id'),
          ('stg_gkg_emotions', 'not_null', 'date_str'), ('fct_daily_events', 'unique', 'event_date_raw'),
          ('fct_daily_events', 'not_null', 'event_date_raw'), ('fct_daily_events', 'not_null', 'event_count'),
          ('fct_daily_events', 'not_negative', 'total_articles'), ('dim_actors', 'not_null', 'actor_name'),
          ('dim_actors', 'not_null', 'total_events'), ('dim_countries', 'unique', 'country_code'),
          ('dim_countries', 'not_null', 'country_code'), ('dim_countries', 'not_null', 'total_events'),
          ('fct_trending_themes', 'unique', 'theme'), ('fct_trending_themes', 'not_null', 'theme'),
          ('fct_trending_themes', 'not_null', 'mention_count')) v(model, test, col))
      SELECT model, test, "column", CAST(failures AS BIGINT) AS failures FROM measured""",
    "dq_freshness": """WITH m AS (SELECT date_trunc('second', MAX(ts)) AS t FROM events),
      l AS (SELECT t, date_diff('second', t, TIMESTAMP '2024-01-30 23:00:00') AS lag FROM m)
      SELECT strftime(t, '%Y%m%d%H%M%S') AS newest, CAST(lag AS BIGINT) AS lag_seconds,
      CASE WHEN lag > 10800 THEN 'error' WHEN lag > 3600 THEN 'warn' ELSE 'pass' END AS status FROM l""",
    "stg_events": f"{STG} SELECT * EXCLUDE (embedding), CASE WHEN embedding IS NULL THEN NULL ELSE CAST(len(embedding) AS BIGINT) END AS embedding_dims FROM stg",
    "stg_emotions": f"""{GKG} SELECT GKG_ID AS gkg_id, DATE AS date_str, SOURCE AS source_name, PERSONS AS persons, ORGS AS organizations,
      TOP_THEMES AS themes, AVG_TONE AS avg_tone, POSITIVE_SCORE AS positive_score, NEGATIVE_SCORE AS negative_score,
      {", ".join(f"EMOTION_{e.upper()} AS {e}" for e in V.GCAM_EMOTIONS.values())},
      CASE WHEN AVG_TONE < -2 THEN 'negative' WHEN AVG_TONE > 2 THEN 'positive' ELSE 'neutral' END AS sentiment_category,
      {_DOMINANT} AS dominant_emotion FROM gkg""",
    "dominant_emotion": f"{GKG} SELECT {_DOMINANT} AS dominant_emotion, {n()} AS articles FROM gkg GROUP BY 1",
    "filter_recent": f"{EV} SELECT {EV_COLS} FROM ev WHERE {WEEK}",
    "filter_calendar_week": f"{EV} SELECT {EV_COLS} FROM ev WHERE DATE BETWEEN '20240122' AND '20240128'",
    "filter_calendar_month": f"{EV} SELECT {EV_COLS} FROM ev WHERE DATE BETWEEN '20240101' AND '20240131'",
    "alerts_3d": f"""{EV} SELECT EVENT_ID, MAIN_ACTOR, ACTOR_COUNTRY_CODE, IMPACT_SCORE FROM ev WHERE {DAYS3} AND IMPACT_SCORE < -4
      AND MAIN_ACTOR IS NOT NULL ORDER BY IMPACT_SCORE, EVENT_ID LIMIT 15""",
    "trending_week": f"{EV} {_TRENDING}",
    "feed_week": f"{EV} {_FEED}",
    "pending_embeddings": f"""{PENDING} SELECT EVENT_ID, DATE, MAIN_ACTOR, ACTOR_COUNTRY_CODE, HEADLINE FROM pending""",
    "article_count_fix": f"""{ART}, c AS (SELECT *, COUNT(*) OVER (PARTITION BY EVENT_ID) AS k,
      ROW_NUMBER() OVER (PARTITION BY EVENT_ID ORDER BY NEWS_LINK) AS rn FROM art)
      SELECT * EXCLUDE (k, rn, ARTICLE_COUNT), CASE WHEN k > ARTICLE_COUNT THEN k::DOUBLE ELSE ARTICLE_COUNT END AS ARTICLE_COUNT
      FROM c WHERE rn = 1""",
    "new_rows_only": f"{EV} SELECT {EV_COLS} FROM ev WHERE DATE >= '20240116'",
    "country_name": f"{_LAB} SELECT x.EVENT_ID, x.ACTOR_COUNTRY_CODE, {COUNTRY} AS COUNTRY FROM ev x",
    "region_label": f"{_LAB} SELECT x.EVENT_ID, x.ACTOR_COUNTRY_CODE, {_REGION} AS REGION FROM ev x",
    "country_alias": f"""WITH {ISO}, {_ALIASES}, people AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN n_name ELSE {_NAME_CASE} END AS place
        FROM customer JOIN nation ON n_nationkey = c_nationkey),
      named AS (SELECT *, lower(trim(place)) AS nm FROM people),
      near AS (SELECT DISTINCT nm, arg_min(alpha3, (NOT contains(lower(name), nm), levenshtein(nm, lower(name)), lower(name))) OVER (PARTITION BY nm) AS code
        FROM (SELECT DISTINCT nm FROM named) p, iso WHERE length(nm) >= 3
        AND (contains(lower(name), nm) OR starts_with(lower(name), substr(nm, 1, 3))))
      SELECT c_custkey, place, CASE WHEN length(nm) < 2 OR nm IN {in_list(STOP_WORDS)} THEN NULL
        WHEN nm IN (SELECT a FROM aliases) THEN (SELECT code FROM aliases WHERE a = nm)
        WHEN regexp_full_match(nm, '\\d+') THEN NULL
        ELSE (SELECT code FROM near WHERE near.nm = named.nm) END AS COUNTRY_CODE FROM named""",
    "country_of_words": f"""WITH {ISO}, {_ALIASES}, per AS (SELECT lower(trim(w)) AS word, COUNT(*) AS n FROM
        (SELECT DISTINCT conv_id, turn, text, unnest(list_distinct(string_split(text, ' '))) AS w FROM conversations) GROUP BY 1),
      stop AS (SELECT word FROM per WHERE n * 100 >= (SELECT COUNT(*) FROM conversations)),
      named AS (SELECT word, lower(trim(word)) AS nm FROM (SELECT word FROM per UNION SELECT lower(n_name) FROM nation)),
      near AS (SELECT nm, arg_min(alpha3, (NOT contains(lower(name), nm), levenshtein(nm, lower(name)), lower(name))) AS code
        FROM named, iso WHERE length(nm) >= 3 AND (contains(lower(name), nm) OR starts_with(lower(name), substr(nm, 1, 3))) GROUP BY nm)
      SELECT word, CASE WHEN length(nm) < 2 OR nm IN (SELECT word FROM stop WHERE word IS NOT NULL) THEN NULL
        WHEN nm IN (SELECT a FROM aliases) THEN (SELECT code FROM aliases WHERE a = nm)
        WHEN regexp_full_match(nm, '\\d+') THEN NULL
        ELSE (SELECT code FROM near WHERE near.nm = named.nm) END AS COUNTRY_CODE FROM named""",
    "region_expand": f"{EV}, {_MEMBERS} SELECT {EV_COLS} FROM ev WHERE ACTOR_COUNTRY_CODE IN (SELECT code FROM members WHERE region = 'middle east')",
    "region_members": f"WITH {_MEMBERS} SELECT m.region, m.code AS ACTOR_COUNTRY_CODE FROM region r JOIN members m ON m.region = lower(r.r_name)",
    "vector_cross_score": f"""{PAIRS} SELECT EVENT_ID, query_id, {r6('similarity')} AS similarity, position FROM (SELECT *,
      ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY similarity DESC, EVENT_ID) AS position FROM pairs) WHERE position <= 10""",
    "merge_embeddings": _MERGED_VEC,
    "fct_daily_events": f"""{DAILY} SELECT *, {pct('events_with_headlines', 'event_count')} AS headline_coverage_pct,
      {pct('events_with_embeddings', 'event_count')} AS embedding_coverage_pct,
      {pct('positive_count + very_positive_count', 'event_count')} AS positive_event_pct,
      {pct('negative_count + very_negative_count', 'event_count')} AS negative_event_pct FROM daily""",
    "dim_actors": f"""{STG}, stats AS (SELECT actor_name, actor_country_code, {n()} AS total_events,
        COUNT(DISTINCT event_date_raw) AS active_days, MIN(event_date_raw) AS first_seen_date, MAX(event_date_raw) AS last_seen_date,
        SUM(article_count) AS total_articles, {_MEANS}, MAX(article_count) AS max_articles_single_event
        FROM stg WHERE actor_name IS NOT NULL GROUP BY 1, 2),
      modes AS (SELECT actor_name, actor_country_code, sentiment_category, ROW_NUMBER() OVER (PARTITION BY actor_name, actor_country_code
        ORDER BY COUNT(*) DESC, sentiment_category) AS rn FROM stg WHERE actor_name IS NOT NULL GROUP BY 1, 2, 3)
      SELECT s.*, m.sentiment_category AS typical_sentiment,
        ROW_NUMBER() OVER (ORDER BY total_events DESC, s.actor_name, s.actor_country_code NULLS LAST) AS event_rank,
        ROW_NUMBER() OVER (ORDER BY total_articles DESC, s.actor_name, s.actor_country_code NULLS LAST) AS article_rank
      FROM stats s JOIN modes m ON m.rn = 1 AND m.actor_name = s.actor_name
        AND m.actor_country_code IS NOT DISTINCT FROM s.actor_country_code""",
    "dim_countries": f"""{STG}, stats AS (SELECT actor_country_code AS country_code, {n()} AS total_events,
        COUNT(DISTINCT actor_name) AS unique_actors, COUNT(DISTINCT event_date_raw) AS active_days,
        MIN(event_date_raw) AS first_event_date, MAX(event_date_raw) AS last_event_date, SUM(article_count) AS total_articles, {_MEANS},
        {n_if('goldstein_scale < 0')} AS negative_events, {n_if('goldstein_scale >= 0')} AS positive_events
        FROM stg WHERE actor_country_code IS NOT NULL GROUP BY 1)
      SELECT *, {pct('negative_events', 'total_events')} AS negative_event_pct,
        ROW_NUMBER() OVER (ORDER BY total_events DESC, country_code) AS activity_rank FROM stats""",
    "fct_daily_emotions": f"""{GKG}, d AS (SELECT *, substr(CAST(DATE AS VARCHAR), 1, 8) AS date_key FROM gkg)
      SELECT date_key, strptime(date_key, '%Y%m%d')::DATE AS event_date, {rnd('AVG(AVG_TONE)', 2)} AS avg_mood,
      {rnd('AVG(POSITIVE_SCORE)', 2)} AS avg_positive, {rnd('AVG(NEGATIVE_SCORE)', 2)} AS avg_negative,
      {", ".join(f"{rnd(f'AVG(EMOTION_{e.upper()})', 2)} AS avg_{e}" for e in V.DAILY_EMOTIONS)},
      {n()} AS article_count FROM d GROUP BY 1, 2""",
    "fct_trending_themes": f"""{GKG}, {_THEME_ROWS} SELECT theme, {n()} AS mention_count, COUNT(DISTINCT date_key) AS days_active,
      {rnd('(COUNT(*) / COUNT(DISTINCT date_key)::DOUBLE)', 1)} AS avg_daily_mentions FROM themes GROUP BY 1 HAVING COUNT(*) >= 10
      ORDER BY mention_count DESC, theme LIMIT 100""",
    "explode_themes": f"{GKG}, {_THEME_ROWS} SELECT date_key, theme, {n()} AS mentions FROM themes GROUP BY 1, 2",
    "weekly_metrics": f"{EV} SELECT {n()} AS recent, {n_if('abs(IMPACT_SCORE) > 6')} AS critical FROM ev WHERE {WEEK}",
    "weekly_hotspot": f"""{EV} SELECT ACTOR_COUNTRY_CODE, {n()} AS events FROM ev WHERE {WEEK} AND ACTOR_COUNTRY_CODE IS NOT NULL
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""",
    "dashboard_metrics": f"""{EV} SELECT (SELECT {n()} FROM ev) AS total, (SELECT {n()} FROM ev WHERE {WEEK}) AS recent,
      (SELECT {n()} FROM ev WHERE {WEEK} AND abs(IMPACT_SCORE) > 6) AS critical,
      (SELECT ACTOR_COUNTRY_CODE FROM ev WHERE {WEEK} AND ACTOR_COUNTRY_CODE IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) AS hotspot""",
    "countries_month": f"""{EV} SELECT ACTOR_COUNTRY_CODE AS country, {n()} AS events FROM ev WHERE {MONTH}
      AND ACTOR_COUNTRY_CODE IS NOT NULL GROUP BY 1""",
    "timeseries_month": f"""{EV} SELECT DATE, {n()} AS events, {n_if('IMPACT_SCORE < -2')} AS negative,
      {n_if('IMPACT_SCORE > 2')} AS positive FROM ev WHERE {MONTH} GROUP BY 1""",
    "sentiment_week": f"""{EV} SELECT {r6('AVG(IMPACT_SCORE)')} AS avg, {n_if('IMPACT_SCORE < -3')} AS neg,
      {n_if('IMPACT_SCORE > 3')} AS pos, {n()} AS total FROM ev WHERE {WEEK} AND IMPACT_SCORE IS NOT NULL""",
    "weekly_sentiment_status": f"""{EV} SELECT {r6('AVG(IMPACT_SCORE)')} AS avg, {n_if('IMPACT_SCORE < -3')} AS neg,
      {n_if('IMPACT_SCORE > 3')} AS pos, {n()} AS total, {_STATUS} AS status FROM ev WHERE {WEEK} AND IMPACT_SCORE IS NOT NULL""",
    "actors_week": f"""{EV} SELECT MAIN_ACTOR, ACTOR_COUNTRY_CODE, {n()} AS events, {r6('AVG(IMPACT_SCORE)')} AS avg_impact FROM ev
      WHERE {WEEK} AND length(MAIN_ACTOR) > 3 GROUP BY 1, 2 ORDER BY events DESC, 1, 2 NULLS LAST LIMIT 10""",
    "tone_distribution": f"""{EV} SELECT {bands('IMPACT_SCORE', V.TONE_HISTOGRAM_BANDS)} AS cat, {n()} AS cnt FROM ev
      WHERE {WEEK} AND IMPACT_SCORE IS NOT NULL GROUP BY 1""",
    "parse_gkg": f"{GKG} SELECT * FROM gkg",
    "emotion_pulse": f"""{GKG} SELECT {emotion_mean('AVG_TONE', 'avg_mood')}, {r6('AVG(EMOTION_FEAR)')} AS avg_fear,
      {r6('AVG(EMOTION_JOY)')} AS avg_joy, {r6('AVG(EMOTION_ANGER)')} AS avg_anger, {r6('AVG(EMOTION_TRUST)')} AS avg_trust,
      {n()} AS article_count, {bands('COALESCE(AVG(AVG_TONE), 0)', V.MOOD_BANDS)} AS mood_label FROM gkg WHERE {DAY}""",
    "emotion_radar": f"""{GKG}, m AS (SELECT {_RADAR} FROM gkg WHERE {DAY})
      SELECT {", ".join(f"{r6(e)} AS {e}" for e in V.RADAR_EMOTIONS)}, {_RADAR_TOP} AS dominant,
      {r6("greatest(" + ", ".join(V.RADAR_EMOTIONS) + ")")} AS dominant_value FROM m""",
    "emotion_stats": f"""{GKG} SELECT {n()} AS total_articles, {emotion_mean('POSITIVE_SCORE', 'avg_positive')},
      {emotion_mean('NEGATIVE_SCORE', 'avg_negative')}, {emotion_mean('EMOTION_FEAR', 'avg_fear')},
      {emotion_mean('EMOTION_JOY', 'avg_joy')} FROM gkg WHERE {DAY}""",
    "emotion_insight": f"""{GKG}, m AS (SELECT AVG(AVG_TONE) AS tone, AVG(EMOTION_FEAR) AS fear, AVG(EMOTION_JOY) AS joy,
      AVG(EMOTION_ANGER) AS anger, {n()} AS cnt FROM gkg WHERE {DAY})
      SELECT {r6('tone')} AS tone, {r6('fear')} AS fear, {r6('joy')} AS joy, {r6('anger')} AS anger, cnt,
      CASE WHEN fear > joy * 1.5 THEN 'fear' WHEN joy > fear * 1.5 THEN 'joy' WHEN tone < -2 THEN 'negative'
        WHEN tone > 2 THEN 'positive' ELSE 'balanced' END AS insight FROM m""",
    "trending_topics": f"""{GKG}, {_THEME_ROWS}, top AS (SELECT theme, COUNT(*) AS k FROM themes WHERE {DAY} GROUP BY 1)
      SELECT label, {n('SUM(k)')} AS mentions FROM (SELECT {TOPIC} AS label, k FROM top) WHERE label IS NOT NULL
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8""",
    "article_counts": f"{ART} SELECT EVENT_ID, {n()} AS OUR_ARTICLE_COUNT FROM art GROUP BY 1",
    "extract_headlines": EXTRACTED,
    "best_row_per_event": f"{_BEST_ROW} SELECT EVENT_ID, NEWS_LINK, HEADLINE, c AS OUR_ARTICLE_COUNT FROM ranked WHERE rn = 1",
    "headline_from_url": f"{ART}, {url_titles('art')} SELECT a.EVENT_ID, a.NEWS_LINK, t.title AS HEADLINE FROM art a JOIN titles t ON t.url = a.NEWS_LINK",
    "headline_of_lines": f"""WITH lines AS ({_LINES}), {cleaned('lines', 'line')}
      SELECT l.doc_id, l.line_no, k.headline FROM lines l LEFT JOIN cleaned k ON k.raw = l.line""",
    "headline_of_links": f"""WITH lines AS ({_LINES}), linked AS (SELECT doc_id, line_no, 'https://www.example.com/2024/01/'
        || replace(trim(line), ' ', '-') || '-' || CAST(doc_id AS VARCHAR) || '.html' AS NEWS_LINK FROM lines), {url_titles('linked')}
      SELECT l.doc_id, l.line_no, l.NEWS_LINK, t.title AS HEADLINE FROM linked l JOIN titles t ON t.url = l.NEWS_LINK""",
    "headline_of_pages": f"""WITH linked AS (SELECT page_id, url AS NEWS_LINK FROM pages), {url_titles('linked')}
      SELECT l.page_id, t.title AS HEADLINE FROM linked l JOIN titles t ON t.url = l.NEWS_LINK""",
    "segment_score": f"{EV} SELECT EVENT_ID, {n(_score('HEADLINE'))} AS score FROM ev",
    "clean_headline": f"WITH {cleaned('conversations', 'text')} SELECT c.conv_id, c.turn, k.headline FROM conversations c LEFT JOIN cleaned k ON k.raw = c.text",
    "clean_headlines": f"{EV}, {best('ev')} SELECT {EV_COLS.replace('HEADLINE', 'BH AS HEADLINE')} FROM best WHERE BH IS NOT NULL",
    "best_headline": f"{EV}, {best('ev')} SELECT EVENT_ID, BH AS HEADLINE FROM best",
    "title_case": f"{EV} SELECT EVENT_ID, {_TITLE} AS title FROM ev",
    "headline_quality": f"{EV} SELECT EVENT_ID, HEADLINE, {r6(quality('HEADLINE', 'NEWS_LINK'))} AS QUALITY FROM ev",
    "headline_quality_by_day": f"""{EV}, {best('ev')}, s AS (SELECT DATE, {quality('BH', 'NEWS_LINK')} AS qq, {garbage('BH')} AS g
        FROM best WHERE BH IS NOT NULL)
      SELECT DATE, {n()} AS headlines, {r6('AVG(qq)')} AS avg_quality, {r6('AVG(CASE WHEN qq < 0.3 THEN 1 ELSE 0 END)')} AS low_quality_share,
      {r6('AVG(CASE WHEN g >= 2 THEN 1 ELSE 0 END)')} AS garbage_share FROM s GROUP BY 1""",
    "garbage_words": f"SELECT conv_id, turn, {n(garbage('text'))} AS garbage FROM conversations",
    "dedupe_key": f"{EV} SELECT EVENT_ID, {key_of('HEADLINE')} AS dedupe_key FROM ev",
    "dedupe_stories": f"""{EV}, {best('ev')}, f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key_of('BH')}
        ORDER BY ARTICLE_COUNT DESC, DATE DESC, EVENT_ID) AS rn FROM best WHERE BH IS NOT NULL)
      SELECT {EV_COLS.replace('HEADLINE', 'BH AS HEADLINE')} FROM f WHERE rn = 1""",
    "impact_label": f"{EV} SELECT EVENT_ID, {_IMPACT} AS label FROM ev",
    "intensity_label": f"{EV} SELECT EVENT_ID, {_INTENSITY} AS label FROM ev",
    "tone_flag": f"{EV} SELECT EVENT_ID, {_TONE} AS label FROM ev",
    "severity_tag": f"{EV} SELECT EVENT_ID, {_SEVERITY} AS label FROM ev",
    "label_events": f"""{_LAB} SELECT x.EVENT_ID, {_REGION} AS REGION, {_IMPACT} AS IMPACT_LABEL, {_INTENSITY} AS INTENSITY, {_TONE} AS TONE,
      {_SEVERITY} AS SEVERITY, {bands('IMPACT_SCORE', V.SENTIMENT_BANDS)} AS SENTIMENT_CATEGORY FROM ev x""",
    "label_distribution": f"{EV} SELECT DATE, {_INTENSITY} AS label, {n()} AS events FROM ev GROUP BY 1, 2",
    "story_score": f"{EV}, {best('ev')}, {_SCORED} SELECT EVENT_ID, {r6('QUALITY')} AS QUALITY, {r6('SCORE')} AS SCORE FROM scored",
    "process_stories": stories(_TRENDING.split(" ORDER BY")[0], 20),
    "process_feed": stories(_FEED.split(" ORDER BY")[0], 50),
    "query_terms": f"""WITH w AS (SELECT conv_id, turn, list_filter(list_transform(list_filter(
        regexp_split_to_array(trim(text, e' \\t\\n\\r'), '\\s+'), lambda w: length(w) > 2),
        lambda w: regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}]', '', 'g')),
        lambda w: length(w) > 2 AND w NOT IN {in_list(V.SEARCH_STOP_WORDS)}) AS t FROM conversations)
      SELECT conv_id, turn, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS position, unnest(t) AS term FROM w""",
    "embedding_inputs": f"{INPUTS} SELECT EVENT_ID, text FROM inputs",
    "embed_batch": f"""{INPUTS}, low AS (SELECT EVENT_ID, lower(text) AS t FROM inputs) SELECT EVENT_ID,
      CASE WHEN t IS NOT NULL THEN 26::BIGINT END AS dims, ({_LETTERS})::DOUBLE AS checksum FROM low""",
    "cosine_similarity": f"SELECT vec_id, {r6(cosine('embedding'))} AS similarity FROM embeddings",
    "score_pairs": f"{PAIRS} SELECT EVENT_ID, query_id, {r6('similarity')} AS similarity FROM pairs",
    "similarity_group": f"""{EV} SELECT HEADLINE, MAX(DATE) AS DATE, MAX(ACTOR_COUNTRY_CODE) AS ACTOR_COUNTRY_CODE, MAX(MAIN_ACTOR) AS MAIN_ACTOR,
      MAX(IMPACT_SCORE) AS IMPACT_SCORE, SUM(ARTICLE_COUNT) AS ARTICLE_COUNT, MAX(NEWS_LINK) AS NEWS_LINK,
      {r6(f"MAX({cosine('EMBEDDING')})")} AS similarity FROM ev WHERE HEADLINE IS NOT NULL AND EMBEDDING IS NOT NULL
      GROUP BY HEADLINE HAVING MAX({cosine('EMBEDDING')}) >= 0.2""",
    "dedupe_best_similarity": f"""{EV}, s AS (SELECT EVENT_ID, HEADLINE, {cosine('EMBEDDING')} AS sim FROM ev
        WHERE HEADLINE IS NOT NULL AND EMBEDDING IS NOT NULL)
      SELECT EVENT_ID, HEADLINE, {r6('sim')} AS similarity FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY HEADLINE
        ORDER BY sim DESC, EVENT_ID) AS rn FROM s) WHERE rn = 1""",
    "hybrid_search": f"{EV}, {branch('h', _LIKE)} SELECT {_HITS}, {r6('similarity')} AS similarity FROM h",
    "vector_search": f"{EV}, {branch('v', 'ARTICLE_COUNT >= 2')} SELECT {_HITS}, {r6('similarity')} AS similarity FROM v",
    "merged_search": f"{EV}, {merged()} SELECT {_HITS}, {r6('similarity')} AS similarity FROM merged",
    "keyword_search": f"{EV}, {by_words('k', ['peace', 'agreement'])} SELECT {_HITS} FROM k",
    "search_with_fallback": f"""{EV}, {merged()}, {by_words('k2', ['flood', 'warning', 'river', 'valleys'])},
      {by_words('k3', ['central', 'bank', 'decision'])}
      SELECT {_HITS}, {r6('similarity')} AS similarity, 1::BIGINT AS query_id FROM merged
      UNION ALL SELECT {_HITS}, NULL, 2 FROM k2 UNION ALL SELECT {_HITS}, NULL, 3 FROM k3""",
    "answer_context": f"""{EV}, {merged(None)}, {cleaned('merged', 'HEADLINE')}, {ISO}, {REGIONAL},
      c AS (SELECT x.*, k.headline AS BH FROM merged x JOIN cleaned k ON k.raw = x.HEADLINE WHERE k.headline IS NOT NULL),
      x AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY BH ORDER BY similarity DESC, ARTICLE_COUNT DESC) AS rn FROM c
        WHERE {quality('BH', 'NEWS_LINK')} >= 0.3::DOUBLE AND {garbage('BH')} < 2 AND length(BH) >= 15) WHERE rn = 1
        ORDER BY similarity DESC, ARTICLE_COUNT DESC, BH LIMIT 8),
      lines AS (SELECT similarity, ARTICLE_COUNT, BH, concat_ws(' ', '[' || strftime(strptime(DATE, '%Y%m%d'), '%b %d') || ']', BH,
        '— ' || {COUNTRY}, CASE WHEN {_SEVERITY} <> '' THEN '[' || {_SEVERITY} || ']' END) AS line FROM x)
      SELECT 1::BIGINT AS query_id, string_agg(line, e'\\n' ORDER BY similarity DESC, ARTICLE_COUNT DESC, BH) AS context,
      {n()} AS n_lines FROM lines HAVING COUNT(*) > 0""",
    "search_questions": f"""{EV}, asked AS (SELECT conv_id AS query_id, list_filter(list_transform(list_filter(
          regexp_split_to_array(trim(text, e' \\t\\n\\r'), '\\s+'), lambda w: length(w) > 2),
          lambda w: regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}]', '', 'g')),
          lambda w: length(w) > 2 AND w NOT IN {in_list(V.SEARCH_STOP_WORDS)}) AS terms,
        CASE WHEN conv_id % 3 <> 0 THEN embedding::DOUBLE[] END AS vec
        FROM conversations JOIN embeddings ON vec_id = conv_id % (SELECT max(vec_id) + 1 FROM embeddings) WHERE turn = 0),
      usable AS (SELECT * FROM ev WHERE length(HEADLINE) > 15 AND {MONTH}),
      scored AS (SELECT query_id, u.*, list_cosine_similarity(EMBEDDING::DOUBLE[], vec) AS s,
          len(list_filter(terms, lambda t: contains(lower(HEADLINE), t))) AS hits FROM usable u, asked),
      branches AS (SELECT *, 0 AS b FROM scored WHERE s IS NOT NULL AND NOT isnan(s) AND hits > 0
        UNION ALL SELECT *, 1 FROM scored WHERE s IS NOT NULL AND NOT isnan(s) AND ARTICLE_COUNT >= 2),
      grouped AS (SELECT query_id, b, HEADLINE, MAX(DATE) AS DATE, MAX(ACTOR_COUNTRY_CODE) AS ACTOR_COUNTRY_CODE, MAX(MAIN_ACTOR) AS MAIN_ACTOR,
        MAX(IMPACT_SCORE) AS IMPACT_SCORE, SUM(ARTICLE_COUNT) AS ARTICLE_COUNT, MAX(NEWS_LINK) AS NEWS_LINK, MAX(s) AS similarity
        FROM branches GROUP BY query_id, b, HEADLINE HAVING MAX(s) >= 0.2),
      kept AS (SELECT * FROM grouped QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id, b ORDER BY similarity DESC, HEADLINE) <= 10),
      one AS (SELECT * FROM kept QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id, HEADLINE ORDER BY similarity DESC, b) = 1),
      best AS (SELECT * FROM one QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY similarity DESC, HEADLINE) <= 10),
      words AS (SELECT * FROM scored WHERE hits > 0 AND query_id NOT IN (SELECT query_id FROM best)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY hits DESC, ARTICLE_COUNT DESC, EVENT_ID) <= 10)
      SELECT query_id, {_HITS}, {r6('similarity')} AS similarity FROM best UNION ALL SELECT query_id, {_HITS}, NULL FROM words""",
    "event_count_by_filter": f"{LOOK} SELECT {n()} AS TOTAL_EVENTS FROM known WHERE ACTOR_COUNTRY_CODE IN ('USA', 'RUS')",
    "country_ranking": ranking("IMPACT_SCORE < -3", 10),
    "lookup_crisis_by_country": ranking("IMPACT_SCORE < -3", 5),
    "lookup_crisis_events": f"""{LOOK} SELECT {LOOK_COLS} FROM known WHERE ACTOR_COUNTRY_CODE IN ('USA', 'RUS') AND ARTICLE_COUNT >= 3
      AND IMPACT_SCORE < -3 ORDER BY ARTICLE_COUNT DESC, IMPACT_SCORE, EVENT_ID LIMIT 250""",
    "lookup_major_events": f"""{LOOK} SELECT {LOOK_COLS} FROM known WHERE ARTICLE_COUNT > 20 ORDER BY ARTICLE_COUNT DESC, EVENT_ID LIMIT 250""",
    "lookup_top_countries": ranking("TRUE", 5),
    "lookup_event_count": f"{LOOK} SELECT {n()} AS TOTAL_EVENTS FROM known",
    "lookup_events": f"""{LOOK} SELECT {LOOK_COLS} FROM known WHERE ACTOR_COUNTRY_CODE IN ('USA', 'RUS') AND ARTICLE_COUNT > 3
      ORDER BY ARTICLE_COUNT DESC, DATE DESC, EVENT_ID LIMIT 250""",
    "present_events": f"""{LOOK}, found AS (SELECT {LOOK_COLS} FROM known WHERE ACTOR_COUNTRY_CODE IN ('USA', 'RUS') AND ARTICLE_COUNT > 3), {url_titles('found')},
      chosen AS (SELECT f.*, CASE WHEN length(trim(f.HEADLINE)) > 15 THEN f.HEADLINE ELSE t.title END AS t FROM found f JOIN titles t ON t.url = f.NEWS_LINK),
      {cleaned('chosen', 't')}, {ISO}, {REGIONAL},
      x AS (SELECT * FROM (SELECT c.*, k.headline AS BH, ROW_NUMBER() OVER (PARTITION BY {key_of('k.headline')}
        ORDER BY ARTICLE_COUNT DESC, DATE DESC, EVENT_ID) AS rn FROM chosen c JOIN cleaned k ON k.raw = c.t WHERE k.headline IS NOT NULL)
        WHERE rn = 1 ORDER BY ARTICLE_COUNT DESC, DATE DESC, EVENT_ID LIMIT 5)
      SELECT EVENT_ID, strftime(strptime(DATE, '%Y%m%d'), '%b %d') AS DATE, BH AS HEADLINE,
        COALESCE({COUNTRY}, x.ACTOR_COUNTRY_CODE, '—') AS COUNTRY, {_IMPACT} AS SEVERITY, IMPACT_SCORE, NEWS_LINK FROM x""",
    "stream_ingest_events": EXTRACTED,
    "stream_ingest_gkg": f"{GKG} SELECT * FROM gkg",
    "stream_dedupe": f"{ART} SELECT DISTINCT EVENT_ID, DATE FROM art",
    "stream_dedupe_days": f"{EV} SELECT EVENT_ID, CAST(1 AS BIGINT) AS n_rows, CAST(1 AS BIGINT) AS n_fit FROM ev",
    "stream_daily_counts": "SELECT strftime(ts, '%Y%m%d') AS day, COUNT(*) AS events FROM events GROUP BY 1",
    "stream_retention": f"{GKG} SELECT DATE, {n()} AS n_rows FROM gkg WHERE DATE >= 20240116000000 GROUP BY 1",
    "stream_freshness": f"""{EV}, m AS (SELECT strptime(MAX(DATE), '%Y%m%d') AS t FROM ev),
      l AS (SELECT t, date_diff('second', t, TIMESTAMP '2024-01-30 02:00:00') AS lag FROM m)
      SELECT strftime(t, '%Y%m%d%H%M%S') AS newest, CAST(lag AS BIGINT) AS lag_seconds,
      CASE WHEN lag > 10800 THEN 'error' WHEN lag > 3600 THEN 'warn' ELSE 'pass' END AS status FROM l""",
}

# marts kept up by refreshes hold the rows of a full build
ORACLES |= {
    "refreshed_daily_events": ORACLES["fct_daily_events"],
    "refreshed_actors": ORACLES["dim_actors"],
    "refreshed_countries": ORACLES["dim_countries"],
    "refreshed_daily_emotions": ORACLES["fct_daily_emotions"],
    "refreshed_themes": ORACLES["fct_trending_themes"].split("ORDER BY")[0],
}
