"""DuckDB SQL for the operators that SQL can express, by plain joins instead of their methods."""

from __future__ import annotations

from presswire.llm.license_scan import TEMPLATES
from presswire.llm.quality_rules import ERROR, FALSE_REJECTION, GRID
from presswire.llm.url_reputation import ADDRESS, WIDE_SUFFIXES

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _search_words(text: str) -> str:
    return (f"list_filter(string_split_regex(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), "
            r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")


def _count_words(text: str) -> str:
    return rf"list_filter(string_split_regex(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _license_scan() -> str:
    templates = ", ".join(
        f"({i}, '{t.label}', {str(t.base).lower()}, {t.slack}, {t.cover}, string_split('{t.phrase}', ' '), {t.needed}::INT[])"
        for i, t in enumerate(TEMPLATES))
    return f"""
WITH templates(template, label, base, slack, cover, tw, needed) AS (VALUES {templates}),
pairs AS (
    SELECT template, slack, i - 1 AS at_t, tw[i] AS t1, tw[i + 1] AS t2
    FROM (SELECT *, unnest(range(1, len(tw))) AS i FROM templates)),
words AS (SELECT doc_id, {_search_words("text")} AS ws FROM documents),
grams AS (
    SELECT doc_id, i - 1 AS at_d, ws[i] AS w1, ws[i + 1] AS w2
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM words)),
votes AS (
    SELECT DISTINCT doc_id, template, slack, at_d, at_t, at_d - at_t AS diagonal
    FROM grams JOIN pairs p ON w1 = t1 AND w2 = t2),
shifts AS (
    SELECT *, unnest(range(diagonal - slack, diagonal + slack + 1)) AS middle FROM votes),
spans AS (
    SELECT s.doc_id, label, base, min(at_d) AS start_word, len(list_distinct(list(at_t))) / (len(any_value(tw)) - 1) AS share
    FROM shifts s JOIN (SELECT DISTINCT doc_id, template, diagonal FROM votes) v
        ON v.doc_id = s.doc_id AND v.template = s.template AND v.diagonal = s.middle
    JOIN templates t ON t.template = s.template
    GROUP BY s.doc_id, s.template, middle, label, base
    HAVING share >= any_value(cover) AND list_has_all(list(at_t), any_value(needed))),
found AS (
    SELECT doc_id, count(*) FILTER (base) AS n_base, min(start_word) FILTER (base) AS first_word,
        max(start_word) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
    FROM spans GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
    CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM words w LEFT JOIN found f ON f.doc_id = w.doc_id"""


def _quality_rules() -> str:
    allowed = FALSE_REJECTION / len(GRID)
    tries = " UNION ALL ".join(
        f"SELECT lang, n, '{rule}' AS rule, {c}::DOUBLE AS cutoff, rejected_{rule}_{i} AS k FROM counts"
        for rule, cs in GRID.items() for i, c in enumerate(cs))
    counts = ", ".join(
        f"count(*) FILTER ({rule} > {c}::DOUBLE) AS rejected_{rule}_{i}" for rule, cs in GRID.items() for i, c in enumerate(cs))
    above = " OR ".join(f"coalesce({rule} > cut_{rule}, false)" for rule in GRID)
    cuts = ", ".join(f"min(cutoff) FILTER (rule = '{rule}') AS cut_{rule}" for rule in GRID)
    return rf"""
WITH words AS (SELECT doc_id, lang, coalesce(text, '') AS body, {_count_words("text")} AS ws FROM documents),
windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS times
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM words)),
repeats AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + 3)) AS p FROM windows WHERE times > 1) GROUP BY doc_id),
lines AS (
    SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (
        SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM words)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
    SELECT w.doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
        coalesce(l.n, 0) AS n_lines, length(body) - length(regexp_replace(body, '[A-Z]', '', 'g')) AS caps,
        length(body) - length(replace(body, '!', '')) AS bangs
    FROM words w LEFT JOIN repeats r ON r.doc_id = w.doc_id LEFT JOIN lines l ON l.doc_id = w.doc_id),
measured AS (
    SELECT *, n_symbols / greatest(n_words, 1)::DOUBLE AS symbol_rate,
        n_dup_lines / greatest(n_lines, 1)::DOUBLE AS dup_line_rate,
        n_repeat_words / greatest(n_words, 1)::DOUBLE AS repeat_rate,
        caps / greatest(word_chars, 1)::DOUBLE AS caps_rate, bangs / greatest(n_words, 1)::DOUBLE AS bang_rate,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
    FROM base),
counts AS (
    SELECT lang, count(*) AS n, {counts}
    FROM measured m JOIN labels l ON l.doc_id = m.doc_id WHERE l.quality = 1 AND NOT base_failed GROUP BY lang),
tries AS ({tries}),
passed AS (
    SELECT lang, rule, cutoff FROM tries
    WHERE k < n * {allowed!r}::DOUBLE AND list_sum(list_transform(range(0, k + 1), lambda i: exp(
        lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
        + i * ln({allowed!r}::DOUBLE) + (n - i) * ln(1 - {allowed!r}::DOUBLE))))
        <= {ERROR!r}::DOUBLE / {len(GRID)} / (SELECT count(*) FROM counts)),
cuts AS (SELECT lang, {cuts} FROM passed GROUP BY lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT ({above}) AS kept
FROM measured m LEFT JOIN cuts c ON c.lang IS NOT DISTINCT FROM m.lang"""


_DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_search_words("text")} AS ws FROM documents),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_search_words("text")} AS ws FROM benchmark),
windows AS (
    SELECT DISTINCT item, m, array_to_string(ws[i:i + m - 1], ' ') AS gram
    FROM (SELECT item, ws, least(10, len(ws)) AS m, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i
          FROM items WHERE len(ws) > 0)),
places AS (
    SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS gram
    FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
          FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(ws) >= m)),
hits AS (SELECT doc_id, p.m, i, item FROM places p JOIN windows w ON w.m = p.m AND w.gram = p.gram),
hit_words AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
    SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(h.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words h ON h.doc_id = d.doc_id LEFT JOIN hit_items t ON t.doc_id = d.doc_id"""


def _level(name: str, below: str, keys: str) -> str:
    """Counts of a level, and the strength of the prior it gives to the level below."""
    group = f"GROUP BY {keys}" if keys else ""
    columns = f"{keys}, " if keys else ""
    return f"""{name}_sums AS (
    SELECT {columns}sum(n) AS n, sum(bad) AS bad, count(*)::DOUBLE AS children, sum(n * n) AS sizes,
        sum(bad * bad / n) AS squares FROM {below} {group}),
{name}_prior AS (
    SELECT *, 1 / greatest(0.001, least(0.9, coalesce(CASE
            WHEN n - sizes / n - (children - 1) > 0 AND bad > 0 AND bad < n
            THEN ((squares - bad * bad / n) / ((bad / n) * (1 - bad / n)) - (children - 1))
                 / (n - sizes / n - (children - 1)) END, 0.1))) - 1 AS strength
    FROM {name}_sums)"""


# The rules, longest first.
_RULES = [
    ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("example.com", "/en/", "example.com/en/", "block"),
    ("net", "/es/", "net/es/", "block"),
    ("net", "/fr/", "net/fr/", "block"),
    ("com", "/", "com/", "allow"),
]


def _url_reputation() -> str:
    wide = ", ".join(f"'{x}'" for x in WIDE_SUFFIXES)

    def case(value: int) -> str:
        return "CASE " + " ".join(
            f"WHEN (host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}') THEN '{r[value]}'"
            for r in _RULES) + " END"

    def bound(mean: str, weight: str) -> str:
        return f"({mean} - 1.645 * sqrt({mean} * (1 - {mean}) / ({weight} + 1)))"

    return rf"""
WITH parts AS (
    SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
        THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM parts),
placed AS (
    SELECT page_id, translate(raw_host, '{_UPPER}', '{_UPPER.lower()}') AS host,
        regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM raw),
place AS (
    SELECT *, CASE WHEN address THEN bare ELSE array_to_string(labels[-wide - 1:], '.') END AS domain,
        CASE WHEN address THEN '' ELSE array_to_string(labels[-wide:], '.') END AS suffix FROM (
        SELECT *, string_split(bare, '.') AS labels, regexp_matches(bare, '{ADDRESS}') AS address,
            CASE WHEN array_to_string(string_split(bare, '.')[-2:], '.') IN ({wide}) THEN 2 ELSE 1 END AS wide
        FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM placed))),
outcomes AS (
    SELECT page_id AS id, max(CASE WHEN l.quality = 0 OR l.toxic = 1 THEN 1
                                   WHEN coalesce(l.quality, l.toxic) IS NOT NULL THEN 0 END) AS bad
    FROM place p JOIN labels l ON l.doc_id = TRY_CAST(regexp_extract(p.path, '^/[a-z]+/([0-9]+)', 1) AS BIGINT)
    GROUP BY page_id),
known AS (SELECT p.*, bad FROM place p JOIN outcomes ON page_id = id WHERE bad IS NOT NULL),
hosts AS (
    SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM known GROUP BY ALL),
{_level("domain", "hosts", "domain, suffix")},
{_level("suffix", "domain_sums", "suffix")},
{_level("whole", "suffix_sums", "")},
whole_mean AS (SELECT strength, (coalesce(bad, 0.0) + 1) / (coalesce(n, 0.0) + 2) AS mean FROM whole_prior),
suffix_mean AS (
    SELECT s.*, (s.bad + w.strength * w.mean) / (s.n + w.strength) AS mean FROM suffix_prior s, whole_mean w),
domain_mean AS (
    SELECT d.*, (d.bad + s.strength * s.mean) / (d.n + s.strength) AS mean
    FROM domain_prior d JOIN suffix_mean s ON s.suffix = d.suffix),
host_mean AS (
    SELECT h.*, d.strength AS up, (h.bad + d.strength * d.mean) / (h.n + d.strength) AS mean
    FROM hosts h JOIN domain_mean d ON d.domain = h.domain AND d.suffix = h.suffix),
bounds AS (
    SELECT p.page_id, p.host, p.path, coalesce({bound("h.mean", "(h.n + h.up)")}, {bound("d.mean", "d.strength")},
        {bound("s.mean", "s.strength")}, {bound("w.mean", "w.strength")}) AS bad_bound
    FROM place p LEFT JOIN host_mean h ON h.host = p.host
    LEFT JOIN domain_mean d ON d.domain = p.domain AND d.suffix = p.suffix
    LEFT JOIN suffix_mean s ON s.suffix = p.suffix, whole_mean w)
SELECT page_id, host, path, {case(2)} AS rule,
    coalesce({case(3)}, CASE WHEN bad_bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM bounds"""


def _source_divergence() -> str:
    def scaled(n: str, total: str) -> str:
        return f"CAST(1 + (CAST(1000000000 AS HUGEINT) * ({n} + 1)) // ({total} + v) AS BIGINT)"

    return rf"""
WITH docs AS (
    SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
    FROM documents),
seen AS (SELECT doc, lang, source, unnest(ws) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM seen GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT s.lang, source, s.term, count(*) AS n FROM seen s JOIN kept k ON k.lang = s.lang AND k.term = s.term GROUP BY ALL),
totals AS (
    SELECT g.lang, g.source, coalesce(sum(n), 0) AS total
    FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source
    GROUP BY ALL),
chances AS (
    SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, {scaled("coalesce(c.n, 0)", "t.total")} AS p,
        {scaled("k.n", "l.total")} AS q
    FROM totals t JOIN kept k ON k.lang = t.lang JOIN langs l ON l.lang = t.lang
    LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM chances a JOIN chances b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM chances WHERE n > 0 AND p > q)
SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
    FROM parts)
WHERE part = 'pair' OR rank <= 200"""


_VORONOI_SEARCH = """
WITH vectors AS (
    SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS units
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.nth, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.units, d.units) AS BIGINT) AS score
    FROM vectors q JOIN vectors d ON q.nth <> d.nth WHERE q.vec_id % 20 = 0),
ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""


# crc32 bit by bit over the digits of an id
_PREFIX_TRIE = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS family, xor(list_reduce(
        list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
        lambda c, b: list_reduce(
            range(8), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)),
        4294967295), 4294967295) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
    SELECT t.conv_id, pos, role, text FROM turns t JOIN convs c ON c.conv_id = t.conv_id WHERE pos >= h
    UNION ALL
    SELECT c.conv_id, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.family WHERE pos < h),
whole AS (
    SELECT c.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS path
    FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
members AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM whole),
nodes AS (
    SELECT list_slice(path, 1, depth) AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth), ''))
            AS ends_sha256
    FROM members GROUP BY 1, 2),
kids AS (SELECT list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.path = n.path),
above AS (SELECT *, unnest(range(0, depth + 1)) AS up FROM known),
sums AS (
    SELECT list_slice(path, 1, up) AS path, count(*) FILTER (n_children = 0) AS n_leaves,
        sum(CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(path[depth].text) END) AS saved_tokens
    FROM above GROUP BY 1)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves,
    CAST(s.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256
FROM known k JOIN sums s ON s.path = k.path LEFT JOIN nodes p ON k.depth > 0 AND p.path = list_slice(k.path, 1, k.depth - 1)"""


ORACLES: dict[str, str] = {
    "op1_license_scan": _license_scan(),
    "op3_quality_rules": _quality_rules(),
    "op4_decontamination": _DECONTAMINATION,
    "op6_url_reputation": _url_reputation(),
    "op11_prefix_trie": _PREFIX_TRIE,
    "op12_voronoi_search": _VORONOI_SEARCH,
    "op13_source_divergence": _source_divergence(),
}
