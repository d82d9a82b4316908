"""URL filter: fixed rules first, then an empirical-Bayes reputation of the host.

Rules are a short list of (allow or block, host and path); a rule fits its host and all
subdomains if the path starts with the rule's, and the longest fitting rule decides.

Everywhere else the verdict comes from labelled page outcomes. Counts of pages and of bad pages
are summed per host, registered domain and suffix. Each level is shrunk towards the one above
by a beta-binomial prior: its mean is the parent's posterior mean, and its strength comes from
how much the parent's children differ (moments of the counts, weighted by their size). A url is
blocked if the lower posterior bound of its host's share of bad pages is above `max_bad`.
Levels are grouped sums (map-side combine first, so a host with a third of all pages is one row
per task); the join back is an ordinary equi-join on the host, whose hot keys adaptive execution
splits.

Defined cases: a null url, or one without `://`, has an empty host and path, and is judged by the
reputation of the empty host like any other; a page without an outcome, or with a null one, counts
nowhere; hosts without outcomes take the posterior of their domain, suffix or all pages; without
any outcomes everything is allowed; repeated pages repeat their row and count once each, with the worst outcome
of their page_id; an empty table gives no rows; other columns are ignored, whatever their names; a url of any length is
read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from presswire.llm.common import UPPER


@dataclass(frozen=True)
class Rule:
    verdict: str
    place: str

    @property
    def host(self) -> str:
        return self.place.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.place.partition("/")[2]


# The rules of the production filter.
RULES = [
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
    Rule("block", "net/fr/"),
]

#: Second-level registries under which domains are registered.
WIDE_SUFFIXES = [
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "sch.uk",
    "asn.au", "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au",
    "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "school.nz",
    "ac.jp", "ad.jp", "co.jp", "ed.jp", "go.jp", "gr.jp", "lg.jp", "ne.jp", "or.jp",
    "ac.kr", "co.kr", "go.kr", "ne.kr", "or.kr", "re.kr",
    "ac.in", "co.in", "edu.in", "firm.in", "gen.in", "gov.in", "ind.in", "net.in", "nic.in", "org.in",
    "ac.za", "co.za", "gov.za", "net.za", "org.za", "web.za",
    "com.br", "edu.br", "gov.br", "net.br", "org.br",
    "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "com.tw", "edu.tw", "gov.tw", "net.tw", "org.tw",
    "com.hk", "edu.hk", "gov.hk", "net.hk", "org.hk",
    "com.sg", "edu.sg", "gov.sg", "net.sg", "org.sg",
    "com.my", "edu.my", "gov.my", "net.my", "org.my",
    "com.tr", "edu.tr", "gov.tr", "net.tr", "org.tr",
    "com.mx", "edu.mx", "gob.mx", "net.mx", "org.mx",
    "com.ar", "edu.ar", "gob.ar", "net.ar", "org.ar",
    "com.ua", "edu.ua", "gov.ua", "net.ua", "org.ua",
    "ac.id", "co.id", "go.id", "or.id", "web.id",
    "ac.th", "co.th", "go.th", "in.th", "or.th",
    "ac.il", "co.il", "gov.il", "net.il", "org.il",
    "com.pl", "edu.pl", "gov.pl", "net.pl", "org.pl",
]
#: Hosts that are IP addresses.
ADDRESS = r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*)$"

MAX_BAD = 0.5
Z = 1.645
#: Share of variance between children that a prior may assume, and the one taken when they can't tell.
LEAST_SHARE, MOST_SHARE, UNKNOWN_SHARE = 0.001, 0.9, 0.1


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, UPPER.lower()), path


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix, without user and port.

    The suffix is the last label, or the last two if they are one of `WIDE_SUFFIXES`; the domain has one
    label more. An IP address is its own domain, under an empty suffix.
    """
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    wide = F.substring_index(bare, ".", -2).isin(*WIDE_SUFFIXES)
    address = bare.rlike(ADDRESS)
    domain = F.when(address, bare).when(wide, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    suffix = F.when(address, F.lit("")).when(wide, F.substring_index(bare, ".", -2)).otherwise(
        F.substring_index(bare, ".", -1))
    return domain, suffix


def first_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Place and verdict of the longest fitting rule, null if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r.place), r.place))

    def pick(values: list[str]) -> Column:
        out = F.lit(None).cast("string")
        for rule, value in reversed(list(zip(ordered, values))):
            fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
            out = F.when(fits, F.lit(value)).otherwise(out)
        return out

    return pick([r.place for r in ordered]), pick([r.verdict for r in ordered])


def located(pages: DataFrame, *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    host, path = host_and_path(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")))
    split = pages.select(F.col(f"`{page_id}`").alias("page_id"), host.alias("host"), path.alias("path"))
    domain, suffix = domain_and_suffix(F.col("host"))
    return split.withColumns({"domain": domain, "suffix": suffix})


def _sums(children: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of a level from those below, and the share of variance between its children."""
    p = F.col("bad") / F.col("n")
    between = F.col("squares") - F.col("bad") * F.col("bad") / F.col("n")
    freedom = F.col("children") - 1
    room = F.col("n") - F.col("sizes") / F.col("n") - freedom
    share = F.when((room > 0) & (p > 0) & (p < 1), (between / (p * (1 - p)) - freedom) / room)
    return (
        children.groupBy(*keys).agg(
            F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").cast("double").alias("children"),
            F.sum(F.col("n") * F.col("n")).alias("sizes"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("squares"),
        )
        .withColumn("between", F.greatest(F.lit(LEAST_SHARE), F.least(F.lit(MOST_SHARE), F.coalesce(
            share, F.lit(UNKNOWN_SHARE)))))
        .withColumn("strength", 1 / F.col("between") - 1)
        .select(*keys, "n", "bad", "strength")
    )


def reputations(outcomes: DataFrame) -> dict[str, DataFrame]:
    """Posterior of every host, domain, suffix and of all, from (host, domain, suffix, bad 0/1)."""
    known = outcomes.filter(F.col("bad").isNotNull())
    hosts = known.groupBy("host", "domain", "suffix").agg(
        F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    domains = _sums(hosts, ["domain", "suffix"])
    suffixes = _sums(domains, ["suffix"])
    whole = _sums(suffixes, [])

    def shrunk(level: DataFrame, above: DataFrame, on: list[str]) -> DataFrame:
        up = above.select(*on, F.col("mean").alias("up_mean"), F.col("strength").alias("up_strength"))
        return (level.join(up, on) if on else level.join(F.broadcast(up))).withColumn(
            "mean", (F.col("bad") + F.col("up_strength") * F.col("up_mean")) / (F.col("n") + F.col("up_strength")))

    whole = whole.withColumn("mean", (F.coalesce("bad", F.lit(0.0)) + 1) / (F.coalesce("n", F.lit(0.0)) + 2))
    suffixes = shrunk(suffixes, whole, [])  # one row above
    domains = shrunk(domains, suffixes, ["suffix"])
    hosts = shrunk(hosts, domains, ["domain", "suffix"])
    return {"host": hosts, "domain": domains, "suffix": suffixes, "all": whole}


def lower_bound(mean: Column, weight: Column, z: float = Z) -> Column:
    """Mean less z standard deviations of a beta distribution with this mean and total weight."""
    return mean - z * F.sqrt(mean * (1 - mean) / (weight + 1))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    *,
    rules: list[Rule] | None = None,
    page_id: str = "page_id",
    url: str = "url",
    max_bad: float = MAX_BAD,
    z: float = Z,
) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_bound of every page.

    `outcomes` has page_id and bad (1 bad, 0 good) of the pages that are labelled.
    """
    place = located(pages, page_id=page_id, url=url)
    # one outcome per id, so that repeated pages count once each
    known = outcomes.groupBy(F.col("page_id").alias("__page")).agg(F.max("bad").alias("bad"))
    levels = reputations(place.join(known, F.col("page_id") == F.col("__page")))
    host = levels["host"].select(
        "host", lower_bound(F.col("mean"), F.col("n") + F.col("up_strength"), z).alias("host_bound"))
    domain = levels["domain"].select(
        "domain", "suffix", lower_bound(F.col("mean"), F.col("strength"), z).alias("domain_bound"))
    suffix = levels["suffix"].select(
        "suffix", lower_bound(F.col("mean"), F.col("strength"), z).alias("suffix_bound"))
    whole = levels["all"].select(lower_bound(F.col("mean"), F.col("strength"), z).alias("all_bound"))
    # bounds are looked up once per distinct host, and pages meet them in one join
    distinct = place.groupBy("host", "domain", "suffix").agg(F.count("*").alias("pages")).drop("pages")
    bounds = (
        distinct.join(host, "host", "left").join(domain, ["domain", "suffix"], "left").join(suffix, "suffix", "left")
        .join(F.broadcast(whole))  # one row
        .select("host", F.coalesce("host_bound", "domain_bound", "suffix_bound", "all_bound").alias("bad_bound"))
    )
    rule, verdict = first_rule(F.col("host"), F.col("path"), RULES if rules is None else rules)
    return (
        place.join(bounds, "host")
        .select("page_id", "host", "path", rule.alias("rule"),
                F.coalesce(verdict, F.when(F.col("bad_bound") > max_bad, "block").otherwise("allow")).alias("verdict"),
                "bad_bound")
    )

