"""URL filters by rules and empirical-Bayes host reputation (DataFrame functions only).

Labelled page outcomes are counted per host and shrunk through beta-binomial priors: a host's prior is
centred at its registered domain, the domain's at its suffix, the suffix's at all pages. How strongly a
level is shrunk is estimated from the spread between its members. A page without a rule is blocked
when the lower posterior bound of its host's bad rate is above a limit.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm.common import documents, query
from trialspark.shared import materialize

LIMIT = 0.25  # bad rate that a blocked host is believed to exceed
Z = 1.645  # one-sided 95 %
RHO_MIN, RHO_MAX = 0.001, 0.999  # correlation of outcomes inside one member of a level
SECOND_LEVEL = "(?:ac|co|com|edu|gov|net|org)[.](?:au|br|cn|in|jp|kr|nz|uk|za)"  # two-label public suffixes
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host with all its subdomains, below a path prefix."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_host(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def registered_domain(host: Column) -> Column:
    """The public suffix and the label before it; addresses of digits and single labels stand for themselves."""
    bare = bare_host(host)
    domain = F.regexp_extract(bare, rf"[^.]*[.](?:{SECOND_LEVEL}|[^.]+)$", 0)
    return F.when(bare.rlike("^[0-9.]*$") | (domain == ""), bare).otherwise(domain)


def public_suffix(host: Column) -> Column:
    """What follows the first dot of the registered domain; none for addresses and single labels."""
    domain = registered_domain(host)
    return F.when(domain.rlike("^[0-9.]*$"), F.lit("")).otherwise(F.regexp_extract(domain, "^[^.]*[.](.*)$", 1))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, NULL if none does.

    Rules are a list given by the caller and become one expression. Of equally long ones the one with
    the longer host wins, then the alphabetically first.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.host, r.path, r.verdict))

    def fits(r: Rule) -> Column:
        return ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)

    found = [F.when(fits(r), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))) for r in ranked]
    return F.coalesce(*found) if found else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(members: DataFrame) -> float:
    """Pseudo-counts of the prior of a level, by the method of moments over its members.

    ``members`` has ``n, k`` and the prior mean ``p``. The excess of the squared deviations over the
    binomial gives the correlation of two outcomes inside a member; without any member of two
    outcomes the prior weighs as one.
    """
    n, spread = F.col("n"), F.col("p") * (1 - F.col("p"))
    sums = members.agg(
        F.sum((F.col("k") - n * F.col("p")) * (F.col("k") - n * F.col("p"))).alias("squares"),
        F.sum(n * spread).alias("binomial"),
        F.sum(n * (n - 1) * spread).alias("pairs"),
    ).first()
    if not sums["pairs"]:
        return 1.0
    rho = min(max((sums["squares"] - sums["binomial"]) / sums["pairs"], RHO_MIN), RHO_MAX)
    return 1 / rho - 1


def host_reputation(counts: DataFrame, z: float = Z) -> DataFrame:
    """Posterior of each host's bad rate: ``host, n, k, mean, bound`` (``bound``: mean less ``z`` deviations, 0 at least).

    ``counts`` has one row per host: ``host``, ``n`` labelled pages, ``k`` bad ones among them; hosts
    without labelled pages have 0 and take over their domain's mean. Every level is summed from
    the one below, so pages are only counted once. An empty input gives no rows.
    """
    hosts = counts.select("host", registered_domain(F.col("host")).alias("domain"), public_suffix(F.col("host")).alias("suffix"), "n", "k")
    hosts = materialize(hosts)
    sums = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = materialize(hosts.groupBy("suffix", "domain").agg(*sums))
    suffixes = materialize(domains.groupBy("suffix").agg(*sums))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    overall = (whole["k"] + 0.5) / (whole["n"] + 1)

    def shrunk(members: DataFrame) -> DataFrame:
        s = _strength(members)
        return members.withColumn("a", F.col("k") + s * F.col("p")).withColumn("b", F.col("n") - F.col("k") + s * (1 - F.col("p")))

    mean = F.col("a") / (F.col("a") + F.col("b"))
    top = shrunk(suffixes.withColumn("p", F.lit(overall))).select("suffix", mean.alias("p"))
    middle = shrunk(domains.join(top, "suffix")).select("suffix", "domain", mean.alias("p"))
    below = shrunk(hosts.join(middle, ["suffix", "domain"]))
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return below.select("host", "n", "k", mean.alias("mean"), F.greatest(F.lit(0.0), mean - z * deviation).alias("bound"))


def judge(pages: DataFrame, counts: DataFrame, rules: list[Rule] = RULES, limit: float = LIMIT, z: float = Z) -> DataFrame:
    """Verdict on each row's ``url``: all other columns, then ``host, path, rule, verdict, n_labelled, n_bad, bound``.

    ``counts`` is as in ``host_reputation``; hosts that it lacks count as unlabelled. The longest fitting rule decides; without one a
    host whose ``bound`` is above ``limit`` is blocked and every other allowed. A NULL url or one
    without ``://`` has an empty host, which fits no rule and is a member like any other. Repeated
    rows get the same verdict; input columns of the added names are replaced.
    """
    added = ["host", "path", "rule", "verdict", "n_labelled", "n_bad", "bound"]
    url = F.col("url")
    kept = [c for c in pages.columns if c not in added]
    rows = pages.select(*kept, host_of(url).alias("host"), path_of(url).alias("path")).withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    every = rows.groupBy("host").agg(F.lit(0).alias("n"), F.lit(0).alias("k")).unionByName(counts.select("host", "n", "k"))
    totals = every.groupBy("host").agg(F.sum("n").cast("long").alias("n"), F.sum("k").cast("long").alias("k"))
    standing = host_reputation(totals, z)
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    # a host with a third of all pages is on the left of a left join: run-time re-planning splits it
    return rows.join(standing, "host", "left").select(
        *kept,
        "host",
        "path",
        F.col("__rule.rule").alias("rule"),
        F.coalesce(F.col("__rule.verdict"), own).alias("verdict"),
        F.col("n").alias("n_labelled"),
        F.col("k").alias("n_bad"),
        "bound",
    )


ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def first_paragraph(html: Column) -> Column:
    """Plain text of the first paragraph line inside ``<article>``; empty when there is none."""
    inner = F.regexp_extract(F.coalesce(html, F.lit("")), "(?s)<article>.*?<p>(.*?)(?:<br>|</p>)", 1)
    plain = F.regexp_replace(inner, "<[^>]*>", "")
    return F.trim(reduce(lambda text, pair: F.replace(text, F.lit(pair[0]), F.lit(pair[1])), ENTITIES, plain))


def page_outcomes(pages: DataFrame, docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """Labelled page outcomes as counts per host: ``host, n, k``.

    A page takes the label of the documents made from it: those whose first line is the page's first
    paragraph. Where labelled documents of one first line disagree, the page has no outcome. Both
    sides are counted before they meet (pages per host and paragraph, documents per line), so that
    neither a common line nor a hot host makes pairs.
    """
    lines = docs.select("doc_id", F.md5(F.encode(F.trim(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)), "UTF-8")).alias("line"))
    marked = lines.join(labels.select("doc_id", F.col(label).alias("bad")).filter("bad is not null"), "doc_id")
    agreed = marked.groupBy("line").agg(F.min("bad").alias("bad"), F.max("bad").alias("most")).filter("bad = most").select("line", "bad")
    seen = pages.select(host_of(F.col("url")).alias("host"), first_paragraph(F.col("html")).alias("paragraph")).filter("paragraph <> ''")
    linked = seen.groupBy("host", F.md5(F.encode("paragraph", "UTF-8")).alias("line")).agg(F.count("*").alias("pages")).join(agreed, "line")
    return linked.groupBy("host").agg(F.sum("pages").alias("n"), F.sum(F.col("pages") * F.col("bad")).alias("k"))


_BARE = "regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '')"
_FITS = {r.name: f"(host = '{r.host}' or host like '%.{r.host}') and starts_with(path, '{r.path}')" for r in RULES}
_RULE_ORDER = sorted(RULES, key=lambda r: -len(r.name))
_ENTITY_SQL = reduce(lambda x, p: f"replace({x}, '{p[0]}', '{p[1].replace(chr(39), chr(39) * 2)}')", ENTITIES, "regexp_replace(inner_html, '<[^>]*>', '', 'g')")
_PAIRS = "sum(n * (n - 1) * p * (1 - p))"
_RHO = f"least(greatest((sum((k - n * p) * (k - n * p)) - sum(n * p * (1 - p))) / nullif({_PAIRS}, 0), {RHO_MIN}), {RHO_MAX})"
_STRENGTH = f"case when coalesce({_PAIRS}, 0) = 0 then 1.0 else 1 / {_RHO} - 1 end as s"
ORACLE = rf"""
with page as (select page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
                     coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path,
                     regexp_extract(coalesce(html, ''), '(?s)<article>.*?<p>(.*?)(?:<br>|</p>)', 1) as inner_html from pages),
line as (select trim(split_part(coalesce(text, ''), chr(10), 1)) as line, min(toxic) as bad from documents join labels using (doc_id)
         where toxic is not null group by 1 having min(toxic) = max(toxic)),
outcome as (select host, count(*) as n, sum(bad) as k from (select host, trim({_ENTITY_SQL}) as line from page) join line using (line) where line <> '' group by host),
h0 as (select host, coalesce(n, 0)::bigint as n, coalesce(k, 0)::bigint as k, {_BARE} as bare from (select distinct host from page) left join outcome using (host)),
h1 as (select *, regexp_extract(bare, '[^.]*[.](?:{SECOND_LEVEL}|[^.]+)$') as reg from h0),
h2 as (select *, case when regexp_matches(bare, '^[0-9.]*$') or reg = '' then bare else reg end as domain from h1),
h as (select *, case when regexp_matches(domain, '^[0-9.]*$') then '' else regexp_extract(domain, '^[^.]*[.](.*)$', 1) end as suffix from h2),
d as (select suffix, domain, sum(n) as n, sum(k) as k from h group by all),
s as (select suffix, sum(n) as n, sum(k) as k from d group by all),
s1 as (select *, ((select sum(k) from s) + 0.5::double) / ((select sum(n) from s) + 1) as p from s),
s2 as (select suffix, (k + s * p) / (n + s) as p from s1, (select {_STRENGTH} from s1)),
d1 as (select d.*, p from d join s2 using (suffix)),
d2 as (select suffix, domain, (k + s * p) / (n + s) as p from d1, (select {_STRENGTH} from d1)),
e1 as (select h.*, p from h join d2 using (suffix, domain)),
e2 as (select host, n, k, k + s * p as a, n - k + s * (1 - p) as b from e1, (select {_STRENGTH} from e1)),
e as (select host, n, k, greatest(0.0, a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) as bound from e2),
ruled as (select *, case {" ".join(f"when {_FITS[r.name]} then '{r.name}'" for r in _RULE_ORDER)} end as rule from page)
select page_id, host, path, rule,
       case {" ".join(f"when rule = '{r.name}' then '{r.verdict}'" for r in RULES)} when bound > {LIMIT} then 'block' else 'allow' end as verdict,
       n as n_labelled, k as n_bad
from ruled join e using (host)
"""


@query("op12_host_reputation", ORACLE)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    counts = page_outcomes(pages, documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))
    return judge(pages.select("page_id", "url"), counts).select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad")
