"""URL filter: path rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes are counted per host, per registered domain (one label more
than its suffix) and per suffix (the longest of a list of suffixes, a parameter, that ends the host,
else the last label).  A port is no part of either; an IP address is a domain of its own, and all of them share a suffix.  Each level is a
beta-binomial: a suffix shrinks towards the rate of all pages, a domain towards
its suffix, a host towards its domain.  How strongly comes from the data: the
prior's weight at a level is the method-of-moments estimate from the spread of
the rates at that level.  A host is blocked when the lower bound of its
posterior bad rate is above ``max_bad``.

Everything is DataFrame functions.  Counting combines before the shuffle, so a
host with a third of all pages is one partial row per task; the host table goes
back to the pages by an ordinary join, which AQE splits where a host is hot.

Defined results: a null url, or one without ``://``, has an empty host and path
and shares the reputation of the empty host; a host with no labelled page takes
its domain's posterior; repeated rows give repeated rows; a page labelled
more than once is bad if any of its labels says so; empty tables give no rows.
Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from renewcast.llm.common import written

#: (action, host, path prefix)
Rule = tuple[str, str, str]

LEAST_SPREAD, MOST_SPREAD = 0.002, 0.5   # bounds of the intra-class correlation a level may have
Z = 1.645                                # one-sided 95 % bound
MAX_BAD = 0.5
#: Suffixes of several labels under which anyone may register; a complete list belongs into the parameter.
SUFFIXES = (
    "ac.uk", "blogspot.com", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr",
    "edu.au", "github.io", "gitlab.io", "gov.uk", "herokuapp.com", "ne.jp", "net.au", "netlify.app", "or.jp", "org.au", "org.uk", "pages.dev",
    "vercel.app", "web.app", "wordpress.com",
)
IP_SUFFIX = "ip"
PORT, IPV4 = r":[0-9]*$", r"^([0-9]{1,3}\.){3}[0-9]{1,3}$"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path from there up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule text, action) of the longest rule that fits, else nulls.  ``rules`` is a
    configured list (some hundreds at most): it becomes one CASE, longest rule first."""
    name = action = None
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        action = F.when(fits, act) if action is None else action.when(fits, act)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, action)


def levels(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a host that is a suffix itself is its own domain."""
    name = F.regexp_replace(host, PORT, "")
    address = F.rlike(name, F.lit(IPV4)) | F.startswith(name, F.lit("["))
    domain, suffix = F.when(address, name), F.when(address, F.lit(IP_SUFFIX))
    by: dict[int, list[str]] = {}
    for x in suffixes:
        by.setdefault(x.count(".") + 1, []).append(x)
    for n in sorted(by, reverse=True):
        ends = F.substring_index(name, ".", -n)
        domain = domain.when(ends.isin(by[n]), F.substring_index(name, ".", -n - 1))
        suffix = suffix.when(ends.isin(by[n]), ends)
    return domain.otherwise(F.substring_index(name, ".", -2)), suffix.otherwise(F.substring_index(name, ".", -1))


def _weight(counts: DataFrame) -> float:
    """Prior weight at one level: (1 - r) / r for the moment estimate r of the intra-class correlation of
    the groups' bad rates.  One row of sums comes to the driver."""
    n, b = F.col("n").cast("double"), F.col("b").cast("double")
    s = counts.where("n > 0").agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(b).alias("b"),
                                  F.sum(n * n).alias("nn"), F.sum(b * b / n).alias("bb")).first()
    r = 0.0
    if s["k"] and s["k"] > 1:
        m = s["b"] / s["n"]
        within = m * (1 - m)
        room = within * (s["n"] - s["nn"] / s["n"] - (s["k"] - 1))
        r = (s["bb"] - m * s["b"] - (s["k"] - 1) * within) / room if room > 0 else 0.0
    r = min(MOST_SPREAD, max(LEAST_SPREAD, r))
    return round((1 - r) / r, 6)


def host_reputation(pages: DataFrame, outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """host, n, b, alpha, beta: labelled pages, bad ones, and the posterior of the host's bad rate.

    ``pages`` has host and page key ``ref``; ``outcomes`` has ``ref`` and ``bad`` (0/1), one row a ref.
    """
    seen = pages.join(outcomes, "ref", "left")
    hosts = written(seen.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("b")),
                    "host_counts")
    domain, suffix = levels(F.col("host"), suffixes)
    hosts = hosts.withColumns({"domain": domain, "suffix": suffix})
    sums = [F.sum("n").alias("n"), F.sum("b").alias("b")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = hosts.groupBy("suffix").agg(*sums)
    total = hosts.agg(*sums).first()
    root = ((total["b"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    w_suffix, w_domain, w_host = _weight(suffixes), _weight(domains), _weight(hosts)

    top = suffixes.select("suffix", ((F.lit(w_suffix * root) + F.col("b")) / (F.lit(w_suffix) + F.col("n"))).alias("m_suffix"))
    mid = domains.join(top, "suffix").select(
        "domain", ((F.lit(w_domain) * F.col("m_suffix") + F.col("b")) / (F.lit(w_domain) + F.col("n"))).alias("m_domain"))
    return hosts.join(mid, "domain").select(
        "host", "n", "b", (F.lit(w_host) * F.col("m_domain") + F.col("b")).alias("alpha"),
        (F.lit(w_host) * (1 - F.col("m_domain")) + F.col("n") - F.col("b")).alias("beta"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule] = (), id_col: str = "page_id",
               url_col: str = "url", ref: Column | None = None, max_bad: float = MAX_BAD, z: float = Z,
               suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, bad_rate and its lower_bound.

    ``outcomes``: (ref, bad).  ``ref``: the expression over a page that names its outcome, by default
    the id.  The verdict is the rule's action, else ``block`` if the host's lower bound is above
    ``max_bad``, else ``allow``.
    """
    host, path = split_url(F.col(url_col))
    p = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"),
                     (F.col(id_col) if ref is None else ref).cast("long").alias("ref"))
    one = outcomes.groupBy("ref").agg(F.max("bad").alias("bad"))
    posterior = host_reputation(p.select("host", "ref"), one, suffixes)
    a, b = F.col("alpha"), F.col("beta")
    rate = a / (a + b)
    posterior = posterior.select("host", rate.alias("bad_rate"),
                                 (rate - F.lit(z) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("lower_bound"))
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    return p.join(posterior, "host").select(
        F.col("id").alias(id_col), "host", "path", name.alias("rule"),
        F.coalesce(action, F.when(F.col("lower_bound") > max_bad, "block").otherwise("allow")).alias("verdict"),
        F.round("bad_rate", 6).alias("bad_rate"), F.round("lower_bound", 6).alias("lower_bound"))
