"""URL filters: listed rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted for each host. A host's rate of bad
pages has a beta prior whose mean is its registered domain's rate, which in turn is
shrunk to its suffix's rate and that one to the rate of all labelled pages. The strength
of each level's prior comes from the spread of the counts beneath it (method of moments
for the beta-binomial). A page without a rule is blocked if the lower bound of its host's
posterior exceeds a threshold, so hosts without evidence against them are allowed.

Everything is DataFrame expressions. Hosts are counted with map-side partial sums, and
the reputation goes back to the pages by a join that deals a hot host over many parts.

Defined results: a null URL, or one without ``://``, has an empty host and path; no rule
fits it, and its verdict is the method's for the empty host; very long URLs are read whole; repeated rows give repeated
results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.frames import cut_lineage, join_spread

#: Verdict if the posterior's lower bound of the bad rate is above this.
THRESHOLD = 0.5
#: Standard deviations from the posterior's mean to its bound (one-sided 95 %).
DEVIATIONS = 1.645
#: Up to so many rules are compiled into one expression; longer lists are a table to join.
COMPILED_RULES = 200
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "co.kr", "co.za", "com.mx", "com.tr", "com.cn")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    return F.when(F.substring_index(host, ".", -2).isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; rules are (verdict, host followed by path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def with_rules(pages: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame) -> DataFrame:
    """``pages(host, path, ...)`` with ``rule`` and ``ruled``; rules are pairs or a table ``(verdict, rule)``.

    Many rules are joined: each distinct host and path is expanded to the suffixes of its host
    (whole labels) followed by the beginnings of its path that are as long as some rule's path
    for that suffix, and the longest that is a rule counts. A rule that is listed with several
    verdicts has the last one of a list, and blocks in a table.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= COMPILED_RULES:
            rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
            return pages.withColumns({"rule": rule, "ruled": ruled})
        rules = pages.sparkSession.createDataFrame([(verdict, text) for text, verdict in {text: verdict for verdict, text in rules}.items()], "verdict string, rule string")
    listed = rules.where("rule is not null").groupBy("rule").agg(F.max("verdict").alias("ruled"))
    size = F.length("rule")
    name = F.substring_index("rule", "/", 1)
    listed = cut_lineage(listed.select("rule", "ruled", name.alias("name"), (size - F.length(name)).alias("wide")))
    widths = listed.groupBy("name").agg(F.collect_set("wide").alias("widths"))  # at most as many as a rule is long
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    tried = join_spread(urls.select("host", "path", F.explode(suffixes).alias("name")), widths, ["name"], how="inner")
    tried = tried.select("host", "path", F.explode(F.filter("widths", lambda w: w <= F.length("path"))).alias("wide"), "name")
    keyed = tried.select("host", "path", F.concat("name", F.substring(F.col("path"), F.lit(1), F.col("wide"))).alias("rule"))
    fits = join_spread(keyed, listed.select("rule", "ruled"), ["rule"], how="inner")
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "ruled"), F.struct(F.length("rule"), F.col("rule"))).alias("best"))
    return join_spread(pages, best, ["host", "path"]).select(*pages.columns, "best.rule", "best.ruled")


def _strength(children: DataFrame) -> float:
    """Prior strength from children (n, k, mean of the parent), by moments; one row of sums."""
    spread = F.col("mean") * (1 - F.col("mean"))
    row = children.agg(
        F.sum((F.col("k") - F.col("n") * F.col("mean")) * (F.col("k") - F.col("n") * F.col("mean"))).alias("a"),
        F.sum(F.col("n") * spread).alias("b"),
        F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("c"),
    ).first()
    rho = (row["a"] - row["b"]) / row["c"] if row["c"] else 0.0
    rho = min(0.99, max(0.001, rho))
    return 1 / rho - 1


def reputation(outcomes: DataFrame) -> DataFrame:
    """``(host, n, k, alpha, beta, mean, lower)`` for each host of ``outcomes(host, bad boolean, null if unlabelled)``."""
    counted = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k"))
    hosts = cut_lineage(counted.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k"))
    sums = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = cut_lineage(hosts.groupBy("domain", "suffix").agg(*sums))
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(*sums).first()
    mean = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)

    def level(children: DataFrame, parents: DataFrame | None, key: str | None) -> tuple[DataFrame, float]:
        held = children.withColumn("mean", F.lit(mean)) if parents is None else join_spread(children, parents.select(key, F.col("rate").alias("mean")), [key], how="inner")
        strength = _strength(held)
        return held.withColumn("rate", (F.col("k") + strength * F.col("mean")) / (F.col("n") + strength)), strength

    suffix_rates, _ = level(suffixes, None, None)
    domain_rates, _ = level(domains, suffix_rates, "suffix")
    host_rates, s = level(hosts, domain_rates, "domain")
    alpha, beta = F.col("k") + s * F.col("mean"), F.col("n") - F.col("k") + s * (1 - F.col("mean"))
    rated = host_rates.select("host", "n", "k", alpha.alias("alpha"), beta.alias("beta"), F.col("rate").alias("mean"))
    whole = F.col("alpha") + F.col("beta")
    return rated.withColumn("lower", F.col("mean") - DEVIATIONS * F.sqrt(F.col("alpha") * F.col("beta") / (whole * whole * (whole + 1))))


def judge(df: DataFrame, rules: Sequence[tuple[str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", bad: Column | None = None) -> DataFrame:
    """``(id, host, path, rule, verdict, bad_rate)`` for each row.

    ``bad`` labels pages for the reputation (null: unlabelled); by default pages that a
    rule decides are the labelled ones.
    """
    url = F.col(url_col)
    parsed = df.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), *([] if bad is None else [bad.alias("bad")]))
    pages = with_rules(parsed, rules)
    labelled = pages.select("host", (F.col("ruled") == "block").alias("bad") if bad is None else F.col("bad"))
    known = reputation(labelled).select("host", F.col("mean").alias("bad_rate"), "lower")
    judged = join_spread(pages, known, ["host"])
    verdict = F.coalesce("ruled", F.when(F.col("lower") > THRESHOLD, F.lit("block")).otherwise(F.lit("allow")))
    return judged.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "bad_rate")
