"""URL filter: explicit host rules, then empirical-Bayes host reputation.

A rule of the longest fit decides. Where none fits, the host's rate of good pages does:
labelled outcomes are counted by host, registered domain and suffix, and each level's
rate is shrunk to the level above by a beta-binomial prior whose strength is fitted to
the data by moments. A host is blocked when the upper bound of its posterior rate stays
below ``least_rate``; a host nobody labelled inherits its domain's, suffix's or the
overall posterior.

For the reputation a host is taken without a user's name and a port, and an address is a domain of
its own. The suffix is the one that a table of rules gives (``co.uk``, ``*.ck``, ``!www.ck``; the
exception, else the longest rule), if there is one. Else it is the last label, or the last two where these are
a general name below a country's, a known platform, or a name that the data show to be one:
under it many labels have several hosts each.

Only DataFrame functions run here. Nulls and URLs without ``://`` have an empty host and
path; no rule fits an empty host, and it shares one reputation like any other host. Pages
without a label count in no rate. A table of outcomes without rows allows every page that
no rule blocks. Repeated rows are judged one by one; labels count once a page and label row.
Other columns of the tables are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import join_hot, settle

#: (host, path, verdict), as the contract fixes them.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: General names that countries register domains under, and platforms whose users have a name of two labels above theirs.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "mil", "ne", "net", "nom", "or", "org")
PLATFORMS = ("blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com")


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as ``struct(rule, verdict)``; null if none does."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def site_name(host: Column) -> Column:
    """The host without a user's name, a port and a last dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), r"\.$", "")


def _last(labels: Column, k: Column) -> Column:
    """The last ``k`` labels, or all."""
    n = F.least(k, F.size(labels))
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def suffix_rules(rules: DataFrame) -> DataFrame:
    """``(name, rank, take)`` of rules ``(rule)``: the labels that a host under ``name`` has as its suffix; exceptions rank first, then longer rules."""
    rule = F.lower(F.trim("rule"))
    name = F.regexp_replace(rule, r"^(!|\*\.)", "")
    out = rules.select(rule.alias("rule"), name.alias("name")).where(F.col("name") != "")
    labels = F.size(F.split("name", r"\."))
    take = F.when(F.col("rule").startswith("!"), labels - 1).when(F.col("rule").startswith("*."), labels + 1).otherwise(labels)
    return out.select("name", F.when(F.col("rule").startswith("!"), 1000).otherwise(take).alias("rank"), take.alias("take")).distinct()


def with_domains(sites: DataFrame, suffixes: DataFrame | None = None, least_labels: int = 16) -> DataFrame:
    """Adds ``domain`` and ``suffix`` to a table with a row a ``site``.

    ``suffixes(rule)`` is a table of public suffixes of any size; ``least_labels``: labels with two hosts or more each
    that make the two labels above them a suffix.
    """
    address = F.col("site").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | F.col("site").startswith("[")
    rows = sites.withColumn("_labels", F.split("site", r"\."))
    two = _last(F.col("_labels"), F.lit(2))
    rows = rows.withColumn("_two", two).withColumn("_take", F.when(address, 0).when(two.rlike(f"^({'|'.join(SECOND_LEVEL)})\\.[a-z]{{2}}$") | two.isin(*PLATFORMS), 2).otherwise(1))
    if suffixes is not None:
        tails = F.transform(F.sequence(F.lit(1), F.least(F.size("_labels"), F.lit(8))), lambda k: F.array_join(F.slice("_labels", F.size("_labels") - k + 1, k), "."))
        # a wildcard needs one label more than its name
        asked = rows.where(~address).select("site", F.size("_labels").alias("_n"), F.explode(tails).alias("name")).join(suffix_rules(suffixes), "name").where(F.col("take") <= F.col("_n"))
        told = asked.groupBy("site").agg(F.max(F.struct("rank", "take")).alias("_r")).select("site", "_r.take")
        rows = rows.join(told, "site", "left").withColumn("_take", F.coalesce("take", "_take")).drop("take")
    rows = settle(rows)
    parts = rows.where((F.col("_take") == 1) & (F.size("_labels") > 2)).groupBy("_two", _last(F.col("_labels"), F.lit(3)).alias("_three")).agg(F.count("*").alias("c"))
    learnt = settle(parts.groupBy("_two").agg(F.sum("c").alias("_hosts"), F.count_if(F.col("c") > 1).alias("_many")).where(F.col("_many") >= least_labels).select("_two", "_hosts", F.lit(2).alias("_learnt")))
    rows = join_hot(rows, learnt, "_two", "_hosts", rows.count(), how="left", least=100_000)
    rows = rows.withColumn("_take", F.when((F.col("_take") == 1) & (F.size("_labels") > 2), F.coalesce("_learnt", "_take")).otherwise(F.col("_take")))
    domain = F.when(F.col("_take") == 0, F.col("site")).otherwise(_last(F.col("_labels"), F.col("_take") + 1))
    suffix = F.when(F.col("_take") == 0, "").otherwise(_last(F.col("_labels"), F.col("_take")))
    return rows.withColumns({"domain": domain, "suffix": suffix}).select(*sites.columns, "domain", "suffix")


def _shrunk(counts: DataFrame, key: str, least: float, most: float, *others: str) -> DataFrame:
    """``(key, mean, weight)``: posterior means of ``counts(key, _good, _all, _prior)``, shrunk to the prior, with their strengths.

    Moments: with rates r_i from n_i outcomes around prior means m_i, the overdispersion is
    rho = (sum((n_i r_i - n_i m_i)^2 / (m_i (1 - m_i))) - sum n_i) / sum(n_i (n_i - 1)), and the
    prior's strength 1 / rho - 1, held between ``least`` and ``most``.
    """
    m = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("_prior")))
    excess = F.sum((F.col("_good") - F.col("_all") * m) * (F.col("_good") - F.col("_all") * m) / (m * (1 - m))) - F.sum("_all")
    rho = F.try_divide(excess, F.sum(F.col("_all") * (F.col("_all") - 1)))
    counts = settle(counts)
    fitted = counts.agg(F.when(rho.isNull() | (rho <= 0), F.lit(most)).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), 1 / rho - 1)))).first()[0]  # one number
    s = F.lit(most if fitted is None else float(fitted))
    return counts.select(key, *others, ((F.col("_good") + s * F.col("_prior")) / (F.col("_all") + s)).alias("mean"), (F.col("_all") + s).alias("weight"))


def host_reputation(sites: DataFrame, least_strength: float = 2.0, most_strength: float = 200.0, hot: int = 100_000) -> DataFrame:
    """Posterior per site from ``sites(site, domain, suffix, n_good, n_all, n_pages)``, a row a site: ``(site, n_pages, rate, weight)``.

    ``sites`` is read once a level, so it should be a written table. Each level is summed from the one below; suffixes and domains with more than ``hot`` rows
    below them are broadcast, so that none of them meets its rows in one task.
    """
    prior = sites.agg(F.coalesce(F.try_divide(F.sum("n_good"), F.sum("n_all")), F.lit(1.0))).first()[0]  # one number
    limits = (least_strength, most_strength)
    sums = lambda good, many: [F.sum(good).cast("double").alias("_good"), F.sum(many).cast("double").alias("_all"), F.count("*").alias("_below")]
    by_domain = settle(sites.groupBy("domain", "suffix").agg(*sums("n_good", "n_all")))
    by_suffix = by_domain.groupBy("suffix").agg(*sums("_good", "_all")).withColumn("_prior", F.lit(float(prior)))
    below = by_domain.agg(F.count("*"), F.sum("_below")).first()
    above = lambda level, key: settle(level.select(key, "_below", F.col("mean").alias("_prior")))
    suffixes = above(_shrunk(by_suffix, "suffix", *limits, "_below"), "suffix")
    domains = above(_shrunk(join_hot(by_domain.withColumnRenamed("_below", "_sites"), suffixes, "suffix", "_below", below[0], least=hot).withColumnRenamed("_sites", "_below"), "domain", *limits, "_below"), "domain")
    by_site = sites.select("site", "n_pages", "domain", F.col("n_good").cast("double").alias("_good"), F.col("n_all").cast("double").alias("_all"))
    return _shrunk(join_hot(by_site, domains, "domain", "_below", below[1] or 0, least=hot), "site", *limits, "n_pages").select("site", "n_pages", F.col("mean").alias("rate"), "weight")


def filter_urls(
    pages: DataFrame, outcomes: DataFrame, rules=RULES, least_rate: float = 0.5, z: float = 1.645, hot_pages: int = 100_000, id_col: str = "page_id", url_col: str = "url", good_col: str = "good",
    suffixes: DataFrame | None = None, least_labels: int = 16,
) -> DataFrame:
    """Verdict per page: ``(page_id, host, path, rule, verdict, rate, bound)``.

    ``outcomes(id_col, good_col)`` holds labelled pages, good 1 or bad 0; null labels count nowhere.
    ``bound`` is the upper end, ``z`` standard deviations above the mean, of the host's posterior rate.
    Hosts of more than ``hot_pages`` pages, and more than one page in 10,000, of which there are fewer
    than 10,000, are broadcast; pages of all others meet their host in a shuffle. ``suffixes`` and
    ``least_labels``: see :func:`with_domains`.
    """
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    marks = outcomes.select(F.col(id_col).cast("long").alias("page_id"), F.col(good_col).cast("long").alias("_g")).where("_g is not null and page_id is not null")
    marks = marks.groupBy("page_id").agg(F.sum("_g").alias("_g"), F.count("*").alias("_c"))
    zero = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    page = page.withColumn("site", site_name(F.col("host")))
    counted = page.select("page_id", "site").join(marks, "page_id", "left").groupBy("site").agg(zero("_g", "n_good"), zero("_c", "n_all"), F.count("*").alias("n_pages"))
    counted = settle(with_domains(counted, suffixes, least_labels))
    bound = F.col("rate") + z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    known = host_reputation(counted).select("site", "n_pages", F.round("rate", 9).alias("rate"), F.round(bound, 9).alias("bound"))
    judged = join_hot(page, known, "site", "n_pages", counted.agg(F.sum("n_pages")).first()[0] or 0, least=hot_pages)
    judged = judged.withColumn("_r", rule_column(F.col("host"), F.col("path"), rules))
    return judged.select(
        "page_id", "host", "path", F.col("_r.rule").alias("rule"),
        F.coalesce(F.col("_r.verdict"), F.when(F.col("bound") < least_rate, "block").otherwise("allow")).alias("verdict"), "rate", "bound",
    )
