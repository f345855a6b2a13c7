"""URL filters: rules on hosts and paths, and link-graph propagation for what no rule fits.

Host edges come from the links of the pages, relative ones resolved against
their page, so a host's links to itself keep its score with it.  Trust is
personalised PageRank from hosts with allowed pages; distrust is the same walk
over reversed edges from hosts with blocked pages; a seed's mass is the share
of its pages that a rule allows (blocks).  Both thin out as they are split
among many hosts, so a host's distrust less its trust is taken in relation to
the greater of the two that the same seeds would give with full mass.  Above
``margin`` the host is blocked, however many others link to the same blocked
host.  A host that only blocked seeds reach is blocked even if few of its links
lead there; one that both kinds reach is judged by their difference.

Defined results: a null url or one without '://' has an empty host and path,
fits no rule and is allowed; null html has no links; a link without a host of
its own (mailto:, javascript:, #part) is none; of rules of the same length that
fit, the first as listed counts; a url or page of any length is one row's
value; repeated rows each give their row; an empty table gives an empty table.
Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._common import LOWER, UPPER, cut, drop

DAMPING = 0.85
#: a walk ends when no host's score moves by more
TOLERANCE = 1e-4
#: rounds between two writes of the scores
STRIDE = 4


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(F.when(F.instr(url, "://") > 0, host), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_lists(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """host, fits: the rules of each host and of those it is a subdomain of, longest first.

    A host meets the rules by its endings of as many labels as some rule has,
    in a join, so a list of rules may be long.
    """
    spark = hosts.sparkSession
    rows = [(i, text, says, *text.partition("/")[::2]) for i, (text, says) in enumerate(rules)]
    known = spark.createDataFrame([(i, text, says, of, "/" + path if "/" in text else "") for i, text, says, of, path in rows], "place int, rule string, says string, of string, start string")
    sizes = sorted({len(of.split(".")) for _, _, _, of, _ in rows})
    labels = F.split("host", r"\.")
    endings = F.array(*[F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in sizes]).cast("array<string>")
    met = hosts.select("host", F.explode(F.filter(endings, lambda e: e.isNotNull())).alias("of")).join(known, "of")
    fits = F.array_sort(F.collect_list(F.struct((-F.length("rule")).alias("size"), "place", "rule", "says", "start")))
    return met.groupBy("host").agg(fits.alias("fits"))


def edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, n: links between hosts and within one, counted before they are shuffled."""
    found = F.expr(f"""regexp_extract_all({html}, '(?i)\\\\bhref\\\\s*=\\\\s*(?:"\\\\s*([^"]*)|\\'\\\\s*([^\\']*)|([^"\\'\\\\s>]+))', 0)""")
    target = lambda href: F.regexp_replace(href, r"""(?is)^href\s*=\s*["']?\s*""", "")

    def host(link: Column) -> Column:
        """The host a link leads to: its own, the page's if it is relative, else none."""
        own = F.when(link.startswith("//"), host_of(F.concat(F.lit("x:"), link))).when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(link))
        return own.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | link.startswith("#") | (link == ""), F.lit("")).otherwise(F.col("src"))

    links = pages.select(host_of(F.col(url)).alias("src"), F.explode(found).alias("link")).where("src <> ''").select("src", target(F.col("link")).alias("link"))
    return links.select("src", host(F.col("link")).alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def walk(graph: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """way, host, mass, full: personalised PageRank with restarts at ``seeds`` (way, host, mass, full), for each way on its own.

    ``graph`` is (way, src, dst, n).  Each round joins scores with edges on the
    source (AQE splits a hub's edges) and sums before shuffling to the target;
    what a host keeps by links to itself is solved for instead of iterated.
    Mass of hosts without links returns to nobody.  Scores are in units of the
    restart, so a seed that nothing links to keeps its own mass.  ``full`` is a
    second mass that goes the same ways; rounds go on until it moves by less
    than ``tolerance`` at every host.
    """
    key, masses = ["way", "host"], ("mass", "full")
    total = graph.groupBy("way", "src").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)).alias("own"))
    keeps = cut(total.where("own > 0").select("way", F.col("src").alias("host"), (1 / (1 - damping * F.col("own") / F.col("total"))).alias("gain")))
    shares = cut(graph.where("src <> dst").join(total, ["way", "src"]).select("way", F.col("src").alias("host"), "dst", (damping * F.col("n") / F.col("total")).alias("share")))

    def settle(gathered: DataFrame) -> DataFrame:
        gain = F.coalesce("gain", F.lit(1.0))
        return gathered.join(keeps, key, "left").select(*key, *[(F.col(m) * gain).alias(m) for m in masses])

    def step(score: DataFrame) -> DataFrame:
        moved = score.join(shares, key).select("way", F.col("dst").alias("host"), *[(F.col(m) * F.col("share")).alias(m) for m in masses])
        return settle(moved.unionByName(seeds).groupBy(*key).agg(*[F.sum(m).alias(m) for m in masses]))

    score = cut(settle(seeds))
    while True:
        before = score
        for _ in range(STRIDE - 1):
            before = step(before)
        # hosts only ever gain, so what a host had one round earlier is there or nothing
        last = before.select(*key, F.lit(0.0).alias("mass"), F.lit(0.0).alias("full"), F.col("full").alias("was"))
        after = step(before).withColumn("was", F.lit(0.0)).unionByName(last)
        after = cut(after.groupBy(*key).agg(*[F.sum(m).alias(m) for m in (*masses, "was")]))
        drop(score)
        score = after.drop("was")
        if (after.agg(F.max(F.abs(F.col("full") - F.col("was")))).first()[0] or 0.0) <= tolerance:
            drop(keeps, shares)
            return score


def judge(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url", html: str = "html", margin: float = 0.5) -> DataFrame:
    """key, host, path, rule, verdict, trust, distrust for every page."""
    split = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    lists = rule_lists(split.select("host").distinct(), rules)
    first = F.get(F.filter("fits", lambda r: F.startswith(F.col("path"), r["start"])), 0)
    judged = cut(split.join(lists, "host", "left").select(key, "host", "path", first["rule"].alias("rule"), first["says"].alias("says")))
    hosts = cut(judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("says") == "allow").alias("allowed"), F.count_if(F.col("says") == "block").alias("blocked"), F.count("*").alias("pages")))
    found = cut(edges(pages, url, html))
    ways = (("trust", "allowed", "src", "dst"), ("distrust", "blocked", "dst", "src"))
    graph = [found.select(F.lit(way).alias("way"), F.col(a).alias("src"), F.col(b).alias("dst"), "n") for way, _, a, b in ways]
    seeds = [hosts.where(f"{n} > 0").select(F.lit(way).alias("way"), "host", (F.col(n) / F.col("pages")).alias("mass"), F.lit(1.0).alias("full")) for way, n, _, _ in ways]
    score = walk(graph[0].unionByName(graph[1]), seeds[0].unionByName(seeds[1]))
    drop(found, hosts)
    of = lambda way, m: F.coalesce(F.max(F.when(F.col("way") == way, F.col(m))), F.lit(0.0)).alias(f"{way}_{m}")
    scores = score.groupBy("host").agg(*[of(way, m) for way, *_ in ways for m in ("mass", "full")])
    method = F.when(F.col("distrust_mass") - F.col("trust_mass") > margin * F.greatest("trust_full", "distrust_full"), "block").otherwise("allow")
    mass = lambda way: F.coalesce(f"{way}_mass", F.lit(0.0)).alias(way)
    return judged.join(scores, "host", "left").select(key, "host", "path", "rule", F.coalesce("says", method).alias("verdict"), mass("trust"), mass("distrust"))
