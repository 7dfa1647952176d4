"""URL filter: rules on hosts and paths, then trust carried over the link graph.

Method: hosts are the nodes; an edge holds how many links pages of one host have to another. Trust is a
personalised PageRank from the hosts that allowing rules name (and their subdomains), walked along links.
Distrust is a personalised PageRank from those that blocking rules name, walked against the links: who
links to a blocked host takes its share. Both run as rounds of joins and sums over the edges in Spark, until the
ranks change by less than TOLERANCE in all and no further host is reached. Rank that comes to a host without links onwards
returns to the seeds, so both ranks sum up to 1; that is the same as to leave it out of the rounds and to divide by the sum at the end. A host with more distrust than
THRESHOLD times its trust is blocked, so a host that neither reaches is allowed. A url that a rule fits takes
that rule's verdict.

Results for odd input: a null url or one without `://` has empty host and path, fits no rule and is allowed; null html has no
links; links with a scheme or that begin with `//` count, also behind white space; relative links and links to the own host make no edge; repeated pages count again as links; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

from pyspark.sql import Column, DataFrame, functions as F

from ._store import written

DAMPING, TOLERANCE, THRESHOLD = 0.85, 1e-9, 1.0
#: Rounds after which the change of a round is below TOLERANCE on any graph.
ROUNDS = ceil(log(TOLERANCE) / log(DAMPING))
#: Rounds between tests of convergence, each on a table of its own.
EVERY = 4
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""
#: Number of edges up to which the ranks of a round are sent to every task; they are at most two for each edge.
SMALL = 100_000


@dataclass(frozen=True)
class Rule:
    allow: bool
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}/{self.path}"


#: Fixed rules: block net/, allow example.net/en/, block example.com/de/, allow org/fr/.
RULES = (Rule(False, "net", ""), Rule(True, "example.net", "en/"), Rule(False, "example.com", "de/"), Rule(True, "org", "fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fits_host(host: Column, name: str) -> Column:
    return (host == name) | host.endswith("." + name)


def judged(host: Column, path: Column, rules=RULES) -> Column:
    """The rule that fits with the most characters: the longest host, then the longest path; null if none."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.host, r.path)):
        out = F.when(fits_host(host, r.host) & path.startswith("/" + r.path), F.lit(r.name)).otherwise(out)
    return out


def edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) from (host, html): links between different hosts, counted before they are dealt."""
    out = F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), out.alias("dst")).withColumn("dst", F.translate("dst", _UPPER, _LOWER))
    return links.where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))


def propagated(links: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING, small: bool = True) -> DataFrame:
    """(host, rank): personalised PageRank from seeds (host, weight), weights of sum 1, along links (src, dst, share); ranks of sum 1."""
    hint = F.broadcast if small else (lambda x: x)
    seeds = written(seeds, "seeds")
    ranks = seeds.select("host", F.col("weight").alias("rank"))
    start = seeds.select("host", (F.lit(1 - damping) * F.col("weight")).alias("rank"))
    while True:
        before = ranks
        for _ in range(EVERY):
            flow = links.join(hint(ranks.withColumnRenamed("host", "src")), "src").select(F.col("dst").alias("host"), (F.lit(damping) * F.col("rank") * F.col("share")).alias("rank"))
            ranks = flow.unionAll(start).groupBy("host").agg(F.sum("rank").alias("rank"))
        ranks = written(ranks, "ranks")
        both = ranks.select("host", "rank", F.lit(1).alias("n")).unionAll(before.select("host", -F.col("rank"), F.lit(-1)))
        both = both.groupBy("host").agg(F.abs(F.sum("rank")).alias("change"), F.sum("n").alias("n"))  # n is 1 for a host first reached
        change, reached = both.agg(F.coalesce(F.sum("change"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if change < tolerance and not reached:
            total = ranks.agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
            return ranks.select("host", (F.col("rank") / F.lit(total or 1.0)).alias("rank"))


def shares(links: DataFrame, source: str, target: str) -> DataFrame:
    out = links.groupBy(source).agg(F.sum("n").alias("total"))
    return links.join(out, source).select(F.col(source).alias("src"), F.col(target).alias("dst"), (F.col("n") / F.col("total")).alias("share"))


def url_filter(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_col: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every page."""
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.col("html").alias("html"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("id", host.alias("host"), path.alias("path"), "html")
    links = written(edges(rows), "links")
    count = links.count()
    hosts = rows.select("host").where("host <> ''").unionAll(links.select(F.col("dst").alias("host"))).distinct()
    hosts = written(hosts, "hosts")

    def seeds(allow: bool) -> DataFrame:
        """Hosts that rules of this kind name, of the rule with the longest host that fits."""
        kind = F.lit(None).cast("boolean")
        for r in sorted(rules, key=lambda r: (len(r.host), r.host, r.path)):
            kind = F.when(fits_host(F.col("host"), r.host), F.lit(r.allow)).otherwise(kind)
        mine = hosts.where(kind == F.lit(allow))
        n = max(1, mine.count())
        return mine.select("host", F.lit(1.0 / n).alias("weight"))

    small = count <= SMALL
    trust = propagated(written(shares(links, "src", "dst"), "shares"), seeds(True), small=small)
    distrust = propagated(written(shares(links, "dst", "src"), "shares"), seeds(False), small=small)
    ranks = hosts.join(trust.withColumnRenamed("rank", "trust"), "host", "left").join(distrust.withColumnRenamed("rank", "distrust"), "host", "left")
    ranks = written(ranks.select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")), "trust")
    judged_rows = rows.select("id", "host", "path", judged(F.col("host"), F.col("path"), rules).alias("rule"))
    if ranks.count() <= SMALL:
        ranks = F.broadcast(ranks)
    out = judged_rows.join(ranks, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    by_rule = F.lit(None).cast("string")
    for r in rules:
        by_rule = F.when(F.col("rule") == r.name, F.lit("allow" if r.allow else "block")).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.col("distrust") > F.lit(threshold) * F.col("trust"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
