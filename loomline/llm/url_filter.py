"""URL filters with link-graph propagation (operator 9).

Rules decide the pages they fit.  For all other pages the host decides:
personalised PageRank spreads trust from trusted hosts along the links, and
distrust from blocked hosts against them, over host edges counted in Spark.
A host whose distrust reaches a threshold and exceeds its trust is blocked.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch


class Rule(NamedTuple):
    """A verdict for a host, its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str


#: Weight that follows the links; the rest returns to the seeds.
DAMPING = 0.75
ROUNDS = 12
#: Rounds between two tables that cut the lineage.
CUT = 4

_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def parse_rule(line: str) -> Rule:
    """``block example.com/en/`` as a rule; the path begins at the first slash."""
    verdict, _, rest = line.strip().partition(" ")
    host, slash, path = rest.strip().partition("/")
    return Rule(verdict, host, slash + path)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty for a null url or one without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty as for :func:`host_of`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits as struct(rule, verdict), null if none does; of equal rules a block wins."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path, r.verdict == "block")):
        fits = ((host == F.lit(rule.host)) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts: src, dst, weight (number of links); relative links have no other host."""
    links = pages.select("host", F.explode(F.regexp_extract_all(F.col("html"), F.lit(_LINK), 1)).alias("target"))
    found = links.select(F.col("host").alias("src"), ascii_lower(F.col("target")).alias("dst")).where("src <> dst and src <> ''")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def host_scores(hosts: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """Trust and distrust of hosts: host, trust, distrust.

    ``hosts`` has host, trusted and blocked (booleans); ``edges`` has src, dst
    and weight.  Each seed begins with 1 and gets 1 - damping back in every
    round, so scores are measured in seeds and don't shrink as seeds become
    more (shares of 1 would be these scores over the number of seeds).  Trust
    follows the links in proportion to their weight, distrust goes against
    them.  What a host without links would pass on is lost.
    """
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "weight").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    total = both.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    flows = scratch.stage(both.join(total, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("total")).alias("part")), "op9-edges")
    marks = hosts.select("host", F.explode(F.array(
        F.struct(F.lit("trust").alias("kind"), F.col("trusted").alias("on")), F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("on")))).alias("m"))
    seeds = scratch.stage(marks.where("m.on").select("m.kind", "host"), "op9-seeds")
    rank = seeds.withColumn("score", F.lit(1.0))
    restart = seeds.withColumn("score", F.lit(1.0 - damping))
    for k in range(rounds):
        moved = rank.join(flows, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("part") * F.lit(damping)).alias("score"))
        rank = moved.unionByName(restart).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if (k + 1) % CUT == 0:
            rank = scratch.stage(rank, "op9-rank")
    value = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return rank.groupBy("host").agg(value("trust"), value("distrust"))


def judge(pages: DataFrame, rules: Sequence[Rule], threshold: float = 0.001, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, trust, distrust.

    A host is a blocked seed if rules block more than half of its pages, and a
    trusted one if it isn't and a rule allows one.  Without a fitting rule a
    page is blocked if its host's distrust is at least ``threshold`` seeds and
    above its trust, else allowed; so the number of hosts does not decide.  A
    null url, or one without ``://``, has an empty host, no rule and the verdict
    allow; a null html has no links.  Other columns are ignored; no rows give
    no rows.
    """
    url = F.col(url_col)
    read = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col(html_col).alias("html"))
    read = read.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    ruled = lambda verdict: F.sum(F.when(F.col("best.verdict") == verdict, 1).otherwise(0))
    per_host = read.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("n"), ruled("block").alias("nb"), ruled("allow").alias("na"))
    blocked = F.col("nb") * 2 > F.col("n")
    hosts = per_host.select("host", blocked.alias("blocked"), ((F.col("na") > 0) & ~blocked).alias("trusted"))
    scores = host_scores(hosts, host_edges(read))
    scores = scores.select("host", *(F.round(c, 9).alias(c) for c in ("trust", "distrust")))
    zero = F.lit(0.0)
    trust, distrust = F.coalesce("trust", zero), F.coalesce("distrust", zero)
    by_host = F.when((distrust >= threshold) & (distrust > trust), F.lit("block")).otherwise(F.lit("allow"))
    out = read.drop("html").join(scores, "host", "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", by_host).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
