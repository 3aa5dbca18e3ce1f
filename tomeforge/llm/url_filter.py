"""URL verdicts: rules first, then trust and distrust propagated over links between hosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeforge.llm.common import Workspace

#: (verdict, rule); a rule is a host and a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
#: Propagation ends when a round moves less than this share of all seeds' mass; a written table cuts the lineage every so many rounds.
TOLERANCE, WRITTEN = 0.005, 4
#: A host is blocked if its distrust exceeds its trust by more than this share of a full seed's own mass.
THRESHOLD = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    known = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.substring_index(url, "://", 1)
    after = F.when(known, url.substr(F.length(rest) + 4, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        cut = rule.index("/")
        own, start = rule[:cut], rule[cut:]
        fits.append((((host == own) | host.endswith("." + own)) & path.startswith(start), rule, verdict))
    pick = lambda k: reduce(lambda rest, f: F.when(f[0], F.lit(f[k])).otherwise(rest), reversed(fits), F.lit(None).cast("string"))
    return pick(1), pick(2)


def parent_domain(host: Column) -> Column:
    """The host without its first label, if two labels are left."""
    rest = host.substr(F.instr(host, ".") + 1, F.length(host))
    return F.when((F.instr(host, ".") > 1) & (F.instr(rest, ".") > 1), rest)


def host_edges(named: DataFrame) -> DataFrame:
    """(host, to, n): links from host to host, with a scheme or without (//host/...), and one edge each way between a host and the domain
    that it is a part of. Links within a host move nothing and are left out."""
    link = F.explode(F.regexp_extract_all(F.col("html"), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""), F.lit(1)))
    links = named.filter("host <> ''").select("host", link.alias("to")).withColumn("to", F.translate("to", _UPPER, _LOWER)).groupBy("host", "to").agg(F.count(F.lit(1)).alias("n"))
    hosts = links.select("host").unionByName(links.select(F.col("to").alias("host"))).unionByName(named.filter("host <> ''").select("host").distinct()).distinct()
    part = hosts.select("host", parent_domain(F.col("host")).alias("to")).filter("to is not null").withColumn("n", F.lit(1).cast("long"))
    every = links.unionByName(part).unionByName(part.select(F.col("to").alias("host"), F.col("host").alias("to"), "n"))
    return every.filter("host <> to").groupBy("host", "to").agg(F.sum("n").alias("n"))


def propagate(ws: Workspace, seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, host, mass): (1 - d) * seed + d * sum of what each neighbour passes on, until a round moves next to nothing. seeds: kind, host,
    seed; edges: kind, source, target, share. Mass that a host without edges would pass on ends there."""
    start = ws.save(seeds.select("kind", "host", ((1 - DAMPING) * F.col("seed")).alias("mass")).filter("mass > 0"), "start")
    total = start.agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0]
    moving, now, step, held = start, start, 0, start
    while total:
        step += 1
        # what moves on in this round is d times what moved in the last one: its sum is the change
        moving = edges.join(moving.select("kind", F.col("host").alias("source"), "mass"), ["kind", "source"]).groupBy("kind", F.col("target").alias("host")).agg(F.sum(DAMPING * F.col("mass") * F.col("share")).alias("mass"))
        if step % WRITTEN == 0:
            moving = ws.save(moving, f"moving-{step}")
        now = now.unionByName(moving)
        if step % WRITTEN == 0:
            held = ws.save(now.groupBy("kind", "host").agg(F.sum("mass").alias("mass")), f"mass-{step}")
            now = held
            if (moving.agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0]) <= TOLERANCE * total:
                break
    return held


def url_verdicts(pages: DataFrame, rules=RULES, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    The longest fitting rule decides. Other pages take their host's verdict: the share of a host's pages that
    rules allow or block is its seed; trust flows along links from host to host, distrust against them
    (who links to blocked hosts is distrusted), and a host is blocked if distrust - trust exceeds
    THRESHOLD * (1 - DAMPING), else allowed. Edges are the links to other hosts in the pages' href
    attributes, weighted by their number, and those between a host and the domain it is a part of.

    A null url or one without :// has an empty host and path, no rule and is allowed; a null page is without
    links; repeated rows are judged each for itself and count as links and pages; an empty table gives no rows.
    """
    spark = pages.sparkSession
    ws = Workspace(spark, "url_filter")
    host, path = host_and_path(F.col(url))
    named = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = ws.save(named.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")), "judged")
    seeds = judged.filter("host <> ''").groupBy("host").agg(F.avg(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("trusted"), F.avg(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("blocked"))
    seeds = ws.save(seeds, "seeds")
    links = ws.save(host_edges(named), "links")
    share = lambda kind, a, b: links.join(links.groupBy(a).agg(F.sum("n").alias("all")), a).select(F.lit(kind).alias("kind"), F.col(a).alias("source"), F.col(b).alias("target"), (F.col("n") / F.col("all")).alias("share"))
    edges = ws.save(share("trust", "host", "to").unionByName(share("distrust", "to", "host")), "edges")
    every = seeds.select(F.lit("trust").alias("kind"), "host", F.col("trusted").alias("seed")).unionByName(seeds.select(F.lit("distrust").alias("kind"), "host", F.col("blocked").alias("seed")))
    mass = propagate(ws, every, edges)
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass"))).alias(kind)
    known = ws.save(mass.groupBy("host").agg(of("trust"), of("distrust")), "known")
    out = judged.join(known, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    own = F.when(F.col("distrust") - F.col("trust") > THRESHOLD * (1 - DAMPING), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")
