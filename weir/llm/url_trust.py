"""Operator 1, URL filters: trust and distrust propagated over the host graph, in native DataFrame code only.

1. Policy rules (host, path prefix, verdict) are matched against each url; the longest fitting rule decides.
2. Hosts whose pages the rules allow seed a personalised PageRank along links; hosts whose pages the rules
   block seed distrust, which flows against the links (who links to a blocked host is suspect). All trust seeds
   together have the mass 1, and so have all distrust seeds.
   Rounds go on until no host's mass changes by more than a small part of itself, so that every host that a seed
   reaches has its settled trust and distrust, however far it is.
3. A host is blocked where its distrust share passes a threshold; pages that no rule decides take that verdict.

Edges are of two kinds: links between hosts, and, where a caller gives them a weight, family edges between a host and
its parent domain. Links are counted to one row for each pair of hosts before any shuffle, so a host with a third of
all pages is one row for each host it links to. Ranks are one row a host. Nothing is broadcast by hand.

Cases: null url or one without '://' has empty host and path, fits no rule and gets the verdict of the
hostless pages (allow: no link reaches them); null html has no links; repeated pages give repeated rows;
an empty table gives an empty table; other columns of pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lower_ascii, materialize

Rule = tuple[str, str, str]  # verdict, host, path prefix
MAX_RULES = 1000
LINKS_A_TASK = 200_000


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) as the contract of the operator has them; both empty where there is no '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Rules are a policy of at most MAX_RULES rows."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"a policy has at most {MAX_RULES} rules")
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(longest_first):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, family: float = 0.0) -> DataFrame:
    """(src, dst, w): between two hosts, the pages of src with a link to dst; relative links stay inside and don't count.

    family: where it is over 0, a host and its parent domain (the name less its first label, where three labels stay)
    vouch for each other as well, with this part of the host's number of pages: www., m. and blog. hosts share an owner.
    """
    host, _ = split_url(F.col("url"))
    hrefs = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), F.lit(1))
    absolute = F.transform(hrefs, lambda h: F.when(h.startswith("//"), F.concat(F.lit("x:"), h)).otherwise(h))
    targets = F.array_distinct(F.transform(absolute, lambda h: lower_ascii(F.regexp_extract(h, r"://([^/?#]*)", 1))))
    per_page = pages.select(host.alias("src"), targets.alias("to")).filter(F.col("src") != "")
    links = per_page.select("src", F.explode("to").alias("dst")).filter((F.col("dst") != "") & (F.col("dst") != F.col("src")))
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))
    if not family:
        return links
    parent = F.regexp_extract("src", r"^[^.]+\.((?:[^.]+\.){2,}[^.]+)$", 1)
    kin = pages.select(host.alias("src")).groupBy("src").agg((family * F.count("*")).alias("w")).select("src", parent.alias("dst"), "w").filter(F.col("dst") != "")
    return links.unionByName(kin).unionByName(kin.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int | None = None, cut_every: int = 8, tolerance: float = 1e-3, most_rounds: int = 2000) -> DataFrame:
    """(host, trust, distrust) of personalised PageRank: settled, or after `rounds` rounds where they are given.

    Settled: in the last round no mass changed by more than `tolerance` of itself, and no host was newly reached (whose
    whole mass is change). So the summed change is under that part of all mass, and ratios at far hosts hold too. It is
    looked at where lineage is cut; an error is raised if it isn't so after `most_rounds`.

    seeds has (host, trust, distrust) masses. Trust follows links, distrust follows them backwards; both run
    in one loop as rows of a kind, so a round is one join and one aggregation over one row a host and kind.
    Lineage is cut with a table in the shared folder every `cut_every` rounds.
    """
    forth = links.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "w")
    back = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "w")
    both = forth.unionByName(back)
    total = both.groupBy("kind", "a").agg(F.sum("w").alias("total"))
    steps = materialize(both.join(total, ["kind", "a"]).select("kind", "a", "b", (F.col("w") / F.col("total")).alias("p")), "link-steps")
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "mass")).filter(F.col("mass") > 0)
    start = materialize(start, "link-seeds")
    # tasks go by the number of links, so that a small graph isn't a thousand tiny files a round
    tasks = max(1, -(-steps.count() // LINKS_A_TASK))
    ranks = start
    for i in range(1, (rounds or most_rounds) + 1):
        moved = ranks.withColumnRenamed("host", "a").join(steps, ["kind", "a"]).select(F.col("b").alias("host"), "kind", (damping * F.col("mass") * F.col("p")).alias("mass"))
        given = start.select("host", "kind", ((1 - damping) * F.col("mass")).alias("mass"))
        if i % cut_every and i != rounds:
            ranks = moved.unionByName(given).groupBy("host", "kind").agg(F.sum("mass").alias("mass")).coalesce(tasks)
            continue
        before = ranks.select("host", "kind", F.lit(0.0).alias("mass"), F.col("mass").alias("before"))
        now = moved.unionByName(given).withColumn("before", F.lit(0.0)).unionByName(before).groupBy("host", "kind").agg(F.sum("mass").alias("mass"), F.sum("before").alias("before")).coalesce(tasks)
        ranks = materialize(now, "link-ranks")
        moving = ranks.filter(F.abs(F.col("mass") - F.col("before")) > tolerance * F.col("mass"))
        ranks = ranks.select("host", "kind", "mass")
        if rounds is None and moving.isEmpty():
            break
    else:
        if rounds is None:
            raise RuntimeError(f"trust isn't settled after {most_rounds} rounds")
    return ranks.groupBy("host").agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("mass"))), F.lit(0.0)).alias(k) for k in ("trust", "distrust")))


def judge(pages: DataFrame, rules: list[Rule], threshold: float = 0.5, damping: float = 0.85, rounds: int | None = None, family: float = 0.0) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of pages(page_id, url, html).

    verdict: the rule's, else block where the host's distrust / (trust + distrust) is over `threshold`; a host that
    neither reaches is allowed. A host's seed masses are the shares of its pages that rules allow and block, over the
    sum of these shares of all hosts, so that trust and distrust are of one size.
    """
    host, path = split_url(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules))
    verdict = F.col("_fit.verdict")
    share = lambda v: F.avg(F.coalesce((verdict == v).cast("double"), F.lit(0.0)))
    seeds = judged.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")).filter((F.col("host") != "") & (F.col("trust") + F.col("distrust") > 0))
    seeds = materialize(seeds, "link-shares")
    sums = seeds.agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")).first()
    seeds = seeds.select("host", *((F.col(k) / (sums[k] or 1.0)).alias(k) for k in ("trust", "distrust")))
    scores = propagate(host_links(pages, family), seeds, damping, rounds)
    scored = judged.join(scores, "host", "left").withColumns({k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust")})
    method = F.when(F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.coalesce(verdict, method).alias("verdict"), "trust", "distrust")
