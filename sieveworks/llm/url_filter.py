"""URL filters with DataFrame functions alone.

Rules (host and path prefix, longest wins) judge what they fit. For all other pages trust and distrust spread over the host graph:
trust is a personalised PageRank from the hosts that allow rules fit, along the edges; distrust starts at the hosts
that block rules fit and runs against them. Each seed starts with the share of its pages that such rules fit, 1 at most, so neither mass
shrinks when other hosts are added. A host is blocked when its distrust is above its trust, above `floor` times its trust, and at least
`least`, as a share of one seed.

Edges are links between different hosts (distinct pairs, summed in each task before the shuffle). With `parents`, a host and its parent domain name each other too, but for
domains that are public suffixes (`suffixes`, a list of its own or none); that is no link, and it is off unless asked for. The query asks for it, without suffixes. Masses spread by pushing residuals: a host keeps what it has got
until that is above `tolerance`, then keeps 1 - damping of it and sends the rest along its edges, so what a round sends follows what still moves, and rounds end where nothing does. A round is one
join and one sum with partial sums before the shuffle: each host also has a way to itself, by which it keeps what it does not send, so a round names the masses before it once and a plan grows by
one join a round. Lineage is cut by a table in the shared folder every `cut` rounds. Where the bytes of all ways were summed and are few, rounds are not dealt out: they need neither shuffle nor broadcast.
Mass that reaches a host without edges on its way goes back to the seeds, which is the same as scaling what is left to the seeds' sum. Masses are rounded to 12 digits, so the order of sums
decides nothing. Verdicts go to the pages by a broadcast where their bytes were summed and are few, and by a join that splits skewed keys otherwise.

Defined results: null url or no ://: empty host and path, no rule, and the method's verdict for an unknown host,
allow. Null html has no links. Without seeds all hosts are allowed; no pages give no rows. Rules of equal length: the first in the list wins;
equal trust and distrust: allow. Very long pages are searched for links as a whole. Repeated rows are judged each; output columns replace input
columns of the same names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import host_of, saved, without

#: Fixed value: absolute links, with or without scheme.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s<>]+)"""


#: Bytes of hosts and masses that may be broadcast.
MOST_BYTES = 64 << 20

#: Bytes of ways that are one partition's share, so that one task takes them; more are dealt out.
SHARE_BYTES = 8 << 20


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in reversed(ordered):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


#: Endings under which anyone may register, beside all one-label ones.
PUBLIC_SUFFIXES = ["ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "github.io", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk", "blogspot.com", "herokuapp.com", "wordpress.com"]


def host_edges(pages: DataFrame, url_col: str, html_col: str, hosts: DataFrame, parents: bool = False, suffixes: list[str] | None = None) -> DataFrame:
    """Distinct (src, dst) of different, non-empty hosts."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(LINK), F.lit(1))).alias("link"))
    edges = links.select("src", host_of(F.regexp_replace("link", r"^(?i:https?:)?//", "x://")).alias("dst"))
    if parents:
        parent = F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1)
        up = hosts.select(F.col("host").alias("src"), parent.alias("dst")).where(~F.col("dst").isin(PUBLIC_SUFFIXES if suffixes is None else suffixes))
        edges = edges.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.where("src != '' AND dst != '' AND src != dst").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = 1000, damping: float = 0.85, cut: int = 4, tolerance: float = 1e-6) -> DataFrame:
    """seeds: (host, kind, mass), kind trust or distrust. Gives (host, kind, mass) once no host holds more than `tolerance` that it has not passed on, or after so many rounds.

    The masses of a kind sum up to those of its seeds.
    """
    ways = edges.select(F.lit("trust").alias("kind"), "src", "dst").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst")))
    degree = ways.groupBy("kind", "src").agg(F.count("*").alias("degree"))
    ways = saved(ways.join(degree, ["kind", "src"]).select("kind", "src", "dst", "degree"), "host-edges")
    seeds = saved(seeds, "host-seeds")
    ends = ways.select("kind", F.explode(F.array("src", "dst")).alias("src")).unionByName(seeds.select("kind", F.col("host").alias("src"))).distinct()
    ways = ways.unionByName(saved(ends.select("kind", "src", F.col("src").alias("dst"), F.lit(None).cast("long").alias("degree")), "host-ends"))
    few = (ways.agg(F.sum(F.octet_length("src") + F.octet_length("dst") + 64).alias("bytes")).first()["bytes"] or 0) <= SHARE_BYTES
    dealt = lambda df: df.coalesce(1) if few else df  # noqa: E731  every host of a state is one of the ways' ends
    ways = ways.coalesce(1).hint("shuffle_hash") if few else ways
    state = dealt(seeds.select("kind", "host", F.lit(0.0).alias("mass"), F.col("mass").alias("held")))
    pushes, stays = F.col("held") > tolerance, F.col("degree").isNull()
    kept = F.col("mass") + F.when(pushes, F.col("held") * (1 - damping)).otherwise(0.0)
    held = F.when(~stays, F.col("held") / F.col("degree") * damping).when(pushes, 0.0).otherwise(F.col("held"))
    moved = ["kind", F.col("dst").alias("host"), F.when(stays, kept).otherwise(0.0).alias("mass"), held.alias("held")]
    totals, goes = [F.sum("mass").alias("mass"), F.sum("held").alias("held")], pushes | stays
    for i in range(rounds):
        state = dealt(state.withColumnRenamed("host", "src").join(ways, ["kind", "src"]).where(goes).select(*moved).groupBy("kind", "host").agg(*totals))
        if (i + 1) % cut == 0:
            state = dealt(saved(state, "host-mass"))
            if state.where(pushes).isEmpty():
                break
    sums = lambda df: {r["kind"]: r["sum"] for r in df.groupBy("kind").agg(F.sum("mass").alias("sum")).collect()}  # noqa: E731  two rows
    mass = saved(state.select("kind", "host", "mass"), "host-mass")
    had, left = sums(seeds), sums(mass)
    scale = F.lit(1.0)
    for kind, total in had.items():
        scale = F.when(F.col("kind") == kind, total / left[kind] if left.get(kind) else 1.0).otherwise(scale)
    return mass.withColumn("mass", F.round(F.col("mass") * scale, 12))


def judge(pages: DataFrame, rules: list[Rule] | None = None, url_col: str = "url", html_col: str = "html", parents: bool = False, suffixes: list[str] | None = None, rounds: int = 1000, damping: float = 0.85, floor: float = 2.0, least: float = 1e-3) -> DataFrame:
    """pages without html, with host, path, rule, verdict, trust and distrust (of the host; null if the graph did not reach it)."""
    rules = RULES if rules is None else rules
    kept = without(pages, "host", "path", "rule", "verdict", "trust", "distrust", "__fit")
    judged = kept.drop(html_col).withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}).withColumn("__fit", fitting_rule(F.col("host"), F.col("path"), rules))
    hosts = saved(judged.groupBy("host").agg(F.count_if(F.col("__fit.verdict") == "allow").alias("allowed"), F.count_if(F.col("__fit.verdict") == "block").alias("blocked"), F.count("*").alias("pages")).where("host != ''"), "hosts")
    seed = lambda kind, column: hosts.where(F.col(column) > 0).select("host", F.lit(kind).alias("kind"), (F.col(column) / F.col("pages")).alias("mass"))
    seeds = seed("trust", "allowed").unionByName(seed("distrust", "blocked"))
    mass = propagate(host_edges(kept, url_col, html_col, hosts, parents, suffixes), seeds, rounds, damping, tolerance=least / 1000)
    sums = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0)).alias(kind)
    reached = mass.groupBy("host").agg(sums("trust"), sums("distrust"))
    reached = saved(reached, "reached")
    few = (reached.agg(F.sum(F.octet_length("host") + 64).alias("bytes")).first()["bytes"] or 0) <= MOST_BYTES
    out = judged.join(F.broadcast(reached) if few else reached, "host", "left")
    blocked = (F.col("distrust") > F.col("trust")) & (F.col("distrust") > floor * F.col("trust")) & (F.col("distrust") >= least)
    own = F.when(F.coalesce(blocked, F.lit(False)), "block").otherwise("allow")
    columns = [c for c in judged.columns if c not in ("host", "path", "__fit")]
    return out.select(*columns, "host", "path", F.col("__fit.rule").alias("rule"), F.coalesce(F.col("__fit.verdict"), own).alias("verdict"), "trust", "distrust")
