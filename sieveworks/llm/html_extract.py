"""Main-text extraction by consensus paths.

Pass 1 scores each page's containers by the share of the page's unlinked text that they hold themselves, and names every container by its
generalised path: tags with their classes, digits left out, as a 64-bit digest chained from the root. Each page has 1000 votes,
which Spark sums by (host, path). A path of a host wins with at least 1 % of the host's votes and a tenth of those of its best
path (so a host has 100 winners at most); where two winners lie in one container below the body, that container wins as a whole. Pass 2 reads the
pages again and takes the text under the winning paths; a page of which they cover less than half adds its own winners.

Parts that never hold an article go by their tags. A part whose class, id or role names it a menu, advert, comment list and the like
goes too, unless it holds an article or main element, or (comments aside, on a page without such an element) more than half of the page's unlinked text.
Names that only say that such a part is there (has-sidebar, no-comments, share-enabled) count for nothing.

Votes are summed per task before the shuffle, so a host with a third of all pages sends a few rows a task. The winners
are broadcast only when they were counted and are few; else Spark joins by host and splits skewed ones.

Defined results: null or empty html, or a page without text: empty text. Null url: host is empty, and such pages vote
together. An empty table gives an empty result. Ties do no harm, as all paths at a threshold win. A tag or comment cut off at the end is
markup and goes. Very long or deep pages cost what their tags do: containers are numbered and know their parents, and no path is written out.
Repeated rows are extracted each; output columns replace input columns of the same names.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import host_of, saved, without

TAG = re.compile(r"""<!--(?:(?s:.*?)-->|(?s:.*))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))""")
CLASS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACE = re.compile(r"\s+")

#: What never holds article text, what ends a block, what can be a container, what has no end tag.
DROPPED = frozenset("nav header footer aside form script style noscript template iframe svg canvas object select button textarea title head menu dialog audio video".split())
RAW = frozenset("script style noscript template iframe svg textarea title".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - {"body", "html", "head"}
#: What names a part that is no article; words before such a name that only place it; words behind it, or before it, that only say whether it is there.
COMMENTS = r"comments?|comment(?:list|area|s?section|body)|disqus|respond|repl(?:y|ies)|discussion"
NAMES = r"ads?|advert\w*|adbox|banner|sponsor\w*|promo|cookie\w*|consent|notice|notification|alert|popup|modal|newsletter|subscribe|signup|login|sidebar|side|widgets?|related|recommend(?:ed|ations?)|share|sharing|social|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|header|masthead|toolbar|search|hidden|complementary|contentinfo"
PLACES = r"(?:(?:site|page|post|entry|article|block|global|left|right|top|bottom|primary|secondary|mobile|desktop|js|wp|user|reader|the)[-_]+)*"
STATES = r"(?:enabled|disabled|open|opened|closed|active|inactive|visible|layout|free|on|off|none|yes|no|true|false)"
JUNK = re.compile(rf"{PLACES}(?:(?P<comments>{COMMENTS})|{NAMES})(?:[-_]+(?!{STATES}$)\S*)?", re.I)
DIGITS = re.compile(r"\d+")
WINNERS_MAX, VOTES = 200_000, 1000


@lru_cache(1 << 16)
def chained(parent: int, name: str) -> int:
    """Digest of a path, from its parent's and its own name; a signed 64-bit number."""
    return int.from_bytes(blake2b(parent.to_bytes(8, "big", signed=True) + name.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


@lru_cache(1 << 14)
def junk_of(names: str) -> int:
    """2 for comments, 1 for other parts that are no article, 0 for the rest; names: the values of class, id and role."""
    found = [m for m in map(JUNK.fullmatch, names.split()) if m]
    return 0 if not found else 2 if any(m["comments"] for m in found) else 1


def chosen(scores: dict[int, int], parents: dict[int, int | None]) -> set[int]:
    """The winning paths of one page alone: at least a hundredth of all and a tenth of the best, lifted to common parents. parents: None for the body."""
    total, best = sum(scores.values()), max(scores.values(), default=0)
    won = {p for p, s in scores.items() if s and 100 * s >= total and 10 * s >= best}
    shared = Counter(parents[p] for p in won if parents[p] is not None)
    return won | {p for p, n in shared.items() if n > 1}


class Page:
    """The blocks of a page outside of dropped parts, and its containers: numbered, with their parents."""

    def __init__(self, source: str) -> None:
        # node 0 stands for the page; a node is a container or a part with a suspicious name
        self.parent, self.key, self.box, self.junk, self.main, self.in_body = [0], [0], [0], [0], [False], [True]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, unlinked characters
        stack: list[tuple[str, bool, int]] = [("", False, 0)]  # tag, dropped, node
        open_tags: Counter[str] = Counter()
        pieces: list[str] = []
        linked, in_link, at, end = 0, 0, 0, len(source)

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = "".join(pieces)
                pieces.clear()
                text = SPACE.sub(" ", html.unescape(text) if "&" in text else text).strip()
                if text:
                    self.blocks.append((stack[-1][2], text, max(0, len(text) - linked)))
            linked = 0

        def pop_to(i: int) -> None:
            nonlocal in_link
            for tag, _, _ in stack[i:]:
                in_link -= tag == "a"
                open_tags[tag] -= 1
            del stack[i:]

        def last(tags: tuple[str, ...], stops: Iterable[str]) -> int:
            """Place of the innermost open tag of `tags`, unless one of `stops` lies within it; else 0."""
            if not any(open_tags[t] > 0 for t in tags):
                return 0
            i = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] in tags or stack[i][0] in stops), 0)
            return i if stack[i][0] in tags else 0

        while at < end:
            m = TAG.search(source, at)
            stop = m.start() if m else end
            if stop > at and not stack[-1][1]:
                pieces.append(source[at:stop])
                linked += (stop - at) * (in_link > 0)
            if not m:
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                if tag in BLOCKS:
                    flush()
                if open_tags[tag] > 0:
                    pop_to(last((tag,), ()))
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                elif not stack[-1][1]:
                    pieces.append(" " if tag == "br" else "")
                continue
            if tag in BLOCKS:
                flush()
                if tag in CLOSES_P and (i := last(("p",), CONTAINERS)):
                    pop_to(i)
                if tag in ("li", "td", "th", "tr", "dd", "dt"):
                    same = ("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else (tag,)
                    if i := last(same, ("ul", "ol", "table", "dl", "div")):
                        pop_to(i)
            _, dropped, node = stack[-1]
            named = [(x[0].lower(), x[1] or x[2] or x[3]) for x in CLASS.findall(m[3])] if "=" in m[3] else []
            dropped = dropped or tag in DROPPED
            if tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else end
                continue
            if not dropped:
                junk = junk_of(" ".join(v for _, v in named)) if named and tag not in ("html", "body") else 0
                if tag in ("article", "main") and junk == 1:
                    junk = 0
                if junk or tag in CONTAINERS:
                    node = self._node(node, tag, named, junk)
            if not m[3].rstrip(">").endswith("/") or tag in BLOCKS:
                stack.append((tag, dropped, node))
                open_tags[tag] += 1
                in_link += tag == "a"
        flush()
        self._drop()

    def _node(self, parent: int, tag: str, named: list[tuple[str, str]], junk: int) -> int:
        n = len(self.parent)
        self.parent.append(parent)
        self.junk.append(junk)
        self.main.append(tag in ("article", "main") and not junk)
        self.in_body.append(tag == "body" or self.in_body[parent] and tag not in CONTAINERS)
        if tag in CONTAINERS:
            classes = ".".join(sorted({c for k, v in named if k == "class" for c in DIGITS.sub("", v).split()}))
            self.key.append(chained(self.key[parent], f"{tag}.{classes}" if classes else tag))
            self.box.append(n)
        else:
            self.key.append(self.key[parent])
            self.box.append(self.box[parent])
        return n

    def _drop(self) -> None:
        """Leaves out the blocks of parts that are no article."""
        if any(self.junk):
            size, main = [0] * len(self.parent), list(self.main)
            for node, _, worth in self.blocks:
                size[node] += worth
            for n in range(len(size) - 1, 0, -1):  # parents come before their children
                size[self.parent[n]] += size[n]
                main[self.parent[n]] |= main[n]
            gone = [False] * len(size)
            for n in range(1, len(size)):
                own = self.junk[n] and not main[n] and (self.junk[n] == 2 or main[0] or 2 * size[n] <= size[0])
                gone[n] = gone[self.parent[n]] or bool(own)
            self.blocks = [b for b in self.blocks if not gone[b[0]]]
        # what lies within an article or main element counts for the outermost one
        top = [0] * len(self.parent)
        for n in range(1, len(top)):
            top[n] = top[self.parent[n]] or (n if self.main[n] else 0)
        self.place = [top[node] or self.box[node] for node, _, _ in self.blocks]

    def scores(self) -> tuple[dict[int, int], dict[int, int | None]]:
        """(votes of each path, its parent's path or None where that is the body)."""
        held: dict[int, int] = defaultdict(int)
        parents: dict[int, int | None] = {}
        for place, (_, _, worth) in zip(self.place, self.blocks, strict=True):
            key, up = self.key[place], self.box[self.parent[place]]
            held[key] += worth
            parents[key] = None if place == 0 or self.in_body[place] or self.in_body[up] else self.key[up]
        total = sum(held.values())
        return {k: round(VOTES * v / total) for k, v in held.items()} if total else dict.fromkeys(held, 1), parents

    def under(self, winners: set[int]) -> list[bool]:
        """For each block whether it lies under a winning path; of the body only what no other container holds."""
        inside = [False] * len(self.parent)
        for n in range(1, len(inside)):
            inside[n] = inside[self.parent[n]] or (self.box[n] == n and not self.in_body[n] and self.key[n] in winners)
        return [inside[node] or self.in_body[place] and self.key[place] in winners for place, (node, _, _) in zip(self.place, self.blocks, strict=True)]

    def text(self, winners: Iterable[int] | None) -> str:
        """The host's winners and the page's own, so what only this page has beside the usual places is kept too."""
        taken = self.under(set(winners or ()) | chosen(*self.scores()))
        return "\n".join(text for use, (_, text, _) in zip(taken, self.blocks, strict=True) if use)


def votes(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, path, parent, score) over all pages, summed in each task already."""
    names = ["host", "path", "parent", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int, int | None], int] = defaultdict(int)

        def out() -> pa.RecordBatch:
            rows = list(total.items())
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.int64()), pa.array([k[2] for k, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.int64())], names)

        for batch in batches:
            for host, source in zip(batch.column(0), batch.column(1), strict=True):
                host = host.as_py()
                scores, parents = Page(source.as_py() or "").scores()
                for path, score in scores.items():
                    total[host, path, parents[path]] += score
            if len(total) > 50_000:
                yield out()
        if total:
            yield out()

    parts = pages.select(host_of(F.col(url_col)).alias("host"), html_col).mapInArrow(run, "host string, path long, parent long, score long")
    return parts.groupBy("host", "path", "parent").agg(F.sum("score").alias("score"))


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a host: its winning paths, 200 at most with those that two of them are lifted to."""
    voted = saved(votes(pages, url_col, html_col), "votes")
    of_host = voted.groupBy("host").agg(F.sum("score").alias("total"), F.max("score").alias("best"))
    won = voted.join(of_host, "host").where("score > 0 AND 100 * score >= total AND 10 * score >= best")
    lifted = won.where("parent IS NOT NULL").groupBy("host", "parent").agg(F.count_distinct("path").alias("n")).where("n > 1").select("host", F.col("parent").alias("path"))
    return won.select("host", "path").unionByName(lifted).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("paths"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages, without html, with text."""
    winners = saved(winning_paths(pages, url_col, html_col).select(F.col("host").alias("__host"), F.col("paths").alias("__paths")), "winners")
    few = (winners.agg(F.sum(F.size("__paths") + 1).alias("n")).first()["n"] or 0) <= WINNERS_MAX
    kept = without(pages, "text", "__host", "__paths").withColumn("__host", host_of(F.col(url_col)))
    joined = kept.join(F.broadcast(winners) if few else winners, "__host", "left").drop("__host")
    rest = [c for c in joined.columns if c not in (html_col, "__paths")]
    schema = T.StructType([*joined.select(*rest).schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources, paths = batch.column(len(rest)), batch.column(len(rest) + 1)
            texts = [Page(s.as_py() or "").text(p.as_py()) for s, p in zip(sources, paths, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], schema.names)

    return joined.select(*rest, html_col, "__paths").mapInArrow(run, schema)
