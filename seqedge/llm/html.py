"""HTML extraction (operator 5): consensus host paths.

Every page is read into blocks of text and containers. Containers are scored by their text. From the best one the page
climbs while what a parent adds is text and not links, and votes for the generalised tag-class path of the container it
reaches, so that an article of several parts is one; Spark counts the votes per host. The page's text is what all containers
on the winning path hold (the page's own choice where it has none), without menus, forms, adverts and the like.
"""

from __future__ import annotations

import hashlib
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqedge.llm.common import cut, or_empty, quoted, table
from seqedge.llm.urls import host_path

# Element names by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = set("body main article section div td table center blockquote".split())
NOISE = set("head nav header footer aside form button select textarea iframe object dialog menu noscript template svg canvas audio video".split())
BLOCKS = set("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - {"br", "body", "html", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary"}
SAME_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
NOISE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|menu\w*|nav\w*|sidebar\w*|footer|header|masthead|"
    r"breadcrumbs?|comments?|commentlist|discussion|disqus|replies|respond|share\w*|sharing|social\w*|related|recommend\w*|newsletter|subscribe|"
    r"popup|modal|pagination|pager|widgets?|toolbar|login|signup|hidden)(?:$|[\s_-])", re.I)
GOOD_WORDS = re.compile(r"article|content|post|entry|story|main|body|text", re.I)
WEIGHT = {"article": 3.0, "main": 2.0, "body": 0.5}
#: A container's share of its children's scores.
RISE = 0.5
#: Most linked characters, of all, in what a parent adds to an article, and in a container that is part of one.
LINKED = 1 / 3
#: Characters of a path that are kept as they are; of a longer one a digest goes on.
PATH = 400

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|noscript|template|svg|iframe|textarea)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:/>|>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Page:
    """blocks: texts in page order. sizes: their characters, and those in links. containers: (path, first block, end, score,
    parent, element, its marks)."""

    def __init__(self, source: str):
        self.blocks: list[str] = []
        self.sizes: list[tuple[int, int]] = []
        self.containers: list[list] = []
        self._words: list[str] = []
        self._linked, self._links = 0, 0
        self._stack: list[tuple[str, bool, int]] = [("", False, -1)]  # element, inside noise, its container
        at = 0
        for m in TOKEN.finditer(source):
            self._text(source[at : m.start()])
            at = m.end()
            name = m[3] or m[6]
            if name and not (m[2] or m[5]):
                self._open(name.lower(), m[4] or m[7] or "")
            elif name:
                self._close(name.lower())
        self._text(source[at:])
        self._flush()
        while len(self._stack) > 1:
            self._pop()
        self._score()

    def _text(self, raw: str) -> None:
        if raw and not self._stack[-1][1]:
            self._words.append(raw)
            if self._links:
                self._linked += len(raw)

    def _flush(self) -> None:
        if self._words:
            text = " ".join(html.unescape("".join(self._words)).split())
            if text:
                self.blocks.append(text)
                self.sizes.append((len(text), min(self._linked, len(text))))
                if (c := self._stack[-1][2]) >= 0:
                    self.containers[c][3] += max(0, len(text) - 2 * self._linked) + 20
            self._words, self._linked = [], 0

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCKS:
            self._flush()
            for ended in (SAME_ENDS.get(name, set()), {"p"} if name in ENDS_P else set()):
                for i in range(len(self._stack) - 1, 0, -1):
                    if self._stack[i][0] in ended:
                        while len(self._stack) > i:
                            self._pop()
                        break
                    if self._stack[i][0] in CONTAINERS or self._stack[i][0] in ("ul", "ol", "dl", "tr") and name != "tr":
                        break
        if name in VOID or attributes.endswith("/") and name not in CONTAINERS:
            return
        marks = {k.lower(): a or b or c for k, a, b, c in NAMES.findall(attributes)} if attributes else {}
        noisy, inside = self._stack[-1][1], self._stack[-1][2]
        words = " ".join(marks.values())
        noisy = noisy or name in NOISE or bool(words and name not in ("html", "body", "main") and NOISE_WORDS.search(words))
        if name in CONTAINERS and not noisy:
            label = ".".join([name, *sorted(re.sub(r"\d+", "#", (marks.get("class") or "").lower()).split())[:3]])
            above = self.containers[inside][0] if inside >= 0 else ""
            above = above if len(above) < PATH else hashlib.md5(above.encode()).hexdigest()
            self.containers.append([f"{above}>{label}" if above else label, len(self.blocks), None, 0.0, inside, name, words])
            inside = len(self.containers) - 1
        self._links += name == "a"
        self._stack.append((name, noisy, inside))

    def _close(self, name: str) -> None:
        if name in BLOCKS:
            self._flush()
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == name:
                while len(self._stack) > i:
                    self._pop()
                return
            if self._stack[i][0] in CONTAINERS and name not in BLOCKS:
                return

    def _pop(self) -> None:
        name, noisy, inside = self._stack[-1]
        if name in CONTAINERS or noisy and not self._stack[-2][1]:
            self._flush()
        if name in CONTAINERS and not noisy and self.containers[inside][2] is None:
            self.containers[inside][2] = len(self.blocks)
        self._links -= name == "a"
        self._stack.pop()

    def _score(self) -> None:
        for c in reversed(self.containers):
            if c[4] >= 0:
                self.containers[c[4]][3] += RISE * c[3]
        for c in self.containers:
            c[3] *= WEIGHT.get(c[5], 1.0) * (1.5 if c[5] not in WEIGHT and GOOD_WORDS.search(c[6]) else 1.0)

    def best(self, path: str | None = None) -> list | None:
        """The container with the highest score (on ``path``, if any is); the first of equals."""
        there = [c for c in self.containers if c[0] == path] or self.containers
        return max(there, key=lambda c: c[3], default=None)

    def linked(self, b: int, e: int) -> tuple[int, int]:
        """Characters, and those in links, of a stretch of blocks."""
        return sum(n for n, _ in self.sizes[b:e]), sum(k for _, k in self.sizes[b:e])

    def article(self) -> list | None:
        """The best container, or the last one on the way up to the body whose parts beside it are text, not links."""
        c = found = self.best()
        while c and c[4] >= 0 and self.containers[c[4]][5] != "body":
            up = self.containers[c[4]]
            (n, k), (m, j) = self.linked(up[1], c[1]), self.linked(c[2], up[2])
            if k + j > LINKED * (n + m):
                break
            found, c = (up if n + m else found), up
        return found

    def text(self, path: str | None) -> str:
        there = [c for c in self.containers if c[0] == path]
        if len(there) > 1:  # parts of one article; lists of links on the same path are none
            best = self.best(path)
            there = [c for c in there if c is best or (x := self.linked(c[1], c[2]))[1] <= LINKED * x[0]]
        there = there or [c for c in [self.article()] if c]
        return " ".join(" ".join(self.blocks[c[1] : c[2]]) for c in there if c[2] > c[1]) if there else " ".join(self.blocks)


def winning_paths(pages: DataFrame, url: str = "url", markup: str = "html") -> DataFrame:
    """(host, path): the path that most pages of a host vote for; ties go to the higher sum of scores, then the path."""

    def vote(batches):
        for batch in batches:
            best = [Page(x.as_py() or "").article() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b and b[0] for b in best], pa.string()),
                                              pa.array([b and float(b[3]) for b in best], pa.float64())], names=["host", "path", "score"])

    votes = pages.select(host_path(quoted(url))[0].alias("host"), quoted(markup).alias("markup")).mapInArrow(vote, "host string, path string, score double")
    counted = votes.filter("path is not null and score > 0").groupBy("host", "path").agg(F.count("*").alias("votes"), F.round(F.sum("score")).alias("score"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("votes", "score", "path")).alias("path"))


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """(key, url, text, n_chars) per input row. A null url is the empty host; null or empty html gives an empty text;
    repeated rows and equal or null keys are extracted one by one; an empty table gives no rows; other columns play no part.

    Winners are one small row a host. They are cut, so Spark joins by their measured size: beside the pages as they are
    read while small, by a shuffle that AQE can split beyond that.
    """
    winners = cut(winning_paths(pages, url, markup), "host-paths")
    rows = pages.select(quoted(key).alias("key"), quoted(url).alias("url"), host_path(quoted(url))[0].alias("host"), quoted(markup).alias("markup"))
    rows = rows.join(winners, "host", "left").select("key", "url", "markup", "path")

    def read(batches):
        for batch in batches:
            texts = [Page(x.as_py() or "").text(p) if x.is_valid else "" for x, p in zip(batch.column(2), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["key", "url", "text"])

    kind = dict(rows.dtypes)["key"]
    out = rows.mapInArrow(read, f"key {kind}, url string, text string")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length(or_empty(F.col("text"))).cast("long").alias("n_chars"))


def op5_consensus_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
