"""HTML main-text extraction by consensus of a host's pages.

Each page's containers are scored by the text they hold outside links and
outside elements that are furniture by tag, role or name; the page votes for
the path of the deepest container that still holds most of it.  A vote never
goes below an article nor below a container with text of its own, so headings
and leads beside the body stay.  A name makes an element furniture only if all
words of the class or id say so (``share-bar``, not ``search-history``).  Inside
an article only boxes are judged by names, not headings, paragraphs, items or
tables, and names that articles use themselves (``menu``, ``discussion``) drop a
box only if most of its text is links, as a list outside an article is dropped.
Paths are generalised: tag and class names without digits.  Spark counts for
each host the pages that have a path, vote for it, and the different texts
found there.  Pages with little text follow the template the host's other pages
agree on: every page is extracted again with its host's paths, best voted
first.  A page whose path of the host holds less than half of what its own vote
holds keeps its own vote, unless most of the host's pages with that container
voted for another one.  Containers before the chosen one under the same parent
(title, lead) belong to it, but for those whose text the host repeats.

Only counts by (host, path, text hash) are shuffled.  A path counts for its host
with at least ``LEAST_SHARE`` of the votes, so a host has few, however many
pages it has; a page of a rarer template has its own vote.  The hosts' paths are
broadcast while they have at most ``BROADCAST_CHARS`` characters; beyond that
they are joined.

Defined results: null html is empty; very long pages are read whole; paths with
equal votes rank by name; a page without text gives an empty text;
pages without a host vote together as host ''; unclosed and misnested markup
is closed as browsers do for blocks; text without a body counts as body text;
repeated rows each give a row.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Container, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
import xxhash
from pyspark.sql import DataFrame, SparkSession

from kindred.llm.arrowtext import slices, small_batches
from kindred.llm.url_filter import url_parts
from kindred.storage import materialise

MOST = 0.75  # share of a container's text that makes its child the better one
LEAST_SHARE = 0.01
DEEPEST = 40  # below this depth a path goes on as a hash of its rest
BROADCAST_CHARS = 8 << 20

# HTML's element groups and common names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg canvas audio video xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul button".split())
CONTAINERS = frozenset("article body center div main section td".split())
FURNITURE = frozenset("nav footer aside form dialog menu search select button fieldset option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adsense anzeige anzeigen advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment commentaire commentaires commentarea commentbox commentform commentlist comments commentsection comentario comentarios consent cookie cookies copyright disclaimer discussion disqus footer gdpr header kommentar kommentare legal login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination popular popup promo promotion publicidad publicite recommended related replies reply respond search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar trending werbung widget".split()
)
# Words that say nothing beside a name of furniture.
LAYOUT = frozenset("a and area articles b bar block bottom box btn button buttons col column container content d div el entry fb footer global group header holder icon icons inner item items js left link links list main media module my nav on outer overlay page panel post posts right row section secondary site slot small sticky sub text the thread title to top ui unit user users v view w wrap wrapper x".split())
# Names of furniture that articles use for parts of their own.
DOUBTFUL = frozenset("discussion menu menus popular search".split())
BOXES = frozenset("div section ul ol dl details dialog figure td".split())
KEEPERS = frozenset(["html", "body", "main", "article"])
CLOSES = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
STOP = re.compile(r"""=\s*+(["'])|>""")  # a quoted value begins, or the tag ends
ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|(?=[\s/]|$))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """A page as blocks of text under a tree of containers."""

    def __init__(self, source: str | None):
        self.parent, self.path, self.article = [-1], ["body"], [False]
        self.blocks: list[tuple[str, int, int]] = []  # text, container, characters in links
        # Tag, container, furniture, in an article, number of blocks before an element that goes if it is mostly links.
        self._stack: list[tuple[str, int, bool, bool, int | None]] = [("body", 0, False, False, None)]
        self._lean = [0]  # characters in links less those outside, of the blocks up to each
        self._depth = [0]
        self._open_tags: Counter[str] = Counter()
        self._text: list[str] = []
        self._links = self._in_link = 0
        self._unclosed: set[str] = set()  # quotes of which the rest has none
        if source:
            self._read(source)

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            found = TOKEN.search(source, at)
            if found is None:
                self._add(source[at:])
                break
            if found.start() > at:
                self._add(source[at : found.start()])
            at = found.end()
            tag = found[2]
            if tag is None:
                continue
            tag = tag.lower()
            begin, at = at, self._tag_end(source, at)
            attributes = source[begin : at - 1]
            if tag in RAW:
                if not found[1] and not (tag == "svg" and attributes.endswith("/")):  # HTML closes no script by a slash
                    stop = re.compile(rf"</{re.escape(tag)}\b[^>]*+>?", re.I).search(source, at)
                    at = stop.end() if stop else size
            elif found[1]:
                self._close(tag)
            else:
                self._open(tag, attributes)
        self._flush()

    def _tag_end(self, source: str, at: int) -> int:
        """The place behind a tag's ``>``; a quote that never closes is an ordinary character."""
        while (found := STOP.search(source, at)) is not None:
            if found[1] is None:
                return found.end()
            at = found.end()
            if found[1] not in self._unclosed:
                close = source.find(found[1], at)
                if close < 0:
                    self._unclosed.add(found[1])
                else:
                    at = close + 1
        return len(source) + 1

    def _add(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self._text.append(text)
        if self._in_link:
            self._links += len(text.strip())

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text and not self._stack[-1][2]:
                links = min(self._links, len(text))
                self.blocks.append((text, self._stack[-1][1], links))
                self._lean.append(self._lean[-1] + 2 * links - len(text))
            self._text, self._links = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self._in_link = 1
        if tag in VOID:
            if tag == "hr":
                self._flush()
            else:
                self._text.append(" " if tag == "br" else "")
            return
        if tag not in BLOCKS:
            return
        self._flush()
        if tag in ("html", "body"):
            return
        self._in_link = 0
        if tag in CLOSES:
            names, walls = CLOSES[tag]
            self._pop_to(names.split(), walls)
        if tag not in ("li", "td", "th", "tr", "dd", "dt", "option"):
            self._pop_to(["p"], {"table", "td", "div", "button"})
        elif self._stack[-1][0] == "p":
            self._pop_to(["p"], {"table"})
        _, node, furniture, inside, _ = self._stack[-1]
        names = self._names(attributes) if attributes.strip() else ("", "", False)
        judged = self._furniture(tag, inside, *names)
        doubtful = judged is None or (tag in ("ul", "ol") and not inside)
        furniture = furniture or bool(judged)
        if tag in CONTAINERS:
            self.parent.append(node)
            self.article.append(tag == "article")
            deep = self._depth[node] + 1
            path = f"{self.path[node]}>{tag}{names[0]}"
            self.path.append(path if deep <= DEEPEST else f"{path.partition('#')[0] if deep == DEEPEST + 1 else self.path[node].partition('#')[0]}#{xxhash.xxh3_64_hexdigest(path)}")
            self._depth.append(deep)
            node = len(self.parent) - 1
        self._stack.append((tag, node, furniture, inside or tag in ("article", "main"), len(self.blocks) if doubtful else None))
        self._open_tags[tag] += 1

    def _cut(self, k: int) -> None:
        """Close everything from place ``k`` of the stack on."""
        for tag, *_, since in reversed(self._stack[k:]):
            self._open_tags[tag] -= 1
            if since is not None and self._lean[-1] > self._lean[since]:
                del self.blocks[since:], self._lean[since + 1 :]
        del self._stack[k:]

    @staticmethod
    def _names(attributes: str) -> tuple[str, str, bool]:
        """(generalised class names, words to judge by, hidden)."""
        label, judged, hidden = "", "", False
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), html.unescape(a or b or c)
            if name == "class":
                label = "".join(f".{x}" for x in sorted({DIGITS.sub("", x) for x in value.split()}) if x)
                judged += " " + value
            elif name == "id":
                judged += " " + value
            elif name == "role":
                judged += " role=" + value.strip().lower()
            else:
                hidden |= name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and bool(HIDDEN.search(value)))
        return label, judged, hidden

    @staticmethod
    def _furniture(tag: str, inside: bool, label: str, judged: str, hidden: bool) -> bool | None:
        """None: furniture if most of it is links."""
        if hidden or tag in FURNITURE:
            return True
        if tag == "header":
            return not inside
        if not judged or tag in KEEPERS:
            return False
        if inside and tag not in BOXES:
            judged = " ".join(x for x in judged.split() if x.startswith("role="))
        roles = {x[5:] for x in judged.split() if x.startswith("role=")}
        names = NAMES - {"header", "byline"} if inside else NAMES
        tokens = ({w.lower() for w in PART.findall(x)} for x in judged.split() if not x.startswith("role="))
        named = [words & names for words in tokens if words & names and words <= NAMES | LAYOUT]
        if roles & ROLES or any(not (inside and words <= DOUBTFUL) for words in named):
            return True
        return None if named else False

    def _pop_to(self, names: list[str], walls: set[str]) -> None:
        """Close open elements of ``names`` unless a wall is nearer."""
        while any(self._open_tags[x] > 0 for x in names):
            for k in range(len(self._stack) - 1, 0, -1):
                if self._stack[k][0] in names:
                    self._cut(k)
                    break
                if self._stack[k][0] in walls:
                    return
            else:
                return

    def _close(self, tag: str) -> None:
        if tag == "a":
            self._in_link = 0
        if tag not in BLOCKS:
            return
        self._flush()
        if self._open_tags[tag] > 0:
            self._cut(next(k for k in range(len(self._stack) - 1, 0, -1) if self._stack[k][0] == tag))

    def totals(self) -> list[int]:
        """Characters outside links below each container."""
        total = [0] * len(self.parent)
        for text, node, links in self.blocks:
            total[node] += len(text) - links
        for node in range(len(total) - 1, 0, -1):
            total[self.parent[node]] += total[node]
        return total

    def vote(self) -> str | None:
        """Path of the deepest container that holds most of the text of each one around it.

        It is no deeper than an article, nor than a container with text of its own.
        """
        total = self.totals()
        own = {node for text, node, links in self.blocks if len(text) > links}
        if not total[0]:
            return None
        children: dict[int, list[int]] = {}
        for node in range(1, len(total)):
            children.setdefault(self.parent[node], []).append(node)
        at = 0
        while at in children and at not in own and not self.article[at]:
            best = max(children[at], key=lambda n: (total[n], -n))
            if total[best] < MOST * total[at]:
                break
            at = best
        return self.path[at]

    def texts(self) -> list[int]:
        """A hash of the text below each container with text outside links, else 0."""
        made: list[list[str]] = [[] for _ in self.parent]
        for text, node, _ in self.blocks:
            made[node].append(text)
        total = self.totals()
        for node in range(len(total) - 1, 0, -1):
            made[self.parent[node]].append(str(xxhash.xxh3_64_intdigest("\n".join(made[node]))))
        return [xxhash.xxh3_64_intdigest("\n".join(x)) >> 1 if n else 0 for x, n in zip(made, total, strict=True)]

    def text(self, paths: list[str], lost: Container[str] = (), repeated: Container[str] = ()) -> tuple[str, str | None]:
        """The blocks below the containers of the page's path, and that path.

        It is the first of ``paths`` that holds text, or the page's vote if
        that holds more than twice as much and is none of ``lost``.
        Containers before it under the same parent are part of it unless they are
        articles of their own or their path is ``repeated``.
        """
        total, own = self.totals(), self.vote()
        held: Counter[str] = Counter()
        for p, n in zip(self.path, total, strict=True):
            held[p] += n
        path = next((p for p in paths if held[p]), own)
        if path is None:  # nothing but links, or no text at all
            return "\n".join(t for t, _, _ in self.blocks), None
        if own is not None and own not in lost and 2 * held[path] < held[own]:
            path = own
        chosen = [node for node, n in enumerate(total) if self.path[node] == path and n]
        last = {self.parent[node]: node for node in chosen if node and not self.article[node]}
        inside = [False] * len(total)
        for node in range(len(total)):
            before = node and node < last.get(self.parent[node], 0) and total[node] and not self.article[node] and self.path[node] not in repeated
            inside[node] = bool(before) or (self.path[node] == path and total[node] > 0) or (node > 0 and inside[self.parent[node]])
        kept = [t for t, node, _ in self.blocks if inside[node]]
        return "\n".join(kept), path


def host_paths(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", least: float = LEAST_SHARE) -> DataFrame:
    """(host, paths, lost, repeated) of hosts, for paths on at least ``least`` of a host's pages.

    ``paths`` have that share of the votes, best first; ``lost`` have votes, but
    of less than half of the pages that have them; ``repeated`` hold no more
    than half as many texts as pages, on three pages or more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                found: Counter[tuple] = Counter()
                for host, source in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                    page = Page(source)
                    vote = page.vote()
                    found.update({(host, path, text, path == vote) for path, text in zip(page.path, page.texts(), strict=True) if text})
                host, path, text, voted = zip(*found, strict=True) if found else ((), (), (), ())
                yield pa.RecordBatch.from_pydict({"host": pa.array(host, pa.string()), "path": pa.array(path, pa.string()), "text": pa.array(text, pa.int64()), "voted": pa.array(voted, pa.bool_()), "n": pa.array(found.values(), pa.int64())})

    host, _ = url_parts(F.col(url_col))
    seen = pages.select(host.alias("host"), F.col(html_col).alias("html")).mapInArrow(run, "host string, path string, text long, voted boolean, n long")
    by_text = seen.groupBy("host", "path", "text").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("voted"), F.col("n")).otherwise(0)).alias("votes"))
    counted = materialise(by_text.groupBy("host", "path").agg(F.sum("n").alias("seen"), F.sum("votes").alias("votes"), F.count("*").alias("texts")), "votes")
    cast = counted.groupBy("host").agg(F.sum("votes").alias("cast"))
    share = F.col("cast") * least
    ranked, lost = F.col("votes") >= F.greatest(share, F.lit(1)), (F.col("votes") > 0) & (2 * F.col("votes") < F.col("seen"))
    repeated = (F.col("seen") >= F.greatest(share, F.lit(3))) & (2 * F.col("texts") <= F.col("seen"))
    marked = counted.join(cast, "host").select("host", "path", "votes", ranked.alias("ranked"), lost.alias("lost"), repeated.alias("repeated")).where("ranked OR lost OR repeated")
    listed = lambda mark: F.sort_array(F.collect_list(F.when(F.col(mark), F.col("path"))))
    best = F.sort_array(F.collect_list(F.when(F.col("ranked"), F.struct((-F.col("votes")).alias("order"), "path"))))
    out = marked.groupBy("host").agg(best.alias("best"), listed("lost").alias("lost"), listed("repeated").alias("repeated"))
    return out.select("host", F.col("best.path").alias("paths"), "lost", "repeated")


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """``id_col``, url, text, n_chars and the path used, for every row."""
    best = materialise(host_paths(pages, url_col=url_col, html_col=html_col), "paths")
    host, _ = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    told = ("paths", "lost", "repeated")
    few = (best.agg(F.sum(F.length(F.concat_ws("", "host", *told)) + 32)).first()[0] or 0) <= broadcast_chars
    rows = rows.join(F.broadcast(best) if few else best, "host", "left").select("id", "url", "html", *told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                hosts = zip(*(part.column(c).to_pylist() for c in told), strict=True)
                made = [Page(x).text(*(p or () for p in known)) for x, known in zip(part.column("html").to_pylist(), hosts, strict=True)]
                text = [t for t, _ in made]
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "url": part.column("url"), "text": pa.array(text, pa.string()), "n_chars": pa.array([len(t) for t in text], pa.int64()), "path": pa.array([p for _, p in made], pa.string())})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long, path string").withColumnRenamed("id", id_col)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the main text of all pages."""
    small_batches(spark)
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
