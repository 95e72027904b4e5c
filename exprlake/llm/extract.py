"""HTML main-text extraction by consensus host paths.

Every page's containers are scored by their own running text; the page proposes the generalised path (tags with their
classes, digits generalised) of its best container. Spark sums the proposals per host and path, and every host keeps
its winning paths. Each page is then extracted again from the container on the first winning path that it has, or
from its own best container if it has none. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are left out wherever they stand. What only a class, id or role marks as such is not left out if it is
an article, main or holds most of the page's text (reader comments may hold most of it), nor where nothing else has text.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from exprlake.llm.common import stage, text_rows

#: Winning paths kept for a host, and the least share of the host's pages that proposed a path.
WINNERS, LEAST_SHARE = 4, 0.1
#: Characters of all hosts' winning paths up to which they are broadcast; beyond, pages and paths meet in a join by host.
BROADCAST_CHARS = 16_000_000
#: Path of what stands outside any element.
ROOT = "#"

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_VALUE = re.compile(r"\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_DROPPED = frozenset("head script style noscript template svg math iframe object canvas audio video nav header footer aside form button select option textarea input label dialog menu title xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"}}
_SCOPES = frozenset("table ul ol dl select body article section div".split())
#: Whole tokens of a class, id or role that mark what is not the article: a word alone, or with usual qualifiers around it.
_COMMENTS = r"(?:comments?|commentlist|disqus|respond|replies)"
_WORDS = rf"(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu\w*|breadcrumbs?|header|masthead|footer|sidebar|side[_-]bar|rail|aside|widget|{_COMMENTS}|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|pagination|pager|toolbar|search|complementary|contentinfo|alert)"
_BEFORE = r"(?:(?:site|page|main|top|bottom|left|right|upper|lower|primary|secondary|global|mobile|desktop|sticky|fixed|floating|post|posts|article|entry|blog|user|reader|google|wp|js|the|block|footer|header|sidebar)[_-]+)*"
_AFTER = r"(?:[_-]+(?:bar|box|list|item|items|link|links|wrap|wrapper|container|content|area|section|block|inner|outer|body|text|title|form|button|buttons|btn|icons?|panel|slot|unit|row|col|column|group|media|posts?|articles?|stories|left|right|top|bottom|primary|secondary|main|message|dialog|\d+\w*))*"
_BOILER = re.compile(rf"{_BEFORE}{_WORDS}(?:[_-]+{_WORDS})*{_AFTER}", re.I)
_READERS = re.compile(rf"{_BEFORE}{_COMMENTS}(?:[_-]+{_COMMENTS})*{_AFTER}", re.I)
_MAIN = frozenset("article main".split())
#: Blocks that are no containers.
_BLOCKS = frozenset("p li td tr h1 h2 h3 h4 h5 h6".split())


class _Paths:
    """The distinct paths of a page as a tree: a path is a number, its parent's number is smaller."""

    def __init__(self) -> None:
        self.up, self.tag, self.step = [0], [ROOT], [ROOT]
        self._below: dict[tuple[int, str], int] = {}

    def below(self, up: int, tag: str, step: str) -> int:
        found = self._below.setdefault((up, step), len(self.up))
        if found == len(self.up):
            self.up.append(up)
            self.tag.append(tag)
            self.step.append(step)
        return found

    def name(self, path: int) -> str:
        steps = []
        while path:
            steps.append(self.step[path])
            path = self.up[path]
        return "/".join([ROOT, *reversed(steps)])

    def find(self, name: str) -> int | None:
        path: int | None = 0
        for step in name.split("/")[1:]:
            path = self._below.get((path, step))
            if path is None:
                break
        return path


class _Node:
    __slots__ = ("tag", "path", "up", "never", "marked", "skip", "own", "linked")

    def __init__(self, tag: str, path: int, up: int, never: bool, marked: int):
        self.tag, self.path, self.up, self.never, self.marked = tag, path, up, never, marked
        self.skip, self.own, self.linked = never, 0, 0


def _step(tag: str, attributes: str) -> tuple[str, bool, int]:
    """A path step of tag and classes with digits generalised, whether the element never shows article text, and whether class,
    id or role mark it as boilerplate: 0 no, 1 yes, 2 as reader comments."""
    if not attributes:
        return tag, tag in _DROPPED, 0
    found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    names = sorted({re.sub(r"\d+", "#", c).replace("/", "_") for c in found.get("class", "").split()})
    hidden = "hidden" in _VALUE.sub(" ", attributes).lower().split() or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
    marked = 0
    if tag not in ("html", "body") and tag not in _MAIN:
        said = [t for k in ("class", "id", "role") for t in found.get(k, "").split() if _BOILER.fullmatch(t)]
        marked = 2 if any(_READERS.fullmatch(t) for t in said) else bool(said)
    return ".".join([tag, *names]), tag in _DROPPED or hidden, marked


def _settle(nodes: list[_Node], pieces: list[tuple[int, str, bool, bool]]) -> list[tuple[int, str, bool]]:
    """Decide which marked elements are skipped, and return the pieces outside them.

    Text in links does not count for an element's share of the page's text. Where an article or main has text, a marked element
    beside it stays skipped however long it is."""
    held = [max(0, x.own - x.linked) for x in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        held[nodes[k].up] += held[k]
    dropped = [x.marked == 2 or (x.marked == 1 and 2 * size <= held[0]) for x, size in zip(nodes, held, strict=True)]
    main = [x.tag in _MAIN and size > 0 for x, size in zip(nodes, held, strict=True)]
    below, inside = [False] * len(nodes), [False] * len(nodes)  # an article stands below; the element is in an innermost one
    for k in range(len(nodes) - 1, 0, -1):
        below[nodes[k].up] |= (main[k] or below[k]) and not dropped[k]
    for k, x in enumerate(nodes[1:], 1):
        inside[k] = inside[x.up] or (main[k] and not below[k])
        x.skip = x.never or nodes[x.up].skip or dropped[k] or (x.marked == 1 and below[0] and not below[k] and not inside[k])
    if not any(t.strip() for k, t, _, _ in pieces if not nodes[k].skip):
        for x in nodes:
            x.skip = x.never
    kept, edge = [], False
    for k, text, ends, brk in pieces:
        edge |= ends  # of left-out pieces too
        if not nodes[k].skip:
            kept.append((k, text, edge))
            edge = edge and brk
    for x in nodes:
        if x.skip:
            x.own = x.linked = 0
    return kept


def parse(page: str) -> tuple[list[_Node], list[tuple[int, str, bool]], _Paths]:
    """The elements of a page, its text pieces (element, text, whether a block ends before it), and its paths.

    Pieces in boilerplate are left out. Time and memory grow with the page's length, however deep its elements are nested."""
    paths = _Paths()
    nodes = [_Node("", 0, 0, False, 0)]
    stack, pieces, links, edge = [0], [], 0, True
    opened: Counter[str] = Counter()  # tags on the stack
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            text = m.group()
            if text[0] == "<" and len(text) > 1:
                continue
            node = nodes[stack[-1]]
            if not node.never:
                pieces.append((stack[-1], text, edge, False))
                edge = False
                size = len(text.strip())
                node.own += size
                node.linked += size if links else 0
            continue
        tag = tag.lower()
        if m.group(1):
            if opened[tag]:
                while True:
                    closed = nodes[stack.pop()]
                    opened[closed.tag] -= 1
                    links -= closed.tag == "a"
                    edge |= closed.tag not in _INLINE
                    if closed.tag == tag:
                        break
            continue
        if tag in _CLOSES_P or tag in _SIBLINGS:
            ends = {"p"} if tag in _CLOSES_P else _SIBLINGS[tag]
            for depth in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ends) else ():
                t = nodes[stack[depth]].tag
                if t in ends:
                    links -= sum(nodes[k].tag == "a" for k in stack[depth:])
                    opened.subtract(nodes[k].tag for k in stack[depth:])
                    del stack[depth:]
                    edge = True
                    if t == "p":
                        break
                elif t in _SCOPES:
                    break
        edge |= tag not in _INLINE
        parent = nodes[stack[-1]]
        if tag == "br" and not parent.never:
            pieces.append((stack[-1], "\n", edge, True))
        if tag in _VOID:
            continue
        step, never, marked = _step(tag, m.group(3))
        nodes.append(_Node(tag, paths.below(parent.path, tag, step), stack[-1], parent.never or never, marked))
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else n
            continue
        if not m.group(3).endswith("/") or tag not in ("svg", "math", "path"):
            stack.append(len(nodes) - 1)
            opened[tag] += 1
            links += tag == "a"
    return nodes, _settle(nodes, pieces), paths


def _best(nodes: list[_Node], paths: _Paths) -> tuple[int | None, float]:
    """The best container's path and its score: text outside links of its blocks, lowered at each level between block and container.

    Articles and main count three times; of equal ones the last in page order is best."""
    worth, reached = [0.0] * len(paths.up), [False] * len(paths.up)
    for node in nodes:
        if not node.skip and node.own:
            worth[node.path] += node.own - 2 * node.linked
            reached[node.path] = True
    best, most = None, 0.0
    for path in range(len(worth) - 1, -1, -1):  # children before their parents
        if not reached[path]:
            continue
        tag, value = paths.tag[path], worth[path]
        passed = value
        if tag not in _INLINE and tag not in _BLOCKS:
            if best is None or value * (3 if tag in _MAIN else 1) > most:
                best, most = path, value * (3 if tag in _MAIN else 1)
            passed *= 0.9 if tag in _MAIN else 0.6
        if path:
            worth[paths.up[path]] += passed
            reached[paths.up[path]] = True
    return best, worth[best] if best is not None else 0.0


def proposal(page: str) -> tuple[str, float]:
    """Path of the best container and its score ('' without text)."""
    nodes, _, paths = parse(page)
    best, worth = _best(nodes, paths)
    return (paths.name(best), worth) if best is not None else ("", 0.0)


def extract(page: str, winners: list[str]) -> tuple[str, str]:
    """Main text and the path it was taken from: the first of winners that has text, else the page's best container."""
    nodes, pieces, paths = parse(page)
    with_text = [False] * len(paths.up)
    for k, t, _ in pieces:
        path = nodes[k].path
        if t.strip():
            while not with_text[path]:
                with_text[path] = True
                path = paths.up[path]
    known = (paths.find(w) for w in winners if w)
    chosen = next((p for p in known if p is not None and with_text[p]), None)
    if chosen is None:
        chosen = _best(nodes, paths)[0]
    if chosen is None or not with_text[chosen]:
        return "", ""
    inside = [False] * len(paths.up)
    for path, up in enumerate(paths.up):
        inside[path] = path == chosen or inside[up]
    blocks, held = [], []
    for k, text, edge in pieces:
        if edge and held:
            blocks.append("".join(held))
            held = []
        if inside[nodes[k].path]:
            held.append(text)
    blocks.append("".join(held))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b), paths.name(chosen)


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^/?#]*://([^/?#]*)", 1), F.lit("")))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: key, url, text, n_chars (code points), path.

    A null html is empty and gives an empty text; rows with a null url vote as one host of their own; null or repeated
    keys pass through row by row. Only three columns are read, so other columns never clash. Very long and very deep pages take
    time and memory in proportion to their length; paths of equal weight win in their order as text. An empty table gives no rows.
    """
    pages = text_rows(pages)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [proposal(p.as_py() or "") for p in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["host", "path", "score"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [extract(p.as_py() or "", w.as_py() or []) for p, w in zip(batch.column(2), batch.column(3), strict=True)]
            text = pa.array([r[0] for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), text, pa.array([r[1] for r in rows], pa.string())], [key, url, "text", "path"])

    hosted = pages.select(F.col(key).alias(key), F.col(url).alias(url), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    votes = hosted.select("host", "html").mapInArrow(propose, "host string, path string, score double").where("path <> ''")
    # votes are pages; a page's weight is its logarithmic score, so that one huge page does not decide for its host
    votes = votes.groupBy("host", "path").agg(F.sum(F.log1p(F.greatest("score", F.lit(0.0)))).alias("weight"))
    by_host = Window.partitionBy("host")
    ranked = votes.withColumn("share", F.col("weight") / F.sum("weight").over(by_host)).withColumn("place", F.row_number().over(by_host.orderBy(F.desc("weight"), "path")))
    ranked = ranked.where(F.col("place") <= WINNERS).where((F.col("share") >= LEAST_SHARE) | (F.col("place") == 1))
    winners = ranked.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "path"))), lambda x: x["path"]).alias("paths"))
    winners = stage(winners, "winners")
    size = winners.agg(F.sum(F.length("host") + F.length(F.array_join("paths", " ")))).first()[0] or 0
    if size <= BROADCAST_CHARS:  # whole pages need not move then
        winners = F.broadcast(winners)
    joined = hosted.join(winners, "host", "left").select(key, url, "html", "paths")
    kinds = f"`{key}` {pages.schema[key].dataType.simpleString()}, `{url}` {pages.schema[url].dataType.simpleString()}, text string, path string"
    return joined.mapInArrow(read, kinds).select(key, url, "text", F.length("text").cast("long").alias("n_chars"), "path")
