"""Main text of web pages by consensus host paths: each page scores its containers, hosts vote on generalised tag-class paths, and
the pages are extracted again along the winning paths.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm._spark import extended, written

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|title|object)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)

#: Elements without end tags; inline ones; those that never hold an article; those that hold none unless they hold the page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr picture source".split())
JUNK_TAGS = set("nav footer head menu button dialog audio video canvas".split())
MARKED_TAGS = set("aside form fieldset header".split())
JUNK_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that mark a container, if nothing but such words, SHAPE_NAMES and ARTICLE_NAMES stand in the name: reader comments;
#: adverts and notices; parts made of links; others, which ARTICLE_NAMES in the same name overrule. Names with LAYOUT_NAMES tell of a layout.
COMMENT_NAMES = set("comment comments disqus reply replies respond responses".split())
NOTICE_NAMES = set(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo cookie cookies consent gdpr popup modal newsletter subscribe
    subscription signup login""".split()
)
LINK_NAMES = set(
    """share sharing social related recommended recommendations sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer
    pagination pager""".split()
)
WEAK_NAMES = set("header masthead topbar banner notice notices notification alert overlay promotion discussion side foot skip toolbar search aside".split())
SHAPE_NAMES = set(
    """area bar block bottom box btn button buttons card cards container feed global group holder icons inner item items left legal line link links list
    media module outer panel reader readers right row section site slot tags thread tools top unit us user users view visitor wrap wrapper""".split()
)
ARTICLE_NAMES = set("article articles post posts entry story stories content main body text page blog news title headline".split())
LAYOUT_NAMES = set("has no with without layout col columns".split())
CONTAINERS = set("body div section article main td center".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: A start of one of the first ends an open one of the second, up to a container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCK_CLOSES_P = CONTAINERS | MARKED_TAGS | HEADINGS | set("p ul ol li dl dt dd table tr td th blockquote pre figure figcaption footer nav hr address details".split())

#: Paths that hosts have something to say on, up to which they are broadcast (about 40 bytes each); with more, each page meets its own paths.
BROADCAST_PATHS, SALTS = 400_000, 64
#: Weight of a weakly marked container's text; share of the page's text from which such a mark doesn't count; of a container's, from which what
#: stands beside it belongs to it; of linked text, from which a container of three links is a list of links; characters of a short part.
MARKED, WHOLE, BESIDE, LINKS, SHORT = 0.1, 0.8, 0.1, 0.8, 200
#: A path is boilerplate of its host if it stands on this many different pages at least, and on this share of them with text that another page has too.
PAGES, REPEATED = 3, 0.5
_MASK = (1 << 64) - 1


class Box:
    """A container of a page: its path as a hash of all steps, and what its subtree holds."""

    __slots__ = ("key", "tag", "parent", "kind", "marked", "chars", "kept", "linked", "links", "headings", "titles", "holds", "digest")

    def __init__(self, tag: str, name: str, parent: Box | None, kind: str):
        self.key = xxhash.xxh3_64_intdigest(f"{parent.key}>{tag}{name}") if parent else 0
        self.tag, self.parent, self.kind, self.marked = tag, parent, kind, False
        self.chars = self.kept = self.linked = self.links = self.headings = self.titles = self.digest = 0
        self.holds = False

    def above(self) -> Iterator[Box]:
        """The box itself and its ancestors."""
        box: Box | None = self
        while box is not None:
            yield box
            box = box.parent

    @property
    def guarded(self) -> bool:
        """Whether repetition can't make it boilerplate: it holds an article element, or a title and text of some size."""
        return self.holds or 0 < 5 * self.titles <= self.chars


def _kind(words: set[str]) -> str:
    """What a name's words tell: comment, notice, link, weak or nothing."""
    if words & LAYOUT_NAMES or not words <= COMMENT_NAMES | NOTICE_NAMES | LINK_NAMES | WEAK_NAMES | SHAPE_NAMES | ARTICLE_NAMES:
        return ""
    for kind, names in (("comment", COMMENT_NAMES), ("notice", NOTICE_NAMES), ("link", LINK_NAMES)):
        if words & names:
            return kind
    return "weak" if words & WEAK_NAMES and not words & ARTICLE_NAMES else ""


@lru_cache(65536)
def _names(attributes: str) -> tuple[str, bool, str]:
    """The generalised class (without digits); whether a role excludes; the strongest kind of class and id."""
    first, kinds, roles = "", set(), set()
    for key, value in _ATTRIBUTE.findall(attributes):
        value = html_lib.unescape(value.strip("\"'"))
        if key.lower() == "role":
            roles |= set(value.lower().split())
            continue
        for x in value.split():
            kinds.add(_kind(set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", x).lower())) - {""}))
        if key.lower() == "class" and value.split():
            first = "." + ".".join(sorted({re.sub(r"\d+|>", "", x) for x in value.lower().split()}))
    return first, bool(roles & JUNK_ROLES), next((k for k in ("comment", "notice", "link", "weak") if k in kinds), "")


def blocks(page: str) -> list[tuple[str, Box, int]]:
    """The text blocks outside what never holds an article, in page order: text, innermost box, characters of links in it. The boxes
    hold the sums over their subtrees.
    """
    out: list[tuple[str, Box, int, str]] = []
    root = Box("", "", None, "")
    stack: list[tuple[str, bool, Box]] = [("", False, root)]  # tag, excluded, box
    parts: list[str] = []
    linked = links = in_link = 0

    def flush() -> None:
        nonlocal linked, links
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                box, some = stack[-1][2], min(linked, len(text))
                out.append((text, box, some, stack[-1][0]))
                title, own = stack[-1][0] == "h1", xxhash.xxh3_64_intdigest(text)
                for each in box.above():
                    each.chars += len(text) - some
                    each.linked += some
                    each.links += links
                    each.titles += title * len(text)
                    each.digest = (each.digest * 0x9E3779B97F4A7C15 + own) & _MASK
            parts.clear()
        linked = links = 0

    def pop_to(k: int) -> None:
        flush()
        del stack[k:]

    def put(text: str) -> None:
        nonlocal linked
        if text and not stack[-1][1]:
            parts.append(text)
            if in_link:
                linked += len(text)

    at = 0
    for m in _TAG.finditer(page):
        put(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                put(" ")
            elif tag == "a":
                in_link = 0 if m[2] else 1
                links += in_link
            continue
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if stack[k][0] in CONTAINERS and tag not in CONTAINERS and tag not in JUNK_TAGS and tag not in MARKED_TAGS and tag != "html":
                    flush()
                    break
            else:
                flush()
            continue
        flush()
        in_link = 0
        for shut in (_CLOSES.get(tag, set()), {"p", *HEADINGS} if tag in _BLOCK_CLOSES_P else set()):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in shut:
                    pop_to(k)
                    break
                if stack[k][0] in CONTAINERS or stack[k][0] in ("table", "ul", "ol", "dl"):
                    break
        if tag in VOID:
            continue
        _, junk, box = stack[-1]
        name, excluded, kind = _names(m[4]) if m[4] else ("", False, "")
        if tag in ("body", "html", "main"):
            excluded, kind = False, ""
        elif tag == "article":
            excluded, kind = False, "comment" if kind == "comment" else "inner" if _in_article(box) else ""
        elif tag in MARKED_TAGS and not (tag == "header" and _in_article(box)):
            kind = kind or "tag"
        junk = junk or excluded or tag in JUNK_TAGS
        if tag in CONTAINERS or name or kind:
            box = Box(tag, name, box, kind)
        stack.append((tag, junk, box))
    put(page[at:])
    flush()
    boxes = list({id(b): b for _, own, _, _ in out for b in own.above()}.values())
    for box in boxes:
        if box.tag in ("article", "main") and not any(b.kind in ("comment", "inner") for b in box.above()):
            for each in box.above():
                each.holds = True
    for box in boxes:
        box.marked = _marked(box, root)
    titled = any(heading == "h1" and not any(b.marked for b in own.above()) for _, own, _, heading in out)
    for box in boxes:  # the page's only title, and all of its text unless it is a notice or comments, are of the article
        box.marked = box.marked and not (box.titles and not titled and box.kind != "notice" and box.chars > 0)
    if boxes and all(any(b.marked for b in own.above()) for _, own, _, _ in out):
        for box in boxes:
            box.marked = box.marked and box.kind in ("notice", "comment")
    for text, box, some, heading in out:
        if not any(b.marked for b in box.above()):
            for each in box.above():
                each.kept += len(text) - some
                each.headings += heading in HEADINGS
    return [x[:3] for x in out]


def _in_article(box: Box) -> bool:
    return any(b.tag in ("article", "main") for b in box.above())


def _marked(box: Box, root: Box) -> bool:
    """Whether a container is none of the article's, by its name and what it holds."""
    whole, size = box.chars >= WHOLE * root.chars, box.linked + box.chars
    linked = box.links >= 2 and box.linked >= LINKS * size / 2
    if box.holds:
        return False
    if box.tag in ("div", "section", "td", "ul", "ol", "p") and box.links >= 3 and box.linked >= LINKS * size and size < WHOLE * (root.linked + root.chars):
        return True  # a list of links in a container of its own
    if box.kind == "inner":  # HTML: an article in an article is a comment on it, unless it is its very text
        outer = next(b for b in box.parent.above() if b.tag in ("article", "main"))
        return outer.tag == "article" and not box.titles and outer.titles > 0
    if box.kind in ("", "comment"):
        return bool(box.kind)
    inside = box.parent is not None and _in_article(box.parent)
    if box.kind == "notice":
        return not (inside and box.tag == "section") or linked or size <= SHORT
    if box.kind in ("link", "weak") and inside and not linked:
        return box.tag != "section" and size <= SHORT
    return not whole


def article(box: Box) -> Box:
    """The container of the article that a box's text belongs to: the outermost article element, else the main element, else the highest container,
    the body included, that adds a heading, or text of some size, to it. Containers that add nothing are passed.
    """
    for tag in ("article", "main"):
        found = [each for each in box.above() if each.tag == tag and each.kind != "comment"]
        if found:
            return found[-1]
    found = now = box
    while now.parent is not None and now.parent.tag not in ("", "html"):
        now = now.parent
        beside = now.kept - found.kept
        if now.headings > found.headings or beside > 0 and beside >= BESIDE * found.kept:
            found = now
        elif beside > 0:
            break
    return found


def scores(found: list[tuple[str, Box, int]]) -> dict[int, float]:
    """By path of an article's container: characters outside links of the boxes that belong to it, weakly marked ones by a small weight."""
    own: dict[int, float] = defaultdict(float)
    boxes = {}
    for text, box, linked in found:
        kinds = {b.kind for b in box.above() if b.marked}
        boxes[id(box)] = box
        own[id(box)] += max(len(text) - 2 * linked, 0) * (0.0 if kinds & {"notice", "comment", "inner"} else MARKED if kinds else 1.0)
    out: dict[int, float] = defaultdict(float)
    for key, box in boxes.items():
        if own[key] > 0:
            out[article(box).key] += own[key]
    return out


def shares(best: dict[int, float]) -> dict[int, int]:
    """Scores as shares of one vote, in millionths."""
    whole = sum(best.values())
    return {path: round(1e6 * score / whole) for path, score in best.items() if score > 0}


def main_text(page: str, host: dict[int, tuple[int, bool]]) -> str:
    """host: votes of paths, and whether they are boilerplate. The text in all containers of the path with the most votes (the page's own where the
    host says nothing), without marked containers and boilerplate inside; none if no path is left.
    """
    found = blocks(page)
    votes = shares(scores(found))
    for box in {id(b): b for _, x, _ in found for b in x.above()}.values():
        if host.get(box.key, (0, False))[0]:
            votes[box.key] = host[box.key][0]
    repeats = lambda b: host.get(b.key, (0, False))[1] and not b.guarded
    for path in sorted(votes, key=lambda p: (votes[p], p), reverse=True):
        got = []
        for text, box, _ in found:
            inside = list(box.above())
            top = next((k for k, b in enumerate(inside) if b.key == path), None)  # the innermost container of this path
            if top is not None and not any(b.marked for b in inside[:top]) and not any(repeats(b) for b in inside):
                got.append(text)
        if got:
            return "\n\n".join(got)
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """pages: page_id, url, html (others ignored). Returns page_id, url, text, a row for each row.

    Every page gives the containers of its possible articles shares of one vote by their text, and tells the digest of each container's text. A host
    sums the votes by path (ties by the path's hash), and takes a path as boilerplate if most of its different pages repeat its text. A page takes the
    path with the most votes that it has. Its text is all of that container, whatever its parts, but for marked containers (see _marked) and
    boilerplate inside it. Hosts are lower-case, without user and port; a null url or one without host belongs to the empty host. On paths of a single
    page a host says nothing, so that page's own vote holds.

    Null or empty html: an empty text. Repeated rows vote and are extracted each; for repetition they are one page. Very long pages are read whole, one
    at a time. Other columns are ignored, whatever their names. No rows: no rows.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))
    deal = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")  # copies of a page are dealt to salts
    pages = pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("html").alias("page"), deal.alias("salt"))

    def tell(batches):
        for batch in batches:
            out: list[tuple] = []
            for own, page, salt, text in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "salt", "html")), strict=True):
                found = blocks(text or "")
                votes, digests = shares(scores(found)), {}
                for box in {id(b): b for _, x, _ in found for b in x.above()}.values():
                    digests[box.key] = (digests.get(box.key, 0) * 31 + box.digest) & _MASK
                out += [(own, _signed(key), page, salt, _signed(d), votes.get(key, 0)) for key, d in digests.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [()] * 6, _TOLD.types, strict=True)], schema=_TOLD)

    told = pages.select("host", "page", "salt", "html").mapInArrow(tell, "host string, path long, page long, salt int, digest long, votes long")
    seen = written(told.groupBy("host", "path", "page", "salt", "digest").agg(F.sum("votes").alias("votes")), "paths")
    texts = seen.groupBy("host", "path", "page", "digest").agg(F.sum("votes").alias("votes")).groupBy("host", "path", "digest").agg(F.count(F.lit(1)).alias("n"), F.sum("votes").alias("votes"))
    known = texts.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("again"), F.sum("votes").alias("votes"))
    boiler = (F.col("n") >= PAGES) & (F.col("again") >= REPEATED * F.col("n"))
    known = written(known.where("n > 1").select("host", "path", "votes", boiler.alias("boiler")).where("votes > 0 or boiler"), "hosts")
    told_of = F.collect_list(F.struct("path", "votes", "boiler")).alias("known")
    if known.count() <= BROADCAST_PATHS:
        met = pages.join(F.broadcast(known.groupBy("host").agg(told_of)), "host", "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        of_page = seen.select("host", "path", "page", "salt").join(salted, ["host", "path", "salt"]).groupBy("host", "page", "salt").agg(told_of)
        met = pages.join(of_page, ["host", "page", "salt"], "left")

    def read(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for page, told in zip(batch.column("html").to_pylist(), batch.column("known"), strict=True):
            out.append(main_text(page or "", {x["path"] & _MASK: (x["votes"], x["boiler"]) for x in told.as_py() or ()}))
        return [pa.array(out, pa.string())]

    return extended(met, read, "text string").select("page_id", "url", "text")


_TOLD = pa.schema([("host", pa.string()), ("path", pa.int64()), ("page", pa.int64()), ("salt", pa.int32()), ("digest", pa.int64()), ("votes", pa.int64())])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x
