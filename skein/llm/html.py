"""Main-text extraction by tree scoring.

The page becomes a light tree (unclosed and misnested tags are tolerated).  Menus, page headers and
footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are cut by element,
role and class or id words.  Each block with text of its own then passes points, one plus its commas plus
up to three for its length, to its ancestors (all to the parent, less with distance); an
element's score is its points times the part of its text that is not in links.  An article or main element has
``PRIOR`` times its points, as its author says where the text is.  The best container is
kept, with those siblings that score near it or head it.  Its blocks are the result, in page order.

The scanner reads each character a bounded number of times whatever the markup (unclosed quotes, comments,
tags and references included), open elements are found by their depth, and points reach ``REACH`` ancestors.

Character references are decoded, white space inside a block (line breaks included) becomes one space,
blocks are trimmed and joined by one newline; nothing else is dropped or cut.  A form is not cut if it
holds an article or a run of paragraphs.  A list of links without a mark of a menu is dropped only where
no container but the body was found.

Cases: a null or empty page gives an empty text; a page without markup is one block; ties go to the
outer element; very deep or long pages need no recursion; null ids and urls stay null; repeated rows
give a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import rows_of

GAP, NAME, EQUALS, BARE, NAME_END = re.compile(r"[\s/]*"), re.compile(r"[^\s=>/]+"), re.compile(r"\s*=\s*"), re.compile(r"[^\s>]*"), re.compile(r"[\s/>]")
LONG_REFERENCE = re.compile(r"&#0*([0-9]{8,});?")
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
SPACE = re.compile(r"\s+")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: HTML elements by kind.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "ruby",
    "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "img",
}
CUT = {"head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "option", "input", "textarea", "iframe", "svg", "canvas", "object", "audio", "video", "map", "dialog", "menu", "title", "frameset"}
CUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Words of a class or id that mark what is not the article.
CUT_WORDS = {
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "adsense", "alert", "announcement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent",
    "cookie", "cookies", "copyright", "discussion", "disclaimer", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
    "notification", "outbrain", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "sidenav",
    "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "taboola", "toolbar", "topbar", "warning", "widget",
}
READERS = {"comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "respond"}
ARTICLE = {"article", "main"}
NEVER_CUT = {"html", "body", "article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "a", "b", "i", "em", "strong", "span", "td", "tr", "table", "tbody", "li", "blockquote", "pre", "code"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: What a start tag closes if it is open, up to the fences that stop the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
FENCES = {"table", "td", "th", "article", "section", "div", "body", "html", "main", "aside", "nav", "header", "footer", "form", "ul", "ol", "dl", "blockquote", "figure", "button", "object"}


#: Points of an article or main element count this often: more than what a container three levels below it can be nearer.
PRIOR = 5
#: Ancestors that a block's points reach.
REACH = 16
#: Paragraphs in a form that make it part of the text.
RUN = 3


class Node:
    __slots__ = ("attrs", "children", "cut", "holds", "letters", "linked", "links", "parent", "points", "tag")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.points, self.letters, self.linked, self.links, self.cut, self.holds = 0.0, 0, 0, 0, False, 0


class Scanner:
    """Finds where tags end.  Reading on past an unclosed quote or tag is paid from a budget that grows with the page only."""

    def __init__(self, page: str):
        self.page, self.end = page, len(page)
        self.budget = len(page) + 10_000
        self.gone: set[str] = set()

    def find(self, what: str, at: int) -> int:
        """Like ``str.find``, but what was once not found is not looked for again."""
        if what in self.gone:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The position of the > that closes a tag, from the end of its name on; outside of quotes if those close; -1 if there is none."""
        first = self.find(">", at)
        if first < 0 or self.budget < 0:
            return first
        page, start = self.page, at
        while True:
            at = GAP.match(page, at).end()
            if at >= self.end:
                break
            if page[at] == ">":
                return at
            if page[at] == "=":
                at += 1
                continue
            at = NAME.match(page, at).end()
            is_ = EQUALS.match(page, at)
            if not is_:
                continue
            at = is_.end()
            if page[at : at + 1] in ('"', "'") and at < self.end:
                shut = self.find(page[at], at + 1)
                if shut < 0:
                    break
                at = shut + 1
            else:
                at = BARE.match(page, at).end()
        self.budget -= at - start
        return first


def decoded(text: str) -> str:
    """``text`` without character references; numbers beyond all characters become U+FFFD."""
    if "&" not in text:
        return text
    return unescape(LONG_REFERENCE.sub("\ufffd", text))


def parse(page: str) -> Node:
    root = Node("#root", "", None)
    stack, places, fences = [root], {}, [0]  # open elements, their depths by tag, the depths of fences
    scan, at, end = Scanner(page), 0, len(page)

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            gone = stack.pop()
            places[gone.tag].pop()
            if gone.tag in FENCES:
                fences.pop()
            if gone.tag == "form" and places["form"]:
                stack[places["form"][-1]].holds += gone.holds

    def close(tags: set[str], fence: set[str]) -> None:
        """Close the outermost open element of ``tags`` that no fence hides."""
        least = fences[-1] if fence is FENCES else max((places[t][-1] for t in fence if places.get(t)), default=0)
        if least and stack[least].tag in tags:
            close_to(least)
            return
        found = [p[bisect_right(p, least)] for t in tags if (p := places.get(t)) and p[-1] > least]
        if found:
            close_to(min(found))

    while at < end:
        start = scan.find("<", at)
        if start < 0:
            stack[-1].children.append(decoded(page[at:]))
            break
        if start > at:
            stack[-1].children.append(decoded(page[at:start]))
        at = start
        ending = page.startswith("/", at + 1)
        letter = page[at + 1 + ending : at + 2 + ending]
        if page.startswith("<!--", at):
            shut = scan.find("-->", at + 4)
            at = shut + 3 if shut >= 0 else end
            continue
        if page.startswith("<![CDATA[", at) and (shut := scan.find("]]>", at)) >= 0:
            stack[-1].children.append(page[at + 9 : shut])
            at = shut + 3
            continue
        if letter in ("!", "?") and not ending and (shut := scan.find(">", at)) >= 0:
            at = shut + 1
            continue
        if not (letter.isascii() and letter.isalpha()) or scan.find(">", at) < 0:
            stack[-1].children.append("<")
            at += 1
            continue
        name_end = NAME_END.search(page, at + 1 + ending).start()  # there is a > ahead
        tag, shut = page[at + 1 + ending : name_end].lower(), scan.tag_end(name_end)
        attrs, at = page[name_end:shut], shut + 1
        if ending:
            open_ = places.get(tag)
            if open_ and (tag not in INLINE or open_[-1] > fences[-1]):
                close_to(open_[-1])
            elif tag == "p":
                stack[-1].children.append(Node("p", "", stack[-1]))
            continue
        shut_by, fence = CLOSES.get(tag, (None, None))
        if tag not in INLINE:
            close({"p"}, FENCES)
        if tag in HEADINGS:
            close(HEADINGS, FENCES)
        if shut_by:
            close(shut_by, fence)
        if tag == "a":
            close({"a"}, FENCES)
        child = Node(tag, attrs, stack[-1])
        stack[-1].children.append(child)
        if (tag == "p" or tag in ARTICLE) and places.get("form"):
            stack[places["form"][-1]].holds += 1 if tag == "p" else RUN
        if tag in VOID or attrs.rstrip().endswith("/") and tag in ("svg", "path", "circle"):
            continue
        if tag in RAW:
            shut = None if f"</{tag}" in scan.gone else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if not shut:
                scan.gone.add(f"</{tag}")
            if not shut and tag in ("title", "textarea"):  # never closed: only the rest of the line is lost
                at = start if (start := scan.find("<", at)) >= 0 else end
            else:
                at = shut.end() if shut else end
            continue
        places.setdefault(tag, []).append(len(stack))
        if tag in FENCES:
            fences.append(len(stack))
        stack.append(child)
    close_to(1)
    return root


def _is_cut(node: Node, in_article: bool) -> bool:
    if node.tag in CUT:
        return node.tag != "form" or node.holds < RUN
    if node.tag == "header" and not in_article:
        return True
    if not node.attrs.strip():
        return False
    names, role = set(), ""
    for name, *values in ATTRIBUTE.findall(node.attrs):
        name, value = name.lower(), next(filter(None, values), "")
        if name in ("class", "id"):
            names |= {w.lower() for w in NAME_WORD.findall(value)}
        elif name == "role":
            role = value.strip().lower()
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return node.tag not in ("html", "body")
    if node.tag in NEVER_CUT:
        return bool(names & READERS) and node.tag not in ("html", "body", "main")
    words = names & CUT_WORDS
    if words == {"header"} and in_article:
        return False  # an article's own heading
    return role in CUT_ROLES or bool(words)


def measure(root: Node) -> list[Node]:
    """Mark what is cut, count letters and linked letters, pass points; the live elements in page order."""
    live, stack = [], [(root, False, False)]
    while stack:
        node, in_article, in_link = stack.pop()
        inside = in_article or node.tag in ARTICLE
        live.append(node)
        for child in reversed(node.children):
            if isinstance(child, Node):
                child.cut = _is_cut(child, inside)
                if not child.cut:
                    stack.append((child, inside, in_link or child.tag == "a"))
    for node in reversed(live):  # children before parents
        own = 0
        for child in node.children:
            if isinstance(child, str):
                own += len(child.strip())
            elif not child.cut:
                node.letters += child.letters
                node.linked += child.letters if child.tag == "a" else child.linked
                node.links += child.links + (child.tag == "a")
        node.letters += own
    for node in live:
        if node.tag in INLINE or node.parent is None:
            continue
        text = _own_text(node)
        if len(text) < 2:
            continue
        density = node.linked / node.letters if node.letters else 0
        points = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - min(density, 1))
        up, far = node if node.tag not in ("p", "li", "td", "pre", "blockquote", *HEADINGS) else node.parent, 1
        while up is not None and up.parent is not None and far <= REACH:
            up.points += points / (1 if far == 1 else 2 * (far - 1))
            up, far = up.parent, far + 1
    return live


def _own_text(node: Node) -> str:
    """The text of a block outside the blocks in it."""
    out, stack = [], list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.cut and x.tag in INLINE:
            stack.extend(reversed(x.children))
    return SPACE.sub(" ", "".join(out)).strip()


def choose(root: Node, live: list[Node]) -> list[Node]:
    """The best container and the siblings that belong to it."""

    def score(n: Node) -> float:
        return n.points * (1 - (n.linked / n.letters if n.letters else 0)) * (PRIOR if n.tag in ARTICLE else 1)

    scored = [n for n in live if n.points > 0 and n.tag not in INLINE]
    if not scored:
        return [root]
    best = max(scored, key=score)  # the first, so the outer, of equals
    top = score(best)
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    kept, before = [], True
    for n in best.parent.children:
        if n is best:
            before = False
            kept.append(n)
        elif isinstance(n, Node) and not n.cut and n.letters:
            plain = 1 - n.linked / n.letters
            if best.tag == "article":
                near = n.tag in ("h1", "h2") and before
            else:
                near = score(n) >= max(3, 0.2 * top) or n.tag in HEADINGS and before or n.tag in ("p", "blockquote", "pre") and plain > 0.7
            if near:
                kept.append(n)
    return kept


def blocks(containers: list[Node]) -> list[str]:
    """The texts of all blocks, in page order."""
    out, run = [], []
    whole = len(containers) == 1 and containers[0].tag in ("#root", "html", "body")

    def flush() -> None:
        text = SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    stack: list = [x for n in reversed(containers) for x in (None, n, None)]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.cut:
            continue
        elif x.tag == "br":
            run.append(" ")
        elif x.tag in INLINE:
            stack.extend(reversed(x.children))
        elif whole and x.tag in ("ul", "ol", "div", "table", "section") and x.links >= 3 and x.linked >= 0.9 * x.letters:
            flush()  # a menu by its looks
        else:
            stack.append(None)
            stack.extend(reversed(x.children))
            stack.append(None)
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    return "\n".join(blocks(choose(root, measure(root))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row, in one pass without a shuffle."""

    def texts(batches):
        for batch in batches:
            for part in rows_of(batch):
                found = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return picked.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
