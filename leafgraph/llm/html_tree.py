"""A web page as a flat tree: elements in page order, each with its parent and its items."""

from __future__ import annotations

import re
from html import unescape

import xxhash

# Element names of the HTML standard by their part in this module.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre "
    "search section select summary table tbody td tfoot th thead title tr ul".split()
)
CONTAINERS = frozenset(
    "address aside details dialog div dl fieldset figure footer form header main menu nav ol section table ul".split()
)
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input menu nav noembed noframes noscript "
    "object script select style svg template textarea title video xmp".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {
    "li": ("li", frozenset(("ul", "ol", "menu"))),
    "dt": ("dt dd", frozenset(("dl",))),
    "dd": ("dt dd", frozenset(("dl",))),
    "tr": ("tr td th", frozenset(("table",))),
    "td": ("td th", frozenset(("tr", "table"))),
    "th": ("td th", frozenset(("tr", "table"))),
    "option": ("option", frozenset(("select", "datalist"))),
}
CLOSED_BY = {k: (frozenset(a.split()), b) for k, (a, b) in CLOSED_BY.items()}
P_SCOPE = frozenset("article aside blockquote body button dd div footer header html li main nav object section table td th".split())

# Words of class, id and role that name parts besides the article.
NOT_ARTICLE = frozenset(
    "advert adverts advertisement advertisements adslot ads ad banner breadcrumb breadcrumbs comment comments "
    "commentlist consent cookie cookies copyright disqus disclaimer gdpr login menu modal nav navbar navigation "
    "newsletter notice notices notification pagination pager popup promo promoted promotion recommended related "
    "replies respond share sharebar sharing signup social sponsor sponsored subscribe subscription toolbar".split()
)
LAYOUT = frozenset("footer header masthead sidebar topbar widget widgets complementary contentinfo".split())

TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|$))|<[!?][^>]*+(?:>|$)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>""",
    re.S,
)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def digest(text: str) -> int:
    """A signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Page:
    """tag, parent, attributes and items of every element; an item is a text or a child's number."""

    def __init__(self, html: str):
        self.tags, self.parents, self.attributes, self.items = ["#page"], [-1], [""], [[]]
        self._open = [0]
        self._read(html)

    def _close_to(self, depth: int) -> None:
        del self._open[depth:]

    def _start(self, tag: str, attributes: str, empty: bool) -> None:
        stack, tags = self._open, self.tags
        if tag == "body" and any(tags[n] == "head" for n in stack):
            self._close_to(next(i for i, n in enumerate(stack) if tags[n] == "head"))
        elif tag in CLOSED_BY:
            own, scope = CLOSED_BY[tag]
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] in scope:
                    break
                if tags[stack[i]] in own:
                    self._close_to(i)
        elif tag in BLOCK and tag != "br":
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] == "p":
                    self._close_to(i)
                    break
                if tags[stack[i]] in P_SCOPE:
                    break
        n = len(tags)
        tags.append(tag)
        self.parents.append(stack[-1])
        self.attributes.append(attributes)
        self.items.append([])
        self.items[stack[-1]].append(n)
        if not empty and tag not in VOID:
            stack.append(n)

    def _end(self, tag: str) -> None:
        for i in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[i]] == tag:
                self._close_to(i)
                return

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            stop, m = html.find("<", at), None
            while stop >= 0 and not (m := TOKEN.match(html, stop)):
                stop = html.find("<", stop + 1)
            if stop < 0:
                stop = size
            if stop > at:
                self.items[self._open[-1]].append(unescape(html[at:stop]))
            if not m:
                break
            at = m.end()
            slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if slash:
                self._end(tag)
                continue
            self._start(tag, attributes, attributes.endswith("/"))
            if tag in RAW:
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else size
                self._end(tag)

    def subtrees(self) -> list[int]:
        """A digest of what stands in each element: names and texts, white space evened out."""
        out = [0] * len(self.tags)
        for n in range(len(self.tags) - 1, -1, -1):
            parts = [self.tags[n]]
            for x in self.items[n]:
                if isinstance(x, int):
                    parts.append(f"<{out[x]}>")
                elif text := " ".join(x.split()):
                    parts.append(text)
            out[n] = digest("\x00".join(parts))
        return out

    def has_text(self) -> list[bool]:
        out = [False] * len(self.tags)
        for n in range(len(self.tags) - 1, -1, -1):
            out[n] = self.tags[n] not in RAW and any(out[x] if isinstance(x, int) else not x.isspace() for x in self.items[n])
        return out

    def rules(self) -> tuple[list[bool], list[bool]]:
        """(in an article, not of the article) of each element, by names, classes and roles."""
        tags, parents = self.tags, self.parents
        n_all = len(tags)
        holds = [False] * n_all
        heading = [False] * n_all
        for n in range(n_all - 1, 0, -1):
            holds[parents[n]] |= holds[n] or tags[n] in ("article", "main")
            heading[parents[n]] |= heading[n] or tags[n] in HEADINGS
        inside, out = [False] * n_all, [False] * n_all
        for n in range(1, n_all):
            up, tag, attributes = parents[n], tags[n], self.attributes[n]
            inside[n] = inside[up] or tag == "article"
            if out[up] or tag in DROPPED or (tag == "article" and inside[up]):
                out[n] = True
                continue
            kept_header = inside[up] and heading[n] and not holds[n]
            if tag == "header" and not kept_header and not holds[n]:
                out[n] = True
            elif attributes and tag not in ("html", "body"):
                if HIDDEN.search(attributes):
                    out[n] = True
                    continue
                words = {w.lower() for a in ATTRIBUTE.findall(attributes) for w in WORD.findall(a[1] or a[2] or a[3])}
                if tag in ("article", "main") or "main" in words:
                    out[n] = bool(words & {"comment", "comments"})
                else:
                    out[n] = bool(words & NOT_ARTICLE) and not (holds[n] and not words & {"comment", "comments", "related"})
                    out[n] |= bool(words & LAYOUT) and not holds[n] and not kept_header
        return inside, out


def joined(texts: list[str]) -> str:
    """White space evened out, nothing at the ends."""
    return " ".join("".join(texts).split())
