"""A small document tree over the standard library's HTML parser, with the selectors that scraper rules use.

Markup that is well formed apart from unclosed p, li and the like gives the expected tree; recovery from other faults
is that of a simple stack.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

from .rules import BOILERPLATE, SCRAPER_DEFAULTS

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSED_BY = {"p": frozenset("p div ul ol table section article h1 h2 h3 h4 h5 h6 blockquote pre footer header nav aside main".split()), "li": frozenset(["li"]), "option": frozenset(["option"])}
MAIN_CHARS, LINK_RATIO = 200, 0.40


class Node:
    __slots__ = ("name", "attrs", "parent", "children", "source")

    def __init__(self, name: str, attrs: dict, parent: Node | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []
        self.source = 0

    def nodes(self) -> Iterator[Node]:
        """All elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def strings(self) -> list[str]:
        out, todo = [], list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                out.append(c)
            else:
                todo += reversed(c.children)
        return out

    def text(self, separator: str = "", strip: bool = False) -> str:
        parts = self.strings()
        return separator.join(s for p in parts if (s := p.strip())) if strip else separator.join(parts)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def size(self) -> int:
        """The length of the element's markup, as written out."""
        total, todo = 0, [self]
        while todo:
            n = todo.pop()
            total += 2 * len(n.name) + 5 + sum(len(k) + len(v or "") + 4 for k, v in n.attrs.items())
            for c in n.children:
                if isinstance(c, str):
                    total += len(c)
                else:
                    todo.append(c)
        return total


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSED_BY.get(self.at.name, ()):
            self.at = self.at.parent or self.root
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag: str) -> None:
        n: Node | None = self.at
        while n is not None and n.name != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = Builder()
    b.feed(html)
    b.close()
    return b.root


_STEP = re.compile(r"""(?P<tag>[a-zA-Z][\w-]*|\*)?(?P<rest>(?:[.#][\w-]+|\[[\w-]+(?:=["']?[^"'\]]*["']?)?\])*)""")
_PART = re.compile(r"""([.#])([\w-]+)|\[([\w-]+)(?:=["']?([^"'\]]*)["']?)?\]""")


@lru_cache(maxsize=4096)
def compile_selector(selector: str) -> list[list[tuple]]:
    """Alternatives of chains of steps (child, tag, tests); child: joined by >."""
    out = []
    for alternative in selector.split(","):
        chain, child = [], False
        for word in re.sub(r"\s*>\s*", " > ", alternative.strip()).split():
            if word == ">":
                child = True
                continue
            m = _STEP.fullmatch(word)
            if not m:
                chain = []
                break
            tests = [(a or "[", b or c, d) for a, b, c, d in _PART.findall(m["rest"])]
            chain.append((child, (m["tag"] or "*").lower(), tests))
            child = False
        if chain:
            out.append(chain)
    return out


def fits(node: Node, tag: str, tests: list) -> bool:
    if tag not in ("*", node.name):
        return False
    for kind, name, value in tests:
        if kind == "." and name not in node.classes():
            return False
        if kind == "#" and node.attrs.get("id") != name:
            return False
        if kind == "[" and (name not in node.attrs or value and node.attrs[name] != value):
            return False
    return True


def chained(node: Node, chain: list[tuple]) -> bool:
    child, tag, tests = chain[-1]
    if not fits(node, tag, tests):
        return False
    if len(chain) == 1:
        return True
    up = node.parent
    while up is not None and up.name:
        if chained(up, chain[:-1]):
            return True
        if child:
            return False
        up = up.parent
    return False


def select(top: Node, selector: str) -> Iterator[Node]:
    chains = compile_selector(selector)
    return (n for n in top.nodes() if any(chained(n, c) for c in chains))


def select_one(top: Node, selector: str) -> Node | None:
    return next(select(top, selector), None)


def prune(top: Node) -> None:
    """Takes boilerplate elements out of the tree."""
    tags = {s for s in BOILERPLATE if s[0] not in ".#"}
    classes, ids = ({s[1:] for s in BOILERPLATE if s[0] == kind} for kind in ".#")
    todo = [top]
    while todo:
        n = todo.pop()
        n.children = [
            c for c in n.children if isinstance(c, str) or not (c.name in tags or classes.intersection(c.classes()) or c.attrs.get("id") in ids)
        ]
        todo += [c for c in n.children if isinstance(c, Node)]


def main_content(top: Node) -> str | None:
    """The text of a page's main element, or of the block of most text and density squared that isn't mostly links."""
    for selector in ("article", "main", '[role="main"]', '[itemprop="articleBody"]', '[itemprop="mainEntity"]'):
        if (found := select_one(top, selector)) is not None:
            return found.text("\n")
    best: tuple[float, str] | None = None
    for n in (select_one(top, "body") or top).nodes():
        if n.name in ("div", "section", "article") and len(text := n.text("\n").strip()) >= MAIN_CHARS:
            links = [len(a.text(strip=True)) for a in n.nodes() if a.name == "a"]
            if links and sum(links) >= LINK_RATIO * len(n.text(strip=True)):
                continue
            score = len(text) * (len(text) / n.size()) ** 2
            if best is None or score > best[0]:
                best = (score, text)
    return best and best[1]


def long_paragraph(art: Node) -> str:
    return next((t for p in select(art, "p") if len(t := p.text(strip=True)) > 20), "")


class Scraper:
    """A source's rules: what its articles are, and for each field the ways to it, of which the first that gives a text counts."""

    def __init__(self, rules: dict):
        told = {k: d if (v := rules.get(k)) is None else v for k, d in SCRAPER_DEFAULTS.items()}
        self.articles, self.title = told["article_selector"], told["title_selector"]
        self.link, self.base = told["link_selector"], told["link_base"].rstrip("/")
        text = lambda selector: lambda art, title: n.text(strip=True) if (n := select_one(art, selector)) else ""
        when = told["date_selector"]
        self.ways: dict[str, tuple[Callable[[Node, Node], str], ...]] = {
            "url": (self.own_link, lambda art, title: self.href(art), lambda art, title: self.href(art.parent)),
            "summary": (text(told["summary_selector"]), lambda art, title: long_paragraph(art)),
            "published_date": (lambda art, title: (n.attrs.get("datetime") or "") if (n := select_one(art, when)) else "", text(when)),
        }

    def href(self, node: Node | None) -> str:
        link = (node.attrs.get("href") or "") if node is not None and node.name == "a" else ""
        return self.base + link if self.base and link.startswith("/") else link

    def own_link(self, art: Node, title: Node) -> str:
        if self.link:
            return self.href(select_one(art, self.link))
        return self.href(title if title.name == "a" else select_one(title, "a"))

    def read(self, html: str) -> Iterator[dict]:
        """title (4 characters at least), url, summary (2000 characters at most), published_date of each article."""
        top = parse(html)
        for art in select(top, self.articles) if self.articles else [top]:
            node = select_one(art, self.title)
            title = node.text(strip=True) if node is not None else ""
            if len(title) >= 4:
                found = {field: next((t for way in ways if (t := way(art, node))), "") for field, ways in self.ways.items()}
                yield {"title": title, **found, "summary": found["summary"][:2000]}


def scrape(html: str, rules: dict) -> list[dict]:
    return list(Scraper(rules).read(html))
