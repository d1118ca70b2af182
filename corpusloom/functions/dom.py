"""A small document tree over the standard library's HTML tokenizer, and selectors over it.

No element is implied: <p> in <p> nests, an end tag closes up to the nearest open element of its name, and what is open
at the end is closed there. A repeated attribute takes its last value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import escape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(("script", "style", "template"))


class Node:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, parent: Node | None = None) -> None:
        self.name, self.attrs, self.parent, self.children = name, attrs or {}, parent, []

    def get(self, key: str, default: str = "") -> str:
        return self.attrs.get(key, default)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def strings(self) -> Iterator[str]:
        todo: list = list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                yield c
            elif c.name not in SILENT:
                todo.extend(reversed(c.children))

    def text(self, sep: str = " ") -> str:
        """Strings stripped, without empty ones, joined."""
        return sep.join(t for t in (s.strip() for s in self.strings()) if t)

    def find_all(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.name in names]

    def find(self, *names: str) -> Node | None:
        return next((n for n in self.walk() if n.name in names), None)

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def html(self) -> str:
        out: list[str] = []
        stack: list = [self]
        while stack:
            c = stack.pop()
            if isinstance(c, tuple):
                out.append(c[0])
            elif isinstance(c, str):
                out.append(escape(c, quote=False))
            elif c.name == "#root":
                stack.extend(reversed(c.children))
            else:
                a = "".join(f' {k}="{escape(v)}"' for k, v in c.attrs.items())
                out.append(f"<{c.name}{a}/>" if c.name in VOID else f"<{c.name}{a}>")
                if c.name not in VOID:
                    stack.append((f"</{c.name}>",))
                    stack.extend((x,) if isinstance(x, str) and c.name in SILENT else x for x in reversed(c.children))
        return "".join(out)

    def select(self, selector: str) -> list[Node]:
        alts = _compile(selector)
        return [n for n in self.walk() if any(_fits(n, a, self) for a in alts)]

    def select_one(self, selector: str) -> Node | None:
        alts = _compile(selector)
        return next((n for n in self.walk() if any(_fits(n, a, self) for a in alts)), None)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        n = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent is not None and n.name != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


_SIMPLE = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*(?P<flag>[iI])?\s*)?\]|:(?P<pseudo>first-child|last-child|nth-child)(?:\((?P<arg>\d+|odd|even)\))?")


@lru_cache(maxsize=512)
def _compile(selector: str) -> list[list[tuple[str, list[tuple]]]]:
    """Alternatives, each a list of (combinator to the left, tests) from left to right. Supported: tag, *, #id, .class, [attr op value i], :first-child, :last-child, :nth-child(n), descendant, child, comma."""
    out = []
    for alt in re.split(r",(?![^\[]*\])", selector):
        parts: list[tuple[str, list[tuple]]] = []
        comb, i, s = " ", 0, alt.strip()
        while i < len(s):
            if m := re.match(r"\s*([>])\s*|\s+", s[i:]):
                comb = m.group(1) or " "
                i += m.end()
                parts.append((comb, []))
                continue
            m = _SIMPLE.match(s, i)
            if not m:
                raise ValueError(f"selector not supported: {selector}")
            if not parts:
                parts.append((" ", []))
            g = m.groupdict()
            if g["tag"]:
                parts[-1][1].append(("tag", g["tag"].lower()))
            elif g["id"]:
                parts[-1][1].append(("id", g["id"]))
            elif g["cls"]:
                parts[-1][1].append(("cls", g["cls"]))
            elif g["attr"]:
                v = next((g[k] for k in ("dq", "sq", "bare") if g[k] is not None), None)
                parts[-1][1].append(("attr", g["attr"].lower(), g["op"], v, bool(g["flag"])))
            else:
                parts[-1][1].append(("nth", g["pseudo"], g["arg"]))
            i = m.end()
        if parts:
            out.append(parts)
    return out


def _test(n: Node, t: tuple) -> bool:
    if t[0] == "tag":
        return t[1] == "*" or n.name == t[1]
    if t[0] == "id":
        return n.get("id") == t[1]
    if t[0] == "cls":
        return t[1] in n.classes
    if t[0] == "nth":
        kin = [c for c in n.parent.children if isinstance(c, Node)] if n.parent else [n]
        k = next(i for i, c in enumerate(kin, 1) if c is n)
        if t[1] == "first-child":
            return k == 1
        if t[1] == "last-child":
            return k == len(kin)
        return k % 2 == (t[2] == "odd") if t[2] in ("odd", "even") else k == int(t[2])
    _, name, op, want, fold = t
    if name not in n.attrs:
        return False
    if op is None:
        return True
    have = n.attrs[name]
    if fold:
        have, want = have.lower(), want.lower()
    return {"=": have == want, "*=": want in have, "^=": have.startswith(want), "$=": have.endswith(want), "~=": want in have.split(), "|=": have == want or have.startswith(want + "-")}[op]


def _fits(n: Node, parts: list[tuple[str, list[tuple]]], top: Node) -> bool:
    if not all(_test(n, t) for t in parts[-1][1]):
        return False
    if len(parts) == 1:
        return True
    comb, p = parts[-1][0], n.parent
    while p is not None and p is not top.parent and p.name != "#root":
        if _fits(p, parts[:-1], top):
            return True
        if comb == ">":
            return False
        p = p.parent
    return False
