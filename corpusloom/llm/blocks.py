"""Pages as sequences of text blocks: one linear pass over HTML source or markdown, without building a tree."""

from __future__ import annotations

import re
from html import unescape

import xxhash

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![a-z][^>]*>|<\?[^>]*>|<(script|style|template|noscript|textarea|svg|head)\b[^>]*>|<(/?)([a-z][a-z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.I | re.S,
)
_ENDS = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "template", "noscript", "textarea", "svg")} | {"head": re.compile(r"</head\s*>|(?=<body\b)|(?=<h1\b)", re.I)}
_COUNTED = re.compile(r"<(?:p|li|h[1-6])(?=[\s/>])", re.I)
_ATTR = re.compile(r"(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_WS = re.compile(r"\s+")
_BLANK = re.compile(r"[\ufeff\s]*")
_NO_PAGE = re.compile(r"<\?xml(?![^>]*>\s*(?:<!--.*?-->\s*)*<(?:!doctype\s+)?html\b)|<rss|<feed|<rdf|[{\[]", re.I | re.S)
_PAGE_TAG = re.compile(r"<(?:html|body|p|div|h1|table)\b", re.I)
_WORD = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"[0-9]+")
#: Characters up to which words of the host's name are masked in a line, so that it is the same line on another host.
LONG = 160
INLINE = frozenset("a abbr b bdi bdo br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr button".split())
CONTAINER = frozenset("html body div section article main aside nav header footer ul ol dl table tbody thead tfoot tr td th form figure blockquote details fieldset dialog".split())
LEAF = frozenset("p li h1 h2 h3 h4 h5 h6 pre dt dd figcaption caption summary address option legend title".split())
POSITIONED = frozenset("p li h1 h2 h3 h4 h5 h6".split())
_TABLEISH = frozenset(("table", "tbody", "thead", "tfoot", "tr", "td", "th"))


class Block:
    """A run of text in one element. path: its containers; box: number of its innermost container; link: characters inside anchors."""

    __slots__ = ("attr", "box", "code", "hide", "key", "link", "path", "pos", "prose", "tag", "text")

    def __init__(self, tag: str, pos: int, path: str, box: int, attr: str) -> None:
        self.tag, self.pos, self.path, self.box, self.attr = tag, pos, path, box, attr
        self.text = self.prose = ""
        self.link, self.code, self.key, self.hide = 0, False, 0, False


def is_html(source: str | None) -> bool:
    """Whether the source is an HTML page, not a feed, JSON or nothing."""
    if not source:
        return False
    s = _BLANK.match(source).end()
    if _NO_PAGE.match(source, s):
        return False
    return source[s : s + 1] == "<" or bool(_PAGE_TAG.search(source, s))


def html_blocks(source: str) -> tuple[str, list[Block], list[tuple[str, int]]]:
    """(title, blocks in source order, boxes as (label, parent)). Start tags p, li, h1-h6 are numbered through the page."""
    title, blocks = "", []
    boxes: list[tuple[str, int]] = [("", -1)]
    stack: list[tuple[str, int]] = [("", 0)]
    paths = {0: ""}
    pos = 0
    leaf: Block | None = None
    parts: list[str] = []
    prose: list[str] = []
    link = in_a = in_code = in_pre = 0

    def flush() -> None:
        nonlocal leaf, link
        if parts:
            raw = "".join(parts)
            text = unescape(raw) if "&" in raw else raw
            flat = _WS.sub(" ", text).strip()
            if flat or leaf is not None and leaf.pos:
                b = leaf
                if b is None or b.text:
                    b = Block("text" if b is None else b.tag, 0 if b is None else b.pos, paths[stack[-1][1]], stack[-1][1], "" if b is None else b.attr)
                    b.code = in_pre > 0
                    blocks.append(b)
                b.text, b.link = flat, link
                p = "".join(prose)
                b.prose = text if p == raw else (unescape(p) if "&" in p else p)
            parts.clear()
            prose.clear()
        link = 0

    def open_leaf(tag: str, n: int, attrs: str) -> None:
        nonlocal leaf
        attr = ""
        if attrs and (m := _ATTR.search(attrs)):
            attr = m.group(2).strip("\"'").lower()
        leaf = Block(tag, n, paths[stack[-1][1]], stack[-1][1], attr)
        leaf.code = in_pre > 0
        blocks.append(leaf)

    at = 0
    search, n_all = _TAG.search, len(source)
    while True:
        m = search(source, at)
        start = m.start() if m else n_all
        if start > at:
            data = source[at:start]
            if parts or not data.isspace():
                parts.append(data)
                if not in_code:
                    prose.append(data)
                if in_a:
                    link += len(data.strip())
        if not m:
            break
        at = m.end()
        skip = m.group(1)
        if skip:
            name = skip.lower()
            e = _ENDS[name].search(source, at)
            inner = source[at : e.start() if e else n_all]
            if name == "head":
                if t := re.search(r"<title[^>]*>(.*?)</title\s*>", inner, re.I | re.S):
                    title = _WS.sub(" ", unescape(t.group(1))).strip()
            elif name == "noscript":
                pos += len(_COUNTED.findall(inner))
            elif name == "textarea":
                pass
            at = e.end() if e else n_all
            continue
        name = m.group(3)
        if name is None:
            continue
        name = name.lower()
        closing = bool(m.group(2))
        if name in INLINE:
            if name == "a":
                in_a = 0 if closing else 1
            elif name == "code" or name == "kbd" or name == "samp":
                in_code = 0 if closing else 1
                if parts:
                    prose.append(" ")
            elif name == "br":
                parts.append("\n")
                prose.append("\n")
            elif name == "img" or name == "input":
                pass
            continue
        if name in LEAF:
            flush()
            if name == "pre":
                in_pre = 0 if closing else 1
            if closing:
                leaf = None
                in_a = in_code = 0
                continue
            in_a = in_code = 0
            if name == "li":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ("ul", "ol"):
                        del stack[k + 1 :]
                        break
            if name in POSITIONED:
                pos += 1
                open_leaf(name, pos, m.group(4))
            else:
                open_leaf(name, 0, m.group(4))
            continue
        if name in CONTAINER:
            flush()
            leaf = None
            in_a = in_code = 0
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
                    if stack[k][0] in ("td", "th", "table") and name not in _TABLEISH and name not in ("body", "html"):
                        break
            else:
                if name in ("td", "th", "tr"):
                    stop = ("tr", "table", "tbody", "thead") if name != "tr" else ("table", "tbody", "thead")
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in stop:
                            del stack[k + 1 :]
                            break
                attrs = m.group(4)
                label = name
                if attrs and len(attrs) > 4:
                    label += "".join("." + v.strip("\"'").lower() for _, v in _ATTR.findall(attrs))
                boxes.append((label, stack[-1][1]))
                b = len(boxes) - 1
                paths[b] = paths[stack[-1][1]] + "/" + label
                stack.append((name, b))
                if name in ("td", "th"):
                    leaf = None
            continue
        flush()
        leaf = None
    flush()
    return title, [b for b in blocks if b.text or b.pos], boxes


_FENCE = re.compile(r"^\s{0,3}(```|~~~)")
_MDLINK = re.compile(r"!?\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\((?:[^()\s]|\([^()]*\))*(?:\s+\"[^\"]*\")?\)")
_BULLET = re.compile(r"^\s{0,3}(?:[-*+]|\d{1,3}[.)])\s+")
_HEAD = re.compile(r"^\s{0,3}(#{1,6})\s+(.*)$")
_CODE = re.compile(r"(`+)(?!`).+?(?<!`)\1(?!`)")
_EMPH = re.compile(r"^(\*\*|__|\*|_)(.+)\1$")


def markdown_blocks(source: str) -> list[Block]:
    """Blocks of a markdown record; pos is the first line, and path the last line, both counted from 1. Consecutive prose lines are one block."""
    blocks: list[Block] = []
    fence = ""
    cur: Block | None = None
    for i, line in enumerate(source.split("\n"), 1):
        if fence:
            b = blocks[-1]
            b.path = str(i)
            if line.strip().startswith(fence):
                fence = ""
            else:
                b.text += "\n" + line
            continue
        s = line.strip()
        if not s:
            cur = None
            continue
        if m := _FENCE.match(line):
            fence = m.group(1)
            cur = None
            b = Block("pre", i, str(i), 0, "")
            b.code = True
            blocks.append(b)
            continue
        if h := _HEAD.match(line):
            tag, body = f"h{len(h.group(1))}", h.group(2).strip()
        elif m := _BULLET.match(line):
            tag, body = "li", line[m.end() :].strip()
        elif s[0] == ">" and s[1:2] in (" ", ">", ""):
            tag, body = "quote", s.lstrip("> ")
        elif s[0] == "|" and s[-1] == "|" and len(s) > 1:
            tag, body = "td", s
        else:
            tag, body = "p", s
        if tag == "p" and cur is not None and cur.tag in ("p", "li", "quote"):
            cur.text += "\n" + body
            cur.path = str(i)
            continue
        b = Block(tag, i, str(i), 0, "")
        b.text = body
        blocks.append(b)
        cur = b if tag in ("p", "li", "quote") else None
    for b in blocks:
        if b.code:
            continue
        b.prose = _CODE.sub(" ", b.text) if "`" in b.text else b.text
        if "](" in b.text:
            b.link = sum(len(m.group(1)) for m in _MDLINK.finditer(b.text))
            b.text = _MDLINK.sub(lambda m: m.group(1), b.text)
    return blocks


def squeeze_host(host: str | None) -> str:
    return re.sub(r"[^a-z0-9]", "", (host or "").lower())


def key_text(text: str, host: str) -> str:
    """Line key for repetition counts: words joined by a blank, runs of digits as 0, words of the host's name masked. Text beyond LONG characters keeps its punctuation and the host's name."""
    low = _DIGITS.sub("0", text.lower())
    if len(low) > LONG:
        return " ".join(low.replace("*", "").replace("_", " ").replace("`", "").split())
    return " ".join(["%" if len(w) > 2 and w in host else w for w in _WORD.findall(low)])


def key_hash(text: str) -> int:
    """64-bit key of a text of words joined by blanks; its low byte is the number of words by four, at most 255."""
    return (xxhash.xxh64_intdigest(text) & ~255 | min(255, text.count(" ") // 4)) - (1 << 63)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())
