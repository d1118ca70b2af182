"""Main body of a page: tag paths with their text and punctuation, what a block shows by form, and the decision once the host's counts are known."""

from __future__ import annotations

import re
from functools import lru_cache

from corpusloom.llm.blocks import Block, html_blocks, key_hash, key_text, markdown_blocks

_END = re.compile(r"[.!?…:;。！？][\"'”»’)\]*_`]*\s*$")
_PREFIX = re.compile(r"^([^\W\d_]+(?:[ '’-][^\W\d_]+){0,3})\s?:\s")
_CRUMB = re.compile(r"^[^.!?>»›\n]{1,40}(?:\s*[>»›]\s*[^.!?>»›\n]{1,40}){1,5}$")
_BAR = re.compile(r"^[^.!?|\n]{1,40}(?:\s+[|·•]\s+[^.!?|\n]{1,40}){2,}$")
_INITIAL = re.compile(r"(?:^|[\s.])[^\W\d_]\.[*_]*$")
_RUN = re.compile(r"\d+")
# Words that open a byline in the languages of the data.
_BYLINE = re.compile(r"^(?:by|words|text|texte|par|von|por|written|écrit|geschrieben|escrito)\b", re.I)
_HEADS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Containers that part a page into sections; lists, tables and quotes belong to the section around them.
_SECTION = frozenset("html body div section article main aside nav header footer form dialog details fieldset".split())
_PARAGRAPH = frozenset(("p", "text", "em"))

# flags of a block
HIDE, HEAD, H1, H2, FIXED, EMPTY, CODE, LOCAL, FIRST = 1, 2, 4, 8, 16, 32, 64, 128, 256


def block_keys(b: Block, host: str) -> list[int]:
    """Keys of a block for the repetition counts: its whole text, and the lead-in of a label such as `See also: ...`."""
    if b.code or b.tag in ("td", "pre") or not b.text or b.link >= 0.85 * len(b.text):
        return []
    text = key_text(b.text, host)
    if not text:
        return []
    b.key = key_hash(text)
    keys = [b.key]
    if b.tag in ("p", "quote", "text") and ":" in b.text and not _END.search(b.text[-24:]) and (m := _PREFIX.match(b.text)):
        keys.append(key_hash(key_text(m.group(1), host) + " :"))
    return keys


def parse(source: str, kind: str) -> tuple[str, list[Block], list[tuple[str, int]]]:
    if kind == "html":
        return html_blocks(source)
    blocks = markdown_blocks(source)
    return "", blocks, [("", -1)]


def title_key(blocks: list[Block], host: str) -> int:
    """Key of the page's first heading: copies of one page count once in the repetition counts."""
    return key_hash(key_text(next((b.text for b in blocks if b.tag == "h1" and b.text), ""), host))


_hashes: dict[str, int] = {}


def _path_hash(path: str) -> int:
    h = _hashes.get(path)
    if h is None:
        if len(_hashes) > 200_000:
            _hashes.clear()
        h = _hashes[path] = key_hash(path)
    return h


@lru_cache(maxsize=50_000)
def _masked(label: str) -> str:
    return _RUN.sub("0", label)


def _sections(boxes: list[tuple[str, int]]) -> list[tuple[str, tuple[int, ...]]]:
    """(path, keys of the section paths around, nearest first) of every box; digits in labels are masked."""
    out: list[tuple[str, tuple[int, ...]]] = []
    for label, up in boxes:
        label = _masked(label)
        path, chain = (out[up][0] + "/" + label, out[up][1]) if up >= 0 else (label, ())
        name = label.partition(".")[0]
        if up < 0 or name in _SECTION or name == "td" and "." in label:
            chain = (_path_hash(path), *chain)
        out.append((path, chain))
    return out


def _linked(b: Block) -> bool:
    """Whether the text of a block stands in anchors: all of it, or most where it ends no sentence."""
    size = len(b.text)
    return size > 0 and (b.link >= 0.85 * size or b.link >= 0.5 * size and b.tag in ("p", "text", "quote") and not _END.search(b.text.strip("*_ \t\n")[-24:]))


def leaf_paths(blocks: list[Block], boxes: list[tuple[str, int]], kind: str) -> list[tuple[int, tuple[int, ...], bool]]:
    """(key of the root-to-leaf tag path, keys of the sections around it, whether the leaf is a paragraph) of every block.

    The leaf of a block is `a` where its text stands in anchors, and `em` where all of it is emphasis. Markdown has its outline for a tree: what
    stands before the first heading, under h1, and under the headings below it.
    """
    out = []
    if kind == "html":
        around = _sections(boxes)
        for b in blocks:
            path, chain = around[b.box]
            leaf = f"{path}/{b.tag}.{_masked(b.attr)}" if b.attr else f"{path}/{b.tag}"
            anchor = _linked(b)
            out.append((_path_hash(leaf + "/a" if anchor else leaf), chain, anchor or b.tag in _PARAGRAPH and (bool(b.attr) or not b.text or b.tag == "text")))
        return out
    section, chain = "#", (_path_hash("#"),)
    levels: list[str] = []
    for b in blocks:
        if b.tag in _HEADS:
            while levels and levels[-1] >= b.tag:
                levels.pop()
            levels.append(b.tag)
            section = "#" + "/".join(levels)
            chain = tuple(_path_hash("#" + "/".join(levels[:k])) for k in range(len(levels), -1, -1))
        tag = b.tag
        if tag == "p" and b.text[:1] in "*_" and b.text.rstrip()[-1:] == b.text[:1]:
            tag = "em"
        anchor = _linked(b)
        out.append((_path_hash(f"{section}/{tag}/a" if anchor else f"{section}/{tag}"), chain, anchor or tag in _PARAGRAPH))
    return out


def path_stats(blocks: list[Block], paths: list[tuple[int, tuple[int, ...], bool]]) -> list[tuple]:
    """Per tag path of a page: characters, punctuation marks, nodes, and the sum of the nodes' places on the page from 0 to 1."""
    rows: dict[int, list] = {}
    n = max(1, len(blocks))
    for i, (b, (leaf, chain, paragraph)) in enumerate(zip(blocks, paths)):
        r = rows.get(leaf)
        if r is None:
            r = rows[leaf] = [chain, paragraph, 0, 0, 0, 0.0]
        if b.text and not b.code:
            r[2] += len(b.text)
            count = b.text.count
            r[3] += count(".") + count(",") + count(";") + count(":") + count("?") + count("!")
        r[4] += 1
        r[5] += i / n
    return [(k, *r) for k, r in rows.items()]


def structure(blocks: list[Block], boxes: list[tuple[str, int]], kind: str, host: str, paths: list[tuple[int, tuple[int, ...], bool]]) -> list[tuple[int, int, int, int]]:
    """(flags, key, lead-in key, tag path) of every block: what links and form say, before the host's counts are known. A key of 0 is none.

    LOCAL marks the section that holds most of the page's own text: it stands in where none of the host's content paths
    occurs on the page.
    """
    if not blocks:
        return []
    first = next((i for i, b in enumerate(blocks) if b.tag == "h1" and b.text), None)
    weight: dict[int, int] = {}
    for b, (_, chain, _) in zip(blocks, paths):
        weight[chain[0]] = weight.get(chain[0], 0) + len(b.text) - b.link
    local = max(weight, key=lambda k: (weight[k], k))
    out = []
    for i, b in enumerate(blocks):
        flags = (HEAD if b.tag in _HEADS else 0) | (H1 if b.tag == "h1" else 0) | (H2 if b.tag == "h2" else 0) | (0 if b.text else EMPTY) | (CODE if b.code else 0)
        leaf, chain, _ = paths[i]
        if chain[0] == local:
            flags |= LOCAL
        hide = False
        k1 = k2 = 0
        if i == first:
            flags |= FIXED | FIRST
        elif b.code or b.tag in ("td", "h1"):
            flags |= FIXED
        elif b.text:
            keys = block_keys(b, host)
            k1, k2 = (*keys, 0, 0)[:2]
            text = b.text.strip("*_ \t\n")
            if not text:
                pass
            elif b.tag in ("p", "text", "quote") and (
                (">" in text or "»" in text or "›" in text) and _CRUMB.match(text) or ("|" in text or "·" in text or "•" in text) and _BAR.match(text)
            ):
                hide = True
            elif b.tag in ("p", "text") and first is not None and i == first + 1 and text.count(" ") < 14 and "\n" not in text and (
                not _END.search(text[-24:]) or _INITIAL.search(text) or b.attr or text.count(" ") < 6 and _BYLINE.match(text)
            ):
                hide = True
            elif b.tag == "p" and b.attr and text.count(" ") < 14 and not _END.search(text[-24:]):
                hide = True
        out.append((flags | (HIDE if hide else 0), k1, k2, leaf))
    return out


def finish(rows: list[tuple[int, int, int, int]], frequent: set[int], content: set[int], kind: str) -> list[bool]:
    """Whether each block is outside the main body, given the host's repeated keys and the tag paths that hold content there.

    The page's own first h1 belongs to it wherever it stands.
    """
    n = len(rows)
    known = any(leaf in content and not f & (EMPTY | HEAD) for f, _, _, leaf in rows)
    hide = [
        not f & FIRST and (not (leaf in content if known else f & LOCAL) or bool(f & HIDE) or not f & (H2 | FIXED) and (k1 in frequent or k2 in frequent))
        for f, k1, k2, leaf in rows
    ]
    shown = hidden = 0  # a heading whose section holds nothing but hidden blocks belongs to them
    for i in range(n - 1, -1, -1):
        f, k1, k2, _ = rows[i]
        if f & HEAD:
            if not f & H1 and not hide[i] and not shown and hidden and (not f & H2 or k1 in frequent or k2 in frequent):
                hide[i] = True
            shown = hidden = 0
        elif hide[i]:
            hidden += 1
        elif not f & EMPTY:
            shown += 1
    if kind == "html":  # an element without text of its own follows the block after it
        for i in range(n - 2, -1, -1):
            if rows[i][0] & EMPTY and not hide[i]:
                hide[i] = hide[i + 1]
    return hide


class Layout:
    """A parsed page: its blocks with flags, keys and tag paths, and what the host's counts need of it."""

    __slots__ = ("blocks", "boxes", "host", "rows", "stats", "title")

    def __init__(self, source: str, form: str, host: str) -> None:
        self.host = host
        self.title, self.blocks, self.boxes = parse(source, form)
        paths = leaf_paths(self.blocks, self.boxes, form)
        self.stats = path_stats(self.blocks, paths)
        self.rows = structure(self.blocks, self.boxes, form, host, paths)

    def keys(self) -> list[int]:
        return list({k for _, k1, k2, _ in self.rows for k in (k1, k2) if k})
