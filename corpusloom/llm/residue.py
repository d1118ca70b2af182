"""Markup left standing in prose, after subtrees and lines recurring across a host are deleted; and text cleaned of it."""

from __future__ import annotations

import re
from html import unescape

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import Block, is_html, key_hash, squeeze_host
from corpusloom.llm.hostlines import repeated_keys, with_sets
from corpusloom.llm.mainbody import block_keys, parse, title_key
from corpusloom.llm.pages import page_source
from corpusloom.operators.arrow import map_rows
from corpusloom.session import materialize

#: Unfilled slots of templates, in the notations of common template languages.
PLACEHOLDER = re.compile(
    r"\{\{[#/^>&]?\s*[\w.]+(?:\s+[\w.]+)?\s*\}\}|\{%.*?%\}|<%=?.*?%>|[$#]\{[\w.]+\}|%\(\w+\)[sdif]|(?<![\w{}_^\\])\{\d\}(?!\{)|__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__"
    r"|%%[A-Z_]+%%|@@[A-Z_]+@@|<[A-Z]{2,}(?: [A-Z]{2,})+>|\[(?:INSERT|YOUR|ADD|ENTER|TITLE|NAME|TEXT|IMAGE)\b[A-Z ]*\]|\[\*\w+\*\]|\[object Object\]|\b(?:TODO|FIXME):"
)
# Element names that count as HTML.
_NAMES = "a|abbr|article|aside|b|big|blockquote|body|br|center|cite|code|dd|del|div|dl|dt|em|figcaption|figure|font|footer|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|li|link|main|mark|meta|nav|ol|option|p|pre|q|s|script|section|select|small|span|strike|strong|style|sub|sup|table|tbody|td|tfoot|th|thead|time|title|tr|tt|u|ul|var|video"
HTML_TAG = re.compile(rf"</?(?:{_NAMES})(?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s<>\"']+)))*\s*/?>|<!--.*?-->|<!--", re.I | re.S)
HTML_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,20});")
WIKI = re.compile(
    r"\[\[[^\[\]\n]+(?:\n[^\[\]\n]+)?\]\]|\{\{\s*[\w:./-]+(?:\s+[\w:./-]+)*\s*\|[^{}]*\}\}|^\s*(={2,6})[ \t]*[^=\s][^=]*?\1\s*$|\{\|[^\n]*(?:\n|$)|\[(?:https?|ftp)://[^\s\]]+\s+[^\]]+\]|'''?[^'\n]+'''?(?=\W|$)|__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__",
    re.M,
)
LATEX = re.compile(
    r"\\[A-Za-z]{2,}\*?\s?(?:\[[^\]\n]*\])?\{|\\begin\{|\\end\{|\$\$[^$]+\$\$|\$[^$\n]*(?:\\[A-Za-z]+|[A-Za-z0-9]\s*[_^]\s*\{?[A-Za-z0-9])[^$\n]*\$|\\\([^\n]+?\\\)|\\\[[^\n]+?\\\]|~\\[a-z]+\{"
)
MARKDOWN = re.compile(
    r"^[ \t]*#{1,6}[ \t]+\S|(?<![*\w])\*{2,3}(?=[^\s*])[^*\n]*[^\s*]\*{2,3}(?![*\w])|(?<!\w)__(?=[^\s_])(?:[^_\n]|_(?!_))*[^\s_]__(?!\w)|(?<![`\w])`+[^`\n]+`+(?![`\w])"
    r"|!?\[[^\]\[\n]+\]\([^()\s]+(?:\s+\"[^\"]*\")?\)|~~(?=\S)[^~\n]+~~|\[\^\w+\]|^[ \t]*[*+-][ \t]+\S|^[ \t]*```|^\|?[ \t]*:?-{3,}:?[ \t]*\||(?<![*\w])\*(?=[^\s*])[^*\n]*[^\s*]\*(?![*\w])|^>[ \t]\S",
    re.M,
)


def markup_kinds(prose: str, form: str) -> list[str]:
    """Kinds of markup standing as literal text in prose of an html or markdown page."""
    flat = " ".join(prose.split()) if "\n" in prose else prose  # hard wraps fall inside markup
    if "{" in prose or "[" in prose or "_" in prose or "<" in prose or "%" in prose or "@" in prose or "TODO" in prose:
        flat = PLACEHOLDER.sub(" ", flat)
        prose = PLACEHOLDER.sub(" ", prose)
    out = []
    if ("[" in prose or "{" in prose or "==" in prose or "''" in prose) and (WIKI.search(prose) or WIKI.search(flat)):
        out.append("wiki")
    if ("\\" in prose or "$" in prose) and LATEX.search(flat):
        out.append("latex")
    if ("<" in prose and HTML_TAG.search(prose)) or ("&" in prose and HTML_ENTITY.search(prose)):
        out.append("html")
    if form == "html" and MARKDOWN.search(WIKI.sub(" ", prose) if "wiki" in out else prose):
        out.append("markdown")
    return out


def subtree_keys(blocks: list[Block], boxes: list[tuple[str, int]], host: str, form: str) -> tuple[list[int], list[list[int]]]:
    """(key of each block's own element, keys of the subtrees around it).

    A subtree's key is the hash of its root's tag and attributes and of its children in source order, each child a
    block with its tag, attribute and text or a subtree of its own; digits are masked. In markdown a heading is the root
    of what follows it up to the next heading of its rank. The low byte holds the number of words by four.
    """
    if form == "markdown":
        boxes, places, levels = [("", -1)], [], [("", 0)]
        for b in blocks:
            if b.tag[0] == "h" and b.tag[1:].isdigit():
                while len(levels) > 1 and levels[-1][0] >= b.tag:
                    levels.pop()
                boxes.append((b.tag, levels[-1][1]))
                levels.append((b.tag, len(boxes) - 1))
            places.append(levels[-1][1])
    else:
        places = [b.box for b in blocks]
    own: list[int] = []
    parts: list[list] = [[] for _ in boxes]
    size = [0] * len(boxes)
    attached = [i == 0 for i in range(len(boxes))]
    chains: list[list[int]] = []
    for b, at in zip(blocks, places):
        block_keys(b, host)
        k = b.key or key_hash(b.text)
        own.append(k)
        parts[at].append(f"{b.tag}.{b.attr}:{k}")
        chain, i, n = [], at, b.text.count(" ") + 1 if b.text else 0
        while i > 0:
            chain.append(i)
            size[i] += n
            up = boxes[i][1]
            if not attached[i]:
                attached[i] = True
                parts[up].append(i)
            i = up
        chains.append(chain)
    keys = [0] * len(boxes)
    for i in range(len(boxes) - 1, 0, -1):  # children are numbered after their parents
        if parts[i]:
            inner = "|".join(str(keys[x]) if isinstance(x, int) else x for x in parts[i])
            keys[i] = (xxhash.xxh64_intdigest(f"<{_DIGIT_RUN.sub('0', boxes[i][0])}>{inner}") & ~255 | min(255, size[i] // 4)) - (1 << 63)
    return own, [[keys[i] for i in c] for c in chains]


_ROW = "kind string, id long, host string, title long, keys array<long>, residue array<struct<k:long,boxes:array<long>,m:string>>, cells array<struct<k:long,boxes:array<long>,t:string>>"


def residue_records(pages: DataFrame, texts: bool = False) -> DataFrame:
    """Each page's subtree keys, the markup found in its prose and, where wanted, its cleaned blocks; the only pass over the sources."""

    def one(kind, rid, host, source):  # noqa: ANN001, ANN202
        form, text = page_source(kind, source)
        if not text or form == "html" and not is_html(text):
            return []
        h = squeeze_host(host)
        _, blocks, boxes = parse(text, form)
        own, around = subtree_keys(blocks, boxes, h, form)
        found, cells = [], []
        for b, k, s in zip(blocks, own, around):
            if not b.code and b.prose and b.tag != "td":
                found.extend({"k": k, "boxes": s, "m": m} for m in markup_kinds(b.prose, form))
            if texts and b.text:
                cells.append({"k": k, "boxes": s, "t": _rendered(b, form)})
        keys = {b.key for b in blocks if b.key} | {k for s in around for k in s}
        return [(kind, rid, host, title_key(blocks, h), list(keys), found, cells)]

    return map_rows(pages.select("kind", "id", "host", "source"), _ROW, one)


def _without_recurring(pages: DataFrame, texts: bool) -> DataFrame:
    """Records with freq, the keys of the lines and subtrees that recur across their host."""
    rows = materialize(residue_records(pages, texts))
    often = repeated_keys(rows.select("kind", "host", "title", "keys")).groupBy("kind", "host").agg(F.collect_set("key").alias("freq"))
    some = rows if texts else rows.where(F.size("residue") > 0)
    return with_sets(some.drop("keys", "title"), often).withColumn("freq", F.coalesce("freq", F.array().cast("array<long>")))


def _own(cells: str) -> F.Column:
    """The entries that lie in no recurring subtree or line."""
    return F.filter(cells, lambda r: ~F.array_contains("freq", r["k"]) & ~F.arrays_overlap(r["boxes"], F.col("freq")))


def markup_residue(pages: DataFrame) -> DataFrame:
    """(kind, id, markup): kinds of markup that stand as text in the prose of a page's own content.

    Subtrees and lines that recur across a host are deleted first. Code samples, placeholders and table cells are no
    prose. Null or empty sources, feeds, and page_data that is no JSON give no rows; rows delivered twice count once.
    """
    x = _without_recurring(pages, False)
    return x.select("kind", "id", F.explode(F.array_distinct(F.transform(_own("residue"), lambda r: r["m"]))).alias("markup")).distinct()


_WIKI_LINK = re.compile(r"\[\[(?:(?:File|Image|Datei|Fichier|Archivo):[^\[\]|]*(?:\|[^\[\]|]*)*?\|?([^\[\]|]*)|(?:Category|Kategorie|Catégorie|Categoría):[^\[\]]*|(?:[^\[\]|]*\|)?([^\[\]|]*))\]\]")
_DIGIT_RUN = re.compile(r"\d+")
_TEX_KEEP = re.compile(r"\\(?:textbf|textit|emph|section|subsection|footnote|text|underline)\*?\{([^{}]*)\}")


def clean_text(text: str) -> str:
    """Prose without the markup named above, keeping the words, and formulas as they stand between their dollar signs."""
    t = _WIKI_LINK.sub(lambda m: m.group(1) or m.group(2) or "", text)
    t = re.sub(r"\{\{\s*[\w:./ -]+\|[^{}]*\}\}|\{\|[^\n]*|^\|[-}].*$", "", t, flags=re.M)
    t = re.sub(r"\[(?:https?|ftp)://[^\s\]]+\s+([^\]]+)\]", r"\1", t)
    t = re.sub(r"^\s*(={2,6})[ \t]*([^=\n]+?)[ \t]*\1\s*$", lambda m: "#" * len(m.group(1)) + " " + m.group(2), t, flags=re.M)
    t = re.sub(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1", t)
    t = _TEX_KEEP.sub(r"\1", t)
    t = re.sub(r"~?\\(?:cite|ref|label)\{[^{}]*\}", "", t)
    t = re.sub(r"\\(?:begin|end)\{(?:itemize|enumerate)\}", "", t)
    t = re.sub(r"[ \t]*\\item[ \t]+", "\n- ", t)
    t = HTML_TAG.sub("", t)
    t = HTML_ENTITY.sub(lambda m: unescape(unescape(m.group(0))), t)
    return re.sub(r"[ \t ​]+", " ", t).strip()


def _rendered(b: Block, form: str) -> str:
    if b.code:
        return "```\n" + b.prose.strip("\n") + "\n```" if form == "html" else "```" + b.text + "\n```"
    lead = "#" * int(b.tag[1]) + " " if b.tag[0] == "h" and b.tag[1:].isdigit() else "- " if b.tag == "li" else "> " if b.tag in ("quote", "blockquote") else ""
    return lead + clean_text(b.text)


def clean_documents(pages: DataFrame) -> DataFrame:
    """(kind, id, text, markup): clean text with headings as #, lists as -, code blocks fenced and formulas kept, without recurring subtrees; pages of which nothing is left give no row."""
    x = _without_recurring(pages, True)
    text = F.array_join(F.transform(_own("cells"), lambda r: r["t"]), "\n\n")
    kinds = F.array_sort(F.array_distinct(F.transform(_own("residue"), lambda r: r["m"])))
    return x.select("kind", "id", text.alias("text"), kinds.alias("markup")).where("text <> ''").dropDuplicates(["kind", "id"])
