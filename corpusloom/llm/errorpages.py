"""Error pages, script notices, filler and unfinished templates among page records."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import key_hash, key_text, words_of
from corpusloom.llm.hostlines import host_sets, with_sets
from corpusloom.llm.layouts import hidden, page_layouts
from corpusloom.llm.mainbody import EMPTY, H1
from corpusloom.llm.pages import host_of
from corpusloom.llm.residue import PLACEHOLDER
from corpusloom.operators.arrow import map_rows
from corpusloom.session import materialize

#: A body is low in information under so many words, or under this part of the host's median.
LOW, PART = 30, 0.2
#: Different addresses under one title, and different titles over one body, that make it a shared one.
ADDRESSES, TITLES = 3, 2
#: Letters of a term that is compared, and terms compared of a heading or an address.
TERM, TERMS = 4, 24
#: Words of filler that make a paragraph filler, and their least share.
FILLER_WORDS, FILLER_SHARE = 8, 0.75

# The words of the usual Latin filler, and words programmers put in the place of real ones.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
STAND_INS = frozenset("foo bar baz qux quux bla blah blub dummy test sample text xyz".split())
# The rows of a keyboard, the alphabet and the digits, along which filler is typed.
_RUNS = ("qwertyuiop", "qwertzuiop", "azertyuiop", "asdfghjkl", "zxcvbnm", "yxcvbnm", "abcdefghijklmnopqrstuvwxyz", "1234567890")
_PAIRS = frozenset(p for r in _RUNS for a, b in zip(r, r[1:]) for p in (a + b, b + a)) | frozenset(c + c for c in "abcdefghijklmnopqrstuvwxyz0123456789")
_MAY_HOLD = re.compile(r"[{%$@<\[]|__|TODO|FIXME")


def typed_along(word: str) -> bool:
    """Whether a word of three letters or more runs along a keyboard row, the alphabet or one key."""
    return len(word) >= 3 and all(a + b in _PAIRS for a, b in zip(word, word[1:]))


def is_filler(text: str) -> bool:
    """Whether a paragraph is filler: Latin filler, or keyboard runs and stand-in words, by their share of its words."""
    w = words_of(text)
    if len(w) < FILLER_WORDS:
        return False
    return sum(x in LOREM for x in w) >= FILLER_SHARE * len(w) or sum(x in STAND_INS or typed_along(x) for x in w) >= FILLER_SHARE * len(w)


def address_words(url: str | None) -> list[str]:
    path = re.sub(r"^[a-z]+://[^/]*", "", url or "", flags=re.I).split("?")[0].split("#")[0].rstrip("/")
    return [w for w in words_of(re.sub(r"\.[a-z]{2,5}$", "", path.rsplit("/", 1)[-1])) if not w.isdigit()]


def _terms(words: list[str]) -> list[str]:
    return list(dict.fromkeys(w for w in words if len(w) >= TERM and not w.isdigit()))[:TERMS]


def page_signs(pages: DataFrame) -> DataFrame:
    """What each page shows of placeholders and of its heading's and address's terms, block by block: the only pass over the sources. pages: (kind, id, host, url, status, source)."""

    def signs(page, form, url, status):  # noqa: ANN001, ANN202
        head = next((b.text for b in page.blocks if b.tag == "h1" and b.text), page.title)
        own = words_of(head)
        said, named = _terms(own), _terms(address_words(url))
        bits = [(t, 1 << i) for i, t in enumerate(said)] + [(t, 1 << (TERMS + i)) for i, t in enumerate(named)]
        rows = []
        for b, (f, k, _, _) in zip(page.blocks, page.rows):
            mark = cover = size = body = 0
            if not f & EMPTY:
                if not b.code and b.prose and (_MAY_HOLD.search(b.prose) and PLACEHOLDER.search(" ".join(b.prose.split())) or is_filler(b.text)):
                    mark = 1
                if not f & H1:
                    low = b.text.lower()
                    size = low.count(" ") + low.count("\n") + 1
                    body = k or key_hash(key_text(low, page.host))
                    for t, bit in bits:
                        if t in low:
                            cover |= bit
            rows.append((mark, size, body, cover))
        address = key_hash(re.split(r"[?#]", url or "")[0].rstrip("/"))
        return np.array(rows, np.int64).tobytes(), bool(PLACEHOLDER.search(page.title)), bool(said), bool(named), key_hash(" ".join(own)) if own else 0, address, status

    extra = "signs binary, marked boolean, said boolean, named boolean, head long, address long, status int"
    return page_layouts(pages, extra, signs, ("url", "status"), plain=True)


def unusable_pages(pages: DataFrame) -> DataFrame:
    """(kind, id, reason): records to drop. reason is template, or message.

    template: an unfilled placeholder or a filler paragraph stands in the title or prose. message: the main body holds
    little against the pages of its host, and it names no term of its heading or of its address, or its heading stands
    over ADDRESSES addresses or its text under TITLES headings, or the response failed; or, at any length, the body names
    no term of heading and address and the heading stands over many addresses. Empty sources, feeds and JSON give no
    rows; text without any tag is a page of one block; rows delivered twice count once.
    """
    rows = materialize(page_signs(pages))
    sets = host_sets(rows.select("kind", "host", "title", "keys", "stats"))
    x = with_sets(rows.drop("keys", "stats", "title"), sets)

    def one(kind, rid, host, signs, cells, marked, said, named, head, address, status, freq, content):  # noqa: ANN001, ANN202
        hide = hidden(kind, cells, freq, content)
        shown = [r for r, h in zip(np.frombuffer(signs, np.int64).reshape(-1, 4).tolist(), hide) if not h]
        cover = 0
        for r in shown:
            cover |= r[3]
        heads, names = cover & ((1 << TERMS) - 1), cover >> TERMS
        body = hash(tuple(r[2] for r in shown if r[2]))
        return [(kind, rid, host, marked or any(r[0] for r in shown), sum(r[1] for r in shown), heads == 0, named and names == 0, body, head, address, (status or 0) >= 400)]

    c = map_rows(
        x.select("kind", "id", "host", "signs", "cells", "marked", "said", "named", "head", "address", "status", "freq", "content"),
        "kind string, id long, host string, template boolean, size int, unsaid boolean, unnamed boolean, body long, head long, address long, failed boolean",
        one,
    )
    c = materialize(c.dropDuplicates(["kind", "id"]))
    usual = c.groupBy("kind", "host").agg(F.percentile_approx("size", 0.5, 100).alias("usual")).select(F.col("kind").alias("_k"), F.col("host").alias("_h"), "usual")
    over = c.where("head <> 0").select("kind", "head", "address").distinct().groupBy("kind", "head").agg(F.count("*").alias("addresses")).where(F.col("addresses") >= ADDRESSES)
    under = c.select("kind", "body", "head").distinct().groupBy("kind", "body").agg(F.count("*").alias("heads")).where(F.col("heads") >= TITLES)
    x = c.join(usual, (F.col("kind") == F.col("_k")) & F.col("host").eqNullSafe(F.col("_h")), "left").drop("_k", "_h")
    x = x.join(over, ["kind", "head"], "left").join(under, ["kind", "body"], "left")
    low = F.col("size") < F.greatest(F.lit(LOW), PART * F.col("usual"))
    shared = F.col("addresses").isNotNull()
    message = low & (F.col("unsaid") | F.col("unnamed") | shared | F.col("heads").isNotNull() | F.col("failed")) | F.col("unsaid") & F.col("unnamed") & shared
    return x.withColumn("message", message).where(F.col("template") | F.col("message")).select("kind", "id", F.when(F.col("message"), "message").otherwise("template").alias("reason"))


def signed_pages(page_store: DataFrame, page_markdown: DataFrame) -> DataFrame:
    """page_store.html and page_markdown.markdown in the form page_signs takes."""
    a = page_store.select(F.lit("html").alias("kind"), F.col("page_id").alias("id"), F.coalesce("host", host_of()).alias("host"), "url", F.col("status_code").alias("status"), F.col("html").alias("source"))
    b = page_markdown.select(F.lit("markdown").alias("kind"), F.col("page_id").alias("id"), F.coalesce("host", host_of()).alias("host"), "url", F.lit(None).cast("int").alias("status"), F.col("markdown").alias("source"))
    return a.unionByName(b)
