"""Main content of pages: tag-path ratios, aggregated per host, select the content paths; host repetition removes the template lines inside them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.blocks import POSITIONED
from corpusloom.llm.hostlines import host_sets, with_sets
from corpusloom.llm.layouts import hidden, page_layouts
from corpusloom.operators.arrow import map_rows
from corpusloom.session import materialize


def _decided(pages: DataFrame, extra: str, fn) -> DataFrame:  # noqa: ANN001
    layouts = materialize(page_layouts(pages, extra, fn))
    return with_sets(layouts.drop("keys", "stats", "title"), host_sets(layouts.select("kind", "host", "title", "keys", "stats")))


def boilerplate_positions(pages: DataFrame) -> DataFrame:
    """(kind, id, pos) of what is outside the main body: line numbers of markdown, numbers of p, li and h1-h6 elements of html.

    Pages with null or empty source, feeds and JSON give no rows; a page on which none of its host's content paths
    occurs keeps the section with most of its text; texts are processed whole. Rows delivered twice give their positions once.
    """

    def places(page, form):  # noqa: ANN001, ANN202
        if form == "html":
            spans = [(b.pos if b.tag in POSITIONED else 0, b.pos) for b in page.blocks]
        else:
            spans = [(b.pos, int(b.path)) for b in page.blocks]
        return (np.array(spans, np.int32).tobytes(),)

    def one(kind, rid, spans, cells, freq, content):  # noqa: ANN001, ANN202
        spans = np.frombuffer(spans, np.int32).reshape(-1, 2).tolist()
        out = {p for h, (a, b) in zip(hidden(kind, cells, freq, content), spans) if h and a for p in range(a, b + 1)}
        return [(kind, rid, sorted(out))] if out else []

    found = map_rows(_decided(pages, "spans binary", places).select("kind", "id", "spans", "cells", "freq", "content"), "kind string, id long, pos array<int>", one)
    return found.dropDuplicates(["kind", "id"]).select("kind", "id", F.explode("pos").alias("pos"))


def main_content(pages: DataFrame) -> DataFrame:
    """(kind, id, title, text): the main body alone, blocks joined by blank lines; pages without one give no row."""

    def one(kind, rid, head, texts, cells, freq, content):  # noqa: ANN001, ANN202
        body = "\n\n".join(t for t, h in zip(texts, hidden(kind, cells, freq, content)) if t and not h)
        return [(kind, rid, head, body)] if body else []

    layouts = _decided(pages, "head string, texts array<string>", lambda page, form: (page.title, [b.text for b in page.blocks]))
    rows = layouts.select("kind", "id", "head", "texts", "cells", "freq", "content")
    return map_rows(rows, "kind string, id long, title string, text string", one).dropDuplicates(["kind", "id"])
