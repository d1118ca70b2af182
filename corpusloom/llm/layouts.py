"""Pages parsed once: each becomes its blocks' flags, keys and tag paths, and the counts that its host needs of it."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.blocks import is_html, squeeze_host
from corpusloom.llm.hostlines import STATS
from corpusloom.llm.mainbody import Layout, finish, title_key
from corpusloom.llm.pages import page_source

_FIELDS = f"kind string, id long, host string, title long, keys array<long>, stats {STATS}, cells binary"


def merged(rows: dict[int, list], more: list[tuple]) -> None:
    """Adds a page's path counts to those of its host."""
    for leaf, around, paragraph, chars, marks, nodes, place in more:
        r = rows.get(leaf)
        if r is None:
            rows[leaf] = [leaf, around, paragraph, chars, marks, nodes, place]
        else:
            r[2] = r[2] and paragraph
            r[3] += chars
            r[4] += marks
            r[5] += nodes
            r[6] += place


def packed(rows: list[tuple[int, int, int, int]]) -> bytes:
    """The numbers of the blocks, field by field, compressed: a page is written once and read twice."""
    return zlib.compress(np.ascontiguousarray(np.array(rows, np.int64).reshape(-1, 4).T).tobytes(), 1)


def page_layouts(pages: DataFrame, extra: str = "", fn: Callable[..., tuple] | None = None, columns: tuple[str, ...] = (), plain: bool = False) -> DataFrame:
    """A row (kind, id, host, title, keys, stats, cells, extra fields) for each page of (kind, id, host, source, columns).

    cells holds the (flags, key, lead-in key, tag path) of the blocks as 64-bit integers, compressed. stats holds the path counts of
    all pages of the host in the batch, on one of its rows: they are combined before anything is shuffled. fn(layout,
    form, *columns) gives the extra fields. Null and empty sources, feeds and JSON give no row; with plain, text without
    any tag is a page of one block.
    """
    st = T._parse_datatype_string(_FIELDS + (", " + extra if extra else ""))
    arrow = to_arrow_schema(st)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = []
            counts: dict[tuple, tuple[int, dict[int, list]]] = {}
            for kind, rid, host, source, *more in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))):
                form, text = page_source(kind, source)
                if not text or form == "html" and not (is_html(text) or plain and text.strip() and text.lstrip("﻿ \t\r\n")[:1] not in "<{["):
                    continue
                h = squeeze_host(host)
                page = Layout(text, form, h)
                at, rows = counts.setdefault((kind, host), (len(out), {}))
                merged(rows, page.stats)
                out.append([kind, rid, host, title_key(page.blocks, h), page.keys(), None, packed(page.rows), *(fn(page, form, *more) if fn else ())])
            for at, rows in counts.values():
                out[at][5] = [dict(zip(("leaf", "around", "paragraph", "chars", "marks", "nodes", "place"), r)) for r in rows.values()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return pages.select("kind", "id", "host", "source", *columns).mapInArrow(run, st)


def hidden(kind: str, cells: bytes, freq: list[int] | None, content: list[int] | None) -> list[bool]:
    """Whether each block of a layout is outside the main body."""
    return finish(np.frombuffer(zlib.decompress(cells), np.int64).reshape(4, -1).T.tolist(), set(freq or ()), set(content or ()), "markdown" if kind == "markdown" else "html")
