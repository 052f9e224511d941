"""Text blocks of web pages by walking their tags: nested and unclosed ones, which patterns can't follow.

The walk keeps a stack of open elements. Elements that can't hold each other close as browsers close them: a paragraph ends where another block begins, an item of a list
or table where the next one begins, and an end tag closes whatever is open inside its element; end tags of nothing are ignored. Text belongs to the
innermost block around it; scripts, styles and templates have none. It runs in Arrow batches, a page at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Of these the next one of the same set ends an open one, unless an element of the second set lies between.
SIBLINGS = [(frozenset(["li"]), frozenset(["ul", "ol", "menu"])), (frozenset(["dt", "dd"]), frozenset(["dl"])), (frozenset(["td", "th"]), frozenset(["tr", "table"])), (frozenset(["tr"]), frozenset(["table", "tbody", "thead", "tfoot"])), (frozenset(["option"]), frozenset(["select", "datalist"]))]
ROWS_OUT = 5_000


class Walker(HTMLParser):
    """Blocks of one page in the order in which they begin: (path of tags, text, links inside)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.at: list[int] = []  # for each open element the block that its text goes to
        self.blocks: list[list] = []

    def _block(self) -> list:
        if not self.at:
            self.blocks.append([">".join(self.open), [], 0])
            return self.blocks[-1]
        return self.blocks[self.at[-1]]

    def _close(self, depth: int) -> None:
        del self.open[depth:], self.at[depth:]

    def _ended_by(self, tag: str) -> None:
        """Close what can't stay open where ``tag`` begins."""
        for same, around in SIBLINGS:
            if tag in same:
                for depth in range(len(self.open) - 1, -1, -1):
                    if self.open[depth] in same:
                        self._close(depth)
                        break
                    if self.open[depth] in around:
                        break
        if tag not in INLINE and tag not in VOID and tag not in SILENT:
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth] == "p":
                    self._close(depth)
                    break
                if self.open[depth] not in INLINE:
                    break

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        self._ended_by(tag)
        inside = self.at[-1] if self.at else None
        self.open.append(tag)
        if tag in INLINE and inside is not None:
            self.at.append(inside)
            self.blocks[inside][2] += tag == "a"
        else:
            self.blocks.append([">".join(self.open), [], int(tag == "a")])
            self.at.append(len(self.blocks) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in VOID:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth] == tag:
                self._close(depth)
                return
            if tag in INLINE and self.open[depth] not in INLINE:
                return  # the end of an inline element leaves the block around it open

    def handle_data(self, data: str) -> None:
        if not SILENT.intersection(self.open):
            self._block()[1].append(data)


def blocks_of(html: str | None) -> list[tuple[str, str, int]]:
    """(path, text, links) of every block that has text; blanks are single."""
    walker = Walker()
    walker.feed(html or "")
    walker.close()
    found = ((path, re.sub(r"\s+", " ", "".join(parts)).strip(), links) for path, parts, links in walker.blocks)
    return [b for b in found if b[1]]


def page_blocks(df: DataFrame, id_: str, html: str) -> DataFrame:
    """``id_`` (a number), ``pos``, ``path``, ``tag``, ``text`` and ``links`` of every block of text of every page; null pages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for key, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held += [(key, pos, path, text, links) for pos, (path, text, links) in enumerate(blocks_of(page))]
                if len(held) >= ROWS_OUT:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)

    rows = df.select(F.col(id_).cast("long"), F.col(html).cast("string")).mapInArrow(run, f"`{id_}` long, pos long, path string, text string, links long")
    return rows.select(id_, "pos", "path", F.element_at(F.split("path", ">"), -1).alias("tag"), "text", "links")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "pos", "path", "text", "links"])
