"""Positioned text items into lines, wrap margins per indentation, and sections of blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioscope.functions import text as T
from folioscope.session import cut_lineage, partitions

# Sizes, gaps and tolerances in points.
TITLE_SIZE, HEADING_SIZE, H2_SIZE, BODY_SIZE = 20, 12, 14, 10.5
PARAGRAPH_GAP, TITLE_GAP, HEADING_GAP, CELL_GAP = 20, 35, 25, 12
SAME_LINE = 3
BODY_LEFT, LIST_INDENT = 50, 30
MARGIN_TOLERANCE, MEASURED_TOLERANCE = 20, 10
WRAP_LINES, NARROWER_BY = 20, 10

# Print headers and footers, and paths of sources.
HEADER = r"^\d{1,2}/\d{1,2}/\d{2}, \d{1,2}:\d{2} [AP]M .*handbook\z"
FOOTER = r"^file:///\S+ \d+/\d+\z"
SOURCE_PATH = r"^contents/handbook/\S+\.md\z"
NUMBERED = r"^\d+[.)][" + T.SPACE + "]"
LINE = "doc_id string, page int, line_ord int, y double, x double, right double, size double, text string"


@F.pandas_udf(StringType())
def normalize_text(text: pd.Series) -> pd.Series:
    """NFKC, which Spark has no function for."""
    return text.str.normalize("NFKC")


def lines_from_items(items: DataFrame) -> DataFrame:
    """``doc_id, page, line_ord, y, x, right, size, text`` of ``items`` (doc_id, page, item_ord, str, x, y, size, width).

    From the top, an item joins the open line if it is within SAME_LINE of the line's first item; items of a line run
    from left to right, a wide gap separating table cells.  Blank items are left out.  A page is one small group.
    """
    shown = items.where(T.trim(F.col("str")) != "").select(
        "doc_id", "page", F.struct((-F.col("y")).alias("up"), "x", "item_ord", "y", "str", "size", "width").alias("item")
    )
    shown = shown.repartition(partitions(items.sparkSession), "doc_id", "page")  # folding costs more than the bytes suggest
    pages = shown.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list("item")).alias("items"))
    start = F.struct(
        F.lit(0).alias("at"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("starts")
    )

    def cluster(s: Column, item: Column) -> Column:
        # Only the start of a line makes the state grow.
        at = (s["at"] + 1).cast("int").alias("at")
        opened = F.struct(at, item["y"].alias("anchor"), F.concat(s["starts"], F.array(s["at"])).alias("starts"))
        same = F.abs(s["anchor"] - item["y"]) <= SAME_LINE
        return F.when(same, F.struct(at, s["anchor"].alias("anchor"), s["starts"].alias("starts"))).otherwise(opened)

    numbered = (
        pages.withColumn("starts", F.aggregate("items", start, cluster)["starts"])
        .select("doc_id", "page", "starts", F.posexplode("items").alias("at", "items"))
        .select("doc_id", "page", (F.size(F.filter("starts", lambda x: x <= F.col("at"))) - 1).alias("line"), "items")
    )
    lines = numbered.groupBy("doc_id", "page", F.col("line").alias("line_ord")).agg(
        F.min_by("items", F.struct("items.up", "items.x", "items.item_ord")).alias("top"),
        F.sort_array(F.collect_list(F.struct("items.x", "items.up", "items.item_ord", "items.str", "items.width"))).alias("run"),
        F.max(F.col("items.x") + F.col("items.width")).alias("right"),
        F.min("items.size").alias("size"),
    )
    empty = F.struct(F.lit("").alias("text"), F.lit(None).cast("double").alias("right"))

    def join(s: Column, item: Column) -> Column:
        gap = item["x"] - s["right"]
        open_end, open_start = s["text"].rlike(f"[{T.SPACE}]\\z"), item["str"].rlike(f"^[{T.SPACE}]")
        before = (
            F.when(gap > CELL_GAP, F.concat(T.trim_end(s["text"]), F.lit(" | ")))
            .when((gap > 1) & ~open_end & ~open_start, F.concat(s["text"], F.lit(" ")))
            .otherwise(s["text"])
        )
        return F.struct(F.concat(before, item["str"]).alias("text"), (item["x"] + item["width"]).alias("right"))

    joined = lines.withColumn("text", F.aggregate("run", empty, join)["text"])
    return joined.select(
        "doc_id",
        "page",
        "line_ord",
        F.col("top.y").alias("y"),
        F.col("run")[0]["x"].alias("x"),
        "right",
        "size",
        T.collapse(normalize_text("text")).alias("text"),
    )


def is_page_chrome(text: Column) -> Column:
    """Print headers and footers, also where cells were separated."""
    bare = F.replace(text, F.lit(" | "), F.lit(" "))
    return bare.rlike(HEADER) | bare.rlike(FOOTER)


def indent_margins(lines: DataFrame) -> DataFrame:
    """Per document and indentation: where its lines wrap, and whether that is clearly before the page's margin.

    The margin is the value at position floor((n - 1) * 0.99) of the sorted right ends, read off their counts; it needs
    WRAP_LINES lines.  Headings, small print and numbered items don't count for an indentation.
    """
    body = lines.where(F.col("size") < HEADING_SIZE).select("doc_id", "right", F.floor(F.col("x") + 0.5).cast("int").alias("indent"), "size", "text")
    page = body.groupBy("doc_id").agg(F.max("right").alias("page_margin"))
    counted = body.where((F.col("size") >= BODY_SIZE) & ~F.col("text").rlike(NUMBERED))
    counts = counted.groupBy("doc_id", "indent", "right").count()
    upto = Window.partitionBy("doc_id", "indent").orderBy("right").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("count").over(Window.partitionBy("doc_id", "indent"))
    running = counts.withColumns({"upto": F.sum("count").over(upto), "lines": total})
    at = running.where(F.col("upto") > F.floor((F.col("lines") - 1) * 0.99)).groupBy("doc_id", "indent").agg(
        F.max("lines").alias("lines"), F.min("right").alias("margin")
    )
    narrower = (F.col("lines") >= WRAP_LINES) & (F.col("margin") <= F.col("page_margin") - NARROWER_BY)
    return at.join(page, "doc_id").withColumn("is_narrower", narrower)


def document_margins(lines: DataFrame) -> DataFrame:
    """``doc_id, page_margin, own``: where a document's lines wrap, and the indentations (indent, margin) that wrap clearly before it."""
    body = lines.where((F.col("size") < HEADING_SIZE) & F.col("doc_id").isNotNull())
    page = body.groupBy("doc_id").agg(F.max("right").alias("page_margin"))
    own = indent_margins(lines).where("is_narrower").groupBy("doc_id").agg(F.collect_list(F.struct("indent", "margin")).alias("own"))
    return page.join(own, "doc_id", "left")


def list_level(x: Column, text: Column) -> Column:
    return (
        F.when(x >= BODY_LEFT + LIST_INDENT * 0.8, F.floor((x - BODY_LEFT) / LIST_INDENT + 0.5))
        .when(text.rlike(NUMBERED), 1)
        .otherwise(0)
        .cast("int")
    )


BLOCK = (
    "doc_id string, section int, section_title string, section_path string, block_ord int, kind string, level int, "
    "list_level int, text string, page int, continued boolean"
)


class _Parser:
    """The state of one document's pass over its lines; emits blocks once nothing can join them any more."""

    def __init__(self, doc_id: str) -> None:
        self.doc_id, self.section, self.title, self.path = doc_id, -1, "", ""
        self.page_margin, self.own = 0.0, {}
        self.titles: list = []
        self.previous = self.anchor = None
        self.block: list | None = None
        self.number = 0

    def close(self) -> list[tuple]:
        done = [] if self.block is None else [(self.doc_id, self.section, self.title, self.path, self.number, *self.block)]
        self.number += len(done)
        self.block = None
        return done

    def open(self, *block) -> list[tuple]:
        done = self.close()
        self.block = list(block)
        return done

    def measure(self, page_margin: float | None, own: list | None) -> None:
        """Take the document's margins, which come before its lines."""
        self.page_margin = 0.0 if page_margin is None else page_margin
        self.own = {r["indent"]: r["margin"] for r in (own if own is not None else [])}

    def edge(self, line) -> float:
        """Where a line ends that is full: its margin, measured for its indentation, else the page's, less a tolerance."""
        own = None if line.numbered or pd.isna(line.x) else self.own.get(math.floor(line.x + 0.5))
        return self.page_margin - MARGIN_TOLERANCE if own is None else own - MEASURED_TOLERANCE

    def wraps(self, line, gap: float | None) -> bool:
        """Whether the line goes on with the open paragraph."""
        before = self.previous
        if self.block is None or self.block[0] != "paragraph" or self.anchor is None or before.size >= HEADING_SIZE:
            return False
        if line.numbered or line.x < self.anchor - 3:
            return False
        width = (line.right - line.x) / max(len(line.text), 1)
        if before.right + width * (len(line.text.split(" ")[0]) + 1) <= self.edge(before):
            return False  # the first word would have fitted: the break was meant
        if gap is not None:
            return gap < PARAGRAPH_GAP
        bulleted = self.block[2] > 0 and not self.block[6]
        return not before.finished and (not bulleted or not line.starts_item)

    def take(self, line) -> list[tuple]:
        out: list[tuple] = []
        before = self.previous
        gap = before.y - line.y if before is not None and before.page == line.page else None
        if line.size >= TITLE_SIZE:
            self.titles = [*self.titles, line] if self.titles and gap is not None and gap < TITLE_GAP else [line]
            self.anchor = None
        elif line.is_path and self.titles:
            out += self.close()
            self.section, self.number = self.section + 1, 0
            self.title, self.path = " ".join(t.text for t in self.titles), line.text
            self.titles, self.anchor = [], None
        elif self.section >= 0:
            if self.titles:
                text = " ".join(t.text for t in self.titles)
                if text.lower() != self.title.lower():
                    out += self.open("heading", 1, 0, text, self.titles[0].page, None, False)
                self.titles = []
            if line.size >= HEADING_SIZE:
                level = 2 if line.size >= H2_SIZE else 3
                same = self.block is not None and self.block[:2] == ["heading", level] and before.size == line.size
                if same and gap is not None and gap < HEADING_GAP:
                    self.block[3] = _joined(self.block[3], line.text)
                else:
                    out += self.open("heading", level, 0, line.text, line.page, None, False)
                self.anchor = None
            elif self.wraps(line, gap):
                if gap is not None:
                    self.block[3] = _joined(self.block[3], line.text)
                else:
                    level, numbered = self.block[2], self.block[6]
                    out += self.open("paragraph", None, level, line.text, line.page, True, numbered and line.numbered)
            else:
                out += self.open("paragraph", None, line.list_level, line.text, line.page, None, line.numbered)
                self.anchor = line.x
        self.previous = line
        return out


def _joined(before: str, after: str) -> str:
    return before + after if before[-1:] == "-" and before[-2:-1].isascii() and before[-2:-1].isalnum() else f"{before} {after}"


def section_blocks(lines: DataFrame) -> DataFrame:
    """Sections of heading and paragraph blocks from the lines of documents (columns as of ``lines_from_items``).

    Title-size lines followed by a source path start a section; without one they are a level-1 heading, unless they
    repeat the section's title.  Lines before the first section are dropped, print headers and footers too.  Each
    document is read once, in order, as a sorted stream that its margins lead: only they and the open block are held.
    """
    content = cut_lineage(lines.where(~is_page_chrome(F.col("text"))))  # read by the margins and by the parser
    margins = document_margins(content)
    marked = content.select(
        "doc_id", F.lit(False).alias("is_margin"), "page", "line_ord", "y", "x", "right", "size", "text",
        F.col("text").rlike(NUMBERED).alias("numbered"),
        F.col("text").rlike(SOURCE_PATH).alias("is_path"),
        F.col("text").rlike(r"[.!?:][\"')]?\z").alias("finished"),
        F.col("text").rlike(r"^(?:\p{Lu}|https?://|\S*_)").alias("starts_item"),
        list_level(F.col("x"), F.col("text")).alias("list_level"),
    ).unionByName(margins.select("doc_id", F.lit(True).alias("is_margin"), F.col("page_margin").alias("right"), "own"), allowMissingColumns=True)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser: _Parser | None = None
        columns = [c.split()[0] for c in BLOCK.split(", ")]
        for batch in batches:
            out: list[tuple] = []
            for line in batch.itertuples(index=False):
                if parser is None or parser.doc_id != line.doc_id:
                    out += parser.close() if parser else []
                    parser = _Parser(line.doc_id)
                if line.is_margin:
                    parser.measure(line.right, line.own)
                else:
                    out += parser.take(line)
            yield _frame(out, columns)
        if parser is not None:
            yield _frame(parser.close(), columns)

    ordered = marked.repartition("doc_id").sortWithinPartitions("doc_id", F.desc("is_margin"), "page", "line_ord")
    return ordered.mapInPandas(parse, BLOCK)


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame([r[:11] for r in rows], columns=columns)
    return frame.astype({"level": "Int32", "list_level": "Int32", "continued": "boolean"})


def laid_out(blocks: DataFrame) -> DataFrame:
    """Blocks as positioned text items, to run the layout operators over the given tables.

    Every paragraph is a document page of its own; its words stand four to a line, each 5.5 points a character wide.
    A line sinks a little from word to word, every other line so much that its fourth word is no more on it.
    """
    held = blocks.where("section_id is not null and kind = 'paragraph' and text is not null").dropDuplicates(["section_id", "block_ord"])
    words = F.posexplode(F.filter(F.split(T.collapse(F.col("text")), " "), lambda w: w != "")).alias("item_ord", "str")
    each = held.select(F.col("section_id").alias("doc_id"), F.col("block_ord").alias("page"), "list_level", words)
    column = F.pmod("item_ord", F.lit(4))
    left = BODY_LEFT + LIST_INDENT * F.coalesce("list_level", F.lit(0))
    line = F.floor(F.col("item_ord") / 4)
    sunk = column * F.when(line % 2 == 1, 1.1).otherwise(0.9)
    return each.select(
        "doc_id",
        "page",
        "item_ord",
        "str",
        (left + column * 120).cast("double").alias("x"),
        ((700 - 16 * line).cast("double") - sunk).alias("y"),
        F.lit(11.0).alias("size"),
        F.least(F.length("str") * 5.5, F.lit(115.0)).cast("double").alias("width"),
    )


def section_pages(blocks: DataFrame) -> DataFrame:
    """``section_id, start_page, end_page``: the first and last page that each section has a block on."""
    return (
        blocks.where("section_id is not null")
        .groupBy("section_id")
        .agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"))
    )


def section_lines(sections: DataFrame, blocks: DataFrame, across: int = 8) -> DataFrame:
    """Sections as the lines of a printed document each, to run the section parser over the given tables.

    A title and a path open the document; headings are larger print; paragraphs have ``across`` words to a line, with
    the gaps, indents and right ends of print.  Blocks without a text, page or section are left out.  Numbers of lines
    (long here) rise down the page, with gaps.
    """
    named = sections.where("section_id is not null and path is not null and start_page is not null").dropDuplicates(["section_id"])
    # Spaces at the ends are plain ones after the first replacement; sections are joined first, so that dropping repeats needs no shuffle.
    shown = blocks.where("section_id is not null and text is not null and page is not null").where(F.col("text").rlike(f"[^{T.SPACE}]"))
    held = shown.join(named.select("section_id"), "section_id", "left_semi").dropDuplicates(["section_id", "block_ord"])
    held = held.withColumn("bare", F.trim(F.regexp_replace("text", f"[{T.SPACE}]+", " ")))
    # Each text is taken apart by one pattern: an expression over the words inside a lambda would be computed for every line.
    printed = F.regexp_extract_all("bare", F.lit(rf"[^ ]+(?: [^ ]+){{0,{across - 1}}}"), F.lit(0))
    size = F.when(F.col("kind") != "heading", 11.0).when(F.coalesce("level", F.lit(3)) <= 2, 15.0).otherwise(13.0)
    left = BODY_LEFT + LIST_INDENT * F.coalesce("list_level", F.lit(0))
    body = held.select(
        F.col("section_id").alias("doc_id"), "page", "block_ord", size.alias("size"), left.cast("double").alias("x"),
        F.when(F.col("kind") == "heading", F.array("bare")).otherwise(printed).alias("rows"),
    ).withColumn("lines", F.size("rows")).select("doc_id", "page", "block_ord", "size", "x", "lines", F.posexplode("rows").alias("at", "text"))
    full = (F.col("at") < F.col("lines") - 1) & (F.col("size") < HEADING_SIZE)
    body = body.select(
        "doc_id", "page", F.col("block_ord").alias("a"), F.col("at").alias("b"), "x", "size", "text",
        F.when(full, 560.0).otherwise(F.least(F.lit(560.0), F.col("x") + 5.5 * F.length("text"))).alias("right"),
    )
    lead = named.select(
        F.col("section_id").alias("doc_id"),
        F.col("start_page").alias("page"),
        F.inline(
            F.array(
                F.struct(F.lit(-2).alias("a"), F.lit(22.0).alias("size"), F.coalesce("title", F.lit("Untitled")).alias("text")),
                F.struct(F.lit(-1).alias("a"), F.lit(8.5).alias("size"), F.col("path").alias("text")),
            )
        ),
    ).select("doc_id", "page", "a", F.lit(0).alias("b"), F.lit(float(BODY_LEFT)).alias("x"), "size", "text", F.lit(300.0).alias("right"))
    # Down the page: a line's height within a block, a paragraph's gap between blocks.
    every = lead.unionByName(body)
    top = (F.col("a") + 3) * 4000.0 + F.col("b") * 16.0
    number = (F.col("a") + 3).cast("long") * (1 << 32) + F.col("b")
    return every.select("doc_id", "page", number.alias("line_ord"), (-top).alias("y"), "x", "right", "size", "text")
