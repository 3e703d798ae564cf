"""Holding reports landed as HTML: quarter sections, table rows and their derived totals."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from holdscope.functions.parsing import to_float, to_fraction, to_int
from holdscope.functions.text import infer_market, strip
from holdscope.operators.latest import latest_by_max_date
from holdscope.session import ship_package

PERIOD = re.compile(r"\d{4}年\d季度股票投资明细", re.ASCII)
TITLE = re.compile(rf"(?s)<h4[^>]*>(?:(?!</h4>).)*?({PERIOD.pattern}).*?</h4>", re.ASCII)
CUTOFF = re.compile(r"截止至：\s*<font[^>]*>(\d{4}-\d{2}-\d{2})</font>", re.ASCII)
TAG = re.compile(r"<[^>]+>")
#: The common HTML entities as characters; the ampersand goes last.
ENTITIES = (("&nbsp;", "\xa0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
#: Rows and characters of text that a batch gives back at a time, about.
BATCH_ROWS, BATCH_CHARS = 10_000, 4 << 20


def unescape(c: Column) -> Column:
    """The common HTML entities as characters."""
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def plain(c: Column) -> Column:
    """Text without tags, trimmed, entities resolved."""
    return unescape(strip(F.regexp_replace(c, TAG.pattern, "")))


def elements(html: Column, tag: str) -> Column:
    """Inner HTML of every element with this tag, in order."""
    return F.regexp_extract_all(html, F.lit(f"(?s)<{tag}(?:\\s[^>]*)?>(.*?)</{tag}>"), 1)


def quarter_end(year: Column, quarter: Column) -> Column:
    """Last day of a quarter."""
    return F.last_day(F.make_date(year.cast("int"), (quarter.cast("int") * 3), F.lit(1)))


def inner_html(tag: str) -> Callable[[str], list[str]]:
    """``elements`` as a function of one text.

    Most often only blanks stand between elements, and cutting at the closing tags is enough; other texts are matched.
    """
    whole = re.compile(rf"<{tag}(?:\s[^>]*)?>([^<]*+(?:<(?!/{tag}>)[^<]*+)*+)</{tag}>", re.ASCII)
    openings, close = tuple(f"<{tag}{c}" for c in "> \t\n\r\f\v"), f"</{tag}>"

    def found(text: str) -> list[str]:
        out = []
        for piece in text.split(close)[:-1]:
            piece = piece.lstrip()
            end = piece.find(">")
            if end < 0 or not piece.startswith(openings):
                return whole.findall(text)
            out.append(piece[end + 1 :])
        return out

    return found


def plain_text(cell: str) -> str:
    """``plain`` of one text; Python trims the same white space."""
    cell = TAG.sub("", cell) if "<" in cell else cell
    cell = cell.strip()
    if "&" in cell:
        for entity, char in ENTITIES:
            cell = cell.replace(entity, char)
    return cell


def titles_of(page: str) -> list[tuple[int, int, str]]:
    """Begin, end and period of each match of ``TITLE``. Headings that hold no other heading are read one by one."""
    found, at = [], 0
    while (close := page.find("</h4>", at)) >= 0:
        begin = page.find("<h4", at, close)
        at = close + 5
        if begin >= 0:
            text = page.find(">", begin, close) + 1
            if not text or page.find("<h4", begin + 1, close) >= 0:
                return [(m.start(), m.end(), m[1]) for m in TITLE.finditer(page)]
            if period := PERIOD.search(page, text, close):
                found.append((begin, at, period[0]))
    return found


def sections_of(page: str) -> Iterator[tuple[str, str | None, str]]:
    """Title, stated cut-off and following HTML of each section; two control characters, which no page holds as such, go."""
    page = page.replace("\x01", "").replace("\x02", "")
    titles = titles_of(page)
    for i, (_, end, period) in enumerate(titles):
        body = page[end : titles[i + 1][0] if i + 1 < len(titles) else None]
        cutoff = CUTOFF.search(body)
        yield period, cutoff and cutoff[1], body


def cells_of(body: str, rows: Callable, cells: Callable, first: int, least: int) -> Iterator[tuple[int, list[str]]]:
    """Number and plain cells of each table row from number ``first`` that has ``least`` cells."""
    for number, row in enumerate(rows(body)):
        if number >= first:
            found = cells(row)
            if len(found) >= least:
                yield number, [plain_text(c) if "<" in c or "&" in c else c.strip() for c in found]


def each_text(rows: DataFrame, html: str, parse: Callable[[str], Iterator[tuple]], fields: str) -> DataFrame:
    """What ``parse`` finds in each text as ``fields``, with the other columns of its row; a null text has nothing."""
    kept = [c for c in rows.columns if c != html]
    added = StructType.fromDDL(fields)
    schema = StructType([*(rows.schema[c] for c in kept), *added])
    kinds = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
    kinds = [(f.name, kinds[f.dataType.simpleString()]) for f in added]

    def arrow(batch: pa.RecordBatch, at: list[int], found: list[tuple]) -> pa.RecordBatch:
        columns = [batch.column(c).take(pa.array(at, pa.int32())) for c in kept]
        columns += [pa.array(values, kind) for values, (_, kind) in zip(zip(*found), kinds)]
        return pa.RecordBatch.from_arrays(columns, names=[*kept, *(name for name, _ in kinds)])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, chars = [], [], 0
            for i, text in enumerate(batch.column(html).cast(pa.large_binary()).to_pylist()):
                text = (text or b"").decode(errors="replace")
                for item in parse(text):
                    at.append(i)
                    found.append(item)
                chars += len(text)
                if found and (len(found) >= BATCH_ROWS or chars >= BATCH_CHARS):
                    yield arrow(batch, at, found)
                    at, found, chars = [], [], 0
            if found:
                yield arrow(batch, at, found)

    ship_package(rows.sparkSession)
    return rows.select(*kept, html).mapInArrow(step, schema)


def quarter_sections(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per quarter section of each page: title, report date and the section's HTML.

    The date is the stated cut-off, else the quarter's last day. Everything before the first title is not a section.
    """
    rows = each_text(pages, html, sections_of, "report_period string, _stated string, body string")
    # A title begins with the year, one character and the quarter. A cut-off has one form of a date.
    year, quarter = F.substring("report_period", 1, 4), F.substring("report_period", 6, 1)
    return rows.select(
        *[c for c in pages.columns if c != html],
        "report_period",
        year.alias("year"),
        quarter.alias("quarter"),
        F.coalesce(F.col("_stated").try_cast("date"), quarter_end(year, quarter)).alias("report_date"),
        "body",
    )


def cell_rows(
    rows: DataFrame, html: str, row_tag: str = "tr", cell_tag: str = "td", first: int = 0, least: int = 0
) -> DataFrame:
    """Plain cells of every table row, numbered from zero (the header is row zero).

    Rows before number ``first`` and those with fewer than ``least`` cells drop out.
    """
    parse = partial(cells_of, rows=inner_html(row_tag), cells=inner_html(cell_tag), first=first, least=least)
    return each_text(rows, html, parse, "row int, cells array<string>")


def weight_position(cells: Column) -> Column:
    """Zero-based place of the first cell with a percent sign; -1 if none."""
    return F.array_position(F.transform(cells, lambda c: c.contains("%")), True) - 1


def other_numbers(cells: Column, at: Column) -> Column:
    """Numbers after the third cell without the weight cell at ``at``, largest first."""
    others = F.filter(cells, lambda c, i: (i > 2) & (i != at))
    return F.sort_array(F.filter(F.transform(others, to_float), lambda v: v.isNotNull()), asc=False)


def holding_rows(sections: DataFrame, body: str = "body") -> DataFrame:
    """Holdings of each section: the weight is the percent cell, value and shares are the two
    largest other numbers. Rows with fewer than seven cells and header rows drop out.
    """
    rows = cell_rows(sections, body, first=1, least=7)
    kept = [c for c in rows.columns if c not in ("cells", "row")]
    cells, at, numbers = F.col("cells"), F.col("_at"), F.col("_numbers")
    rows = rows.withColumn("_at", weight_position(cells)).withColumn("_numbers", other_numbers(cells, at))
    code = F.get(cells, F.lit(1))
    return rows.select(
        *kept,
        to_int(F.get(cells, F.lit(0))).cast("int").alias("sort_order"),
        code.alias("asset_code"),
        F.get(cells, F.lit(2)).alias("asset_name"),
        F.when(at >= 0, to_fraction(F.get(cells, at.cast("int")))).alias("weight"),
        F.get(numbers, F.lit(1)).alias("share_quantity"),
        F.get(numbers, F.lit(0)).alias("market_value"),
        F.lit("stock").alias("asset_type"),
        infer_market(code).alias("market"),
        F.lit(True).alias("is_top10"),
    )


def allocation_rows(holdings: DataFrame) -> DataFrame:
    """Stock allocation of each product's latest quarter."""
    zero = F.lit(0.0)
    return (
        latest_by_max_date(holdings, ["product_id"], "report_date")
        .groupBy("product_id", "report_date")
        .agg(
            F.lit("stock").alias("asset_class"),
            F.coalesce(F.sum("weight"), zero).alias("weight"),
            F.coalesce(F.sum("market_value"), zero).alias("market_value"),
        )
    )


def summary_rows(holdings: DataFrame) -> DataFrame:
    """Total weight, concentration and count of each product's latest quarter."""
    zero = F.lit(0.0)
    w = F.coalesce("weight", zero)
    return (
        latest_by_max_date(holdings, ["product_id"], "report_date")
        .groupBy("product_id", "report_date")
        .agg(
            F.sum(w).alias("top10_weight"),
            F.sum(w).alias("stock_weight"),
            F.count(F.lit(1)).alias("holding_count"),
            F.sum(w * w).alias("concentration_score"),
        )
    )


def report_dates(products: DataFrame, year: Column, years: int = 3) -> DataFrame:
    """Quarter ends of the last ``years`` calendar years up to ``year`` for every product."""
    first = F.make_date(year - F.lit(years - 1), F.lit(3), F.lit(1))
    last = F.make_date(year, F.lit(12), F.lit(1))
    starts = F.sequence(first, last, F.make_interval(months=F.lit(3)))
    return products.select("*", F.explode(starts).alias("_d")).select(
        *products.columns, F.last_day("_d").alias("report_date")
    )
