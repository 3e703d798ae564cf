"""Text and code expressions: markets, names, labels and number formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from holdscope.functions import constants as C

# All Unicode white space: ASCII blanks and separators, no-break, typographic and full-width.
_SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)


def strip(c: Column) -> Column:
    """Trim all Unicode white space, not only ASCII blanks."""
    return F.btrim(c, F.lit(_SPACES))


def lookup(c: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, NULL when the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def label(c: Column, table: dict[str, str]) -> Column:
    """Code to label: unknown codes pass through, empty becomes a dash."""
    return F.when(c.isNull() | (c == ""), F.lit("—")).otherwise(F.coalesce(lookup(c, table), c))


def _prefix_chain(code: Column, start: Column | None = None) -> Column:
    for market, prefixes in C.MARKET_PREFIXES:
        hit = code.rlike("^(" + "|".join(prefixes) + ")")
        start = F.when(hit, market) if start is None else start.when(hit, market)
    return start


def infer_market(code: Column) -> Column:
    """Market from a security code: prefixes first, then five characters mean HK."""
    c = strip(code)
    return _prefix_chain(c).when(F.length(c) == 5, "HK").otherwise("UNKNOWN")


def infer_market_web(code: Column, any_letter: bool = False) -> Column:
    """Market from a code as the browse layer sees it: five digits and letters come first.

    ``any_letter`` also takes non-Latin letters as a US ticker.
    """
    c = strip(code)
    letters = r"^\p{L}{1,5}$" if any_letter else "^[A-Za-z]{1,5}$"
    start = (
        F.when(code.isNull() | (code == ""), "UNKNOWN")
        .when(c.rlike("^[0-9]{5}$"), "HK")
        .when(c.rlike(letters), "US")
    )
    return _prefix_chain(c, start).otherwise("UNKNOWN")


def bundle_key(market: Column) -> Column:
    """Index bundle of an inferred market."""
    return F.when(market.isin("SH", "SZ", "BJ"), "domestic").otherwise(F.lower(market))


def kline_prefix(market: Column) -> Column:
    """Source prefix of a market; NULL when the source does not carry it."""
    return lookup(F.upper(strip(market)), C.KLINE_PREFIX)


def market_region(market: Column) -> Column:
    return F.when(F.upper(strip(market)) == "HK", "hk").otherwise("domestic")


def market_currency(market: Column) -> Column:
    return F.when(F.upper(market) == "HK", "HKD").otherwise("CNY")


def symbol_code(code: Column, market: Column) -> Column:
    """Quote symbol of a security."""
    return F.concat(F.upper(market), code)


def strip_exchange(symbol: Column) -> Column:
    """Bare security code of a quote symbol; HK and short symbols stay as they are."""
    return F.when(F.length(symbol) >= 6, F.regexp_replace(symbol, "^(SH|SZ|BJ)", "")).otherwise(symbol)


def base_name(name: Column) -> Column:
    """Product family name: the share-class letter at the end is dropped."""
    return strip(F.regexp_replace(strip(name), "(?iU)" + C.SHARE_CLASS, ""))


def has_share_class(name: Column) -> Column:
    return strip(name).rlike("(?iU)" + C.SHARE_CLASS)


def _shorten(name: Column, suffixes: tuple[str, ...]) -> Column:
    cut = F.regexp_replace(strip(name), "(?U)\\s*(" + "|".join(suffixes) + ")$", "")
    return F.when(cut == "", name).otherwise(cut)


def shorten_industry(name: Column) -> Column:
    """Industry name without one trailing level mark."""
    return _shorten(name, C.INDUSTRY_SUFFIXES)


def shorten_industry_report(name: Column) -> Column:
    """Report form: banks get one readable name, digits stay."""
    plain = strip(name)
    return F.when(plain.isin(*C.BANK_INDUSTRIES), C.BANK_LABEL).otherwise(
        _shorten(plain, C.REPORT_INDUSTRY_SUFFIXES)
    )


def cluster_label(industries: Column, max_pieces: int = 3, min_weight: float = 0.05) -> Column:
    """Readable label from ``array<struct<industry, weight>>`` in weight order; NULL if none fits."""
    usable = F.filter(
        industries,
        lambda x: x["industry"].isNotNull()
        & (x["industry"] != "")
        & (x["industry"] != C.UNKNOWN_INDUSTRY)
        & (F.coalesce(x["weight"], F.lit(0.0)) >= min_weight),
    )
    names = F.array_distinct(F.transform(usable, lambda x: shorten_industry(x["industry"])))
    joined = F.array_join(F.slice(names, 1, max_pieces), " + ")
    return F.when(joined != "", joined)


def display_label(stored: Column, derived: Column, cluster_id: Column) -> Column:
    """Stored label, else derived, else the cluster number."""
    blank = F.nullif(stored, F.lit(""))
    return F.coalesce(blank, derived, F.concat(F.lit("簇 #"), cluster_id.cast("string")))


def label_source(stored: Column, derived: Column) -> Column:
    return (
        F.when(F.nullif(stored, F.lit("")).isNotNull(), "stored")
        .when(derived.isNotNull(), "industries")
        .otherwise("id")
    )


def fixed(c: Column, digits: int) -> Column:
    """A number with a fixed count of decimals and no grouping."""
    return F.format_string(f"%.{digits}f", c.cast("double"))


def money_text(c: Column) -> Column:
    """Money with ten-thousand and hundred-million units."""
    v = c.cast("double")
    a = F.abs(v)
    return (
        F.when(v.isNull(), "—")
        .when(a >= 1e8, F.concat(fixed(v / 1e8, 2), F.lit("亿")))
        .when(a >= 1e4, F.concat(fixed(v / 1e4, 2), F.lit("万")))
        .when(a >= 1, fixed(v, 2))
        .otherwise(fixed(v, 4))
    )


def amount_text(c: Column) -> Column:
    """Browse-page amount: units for large values, grouping for the rest."""
    v = c.cast("double")
    return (
        F.when(v.isNull(), "—")
        .when(v >= 1e8, F.concat(fixed(v / 1e8, 2), F.lit("亿")))
        .when(v >= 1e4, F.concat(fixed(v / 1e4, 2), F.lit("万")))
        .otherwise(F.format_number(v, 2))
    )


def price_text(c: Column) -> Column:
    return F.when(c.isNull(), "—").otherwise(F.format_number(c.cast("double"), 4))


def percent_text(c: Column, scale: float = 1.0) -> Column:
    """Percent with two decimals; ``scale`` 100 shows a fraction, 1 shows the stored number."""
    return F.when(c.isNull(), "—").otherwise(F.concat(fixed(c * F.lit(scale), 2), F.lit("%")))


def volume_text(c: Column, unit: Column) -> Column:
    """Volume with unit word."""
    v = c.cast("double")
    word = F.coalesce(lookup(unit, C.VOLUME_UNITS), F.lit(""))
    number = (
        F.when(F.abs(v) >= 1e8, F.concat(fixed(v / 1e8, 2), F.lit("亿")))
        .when(F.abs(v) >= 1e4, F.concat(fixed(v / 1e4, 2), F.lit("万")))
        .otherwise(F.format_number(v, 0))
    )
    return F.when(v.isNull(), "—").otherwise(F.concat(number, word))


def truncate(c: Column, n: int = 60) -> Column:
    """At most ``n`` characters, the last one an ellipsis when cut."""
    return (
        F.when(c.isNull() | (c == ""), "")
        .when(F.length(c) <= n, c)
        .otherwise(F.concat(F.substring(c, 1, n - 1), F.lit("…")))
    )


def date_text(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("—"))


def contains_any(c: Column, words: tuple[str, ...]) -> Column:
    """True when the text holds any of the words."""
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words], F.lit(False))


def match_any(columns: list[Column], keyword: str) -> Column:
    """Case-insensitive substring over several columns; ``%`` and ``_`` keep their LIKE meaning."""
    pattern = f"%{keyword.strip()}%"
    return reduce(lambda a, b: a | b, [c.ilike(pattern) for c in columns])
