"""Product lists landed as JSON: field picks, classification and the unified schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdscope.functions import constants as C
from holdscope.functions.parsing import to_date, to_float
from holdscope.functions.text import contains_any, lookup, strip
from holdscope.operators.skew import attach
from holdscope.sources.writes import first_per_key

# Source field of each column. (kind, field): text, number, date.
FIELDS: dict[str, dict[str, tuple[str, str]]] = {
    "BOC": {
        "product_code": ("text", "productCode"),
        "product_name": ("text", "productName"),
        "unit_nav": ("number", "shareNetWorth"),
        "cumulative_nav": ("number", "cumulativeNetWorth"),
        "nav_date": ("date", "releaseDate"),
        "risk_text": ("text", "riskLevel"),
        "min_purchase_amount": ("number", "startsPrice"),
    },
    "JX": {
        "product_code": ("text", "ivsmpdEcd"),
        "product_name": ("text", "fndNm"),
        "unit_nav": ("number", "accFxMrgnNetval"),
        "cumulative_nav": ("number", "accFxMrgnNetval"),
        "nav_date": ("date", "drivDt"),
        "establish_date": ("date", "opdt"),
        "maturity_date": ("date", "exdt"),
        "risk_text": ("text", "csdcFndRskGrdCd"),
        "performance_benchmark": ("text", "fndPerfcmprbssAmt"),
        "min_purchase_amount": ("number", "pertxnNumLwrlmtVal"),
        "product_type_raw": ("text", "fndIvsDrcCd"),
    },
    "CEB": {
        "product_code": ("text", "prodRegCode"),
        "product_name": ("text", "prodName"),
        "risk_text": ("text", "prodRiskLevelName"),
        "product_type_raw": ("text", "prodOperateModeName"),
        "registration_code": ("text", "prodRegCode"),
        "org_name": ("text", "orgName"),
    },
    "CITIC": {
        "product_code": ("text", "prodCode"),
        "product_name": ("text", "prodName"),
        "product_short_name": ("text", "prodNameShort"),
        "risk_text": ("text", "riskLevel"),
        "product_type_raw": ("text", "profitTypeStr"),
        "product_sub_type": ("text", "respProductTypeStr"),
        "establish_date": ("date", "establishDateStr"),
        "unit_nav": ("number", "nav"),
        "cumulative_nav": ("number", "totalNav"),
        "nav_date": ("date", "navDate"),
        "performance_benchmark": ("text", "benchmarks"),
        "min_purchase_amount": ("number", "minSubsP"),
        "min_additional_amount": ("number", "minApplyP"),
    },
    "ZY": {
        "product_code": ("text", "prdCode"),
        "product_name": ("text", "prdName"),
        "product_short_name": ("text", "prdBrief"),
        "unit_nav": ("number", "netValue"),
        "establish_date": ("date", "beginDate"),
        "maturity_date": ("date", "expireDate"),
        "risk_text": ("text", "risk"),
        "performance_benchmark": ("text", "rateDes"),
        "min_purchase_amount": ("number", "initMoney"),
        "product_type_raw": ("text", "style"),
        "registration_code": ("text", "regCode"),
    },
    "SPD": {
        "product_code": ("text", "PRDC_CD"),
        "product_name": ("text", "PRDC_NM"),
        "risk_text": ("text", "RISK_GRADE"),
        "product_type_raw": ("text", "PRDC_TYP"),
        "product_status": ("text", "PRDC_STT"),
        "registration_code": ("text", "PRDC_RGST_CD"),
        "currency": ("text", "RS_CRRN"),
    },
}
# The NAV list of the source whose products and NAVs come apart.
SPD_NAV_FIELDS = {
    "product_code": ("text", "REAL_PRD_CODE"),
    "unit_nav": ("number", "NAV"),
    "cumulative_nav": ("number", "TOT_NAV"),
    "nav_date": ("date", "ISS_DATE"),
}
# Sources whose dates are not cut to ten characters before parsing.
FULL_DATE_SOURCES = ("JX", "SPD")
ORG_FILTER = {"CEB": "光大理财"}

UNIFIED = (
    "institution_type", "institution_name", "institution_code", "product_code", "product_name",
    "product_short_name", "product_type", "product_sub_type", "registration_code", "sales_code",
    "establish_date", "maturity_date", "risk_level", "risk_level_standard", "currency", "manager",
    "custodian", "fund_manager", "investment_target", "investment_scope", "investment_strategy",
    "performance_benchmark", "benchmark_type", "min_purchase_amount", "min_additional_amount", "status",
    "data_source", "collect_date",
)


def fund_rows(lists: DataFrame, payload: str = "payload") -> DataFrame:
    """Fund lists (a JSON array of cell arrays) to rows; rows with fewer than eight cells drop."""
    cells = F.from_json(F.col(payload), "array<array<string>>")
    rows = lists.select(
        *[c for c in lists.columns if c != payload], F.posexplode(cells).alias("arrival", "_c")
    ).filter(F.size("_c") >= 8)

    def cell(i: int) -> Column:
        return F.get(F.col("_c"), F.lit(i))

    numbers = {
        "unit_nav": 5, "cumulative_nav": 6, "daily_return": 7,
        "return_1m": 10, "return_3m": 11, "return_6m": 12, "return_1y": 13,
    }
    return rows.select(
        *[c for c in rows.columns if c != "_c"],
        cell(0).alias("product_code"),
        cell(1).alias("product_name"),
        cell(2).alias("product_type_raw"),
        *[to_float(cell(i)).alias(name) for name, i in numbers.items()],
    )


def picked_fields(
    rows: DataFrame, fields: Mapping[str, tuple[str, str]], payload: str = "payload", first_ten: bool = True
) -> DataFrame:
    """JSON objects to typed columns by a field table."""
    schema = ", ".join(sorted({f"`{f}` STRING" for _, f in fields.values()}))
    obj = rows.withColumn("_o", F.from_json(F.col(payload), schema))
    kinds = {"text": lambda c: c, "number": to_float, "date": lambda c: to_date(c, first_ten)}
    return obj.select(
        *[c for c in rows.columns if c != payload],
        *[kinds[kind](F.col(f"_o.`{field}`")).alias(name) for name, (kind, field) in fields.items()],
    )


def bank_rows(rows: DataFrame, source: str, payload: str = "payload", arrival: str = "arrival") -> DataFrame:
    """Product rows of a bank feed.

    Keeps rows of the wanted organisation where the feed mixes several, and the first arrival
    of each product code where the feed repeats codes.
    """
    out = picked_fields(rows, FIELDS[source], payload, source not in FULL_DATE_SOURCES)
    if source in ORG_FILTER:
        out = out.filter(F.col("org_name").contains(ORG_FILTER[source])).drop("org_name")
    if source == "ZY":
        out = out.withColumn("product_name", F.coalesce(F.nullif("product_name", F.lit("")), "product_short_name"))
        out = out.drop("product_short_name").withColumn(
            "performance_benchmark", F.nullif("performance_benchmark", F.lit(""))
        )
    if source in ("CEB", "CITIC", "ZY"):
        coded = out.filter(F.col("product_code").isNotNull() & (F.col("product_code") != ""))
        out = first_per_key(coded, ["product_code"], [F.col(arrival).asc()])
    return out


def with_first_nav(products: DataFrame, navs: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Products with the first NAV row of their code, if any."""
    coded = navs.filter(F.col("product_code").isNotNull() & (F.col("product_code") != ""))
    first = first_per_key(coded, ["product_code"], [F.col(arrival).asc()]).drop(arrival)
    return attach(products, first, ["product_code"], "left")


def product_type(source: str, name: Column, raw: Column | None = None) -> Column:
    """Unified type by the source's rules: a known raw code, else the first rule that matches."""
    name = F.coalesce(name, F.lit(""))
    text = F.coalesce(strip(raw), F.lit("")) if raw is not None else F.lit("")
    rules = F.lit("other")
    for kind, in_name, in_raw, in_upper in reversed(C.TYPE_RULES[source]):
        hit = contains_any(name, in_name) | contains_any(text, in_raw) | contains_any(F.upper(name), in_upper)
        rules = F.when(hit, kind).otherwise(rules)
    if source in C.TYPE_CODES and raw is not None:
        return F.coalesce(lookup(raw, C.TYPE_CODES[source]), rules)
    return rules


def risk_level(source: str, text: Column) -> Column:
    """Risk class from free text by the source's ordered words; no text or no hit is R3."""
    t = F.upper(strip(text))
    out = F.lit("R3")
    if source == "CITIC":
        # Whole numbers 1 to 5 are classes of their own.
        out = F.when(t.rlike("^[1-5]$"), F.concat(F.lit("R"), t)).otherwise(out)
    for level, words in reversed(C.RISK_RULES[source]):
        out = F.when(contains_any(t, words), level).otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) == "", "R3").otherwise(out)


def standard_risk(label: Column) -> Column:
    """Standard level of a risk label, NULL when the label is not in the table."""
    return lookup(label, C.RISK_LEVELS)


def risk_columns(source: str, text: Column) -> tuple[Column, Column]:
    """Raw class and standard level of a source, each with that source's own default."""
    if source == "fund":
        return F.lit("R3"), F.coalesce(standard_risk(F.lit("R3")), F.lit("L3"))
    given = F.coalesce(F.nullif(text, F.lit("")), F.lit("R3"))
    if source == "JX":
        return given, F.coalesce(standard_risk(given), lookup(F.upper(given), _R_TO_L), F.lit("L3"))
    if source == "SPD":
        return given, F.coalesce(standard_risk(given), risk_level(source, given))
    raw = risk_level(source, text)
    if source in ("BOC", "ZY"):
        return raw, F.coalesce(standard_risk(raw), F.concat(F.lit("L"), F.right(raw, F.lit(1))))
    return raw, F.coalesce(standard_risk(raw), raw)


_R_TO_L = {f"R{i}": f"L{i}" for i in range(1, 6)}


def normalise(rows: DataFrame, source: str, institution: str | None = None) -> DataFrame:
    """Rows of a feed in the unified product schema (28 columns).

    ``source`` names the rules, ``institution`` the constants when several feeds share rules.
    """
    kind, name, custodian = C.INSTITUTIONS[institution or source]
    have = set(rows.columns)

    def col(c: str) -> Column:
        return F.col(c) if c in have else F.lit(None).cast("string")

    raw_type = F.col("product_type_raw") if "product_type_raw" in have else None
    raw_risk, level = risk_columns(source, col("risk_text"))
    sub_type = col("product_sub_type") if source == "CITIC" else col("product_type_raw")
    registration = F.col("product_code") if source in ("BOC", "CITIC") else col("registration_code")
    title = F.coalesce(F.col("product_name"), F.lit(""))
    ended = F.coalesce(col("product_status"), F.lit("")) == "终止"
    values = {
        "institution_type": F.lit(kind),
        "institution_name": F.lit(name),
        "institution_code": F.lit(institution or source),
        "product_code": F.col("product_code"),
        "product_name": title,
        "product_short_name": col("product_short_name"),
        "product_type": product_type(source, title, raw_type),
        "product_sub_type": F.nullif(sub_type, F.lit("")),
        "registration_code": registration,
        "establish_date": col("establish_date").cast("date"),
        "maturity_date": col("maturity_date").cast("date"),
        "risk_level": raw_risk,
        "risk_level_standard": level,
        "currency": F.coalesce(F.nullif(col("currency"), F.lit("")), F.lit("CNY")),
        "manager": F.lit(name),
        "custodian": F.lit(custodian).cast("string"),
        "performance_benchmark": col("performance_benchmark"),
        "min_purchase_amount": col("min_purchase_amount").cast("decimal(18,4)"),
        "min_additional_amount": col("min_additional_amount").cast("decimal(18,4)"),
        "status": F.when(ended, "inactive").otherwise("active"),
        "data_source": F.col("data_source"),
        "collect_date": F.coalesce(F.col("collect_date"), F.current_date()),
    }
    return rows.select(*[values.get(c, F.lit(None).cast("string")).alias(c) for c in UNIFIED])
