"""Typed readers for vendor feeds (SRC-07, SRC-08, SRC-10): a registry feed name ->
record schema (the "Returns" field lists), plus the payload key holding the records.

Fundamentals feeds document no field list ("different attributes"), so they keep the
identifying keys and the raw record as text (``load_fundamentals``), or are typed by the fields
that their records turn out to have (``infer_fields``, ``typed_records``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.readers import ddl_fields, explode_payload

# Calendar feeds, their payload keys and documented fields.
CALENDAR_FIELDS = {
    "dividends": ("dividends", "id date updated isin ticker name exchange frequency dividend dividend_prior dividend_type "
                  "dividend_yield ex_dividend_date payable_date record_date importance"),
    "earnings": ("earnings", "id date date_confirmed time isin ticker exchange name period period_year eps eps_est eps_prior "
                 "eps_surprise eps_surprise_percent revenue revenue_est revenue_prior revenue_surprise "
                 "revenue_surprise_percent importance updated"),
    "splits": ("splits", "id updated date time ticker exchange importance ratio optionable date_ex date_recorded "
               "date_distribution"),
    "economics": ("economics", "id date time country event_name event_period period_year actual actual_t consensus "
                  "consensus_t prior importance updated description"),
    "guidance": ("guidance", "id date time ticker exchange name period period_year prelim eps_guidance_est eps_guidance_max "
                 "eps_guidance_min eps_guidance_prior_max eps_guidance_prior_min revenue_guidance_est "
                 "revenue_guidance_max revenue_guidance_min revenue_guidance_prior_max revenue_guidance_prior_min "
                 "importance updated"),
    "ipos": ("ipos", "id date time ticker exchange name pricing_date price_min price_max deal_status insider_lockup_days "
             "insider_lockup_date offering_value offering_shares lead_underwriters underwriter_quiet_expiration_days "
             "underwriter_quiet_expiration_date update"),
    "retail": ("retail", "id date time ticker exchange name importance period period_year sss sss_est retail_surprise "
               "updated"),
    "ratings": ("ratings", "id date time ticker exchange name action_pt action_company rating_current pt_current "
                "rating_prior pt_prior url importance updated url_calendar url_news analyst analyst_name"),
    "conference-calls": ("conference", "id date time ticker exchange name start_time phone_num international_line "
                         "reservation_num access_code webcast_url importance updated"),
}
#: Types of the fields that are not text.
FIELD_TYPES = {
    "importance": "int", "period_year": "int", "frequency": "int", "insider_lockup_days": "int",
    "underwriter_quiet_expiration_days": "int", "updated": "bigint", "update": "bigint", "offering_value": "bigint",
    "offering_shares": "bigint", "optionable": "boolean", "lead_underwriters": "array<string>",
}
CALENDAR_FEEDS = {feed: (key, ", ".join(f"{f} {FIELD_TYPES.get(f, 'string')}" for f in fields.split()))
                  for feed, (key, fields) in CALENDAR_FIELDS.items()}

FUNDAMENTAL_FEEDS = ["fundamentals", "financials", "valuation-ratios", "earning-ratios", "operation-ratios",
                     "share-class", "share-class-profile-history", "earning-reports", "alpha-beta", "company",
                     "company-profile", "asset-classification", "ownership-summary"]

REFERENCE_FEEDS = {
    "security": "symbol string, exchange string, cusip string, name string, currency string",
    "ticker-detail": "symbol string, exchange string, sector string, industry string, marketcap double, "
                     "percentile array<struct<metric: string, value: double>>",
    "logos": "symbol string, mark_light string, mark_dark string, logo_light string, logo_dark string",
    "quote": "symbol string, last double, previousClose double, change double, changePercent double, "
             "fiftyDayAveragePrice double, fiftyTwoWeekHigh double, fiftyTwoWeekLow double, volume bigint",
}


def load_feed(df: DataFrame, feed: str, json_col: str = "payload", keep=()) -> DataFrame:
    """SRC-07 / SRC-10 landed payloads of a calendar or reference feed -> typed rows."""
    if feed in CALENDAR_FEEDS:
        key, schema = CALENDAR_FEEDS[feed]
        return explode_payload(df, json_col, key, schema, keep)
    if feed in REFERENCE_FEEDS:
        return df.select(*keep, F.inline_outer(F.from_json(json_col, f"array<struct<{ddl_fields(REFERENCE_FEEDS[feed])}>>")))
    raise ValueError(f"unknown feed {feed!r}")


def load_fundamentals(df: DataFrame, feed: str, json_col: str = "payload") -> DataFrame:
    """SRC-08 fundamentals feeds: identifying keys typed, the record kept as JSON text."""
    if feed not in FUNDAMENTAL_FEEDS:
        raise ValueError(f"unknown fundamentals feed {feed!r}")
    recs = F.from_json(json_col, "array<string>")
    d = df.select(F.explode_outer(recs).alias("record"))
    keys = {k: F.get_json_object("record", f"$.{k}") for k in ("symbol", "isin", "cik", "asOf")}
    return d.select(F.lit(feed).alias("feed"), *[v.alias(k) for k, v in keys.items()],
                    F.to_date(keys["asOf"]).alias("as_of"), "record")


def infer_fields(df: DataFrame, json_col: str, by: str | None = None) -> dict:
    """SRC-08 {group: {field: type}} of the JSON objects in ``json_col`` (per value of ``by``, or under
    None), in field order.

    Every row's schema is merged with the others by a native aggregate over one lattice of
    types: integers widen to decimals, decimals read as double, a field that is an object or
    array in all rows keeps its structure, one whose rows disagree is text.  Only the schemas
    come to the driver.  Null, broken and non-object texts add nothing; fields that are null
    in every row are text."""
    v = F.try_parse_json(F.col(json_col))
    objects = df.withColumn("_v", v).filter(F.schema_of_variant("_v").startswith("OBJECT"))
    groups = objects.groupBy(*([by] if by else [])).agg(F.schema_of_variant_agg("_v").alias("s"), F.count(F.lit(1)).alias("n"))
    out = {}
    for r in groups.filter("n > 0").collect():
        ddl = re.sub(r"DECIMAL\(\d+,\s*\d+\)", "DOUBLE", r["s"]).replace("OBJECT<", "STRUCT<")
        ddl = re.sub(r"\b(VARIANT|VOID)\b", "STRING", ddl)
        st = T._parse_datatype_string(ddl)
        out[r[by] if by else None] = {f.name: f.dataType.simpleString() for f in st.fields}
    return out


def typed_records(df: DataFrame, json_col: str, fields: dict, rescue: str = "rescued") -> DataFrame:
    """``df`` with the ``fields`` (name -> type) of the JSON objects in ``json_col`` as typed columns, and
    a map ``rescue`` of all that does not fit: fields that are not listed, and texts of listed ones
    whose type is another.  Nothing of a record is lost; a broken text gives nulls and no map.
    Columns of ``df`` named like a field are replaced."""
    texts = F.from_json(F.col(json_col), "map<string,string>")
    struct = F.from_json(F.col(json_col), "struct<" + ", ".join(f"`{n}`: {t}" for n, t in fields.items()) + ">")
    d = df.withColumns({"_t": texts, "_s": struct})
    listed = F.array(*[F.lit(n) for n in fields]).cast("array<string>")
    misfit = [F.when(F.col("_t")[n].isNotNull() & F.col("_s")[n].isNull(), F.lit(n)) for n in fields]
    lost = F.array_compact(F.array(*misfit)) if misfit else listed
    rest = F.map_filter("_t", lambda k, v: ~F.array_contains(listed, k) | F.array_contains(lost, k))
    keep = [c for c in df.columns if c not in fields and c not in (json_col, rescue)]
    return d.select(*keep, *[F.col("_s")[n].alias(n) for n in fields], rest.alias(rescue))
