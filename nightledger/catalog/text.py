"""Text family: price strings, room names, rate cards, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nightledger.catalog import Registry
from nightledger.functions import text as X
from nightledger.sources import warehouse as W

QUERIES = Registry()

CARD = r'(?s)<div class="card">(.*?)</div>'
PRICE = r'(?s)<span class="price">(.*?)</span>'
UNIT = r'(?s)<p class="unit">(.*?)</p>'


def shown_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Each rate as the text a site would show, with a unit name."""
    amount = "format_number(price, 1)"
    return W.competitor_prices(spark, folder).withColumn("k", F.expr("cast(event_id AS BIGINT)")).selectExpr(
        "event_id",
        "k",
        "hotel_id",
        "room_type",
        "check_in_date",
        f"CASE WHEN NOT is_available THEN 'Sold out' WHEN k % 5 = 0 THEN concat('₹ ', {amount})"
        f" WHEN k % 5 = 1 THEN concat('INR ', {amount}, ' per night')"
        f" WHEN k % 5 = 2 THEN concat('from rs. ', {amount}) WHEN k % 5 = 3 THEN '₹ 0'"
        f" ELSE concat('₹', {amount}, ' / night') END AS price_text",
        "element_at(array('Grand Suite King', 'Superior Twin', 'Luxury Room', 'Pod 7B',"
        " 'Premium Executive Room, Club Access', 'Classic Double'), cast(k % 6 AS INT) + 1) AS unit_text",
        "cast(1 + k % 3 AS INT) AS nights",
    )


@QUERIES.add("k8_price_strings")
def k8(spark, folder):
    return shown_rates(spark, folder).select("event_id", X.parse_price(F.col("price_text")).alias("price"))


@QUERIES.add("k8_page_prices")
def k8b(spark, folder):
    """The first currency amount in each raw page, looked for in the whole page."""
    pages = W.table(spark, folder, "pages")
    return pages.select("page_id", X.parse_price(F.col("html")).alias("price"))


@QUERIES.add("k9_room_names")
def k9(spark, folder):
    unit = F.col("unit_text")
    return shown_rates(spark, folder).select(
        "event_id",
        X.classify_room(unit, "site").alias("site_room"),
        X.classify_room(unit, "portal").alias("portal_room"),
    )


@QUERIES.add("k11_nightly_prices")
def k11(spark, folder):
    return shown_rates(spark, folder).select(
        "event_id", X.nightly_price(F.col("price_text"), F.col("nights")).alias("price")
    )


def card_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Results pages of a room night, cards in order; some nights use another layout.

    Cards are spread over pages by ranges of 4096 keys, so a page has a bounded number of
    cards however popular the night is.
    """
    card = (
        "concat('<div class=\"card\"><p class=\"unit\">', unit_text, '</p><span class=\"price\">',"
        " price_text, '</span></div>')"
    )
    return (
        shown_rates(spark, folder)
        .groupBy("hotel_id", "room_type", "check_in_date", F.expr("k div 4096").alias("page"))
        .agg(F.array_sort(F.collect_list(F.struct("k", F.expr(card).alias("card")))).alias("cards"))
        .selectExpr(
            "concat_ws('|', hotel_id, room_type, cast(check_in_date AS STRING), cast(page AS STRING))"
            " AS page_id",
            "room_type",
            "CASE WHEN dayofyear(check_in_date) % 9 = 0"
            " THEN concat('<html>', replace(array_join(transform(cards, c -> c.card), ''), 'div', 'section'), '</html>')"
            " ELSE concat('<html>', array_join(transform(cards, c -> c.card), ''), '</html>') END AS html",
        )
    )


@QUERIES.add("k10_rate_cards")
def k10(spark, folder):
    return X.rate_cards(card_pages(spark, folder), W.BRAND_CYCLE, CARD, PRICE, UNIT).select(
        "page_id", F.col("position").cast("int").alias("position"), "competitor", "price", "card_room"
    )


@QUERIES.add("k10_page_report")
def k10b(spark, folder):
    pages = card_pages(spark, folder)
    return X.page_report(pages, X.rate_cards(pages, W.BRAND_CYCLE, CARD, PRICE, UNIT))


PARAGRAPH, WHOLE = r"(?s)<p>(.*?)</p>", r"(?s)(.*)"


def site_pages(spark: SparkSession, folder: str) -> DataFrame:
    return W.table(spark, folder, "pages").selectExpr("page_id", "'standard' AS room_type", "html")


@QUERIES.add("k10_site_cards")
def k10c(spark, folder):
    """The extractor on raw pages of other sites: every paragraph is a card."""
    cards = X.rate_cards(site_pages(spark, folder), W.BRAND_CYCLE, PARAGRAPH, WHOLE, WHOLE)
    return cards.select(
        "page_id", F.col("position").cast("int").alias("position"), "competitor", "price", "card_room"
    )


@QUERIES.add("k10_site_report")
def k10d(spark, folder):
    pages = site_pages(spark, folder)
    return X.page_report(pages, X.rate_cards(pages, W.BRAND_CYCLE, PARAGRAPH, WHOLE, WHOLE))


@QUERIES.add("k12_redacted_documents")
def k12(spark, folder):
    documents = W.table(spark, folder, "documents")
    clean = X.redact(F.col("text"))
    return documents.select(
        "doc_id",
        F.md5(clean).alias("digest"),
        ((F.length(clean) - F.length(F.replace(clean, F.lit(X.MASK), F.lit("")))) / len(X.MASK))
        .cast("int")
        .alias("masked"),
    )
