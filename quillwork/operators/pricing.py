"""Prices, surcharges and localised service texts. All arithmetic is on decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DISCOUNT, BANK_FEE = 10, 10  # percent
MONEY = "decimal(12,2)"
# The word for a free service.
FREE = {"en": "Free", "fr": "Gratuit", "ar": "مجاني"}


def _scaled(base: Column, percent: int) -> Column:
    return F.round(base * F.lit(100 + percent).cast("decimal(5,0)") / F.lit(100).cast("decimal(5,0)"), 2).cast(MONEY)


def online_total(base: Column, discount: int = DISCOUNT) -> Column:
    """The price paid online, rounded half up; null stays null."""
    return _scaled(base, -discount)


def bank_total(base: Column, fee: int = BANK_FEE) -> Column:
    return _scaled(base, fee)


def payable_total(base: Column, method: Column) -> Column:
    return F.when(method == "bank", bank_total(base)).otherwise(online_total(base))


def is_free(base: Column) -> Column:
    return F.coalesce(base == 0, F.lit(False))


def to_cents(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def truthy(text: Column) -> Column:
    """Neither null nor '' nor '0'."""
    return F.coalesce(~text.isin("", "0"), F.lit(False))


def or_english(text: Column, english: Column) -> Column:
    """Falls back where the text is null, '' or '0'."""
    return F.when(truthy(text), text).otherwise(english)


def price_label(shown: Column, price: Column, locale: str = "en") -> Column:
    """The text if there is one, else the word for free, else whole thousands-separated units."""
    amount = F.concat(F.format_number(F.round(price, 0), 0), F.lit(" MAD"))
    return F.when(truthy(shown), shown).when(price.isNull() | (price == 0), FREE[locale]).otherwise(amount)


def totals(requests: DataFrame) -> DataFrame:
    base, method = F.col("base_price"), F.col("payment_method")
    return requests.select("id", online_total(base).alias("online_total"), bank_total(base).alias("bank_total"), payable_total(base, method).alias("payable_total"), is_free(base).alias("is_free"), to_cents(online_total(base)).alias("online_cents"))


def service_catalog(services: DataFrame) -> DataFrame:
    """Services by price with both totals."""
    return services.select("id", "name_en", "price", online_total(F.col("price")).alias("online_total"), bank_total(F.col("price")).alias("bank_total")).orderBy("price", "id")


def localized_services(services: DataFrame, locale: str = "fr") -> DataFrame:
    """Names and descriptions fall back to English where null; price texts and both kinds of notes also where '' or '0'."""
    shown = _shown("price_display", locale)
    return services.select(
        "id",
        F.coalesce(f"name_{locale}", "name_en").alias("name"),
        F.coalesce(f"description_{locale}", "description_en").alias("description"),
        _shown("notes", locale).alias("notes"),
        _shown("additional_notes", locale).alias("additional_notes"),
        shown.alias("price_display"),
        price_label(shown, F.col("price"), locale).alias("price_label"),
    )


def _shown(field: str, locale: str) -> Column:
    return or_english(F.col(f"{field}_{locale}"), F.col(f"{field}_en"))


def surcharge_lines(requests: DataFrame) -> DataFrame:
    base = F.col("base_price").cast(MONEY)
    return requests.select("id", (bank_total(F.col("base_price")) - base).cast(MONEY).alias("bank_fee"), (base - online_total(F.col("base_price"))).cast(MONEY).alias("discount"))


def payment_route(requests: DataFrame, external: str) -> DataFrame:
    """Free: no link; bank: the internal link only; else the external address and the internal link."""
    free, link = is_free(F.col("base_price")), F.concat(F.lit("/payment/"), "ticket_number")
    url = F.when(free | (F.col("payment_method") == "bank"), "").otherwise(external)
    return requests.select("id", url.alias("url"), F.when(free, "").otherwise(link).alias("link"))
