"""Amounts, dates, currency codes and format signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT_TYPE = "decimal(38,10)"

# Bounds on amounts that arrive as text.
AMOUNT_TEXT_LIMIT = 32
AMOUNT_LIMIT = "999999999999999999"

# Active ISO-4217 codes, funds, metals and test codes included.
CURRENCY_CODES = (
    "AED AFN ALL AMD AOA ARS AUD AWG AZN BAM BBD BDT BHD BIF BMD BND BOB BOV BRL BSD BTN "
    "BWP BYN BZD CAD CDF CHE CHF CHW CLF CLP CNY COP COU CRC CUP CVE CZK DJF DKK DOP DZD "
    "EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HTG HUF IDR ILS INR "
    "IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD "
    "MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MXV MYR MZN NAD NGN NIO NOK NPR NZD "
    "OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE "
    "SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD USN UYI "
    "UYU UYW UZS VED VES VND VUV WST XAD XAF XAG XAU XBA XBB XBC XBD XCD XCG XDR XOF XPD "
    "XPF XPT XSU XTS XUA XXX YER ZAR ZMW ZWG"
).split()

MISSING_DATE = "0000-00-00"
MISSING_CURRENCY = "XXX"


def is_currency_shape(code: Column) -> Column:
    return code.rlike("^[A-Z]{3}\\z")


def is_currency(code: Column) -> Column:
    """A known three-letter code, looked up in one constant string; no join."""
    listed = F.lit(" " + " ".join(CURRENCY_CODES) + " ")
    known = F.contains(listed, F.concat(F.lit(" "), code, F.lit(" ")))
    return F.coalesce(is_currency_shape(code) & known, F.lit(False))


def is_decimal_text(text: Column) -> Column:
    """Short enough, and digits with an optional sign and fraction."""
    return F.when(
        F.length(text) <= AMOUNT_TEXT_LIMIT, text.rlike("^-?[0-9]+(\\.[0-9]+)?\\z")
    ).otherwise(F.lit(False))


def bounded_decimal(text: Column) -> Column:
    """Parse a plain decimal; null when too long, malformed or out of range."""
    parsed = F.when(is_decimal_text(text), text.try_cast(AMOUNT_TYPE))
    bound = F.lit(AMOUNT_LIMIT).cast(AMOUNT_TYPE)
    return F.when(parsed.between(-bound, bound), parsed)


def rounded_amount(amount: Column) -> Column:
    """Whole units, half away from zero, as text; null stays null."""
    return F.round(amount, 0).cast("decimal(38,0)").cast("string")


def same_number(left: Column, right: Column) -> Column:
    """Equality as decimals; text that is no number never matches."""
    return F.coalesce(
        F.trim(left).try_cast(AMOUNT_TYPE) == F.trim(right).try_cast(AMOUNT_TYPE), F.lit(False)
    )


def compact_date(text: Column) -> Column:
    """Year, month and day written without separators.

    Month and day may each drop their leading zero, as calendar parsers allow;
    the alternatives are tried longest first.
    """
    pattern = "^([0-9]{4})(1[0-2]|0[1-9]|[1-9])(3[01]|[12][0-9]|0[1-9]|[1-9]| [1-9])\\z"
    parts = [F.trim(F.regexp_extract(text, pattern, i)) for i in (1, 2, 3)]
    iso = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.when(text.rlike(pattern) & (parts[0] != "0000"), iso.try_cast("date"))


def strict_date(text: Column) -> Column:
    """``YYYY-MM-DD``, or a midnight timestamp on that day."""
    pattern = (
        "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
        "([Tt _ ]00:00(:00(\\.0+)?)?([Zz]|[+-][0-9]{2}:?[0-9]{2})?)?\\z"
    )
    return F.when(
        text.rlike(pattern) & ~text.startswith("0000"), F.left(text, F.lit(10)).try_cast("date")
    )


def date_or_placeholder(day: Column) -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(MISSING_DATE))


def document_format(content: Column) -> Column:
    """``pdf`` or ``jpeg`` by leading bytes, else null."""
    return F.when(F.startswith(content, F.expr("X'255044462D'")), F.lit("pdf")).when(
        F.startswith(content, F.expr("X'FFD8FF'")), F.lit("jpeg")
    )


def format_extension(fmt: Column) -> Column:
    return F.when(fmt == "pdf", F.lit(".pdf")).when(fmt == "jpeg", F.lit(".jpg"))


def present_names(pairs: list[tuple[str, Column]]) -> Column:
    """Names whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))
