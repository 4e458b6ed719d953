"""Dates, money, quantities and check digits as Column builders; nothing throws under ANSI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, known, let

# Fixed field names of the comparison families, and suffixes of generated line names.
DATE_FIELDS = ("patient_dob", "admission_date", "statement_from", "statement_to", "service_from", "service_to", "service_date")
MONEY_FIELDS = ("total_charge", "total_charges", "charge", "service_charge")
QUANTITY_FIELDS = ("units",)
CODE_FIELDS = ("diagnosis_1", "diagnosis_2", "diagnosis_3", "diagnosis_4", "principal_dx", "procedure_code", "revenue_code", "provider_npi", "referring_npi", "attending_npi", "federal_tax_id", "federal_tax_no")
DATE_SUFFIXES = ("_date_from", "_date_to", "_service_date", "_dob")
MONEY_SUFFIXES = ("_charges", "_charge")
QUANTITY_SUFFIXES = ("_units",)
# Fixed lengths of month, day and year in a date of three parts.
PART_LENGTHS = ("222", "224", "124", "214", "114", "122", "212", "112")


def digits(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")


def _calendar(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where the calendar has none."""
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year != "0000", text.try_cast("date"))


def _century(year: Column, pivot: int) -> Column:
    """Two digits up to the pivot are in the 2000s."""
    return F.when(F.length(year) == 2, F.concat(F.when(year.try_cast("int") <= pivot, "20").otherwise("19"), year)).otherwise(year)


def printed_date(x: Column) -> Column:
    """A date as forms print it: three parts, or a run of 6 or 8 digits, month first; years to 26 are in the 2000s."""
    parts = F.filter(F.split(F.coalesce(x, F.lit("")), "[^0-9]+"), lambda p: p != "")
    date = lambda month, day, year: F.struct(month.alias("month"), day.alias("day"), year.alias("year"))

    def read(p: Column) -> Column:
        shape = F.concat(*(F.length(F.get(p, F.lit(i))).cast("string") for i in range(3)))
        run = let(F.array_join(p, ""), lambda r: F.when(F.length(r).isin(6, 8), date(F.substring(r, 1, 2), F.substring(r, 3, 2), F.substring(r, 5, 4))))
        return F.when((F.size(p) == 3) & shape.isin(*PART_LENGTHS), date(*(F.get(p, F.lit(i)) for i in range(3)))).otherwise(run)

    return let(let(parts, read), lambda d: _calendar(_century(d["year"], 26), d["month"], d["day"]))


def compared_date(x: Column) -> Column:
    """Digits as YYYYMMDD: six digits month first with years to 68 in the 2000s, eight year first, then month first."""
    def read(d: Column) -> Column:
        six = _calendar(_century(F.substring(d, 5, 2), 68), F.substring(d, 1, 2), F.substring(d, 3, 2))
        ymd = _calendar(F.substring(d, 1, 4), F.substring(d, 5, 2), F.substring(d, 7, 2))
        mdy = _calendar(F.substring(d, 5, 4), F.substring(d, 1, 2), F.substring(d, 3, 2))
        found = F.when(F.length(d) == 6, six).when(F.length(d) == 8, F.coalesce(ymd, mdy))
        return F.coalesce(F.date_format(found, "yyyyMMdd"), d)

    return let(digits(x), read)


def compared_money(x: Column) -> Column:
    """Two decimals, halves to even; what is no number keeps its digits, points and signs."""
    own = F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9.-]", "")
    return F.coalesce(F.bround(own.try_cast("decimal(30,10)"), 2).cast("decimal(28,2)").cast("string"), own)


def compared_quantity(x: Column) -> Column:
    """A number without zeros at its end; what is no number keeps its letters and digits."""
    own = F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9.-]", "")
    number = own.try_cast("decimal(30,10)").cast("string")
    plain = F.regexp_replace(F.regexp_replace(number, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.coalesce(plain, F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]", ""))


def _ends(name: Column, suffixes: tuple[str, ...]) -> Column:
    return name.rlike("(?:" + "|".join(suffixes) + ")$")


def family(name: Column) -> Column:
    """date, money, quantity, code or text, in this order."""
    return (
        F.when(name.isin(*DATE_FIELDS) | _ends(name, DATE_SUFFIXES), "date")
        .when(name.isin(*MONEY_FIELDS) | _ends(name, MONEY_SUFFIXES), "money")
        .when(name.isin(*QUANTITY_FIELDS) | _ends(name, QUANTITY_SUFFIXES), "quantity")
        .when(name.isin(*CODE_FIELDS), "code")
        .otherwise("text")
    )


def compared_value(name: Column, value: Column) -> Column:
    """The form in which a field's values are compared."""
    text = F.upper(F.trim(F.coalesce(value, F.lit(""))))
    kind = family(name)
    return (
        F.when(text == "", "")
        .when(name == "type_of_bill", F.right(digits(text), F.lit(3)))
        .when(kind == "date", compared_date(text))
        .when(kind == "money", compared_money(text))
        .when(kind == "quantity", compared_quantity(text))
        .otherwise(F.regexp_replace(text, "[^A-Z0-9]", ""))
    )


def npi_valid(x: Column) -> Column:
    """Ten digits whose last is the Luhn check digit with the issuer prefix."""
    d = digits(x)
    return F.when(F.length(d) == 10, F.call_function("luhn_check", F.concat(F.lit("80840"), d))).otherwise(False)


def record_money(x: Column, scale: int = 2) -> Column:
    """Digits of a fixed-width amount with an implied point; a sign may lead or trail."""
    raw = F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), ",", "")
    number = known(digits(raw)).try_cast("decimal(28,0)")
    signed = F.when(raw.startswith("-") | raw.endswith("-"), -number).otherwise(number)
    return F.coalesce((signed * F.lit(1).cast("decimal(10,0)") / F.lit(10**scale).cast("decimal(10,0)")).cast(f"decimal(28,{scale})").cast("string"), F.lit(""))


def person(last: Column, first: Column, middle: Column) -> Column:
    """``last, first middle`` without stray commas and blanks."""
    right = F.concat_ws(" ", known(first), known(middle))
    return F.regexp_replace(F.concat(F.coalesce(last, F.lit("")), F.lit(", "), right), "^[ ,]+|[ ,]+$", "")


def cents(x: Column) -> Column:
    """An amount in whole cents, or null."""
    return F.bround(F.when(~blank(x), F.trim(x)).try_cast("double") * 100).try_cast("long")


def ratio(a: Column, b: Column, places: int) -> Column:
    """Null where b is 0; halves to even."""
    return F.bround(F.try_divide(a.cast("double"), b.cast("double")), places)


def cpu_cost(ms: Column, per_hour: float = 0.05) -> Column:
    return ms / 1000 / 3600 * per_hour


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are for a million tokens; null for a model without a price."""
    return tokens_in / 1e6 * price_in + tokens_out / 1e6 * price_out
