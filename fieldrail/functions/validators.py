"""The 17 value rules. Each is (value, context) -> verdict, detail as one Column struct."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, strip
from .typed import digits, npi_valid, printed_date

PASS, FAIL, INAPPLICABLE = "PASS", "FAIL", "INAPPLICABLE"
# Fixed code lists.
CPT = ("99213", "99214", "99203", "99204", "80053", "85025", "93000", "71046", "97110", "90837", "20610", "36415", "99284", "99283", "93005", "80048", "81001", "99215", "99205", "99212")
ICD10 = ("E11.9", "I10", "M54.5", "J06.9", "K21.9", "F41.1", "N39.0", "M25.561", "R51.9", "E78.5", "J45.909", "Z00.00", "R05.9", "M79.3", "E66.9", "F32.9", "G43.909", "R10.9", "J02.9", "L70.0", "F25.9")
REVENUE = ("0250", "0300", "0450", "0510", "0730", "0270", "0320", "0360", "0420", "0610")
LAST_DAY = "2026-12-31"
MOST_YEARS = 125


def _verdict(ok: Column, why: Column | str) -> Column:
    why = F.lit(why) if isinstance(why, str) else why
    good = F.coalesce(ok, F.lit(False))
    return F.struct(F.when(good, PASS).otherwise(FAIL).alias("verdict"), F.when(good, "").otherwise(why).alias("detail"))


def _full(x: Column, pattern: str) -> Column:
    return x.rlike(rf"^(?:{pattern})\z")


def _shape(pattern: str, why: str, upper: bool = False) -> Callable[[Column, "Context"], Column]:
    def rule(value: Column, context: Context) -> Column:
        own = strip(value)
        return _verdict(_full(F.upper(own) if upper else own, pattern), why)

    return rule


class Context:
    """What a page tells about its fields: columns of the row that holds the value.

    dob: the page's patient_dob; has_dob: whether it has the field; claim_dates: array of
    parsed claim dates; total, line_cents: page amounts in cents (null total: can't be read).
    """

    def __init__(self, dob: Column | None = None, claim_dates: Column | None = None, total: Column | None = None, line_cents: Column | None = None, lines: Column | None = None) -> None:
        none = F.lit(None)
        self.dob = none.cast("string") if dob is None else dob
        self.claim_dates = none.cast("array<date>") if claim_dates is None else claim_dates
        self.total = none.cast("long") if total is None else total
        self.line_cents = none.cast("long") if line_cents is None else line_cents
        self.lines = F.lit(0) if lines is None else lines


def npi_checksum(value: Column, context: Context) -> Column:
    n = F.length(digits(value))
    return _verdict(npi_valid(value), F.when(n != 10, F.concat(F.lit("NPI length "), n.cast("string"))).otherwise("Luhn check failed"))


def cpt_dictionary(value: Column, context: Context) -> Column:
    return _verdict(strip(value).isin(*CPT), "unknown CPT")


def icd10_dictionary(value: Column, context: Context) -> Column:
    code = F.regexp_replace(F.upper(value), "[^A-Z0-9]", "")
    return _verdict(code.isin(*(c.replace(".", "") for c in ICD10)), "unknown ICD-10")


def date_valid(value: Column, context: Context) -> Column:
    return _verdict(printed_date(value).isNotNull(), "unparseable date")


def patient_dob_valid(value: Column, context: Context) -> Column:
    """One whole printed date that precedes the earliest claim date by at most 125 years."""
    text = strip(value)
    whole = _full(text, r"\d{6}|\d{8}|\d{1,2}([/ .-])\d{1,2}\1\d{2,4}")
    iso = F.when(_full(text, r"\d{8}"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))
    dob = F.coalesce(printed_date(text), iso)
    first = F.array_min(context.claim_dates)
    later = (F.month(first) < F.month(dob)) | ((F.month(first) == F.month(dob)) & (F.dayofmonth(first) < F.dayofmonth(dob)))
    years = F.year(first) - F.year(dob) - later.cast("int")
    why = (
        F.when(~whole, "DOB must be one complete printed date")
        .when(dob.isNull(), "unparseable DOB")
        .when(first.isNull(), "claim date unavailable for DOB chronology")
        .when(dob >= first, "DOB is not before claim dates")
        .when(years > MOST_YEARS, "DOB exceeds plausible age range")
    )
    return _verdict(why.isNull(), why)


def dob_before_service(value: Column, context: Context) -> Column:
    day, dob = printed_date(value), printed_date(context.dob)
    why = F.when(day.isNull(), "unparseable").when(F.coalesce(day < dob, F.lit(False)), "service date before DOB").when(day > F.lit(LAST_DAY).cast("date"), "date in the future")
    return _verdict(why.isNull(), why)


def claim_arithmetic(value: Column, context: Context) -> Column:
    """The page's line cents add up to its total; a verdict of the page, stamped on each charge."""
    unread = context.total.isNull() | context.line_cents.isNull()
    none = context.lines == 0
    ok = context.line_cents == context.total
    detail = F.when(unread & ~none, "amounts unparseable").when(none & context.total.isNull(), "amounts unparseable").when(none, "no line charges").when(ok, "").otherwise(F.concat(F.lit("lines sum "), context.line_cents.cast("string"), F.lit(" != total "), context.total.cast("string")))
    return F.struct(F.when(unread | none, INAPPLICABLE).when(ok, PASS).otherwise(FAIL).alias("verdict"), detail.alias("detail"))


def name_format(value: Column, context: Context) -> Column:
    s = strip(value)
    commas = F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))
    why = F.when(~F.length(s).between(2, 40), "implausible length").when(commas != 1, F.concat(commas.cast("string"), F.lit(" commas (merged/failed span?)"))).when(~_full(s, r"[A-Za-z .'-]+,\s*[A-Za-z .'-]+"), "bad Last, First shape")
    return _verdict(why.isNull(), why)


def org_name_format(value: Column, context: Context) -> Column:
    s = strip(value)
    why = F.when(~F.length(s).between(2, 60), "implausible length").when(~(_full(s, r"[A-Za-z0-9 .,'&\-]+") & s.rlike("[A-Za-z]")), "bad organisation name")
    return _verdict(why.isNull(), why)


def revenue_code_format(value: Column, context: Context) -> Column:
    s = strip(value)
    return _verdict(s.isin(*REVENUE) | _full(s, r"0\d{3}"), "bad revenue code")


# Fixed wording: the details of verdicts are what users of such stamps read.
RULES: dict[str, Callable[[Column, Context], Column]] = {
    "npi_checksum": npi_checksum,
    "cpt_format": _shape(r"\d{5}", "not 5 digits"),
    "cpt_dictionary": cpt_dictionary,
    "icd10_format": _shape(r"[A-TV-Z]\d[0-9A-Z](\.[0-9A-Z]{1,4})?", "bad ICD-10 shape", upper=True),
    "icd10_dictionary": icd10_dictionary,
    "date_valid": date_valid,
    "patient_dob_valid": patient_dob_valid,
    "dob_before_service": dob_before_service,
    "currency_format": _shape(r"\d{1,7}\.\d{2}", "not a currency amount"),
    "claim_arithmetic": claim_arithmetic,
    "numeric_format": _shape(r"\d{1,4}", "not a small integer"),
    "zip_format": _shape(r"\d{5}(-\d{4})?", "bad ZIP"),
    "tax_id_format": _shape(r"\d{2}-?\d{7}", "bad EIN shape"),
    "id_format": _shape(r"[A-Z0-9]{6,15}", "bad member-ID shape", upper=True),
    "name_format": name_format,
    "org_name_format": org_name_format,
    "revenue_code_format": revenue_code_format,
}


def check(rule: str, value: Column, context: Context | None = None) -> Column:
    return RULES[rule](F.coalesce(value, F.lit("")), context or Context())


def stamps(value: Column, required: Column, optional: Column, context: Context | None = None) -> Column:
    """Array of (validator, verdict, detail) for the required rules, in their order."""
    context = context or Context()
    empty = blank(value)

    def stamp(name: Column) -> Column:
        verdict = F.lit(None).cast("struct<verdict:string,detail:string>")
        for rule in RULES:
            verdict = F.when(name == rule, check(rule, value, context)).otherwise(verdict)
        unknown = ~name.isin(*RULES)
        return F.struct(
            name.alias("validator"),
            F.when(unknown, INAPPLICABLE).when(empty & optional, INAPPLICABLE).when(empty, FAIL).otherwise(verdict["verdict"]).alias("verdict"),
            F.when(unknown, "unknown validator").when(empty, "empty value").otherwise(verdict["detail"]).alias("detail"),
        )

    return F.transform(F.coalesce(required, F.array().cast("array<string>")), stamp)


def failed(stamped: Column) -> Column:
    return F.exists(stamped, lambda s: s["verdict"] == FAIL)
