"""Text normalisation and classification as Column builders. Null and "" are one: blank."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Typographic and full-width marks, and what they are read as.
MARKS = "，。：；（）－—–＄／＇‘’“”　"
PLAIN = ",.:;()---$/'''\"\" "
CMS_MARKERS = ("HEALTHINSURANCECLAIMFORM", "CMS1500", "HCFA1500", "PATIENT", "INSURED")
UB_MARKERS = ("UB04", "UNIFORMBILL", "STATEMENTCOVERS", "REVENUE", "MEDICALRECORD")
# Fixed patterns of labelled values in free text, already upper case with single spaces.
_DATE = r"(?:\d{1,2}[/.-]){2}\d{2,4}|\d{8}"
_MONEY = r"\$?\s*[0-9][0-9,]*\.\d{2}"
LABELS = {
    "patient_name": r"(?:PATIENT|MEMBER)\s+NAME\s*[:#-]?\s*([A-Z][A-Z ,.'-]{3,45})",
    "patient_dob": rf"(?:DOB|DATE OF BIRTH)\s*[:#-]?\s*({_DATE})",
    "patient_account_no": r"(?:PATIENT ACCOUNT|CLAIM)\s*(?:NO|NUMBER|#)?\s*[:#-]?\s*([A-Z0-9-]{5,25})",
    "total_charge": rf"(?:TOTAL (?:CHARGE|CHARGES|BILLED))\s*[:$#-]?\s*({_MONEY})",
    "provider_npi": r"(?:PROVIDER\s+)?NPI\s*[:#-]?\s*(\d{10})",
    "diagnosis_1": r"(?:DIAGNOSIS|ICD(?:-10)?)\s*(?:CODE)?\s*[:#-]?\s*([A-Z][0-9A-Z.]{2,7})",
}


def blank(x: Column) -> Column:
    """Whether x is null or empty."""
    return F.coalesce(x, F.lit("")) == ""


def known(x: Column) -> Column:
    """x, or null if it is blank."""
    return F.nullif(x, F.lit(""))


def strip(x: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once; expressions would hold a copy each."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm(x: Column) -> Column:
    """Compares values: no white space (Unicode's), lower case."""
    return F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", ""))


def same(a: Column, b: Column) -> Column:
    return norm(a) == norm(b)


def squash(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "")


def compact(x: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(x, F.lit(""))), "[^A-Z0-9]", "")


def fold_marks(x: Column) -> Column:
    return F.translate(x, MARKS, PLAIN)


@F.pandas_udf(T.StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))


def span_text(x: Column) -> Column:
    """A span's text: NFKC, marks folded, stripped.

    Spark has no NFKC, and runs a Python function for every row whatever a CASE says; so the function is given the
    texts that aren't ASCII only, and nulls for the rest.
    """
    wide = F.when(x.rlike(r"[^\x00-\x7F]"), x)
    return strip(fold_marks(F.when(wide.isNull(), x).otherwise(_nfkc(wide))))


def strip_fence(x: Column) -> Column:
    """The inside of one fenced block, or the text itself."""
    inside = F.regexp_extract(x, r"(?s)^\s*```(?:json|JSON)?\s*(.*?)\s*```\s*$", 1)
    return F.coalesce(known(inside), F.trim(x))


def marker_score(text: Column, markers: tuple[str, ...]) -> Column:
    """How many of the markers the compact text has."""
    return reduce(lambda a, b: a + b, [F.contains(compact(text), F.lit(m)).cast("int") for m in markers])


def form_of(text: Column) -> Column:
    """UB-04 only with strictly more of its markers."""
    return F.when(marker_score(text, UB_MARKERS) > marker_score(text, CMS_MARKERS), "ub04").otherwise("cms1500")


def char_type(x: Column) -> Column:
    own = F.regexp_replace(F.coalesce(x, F.lit("")), "[^A-Za-z0-9]", "")
    return F.when(own == "", "empty").when(own.rlike("^[0-9]+$"), "numeric").when(own.rlike("^[A-Za-z]+$"), "alphabetic").otherwise("mixed")


def length_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 4, "1-4").when(n <= 9, "5-9").when(n <= 19, "10-19").otherwise("20+")


def area_bucket(width: Column, height: Column) -> Column:
    area = width * height
    return F.when(area.isNull(), "missing").when(area < 10_000, "small").when(area < 30_000, "medium").otherwise("large")


def outcome(value: Column, truth: Column) -> Column:
    return F.when(blank(value), "missing").when(same(value, truth), "correct").otherwise("incorrect")


def labelled(text: Column) -> Column:
    """Map of the labelled values in free text; labels that aren't there are left out."""
    flat = F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")
    pairs = F.array(*(F.struct(F.lit(n).alias("key"), F.trim(F.regexp_extract(flat, p, 1)).alias("value")) for n, p in LABELS.items()))
    return F.map_from_entries(F.filter(pairs, lambda x: x["value"] != ""))


def hash_id(x: Column, digits: int = 12) -> Column:
    """The first hex digits of sha256."""
    return F.substring(F.sha2(x, 256), 1, digits)


def stable_hash(x: Column) -> Column:
    """sha256 that doesn't depend on the kind of line ends."""
    return F.sha2(F.regexp_replace(x, r"\r\n?", "\n"), 256)


def first_reason(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for when, name in reversed(rules):
        out = F.when(when, name).otherwise(out)
    return out
