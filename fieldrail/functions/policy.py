"""Rules of live model calls, answers' usage, prompts, retries and masks as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .decisions import ACCEPT, FLAG, RETRY
from .text import blank, first_reason, strip
from .typed import digits, family

# Fixed names of model ids that are refused.
AUTO_ROUTERS, FREE_SUFFIX = ("openrouter/auto", "auto"), ":free"
# Fixed limits of one session: calls and money.
LIMITS = {"paid_per_field": 1, "per_field": 1, "per_page": 2, "per_document": 3, "per_batch": 5, "session_usd": 0.02, "document_usd": 0.005}
# Fixed texts: what a field is, by its name.
EXPECTATIONS = {
    "patient_name": "a person's name, usually LAST, FIRST MI",
    "insured_name": "a person's name, usually LAST, FIRST MI",
    "billing_provider_name": "an organisation or practice name",
    "provider_name": "an organisation or practice name",
    "patient_dob": "a date of birth, MM DD YYYY",
    "insured_id": "an insurance member/policy identifier",
    "billing_provider_npi": "a 10-digit NPI number",
    "provider_npi": "a 10-digit NPI number",
    "attending_npi": "a 10-digit NPI number",
    "rendering_npi": "a 10-digit NPI number",
    "referring_provider_npi": "a 10-digit NPI number",
    "federal_tax_id": "a federal tax ID (EIN or SSN format)",
    "federal_tax_no": "a federal tax ID (EIN or SSN format)",
    "total_charge": "a dollar amount",
    "total_charges": "a dollar amount",
    "charges": "a dollar amount",
    "cpt_code": "a 5-character CPT/HCPCS procedure code",
    "hcpcs": "a 5-character CPT/HCPCS procedure code",
    "rev_code": "a 3-4 digit revenue code",
    "patient_zip": "a US ZIP code",
}
# Fixed names of the ways in which a field type is read again.
RETRY_MODES = {
    "date": "date-digits-x-order",
    "money": "money-decimal-preserving",
    "quantity": "isolated-quantity",
    "identifier": "identifier-digits",
    "diagnosis_code": "diagnosis-code",
    "procedure_code": "procedure-code",
    "code": "isolated-code",
    "text": "field-text",
}
# Fixed shares of a box that hold its value, by form and field; and the fields of a form that may be blank there.
VALUE_REGIONS = {("cms1500", "admission_date"): (0.0, 0.55, 0.75, 1.0)}
OPTIONAL_BLANKS = (("cms1500", "admission_date"),)
# Fixed share of a page that a crop may cover.
MOST_OF_PAGE = 0.25
HIDDEN = "[hidden]"


def model_refusal(model: Column) -> Column:
    """Why a model id is refused whatever the allow list says, or null."""
    name = F.lower(strip(F.coalesce(model, F.lit(""))))
    return F.when(name == "", "none").when(name.isin(*AUTO_ROUTERS), "auto router").when(name.endswith(FREE_SUFFIX), "free variant")


def static_gate(c: dict[str, Column]) -> Column:
    """The first gate that stops a call whatever went before, or null.

    c: enabled, adapter, test_flag, key, synthetic, crop_refusal, model, listed, vision.
    """
    gates = (
        (~c["enabled"], "BLOCKED_LIVE_PATH_DISABLED"),
        (~c["adapter"], "BLOCKED_ADAPTER_DISABLED"),
        (~c["test_flag"], "BLOCKED_LIVE_TEST_FLAG_UNSET"),
        (blank(strip(c["key"])), "BLOCKED_NO_API_KEY"),
        (~c["synthetic"], "BLOCKED_NOT_SYNTHETIC"),
        (c["crop_refusal"].isNotNull(), "BLOCKED_NOT_A_CROP"),
        (model_refusal(c["model"]).isNotNull(), "BLOCKED_MODEL_REFUSED"),
        (~c["listed"], "BLOCKED_MODEL_NOT_ALLOWLISTED"),
        (~F.coalesce(c["vision"], F.lit(False)), "BLOCKED_MODEL_NOT_VISION"),
    )
    return F.nullif(first_reason(*gates, otherwise=""), F.lit(""))


def counted_gates(c: dict[str, Column], limits: dict[str, float] = LIMITS) -> Column:
    """The first allowance that is used up, or null: counts first, then money.

    c: paid_field, calls_field, calls_page, calls_document, calls_batch, session_usd, document_usd.
    """
    gates = (
        (c["paid_field"] >= limits["paid_per_field"], "BLOCKED_FIELD_PAID_ATTEMPTS"),
        (c["calls_field"] >= limits["per_field"], "BLOCKED_FIELD_CALL_LIMIT"),
        (c["calls_page"] >= limits["per_page"], "BLOCKED_PAGE_CALL_LIMIT"),
        (c["calls_document"] >= limits["per_document"], "BLOCKED_DOCUMENT_CALL_LIMIT"),
        (c["calls_batch"] >= limits["per_batch"], "BLOCKED_BATCH_CALL_LIMIT"),
        (c["session_usd"] >= limits["session_usd"], "BLOCKED_SESSION_BUDGET"),
        (c["document_usd"] >= limits["document_usd"], "BLOCKED_DOCUMENT_BUDGET"),
    )
    return F.nullif(first_reason(*gates, otherwise=""), F.lit(""))


def live_gate(c: dict[str, Column], reuse: bool = True, parallel: bool = False, limits: dict[str, float] = LIMITS) -> Column:
    """The first gate that stops a call, the cache, or ALLOW; nothing is reserved, so it is a preview as well.

    c: what static_gate and counted_gates take, seen (an equal request was answered) and in_flight.
    """
    seen = F.when(c["seen"], "REUSED_CACHED_RESULT" if reuse else "BLOCKED_DUPLICATE_REQUEST")
    busy = F.when(c["in_flight"] & (not parallel), "BLOCKED_PARALLEL_CALL")
    return F.coalesce(static_gate(c), seen, busy, counted_gates(c, limits), F.lit("ALLOW"))


def charge(billed: Column, called: Column, limits: dict[str, float] = LIMITS) -> Column:
    """What a finished call is booked at: an unknown cost takes a document's whole allowance, a call that wasn't made nothing."""
    return F.coalesce(billed, F.when(F.coalesce(called, F.lit(False)), F.lit(max(0.0, limits["document_usd"]))).otherwise(0.0))


def usage(text: Column) -> Column:
    """Token counts and the reported cost of a provider's usage object (JSON); what isn't a number stays null."""
    v = F.try_parse_json(text)

    def number(path: str, kind: str) -> Column:
        own = F.try_variant_get(v, path, "variant")
        is_number = F.schema_of_variant(own).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
        return F.when(F.coalesce(is_number, F.lit(False)), F.try_variant_get(v, path, "double")).try_cast(kind)

    return F.struct(
        number("$.prompt_tokens", "long").alias("input_tokens"),
        number("$.completion_tokens", "long").alias("output_tokens"),
        number("$.prompt_tokens_details.image_tokens", "long").alias("image_tokens"),
        number("$.prompt_tokens_details.cached_tokens", "long").alias("cached_tokens"),
        number("$.completion_tokens_details.reasoning_tokens", "long").alias("reasoning_tokens"),
        number("$.cost", "double").alias("reported_usd"),
    )


def expectation(name: Column) -> Column:
    """What a field is, in words: by its name, by its name without the line, by parts of it."""
    base = F.regexp_replace(name, r"^line\d+_", "")
    own = F.create_map(*(F.lit(x) for pair in EXPECTATIONS.items() for x in pair))
    other = F.when(base.contains("date"), "a date, MM DD YYYY").when(base.contains("code") | base.startswith("diagnosis"), "an ICD-10 diagnosis code").otherwise("a short printed value")
    return F.coalesce(own[name], own[base], other)


def retry_value(name: Column, text: Column) -> Column:
    """The value of a field that was read again, by its family."""
    t, d, kind = F.coalesce(text, F.lit("")), digits(text), family(name)
    groups = F.regexp_extract_all(F.replace(t, F.lit(","), F.lit("")), F.lit(r"\d+"), F.lit(0))
    money = F.when(F.size(groups) >= 2, F.concat(groups[0], F.lit("."), F.right(F.element_at(groups, -1), F.lit(2)))).when(d != "", F.concat(d, F.lit(".00"))).otherwise("")
    return (
        F.when(kind == "date", F.right(d, F.lit(8)))
        .when(kind == "money", money)
        .when(kind == "quantity", F.when(d != "", d).when(F.upper(t).contains("T"), "1").otherwise(""))
        .when(name.isin("billing_provider_npi", "referring_provider_npi"), F.substring(d, 1, 10))
        .when(name == "federal_tax_id", F.substring(d, 1, 9))
        .otherwise(F.trim(t))
    )


def retry_mode(field_type: Column, marks: Column) -> Column:
    """How a field is read again; a field with marks by its marks."""
    own = F.create_map(*(F.lit(x) for pair in RETRY_MODES.items() for x in pair))
    return F.when(marks, "checkbox-mark-detection").otherwise(own[field_type])


def confirmed(form: Column, name: Column, state: Column, retries: Column) -> Column:
    """A date of birth on this form is accepted only after it was read a second time."""
    early = (form == "ub04") & (name == "patient_dob") & state.isin(ACCEPT, FLAG) & (retries == 0)
    return F.when(early, RETRY).otherwise(state)


def _is(form: Column, name: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit(False)
    for f, n in pairs:
        out = out | (form.eqNullSafe(F.lit(f)) & name.eqNullSafe(F.lit(n)))
    return out


def value_region(form: Column, name: Column, box: Column) -> Column:
    """The part of a box (x0, y0, x1, y1) that holds its value; the box itself for other fields and forms."""
    out = box
    for pair, (a, b, c, d) in VALUE_REGIONS.items():
        w, h = box["x1"] - box["x0"], box["y1"] - box["y0"]
        own = F.struct((box["x0"] + a * w).alias("x0"), (box["y0"] + b * h).alias("y0"), (box["x0"] + c * w).alias("x1"), (box["y0"] + d * h).alias("y1"))
        out = F.when(_is(form, name, (pair,)), own).otherwise(out)
    return out


def label_read_again(form: Column, name: Column, box: Column, field: Column, attempts: Column) -> Column:
    """(bbox, value, confidence, state, attempts): a field whose first reading took in its label is emptied, cut and retried.

    field: value, confidence, state; attempts: an array of (engine, value, confidence), which stays but for what was read.
    A field without a box stays as it is.
    """
    again = _is(form, name, tuple(VALUE_REGIONS)) & box.isNotNull()
    emptied = F.transform(attempts, lambda a: F.struct(a["engine"].alias("engine"), F.lit(None).cast("string").alias("value"), F.lit(0.0).alias("confidence")))
    return F.struct(
        value_region(form, name, box).alias("bbox"),
        F.when(~again, field["value"]).alias("value"),
        F.when(again, 0.0).otherwise(field["confidence"]).alias("confidence"),
        F.when(again, RETRY).otherwise(field["state"]).alias("state"),
        F.when(again, emptied).otherwise(attempts).alias("attempts"),
    )


def blank_policy(form: Column, name: Column, value: Column, state: Column) -> Column:
    """(state, value, verdict, stamp): an optional value region that is blank is accepted and not for people."""
    off = _is(form, name, OPTIONAL_BLANKS) & blank(strip(F.coalesce(value, F.lit(""))))
    return F.struct(F.when(off, ACCEPT).otherwise(state).alias("state"), F.when(~off, value).alias("value"), F.when(off, "INAPPLICABLE").alias("verdict"), F.when(off, "template_blank_policy").alias("stamp"))


def crop_refusal(fraction: Column) -> Column:
    """Why an image that covers this share of its page isn't a field's crop, or null."""
    return F.when(fraction.isNull(), "no source page size").when(fraction > MOST_OF_PAGE, "covers too much of the page")


def shown(value: Column, mask: Column) -> Column:
    """A value as a screenshot may show it."""
    return F.when(mask & ~blank(value), HIDDEN).otherwise(value)


def mode_error(local: Column, model: Column, paid: Column, optional: Column) -> Column:
    """The first rule that an operating mode breaks, or null."""
    known = F.array(*map(F.lit, ("high", "med", "low")))
    share = lambda x: F.coalesce(x.between(0, 1), F.lit(False))
    rules = ((~share(local), "local_accept_confidence"), (~share(model), "multimodal_accept_confidence"), (F.size(F.array_except(paid, known)) > 0, "paid_escalation_criticalities"), (optional, "allow_optional_escalation"))
    return F.nullif(first_reason(*rules, otherwise=""), F.lit(""))
