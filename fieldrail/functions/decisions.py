"""Confidence, routing, candidate merges, grounding and cost rules as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, first_reason, same, squash

ACCEPT, FLAG, RETRY, ESCALATE, HUMAN, OVERRIDE = "ACCEPT", "ACCEPT_WITH_FLAG", "RETRY", "ESCALATE", "HUMAN_REVIEW", "ACCEPT_WITH_OVERRIDE"
TERMINAL = (ACCEPT, FLAG, OVERRIDE)
AUTOMATED = (ACCEPT, FLAG, RETRY, ESCALATE, HUMAN)
# Fixed presets: accept threshold, escalate threshold, whether flags are allowed.
PRESETS = {"economy": (0.80, 0.50, True), "balanced": (0.88, 0.60, True), "accuracy": (0.95, 0.75, False)}
BUDGETS = {"retry_ocr": 1, "multimodal": 1}
# Fixed charsets of whole values by rule.
CHARSETS = {
    "npi_checksum": r"[\d ]+",
    "cpt_format": r"[\d ]+",
    "numeric_format": r"[\d ]+",
    "currency_format": r"[\d.,$ ]+",
    "zip_format": r"[\d\- ]+",
    "tax_id_format": r"[\d\- ]+",
    "date_valid": r"[\d/\- ]+",
    "icd10_format": r"[A-Za-z0-9. ]+",
    "id_format": r"[A-Za-z0-9 ]+",
    "name_format": r"[A-Za-z .,'\-]+",
    "revenue_code_format": r"[\d ]+",
}
# Fixed shapes of grounded answers by type of field.
ANSWER_SHAPES = {
    "npi": r"^\d{10}$",
    "zip": r"^\d{5}(-?\d{4})?$",
    "cpt": r"^[0-9A-Z]{5}$",
    "rev_code": r"^\d{3,4}$",
    "currency": r"^\$?\s*[\d,]+(\.\d{1,2})?$",
    "date": r"^[\d]{1,4}[-/ ]?[\d]{1,2}[-/ ]?[\d]{1,4}$",
    "icd10": r"^[A-TV-Z][0-9][0-9A-Z]\.?[0-9A-Z]{0,4}$",
}
MOST_VISIBLE = 120
RETRYABLE = ("RATE_LIMIT", "TIMEOUT", "NETWORK_ERROR", "PROVIDER_5XX")


def clip(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def charset_fit(value: Column, rules: Column) -> Column:
    """1 or 0 by the best fitting charset of the field's rules; a half without any."""
    has = F.exists(rules, lambda r: r.isin(*CHARSETS))
    fits = F.lit(False)
    for rule, pattern in CHARSETS.items():
        fits = fits | (F.array_contains(rules, rule) & value.rlike(f"^(?:{pattern})\\z"))
    return F.when(blank(value) | ~has, 0.5).when(fits, 1.0).otherwise(0.0)


def span_sanity(n: Column) -> Column:
    return F.when(n == 0, 0.0).when(n <= 3, 1.0).otherwise(F.greatest(F.lit(0.2), 1.0 - 0.15 * (n - 3)))


def fuse(ocr: Column, quality: Column, n_spans: Column, value: Column, rules: Column) -> Column:
    """Weighted evidence, four places, halves to even."""
    score = 0.55 * clip(ocr) + 0.15 * clip(quality) + 0.15 * span_sanity(n_spans) + 0.15 * charset_fit(value, rules)
    return F.bround(clip(score), 4)


def decide(value: Column, confidence: Column, fails: Column, required: Column, optional: Column, policy_flag: Column, external: Column, criticality: Column, retries: Column, escalations: Column, accept: Column, escalate: Column, preset_flag: Column) -> Column:
    """(state, reason): the first rule that holds; optional blanks come even before failures."""
    flaggable = preset_flag & policy_flag & (criticality != "high")
    may_retry = retries < BUDGETS["retry_ocr"]
    may_escalate = external & (escalations < BUDGETS["multimodal"])
    tolerable = (confidence >= escalate) & flaggable
    conf = F.format_string("%.2f", confidence)

    def rung(reason: Column, fail: Column) -> Column:
        state = F.when(may_retry, RETRY).when(may_escalate, ESCALATE).when(~fail & tolerable, FLAG).otherwise(HUMAN)
        spent = F.concat(F.lit("attempts exhausted; validators clean, conf "), conf, F.lit(" tolerable for "), criticality, F.lit(" criticality"))
        text = F.when(may_retry, F.concat(reason, F.lit("; retry budget available"))).when(may_escalate, F.concat(reason, F.lit("; retry exhausted"))).when(~fail & tolerable, spent).otherwise(F.concat(reason, F.lit("; attempt budget exhausted")))
        return F.struct(state.alias("state"), text.alias("reason"))

    def final(state: str, reason: Column) -> Column:
        return F.struct(F.lit(state).alias("state"), reason.alias("reason"))

    fail = F.size(fails) > 0
    empty = blank(value)
    return (
        F.when(empty & optional, final(ACCEPT, F.lit("optional field legitimately empty")))
        .when(fail, rung(F.concat(F.lit("validator FAIL: "), F.array_join(fails, ",")), F.lit(True)))
        .when(empty & (F.size(required) > 0), rung(F.lit("empty value on required field"), F.lit(False)))
        .when(confidence >= accept, final(ACCEPT, F.concat(F.lit("validators clean, conf "), conf, F.lit(" >= accept"))))
        .when(tolerable, final(FLAG, F.concat(criticality, F.lit(" criticality, validators clean, conf "), conf, F.lit(" tolerable"))))
        .otherwise(rung(F.concat(F.lit("conf "), conf, F.lit(" below accept threshold")), F.lit(False)))
    )


def state_allowed(state: Column, override: Column, reviewer: Column, reason: Column) -> Column:
    """Only a person with a name and a reason may override."""
    return F.when(override, (state == OVERRIDE) & ~blank(reviewer) & ~blank(reason)).otherwise(state.isin(*AUTOMATED))


def merge_retry(value: Column, confidence: Column, fails: Column, new_value: Column, new_confidence: Column, new_fails: Column) -> Column:
    """(decision, value, confidence, took) of a retried field."""
    agree = same(value, new_value) & ~blank(new_value)
    raised = F.when(agree, F.least(F.lit(1.0), new_confidence + 0.10)).otherwise(new_confidence)
    decision = first_reason(
        (agree, "agree"),
        (fails & ~new_fails, "retry_passes_validators"),
        (~fails & new_fails, "keep_primary_validators"),
        (raised > confidence + 0.05, "retry_higher_confidence"),
        otherwise="disagree_unresolved",
    )
    took = decision.isin("retry_passes_validators", "retry_higher_confidence")
    merged = F.when(decision == "agree", F.least(F.lit(1.0), F.greatest(confidence, raised))).when(took, raised).when(decision == "disagree_unresolved", F.least(confidence, F.lit(0.6))).otherwise(confidence)
    return F.struct(decision.alias("decision"), F.when(took, new_value).otherwise(value).alias("value"), merged.alias("confidence"), took.alias("took"))


def merge_model(value: Column, confidence: Column, fails: Column, new_value: Column, new_confidence: Column, new_fails: Column) -> Column:
    """(decision, value, confidence) of an escalated field."""
    decision = first_reason(
        (new_fails & ~fails, "keep_primary_validators"),
        (fails & ~new_fails, "escalation_passes_validators"),
        (fails & new_fails, "both_fail_validators"),
        (new_confidence > confidence, "escalation_higher_confidence"),
        otherwise="keep_primary_confidence",
    )
    took = decision.isin("escalation_passes_validators", "escalation_higher_confidence")
    return F.struct(decision.alias("decision"), F.when(took, new_value).otherwise(value).alias("value"), F.when(took, new_confidence).otherwise(confidence).alias("confidence"))


def answer_type(name: Column) -> Column:
    """The type an answer must look like, or null."""
    base = F.regexp_replace(name, r"^line[0-9]+_", "")
    return (
        F.when(base.endswith("npi"), "npi")
        .when(base == "patient_zip", "zip")
        .when(base.isin("cpt_code", "hcpcs"), "cpt")
        .when(base == "rev_code", "rev_code")
        .when(base.isin("total_charge", "total_charges", "charges", "amount_paid"), "currency")
        .when(base.startswith("diagnosis_code") | (base == "principal_dx"), "icd10")
        .when(base.contains("date") | (base == "patient_dob"), "date")
    )


def grounding_rejects(name: Column, value: Column, visible: Column, optional: Column, parse_error: Column) -> Column:
    """Reasons why an answer may not compete; an empty array if there are none."""
    own, seen = F.trim(F.coalesce(value, F.lit(""))), F.trim(F.coalesce(visible, F.lit("")))
    kind, bare = answer_type(name), F.replace(own, F.lit(" "), F.lit(""))
    shaped = F.lit(True)
    for k, pattern in ANSWER_SHAPES.items():
        shaped = F.when(kind == k, bare.rlike(pattern)).otherwise(shaped)
    reasons = F.array_compact(
        F.array(
            F.when(squash(seen) == "", "no visible_text evidence supplied").when(~F.contains(squash(seen), squash(own)), "ungrounded"),
            F.when(F.length(seen) > MOST_VISIBLE, "visible_text too long"),
            F.when(~shaped, F.concat(F.lit("type mismatch: "), kind)),
        )
    )
    none = F.array().cast("array<string>")
    return F.when(~blank(parse_error), F.array(F.concat(F.lit("unstructured: "), parse_error))).when(own == "", F.when(optional, none).otherwise(F.array(F.lit("empty value on a non-optional field")))).otherwise(reasons)


def crop_allowed(crop_w: Column, crop_h: Column, page_w: Column, page_h: Column) -> Column:
    """The first refusal of a crop, or null: at least 8 pixels, at most a quarter of the page."""
    return F.when((crop_w < 8) | (crop_h < 8), "crop too small").when(crop_w * crop_h > 0.25 * page_w * page_h, "crop over a quarter of the page")


def policy_gate(external: Column, approved: Column, spent: Column, budget: Column, full_page: Column, crop_refusal: Column, cached: Column) -> Column:
    """The first gate that stops a model call, the cache, or CALL."""
    return first_reason(
        (~external, "BLOCKED_EXTERNAL_FORBIDDEN"),
        (~approved, "BLOCKED_MODEL_NOT_APPROVED"),
        (spent >= budget, "BLOCKED_BUDGET"),
        (full_page, "BLOCKED_FULL_PAGE"),
        (crop_refusal.isNotNull(), "BLOCKED_CROP"),
        (cached, "REUSED_CACHED_RESULT"),
        otherwise="CALL",
    )


def status_category(status: Column) -> Column:
    return F.when(status.isin(401, 403), "AUTHENTICATION_ERROR").when(status == 408, "TIMEOUT").when(status == 429, "RATE_LIMIT").when(status >= 500, "PROVIDER_5XX").otherwise("UNKNOWN_PROVIDER_ERROR")


def billed(reported: Column, measured: Column, called: Column, allowance: Column) -> Column:
    """Reported before measured, never an estimate; an unknown price costs the whole allowance."""
    return F.when(~called, 0.0).otherwise(F.coalesce(reported, measured, allowance))


def cost_basis(reported: Column, measured: Column, text_estimate: Column) -> Column:
    """(usd, basis): reported, measured, a lower bound from text, or unknown."""
    return F.struct(F.coalesce(reported, measured, text_estimate).alias("usd"), F.when(reported.isNotNull(), "reported").when(measured.isNotNull(), "measured").when(text_estimate.isNotNull(), "estimate_lower_bound").otherwise("unknown").alias("basis"))


def cost_columns(mode: Column, cost: Column, cached: Column) -> Column:
    """An oracle's cost is projected, a live one measured; cached calls are free."""
    own = F.when(cached, 0.0).otherwise(cost)
    return F.struct(F.when(mode == "oracle", 0.0).otherwise(own).alias("measured_usd"), F.when(mode == "oracle", own).otherwise(0.0).alias("projected_usd"))


def local_candidate(decision: Column, final: Column, primary: Column, primary_conf: Column, retry: Column, retry_conf: Column) -> Column:
    """(value, confidence) that local attempts alone would have given."""
    keep = decision.startswith("keep_primary") | (decision == "rejected_by_grounding")
    p, r = F.coalesce(primary_conf, F.lit(0.0)), F.coalesce(retry_conf, F.lit(0.0))
    take = ~blank(retry) & (blank(primary) | (r > p + 0.05))
    kept = F.struct(final.alias("value"), F.when(same(final, retry), r).otherwise(p).alias("confidence"))
    own = F.struct(F.when(take, retry).otherwise(primary).alias("value"), F.when(take, r).otherwise(p).alias("confidence"))
    return F.when(keep, kept).otherwise(own)


# Fixed names: what each cause of a failure is answered by.
RESOLUTION_OF = {
    "governor_threshold": "governor_threshold_calibration",
    "validator_strictness": "validator_correction",
    "normalization": "deterministic_normalization",
    "oracle_limitation": "multimodal_escalation",
    "crop_accuracy": "better_local_crop_strategy",
    "ocr_segmentation": "field_specific_ocr_mode",
    "field_mapping": "better_local_crop_strategy",
    "preprocessing": "better_local_crop_strategy",
    "genuinely_unreadable_source": "human_review_only",
}


def resolution_of(cause: Column) -> Column:
    return first_reason(*((cause == c, r) for c, r in RESOLUTION_OF.items()), otherwise="human_review_only")


def root_cause(state: Column, correct: Column, rule_failed: Column, truth: Column, final: Column, primary: Column, rejected: Column, primary_outcome: Column, retry_outcome: Column, escalation_outcome: Column, shorter_side: Column, truth_type: Column, tier: Column) -> Column:
    """The cause of a failure: ten rules, the first that holds; resolution_of() has its answer."""
    bare = lambda x: F.lower(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\W", ""))
    spelled = lambda x: ~same(x, truth) & (bare(x) == bare(truth))
    n = F.length(F.coalesce(truth, F.lit("")))
    # fixed names of causes
    rules = [
        ((state == HUMAN) & correct, "governor_threshold"),
        (rule_failed & correct, "validator_strictness"),
        (spelled(final), "normalization"),
        (rejected | ((primary_outcome == "correct") & (escalation_outcome == "incorrect")), "oracle_limitation"),
        (spelled(primary), "normalization"),
        (F.coalesce(shorter_side < 50, F.lit(False)), "crop_accuracy"),
        ((primary_outcome == "missing") | (retry_outcome == "missing") | (n <= 2), "ocr_segmentation"),
        ((n >= 20) & (truth_type == "alphabetic"), "field_mapping"),
        (tier == "ugly", "preprocessing"),
    ]
    return first_reason(*rules, otherwise="genuinely_unreadable_source")
