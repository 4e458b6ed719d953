"""Small fixed tables: field policy, error categories, prices. They are code, so their size is bounded."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Policy:
    """criticality; whether it may be blank, flagged, sent to a model outside; names of its rules."""

    criticality: str
    optional: bool = False
    allow_flag: bool = False
    external_allowed: bool = True
    rules: str = ""


# What holds for each field; names of service lines begin with "line:".
POLICY = {
    "insured_id": Policy("high", rules="id_format"),
    "patient_name": Policy("high", rules="name_format"),
    "patient_dob": Policy("high", rules="date_valid dob_before_service"),
    "patient_sex": Policy("low", allow_flag=True),
    "insured_name": Policy("med", rules="name_format"),
    "patient_address": Policy("low", allow_flag=True, external_allowed=False),
    "patient_city": Policy("low", allow_flag=True),
    "patient_state": Policy("low", allow_flag=True),
    "patient_zip": Policy("med", rules="zip_format"),
    "patient_relationship": Policy("low", allow_flag=True),
    "insurance_plan_name": Policy("med"),
    "diagnosis_code_a": Policy("high", rules="icd10_format icd10_dictionary"),
    "diagnosis_code_b": Policy("high", optional=True, rules="icd10_format icd10_dictionary"),
    "diagnosis_code_c": Policy("high", optional=True, rules="icd10_format icd10_dictionary"),
    "diagnosis_code_d": Policy("high", optional=True, rules="icd10_format icd10_dictionary"),
    "federal_tax_id": Policy("high", rules="tax_id_format"),
    "patient_account_no": Policy("med"),
    "total_charge": Policy("high", rules="currency_format claim_arithmetic"),
    "amount_paid": Policy("med", optional=True, rules="currency_format"),
    "billing_provider_name": Policy("med", rules="org_name_format"),
    "billing_provider_npi": Policy("high", rules="npi_checksum"),
    "referring_provider_npi": Policy("high", optional=True, rules="npi_checksum"),
    "line:date_from": Policy("high", rules="date_valid dob_before_service"),
    "line:date_to": Policy("med", rules="date_valid"),
    "line:place_of_service": Policy("low", allow_flag=True),
    "line:cpt_code": Policy("high", rules="cpt_format cpt_dictionary"),
    "line:diagnosis_pointer": Policy("med", allow_flag=True),
    "line:charges": Policy("high", rules="currency_format claim_arithmetic"),
    "line:units": Policy("med", rules="numeric_format"),
    "line:rendering_npi": Policy("high", rules="npi_checksum"),
    "line:rev_code": Policy("high", rules="revenue_code_format"),
    "line:hcpcs": Policy("med", optional=True, rules="cpt_format"),
    "line:service_date": Policy("high", rules="date_valid dob_before_service"),
    "provider_npi": Policy("high", rules="npi_checksum"),
    "attending_npi": Policy("high", rules="npi_checksum"),
    "principal_dx": Policy("high", rules="icd10_format icd10_dictionary"),
    "total_charges": Policy("high", rules="currency_format claim_arithmetic"),
    "statement_from": Policy("med", rules="date_valid"),
    "statement_to": Policy("med", rules="date_valid"),
    "admission_date": Policy("med", rules="date_valid"),
    "federal_tax_no": Policy("high", rules="tax_id_format"),
    "provider_name": Policy("med", rules="org_name_format"),
    "payer_name": Policy("med"),
    "patient_control_no": Policy("med"),
    "medical_record_no": Policy("med"),
    "type_of_bill": Policy("med", rules="numeric_format"),
}
ERROR_CATEGORIES = ("AUTHENTICATION_ERROR", "CONFIGURATION_ERROR", "CONTENT_BLOCKED", "INVALID_RESPONSE", "NETWORK_ERROR", "PROVIDER_5XX", "RATE_LIMIT", "TIMEOUT", "UNKNOWN_PROVIDER_ERROR", "UNSUPPORTED_IMAGE")


def field_policy(spark: SparkSession) -> DataFrame:
    """(base_name, scope, criticality, optional, allow_flag, external_allowed, validators)."""
    rows = []
    for name, own in POLICY.items():
        scope, _, base = name.rpartition(":")
        rows.append((base, scope or "page", own.criticality, own.optional, own.allow_flag, own.external_allowed, own.rules.split()))
    return spark.createDataFrame(rows, "base_name string, scope string, criticality string, optional boolean, allow_flag boolean, external_allowed boolean, validators array<string>")


def line_no(name: Column) -> Column:
    return F.regexp_extract(name, r"^line([0-9]+)_(\w+)$", 1).try_cast("int")


def base_name(name: Column) -> Column:
    inner = F.regexp_extract(name, r"^line([0-9]+)_(\w+)$", 2)
    return F.when(inner != "", inner).otherwise(name)


def with_policy(fields: DataFrame, name: str = "field_name") -> DataFrame:
    """fields with their policy; names without one get the defaults."""
    dim = field_policy(fields.sparkSession)
    scope = F.when(line_no(F.col(name)).isNotNull(), "line").otherwise("page")
    keyed = fields.withColumns({"base_name": base_name(F.col(name)), "scope": scope})
    out = keyed.join(F.broadcast(dim), ["base_name", "scope"], "left")
    defaults = {"criticality": F.lit("med"), "optional": F.lit(False), "allow_flag": F.lit(False), "external_allowed": F.lit(True), "validators": F.array().cast("array<string>")}
    return out.withColumns({c: F.coalesce(c, d) for c, d in defaults.items()})
