"""Model answers, expected names, denominators, provider states, dataset checks, dashboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import ANSWER_SHAPES, HUMAN, TERMINAL, answer_type, clip
from ..functions.text import blank, first_reason, fold_marks, hash_id, strip, strip_fence
from ..functions.typed import ratio
from .ledger import total

# Fixed keys of a strict answer, names of the specification in the extraction schema, failure mix of the double.
ANSWER_KEYS = ("confidence", "reason", "value", "visible_text")
CONTRACT_KEYS = ("confidence", "value", "visible")
ALIASES = {"referring_npi": "referring_provider_npi", "diagnosis_1": "diagnosis_code_a", "diagnosis_2": "diagnosis_code_b", "diagnosis_3": "diagnosis_code_c", "diagnosis_4": "diagnosis_code_d"}
NSF_ALIASES = {"provider_name": "billing_provider_name", "provider_npi": "billing_provider_npi"}
NSF_LINE = {"service_from": "date_from", "service_to": "date_to", "place_of_service": "place_of_service", "procedure_code": "cpt_code", "diagnosis_pointer": "diagnosis_pointer", "charge": "charges", "units": "units"}
UB_LINE = {"revenue_code": "rev_code", "procedure_code": "hcpcs", "service_date": "service_date", "charge": "charges", "units": "units"}
MOST_LINES = 3
MIX = (("prose", 0.02), ("blank", 0.03), ("ungrounded", 0.04), ("wrong", 0.06))
CONFUSED, CONFUSION = "0O1I5S8B2Zoisbz", "O0I1S5B8Z201582"
VOLUMES = (1_000_000, 10_000_000)


def parse_answer(text: Column) -> Column:
    """(value, visible_text, confidence, reason, error) of a strict JSON answer with exactly four keys."""
    v = F.try_parse_json(strip(F.coalesce(text, F.lit(""))))
    keys = F.array_sort(F.json_object_keys(strip(F.coalesce(text, F.lit("")))))
    get = lambda k: F.try_variant_get(v, f"$.{k}", "string")
    error = F.when(v.isNull(), "invalid JSON").when(F.coalesce(F.array_join(keys, ","), F.lit("")) != ",".join(ANSWER_KEYS), "response keys must be exactly " + ", ".join(ANSWER_KEYS))
    own = lambda c: F.when(error.isNull(), c)
    clean = lambda k: strip(fold_marks(F.coalesce(get(k), F.lit(""))))
    return F.struct(
        own(F.nullif(clean("value"), F.lit(""))).alias("value"),
        own(clean("visible_text")).alias("visible_text"),
        F.coalesce(own(clip(F.coalesce(get("confidence").try_cast("double"), F.lit(0.0)))), F.lit(0.0)).alias("confidence"),
        own(F.substring(F.coalesce(get("reason"), F.lit("")), 1, 120)).alias("reason"),
        error.alias("error"),
    )


def contract_answer(text: Column, name: Column, most: int = 120) -> Column:
    """(value, visible, confidence, reject) of a JSON answer with exactly value, visible and confidence.

    The first rule that is broken rejects it: a JSON object, its keys, types, bounds, nothing seen but something
    said, too long for a box, not of the field's shape. A value that is blank is a blank box.
    """
    body = strip_fence(F.coalesce(text, F.lit("")))
    v = F.try_parse_json(body)
    keys = F.array_sort(F.json_object_keys(body))
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")), F.lit("VOID"))
    number = kind("confidence").rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    visible, confidence = F.try_variant_get(v, "$.visible", "boolean"), F.try_variant_get(v, "$.confidence", "double")
    value = F.nullif(strip(fold_marks(F.try_variant_get(v, "$.value", "string"))), F.lit(""))
    shape, bare = answer_type(name), F.replace(value, F.lit(" "), F.lit(""))
    shaped = F.lit(True)
    for k, pattern in ANSWER_SHAPES.items():
        shaped = F.when(shape == k, bare.rlike(pattern)).otherwise(shaped)
    reject = F.nullif(
        first_reason(
            (F.trim(body) == "", "empty"),
            (v.isNull(), "no JSON"),
            (~F.schema_of_variant(v).startswith("OBJECT"), "no object"),
            (F.size(F.array_except(F.array(*map(F.lit, CONTRACT_KEYS)), keys)) > 0, "missing keys"),
            (F.size(keys) > len(CONTRACT_KEYS), "more keys"),
            (~kind("value").isin("STRING", "VOID"), "value type"),
            (kind("visible") != "BOOLEAN", "visible type"),
            (~number, "confidence type"),
            (~confidence.between(0, 1), "confidence bounds"),
            (~visible & value.isNotNull(), "unseen value"),
            (F.coalesce(F.length(value) > most, F.lit(False)), "too long"),
            (F.coalesce(~shaped, F.lit(False)), "shape"),
            otherwise="",
        ),
        F.lit(""),
    )
    fine = reject.isNull()
    return F.struct(F.when(fine, value).alias("value"), F.when(fine, visible).alias("visible"), F.when(fine, confidence).alias("confidence"), reject.alias("reject"))


def expected_names(records: DataFrame, keys: list[str]) -> DataFrame:
    """Records' fields (format_name, field_name, value) under the schema's names; the attending id only with qualifier XX."""
    name, nsf = F.col("field_name"), F.col("format_name") == "NSF320"
    out = name
    for a, b in ALIASES.items():
        out = F.when(name == a, b).otherwise(out)
    for a, b in NSF_ALIASES.items():
        out = F.when(nsf & (name == a), b).otherwise(out)
    xx = records.groupBy(*keys).agg(F.max((name == "attending_qualifier") & (F.col("value") == "XX")).alias("xx"))
    named = records.join(xx, keys).withColumn("field_name", F.when(name == "attending_identifier", F.when(F.col("xx"), "attending_npi")).otherwise(out))
    return named.filter(F.col("field_name").isNotNull() & ~blank(F.col("value"))).select(*keys, "field_name", "value")


def expected_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """The first three service lines (format_name, line_no, field_name, value) as line{n}_{name}."""
    name, nsf = F.col("field_name"), F.col("format_name") == "NSF320"
    out = F.lit(None).cast("string")
    for table, mine in ((NSF_LINE, nsf), (UB_LINE, ~nsf)):
        for a, b in table.items():
            out = F.when(mine & (name == a), b).otherwise(out)
    made = lines.filter(F.col("line_no") <= MOST_LINES).withColumn("target", out).filter(F.col("target").isNotNull() & ~blank(F.col("value")))
    return made.select(*keys, F.concat(F.lit("line"), F.col("line_no").cast("string"), F.lit("_"), "target").alias("field_name"), "value")


def denominators(expected: DataFrame, policy: DataFrame, visible: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, extended, primary, unknown) counts; primary has what is scored, and what is scored if visible."""
    own = expected.filter(~blank(F.col("value"))).join(policy, "field_name", "left").join(visible.select(*keys, "field_name").distinct().withColumn("seen", F.lit(True)), [*keys, "field_name"], "left")
    status = F.col("status")
    primary = (status == "primary_scored") | ((status == "conditional_scored") & F.col("seen").isNotNull())
    return own.groupBy(*keys).agg(F.count("*").alias("extended"), F.count_if(primary).alias("primary"), F.count_if(status.isNull()).alias("unknown"))


def retry_funnel(rows: DataFrame) -> DataFrame:
    c = F.col
    return rows.agg(
        F.count_if(c("eligible")).alias("eligible"),
        F.count_if(c("retried")).alias("retried"),
        F.count_if(c("retried") & ~c("primary_correct")).alias("wrong_retried"),
        F.count_if(c("retried") & c("primary_correct") & (c("category") != "high")).alias("right_low_retried"),
        F.count_if(c("retried") & c("blank")).alias("blank_retried"),
        F.count_if(c("retried") & c("candidate_correct")).alias("candidates_right"),
        F.count_if(c("retried") & c("selected")).alias("selected"),
        F.count_if(~c("final_correct")).alias("unresolved"),
    )


def provider_reason(enabled: Column, model: Column, credential: Column) -> Column:
    return first_reason((~enabled, "disabled by policy"), (blank(model), "model not configured"), (~credential, "credential missing"), otherwise="external calls are not executed by the local workspace")


def workflow_state(attempted: Column, state: Column, eligible: Column) -> Column:
    """How a field's way ends."""
    open_ = ~state.isin(*TERMINAL, "INAPPLICABLE")
    return first_reason((attempted & open_, "MULTIMODAL_FAILED"), (attempted, "MULTIMODAL_ATTEMPTED"), otherwise="HUMAN_REVIEW_REQUIRED")


def request_refusal(synthetic: Column, size: Column, share: Column, most_bytes: int = 2_000_000, most_share: float = 0.25) -> Column:
    """The first rule that a request breaks, or null; an image of unknown origin is refused."""
    rules = ((~synthetic, "CONFIGURATION_ERROR"), (size > most_bytes, "UNSUPPORTED_IMAGE size"), (share.isNull(), "UNSUPPORTED_IMAGE provenance"), (share > most_share, "UNSUPPORTED_IMAGE page"))
    return F.nullif(first_reason(*rules, otherwise=""), F.lit(""))


def split_integrity(split: DataFrame, manifest: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of checks of (doc_id, part), (doc_id), (doc_id, tier, field_name): zeros are sound; digest of the test ids."""
    both = split.groupBy("doc_id").agg(F.count_distinct("part").alias("n")).filter("n > 1")
    twice = manifest.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    ids, known = split.select("doc_id").distinct(), manifest.select("doc_id").distinct()
    sets = truth.groupBy("doc_id", "tier").agg(F.array_sort(F.collect_set("field_name")).alias("names")).groupBy("doc_id").agg(F.count_distinct("names").alias("n")).filter("n > 1")
    count = lambda frame, name: frame.agg(F.count("*").alias(name))
    out = count(both, "overlap")
    for part in (count(twice, "repeated"), count(ids.join(known, "doc_id", "left_anti"), "unknown"), count(known.join(ids, "doc_id", "left_anti"), "unsplit"), count(sets, "uneven_tiers")):
        out = out.crossJoin(part)  # one row each
    return out


def frozen_digest(ids: Column) -> Column:
    """sha256 over sorted ids, a line each; an aggregate of a bounded split."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(ids)), "\n"), 256)


def oracle_answer(doc: Column, field: Column, tier: Column, truth: Column) -> Column:
    """(kind, value, visible): a seeded double of a model; one answer for one field, always."""
    roll = F.crc32(F.concat_ws("|", doc, field, tier).cast("binary")) / F.lit(2.0**32)
    kind, edge = F.lit("right"), 0.0
    edges = []
    for name, share in MIX:
        edge += share
        edges.append((roll < edge, name))
    kind = first_reason(*edges, otherwise="right")
    bad = corrupt(truth)
    value = F.when(kind.isin("prose", "blank"), "").when(kind.isin("ungrounded", "wrong"), bad).otherwise(truth)
    return F.struct(kind.alias("kind"), value.alias("value"), F.when(kind == "wrong", bad).when(kind.isin("prose", "blank"), "").otherwise(truth).alias("visible"))


def corrupt(value: Column) -> Column:
    """The first glyph that is easily confused, confused; else without its last character."""
    at = F.regexp_instr(value, F.lit(f"[{CONFUSED}]"))
    swapped = F.concat(F.expr("''"), F.substring(value, F.lit(1), at - 1), F.translate(F.substring(value, at, F.lit(1)), CONFUSED, CONFUSION), F.substring(value, at + 1, F.length(value)))
    return F.when(blank(value), "0").when(at > 0, swapped).when(F.length(value) > 1, F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(F.concat(value, F.lit("X")))


def private_row(comparisons: DataFrame, keys: list[str]) -> DataFrame:
    """What may leave: names and booleans of each document's comparisons, no values."""
    entry = F.struct("field_name", (F.col("outcome") == "correct").alias("correct"), (~blank(F.col("actual"))).alias("present"))
    return comparisons.groupBy(*keys).agg(F.count("*").alias("evaluated"), F.count_if(F.col("outcome") == "correct").alias("right"), F.count_if(~blank(F.col("actual"))).alias("present"), F.array_sort(F.collect_list(entry)).alias("fields"))


def cost_dashboard(fields: DataFrame, human_usd: float = 0.03) -> DataFrame:
    """Costs by basis, never added up across bases, unit costs, and what volumes would cost."""
    c = F.col
    pages = F.count_distinct("doc_id")
    one = fields.agg(pages.alias("pages"), F.count("*").alias("fields"), F.count_if(c("state") == HUMAN).alias("human"), total(c("local_usd")).alias("local_usd"), total(c("measured_usd")).alias("measured_usd"), total(c("projected_usd")).alias("projected_usd"), F.count_if(c("correct") & c("state").isin(*TERMINAL)).alias("resolved"))
    one = one.withColumns({"measured_per_page_usd": ratio(c("local_usd") + c("measured_usd"), c("pages"), 9), "measured_per_resolved_usd": ratio(c("local_usd") + c("measured_usd"), c("resolved"), 9), "assumed_human_usd": F.bround(c("human") * human_usd, 6)})
    return one.withColumns({f"local_at_{v // 1_000_000}m_usd": F.bround(c("local_usd") / c("pages") * v, 4) for v in VOLUMES})


def with_trailer(rows: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Detail rows and one summary row (its keys are TOTAL), for a CSV."""
    last = rows.agg(*(F.sum(s).alias(s) for s in sums)).select(*(F.lit("TOTAL").alias(k) for k in keys), *sums)
    return rows.select(*(F.col(k).cast("string").alias(k) for k in keys), *sums).withColumn("_last", F.lit(0)).unionByName(last.withColumn("_last", F.lit(1))).orderBy("_last", *keys).drop("_last")


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, of two arrays of one length; null where one doesn't vary."""
    n = F.size(a).cast("double")
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    dev = lambda x: F.transform(x, lambda v: v - mean(x))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    x, y = dev(a), dev(b)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x) * dot(y, y)))


def _unit(x: Column) -> Column:
    """An array less its mean, of length one; null where it doesn't vary."""
    n = F.size(x).cast("double")
    centred = F.transform(x, lambda v: v - F.aggregate(x, F.lit(0.0), lambda s, w: s + w) / n)
    size = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(size > 0, F.transform(centred, lambda v: v / size))


def shifted_correlation(a: Column, b: Column, most: int = 4) -> Column:
    """The best correlation over circular shifts of b by up to ``most`` places; a and b are units (_unit)."""
    roll = lambda k: F.concat(F.slice(b, F.size(b) - k + 1, k), F.slice(b, F.lit(1), F.size(b) - k)) if k > 0 else F.concat(F.slice(b, 1 - k, F.size(b) + k), F.slice(b, 1, -k)) if k < 0 else b
    dot = lambda x: F.aggregate(F.zip_with(a, x, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.array_max(F.array(*(dot(roll(k)) for k in range(-most, most + 1))))


# Fixed weights of the two profiles.
ROWS_WEIGHT, COLUMNS_WEIGHT = 0.45, 0.55
#: Variants of forms that a routing takes; they go to every task.
MOST_VARIANTS = 64


def profile_routes(pages: DataFrame, variants: DataFrame, page: str, least: float = 0.75, margin: float = 0.05) -> DataFrame:
    """(page, form, variant, score): the form whose best variant's profiles are most like the page's, or unknown.

    pages: (page, rows, cols); variants: (form, variant, rows, cols), at most MOST_VARIANTS. A form wins with at least
    ``least``, and ``margin`` before the next form.
    """
    from pyspark.sql import Window

    c = F.col
    held = variants.select("form", "variant", _unit(c("rows")).alias("rows"), _unit(c("cols")).alias("cols")).limit(MOST_VARIANTS + 1).collect()
    if len(held) > MOST_VARIANTS:
        raise ValueError(f"more than {MOST_VARIANTS} variants of forms")
    kind = variants.select(F.array(F.struct("form", "variant", c("rows").cast("array<double>").alias("rows"), c("cols").cast("array<double>").alias("cols"))).alias("v")).schema["v"].dataType.simpleString()
    known = F.array(*(F.struct(F.lit(v.form).alias("form"), F.lit(v.variant).alias("variant"), F.lit(v.rows).alias("rows"), F.lit(v.cols).alias("cols")) for v in held)).cast(kind)
    score = lambda v: ROWS_WEIGHT * shifted_correlation(c("_rows"), v["rows"]) + COLUMNS_WEIGHT * shifted_correlation(c("_cols"), v["cols"])
    own = pages.select(page, _unit(c("rows")).alias("_rows"), _unit(c("cols")).alias("_cols"))
    scored = own.select(page, F.inline(F.transform(known, lambda v: F.struct(v["form"].alias("form"), v["variant"].alias("variant"), F.round(F.coalesce(score(v), F.lit(0.0)), 9).alias("score")))))
    best = scored.groupBy(page, "form").agg(F.max(F.struct("score", "variant")).alias("b")).select(page, "form", "b.score", "b.variant")
    by = Window.partitionBy(page).orderBy(F.desc("score"), "form")
    first = best.withColumns({"k": F.row_number().over(by), "second": F.coalesce(F.lead("score").over(by), F.lit(0.0))}).filter("k = 1")
    sure = (c("score") >= least) & (c("score") - c("second") >= margin)
    return first.select(page, F.when(sure, c("form")).otherwise("unknown").alias("form"), F.when(sure, c("variant")).alias("variant"), "score")


def document_plan(spark, n: int, seed: int, forms: tuple[str, ...] = ("cms1500", "ub04")) -> DataFrame:
    """(form, claim_seed, doc_id) of a dataset, by arithmetic alone."""
    out = None
    for k, form in enumerate(forms):
        part = spark.range(n).select(F.lit(form).alias("form"), (F.lit(seed * 100_000 + 50_000 * (k > 0)) + F.col("id")).alias("claim_seed"), F.format_string(f"{form}_{seed}_%04d", "id").alias("doc_id"))
        out = part if out is None else out.union(part)
    return out


def file_hashes(files: DataFrame) -> DataFrame:
    """(name, sha256 of the bytes) that don't depend on the kind of line ends, for freeze manifests."""
    lines = F.regexp_replace(F.decode("content", "ISO-8859-1"), r"\r\n?", "\n")
    return files.select("name", F.sha2(F.encode(lines, "ISO-8859-1"), 256).alias("sha256"))


def manifest_differences(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """Names whose hash changed, or that are only on one side."""
    both = frozen.withColumnRenamed("sha256", "was").join(now.withColumnRenamed("sha256", "is"), "name", "full")
    return both.filter(~F.col("was").eqNullSafe(F.col("is")))


def fingerprint(session: Column, field: Column, crop: Column, model: Column) -> Column:
    """Tells a repeated request; 32 hex digits."""
    return hash_id(F.concat_ws("|", session, field, crop, model), 32)
