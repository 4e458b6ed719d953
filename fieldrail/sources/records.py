"""JSON records: logs, truth files, nested lines; idempotent appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = "ts string, doc_id string, page_id string, field string, operation string, cost_usd double, latency_ms double, meta map<string,string>"
TRUTH = "doc_id string, page_id string, form string, tier string, seed long, fields map<string,struct<value:string,bbox:array<double>>>"


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Blank lines are passed over; a missing path is an empty table."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Rows as further JSON lines below a path, money to 8 places and times to 2; what is there stays as it is."""
    places = {"cost_usd": 8, "latency_ms": 2}
    rows.withColumns({n: F.bround(F.coalesce(n, F.lit(0.0)), k) for n, k in places.items() if n in rows.columns}).write.mode("append").json(path)


def truth_fields(truth: DataFrame) -> DataFrame:
    """(doc_id, page_id, form, tier, field_name, value) of truth documents."""
    return truth.select("doc_id", "page_id", "form", "tier", F.explode("fields").alias("field_name", "f")).select("doc_id", "page_id", "form", "tier", "field_name", F.col("f.value").alias("value"))


def flatten_lines(rows: DataFrame, lines: str, keep: list[str]) -> DataFrame:
    """Keys of an array of maps as ``line{n}_{key}`` rows."""
    one = rows.select(*keep, F.posexplode(lines).alias("n", "line"))
    pairs = one.select(*keep, "n", F.explode("line").alias("key", "value"))
    return pairs.select(*keep, F.concat(F.lit("line"), (F.col("n") + 1).cast("string"), F.lit("_"), F.col("key")).alias("field_name"), "value")


def append_once(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of new whose key isn't there yet, one a key."""
    return new.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def resume(targets: DataFrame, done: DataFrame, keys: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """Targets that aren't done yet, in order; at most limit."""
    left = targets.join(done.select(*keys).distinct(), keys, "left_anti").orderBy(*order)
    return left if limit is None else left.limit(limit)


def page_json(fields: DataFrame) -> DataFrame:
    """(doc_id, page_id, json): the fields of a page as one JSON object."""
    entry = F.struct("field_name", F.struct("value", "state", F.bround("confidence", 4).alias("confidence")).alias("v"))
    return fields.groupBy("doc_id", "page_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("json"))


def synthetic_claims(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Seeded claims with lines whose cents add up and an identifier with its check digit."""
    base = spark.range(n).withColumn("r", F.xxhash64(F.lit(seed), "id"))
    nine = F.concat(F.lit("1"), F.lpad(F.pmod("r", F.lit(100_000_000)).cast("string"), 8, "0"))
    padded = F.concat(F.lit("80840"), nine)
    # the check digit makes the doubled sum a multiple of ten
    total = sum((F.when((d := F.substring(padded, 14 - i, 1).cast("int") * (2 if i % 2 == 0 else 1)) > 9, d - 9).otherwise(d) for i in range(14)), F.lit(0))
    npi = F.concat(nine, F.pmod(10 - total % 10, F.lit(10)).cast("string"))
    count = (F.pmod("r", F.lit(3)) + 1).cast("int")
    lines = F.transform(F.sequence(F.lit(1), count), lambda k: F.struct(k.alias("line_no"), (F.pmod(F.xxhash64("r", k), F.lit(90_000)) + 1000).alias("cents")))
    out = base.select(F.format_string("claim_%d_%06d", F.lit(seed), "id").alias("doc_id"), npi.alias("billing_provider_npi"), lines.alias("lines"))
    return out.withColumn("total_cents", F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["cents"]))


# Fixed values of hospital claims: revenue codes with their procedure, bill types, diagnoses, payers.
UB_PROCEDURES = {"0250": "", "0300": "80053", "0450": "99284", "0510": "99213", "0730": "93005"}
UB_BILL_TYPES = ("0111", "0131", "0851")
UB_DIAGNOSES = ("E11.9", "I10", "M54.5", "J06.9", "K21.9", "F41.1", "N39.0", "R51.9", "E78.5", "J45.909")
UB_PAYERS = ("Aetna", "UnitedHealthcare", "Cigna", "BCBS", "Humana", "Medicare")


def draw(seed: Column, what: str | Column, n: int) -> Column:
    """One of 0..n-1, by the SHA-256 of ``seed:what``."""
    what = F.lit(what) if isinstance(what, str) else what
    return F.conv(F.substring(F.sha2(F.concat_ws(":", seed.cast("string"), what), 256), 1, 8), 16, 10).cast("long") % n


def check_digit(nine: Column) -> Column:
    """What makes the doubled sum of the prefix, nine digits and itself a multiple of ten."""
    padded = F.concat(F.lit("80840"), nine)
    total = sum((F.when((d := F.substring(padded, 14 - i, 1).cast("int") * (2 if i % 2 == 0 else 1)) > 9, d - 9).otherwise(d) for i in range(14)), F.lit(0))
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def synthetic_ub_claims(seeds: DataFrame, seed: str) -> DataFrame:
    """Hospital claims, one a row of seeds: fields, two or three lines of different revenue codes, a total that is theirs.

    Only the seed decides; provider numbers have their check digits, statements end by three days after they begin.
    """
    s = F.col(seed)
    pick = lambda what, of: F.element_at(F.array(*map(F.lit, of)), (draw(s, what, len(of)) + 1).cast("int"))
    number = lambda what, low, high: (draw(s, what, high - low + 1) + low).cast("string")
    nine = lambda what: F.concat(F.lit("1"), F.lpad(draw(s, what, 100_000_000).cast("string"), 8, "0"))
    day = lambda d: F.concat(F.lpad((draw(s, "month", 5) + 1).cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"), F.lit("26"))
    first = draw(s, "day", 28) + 1
    money = lambda cents: F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    # codes in the order of their draws: the first two or three of them
    order = F.array_sort(F.array(*(F.struct(draw(s, f"code:{code}", 1 << 30).alias("k"), F.lit(code).alias("rev_code"), F.lit(hcpcs).alias("hcpcs")) for code, hcpcs in UB_PROCEDURES.items())))
    cents = lambda code: draw(s, F.concat(F.lit("cents:"), code), 7020) * 25 + 9500
    chosen = F.transform(F.slice(order, F.lit(1), (draw(s, "lines", 2) + 2).cast("int")), lambda x: F.struct(x["rev_code"], x["hcpcs"], (draw(s, F.concat(F.lit("units:"), x["rev_code"]), 4) + 1).cast("string").alias("units"), cents(x["rev_code"]).alias("cents")))
    base = seeds.select(s, chosen.alias("_lines"))
    npi = lambda what: F.concat(nine(what), check_digit(nine(what)))
    return base.select(
        seed,
        pick("bill", UB_BILL_TYPES).alias("type_of_bill"),
        F.concat(F.lit("PC"), number("control", 1_000_000, 9_999_999)).alias("patient_control_no"),
        F.concat(F.lit("MR"), number("record", 100_000, 999_999)).alias("medical_record_no"),
        F.concat(number("tax", 10, 99), F.lit("-"), number("tax no", 1_000_000, 9_999_999)).alias("federal_tax_no"),
        day(first).alias("statement_from"),
        day(F.least(first + draw(s, "stay", 4), F.lit(28))).alias("statement_to"),
        day(first).alias("admission_date"),
        pick("sex", ("M", "F")).alias("patient_sex"),
        pick("payer", UB_PAYERS).alias("payer_name"),
        pick("dx", UB_DIAGNOSES).alias("principal_dx"),
        npi("provider").alias("provider_npi"),
        npi("attending").alias("attending_npi"),
        F.concat(F.substring(F.lit("ABCDEFGHJK"), (draw(s, "letter", 10) + 1).cast("int"), F.lit(1)), number("insured", 100_000_000, 999_999_999)).alias("insured_id"),
        money(F.aggregate("_lines", F.lit(0).cast("long"), lambda a, x: a + x["cents"])).alias("total_charges"),
        F.transform("_lines", lambda x: F.create_map(F.lit("rev_code"), x["rev_code"], F.lit("hcpcs"), x["hcpcs"], F.lit("service_date"), day(first), F.lit("units"), x["units"], F.lit("charges"), money(x["cents"]))).alias("lines"),
    )


def split_documents(docs: DataFrame, seed: int, share: float = 0.4) -> DataFrame:
    """A seeded split stratified by form: calibration or test.

    The floor(n * share) documents of a form with the least hashes are for calibration, by a
    threshold that is searched without putting a form's documents into one task.
    """
    from ..operators.ledger import nearest_ranks

    hashed = docs.withColumn("_h", F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 15), 16, 10).cast("long"))
    last = F.floor(F.col("n") * F.lit(str(share)).cast("decimal(6,4)"))
    cut = nearest_ranks(hashed, "form", "_h", {"last": last}).select(F.col("form").alias("_form"), F.col("last").alias("_last"))
    both = hashed.join(cut, F.col("form").eqNullSafe(F.col("_form")), "left")
    return both.withColumn("part", F.when(F.col("_h") <= F.col("_last"), "calibration").otherwise("test")).drop("_h", "_form", "_last")
