"""Cost ledger reports: (doc_id, page_id, operation, cost_usd, latency_ms) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank
from ..functions.typed import ratio

MONEY = "decimal(38,8)"


def total(x: Column) -> Column:
    """A sum that doesn't depend on the order of the rows."""
    return F.sum(x.cast(MONEY)).cast("double")


def summary(ledger: DataFrame) -> DataFrame:
    """A row for each operation and one for all (operation null): calls, cost, latency, pages, cost a page."""
    page = F.when(~blank(F.col("page_id")), F.struct("doc_id", "page_id"))
    sums = [F.count("*").alias("calls"), F.bround(total(F.col("cost_usd")), 6).alias("cost_usd"), F.bround(total(F.col("latency_ms")), 1).alias("latency_ms"), F.count_distinct(page).alias("pages")]
    out = ledger.groupingSets([["operation"], []], "operation").agg(*sums)
    return out.withColumn("cost_per_page_usd", F.coalesce(ratio(F.col("cost_usd"), F.col("pages"), 6), F.lit(0.0)))


def stage_costs(ledger: DataFrame) -> DataFrame:
    out = ledger.groupBy("operation").agg(F.count("*").alias("calls"), F.bround(total(F.col("cost_usd")), 8).alias("cost_usd"))
    return out.orderBy(F.desc("cost_usd"), "operation")


def nearest_ranks(rows: DataFrame, by: str, value: str, targets: dict[str, Column], slices: int = 200) -> DataFrame:
    """(by, n, a column a target): the value at the place that a target makes of n, the number of by's values.

    Values are counted first; each key's distinct values are cut into slices of like size, the slice
    with the place is found by running totals of slices, and only its values are put in order.
    No task takes all values of a key.
    """
    own = rows.filter(F.col(value).isNotNull()).select(F.struct(F.col(by).alias("key")).alias("_k"), F.col(value).alias("_v"))
    counts = own.groupBy("_k", "_v").agg(F.count("*").alias("_n"))
    edges = counts.groupBy("_k").agg(F.percentile_approx("_v", [k / slices for k in range(1, slices)], 10 * slices).alias("_edges"))
    cut = counts.join(edges, "_k").select("_k", "_v", "_n", F.size(F.filter("_edges", lambda e: e < F.col("_v"))).alias("_slice"))
    sums = cut.groupBy("_k", "_slice").agg(F.sum("_n").alias("_m"))
    by_key = Window.partitionBy("_k")
    placed = sums.withColumns({"_upto": F.sum("_m").over(by_key.orderBy("_slice")), "n": F.sum("_m").over(by_key)})
    wanted = F.array(*(F.struct(F.lit(name).alias("_target"), place.cast("long").alias("_place")) for name, place in targets.items()))
    wanted = placed.select("_k", "_slice", "n", (F.col("_upto") - F.col("_m")).alias("_before"), "_upto", F.inline(wanted))
    wanted = wanted.filter((F.col("_place") > F.col("_before")) & (F.col("_place") <= F.col("_upto")))
    inside = cut.join(wanted, ["_k", "_slice"])
    run = F.col("_before") + F.sum("_n").over(Window.partitionBy("_k", "_target").orderBy("_v"))
    found = inside.withColumn("_run", run).filter(F.col("_run") >= F.col("_place")).groupBy("_k", "n", "_target").agg(F.min("_v").alias("_found"))
    return found.groupBy("_k", "n").pivot("_target", list(targets)).agg(F.first("_found")).select(F.col("_k.key").alias(by), "n", *targets)


def percentiles(rows: DataFrame, by: str, value: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Nearest rank: the value at place ceil(share * n)."""
    places = {f"p{round(q * 100)}": F.greatest(F.ceil(F.col("n") * F.lit(str(q)).cast("decimal(6,4)")), F.lit(1)) for q in shares}
    return nearest_ranks(rows, by, value, places).drop("n")


def projection(local_per_page: Column, api_per_page: Column, human_rate: Column, pages: Column, human_usd: float = 0.03) -> Column:
    """Costs of a volume: local, api, automated, and people's as an assumption of its own."""
    return F.struct((local_per_page * pages).alias("local_usd"), (api_per_page * pages).alias("api_usd"), ((local_per_page + api_per_page) * pages).alias("automated_usd"), (human_rate * pages * human_usd).alias("human_usd"))


def last_of_key(ledger: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Repeated operations of a key collapse into the last."""
    value = F.struct(*(c for c in ledger.columns if c not in keys))
    return ledger.groupBy(*keys).agg(F.max_by(value, order).alias("v")).select(*keys, "v.*")


def first_of_key(ledger: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Repeated operations of a key collapse into the first."""
    value = F.struct(*(c for c in ledger.columns if c not in keys))
    return ledger.groupBy(*keys).agg(F.min_by(value, order).alias("v")).select(*keys, "v.*")
