"""URL filter: host and path rules first, then naive Bayes over segmented names.

Host labels are concatenated words; a Viterbi search over unigram counts splits them.
Multinomial naive Bayes scores the words of host and path.  It learns from the URLs
that a rule decides, all of them, with counts made by Spark.

Both models are whole: the counts of all words and tokens are written tables, of which only
totals reach the driver.  Each distinct host label gets its matching words by a join of its
substrings, each distinct host and path the counts of its tokens by a join; tasks see those only.
Long texts stand under their MD5 in the joins.

Defined results: the host stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the
end, A-Z in lower case; the path goes on to ``?``, ``#`` or the end; null or no ``://``
leave both empty, and no rule fits.  A rule's host fits itself and its subdomains; of
several rules the longest wins (of equal ones, the first by name).  Without URLs of both
classes to learn from, the verdict without a rule is that of the one class, or allow.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: A label of a host has 63 bytes at most, so no longer word can be part of one.
LONGEST = 63
#: host and path of the rules, and their verdicts
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        name, slash, rest = rule.partition("/")
        fits = (host == name) | host.endswith("." + name)
        out = F.when(fits & path.startswith(slash + rest), rule).otherwise(out)
    return out


class Segmenter:
    """Splits a name into words of the largest product of unigram probabilities."""

    def __init__(self, counts: dict[str, int], seen: int | None = None) -> None:
        """seen: the sum of all counts, where counts has only the words that a name can need."""
        total = (sum(counts.values()) if seen is None else seen) + 1
        self.cost = {w: -math.log(n / total) for w, n in counts.items() if n > 0}
        self.unknown = math.log(total) + math.log(10)
        self.known: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        """Unknown stretches cost as much as an unseen word and more with their length."""
        if name in self.known:
            return self.known[name]
        best, back = [0.0], [0]
        for end in range(1, len(name) + 1):
            options = []
            for start in range(max(0, end - LONGEST), end):
                word = name[start:end]
                cost = self.cost.get(word, self.unknown + 2.3 * len(word))
                options.append((best[start] + cost, start))
            cost, start = min(options)
            best.append(cost)
            back.append(start)
        out, end = [], len(name)
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        if len(self.known) > 100_000:
            self.known.clear()
        self.known[name] = out[::-1]
        return self.known[name]


def parts_of(text: Column) -> Column:
    """Labels of a host or parts of a path; numbers are one token."""
    found = F.transform(F.split(text, "[^0-9a-z]+"), lambda part: F.regexp_replace(part, "[0-9]+", "0"))
    return F.filter(found, lambda part: part != "")


def _key(text: Column) -> Column:
    return F.unhex(F.md5(text))


class Bayes:
    """Multinomial naive Bayes with add-one smoothing."""

    def __init__(self, counts: dict[str, tuple[int, int]], urls: tuple[int, int], totals: tuple[int, int, int] | None = None) -> None:
        """totals: (sum, sum, number) of all tokens' counts, where counts has only the tokens that a URL needs."""
        self.urls = urls
        *sums, distinct = totals or (*(sum(c[k] for c in counts.values()) for k in (0, 1)), len(counts))
        both = [n + distinct + 1 for n in sums]
        self.weight = {t: math.log((c[1] + 1) / both[1]) - math.log((c[0] + 1) / both[0]) for t, c in counts.items()}
        self.unseen = math.log(1 / both[1]) - math.log(1 / both[0])
        self.prior = math.log((urls[1] + 1) / (urls[0] + 1))

    def blocks(self, found: list[str]) -> tuple[float, bool]:
        """(log odds of block, verdict)."""
        if not all(self.urls):
            return 0.0, bool(self.urls[1])
        odds = self.prior + sum(self.weight.get(t, self.unseen) for t in sorted(found))
        return odds, odds > 0


def word_counts(pages: DataFrame, text_col: str) -> DataFrame:
    """Unigram counts (w, n) of lower-case a-z words of whole pages, without their tags."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"<[^>]*>", " "))
    words = pages.select(F.explode(F.split(plain, "[^a-z]+")).alias("w")).filter(F.length("w").between(2, LONGEST))
    return words.groupBy("w").agg(F.count("*").alias("n"))


def split_labels(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(lk, words) of distinct labels (lk, label)."""
    label = F.col("label")
    starts = labels.filter(F.length("label") > 1).select("lk", "label", F.explode(F.sequence(F.lit(1), F.length("label") - 1)).alias("at"))
    # a label's own text from one place on, so that long labels don't stand in every row
    tails = starts.select("lk", label.substr(F.col("at"), F.lit(LONGEST)).alias("tail"))
    heads = F.transform(F.sequence(F.lit(2), F.length("tail")), lambda n: F.col("tail").substr(F.lit(1), n))
    found = tails.select("lk", F.explode(heads).alias("w")).join(words, "w").select("lk", F.struct("w", "n").alias("found"))
    found = found.groupBy("lk").agg(F.collect_list("found").alias("found"))
    seen = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [Segmenter({x["w"]: x["n"] for x in known or ()}, seen).split(label) for label, known in zip(*(c.to_pylist() for c in batch.columns[1:]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["lk", "words"])

    return labels.join(found, "lk", "left").select("lk", "label", "found").mapInArrow(split, "lk binary, words array<string>")


def _sums(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("good", "bad")))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, block_odds) a row."""
    scratch = Scratch(pages.sparkSession)
    words = scratch.put("words", word_counts(pages, text_col))
    ruled = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = ruled.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = scratch.put("ruled", ruled.withColumns({"hk": _key(F.col("host")), "pk": _key(F.col("path"))}))
    block = {r for r, v in rules if v == "block"}

    hosts = ruled.groupBy("hk").agg(F.first("host").alias("host")).select("hk", F.explode(parts_of(F.col("host"))).alias("label"))
    hosts = scratch.put("hosts", hosts.withColumn("lk", _key(F.col("label"))))
    splits = split_labels(scratch.put("labels", hosts.groupBy("lk").agg(F.first("label").alias("label"))), words)
    spoken = hosts.join(splits, "lk").select("hk", F.explode("words").alias("word"))
    spoken = scratch.put("spoken", spoken.select("hk", F.concat(F.lit("h:"), "word").alias("token")))

    bad = F.col("rule").isin(*block) if block else F.lit(False)
    seen = ruled.filter("rule is not null").withColumns({"good": F.when(bad, 0).otherwise(1), "bad": F.when(bad, 1).otherwise(0)})
    part = F.concat(F.lit("p:"), "part").alias("token")
    learned = _sums(seen, "hk").join(spoken, "hk").select("token", "good", "bad")
    learned = learned.unionByName(seen.select(F.explode(parts_of(F.lower("path"))).alias("part"), "good", "bad").select(part, "good", "bad"))
    table = scratch.put("tokens", _sums(learned, "token"))
    urls, totals = _sums(seen).first(), _sums(table).first()
    urls, totals = (urls.good, urls.bad), (totals.good, totals.bad, table.count())

    def counted(tokens: DataFrame, key: str) -> DataFrame:
        """All tokens of a text with their counts; 0 and 0 of those that no rule has seen."""
        rows = tokens.join(table, "token", "left").fillna(0, ["good", "bad"])
        return rows.groupBy(key).agg(F.collect_list(F.struct("token", "good", "bad")).alias(key + "_found"))

    paths = ruled.groupBy("pk").agg(F.first("path").alias("path")).select("pk", F.explode(parts_of(F.lower("path"))).alias("part"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict, odds = [], []
            for rule, *found in zip(*(batch.column(n).to_pylist() for n in ("rule", "hk_found", "pk_found"))):
                known = [t for x in found for t in x or ()]
                o, is_bad = Bayes({t["token"]: (t["good"], t["bad"]) for t in known}, urls, totals).blocks([t["token"] for t in known])
                odds.append(o)
                verdict.append("block" if (is_bad if rule is None else rule in block) else "allow")
            kept = batch.select(["id", "host", "path", "rule"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(verdict, pa.string()), pa.array(odds, pa.float64())], [*kept.schema.names, "verdict", "block_odds"])

    full = ruled.join(counted(spoken, "hk"), "hk", "left").join(counted(paths.select("pk", part), "pk"), "pk", "left")
    kind = pages.schema[id_col].dataType.simpleString()
    return full.select("id", "host", "path", "rule", "hk_found", "pk_found").mapInArrow(decide, f"id {kind}, host string, path string, rule string, verdict string, block_odds double").withColumnRenamed("id", id_col)
