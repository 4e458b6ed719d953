"""The corpus operators as queries over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read
from .decontaminate import leaked
from .filter_audit import filter_audit
from .html_extract import main_texts
from .importance import resample
from .matroska import media_files, media_report
from .minhash_dedup import near_duplicates
from .sentencepiece_codec import encode
from .substring_dedup import removal_report
from .token_counts import count_tokens
from .token_files import read_report, write_ids
from .toxicity import toxicity_report
from .url_filter import judge
from .warc import derivatives, responses

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by the model, each checked against the sentencepiece library and decoded again."""
    return encode(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), ids=False, parity=True)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark items that leak into them, and the least word edits found."""
    return leaked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to bit-plane files in the order of doc_id, and what the files hold."""
    files = write_ids(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), Scratch(spark), end_id=1)
    return read_report(files)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by overlapping chunks."""
    return count_tokens(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), limit=2048)


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of all pages' responses, as digests."""
    made = derivatives(responses(read(spark, sf_dir, "pages")))
    return made.withColumn("record_bytes", F.octet_length("record").cast("long")).withColumn("record_sha256", F.sha2("record", 256)).drop("record")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return judge(read(spark, sf_dir, "pages"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies: three-word shingles, 85 of 100."""
    return near_duplicates(read(spark, sf_dir, "documents"), size=3, percent=85)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without windows of 13 words that an earlier document has."""
    return removal_report(read(spark, sf_dir, "documents"), size=13)


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text written as a Matroska file to a table, read back from there and described."""
    files = Scratch(spark).put("media", media_files(read(spark, sf_dir, "documents")))
    return media_report(files)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labels that aren't held out."""
    return toxicity_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters keeps and removes in every order, by language."""
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents, drawn towards the benchmark's words: weights, scores and ranks."""
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=25)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_texts(read(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    found = (
        op1_sentencepiece,
        op2_decontamination,
        op3_token_files,
        op4_token_counts,
        op5_warc_derivatives,
        op6_url_filter,
        op7_minhash_near_dedup,
        op8_substring_dedup,
        op9_matroska,
        op10_toxicity,
        op11_filter_audit,
        op12_importance_resampling,
        op13_html_extraction,
    )
    return {f.__name__: f for f in found}


_SPACE = r"[\x20\x09-\x0D]+"
#: Brute force over all windows and all pairs with a common shingle; for small tables.
_REMOVAL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT g, min(doc_id) AS least FROM p GROUP BY g),
r AS (SELECT DISTINCT p.doc_id, p.i + k AS at FROM p JOIN m ON p.g = m.g, range(13) t(k) WHERE m.least < p.doc_id),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.at) FILTER (r.at IS NULL) AS kept, count(r.at) AS gone FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.at = r.at GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""
_NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
c AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT c.doc_id, e.b FROM c JOIN e ON c.r = e.a)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(c.r) AS component_id, d.doc_id = min(c.r) AS kept FROM d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""

_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{_SPACE}'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
y AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END, CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN y USING (doc_id)),
g AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, n, good, toxic, fails = own AS alone, contains(fails, own) AS fail, length(translate(fails, before, '')) < length(fails) AS gone
  FROM g, s),
k AS (
  SELECT part, filter_order, step, own, CAST(coalesce(sum(n) FILTER (NOT fail AND NOT gone), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (fail AND NOT gone), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (fail AND gone), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (fail AND NOT gone AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (fail AND NOT gone AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM k"""
#: CRC-32 by a table of single bytes, over the distinct features.
_RESAMPLE = r"""
WITH z AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(b AS BIGINT))) AS tab),
x AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
w AS (SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda v: v <> '') AS w FROM x),
f AS (SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS feature FROM w),
g AS (SELECT side, id, feature, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT feature, hex(feature) AS h FROM (SELECT DISTINCT feature FROM g)),
c AS (
  SELECT feature, xor(list_reduce(list_transform(range(CAST(length(h) / 2 AS BIGINT)), lambda i: CAST(instr('0123456789ABCDEF', h[2 * i + 1]) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 17 AS BIGINT)),
    lambda s, b: xor(s // 256, tab[1 + xor(s % 256, b)]), 4294967295), 4294967295) % 10000 AS bucket FROM h, z),
b AS (SELECT side, id, bucket, sum(n) AS n FROM g JOIN c USING (feature) GROUP BY ALL),
t AS (SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM b GROUP BY bucket),
a AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM t) + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM t) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM t),
p AS (SELECT id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * gain) AS BIGINT) AS total FROM b JOIN a USING (bucket) WHERE side = 'd' GROUP BY id),
q AS (
  SELECT w.id AS doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS weight,
    CAST('0x' || substr(sha256('7:' || CAST(w.id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM w LEFT JOIN p ON p.id = w.id WHERE w.side = 'd'),
e AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM q),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM e WHERE n_words >= 20)
SELECT e.doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(CASE WHEN place <= (25 * n) // 100 THEN place END AS BIGINT) AS rank, n_words FROM e LEFT JOIN r USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": _AUDIT, "op12_importance_resampling": _RESAMPLE, "op7_minhash_near_dedup": _NEAR, "op8_substring_dedup": _REMOVAL}
