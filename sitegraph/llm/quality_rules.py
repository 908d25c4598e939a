"""Quality rules by document, and a verdict on each host from how often its documents fail them.

Only DataFrame functions. A document's counts are made inside its row, so texts are not shuffled;
what travels is one narrow row per document and one per host. A host's failure rate is shrunk
towards the rate of all hosts with a beta prior fitted to them (method of moments), so that a host
of few documents is not judged by those alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegraph.session import cut

# Fixed values of the counts: white space between words, symbols, words in a window.
BREAKS = "[\\x20\\x09-\\x0D]+"
WORD_CHARACTER = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 3

#: Rejected hosts that are broadcast, some 50 bytes each; beyond that their join shuffles the texts.
BROADCAST_HOSTS = 100_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """Base rules of a document, and the shrunk failure rate from which a host is rejected."""

    least_words: int = 50
    most_repeat_percent: int = 50
    host_rate: float = 0.8
    #: Strength of the prior (documents) where the hosts' rates do not vary, and at most.
    most_strength: float = 1e6


def _with_words(df: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return df.withColumns(
        {
            "_text": text,
            "_words": F.array_remove(F.split(text, BREAKS), ""),
            "_lines": F.filter(F.split(text, "\\n"), lambda line: line.rlike(WORD_CHARACTER)),
        }
    )


def _with_windows(df: DataFrame) -> DataFrame:
    """64-bit hashes of the 3-word windows, by the position of their first word."""
    words = F.col("_words")
    starts = F.slice(words, 1, F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    hashes = F.transform(starts, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return df.withColumn("_windows", hashes)


def _with_sorted(df: DataFrame) -> DataFrame:
    """Windows with their positions, equal ones together; NULL where all windows differ."""
    windows = F.col("_windows")
    repeats = F.size(F.array_distinct(windows)) < F.size(windows)
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return df.withColumn("_sorted", F.when(repeats, pairs))


def _repeat_words() -> Column:
    """Words covered by windows found twice or more: over their positions in order, each adds up to three."""
    pairs = F.col("_sorted")

    def position(pair: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get(pairs, k - 1)["h"])
        return F.when(before.eqNullSafe(pair["h"]) | F.get(pairs, k + 1)["h"].eqNullSafe(pair["h"]), pair["i"])

    found = F.array_sort(F.array_compact(F.transform(pairs, position)))
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(-WINDOW).alias("last"))
    covered = F.aggregate(
        found,
        start,
        lambda acc, i: F.struct(
            (acc["words"] + F.least(F.lit(WINDOW), i - acc["last"]).cast("long")).alias("words"), i.alias("last")
        ),
        lambda acc: acc["words"],
    )
    return F.coalesce(covered, F.lit(0).cast("long"))


def with_counts(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """`df` with the five counts and base_failed."""
    counted = _with_sorted(_with_windows(_with_words(df))).select(
        *df.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words().alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < rules.least_words) | (
        100 * F.col("n_repeat_words") > rules.most_repeat_percent * F.col("n_words")
    )
    return counted.withColumn("base_failed", failed)


def host_verdicts(judged: DataFrame, host: str, rules: Rules = Rules()) -> DataFrame:
    """Per host (NULL is one): documents, failures, the shrunk rate, and whether it is rejected.

    `judged` has the host and base_failed, and is read twice. The prior is two numbers.
    """
    hosts = judged.groupBy(host).agg(
        F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures")
    )
    failures, docs = F.col("host_failures"), F.col("host_docs")
    sums = hosts.agg(
        F.sum(docs).alias("n"), F.sum(failures).alias("k"), F.sum(failures * failures / docs).alias("squares")
    ).first()
    alpha, beta = beta_prior(sums["n"], sums["k"], sums["squares"], rules.most_strength)
    rate = (failures + F.lit(alpha)) / (docs + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > rules.host_rate)


def beta_prior(n: int | None, k: int | None, squares: float | None, most: float) -> tuple[float, float]:
    """Moments of the hosts' rates, weighted by documents: n documents, k failures, sum of n_h * rate_h^2."""
    if not n:
        return 0.0, 1.0
    mean = k / n
    variance = squares / n - mean * mean
    strength = min(most, mean * (1 - mean) / variance - 1) if variance > 1e-12 else most
    strength = max(strength, 1e-6)
    return mean * strength, (1 - mean) * strength


def judged_documents(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """doc_id, the counts, base_failed, host_rate and kept, one row per row of `docs`.

    A document is kept if it passes the base rules and its host is not rejected. A NULL text has no
    words. Documents of a NULL host share one. Repeated rows count as often as they occur. Columns
    other than doc_id, text and the host are not read. An empty table gives an empty result.
    """
    narrow = docs.select("doc_id", "text", F.col(host).alias("_host"))
    judged = cut(with_counts(narrow, rules).drop("text"))
    verdicts = host_verdicts(judged, "_host", rules).select(F.col("_host").alias("_name"), "host_rate", "host_rejected")
    joined = judged.join(verdicts, judged["_host"].eqNullSafe(verdicts["_name"]))
    kept = ~F.col("base_failed") & ~F.col("host_rejected")
    return joined.select("doc_id", *COUNTS, "base_failed", F.round("host_rate", 9).alias("host_rate"), kept.alias("kept"))


def kept_documents(docs: DataFrame, host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of `docs` that the rules keep, with their columns.

    Counts are made twice, once for the hosts and once beside the text, so that texts are not
    shuffled: only rejected hosts are joined, and up to `BROADCAST_HOSTS` of them are broadcast.
    """
    narrow = docs.select("doc_id", "text", F.col(host).alias("_host"))
    judged = cut(with_counts(narrow, rules).select("_host", "base_failed"))
    rejected = cut(host_verdicts(judged, "_host", rules).where("host_rejected").select(F.col("_host").alias("_name")))
    if rejected.count() <= BROADCAST_HOSTS:
        rejected = F.broadcast(rejected)
    named = {c: f"_c{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select([F.col(c).alias(n) for c, n in named.items()])
    # The row id keeps the filter above the counts: pushed below, it would repeat them inside each other.
    counted = with_counts(renamed.withColumn("text", F.col(named["text"])), rules)
    good = counted.withColumn("_row", F.monotonically_increasing_id()).where("NOT base_failed AND _row >= 0")
    passed = good.join(rejected, good[named[host]].eqNullSafe(rejected["_name"]), "left_anti")
    return passed.select([F.col(n).alias(c) for c, n in named.items()])


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT k, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS g
  FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w) x
), r AS (
  SELECT k, count(DISTINCT i + j) AS n FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) x,
    (VALUES (0), (1), (2)) o(j) WHERE c > 1 GROUP BY k
), f AS (
  SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN r ON r.k = w.k
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
), h AS (
  SELECT source, count(*) AS n, CAST(sum(CAST(base_failed AS INTEGER)) AS DOUBLE) AS q FROM b GROUP BY source
), m AS (
  SELECT sum(q) / sum(n) AS m, sum(q * q / n) / sum(n) - (sum(q) / sum(n)) * (sum(q) / sum(n)) AS v FROM h
), p AS (
  SELECT m, greatest(CASE WHEN v > 1e-12 THEN least(1e6, m * (1 - m) / v - 1) ELSE 1e6 END, 1e-6) AS s FROM m
), v AS (
  SELECT source, (q + m * s) / (n + s) AS host_rate FROM h, p
)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(v.host_rate, 9) AS host_rate,
  NOT base_failed AND NOT v.host_rate > 0.8 AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
