"""Quality rules at the level of hosts, in DataFrame operations only.

Document rules are counted by host (pre-aggregated before the shuffle, so a host with a third of all rows costs one row a task).
The hosts' failure rates are shrunk towards a beta prior that is fitted to the hosts' own rates by moments, and
the hosts' verdicts are joined back to the documents. The prior counts as at most so many documents as a host has on average, so that
it can't drown a host of usual size. A host is rejected if its posterior rate, less DEVIATIONS standard deviations, is above the limit:
MOST_FAILED, or what is far from the prior, DEVIATIONS of its standard deviations and TIMES its mean, whichever of the two is less.

A null text is empty and fails; a null host is a host of its own. A single document's host is judged mostly by the prior.
Ties count as kept. Equal rows get equal results; an empty table gives an empty result. Very long texts count whole.
Columns added (FEATURES, base_failed, host_rate, kept) replace columns of their names; others are left alone, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capwindow.llm import common

LEAST_WORDS, MOST_REPEATED = 50, 50
#: Host rules: symbols per 100 words, repeated lines per 100 words.
MOST_SYMBOLS, MOST_DUP_LINES = 50, 10
#: The failure rate that no host may surely exceed, and how far from the prior a lower one may be.
MOST_FAILED, DEVIATIONS, TIMES = 0.5, 2.0, 2.0
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def covered(starts: Column) -> Column:
    """How many places windows of three with these sorted starts cover."""
    steps = F.transform(starts, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - x, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda a, b: a + b)


def with_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the counts of FEATURES. Windows are compared by hash; only texts that repeat one sort their windows."""
    words, lines, hashes, windows, ordered, starts = (common.free_name(df, k) for k in ("words", "lines", "hashes", "windows", "ordered", "starts"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumns({words: F.regexp_extract_all(text, F.lit(common.WORD), F.lit(0)), lines: some})
    df = df.withColumns(
        {
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            hashes: F.transform(words, lambda w: F.xxhash64(w)),
        }
    ).drop(words, lines)
    h = F.col(hashes)
    three = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)))
    df = df.withColumn(windows, three).drop(hashes)
    w = F.col(windows)
    by_hash = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(ordered, F.when(F.size(F.array_distinct(w)) < F.size(w), by_hash)).drop(windows)
    o = F.col(ordered)
    found = F.filter(o, lambda x, k: (F.when(k > 0, F.get(o, k - 1)["h"]).eqNullSafe(x["h"])) | (F.get(o, k + 1)["h"].eqNullSafe(x["h"])))
    df = df.withColumn(starts, F.sort_array(F.transform(found, lambda x: x["i"]))).drop(ordered)
    return df.withColumn("n_repeat_words", F.coalesce(covered(F.col(starts)), F.lit(0)).cast("long")).drop(starts)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def rule_failed() -> Column:
    """What counts against a host: the base rules, and too many symbols or repeated lines."""
    return base_failed() | (100 * F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words")) | (100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_words"))


def host_key(host_col: str) -> Column:
    return F.when(F.col(host_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(host_col)))


def host_verdicts(featured: DataFrame, host_col: str = "source", most_failed: float = MOST_FAILED) -> DataFrame:
    """(host, host_rate, host_kept): the key and the posterior mean of each host's failure rate, and its verdict."""
    hosts = common.cut(featured.groupBy(host_key(host_col).alias("host")).agg(F.count("*").alias("docs"), F.count_if(rule_failed()).alias("failed")))
    rate = F.col("failed") / F.col("docs")
    fit = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.avg(1 / F.col("docs")).alias("u"), F.avg("docs").alias("d")).first()
    mean, docs = fit["m"] or 0.0, fit["d"] or 1.0
    # The rates' variance, less what counting alone brings, is that of the prior.
    between = (fit["v"] or 0.0) - mean * (1 - mean) * (fit["u"] or 0.0)
    strength = min(max(mean * (1 - mean) / between - 1, 1.0), docs) if between > 0 else docs
    limit = min(most_failed, max(mean + DEVIATIONS * math.sqrt(mean * (1 - mean) / (strength + 1)), TIMES * mean))
    shrunk = (F.col("failed") + F.lit(mean * strength)) / (F.col("docs") + F.lit(strength))
    spread = F.sqrt(F.greatest(F.lit(0.0), shrunk * (1 - shrunk)) / (F.col("docs") + F.lit(strength + 1)))
    return hosts.select("host", shrunk.alias("host_rate"), (shrunk - DEVIATIONS * spread <= limit).alias("host_kept"))


def judge(featured: DataFrame, verdicts: DataFrame, host_col: str = "source") -> DataFrame:
    """Documents with base_failed, host_rate and kept."""
    key, rate, verdict = (common.free_name(featured, k) for k in ("host_key", "rate_of_host", "verdict"))
    told = verdicts.select(F.col("host").alias(key), F.col("host_rate").alias(rate), F.col("host_kept").alias(verdict))
    joined = featured.withColumn(key, host_key(host_col)).join(told, key, "left")
    return joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & F.coalesce(verdict, F.lit(True)), "host_rate": F.col(rate)}).drop(key, rate, verdict)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    featured = common.cut(with_features(docs).drop("text"))
    return judge(featured, host_verdicts(featured)).select("doc_id", *FEATURES, "base_failed", "kept", F.round("host_rate", 6).alias("host_rate"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
again AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) s(d) GROUP BY r),
counts AS (SELECT split.r, doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM split LEFT JOIN covered ON split.r = covered.r),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words OR 100 * n_symbols > {MOST_SYMBOLS} * n_words OR 100 * n_dup_lines > {MOST_DUP_LINES} * n_words AS failed FROM counts),
hosts AS (SELECT source, count(*) AS docs, count(*) FILTER (failed) AS bad FROM judged GROUP BY source),
moments AS (SELECT avg(bad / docs) AS m, coalesce(var_samp(bad / docs), 0) AS v, avg(1 / docs) AS u, avg(docs) AS d FROM hosts),
prior AS (SELECT m, CASE WHEN v - m * (1 - m) * u > 0 THEN least(greatest(m * (1 - m) / (v - m * (1 - m) * u) - 1, 1.0), d) ELSE d END AS k FROM moments),
bound AS (SELECT m, k, least({MOST_FAILED}, greatest(m + {DEVIATIONS} * sqrt(m * (1 - m) / (k + 1)), {TIMES} * m)) AS most FROM prior),
rated AS (SELECT source, (bad + m * k) / (docs + k) AS host_rate, docs, k, most FROM hosts, bound)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND host_rate - {DEVIATIONS} * sqrt(greatest(0.0, host_rate * (1 - host_rate)) / (docs + k + 1)) <= most AS kept, round(host_rate, 6) AS host_rate
FROM judged j JOIN rated h ON j.source IS NOT DISTINCT FROM h.source
"""
