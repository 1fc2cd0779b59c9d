"""Host-level quality rules (operator 4), DataFrame functions only.

Each document is held against a few rules.  Failures are aggregated by host (the
``source`` column), and each host's failure rate is shrunk by a beta prior whose
mean is the pooled rate and whose strength comes from the spread of the hosts'
rates (method of moments), so that a host of few documents is judged near the
average.  Host verdicts are joined back: on a host whose shrunk rate reaches
``HOST_RATE`` a document must pass the strict form of every rule, elsewhere only the
lenient form.  Documents that pass all strict rules stay on any host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import SPACE, TEXT_ROW_GROUP, prepare, staged

#: Shrunk failure rate from which a host is distrusted.
HOST_RATE = 0.5
#: Least words, and most percent of words in repeated 3-word windows (base rule).
LEAST_WORDS, BASE_REPEAT = 50, 50
#: Most per cent: (strict, lenient) of symbols to words, capital letters A-Z to
#: word characters, repeated lines to lines, words in repeated windows to words.
LIMITS = {"symbols": (10, 30), "capitals": (30, 50), "lines": (30, 60), "repeats": (30, 50)}
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"

#: Name of the struct column that the operator adds, and its counts.
VERDICT = "_quality"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def _windows(words: Column) -> Column:
    """Hashes of the 3-word windows of a text."""
    n = F.size(words)
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))


def with_features(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """``docs`` with a struct ``_quality`` of counts and failed rules.  Intermediate
    arrays are plain columns of their own, so that each is computed once."""
    q = lambda name: F.col(f"{VERDICT}_{name}")
    add = lambda df, **columns: df.withColumns({f"{VERDICT}_{k}": v for k, v in columns.items()})
    out = add(docs, t=F.coalesce(F.col(text_col), F.lit("")))
    out = add(out, words=F.filter(F.split(q("t"), SPACE + "+"), lambda w: w != ""),
              lines=F.filter(F.split(q("t"), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    out = add(out, n_words=F.size(q("words")).cast("long"),
              word_chars=F.length(F.translate(q("t"), " \t\n\x0b\x0c\r", "")).cast("long"),
              n_symbols=(F.length(q("t")) - _without(q("t"), SYMBOLS)).cast("long"),
              n_dup_lines=(F.size(q("lines")) - F.size(F.array_distinct(q("lines")))).cast("long"),
              n_lines=F.size(q("lines")).cast("long"),
              n_capitals=(F.length(q("t")) - _without(q("t"), CAPITALS)).cast("long"),
              h=_windows(q("words")))
    # positions of windows that occur again: neighbours in the order of (hash, position)
    out = add(out, s=F.when(F.size(F.array_distinct(q("h"))) < F.size(q("h")), F.sort_array(
        F.transform(q("h"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    m = F.size(q("s"))
    same = lambda a, b: F.get(q("s"), a)["h"] == F.get(q("s"), b)["h"]
    out = add(out, r=F.when(q("s").isNotNull(), F.transform(
        F.filter(F.sequence(F.lit(0), m - 1), lambda j: ((j > 0) & same(j, j - 1)) | ((j < m - 1) & same(j, j + 1))),
        lambda j: F.get(q("s"), j)["i"])))
    covered = F.array_union(F.array_union(q("r"), F.transform(q("r"), lambda i: i + 1)),
                            F.transform(q("r"), lambda i: i + 2))
    out = add(out, n_repeat_words=F.coalesce(F.when(q("r").isNotNull(), F.size(covered)), F.lit(0)).cast("long"))

    def fails(k: int) -> Column:
        over = lambda part, whole, rule: 100 * part > LIMITS[rule][k] * whole
        return (over(q("n_symbols"), q("n_words"), "symbols") | over(q("n_capitals"), q("word_chars"), "capitals")
                | over(q("n_dup_lines"), q("n_lines"), "lines") | over(q("n_repeat_words"), q("n_words"), "repeats"))

    base = (q("n_words") < LEAST_WORDS) | (100 * q("n_repeat_words") > BASE_REPEAT * q("n_words"))
    return out.select(*docs.columns, F.struct(
        *(q(c).alias(c) for c in COUNTS), base.alias("base_failed"), fails(0).alias("strict_failed"),
        fails(1).alias("lenient_failed"), F.col(host_col).alias("host")).alias(VERDICT))


def host_verdicts(features: DataFrame) -> DataFrame:
    """One row per host: documents, failures, shrunk rate and ``distrusted``."""
    v = F.col(VERDICT)
    hosts = features.groupBy(v["host"].alias("host")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((v["base_failed"] | v["strict_failed"]).cast("long")).alias("failed"))
    # three sums over the host table, one row
    total = hosts.agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"),
                      F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares")).first()
    n, failed = total["n"] or 0, total["failed"] or 0
    mean = failed / n if n else 0.0
    spread = max(total["squares"] / n - mean * mean, 0.0) if n else 0.0
    strength = min(max(mean * (1 - mean) / spread - 1, 1.0), 1e6) if spread > 1e-12 else 1e6
    rate = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("rate", rate).withColumn("distrusted", F.col("rate") >= HOST_RATE)


def judge(docs: DataFrame, columns: list[str] | None = None, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``columns`` of ``docs`` (all by default) with a struct ``_quality``: the five
    counts, ``base_failed``, ``host_rate`` and ``kept``.

    Null text has no words and fails the base rule; rows without a host are a host
    of their own.  Repeated rows are judged (and counted) one by one; equal texts
    get equal counts.  All other columns pass through.  An empty table gives no
    rows."""
    prepare(docs.sparkSession)
    columns = docs.columns if columns is None else columns
    features = staged(with_features(docs, text_col, host_col).select(*columns, VERDICT), "quality-features",
                      TEXT_ROW_GROUP if text_col in columns else None)
    # written first, so that its size is known before the join: whole texts aren't shuffled to meet a short list of hosts
    hosts = staged(host_verdicts(features).select(F.col("host").alias("_quality_host"), "rate", "distrusted"), "quality-hosts")
    v = F.col(VERDICT)
    joined = features.join(hosts, v["host"].eqNullSafe(F.col("_quality_host")), "left") \
        .withColumn(VERDICT, F.struct(
            *(v[c].alias(c) for c in (*COUNTS, "base_failed")),
            F.col("rate").alias("host_rate"),
            (~v["base_failed"] & ~F.when(F.col("distrusted"), v["strict_failed"]).otherwise(v["lenient_failed"])).alias("kept")))
    return joined.select(*columns, VERDICT)


#: The same rules in DuckDB SQL; ``verdicts`` has a row per document.
SQL = rf"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
windows as (select rid, i, words[i] as a, words[i + 1] as b, words[i + 2] as c
            from (select rid, words, unnest(generate_series(1, len(words) - 2)) as i from w)),
repeated as (select rid, i from (select rid, i, count(*) over (partition by rid, a, b, c) as n from windows) where n > 1),
covered as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from repeated) group by rid),
f as (select w.rid, doc_id, source, cast(len(words) as bigint) as n_words,
             cast(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
             cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
             cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, len(lines) as n_lines,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_capitals,
             cast(coalesce(covered.n, 0) as bigint) as n_repeat_words
      from w left join covered on w.rid = covered.rid),
g as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {BASE_REPEAT} * n_words as base_failed,
  100 * n_symbols > {LIMITS['symbols'][0]} * n_words or 100 * n_capitals > {LIMITS['capitals'][0]} * word_chars
  or 100 * n_dup_lines > {LIMITS['lines'][0]} * n_lines or 100 * n_repeat_words > {LIMITS['repeats'][0]} * n_words as strict_failed,
  100 * n_symbols > {LIMITS['symbols'][1]} * n_words or 100 * n_capitals > {LIMITS['capitals'][1]} * word_chars
  or 100 * n_dup_lines > {LIMITS['lines'][1]} * n_lines or 100 * n_repeat_words > {LIMITS['repeats'][1]} * n_words as lenient_failed
  from f),
hosts as (select source, count(*) as n, sum(case when base_failed or strict_failed then 1 else 0 end) as failed from g group by source),
m as (select cast(sum(failed) as double) / sum(n) as mean,
             sum(cast(failed as double) * failed / n) / sum(n) - (cast(sum(failed) as double) / sum(n)) ** 2 as spread from hosts),
p as (select mean, case when spread > 1e-12 then least(greatest(mean * (1 - mean) / spread - 1, 1.0), 1e6) else 1e6 end as strength from m),
h as (select source, (failed + mean * strength) / (n + strength) >= {HOST_RATE} as distrusted from hosts, p),
verdicts as (select g.*, not base_failed and not (case when distrusted then strict_failed else lenient_failed end) as kept
             from g join h on g.source is not distinct from h.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from verdicts
"""
