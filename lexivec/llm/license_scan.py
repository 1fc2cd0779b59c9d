"""Licence scan by ordered signature rules (operator 12), DataFrame functions only.

A text without any anchor word is done after one regular expression.  Others are
normalised (words in lower case, each between two spaces of its own), the gate words
that occur choose the rules to try, and each chosen rule gives the gaps between its
matches and their lengths, in words.  Running sums of these are the detections'
places.  Overlaps are resolved by rule: a detection inside one of a stronger rule, or
inside a longer one of the same strength, is suppressed; of equal ones the first rule's
stays.  Detections that merely overlap both stay.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import prepare, staged
from lexivec.llm.license_rules import RAW_ANCHOR, RULES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Separators of words in a text whose capitals A-Z still stand.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Contract phrases with their labels; their places are counted whatever the rules say.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_TABLE = [{"id": i, "label": r.label, "gates": list(r.gates), "regex": r.compiled, "priority": r.priority, "weight": r.weight}
          for i, r in enumerate(RULES)] + \
         [{"id": len(RULES) + i, "label": label, "gates": ["license"], "regex": " " + phrase.replace(" ", "  ") + " ", "priority": 0, "weight": 0.0}
          for i, (phrase, label) in enumerate(BASE.items())]
_FIELDS = "id int, label string, gates array<string>, regex string, priority int, weight double"
PRIORITIES = sorted({r.priority for r in RULES})
COUNTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _spaces(s):
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _words(s):
    """Words of a piece of normalised text."""
    return (_spaces(s) / 2).cast("long")


def with_hits(docs: DataFrame, columns: list[str], text_col: str) -> DataFrame:
    """``columns`` with a row number, the number of words, and per matching rule the gaps
    before its matches and their lengths, in words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    gated = F.when(text.rlike("(?i)" + RAW_ANCHOR), F.translate(text, UPPER, LOWER)).otherwise(F.lit(""))
    base = docs.select(F.struct(*columns).alias("doc"), F.monotonically_increasing_id().alias("row"),
                       F.regexp_count(text, F.lit(WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60"))).cast("long").alias("n_words"),
                       F.trim(F.regexp_replace(gated, BETWEEN, "  ")).alias("norm"))
    base = base.withColumn("norm", F.when(F.col("norm") != "", F.concat(F.lit(" "), F.col("norm"), F.lit(" "))).otherwise(F.lit("")))
    gates = F.array(*(F.lit(g) for g in sorted({g for r in _TABLE for g in r["gates"]})))
    norm = F.col("norm")
    base = base.withColumn("present", F.when(norm != "", F.filter(gates, lambda g: F.contains(norm, F.concat(F.lit(" "), g, F.lit(" "))))))
    rules = F.from_json(F.lit(json.dumps(_TABLE)), f"array<struct<{_FIELDS.replace(' ', ': ').replace(',: ', ', ')}>>")
    tried = F.filter(rules, lambda r: F.size(F.array_except(r["gates"], F.col("present"))) == 0)
    matches = F.filter(F.transform(tried, lambda r: F.struct(r.alias("r"), F.regexp_extract_all(norm, r["regex"], F.lit(0)).alias("m"))),
                       lambda x: F.size(x["m"]) > 0)
    hits = F.transform(matches, lambda x: F.struct(
        x["r"]["id"].alias("id"), x["r"]["label"].alias("label"), x["r"]["priority"].alias("priority"), x["r"]["weight"].alias("weight"),
        F.transform(F.split(norm, x["r"]["regex"], -1), _words).alias("gaps"), F.transform(x["m"], _words).alias("lengths")))
    return base.withColumn("hits", F.when(F.size("present") > 0, hits)).select("doc", "row", "n_words", "hits")


def detections(hits: DataFrame) -> DataFrame:
    """``row, id, label, priority, weight, start, end`` of every match, in words."""
    one = hits.where("hits is not null").select("row", F.explode("hits").alias("h")) \
        .select("row", "h.id", "h.label", "h.priority", "h.weight", F.posexplode(F.arrays_zip("h.gaps", "h.lengths")).alias("i", "x")) \
        .select("row", "id", "label", "priority", "weight", "i", F.col("x.gaps").alias("gap"), F.col("x.lengths").alias("length"))
    upto = Window.partitionBy("row", "id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce("length", F.lit(0))).over(upto)
    return one.withColumn("end", end).where("length is not null") \
        .select("row", "id", "label", "priority", "weight", (F.col("end") - F.col("length")).alias("start"), "end")


def kept(found: DataFrame) -> DataFrame:
    """Detections of the rules that no other one suppresses."""
    d = found.where("priority > 0")
    place = Window.partitionBy("row", "start", "end", "priority")
    d = d.withColumn("first", F.min("id").over(place)).where("id = first").drop("first")
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("row", "start", "priority")
    inside = F.max("end").over(here) > F.col("end")
    for p in PRIORITIES:
        inside = inside | F.coalesce((F.col("priority") > p) & (F.max(F.when(F.col("priority") == p, F.col("end"))).over(before) >= F.col("end")),
                                     F.lit(False))
        inside = inside | F.coalesce((F.col("priority") == p) & (F.max(F.when(F.col("priority") == p, F.col("end"))).over(earlier) >= F.col("end")),
                                     F.lit(False))
    return d.withColumn("inside", inside).where("not inside").drop("inside")


def scan(docs: DataFrame, columns: list[str] | None = None, text_col: str = "text", out: str = "license") -> DataFrame:
    """``columns`` of ``docs`` (all by default) with a struct ``out`` of ``n_words, n_base,
    first_word, last_word, base_labels, labels, score`` and ``spans``, the kept
    detections (label, start and end in words, weight) by place.

    ``score`` is the largest weight of a kept detection, 0 without any.  Null and empty
    texts have no words and no labels; repeated rows are scanned one by one; texts of any
    length are scanned whole; columns pass through whatever their names, one named like
    ``out`` is refused.  An empty table gives no rows."""
    prepare(docs.sparkSession)
    columns = docs.columns if columns is None else columns
    if out in columns:
        raise ValueError(f"{out!r} is a column of the documents: give the result another name")
    hits = staged(with_hits(docs, columns, text_col), "license-hits")
    found = staged(detections(hits), "license-detections")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = found.where("priority = 0").groupBy("row").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"),
        joined("label").alias("base_labels"), F.collect_set("label").alias("base_set"))
    rules = kept(found).groupBy("row").agg(
        F.max("weight").alias("score"), F.collect_set("label").alias("rule_set"),
        F.array_sort(F.collect_list(F.struct("start", "end", "label", "weight"))).alias("spans"))
    none = F.array().cast("array<string>")
    labels = F.array_join(F.array_sort(F.array_union(F.coalesce("base_set", none), F.coalesce("rule_set", none))), ",")
    result = hits.drop("hits").join(base, "row", "left").join(rules, "row", "left")
    return result.select("doc.*", F.struct(
        "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), labels.alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint,label:string,weight:double>>")).alias("spans")).alias(out))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The same scan in DuckDB SQL, every rule tried on every text with an anchor.
SQL = rf"""
with rules(id, label, regex, priority, weight) as (values
  {", ".join(f"({r['id']}, {_quoted(r['label'])}, {_quoted(r['regex'])}, {r['priority']}, cast({r['weight']} as double))" for r in _TABLE)}),
d as (select row_number() over () as rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '{WORD}') as ws from d),
g as (select rid, ' ' || array_to_string(ws, '  ') || ' ' as norm from w where regexp_matches(t, {_quoted(RAW_ANCHOR)})),
m as (select rid, r.*, regexp_extract_all(norm, regex) as ms, string_split_regex(norm, regex) as gs from g, rules r where regexp_matches(norm, regex)),
x as (select rid, id, label, priority, weight, unnest(ms) as m, gs, ms, unnest(generate_series(1, len(ms))) as i from m),
p as (select rid, id, label, priority, weight,
             length(regexp_replace(array_to_string(gs[1:i], '') || array_to_string(ms[1:i - 1], ''), '[^ ]', '', 'g')) // 2 as start,
             length(regexp_replace(m, '[^ ]', '', 'g')) // 2 as n from x),
q as (select *, start + n as stop from p),
kept as (select a.* from q a where a.priority > 0 and not exists (
  select 1 from q b where b.rid = a.rid and b.priority > 0 and b.start <= a.start and b.stop >= a.stop and (
    b.priority < a.priority or (b.priority = a.priority and (b.stop - b.start > a.stop - a.start or (b.start = a.start and b.stop = a.stop and b.id < a.id)))))),
base as (select rid, count(*) as n_base, min(start) as first_word, max(start) as last_word,
                array_to_string(list_sort(list_distinct(list(label))), ',') as base_labels from q where priority = 0 group by rid),
lab as (select rid, array_to_string(list_sort(list_distinct(list(label))), ',') as labels
        from (select rid, label from kept union all select rid, label from q where priority = 0) group by rid),
sc as (select rid, max(weight) as score from kept group by rid)
select doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word,
       cast(last_word as bigint) as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score
from w left join base using (rid) left join lab using (rid) left join sc using (rid)
"""
