"""Phrase collocation mining after Toivonen (operator 13).

A sample of the documents proposes phrases: the word sequences of one to five words
that reach a lowered count in it.  A full pass then counts these proposals and their
negative border: every phrase whose two parts without the last and without the first
word are proposals (words: all of them).  A border phrase that turns out frequent is a
failure, since longer phrases over it were not counted; an expansion pass counts what
the failures add.  It looks ahead: a phrase it meets for the first time is extended at
once, so that a long passage that the sample missed takes this one pass, not one for
each length, and the search is closed after it.

The first pass counts 64-bit hashes, which can only add up too much; the second counts
by text whatever the first found frequent, with the expansion, so counts are exact.
They never depend on the sample, only what the passes cost does.

Sets of phrases reach the tasks as a bitmap of ``BITS`` bits of their hashes, of one
size whatever the corpus: a false positive costs a phrase counted for nothing, nothing
is missed.  A text is counted in steps cut between its pieces, so a very long one needs
no more memory than a short one.
"""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.llm.common import mix, partitions, prepare, staged, utf8

#: Fewest occurrences of a candidate, its most words, and phrases listed per language.
LEAST, WORDS, TOP = 100, 5, 2000
#: One in SAMPLE documents proposes; the lowered count is SLACK of the expected one, two at least.
SAMPLE, SLACK = 16, 0.8
#: Bits of the map of proposals (a power of two, at least 64), 16 MB.
BITS = 1 << 27
#: Bytes of text that a task counts at once, and phrases whose counts it holds over several steps.
STEP, HELD = 4 << 20, 1 << 18

COUNTS = "lang string, k int, phrase string, f long"
HASHES = "h long, f long"

_BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _BREAKS, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_BREAKS))


def _chunks(text: bytes, step: int):
    """``text`` cut at piece borders into runs of about ``step`` bytes (a longer piece stays whole)."""
    start = 0
    while len(text) - start > step:
        cut = text.rfind(b"\n", start, start + step)
        if cut <= start:
            cut = text.find(b"\n", start + step)
            if cut < 0:
                break
        yield text[start:cut]
        start = cut
    yield text[start:]


class _Words:
    """Word ids of texts of one language: 0 separates pieces."""

    def __init__(self, texts: list[bytes]):
        ids = defaultdict(itertools.count().__next__)
        ids[b"\n"], ids[b""]  # 0 and 1
        tokens = b"\n".join(texts).replace(b"\n", b" \n ").split(b" ")
        w = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
        self.words, self.at = list(ids), w[w != 1]

    def phrases(self, first: np.ndarray, k: int) -> list[bytes]:
        words = self.words
        return [b" ".join([words[i] for i in row]) for row in self.at[first[:, None] + np.arange(k)].tolist()]


def _distinct(values: np.ndarray):
    """Place of the first of each distinct value, number of each row's value, rows of each."""
    of, distinct = pd.factorize(values)
    first = np.empty(len(distinct), np.int64)
    first[of[::-1]] = np.arange(len(values) - 1, -1, -1)
    return first, of, np.bincount(of)


def _levels(words: _Words, seed: int, most: int, keep):
    """Per length k: ``k, first, n, hashes, pre, suf`` of the distinct phrases: a place,
    the number of places, the hash and the numbers of the two parts among the phrases of
    length k - 1.  ``keep(k, hashes, pre, suf)`` says which are extended."""
    w = words.at
    digest = xxhash.xxh3_64_intdigest
    h1 = np.fromiter((digest(x, seed=seed) for x in words.words), np.uint64, len(words.words))
    places = np.flatnonzero(w)
    first, of, n = _distinct(w[places])
    hashes, pre, suf = h1[w[places[first]]], None, None
    for k in range(1, most + 1):
        if not len(places):
            return
        yield k, places[first], n, hashes, pre, suf
        if k == most:
            return
        good = keep(k, hashes, pre, suf)
        label = np.full(len(w) + 1, -1, np.int64)
        label[places] = np.where(good[of], of, -1)
        places = np.flatnonzero((label[:-1] >= 0) & (label[1:] >= 0))
        if not len(places):
            return
        first, of, n = _distinct(label[places] * len(h1) + w[places + k])
        pre, suf = label[places[first]], label[places[first] + 1]
        with np.errstate(over="ignore"):
            hashes = mix(hashes[pre] * np.uint64(0x9E3779B97F4A7C15) + h1[w[places[first] + k]], k)


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _steps(batches, step: int):
    """Groups of folded texts, by language, of about ``step`` bytes."""
    held, size = defaultdict(list), 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for chunk in _chunks(utf8(text).translate(_FOLD), step):
                held[lang].append(chunk)
                size += len(chunk) + 64
                if size >= step:
                    yield held
                    held, size = defaultdict(list), 0
    if held:
        yield held


def _hash_counter(bits, most: int, step: int):
    """Counts of the hashes of the phrases that ``bits`` and its border hold (None: of all)."""
    def run(batches):
        for held in _steps(batches, step):
            for lang, texts in held.items():
                def keep(k, hashes, pre, suf):
                    return np.ones(len(hashes), bool) if bits is None else _in(bits.value, hashes)
                for _, _, n, hashes, _, _ in _levels(_Words(texts), xxhash.xxh3_64_intdigest(utf8(lang)), most, keep):
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n)], names=["h", "f"])
    return run


def _rows(counts: dict[tuple[str, int], dict[bytes, int]]):
    """The held counts as rows; ``counts`` is empty after it."""
    while counts:
        (lang, k), found = counts.popitem()
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(found), np.int32))), pa.array(np.full(len(found), k, np.int32)),
             pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "k", "phrase", "f"])


def _text_counter(proposed, frequent, most: int, step: int, most_held: int = HELD):
    """Counts by text of the phrases that the first pass (over ``proposed`` and its border)
    found ``frequent``, and of those that it did not count.  A task adds up the counts of its
    steps and sends them on when it holds more than ``most_held`` phrases."""
    def run(batches):
        counts: dict[tuple[str, int], dict[bytes, int]] = {}

        def add(lang: str, k: int, phrases: list[bytes], n: list[int]) -> None:
            found = counts.setdefault((lang, k), {})
            for phrase, f in zip(phrases, n):
                found[phrase] = found.get(phrase, 0) + f

        for held in _steps(batches, step):
            if sum(map(len, counts.values())) > most_held:
                yield from _rows(counts)
            for lang, texts in held.items():
                words, state = _Words(texts), {}

                def keep(k, hashes, pre, suf):
                    return state["wanted"]

                for k, first, n, hashes, pre, suf in _levels(words, xxhash.xxh3_64_intdigest(utf8(lang)), most, keep):
                    counted = np.ones(len(n), bool) if k == 1 else state["proposed"][pre] & state["proposed"][suf]
                    state = {"wanted": ~counted | _in(frequent.value, hashes), "proposed": counted & _in(proposed.value, hashes)}
                    if k == 1:
                        add(lang, 0, [b""], [int(n.sum())])
                    pick = np.flatnonzero(state["wanted"])
                    if len(pick):
                        add(lang, k, words.phrases(first[pick], k), n[pick].tolist())
        yield from _rows(counts)
    return run


def _bitmap(hashes: DataFrame, bits: int) -> np.ndarray:
    """The map of the column ``h``: at most ``bits / 64`` words come to the driver."""
    words = hashes.select(F.expr(f"h & {bits - 1}L").alias("h")).groupBy(F.expr("shiftright(h, 6)").alias("at")) \
        .agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, most: int = WORDS, text_col: str = "text", lang_col: str = "lang",
                     sample: int = SAMPLE, bits: int = BITS, step: int = STEP) -> DataFrame:
    """``lang, k, phrase, f``: every phrase of 1 to ``most`` words with ``least``
    occurrences or more, and per language a row of k = 0 with its number of words.

    Null text is empty, null language is ``und``; repeated rows count as often as they
    occur; other columns aren't read.  An empty table gives no rows."""
    spark = docs.sparkSession
    prepare(spark)
    sc = spark.sparkContext
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lowered = max(2, int(SLACK * least / sample))
    # by row, not by text: copies must not come in or stay out together
    sampled = texts.where(F.rand(17) * sample < 1)

    def reaching(rows: DataFrame, counter, f: int):
        counts = rows.mapInArrow(counter, HASHES).groupBy("h").agg(F.sum("f").alias("f"))
        return sc.broadcast(_bitmap(counts.where(F.col("f") >= f), bits))

    proposed = reaching(sampled, _hash_counter(None, most - 1, step), lowered)
    frequent = reaching(texts, _hash_counter(proposed, most, step), least)
    counts = texts.mapInArrow(_text_counter(proposed, frequent, most, step), COUNTS).groupBy("lang", "k", "phrase").agg(F.sum("f").alias("f"))
    out = staged(counts.where((F.col("f") >= least) | (F.col("k") == 0)), "collocations")
    proposed.unpersist()
    frequent.unpersist()
    return out


def _prefix(k, phrase: str = "phrase"):
    """The first ``k`` words of a phrase, the last ``-k`` where it is negative."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), F.col(k) if isinstance(k, str) else k)


def collocations(docs: DataFrame, least: int = LEAST, most: int = WORDS, top: int = TOP, text_col: str = "text",
                 lang_col: str = "lang", sample: int = SAMPLE, bits: int = BITS, step: int = STEP) -> DataFrame:
    """The ``top`` phrases of 2 to ``most`` words of each language by their cohesion
    ``score = floor(1000 * a * n / (l * r))`` at the weakest cut: ``lang, rank, phrase,
    a, l, r, n, score``, ties by ``a`` descending, then phrase.

    Phrases within a longer one that occurs as often are left out.  Nulls, repeated
    rows and empty tables as in :func:`frequent_phrases`; a text without two words in a
    piece adds no phrase."""
    found = frequent_phrases(docs, least, most, text_col, lang_col, sample, bits, step)
    counts = found.where("k > 0").select("lang", "k", "phrase", "f")
    longer = counts.where("k > 2")
    # occurrences can't grow with length, so a longer phrase that matches shows in one of k + 1 words
    inside = longer.select("lang", _prefix(F.col("k") - 1).alias("phrase"), "f") \
        .unionByName(longer.select("lang", _prefix(1 - F.col("k")).alias("phrase"), "f")) \
        .groupBy("lang", "phrase").agg(F.max("f").alias("within"))
    part = counts.select("lang", "phrase", "f")
    cuts = counts.where("k > 1").join(inside, ["lang", "phrase"], "left").where("within is null or within < f") \
        .select("lang", "phrase", "k", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")) \
        .withColumn("head", _prefix("cut")).withColumn("tail", _prefix(F.col("cut") - F.col("k")))
    both = cuts.join(part.toDF("lang", "head", "l"), ["lang", "head"]).join(part.toDF("lang", "tail", "r"), ["lang", "tail"]) \
        .join(found.where("k = 0").select("lang", F.col("f").alias("n")), "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    up = (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(19,0)") * wide("n")
    scored = both.withColumn("score", F.call_function("div", up, wide("l") * wide("r")))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b")) \
        .select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), "n", F.col("b.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language's list is cut within shares of it first, so that none is sorted in one task
    share = F.pmod(F.xxhash64("phrase"), F.lit(partitions(docs.sparkSession)))
    first = best.withColumn("share", share).withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))) \
        .where(F.col("place") <= top).drop("share", "place")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")) \
        .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same lists in DuckDB SQL.
SQL = rf"""
with p as (select rid, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece
           from (select row_number() over () as rid, coalesce(lang, 'und') as lang,
                        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
starts as (select lang, ws, unnest(generate_series(1, len(ws))) as i from w),
f as (select lang, k, array_to_string(ws[i:i + k - 1], ' ') as phrase, count(*) as f
      from starts, (select unnest(generate_series(1, {WORDS})) as k) where i + k - 1 <= len(ws) group by all),
n as (select lang, cast(sum(f) as bigint) as n from f where k = 1 group by lang),
c as (select *, string_split(phrase, ' ') as ws from f where k > 1 and f >= {LEAST}),
sub as (select lang, array_to_string(ws[i:i + m - 1], ' ') as phrase, f
        from c, (select unnest(generate_series(2, {WORDS - 1})) as m), (select unnest(generate_series(1, {WORDS})) as i)
        where m < k and i + m - 1 <= k),
within_ as (select lang, phrase, max(f) as f from sub group by all),
kept as (select c.* from c left join within_ x on c.lang = x.lang and c.phrase = x.phrase where x.f is null or 100 * x.f < 100 * c.f),
cuts as (select kept.lang, kept.phrase, f, j, array_to_string(ws[1:j], ' ') as head, array_to_string(ws[j + 1:], ' ') as tail
         from kept, (select unnest(generate_series(1, {WORDS - 1})) as j) where j < k),
s as (select cuts.lang, cuts.phrase, cuts.f as a, cuts.j, h.f as l, t.f as r, n.n,
             cast(cast(1000 as hugeint) * cuts.f * n.n // (cast(h.f as hugeint) * t.f) as bigint) as score
      from cuts join f h on h.lang = cuts.lang and h.phrase = cuts.head join f t on t.lang = cuts.lang and t.phrase = cuts.tail
      join n on n.lang = cuts.lang),
best as (select *, row_number() over (partition by lang, phrase order by score, j) as o from s),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
           from best where o = 1)
select * from ranked where rank <= {TOP}
"""
