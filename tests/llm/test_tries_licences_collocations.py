"""Operators 11 to 13 against plain brute-force versions, on small tables with nulls, empty
and long texts, ties, repeated rows, empty tables and clashing names, and against their SQL."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

from lexivec.llm import collocations, conversation_trie, license_rules, license_scan
from lexivec.llm.scan import P, running_sums

TALKS = "conv_id long, turn long, role string, text string, place string, part string, a string, n string, depth string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, hits string, doc string, h string, f string, k string"


def talks():
    rows = []
    for c in range(40):
        for t in range(c % 7 + (c % 3) * 4):
            same = c % 4 < 2 or t < 2
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if same else f"turn {t} of {c % 6} é"))
    rows += [(50, None, "user", "first"), (50, 1, None, None), (50, 1, "a", "tie"), (50, 1, "a", "tie"), (50, 1, "a", "Tie")]
    rows += [(51, 0, "user", None), (None, 0, "user", "nobody's"), (52, 0, "user", "x" * 70000), (7, 3, "user", "again"), (7, 3, "user", "again")]
    rows += [(60 + i, 0, "user", "turn 0") for i in range(30)]  # some of them turnless once rebuilt
    return [r + ("x",) * 5 for r in rows]


def brute_trie(rows):
    conv = collections.defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in conv.items()}
    nodes = collections.defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt = own.get(c - c % 5, [])[:h] + own[c][h:]
        for d in range(len(rebuilt) + 1):
            nodes[tuple(rebuilt[:d])].append((c, d == len(rebuilt)))
    kids, leaves, saved = collections.Counter(p[:-1] for p in nodes if p), collections.Counter(), collections.Counter()
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
            leaves[p[:d]] += kids[p] == 0
    ends = lambda m: ",".join(map(str, sorted(c for c, last in m if last)))
    return sorted((min(m)[0], len(p), min(nodes[p[:-1]])[0] if p else -1, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(ends(m).encode()).hexdigest()) for p, m in nodes.items())


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_trie(spark):
    df = spark.createDataFrame(talks(), TALKS)
    want = brute_trie(talks())
    assert any(r[1] == 0 and r[7] != conversation_trie.NOTHING for r in want)  # turnless members
    assert trie_rows(conversation_trie.prefix_trie(df.repartition(5))) == want
    db = duckdb.connect()
    db.register("conversations", df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    got = [tuple(-1 if x is None else x for x in r) for r in db.execute(conversation_trie.SQL).fetchall()]
    assert sorted(got) == want
    assert conversation_trie.prefix_trie(df.limit(0)).count() == 0


def test_trie_one_long_conversation(spark):
    """A conversation of most rows crosses the borders of the sorted ranges."""
    rows = [(3, t, "user", f"t{t % 5}") + ("x",) * 5 for t in range(1200)] + [(8, t, "user", f"t{t % 5}") + ("x",) * 5 for t in range(600)]
    rows += talks()[:60]
    assert trie_rows(conversation_trie.prefix_trie(spark.createDataFrame(rows, TALKS).repartition(6))) == brute_trie(rows)


def test_trie_survives_colliding_hashes(spark, monkeypatch):
    """With bases that lose the order of turns, nodes that mix different prefixes are found and hashed anew."""
    real, tried = conversation_trie._bases, []

    def bases(seed):
        tried.append(seed)
        return real(seed) if seed else dict.fromkeys(conversation_trie.LANES, 1)
    monkeypatch.setattr(conversation_trie, "_bases", bases)
    rows = [(0, 0, "u", "a"), (0, 1, "u", "b"), (5, 0, "u", "b"), (5, 1, "u", "a")]
    rows = [r + ("x",) * 5 for r in rows]
    assert trie_rows(conversation_trie.prefix_trie(spark.createDataFrame(rows, TALKS))) == brute_trie(rows)
    assert set(tried) == {0, 1}


def test_running_sums(spark):
    r = np.random.default_rng(0)
    rows = [(int(k), i, int(v)) for i, (k, v) in enumerate(zip(np.minimum(r.geometric(0.3, 3000), 6), r.integers(0, 2**31 - 1, 3000)))]
    df = spark.createDataFrame(rows, "key long, i long, v long").withColumn("w", (0 * __import__("pyspark").sql.functions.col("v")) + 2).repartition(7)
    got = {x.i: x for x in running_sums(df, "key", ["i"], {"v": 12345}, ["w"], "test-sums").collect()}
    state = collections.defaultdict(lambda: (0, 0))
    for key, i, v in rows:
        n, total = state[key]
        term = v * pow(12345, n, P) % P
        total = (total + term) % P
        state[key] = (n + 1, total)
        assert (got[i].place, got[i].v_sum, got[i].v, got[i].w_sum) == (n, total, term, 2 * n + 2)


LICENCES = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "MIT license mit-license MIT\nLICENSE apache license",
            "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "GNU Lesser General Public License v2.1 or later",
            "SPDX-License-Identifier: BSD-3-Clause", "the eclipse public license and an open road", "permissions are for the commons", "cc - by 4.0",
            "É mit licenseé mit license", "Copyright (c) 2020 A. Person. All rights reserved."]


def licence_docs():
    texts = [None, "", " \n", *LICENCES, "mit license " * 3000, " ".join(LICENCES) * 20, LICENCES[0], LICENCES[0]]
    return [(i % 17, t, "en", None, 1) + ("x",) * 6 for i, t in enumerate(texts)]


def brute_licences(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(license_scan.WORD, low)
    norm = "".join(f" {w} " for w in words)
    at = lambda n: norm[:n].count(" ") // 2
    base = [(label, at(m.start())) for phrase, label in license_scan.BASE.items()
            for m in re.finditer(" " + phrase.replace(" ", "  ") + " ", norm)]
    found = [(r, i, at(m.start()), at(m.end())) for i, r in enumerate(license_rules.RULES) for m in re.finditer(r.compiled, norm)]
    kept = []
    for r, i, s, e in found:
        beaten = any(s2 <= s and e2 >= e and (q.priority < r.priority or (q.priority == r.priority and (e2 - s2 > e - s or ((s2, e2) == (s, e) and j < i))))
                     for q, j, s2, e2 in found)
        if not beaten:
            kept.append((r, s, e))
    starts = [s for _, s in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in base})),
            ",".join(sorted({x for x, _ in base} | {r.label for r, _, _ in kept})), max((r.weight for r, _, _ in kept), default=0.0),
            sorted((s, e, r.label) for r, s, e in kept))


def test_licences(spark):
    docs = spark.createDataFrame(licence_docs(), DOCS).repartition(3)
    rows = license_scan.scan(docs).collect()
    got = sorted(((r.text, *(r.license[c] for c in license_scan.COUNTS), sorted((x.start, x.end, x.label) for x in r.license.spans)) for r in rows), key=repr)
    long = "mit license " * 3000
    want = []
    for r in licence_docs():
        if r[1] == long:  # its pairs are too many for the brute force: every place is one of "mit license"
            want.append((long, 6000, 3000, 0, 5998, "mit", "mit", license_rules.NAMED[1], [(2 * i, 2 * i + 2, "mit") for i in range(3000)]))
        else:
            want.append((r[1], *brute_licences(r[1])))
    assert got == sorted(want, key=repr)
    assert all(r.row == "x" and r.hits == "x" and r.doc == "x" for r in rows)
    assert license_scan.scan(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(docs.withColumnRenamed("row", "license"))


def spelled(pattern):
    """Every shortest spelling of a signature: optional parts left out, alternatives one by one."""
    before = None
    while pattern != before:
        before, pattern = pattern, re.sub(r"\([^()|]*\)(\?|\{0,\d+\})", "", pattern)
        pattern = re.sub(r"\([^()]*\)(\?|\{0,\d+\})", "", pattern)
    part = re.search(r"\(([^()]*)\)", pattern)
    if not part:
        return [pattern]
    return [x for choice in part[1].split("|") for x in spelled(pattern[:part.start()] + choice + pattern[part.end():])]


def test_license_gates_stand_in_every_match():
    for r in license_rules.RULES:
        for words in spelled(r.pattern.removeprefix(license_rules.NOTICE)):
            assert all(re.search(rf"\b{g}\b", words) for g in r.gates), (r, words)
    assert len(license_rules.RULES) > 500


PROSE = "the cat sat on the mat. The cat, sat on\tthe mat; new york city is new york city! a b a b a b\nA\x0bB\x0cé é é"


def phrase_docs():
    r = np.random.default_rng(3)
    texts = [None, "", " . , ", PROSE, PROSE * 3, PROSE, PROSE] + [" ".join(r.choice(list("abcd"), 60)) for _ in range(12)]
    rows = [(i, t, [None, "en", "de", "und"][i % 4], None, 1) + ("x",) * 6 for i, t in enumerate(texts)]
    return rows + rows[3:6]


def brute_phrases(rows, least, most, top):
    f, n = collections.Counter(), collections.Counter()
    for _, t, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    found = {x: c for x, c in f.items() if c >= least and len(x[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if any(l2 == lang and len(q) > len(p) and 100 * c >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (l2, q), c in found.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p), a, left, right, n[lang], score))
    return sorted((lang, i, *r[2:]) for lang, rows in out.items() for i, r in enumerate(sorted(rows)[:top], 1))


@pytest.mark.parametrize("options", [dict(sample=2, bits=1 << 16, step=200), dict(sample=1, bits=64, step=1 << 20), dict(sample=50, bits=1 << 20, step=1)])
def test_collocations(spark, options):
    """Whatever the sample proposes and however many false positives the map has."""
    docs = spark.createDataFrame(phrase_docs(), DOCS).repartition(3)
    got = [tuple(r) for r in collocations.collocations(docs, least=4, most=5, top=30, **options).collect()]
    assert sorted(got) == brute_phrases(phrase_docs(), 4, 5, 30)
    assert collocations.collocations(docs.limit(0), least=4).count() == 0


def test_steps_of_a_task_are_added_up():
    """A phrase leaves a task once, whatever its number of steps, unless the task holds too many."""
    import types

    import pyarrow as pa
    everything = types.SimpleNamespace(value=np.full(1, ~np.uint64(0)))
    batches = [pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 20), pa.array(["one two one, two"] * 40)], names=["lang", "text"])] * 3
    for most_held, once in ((1 << 18, True), (0, False)):
        rows = pa.Table.from_batches(collocations._text_counter(everything, everything, 3, 1, most_held)(batches)).to_pylist()
        total = collections.Counter()
        for r in rows:
            total[r["lang"], r["k"], r["phrase"]] += r["f"]
        want = {(0, ""): 4, (1, "one"): 2, (1, "two"): 2, (2, "one two"): 1, (2, "two one"): 1, (3, "one two one"): 1}
        assert total == {(lang, *x): 60 * n for lang in ("en", "de") for x, n in want.items()}
        assert (len(rows) == len(total)) == once


def test_score_passes_64_bits(spark):
    """1000 * a * n beyond 64 bits is exact."""
    big = spark.createDataFrame([("en", 0, "", 3 * 10**15), ("en", 1, "a", 10**12 + 7), ("en", 1, "b", 10**11 + 3), ("en", 2, "a b", 10**10 + 1)],
                                "lang string, k int, phrase string, f long")
    import unittest.mock
    with unittest.mock.patch.object(collocations, "frequent_phrases", lambda *a, **k: big):
        row = collocations.collocations(spark.range(1)).first()
    assert row.score == 1000 * (10**10 + 1) * 3 * 10**15 // ((10**12 + 7) * (10**11 + 3))
