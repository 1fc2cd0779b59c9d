"""Every operator against a plain brute-force version, on a small table with nulls,
empty and long texts, ties, repeated rows and extra columns with clashing names."""

import collections
import hashlib
import html
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexivec.llm import (embedding_graph, html_blocks, jaccard_join, mixing, packing, pii, quality_rules, token_counts,
                         token_files, tokens, toxicity)
from lexivec.llm.components import connected_components

EXTRA = "row string, key string, cls string, token string, n string, shard string, hash string, _lexivec_row string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(r.integers(0, 20, n), r.integers(0, 30, n)))


def rows():
    texts = [None, "", "   ", "one", "two words", prose(1, 120), prose(1, 120), prose(1, 118) + " new end", prose(2, 300), prose(3, 9000),
             "A b C\nA b C\nA b C\n\nx  y", "mail bob.42@mail8.example.com or 10.20.30.40, card 4532015112830366, call +1 (988) 555-2485 now",
             "###" * 80, "end.\nNew <|endoftext|> it's\tTAB  double é ñ ß", prose(4, 60), prose(5, 70), "SHOUT " * 60]
    out = [(i, t, "en", ["b", "a", None][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[5], out[5], (None, texts[8], None, None, None), (None, None, None, None, None)]
    out += [(100 + i, prose(50 + i, 80 + i), "en", "a", 1) for i in range(20)]
    return [r + ("x",) * 8 for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def library_ids(name):
    tok = Tokenizer.from_file(tokens.vocabulary(name))
    return [np.array(tok.encode(r[1] or "", add_special_tokens=False).ids, "<u4") for r in rows()]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_librarys_ids(name):
    odd = ["a \n b", "x \ny", "a\n\nb c", "\na", "a\n", " lead", "trail ", "a\x1c b\x85c", "é ́x", "İstanbul ΣΑΣ", "日本 語", "\x01 a \x01",
           "don't\nstop it's, ok", "😀 👍🏽 ok", "<|startoftext|> a <|ENDOFTEXT|>", "x" * 3000, "1234 5,6.7 a1b2"] + [r[1] for r in rows()]
    tok = Tokenizer.from_file(tokens.vocabulary(name))
    enc = tokens.UnitEncoder(tokens.vocabulary(name))
    for _ in range(2):  # the second time from the memo
        assert [x.tolist() for x in enc.encode(odd)] == [tok.encode(t or "", add_special_tokens=False).ids for t in odd]


def test_packing(docs, empty):
    path = tokens.vocabulary("byte_bpe_50k.json")
    got = packing.pack(docs, path, shard_rows=8).collect()
    want = collections.Counter()
    for r, ids in zip(rows(), library_ids("byte_bpe_50k.json")):
        want[(r[0], len(ids) + 1, crc(np.append(ids, 1)))] += 1
    seq, docs_of = collections.defaultdict(list), collections.defaultdict(list)
    for p in got:
        assert p.length == len(p.ids) // 4 and p.ids_crc32 == zlib.crc32(p.ids)
        seq[p.sequence_id].append(p)
        docs_of[p.doc_id].append(p)
    for pieces in seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    for doc_id, n, c in want:
        if sum(k[0] == doc_id for k in want) == 1 and want[(doc_id, n, c)] == 1:
            pieces = sorted(docs_of[doc_id], key=lambda p: p.start)
            ids = b"".join(bytes(p.ids) for p in pieces)
            assert zlib.crc32(ids) == c and len(ids) == 4 * n and all(p.doc_tokens == n for p in pieces)
    assert sum(p.length for p in got) == sum(k[1] * v for k, v in want.items())
    assert packing.pack(empty, path).collect() == []


def test_like_tails_meet_in_a_shard(spark):
    r = np.random.default_rng(11)
    topics = [["".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), 8)) for _ in range(12)] for _ in range(40)]
    common = " ".join(WORDS)
    texts = [f"{common} {' '.join(r.permutation(topics[i % 40]))} {common}" for i in range(640)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seq = collections.defaultdict(list)
    for p in packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"), shard_rows=64).select("doc_id", "sequence_id", "offset").collect():
        seq[p.sequence_id].append((p.offset, p.doc_id % 40))
    same = [t == min(pieces)[1] for pieces in seq.values() for _, t in sorted(pieces)[1:]]
    assert np.mean(same) > 0.6


def test_seed_is_scored_with_all_its_terms():
    seed = np.arange(200, dtype="<u4")
    ids = [seed] + [np.array([i, 1000 + i], "<u4") for i in range(200)]
    assert (packing.Index(ids).scores(0) > 0).all()


def test_ids_of_most_tails_are_not_drawn():
    r = np.random.default_rng(12)
    tails = [np.concatenate([np.arange(50), r.choice(np.arange(50, 5000), 20, replace=False)]).astype("<u4") for _ in range(2000)]
    found = packing.signatures(tails, packing.draws(np.bincount(np.concatenate(tails)), len(tails)))
    assert all(np.bincount(h).max() < 50 for h in found)


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i: i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)] if words else [])


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard_join(spark, empty, k, num, den):
    r = np.random.default_rng(7)
    texts = [row[1] for row in rows()]
    base = [prose(900 + i, 200).split() for i in range(6)]
    for i in range(120):  # near copies around the threshold
        w = list(base[i % 6])
        for at in r.integers(0, len(w), r.integers(0, 6)):
            w[at] = f"edit{r.integers(0, 9)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, cls string")
    sets, parent = [shingle_set(t, k) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.linked(docs, k, num, den).collect()}
    assert got == {i: (len(s), root(i)) for i, s in enumerate(sets)}
    assert jaccard_join.linked(empty, k, num, den).collect() == []


def test_hosts_meet_texts_without_a_shuffle(spark):
    """A host table that is short, other than the texts, is broadcast by its written size."""
    texts = spark.createDataFrame([(i, prose(9000 + i, 200), f"h{i % 3}") for i in range(300)], "doc_id long, text string, source string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40kb")
    try:
        plan = quality_rules.judge(texts)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_toxicity(spark, docs):
    r = np.random.default_rng(3)
    texts = [(i, " ".join([prose(2000 + i, 60), *(["vileword", "nastystem" + "abc"[i % 3]] if i % 4 == 0 else [])])) for i in range(400)]
    train = spark.createDataFrame([(i, t, "x") for i, t in texts] + [(None, None, "x")], "doc_id long, text string, key string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in texts if r.random() < 0.9] + [(None, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.fit_and_score(train, labels).collect()}
    assert len(got) == 401 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    held = [x for x in got.values() if x.held_out and x.doc_id is not None]
    assert held and all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got.values() if x.doc_id is not None)
    assert np.mean([x.predicted == int(x.doc_id % 4 == 0) for x in held]) > 0.95
    none = toxicity.fit_and_score(docs, labels.limit(0)).collect()
    assert len(none) == len(rows())


def toxic_table(spark):
    texts = [(i, f"{WORDS[i % 3]} vileword{'' if i % 3 else ' nastystem'}" if i % 2 else f"plain {WORDS[3 + i % 5]}") for i in range(400)]
    labels = [(i, i % 2) for i in range(400)]
    return texts, spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_calibration_leaves_copies_out(spark):
    """Labelled copies must not vote on each other in the calibration."""
    texts, docs, labels = toxic_table(spark)
    index = toxicity.fit(docs, labels).index
    of = dict((str(i), t) for i, t in texts)
    groups = [{of[index.ids[i]] for i in c} for c in index.copies.values()]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == len(groups)
    assert sum(map(len, index.copies.values())) == len(index.ids)


def test_scores_by_brute_force(spark):
    """The whole score, term weights to calibration, written out plainly."""
    r = np.random.default_rng(8)
    texts = [(i, " ".join([prose(7000 + i // 2, 25), *(["vileword", "nasty" + "abc"[i % 3], "u2"][: 1 + i % 3] if i % 5 == 0 else [])])) for i in range(240)]
    texts += [(500, None), (501, ""), (502, "plain long " * 40_000), (503, "unseenword")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, score string")
    label = {i: int(i % 5 == 0) for i, _ in texts if r.random() < 0.8}
    labels = spark.createDataFrame([*label.items(), (None, 1), (9999, 1), (3, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}

    bags = {i: toxicity.terms(t) for i, t in texts}
    known = sorted(i for i in label if zlib.crc32(str(i).encode()) % 4 != 2)
    n_pos, n_neg = sum(label[i] for i in known), sum(1 - label[i] for i in known)
    weight = {}
    for t in set().union(*(bags[i] for i in known)):
        pos, neg = sum(t in bags[i] for i in known if label[i]), sum(t in bags[i] for i in known if not label[i])
        if pos * n_neg > neg * n_pos:
            ll = lambda k, n, p: (k * np.log(p) if k else 0) + ((n - k) * np.log(1 - p) if n > k else 0)
            share = (pos + neg) / (n_pos + n_neg)
            both = ll(pos, n_pos, pos / n_pos) + ll(neg, n_neg, neg / n_neg) - ll(pos, n_pos, share) - ll(neg, n_neg, share)
            weight[t] = max(0, 2 * both) ** 0.5 * np.log(1 + (n_pos + n_neg) / (pos + neg))

    def vector(bag):
        v = {t: (1 + np.log(n)) * weight[t] for t, n in bag.items() if weight.get(t, 0) > 0}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {t: x / norm for t, x in v.items()}

    vectors = {i: vector(b) for i, b in bags.items()}
    learnt = [y for i, y in [*label.items(), (9999, 1)] if zlib.crc32(str(i).encode()) % 4 != 2]
    total = {v: learnt.count(v) for v in (0, 1)}
    stands = {1: total[1] / n_pos, 0: total[0] / n_neg}
    prior = stands[1] * n_pos / (stands[1] * n_pos + stands[0] * n_neg)

    def near(v, skip=()):
        found = [(round(sum(x * vectors[j].get(t, 0.0) for t, x in v.items()), 12), j) for j in known if j not in skip and vectors[j]]
        return sorted((f for f in found if f[0] > 0), reverse=True)

    for i, _ in texts:
        v = vectors[i]
        want = [c for c, _ in near(v)[:15]]
        assert np.allclose([e.cosine for e in got[i].evidence], want), i
        cosine = dict((j, c) for c, j in near(v))
        assert all(abs(cosine[int(e.id)] - e.cosine) < 1e-9 and label[int(e.id)] == e.label for e in got[i].evidence)
    # votes rise with scores: isotonic
    vote = {}
    for i, _ in texts:
        e = got[i].evidence
        s2 = [x.cosine ** 2 * stands[x.label] for x in e]
        vote[i] = (sum(s for s, x in zip(s2, e) if x.label) + 0.05 * prior) / (sum(s2) + 0.05) if e else None
    scored = sorted((vote[i], got[i].score) for i, _ in texts if vote[i] is not None)
    assert all(a[1] <= b[1] + 1e-9 for a, b in zip(scored, scored[1:]) if b[0] - a[0] > 1e-9)
    assert got[500].score == got[501].score == got[503].score


def test_batched_search_gives_plain_sums():
    """Texts searched together get the sums of the plain loop, bit by bit, with dense and short lists and ties."""
    r = np.random.default_rng(9)

    def vector(size):
        t = np.unique(np.minimum(r.geometric(0.02, size) - 1, 900))
        w = r.random(len(t)) + 0.01
        return t, w / np.sqrt(w @ w)

    vectors = [vector(int(r.integers(1, 60))) for _ in range(1400)]
    vectors += vectors[:30] * 3  # copies tie
    index = toxicity.Index(vectors, list(range(len(vectors))), np.zeros(len(vectors)), np.ones(len(vectors)))
    queries = [*vectors[:90], (np.array([5, 2000]), np.array([0.6, 0.8])), (np.array([2000]), np.array([1.0])), (np.zeros(0, np.int64), np.zeros(0))]
    skips = [frozenset(range(n, 1400, 9)) if n % 2 else frozenset() for n in range(len(queries))]
    for (ts, ws), skip, got in zip(queries, skips, index.nearest_of(queries, 15, skips)):
        weigh = dict(zip(ts.tolist(), ws.tolist()))
        every = []
        for at, i in enumerate(index.ids):
            total = 0.0
            for t, w in zip(vectors[i][0].tolist(), vectors[i][1].tolist()):
                total += w * weigh.get(t, 0.0)
            if total > 0 and at not in skip:
                every.append((-total, at))
        assert got == [(-s, at) for s, at in sorted(every)[:15]]
    assert (index.dense[0] >= 0).any() and (index.dense[0] < 0).any()


def test_block_max_search_is_exact():
    r = np.random.default_rng(5)
    vectors = []
    for _ in range(1500):
        v = {int(t): float(w) for t, w in zip(r.integers(0, 40, 4), r.random(4) + 0.1)}
        norm = sum(x * x for x in v.values()) ** 0.5
        vectors.append((np.array(sorted(v)), np.array([v[t] / norm for t in sorted(v)])))
    vectors.append((np.zeros(0, np.int64), np.zeros(0)))
    index = toxicity.Index(vectors, list(range(1501)), np.zeros(1501), np.ones(1501))
    dot = lambda a, b: float(sum(w * b[1][b[0] == t].sum() for t, w in zip(*a)))
    for n, q in enumerate(vectors[:60]):
        skip = frozenset(range(0, 1500, 7)) if n % 2 else frozenset()
        every = sorted(-dot(q, vectors[index.ids[i]]) for i in range(len(index.ids)) if i not in skip)
        got = index.nearest(q, 15, skip)
        assert np.allclose([s for s, _ in got], [-s for s in every[:15] if s < 0])
        assert all(abs(dot(q, vectors[index.ids[i]]) - s) < 1e-9 and i not in skip for s, i in got)
    assert index.nearest(vectors[-1], 15) == []


def test_quality_rules(spark, docs, empty, tmp_path):
    judged = quality_rules.judge(docs)
    assert judged.columns == [*docs.columns, "_quality"] and judged.count() == len(rows())
    names = (*quality_rules.COUNTS, "base_failed", "kept")
    got = sorted(([r.doc_id, *(r._quality[c] for c in names)] for r in judged.collect()), key=repr)
    docs.write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    assert got == sorted(map(list, con.execute(quality_rules.SQL).fetchall()), key=repr)
    assert quality_rules.judge(empty).collect() == []


def test_token_files(docs, empty):
    path = tokens.vocabulary("word_bpe_49k.json")
    got = token_files.encode_and_read(docs, path).collect()
    order = sorted(zip(rows(), library_ids("word_bpe_49k.json")), key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[0][1] or ""))
    at, want = 0, []
    for r, ids in order:
        ids = np.append(ids, 1)
        want.append((r[0], at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want
    assert token_files.encode_and_read(empty, path).collect() == []


def test_perfect_hash():
    keys = [b"%d#0" % i for i in range(5000)]
    ph = token_files.PerfectHash.build(keys)
    assert sorted(ph.lookup(keys).tolist()) == list(range(5000))
    assert (ph.lookup([b"other%d" % i for i in range(2000)]) >= 0).mean() < 0.01


def test_mixing(docs, empty):
    got = mixing.mix(docs).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((r[0] or -1, size(r[1])) for r in rows())
    per = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert r.taken <= 3 * r.size and (r.taken % r.size == 0 if r.size else r.taken == 0)
        per[r.source][0] += r.size
        per[r.source][1] += r.taken
        per[r.source][2] = r.target
    total = sum(p[0] for p in per.values())
    assert abs(sum(p[2] for p in per.values()) - total) < 1e-6
    for source, (words, taken, target) in per.items():
        reach = 1  # sums of 0 to 3 copies of each document, as bits
        for r in got:
            for _ in range(3 if r.source == source else 0):
                reach |= reach << r.size
        best = (reach & (1 << int(target) + 1) - 1).bit_length() - 1
        assert target <= 3 * words + 1e-9 and best - 20 <= taken <= target
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs).collect()))
    assert mixing.mix(empty).collect() == []


def test_budget_fit():
    r = np.random.default_rng(1)
    for _ in range(30):
        size, count = np.unique(r.integers(1, 400, 12)), r.integers(1, 6, 12)
        count = count[: len(size)]
        budget = int(r.integers(0, (size * count).sum() + 10))
        take = mixing.fit(size, count, budget)
        assert (take >= 0).all() and (take <= count).all() and (size * take).sum() <= budget
    assert (mixing.fit(np.array([3, 5]), np.array([4, 4]), 14) * [3, 5]).sum() == 14


def test_token_counts(spark, docs, empty, tmp_path):
    path, cache = tokens.vocabulary("word_bpe_49k.json"), str(tmp_path / "cache")
    want = sorted([(r[0], len((r[1] or "").encode()), len(ids), len(ids) > 2048) for r, ids in zip(rows(), library_ids("word_bpe_49k.json"))], key=repr)
    for _ in range(2):  # the second run only reads the cache
        assert sorted(map(tuple, token_counts.count_tokens(docs, path, cache).collect()), key=repr) == want
    assert spark.read.parquet(cache).groupBy("content").count().where("count > 1").count() == 0
    assert token_counts.count_tokens(empty, path).collect() == []


def base_by_regex(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), m.end(), 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), m.end(), 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), m.end(), 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_base_spans():
    r = np.random.default_rng(9)
    cases = ["a@b.c@d.e", "a@@b.c", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1", "1.2.3", "+1 2", "+12345678901 +(1)", "0000.1.2.3"]
    cases += ["".join(r.choice(list("ab1234567890.@+ -()"), 60)) for _ in range(400)]
    for t in cases:
        assert pii.base_spans(t) == base_by_regex(t), t


def test_pii(spark, docs, empty):
    many = spark.createDataFrame([(i, f"{prose(i, 12)} u{i}.42@mail{i % 9}.example.com {prose(i + 1, 9)} {i % 250}.7.8.9 "
                                      f"{prose(i, 5)} +1 ({200 + i % 700}) 555-{1000 + i} {prose(i, 6)}") for i in range(300)], "doc_id long, text string")
    model = pii.fit(many)
    seen = {r.doc_id: r for r in pii.detect(many, model).collect()}
    assert all(r.n_email == r.n_ip == r.n_phone == 1 for r in seen.values())
    # held-out accuracy of the model alone
    right = total = 0
    for i in range(300, 330):
        t = f"{prose(i, 4)} v{i}.77@mail1.example.org {prose(i, 3)}"
        (_, spans), = pii.find([t], model)
        x = np.zeros((1, pii.WINDOW), np.int64)
        cut = t[max(0, t.index("@") - 32):][: pii.WINDOW]
        x[0, : len(cut)] = pii.codes(cut)
        tags, _ = model.decode(x)
        y = pii._label(cut, base_by_regex(cut))
        right, total = right + int((tags[0, : len(cut)] == y).sum()), total + len(cut)
        assert set(base_by_regex(t)) <= set(spans)
    assert right / total > 0.9
    assert pii.find(["plain words only", None, "Version 2.0."], model)[0] == ([], [])
    got = {r.doc_id: r for r in pii.detect(docs, model).collect()}
    want = pii.written(base_by_regex(rows()[11][1]))
    assert got[11].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and "<EMAIL>" in got[11].redacted
    masked = pii.redact(docs, model).collect()
    assert len(masked) == len(rows()) and all(r.text is None or r.n_chars in (len(r.text), 1, None) for r in masked)
    assert pii.detect(empty, pii.fit(empty)).collect() == []


def test_embedding_graph(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(300, 16))
    near = base[:60] + 0.03 * r.normal(size=(60, 16))
    v = np.vstack([base, near, near[:5], 2 * base[:3]]).tolist()
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 15]
    frame = spark.createDataFrame([(i, x, 1) for i, x in enumerate(v + odd)] + [(None, v[0], 1)], "vec_id long, embedding array<float>, node int")
    x = np.array(v, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.95
    got = {row.vec_id: row for row in embedding_graph.near_duplicates(frame).collect()}
    n, true = len(v), link.sum(1) - 1
    true[link[0]] += 1  # the row without an id
    found = np.array([got[i].n_links for i in range(n)])
    assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
    for i in range(n, n + len(odd)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert all(got[i].kept == (got[i].component_id == i) for i in range(n))
    assert embedding_graph.near_duplicates(frame.limit(0)).collect() == []


def test_embedding_graph_border_pairs(spark, monkeypatch):
    """Pairs of cosine about 0.955 across the borders of many shards; vectors of many
    copies, linked to nothing else, must not hide from the audit that pairs are lost."""
    monkeypatch.setattr(embedding_graph, "SHARD_ROWS", 4)
    r = np.random.default_rng(21)
    base = embedding_graph.unit(r.normal(size=(600, 4)))
    off = r.normal(size=(600, 4))
    off = embedding_graph.unit(off - (off * base).sum(1, keepdims=True) * base)
    near = np.hstack([np.vstack([base, 0.955 * base + (1 - 0.955 ** 2) ** 0.5 * off]), np.zeros((1200, 3))])
    apart = np.array([(0.0, 0, 0, 0, x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if 0 < abs(x) + abs(y) + abs(z) < 3])
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(near.tolist())], "vec_id long, embedding array<float>")
    copied = spark.createDataFrame([(x,) for x in apart.tolist()], "embedding array<float>")
    frame = frame.unionByName(copied.crossJoin(spark.range(2000, 22000).withColumnRenamed("id", "vec_id")))
    got = {row.vec_id: row for row in embedding_graph.near_duplicates(frame).where("vec_id < 2000").collect()}
    x = embedding_graph.unit(near.astype(np.float32).astype(float))
    true = (x @ x.T >= 0.95).sum(1) - 1
    found = np.array([got[i].n_links for i in range(1200)])
    assert (found <= true).all() and found.sum() >= 0.93 * true.sum()  # audited: 0.95 of a sample's links


def test_embedding_graph_dense_group_in_blocks(spark, monkeypatch):
    """A dense group larger than a block is compared in blocks, with the right links."""
    monkeypatch.setattr(embedding_graph, "SHARD_ROWS", 100)
    monkeypatch.setattr(embedding_graph, "BLOCK", 150, raising=False)
    compared, real = [], embedding_graph._compared
    monkeypatch.setattr(embedding_graph, "_compared", lambda rows, threshold: compared.append(rows) or real(rows, threshold))
    r = np.random.default_rng(23)
    dense = r.normal(size=16) + 0.1 * r.normal(size=(500, 16))
    v = np.vstack([dense, r.normal(size=(500, 16)), dense[:20]])
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    got = {row.vec_id: row for row in embedding_graph.near_duplicates(frame).collect()}
    x = embedding_graph.unit(v.astype(np.float32).astype(float))
    true = (x @ x.T >= 0.95).sum(1) - 1
    found = np.array([got[i].n_links for i in range(len(v))])
    assert compared and max(row.blocks for row in compared[0].select("blocks").collect()) >= 3
    assert (found <= true).all() and found.sum() >= 0.95 * true.sum()


def test_embedding_graph_rare_links(spark, monkeypatch):
    """Where few of the audited vectors have a link, all pairs are compared."""
    def lost(nodes, *_):
        none = nodes.where("false")
        return none.selectExpr("node", "copies links", "copies pairs"), none.selectExpr("node a", "node b")

    monkeypatch.setattr(embedding_graph, "_links", lost)
    monkeypatch.setattr(embedding_graph, "SAMPLE", 256)
    monkeypatch.setattr(embedding_graph, "BLOCK", 300, raising=False)
    r = np.random.default_rng(22)
    base = r.normal(size=(1500, 32))
    v = np.vstack([base, base[:6] + 0.1 * r.normal(size=(6, 32)), base[:3]])
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<float>")
    got = {row.vec_id: row for row in embedding_graph.near_duplicates(frame).collect()}
    x = embedding_graph.unit(v.astype(np.float32).astype(float))
    true = (x @ x.T >= 0.95).sum(1) - 1
    assert true.sum() >= 12 and [got[i].n_links for i in range(len(v))] == true.tolist()
    assert all(got[i].component_id == got[1500 + i].component_id == i for i in range(6))


REWRITTEN = {"email": ["jane.doe(at)example.com", "bob.smith @ mail.example.org"], "card": ["4111.1111.1111.1111", "4111/1111/1111/1111"],
             "ip": ["10 . 20 . 30 . 40"], "phone": ["151-234-5678"]}


def test_pii_adds_rewritten_spans(spark):
    """The model adds what no pattern knows, wherever it lies to the windows, and leaves clean texts alone."""
    r = np.random.default_rng(4)
    n = lambda k: "".join(map(str, r.integers(0, 10, k)))

    def card():
        d = "4" + n(14)
        return next(f"{(d + c)[:4]} {(d + c)[4:8]} {(d + c)[8:12]} {(d + c)[12:]}" for c in "0123456789" if pii.luhn(d + c))

    plain = "the and of thner eral in onth "
    kinds = [lambda i: f"{WORDS[i % 20]}.{WORDS[i % 7]}@{WORDS[i % 11]}.example.com", lambda i: f"10.{i % 250}.{i % 199}.7", lambda i: card(),
             lambda i: f"+{1 + i % 80} {n(3)} {n(3)} {n(4)}"]
    docs = spark.createDataFrame([(i, plain * 2 + kinds[i % 4](i) + " " + prose(i, 12)) for i in range(200)] + [(None, None), (500, "")],
                                 "doc_id long, text string")
    model = pii.fit(docs)
    caught = total = 0
    for kind, forms in REWRITTEN.items():
        for form in forms:
            for before in range(0, 64, 9):  # all offsets to the windows' borders
                text = "x" * before + " " + plain * 4 + form + " " + plain * 4
                (base, spans), = pii.find([text], model)
                assert base == [] and all(text[a:b] == form and pii.KINDS[k] == kind for a, b, k in spans)
                caught, total = caught + len(spans), total + 1
    assert caught >= 0.8 * total, (caught, total)
    assert pii.find([plain * 50, "In 1999 some 300 (12) and 4.5 of 7"], model) == [([], []), ([], [])]


def test_pii_stitches_windows():
    """A span over the border of two windows is one span, tags being those of the nearest centre."""
    starts = [0, 32]
    tags, sure = np.zeros((2, pii.WINDOW), np.int64), np.ones((2, pii.WINDOW))
    tags[0, 30], tags[0, 31:64], tags[1, 0:30] = 7, 8, 8  # a phone at 30 .. 62, cut by both windows
    body = "a" * 30 + "151-234-56 78 (90) 1 23" + "a" * 60
    tags[0, 53:] = tags[1, 21:] = 0
    assert pii._well_formed(body[30:53], 3) and pii.reconcile(body, [], starts, tags, sure) == [(30, 53, 3)]
    assert list(pii._cut(np.array([0, 1, 2, 2, 1, 2, 3, 4, 0, 8]))) == [(1, 4, 0), (4, 6, 0), (6, 8, 1), (9, 10, 3)]


PROSE = "the cat and the dog were at the house of a man and it was good"


@pytest.mark.parametrize("page, text", [
    # a page wrapped in a form, and one in a container with a name of boilerplate
    (f"<body><form><h1>T</h1><p>{PROSE}</p><label>Name</label><input></form></body>", "T\n" + PROSE),
    (f"<body><div class='container related'><p>{PROSE}</p><div class='sidebar'>{PROSE} twice</div></div></body>", PROSE),
    # a teaser in an article beside the main text
    (f"<body><article>Read on</article><div><p>{PROSE}</p></div></body>", "Read on\n" + PROSE),
    # no stop words, links only, reader comments, a form without text
    ("<body><p>" + " ".join(f"zorg{i}" for i in range(36)) + "</p></body>", ""),
    (f"<body><p><a href='/'>{PROSE}</a></p><p>{PROSE}</p></body>", PROSE),
    (f"<body><article><p>{PROSE}</p></article><div class='comments'><article><p>{PROSE}</p></article></div></body>", PROSE),
    (f"<body><p>{PROSE}</p><form><p>Write to us</p></form></body>", PROSE),
    # a heading between a good and a bad block takes the class of the next, another short block that of the previous
    (f"<body><p><a href='/'>{PROSE}</a></p><h2>Head</h2><p>{PROSE}</p><h2>Links</h2><p><a href='/'>{PROSE}</a></p></body>",
     "Head\n" + PROSE),
    ("", ""), ("<body><p>short</p></body>", "short"),
])
def test_html_cases(page, text):
    assert html_blocks.main_text(page) == text


def test_html_second_pass_by_brute_force():
    """Nearest decided neighbours of every undecided block, looked for one by one; and a long page."""
    r = np.random.default_rng(5)
    for n in (1, 2, 5, 30, 30, 30, 3000):
        found = [html_blocks.Block("x", 0.0, html_blocks.Place(article=bool(a)), bool(h))
                 for a, h in zip(r.integers(0, 2, n), r.integers(0, 2, n))]
        classes = [int(c) for c in r.choice([-1, 0, 0, 0, 1], n)]
        expected = []
        lone = 1 not in classes and not any(b.place.article for b in found)
        for i, c in enumerate(classes):
            if not c:
                near = sorted((abs(i - j), -j if found[i].heading else j, classes[j]) for j in range(n)
                              if classes[j] and found[j].place.article == found[i].place.article)
                c = near[0][2] if near else (1 if found[i].place.article or lone else -1)
            expected.append(c > 0)
        assert html_blocks.second_pass(found, classes) == expected
    page = "<body><main>" + f"<p>{PROSE}</p><h2>Part</h2>" * 20_000 + "</main></body>"
    assert html_blocks.main_text(page) == "\n".join([PROSE, "Part"] * 20_000)


def test_html_blocks(spark):
    page = ("<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header>Site</header>"
            "<nav><ul><li><a href='/a'>Home</a></li></ul></nav><!-- x --><div class=\"ad\">Buy now</div><article><h1>Big &amp; title</h1>"
            "<p><b>First\n  para&nbsp;graph.<br><p>Short.</p><aside>More</aside></article><section id=comments><p>Nice post and so on</p></section>"
            "<form><input>Sign up</form><footer>&copy; me</footer>")
    plain = "<body><div><p>" + "the cat and the dog of the house is in that for on " * 3 + "</p><p>Ok.</p></div><p><a href=x>link</a></p></body>"
    frame = spark.createDataFrame([(1, "u", page, "x"), (2, None, None, "x"), (None, "u", "", "x"), (4, "u", plain, "x"), (4, "u", plain, "x")],
                                  "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_blocks.extract(frame).collect()}
    assert got[1].text == html.unescape("Big &amp; title\nFirst para graph.\nShort.") and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[None].text == "" and got[4].text.endswith("\nOk.") and "link" not in got[4].text
    assert html_blocks.extract(frame.limit(0)).collect() == []


def test_pipeline(spark, docs, empty, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    step = docs
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(stage(spark, step, str(tmp_path)).collect(), SCHEMA)
        assert step.columns == docs.columns
        sizes.append(step.count())
    assert 0 < sizes[1] < sizes[0] < len(rows())
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = collections.Counter()
    for p in out:
        pieces[p.sequence_id] += p.length
    assert out and max(pieces.values()) <= 2048
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).collect() == []
