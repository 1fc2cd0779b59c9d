"""Toxicity from nearest labelled examples by exact TF-IDF cosine (operator 3).

*Examples* are a bounded sample of labelled documents (``EXAMPLES`` of each label, by
hash order), both labels in one index.  Terms are all words of the examples and word beginnings.
A term weighs TF x IDF x the root of its log-likelihood ratio between the labels,
one-sided: a term not more frequent in toxic examples weighs nothing, all others count, however
rare.  A document is scored by its nearest examples under the cosine of these
vectors, found exactly with a block-max inverted index: postings are grouped in
blocks of examples, each term keeps its largest weight per block, runs of blocks are opened in the
order of their upper bounds, for those texts of a batch whose k-th best they can reach.
Lists of common terms are rows of a dense matrix, so a batch of texts meets a run by one
product in single precision; what comes near the k-th best is summed again in double
precision, so neighbours and cosines are those of the plain sum.

Votes are weighted by similarity and by how many labelled documents an example stands
for.  They become a score by an isotonic fit on the examples themselves, each voted on
without itself or its copies.  A document without any weighing term gets the rate of toxic
labels among examples without one.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import prepare, staged

#: Labelled documents of each label that are fitted on, at most.
EXAMPLES = 4096
#: Nearest examples that vote; examples in a block of the index.
NEIGHBOURS, BLOCK = 15, 64
#: Blocks that are opened together; texts that are searched together.
RUN, BATCH = 16, 64
#: Terms with dense lists, at most, and the share of examples (one in so many) that such a list holds at least.
DENSE, DENSE_SHARE = 1024, 16
#: Relative error allowed to sums in single precision (with DENSE terms below 1e-4).
SLACK = 1e-3
#: Characters of a word's beginning that is a term of its own.
STEM = 5
THRESHOLD = 0.3
#: Scores of texts that a task remembers, for copies.
MEMO = 4096

_WORD = re.compile(r"\w+")


def terms(text: str | None) -> Counter:
    """Words (lower case) and beginnings of longer words."""
    words = Counter(_WORD.findall((text or "").lower()))
    out = Counter(words)
    for w, n in words.items():
        if len(w) > STEM:
            out[w[:STEM] + "*"] += n
    return out


def ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Log-likelihood ratios of terms' document counts where they are relatively more
    frequent in toxic examples, else 0."""
    pos, neg = np.asarray(pos, float), np.asarray(neg, float)

    def ll(k, n, p):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(p), 0.0) + np.where(n > k, (n - k) * np.log1p(-p), 0.0)

    share = (pos + neg) / max(1, n_pos + n_neg)
    out = 2 * (ll(pos, n_pos, pos / max(1, n_pos)) + ll(neg, n_neg, neg / max(1, n_neg)) - ll(pos, n_pos, share) - ll(neg, n_neg, share))
    return np.where(pos * n_neg > neg * n_pos, np.maximum(out, 0.0), 0.0)


Vector = tuple[np.ndarray, np.ndarray]  # ascending term numbers, weights


class Index:
    """A block-max inverted index over unit vectors of examples.

    Examples are numbered by their heaviest term, so a block holds examples alike.
    Postings lie by term and example, and once more by example and term."""

    def __init__(self, vectors: list[Vector], ids: list, labels: np.ndarray, weights: np.ndarray, digests: list | None = None):
        order = sorted((i for i, (t, _) in enumerate(vectors) if len(t)), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), i))
        self.ids = [ids[i] for i in order]
        self.labels, self.weights = np.asarray(labels, float)[order], np.asarray(weights, float)[order]
        self.copies: dict = {}
        for at, i in enumerate(order):
            self.copies.setdefault(digests[i] if digests else i, []).append(at)
        size = [len(vectors[i][0]) for i in order]
        at = np.repeat(np.arange(len(order), dtype=np.int32), size)
        term = np.concatenate([vectors[i][0] for i in order]) if order else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in order]).astype(np.float64) if order else np.zeros(0)
        self.terms = int(term.max()) + 1 if len(term) else 0
        self.first_of, self.term_of, self.weight_of = np.cumsum([0, *size]), term.astype(np.int32), weight
        by = np.lexsort((at, term))
        self.at, self.weight = at[by], weight[by]
        self.first = np.searchsorted(term[by], np.arange(self.terms + 1))
        self.dense: tuple | None = None  # made by the first search of a process, never shipped

    @staticmethod
    def _runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of several runs, one after the other, and the run of each."""
        n = end - start
        run = np.repeat(np.arange(len(n)), n)
        return np.arange(len(run)) + np.repeat(start - (np.cumsum(n) - n), n), run

    def _dense(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of each term with a dense list (others: -1), these lists, their largest weights by block."""
        if self.dense is None:
            n, df = len(self.ids), np.diff(self.first)
            common = np.argsort(-df, kind="stable")[:DENSE]
            common = np.sort(common[df[common] * DENSE_SHARE >= n])
            row = np.full(self.terms, -1, np.int64)
            row[common] = np.arange(len(common))
            lists = np.zeros((len(common), n), np.float32)
            for k, t in enumerate(common):
                cut = slice(self.first[t], self.first[t + 1])
                lists[k, self.at[cut]] = self.weight[cut]
            self.dense = row, lists, np.maximum.reduceat(lists, np.arange(0, n, BLOCK), axis=1)
        return self.dense

    def nearest(self, query: Vector, k: int, skip: frozenset = frozenset()) -> list[tuple[float, int]]:
        """The k examples of highest cosine above 0, ties by position: (cosine, position)."""
        return self.nearest_of([query], k, [skip])[0]

    def nearest_of(self, queries: list[Vector], k: int, skips: list[frozenset] | None = None) -> list[list[tuple[float, int]]]:
        """:meth:`nearest` of many queries."""
        out: list[list[tuple[float, int]]] = []
        for s in range(0, len(queries), BATCH):
            out += self._nearest(queries[s: s + BATCH], k, skips[s: s + BATCH] if skips else [frozenset()] * BATCH)
        return out

    def _nearest(self, queries: list[Vector], k: int, skips: list[frozenset]) -> list[list[tuple[float, int]]]:
        n = len(self.ids)
        if not n:
            return [[] for _ in queries]
        row, lists, most = self._dense()
        of = np.repeat(np.arange(len(queries)), [len(t) for t, _ in queries])
        ts, ws = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
        known = ts < self.terms
        of, ts, ws = of[known], ts[known], ws[known]
        common = row[ts] >= 0
        heavy = np.zeros((len(queries), len(lists)), np.float32)
        heavy[of[common], row[ts[common]]] = ws[common]
        rest = ~common
        start = self.first[ts[rest]]
        size = self.first[ts[rest] + 1] - start
        pos = np.repeat(start - (np.cumsum(size) - size), size)
        pos += np.arange(len(pos))
        cell, value = np.repeat(of[rest] * n, size), np.repeat(ws[rest], size)
        cell += self.at[pos]
        value *= self.weight[pos]
        light = np.bincount(cell, value, len(queries) * n).reshape(len(queries), n).astype(np.float32)
        bound = heavy @ most + np.maximum.reduceat(light, np.arange(0, n, BLOCK), axis=1)
        bound = np.maximum.reduceat(bound, np.arange(0, bound.shape[1], RUN), axis=1) * (1 + SLACK)
        score, best = np.zeros((len(queries), n), np.float32), np.zeros((len(queries), k), np.float32)
        left_out = [np.array(sorted(x), np.int64) for x in skips[: len(queries)]]
        for c in np.argsort(-bound.sum(0), kind="stable").tolist():
            open_to = np.flatnonzero((bound[:, c] > 0) & (bound[:, c] >= best.min(1)))
            if not len(open_to):
                continue
            cut = slice(c * RUN * BLOCK, (c + 1) * RUN * BLOCK)
            found = heavy[open_to] @ lists[:, cut] + light[open_to, cut]
            for i, q in enumerate(open_to.tolist()):
                if len(left_out[q]):
                    gone = left_out[q] - cut.start
                    found[i, gone[(gone >= 0) & (gone < found.shape[1])]] = 0
            score[open_to, cut] = found
            both = np.hstack([best[open_to], found])
            best[open_to] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        out, weigh, first = [], np.zeros(self.terms), np.searchsorted(of, np.arange(len(queries) + 1))
        for q, limit in enumerate(best.min(1).astype(float)):
            near = np.flatnonzero((score[q] > 0) & (score[q] >= limit * (1 - SLACK)))
            mine = slice(first[q], first[q + 1])
            weigh[ts[mine]] = ws[mine]
            pos, run = self._runs(self.first_of[near], self.first_of[near + 1])
            exact = np.bincount(run, self.weight_of[pos] * weigh[self.term_of[pos]], len(near))
            weigh[ts[mine]] = 0
            top = np.lexsort((near, -exact))[:k]
            out.append(list(zip(exact[top].tolist(), near[top].tolist())))
        return out

    def vote(self, near: list[tuple[float, int]], prior: float) -> float:
        """Share of toxic labels among neighbours, by similarity and weight."""
        if not near:
            return prior
        s, at = np.array([n[0] for n in near]) ** 2, [n[1] for n in near]
        w = s * self.weights[at]
        return float((w @ self.labels[at] + 0.05 * prior) / (w.sum() + 0.05))


class Model:
    """Terms, index and calibration; as large as the bounded sample makes them."""

    def __init__(self, vocabulary: dict[str, int], weights: np.ndarray):
        self.vocabulary, self.weights = vocabulary, weights  # of terms that weigh something
        self.stems = {t[:-1]: k for t, k in vocabulary.items() if t.endswith("*")}  # beginnings, as they stand in words
        self.index = Index([], [], np.zeros(0), np.zeros(0))
        self.prior = self.empty = 0.0
        self.steps, self.rates = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        self.memo: dict[str, tuple[float, list]] = {}

    def vector(self, text: str | None) -> Vector:
        """Unit vector of a whole text."""
        find, begin = self.vocabulary.get, self.stems.get
        counts: dict[int, int] = {}
        for w, n in Counter(_WORD.findall((text or "").lower())).items():
            if (t := find(w)) is not None:
                counts[t] = n
            if len(w) > STEM and (t := begin(w[:STEM])) is not None:
                counts[t] = counts.get(t, 0) + n
        if not counts:
            return np.zeros(0, np.int64), np.zeros(0)
        ts, ns = np.array([*counts], np.int64), np.array([*counts.values()], float)
        order = np.argsort(ts)
        ts = ts[order]
        v = (1 + np.log(ns[order])) * self.weights[ts]
        return ts, v / np.sqrt(v @ v)

    def calibrate(self, votes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> None:
        """Isotonic regression of labels on votes (pool adjacent violators), each
        step smoothed towards the prior."""
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # lowest vote, weight, weighted labels
        for v, y, w in zip(votes[order], labels[order], weights[order]):
            pools.append([v, w, w * y])
            while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
                top = pools.pop()
                pools[-1][1] += top[1]
                pools[-1][2] += top[2]
        if pools:
            self.steps = np.array([p[0] for p in pools])
            self.rates = np.array([(p[2] + self.prior) / (p[1] + 1) for p in pools])

    def rate(self, vote: float) -> float:
        at = max(0, int(np.searchsorted(self.steps, vote, "right")) - 1)
        return float(min(1.0, max(0.0, self.rates[at])))

    def score(self, text: str | None) -> tuple[float, list]:
        """(score, evidence): evidence are (example id, cosine, label) of the voters."""
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[tuple[float, list]]:
        """:meth:`score` of many texts; equal ones are searched once."""
        keys = [_digest(t) for t in texts]
        new = {x: t for x, t in zip(keys, texts) if x not in self.memo}
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = dict(zip(keys, texts))
        queries = [self.vector(t) for t in new.values()]
        for x, query, near in zip(new, queries, self.index.nearest_of(queries, NEIGHBOURS)):
            found = [(self.index.ids[i], s, int(self.index.labels[i])) for s, i in near]
            self.memo[x] = (self.rate(self.index.vote(near, self.prior)) if len(query[0]) else self.empty, found)
        return [self.memo[x] for x in keys]


def held_out(doc_id):
    """Rows whose labels are never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).alias("y")) \
        .where("y in (0, 1) and id is not null").groupBy("id").agg(F.max("y").alias("y"))
    known = staged(known.where(~held_out("id")), "tox-labels")
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    part = lambda y: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(EXAMPLES)
    sample = part(1).unionByName(part(0))  # at most 2 * EXAMPLES ids
    rows = staged(docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(sample), "id")
                  .select(F.col("id").cast("string").alias("id"), "y", "text"), "tox-examples")

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for y, text in zip(b["y"], b["text"]):
                found = terms(text)
                if found:
                    yield pd.DataFrame({"y": np.full(len(found), y, np.int32), "term": list(found)})

    cells = rows.mapInPandas(spell, "y int, term string")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    stats = cells.groupBy("term").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")) \
        .where(F.col("pos") * n_neg > F.col("neg") * n_pos).toArrow()  # terms of at most 2 * EXAMPLES texts
    pos, neg = stats["pos"].to_numpy(), stats["neg"].to_numpy()
    weights = np.sqrt(ratio(pos, neg, n_pos, n_neg)) * np.log1p((n_pos + n_neg) / np.maximum(1, pos + neg))
    order = sorted((t, i) for i, t in enumerate(stats["term"].to_pylist()) if weights[i] > 0)
    model = Model({t: k for k, (t, _) in enumerate(order)}, weights[[i for _, i in order]])

    shared = spark.sparkContext.broadcast(model)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shared.value.vector(t) for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "y": b["y"], "digest": [_digest(t) for t in b["text"]],
                                "t": [t for t, _ in found], "w": [w for _, w in found]})

    held = staged(rows.mapInPandas(place, "id string, y int, digest string, t array<long>, w array<double>"), "tox-vectors").toArrow()
    held = sorted(zip(held["id"].to_pylist(), held["y"].to_pylist(), held["digest"].to_pylist(),
                      ((t.values.to_numpy(), w.values.to_numpy()) for t, w in zip(held["t"], held["w"]))), key=lambda x: x[:3])
    y = np.array([h[1] for h in held], float)
    # each example stands for so many labelled documents
    stands = {v: totals.get(v, 0) / max(1, n.get(v, 0)) for v in (0, 1)}
    w = np.array([stands[h[1]] for h in held])
    model.prior = float(w @ y / w.sum()) if len(w) else 0.0
    without = np.array([not len(h[3][0]) for h in held], bool)
    model.empty = float(w[without] @ y[without] / w[without].sum()) if without.any() else model.prior
    model.index = Index([h[3] for h in held], [h[0] for h in held], y, w, [h[2] for h in held])
    votes = left_out(rows, model).toArrow()
    of = np.array([stands[v] for v in votes["y"].to_pylist()])
    model.calibrate(votes["vote"].to_numpy(), votes["y"].to_numpy().astype(float), of)
    return model


def _digest(text: str | None) -> str:
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass")).hexdigest()


def left_out(rows: DataFrame, model: Model) -> DataFrame:
    """``y, vote``: vote on each example that has terms, without itself or its copies (equal texts)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index, memo = shared.value.index, {}
        for b in batches:
            digests = [_digest(t) for t in b["text"]]
            new = {x: shared.value.vector(t) for x, t in zip(digests, b["text"]) if x not in memo}
            known = {x: query for x, query in new.items() if len(query[0])}
            near = index.nearest_of([*known.values()], NEIGHBOURS, [frozenset(index.copies[x]) for x in known])
            memo |= dict.fromkeys(new) | {x: index.vote(found, shared.value.prior) for x, found in zip(known, near)}
            out = [(y, memo[x]) for y, x in zip(b["y"], digests) if memo[x] is not None]
            yield pd.DataFrame({"y": np.array([y for y, _ in out], np.int32), "vote": np.array([v for _, v in out], float)})

    # written first: sorting by ranges would run the votes twice
    return staged(rows.mapInPandas(run, "y int, vote double"), "tox-votes").orderBy("vote", "y")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text_col: str = "text", evidence: bool = True) -> DataFrame:
    """``key, score, predicted`` and ``evidence`` (examples with cosine and label) of
    every row.  Null or empty text has no terms and gets the score of a document
    without any; very long texts count whole; neighbours that tie go by position in the index.  Repeated rows and null keys are kept; other columns are ignored; an
    empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by EXAMPLES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            found = [x for s in range(0, len(texts), MEMO // 4) for x in shared.value.scores(texts[s: s + MEMO // 4])]
            out = pd.DataFrame({"key": b["key"], "score": [s for s, _ in found]})
            if evidence:
                out["evidence"] = [[{"id": i, "cosine": c, "label": y} for i, c, y in e] for _, e in found]
            yield out

    more = ", evidence array<struct<id: string, cosine: double, label: int>>" if evidence else ""
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text_col).alias("text"))
    out = rows.mapInPandas(run, f"key string, score double{more}")
    return out.select(F.col("key").cast(docs.schema[key].dataType).alias(key), "score",
                      (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *(["evidence"] if evidence else []))


def fit_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    prepare(docs.sparkSession)
    return score(docs, fit(docs, labels), evidence=False).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
