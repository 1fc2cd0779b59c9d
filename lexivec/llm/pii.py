"""Personal data by patterns and a character BiLSTM-CRF (operator 8).

Base spans come from four patterns (e-mail, IP address, card, phone) over the whole
text.  A character-level bidirectional LSTM with CRF transitions, trained in numpy on
windows whose spans the patterns label (some of them rewritten into forms that the
patterns don't know), adds spans of the same kinds.

An added span has the form of its kind, so it holds a digit, an ``@`` or one of the rewritten
forms of it.  Windows are laid over every stretch of a text within reach of such a sign, so the
rest of a text cannot hold a span and needs no decoding.  Windows overlap by half;
each is decoded by Viterbi with posterior marginals.  Reconciling is global for a text: each
character takes its tag from the window whose centre is nearest, spans are cut from the tags so
stitched, across windows; those of low posterior or of the wrong form go, overlaps go to the more
certain one, and base spans always stay.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexivec.llm.common import prepare, staged

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window and reach of a span around its sign.
WINDOW, REACH = 64, 48
#: Documents with signs of each kind that training windows are taken from, at most.
DOCUMENTS = 512
#: Windows that the model is trained on, at most (a sixth for each kind, the rest without
#: spans); passes; units per direction.
TRAINING, PASSES, HIDDEN, EMBED, BATCH = 1536, 14, 16, 12, 32
#: Least mean posterior of an added span.
CERTAIN = 0.9
#: Replacement of a span of each kind.
MASK = "<{}>"

# The base patterns (possessive or anchored forms of them).
_AT_RIGHT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each "@": the run of local characters before it
    (after the previous match) and the domain behind it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _AT_RIGHT.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), by start, then kind."""
    out = [(s, e, 0) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


_DIGIT = re.compile("[0-9]")
_SEED = re.compile(r"[0-9@]|[(\[]at[)\]]")

# Signs of each kind, as SQL conditions: a text with a base span has the sign of its kind.
_SIGNS = ("contains(t, '@')", r"t rlike '[0-9][.][0-9]+[.][0-9]+[.][0-9]'", r"t rlike '[0-9](?:[ -]?[0-9]){11}'", r"t rlike '[+][0-9][ ().0-9-]{7}'")


# --- the model -------------------------------------------------------------

#: Characters that have a code of their own; others share one by class.
_OWN = "@.-+()_%=:/,;!?#&$*'\" \n0"


def codes(s: str) -> np.ndarray:
    out = np.empty(len(s), np.int64)
    for i, c in enumerate(s):
        if "0" <= c <= "9":
            c = "0"
        at = _OWN.find(c)
        out[i] = at + 6 if at >= 0 else 1 if "a" <= c <= "z" else 2 if "A" <= c <= "Z" else 3 if c.isalpha() else 4 if c.isspace() else 5
    return out


N_CODES = len(_OWN) + 6
#: Tags: 0 outside, 1 + 2k begin, 2 + 2k inside a span of kind k.
N_TAGS = 1 + 2 * len(KINDS)


def _allowed() -> np.ndarray:
    ok = np.ones((N_TAGS, N_TAGS), bool)
    for t in range(2, N_TAGS, 2):
        ok[:, t] = False
        ok[[t - 1, t], t] = True
    return ok


_FORBIDDEN = np.where(_allowed(), 0.0, -1e4)
_FIRST = np.array([0.0] + [0.0, -1e4] * len(KINDS))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


class Model:
    """Embedding, two LSTMs, a linear layer to tag scores, CRF transitions."""

    def __init__(self, seed: int = 1):
        r, h, e = np.random.default_rng(seed), HIDDEN, EMBED
        n = lambda *s: r.normal(0, 0.15, s)
        self.p = {"E": n(N_CODES, e), "T": n(N_TAGS, N_TAGS) * 0.1, "O": n(2 * h, N_TAGS), "b": np.zeros(N_TAGS)}
        for d in "fb":
            self.p["W" + d], self.p["c" + d] = n(e + h, 4 * h), np.zeros(4 * h)
            self.p["c" + d][h: 2 * h] = 1.0

    def _lstm(self, d: str, x: np.ndarray):
        steps, n, _ = x.shape
        h, w, bias = HIDDEN, self.p["W" + d], self.p["c" + d]
        pre = x @ w[:EMBED] + bias
        hidden, cell, gates = np.zeros((steps + 1, n, h)), np.zeros((steps + 1, n, h)), np.zeros((steps, n, 4 * h))
        for t in range(steps):
            g = pre[t] + hidden[t] @ w[EMBED:]
            g[:, : 3 * h] = _sigmoid(g[:, : 3 * h])
            g[:, 3 * h:] = np.tanh(g[:, 3 * h:])
            gates[t] = g
            cell[t + 1] = g[:, h: 2 * h] * cell[t] + g[:, :h] * g[:, 3 * h:]
            hidden[t + 1] = g[:, 2 * h: 3 * h] * np.tanh(cell[t + 1])
        return hidden, cell, gates

    def scores(self, x: np.ndarray, keep: bool = False):
        """Tag scores (steps, windows, tags) of codes (windows, steps)."""
        emb = self.p["E"][x.T]
        f, b = self._lstm("f", emb), self._lstm("b", emb[::-1])
        both = np.concatenate([f[0][1:], b[0][1:][::-1]], 2)
        s = both @ self.p["O"] + self.p["b"]
        return (s, (x, emb, f, b, both)) if keep else s

    def _passes(self, s: np.ndarray):
        """Forward and backward log sums of the CRF."""
        t = self.p["T"] + _FORBIDDEN
        a, z = np.empty_like(s), np.empty_like(s)
        a[0], z[-1] = s[0] + _FIRST, 0.0
        for i in range(1, len(s)):
            a[i] = _logsum(a[i - 1][:, :, None] + t, 1) + s[i]
            j = len(s) - 1 - i
            z[j] = _logsum(t + (s[j + 1] + z[j + 1])[:, None, :], 2)
        return a, z, _logsum(a[-1], 1)

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags and their posterior marginals, (windows, steps) each."""
        s = self.scores(x)
        a, z, total = self._passes(s)
        t = self.p["T"] + _FORBIDDEN
        best, back = s[0] + _FIRST, np.zeros(s.shape, np.int64)
        for i in range(1, len(s)):
            c = best[:, :, None] + t
            back[i] = c.argmax(1)
            best = c.max(1) + s[i]
        tags = np.zeros(x.shape, np.int64)
        tags[:, -1] = best.argmax(1)
        rows = np.arange(len(x))
        for i in range(len(s) - 1, 0, -1):
            tags[:, i - 1] = back[i][rows, tags[:, i]]
        marginal = np.exp(a + z - total[:, None])
        return tags, np.take_along_axis(marginal.transpose(1, 0, 2), tags[:, :, None], 2)[:, :, 0]

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        s, (x, emb, f, b, both) = self.scores(x, True)
        a, z, total = self._passes(s)
        steps, n, _ = s.shape
        rows, t = np.arange(n), self.p["T"] + _FORBIDDEN
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        ds = np.exp(a + z - total[:, None])
        for i in range(steps):
            ds[i, rows, y[:, i]] -= 1
        for i in range(1, steps):
            pair = a[i - 1][:, :, None] + t + (s[i] + z[i])[:, None, :] - total[:, None, None]
            g["T"] += np.exp(pair).sum(0)
            np.add.at(g["T"], (y[:, i - 1], y[:, i]), -1)
        ds /= n
        g["T"] /= n
        g["O"], g["b"] = np.tensordot(both, ds, ([0, 1], [0, 1])), ds.sum((0, 1))
        dboth = ds @ self.p["O"].T
        demb = np.zeros_like(emb)
        for d, (hidden, cell, gates), dh_all, inputs in (
                ("f", f, dboth[:, :, :HIDDEN], emb), ("b", b, dboth[::-1, :, HIDDEN:], emb[::-1])):
            h, w = HIDDEN, self.p["W" + d]
            dh, dc, dx = np.zeros((n, h)), np.zeros((n, h)), np.zeros_like(inputs)
            for i in range(steps - 1, -1, -1):
                dh = dh + dh_all[i]
                gi, gf, go, gg = (gates[i][:, k * h: (k + 1) * h] for k in range(4))
                tc = np.tanh(cell[i + 1])
                dc = dc + dh * go * (1 - tc * tc)
                dz = np.concatenate([dc * gg * gi * (1 - gi), dc * cell[i] * gf * (1 - gf),
                                     dh * tc * go * (1 - go), dc * gi * (1 - gg * gg)], 1)
                g["W" + d][:EMBED] += inputs[i].T @ dz
                g["W" + d][EMBED:] += hidden[i].T @ dz
                g["c" + d] += dz.sum(0)
                dx[i], dh, dc = dz @ w[:EMBED].T, dz @ w[EMBED:].T, dc * gf
            demb += dx if d == "f" else dx[::-1]
        np.add.at(g["E"], x.T, demb)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, passes: int = PASSES, rate: float = 0.02, seed: int = 1) -> "Model":
        """Adam on shuffled batches, gradients clipped by norm."""
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        step = 0
        total = passes * -(-len(x) // BATCH)
        for _ in range(passes):
            order = r.permutation(len(x))
            for s in range(0, len(x), BATCH):
                at = order[s: s + BATCH]
                g, step = self._gradient(x[at], y[at]), step + 1
                norm = np.sqrt(sum((k * k).sum() for k in g.values()))
                now = rate * (1 - 0.9 * step / total)
                for k in self.p:
                    d = g[k] * min(1.0, 5.0 / (norm + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    self.p[k] -= now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        return self


def _label(s: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    y, free = np.zeros(len(s), np.int64), 0
    for a, b, k in spans:
        if a >= free:
            y[a], y[a + 1: b], free = 1 + 2 * k, 2 + 2 * k, b
    return y


def _rewrite(s: str, spans: list[tuple[int, int, int]], r: np.random.Generator) -> tuple[str, list]:
    """A window with some spans in forms that the patterns don't know."""
    out, new, at = "", [], 0
    for a, b, k in spans:
        if a < at:
            continue
        span = s[a:b]
        if k == 0:
            span = span.replace("@", str(r.choice([" @ ", "(at)", " [at] "])))
        elif k == 1:
            span = span.replace(".", " . ")
        elif k == 2:
            d = _digits(span)
            span = str(r.choice([".", "/"])).join(d[i: i + 4] for i in range(0, len(d), 4))
        else:
            span = str(r.choice(["00", "("])) + span[1:] if r.random() < 0.5 else span[1:].lstrip("0123456789 ")
        if len(span) < 7:
            span = s[a:b]
        out += s[at:a]
        new.append((len(out), len(out) + len(span), k))
        out += span
        at = b
    return out + s[at:], new


def examples(text: str) -> list[tuple[int, str]]:
    """(kind, window) of every base span that fits into a window, at a place that the text's
    own bytes decide; and as many windows without a span (kind -1)."""
    out, spans = [], base_spans(text)
    place = zlib.crc32(text[:4096].encode("utf-8", "surrogatepass"))
    for n, (a, b, k) in enumerate(spans):
        if b - a <= WINDOW:
            shift = (place + 7919 * n) % (WINDOW - (b - a) + 1)
            out.append((k, text[max(0, a - shift): max(0, a - shift) + WINDOW]))
    plain = [m.start() for m in _SEED.finditer(text)]
    for n in range(len(out) + 1):
        at = plain[(place + 104729 * n) % len(plain)] if plain and n % 2 else (place + 1299709 * n) % max(1, len(text))
        w = text[max(0, at - WINDOW // 2): max(0, at - WINDOW // 2) + WINDOW]
        if w and not base_spans(w):
            out.append((-1, w))
    return out


def fit(docs: DataFrame, text_col: str = "text") -> Model | None:
    """Train on a bounded sample of windows for each kind, labelled by the patterns; None
    where the corpus holds no span.  The documents they come from are those of the least
    hashes with signs of the kind."""
    signs = [F.coalesce(F.expr(sign), F.lit(False)).alias(k) for sign, k in zip(_SIGNS, KINDS)]
    seen = staged(docs.select(F.col(text_col).alias("t")).select(F.xxhash64("t").alias("h"), *signs).where(" or ".join(KINDS)), "pii-signs")
    chosen = None
    for k in KINDS:
        part = seen.where(k).select("h").distinct().orderBy("h").limit(DOCUMENTS)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(text_col).alias("t")).withColumn("h", F.xxhash64("t")) \
        .join(F.broadcast(chosen.distinct()), "h", "left_semi")  # at most 4 * DOCUMENTS hashes

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["t"]:
                found = examples(t)
                yield pd.DataFrame({"kind": np.array([k for k, _ in found], np.int32), "w": pd.Series([w for _, w in found], dtype=object)})

    cells = staged(texts.select("t").mapInPandas(cut, "kind int, w string").distinct(), "pii-windows")
    picked: list[str] = []
    for k in range(-1, len(KINDS)):
        room = TRAINING // 6 if k >= 0 else TRAINING - len(KINDS) * (TRAINING // 6)
        picked += [r["w"] for r in cells.where(F.col("kind") == k).orderBy(F.xxhash64("w"), "w").limit(room).collect()]
    return train([(w, base_spans(w)) for w in picked])


def train(labelled: list[tuple[str, list]]) -> Model | None:
    """A model of labelled windows; None where none holds a span.  Windows of a kind take turns
    until there are ``TRAINING // 6``, half of the turns with spans in rewritten forms and at
    other places, so rare kinds are learnt too."""
    groups: dict[int, list[tuple[str, list]]] = {}
    for w, spans in labelled:
        groups.setdefault(spans[0][2] if spans else -1, []).append((w, spans))
    if not set(groups) - {-1}:
        return None
    r = np.random.default_rng(1)
    turns = [g[n % len(g)] for k, g in sorted(groups.items())
             for n in range(TRAINING // 6 if k >= 0 else min(len(g), TRAINING - len(KINDS) * (TRAINING // 6)))]
    x, y = np.zeros((len(turns), WINDOW), np.int64), np.zeros((len(turns), WINDOW), np.int64)
    for i, (s, spans) in enumerate(turns):
        if spans and r.random() < 0.5:
            s, spans = _rewrite(s, spans, r)
        skip = int(r.integers(0, 1 + min([len(s) - 1, 24, *(a for a, _, _ in spans)]))) if s else 0  # the span moves
        s, spans = s[skip:], [(a - skip, b - skip, k) for a, b, k in spans if a >= skip]
        n = min(len(s), WINDOW)
        x[i, :n], y[i, :n] = codes(s)[:n], _label(s, spans)[:n]
    return Model().train(x, y)


def _well_formed(s: str, kind: int) -> bool:
    """Form that an added span must have."""
    if kind == 0:
        return bool(re.fullmatch(r"[\w.%+-]+\s?(?:@|[(\[]at[)\]])\s?[\w-]+(?:\.[\w-]+)+", s))
    d = _digits(s)
    if kind == 1:
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and not re.search(r"[^0-9.\s]", s)
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d) and not re.search(r"[^0-9./\s-]", s)
    return 9 <= len(d) <= 15 and not re.search(r"[^0-9+().\s/-]", s) and bool(re.search(r"[\s().-]", s)) and not re.fullmatch(r"[0-9.]+", s)


def windows(text: str) -> list[int]:
    """Starts of windows that together cover all that is within reach of a sign,
    each overlapping the next by half."""
    out: list[int] = []
    end = -1
    for m in _SEED.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.start() + REACH)
        if b <= end:
            continue
        start = max(a, (out[-1] + WINDOW // 2) if out and a < end else a)
        while True:
            out.append(start)
            end = start + WINDOW
            if end >= b:
                break
            start += WINDOW // 2
    return out


def _cut(row: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, end, kind) of the runs of a kind in a row of tags; a begin tag ends a run."""
    kinds = (row + 1) // 2
    edge = np.flatnonzero(np.r_[True, (kinds[1:] != kinds[:-1]) | (row[1:] % 2 == 1)]) if len(row) else np.zeros(0, np.int64)
    for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(row)]):
        if kinds[i]:
            yield i, j, int(kinds[i]) - 1


def reconcile(text: str, base: list[tuple[int, int, int]], starts: list[int], tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int]]:
    """Base spans and the added ones of a whole text, by start, then kind."""
    proposals = []
    first = 0
    while first < len(starts):
        last = first  # a run of overlapping windows
        while last + 1 < len(starts) and starts[last + 1] < starts[last] + WINDOW:
            last += 1
        end = min(starts[last] + WINDOW, len(text))
        # the half-way points between the centres of neighbouring windows
        cuts = [starts[first], *((starts[w] + starts[w + 1] + WINDOW) // 2 for w in range(first, last)), end]
        at = [(w, cuts[w - first] - starts[w], min(cuts[w - first + 1], end) - starts[w]) for w in range(first, last + 1)]
        row = np.concatenate([tags[w, a:e] for w, a, e in at])
        p = np.concatenate([sure[w, a:e] for w, a, e in at])
        for i, j, kind in _cut(row):
            q = float(p[i:j].mean())
            if q >= CERTAIN:
                proposals.append((-q, starts[first] + i, starts[first] + j, kind))
        first = last + 1
    kept = list(base)
    for _, a, b, kind in sorted(proposals):  # the most certain first
        if all(b <= s or a >= e for s, e, _ in kept if s < b) and _well_formed(text[a:b], kind):
            kept.append((a, b, kind))
    return sorted(kept, key=lambda x: (x[0], x[2]))


def find(texts: list[str | None], model: Model | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each whole text."""
    texts = ["" if t is None else t for t in texts]
    base = [base_spans(t) for t in texts]
    jobs = []
    for i, t in enumerate(texts):
        if model is not None and _SEED.search(t):
            jobs += [(i, s) for s in windows(t)]
    starts: dict[int, list[int]] = {}
    found: dict[int, list] = {}
    for s in range(0, len(jobs), 512):
        part = jobs[s: s + 512]
        x = np.zeros((len(part), WINDOW), np.int64)
        for k, (i, a) in enumerate(part):
            c = codes(texts[i][a: a + WINDOW])
            x[k, : len(c)] = c
        tags, sure = model.decode(x)
        for k, (i, a) in enumerate(part):
            starts.setdefault(i, []).append(a)
            found.setdefault(i, []).append((tags[k], sure[k]))
    out = []
    for i, t in enumerate(texts):
        if i in found:
            tags, sure = (np.stack(v) for v in zip(*found[i]))
            out.append((base[i], reconcile(t, base[i], starts[i], tags, sure)))
        else:
            out.append((base[i], base[i]))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redacted(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """A text with each span replaced; overlapping spans become one, named by the first."""
    if not spans:
        return text
    out, end = [], 0
    for a, b, k in spans:
        if a >= end:
            out += [text[end:a], MASK.format(KINDS[k].upper())]
        end = max(end, b)
    return "".join(out) + text[end:]


def detect(docs: DataFrame, model: Model | None, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, n_email, n_ip, n_card, n_phone`` (base spans), ``base_sha256, spans`` and
    ``redacted`` (the text with all spans masked) of every row.

    Null text is empty and stays null in ``redacted``.  Offsets are code points, ends
    exclusive.  Repeated rows and null keys are kept, other columns ignored; an empty
    table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            found = find(texts, shared.value)
            out = {"key": b["key"]}
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"] = [sum(s[2] == k for s in base) for base, _ in found]
            out["base_sha256"] = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
            out["spans"] = [written(all_) for _, all_ in found]
            out["redacted"] = [redacted(t, all_) for t, (_, all_) in zip(texts, found)]
            yield pd.DataFrame(out)

    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text_col).alias("text"))
    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    out = rows.mapInPandas(run, f"key string, {counts}, base_sha256 string, spans string, redacted string")
    return out.withColumn("key", F.col("key").cast(docs.schema[key].dataType)).withColumnRenamed("key", key)


def redact(docs: DataFrame, model: Model | None, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span of the text masked, and its length in code points in
    ``length_col``, where there is such a column.  All other columns and rows stay."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    length_at = docs.columns.index(length_col) if length_col in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            changed = [redacted(t, spans) for t, (_, spans) in zip(texts, find(texts, shared.value))]
            columns = list(b.columns)
            columns[at] = pa.array(changed, b.schema.field(at).type)
            if length_at >= 0:
                lengths = columns[length_at].to_pylist()
                columns[length_at] = pa.array([n if new == old else len(new) for n, new, old in zip(lengths, changed, texts)],
                                              b.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)


def fit_and_detect(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return detect(docs, fit(docs)).drop("redacted")
