"""Token ids of whole texts with the ``tokenizers`` library, one library call
per batch of *distinct* text units instead of one per text.

A text is cut at single ASCII spaces that no other white space touches.  Such a
cut is always a boundary of the tokenizer's own pre-tokens (a space can only
start a pre-token or be dropped), so the ids of the units, put together, are the
ids of the text.  The distinct units of a batch are looked up in a bounded memo;
the missing ones go through the library joined by a separator whose single id
cannot come from a unit.  Units for which that cannot be guaranteed (odd white
space, the separator's character, special strings) are encoded one by one.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lexivec.llm.common import utf8

#: Units in each of a worker's two memo generations; when the young one is full
#: it becomes the old one, from which units still in use move up again.
MEMO_UNITS = 180_000
#: Characters of text that one vectorised step works on.
STEP_CHARS = 8_000_000
#: An ASCII space that stands alone.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A word of Latin letters that normalising leaves whole (no U+0130, U+0149, U+017F),
#: then marks without an apostrophe: two pre-tokens at most.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+)([!-&(-/:-@\\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1
    characters stand for themselves, the others for 256, 257, ... in turn."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class UnitEncoder:
    """``encode(texts)`` gives for each text its ids as a uint32 array."""

    def __init__(self, path: str, memo_units: int = MEMO_UNITS):
        from tokenizers import Tokenizer

        self.memo_units = memo_units

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        one = lambda s: self.tok.encode(s, add_special_tokens=False).ids
        a, b = "qab", "qzc"
        # does white space vanish (word-end vocabularies) or stay part of the ids?
        self.drops_space = one(f"{a} {b}") == one(a) + one(b) and one(" \n ") == []
        self.sep_text, self.sep_char = (" \x01 ", "\x01") if self.drops_space else ("\n ", "\n")
        sep = one(self.sep_char)
        self.sep_id = sep[0] if len(sep) == 1 else None
        if not self.drops_space and one(f" {a}\n {b}\n") != one(f" {a}") + sep + one(f" {b}") + sep:
            self.sep_id = None
        # without a space-preserving rule that is known to hold, texts go whole
        self.whole = not (self.drops_space or one(f"{a} {b}") == one(a) + one(f" {b}"))
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.old_parts: dict[str, bytes] = {}
        # pre-tokens may go to the library's model directly where that gives the same ids
        self.model, self.direct = self.tok.model, False
        if not self.whole:
            probe = ["The", "Größe,", "été.&%$", "thntiestion", "Ñandú!!", "worthless#", "ÆON;", "straße", *([] if self.drops_space else ["end.\nNew", "a\nb,\nc"])]
            self.direct = all(self._direct(u if self.drops_space else " " + u) == self._ids(u if self.drops_space else " " + u)
                              for u in probe)

    def _ids(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, x: str) -> bytes:
        """Ids of one pre-token, by the library's model."""
        ids = self.parts.get(x)
        if ids is None:
            ids = self.old_parts.get(x)
            if ids is None:
                y = x.encode().decode("latin-1").translate(_LETTERS)
                found = [t.id for t in self.model.tokenize(y)]
                ids = struct.pack(f"<{len(found)}I", *found)
            self.parts[x] = ids
        return ids

    def _direct(self, unit: str) -> bytes | None:
        """Ids of a plain unit, None if it isn't plain."""
        space = "" if self.drops_space or unit[:1] != " " else " "
        out = b""
        # single line ends between words are pre-tokens of their own
        for i, piece in enumerate((unit.lower() if self.drops_space else unit[len(space):]).split("\n")):
            m = _PLAIN.fullmatch(piece)
            if m is None:
                return None
            out += (self._part("\n") + self._part(m[1])) if i else self._part(space + m[1])
            if m[2]:
                out += self._part(m[2])
        return out

    def _learn(self, units: list[str]) -> None:
        """Encode units that the memo lacks.  Unless white space is dropped, a
        unit begins with its space."""
        plain, odd = [], []
        for u in units:
            if u in self.old:
                self.memo[u] = self.old[u]
                continue
            if self.direct and (ids := self._direct(u)) is not None:
                self.memo[u] = ids
                continue
            body = u if self.drops_space else u[1:]
            bad = self.sep_id is None or not body or self.sep_char in u or any(s in u for s in self.special)
            bad = bad or (not self.drops_space and (u[:1] != " " or body[:1].isspace() or body[-1:].isspace()))
            bad = bad or (self.drops_space and body != body.strip())
            (odd if bad else plain).append(u)
        for s in range(0, len(plain), 4096):
            part = plain[s: s + 4096]
            if self.drops_space:
                text = self.sep_text.join(part) + self.sep_text
            else:
                text = "\n".join(part) + "\n"
            ids = np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(ids == self.sep_id)
            if len(ends) != len(part):
                odd.extend(part)
                continue
            begin = 0
            for u, e in zip(part, ends.tolist()):
                self.memo[u] = ids[begin:e].tobytes()
                begin = e + 1
        for u in odd:
            self.memo[u] = self._ids(u)

    def _units(self, texts: list[str]):
        """Units of all texts, one after another, and the number of each text's."""
        if self.drops_space:
            lists = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), " ")
            flat = lists.flatten()
            return flat, np.diff(lists.offsets.to_numpy())
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        return lists.flatten(), np.diff(lists.offsets.to_numpy())

    def encode(self, texts: list[str | None], step_chars: int = STEP_CHARS) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        todo, chars = [], 0
        for i, t in enumerate(texts):
            t = "" if t is None else t
            if not t:
                out[i] = np.zeros(0, "<u4")
            elif self.whole:
                out[i] = np.frombuffer(self._ids(t), "<u4")
            else:
                todo.append(i)
                chars += len(t)
                if chars >= step_chars:
                    self._step(texts, todo, out)
                    todo, chars = [], 0
        if todo:
            self._step(texts, todo, out)
        return out

    def _slow(self, t: str) -> np.ndarray:
        """A text in which white space touches white space: cut at lone spaces only."""
        units = _CUT.split(t)
        units = [units[0], *(" " + u for u in units[1:])]
        new = [u for u in dict.fromkeys(units) if u not in self.memo]
        self._learn(new)
        ids = np.frombuffer(b"".join([self.memo[u] for u in units]), "<u4")
        self._bound()
        return ids

    def _bound(self) -> None:
        if len(self.memo) > self.memo_units:
            self.old, self.memo = self.memo, {}
        if len(self.parts) > self.memo_units:
            self.old_parts, self.parts = self.parts, {}

    def _step(self, texts: list, todo: list[int], out: list) -> None:
        flat, counts = self._units([texts[i] for i in todo])
        coded = flat.dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        keys = words if self.drops_space else [" " + w for w in words]
        if "" in keys:
            self.memo[""] = b""
        memo = self.memo
        self._learn([u for u in keys if u not in memo])
        vals = [memo[u] for u in keys]
        starts_of = np.concatenate([[0], np.cumsum(counts)])
        if not self.drops_space:
            # texts with a unit that is empty or has white space at an end go another way
            touch = np.fromiter((not w or w[0].isspace() or w[-1].isspace() for w in words), bool, len(words))
            if touch.any():
                bad = np.logical_or.reduceat(touch[index], starts_of[:-1])
                for k in np.flatnonzero(bad).tolist():
                    out[todo[k]] = self._slow(texts[todo[k]])
                rest = [i for k, i in enumerate(todo) if not bad[k]]
                return self._step(texts, rest, out) if rest else None
        if not self.drops_space:
            # the first unit of a text has no space before it
            lead = [words[index[s]] for s in starts_of[:-1]]
            self._learn([u for u in dict.fromkeys(lead) if u not in memo])
            extra = {u: len(vals) + k for k, u in enumerate(dict.fromkeys(lead))}
            vals += [memo[u] for u in extra]
            index = index.astype(np.int64)
            index[starts_of[:-1]] = [extra[u] for u in lead]
        size = np.fromiter(map(len, vals), np.int32, len(vals)) // 4
        pool = np.frombuffer(b"".join(vals), "<u4")
        begin = np.cumsum(size, dtype=np.int32) - size
        n = size[index]
        ends = np.cumsum(n, dtype=np.int32)  # a step has far fewer ids than 2 ** 31
        where = np.repeat(begin[index] - (ends - n), n)
        where += np.arange(len(where), dtype=np.int32)
        ids = pool[where]
        cuts = np.concatenate([[0], ends])[starts_of]
        for k, i in enumerate(todo):
            out[i] = ids[cuts[k]: cuts[k + 1]]
        self._bound()

_ENCODERS: dict[tuple, UnitEncoder] = {}


def encoder(path: str, memo_units: int = MEMO_UNITS) -> UnitEncoder:
    """The worker's encoder of a vocabulary file, loaded once a process."""
    if (path, memo_units) not in _ENCODERS:
        _ENCODERS[path, memo_units] = UnitEncoder(path, memo_units)
    return _ENCODERS[path, memo_units]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    """Version digest of a tokenizer file's content."""
    import hashlib

    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def n_bytes(text: str | None) -> int:
    return len(utf8(text))
