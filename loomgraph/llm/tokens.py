"""Ids of a public tokenizer, exactly as the tokenizers library gives them, in large batches.

The vocabulary of lower-cased words with word ends splits a text into runs of letters, single digits and
runs of anything else, and merges each run by itself. Here numpy cuts a batch of plain Latin texts into
those runs and hashes them (64 bits); each worker keeps the ids of the runs that it has met, and only new
ones go through the library's own merges. Every text that holds any other character, a contraction or a
special token's string is encoded whole by the library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pandas as pd

from .textvec import SLICE, span_hashes

DEFAULT = "word_bpe_49k.json"
#: Runs whose ids a Python worker keeps (some 120 bytes each); beyond that it starts anew.
KEPT = 400_000
#: Code points of one batch.
BATCH = 1 << 19

#: Code points whose lower case and class are the same in Python and in the library.
_SAFE = [chr(i) for i in [*range(0x1C), *range(0x20, 0x130), *range(0x131, 0x180), *range(0x2010, 0x2028), 0x20AC]]
_OTHER = re.compile(f"[^{''.join(map(re.escape, _SAFE))}]")
_CONTRACTION = re.compile("'(?:[sStTmMdD]|[rR][eE]|[vV][eE]|[lL][lL])")
_SPACE, _LETTER, _DIGIT, _REST = range(4)
_CLASS = np.zeros(0x20AD, np.uint8)
for _c in _SAFE:
    _CLASS[ord(_c)] = {"L": _LETTER, "N": _DIGIT}.get(unicodedata.category(_c)[0], _SPACE if _c.isspace() else _REST)
#: Bytes that the byte-level alphabet writes as themselves; the others follow from U+0100 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SELF} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SELF)}


def goes_whole(text: str) -> bool:
    """Whether the library must encode the text itself: other characters, special tokens, contractions."""
    return "<|" in text or ("'" in text and bool(_CONTRACTION.search(text))) or not (text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f")) and bool(_OTHER.search(text))


def vocabulary_path(name: str = DEFAULT) -> str:
    """Where the installed vocabulary files are; a full path is taken as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """encode_all(texts) -> (all ids as uint32, offsets of the texts), without special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_runs = bool(spec["model"].get("end_of_word_suffix")) and kinds == ["NFC", "Replace", "Lowercase"]
        self.model = self.whole.model
        self._forget()

    def _forget(self) -> None:
        self.slot: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.at, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.second = np.zeros(1 << 14, np.uint64)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, keys: list[int], second: np.ndarray, runs: list[str]) -> None:
        """Ids of runs not met before, from the library's merges."""
        parts, tokenize = [], self.model.tokenize
        for run in runs:
            as_bytes = run if run.isascii() else run.encode().decode("latin-1").translate(_BYTES)
            parts.append(array("I", [t.id for t in tokenize(as_bytes)]))
        lengths = np.array([len(p) for p in parts], np.int64)
        ids = np.frombuffer(b"".join(parts), np.uint32)
        n = len(self.slot)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while n + len(runs) > len(self.at):
            self.at, self.length, self.second = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length, self.second))
        self.pool[self.used : self.used + len(ids)] = ids
        self.length[n : n + len(runs)] = lengths
        self.at[n : n + len(runs)] = self.used + np.cumsum(lengths) - lengths
        self.second[n : n + len(runs)] = second
        self.used += len(ids)
        self.slot.update(zip(keys, range(n, n + len(runs)), strict=True))

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of normalised texts of safe characters."""
        joined = "\n".join(texts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = _CLASS[cp]
        cuts = np.flatnonzero((np.diff(kind, prepend=np.uint8(255)) != 0) | (kind == _DIGIT))
        stops = np.append(cuts[1:], len(cp))
        inside = kind[cuts] != _SPACE
        starts, stops = cuts[inside], stops[inside]
        narrow = cp.astype("<u2").tobytes()  # safe characters have code points below 2**16
        keys, second = (span_hashes(narrow, 2 * starts, 2 * stops, seed) for seed in (1, 2))
        codes, uniques = pd.factorize(keys)
        if len(self.slot) + len(uniques) > KEPT:
            self._forget()
        listed = uniques.tolist()
        new = [i for i, k in enumerate(listed) if k not in self.slot]
        if new:
            first = np.zeros(len(uniques), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            at = first[new]
            self._learn([listed[i] for i in new], second[at], [joined[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)])
        slots = np.fromiter(map(self.slot.__getitem__, listed), np.int64, len(listed))[codes]
        if (self.second[slots] != second).any():  # two runs with one first hash
            parts = [self._whole(t) for t in texts]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        lengths = self.length[slots]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.arange(total) + np.repeat(self.at[slots] - (ends - lengths), lengths)]
        first_char = np.zeros(len(texts), np.int64)
        np.cumsum([len(t) + 1 for t in texts[:-1]], out=first_char[1:])
        runs_before = np.append(np.searchsorted(starts, first_char), len(starts))
        before = np.concatenate([[0], ends])[runs_before]
        return ids, np.diff(before)

    def encode_all(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Null and empty texts have no ids."""
        made: list[np.ndarray | None] = [None] * len(texts)
        waiting: list[tuple[int, str]] = []
        size = 0

        def flush():
            nonlocal waiting, size
            if waiting:
                ids, lengths = self._batch([t for _, t in waiting])
                for (i, _), part in zip(waiting, np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                    made[i] = part
            waiting, size = [], 0

        for i, text in enumerate(texts):
            if not isinstance(text, str) or not text:
                continue
            if not self.by_runs or len(text) > SLICE or goes_whole(text):
                made[i] = self._whole(text)
                continue
            text = unicodedata.normalize("NFC", text).lower()
            if size + len(text) > BATCH:
                flush()
            waiting.append((i, text))
            size += len(text) + 1
        flush()
        empty = np.zeros(0, np.uint32)
        parts = [empty if p is None else p for p in made]
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=offsets[1:])
        return (np.concatenate(parts) if parts else empty), offsets


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder in each Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
