"""Words of many texts as numpy arrays of 64-bit hashes: no Python object for each word.

A span of bytes is hashed lane by lane: eight bytes at a time are mixed into the state together with the place
of the lane, and the length goes in first, so no sum or product over the bytes can cancel out. Spans of more
than LONG bytes are hashed with blake2b. Words of at most eight bytes of one length never meet; other words
meet as values of a random function would, about once for 2**32 distinct words, unless they were made to.
"""

from __future__ import annotations

import hashlib

import numpy as np

UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes.maketrans(UPPER, UPPER.lower())
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_NON_WORD = np.zeros(256, bool)
_NON_WORD[:0x80] = True
_NON_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
#: Bytes between words: white space, or (for lower-cased text) all ASCII but letters and digits.
SEPARATORS = {"space": _SPACE, "word": _NON_WORD}

#: Bytes hashed at once; each slice makes some arrays of that length.
SLICE = 1 << 19
#: Spans of more bytes than this go through blake2b one by one.
LONG = 512
_LANE, _LENGTH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end] for each span; other seeds give other functions."""
    padded = data + bytes(8)
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    length = ends - starts
    h = mix((length.astype(np.uint64) + np.uint64(seed)) * _LENGTH) ^ (lanes[starts] & _MASKS[np.minimum(length, 8)])
    h = mix(h)
    left = np.flatnonzero((length > 8) & (length <= LONG))
    at = 8
    while len(left):
        k = np.minimum(length[left] - at, 8)
        h[left] = mix((h[left] + np.uint64(at * int(_LANE) & (2**64 - 1))) ^ (lanes[starts[left] + at] & _MASKS[k]))
        at += 8
        left = left[length[left] > at]
    for i in np.flatnonzero(length > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def encoded(text) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def _hash_slice(parts: list[bytes], between: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    buf = (b" ".join(parts) + b" ").translate(LOWER)
    a = np.frombuffer(buf, np.uint8)
    sep = between[a]
    edges = np.flatnonzero(np.diff(sep, prepend=True))
    starts, ends = edges[0::2], edges[1::2]
    if longest and len(starts) and int((ends - starts).max()) > longest:
        n = -(-(ends - starts) // longest)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts, ends = np.repeat(starts, n) + nth * longest, np.minimum(np.repeat(starts, n) + (nth + 1) * longest, np.repeat(ends, n))
    h = span_hashes(buf, starts, ends)
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    return h, np.searchsorted(starts, at[:-1])


def word_hashes(texts, kind: str = "space", longest: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets: words of text i are hashes[offsets[i]:offsets[i + 1]]).

    A-Z count as a-z. Null and empty texts have no words. With longest, words of more bytes are cut into
    pieces of so many.
    """
    between = SEPARATORS[kind]
    hashes, offsets, total = [], [], 0
    part: list[bytes] = []
    size = 0

    def flush():
        nonlocal part, size, total
        if part:
            h, o = _hash_slice(part, between, longest)
            hashes.append(h)
            offsets.append(o + total)
            total += len(h)
            part, size = [], 0

    for text in texts:
        b = encoded(text)
        if size + len(b) >= SLICE:
            flush()
        part.append(b)
        size += len(b) + 1
    flush()
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    o = np.concatenate([*offsets, [total]]).astype(np.int64)
    return h, o


def chain(h: np.ndarray, k: int, order: int | None = None) -> np.ndarray:
    """Hashes of all runs of k consecutive items of h; h and the result are uint64."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = np.full(n, 0x243F6A8885A308D3 + k, np.uint64)
    for i in range(k):
        x = mix(x * np.uint64(0x2545F4914F6CDD1D) + h[i : i + n])
    return x


def shingle_sets(texts, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each text its sorted distinct k-word shingles, as uint64, and its number of words.

    A text of fewer words, but not none, has its whole sequence as the one shingle.
    """
    h, o = word_hashes(texts)
    runs = chain(h, k)
    sets = []
    for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(runs[a : b - k + 1])
            sets.append(s[np.flatnonzero(np.diff(s, prepend=s[0] ^ np.uint64(1)))])
        else:
            sets.append(chain(h[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return sets, np.diff(o)
