"""Token counts of a byte-level vocabulary by a map-side lookup in two tiers.

The library cuts a text into pre-tokens (runs of letters, digits, other signs, white space) and merges each by itself, so a
text has as many tokens as its pre-tokens have. The lengths of the frequent ones are broadcast as one compact hash
table; a miss is looked up in its worker's cache, and what the cache lacks is merged by the library once. No pre-token is
shuffled: `frequent` reads all texts and sums them up in each task by a Misra-Gries summary of bounded size, and only
summaries are merged, some at a time.

The classes of code points that decide where a pre-token ends are asked from the library itself. Strings of added tokens
inside a text count as the library's default has it, one token each. A vocabulary of another build (`.model` files,
other pre-tokenizers, normalizers) is counted by its library text by text.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each. Ties in the summary only decide which
lengths are broadcast, never a count. Empty tables give no rows. Extra columns are not read. Texts are cut into
slices where a pre-token surely ends, so a long one takes no more memory than a slice, or than its longest pre-token.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, releasing
from .textvec import span_hashes
from .tokens import _BYTES, vocabulary_path

DEFAULT = "byte_bpe_50k.json"
#: Pre-tokens whose lengths are broadcast, at 14 bytes each in a table twice as large.
FREQUENT = 16_384
#: Pre-tokens that a task counts before it subtracts, that its summary keeps, and summaries that are merged at once.
COUNTED, SENT, MERGED = 65_536, 16_384, 16
#: Longer pre-tokens aren't broadcast, and not kept by workers either; in bytes of the hashed form.
LONGEST = 128
#: Code points of one batch, pre-tokens that a worker's cache keeps; beyond that it starts anew.
BATCH, KEPT = 1 << 19, 400_000
_SPACE, _LETTER, _DIGIT, _REST, _BREAK = range(5)


class Lengths:
    """A hash table of pre-token lengths as three arrays: open addressing, places in a row, 0 for none."""

    def __init__(self, keys: np.ndarray, seconds: np.ndarray, lengths: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.keys, self.seconds, self.lengths = np.zeros(size, np.uint64), np.zeros(size, np.uint32), np.zeros(size, np.uint16)
        for k, s, n in zip(keys.tolist(), seconds.tolist(), lengths.tolist(), strict=True):
            at = k & (size - 1)
            while self.lengths[at]:
                at = (at + 1) & (size - 1)
            self.keys[at], self.seconds[at], self.lengths[at] = k, s, n

    def find(self, keys: np.ndarray, seconds: np.ndarray) -> np.ndarray:
        """The lengths, 0 where the table has none."""
        mask = len(self.keys) - 1
        out = np.zeros(len(keys), np.int64)
        todo, at = np.arange(len(keys)), (keys & np.uint64(mask)).astype(np.int64)
        while len(todo):
            have = self.lengths[at]
            same = (self.keys[at] == keys[todo]) & (have > 0)
            hit = todo[same]
            out[hit] = np.where(self.seconds[at[same]] == seconds[hit], have[same], 0)
            on = ~same & (have > 0)
            todo, at = todo[on], (at[on] + 1) & mask
        return out


class PreTokens:
    """Cuts texts as the library's byte-level pre-tokenizer does, many at once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.model, self.cutter = self.library.model, self.library.pre_tokenizer
        added = self.library.get_added_tokens_decoder().values()
        plain = isinstance(self.cutter, ByteLevel) and self.cutter.use_regex and not self.cutter.add_prefix_space
        self.by_pieces = plain and self.library.normalizer is None and not any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added)
        self.special = re.compile("|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content)))) if added else None
        self.classes = np.zeros(0x110000, np.uint8)
        self.asked = np.zeros(0x1100, bool)
        self.cache: dict[int, tuple[int, int]] = {}

    def kinds(self, cp: np.ndarray) -> np.ndarray:
        """Classes of code points; a page of 256 is asked when its first code point is met."""
        pages = np.unique(cp >> np.uint32(8))
        for page in pages[~self.asked[pages]].tolist():
            signs = [chr(c) for c in range(page << 8, (page + 1) << 8) if not 0xD800 <= c < 0xE000]
            known = np.full(len(signs), _SPACE, np.uint8)
            for kind, sign in ((_LETTER, "a"), (_DIGIT, "1"), (_REST, "!")):
                starts = {a for _, (a, _) in self.cutter.pre_tokenize_str("\n".join(sign + c for c in signs))}
                known[[3 * i + 1 not in starts for i in range(len(signs))]] = kind
            self.classes[[ord(c) for c in signs]] = known
            self.asked[page] = True
        return self.classes[cp]

    def slices(self, text: str) -> Iterator[str]:
        """The text in parts of some BATCH code points, cut where a pre-token ends whatever follows."""
        begin = 0
        while len(text) - begin > 2 * BATCH:
            at, width = begin + BATCH, 4096
            while True:
                cp = np.frombuffer(text[at : at + width].encode("utf-32-le"), np.uint32)
                kind = self.kinds(cp)
                ends = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE) & (cp[:-1] != 39))
                if len(ends) or at + width >= len(text):
                    break
                at, width = at + width - 1, 4 * width
            if not len(ends):
                break
            stop = at + int(ends[0]) + 1
            yield text[begin:stop]
            begin = stop
        yield text[begin:]

    def cut(self, parts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all parts joined, starts and ends of pre-tokens, their two hashes, pre-tokens before each part)."""
        joined = "\n".join(parts) + "\n"
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kind = self.kinds(cp)
        breaks = np.cumsum([len(p) + 1 for p in parts]) - 1
        kind[breaks] = _BREAK
        first = np.diff(kind, prepend=np.uint8(255)) != 0
        first[breaks] = True
        start = first.copy()
        solid = (kind == _LETTER) | (kind == _DIGIT) | (kind == _REST)
        runs = np.flatnonzero(first & solid)
        after_space = runs[(runs > 0) & (kind[runs - 1] == _SPACE)]
        start[after_space - 1] = True  # the last sign of white space stands alone, or
        blank = after_space[cp[after_space - 1] == 0x20]
        start[blank] = False  # is the first of what follows, if it is a blank
        # contractions: an apostrophe that no blank leads, and the letters of one after it
        q = runs[cp[runs] == 39]
        q = q[(q == 0) | (cp[q - 1] != 0x20) | (kind[q - 1] == _BREAK)]
        q = q[q + 1 < len(cp)]
        q = q[kind[q + 1] == _LETTER]
        if len(q):
            x, y = cp[q + 1], np.where(q + 2 < len(cp), cp[np.minimum(q + 2, len(cp) - 1)], 0)
            n = np.where(np.isin(x, [ord(c) for c in "stmd"]), 1, 0)
            for a, b in ("re", "ve", "ll"):
                n[(x == ord(a)) & (y == ord(b))] = 2
            q, n = q[n > 0], n[n > 0]
            start[q + 1] = False
            end = q + 1 + n
            start[end[kind[end] == _LETTER]] = True
        at = np.flatnonzero(start)
        ends = np.append(at[1:], len(cp))
        inside = kind[at] != _BREAK
        starts, ends = at[inside], ends[inside]
        if len(cp) and int(cp.max()) > 0xFFFF:
            data, width, seeds = cp.tobytes(), 4, (3, 4)
        else:
            data, width, seeds = cp.astype("<u2").tobytes(), 2, (1, 2)
        keys = span_hashes(data, width * starts, width * ends, seeds[0])
        seconds = (span_hashes(data, width * starts, width * ends, seeds[1]) >> np.uint64(32)).astype(np.uint32)
        return joined, starts, ends, keys, seconds, np.searchsorted(starts, np.concatenate([[0], breaks[:-1] + 1]))

    def merged(self, piece: str) -> int:
        """Tokens of one pre-token, by the library's merges."""
        return len(self.model.tokenize(piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_BYTES)))

    def lengths(self, table: Lengths, joined: str, starts, ends, keys, seconds) -> np.ndarray:
        """Tokens of each pre-token: the broadcast table, then this worker's cache, then the library."""
        out = table.find(keys, seconds)
        missing = np.flatnonzero(out == 0)
        if not len(missing):
            return out
        codes, uniques = pd.factorize(keys[missing])
        first = np.zeros(len(uniques), np.int64)
        first[codes[::-1]] = missing[::-1]
        if len(self.cache) + len(uniques) > KEPT:
            self.cache.clear()
        known = np.zeros(len(uniques), np.int64)
        check = np.zeros(len(uniques), np.uint32)
        get = self.cache.get
        for i, (key, at, second) in enumerate(zip(uniques.tolist(), first.tolist(), seconds[first].tolist(), strict=True)):
            got = get(key)
            if got is None or got[0] != second:
                got = (second, self.merged(joined[starts[at] : ends[at]]))
                self.cache[key] = got
            check[i], known[i] = got
        out[missing] = known[codes]
        for at in missing[check[codes] != seconds[missing]].tolist():  # two pre-tokens with one first hash
            out[at] = self.merged(joined[starts[at] : ends[at]])
        return out

    def parts(self, texts: list[str | None]) -> Iterator[tuple[list[int], list[int], list[str]]]:
        """Batches (text of each part, added tokens before it, the parts); an added token's string parts a text."""
        owner, extra, parts, size = [], [], [], 0
        for i, text in enumerate(texts):
            pieces = self.special.split(text) if text and self.special is not None and self.special.search(text) else [text or ""]
            for k, piece in enumerate(pieces):
                for j, part in enumerate(self.slices(piece)):
                    if size + len(part) > BATCH and parts:
                        yield owner, extra, parts
                        owner, extra, parts, size = [], [], [], 0
                    owner.append(i)
                    extra.append(int(k > 0 and j == 0))
                    parts.append(part)
                    size += len(part) + 1
        if parts:
            yield owner, extra, parts

    def count_all(self, texts: list[str | None], table: Lengths) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        for owner, extra, parts in self.parts(texts):
            joined, starts, ends, keys, seconds, before = self.cut(parts)
            sums = np.concatenate([[0], np.cumsum(self.lengths(table, joined, starts, ends, keys, seconds))])
            np.add.at(total, owner, np.diff(sums[np.append(before, len(starts))]) + np.array(extra))
        return total


class Whole:
    """Vocabularies that aren't byte-level pairs: the library counts text by text."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.one = lambda t: len(model.encode(t, num_threads=1))
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.one = lambda t: len(tokenizer.encode(t, add_special_tokens=False).ids)

    def count_all(self, texts: list[str | None], table: Lengths) -> np.ndarray:
        return np.array([self.one(t) if t else 0 for t in texts], np.int64)


_cutters: dict[str, PreTokens | Whole] = {}


def cutter(path: str) -> PreTokens | Whole:
    """One for each Python worker, with its cache."""
    if path not in _cutters:
        found = None if path.endswith(".model") else PreTokens(path)
        _cutters[path] = found if found is not None and found.by_pieces else Whole(path)
    return _cutters[path]


def trimmed(counts: Counter, most: int) -> Counter:
    """The `most` largest, less what the next one has: the step of a Misra-Gries summary, which merging keeps right."""
    if len(counts) <= most:
        return counts
    top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))
    less = top[most][1]
    return Counter({k: n - less for k, n in top[:most] if n > less})


SUMMARY = "at long, pieces array<string>, counts array<long>"


def frequent(docs: DataFrame, path: str, most: int = FREQUENT) -> pd.DataFrame:
    """key, second, length of frequent pre-tokens: every one that makes up more than one in SENT of all is among them."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cutter(path)
        counts: dict[int, int] = {}
        names: dict[int, str] = {}
        for batch in batches:
            for _, _, parts in c.parts(batch.column(0).to_pylist()):
                joined, starts, ends, keys, *_ = c.cut(parts)
                short = np.flatnonzero(ends - starts <= LONGEST // 2)
                codes, uniques = pd.factorize(keys[short])
                at = np.zeros(len(uniques), np.int64)
                at[codes[::-1]] = short[::-1]
                for key, n, i in zip(uniques.tolist(), np.bincount(codes, minlength=len(uniques)).tolist(), at.tolist(), strict=True):
                    if key in counts:
                        counts[key] += n
                    else:
                        counts[key] = n
                        names[key] = joined[starts[i] : ends[i]]
                if len(counts) > COUNTED:
                    counts = dict(trimmed(Counter(counts), COUNTED // 2))
                    names = {k: names[k] for k in counts}
        kept = trimmed(Counter({names[k]: n for k, n in counts.items()}), SENT)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([list(kept)], pa.list_(pa.string())), pa.array([list(kept.values())], pa.list_(pa.int64()))], names=["at", "pieces", "counts"])

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        total: Counter = Counter()
        for pieces, counts in zip(rows["pieces"], rows["counts"], strict=True):
            for p, n in zip(pieces, counts, strict=True):
                total[p] += int(n)
            if len(total) > COUNTED:
                total = trimmed(total, SENT)
        total = trimmed(total, SENT)
        return pd.DataFrame({"at": [int(rows["at"].iloc[0]) // MERGED], "pieces": [list(total)], "counts": [list(total.values())]})

    rows = cut(docs.select("text").mapInArrow(releasing(summary), SUMMARY))
    n = (rows.agg(F.max("at")).first()[0] or 0) + 1
    while n > 1:
        rows = cut(rows.groupBy(F.floor(F.col("at") / MERGED)).applyInPandas(joined, SUMMARY))
        n = -(-n // MERGED)

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = cutter(path)
        for f in frames:
            for pieces, counts in zip(f["pieces"], f["counts"], strict=True):
                best = [p for p, _ in sorted(zip(pieces, counts, strict=True), key=lambda x: (-x[1], x[0]))[:most]]
                for i in range(0, len(best), 1000):
                    made = [c.cut([p]) for p in best[i : i + 1000]]
                    yield pd.DataFrame({"key": [int(m[3].view(np.int64)[0]) for m in made], "second": [int(m[4][0]) for m in made], "length": [c.merged(p) for p in best[i : i + 1000]]})

    return rows.mapInPandas(measured, "key long, second long, length int").toPandas()


def count_tokens(docs: DataFrame, tokenizer: str = DEFAULT, limit: int = 1024, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document's whole text."""
    path = vocabulary_path(tokenizer)
    docs = docs.select("doc_id", "text")
    found = frequent(docs, path, most) if isinstance(cutter(path), PreTokens) else pd.DataFrame({"key": [], "second": [], "length": []}, dtype=np.int64)
    lengths = Lengths(found["key"].to_numpy(np.int64).view(np.uint64), found["second"].to_numpy(np.uint32), found["length"].to_numpy(np.uint16))
    sent = docs.sparkSession.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = cutter(path)
        for batch in batches:
            n = c.count_all(batch.column(1).to_pylist(), sent.value)
            size = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
