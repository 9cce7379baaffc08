"""Weighted backoff automaton: smoothed n-grams as states with failure arcs.

Counts of all n-grams of the training texts are smoothed in a hierarchy: a word w after the history h has
    p(w | h) = (c(h w) + M * p(w | shorter h)) / (c(h) + M),
with p(w) = (c(w) + 1) / (N + V + 1) at the end. A history of two tokens or more counts only if it was seen
CUTOFF times; else p(w | h) = p(w | shorter h). So a history that was seen often enough is a state; each n-gram h w that
was seen is an arc with weight log10 p(w | h); and the failure arc to the shorter history weighs
log10(M / (c(h) + M)), exactly what is left for words without an arc. A text is scored in one pass from left
to right: from the current state take the word's arc, or failure arcs until one has it, and carry the state.

The corpus counts come by `counting.totals`: each block of documents learns the totals of the n-grams that it
holds and builds its part of the automaton, which has every state and arc that its texts can take. Blocks are
bounded, so no task, broadcast or driver needs the whole model. Words and pairs are asked for first; longer n-grams
then, only those whose history is a state.

Texts are traversed in lanes: each text is cut into lanes of LANE tokens, all lanes of a block take one arc each at
a time. A lane that begins within a text first reads the tokens before it, ORDER - 1 of them, from the empty state:
that brings it to the state in which the text's traversal arrives there, since no state is longer.

Null and empty texts have one token, the end. Repeated rows count and are scored each. A table without
training rows gives N = 0 and V = 0. Empty tables give no rows. Extra columns are not read. Words are 64-bit
hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks_of, crc_of_id, in_blocks, release, text_bytes, text_of
from .counting import BUCKET_HASHES, answers_for, distinct, in_order, totals
from .textvec import mix, word_hashes

ORDER = 3
#: Least count of a history of two tokens or more.
CUTOFF = 2
#: Pseudo-counts of the shorter history.
M = 4.0
#: Text bytes of one block.
BLOCK_BYTES = 3 << 20
#: Tokens of one lane.
LANE = 256
#: Last bit of a hash: 1 for single tokens, 0 for longer n-grams.
_ONE = np.uint64(1)
END, START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814E)


def held_out():
    return crc_of_id("doc_id") % 7 == 2


class Tokens:
    """The tokens of some texts: word hashes, then one end each; and the n-grams that end at each token."""

    def __init__(self, texts: list[str | None], order: int):
        h, o = word_hashes(texts)
        n = len(texts)
        self.offsets = o + np.arange(n + 1)
        w = np.insert(h | _ONE, o[1:], END)
        self.grams: list[np.ndarray] = [w]  # grams[k]: hash of the k + 1 tokens up to each place
        place = np.arange(len(w)) - np.repeat(self.offsets[:-1], np.diff(self.offsets))
        before = w
        chained = w
        for k in range(1, order):
            # the token k places before; START stands before the text, once
            before = np.concatenate([np.full(1, START), before[:-1]])
            before = np.where(place == k - 1, START, before)
            chained = mix(chained * np.uint64(0x2545F4914F6CDD1D) + before + np.uint64(k))
            self.grams.append(np.where(place >= k - 1, chained & ~_ONE, np.uint64(0)))
        self.place = place


def histories(tokens: Tokens, order: int) -> list[np.ndarray]:
    """histories[k]: hash of the k + 1 tokens before each place, 0 where START has gone by."""
    out = []
    for k in range(order - 1):
        x = np.concatenate([[START], tokens.grams[k][:-1]])
        x = np.where(tokens.place == 0, START if k == 0 else np.uint64(0), x)
        out.append(x)
    return out


class Automaton:
    """States are seen histories, by number; state 0 is the empty one. Arcs have a target and a weight.

    Built from the places of some texts: every arc that those texts can take, and no other.
    """

    def __init__(self, words: np.ndarray, states: list[np.ndarray], n_states: int, weights: list[np.ndarray], arcs: list[np.ndarray], failures: list[np.ndarray]):
        """For each place: its word's code; the state of each length of history (0: none); then for each
        length of history, the empty one first: the weight of the word's arc, whether there is one, and (from
        length 1 on) the weight of the failure arc."""
        self.n_words = int(words.max()) + 1 if len(words) else 1
        self.failure, self.failure_weight = np.zeros(n_states, np.int64), np.zeros(n_states)
        levels = [np.zeros(len(words), np.int64), *states]
        keys, targets, values = [], [], []
        longest = [levels[0]]  # of each place the longest history of up to k tokens that is a state
        for at in states:
            longest.append(np.where(at > 0, at, longest[-1]))
        for k, at in enumerate(levels):
            has = np.flatnonzero(arcs[k] & ((at > 0) | (k == 0)))
            key, first = np.unique(at[has] * self.n_words + words[has], return_index=True)
            first = has[first]
            # the history after the word: the longest that the arc's own history leads to
            behind = longest[min(k + 1, len(levels) - 1)]
            keys.append(key)
            targets.append(np.append(behind[1:], 0)[first])
            values.append(weights[k][first])
            if k:
                mine = np.flatnonzero(at > 0)
                self.failure[at[mine]] = levels[k - 1][mine]
                self.failure_weight[at[mine]] = failures[k - 1][mine]
        keys = np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        self.arcs, self.target, self.weight = keys[order], np.concatenate(targets)[order], np.concatenate(values)[order]

    def step(self, state: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, log10 probability) of each lane after its word: failure arcs until a state has the word's arc."""
        total, state = np.zeros(len(state)), state.copy()
        arc = np.zeros(len(state), np.int64)
        left = np.arange(len(state))
        while len(left):
            key = state[left] * self.n_words + words[left]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[at] == key
            arc[left[hit]] = at[hit]
            left = left[~hit]
            total[left] += self.failure_weight[state[left]]
            state[left] = self.failure[state[left]]
        return self.target[arc], total + self.weight[arc]

    def score(self, words: np.ndarray, offsets: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
        """The score of each text, words[offsets[i]:offsets[i + 1]], from state starts[i] on; in lanes."""
        length = np.diff(offsets)
        n = -(-length // LANE)
        text = np.repeat(np.arange(len(length)), n)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        begin = offsets[text] + nth * LANE
        end = np.minimum(begin + LANE, offsets[text + 1])
        warm = np.where(nth > 0, order - 1, 0)
        state = np.where(nth > 0, 0, starts[text])
        sums = np.zeros(len(text))
        by = np.argsort(-(end - begin + warm), kind="stable")
        begin, end, warm, state, text = ((x[by]) for x in (begin - warm, end, warm, state, text))
        for t in range(int((end - begin).max(initial=0))):
            active = int(np.searchsorted(-(end - begin), -t, "left"))  # lanes of more than t tokens come first
            state[:active], p = self.step(state[:active], words[begin[:active] + t])
            sums[:active] += np.where(t >= warm[:active], p, 0.0)
        return np.bincount(text, sums, len(length))


def traverse(tokens: Tokens, order: int, counts: list[np.ndarray], starts: int, n: int, v: int, m: float) -> tuple[np.ndarray, np.ndarray]:
    """(score of each text, base log10 probability of each token).

    counts[k]: the training count of the k + 1 tokens up to each place; starts: the number of training texts.
    """
    base = np.log10((counts[0] + 1) / (n + v + 1))
    words = pd.factorize(tokens.grams[0])[0].astype(np.int64)
    weights, arcs, failures, states = [base], [np.ones(len(base), bool)], [], []
    probability, n_states = 10.0**base, 1
    for k, h in enumerate(histories(tokens, order)):
        seen = np.where(tokens.place == 0, starts if k == 0 else 0, np.append([0], counts[k][:-1]))
        state = np.zeros(len(h), np.int64)
        known = seen >= (CUTOFF if k else 1)
        codes, found = pd.factorize(h[known])
        state[known] = codes + n_states
        n_states += len(found)
        probability = np.where(known, (counts[k + 1] + m * probability) / (seen + m), probability)
        states.append(state)
        weights.append(np.log10(probability))
        arcs.append(counts[k + 1] > 0)
        failures.append(np.log10(m / (seen + m)))
    at = tokens.offsets[:-1]
    machine = Automaton(words, states, n_states, weights, arcs, failures)
    del weights, arcs, failures, probability
    return machine.score(words, tokens.offsets, states[0][at] if states else np.zeros(len(at), np.int64), order), base


def has_state(tokens: Tokens, counts: list[np.ndarray], k: int) -> np.ndarray:
    """Whether the k tokens before each place are a state, so that the count of the k + 1 up to it matters; k >= 2."""
    return (tokens.grams[k] != 0) & (np.append([0], counts[k - 1][:-1]) >= CUTOFF)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, order: int = ORDER, m: float = M, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs: doc_id, text, held_out; rows that aren't held out train. One row of SCORES for each."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "held_out")
    size = text_bytes(source)
    number = blocks_of(size, block_bytes)
    blocks = in_blocks(source, number, "doc_id", "held_out")
    # about one distinct n-gram of each order for every ten bytes
    buckets = max(1, size // 10 // BUCKET_HASHES)
    pairs = min(order, 2)

    def read(rows: pd.DataFrame, upto: int) -> tuple[Tokens, np.ndarray]:
        """The tokens of a block's texts, and which of them are in training texts."""
        tokens = Tokens([text_of(z) for z in rows["z"]], upto)
        return tokens, np.repeat(~rows["held_out"].to_numpy(bool), np.diff(tokens.offsets))

    def counted(tokens: Tokens, got: pd.DataFrame, upto: int) -> tuple[list[np.ndarray], int]:
        """(counts of the n-grams of up to `upto` tokens, 0 where there is no state before; number of training texts)."""
        keys = distinct(np.concatenate([*tokens.grams[:pairs], np.full(1, START)]))[0]
        count = in_order(got[got["number"] == 0], len(keys))
        counts = [np.where(g == 0, 0, count[np.searchsorted(keys, g)]) for g in tokens.grams[:pairs]]
        starts = int(count[np.searchsorted(keys, START)])
        for k in range(2, upto):
            c, asked = np.zeros(len(counts[0]), np.int64), has_state(tokens, counts, k)
            grams = tokens.grams[k][asked]
            keys = distinct(grams)[0]
            c[asked] = in_order(got[got["number"] == k - 1], len(keys))[np.searchsorted(keys, grams)]
            counts.append(c)
        return counts, starts

    def ask(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        rows = rows.reset_index(drop=True)
        tokens, trains = read(rows, pairs)
        starts = np.full(len(rows), START)
        keys, counts = distinct(np.concatenate([*tokens.grams, starts]), np.concatenate([*(g[trains] for g in tokens.grams), starts[: int((~rows["held_out"].to_numpy(bool)).sum())]]))
        return keys, np.where(keys == 0, 0, counts)

    answers = totals(blocks, number, ask, 2 * buckets, kind=_ONE)
    sums = answers.where(F.col("block") < 0).agg(F.sum("kinds"), F.sum("occurrences")).first()
    v, n = int(sums[0] or 0), int(sums[1] or 0)
    known = answers_for(answers)
    for k in range(2, order):

        def ask_longer(rows: pd.DataFrame, got: pd.DataFrame, k=k) -> tuple[np.ndarray, np.ndarray]:
            tokens, trains = read(rows, k + 1)
            asked = has_state(tokens, counted(tokens, got, k)[0], k)
            return distinct(tokens.grams[k][asked], tokens.grams[k][asked & trains])

        known = known.unionByName(answers_for(totals(blocks, number, ask_longer, buckets, known=known), k - 1))

    def scored(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        tokens, trains = read(rows, order)
        counts, starts = counted(tokens, got, order)
        scores, base = traverse(tokens, order, counts, starts, n, v, m)
        at = tokens.offsets[:-1]
        out = pd.DataFrame(
            {
                "doc_id": rows["doc_id"].astype("Int64"),
                "held_out": rows["held_out"].astype(bool),
                "n_tokens": np.diff(tokens.offsets),
                "n_known": np.add.reduceat((counts[0] > 0).astype(np.int64), at),
                "train_tokens": n,
                "base_score": np.add.reduceat(base, at),
                "score": scores,
            }
        )
        del tokens, trains, counts, base
        release()
        return out

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(scored, SCORES)
