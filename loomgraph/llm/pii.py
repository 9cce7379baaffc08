"""Personal data: generators propose spans, boosted trees score them, calibrated thresholds select.

Four strict patterns (email, ip, card, phone) give the base spans, which always count. Wider generators of the
same kinds, and one of secrets (long random strings), propose further, overlapping candidates in other forms:
"bob (at) example (dot) org", a phone number without +, an address with [.] for its dots. Boosted trees over
format and context features choose among them. They learn from the corpus itself:

* base spans, as they stand and rewritten in other forms at their place in the text, are positives; the features
  don't say whether a span begins with + or has an @, so the trees can't just repeat the strict patterns;
* base spans broken at their place (wrong checksum, part over 255, too few digits, prices, dates, lists) and real
  candidates that stay invalid in every form are negatives; other candidates are unlabelled and not used;
* strings behind a word such as token or password and a sign are positives of secret; that word isn't a feature.

Scores are calibrated on a part that wasn't trained on, and each kind's threshold lies halfway between the lowest score with the
wanted precision there and the next one below. A candidate over its threshold that overlaps no other span is added.

The sample is at most about SAMPLE candidates, chosen by a hash of the row: the documented bound of the fit.
Null and empty texts have no spans. Repeated rows stay. Where no candidate can be had, or only of one class,
nothing is added. Empty tables give no rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, releasing

#: Order of the kinds, as in the digests.
KINDS = ("email", "ip", "card", "phone")
#: Kinds of added spans.
ALL_KINDS = (*KINDS, "secret")
SAMPLE = 6_000
PRECISION = 0.98

# --- base spans. Fixed patterns:
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match can only begin where digits begin; so long runs are read once
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def is_octet(digits: str) -> bool:
    """At most 255; Python reads no number of thousands of digits, so zeros in front go first."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or (len(digits) == 3 and digits <= "255")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @, domain; found from each @ outwards, so that no start is tried twice."""
    out: list[tuple[int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _CARD.finditer(text):  # of two digits at least; the shortest ip has dots between, so it's looked for apart
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "." in text:
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(is_octet(x) for x in m.group().split("."))]
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return ordered(found)


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], ALL_KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k, a, b in spans])


# --- candidates
_AT, _DOT = r" ?(?:@|[(\[{] ?at ?[)\]}]) ?", r" ?(?:\.|[(\[{] ?dot ?[)\]}]) ?"
_LABEL = r"[A-Za-z0-9-]+"
_RANDOM = r"[A-Za-z0-9_+/=-]"
_WIDE = {
    "email": re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})+| at {_LABEL}(?: dot {_LABEL})+)"),
    "ip": re.compile(r"[0-9]{1,4}(?:(?: ?[.,:-] ?|\[\.\]|\(\.\)| dot )[0-9]{1,4}){2,5}"),
    "card": re.compile(r"[0-9](?:[ ./_-]{0,2}[0-9]){10,22}"),
    "phone": re.compile(r"[+(]?[0-9][0-9 ().\-/]{6,22}[0-9]"),
    "secret": re.compile(rf"(?<!{_RANDOM}){_RANDOM}{{20,}}+"),
}
#: What a text must hold for a generator to be run at all.
_NEEDS = {"email": re.compile(r"@|[\[({] ?at ?[\])}]| at [A-Za-z0-9-]+ dot "), "digits": re.compile(r"[0-9][0-9 ().,:/_-]{6}"), "ip": re.compile(r"[0-9](?: ?[.,:-] ?|\[\.\]|\(\.\)| dot )[0-9]")}
#: Longest secret.
SECRET = 200
#: Words before a span that speak for its kind. Fixed values.
_CUES = {
    "email": re.compile(r"mail|contact|write|correo|courriel|kontakt", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|server|host|address|adresse|router", re.IGNORECASE),
    "card": re.compile(r"card|visa|iban|account|karte|carte|tarjeta|konto", re.IGNORECASE),
    "phone": re.compile(r"phone|call|tel|fax|mobile|handy|llame|appel", re.IGNORECASE),
}
#: What makes a secret a positive of the training; it's no feature.
_NAMED = re.compile(r"(?:token|secret|passw(?:or)?d|pwd|api[_ -]?key|access[_ -]?key|auth)[\"' ]{0,2}[=:][\"' ]{0,2}$", re.IGNORECASE)
_HEX = frozenset("0123456789abcdefABCDEF")
FEATURES = 21


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans of the wide generators."""
    found = []
    if _NEEDS["email"].search(text):
        found += [("email", m.start(), m.end()) for m in _WIDE["email"].finditer(text)]
    if _NEEDS["ip"].search(text):
        found += [("ip", m.start(), m.end()) for m in _WIDE["ip"].finditer(text)]
    if _NEEDS["digits"].search(text):
        for kind in ("card", "phone"):
            found += [(kind, m.start(), m.end()) for m in _WIDE[kind].finditer(text)]
    found += [("secret", m.start(), m.end()) for m in _WIDE["secret"].finditer(text) if m.end() - m.start() <= SECRET]
    return found


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format of the span, then its surroundings. Neither + nor @ is looked at: those make the base patterns."""
    s = text[a:b]
    digits = _NOT_DIGIT.sub("", s)
    runs = re.findall("[0-9]+", s)
    groups = [len(g) for g in runs] or [0]
    before, after = text[max(0, a - 30) : a], text[b : b + 1]
    often = np.bincount(np.frombuffer(s.encode("ascii", "replace"), np.uint8)) if kind == "secret" else np.ones(1)
    share = often[often > 0] / often.sum()
    letters = re.findall("[A-Za-z]+", s)
    return [
        ALL_KINDS.index(kind),
        len(s),
        len(digits),
        len(set(digits)),
        sum(map(str.isalpha, s)),
        len(groups),
        max(groups),
        min(groups),
        sum(not c.isalnum() for c in s),
        s.count("."),
        s.count(" "),
        float(bool(digits) and luhn(digits)),
        float(bool(_CUES[kind].search(before))) if kind in _CUES else 0.0,
        float(before[-1:].isalnum()),
        float(after.isalnum()),
        sum(map(is_octet, runs)) / max(1, len(runs)),
        float(s.count(",") + s.count(":") + s.count("/")),
        float(bool(letters) and not any(c.isdigit() for c in letters[-1]) and 2 <= len(letters[-1]) <= 6),
        float(-(share * np.log2(share)).sum()),
        sum(c in _HEX for c in s) / len(s),
        float(max(map(len, letters), default=0)),
    ]


# --- what the trees learn from


def plain(kind: str, s: str) -> str:
    """A span's words for signs as signs, without the spaces about them."""
    if kind == "email":
        s = re.sub(r" ?[(\[{] ?at ?[)\]}] ?| at ", "@", s)
        s = re.sub(r" ?[(\[{] ?dot ?[)\]}] ?| dot ", ".", s)
        return re.sub(r" ?([@.]) ?", r"\1", s)
    if kind == "ip":
        return re.sub(r"\[\.\]|\(\.\)| dot | ?\. ?", ".", s)
    return s


def valid(kind: str, s: str) -> bool:
    """Whether a span could be of its kind in another form. What isn't is a negative."""
    digits = _NOT_DIGIT.sub("", s)
    if kind == "email":
        domain = plain(kind, s).rpartition("@")[2]
        return bool(re.search(r"\.[A-Za-z]{2,}$", domain))
    if kind == "ip":
        parts = plain(kind, s).split(".")
        return len(parts) == 4 and all(p.isdigit() and is_octet(p) for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 and (len(digits) != len(s))


def rewritten(kind: str, s: str, rng: np.random.Generator) -> str:
    """A base span in another form."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    if kind == "email":
        at, dot = pick((" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" @ ", "."), (" {at} ", " {dot} "), (" (at) ", " (dot) "))
        local, _, domain = s.rpartition("@")
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return s.replace(".", pick("[.]", "(.)", " dot ", " . "))
    groups = re.findall("[0-9]+", s)
    digits = "".join(groups)
    if kind == "card":
        k = pick(4, 4, 5, 6)
        return pick(".", "/", " - ", "  ", "_", ". ").join(digits[i : i + k] for i in range(0, len(digits), k))
    if len(groups) < 3:
        groups = [digits[:-7], digits[-7:-4], digits[-4:]]
    keep = groups if len("".join(groups[1:])) < 9 or rng.integers(3) else groups[1:]  # with or without the country's code
    return pick("", "", "00", "0") + pick(" ", "-", ".", "/", " ").join(keep)


def broken(kind: str, s: str, rng: np.random.Generator) -> str:
    """A base span made into something near that isn't personal data."""
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    number = lambda low, high: str(int(rng.integers(low, high)))
    groups = re.findall("[0-9]+", s)
    if kind == "email":
        return number(1, 90) + pick(" @ ", " (at) ", "@") + number(1, 90) + "." + number(10, 99)
    if kind == "ip":
        bad = [*groups[:3], pick(number(256, 1000), number(1000, 10000))]
        return pick(".".join(bad), " . ".join(bad), pick(".", "-").join(number(1000, 10000) for _ in range(4)), ", ".join(groups[:4]), "[.]".join(bad), "-".join([number(1990, 2030), *groups[1:3]]), ":".join(groups[:3]), ".".join([*groups[:3], *groups[:3]]))
    digits = "".join(groups)
    if kind == "card":
        i = int(rng.integers(len(digits)))
        wrong = digits[:i] + str((int(digits[i]) + 1 + int(rng.integers(8))) % 10) + digits[i + 1 :]
        if rng.integers(3) == 0:  # too few digits, the checksum right
            wrong = next(x for x in (digits[:10] + str(c) for c in range(10)) if luhn(x))
        k = pick(3, 4, 5, 30, 30)
        return pick(" ", "-", "", ".").join(wrong[i : i + k] for i in range(0, len(wrong), k))
    return pick(pick(".", " ", "-").join(number(1000, 10000) for _ in range(4)), f"{number(1990, 2030)}-{number(10, 13)}-{number(10, 29)} {number(10, 24)}", f"{digits[:4]} {digits[4:7]}", digits, f"{number(1, 99)}.{number(100, 999)}.{number(100, 999)}", digits * 2, f"{number(1000, 2000)}-{number(1000, 2000)}")


def not_secret(rng: np.random.Generator) -> str:
    """A long string that is no secret."""
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), int(rng.integers(20, 40))))
    return [letters, letters[:7] + "-" + letters[7:14] + "-" + letters[14:], "=" * len(letters), "0123456789" * 3, letters[:5] + "/" + letters[5:12] + "/" + letters[12:] + "/index", "".join(rng.choice(list("0123456789"), 24))][int(rng.integers(6))]


def examples(text: str, kind: str, a: int, b: int, base: list[tuple[str, int, int]], seed: int) -> list[tuple[list[float], int]]:
    """Features and labels that one candidate gives: its own and those of its rewritten and broken forms, put in its place."""
    rng = np.random.default_rng(seed)

    def put(s: str, label: int, at: int, end: int) -> list[tuple[list[float], int]]:
        left, right = text[max(0, at - 60) : at], text[end : end + 60]
        changed, low = left + s + right, len(left)
        found = [(x, y) for k, x, y in candidates(changed) if k == kind and x < low + len(s) and y > low]
        return [(features(changed, kind, x, y), label) for x, y in found if not label or y - x >= 0.6 * len(s)]

    if kind == "secret":
        named = bool(_NAMED.search(text[max(0, a - 30) : a]))
        return [(features(text, kind, a, b), int(named)), *(put(not_secret(rng), 0, a, b) if named else [])]
    inside = next(((x, y) for k, x, y in base if k == kind and a <= x and y <= b), None)
    if inside:
        own = text[inside[0] : inside[1]]
        forms = [put(rewritten(kind, own, rng), 1, *inside) for _ in range(2)] + [put(broken(kind, own, rng), 0, *inside) for _ in range(2)]
        return [(features(text, kind, a, b), 1), *(x for f in forms for x in f)]
    return [] if valid(kind, text[a:b]) else [(features(text, kind, a, b), 0)]


# --- boosted trees


@dataclass
class Trees:
    """Depth-limited regression trees on binned features, added up to log odds."""

    rate: float = 0.2
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, cut, value of each node of a full tree

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut_, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(feature) + 1))):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut_[node])
            out += self.rate * value[node]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, leaf: float = 5.0) -> Trees:
    """Logistic loss, second-order splits, at most 32 cuts for each feature."""
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(start=float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    raw = np.full(len(y), model.start)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        feature, cut_, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2 * inner + 1)
        node = np.zeros(len(y), np.int64)
        for n in range(inner):
            mine = np.flatnonzero(node == n)
            if not len(mine):
                continue
            best = (1e-6, 0, -1)
            gs, hs = g[mine].sum(), h[mine].sum()
            for f, c in enumerate(cuts):
                left_g = np.cumsum(np.bincount(bins[mine, f], g[mine], len(c) + 1))[:-1]
                left_h = np.cumsum(np.bincount(bins[mine, f], h[mine], len(c) + 1))[:-1]
                gain = left_g**2 / (left_h + leaf) + (gs - left_g) ** 2 / (hs - left_h + leaf) - gs**2 / (hs + leaf)
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), f, int(gain.argmax()))
            if best[2] >= 0:
                feature[n], cut_[n] = best[1], cuts[best[1]][best[2]]
            node[mine] = 2 * n + 1 + (x[mine, feature[n]] > cut_[n])
        leaves = node  # all rows are below the inner nodes now
        gl = np.bincount(leaves, g, 2 * inner + 1)
        hl = np.bincount(leaves, h, 2 * inner + 1)
        value = gl / (hl + leaf)
        raw += model.rate * value[node]
        model.trees.append((feature, cut_, value))
    return model


@dataclass
class Selector:
    trees: Trees | None = None
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.raw(x) + self.shift)))


def _platt(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through held-back scores."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * raw + b)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([((p - y) * raw).sum(), (p - y).sum()])
        hessian = np.array([[(w * raw * raw).sum() + 1e-3, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


def fit(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> Selector:
    """Train on candidates of docs (doc_id, text); all candidates are counted, about `sample` of them are used."""
    source = docs.select(F.xxhash64(F.lit(5), "doc_id", "text").alias("h"), "text").where(F.col("text").isNotNull())

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"n": [sum(len(candidates(t)) for f in frames for t in f["text"])]})

    total = source.select("text").mapInPandas(releasing(counted), "n long").agg(F.sum("n")).first()[0] or 0
    if not total:
        return Selector()
    share = min(1.0, sample / total)

    def labelled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for h, text in zip(f["h"], f["text"], strict=True):
                base = None
                for i, (kind, a, b) in enumerate(candidates(text)):
                    seed = (h * 0x9E3779B97F4A7C15 + i * 0xC2B2AE3D27D4EB4F) & (2**64 - 1)
                    if seed >> 11 < share * 2**53:
                        base = base_spans(text) if base is None else base
                        rows += [(h, i, j, x, y) for j, (x, y) in enumerate(examples(text, kind, a, b, base, seed))]
            yield pd.DataFrame(rows, columns=["h", "i", "j", "x", "y"])

    got = sorted(source.mapInPandas(releasing(labelled), "h long, i int, j int, x array<double>, y int").collect(), key=lambda r: (r.h, r.i, r.j))
    if not got:
        return Selector()
    x, y = np.array([r.x for r in got]), np.array([r.y for r in got], float)
    # whole texts are held back, so a span's forms are all on one side
    held = np.array([(r.h * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> 62 == 0 for r in got])
    if min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) < 1:
        return Selector()
    out = Selector(boost(x[~held], y[~held]))
    out.slope, out.shift = _platt(out.trees.raw(x[held]), y[held])
    p = out.probability(x[held])
    for k, kind in enumerate(ALL_KINDS):
        mine = x[held][:, 0] == k
        order = np.argsort(-p[mine], kind="stable")
        good = np.cumsum(y[held][mine][order]) / np.arange(1, mine.sum() + 1)
        fine = np.flatnonzero(good >= precision)
        if len(fine) and y[held][mine].any():
            out.thresholds[kind] = max(0.5, _between(p[mine][order], int(fine[-1])))
    return out


def _between(p: np.ndarray, last: int) -> float:
    """Halfway, in log-odds, from the last accepted of the falling probabilities to the first that isn't (0.5 if all are).

    The last accepted one itself would be too high where a kind is rare: its few held-back rows all score near 1, and
    others of it a little less, while what is rejected lies far below.
    """
    odds = lambda v: math.log(v / (1 - v))
    inside = np.clip(p, 1e-9, 1 - 1e-9)
    below = odds(float(inside[last + 1])) if last + 1 < len(p) else 0.0
    return 1 / (1 + math.exp(-(odds(float(inside[last])) + below) / 2))


# --- all spans


def added_spans(text: str, base: list[tuple[str, int, int]], selector: Selector) -> list[tuple[str, int, int]]:
    """Candidates that the trees select, best first, none over another span."""
    if selector.trees is None or not selector.thresholds:
        return []
    taken = sorted((a, b) for _, a, b in base)

    def free(a: int, b: int) -> bool:
        i = bisect.bisect_left(taken, (a, a))
        return not (i < len(taken) and taken[i][0] < b) and not (i and any(e > a for _, e in taken[max(0, i - 4) : i]))

    open_ = [c for c in candidates(text) if c[0] in selector.thresholds and free(c[1], c[2])]
    if not open_:
        return []
    p = selector.probability(np.array([features(text, *c) for c in open_]))
    out = []
    for i in np.argsort(-p, kind="stable").tolist():
        kind, a, b = open_[i]
        if p[i] >= selector.thresholds[kind] and free(a, b):
            out.append(open_[i])
            bisect.insort(taken, (a, b))
    return out


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def find(docs: DataFrame, selector: Selector) -> DataFrame:
    """doc_id, base counts, the digest of the base spans, all spans and their number."""
    sent = docs.sparkSession.sparkContext.broadcast(selector)  # a few thousand numbers, whatever the input's size

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for text in f["text"]:
                base = base_spans(text) if text else []
                more = added_spans(text, base, sent.value) if text else []
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(ordered(base + more)), len(base) + len(more)))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in FOUND.split(", ")])
            out.insert(0, "doc_id", f["doc_id"].astype("Int64").to_numpy())
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(releasing(run), f"doc_id long, {FOUND}")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind; spans that overlap become one, named by the first."""
    out, at = [], 0
    for kind, a, b in ordered(spans):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, selector: Selector) -> DataFrame:
    """docs with the spans replaced in text; all other columns stay. Null stays null."""
    sent = docs.sparkSession.sparkContext.broadcast(selector)

    @F.pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        def one(t):
            if not t:
                return t
            base = base_spans(t)
            return redacted(t, base + added_spans(t, base, sent.value))

        out = text.map(one)
        release()
        return out

    return docs.withColumn("text", clean("text"))
