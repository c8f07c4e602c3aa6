"""Personal data by candidates and boosted trees.

Base rules find mail addresses, IP addresses, card and phone numbers whose form is beyond doubt. Beside them, generators
with high recall propose spans that may overlap: addresses spelt out, phone numbers without a country, card numbers with
a slip of the pen, bank accounts, national ids, keys and passwords. Boosted trees score each candidate by its format and
by the words before it, a curve fitted on held-out examples turns scores into probabilities, and for each kind the least
threshold that held-out examples show to be precise selects. Base spans stay in any case; of added spans that overlap
the likeliest stays, and none overlaps a base span.

Nobody has labelled the corpus, so examples are planted: format templates of each kind and decoys of similar shape
(dates, versions, order numbers, prices, digests) are put into GROUND characters of at most SAMPLE documents each, at
random places, some behind a cue and some not. Their words, drawn from the corpus, are the background. Scores cover
every candidate of every text.

Cases: null and empty texts have no spans; candidates of more than LONGEST characters are left to the base rules;
repeated rows give repeated results; a null doc_id stays null; an empty table gives an empty result; with no text to
plant in, examples stand alone; texts of any length are read whole, in time linear in their length; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.common import bounded_sample, small_parts

KINDS = ("email", "ip", "card", "phone", "account", "national_id", "secret")
BASE = KINDS[:4]
SAMPLE, GROUND, PLANTED, LONGEST, BEFORE = 400, 2000, 12_000, 80, 32
TREES, DEPTH, RATE, BINS, LEAST_GAIN = 60, 4, 0.2, 32, 1e-3
#: Share of right ones that a threshold must show on held-out examples.
PRECISION = 0.97

Span = tuple[int, int, int]  # start, end, place of the kind in KINDS

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: A match within a run of digits would need the run's own begin to match, so only that is tried.
IP = re.compile(r"[0-9](?<![0-9].)[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")

#: High recall, bounded length; which of these are personal is for the trees to say. The look behind comes after the
#: first character, by which the places to try are found.
GENERATORS = [
    (KINDS.index(kind), re.compile(pattern))
    for kind, pattern in [
        ("ip", r"[0-9A-Fa-f](?<![0-9A-Za-z:].)[0-9A-Fa-f]{0,3}+:(?:[0-9A-Fa-f]{1,4}+:){3,6}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])"),
        ("card", r"[0-9](?<![0-9A-Za-z].)[0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{3,7}(?![0-9A-Za-z])"),
        ("phone", r"[0-9(](?<![0-9A-Za-z(].)(?:(?<=\()[0-9]{2,5}\)|(?<=[0-9])[0-9]{1,4})(?:[ ./-]{1,2}[0-9]{2,5}){1,4}(?![0-9A-Za-z])"),
        ("phone", r"[0-9](?<![0-9A-Za-z].)[0-9]{6,12}(?![0-9A-Za-z])"),
        ("account", r"[A-Z](?<![0-9A-Za-z].)[A-Z][0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
        ("national_id", r"[0-9](?<![0-9A-Za-z].)[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z])"),
        ("secret", r"[A-Za-z0-9+/_-](?<![0-9A-Za-z+/_-].)[A-Za-z0-9+/_-]{15,79}+(?![0-9A-Za-z+/_-])"),
    ]
]
#: An address spelt out: what stands for @, and the domain. The local part is looked for before it.
SPELT = re.compile(r"(?: ?[(\[]at[)\]] ?| at )[A-Za-z0-9-]{1,40}+(?:(?:\.| ?[(\[]dot[)\]] ?| dot )[A-Za-z0-9-]{2,20}+){1,4}")

#: Words of the context that speak for a kind, and words that speak for none of them.
CUES = [
    r"mail|contact|write|address|schreib|correo|courriel",
    r"\bip\b|host|server|client|login|network",
    r"card|visa|master|credit|karte|tarjeta|carte|amex",
    r"phone|\btel|call|mobile|\bfax|dial|whatsapp|telefon",
    r"iban|bank|account|konto|cuenta|compte|swift",
    r"ssn|social|national|passport|tax id|identity",
    r"token|secret|passw|pwd|api.?key|\bkey|auth|bearer",
    r"version|\bv\.?$|release|build|isbn|order|invoice|ticket|\bno\.|page|total|price|sha|md5|commit|hash|section|chapter|eur|usd",
]
CUE = [re.compile(c) for c in CUES]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the base rules, in order of start, then kind."""
    spans: list[Span] = []
    end = at_before = 0
    for m in AT_DOMAIN.finditer(text) if "@" in text else ():
        at = m.start()
        low = max(end, text.rfind("@", at_before, at) + 1)
        start = low + len(text[low:at].rstrip(LOCAL))
        at_before = at
        if start < at:
            spans.append((start, m.end(), 0))
            end = m.end()
    for m in IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            spans.append((m.start(), m.end(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            spans.append((m.start(), m.end(), 2))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
            spans.append((m.start(), m.end(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2]))


def candidates(text: str) -> list[Span]:
    """What the generators propose."""
    found = []
    for m in SPELT.finditer(text) if any(at in text for at in (" at ", "(at)", "[at]")) else ():
        local = text[max(0, m.start() - 40) : m.start()]
        if before := len(local) - len(local.rstrip(LOCAL)):
            found.append((m.start() - before, m.end(), 0))
    found += [(m.start(), m.end(), kind) for kind, pattern in GENERATORS for m in pattern.finditer(text)]
    return [f for f in found if f[1] - f[0] <= LONGEST]


def _iban(span: str) -> bool:
    s = span.replace(" ", "")
    return len(s) > 4 and s.isalnum() and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def features(text: str, span: Span) -> list[int]:
    """Format and context of a candidate, as small whole numbers."""
    start, end, kind = span
    s = text[start:end]
    digits = NOT_DIGIT.sub("", s)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    letters = sum(c.isalpha() for c in s)
    before = text[max(0, start - BEFORE) : start].lower()
    ahead, behind = text[start - 1 : start], text[end : end + 1]
    # A group of digits on the other side of a blank: the candidate may be part of something longer.
    beside = [int(c.isdigit()) for c in (text[max(0, start - 2) : max(0, start - 1)], text[end + 1 : end + 2])]
    lower, upper = sum(c.islower() for c in s), sum(c.isupper() for c in s)
    return [
        *(int(kind == k) for k in range(len(KINDS))),
        len(s), len(digits), letters, len(groups), groups[0] if groups else 0, groups[-1] if groups else 0, max(groups, default=0), min(groups, default=0),
        int(len(digits) > 1 and luhn(digits)), int(kind == 4 and _iban(s)), int(bool(digits) and digits[:2] in ("19", "20")), int(digits[:1] or 10),
        len(set(s)), s.count("."), s.count("-"), s.count(" "), s.count("/"), s.count(":"), s.count("("), lower, upper,
        int(all(c in "0123456789abcdefABCDEF" for c in s)), int(lower > 0 and upper > 0 and bool(digits)), int(any(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:]))),
        *(int(bool(c.search(before))) for c in CUE), *beside,
        int(ahead in "\"'=:" and ahead != ""), int(ahead in ".,-/$€#" and ahead != ""), int(behind in "\"'" and behind != ""), int(behind in "%$€-/" and behind != ""),
    ]


class Trees(NamedTuple):
    """Boosted trees of fixed depth, as arrays: node i has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray  # tree x inner node
    above: np.ndarray
    leaf: np.ndarray  # tree x leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, above, leaf in zip(*self):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > above[node])
            total += leaf[node - inner]
        return total


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss. Each level of a tree is one histogram of gradients over node, feature and
    bin."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    n, f = x.shape
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    margin = np.zeros(n)
    out = Trees(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.iinfo(np.int64).max), np.zeros((TREES, leaves)))
    flat = binned + np.arange(f) * BINS
    for t in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            wide = 2**level
            cells = (node[:, None] * (f * BINS) + flat).ravel()
            shape = (wide, f, BINS)
            sum_g = np.bincount(cells, np.repeat(g, f), wide * f * BINS).reshape(shape).cumsum(2)
            sum_h = np.bincount(cells, np.repeat(h, f), wide * f * BINS).reshape(shape).cumsum(2)
            all_g, all_h = sum_g[..., -1:], sum_h[..., -1:]
            gain = sum_g**2 / (sum_h + 1) + (all_g - sum_g) ** 2 / (all_h - sum_h + 1) - all_g**2 / (all_h + 1)
            best = gain.reshape(wide, -1).argmax(1)
            on, at = best // BINS, best % BINS
            split = gain.reshape(wide, -1)[np.arange(wide), best] > LEAST_GAIN
            at = np.where(split, at, BINS)
            first = wide - 1
            out.feature[t, first : first + wide] = on
            for k in range(wide):
                if split[k] and at[k] < len(cuts[on[k]]):
                    out.above[t, first + k] = cuts[on[k]][at[k]]
            node = 2 * node + (binned[np.arange(n), on[node]] > at[node])
        leaf = RATE * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + 1)
        out.leaf[t] = leaf
        margin += leaf[node]
    return out


class Model(NamedTuple):
    trees: Trees
    slope: float
    offset: float
    thresholds: list[float]  # by kind

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.score(x) + self.offset)))


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve that fits best, by Newton's method on slightly drawn-in targets."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.array([1.0, 0.0])
    a = np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-(a @ w)))
        w += np.linalg.solve((a.T * (p * (1 - p))) @ a + 1e-6 * np.eye(2), a.T @ (target - p))
    return float(w[0]), float(w[1])


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """A threshold of 0.5 or more, as low as the precision asked for allows: midway between the last score taken and the
    next; beyond 1 where none has that precision."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
    ends = np.append(np.diff(p[order]) != 0, True) if len(p) else np.zeros(0, bool)
    fits = np.flatnonzero((right >= PRECISION) & ends & (p[order] >= 0.5))
    if not len(fits):
        return 2.0
    taken, left = p[order][fits[-1]], np.append(p[order], 0.0)[fits[-1] + 1]
    return max(0.5, float(taken + left) / 2)


class Planter:
    """Makes labelled examples: templates of each kind and decoys."""

    def __init__(self, seed: int = 12) -> None:
        self.rng = np.random.default_rng(seed)

    def pick(self, *options: str) -> str:
        return options[self.rng.integers(len(options))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def chars(self, alphabet: str, n: int) -> str:
        return "".join(alphabet[k] for k in self.rng.integers(0, len(alphabet), n))

    def word(self) -> str:
        return self.chars("abcdefghilmnoprstu", int(self.rng.integers(3, 9)))

    def grouped(self, sizes: list[int], between: str) -> str:
        return between.join(self.digits(n) for n in sizes)

    def account(self) -> str:
        body = self.digits(int(self.rng.integers(12, 22)))
        land = self.pick("DE", "FR", "ES", "GB", "NL", "IT")
        check = 98 - int("".join(str(int(c, 36)) for c in f"{body}{land}00")) % 97
        raw = f"{land}{check:02d}{body}"
        return raw if self.rng.random() < 0.5 else " ".join(raw[k : k + 4] for k in range(0, len(raw), 4))

    def personal(self, kind: int) -> tuple[str, str]:
        """(cue, value)"""
        r = self.rng
        if kind == 0:
            at, dot = self.pick("(at)", "[at]", " at ", " (at) "), self.pick(".", " dot ", "(dot)")
            return self.pick("mail: ", "contact ", "write to "), f"{self.word()}.{self.word()}{at}{self.word()}{dot}{self.pick('com', 'org', 'de', 'net')}"
        if kind == 1:
            return self.pick("ip ", "host ", "from client "), ":".join(self.chars("0123456789abcdef", int(r.integers(1, 5))) for _ in range(8))
        if kind == 2:
            return self.pick("card ", "visa ", "credit card: "), self.grouped([4, 4, 4, 4], self.pick("", "", " ", "-"))
        if kind == 3:
            forms = [f"({self.digits(3)}) {self.digits(3)}-{self.digits(4)}", self.grouped([3, 3, 4], self.pick("-", ".", " ")), self.grouped([4, 6], " "), f"0{self.digits(9)}", f"0{self.digits(3)}/{self.digits(7)}"]
            return self.pick("phone ", "tel. ", "call ", "mobile: "), self.pick(*forms)
        if kind == 4:
            return self.pick("iban ", "account ", "bank: "), self.account()
        if kind == 5:
            return self.pick("ssn ", "social security ", "national id "), self.grouped([3, 2, 4], "-")
        alphabet = self.pick("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
        return self.pick('token = "', "api_key=", "password: ", "secret: "), self.chars(alphabet, int(r.integers(20, 41)))

    def decoy(self) -> tuple[str, str]:
        """(cue, value): numbers and codes of other kinds in the same shapes."""
        year, month, day = int(self.rng.integers(1900, 2040)), int(self.rng.integers(1, 13)), int(self.rng.integers(1, 29))
        return [
            (self.pick("", "on ", "date "), f"{year}{self.pick('-', '/', '.')}{month:02d}{self.pick('-', '/', '.')}{day:02d}"),
            (self.pick("", "on "), f"{day:02d}{self.pick('.', '/', '-')}{month:02d}{self.pick('.', '/', '-')}{year}"),
            (self.pick("", "time "), f"{year}{month:02d}{day:02d}{self.digits(int(self.rng.integers(0, 7)))}"),
            (self.pick("order ", "invoice ", "ticket ", "no. "), self.digits(int(self.rng.integers(7, 14)))),
            (self.pick("total ", "price ", "", "eur "), ".".join([str(int(self.rng.integers(1, 999))), self.digits(3), self.digits(3)])),
            (self.pick("isbn ", "isbn: "), self.pick(f"978{self.digits(10)}", f"978-{self.digits(1)}-{self.digits(5)}-{self.digits(3)}-{self.digits(1)}")),
            (self.pick("pages ", "section ", "version ", ""), self.grouped([2, 2, 3], self.pick(".", "-", " "))),
            (self.pick("sha ", "md5 ", "commit ", "hash "), self.chars("0123456789abcdef", int(self.rng.integers(20, 41)))),
            (self.pick("total ", ""), self.grouped([3, 3, 3], " ")),
            ("", self.pick("-", "_", "/", "").join(self.word() for _ in range(5))),
            ("", self.chars("ABCDEFGHILMNOPRSTU", 20)),
            ("", f"{self.word()} at {self.word()}.{self.word()[:5]}"),
            ("", self.digits(1) * 16),
        ][self.rng.integers(13)]


def examples(backgrounds: list[str], count: int = PLANTED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, label, kind) of the candidates that planted values make; every third value is a decoy."""
    plant = Planter()
    texts = [b for b in backgrounds if b.strip()] or [""]
    x, y, kinds = [], [], []
    for k in range(count):
        real = k % 3 != 0
        kind = k % len(KINDS)
        cue, value = plant.personal(kind) if real else plant.decoy()
        # Decoys keep their cue more often: without one, some are no decoys to anybody.
        shown = cue if plant.rng.random() < (0.5 if real else 0.7) else ""
        if kind == len(KINDS) - 1 and real:
            shown = cue  # a string of characters is a secret by what is said of it
        ground = texts[plant.rng.integers(len(texts))]
        at = int(plant.rng.integers(0, len(ground) + 1))
        left, right = ground[max(0, at - 60) : at], ground[at : at + 20]
        text = f"{left} {shown}{value} {right}"
        start = len(left) + 1 + len(shown)
        for span in candidates(text):
            if span[0] < start + len(value) and span[1] > start:
                whole = span[0] == start and span[1] == start + len(value)
                x.append(features(text, span))
                y.append(int(real and whole and span[2] == kind))
                kinds.append(span[2])
    return np.array(x, np.int64), np.array(y, float), np.array(kinds)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trees from four fifths of the examples, curve and thresholds from the others."""
    text = F.col(text_col).cast("string")
    # Some place in each text, picked by its id.
    start = F.pmod(F.xxhash64(F.col(id_col)), F.greatest(F.length(text) - GROUND, F.lit(0)) + 1) + 1
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.substr(text, start.cast("int"), F.lit(GROUND)).alias("ground")).where("id is not null and ground is not null")
    grounds = sorted((r.id, r.ground) for r in bounded_sample(rows, "id", SAMPLE).collect())
    # Background must hold nothing that a rule knows.
    x, y, kinds = examples([NOT_PLAIN.sub(" ", g) for _, g in grounds])
    apart = np.arange(len(x)) % 5 == 4
    trees = fit_trees(x[~apart], y[~apart])
    slope, offset = _calibrate(trees.score(x[apart]), y[apart])
    p = Model(trees, slope, offset, []).probability(x[apart])
    of = [kinds[apart] == k for k in range(len(KINDS))]
    return Model(trees, slope, offset, [_threshold(p[m], y[apart][m]) for m in of])


#: What is cut out of texts before examples are planted in them.
NOT_PLAIN = re.compile(r"\S*[0-9@=\"]\S*")


def select(spans: list[Span], base: list[Span], chances: np.ndarray, thresholds: list[float]) -> list[Span]:
    """Base spans, and of the candidates above their thresholds the likeliest that overlap no other."""
    held = sorted((s, e) for s, e, _ in base)
    merged: list[list[int]] = []  # disjoint, in order
    for s, e in held:
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    kept = list(base)
    order = sorted((k for k in range(len(spans)) if chances[k] >= thresholds[spans[k][2]]), key=lambda k: (-round(float(chances[k]), 9), spans[k]))
    starts = [s for s, _ in merged]
    ends = [e for _, e in merged]
    for k in order:
        s, e, _ = spans[k]
        at = bisect_left(ends, s + 1)
        if at == len(starts) or starts[at] >= e:
            starts.insert(at, s)
            ends.insert(at, e)
            kept.append(spans[k])
    return sorted(kept, key=lambda s: (s[0], s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, n_added bigint, base_sha256 string, spans string"


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans) of each row of docs."""
    fitted = train(docs, id_col, text_col) if model is None else model
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in small_parts(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                bases = [base_spans(t) for t in texts]
                found = [candidates(t) for t in texts]
                x = np.array([features(t, s) for t, spans in zip(texts, found) for s in spans], np.int64)
                p = known.probability(x) if len(x) else np.zeros(0)
                at, out = 0, []
                for base, spans in zip(bases, found):
                    every = select(spans, base, p[at : at + len(spans)], known.thresholds)
                    at += len(spans)
                    counts = [sum(s[2] == k for s in base) for k in range(len(BASE))]
                    out.append((*counts, len(every) - len(base), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
                kinds = [pa.int64()] * 5 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(work, SCHEMA)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by the name of its kind."""
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])
