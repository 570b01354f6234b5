"""Personal data by candidate gradient boosting.

Generators with high recall propose overlapping spans; small boosted trees score each from its format and its
context; a threshold, calibrated on held-out candidates, selects. Spans that the exact base rules find
(e-mail, IP address, payment card, international phone number) always stay, and a proposed span never
replaces one. The trees are fitted here: lines of at most SAMPLE_DOCS documents of the table at hand, those
with the smallest hashes, serve as surroundings into which labelled examples and look-alikes are written.
Detection itself covers every text in full.

Edge cases: a null text is empty and has no spans. Repeated rows, and rows of one doc_id or none, are judged each
by its own text. Very long texts and runs of digits take time in proportion to their length (no pattern rescans
a run). Proposals of equal chance go by start, length and kind. An empty table fits the trees without
surroundings and gives an empty result. Extra columns are ignored by `detect` and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order that breaks ties between spans of one start.
KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn")
SAMPLE_DOCS = 200
PRECISION = 0.98
ROUNDS = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(d * 2 - 9 * (d > 4) for d in values[1::2])) % 10 == 0


def _octet(digits: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    value = digits.lstrip("0")
    return len(value) <= 3 and int(value or "0") <= 255


def _emails(text: str) -> Iterator[Span]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield "email", start, last
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """The spans of the exact rules, by start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *m.span()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


#: Generators beyond the base rules: each names the kind that it proposes.
_PROPOSALS = (
    ("secret", re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{16,}+")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+")),
    ("ssn", re.compile(r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("phone", re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")),
    ("email", re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,64}+(?:\x20?[(\[]dot[)\]]\x20?|\.)[A-Za-z]{2,}+")),
)


def proposals(text: str) -> list[Span]:
    """Candidate spans of all generators, which may overlap."""
    digits, found = bool(_DIGIT.search(text)), []
    for kind, pattern in _PROPOSALS:
        if digits if kind != "email" else "at)" in text or "at]" in text:
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return found


#: Words near a span that speak for or against personal data; fixed values.
_FOR = re.compile(r"(?i)token|secret|password|passwd|api.?key|bearer|credential|ssn|social security|iban|account|tel|phone|call|mobile|fax|mail|contact")
_AGAINST = re.compile(r"(?i)commit|sha|md5|hash|checksum|digest|version|build|part|order|invoice|isbn|uuid|model|serial|page|ref|item")
_NEAR = 24


def features(text: str, span: Span) -> list[float]:
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - _NEAR) : start], text[end : end + 8]
    n, digits = len(body), sum(c.isdigit() for c in body)
    counts = [body.count(c) for c in set(body)]
    compact = body.replace(" ", "")
    iban = kind == "iban" and compact.isalnum() and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1
    return [
        KINDS.index(kind), n, digits / n, sum(c.isupper() for c in body) / n, sum(not c.isalnum() for c in body) / n,
        -sum(c / n * math.log2(c / n) for c in counts), sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:], strict=False)) / n,
        bool(_FOR.search(before)), bool(_AGAINST.search(before)), before[-1:] in ("'", '"'), "=" in before[-4:] or ":" in before[-4:],
        iban, after[:1] in ("'", '"'), body.startswith(("sk", "pk", "gh", "AK")),
    ]


@dataclass(frozen=True)
class Trees:
    """Boosted trees of depth two over binned features, with calibrated scores."""

    start: float
    trees: tuple
    knots: np.ndarray
    levels: np.ndarray
    threshold: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for (f, cut), halves in self.trees:
            right = x[:, f] > cut
            for side, (g, low, a, b) in enumerate(halves):
                rows = right == bool(side)
                total[rows] += np.where(x[rows, g] > low, b, a)
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.margin(x), self.knots, self.levels)


def _split(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[int, float, float, float]:
    """The best cut of one feature, and the steps of its two sides."""
    best, found = -1.0, (0, math.inf, 0.0, 0.0)
    for f in range(x.shape[1]):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 19), method="lower")):
            right = x[:, f] > cut
            sums = [(gradient[s].sum(), hessian[s].sum() + 1.0) for s in (~right, right)]
            if (gain := sum(g * g / h for g, h in sums)) > best + 1e-9:
                best, found = gain, (f, float(cut), *(float(g / h) for g, h in sums))
    return found


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = 0.3, precision: float = PRECISION) -> Trees:
    """Fits on even rows; calibrates (isotonic steps) and sets the threshold on odd rows."""
    bx, by, hx, hy = x[::2], y[::2], x[1::2], y[1::2]
    start, trees = math.log((by.sum() + 1) / (len(by) - by.sum() + 1)), []
    margin = np.full(len(bx), start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = by - p, p * (1 - p)
        f, cut, *_ = _split(bx, gradient, hessian)
        halves = []
        for side in (bx[:, f] <= cut, bx[:, f] > cut):
            g, low, a, b = _split(bx[side], gradient[side], hessian[side]) if side.any() else (0, math.inf, 0.0, 0.0)
            halves.append((g, low, rate * a, rate * b))
            margin[side] += np.where(bx[side][:, g] > low, rate * b, rate * a)
        trees.append(((f, cut), tuple(halves)))
    model = Trees(start, tuple(trees), np.zeros(1), np.zeros(1), 0.0)
    scores = model.margin(hx)
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, last score
    for s, v in zip(scores[order], hy[order], strict=True):
        blocks.append([float(v), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, s2 = blocks.pop()
            v1, w1, _ = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, s2]
    knots, levels = np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])
    calibrated = np.interp(scores, knots, levels)
    good = [t for t in np.unique(calibrated) if hy[calibrated >= t].mean() >= precision]
    return Trees(start, tuple(trees), knots, levels, float(max(min(good, default=1.0), 0.5)))


def examples(surroundings: list[str], n: int = 1200, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Labelled candidates: personal data and look-alikes, written into the given lines."""
    rng = random.Random(seed)
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexes, mixed, figures = "0123456789abcdef", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", "0123456789"

    def iban(valid: bool) -> str:
        body = some(figures, 18)
        check = 98 - int(body + "131400") % 97
        return f"DE{(check if valid else (check + rng.randrange(2, 90)) % 97 + 1):02d}{body}"

    local = lambda: f"{rng.choice(('({})', '{}')).format(some('23456789', 3))}{rng.choice(' -.')}{some(figures, 3)}-{some(figures, 4)}"
    true = [
        lambda: f'{rng.choice(("token", "secret", "api_key", "password"))} {rng.choice("=:")} "{some(hexes, rng.choice((32, 40, 64)))}"',
        lambda: f"{rng.choice(('Bearer', 'api key', 'token ='))} {some(mixed, rng.randrange(24, 48))}",
        lambda: f"secret: sk_live_{some(mixed, 24)}",
        lambda: f"{rng.choice(('IBAN', 'account', ''))} {iban(True)}",
        lambda: f"{rng.choice(('SSN', 'social security'))} {some(figures, 3)}-{some(figures, 2)}-{some(figures, 4)}",
        lambda: f"{rng.choice(('call', 'tel', 'phone', 'fax', 'mobile'))}: {local()}",
        lambda: f"{rng.choice(('mail', 'contact'))} {some(mixed[:20], 6)} (at) {some(mixed[:20], 8)} (dot) org",
    ]
    false = [
        lambda: f"{rng.choice(('commit', 'sha', 'checksum', 'md5', 'digest'))} {rng.choice(('', '= ', ': '))}{some(hexes, rng.choice((32, 40, 64)))}",
        lambda: some(mixed[:23], rng.randrange(14, 30)) + some(figures, rng.randrange(1, 3)),
        lambda: some(figures, rng.randrange(16, 22)),
        lambda: f"uuid {some(hexes, 8)}-{some(hexes, 4)}-4{some(hexes, 3)}-a{some(hexes, 3)}-{some(hexes, 12)}",
        lambda: f"{rng.choice(('model', 'ref', 'item'))} {iban(False)}",
        lambda: f"{rng.choice(('part', 'item', 'order', 'ref', 'in'))} {some(figures, 3)}-{some(figures, 2)}-{some(figures, 4)}",
        lambda: f"{rng.choice(('order', 'invoice', 'serial', 'page', 'about'))} {local()}",
        lambda: f"{some(mixed[:20], 5)}-{some(mixed[:20], 6)}-{some(mixed[:20], 6)}-{some(figures, 2)}",
    ]
    rows, labels = [], []
    while len(rows) < n:
        label = rng.random() < 0.5
        line = rng.choice(surroundings) if surroundings else ""
        at = rng.randrange(len(line) + 1)
        at = line.rfind(" ", 0, at) + 1
        made = rng.choice(true if label else false)()
        text = f"{line[:at]}{made} {line[at:]}"
        for span in proposals(text):
            if at <= span[1] and span[2] <= at + len(made) + 1:
                rows.append(features(text, span))
                labels.append(float(label))
    return np.array(rows, dtype=float), np.array(labels)


def train(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Trees:
    """Fits the trees; at most `sample` documents, those with the smallest hashes, lend one line each of up to 400 characters."""
    line = F.regexp_extract("text", r"[^\n]{1,400}", 0).alias("line")
    chosen = docs.select(F.xxhash64("doc_id", F.lit("pii")).alias("h"), "doc_id", line).where("line != ''").orderBy("h", "doc_id", "line").limit(sample)
    return fit(*examples([r["line"] for r in chosen.collect()]))


def spans(text: str | None, model: Trees) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans: base ones and accepted proposals that overlap none of them or each other."""
    text = text or ""
    base = base_spans(text)
    offered = proposals(text)
    if not offered:
        return base, base
    chance = model.probability(np.array([features(text, s) for s in offered], dtype=float))
    added: list[Span] = []
    best = sorted((i for i in range(len(offered)) if chance[i] >= model.threshold), key=lambda i: (-chance[i], offered[i][1], -offered[i][2], _order(offered[i])))
    used = np.zeros(len(text) + 1, dtype=bool)
    for _, s, e in base:
        used[s:e] = True
    for i in best:
        _, s, e = offered[i]
        if not used[s:e].any():
            used[s:e] = True
            added.append(offered[i])
    return base, sorted(base + added, key=_order)


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


DETECTED = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def detect(docs: DataFrame, model: Trees) -> DataFrame:
    """Counts of base spans, the digest of their list, and the list of all spans (kind:start:end, code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = spans(text.as_py(), model)
                counts = [sum(k == kind for k, _, _ in base) for kind in KINDS[:4]]
                rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[c.split()[0] for c in DETECTED.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, DETECTED)


def redacted(text: str, found: list[Span]) -> str:
    """The text with every span, overlapping ones as one, replaced by its kind in brackets."""
    parts, last = [], 0
    for kind, start, end in found:
        if start >= last:
            parts += [text[last:start], f"[{kind.upper()}]"]
        last = max(last, end)
    return "".join([*parts, text[last:]])


def redact(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data in column `text` replaced; null stays null."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if (t := v.as_py()) is None else redacted(t, spans(t, model)[1]) for v in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.column(at).type))

    return docs.mapInArrow(run, docs.schema)
