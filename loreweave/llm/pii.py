"""Personal data: high-recall generators propose spans, boosted trees score them, calibrated thresholds select.

Spans that meet the strict patterns (base spans) always stay. Wider generators propose further spans of the same
kinds, overlapping as they may; gradient-boosted trees score each from its format and its context, and those at or
above their kind's threshold are added, best score first, where they overlap no span or extend one of their kind. Beside the four
kinds of the strict patterns there are secrets (tokens, keys, passwords), which only the method finds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import slices

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4  # kinds that have a strict pattern

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Possessive and fenced by (?<![0-9]): a run of digits that fails from its start fails from everywhere in it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_WIDE = {
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}\s?(?:@|\(at\)|\[at\])\s?[\w-]{1,63}(?:(?:\.|\s?(?:\(dot\)|\[dot\])\s?)[\w-]{1,63}){1,6}"),
    "ip": re.compile(r"(?<![\w.:])(?:[0-9a-fA-F]{1,4}:){3,7}[0-9a-fA-F]{1,4}(?![\w:])|(?<![\w.])\d{1,3}(?:\[?\.\]?\d{1,3}){3}(?![\w.])"),
    "card": re.compile(r"(?<![\w.])\d{4}(?:[ .-]?\d{2,6}){2,4}(?![\w])"),
    "phone": re.compile(r"(?<![\w.])(?:\(\d{2,4}\)|\d{2,5})(?:[ ./-]\d{2,5}){1,4}(?![\w])"),
    "secret": re.compile(r"(?<![\w+/-])[A-Za-z0-9+/_-]{12,128}={0,2}(?![\w+/=-])"),
}
_DIGIT = re.compile(r"[0-9]")
_HINTS = {
    "email": ("mail", "e-mail", "email", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "addr", "from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "telefon", "téléphone", "móvil"),
    "secret": ("token", "secret", "password", "passwd", "api_key", "apikey", "api key", "access key", "auth", "bearer"),
}
#: What stands before numbers that name things, not persons.
_NAMES = ("no.", "nr.", "number", "order", "ref", "version", "serial", "isbn", "issn", "doi", "total", "part", "item", "sku", "invoice", "page", "commit", "sha", "md5", "hash", "build", "checksum", "#", "$", "€", "£")


#: What issuers put before their keys: two to six letters and a mark, or four capitals.
_ISSUED = re.compile(r"(?:[A-Za-z]{2,6}[_-]|[A-Z]{4}(?=[A-Z0-9]))[A-Za-z0-9_-]{12,}$")
_RUNS = re.compile(r"[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost non-overlapping matches of each kind, failing ones dropped."""
    out: list[tuple[int, int, int]] = []
    at, cursor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > cursor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((0, start, found.end()))
            cursor = found.end()
        at = text.find("@", max(at + 1, cursor))
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


def candidates(text: str) -> list[tuple[int, int, int]]:
    """Proposals of the wide generators; kinds may overlap."""
    out = []
    if not _DIGIT.search(text) and not ("@" in text or "(at)" in text or "[at]" in text):
        return out
    for k, kind in enumerate(KINDS):
        if kind == "email" and not ("@" in text or "(at)" in text or "[at]" in text):
            continue
        if kind == "secret":  # a word of letters alone is none
            out += [(k, *m.span()) for m in _WIDE[kind].finditer(text) if _DIGIT.search(m.group())]
        else:
            out += [(k, *m.span()) for m in _WIDE[kind].finditer(text)]
    return out


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    span = text[start:end]
    lead = text[max(0, start - 16) : start].lower()
    n_alpha, n_hex, n_upper = (sum(map(f, span)) for f in (str.isalpha, "abcdefABCDEF".__contains__, str.isupper))
    digits = [c for c in span if c.isdigit()]
    before, after = text[max(0, start - 24) : start], text[end : end + 2]
    plain = "".join(c for c in digits if "0" <= c <= "9")
    groups, runs = re.findall(r"\d+", span), _RUNS.findall(span)
    return [
        float(kind), float(len(span)), float(len(digits)), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(len(set(digits))), float(span.count(".")), float(span.count("-")), float(span.count(" ")), float("@" in span), float("(" in span), float(":" in span),
        float(bool(plain) and luhn(plain)), float(max((int(g[:9]) for g in groups), default=0) <= 255), float(any(c.isalpha() for c in span)),
        float(any(h in before.lower() for h in _HINTS[KINDS[kind]])), float(before[-1:].isalnum()), float(before[-1:] in "$€£#v/="), float(after[:1] in "%/:"),
        float(plain[:1] in "3456"), float(len(groups[0]) if groups else 0), float(int(groups[0][:4] or 0) if groups else 0),
        float(any(x in lead for x in _NAMES)), float(n_alpha), float(n_hex), float(n_upper), float(len(set(span))), float(before[-1:] in "\"'"), float("=" in lead or ":" in lead),
        float(all(int(g[:9]) <= 255 for g in groups)), float(len({len(g) for g in groups})), float(any(len(g) == 4 and g[:2] in ("19", "20") for g in groups)),
        float(bool(_ISSUED.match(span))), len(runs) / max(1, len(span)), float(max(map(len, runs), default=0)), float(sum(c in "aeiouAEIOU" for c in span)) / max(1, n_alpha), float(span.count("/") + span.count("_")),
    ]


class BoostedTrees:
    """Gradient boosting of depth-2 trees on the logistic loss, with splits at quantiles."""

    def __init__(self, rounds: int = 60, rate: float = 0.2):
        self.rounds, self.rate, self.trees, self.bias = rounds, rate, [], 0.0

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        best = (-1.0, 0, np.inf)
        for f in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 16))):
                left = x[:, f] <= cut
                gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1)
                if gain > best[0]:
                    best = (gain, f, float(cut))
        return best[1], best[2]

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.bias = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        score = np.full(len(y), self.bias)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            f, cut = self._split(x, g, h)
            sides = []
            for side in (x[:, f] <= cut, x[:, f] > cut):
                f2, cut2 = self._split(x[side], g[side], h[side]) if side.sum() > 8 else (0, np.inf)
                leaf = [float(self.rate * g[m].sum() / (h[m].sum() + 1)) for m in (side & (x[:, f2] <= cut2), side & (x[:, f2] > cut2))]
                sides.append((f2, cut2, *leaf))
            self.trees.append((f, cut, *sides))
            score = self.raw(x)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for f, cut, *sides in self.trees:
            for side, (f2, cut2, low, high) in zip((x[:, f] <= cut, x[:, f] > cut), sides):
                out += side * np.where(x[:, f2] <= cut2, low, high)
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def labelled_candidates(rows: int = 6000, seed: int = 5) -> list[tuple[str, int, int, int, int, bool]]:
    """A bounded labelled sample, (text, kind, start, end, personal, held out): every proposal of the wide generators in sentences that
    hold one form each, personal where the proposal is that form and the form is personal data. Forms not personal are dates, versions,
    amounts, measures, times, numbers of orders, books and pages, checksums of files, paths, and long identifiers, set or not. A choice: a
    card or account number counts with a wrong check digit too, as when mistyped, unless a word before says that it numbers a thing; so a
    number of 16 digits in running prose is redacted whatever it is. Forms and leads of the held-out half differ from those that the trees
    are fitted on, secrets of other issuers among them."""
    rng = np.random.default_rng(seed)
    num = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    hexed = lambda n: "".join(pick(*"0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(pick(*"abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n - 2)) + num(2)
    upper = lambda n: num(1) + "".join(pick(*"ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(n - 2)) + num(1)
    octets = lambda: [str(int(x)) for x in rng.integers(0, 256, 4)]
    name = lambda: "".join(pick(*"abcdeéfgiklmnoörst") for _ in range(int(rng.integers(3, 9))))
    spaced = lambda s, mark: mark.join(s[i : i + 4] for i in range(0, len(s), 4))

    def card() -> str:
        body = pick("4", "51", "55", "6011", "35")
        body += num(15 - len(body))
        return next(body + str(d) for d in range(10) if luhn(body + str(d)))

    hints = [(*_HINTS[k][: len(_HINTS[k]) // 2], *_HINTS[k][len(_HINTS[k]) // 2 :]) for k in KINDS]
    own = lambda k, held: pick(*hints[k][len(hints[k]) // 2 :]) if held else pick(*hints[k][: len(hints[k]) // 2])
    things = lambda held: pick("serial", "part", "invoice", "sku", "checksum", "isbn") if held else pick("no.", "order", "version", "ref", "commit", "total", "#", "$")
    year = lambda: f"{pick('19', '20')}{num(2)}"
    # (kind, personal, held out: True, False or None for both, what stands before: hint, thing or prose, form)
    make = [
        (0, 1, None, "any", lambda: f"{name()}.{num(2)}@{name()}.{pick('com', 'org', 'net')}"), (0, 1, False, "any", lambda: f"{name()} (at) {name()} (dot) {pick('com', 'org')}"),
        (0, 1, True, "any", lambda: f"{name()}[at]{name()}.{pick('com', 'fr', 'de')}"), (0, 1, True, "any", lambda: f"{name()}_{num(1)} @ {name()}.{pick('it', 'net')}"),
        (0, 0, False, "prose", lambda: f"{num(1)} @ {num(1)}.{num(2)}"), (0, 0, True, "prose", lambda: f"{num(2)}@{num(2)}.{num(1)}.{num(1)}"),
        (1, 1, None, "any", lambda: ":".join(hexed(4) for _ in range(8))), (1, 1, False, "any", lambda: "[.]".join(octets())), (1, 1, True, "any", lambda: "[.".join(octets()[:2]) + "." + ".".join(octets()[:2])),
        (1, 0, None, "prose", lambda: f"{num(2)}:{num(2)}:{num(2)}:{num(2)}"), (1, 0, False, "thing", lambda: ".".join(str(int(x)) for x in rng.integers(256, 999, 4))),
        (1, 0, True, "thing", lambda: f"{num(3)}.{num(3)}.{num(3)}.{num(3)}"),
        (2, 1, False, "any", lambda: spaced(card(), ".")), (2, 1, True, "any", lambda: f"{card()[:4]} {num(6)} {num(5)}"), (2, 1, None, "any", lambda: pick("4", "5", "3", "6") + num(15)), (2, 1, None, "prose", lambda: num(16)),
        (2, 0, None, "thing", lambda: num(16)), (2, 0, False, "any", lambda: num(12)), (2, 0, True, "any", lambda: num(13)), (2, 0, False, "prose", lambda: spaced(num(12), "-")), (2, 0, True, "prose", lambda: f"{num(4)} {num(4)} {num(2)}"),
        (2, 0, None, "prose", lambda: f"{year()}-{num(2)}-{num(2)}"), (2, 0, True, "prose", lambda: f"{year()}{num(4)}{num(6)}"), (2, 0, True, "thing", lambda: f"978{num(10)}"),
        (3, 1, False, "any", lambda: f"({num(3)}) {num(3)}-{num(4)}"), (3, 1, True, "any", lambda: f"({num(3)}){pick(' ', '.')}{num(3)}.{num(4)}"), (3, 1, None, "any", lambda: f"{num(3)}-{num(3)}-{num(4)}"),
        (3, 1, False, "any", lambda: f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}"), (3, 1, False, "any", lambda: f"0{num(3)} {num(3)}-{num(4)}"), (3, 1, False, "any", lambda: f"0{num(3)}/{num(6)}"), (3, 1, True, "any", lambda: f"0{num(2)}-{num(3)} {num(4)}"), (3, 1, True, "any", lambda: f"0{num(3)}-{num(3)} {num(4)}"), (3, 0, None, "prose", lambda: f"{year()}-{num(2)}-{num(2)}"),
        (3, 0, False, "prose", lambda: f"{num(2)}/{num(2)}/{year()}"), (3, 0, True, "prose", lambda: f"{num(2)}.{num(2)}.{year()}"), (3, 0, False, "any", lambda: f"{num(2)} {num(3)}"), (3, 0, True, "thing", lambda: f"{num(3)} {num(3)}"),
        (3, 0, False, "prose", lambda: f"{year()}-{year()}"), (3, 0, True, "prose", lambda: f"{num(4)} {num(4)}"), (3, 0, None, "thing", lambda: f"{num(3)}.{num(2)}"), (3, 0, True, "prose", lambda: f"{num(2)} {num(3)} {num(3)}"),
        (4, 1, None, "set", lambda: hexed(int(pick(32, 40, 64)))), (4, 1, False, "set", lambda: mixed(int(rng.integers(20, 44)))), (4, 1, None, "hint", lambda: mixed(24)),
        (4, 1, False, "any", lambda: pick("ghp_", "sk-", "pk_") + mixed(int(rng.integers(24, 40)))), (4, 1, False, "any", lambda: "AKIA" + upper(16)), (4, 1, True, "any", lambda: pick("glpat-", "xoxb-", "hf_") + mixed(int(rng.integers(20, 36)))), (4, 1, True, "any", lambda: "ASIA" + upper(16)),
        (4, 1, False, "set", lambda: f"{name()}{num(1)}{name()}{num(3)}{name()[:1]}{num(2)}"), (4, 1, True, "set", lambda: f"{name()}{num(2)}{name().title()}{num(3)}x"), (4, 0, False, "plain", lambda: f"{name()}_{name()}_{num(4)}"), (4, 0, True, "plain", lambda: f"{name()}-{num(4)}-{name()}{num(2)}"),
        (4, 0, None, "prose", lambda: "/".join([*(name() for _ in range(int(rng.integers(2, 5)))), f"{name().title()}{num(1)}{name().title()}", name()])),
        (4, 0, False, "prose", lambda: f"{name()}/{name()}/{name().title()}{num(1)}{name().title()}"), (4, 0, True, "prose", lambda: f"{name()}_{name()}{num(2)}/{name()}-{num(3)}"), (4, 0, True, "prose", lambda: f"{name()}{name()}{num(4)}{name()}"), (4, 0, False, "prose", lambda: f"{name()}{name()}{name()}{num(4)}"),
        (4, 0, None, "thing", lambda: hexed(int(pick(32, 40, 64)))), (4, 0, False, "prose", lambda: f"{name()}-{name()}-{num(3)}x"), (4, 0, True, "prose", lambda: f"{name()}/{name()}/{num(4)}"), (4, 0, None, "prose", lambda: num(pick(12, 13, 14, 17, 18, 20))),
        (4, 0, True, "prose", lambda: f"{hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}"), (4, 0, False, "prose", lambda: f"IMG_{num(8)}_{num(6)}"),
    ]
    out: list[tuple[str, int, int, int, int, bool]] = []
    for i in range(rows):
        held = bool(i % 2)
        forms = [m for m in make if m[2] is None or m[2] == held]
        kind, label, _, lead, form = forms[(i // 2) % len(forms)]
        span = form()
        lead = pick("hint", "prose", "prose") if lead == "any" else lead
        first = {"hint": lambda: f"{own(kind, held)}{pick('', ':', ' is')} ", "thing": lambda: f"{things(held)} ", "prose": lambda: f"{name()}{pick('', ',')} ", "plain": lambda: f"{name()}{pick('=', ' = ', ': ')}", "set": lambda: f"{own(kind, held)}{pick(' = ', '=', ': ')}{pick(chr(34), '', chr(39))}"}[lead]()
        text = " ".join(name() for _ in range(int(rng.integers(1, 6)))) + " " + first
        start = len(text)
        text += span + pick(" ", ". ", ", ", '" ', "!! ") + " ".join(name() for _ in range(3))
        out += [(text, k, s, e, int(label and (k, s, e) == (kind, start, start + len(span))), held) for k, s, e in candidates(text)]
    return out


@lru_cache(maxsize=1)
def trained(precision: float = 0.97) -> tuple[BoostedTrees, tuple[float, ...]]:
    """The trees and, for each kind, the least threshold that keeps this precision on the held-out half."""
    model, limits, _ = _fitted(precision)
    return model, limits


def _fitted(precision: float) -> tuple[BoostedTrees, tuple[float, ...], list[tuple[str, float, float, float]]]:
    """Besides, for each kind: (kind, threshold, precision, recall) on the held-out half."""
    rows = labelled_candidates()
    x = np.array([features(*r[:4]) for r in rows])
    y, held = np.array([r[4] for r in rows], float), np.array([r[5] for r in rows])
    model = BoostedTrees().fit(x[~held], y[~held])
    p, y, kinds = model.predict(x[held]), y[held], x[held][:, 0]
    limits, report = [], []
    for k, kind in enumerate(KINDS):
        score, label = p[kinds == k], y[kinds == k]
        order = np.argsort(-score, kind="stable")
        right = np.cumsum(label[order]) / np.arange(1, len(order) + 1)
        fine = np.flatnonzero((right >= precision) & np.append(score[order][1:] != score[order][:-1], True)) if len(order) else order
        limits.append(max(0.5, float(score[order][fine[-1]])) if len(fine) else 1.01)
        kept = score >= limits[-1]
        report.append((kind, limits[-1], float(label[kept].mean()) if kept.any() else float("nan"), float(label[kept].sum() / max(1.0, label.sum()))))
    return model, tuple(limits), report


def find(text: str | None, model: BoostedTrees, limits: tuple[float, ...]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), both by kind, then start."""
    if not text:
        return [], []
    base = base_spans(text)
    held = set(base)
    proposed = [c for c in candidates(text) if c not in held]
    if not proposed:
        return base, base
    score = model.predict(np.array([features(text, *c) for c in proposed]))
    fine = [(s, c) for s, c in zip(score.tolist(), proposed) if s >= limits[c[0]]]
    if not fine:
        return base, base
    # Which span of each kind holds a character, by its place in spans, from 1.
    owner = np.zeros((len(KINDS), len(text)), np.int32)
    spans = list(base)
    for i, (kind, start, end) in enumerate(spans):
        owner[kind, start:end] = i + 1
    for _, (kind, start, end) in sorted(fine, key=lambda x: (-x[0], x[1])):
        others = np.delete(owner[:, start:end], kind, 0)
        first, last = owner[kind, start], owner[kind, end - 1]
        if others.any() or (first and spans[first - 1][1] < start) or (last and spans[last - 1][2] > end):
            continue
        spans.append((kind, start, end))
        owner[kind, start:end] = len(spans)
    return base, sorted(spans)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redact(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first in the text is named."""
    if text is None:
        return None
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], x[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = False) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_secret) of every document, and text_redacted on demand.

    n_spans counts all spans, n_secret the secrets among them. The other counts and base_sha256 are of the base spans; spans lists all of them, kind:start:end in code points, by kind, then
    start. Null and empty texts have none (the hash of the empty string; a null text stays null when redacted).
    Repeated rows and null ids keep their rows; equal scores go by kind and place; an empty table gives no rows;
    other columns are ignored. The trees are fitted on labelled_candidates(), a bounded sample.
    """
    sent = documents.sparkSession.sparkContext.broadcast(trained())
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, limits = sent.value
        for batch in slices(batches, 1, 4 << 20):
            texts = batch.column(1).to_pylist()
            found = [find(t, model, limits) for t in texts]
            counts = [[sum(k == j for k, _, _ in base) for base, _ in found] for j in range(BASE)]
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts)]
            columns.append(pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string()))
            columns.append(pa.array([_joined(spans) for _, spans in found], pa.string()))
            columns.append(pa.array([len(spans) for _, spans in found], pa.int64()))
            columns.append(pa.array([sum(k == BASE for k, _, _ in spans) for _, spans in found], pa.int64()))
            names = ["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans", "n_spans", "n_secret"]
            if redacted:
                columns.append(pa.array([redact(t, spans) for t, (_, spans) in zip(texts, found)], pa.string()))
                names.append("text_redacted")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_secret long"
    return docs.mapInArrow(run, schema + (", text_redacted string" if redacted else ""))
