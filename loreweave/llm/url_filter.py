"""URL filter: host and path rules first, logistic regression on hashed character n-grams of host and path for the rest."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14

#: Words of hosts and paths, by what the labelled table calls hosts that hold them: block in any company, block only with another of these two
#: lists, allow.
BLOCK_WORDS = (
    "casino slots poker jackpot roulette betting bets bingo gamble gambling porn xxx sexy nude escort camgirls hookup dating viagra cialis pills "
    "pharmacy steroids weightloss warez keygen torrent nulled ads adserver popup popunder clicks affiliate spam spammer bulkmail giveaway forex "
    "payday loans quickcash getrich erotic sextoys lottery wager sportsbook scam phishing"
).split()
MIXED_WORDS = "track tracker winner win free cheap discount bonus prize adult singles webcam drugs replica watches fake crack serial banner redirect crypto hot best".split()
ALLOW_WORDS = (
    "news press journal times daily university school college research science physics history museum library archive books wiki docs guide "
    "manual help support forum community blog recipes garden travel weather sports sport field health clinic city council gov law court bank insurance "
    "shop market code project software data maps radio music film art theatre photo family kids church energy water transport rail airport education"
).split()
_SYLLABLES = "ba ke li mo nu ra se ti vo an er in or th st re ou es ble ly ing her and on al en de ra men tor qui lan ver sol"


def labelled_urls(rows: int = 3600, seed: int = 3) -> list[tuple[str, int, bool]]:
    """The labelled table by rule: (url, 1 = block, held out). Hosts are words of the lists, alone, together or with made-up syllables, or
    syllables only (allowed), under common subdomains and domains. A mixed word beside an allowed one, as in a name for running or for a
    library that asks no fee, misleads: such hosts are allowed. Paths have words of any list, whatever the host, and tell nothing. Held out
    are a third of the rows: half of these have pairs of words that the rest does not have, half have only words that the rest does not
    have in any host or path (a quarter of each list)."""
    rng = np.random.default_rng(seed)
    pick = lambda x: x[int(rng.integers(len(x)))]
    syllables = _SYLLABLES.split()
    made = lambda: "".join(pick(syllables) for _ in range(int(rng.integers(2, 5))))
    every = (BLOCK_WORDS, MIXED_WORDS, ALLOW_WORDS)
    known, unseen = ([[w for i, w in enumerate(x) if (i % 4 == 3) == new] for x in every] for new in (False, True))
    out: list[tuple[str, int, bool]] = []
    for i in range(rows):
        held, new = i % 3 == 0, i % 6 == 0
        bad, mixed, good = unseen if new else known
        place = {w: k for k, w in enumerate(bad + mixed + good)}
        kind, block = [("bad bad", 1), ("bad mixed", 1), ("mixed mixed", 1), ("bad good", 1), ("bad", 1), ("bad", 1), ("mixed good", 0), ("good good", 0), ("good", 0), ("mixed", 0), ("", 0), ("", 0), ("good", 0), ("", 0)][int(rng.integers(14))]
        lists = {"bad": bad, "mixed": mixed, "good": good}
        while True:
            words = [pick(lists[x]) for x in kind.split()]
            # Pairs are told apart by the sum of their places, so that none is on both sides.
            if len(words) < 2 or words[0] != words[1] and (new or (sum(place[w] for w in words) % 3 == 0) == held):
                break
        parts = words if len(words) == 2 else [*words, made()] if words and rng.random() < 0.6 else words or ([made()] if rng.random() < 0.8 else [made(), made()])
        name = pick(["-", ""]).join(parts if rng.random() < 0.5 else parts[::-1]) + (str(int(rng.integers(100))) if rng.random() < 0.15 else "")
        host = f"{pick(['', '', 'www.', 'm.', 'blog.', 'en.', 'go.'])}{name}.{pick(['example.com', 'example.org', 'example.net', 'com', 'org', 'net', 'info', 'co.uk', 'de', 'fr', 'es'])}"
        tail = pick(["", "/", ".html", "/index.html", "?page=2&ref=x", "?utm_source=feed", "#top"])
        path = pick([f"/{int(rng.integers(10000))}", f"/{pick(['en', 'de', 'fr', 'es'])}/{int(rng.integers(10000))}", f"/{made()}/{made()}", f"/{pick(bad + mixed + good)}/{int(rng.integers(100))}", f"/{made()}"])
        out.append((f"{pick(['http', 'https'])}://{host}{path}{tail}", block, held))
    return out


#: (host, path prefix, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null or no `://`: empty."""
    host = F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"(?s)\A([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(_after_scheme(F.coalesce(url, F.lit(""))), r"(?s)\A[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits: its host or a subdomain of it, and a path that starts with the rule's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda x: (len(x[0] + x[1]), x)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str) -> np.ndarray:
    """Buckets of the character 3- and 4-grams of host and path, each part marked and fenced."""
    out = set()
    for mark, part in (("h", host), ("p", path.lower())):
        part = f"^{part}$"
        for n in (3, 4):
            out.update(zlib.crc32(f"{mark}{part[i : i + n]}".encode("utf-8", "surrogatepass")) % BUCKETS for i in range(len(part) - n + 1))
    return np.fromiter(out, np.int64, len(out))


def _flat(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.array([len(f) for f in found])
    return np.concatenate(found), np.repeat(np.arange(len(found)), n), 1 / np.sqrt(np.maximum(1, n))


def scores(found: list[np.ndarray], w: np.ndarray, bias: float) -> np.ndarray:
    if not found:
        return np.zeros(0)
    flat, row, scale = _flat(found)
    return 1 / (1 + np.exp(-(bias + scale * np.bincount(row, w[flat], len(found)))))


def fit(rows: list[tuple[str, str, int]], rounds: int = 400, rate: float = 20.0, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias from (host, path, label) rows, by full gradient steps with L2."""
    found = [features(h, p) for h, p, _ in rows]
    y = np.array([label for _, _, label in rows], float)
    flat, row, scale = _flat(found)
    w, bias = np.zeros(BUCKETS), 0.0
    for _ in range(rounds):
        gap = (1 / (1 + np.exp(-(bias + scale * np.bincount(row, w[flat], len(found))))) - y) / len(y)
        w -= rate * (np.bincount(flat, (gap * scale)[row], BUCKETS) + decay * w)
        bias -= rate * gap.sum() / 4
    return w, bias


def chosen_threshold(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least score at which the held-out URLs above it are blocked with this precision; 1.01 where none does."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero((right >= precision) & np.append(score[order][1:] != score[order][:-1], True))
    return float(score[order][fine[-1]]) if len(fine) else 1.01


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    threshold: float
    precision: float
    recall: float


def train(examples: list[tuple[str, str, int, bool]], precision: float) -> Model:
    """(host, path, label, held out) -> the model, with the threshold, precision and recall of the held-out rows. Without held-out rows
    the threshold is 0.5."""
    w, bias = fit([x[:3] for x in examples if not x[3]])
    held = [x for x in examples if x[3]]
    if not held:
        return Model(w, bias, 0.5, float("nan"), float("nan"))
    score, y = scores([features(h, p) for h, p, _, _ in held], w, bias), np.array([x[2] for x in held], float)
    threshold = chosen_threshold(score, y, precision)
    blocked = score >= threshold
    return Model(w, bias, threshold, float(y[blocked].mean()) if blocked.any() else float("nan"), float(y[blocked].sum() / max(1.0, y.sum())))


def judge(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] | None = None,
    labelled: list[tuple[str, int, bool]] | None = None, precision: float = 0.99,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every page.

    The verdict is the longest fitting rule's, else block where the model's score reaches the threshold that keeps this precision on the
    held-out rows of the labelled table (url, label, held out). Null
    urls and urls without `://` have empty host and path, fit no rule and are scored like any other. Repeated rows and null
    ids keep their rows; equally long rules: the later by name; an empty table gives no rows; other columns are
    ignored. The labelled table is small by contract; without one it is labelled_urls(), 3600 rows made by a rule; an empty one is an error.
    """
    rules = RULES if rules is None else rules
    labelled = labelled_urls() if labelled is None else labelled
    if not labelled:
        raise ValueError("the labelled table is empty")
    examples = pages.sparkSession.createDataFrame(labelled, "url string, label int, held boolean").select(host_of(F.col("url")), path_of(F.col("url")), "label", "held")
    model = train([tuple(r) for r in examples.collect()], precision)
    sent = pages.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = sent.value
        for batch in batches:
            found = [features(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(found, w, bias), pa.float64())], [*batch.schema.names, "score"])

    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", rule.alias("rule"), verdict.alias("ruled"))
    scored = ruled.mapInArrow(run, "page_id long, host string, path string, rule string, ruled string, score double")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= model.threshold, "block").otherwise("allow")).alias("verdict"), "score")
