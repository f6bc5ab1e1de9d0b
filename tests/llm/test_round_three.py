"""Whitening, collocations and packing by minimum bin slack: brute force, an exact round trip, and odd input."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from loreweave.llm import bin_slack, collocations, packing, whitening
from loreweave.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, part int, length long, words int, f long, n long, cell long"


def docs(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", 1, 2, 3, 4, 5, 6) for r in rows], DOCS)


# Whitening


def odd_matrices():
    rng = np.random.default_rng(3)
    turn, _ = np.linalg.qr(rng.standard_normal((16, 16)))
    wide, _ = np.linalg.qr(rng.standard_normal((50, 16)))
    tops = [3.0] * 4 + [1.0] * 12
    return {
        "plain": rng.standard_normal((300, 40)), "low rank": rng.standard_normal((300, 3)) @ rng.standard_normal((3, 40)), "few rows": rng.standard_normal((3, 9)),
        "graded": rng.standard_normal((300, 20)) * 10.0 ** -np.arange(20), "graded up": rng.standard_normal((300, 20)) * 10.0 ** np.arange(20),
        "equal": np.vstack([np.eye(16)] * 3), "tied": wide * tops, "tied, turned": wide * tops @ turn, "nearly tied": wide * np.array([3, 3 + 1e-12, 3 + 1e-9, 3 + 1e-6, *tops[4:]]) @ turn,
        "huge": rng.standard_normal((300, 8)) * 1e18, "one": rng.standard_normal((5, 1)), "zero": np.zeros((5, 4)), "one column zero": np.diag([3.0, 0.0, 2.0]),
        "two near": np.linalg.cholesky(np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1) + 3 * np.eye(21)).T,
    }


@pytest.mark.parametrize("name", list(odd_matrices()))
def test_solver_against_a_plain_singular_value_decomposition(name):
    a = odd_matrices()[name]
    square = np.zeros((a.shape[1],) * 2)
    r = np.linalg.qr(a, mode="r")
    square[: len(r)] = r
    values, vectors = whitening.directions(square, a.shape[1])
    want = np.linalg.svd(a, compute_uv=False)
    assert len(values) == (want > a.shape[1] * np.finfo(float).eps * want[0]).sum() if want[0] else len(values) == 0
    if len(values):
        assert np.abs(values - want[: len(values)]).max() < 1e-13 * want[0]
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13
        assert np.abs(a.T @ (a @ vectors) / want[0] ** 2 - vectors * (values / want[0]) ** 2).max() < 1e-13


def test_singular_values_to_high_relative_accuracy():
    d, e = np.array([1.0, 1e-8, 1e-20, 1e-3]), np.array([1e-3, 1e-12, 1e-9])
    found = whitening.singular_values(d, e)
    assert abs(math.prod(found) / math.prod(d) - 1) < 1e-13 and found[-1] > 0


def vectors_table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, b"x") for i, v in rows], "vec_id long, embedding array<double>, component int, whitened double, x binary")


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    data = rng.standard_normal((300, 10)) @ np.diag(np.arange(1, 11)) / 4
    data[50:120] = data[3]  # repeats count once in the fit
    nan, inf = float("nan"), float("inf")
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(3, data[3].tolist()), (None, data[4].tolist())]
    odd = [(900, None), (901, []), (902, [nan] * 10), (903, [inf] + [0.0] * 9), (904, [None] + [0.0] * 9), (905, [1.0, 2.0])]
    found = whitening.whiten(vectors_table(spark, rows + odd).repartition(5)).collect()
    x = np.floor(256 * data).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    v = np.cov(fit.T.astype(float), bias=True)
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    assert len(found) == 4 * len(rows) and {r.n for r in found} == {n} and {r.vec_id for r in found} == {i for i, _ in rows}
    signs = {}
    for r in found:
        i = 4 if r.vec_id is None else r.vec_id
        c = r.component - 1
        want = float((x[i] - sums / n) @ w[:, c] / math.sqrt(e[c]))
        sign = signs.setdefault(c, 1 if want * r.whitened > 0 else -1)
        assert abs(sign * want - r.whitened) < 1e-9
        assert r.deviation == int(((n * x[i] - sums) ** 2).sum())
        assert abs(r.explained / (e[c] / np.trace(v)) - 1) < 1e-12 and r.identity_error < 1e-12


def test_whitening_of_odd_tables(spark):
    empty = whitening.whiten(vectors_table(spark, []).limit(0))
    assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(vectors_table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    line = whitening.whiten(vectors_table(spark, [(i, [float(i), 2.0 * i, -0.0]) for i in range(5)])).collect()
    assert len(line) == 5 and all(r.component == 1 and abs(r.explained - 1) < 1e-12 for r in line)
    huge = whitening.whiten(vectors_table(spark, [(1, [1e308, 0.0]), (2, [-1e308, 1.0]), (3, [0.0, 5.0])])).collect()
    assert {r.deviation is None for r in huge} == {True, False} and all(math.isfinite(r.whitened) for r in huge)
    wide = whitening.whiten(vectors_table(spark, [(i, [float(i * 10**12), float(i * i)]) for i in range(6)])).collect()  # sums of squares beyond 64 bits
    x = [[256 * i * 10**12, 256 * i * i] for i in range(6)]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((6 * a - s) ** 2 for a, s in zip(x[i], sums)) for i in range(6)}
    assert {r.vec_id: r.deviation for r in wide} == {i: v if v < 2**63 else None for i, v in want.items()}


def test_whitening_joins_triangles_in_a_tree(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((400, 6))
    held = [whitening._triangle(i, np.linalg.qr(a[10 * i : 10 * i + 10], mode="r")) for i in range(40)]
    joined = list(whitening._joined(6)(iter(held)))
    assert [b.column(0).to_pylist() for b in joined] == [[0], [1]]
    tops = [np.frombuffer(b.column(1)[0].as_py(), "<f8").reshape(-1, 6) for b in joined]
    assert np.allclose(sum(t.T @ t for t in tops), a.T @ a)


# Collocations


def brute_phrases(rows, threshold, longest, top):
    f, n = collections.Counter(), collections.Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        text = re.sub("[A-Z]", lambda m: m.group().lower(), r[1] or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                f.update((lang, *w[i : i + m]) for i in range(len(w) - m + 1))
    often = {k: v for k, v in f.items() if v >= threshold}
    out = []
    for (lang, *w), a in often.items():
        if len(w) < 2:
            continue
        score, k = min((2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        longer = [v for (other, *x), v in often.items() if other == lang and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x) - len(w) + 1))]
        if not any(100 * v >= 80 * a for v in longer):
            out.append((lang, " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score))
    ranked = []
    for lang, group in itertools.groupby(sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())), key=lambda r: r[0]):
        ranked += [(lang, i, *r[1:]) for i, r in zip(range(1, top + 1), group)]
    return set(ranked)


def phrase_rows(seed, n, size=6):
    rng = random.Random(seed)
    words = ["Aa", "bb", "c'c", "ÄÖ", "dd", "e-e", " f", "the", "The", "<|x|>"][:size]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ! ", "\r\n", "\x0b"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(marks) for _ in range(rng.randrange(40))), rng.choice(["en", "de", None, "und"])) for i in range(n)]
    return rows + [(9000, None, "en"), (9001, "", None), (9002, " \t ", "fr"), (9003, "..!", "fr"), (None, "bb aa bb aa", "en"), (1, "bb aa bb aa", "en"), (1, "bb aa bb aa", "en")]


@pytest.mark.parametrize("threshold, longest, top", [(5, 4, 2000), (3, 3, 7), (30, 4, 2000), (4, 5, 2000)])
def test_collocations_equal_brute_force(spark, threshold, longest, top):
    rows = phrase_rows(threshold, 150) + [(10_000, "dd bb aa " * 3000 + "the end", "en")]
    found = collocations.collocations(docs(spark, rows).repartition(3), threshold=threshold, longest=longest, top=top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in found.collect()} == brute_phrases(rows, threshold, longest, top)


def test_collocations_with_tiny_summaries_and_bit_tables(spark):
    rows = phrase_rows(2, 200, size=10)
    found = collocations.collocations(docs(spark, rows).repartition(6), threshold=6, counters=4, filter_bytes=64)
    assert {tuple(r) for r in found.collect()} == brute_phrases(rows, 6, 4, 2000)
    assert collocations.collocations(docs(spark, []).limit(0)).count() == 0
    assert collocations.collocations(docs(spark, [(1, None), (2, "a")])).count() == 0


def test_chunks_hold_texts_that_run_on(monkeypatch):
    rows = phrase_rows(5, 60) + [(1, "the aa bb dd " * 300 + "end. " + "x" * 500 + " y", "en"), (2, "z" * 3000, "de")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[2] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["lang", "text"])

    def counts():
        out = collections.Counter()
        for chunk, seen in collocations._chunks(iter([batch]), 4):
            for n, counts, hashes, places, a in chunk.grams(seen):
                for c, at in zip(counts.tolist(), places.tolist()):
                    out[n, b" ".join(chunk.words[i] for i in a[at : at + n])] += c
        return out

    whole = counts()
    want = collections.Counter()
    for r in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m.group().lower(), r[1] or "")):
            w = re.findall("[^\x20\x09]+", piece)
            want.update((m, " ".join(w[i : i + m]).encode()) for m in range(1, 5) for i in range(len(w) - m + 1))
    assert whole == want
    for chunk, words, cut in ((1, 10**6, 10), (7, 10**6, 25), (10**6, 5, 60), (50, 10**6, 3)):
        monkeypatch.setattr(collocations, "_CHUNK", chunk)
        monkeypatch.setattr(collocations, "_WORDS", words)
        monkeypatch.setattr(collocations, "_SLICE", cut)
        assert counts() == whole


def test_squeezed_sums_come_back():
    rng = np.random.default_rng(4)
    for most, n in ((1 << 28, 1), (1 << 28, 4000), (5000, 4000), (1 << 28, 5), (300_000, 20), (65536 * 3, 3)):
        keys = np.unique(rng.integers(0, most, n)).astype(np.uint64)
        for counts in (rng.integers(1, 4, len(keys)), rng.integers(1, 1 << 40, len(keys))):
            packed = collocations.squeezed(keys, counts)
            found = collocations.unsqueezed(*packed)
            assert found[0].tolist() == keys.tolist() and found[1].tolist() == counts.tolist()
    for gap in (65534, 65535, 65536, 131069, 131070, 131071):
        keys = np.array([7, 8, 8 + gap, 9 + gap, 10 + gap, 11 + gap], np.uint64)
        assert collocations.unsqueezed(*collocations.squeezed(keys, np.arange(1, 7)))[0].tolist() == keys.tolist()


def test_misra_gries_keeps_all_frequent_keys_in_any_order():
    rng = np.random.default_rng(2)
    for trial in range(40):
        stream = np.concatenate([rng.zipf(1.3, 3000) % 700, np.repeat(rng.integers(0, 700, 3), 60)]).astype(np.uint32)
        rng.shuffle(stream)
        threshold = 50
        capacity = len(stream) // threshold + 1
        kept, lost = (np.zeros(0, np.uint32), np.zeros(0, np.int64)), 0
        for part in np.array_split(stream, 1 + trial):
            keys, counts = np.unique(part, return_counts=True)
            *kept, taken = collocations.merge_summaries(kept, [(keys, counts)], capacity)
            lost += taken
            assert len(kept[0]) <= capacity
        true = dict(zip(*(x.tolist() for x in np.unique(stream, return_counts=True))))
        left = dict(zip(kept[0].tolist(), kept[1].tolist()))
        assert lost < threshold
        assert all(k in left and left[k] <= c <= left[k] + lost for k, c in true.items() if c >= threshold)


# Packing


def test_fullest_combination_equals_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        counts = {n: rng.randrange(1, 4) for n in rng.sample(range(1, 25), rng.randrange(1, 6))}
        room = rng.randrange(0, 40)
        best = max(s for c in itertools.product(*(range(n + 1) for n in counts.values())) if (s := sum(a * b for a, b in zip(c, counts))) <= room)
        found = bin_slack.fullest(sorted(counts, reverse=True), counts, room)
        assert sum(k * n for k, n in found.items()) == best and all(n <= counts[k] for k, n in found.items())


def test_combinations_use_every_piece_and_few_bins():
    rng = np.random.default_rng(1)
    for lengths, most in ((np.clip(rng.lognormal(6, 1, 20000), 1, 2048), 1.0005), (rng.integers(1, 2049, 5000), 1.03), (rng.integers(1, 60, 50000), 1.0005)):
        counts = collections.Counter(lengths.astype(int).tolist())
        plan = bin_slack.minimum_bin_slack(counts, 2048)
        used = collections.Counter()
        for times, found in plan:
            assert sum(k * n for k, n in found.items()) <= 2048
            used.update({k: times * n for k, n in found.items()})
        assert used == counts and sum(t for t, _ in plan) <= most * -(-sum(k * n for k, n in counts.items()) // 2048) + 1


def test_bin_slack_packing_is_an_exact_round_trip(spark):
    rng, bpe = random.Random(2), packing.tokenizer(vocabulary())
    text = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    rows = [(i, text(rng.choice([1, 20, 300, 900, 3000]))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "  lead \n\n"), (103, "<|endoftext|>"), (None, "no id"), (1, "repeated"), (1, "repeated"), *((200 + i, "same") for i in range(300))]
    found = bin_slack.pack_whole(docs(spark, rows).repartition(5), vocabulary()).collect()
    end = np.array([0], "<u4").tobytes()
    texts = collections.defaultdict(list)
    for i, t in rows:
        texts[i].append(bpe.ids(t or "") + end)
    pieces = collections.defaultdict(list)
    for r in found:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, own in texts.items():
        want = []
        for ids in own:
            total = len(ids) // 4
            start, piece = 0, 0
            while start < total:
                n = (total - start) % 2048 or 2048
                want.append((piece, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                start, piece = start + n, piece + 1
        assert sorted(pieces[i]) == sorted(want)
    windows = collections.defaultdict(list)
    for r in found:
        windows[r.sequence_id].append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    total = sum(len(ids) // 4 for own in texts.values() for ids in own)
    assert len(windows) <= -(-total // 2048) + 2
    assert bin_slack.pack_whole(docs(spark, []).limit(0), vocabulary()).count() == 0
