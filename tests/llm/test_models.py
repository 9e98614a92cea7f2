"""The two classifiers against plain-loop versions of themselves, end to end on a few dozen rows."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("cuelake.llm.queries")

from cuelake.llm import language_id, toxicity, words  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MASK = 2**64 - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def hashed(word):
    h, p = 0, 1
    for c in word:
        h, p = (h + (c + 1) * p) & MASK, p * int(words.BASE) & MASK
    return mixed(h)


def gram(h):
    out = len(h) * 0x632BE5AB & MASK
    for x in h:
        out = mixed((out * int(words.BASE) + x) & MASK)
    return out


def plain_features(text):
    h = [hashed(w) for w in re.findall(rb"[a-z0-9\x80-\xff]+", (text or "").encode().lower())]
    found = h + [gram(h[k : k + 2]) for k in range(len(h) - 1)] + [mixed((a * 0xD6E8FEB86659FD93 + b) & MASK) for a, b in zip(h, h[2:], strict=False)]
    return sorted({x >> (64 - toxicity.BITS) for x in found})


def plain_ftrl(rows, y):
    """Weights, bias of FTRL-proximal a coordinate at a time, and of Platt's scale on top."""
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), zlib.crc32(np.array(rows[i], np.int32)), zlib.adler32(np.array(rows[i], np.int32)), y[i]))
    rows, y = [rows[i] for i in order], [y[i] for i in order]
    often = {}
    for r in rows:
        for c in r:
            often[c] = often.get(c, 0) + 1
    rows = [[c for c in r if often[c] >= toxicity.LEAST_ROWS] for r in rows]
    z, n, a, b, l1, l2 = {}, {}, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(c):
        zc, nc = z.get(c, 0.0), n.get(c, 0.0)
        if c == "bias":
            return -zc / ((b + math.sqrt(nc)) / a)
        return 0.0 if abs(zc) <= l1 else (math.copysign(l1, zc) - zc) / ((b + math.sqrt(nc)) / a + l2)

    for k in range(toxicity.PASSES):
        for i in np.random.default_rng(k).permutation(len(y)):
            cs = [*rows[i], "bias"]
            w = {c: weight(c) for c in cs}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - y[i]
            for c in cs:
                nc = n.get(c, 0.0)
                z[c] = z.get(c, 0.0) + g - (math.sqrt(nc + g * g) - math.sqrt(nc)) / a * w[c]
                n[c] = nc + g * g
    w = {c: weight(c) for c in z if c != "bias"}
    sums = [sum(w[c] for c in r) for r in rows]
    s, t = 1.0, 0.0
    for _ in range(200):  # Platt's objective by small Newton steps
        q = [1 / (1 + math.exp(-max(-35, min(35, s * x + t)))) for x in sums]
        gs, gt = sum((p - v) * x for p, v, x in zip(q, y, sums, strict=True)) + 0.1 * (s - 1), sum(p - v for p, v in zip(q, y, strict=True)) + 1e-3 * t
        h = [p * (1 - p) + 1e-6 for p in q]
        ss, st, tt = sum(p * x * x for p, x in zip(h, sums, strict=True)) + 0.1, sum(p * x for p, x in zip(h, sums, strict=True)), sum(h) + 1e-3
        d = ss * tt - st * st
        s, t = s - max(-2, min(2, (tt * gs - st * gt) / d)), t - max(-2, min(2, (ss * gt - st * gs) / d))
    return {c: x * s for c, x in w.items()}, t


def test_toxicity_agrees_with_plain_loops(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for k in range(120):
        y = int(rng.random() < 0.4)
        w = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 25))] + rng.choices(["Scum", "idiot", "Crétin"], k=2 * y)
        rng.shuffle(w)
        rows.append((k, ", ".join(w), "en", "s", 0))
        labels.append((k, 1, y))
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (202, "one", "en", "s", 0), (203, "scum idiot", "en", "s", 0)]
    lab = spark.createDataFrame([*labels, labels[1]], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity_report(spark.createDataFrame(rows, DOCS), lab).collect()}
    learned = [k for k, *_ in labels if zlib.crc32(str(k).encode()) % 5]
    weights, bias = plain_ftrl([plain_features(rows[k][1]) for k in learned], [labels[k][2] for k in learned])
    for k, text, *_ in rows:
        z = bias + sum(weights.get(c, 0.0) for c in plain_features(text))
        assert got[k].score == pytest.approx(1 / (1 + math.exp(-max(-35, min(35, z)))), abs=1e-5)
    assert max(abs(w) for w in weights.values()) > 0


def test_the_sample_is_bounded_by_its_features(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_FEATURES", 2000)
    seen = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda rows, y: seen.append(1) or fit(rows, y))
    rows = [(k, " ".join(f"w{(k * 7 + j) % 50}" for j in range(40)), "en", "s", 0) for k in range(200)]
    lab = spark.createDataFrame([(k, 1, k % 2) for k in range(200)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity_report(spark.createDataFrame(rows, DOCS), lab).count() == 200


LETTERS = {"aa": "the of and ing ther", "bb": "une les des que ent", "cc": "der die und sch ein"}


def plain_grams(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode())
    return {data[k : k + n] for n in language_id.SIZES for k in range(len(data) - n + 1)}


def test_language_agrees_with_kernel_ridge_over_sets(spark):
    """With all learning rows as landmarks, the Nyström map is exact: the scores are those of kernel ridge regression."""
    rng = random.Random(3)
    rows = []
    for k in range(90):
        lang = rng.choice(list(LETTERS))
        rows.append((k, " ".join(rng.choice(LETTERS[lang].split()) for _ in range(rng.randrange(4, 20))), lang, "s", 0))
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    frame = spark.createDataFrame(rows, DOCS)
    model = language_id.train(frame.select("doc_id", "text", "lang"), language_id.learns(), landmarks=3 * len(learned))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(frame.select("doc_id", "text"), model).collect()}

    names, sets = sorted(LETTERS), {r[0]: plain_grams(r[1]) for r in rows}
    counts = {}
    for name in names:
        own = {}
        for r in learned:
            if r[2] == name:
                for g in sets[r[0]]:
                    own[g] = own.get(g, 0) + 1
        many = {g for g, c in own.items() if c > 1}
        for g in many or own:
            counts[g] = True
    # codes are little-endian numbers, so that n-grams ending in a zero byte could share one; texts have none
    assert len(model.alphabet) == len(counts)
    alphabet = set(counts)
    part = {k: s & alphabet for k, s in sets.items()}
    kernel = lambda a, b: len(a & b) / math.sqrt(max(1, len(a)) * max(1, len(b)))
    k = np.array([[kernel(part[a[0]], part[b[0]]) for b in learned] for a in learned])
    y = np.array([[float(a[2] == n) for n in names] for a in learned])
    value, vector = np.linalg.eigh(k)
    keep = value > 1e-8 * value[-1]
    phi = k @ (vector[:, keep] / np.sqrt(value[keep]))
    solved = np.linalg.solve(phi.T @ phi + language_id.RIDGE * len(learned) * np.eye(phi.shape[1]), phi.T @ (y - y.mean(0)))
    for r in rows:
        row = np.array([kernel(part[r[0]], part[b[0]]) for b in learned])
        s = row @ (vector[:, keep] / np.sqrt(value[keep])) @ solved + y.mean(0)
        assert got[r[0]][0] == names[int(s.argmax())]
        assert got[r[0]][1] == pytest.approx(min(1.0, max(0.0, s.max())), abs=2e-3)


def test_many_languages_each_keep_ngrams_of_their_own(spark):
    """More languages than landmarks, each with words of its own, are told apart."""
    rng, rows = random.Random(8), []
    for lang in range(140):
        own = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(3)]
        rows += [(lang * 10 + j, " ".join(rng.choice(own) for _ in range(5 + j)), f"l{lang:03d}", "s", 0) for j in range(8)]
    got = language_id.language_report(spark.createDataFrame(rows, DOCS)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in got if r.held_out]) > 0.95
