"""Plain twins: dense risks with numerical slopes for the two classifiers, a quadratic patience alignment for the licence scan."""

import random
import re
import sys
import time
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from spendlens.llm import license_scan, linear, quality_pu, toxicity  # noqa: E402
from spendlens.llm.license_texts import LICENSES  # noqa: E402

TEXTS = ["alpha beta gamma!", "", "alpha ALPHA alpha #1", "Delta said hello. Women are here", "beta beta", "men and women wait",
         "x " * 40, "zeta eta theta iota kappa", "### $$$ 123", "Gamma beta delta", "good words go here", "noise qqq zzz"]


def made(texts, module, labels):
    out = []
    for t, y in zip(texts, labels, strict=True):
        ids, vals, dense = linear.vector(t, module.features, module.ratios)
        out.append({"label": y, "ids": ids.astype("<u4").tobytes(), "vals": vals.astype("<f4").tobytes(), "ratios": dense})
    return out


def dense(texts, module):
    width = len(module.ratios([]))
    x = np.zeros((len(texts), (1 << linear.BITS) + width + 1))
    for row, text in zip(x, texts, strict=True):
        words = text.split()
        for w in words:
            for h in linear.hashed(module.features(w)):
                row[h] += 1 / np.sqrt(max(1, len(words)))
        row[1 << linear.BITS:] = [*module.ratios(words), 1.0]
    return x


def slope(loss, z, eps=1e-5):
    return (loss(z + eps) - loss(z - eps)) / (2 * eps)


def plus(z):
    return np.logaddexp(0, -z)


def minus(z):
    return np.logaddexp(0, z)


class Stepper:
    def __init__(self, size, rate, decay):
        self.w, self.squares, self.rate, self.decay = np.zeros(size), np.full(size, 1e-8), rate, decay

    def step(self, g):
        g = g + self.decay * self.w
        self.squares += g ** 2
        self.w -= self.rate * g / np.sqrt(self.squares)


@pytest.mark.parametrize("prior", [0.3, 0.95])
def test_positive_unlabelled_descent_equals_the_dense_risk(prior):
    p, u = TEXTS[::2], TEXTS
    x, y = dense(p, quality_pu), dense(u, quality_pu)
    model, rng, turned = Stepper(x.shape[1], 0.2, 3e-3), np.random.default_rng(4), 0
    for _ in range(8):
        a, b = rng.permutation(len(p)), rng.permutation(len(u))
        zp, zu = x[a] @ model.w, y[b] @ model.w
        negative = minus(zu).mean() - prior * minus(zp).mean()  # the risk on negatives that positives and unlabelled texts imply
        on_negatives = y[b].T @ slope(minus, zu) / len(b) - prior * (x[a].T @ slope(minus, zp)) / len(a)
        if negative >= 0:
            model.step(prior * (x[a].T @ slope(plus, zp)) / len(a) + on_negatives)
        else:
            turned += 1
            model.step(-on_negatives)
    got = quality_pu._descend(made(p, quality_pu, [1] * len(p)), made(u, quality_pu, [0] * len(u)), prior, 8, 0.2, 3e-3, 4)
    assert np.abs(got - model.w).max() < 2e-3 and np.abs(model.w).max() > 0.1
    assert (turned > 0) == (prior > 0.9)


class Rows:
    """Stands for a table: what ``sample_vectors`` and ``_swap_counts`` would fetch."""


@pytest.mark.parametrize("penalty", [0.0, 10.0])
def test_counterfactual_fit_equals_the_dense_loss(monkeypatch, penalty):
    labels = [k % 3 == 0 for k in range(len(TEXTS))]
    pairs = {}
    for t in TEXTS:
        for s in toxicity.swaps(t):
            pairs[s] = pairs.get(s, 0) + 1
    assert pairs
    monkeypatch.setattr(toxicity.linear, "sample_vectors", lambda *a: made(TEXTS, toxicity, [int(y) for y in labels]))
    monkeypatch.setattr(toxicity, "_swap_counts", lambda rows: pairs)
    got = toxicity.fit(Rows(), penalty=penalty, epochs=6, rate=0.4, decay=6e-5, seed=2)
    x, y = dense(TEXTS, toxicity), np.array(labels, float)
    model, rng = Stepper(x.shape[1], 0.4, 6e-5), np.random.default_rng(2)
    model.w[-1] = np.log(y.mean() / (1 - y.mean()))
    swap = np.zeros((len(pairs), x.shape[1]))
    for row, (a, b) in zip(swap, pairs, strict=True):
        for h in linear.hashed(toxicity.features(a)):
            row[h] += 1
        for h in linear.hashed(toxicity.features(b)):
            row[h] -= 1
    share = np.array(list(pairs.values())) / len(TEXTS)
    for _ in range(6):
        rng.permutation(len(TEXTS))
        z = x @ model.w
        g = x.T @ (y * slope(plus, z) + (1 - y) * slope(minus, z)) / len(y)
        model.step(g + swap.T @ (share * slope(lambda d: penalty * d ** 2, swap @ model.w)))
    assert np.abs(got - model.w).max() < 2e-3
    change = np.abs(swap @ got)
    if penalty:
        assert change.max() < 0.05


def plain_alignments(text, template, a=0, b=0):
    """All patience alignments by definition: equal words at the start, then at the end, then anchors unique on both sides; any
    longest ascending run of anchors may be taken, and the gaps between are aligned alike."""
    if not text or not template:
        return [()]
    if text[0] == template[0]:
        return [((a, b), *rest) for rest in plain_alignments(text[1:], template[1:], a + 1, b + 1)]
    if text[-1] == template[-1]:
        last = (a + len(text) - 1, b + len(template) - 1)
        return [(*rest, last) for rest in plain_alignments(text[:-1], template[:-1], a, b)]
    anchors = [(k, template.index(w)) for k, w in enumerate(text) if text.count(w) == template.count(w) == 1]
    if not anchors:
        return [()]
    length = []
    for k, (_, y) in enumerate(anchors):
        length.append(1 + max((length[j] for j in range(k) if anchors[j][1] < y), default=0))
    out = []
    for run in longest_runs(anchors, max(length)):
        found = [()]
        edges = [(-1, -1), *run, (len(text), len(template))]
        for (p, r), (q, s) in zip(edges, edges[1:]):
            gap = plain_alignments(text[p + 1:q], template[r + 1:s], a + p + 1, b + r + 1)
            end = ((a + q, b + s),) if (q, s) != edges[-1] else ()
            found = [x + g + end for x in found for g in gap]
        out += found
    return out


def longest_runs(both, most, run=()):
    if len(run) == most:
        yield list(run)
        return
    for k, m in enumerate(both):
        if not run or m[1] > run[-1][1]:
            yield from longest_runs(both[k + 1:], most, (*run, m))


def common_table(text, template):
    t = np.zeros((len(text) + 1, len(template) + 1), int)
    for i, a in enumerate(text):
        for j, b in enumerate(template):
            t[i + 1, j + 1] = t[i, j] + 1 if a == b else max(t[i, j + 1], t[i + 1, j])
    return int(t[-1, -1])


def test_alignment_equals_its_definition():
    rng = random.Random(5)
    for _ in range(400):
        template = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 9))]
        text = [rng.randrange(1, 11) for _ in range(rng.randrange(9))]
        got = license_scan.align(text, template)
        assert all(text[x] == template[y] for x, y in got) and got == sorted(got)
        assert all(p < q and r < s for (p, r), (q, s) in zip(got, got[1:]))
        assert len(got) <= common_table(text, template)
        assert tuple(got) in plain_alignments(text, template)
        masks = {w: sum(1 << k for k, x in enumerate(template) if x == w) for w in set(template)}
        assert license_scan.common_length(text, masks, len(template)) == common_table(text, template)


def plain_scan(scanner, text):
    """Every window aligned, none passed over."""
    words = text.split()
    ids = [scanner.number.get(w.lower().strip(license_scan._MARKS), 0) for w in words]
    out = []
    for name, template in scanner.templates.items():
        own = [(k, i) for k, i in enumerate(ids) if i and i in template]
        need, reach, done = max(1, int(np.ceil(scanner.coverage * len(template)))), len(template) * 3 // 2 + 3, -1

        def window(s):
            return [i for k, i in own[s:] if k < own[s][0] + reach]

        for s in range(len(own)):
            if s <= done or len(window(s)) < need:
                continue
            matched = license_scan.align(window(s), template)
            if len(matched) >= need:
                begin = s + matched[0][0]
                again = license_scan.align(window(begin), template)
                if len(again) >= len(matched):
                    s, matched = begin, again
                out.append((name, len(matched) / len(template), own[s + matched[0][0]][0], own[s + matched[-1][0]][0]))
                done = s + matched[-1][0]
    return out


def test_passed_over_windows_hold_no_copy():
    rng = random.Random(6)
    scanner = license_scan.Scanner(LICENSES, 0.8)
    found = 0
    for n in range(60):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(list(LICENSES.values())).split()
            kind = rng.randrange(4)
            if kind == 1:  # some words lost or put in
                words = [w for w in words if rng.random() > 0.12]
                words = [x for w in words for x in ([w, rng.choice(["the", "sea", "software"])] if rng.random() < 0.1 else [w])]
            elif kind == 2:
                words = rng.sample(words, len(words))
            elif kind == 3:  # two halves the wrong way round
                words = words[len(words) // 2:] + words[:len(words) // 2]
            parts += words + ["tail"] * rng.randrange(5)
        text = " ".join(parts)
        got = scanner.scan(text)
        assert got == plain_scan(scanner, text), n
        found += len(got)
    assert found > 40 and scanner.scan("") == scanner.scan(None) == []


def test_shuffled_template_words_cost_little():
    rng = random.Random(7)
    words = re.findall(r"\S+", LICENSES["mit"])
    text = " ".join(rng.choice(words) for _ in range(100_000))
    scanner = license_scan.Scanner(LICENSES, 0.8)
    began = time.process_time()
    assert [x for x in scanner.scan(text) if x[0] == "mit"] == []
    assert time.process_time() - began < 20  # 11 s for 8,000 words when every window was aligned
