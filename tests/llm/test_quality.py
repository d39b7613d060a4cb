"""Quality scores against a plain version: dictionaries of words and pairs, one feature at a time."""

import math
import random
import re

import numpy as np

from nearkin.llm import quality

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-\x7f]+")


def grams(text):
    words = WORD.findall(text.encode())
    return [(w,) for w in words] + list(zip(words, words[1:], strict=False))


def plain(texts, labels):
    """A margin of each text after the updates."""
    alpha, beta, l1, l2 = quality.ALPHA, quality.BETA, quality.L1, quality.L2
    z, s = {}, {}

    def weight(g):
        if g == "intercept":
            return -z.get(g, 0.0) / ((beta + math.sqrt(s.get(g, 0.0))) / alpha)
        if abs(z.get(g, 0.0)) <= l1:
            return 0.0
        return -(z[g] - math.copysign(l1, z[g])) / ((beta + math.sqrt(s[g])) / alpha + l2)

    def values(text):
        found = grams(text)
        x = {g: quality.SCALE * found.count(g) / len(found) for g in set(found)}
        return {**x, "intercept": 1.0}

    for _ in range(quality.PASSES):
        for text, y in zip(texts, labels, strict=True):
            x = values(text)
            w = {g: weight(g) for g in x}
            p = 1 / (1 + math.exp(-sum(w[g] * x[g] for g in x)))
            for g, v in x.items():
                step = (p - y) * v
                old = s.get(g, 0.0)
                z[g] = z.get(g, 0.0) + step - (math.sqrt(old + step * step) - math.sqrt(old)) / alpha * w[g]
                s[g] = old + step * step
    return [sum(weight(g) * v for g, v in values(t).items()) for t in texts]


def test_against_plain_version():
    r = random.Random(4)
    texts, labels = [], []
    for _ in range(80):
        good = r.random() < 0.5
        words = r.choices(["alpha", "Beta", "é", "x1", "!!", "end."] if good else ["alpha", "beta", "é", "%%", "x1"], k=r.randint(1, 30))
        texts.append(r.choice([" ", "\n", "  "]).join(words))
        labels.append(int(good))
    texts += ["", texts[0]]
    labels += [0, 1 - labels[0]]
    names = {g for t in texts for g in grams(t)}
    ids = {g: quality.features(np.frombuffer(b" ".join(g), np.uint8), np.array([0, len(b" ".join(g))]))[0].tolist() for g in names}
    assert len({i[0] for g, i in ids.items() if len(g) == 1}) == sum(len(g) == 1 for g in names)  # no two words share a feature
    weights, intercept = quality.fit(texts, labels)
    data = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    got = quality.margins(np.concatenate(data), np.concatenate([[0], np.cumsum([len(d) for d in data])]), weights, intercept)
    assert np.allclose(got, plain(texts, labels), atol=1e-4)
