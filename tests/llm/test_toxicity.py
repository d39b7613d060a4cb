"""Toxicity scores against a plain version: dictionaries, all cosines, and Newton steps of its own."""

import math
import random
import re

import numpy as np

from nearkin.llm import toxicity


def corpus(n=260, seed=3):
    r = random.Random(seed)
    common = ["the", "of", "And", "is"]
    words = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in ("ala", "elo", "iru", "omu", "uda") for c in ("", "n", "s")]
    rows = []
    for i in range(n):
        text = [r.choice(common) if r.random() < 0.4 else r.choice(words) for _ in range(r.randint(1, 40))]
        bad = int(r.random() < 0.3)
        if bad:
            text += r.choices(["rotten", "Awful", "vile"], k=r.randint(1, 3))
        rows.append((i, " ".join(text), bad))
    rows += [(n, "", 0), (n + 1, "", 1), (n + 2, rows[0][1], 1 - rows[0][2]), rows[1]]
    return rows


class Plain:
    def __init__(self, rows):
        self.rows = rows
        bags = [self.bag(t) for _, t, _ in rows]
        self.weight = {"": 1.0}
        for w in {w for b in bags for w in b if w}:
            df, yes = sum(w in b for b in bags), sum(w in b and y for b, (_, _, y) in zip(bags, rows, strict=True))
            self.weight[w] = (1 + math.log((1 + len(rows)) / (1 + df))) * math.log2(2 + yes / max(1, df - yes)) ** toxicity.RELEVANCE
        self.entries = {}
        for b, (i, _, y) in zip(bags, rows, strict=True):
            self.entries.setdefault(tuple(sorted(b.items())), []).append((i, y))
        pairs = [(self.vote(t, (i, y)), y) for i, t, y in rows]
        x, y = np.array([self.odds(v) for v, _ in pairs]), np.array([y for _, y in pairs])
        self.a, self.b = 1.0, 0.0
        for _ in range(4000):  # plain descent, from another side than the steps of the operator
            p = 1 / (1 + np.exp(-(self.a * x + self.b)))
            self.a -= 0.4 * (((p - y) * x).sum() + self.a - 1) / len(x)
            self.b -= 0.4 * (p - y).sum() / len(x)

    @staticmethod
    def bag(text):
        out = {"": 1}
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            out[w] = out.get(w, 0) + 1
        return out

    @staticmethod
    def odds(p):
        return math.log(p / (1 - p))

    def vector(self, bag):
        v = {w: (1 + math.log(n)) * self.weight[w] for w, n in bag.items() if w in self.weight}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    def vote(self, text, leave=None):
        bag = self.bag(text)
        q, own, found = self.vector(bag), tuple(sorted(bag.items())), []
        for e, labels in self.entries.items():
            labels = [y for _, y in labels]
            if leave and e == own:
                labels.remove(leave[1])
            if labels:
                v = self.vector(dict(e))
                found.append((sum(x * v.get(w, 0.0) for w, x in q.items()), labels))
        found.sort(key=lambda x: -x[0])
        last = found[min(len(found), toxicity.NEAREST) - 1][0]
        up = down = 0.0
        for c, labels in found:
            if c >= last - 1e-9:
                up += sum(labels) / (0.02 + max(0.0, 1 - c)) ** 2
                down += len(labels) / (0.02 + max(0.0, 1 - c)) ** 2
        every = [y for _, _, y in self.rows]
        every_but = (sum(every) - leave[1]) / (len(every) - 1) if leave else sum(every) / len(every)
        return (up + every_but) / (down + 1)

    def score(self, text):
        return 1 / (1 + math.exp(-(self.a * self.odds(self.vote(text)) + self.b)))


def test_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    monkeypatch.setattr(toxicity, "FIRST", 1)
    rows = corpus()
    plain = Plain(rows)
    fitted = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    assert abs(fitted.slope - plain.a) < 1e-3 and abs(fitted.intercept - plain.b) < 1e-3
    texts = [*(t for _, t, _ in corpus(60, 9)), None, "", "unknownword", "rotten", "the " * 5000]
    for text, (p, evidence) in zip(texts, fitted.scores(texts), strict=True):
        assert abs(p - plain.score(text)) < 1e-3
        assert evidence and set(evidence) <= {i for i, _, _ in rows}
    assert 0 < len(fitted.index.value.most) < len(fitted.index.value.make.term_weight)  # both kinds of terms


def test_votes_are_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    monkeypatch.setattr(toxicity, "FIRST", 1)
    rows = corpus()
    plain, index = Plain(rows), toxicity.Index(rows)
    votes = index.own_votes([t for _, t, _ in rows], [y for _, _, y in rows])
    for (i, text, y), vote in zip(rows, votes, strict=True):
        assert abs(vote - plain.vote(text, (i, y))) < 1e-9


def test_no_word_is_left_out():
    rows = corpus()
    assert set(toxicity.Index(rows).make.place) == {w for _, t, _ in rows for w in re.findall(r"[^\W\d_]+", t.lower())}


def test_few_examples(spark):
    for rows in ([(1, "one", 1)], [(1, "", 0), (2, "two words", 1)]):
        fitted = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, label int"))
        assert all(0 <= p <= 1 for p, _ in fitted.scores([None, "", "one", "two", "three"]))
