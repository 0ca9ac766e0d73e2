"""Deleted interpolation against a plain model, and its edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chatledger.llm import lm_scoring as L
from chatledger.llm import queries


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 1


def deleted(doc_id):
    return not held(doc_id) and zlib.crc32(f"deleted:{'' if doc_id is None else doc_id}".encode()) % 10 == 0


def tokens(text):
    return [w.decode() for w in (text or "").encode().lower().split()] + ["\n"]


class Plain:
    """Counts in dictionaries, one token after the other."""

    def __init__(self, texts):
        self.grams = [Counter(), Counter(), Counter()]
        self.docs = len(texts)
        for text in texts:
            for u, v, w in self.events(text):
                self.grams[0][w] += 1
                self.grams[1][v, w] += 1
                self.grams[2][u, v, w] += 1
        self.tokens, self.words = sum(self.grams[0].values()), len(self.grams[0])

    @staticmethod
    def events(text):
        row = [" ", " ", *tokens(text)]
        return zip(row, row[1:], row[2:])

    def parts(self, u, v, w):
        two = self.docs if v == " " else self.grams[0][v]
        three = self.docs if v == " " else self.grams[1][u, v]
        return (self.grams[2][u, v, w], three, self.grams[1][v, w], two, self.grams[0][w])

    def probability(self, event, weights):
        r3, x3, r2, x2, r1 = self.parts(*event)
        one = weights.one if self.tokens else 0
        p1 = one * r1 / max(1, self.tokens) + (1 - one) / (self.words + 1)
        l2, l3 = weights.two[x2.bit_length()], weights.three[x3.bit_length()]
        p2 = l2 * r2 / max(1, x2) + (1 - l2) * p1
        return l3 * r3 / max(1, x3) + (1 - l3) * p2


def plain_weights(left, texts):
    """Expectation-maximisation, an event at a time."""
    events = [left.parts(*e) for t in texts for e in left.events(t)]
    weights = L.Weights(0.5, L._filled({}), L._filled({}))
    for _ in range(L.MOST_ROUNDS):
        two, three, ones = {}, {}, [0.0, 0.0]
        for r3, x3, r2, x2, r1 in events:
            b2, b3 = x2.bit_length(), x3.bit_length()
            p1 = weights.one * r1 / max(1, left.tokens) + (1 - weights.one) / (left.words + 1)
            q2, q3 = weights.two[b2] * r2 / max(1, x2), weights.three[b3] * r3 / max(1, x3)
            p2 = q2 + (1 - weights.two[b2]) * p1
            a3 = q3 / (q3 + (1 - weights.three[b3]) * p2)
            a2 = (1 - a3) * q2 / p2
            a1 = (1 - a3 - a2) * weights.one * (r1 / max(1, left.tokens)) / p1
            for sums, b, used, total in ((three, b3, a3, 1), (two, b2, a2, 1 - a3)):
                sums[b] = sums.get(b, (0, 0))[0] + used, sums.get(b, (0, 0))[1] + total
            ones = [ones[0] + a1, ones[1] + 1 - a3 - a2]
        new = L.Weights(round((ones[0] + 0.5) / (ones[1] + 1), 6) if events else 0.5, L._filled(two), L._filled(three))
        moved = max(abs(a - b) for a, b in zip([new.one, *new.two, *new.three], [weights.one, *weights.two, *weights.three]))
        weights = new
        if moved < L.SETTLED:
            break
    return weights


def expected(rows):
    learned = [(d, t) for d, t in rows if not held(d)]
    model = Plain([t for _, t in learned])
    left = Plain([t for d, t in learned if not deleted(d)])
    weights = plain_weights(left, [t for d, t in learned if deleted(d)])
    base = model.tokens + 0.5 * (model.words + 1)
    out = []
    for d, t in rows:
        row = tokens(t)
        out.append((
            d, held(d), len(row), sum(w in model.grams[0] for w in row), model.tokens,
            sum(math.log10((model.grams[0][w] + 0.5) / base) for w in row),
            sum(math.log10(model.probability(e, weights)) for e in model.events(t)),
        ))
    return out


def same(found, wanted):
    def key(r):
        return (r[0] is not None, r[0] or 0, *r[1:5], round(r[5], 6), round(r[6], 6))

    found, wanted = sorted(map(tuple, found), key=key), sorted(wanted, key=key)
    assert len(found) == len(wanted)
    for f, w in zip(found, wanted):
        assert f[:5] == w[:5]
        assert f[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9) and f[6] == pytest.approx(w[6], rel=1e-5, abs=1e-5)


def score(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return L.score(made.withColumn("block", F.lit("x")).withColumn("score", F.lit(1)).withColumn("ids", F.lit(0))).collect()


def prose(rng, n):
    words, out = [f"W{i}" for i in range(30)], ["w0"]
    for _ in range(n - 1):
        # Each word is often followed by the next one.
        out.append(words[(int(out[-1][1:]) + 1) % 30] if rng.random() < 0.6 else rng.choice(words))
    return rng.choice([" ", "\n", "\t "]).join(out)


def test_scores_equal_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_BYTES", 2000)
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.choice([1, 5, 40, 200]))) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(30)] + rows[:5]
    rows += [(900, None), (901, ""), (902, " \t\n"), (None, "w1 w2"), (903, "Été É été \x00 a b " + "z" * 70_000), (904, "<s> </s>")]
    same(score(spark, rows), expected(rows))


def test_model_beats_single_tokens_on_held_out_text(spark):
    rng = random.Random(2)
    found = score(spark, [(i, prose(rng, 120)) for i in range(400)])
    apart = [(r["score"] - r["base_score"]) / r["n_tokens"] for r in found if r["held_out"]]
    assert len(apart) > 50 and min(apart) > 0.2


@pytest.mark.parametrize("rows", [[], [(1, "a b")], [(i, "x y") for i in range(200) if held(i)], [(i, None) for i in range(30)]])
def test_little_or_nothing_to_learn_from(spark, rows):
    same(score(spark, rows), expected(rows) if rows else [])


def test_registered_query(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, prose(rng, 20)) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    same(queries.op13_lm_scoring(spark, str(tmp_path)).collect(), expected(rows))


def test_numbers_survive_packing():
    rng = np.random.default_rng(4)
    for x in (np.zeros(0), np.zeros(3), np.array([255]), np.array([256, 1]), rng.integers(0, 2**63, 50) * 2 + 1):
        x = x.astype(np.uint64)
        assert (L._unpack_numbers(L._pack_numbers(x)) == x).all()
