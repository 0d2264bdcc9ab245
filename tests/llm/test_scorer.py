"""The hashed linear scorer of the quality classifier against plain Python."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa

from larkspur.llm import quality_model as q

SF = "/root/testdata/sf0.001"


def fitted_by_hand(docs, labels):
    """The same steps, one document and one bucket after the other."""
    used = sorted({i for index, _ in docs for i in index.tolist()})
    w, m, v, b = (dict.fromkeys(used, 0.0) for _ in range(3)), None, None, 0.0
    w, m, v = w
    for t in range(1, q.EPOCHS + 1):
        grad, total = {i: 1e-6 * w[i] for i in used}, 0.0
        for (index, share), y in zip(docs, labels, strict=True):
            z = b + sum(w[i] * s for i, s in zip(index.tolist(), share.tolist(), strict=True))
            g = (1 / (1 + math.exp(-z)) - y) / len(docs)
            total += g
            for i, s in zip(index.tolist(), share.tolist(), strict=True):
                grad[i] += g * s
        for i in used:
            m[i], v[i] = 0.9 * m[i] + 0.1 * grad[i], 0.99 * v[i] + 0.01 * grad[i] ** 2
            w[i] -= 0.3 * (m[i] / (1 - 0.9**t)) / (math.sqrt(v[i] / (1 - 0.99**t)) + 1e-9)
        b -= 0.5 * total
    return w, b


def test_fit_against_plain_python():
    r = random.Random(6)
    docs, labels = [], []
    for k in range(12):
        index = np.array(sorted(r.sample(range(40), 6)) + [2 * q.BUCKETS + k % 3], np.int32)
        docs.append((index, np.array([*(r.random() for _ in range(6)), 1.0], np.float32)))
        labels.append(r.choice((0.02, 0.3, 0.97)))
    w, b = q.fit(docs, np.array(labels))
    by_hand, own_b = fitted_by_hand(docs, labels)
    assert abs(b - own_b) < 1e-6 and all(abs(w[i] - x) < 1e-6 for i, x in by_hand.items())
    assert set(np.flatnonzero(w).tolist()) <= set(by_hand)
    w, b = q.fit([], np.empty(0))
    assert not w.any() and b == 0


class Held:
    def __init__(self, value):
        self.value = value


def scored_by_hand(text, w, b, reader):
    """Words found by a regex and hashed one by one; each adds its weight and that of its shape."""
    words = re.findall(rb"[^\x20\x09-\x0d]+", text)
    z, n = b, len(words)
    for word in words:
        one = q.Read(word, reader)
        assert len(one.hashes) == 1
        top = 64 - q.BUCKETS.bit_length() + 1
        z += (w[int(one.hashes[0]) >> top] + w[q.BUCKETS + (int(one.shapes[0]) >> top)]) / (n + q.SMOOTH)
    # a word in either case is one word
    counts = collections.Counter(word.lower() for word in words)
    length = sum(n >= k for k in (1, 5, 20, 50, 200, 1000))
    distinct, most = 10 * len(counts) // max(1, n), 10 * max(counts.values(), default=0) // max(1, n)
    z += w[2 * q.BUCKETS + 11 * length + distinct] + w[2 * q.BUCKETS + 100 + 11 * length + most]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_scores_against_plain_python(spark):
    docs = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()][:60]
    texts = [t.encode() for t in docs] + [b"", b" \n\t", "É ü 💡 ÀÀÀ".encode(), b"Word word WORD " * 40, b"x" * 5000 + b" y", b"a-b_c!!! ... 12ab34"]
    r = np.random.default_rng(8)
    w, b = r.normal(0, 1, 2 * q.BUCKETS + 200), 0.25
    got = next(q._scores(Held((w, b)))(iter([pa.array([t.decode() for t in texts])]))).to_pylist()
    reader = q.Reader()
    for text, score in zip(texts, got, strict=True):
        assert abs(score - scored_by_hand(text, w, b, reader)) < 1e-9, text[:80]
