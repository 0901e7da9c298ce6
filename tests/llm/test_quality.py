"""Terms, axes and votes of the quality classifier against plain versions."""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import quality_vote as q
from tests.llm.brute import LOWER, WORD, auc
from tests.llm.cases import rows


def plain_terms(text: str) -> dict[int, float]:
    """Weights of one text by counting; words are named by what the hasher gives for them alone."""
    out: dict[int, float] = {}
    shape = q.shapes()
    runs = [k for k, _ in groupby(int(shape[ord(c)]) for c in text + "\n")]
    tri = Counter(a * q.SHAPES**2 + b * q.SHAPES + c for a, b, c in zip(runs, runs[1:], runs[2:]))
    out |= {t: math.sqrt(c / tri.total()) for t, c in tri.items()}
    words = [w.translate(LOWER) for w in WORD.findall(text)]
    lines = [tuple(w.translate(LOWER) for w in re.split(r"[\x20\x09\x0B-\x0D]", line)) for line in text.split("\n") if WORD.search(line)]
    lines = [tuple(line[next(i for i, w in enumerate(line) if w):]) for line in lines]
    while_ends = [line[: max(i for i, w in enumerate(line) if w) + 1] for line in lines]
    five = [tuple(words[i: i + 5]) for i in range(len(words) - 4)]
    again = lambda xs: sum(c - 1 for c in Counter(xs).values())
    shares = (again(words) / max(len(words), 1), sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1),
              again(five) / max(len(words), 1), again(while_ends) / max(len(lines), 1))
    out |= {q.TRIGRAMS + i: math.sqrt(s) for i, s in enumerate(shares) if s}
    out[q.TRIGRAMS + q.REPEATS + min(int(math.log2(len(words) + 1)), q.LENGTHS - 1)] = 0.3
    for w, c in Counter(int(q.hasher()([w])[0][0] % np.uint64(q.WORD_TERMS)) for w in words).items():
        out[q.FORMS + w] = math.sqrt(c / len(words))
    return out


def matrix(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), q.TERMS), np.float32)
    at, term, weight = q.terms(texts)
    x[at, term] = weight
    return x


def test_terms_equal_plain_counts():
    r = random.Random(5)
    texts = [t or "" for _, t, *_ in rows()] + ["".join(r.choice("aB 7\n.#é") for _ in range(r.randrange(80))) for _ in range(60)]
    x = matrix(texts)
    for i, text in enumerate(texts):
        want = plain_terms(text)
        assert set(np.flatnonzero(x[i]).tolist()) == set(want), i
        assert all(abs(x[i, t] - w) < 1e-5 for t, w in want.items()), i


def test_rarity_of_words():
    texts = ["common rare", "common rare", "common once", "common", "common"]
    s = q.scales(matrix(texts), q.VoteParams(forms=0.5, words=2.0))
    at = lambda w: q.FORMS + int(q.hasher()([w])[0][0] % np.uint64(q.WORD_TERMS))
    assert s[at("rare")] == pytest.approx(2) and s[at("common")] == 0 and s[at("once")] == 0 and set(s[: q.FORMS]) == {0.5}


@pytest.mark.parametrize("groups", [(1.0, 0.0), (0.0, 1.0), (1.0, 1.0)])
def test_axes_span_those_of_a_full_decomposition(groups):
    r = random.Random(8)
    topics = [[f"{c}{i}" for i in range(6)] for c in "abcd"]
    texts = [" ".join(r.choice(topics[j % 4]) for _ in range(40)) + "!#\n.;"[j % 5] * (j % 3) for j in range(80)]
    p = q.VoteParams(forms=groups[0], words=groups[1], axes=4)
    x = matrix(texts)
    space = q.fit(x.copy(), np.zeros(80), p)
    scaled = x * q.scales(x, p)
    u, s, v = np.linalg.svd(scaled, full_matrices=False)
    # Same best approximation of rank 4 by the projections, whatever the signs of the axes.
    mine = x @ space.axes
    assert np.linalg.norm(mine) ** 2 == pytest.approx((s[:4] ** 2).sum(), rel=1e-2)
    assert np.allclose(q.unit(mine), space.vectors, atol=1e-4)


def test_wording_alone_decides(spark):
    """Texts of one form, whose words alone tell the classes apart, held out."""
    r = random.Random(21)
    good, bad = (["".join(r.choice(letters) for _ in range(6)) for _ in range(40)] for letters in ("aeioubcd", "aeiouxyz"))
    data = [(i, " ".join(r.choice((good, bad)[i % 2] if r.random() < 0.5 else good + bad) for _ in range(30))) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = docs.filter("doc_id < 300").select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("label"))

    def area(p: q.VoteParams) -> float:
        got = {row.doc_id: row.score for row in q.scored(docs, q.train(docs, labels, p), p).collect()}
        return auc([1 - i % 2 for i in range(300, 400)], [got[i] for i in range(300, 400)])

    assert area(q.VoteParams()) > 0.95
    assert area(q.VoteParams(words=0.0)) < 0.75


def test_each_group_of_terms_tells_the_labels_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    known = labels.filter(~out).select("doc_id", F.col("quality").alias("label"))
    for p, least in ((q.VoteParams(words=0.0), 0.97), (q.VoteParams(forms=0.0), 0.85), (q.VoteParams(), 0.97)):
        got = q.scored(docs, q.train(docs, known, p), p).join(labels.filter(out), "doc_id").filter("quality is not null").select("quality", "score").collect()
        assert auc([row.quality for row in got], [row.score for row in got]) > least, p
