"""Small inputs with the awkward cases every operator has to take."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

# Names that operators use inside; docs may have columns of the same name.
CLASHING = ("n_words", "doc", "_text", "score", "n", "u", "sig", "node", "tokens", "component", "part", "base", "fail_bits", "item_id", "c", "start")


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(("alpha", "beta", "gamma", "delta", "omega", "zeta", "theta", "iota", "kappa", "of", "the", "and")) + str(r.randrange(40)) for _ in range(n))


def rows() -> list[tuple]:
    """(doc_id, text, ...): nulls, empties, spaces, repeats, near copies, one very long text."""
    r = random.Random(3)
    base = sentence(r, 120)
    near = base.replace("alpha", "alpho", 1)
    long_ = "\n".join(sentence(r, 40) for _ in range(1500))
    texts = [None, "", " \t\n ", "one", "two words", "one", base, near, base, base.upper(), long_, "x" * 60_000, "é😀 ünï\x00 café", sentence(r, 9), sentence(r, 10),
             "\n".join(["same line of text here"] * 30), "# $ % & | < > * " * 20, "tie tie tie", "tie tie tie", sentence(r, 200), sentence(r, 64)]
    out = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, (6, base, None, None, None), (None, base, "en", None, 1), (None, None, None, None, None), (-5, sentence(r, 30), "de", "src1", 7)]


def frame(spark, data: list[tuple] | None = None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))
