"""Ties, shared turns and long values: fifty random inputs each against a plain version; models against plain ones."""

import itertools
import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tallyworks.llm import decontaminate, ngram_join, personal_data, quality_vote, quotations, secret_forest, toxicity

from .cases import frame


# Decontamination: of ties the first place counts


def test_first_place_of_items_held_twice():
    r = random.Random(2)
    for trial in range(50):
        item = " ".join(r.choice("abcdefgh") * 3 + str(r.randrange(9)) for _ in range(12))
        gaps = [" ".join(r.choice("xyz") * 4 for _ in range(r.randrange(40))) for _ in range(4)]
        text = f"{gaps[0]} {item} {gaps[1]} {item} {gaps[2]} {item} {gaps[3]}"
        match = decontaminate.Matcher([(1, item)], decontaminate.MatchParams())
        clean = decontaminate.normalised(text)
        wanted = decontaminate.normalised(item)
        assert match(text) == [(1, 0, clean.index(wanted) + len(wanted))], trial


# Quality votes: of ties the smaller number


def test_nearest_rows_of_ties():
    r = np.random.default_rng(4)
    for trial in range(50):
        near = np.round(r.integers(-3, 4, (7, int(r.integers(1, 60)))) / 7, quality_vote.COSINE_DIGITS)
        k = int(r.integers(1, 20))
        want = [sorted(sorted(range(near.shape[1]), key=lambda i: (-row[i], i))[:k]) for row in near]
        assert quality_vote.nearest(near, k).tolist() == want, trial


# Quotations: threads by row


def plain_threads(messages):
    """(turn, parent_turn, root_turn, depth) of the messages (turn, text) of one conversation, whole quotes only."""
    parsed = []
    for turn, text in messages:
        runs = []
        for line in text.split("\n"):
            marks, rest = re.match(r"(>*) ?(.*)", line).groups()
            if runs and runs[-1][0] == len(marks) and rest and runs[-1][1]:
                runs[-1][1].append(rest)
            else:
                runs.append((len(marks), [rest] if rest else []))
        parsed.append((turn, [(n, " ".join(x).lower()) for n, x in runs if x]))
    first = {}
    for i, (turn, runs) in sorted(enumerate(parsed), key=lambda x: (x[1][0], x[0])):
        for n, text in runs:
            if n == 0:
                first.setdefault(text, (turn, i))
    parent = {}
    for i, (turn, runs) in enumerate(parsed):
        found = [(-n, first[t]) for n, t in runs if n and t in first and first[t][0] < turn]
        if found:
            parent[i] = max(found)[1]
    out = []
    for i, (turn, _) in enumerate(parsed):
        at, depth = i, 0
        while at in parent:
            at, depth = parent[at][1], depth + 1
        out.append((turn, parent[i][0] if i in parent else None, parsed[at][0], depth))
    return sorted(out, key=str)


def test_threads_of_random_conversations_with_shared_turns(spark):
    r = random.Random(9)
    talks = []
    for _ in range(50):
        said, messages = [], []
        for i in range(r.randrange(2, 12)):
            lines = []
            for _ in range(r.choice((0, 0, 1, 1, 2))):
                if said:
                    lines += [">" * r.randint(1, 3) + " " + r.choice(said), ""]
            own = r.choice(said) if said and r.random() < 0.15 else f"own words number {r.randrange(10**6)} said here in full"
            said.append(own)
            messages.append((r.randrange(i // 2 + 1), "\n".join([*lines, own])))
        talks.append(messages)
    rows = [(c, turn, "user", text) for c, messages in enumerate(talks) for turn, text in messages]
    got = defaultdict(list)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    for x in quotations.linked_conversations(df).collect():
        got[x.conv_id].append((x.turn, x.parent_turn, x.root_turn, x.depth))
    for c, messages in enumerate(talks):
        assert sorted(got[c], key=str) == plain_threads(messages), messages


def test_a_message_without_quotes_keeps_its_own_thread_in_a_shared_turn(spark):
    rows = [(1, 0, "a", "the first thing that was said here"), (1, 1, "b", "> the first thing that was said here\n\nyes indeed it was"), (1, 1, "c", "no quote here at all")]
    got = {x.body: (x.parent_turn, x.root_turn, x.depth) for x in quotations.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {"the first thing that was said here": (None, 0, 0), "yes indeed it was": (0, 0, 1), "no quote here at all": (None, 1, 0)}


# Secrets: values of any length, trees against their model


@pytest.fixture(scope="module")
def findings(spark):
    return secret_forest.labelled_findings(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), secret_forest.ForestParams(sample=300)).cache()


def test_values_of_any_length(spark, findings):
    phrase = "correct horse battery staple " * 10 + "upon 9"
    data = [(1, f'password = "{phrase}"', phrase), (2, f'password = "{phrase * 50}"', phrase * 50), (3, "secret: " + "Zx81kq0a" * 5000 + " end", "Zx81kq0a" * 5000),
            (4, "password_for_the_shop_and_its_production_database = Zx81kq0aPQ", "Zx81kq0aPQ")]
    df = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    got = {x.doc_id: (x.start, x.end) for x in secret_forest.secrets(df, findings=findings).collect()}
    assert got == {i: (t.index(v), t.index(v) + len(v)) for i, t, v in data}


def test_long_runs_of_pieces_are_one_candidate(spark):
    run = "&".join("k3" for _ in range(20_000))
    got = spark.createDataFrame([(f"see {run} end",)], "text string").select(secret_forest.candidates(F.col("text"))["c"]).first()[0]
    assert got == [run]


def test_class_samples_are_bounded_and_balanced(spark):
    docs = spark.createDataFrame([(i, f"token = a{i}b{i * 7} and plainwordsinonerun{'x' * (i % 50)}") for i in range(400)], "doc_id long, text string")
    own = secret_forest.labelled_findings(docs, secret_forest.ForestParams(sample=30)).join(secret_forest.example_findings(spark).select("c"), "c", "left_anti")
    counts = {x.label: x["count"] for x in own.groupBy("label").count().collect()}
    assert counts == {1.0: 30, 0.0: 30}


def test_column_trees_vote_as_the_model(spark, findings):
    params = secret_forest.ForestParams(trees=5)
    trees = secret_forest.train(findings, params)
    rows = VectorAssembler(inputCols=list(secret_forest.NAMES), outputCol="features").transform(findings.select("label", *secret_forest.NAMES, "c")).orderBy("label", "c").coalesce(1)
    model = RandomForestClassifier(numTrees=params.trees, maxDepth=params.depth, seed=params.seed).fit(rows)
    each = rows.withColumn("f", F.struct(*secret_forest.NAMES)).withColumn("ours", secret_forest.votes(trees, F.col("f")))
    for x in each.collect():
        assert x.ours == pytest.approx(sum(t.predict(x.features) for t in model.trees) / params.trees)


# Toxicity: coordinates and regression against dictionaries


def test_grams_are_words_neighbours_and_skips():
    texts = ["You are BAD, bad!", "", "one", "é b c d"]
    at, code = toxicity.grams(texts, 40)
    single = {w: toxicity.grams([w], 40)[1][0] for t in texts for w in re.findall(r"[^\W\d_]+", t.lower())}
    pair = lambda a, b, gap: toxicity.grams([f"{a} {b}" if gap == 1 else f"{a} q {b}"], 40)[1]
    for i, t in enumerate(texts):
        ws = re.findall(r"[^\W\d_]+", t.lower())
        want = [single[w] for w in ws]
        want += [pair(a, b, 1)[2] for a, b in zip(ws, ws[1:])]
        want += [pair(a, b, 2)[5] for a, b in zip(ws, ws[2:])]
        assert sorted(code[at == i].tolist()) == sorted(int(w) for w in want)


def plain_ftrl(rows, p):
    seen = defaultdict(int)
    for x, _ in rows:
        for c in x:
            seen[c] += 1
    z, n = defaultdict(float), defaultdict(float)

    def weight(c):
        bar = 0.0 if c == "bias" else p.l1
        if abs(z[c]) <= bar:
            return 0.0
        return -(z[c] - math.copysign(bar, z[c])) / ((p.beta + math.sqrt(n[c])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for x, y in rows:
            on = [*(c for c in x if seen[c] >= p.seen_in), "bias"]
            w = {c: weight(c) for c in on}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for c in on:
                z[c] += g - (math.sqrt(n[c] + g * g) - math.sqrt(n[c])) / p.alpha * w[c]
                n[c] += g * g
    return weight("bias"), {c: weight(c) for c in seen if weight(c)}


def test_regression_equals_a_plain_one():
    r = random.Random(6)
    for trial in range(10):
        p = toxicity.FtrlParams(bits=8, l1=r.choice((0.0, 0.3, 2.0)), epochs=3)
        rows = []
        for _ in range(80):
            x = sorted(r.sample(range(60), r.randrange(0, 9)))
            rows.append((np.array(x, np.int64), int(any(c < 5 for c in x) or r.random() < 0.1)))
        got = toxicity.fit(rows, p)
        bias, weights = plain_ftrl([(x.tolist(), y) for x, y in rows], p)
        assert got.bias == pytest.approx(bias)
        assert dict(zip(got.index.tolist(), got.value.tolist())) == pytest.approx(weights)


def test_rare_coordinates_are_left_out_before_they_are_gathered(spark):
    docs = spark.createDataFrame([(i, f"bad word{chr(97 + i % 7)} only{'abcdefghij'[i % 10] * (i + 1)}" if i % 2 else f"fine word{chr(97 + i % 7)}") for i in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    params = toxicity.FtrlParams(l1=0.5)
    got = toxicity.train(docs, labels, params)
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    at, code = toxicity.distinct_grams([t for _, t in texts], params.bits)
    order = np.argsort(toxicity.mix(np.arange(60).astype(np.uint64)), kind="stable")
    want = toxicity.fit([(code[at == i], int(i) % 2) for i in order], params)
    assert got.bias == pytest.approx(want.bias) and got.index.tolist() == want.index.tolist() and got.value == pytest.approx(want.value)


# Personal data: messages against exact marginals


def exact(g, f):
    k = personal_data.NONE + 1
    own = g.x @ f.unary
    total = np.zeros((len(g.label), k))
    for labels in itertools.product(range(k), repeat=len(g.label)):
        if any(have < personal_data.NONE and have != y for have, y in zip(g.label, labels)):
            continue
        score = sum(0.0 if g.label[u] < personal_data.NONE else own[u, y] for u, y in enumerate(labels))
        score += sum(f.chain[labels[a], labels[b]] for a, b in g.chain) + sum(f.skip[labels[a], labels[b]] for a, b in g.skip)
        for u, y in enumerate(labels):
            total[u, y] += math.exp(score)
    return total / total.sum(axis=1, keepdims=True)


def test_beliefs_on_trees_are_exact_marginals():
    r = np.random.default_rng(3)
    k, width = personal_data.NONE + 1, 3
    for _ in range(10):
        n = 5
        edges = np.array([(int(r.integers(0, i)), i) for i in range(1, n)])
        cut = int(r.integers(0, n))
        label = np.where(r.random(n) < 0.3, r.integers(0, personal_data.NONE, n), personal_data.NONE)
        g = personal_data.Graph(np.zeros(n, np.int64), np.zeros((n, 2), np.int64), label, r.normal(size=(n, width)), edges[:cut].reshape(-1, 2), edges[cut:].reshape(-1, 2))
        skip = r.normal(size=(k, k))
        f = personal_data.Field(r.normal(size=(width, k)), r.normal(size=(k, k)), skip + skip.T)
        got = personal_data.beliefs(g, f, personal_data.FieldParams(rounds=60))
        assert np.allclose(got, exact(g, f), atol=1e-6)


def test_training_takes_documents_in_hash_order(spark):
    docs = spark.createDataFrame([(i, f"mail a{i}@b{i}.org or call +49 30 {1000000 + i} now") for i in range(200)], "doc_id long, text string")
    few = personal_data.FieldParams(units=60)
    a, b = personal_data.train(docs, few), personal_data.train(docs.repartition(7, "text"), few)
    assert np.allclose(a.unary, b.unary)
    assert personal_data.spans(frame(spark), a).count() == frame(spark).count()


def test_one_row_of_each_component_stays(spark):
    """Rows that share an id, lack one or repeat, against a choice row by row."""
    r = random.Random(31)
    bases = [" ".join(f"w{b}x{i}" for i in range(60)) for b in range(6)]
    texts = [*bases, *(b.replace("x5 ", "y5 ", 1) for b in bases), "", None, " \n"]
    data = [(r.choice((None, 1, 2, 3, 4, 5)), r.choice(texts), r.choice(("en", "de")), r.choice((None, "s")), i % 2) for i in range(80)]
    data += [(None, "only without id " * 9, "en", None, 0)] * 2
    docs = frame(spark, data)
    got = sorted(map(repr, map(tuple, ngram_join.one_of_each(docs, ngram_join.JoinParams(words=5, percent=80)).collect())))
    code = {row.text: row.h for row in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    groups: dict = {}
    want = []
    for row in data:
        if not (row[1] or "").split():
            want.append(repr(row))
            continue
        groups.setdefault(min(x for x in texts + [row[1]] if x and len(set(x.split()) ^ set(row[1].split())) <= 2), []).append(row)
    least = lambda row: (row[0] is None, row[0] or 0, code[row[1]], row[2], row[3] is not None, row[3] or "", row[4])
    want += [repr(min(rows, key=least)) for rows in groups.values()]
    assert got == sorted(want)
    assert len(groups) == 7


def moved_texts(df) -> int:
    """Rows with a text that exchanges carried when df was collected."""
    def walk(plan) -> int:
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(plan.plan())
        own = plan.metrics().apply("shuffleRecordsWritten").value() if kind == "ShuffleExchangeExec" and "text#" in plan.output().toString() else 0
        return own + sum(walk(plan.children().apply(i)) for i in range(plan.children().size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_texts_without_copies_do_not_move(spark):
    """Where nothing is small enough for Spark to broadcast, only rows that may go are joined to the decisions."""
    data = [(i if i % 7 else None, " ".join(f"w{i}x{j}" for j in range(30)), "en", None, i) for i in range(400)]
    data += [(1000 + i, data[i][1] + " end", "en", None, i) for i in range(20)] + [data[5], data[7]]
    docs = frame(spark, data)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ngram_join.one_of_each(docs, ngram_join.JoinParams(words=5, percent=80))
        assert moved_texts(out) <= 100
        got = sorted(map(repr, map(tuple, out.collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    gone = {0, 7, 14}  # rows without an id go before their copies with one
    stay = [row for i, row in enumerate(data[:400]) if i not in gone] + [row for row in data[400:420] if row[4] in gone]
    assert got == sorted(map(repr, stay))


@pytest.mark.parametrize("most", [1 << 27, 64])
def test_marks_miss_no_row(spark, monkeypatch, most):
    """Full bitmaps mark more rows, never fewer."""
    monkeypatch.setattr(ngram_join, "MARK_MOST", most)
    docs = spark.range(-3000, 3000).withColumn("code", F.xxhash64("id"))
    keys = docs.filter("id % 10 = 0").select(F.col("code").alias("key"))
    out = ngram_join.marked(docs, F.col("code"), keys, F.col("key"))
    assert out.columns == ["id", "code", "_marked"] and out.count() == 6000
    assert out.filter("id % 10 = 0 and not _marked").count() == 0
    others = out.filter("id % 10 != 0 and _marked").count()
    assert others > 5000 if most == 64 else others <= 400
    assert ngram_join.marked(docs, F.col("code"), keys.limit(0), F.col("key")).filter("_marked").count() == 0
