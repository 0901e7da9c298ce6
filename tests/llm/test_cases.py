"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest

from tallyworks.llm import decontaminate, ngram_join, personal_data, piece_codec, quality_vote, quotations, rule_ledger, secret_forest, toxicity, warc
from tallyworks.session import scratch_path

from .cases import frame, clashing, rows


def labels(df, name="label"):
    from pyspark.sql import functions as F

    return df.select("doc_id", (F.coalesce(F.col("doc_id"), F.lit(0)) % 2).cast("int").alias(name))


def items(spark):
    return spark.createDataFrame([(1, "tie tie tie"), (2, None), (3, ""), (None, "x"), (1, "tie tie tie")], "item_id long, text string")


PER_ROW = {
    "ledger": lambda s, d: rule_ledger.ledger(d).select("doc.doc_id", "n_words", "fail_bits"),
    "join": lambda s, d: ngram_join.join_components(d),
    "codec": lambda s, d: piece_codec.encoded(d),
    "personal": lambda s, d: personal_data.spans(d, personal_data.train(d)),
    "vote": lambda s, d: quality_vote.scored(d, quality_vote.train(d, labels(d))),
    "toxicity": lambda s, d: toxicity.scored(d, toxicity.train(d, labels(d))),
}
SUBSET = {
    "secrets": lambda s, d: secret_forest.secrets(d),
    "contamination": lambda s, d: decontaminate.contamination(d, items(s)),
}
SAME_COLUMNS = {
    "kept": lambda s, d: rule_ledger.kept_documents(d),
    "one of each": lambda s, d: ngram_join.one_of_each(d),
    "clean": lambda s, d: decontaminate.clean_documents(d, items(s)),
    "redacted": lambda s, d: secret_forest.redacted(d),
}


def plain(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_has_a_result(spark, name):
    got = PER_ROW[name](spark, frame(spark))
    found = [r[0] for r in got.collect()]
    assert sorted(map(str, found)) == sorted(str(r[0]) for r in rows())


@pytest.mark.parametrize("name", [*PER_ROW, *SUBSET, *SAME_COLUMNS])
def test_empty_table(spark, name):
    run = (PER_ROW | SUBSET | SAME_COLUMNS)[name]
    assert run(spark, frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", ["ledger", "join", "personal", *SUBSET])
def test_clashing_columns_change_nothing(spark, name):
    run = (PER_ROW | SUBSET)[name]
    docs = frame(spark)
    assert plain(run(spark, docs)) == plain(run(spark, clashing(docs)))


@pytest.mark.parametrize("name", SAME_COLUMNS)
def test_stages_keep_all_columns(spark, name):
    docs = clashing(frame(spark))
    got = SAME_COLUMNS[name](spark, docs)
    assert got.columns == docs.columns
    assert {r["score"] for r in got.collect()} == {"own score"}


@pytest.mark.parametrize("name", ["vote", "toxicity"])
def test_without_labels(spark, name):
    docs = frame(spark)
    module = {"vote": quality_vote, "toxicity": toxicity}[name]
    got = module.scored(docs, module.train(docs, labels(docs).limit(0)))
    assert {round(r.score, 6) for r in got.collect()} == {0.5}


@pytest.mark.parametrize("name", ["vote", "toxicity"])
def test_null_labels_are_left_out(spark, name):
    docs = frame(spark)
    module = {"vote": quality_vote, "toxicity": toxicity}[name]
    told = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, label int")
    assert {round(r.score, 6) for r in module.scored(docs, module.train(docs, told)).collect()} == {0.5}


def test_archives_of_awkward_pages(spark):
    data = [(1, None, None), (2, "http://a b\r\nc", "<p>é😀</p>"), (3, "u", "z" * 100_000), (4, "u", "z" * 100_000), (5, None, ""), (6, "v", "WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n0\r\n\r\n")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    folder = scratch_path(spark, "pages")
    warc.write(clashing(pages), folder)
    got = {r.page_id: r for r in warc.read(spark, folder).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 5), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    assert [got[i].payload_bytes for i in range(1, 7)] == [len((x[2] or "").encode()) for x in data]
    assert all(got[i].payload_digest == warc.base32_digest((data[i - 1][2] or "").encode()) for i in got)


def test_archives_of_repeated_and_missing_page_ids(spark):
    long_, held = "z" * 100_000, "<p>held</p>"
    data = [(7, "u", long_), (7, "u", long_), (3, "v", long_), (7, "u", "other"), (None, "w", long_), (None, "w", "alone"), (None, "x", "alone"), (8, "a", held), (8, "b", held), (8, "b", held), (2, "c", held), (2, "c", held)]
    folder = scratch_path(spark, "pages")
    warc.write(spark.createDataFrame(data, "page_id long, url string, html string").repartition(3), folder)
    stored = warc.read_records(spark, folder)
    assert stored.select("id").distinct().count() == stored.count()
    got = sorted(map(repr, (tuple(r) for r in warc.read(spark, folder).collect())))
    want = [(i, "response" if (i, h) in ((7, long_), (7, "other"), (8, held), (None, "alone")) else "revisit", 7 if h == long_ else 8, h) for i, _, h in data]
    assert got == sorted(repr((i, len(h), warc.base32_digest(h.encode()), kind, top if kind == "revisit" else None)) for i, kind, top, h in want)


def test_no_pages(spark):
    folder = scratch_path(spark, "pages")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read(spark, folder).count() == 0


def test_messages_with_nulls_and_repeats(spark):
    data = [(1, 0, "user", "Hi"), (1, 0, "user", "Hi"), (1, 1, None, None), (None, 0, "user", "> Hi\nx"), (1, None, "user", "> Hi\ny"), (2, 0, "user", "")]
    got = quotations.linked_conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string"))
    assert got.count() == len(data)
    assert sorted(r.position for r in got.filter("conv_id = 1").collect()) == [1, 2, 3, 4]
    assert quotations.linked_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
