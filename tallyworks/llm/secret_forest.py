"""Secret scan whose false positives a random forest removes.

Candidates are values assigned to key words, at any length, tokens of known forms, and long runs of key characters,
also where single marks break them. Each gets features of its length, character transitions, dictionary
coverage, path and neighbouring words; the forest, trained on labelled findings, votes. The trees become one column
expression, so all candidates of a text are judged where the text lies. DataFrame functions only.
"""

from __future__ import annotations

import random
import re
import string
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable
from .common import hash_sample, text_column
from .rule_ledger import bind

# Common fragments of the four languages; what they cover of a candidate is dictionary coverage.
FRAGMENTS = ("the", "and", "ing", "tion", "ent", "her", "for", "ver", "are", "ere", "ion", "ter", "est", "ati", "hat", "ate", "all", "eth", "his", "ich", "der", "die",
             "und", "ein", "sch", "che", "keit", "heit", "lich", "ung", "gen", "ber", "les", "que", "eau", "elle", "ment", "our", "tre", "eux", "aux", "pas", "los", "las",
             "del", "con", "par", "ado", "nte", "ara", "mos", "ble", "onn", "ness", "able")
KEY_WORDS = "token|secret|passw|pwd|api|auth|key|bearer|credential|private|access"
HASH_WORDS = "commit|sha|md5|hash|digest|checksum|revision|etag|tree|uuid|guid"
# Public forms of issued tokens; the first has dotted segments.
KNOWN = (r"eyJ[A-Za-z0-9_-]{6,}(?:\.[A-Za-z0-9_-]{2,}){1,4}", r"SG\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])", r"gh[opsur]_[A-Za-z0-9]{20,}",
         r"xox[abprs]-[A-Za-z0-9-]{10,}", r"(?:sk|pk|rk)[_-](?:live|test|proj)[_-][A-Za-z0-9_-]{8,}", r"AIza[A-Za-z0-9_-]{30,}", r"glpat-[A-Za-z0-9_-]{16,}")
# The part before a value that is assigned to a key word; its short checks spare most positions the rest. What may
# stand before a match has to be bounded: names go on for 64 characters after the key word, gaps are 4 wide.
_ASSIGNED = rf"(?<=[=:\s\"'])(?<=[=:]\s{{0,4}}[\"']?)(?<=(?i:{KEY_WORDS})[A-Za-z0-9_-]{{0,64}}[\"']?\s{{0,4}}[=:]\s{{0,4}}[\"']?)"
# Repeated groups are recursion in the pattern engine, so what follows the first 64 pieces of a run is one class of characters.
_RUN, _EDGE, _LONG = "[A-Za-z0-9_/+-]", "[&!~.](?=[A-Za-z0-9])", "[A-Za-z0-9_/+&!~.-]"
CANDIDATE = "|".join((
    rf"{_ASSIGNED}(?<=[\"'])[^\"'\r\n]++(?=[\"'])",
    rf"{_ASSIGNED}[^\s\"'`<>,;(){{}}\[\]]*[^\s\"'`<>,;(){{}}\[\].:?=]",
    rf"(?<![A-Za-z0-9])(?:{'|'.join(KNOWN)})",
    rf"(?<!{_RUN})(?=(?:{_RUN}|{_EDGE}){{16}}){_RUN}+(?:{_EDGE}{_RUN}+){{0,64}}(?:{_EDGE}{_LONG}+(?<={_RUN}))?(?:={{1,2}}(?![A-Za-z0-9\"']))?",
))
UUID = "^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
BLOCK = 256


@dataclass(frozen=True)
class ForestParams:
    """sample bounds the labelled findings of each class that train the forest."""

    sample: int = 2000
    trees: int = 15
    depth: int = 5
    seed: int = 7
    threshold: float = 0.5


def figures() -> dict[str, Column]:
    """The features of a candidate as columns of its row."""
    return {name: F.col(name) for name in NAMES}


def share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1))


def features(c: Column, before: Column, after: Column) -> dict[str, Column]:
    """Figures of one candidate with the text before and after it."""
    n = F.length(c)
    left = lambda pattern: share(F.length(F.regexp_replace(c, pattern, "")), n)
    near = F.lower(before)
    return {
        "length": n.cast("double"),
        "digits": 1 - left("[0-9]"),
        "capitals": 1 - left("[A-Z]"),
        "beyond_hex": left("[0-9a-fA-F]"),
        "letter_digit": share(F.regexp_count(c, F.lit("[A-Za-z](?=[0-9])")), n),
        "vowel_change": share(F.regexp_count(F.lower(c), F.lit("[aeiou](?=[b-df-hj-np-tv-z])")), n),
        "distinct": share(F.size(F.array_distinct(F.split(c, ""))), n),
        "dictionary": 1 - share(F.length(F.regexp_replace(F.lower(c), "|".join(sorted(FRAGMENTS, key=len, reverse=True)), "")), n),
        "slashes": share(F.regexp_count(c, F.lit("/")), n),
        "in_path": (F.contains(c, F.lit("//")) | c.rlike(r"^/|/.*[._-][a-z]{1,5}$") | near.rlike(r"(https?:|[./@])$") | after.rlike(r"^[.@][a-z]")).cast("double"),
        "assigned": before.rlike(r"[=:]\s*[\"']?$").cast("double"),
        "quoted": (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("double"),
        "key_word": near.rlike(rf"(?:{KEY_WORDS})[a-z_]*[^a-z]{{0,8}}$").cast("double"),
        "known": c.rlike(rf"^(?:{'|'.join(KNOWN)})$").cast("double"),
        "uuid": c.rlike(UUID).cast("double"),
        "hash_size": c.rlike("^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$").cast("double"),
        "hash_word": near.rlike(rf"(?:{HASH_WORDS})[a-z0-9_-]*[^a-z0-9]{{0,8}}$").cast("double"),
        "marks": left("[A-Za-z0-9]"),
    }


NAMES = ("length", "digits", "capitals", "beyond_hex", "letter_digit", "vowel_change", "distinct", "dictionary", "slashes", "in_path", "assigned", "quoted", "key_word", "known", "uuid", "hash_size", "hash_word", "marks")


def running(lengths: Column) -> Column:
    """Sums of all earlier entries, block by block so that arrays of any size stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / BLOCK).cast("int")), lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))
    def within(before: Column) -> Column:
        return F.transform(lengths, lambda x, i: F.get(before, F.floor(i / BLOCK).cast("int")) + total(F.slice(lengths, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))
    return bind(blocks, lambda bs: bind(F.transform(bs, lambda x, i: total(F.slice(bs, F.lit(1), i))), within))


def candidates(text: Column) -> Column:
    """array<struct<c, gap, start, features...>> of a text; gap is the text between the candidate and the one before."""
    def build(found: Column, gaps: Column, starts: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            own = features(c, F.right(F.concat(F.coalesce(F.get(found, i - 1), F.lit("")), F.get(gaps, i)), F.lit(32)), F.left(F.get(gaps, i + 1), F.lit(2)))
            return F.struct(c.alias("c"), (F.get(starts, i) + F.length(F.get(gaps, i))).alias("start"), *(v.alias(k) for k, v in own.items()))
        return F.transform(found, one)

    def split(found: Column) -> Column:
        gaps = F.when(F.size(found) > 0, F.split(text, CANDIDATE, -1)).otherwise(F.array(text))
        return bind(gaps, lambda gaps: bind(running(F.transform(found, lambda c, i: F.length(c) + F.length(F.get(gaps, i)))), lambda starts: build(found, gaps, starts)))

    return bind(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), split)


def silver(c: Column | dict[str, Column]) -> Column:
    """The label of a finding without one of its own, else null.

    1: mixed characters assigned to a key word, tokens of known forms. 0: plain words and plain numbers (quoted words
    assigned to a key word are open), and unassigned UUIDs, hash sizes, what follows a hash word, and paths.
    """
    told = (c["assigned"] == 1) & (c["key_word"] == 1)
    dense = (c["digits"] > 0) & (c["digits"] < 1) & (c["distinct"] > 0.2)
    plain = (c["digits"] == 0) | (c["digits"] == 1)
    other = (c["uuid"] == 1) | (c["hash_size"] == 1) | (c["hash_word"] == 1) | (c["in_path"] == 1)
    return F.when((told & dense) | (c["known"] == 1), 1).when(plain & ~(told & (c["quoted"] == 1)), 0).when(other & ~told, 0)


def examples() -> list[tuple[float, str]]:
    """(label, text) with one candidate each: forms that a corpus may lack. The same in every run."""
    r, phrases = random.Random(20), random.Random(21)
    some = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    plain, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    word = lambda: "".join(r.choice(FRAGMENTS) for _ in range(r.randint(2, 4)))
    out: list[tuple[float, str]] = []
    for i in range(40):
        name, mark = r.choice(("token", "password", "api_key", "secret", "pwd", "auth_key", "private_key")), r.choice(("= ", "=", ": "))
        short = f"{word()[: r.randint(3, 7)].capitalize()}{r.choice('&!@#~.-_')}{r.randrange(10, 9999)}"
        out += [(1.0, f'{name} {mark}"{v}"') for v in (short, some(plain, r.randint(8, 14)), some(plain + "&!~.", r.randint(20, 40)), some(hexes, r.choice((32, 40, 64))))]
        out += [(1.0, f"{name}{mark}{v} and") for v in (some(plain + "!~&", 12) + "7a", some(plain, 32))]
        out += [(1.0, f"{word()} {v} {word()}") for v in (f"eyJ{some(plain, 20)}.{some(plain, 24)}.{some(plain, 12)}", f"AKIA{some('ABCDEFGHIJ234567', 16)}", f"ghp_{some(plain, 36)}")]
        out += [(1.0, f'{name}{mark}"{" ".join(phrases.choice(FRAGMENTS) + phrases.choice(FRAGMENTS) for _ in range(phrases.randint(4, 60)))} {phrases.randrange(99)}"')]
        out += [(1.0, f"{name}{mark.strip()}{short} then")]
        out += [(1.0, f"{word()} {some(plain, 3)}{r.randrange(100)}{some(plain, 14)}&{some(plain, 8)}!{some(plain, 9)}4 {word()}")]
        h = some(hexes, 32)
        out += [(0.0, f"{c} {v} {word()}") for c, v in (("commit", some(hexes, 40)), ("", some(hexes, 40)), (word(), some(hexes, r.choice((32, 64)))), ("sha256:", some(hexes, 64)), ("id", f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"))]
        out += [(0.0, v) for v in (f"see /usr/{word()}/{word()}{r.randrange(99)}/{word()}.py here", f"https://{word()}.org/{word()}/{word()}{r.randrange(9999)}/{word()}", f"the {word()}{word()}{word()}{word()} of", f"no {r.randrange(10 ** 17, 10 ** 18)} and", f"key: {word()} and")]
    return out


def example_findings(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(examples(), "label double, text string").coalesce(1)
    return rows.select("label", F.explode(candidates(F.col("text"))).alias("f")).select("label", *(F.col(f"f.{n}").alias(n) for n in (*NAMES, "c")))


def labelled_findings(docs: DataFrame, params: ForestParams) -> DataFrame:
    """(label, features) of at most params.sample findings of each class, chosen by hash over all documents, and the examples."""
    return labelled(docs.select(F.explode(candidates(text_column())).alias("f")).select("f.*"), params)


def labelled(found: DataFrame, params: ForestParams) -> DataFrame:
    """labelled_findings of candidates that were found before; one that comes several times counts once, with its smallest figures."""
    own = found.withColumn("label", silver(figures()).cast("double")).filter("label is not null")
    kept = durable(own.groupBy("label", "c").agg(F.min(F.struct(*NAMES)).alias("f")).select("label", "f.*", "c"))
    some = [hash_sample(kept.filter(F.col("label") == label), F.xxhash64("c"), "c", params.sample) for label in (0.0, 1.0)]
    return durable(some[0].unionByName(some[1]).unionByName(example_findings(found.sparkSession)))


def split_tree(text: str) -> list:
    """A tree's public description as nested (feature, threshold, below, above) and leaves."""
    lines = [x.strip() for x in text.split("\n") if re.match(r"\s*(If|Else|Predict)", x)]

    def read(at: int) -> tuple[object, int]:
        if m := re.match(r"Predict: ([0-9.]+)", lines[at]):
            return float(m[1]), at + 1
        feature, bound = re.match(r"If \(feature (\d+) <= ([-0-9.E]+)\)", lines[at]).groups()
        low, at = read(at + 1)
        high, at = read(at + 1)
        return (NAMES[int(feature)], float(bound), low, high), at

    return read(0)[0]


def train(findings: DataFrame, params: ForestParams) -> list:
    """Trees of a forest; a class without findings is taken from the examples."""
    findings = findings.select("label", *NAMES, "c")
    classes = {r[0] for r in findings.select("label").distinct().collect()}
    if len(classes) < 2:
        findings = findings.unionByName(example_findings(findings.sparkSession).filter(~F.col("label").isin(*classes) if classes else F.lit(True)))
    rows = VectorAssembler(inputCols=list(NAMES), outputCol="features").transform(findings).orderBy("label", "c").coalesce(1)
    model = RandomForestClassifier(numTrees=params.trees, maxDepth=params.depth, seed=params.seed).fit(rows)
    return [split_tree(t.toDebugString) for t in model.trees]


def votes(trees: list, f: Column | dict[str, Column]) -> Column:
    """Share of the trees that take the finding f for a secret."""
    def tree(node) -> Column:
        return F.lit(node) if isinstance(node, float) else F.when(f[node[0]] <= node[1], tree(node[2])).otherwise(tree(node[3]))

    return reduce(lambda a, b: a + b, map(tree, trees), F.lit(0.0)) / max(len(trees), 1)


def judged(found: Column, trees: list) -> Column:
    """(c, start, score) of every candidate in found."""
    return F.transform(found, lambda f: F.struct(f["c"].alias("c"), f["start"].alias("start"), votes(trees, f).alias("score")))


def secrets(docs: DataFrame, params: ForestParams = ForestParams(), findings: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, end, score) of every secret of every row; start and end in code points, end exclusive.

    findings holds labelled features (see labelled_findings) and defaults to those of docs; candidates are then stored,
    so that texts are searched once for learning and judging. Null and empty texts have none; repeated rows repeat
    theirs; a class without labelled findings is learned from the built-in examples.
    """
    found = docs.select("doc_id", F.explode(candidates(text_column())).alias("f")).select("doc_id", "f.*")
    if findings is None:
        found = durable(found)
        findings = labelled(found, params)
    scored = found.withColumn("score", votes(train(findings, params), figures())).filter(F.col("score") >= params.threshold)
    return scored.select("doc_id", F.col("start").cast("long").alias("start"), (F.col("start") + F.length("c")).cast("long").alias("end"), "score")


def redacted(docs: DataFrame, params: ForestParams = ForestParams(), mark: str = "[secret]", findings: DataFrame | None = None) -> DataFrame:
    """docs with every secret in text replaced by mark; n_chars, where there is one, follows the text.

    Without findings, rows are stored with their candidates, which costs one more copy of the texts on the shared folder
    and saves searching them again; only texts with a secret are then cut anew.
    """
    own = "found"
    while own.lower() in {c.lower() for c in docs.columns}:
        own += "_"
    rows = docs.withColumn(own, candidates(text_column()))
    if findings is None:
        rows = durable(rows)
        findings = labelled(rows.select(F.explode(own).alias("f")).select("f.*"), params)
    trees = train(findings, params)

    def rebuilt(gaps: Column, shown: Column) -> Column:
        return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(shown, i), F.lit("")))), "")

    def cut(found: Column) -> Column:
        shown = F.transform(found, lambda f: F.when(f["score"] >= params.threshold, F.lit(mark)).otherwise(f["c"]))
        return bind(F.split("text", CANDIDATE, -1), lambda gaps: bind(shown, lambda cs: rebuilt(gaps, cs)))

    text = bind(judged(F.col(own), trees), lambda found: F.when(F.exists(found, lambda f: f["score"] >= params.threshold), cut(found)).otherwise(F.col("text")))
    out = rows.withColumn("text", text).drop(own)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
