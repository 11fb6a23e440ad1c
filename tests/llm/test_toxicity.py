import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeseam.llm import toxicity as tox


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, old[j] + 1, old[j - 1] + (x != y)))
    return row[-1]


TERMS = {"idiot": 5.0, "moron": 6.0, "scum": 7.0, "idiots": 4.0, "disgustingly": 3.0, "loweischaft": 2.0}


@given(st.sampled_from(sorted(TERMS)), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("abdiorstm")), max_size=4), st.lists(st.integers(0, 12), max_size=2))
@settings(max_examples=500, deadline=None)
def test_automaton_is_edit_distance(term, put, drop):
    word = list(term)
    for at, c in put:
        word[min(at, len(word)) : min(at, len(word)) + at % 2] = [c]
    for at in drop:
        del word[at % max(1, len(word)) : at % max(1, len(word)) + 1]
    word = "".join(word)
    near = [(distance(word, t), -w, t) for t, w in TERMS.items() if distance(word, t) <= tox.radius(t)]
    want = (min(near)[2], min(near)[0]) if near else None
    assert tox.Automaton(TERMS).match(word) == want


def test_context_separates_quotation_from_abuse():
    m = tox.Model({"idiot": 5.0, "moron": 5.0}, {"idiom"}, -2.0)
    abuse, quote = m.score("you are an idiot today"), m.score('they wrote "an idiot" in the review')
    assert abuse > 0.9 and quote < 0.5
    assert m.score("you idjot and morron") > 0.7
    assert m.score("an idiom") == m.score("") == pytest.approx(1 / (1 + 2.718281828459045**2))
    assert m.score("idiot moron") > abuse


@pytest.fixture(scope="module")
def sf(spark):
    d = "/root/testdata/sf0.1"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_held_out_rows(spark, sf):
    docs, labels = sf
    got = tox.op8(docs, labels)
    r = got.join(labels, "doc_id").filter("held_out").agg(
        F.sum(F.expr("int(predicted = 1 and toxic = 1)")).alias("tp"), F.sum(F.expr("int(predicted = 1 and toxic = 0)")).alias("fp"), F.sum(F.expr("int(predicted = 0 and toxic = 1)")).alias("fn"), F.sum(F.expr("int(toxic = 0)")).alias("neg")
    ).first()
    assert r.tp / (r.tp + r.fn) >= 0.9 and r.fp / r.neg <= 0.02, r
    assert got.count() == docs.count()


def test_edges(spark, make_docs):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(0, 60)] + [(None, 1, 1), (3, 1, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    rng = random.Random(0)
    docs = make_docs([(i, " ".join(f"w{rng.randrange(40)}" for _ in range(9)) + (" scumbag" if i % 2 else ""), "s") for i in range(60)] + [(None, "scumbag", None), (61, None, "s"), (62, "", "s"), (1, "aa", "s")], extra=True)
    got = tox.op8(docs, labels)
    assert got.count() == 64 and got.filter("score < 0 or score > 1 or score is null").count() == 0
    assert got.filter("doc_id is null").first().predicted == 1 and got.filter("doc_id = 61").first().predicted == 0
    kept = tox.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.filter("text like '%scumbag%'").count() == 0
    assert tox.op8(make_docs([]), labels).count() == 0
    assert tox.op8(docs, labels.limit(0)).filter("predicted = 1").count() == 0


def test_terms_of_few_contexts_are_learnt(spark, make_docs):
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(0, 60)] + [(None, 1, 1), (3, 1, None), (5, 0, 1)], "doc_id long, quality int, toxic int")
    rng = random.Random(0)
    docs = make_docs([(i, " ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(9)) + (" scumbag" if i % 2 else ""), "s") for i in range(60)] + [(None, "scumbag", None), (61, None, "s"), (62, "", "s"), (1, "aa", "s")], extra=True)
    got = tox.op8(docs, labels)
    assert got.filter("doc_id is null").first().predicted == 1 and got.filter("doc_id = 61").first().predicted == 0
    assert tox.drop_toxic(docs, labels).filter("text like '%scumbag%'").count() == 0


def test_copies_teach_no_terms(spark, make_docs):
    rng = random.Random(1)
    clean = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(60))
    copied = clean() + " harmless"
    rows = [(i, clean() if i % 2 else copied if i % 4 else clean() + " you scumbag", "s") for i in range(200)]
    labels = spark.createDataFrame([(i, None, 1 - i % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    weights = tox.fit(make_docs(rows), labels).weights
    assert "scumbag" in weights and "harmless" not in weights


def test_the_automaton_adds_to_beginnings(spark, sf):
    """Toxic held-out documents whose learnt words are misspelled by one letter."""
    docs, labels = sf
    model = tox.fit(docs, labels)
    held = docs.join(labels.filter("toxic = 1"), "doc_id").filter(tox.fold("doc_id", 3) == 1).select("text").collect()
    rng = random.Random(3)

    def misspelled(word):
        low = word.lower()
        if low not in model.weights or len(low) < 5:
            return word
        at = rng.randrange(1, 4)
        return word[:at] + "z" + word[at + 1 :]

    texts = [tox.TOKEN.sub(lambda m: misspelled(m[0]), r.text) for r in held]
    plain = tox.Model(model.weights, model.allowed, model.prior, edits=False)
    recall = lambda m: sum(m.score(t) >= 0.7 for t in texts) / len(texts)
    with_edits, without = recall(model), recall(plain)
    assert with_edits >= 0.8 and with_edits > without + 0.1, (with_edits, without)


def test_values_stay_and_ties_are_decided(spark, make_docs):
    rng = random.Random(4)
    long = "q" * 5000
    rows = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(9)) + (f" {long} scumbag" if i % 2 else ""), "s") for i in range(90)]
    docs = make_docs(rows, extra=True)
    labels = spark.createDataFrame([(i, None, i % 2) for i in range(90)] + [(i, None, 0) for i in range(1, 90, 4)], "doc_id long, quality int, toxic int")
    model = tox.fit(docs, labels)
    assert tox.name(long) in model.weights and model.prior == pytest.approx(tox.fit(docs, labels.orderBy(F.desc("toxic"))).prior)
    assert model.score(f"only {long}") > 0.7 > model.score("only " + "r" * 5000)
    kept = tox.drop_toxic(docs, labels)
    assert kept.dtypes == docs.dtypes and {(r.score, r.key) for r in kept.collect()} == {("clash", "clash")} and kept.count() == 45
    assert tox.drop_toxic(make_docs([]), labels).count() == 0


def test_beginnings_are_read_by_the_automaton():
    a = tox.Automaton({"idio*": 4.0, "moron": 5.0, "\0abc": 3.0})
    assert a.read("idiotic") == (None, ["idio*"]) and a.read("idiot") == (None, []) and a.read("morons") == (("moron", 1), [])
