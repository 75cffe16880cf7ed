"""Language, quality, decontamination and chat operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import op1_decontamination as leaks
from tapeloom.llm import op2_chat as chat
from tapeloom.llm import op7_language_id as lang
from tapeloom.llm import op10_quality as quality

SF = "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, held_out int, `__lang` int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, code, "s", 1, "x", 0, 1) for i, t, code in rows], DOCS)


ODD = [(1, None, "en"), (2, "", None), (3, "12 34 !!", "en"), (4, "the cat " * 50_000, "en"), (None, "der Hund", "de"), (4, "x", None)]


def test_language_held_out_accuracy(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("lang").alias("truth"))
    got = lang.op7_language_id(spark, SF).join(given, "doc_id").filter("held_out").toPandas()
    assert len(got) > 150 and (got.lang_pred == got.truth).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_language_of_odd_rows(spark):
    got = lang.languages(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    none = {r.doc_id for r in got if r.lang_pred == "und"}
    assert none >= {1, 2, 3} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert lang.languages(docs(spark, [])).count() == 0
    unlabelled = lang.languages(docs(spark, [(1, "text", None)])).first()
    assert (unlabelled.lang_pred, unlabelled.score) == ("und", 0.0)


def test_language_stage_keeps_columns_and_clean_rows(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    given = given.withColumn("__lang", F.lit("x")).withColumnRenamed("__lang", "lang_pred")
    kept = lang.keep_identified(given.unionByName(given.limit(1).withColumn("text", F.lit("123"))))
    assert kept.columns == given.columns and kept.filter("text <> '123'").count() > 990 and kept.filter("text = '123'").count() == 0


def test_ngrams_read_whole_texts():
    long = "the cat " * 100_000
    assert len(lang.ngrams(long)) == sum(len(long) + 2 - k for k in range(3))
    assert len(lang.ngrams("a")) == 3 + 2 + 1 and not len(lang.ngrams("1 2"))


def test_follow_the_leader_is_sparse_and_right():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        y = int(rng.integers(0, 3))
        rows.append((np.array([y, *(10 + rng.choice(500, 5, replace=False))]), np.ones(6), y))
    weights, bias = lang.follow_the_leader(rows, 3, l1=0.5)
    assert (weights == 0).mean() > 0.95
    assert np.mean([(x @ weights[p] + bias).argmax() == y for p, x, y in rows]) > 0.99


def test_temperature():
    rng = np.random.default_rng(0)
    truth = rng.integers(0, 2, 4000)
    logits = rng.normal(0, 1, (4000, 2))
    truth = (rng.random(4000) < lang.softmax(logits)[:, 1]).astype(int)
    assert lang.best_temperature(5 * logits, truth) == pytest.approx(5, rel=0.15)


def test_quality_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    got = quality.op10_quality(spark, SF).join(truth, "doc_id").filter("held_out").toPandas()
    assert len(got) > 100 and (got.predicted == got.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0, "x"), (1, 0, 1, "x"), (None, 1, 0, "x"), (2, None, None, "x"), (2, 1, 0, "x"), (2, 0, 0, "x")], "doc_id bigint, quality int, toxic int, text string")
    got = quality.scored(docs(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert quality.scored(docs(spark, []), labels).count() == 0
    assert {r.score for r in quality.scored(docs(spark, ODD), labels.limit(0)).collect()} == {0.5}


def test_quality_gradient():
    rng = np.random.default_rng(0)
    sizes = {"W": (quality.FEATURES, 16), "b": (16,), "V": (16, 8), "v": (8,), "U": (16, 8), "u": (8,), "a": (8,), "c": (16,), "d": ()}
    w = {k: rng.normal(0, 0.3, s) for k, s in sizes.items()}
    x, starts, y, weight = rng.normal(size=(9, quality.FEATURES)), np.array([0, 2, 3]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        p = quality._forward(w, x, starts)["p"]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    g = quality._gradient(w, x, starts, y, weight)
    for k in w:
        old, place = w[k].copy(), tuple(np.array(w[k].shape) // 2)
        step = np.zeros(old.shape)
        step[place] = 1e-6
        w[k] = old + step
        up = loss()
        w[k] = old - step
        slope = (up - loss()) / 2e-6
        w[k] = old
        assert slope == pytest.approx(float(np.asarray(g[k])[place]), abs=1e-7)


def test_passages_of_long_texts_agree():
    text = " ".join(f"word{i % 97}." for i in range(3000))
    old = quality.PART
    whole = quality.bag(text)
    try:
        quality.PART = 5000
        parts = quality.bag(text)
    finally:
        quality.PART = old
    assert len(whole) == -(-3000 // 64) and len(parts) >= len(whole)
    assert quality.bag(None).shape == quality.bag("  \n").shape == (1, quality.FEATURES)


ITEM = "so Alice bought 12 apples and 3.5 kg of plums from Bob. Then Alice gave 12 apples away to her cousin."
LEAKS = [
    (1, f"Well, {ITEM} And more."),
    (2, "Well, so Carol bought 40 apples and 7 lb of plums from Dave. Then Carol gave 40 apples away to her cousin."),
    (3, "Well, so Carol bought 40 apples and 7 lb of plums from Dave. Then Erin gave 41 apples away to her cousin."),
    (4, "so Alice bought 12 pears for nobody in particular, which is quite another question than that of apples"),
    (5, None),
    (6, ""),
    (7, ITEM.upper().replace("ALICE", "Alice").replace("BOB", "Bob").replace(" KG", " kg")),
    (None, ITEM),
    (8, "filler words again and again " * 30_000 + ITEM),
    (1, "a clean repeat of the id"),
]


def benchmark(spark):
    rows = [(9, ITEM, 1), (8, None, 1), (7, "short one", 1), (6, "1 2 3 4 5 6 7 8", 1)]
    return spark.createDataFrame(rows, "item_id bigint, text string, doc_id int")


def test_leaks(spark):
    df = docs(spark, [(i, t, "en") for i, t in LEAKS])
    got = {(r.doc_id, r.item_id): (r.slots, r.changed_slots) for r in leaks.contaminated(df, benchmark(spark)).collect()}
    assert set(got) == {(1, 9), (2, 9), (7, 9), (None, 9), (8, 9)}
    assert got[1, 9] == (7, 0) and got[2, 9] == (7, 7) or got[2, 9][1] == 7
    kept = leaks.drop_contaminated(df, benchmark(spark))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6]


def test_leaks_of_nothing(spark):
    df = docs(spark, [(i, t, "en") for i, t in LEAKS])
    assert leaks.contaminated(df, benchmark(spark).limit(0)).count() == 0
    assert leaks.contaminated(df.limit(0), benchmark(spark)).count() == 0
    assert leaks.drop_contaminated(df, benchmark(spark).limit(0)).count() == len(LEAKS)


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, rendered string, piece int")


def test_snapshots_collapse(spark):
    rows = []
    for conv, n in ((1, 2), (2, 4), (3, 3), (4, 4)):  # 2 and 4 are equal and hold 1 and 3
        rows += [(conv, t, "user" if t % 2 == 0 else "assistant", f"turn {t}", "r", 0) for t in range(n)]
    rows += [(5, 0, "user", "turn 0", "r", 0), (5, 1, "assistant", "other", "r", 0)]
    rows += [(6, None, None, None, "r", 0), (None, 0, "user", "lost", "r", 0), (7, 3, "user", "same", "r", 0), (7, 3, "user", "same", "r", 0)]
    got = {(r.conv_id, r.piece): (r.n_turns, r.rendered) for r in chat.chats(turns(spark, rows)).collect()}
    assert set(got) == {(2, 0), (5, 0), (6, 0), (7, 0)}
    assert got[2, 0][1].startswith("<|im_start|>user\nturn 0<|im_end|>\n<|im_start|>assistant\nturn 1<|im_end|>\n")
    assert got[6, 0] == (1, "<|im_start|>\n<|im_end|>\n") and got[7, 0][0] == 2
    assert chat.chats(turns(spark, [])).count() == 0


def test_long_conversation_comes_in_pieces(spark):
    rows = [(1, t, "user", f"t{t}", "r", 0) for t in range(700)] + [(2, t, "user", f"t{t}", "r", 0) for t in range(600)]
    got = sorted((r.piece, r.n_turns) for r in chat.chats(turns(spark, rows)).collect())
    assert got == [(0, 256), (1, 256), (2, 188)]
