"""Queries beside their SQL, and the pipeline against its stages done by hand."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tapeloom.llm import op1_decontamination, registry
from tapeloom.llm import op7_language_id as lang
from tapeloom.llm import op3_sentencepiece as pieces
from tests.compare import compare, connect
from tests.llm.test_dedup import plain

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    found = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in found) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, name):
    problem, _, _ = compare(spark, connect(SF), name, registry.QUERIES[name], registry.ORACLE_SQL[name], SF)
    assert problem is None


def five_word_sets(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


CLASHING = ["__sha", "__cp", "__id", "__fp", "__name", "__stays", "__n", "__row", "__doc", "__lang", "__score", "__leaked", "name", "leaked", "given0", "kept", "__root"]


def test_stages_take_clashing_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.withColumns({c: F.col("doc_id") for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, extra, SF)
        assert got.columns == extra.columns, name
        assert {r.doc_id for r in got.collect()} == {r.doc_id for r in stage(spark, docs, SF).collect()}, name


def test_pipeline(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    words = " ".join(f"word{i % 23} and" for i in range(400))
    more = [(9001, None), (9002, "1 2 3"), (9003, words), (9004, words + " "), (9005, words.replace("word", "WORD")), (None, "A lone text without an id.")]
    extra = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in more], given.schema)
    given.unionByName(extra).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    folder = str(tmp_path)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = lang.train(docs)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, t) for i, t in rows if (p := model.predict(t))[0] != "und" and p[1] >= 0.35]
    assert not {9001, 9002} & {i for i, _ in rows}
    best = {}
    for i, t in rows:
        key = (-len(t), i is None, i or 0)
        best[plain(t)] = min(best.get(plain(t), (key, i, t)), (key, i, t), key=lambda x: x[0])
    rows = [(i, t) for _, i, t in best.values()]
    held = [five_word_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(held[a] & held[b])
            if both >= 0.8 * (len(held[a]) + len(held[b]) - both):
                root[top(a)] = top(b)
    first = {}
    for k, (i, t) in enumerate(rows):
        key = (i is None, i or 0)
        first[top(k)] = min(first.get(top(k), (key, i, t)), (key, i, t), key=lambda x: x[0])
    rows = [(i, t) for _, i, t in first.values()]
    items = [re.findall(r"\w+", r.text.lower()) for r in bench.collect()]
    windows = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in items]

    def leaked(text):
        w = re.findall(r"\w+", text.lower())
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        return any(len(own & x) >= op1_decontamination.COVERAGE * len(x) for x in windows if x)

    rows = [(i, t) for i, t in rows if not leaked(t)]
    assert set(got) == {i for i, _ in rows} and 9004 in got and not {9003, 9005} & set(got)
    library = pieces.library(pieces.default_model())
    assert all(got[i].ids == library.encode(t) and got[i].parity for i, t in rows)


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
