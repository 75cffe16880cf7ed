"""Leaks that a strict reading of names and slots would miss."""

import random

import duckdb
import pytest

from tapeloom.llm import op1_decontamination as leaks
from tests.llm.test_text_models import ITEM, benchmark, docs

COPIES = {
    "lower case": ITEM.lower(),
    "upper case": ITEM.upper(),
    "a line for each word": ITEM.replace(" ", "\n"),
    "double spaces": ITEM.replace(" ", "  "),
    "other names in other lines": ITEM.replace("Alice", "Carol").replace("Bob", "Dave").replace(" ", "\n"),
}


@pytest.mark.parametrize("form", COPIES)
def test_copies_in_another_form(spark, form):
    df = docs(spark, [(1, f"Well, {COPIES[form]} And more.", "en"), (2, "a clean text of quite a few words", "en")])
    assert [(r.doc_id, r.item_id) for r in leaks.contaminated(df, benchmark(spark)).collect()] == [(1, 9)]
    assert [r.doc_id for r in leaks.drop_contaminated(df, benchmark(spark)).collect()] == [2]


LONG = (
    "a farmer has 3 fields with rows of green corn and keeps them well watered over the whole summer while the "
    "old miller next door counts 3 coins every evening and wonders how much flour one could buy with them at market today"
)


@pytest.mark.parametrize("copy", [LONG.replace("3 coins", "4 coins"), LONG.replace("3 fields", "5 fields").replace("3 coins", "6 coins")])
def test_one_changed_slot_frees_no_leak(spark, copy):
    bench = spark.createDataFrame([(5, LONG)], "item_id bigint, text string")
    df = docs(spark, [(1, copy, "en"), (2, "a clean text of quite a few words", "en")])
    assert [(r.doc_id, r.item_id) for r in leaks.contaminated(df, bench).collect()] == [(1, 5)]
    assert [r.doc_id for r in leaks.drop_contaminated(df, bench).collect()] == [2]


def test_windows_with_an_inconsistent_slot_fail(spark):
    """Every window holds the number that is replaced in two ways: no leak."""
    item = "one needs 7 red bricks then 7 blue bricks then 7 more"
    bench = spark.createDataFrame([(5, item)], "item_id bigint, text string")
    df = docs(spark, [(1, "one needs 8 red bricks then 9 blue bricks then 10 more", "en"), (2, item.replace("7", "8"), "en")])
    assert [r.doc_id for r in leaks.contaminated(df, bench).collect()] == [2]


SHARED = "read the following problem with care and answer with one single number at the very end "
PLANTED = {
    11: SHARED + "a train with 12 cars leaves Berlin and needs 40 minutes for the 60 km to Hamburg",
    12: SHARED + "a baker sells 9 loaves to Anna and 9 rolls to Peter and then counts the money twice",
    13: SHARED + "how deep is the old well if a stone needs 3 s to reach the water below",
    14: "一列火车有十二节车厢从北京出发开往上海需要六小时",
}


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Copies in every form, parts of copies, and documents with the shared instruction only."""
    rng, texts = random.Random(5), []
    for item in PLANTED.values():
        words = item.split()
        texts += [item, item.upper(), item.replace(" ", " \n"), item.replace("9", "7"), item.replace("9", "8", 1).replace("12", "15")]
        texts += [f"前文{item}。后文", item.replace("km", "miles").replace("Berlin", "Madrid").replace("Anna", "Eva")]
        for _ in range(12):
            a, b = sorted(rng.sample(range(len(words) + 1), 2))
            texts.append(f"Before this {' '.join(words[a:b])} and after it")
    texts += [SHARED, SHARED * 3, "", None, "A clean text, of quite a few words, by Anna."]
    folder = str(tmp_path_factory.mktemp("planted"))
    docs(spark, [(k, t, "en") for k, t in enumerate(texts)]).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(PLANTED.items()), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_planted_copies_against_sql(spark, planted):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{planted}/{name}.parquet/*.parquet')")
    columns = ["doc_id", "item_id", "matched_windows", "item_windows", "slots", "changed_slots"]
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({leaks.SQL})").fetchall())
    got = sorted(tuple(r) for r in leaks.op1_decontamination(spark, planted).select(*columns).collect())
    assert got == want
    assert {i for _, i, *_ in got} == set(PLANTED) and len(got) > 30
    assert any(row[4] > row[5] > 0 for row in got) and any(row[2] < row[3] for row in got)


@pytest.mark.parametrize("coverage", [0.2, 0.5, 0.9, 1.0])
def test_the_rarest_windows_lose_no_link(spark, planted, coverage):
    given = spark.read.parquet(f"{planted}/documents.parquet"), spark.read.parquet(f"{planted}/benchmark.parquet")
    links = {tuple(r) for r in leaks.contaminated(*given, coverage=coverage).collect()}
    loose = {tuple(r) for r in leaks.contaminated(*given, coverage=0.01).collect() if r.matched_windows >= coverage * r.item_windows}
    assert links == loose and links


def test_a_shared_instruction_brings_no_pair(spark, planted):
    given = spark.read.parquet(f"{planted}/documents.parquet").filter("text like 'read the following%at the very end '")
    items = leaks.item_windows(spark.read.parquet(f"{planted}/benchmark.parquet"))
    assert given.count() == 2 and leaks.matches(given, items).count() == 0
