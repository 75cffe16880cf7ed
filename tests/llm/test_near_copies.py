"""The near dedup stage on planted copies of known similarity."""

import numpy as np
import pytest

import corpus_pipeline
from tapeloom.llm import shingles
from tests.llm.test_dedup import frame


def sets_of(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = sets_of(a), sets_of(b)
    return len(a & b) / len(a | b)


def planted(n=30):
    """Texts of 400 words, each followed by a copy with some words changed; and pairs well below 0.8."""
    rng = np.random.default_rng(7)
    rows = []
    for k in range(n):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, 400)]
        changed = list(words)
        for at in range(7, 7 + 20 * (1 + k % 8 if k % 3 else 16), 20):
            changed[at] = "other"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(changed).upper())]
    return rows


def test_stage_drops_planted_copies(spark):
    rows = planted()
    alike = {k: jaccard(rows[2 * k][1], rows[2 * k + 1][1]) for k in range(len(rows) // 2)}
    near = {k for k, j in alike.items() if j >= 0.8}
    assert len(near) > 15 and any(0.8 <= alike[k] < 0.85 for k in near) and any(alike[k] > 0.95 for k in near) and len(near) < len(alike)
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    assert got == {i for i, _ in rows} - {2 * k + 1 for k in near}


@pytest.mark.parametrize("few, block", [(8, 1 << 19), (1, 1500), (1, 1 << 19)])
def test_crowded_bands_and_pairs_agree(spark, few, block):
    rng = np.random.default_rng(3)
    base = [f"w{x}" for x in rng.integers(0, 1 << 40, 200)]
    texts = []
    for k in range(30):  # a chain: neighbours are near copies, far ones are not
        base = list(base)
        base[(13 * k) % 200] = f"new{k}"
        texts.append(" ".join(base))
    docs = frame(spark, list(enumerate(texts)))
    marked = shingles.with_shingles(docs.select("text"), "text", 5, "__fp", "__bands")
    names = {r.text: r["__fp"] for r in marked.collect()}
    got = shingles.links(docs, marked.drop("text"), "text", 5, 0.8, few, block).collect()
    at = {names[t]: i for i, t in enumerate(texts)}
    want = [(i, j) for i in range(30) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    assert all(jaccard(texts[at[r.a]], texts[at[r.b]]) >= 0.8 for r in got)

    def parts(edges):
        own = list(range(30))
        for a, b in edges:
            own = [own[a] if x == own[b] else x for x in own]
        return [[y for y in range(30) if own[y] == own[x]] for x in range(30)]

    assert parts(want) == parts([(at[r.a], at[r.b]) for r in got])


def test_fingerprint_links_propose_pairs_and_the_sets_decide(spark, monkeypatch):
    from tapeloom.llm import op4_simhash

    words = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(words)), (1, " ".join([*words[:399], "last"])), (2, " ".join(words * 3)), (3, "far away from all of these"), (4, "")]
    rows += [(10 + k, " ".join(words[k:] + words[:k])) for k in (1, 2, 3)]
    seen = []

    def kept(docs, distinct, text, words, similarity, **more):
        seen.extend(tuple(r) for r in more["proposed"].collect())
        return shingles.links(docs, distinct, text, words, similarity, **more)

    monkeypatch.setattr(op4_simhash, "shingle_links", kept)
    monkeypatch.setattr(shingles, "bands", lambda values: np.empty(0, np.uint64))  # only fingerprints propose
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()}
    names = {i: shingles._name(shingles.shingles(t.encode(), 5)) for i, t in rows}
    prints = {i: op4_simhash.fingerprint(t.encode()) for i, t in rows}
    close = {(i, j) for i in prints for j in prints if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2 and names[i] != names[j]}
    assert close and len(seen) >= 1 and all(a < b for a, b in seen)
    own = {i: i for i, _ in rows}
    for i, j in close:  # every pair is far above 0.8, but the empty and the far text
        assert jaccard(rows[[r[0] for r in rows].index(i)][1], rows[[r[0] for r in rows].index(j)][1]) >= 0.8
        own = {k: min(own[i], own[j]) if v in (own[i], own[j]) else v for k, v in own.items()}
    assert got == set(own.values())


def test_one_pass_marks_a_text(spark):
    from tapeloom.llm import op4_simhash

    texts = [("a b c d e f g",), ("",), (None,)]
    docs = spark.createDataFrame(texts, "text string")
    marked = op4_simhash._with_marks(docs, "text", 5)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # one Python worker a task
    for r in marked.collect():
        raw = (r.text or "").encode()
        own = shingles.shingles(raw, 5)
        assert r["__print"] % (1 << 64) == op4_simhash.fingerprint(raw) and r["__fp"] % (1 << 64) == shingles._name(own)
        assert [b % (1 << 64) for b in r["__bands"]] == shingles.bands(own).tolist()
