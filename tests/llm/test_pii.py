"""Personal data: base spans against the contract's patterns, beliefs against enumeration, odd rows."""

import hashlib
import itertools
import re

import numpy as np
import pytest

from tapeloom.llm import op12_pii as pii

SF = "/root/testdata/sf0.01"
# The patterns as the contract states them.
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for k, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1]))
            fits = [True, all(int(p) <= 255 for p in m.group().split(".")) if k == 1 else True, 14 <= len(digits) <= 19 and total % 10 == 0, 10 <= len(digits) <= 15][k]
            if fits:
                out.append((*m.span(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_equal_the_stated_patterns():
    draw = np.random.default_rng(6)
    pieces = ["a.b", "@", "x-y.com", ".", "+1", " (555) ", "123", "-", " ", "255", "0000256", "10.0.0.1", "4111111111111111", "4", "é", "%", "99999", ". ", "\n", "@@", "+"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces, draw.integers(1, 14)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 100_000, "+1" + " " * 300_000, "a@" * 100_000, "1 " * 100_000, "@" * 200_000):
        pii.base_spans(text)
        pii.found_in([text], pii.Model(np.zeros((pii.FEATURES, pii.LABELS)), np.zeros((5, 5)), np.zeros(5)))


def exact_beliefs(model, tokens):
    """Marginals by summing over all labellings of tokens and hubs."""
    n, total = len(tokens.starts), len(tokens.starts) + tokens.hubs
    local = model.unary[np.array(tokens.features)].sum(axis=1)
    sums = np.zeros((n, pii.LABELS))
    for labels in itertools.product(range(pii.LABELS), repeat=total):
        if any(known not in (pii.NONE, label) for known, label in zip(tokens.labels, labels)):
            continue
        score = sum(local[i][labels[i]] for i in range(n) if tokens.labels[i] == pii.NONE)
        score += sum(model.chain[labels[i - 1]][labels[i]] for i in range(n) if tokens.chained[i])
        score += sum(model.skip[labels[i]] for i, hub in tokens.members if labels[i] == labels[n + hub])
        for i in range(n):
            sums[i][labels[i]] += np.exp(score)
    return sums / sums.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("text", ["call 1234567 or later 1234567 maybe", "1 2 3 word 4", "5551234 a a@b.cc 5551234"])
def test_beliefs_equal_enumeration_where_the_graph_is_a_tree(text):
    draw = np.random.default_rng(1)
    model = pii.Model(draw.standard_normal((pii.FEATURES, 5)), draw.standard_normal((5, 5)), draw.random(5) * 3)
    tokens = pii.Tokens()
    tokens.add(text, pii.base_spans(text))
    assert np.allclose(model.beliefs(tokens), exact_beliefs(model, tokens), atol=1e-4)


def test_a_likeness_far_away_carries_a_label():
    plain = np.zeros((pii.FEATURES, 5))
    plain[0] = [2, 0, 0, 0, 0]
    phone = "+49 30 5551234567"
    text = f"call {phone} today" + " word" * 5000 + " or 5551234567 again"
    alone = pii.found_in([text], pii.Model(plain, np.zeros((5, 5)), np.zeros(5)))[0]
    linked = pii.found_in([text, "5551234567"], pii.Model(plain, np.zeros((5, 5)), np.full(5, 8.0)))
    assert alone["added"] == [] and linked[1] == {"base": [], "added": []}
    at = text.rindex("5551234567")
    assert linked[0]["added"] == [(at, at + 10, 3)] and linked[0]["base"] == pii.base_spans(text)


def test_slices_do_not_change_what_is_found(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = pii.train(docs, 200)
    texts = [r.text for r in docs.collect()]
    whole = pii.found_in(texts, model)
    assert whole == [pii.found_in([t], model)[0] for t in texts]
    assert sum(len(f["base"]) for f in whole) > 20


def test_learned_labels_fit_base_spans_held_out():
    draw = np.random.default_rng(3)

    def document(i):
        number = f"+1 ({draw.integers(100, 999)}) 555-{draw.integers(1000, 9999)}"
        return f"We met on day {draw.integers(1, 30)} at 10.{i % 60}. Phone {number} or n{i}.x@mail{i % 9}.example.com, host 10.{i % 256}.3.4 end"

    texts = [document(i) for i in range(400)]
    rows, counts = [], np.zeros(5)
    for text in texts[:300]:
        t = pii.Tokens()
        t.add(text, pii.base_spans(text))
        labels = np.array(t.labels)
        counts += np.bincount(labels, minlength=5)
        c = np.array(t.chained)
        left = np.where(c, np.r_[5, labels[:-1]], 5)
        right = np.where(np.r_[c[1:], False], np.r_[labels[1:], 5], 5)
        rows += list(zip(labels, t.features, left, right))
    model = pii.fit(*(np.array([r[i] for r in rows]) for i in range(4)), np.zeros((len(rows), 5)), counts)
    right = total = 0
    for text in texts[300:]:
        t = pii.Tokens()
        t.add(text, pii.base_spans(text))
        want, t.labels = t.labels, [0] * len(t.labels)  # nothing observed
        right += (model.beliefs(t).argmax(axis=1) == want).sum()
        total += len(want)
    assert right / total > 0.98


def test_a_card_glued_to_a_phone_is_recovered(spark):
    glued = "+1 (884) 555-3918 4078918989542222"
    assert pii.base_spans(f"x {glued} y") == []
    docs = spark.read.parquet("/root/testdata/check_s/documents.parquet").select("doc_id", "text").filter("text like '%@%'")
    found = pii.found_in([f"Anntsh is onntes a thhees. {glued} ton"], pii.train(docs))[0]
    assert found["added"][-1][2] == 2 and found["base"] == []


def test_odd_rows(spark):
    ddl = "doc_id bigint, text string, spans string, label int, place string"
    long = "mail a.b@c.de " + "word " * 200_000 + "10.0.0.1"
    texts = [(1, None), (2, ""), (3, " \n"), (4, long), (5, "a@b.cc a@b.cc"), (5, "a@b.cc a@b.cc"), (None, "x +1 234 567 8901 y"), (6, "\U0001f600 é 10.1.2.3")]
    df = spark.createDataFrame([(i, t, "s", 1, "p") for i, t in texts], ddl)
    rows = pii.personal_data(df, pii.train(df)).collect()
    assert len(rows) == len(texts)
    by = {r.doc_id: r for r in rows}
    empty = hashlib.sha256(b"").hexdigest()
    assert all(by[i].base_sha256 == empty and by[i].spans == "" for i in (1, 2, 3))
    assert (by[4].n_email, by[4].n_ip, by[5].n_email, by[None].n_phone) == (1, 1, 2, 1)
    assert by[6].spans.startswith("ip:4:12") and by[6].base_sha256 == hashlib.sha256(b"ip:4:12").hexdigest()
    assert pii.personal_data(df.limit(0), pii.train(df.limit(0))).count() == 0


def test_sample_is_bounded_and_does_not_depend_on_the_split(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = pii.train(docs.coalesce(1), 20), pii.train(docs.repartition(7), 20)
    assert np.array_equal(one.unary, many.unary) and np.array_equal(one.chain, many.chain)


def test_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pii.op12_pii(spark, SF).collect():
        base = brute(docs[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in range(4)]
        assert set(filter(None, pii.joined(base).split(","))) <= set(r.spans.split(",")) and r.n_added == len(list(filter(None, r.spans.split(",")))) - len(base)
