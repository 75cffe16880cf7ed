"""Exact and near deduplication against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tapeloom.llm import op4_simhash as near
from tapeloom.llm import op9_exact_dedup as exact

SCHEMA = "doc_id bigint, text string, keep_id string, component_id string, kept int, n_rows int"
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen".split()


def rows():
    base = " ".join(WORDS * 20)
    texts = {
        1: "same  text", 2: "same text", 3: "sametext\t", 4: "other", 5: None, 6: "", 7: " \n", 8: base, 9: base,
        10: base.replace("ten", "TEN"), 11: base + " extra", 12: "a b", 13: "A B", 14: "x", 15: "é" * 200_000, 16: "é" * 200_000,
    }
    found = [(i, t) for i, t in texts.items()]
    return [*found, (2, "same text"), (None, "same text"), (None, "alone"), (4, "another text of four")]


def frame(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(i, t, "x", "y", 7, 1) for i, t in data], SCHEMA)


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def by_hand():
    groups = {}
    for i, t in rows():
        groups.setdefault(plain(t), []).append((-len(t or ""), i is None, i or 0, i))
    found = set()
    for text, members in groups.items():
        keep = min(members)[3]
        for i in {m[3] for m in members}:
            found.add((i, keep, len(members), i == keep, hashlib.sha256(text.encode()).hexdigest()))
    return found


def test_exact_duplicates(spark):
    got = [tuple(r) for r in exact.exact_duplicates(frame(spark)).drop("n_rows").collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand()


def test_exact_duplicates_of_nothing(spark):
    assert exact.exact_duplicates(frame(spark, [])).count() == 0
    assert exact.drop_exact_duplicates(frame(spark, [])).count() == 0


def test_exact_drop_keeps_columns_and_one_row_each(spark):
    df = exact.drop_exact_duplicates(frame(spark))
    assert df.columns == frame(spark).columns
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in df.collect())
    want = sorted((k is None, k or 0) for i, k, _, kept, _ in by_hand() if kept)
    assert got == want
    assert df.filter("doc_id = 1").first().text == "same  text"


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values[:100] = values[0] + np.arange(100, dtype=np.uint64)  # one block, neighbouring remainders
    parts = [np.sort(rng.choice(values, 300)) for _ in range(4)]
    import pyarrow as pa

    filters = []
    for p in parts:
        batch = pa.RecordBatch.from_arrays([pa.array(p.view(np.int64))], names=["__fp"])
        filters += [b for b in exact._filter([batch])]
    table = pa.Table.from_batches(filters).sort_by("block")
    merged = np.concatenate([b.column(0).to_numpy() for b in exact._merge(table.to_batches(max_chunksize=7))]).view(np.uint64)
    all_, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert sorted(merged) == sorted(all_[counts > 1])


@pytest.mark.parametrize("n, spread", [(1, 52), (2, 52), (60, 52), (3000, 52), (3000, 12), (500, 9)])
def test_filter_holds_keys_and_counts(n, spread):
    """Random and crowded keys (long shifts, one run), counts of one, two, many and two counter slots."""
    rng = np.random.default_rng(n + spread)
    keys = np.unique(rng.integers(0, 1 << spread, n, dtype=np.uint64))
    counts = rng.choice([1, 1, 1, 2, 3, 70_000, 1 << 53], len(keys)).astype(np.int64)
    got, times = exact.decode(exact.encode(keys, counts))
    assert (got == keys).all() and (times == counts).all()
    top = np.uint64((1 << 52) - 1) - keys[::-1]  # shifted beyond the last quotient
    got, times = exact.decode(exact.encode(top, counts))
    assert (got == top).all() and (times == counts).all()


def test_filter_is_smaller_than_its_fingerprints():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 4000):
        keys = np.unique(rng.integers(0, 1 << 52, n, dtype=np.uint64))
        assert len(exact.encode(keys, np.ones(len(keys), np.int64))) <= 8 * len(keys)


def test_many_filters_of_a_block_merge_in_one_pass(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(exact, "HELD", 5_000)
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 1 << 52, 50_000, dtype=np.uint64)
    parts = [np.unique(rng.choice(pool, 20)) for _ in range(4_000)]
    packed = [exact.encode(p, np.ones(len(p), np.int64)) for p in parts]
    table = pa.table({"block": pa.array([9] * len(packed), pa.int32()), "filter": pa.array(packed, pa.binary())})
    got = np.concatenate([b.column(0).to_numpy() for b in exact._merge(table.to_batches(max_chunksize=300))])
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert (got.view(np.uint64) == (keys[counts > 1] | np.uint64(9 << 52))).all()


def test_groups_come_from_bytes(spark):
    """Texts are compared even where every fingerprint is suspected."""
    df = frame(spark).select("doc_id", "text")
    every = exact.with_marks(df).select("__fp").distinct()
    sizes = [r["__size"] for r in exact.verified_groups(df, every).collect()]
    assert sum(sizes) == len(rows()) and len(sizes) == len({plain(t) for _, t in rows()})


def fingerprint(text):
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def groups(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(spark):
    data = rows()
    prints = [fingerprint(t) for _, t in data]
    root = groups(prints)
    want = []
    for (i, _), p, r in zip(data, prints, root):
        ids = [d for (d, _), q in zip(data, root) if q == r and d is not None]
        want.append((i, f"{p:016x}", min(ids, default=None)))
    got = [tuple(r) for r in near.near_duplicates(frame(spark)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_near_drop(spark):
    df = near.drop_near_duplicates(frame(spark))
    assert df.columns == frame(spark).columns
    prints = [fingerprint(t) for _, t in rows()]
    assert df.count() == len(set(groups(prints)))
    assert near.drop_near_duplicates(frame(spark, [])).count() == near.near_duplicates(frame(spark, [])).count() == 0


def cluster(n, seed=3):
    """Fingerprints of which many lie close together, some in chains."""
    rng = np.random.default_rng(seed)
    found = list(rng.integers(0, 1 << 63, 40, dtype=np.uint64))
    while len(found) < n:
        flips = rng.choice(64, rng.integers(1, 5), replace=False)
        found.append(found[rng.integers(0, len(found))] ^ np.uint64(sum(1 << int(b) for b in flips)))
    return np.unique(np.array(found, np.uint64))


def test_every_close_pair_meets_under_a_key():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        a = int(rng.integers(0, 1 << 63))
        b = a ^ sum(1 << int(x) for x in rng.choice(64, rng.integers(0, 3), replace=False))
        keys = [k for k, m in enumerate(near.MASKS) if not (a ^ b) & int(m)]
        assert any(len(near.near(np.array([a], np.uint64), np.array([b], np.uint64), k)[0]) for k in keys)


@pytest.mark.parametrize("block", [7, 2048])
def test_links_of_crowded_keys(spark, block):
    values = cluster(400)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "`__fp` bigint")
    found = [(r.a, r.b) for r in near.links(df, block).collect()]
    at = {int(v): i for i, v in enumerate(values.view(np.int64))}
    for a, b in found:
        assert ((a ^ b) & (2**64 - 1)).bit_count() <= 2
    root = groups([int(v) for v in values])
    own = list(range(len(values)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in found:
        own[find(at[a])] = find(at[b])
    pairs = {(find(i), r) for i, r in enumerate(root)}
    assert len(pairs) == len(set(root)) == len({p for p, _ in pairs})


def test_components_of_a_long_path(spark):
    from tapeloom.llm.components import components

    path = spark.range(300).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 1).alias("b"))
    extra = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "a bigint, b bigint")
    got = components(path.unionByName(extra)).groupBy("root").count().collect()
    assert sorted(r["count"] for r in got) == [2, 301]
