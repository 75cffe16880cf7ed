"""Token, archive and page operators."""

import base64
import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import op3_sentencepiece as pieces
from tapeloom.llm import op5_warc as warc
from tapeloom.llm import op6_html_text as html
from tapeloom.llm import op8_token_counts as counts

TEXTS = [
    None, "", "a", " a", "a ", "  two  blanks ", "</s> <s> <unk> <0x41>", "▁mark ▁▁", "日本語 😀 👩‍👩‍👧", "\n\n\t x\r\n", "\x00",
    "word " * 40_000, "x" * 50_000, "été été", "The cat. The cat.",
]


def frame(spark, texts=None):
    rows = list(enumerate(TEXTS if texts is None else texts))
    return spark.createDataFrame([(i, t, "x", 1, "y", b"z") for i, t in rows], "doc_id bigint, text string, ids string, n_tokens int, parity string, content binary")


def field(number, value):
    if isinstance(value, bytes):
        return bytes([number << 3 | 2]) + varint(len(value)) + value
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def unigram_model() -> bytes:
    """A model written by hand; nothing is trained."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    plain = ["▁", "a", "b", "c", "▁a", "▁b", "ab", "▁ab", "abc", "▁abc", "bc", "ca", "▁▁"]
    rows += [(p, -1.0 - 0.37 * i, 1) for i, p in enumerate(plain)]
    model = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in rows)
    trainer = field(3, 1) + field(35, 1) + field(40, 0) + field(41, 1) + field(42, 2)
    return model + field(2, trainer) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))


@pytest.mark.parametrize("model", [pieces.default_model(), unigram_model()], ids=["bpe", "unigram"])
def test_parity_and_decoding(model):
    texts = [t for t in TEXTS if t is not None] + ["abc cab  bca", "<s>ab</s>"]
    got = pieces.encode(model, texts)
    assert got == pieces.library(model).encode(texts)
    if pieces.parse(model)["type"] == pieces.BPE:  # the other keeps its byte pieces under hidden names
        assert pieces.decode(model, got) == pieces.tokenizer(model).decode_batch(got, skip_special_tokens=False)
    assert pieces.decode(model, got) == [t.replace("▁", " ") for t in texts]


def test_parse():
    spec = pieces.parse(pieces.default_model())
    assert spec["type"] == pieces.BPE and spec["byte_fallback"] and len(spec["pieces"]) == 32_000 and spec["unknown"] == 0


def test_encoding_of_odd_rows(spark):
    got = {r.doc_id: r for r in pieces.encoded(frame(spark)).collect()}
    library = pieces.library(pieces.default_model())
    for i, t in enumerate(TEXTS):
        assert got[i].ids == library.encode(t or "") and got[i].n_tokens == len(got[i].ids) and got[i].parity
        assert got[i].restored == ("▁" not in (t or ""))
    assert pieces.encoded(frame(spark, [])).count() == 0
    back = pieces.with_text(pieces.encoded(frame(spark)).select("doc_id", "ids")).collect()
    assert all(r.decoded == (TEXTS[r.doc_id] or "").replace("▁", " ") for r in back)


def test_token_counts_and_cache(spark, tmp_path):
    cache = str(tmp_path / "cache")
    got = counts.token_counts(frame(spark, [*TEXTS, "a", "a"]), cache).collect()
    library = pieces.library(pieces.default_model())
    assert len(got) == len(TEXTS) + 2
    for r in got:
        t = ([*TEXTS, "a", "a"][r.doc_id]) or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t))) and r.over_limit == (r.n_tokens > 4096)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in TEXTS})  # each distinct text once
    counts.token_counts(frame(spark, ["a", "new"]), cache)
    assert spark.read.parquet(cache).count() == stored.count() + 1 or spark.read.parquet(cache).groupBy("content").count().filter("count > 1").count() == 0
    files = len(list((tmp_path / "cache").glob("*.parquet")))
    other = counts.tokenizer_file("byte_bpe_50k.json")
    by_json = {r.doc_id: r.n_tokens for r in counts.token_counts(frame(spark), cache, other).collect()}
    from tokenizers import Tokenizer

    built = Tokenizer.from_file(other)
    assert all(by_json[i] == len(built.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS))
    assert spark.read.parquet(cache).select("version").distinct().count() == 2 and files > 0
    assert counts.token_counts(frame(spark, []), cache).count() == 0


PAGES = [
    (1, "http://a/x y", "<p>same</p>"), (2, "http://b", "<p>same</p>"), (3, None, None), (4, "http://d", ""), (5, "http://e\r\nX: 1", "été"),
    (None, "http://f", "<p>same</p>"), (None, "http://g", "alone"), (7, "http://h", "x" * 3_000_000), (2, "http://b", "<p>same</p>"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id bigint, url string, html string, record_type string, size int")


def test_archives(spark, tmp_path):
    listed = warc.write_archives(pages(spark), str(tmp_path))
    got = warc.read_archives(listed).collect()
    assert len(got) == len(PAGES) == sum(r.records for r in listed.collect())
    groups = {}
    for i, _, body in PAGES:
        groups.setdefault(body or "", []).append(i)
    want = []
    for i, url, body in PAGES:
        data = (body or "").encode()
        first = max((x for x in groups[body or ""] if x is not None), default=None)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr) == sorted(want, key=repr)
    for r in listed.collect():
        with open(r.path, "rb") as stream:
            assert stream.read(4) == (0x184D2A5D).to_bytes(4, "little")
        for headers, block in warc.records(r.path):
            assert headers["WARC-Type"] in ("response", "revisit") and block.startswith(b"HTTP/1.1 200 OK")
    urls = {r.url for r in got}
    assert "http://a/x%20y" in urls and "http://e%0D%0AX:%201" in urls and None in urls


def test_small_payloads_are_responses(spark, tmp_path):
    got = warc.read_archives(warc.write_archives(pages(spark), str(tmp_path), least=100)).collect()
    assert {r.record_type for r in got} == {"response"} and all(r.refers_to is None for r in got)
    assert warc.read_archives(warc.write_archives(pages(spark, []), str(tmp_path / "none"))).count() == 0


def test_trained_dictionary(tmp_path):
    archive = warc._Archive(str(tmp_path))
    rows = [warc.record(i, f"http://x/{i}", f"<html><body>{'text of a page ' * 20}{i}</body></html>".encode(), hashlib.sha1(b"").digest(), 0, None, False) for i in range(2000)]
    for r in rows:
        archive.add(r)
    path, records, size = archive.finish()
    assert records == 2000 and size < sum(map(len, rows)) / 4
    assert [int(h["X-Page-ID"]) for h, _ in warc.records(path)] == list(range(2000))
    broken = tmp_path / "cut.warc.zst"
    broken.write_bytes(open(path, "rb").read()[:-20])
    with pytest.raises(Exception):
        list(warc.records(str(broken)))


PAGE = """<!doctype html><html><head><title>x</title></head><body class="has-sidebar"><header class="site"><h1>Site</h1>
<nav><a href=a>home</a></nav></header><div id="cookie-notice">We use cookies to track you, and here is a long explanation.</div>
<div class="layout with-sidebar"><div class="content"><div class="post"><h1>The title</h1><div class="text">
<p>First paragraph with <a href="x">a link</a> and&nbsp;more text, &lt;b&gt; here it goes on and on for long.
<p>Second paragraph &eacute;t&eacute; goes on <b>bold</b>ly for quite a number of words as well.<ul><li>one item<li>two</ul></div>
<div class="text"><p>Third part.</p></div></div></div><div class="sidebar"><p>Sidebar text that is long enough to matter a lot.</p></div></div>
<div class="comments"><article class="comment"><p>I am a reader and write a very long comment, longer than the article itself, in order to
confuse the extraction, which should not fall for it at all, however long it may be in the end of it all.</p></article></div>
<form>name <input></form><footer>(c) me</footer><script>if (a<b) document.write("<p>no</p>")</script></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<p>a<p>b", "a b"), ("<!-- x <p>a</p>", ""),
        (PAGE, "The title First paragraph with a link and more text, <b> here it goes on and on for long. Second paragraph été goes on "
               "boldly for quite a number of words as well. one item two Third part."),
        ("<body><nav>x</nav><article><header><h1>T</h1></header><p>a  b<br>c</p></article><aside>no</aside></body>", "T a b c"),
        ("<body><div class='ad'>buy</div><div><p>only &#116;ext</p></div></body>", "only text"),
        ("<script>x</script>", ""),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_pages_of_the_given_table(spark):
    import re
    from html import unescape

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").unionByName(spark.createDataFrame([(None, None, None)], "page_id bigint, url string, html string"))
    got = {r.page_id: r for r in html.extracted(rows.withColumn("text", F.lit("clash"))).collect()}
    for r in rows.collect():
        found = re.search(r"<article>(.*?)</article>", r.html or "", re.S)
        want = re.sub(r"</?b>", "", re.sub(r"<(/?)(p|h1|br)\b[^>]*>", " ", found[1])) if found else ""
        assert got[r.page_id].text == " ".join(unescape(want).split()) and got[r.page_id].n_chars == len(got[r.page_id].text)
    assert html.extracted(rows.limit(0)).count() == 0


def test_deep_pages_are_linear():
    assert html.main_text("<div>" * 50_000 + "x") == "x"
    assert html.main_text("<p>a" * 50_000) == " ".join("a" * 50_000)


BODY = "".join(f"<p>Sentence {i} of the story goes on for quite a while, with many a word.</p>" for i in range(12))


@pytest.mark.parametrize("page", [
    f"<body><form id=f><input value=x>{BODY}<button>Go</button></form></body>",
    f"<body><form><nav>Menu</nav><article>{BODY}</article></form></body>",
    f'<body><div class="content-sidebar-wrap">{BODY}</div><footer>Foot</footer></body>',
    f'<body><article class="post comment-status-open">{BODY}</article><div id="comments"><p>{"Nice one. " * 9}</p></div></body>',
    f'<body><div>{BODY}</div><form class="newsletter"><p>Join us now</p></form><div class="nav-wrapper"><p>Home and away</p></div></body>',
])
def test_articles_in_odd_wrappers(page):
    text = html.main_text(page)
    assert text.startswith("Sentence 0 of") and text.endswith("many a word.") and text.count("Sentence") == 12


def test_query_of_pieces_returns_ids_and_what_they_decode_to(spark):
    """Every id, and the digest of the decoded text, as the sentencepiece library gives them."""
    folder = "/root/testdata/sf0.001"
    library = pieces.library(pieces.default_model())
    got = {r.doc_id: r for r in pieces.op3_sentencepiece(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        row, ids = got[d.doc_id], library.encode(d.text or "")
        assert row.ids == ids and row.n_tokens == len(ids) and row.parity
        text = pieces.decode(pieces.default_model(), [ids])[0]
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest() and row.restored == (text == (d.text or ""))
