"""Files, tokenizers, HTML, neighbours and near duplicates: round trips, brute force and odd cases."""

import json
import random
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sheaf.llm import html_wrapper as H
from sheaf.llm import parity_join as J
from sheaf.llm.cross_polytope import Hasher, last_axes, nearest
from sheaf.llm.elias_fano import EliasFano
from sheaf.llm.queries import tokenizer_file
from sheaf.llm.sentencepiece_codec import Codec, decode_documents, encode_documents
from sheaf.llm.token_files import ShardReader, read_token_files, token_file_digest, write_token_files

from tests.llm.helpers import components, shingles

BPE, SP = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
TEXTS = ["", "plain words here", "don't  stop\n\nnow \t x", " lead and trail ", "日本語 テスト\n次の行", "a<|endoftext|>b", "x y z\x85q\x1cr", "\n", "é" * 3000, "w1 w2\nw3", None, "tail\n"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62), max_size=700))
def test_elias_fano_round_trip(values):
    v = np.sort(np.array(values, np.int64))
    e = EliasFano.from_bytes(EliasFano.build(v).to_bytes())
    assert (e.all() == v).all()
    assert all(e.select(i) == v[i] for i in range(0, len(v), 13))


def test_elias_fano_is_small():
    v = np.sort(np.random.default_rng(0).integers(0, 10**9, 10_000))
    assert len(EliasFano.build(v).to_bytes()) * 8 / len(v) < 21  # 2 + log2(1e9 / 1e4) = 18.6, and places


def docs(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_token_files_against_the_library(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    rows = [*enumerate(TEXTS * 3), (5, "again"), (None, "no id"), (-9, "first")]
    folder = f"file://{tmp_path}/files"
    manifest = write_token_files(docs(spark, rows).withColumn("n_tokens", F.lit(0)), folder, BPE, shards=3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in read_token_files(manifest).collect())
    at, want = 0, []
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want.append((at, d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    reader = ShardReader(min(r.path for r in manifest.collect()))
    assert reader.doc_id(1) == -9 and reader.document(1).tolist() == [*t.encode("first").ids, 2]
    assert token_file_digest(spark, docs(spark, []).where("false"), BPE).count() == 0


def test_sentencepiece_parity_and_round_trip(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SP)
    rows = list(enumerate(TEXTS))
    out = encode_documents(docs(spark, rows).withColumn("ids", F.lit("clash")), SP)
    back = {r.doc_id: r for r in decode_documents(out, SP).collect()}
    for d, x in rows:
        assert back[d].ids == sp.encode(x or "")
        assert back[d].decoded == (x or "") and back[d].round_trip and back[d].parity
    assert encode_documents(docs(spark, []).where("false"), SP).count() == 0


@pytest.fixture(scope="module")
def codecs(tmp_path_factory):
    import sentencepiece

    path = str(tmp_path_factory.mktemp("models") / "unigram.model")
    with open(path, "wb") as f:
        f.write(unigram_model())
    return {kind: (Codec(p), sentencepiece.SentencePieceProcessor(model_file=p)) for kind, p in (("bpe", SP), ("unigram", path))}


def unigram_model():
    """A unigram model with a character map, trimming and byte fallback, its pieces and scores by rule: nothing is trained."""
    import struct

    import sentencepiece

    def field(number, data):
        size, out = len(data), b""
        while size > 127:
            out, size = out + bytes([size & 127 | 128]), size >> 7
        return bytes([*([number << 3 | 2] if number < 16 else [(number << 3 | 2) & 127 | 128, number >> 4])]) + out + bytes([size]) + data

    def piece(text, score, kind=1):
        return field(1, field(1, text.encode()) + b"\x15" + struct.pack("<f", score) + bytes([0x18, kind]))

    rng = random.Random(12)
    parts = sorted({"".join(rng.choice("abcdelnorst") for _ in range(rng.randint(1, 4))) for _ in range(300)} | set("abcdefghijklmnopqrstuvwxyz0123456789.,"))
    own = [piece("<unk>", 0, 2), piece("<s>", 0, 3), piece("</s>", 0, 3), *(piece(f"<0x{i:02X}>", 0, 6) for i in range(256)), piece("\u2581", -3.0)]
    own += [piece(mark + p, -4.0 - rng.random() * 6 + len(p)) for p in parts for mark in ("", "\u2581")]
    normal = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    return b"".join(own) + b"\x12" + bytes([5]) + b"\x18\x01\x98\x02\x01" + normal[normal.index(b"\x1a") :]


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("abnor st 1\n\té日_.▁ﬁＡ"), max_size=30), max_size=4))
def test_sentencepiece_any_text(codecs, kind, texts):
    codec, sp = codecs[kind]
    ids = codec.encode(texts)
    assert [x.tolist() == sp.encode(t) for x, t in zip(ids, texts, strict=True)] == [codec.parity(t) for t in texts]
    if kind == "bpe":
        assert all(codec.parity(t) for t in texts)
    else:
        assert all(codec.parity(t) for t in texts if t.isascii() and "\n" not in t and "\t" not in t)
    assert all(d == sp.decode(x.tolist()) for d, x in zip(codec.decode(ids), ids, strict=True))


def test_sentencepiece_parity_can_fail():
    codec = Codec(SP)
    theirs = codec.their_words
    codec.their_words = type("Other", (), {"encode": lambda _, texts, num_threads: [[0 if i == 278 else i for i in x] for x in theirs.encode(texts, num_threads=1)]})()
    ids = codec.encode(["the cat", "a cat", "cat\nthe cat", "the"])
    assert [codec.parity(t) for t in ["the cat", "a cat", "a the cat"]] == [278 not in ids[0], True, True] or 278 in ids[0]
    assert all((278 in x) != codec.parity(t) for x, t in zip(ids, ["the cat", "a cat", "cat\nthe cat", "the"], strict=True))


def page(title, paragraphs, side="news"):
    body = "".join(f"<p>{p}</p>" if i % 2 else f"<p>{p}" for i, p in enumerate(paragraphs))
    return f'<html><head><title>{title}</title><style>p{{}}</style></head><body><div id="top-nav" class="menu"><a href="/">Home</a></div><div class="layout has-sidebar"><main><h1>{title}</h1>{body}<div class="comments"><p>so true</p></div></main><div class="sidebar">{side}</div></div><div class="cookie-banner">We use cookies</div><footer>&copy; site</footer></body></html>'


def test_html_wrapper_and_odd_pages(spark):
    rows = [(i, f"http://site.example/{i}", page(f"Title {i}", [f"Text &amp; {i} {k}" for k in range(i % 5 + 1)])) for i in range(12)]
    rows += [(100, None, "<p>x<p>y"), (101, "http://q", None), (102, "nonsense", ""), (103, "http://z/", "a < b & c &lt; d"), (104, "http://deep/", "<div>" * 3000 + "deep" + "</div>" * 3000), (0, "http://site.example/0", page("Title 0", ["Text &amp; 0 0"]))]
    got = H.extract_pages(docs(spark, rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("h"))).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i in range(12):
        assert by[i].text == "\n\n".join([f"Title {i}", *(f"Text & {i} {k}" for k in range(i % 5 + 1))])
    assert [by[i].text for i in (100, 101, 102, 103, 104)] == ["x\n\ny", "", "", "a < b & c < d", "deep"]
    assert all(r.n_chars == len(r.text) for r in got)
    assert H.extract_pages(docs(spark, [], "page_id long, url string, html string").where("false")).count() == 0


def test_wrapper_is_union_free_and_accepts_its_pages():
    w = None
    for n in (3, 1, 4):
        new = H.wrap(H.parse(f"<div><h2>T{n}</h2>" + "<p>a</p>" * n + ("<ul><li>x</ul>" if n == 4 else "") + "<i>same</i></div>"))
        w = new if w is None else H.join(w, new)
    assert H.expression(w) == "<html><div><h2>#text</h2>(<p>a</p>)+(<ul><li>x</li></ul>)?<i>same</i></div></html>"
    assert H.expression(H._load(H._dump(w))) == H.expression(w)


def extracted(pages, host="http://h.example"):
    """The texts of pages of one host, by their own wrapper."""
    w = None
    for p in pages:
        new = H.wrap(H.parse(p))
        w = new if w is None else H.join(w, new)
    rule = H.load_rule(json.dumps(H.rule_of(H._load(H._dump(w)))))
    return [H.extract(p, rule) for p in pages]


def test_class_words_drop_parts_only_by_whole_names():
    kept = "search-results form-factor related-work side-effects legal-analysis social-history share-price comment-text notice-period rail-transport market-share light-rail".split()
    gone = "comments comment-list reader-comments cookie-banner ad ad-slot right-rail related-posts share-buttons top-nav newsletter site-footer breadcrumbs".split()
    pages = [f"<body><div class='top-nav'>Menu</div><article><h1>T{i}</h1>" + "".join(f"<div class='{c}'>{c} says {i} {k}</div>" for k, c in enumerate(kept)) + "".join(f"<div class='{c}'>junk {i}</div>" for c in gone) + "</article></body>" for i in range(6)]
    for one in ([pages[0]], pages):
        assert extracted(one) == ["\n\n".join([f"T{i}", *(f"{c} says {i} {k}" for k, c in enumerate(kept))]) for i in range(len(one))]


def test_constant_parts_of_a_host_go_and_headings_with_text_stay():
    same = "one line that begins alike " * 20
    pages = [f"<html><body><header>Site</header><div id='x'><h1>Title {i}</h1><p>{same}{i}</p><h2>Method</h2><p>text {i} a</p><p>Follow us for more</p><div>Terms apply to all</div>" + "<p>more words here</p>" * (i == 3) + f"<h2>Read on</h2><p>Follow us for more</p><ul><li>point {i}<li>other {i}</ul></div><footer>f</footer></body></html>" for i in range(12)]
    got = extracted(pages)
    for i in range(12):
        want = [f"Title {i}", f"{same}{i}", "Method", f"text {i} a", *["more words here"] * (i == 3), "Read on", f"point {i}", f"other {i}"]
        assert got[i].split("\n\n") == want
    assert extracted(pages[:1] * 1)[0].count("Follow us") == 2  # a single page shows nothing to be constant
    assert extracted([pages[0]] * 9)[0].count("Follow us") == 2  # nor do copies of one


def test_deep_pages_and_generated_names():
    deep = ["<nav>MENU</nav>" + "<div>" * 3000 + f"one {i}<p>two</p><nav>inner</nav>three {i}" + "</div>" * 3000 for i in range(5)]
    sys.setrecursionlimit(10**6)
    assert extracted(deep) == [f"one {i}\n\nthree {i}" for i in range(5)]
    assert extracted(deep[:2]) == [f"one {i}\n\ntwo\n\nthree {i}" for i in range(2)]
    w, rng = None, random.Random(4)
    name = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(7))
    pages = ["<body>" + "".join(f"<div class='{name()}'><span id='{name()}'>{name()}</span></div>" for _ in range(15)) + f"<article>{name()} {name()}</article>" + "".join(f"<{t}>{name()}</{t}>" for t in rng.sample(["section", "p", "div", "ul", "table"], 3)) + "</body>" for _ in range(1500)]
    for p in pages:
        new = H.wrap(H.parse(p))
        w = new if w is None else H.join(w, new)
    assert H.size(w) < H.MOST_NODES and len(H._dump(w)) < 200_000


def test_every_page_against_a_plain_reading(spark):
    """The test pages have one article each; its blocks, read by a regular expression, are the text."""
    import html
    import re

    from sheaf.llm.queries import op1_html_wrapper

    from tests.conftest import SF

    raw = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in op1_html_wrapper(spark, SF).collect():
        [inside] = re.findall(r"<article>(.*?)</article>", raw[r.page_id], re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", inside))
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts]
        assert r.text == "\n\n".join(x for x in want if x)


def test_neighbours_recall_and_odd(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24))
    x[700:900] = x[0] + rng.normal(size=(200, 24)) * 1e-3  # near copies
    x[900:910] = x[1]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] + [1.0] * 23), (5060, [1.0, 2.0]), (None, [1.0] * 24), (5080, [None] + [1.0] * 23)]
    got = nearest(docs(spark, rows + odd, "vec_id long, embedding array<double>").withColumn("id", F.lit("x")), F.col("id") % 20 == 0, bucket_rows=300, query_rows=20).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i in range(0, 1500, 20)}
    hit = 0
    for q, found in by.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and q not in [r.vec_id for r in found]
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        hit += len({r.vec_id for r in found} & set(np.lexsort((np.arange(1500), -s))[:20].tolist()))
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in found)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
    assert hit / (20 * len(by)) >= 0.9


@pytest.mark.parametrize("n, last", [(0, 0), (128 * 100, 0), (128 * 100 + 1, 1), (256 * 100 + 1, 2), (10**12, 64)])
def test_buckets_grow_with_the_vectors(n, last):
    assert last_axes(n, 64, 100) == last
    hasher = Hasher(60, 2, n=n, even_rows=100)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(70, 60))
    ranks, (_, own) = hasher.ranks(x), hasher.of(x)
    assert all(sorted(r) == list(range(hasher.codes)) for r in ranks.reshape(-1, hasher.codes))
    assert (ranks[np.arange(70)[:, None], [0, 1], own] == 0).all()  # a vector's own bucket comes first
    for count in (1, 7, hasher.codes):
        probed = hasher.probed(x, count).reshape(70, 2, count) - np.array([0, hasher.codes])[:, None]
        assert all((ranks[i, t, probed[i, t]] < count).all() and len(set(probed[i, t])) == count for i in range(70) for t in range(2))


@pytest.mark.parametrize("lengths, even, kind", [("lognormal", 4000, "double"), ("one long", 4000, "double"), ("lognormal", 20, "double"), ("alike", 20, "float")])
def test_neighbours_recall_for_unequal_lengths(spark, lengths, even, kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    if lengths == "lognormal":
        x *= np.exp(rng.normal(size=len(x)))[:, None]
    elif lengths == "one long":
        x[7] *= 5
    if kind == "float":
        x = x.astype(np.float32).astype(np.float64)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")
    got = {}
    for r in nearest(rows, F.col("id") % 20 == 0, even_rows=even).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert abs(r.score - x[r.query_id] @ x[r.vec_id]) < 1e-12 * (1 + abs(r.score))
    hit = 0
    for q in range(0, len(x), 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hit / (20 * len(got)) >= 0.9


@pytest.mark.parametrize("n", [0, 1, 5, 21])
def test_few_vectors_give_all(spark, n):
    rows = [(20 * i, [float(i + 1), 1.0]) for i in range(n)]
    got = nearest(docs(spark, rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).collect()
    assert Counter(r.query_id for r in got) == {20 * i: min(20, n - 1) for i in range(n) if n > 1}


def near_copies(seed=7):
    """Families around the limit, a chain whose ends do not link, a hot passage in unrelated texts, copies, small and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    out = []

    def edited(ws, k):
        ws = ws[:]
        for _ in range(k):
            ws[rng.randrange(len(ws))] = word()
        return ws

    for n in (6, 9, 12, 26, 29, 33, 40, 80, 200, 700):
        base = [word() for _ in range(n)]
        out += [base] + [edited(base, max(1, round(n * s))) for s in (0.005, 0.01, 0.02, 0.03, 0.04) for _ in range(3)] + [base[: max(1, int(n * c))] for c in (0.79, 0.8, 0.81, 0.85, 0.95)]
    chain = [word() for _ in range(120)]
    for _ in range(12):
        out.append(chain)
        chain = edited(chain, 2)
    passage = [word() for _ in range(60)]
    out += [[word() for _ in range(40)] + passage + [word() for _ in range(40)] for _ in range(40)]
    out += [passage[:50] + [word() for _ in range(9)] for _ in range(15)]
    out += [out[3]] * 5 + [["same"] * 50] * 3 + [["a", "b"], ["a", "b"], ["a", "c"]]
    texts = [" ".join(w) for w in out] + ["", None, " \n", "A B", "a\tb"]
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


@pytest.mark.parametrize("seed", [7, 8])
def test_near_duplicates_against_all_pairs(spark, seed):
    rows = near_copies(seed)
    sets = {d: shingles(t) for d, t in rows}
    want = components(sets)
    block_rows, bits = {7: (8192, 64), 8: (7, 6)}[seed]  # 8: groups cut into blocks, and class ids that many sets have
    got = J.near_duplicates(docs(spark, rows).withColumn("cls", F.lit("x")), bucket_keys=2000, block_rows=block_rows, class_bits=bits).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(sets[d]), want[d]) for d in sets}


def test_near_duplicates_long_texts_and_many_that_share_a_part(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    long = [word() for _ in range(100_000)]
    near = long[:]
    for k in range(0, 100_000, 2500):
        near[k] = word()
    far = long[:70_000] + [word() for _ in range(30_000)]
    part = [word() for _ in range(120)]
    mixed = [part + [word() for _ in range(40)] for _ in range(2000)]
    texts = [long, near, far, *mixed, [*mixed[5][:-1], "x"]]
    got = {r.doc_id: r.component_id for r in J.near_duplicates(docs(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), block_rows=300).collect()}
    assert got == {i: {1: 0, len(texts) - 1: 8}.get(i, i) for i in range(len(texts))}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab A\n\t\x0b\x85é"), max_size=40)), max_size=12))
def test_shingle_sets_of_a_batch(texts):
    import pyarrow as pa
    from sheaf.llm.shingles import shingle_sets

    known = test_shingle_sets_of_a_batch.__dict__.setdefault("known", {})
    flat, start = shingle_sets(pa.array(texts, pa.string()))
    for t, a, b in zip(texts, start[:-1], start[1:], strict=True):
        own, want = flat[a:b].tolist(), shingles(t)
        assert own == sorted(set(own)) and len(own) == len(want)
        assert known.setdefault(want, own) == own
    assert len({tuple(v) for v in known.values()}) == len(known)


def test_shingle_sets_of_slices():
    import pyarrow as pa
    from sheaf.llm.shingles import pieces, shingle_sets

    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcDEF") for _ in range(4)) for _ in range(rng.choice([0, 3, 200, 5000]))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(300))], names=["text", "id"])
    for most in (10_000, 100_000):
        parts = list(pieces(batch.slice(7).filter(pa.array([rng.random() < 0.8 for _ in range(293)])), most))
        for part in parts:
            flat, start = shingle_sets(part.column("text"))
            for i, a, b in zip(part.column("id").to_pylist(), start[:-1], start[1:], strict=True):
                assert len(shingles(texts[i])) == b - a and (flat[a:b] == shingle_sets(pa.array([texts[i]]))[0]).all()
        assert len(parts) > 3


def test_group_members_are_compared_as_all_pairs():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2**63, 300, dtype=np.uint64) for _ in range(6)]
    sets = [np.unique(np.r_[base[i % 6][: 300 - rng.integers(0, 60)], rng.integers(0, 2**63, rng.integers(0, 40), dtype=np.uint64)]) for i in range(240)]
    n = np.array([len(s) for s in sets])
    cls, comp = np.arange(240), rng.integers(0, 80, 240)
    every = np.concatenate(sets)
    alone = {int(x) for x, k in zip(*np.unique(every, return_counts=True), strict=True) if k == 1}
    c = np.array([len(s) - sum(int(x) in alone for x in s) for s in sets])
    sketch = np.stack([J.bit_sketch(s) for s in sets])
    for side in (np.zeros(240, np.int8), rng.integers(0, 2, 240).astype(np.int8)):
        got = set(J.near_in_group(cls, comp, n, c, sketch, side))
        want = {(i, j) for j in range(240) for i in range(j) if comp[i] != comp[j] and (not side.any() or side[i] != side[j]) and J.links(sets[i], sets[j])}
        assert want <= got and len(got) <= 2 * len(want) + 20


def test_sketches_fold_to_smaller_ones():
    s = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64))
    wide = J.bit_sketch(s)
    assert len(wide) * 64 == 32768
    bits = np.bincount((J.mix(s ^ np.uint64(0xA0761D6478BD642F)) & np.uint64(4095)).astype(np.int64), minlength=4096) & 1
    assert (np.unpackbits(J.fold(wide, 64).view(np.uint8), bitorder="little") == bits).all()


def test_near_duplicates_odd(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, None), (None, "a b c d e f"), (None, "lone text of its own here"), (3, "a b c d e f")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in J.near_duplicates(docs(spark, rows)).collect())
    assert got == Counter([(1, 2, 1), (1, 2, 1), (2, 0, 2), (None, 2, 1), (None, 2, None), (3, 2, 1)])
    assert J.near_duplicates(docs(spark, []).where("false")).count() == 0


def test_bands_leave_two_full_words_to_agree():
    bands = J.Bands(100_000)
    for r, d, b in zip(bands.right.tolist(), bands.differ.tolist(), bands.blocks.tolist(), strict=True):
        assert (r + r * 5 // 4) // 9 <= d and b - d >= 3
    for n in range(J.SMALL, 3000):
        for m in range(n, n * 5 // 4 + 1):
            assert set(bands.of(n)) & set(bands.of(m))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as C

    from tests.conftest import SF

    kept = spark.read.parquet(f"{SF}/documents.parquet")
    columns = kept.columns
    for name, stage in C.STAGES:
        out = stage(spark, kept, SF)
        path = str(tmp_path / name.split()[0])
        out.write.parquet(path)
        after = spark.read.parquet(path)
        before_ids = {r.doc_id: r.text for r in kept.select("doc_id", "text").collect()}
        ids = {r.doc_id: r.text for r in after.select("doc_id", "text").collect()}
        assert set(ids) <= set(before_ids) and len(ids) > 0
        if name != C.STAGES[-1][0]:
            assert after.columns == columns
        if name.startswith("n-gram"):
            want = components({d: shingles(t) for d, t in before_ids.items()})
            assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(d for d in before_ids if want[d] == d)
        elif not name.startswith("line"):
            assert all(before_ids[d] == t for d, t in ids.items())
        kept = after


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline as C

    text, other = "one two three four five six seven eight nine ten", "quite another text of its own with more words in it"
    rows = [(1, text), (1, text), (None, text), (None, text), (2, text), (1, other), (3, other), (4, ""), (4, ""), (5, None), (None, None), (None, None), (6, "short one")]
    frame = docs(spark, [(d, t, "x", 7) for d, t in rows], "doc_id long, text string, cls string, _th long")
    got = C.near_duplicate_join(spark, frame, SF_NONE)
    assert got.columns == frame.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(1, text), (1, other), (4, ""), (5, None), (None, None), (6, "short one")])
    assert C.near_duplicate_join(spark, frame.where("false"), SF_NONE).count() == 0


SF_NONE = "/nowhere"
