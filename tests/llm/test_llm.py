import base64
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.llm import bpe, html, langid, neardup, packing, pii, quality, registry, sharding, substring_dedup, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 3000
#: Nulls, empty and very long texts, repeated rows, and texts without a word or a letter.
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, LONG, "en", "s", len(LONG)), (4, "one", None, "s", 3), (4, "one", None, "s", 3), (None, "no id at all", "en", None, 12), (5, " \n\t ", "en", "s", 4), (6, "123 456 !!", None, "s", 10), (7, "a\x1cb\x85c 漢字 😀", "en", "s", 9)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def texts(data):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, data, name):
    from compare import assert_same

    assert_same(registry.queries()[name](spark, data), registry.oracle_sql()[name], data)


# Top-k.


def test_topk_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (100, [0.5, -1.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [1.0]), (None, [1.0, 2.0]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("id", F.lit(2))
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 5, 5 * 1024**2), (0, 2, 5, 5 * 1024**2), (0, 3, 6, 1024**2), (100, 1, 6, 512 * 1024), (100, 2, 7, 0), (100, 3, 0, -int(1.5 * 1024**2))]
    assert topk.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_in_blocks(spark):
    rnd = np.random.default_rng(2)
    v = rnd.normal(size=(400, 13))
    v[50:80] = v[49]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(5)
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 7 == 0, 6, query_bytes=2000).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    e = np.floor(v * 1024).astype(int)
    for q in range(0, 400, 7):
        s = e @ e[q]
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:6]
        assert got[q] == [(i, s[i]) for i in order]


@pytest.mark.parametrize("seeds, broadcast", [(0, True), (50, False)])
def test_topk_prunes(spark, seeds, broadcast, monkeypatch):
    """Clustered vectors: most pairs go by their bounds, and the result is that of all products."""
    if not broadcast:
        monkeypatch.setattr(topk, "BROADCAST_BYTES", 0)
    rnd = np.random.default_rng(3)
    v = np.repeat(rnd.normal(size=(20, 16)), 100, axis=0) + 0.05 * rnd.normal(size=(2000, 16))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    tally = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, seeds=seeds, query_bytes=1000, tally=tally).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    e = np.floor(v * 1024).astype(int)
    for q in range(0, 2000, 50):
        s = e @ e[q]
        assert got[q] == [(i, s[i]) for i in [i for i in np.lexsort((np.arange(2000), -s)) if i != q][:5]]
    assert tally[0].value == 40 * 2000 and (not seeds or tally[1].value < 0.25 * tally[0].value)


# Substring dedup.


def brute_repeats(rows, length=13):
    first = {}
    split = [(i, words(t)) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, w in split:
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def passages_of(rnd, n):
    vocabulary = ["ab", "b", "cé", "d"]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.randrange(13, 40))] for _ in range(12)]
    for i in range(n):
        w = [rnd.choice(vocabulary + ["x%d" % rnd.randrange(50)]) for _ in range(rnd.randrange(0, 30))]
        for _ in range(rnd.randrange(0, 3)):
            at = rnd.randrange(len(w) + 1)
            p = passages[rnd.randrange(12)]
            w[at:at] = p[rnd.randrange(3) : len(p) - rnd.randrange(3)]
        yield i, " ".join(w)


def repeats(df, places):
    defaults = substring_dedup.repeated_spans.__defaults__
    substring_dedup.repeated_spans.__defaults__ = (13, 5, places)
    try:
        return substring_dedup.remove_repeats(df).collect()
    finally:
        substring_dedup.repeated_spans.__defaults__ = defaults


@pytest.mark.parametrize("places", [1, 3, 1000])
def test_substring_against_brute_force(spark, places):
    rows = list(passages_of(random.Random(places), 80))
    rows += [(200 + k, rows[k][1]) for k in range(0, 40, 3)] * 2
    got = repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), places)
    left = brute_repeats(rows)
    assert len(got) == len(rows)
    for r in got:
        own = dict(rows)[r.doc_id]
        assert words(r.text) == left[r.doc_id] and r.n_removed == len(words(own)) - len(left[r.doc_id])
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def brute_rows(rows, length=13):
    """What is left of each row, where ids may repeat: a window goes if it starts in a row with a smaller id."""
    first = {}
    split = [(i, words(t)) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - length + 1):
            first[tuple(w[k : k + length])] = min(first.get(tuple(w[k : k + length]), i), i)
    out = []
    for i, w in split:
        gone = {j for k in range(len(w) - length + 1) if first[tuple(w[k : k + length])] < i for j in range(k, k + length)}
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_substring_with_repeated_ids(spark, parts):
    c, u = [f"c{k}" for k in range(40)], [f"u{k}" for k in range(40)]
    z = ["z0", "z1", "z2"]
    rows = [(3, c), (5, c), (5, u), (7, c + u[:5]), (7, z + c), (6, c), (7, z + c), (8, u[:20])]
    rows = [(i, " ".join(w)) for i, w in rows] + [(i // 3, t) for i, t in passages_of(random.Random(parts), 60)]
    for places in (1, 1000):
        got = repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), places)
        assert sorted((r.doc_id, " ".join(words(r.text))) for r in got) == brute_rows(rows)


def test_automaton_statistics():
    rnd = random.Random(1)
    for _ in range(200):
        a = substring_dedup.SuffixAutomaton()
        held = [([rnd.choice("abc") for _ in range(rnd.randrange(12))], rnd.randrange(5)) for _ in range(rnd.randrange(5))]
        for w, owner in held:
            a.add(w, owner)
        a.settle()
        t = [rnd.choice("abc") for _ in range(15)]
        best = [max((n for n in range(e + 1) if n == 0 or any("".join(t[e - n : e]) in "".join(w) for w, _ in held)), default=0) for e in range(1, 16)]
        assert [n for n, _ in a.matches(t)] == best
        for before in range(6):
            want = sum(1 << k for k in range(13) if any("".join(t[k : k + 3]) in "".join(w) for w, o in held if o < before))
            assert a.repeated_before(t, 3, before) == want


def test_substring_odd_rows(spark, odd):
    got = substring_dedup.remove_repeats(odd).collect()
    assert len(got) == len(ODD) and all(r.n_removed == 0 for r in got)
    assert substring_dedup.remove_repeats(odd.where("false")).count() == 0


# BPE and packing.


def test_bpe_chunks_agree_with_the_library():
    b = bpe.ByteBPE(bpe.rank_path())
    rnd = random.Random(7)
    signs = ["a", "B", "'s", "'l", "'ll", " ", "  ", "\n", "\t", "é", "1", "!", " ", "\x1c", "\x85", "漢", "\U0001f600", "'", "re"]
    for _ in range(3000):
        t = "".join(rnd.choice(signs) for _ in range(rnd.randrange(60)))
        b.chunk, b.overlap = rnd.randrange(1, 12), rnd.randrange(1, 8)
        ids = b.encode(t)
        assert ids.tolist() == b.whole.encode_ordinary(t) and b.decode(ids) == t.encode()


def digests(ids):
    return hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_bpe_query_against_the_library(spark, data, texts):
    b = bpe.ByteBPE(bpe.rank_path())
    got = {r.doc_id: r for r in bpe.op3_byte_bpe(spark, data).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = b.whole.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), digests(ids), hashlib.sha256((t or "").encode()).hexdigest())


def test_bpe_long_texts_by_rows(spark, texts):
    """Texts of many chunks, with runs longer than an overlap, repeated ids and texts."""
    b = bpe.ByteBPE(bpe.rank_path())
    own = [t for t in texts.values() if t]
    rows = [(1, " ".join(own)[:40_000]), (1, " ".join(own)[:40_000]), (1, "x" * 3000 + " end " + "y1 " * 2000), (None, " \n" * 4000), (2, "short"), (3, None), (4, "漢字'll 😀 " * 900), (5, "a" * 999 + "\ud800" if False else "é" * 2100)]
    got = bpe.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), chunk=1000, overlap=40).collect()
    want = sorted((str(i), b.whole.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), list(r.ids)) for r in got) == want and all(bytes(r.decoded) == b.decode(np.array(r.ids, np.uint32)) and r.n_tokens == len(r.ids) for r in got)


def test_bpe_odd_rows(spark, odd):
    got = bpe.encode_documents(odd).collect()
    assert len(got) == len(ODD)
    assert sorted(bytes(r.decoded).decode() for r in got) == sorted(t or "" for _, t, *_ in ODD)
    assert bpe.encode_documents(odd.where("false")).count() == 0


def test_tokenizers_agree(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder(bpe.rank_path(), packing.added_tokens())
    odd = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", " <|endoftext", "\n<|endoftext|>\n\n  c"]
    for text in [*texts.values(), *odd]:
        assert list(encode(text)) == t.encode(text, add_special_tokens=False).ids
    assert 50256 in encode(odd[0])


def test_packing_holds_every_token_once(spark, odd, texts):
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(i + 100, t) for i, t in texts.items()], "doc_id long, text string"))
    b = bpe.ByteBPE(bpe.rank_path())
    got = packing.pack(df).toPandas()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        ends = np.append(0, np.cumsum(g.length))
        assert (g.offset.to_numpy() == ends[:-1]).all() and ends[-1] <= 2048
    for i, t in [(3, LONG), *((k + 100, v) for k, v in list(texts.items())[:40])]:
        ids = np.append(b.encode(t), 0).astype("<u4")
        own = got[got.doc_id == i].sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and (own.length.to_numpy()[1:] == 2048).all()
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)] and own.length.sum() == len(ids)
    assert len(got[got.doc_id == 4]) == 2 and len(got[got.doc_id.isna()]) == 1
    assert packing.pack(df.where("false")).count() == 0


def test_packing_query_against_the_library(spark, data, texts):
    """Every piece of every document of the table, and no more sequences than plain best fit decreasing, piece by piece."""
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, lengths = set(), []
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.add((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            lengths.append(b - a)
    got = packing.op6_best_fit_packing(spark, data).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    free: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [(f, k) for k, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits)[1]] -= n
        else:
            free.append(2048 - n)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert len(sequences) <= len(free)
    for own in sequences.values():
        assert [o for o, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist() and sum(n for _, n in own) <= 2048


def held(patterns):
    out = collections.Counter()
    for copies, pattern in patterns:
        assert sum(n * k for n, k in pattern.items()) <= 2048
        for n, k in pattern.items():
            out[n] += copies * k
    return out


def test_configurations_are_near_the_bound():
    rnd = np.random.default_rng(1)
    h = collections.Counter(np.minimum(2048, rnd.lognormal(6, 1, 20000).astype(int) + 1).tolist())
    found, figures = packing.solve(h)
    assert held(found) == h and sum(c for c, _ in found) == figures["sequences"] == figures["bound"]
    assert packing.solve({})[0] == [] and packing.solve({2048: 4})[0] == [(4, {2048: 1})]


@pytest.mark.parametrize("kind, gap", [("hot 700", 1.13), ("hot 1100", 1.003), ("200-1500", 1.002), ("two halves", 1.006), ("thirds", 1.05)])
def test_configurations_need_no_more_than_best_fit(kind, gap):
    """The gap is to the bound from below, which holds for any packing."""
    rnd = np.random.default_rng(1)
    lengths = {
        "hot 700": [*rnd.integers(1, 2049, 20000), *[700] * 10000],
        "hot 1100": [*np.minimum(2048, rnd.lognormal(6, 1, 20000).astype(int) + 1), *[1100] * 10000],
        "200-1500": rnd.integers(200, 1501, 20000),
        "two halves": [*rnd.integers(1030, 1401, 10000), *rnd.integers(640, 1021, 10000)],
        "thirds": [*rnd.integers(683, 800, 10000), *rnd.integers(500, 683, 20000)],
    }[kind]
    h = collections.Counter(int(n) for n in lengths)
    found, figures = packing.solve(h)
    assert held(found) == h and sum(c for c, _ in found) == figures["sequences"]
    assert figures["sequences"] <= figures["best_fit"] == sum(c for c, _ in packing.best_fit(h, 2048))
    assert figures["bound"] <= figures["sequences"] <= gap * figures["bound"]
    if kind in ("200-1500", "thirds"):
        assert figures["program"] > 0.5 * figures["sequences"] and figures["sequences"] < figures["best_fit"]


def test_spots_find_ranks():
    h = collections.Counter({700: 25, 1300: 9, 40: 300, 2048: 3})
    spots = packing.Spots(packing.places(packing.solve(h)[0]))
    rows = [(n, r) for n, k in h.items() for r in range(k)]
    sequence, offset = spots(np.array([n for n, _ in rows], np.int32), np.array([r for _, r in rows]))
    for s in set(sequence.tolist()):
        own = sorted((o, n) for o, n, q in zip(offset.tolist(), (n for n, _ in rows), sequence.tolist()) if q == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048


# HTML.


def test_html():
    weights = {"a": -4.0, "li": -4.0, "p": -0.2, "div": -3.0}
    page = """<html><head><title>x</title></head><body><header>Site name</header><nav><ul><li><a href=/>Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies on this site, please agree to all of them now</div>
    <article><h1>Title &amp; more</h1><p>First <b>bold</b>  text<br>goes on here.<p>Second paragraph of words<aside>Related things</aside>
    <form>Sign up <input></form><script>var x = "<p>no</p>";</script><p>Third &eacute;</article><section id="comments"><p>I like this very much indeed, thank you</section><footer>end</footer></body></html>"""
    assert html.Page(page, weights).main_text() == "Title & more\n\nFirst bold text goes on here.\n\nSecond paragraph of words\n\nThird é"
    for s in ("", "<", "<a <a", "<!-- x", "<script>a", "<p>", "&amp;", "<div>" * 500):
        html.Page(s, weights).main_text()


@pytest.mark.parametrize("end", ["</head><body>", "<body>", ""])
def test_html_head_without_end(end):
    page = f"<html><head><title>Name</title><meta charset=utf-8><style>p {{}}</style>{end}<article><p>First words of it<p>and the rest</article>"
    assert html.Page(page, {"p": -0.2}).main_text() == "First words of it\n\nand the rest"


PROSE = "Many good words that make a text of their own which nobody should drop from it because it is what the page is there for and more words than a list of links would have in it."


@pytest.mark.parametrize(
    "body, want",
    [
        ("<ul><li class=share>Share this<li>good words of the list here</ul><p>body of it", "good words of the list here\n\nbody of it"),
        ("<dl><dt class=ad>Buy<dd>kept meaning<dt>term<dd class=promo>now</dl><p>rest", "kept meaning\n\nterm\n\nrest"),
        ("<table><tr><td class=social>Like<td>cell one<tr class=ad><td>x<tr><th>head<td>cell two</table><p>rest", "cell one\n\nhead\n\ncell two\n\nrest"),
        ("<table><thead class=ad><tr><th>Buy<tbody><tr><td>kept</table>", "kept"),
        (f'<section class="related work"><h2>Related work</h2><p>{PROSE}</section><p>rest', f"Related work\n\n{PROSE}\n\nrest"),
        ("<div class=related><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div><p>rest of it", "rest of it"),
        (f"<div class=comments><p>{PROSE}</div><p>rest", "rest"),
        ("<div class=ad/>gone</div><p>kept<div>on", "kept\n\non"),
        ("<p>one <span class=share>Share</span> two<p><b>three<p>four", "one two\n\nthree\n\nfour"),
    ],
)
def test_html_implied_ends_and_marks(body, want):
    weights = {"a": -4.0, "li": -4.0, "p": -0.2, "div": -3.0}
    assert html.Page(f"<body><nav><a>x</a></nav><article><h1>Name</h1><p>{PROSE}</p>{body}</article><footer>end", weights).main_text() == f"Name\n\n{PROSE}\n\n{want}"


def test_html_learned_marks(spark):
    """A mark that no list has goes if labelled pages have it outside; one of the list stays if they have texts of it inside."""
    page = "<body><div class=xyz><p>{0}</p></div><article><h1>T</h1><p>{0}</p><div class=sidebar><p>{0}</p></div></article>"
    pages = spark.createDataFrame([(i, page.format(PROSE)) for i in range(300)], "page_id long, html string")
    model = html.fit(pages)
    got = html.Page(page.format(PROSE).replace("<article>", "<article><div class=xyz><p>" + PROSE + "</p></div>"), model).main_text()
    assert got == f"T\n\n{PROSE}\n\n{PROSE}"


def test_html_pages(spark, data):
    from html import unescape

    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r.text for r in html.op4_html_main_text(spark, data).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner.replace("<br>", " ")))
        assert got[r.page_id] == "\n\n".join(filter(None, blocks))


def test_html_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "old", 1), (None, "u", "<p>some words here", None, None), (2, "u", "", "t", 2)], "page_id long, url string, html string, text string, _html long")
    got = {r.page_id: r for r in html.extract(df, html.fit(df)).collect()}
    assert got[1].text == "" and got[None].text == "some words here" and got[2].n_chars == 0 and got[2]["_html"] == 2
    assert html.extract(df.where("false"), html.fit(df.where("false"))).count() == 0


# Personal data.

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    d = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def base(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def test_base_spans_against_brute_force(spark, texts):
    rnd = random.Random(5)
    signs = ["a", "1", "23", "4111111111111111", ".", "@", "+1", "-", " ", "(", ")", "x.y", "é", "\U0001f600", "255", "256", "_", "%", "\n"]
    rows = [(k, "".join(rnd.choice(signs) for _ in range(rnd.randrange(40)))) for k in range(1500)] + [(k + 5000, t) for k, t in texts.items()] + [(9000, "1 " * 20000), (9001, "a" * 50000 + "@"), (9002, "1." * 30000)]
    got = {r.id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        assert got[i] == base(t), t[:200]


def test_patterns_find_what_the_base_misses(spark, odd):
    rows = [(i, f"Tel-No: +1 803 555 {1000 + i} and the {i} things") for i in range(9)] + [(50, "Tel-No: 803-555-53511 and"), (51, "the 803-555-53511 and"), (52, "Tel-No: soon")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("x")).withColumn("_id", F.lit(1))
    got = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert got[50] == "Tel-No: [PHONE] and" and got[51] == rows[10][1] and got[52] == rows[11][1] and got[0] == "Tel-No: [PHONE] and the 0 things"
    assert pii.mask(odd).count() == len(ODD) and pii.mask(odd.where("false")).count() == 0


def test_patterns_find_spelt_out_identifiers_among_others(spark):
    rows = [(i, f"Mail-To: user{i}@example.com now") for i in range(8)] + [(20 + i, f"Mail-To: room-{i} now") for i in range(8)]
    rows += [(50, "Mail-To: jane.doe(at)example.com now"), (51, "mail-to: (joe[at]example.org) now"), (52, "say jane.doe(at)example.com then")]
    rows += [(60 + i, f"Host-Ip: 10.0.0.{i} up") for i in range(8)] + [(70, "Host-Ip: fe::ab:cd up")]
    got = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "Mail-To: [EMAIL] now" and got[51] == "mail-to: ([EMAIL]) now" and got[70] == "Host-Ip: [IP] up"
    assert all(got[k] == t for k, t in rows if 20 <= k < 50 or k == 52)


def joined(spans):
    order = {k: n for n, k in enumerate(PATTERNS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def test_private_query_against_brute_force(spark, data, texts):
    """On the given table the method adds nothing, so the query's spans are those of the base."""
    got = {r.doc_id: r for r in pii.op5_pii_bootstrap(spark, data).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        own = base(t)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in own) for k in PATTERNS]
        assert got[i].spans == joined(own) and got[i].base_sha256 == hashlib.sha256(joined(own).encode()).hexdigest()


def planted_identifiers(seed=4, n=400):
    """Texts with identifiers that the base knows and others that it does not, in contexts of one to three words on either
    side, and tokens that look like identifiers in other contexts; with the places of the second sort."""
    rnd = random.Random(seed)
    filler = ["w%s" % "".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(300)]
    known = {
        "email": lambda: f"u{rnd.randrange(10**6)}@mail{rnd.randrange(9)}.example.com", "phone": lambda: f"+1{rnd.randrange(10**9, 10**10)}",
        "ip": lambda: ".".join(str(rnd.randrange(256)) for _ in range(4)),
    }
    unseen = {
        "email": lambda: rnd.choice(["u%d(at)site.example", "u%d[at]site.example.org", "u%d{at}x.example"]) % rnd.randrange(10**6), "phone": lambda: f"{rnd.randrange(200, 999)}-{rnd.randrange(100, 999)}-{rnd.randrange(1000, 9999)}",
        "ip": lambda: ":".join("%x" % rnd.randrange(1, 65536) for _ in range(8)),
    }
    around = {"email": [("please write to", ""), ("mail:", ""), ("", "is my address")], "phone": [("call me on", ""), ("tel.", "for help"), ("", "rings here")], "ip": [("from host", ""), ("server at", "answered"), ("", "timed out")]}
    rows, new = [], set()
    for i in range(n):
        w = [rnd.choice(filler) for _ in range(rnd.randrange(5, 40))]
        kind = rnd.choice(list(known))
        left, right = rnd.choice(around[kind])
        is_new = rnd.random() < 0.3
        token = (unseen if is_new else known)[kind]()
        head = " ".join([*w, *left.split()]) + " "
        text = head + token + " " + " ".join([*right.split(), *(rnd.choice(filler) for _ in range(9))])
        if is_new:
            new.add((i, kind, len(head), len(head) + len(token)))
        if rnd.random() < 0.4:  # a part number or a date, which look like phones
            text += " part " + rnd.choice([f"{rnd.randrange(10**8, 10**9)}", "2024-01-%02d" % rnd.randrange(1, 29)]) + " sold"
        rows.append((i, text))
    return rows, new


def test_planted_identifiers_are_found(spark):
    rows, new = planted_identifiers()
    found = set()
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        assert [(s.kind, s.start, s.end) for s in r.base] == base(dict(rows)[r.id])
        found |= {(r.id, s.kind, s.start, s.end) for s in r.spans[len(r.base) :]}
    precision, recall = len(found & new) / max(1, len(found)), len(found & new) / len(new)
    print(f"precision {precision:.3f}, recall {recall:.3f} of {len(new)}")
    assert precision >= 0.95 and recall >= 0.9


def test_texts_of_numbers_take_time_in_proportion(spark):
    import time

    numbers = " ".join(str(k % 100) for k in range(1_400_000))
    spoken = "write to a.b@example.com or +1 803 555 1000 and 10.0.0.1 " * 3000
    rows = [(1, numbers), (2, spoken), (3, "1.2.3.4 " * 50_000)]
    start = time.monotonic()
    got = {r.id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    took = time.monotonic() - start
    masked = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(rows[1:], "doc_id long, text string")).collect()}
    assert len(numbers) > 4_000_000 and took < 60, took
    for i, t in rows:
        assert sorted(got[i]) == sorted(base(t))
    assert masked[2] == "write to [EMAIL] or [PHONE] and [IP] " * 3000 and masked[3] == "[IP] " * 50_000


# Near-duplicates.


def shingle_set(text, k):
    w = words((text or "").encode().lower().decode())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent=80):
    sets = [shingle_set(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and 100 * n >= percent * len(a | sets[j]):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize("block", [4, 256])
def test_near_duplicates_against_brute_force(spark, block):
    rnd = random.Random(block)
    rows = []
    for g in range(6):
        own = ["w%d" % rnd.randrange(400) for _ in range(rnd.choice([8, 60, 150]))]
        for _ in range(rnd.choice([1, 3, 25])):
            w = list(own)
            for _ in range(rnd.randrange(0, max(1, len(w) // 12))):
                w[rnd.randrange(len(w))] = "z%d" % rnd.randrange(900)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows), rows[0][1].upper()), (len(rows) + 1, "solo"), (len(rows) + 2, "SOLO"), (len(rows) + 3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(df, words=2, block=block).collect()}
    assert got == brute_components(rows, 2)


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_near_duplicates_with_repeated_ids(spark, parts):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a), (2, a + " x"), (2, b), (3, b + " y"), (4, "four words that stand"), (4, None), (4, "Four words that stand"), (5, "other words"), (6, ""), (9, "x y z"), (8, "x y z"), (9, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = {(r.doc_id, r.n_shingles > 0): (r.component_id, r.kept) for r in neardup.near_duplicates(df, words=2).collect()}
    assert got == {(1, True): (1, True), (2, True): (1, False), (3, True): (1, False), (4, True): (4, True), (4, False): (4, True), (5, True): (5, True), (6, False): (6, True), (8, True): (8, True), (9, True): (8, False)}
    rows = neardup.near_duplicates(df, words=2, by_id=False).join(df.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").distinct(), ["doc_id", "text_hash"]).collect()
    kept = [(r.doc_id, r.text) for r in rows if r.kept]
    assert {i for i, t in kept if t in (a, b, b + " y", a + " x")} == {1, 2} and (2, b) in kept and (1, a) in kept
    assert sum(t in ("four words that stand", "Four words that stand") for _, t in kept) == 1
    import corpus_pipeline as cp

    left = sorted((r.doc_id, r.text or "") for r in cp.near_duplicates(spark, df, None).collect())
    longest = [(1, a), (2, b), (3, b + " y"), (2, a + " x")]
    assert [r for r in left if r in longest] == [(1, a), (2, b)] and (4, "") in left and len(left) == 7


def test_near_duplicates_odd_rows(spark, odd):
    got = neardup.near_duplicates(odd.withColumn("component", F.lit(1)).withColumn("n", F.lit(1)), words=5).collect()
    assert len(got) == len(ODD) and all(r.kept for r in got)
    assert len(neardup.near_duplicates(odd, by_id=False).collect()) == len(ODD)
    assert neardup.near_duplicates(odd.where("false")).count() == 0


# Languages, shards, quality.


def test_languages(spark, odd):
    got = {r.doc_id: r for r in langid.op8_rank_order_langid(spark, "/root/testdata/sf0.01").collect()}
    truth = dict(duckdb.sql("SELECT doc_id, lang FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    held = [i for i, r in got.items() if r.held_out]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    out = langid.identify(odd.withColumn("score", F.lit("s")), langid.fit(odd)).collect()
    assert len(out) == len(ODD) and {r.doc_id: r.lang_pred for r in out}[1] == "und" and {r.doc_id: r.lang_pred for r in out}[6] == "und"
    assert all(r.lang_pred == "und" for r in langid.identify(odd, langid.fit(odd.where("false"))).collect())


def test_languages_against_plain_code(spark, data):
    """Profiles and out-of-place distances by counters and loops, on the whole small table."""
    docs = duckdb.sql(f"SELECT doc_id, text, lang FROM '{data}/documents.parquet'").fetchall()

    def grams(text):
        out = collections.Counter()
        for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
            w = "\1" + word + "\1"
            out.update(word)
            out.update(w[k : k + 2] for k in range(len(w) - 1))
            out.update(w[k : k + 3] for k in range(len(w) - 2))
        return out

    def ranks(counts):
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))  # noqa: E731  ties go by the packed code points
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:300]]

    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in docs}
    totals = collections.defaultdict(collections.Counter)
    for i, t, lang in docs:
        if lang is not None and t is not None and not held[i]:
            totals[lang] += grams(t)
    profiles = {lang: {g: k for k, g in enumerate(ranks(c))} for lang, c in sorted(totals.items())}
    got = {r.doc_id: r for r in langid.op8_rank_order_langid(spark, data).collect()}
    for i, t, _ in docs:
        own = ranks(grams(t))
        apart = {lang: sum(abs(p[g] - k) if g in p else 300 for k, g in enumerate(own)) for lang, p in profiles.items()}
        best = min(apart, key=lambda x: (apart[x], x)) if own else "und"
        assert got[i].lang_pred == best and got[i].held_out == held[i]
        if own:
            rest = min(v for lang, v in apart.items() if lang != best)
            assert got[i].score == pytest.approx(1 - apart[best] / rest if rest else 0.0)


def test_shards(spark, odd):
    n = 4000
    df = spark.range(n).select(F.col("id").alias("doc_id")).withColumn("shard", F.lit("old")).withColumn("_n", F.lit(1)).withColumn("_part", F.lit(1))
    rows = sharding.shard_rows(df, weights=(1.0, 1.0, 2.0)).collect()
    sizes = collections.Counter(r.shard for r in rows)
    assert abs(sizes[2] - n / 2) < n / 15
    for k in range(3):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes[k]))
    assert all(r.grown_shard in (r.shard, 3) for r in rows) and {r["_n"] for r in rows} == {1}
    more = {r.doc_id: r.shard for r in sharding.shard_rows(df, weights=(1.0, 1.0, 2.0, 1.0)).collect()}
    assert all(more[r.doc_id] == r.grown_shard for r in rows)
    for bad in ((1.0, 0.0), (-1.0,), (), (float("inf"),)):
        with pytest.raises(ValueError):
            sharding.shard_rows(df, weights=bad)
    assert sharding.shard_rows(odd).count() == len(ODD) and sharding.shard_rows(odd.where("false")).count() == 0


def base_failed(text):
    c = quality.counts(text)
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def test_quality(spark, odd, texts):
    for t in [*texts.values(), "", " ", "a\n\na\na b", None]:
        w = words(t)
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            dup += line in seen
            if words(line):
                seen.add(line)
        windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        assert quality.counts(t) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(covered))
    got = {r.doc_id: r for r in quality.quality_rules(odd).collect()}
    assert got[1].base_failed and not got[1].kept and not got[3].kept
    assert quality.quality_rules(odd.where("false")).count() == 0


def plain_ratios(text):
    import zstandard

    data = (text or "").encode()
    return [len(c) / len(zstandard.ZstdCompressor(level=3).compress(c)) for c in [data, *([data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) > 4096 else [])]] if data else [0.0]


def test_bands_reject_what_the_base_rule_keeps(spark):
    docs = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    rnd = random.Random(3)
    blob = [base64.b64encode(rnd.randbytes(24)).decode() for _ in range(4000)]
    plain = sorted((words(t) for _, t in docs if not base_failed(t)), key=len)
    long = [w for t in plain[-40:] for w in t]
    planted = []
    for n in (60, 100, 200, 400, 1500, 4000):
        planted += [blob[:n], long[: 2 * n] + blob[:n]]
    for n in (500, 650, 800, 2000, 8000):
        planted.append(long[: n - n * 45 // 100] + long[9000:9020] * (n * 45 // 2000))
    clean = [w[:n] for w in plain[-30:-10] for n in (100, 300, 900, 3000) if len(w) >= n]
    rows = docs + [(-1 - k, " ".join(w)) for k, w in enumerate(planted)] + [(-1000 - k, " ".join(w)) for k, w in enumerate(clean)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [k for k in range(len(planted)) if got[-1 - k].base_failed] == []
    assert [(k, got[-1 - k].ratio) for k in range(len(planted)) if got[-1 - k].kept] == []
    whole = [k for k in range(len(clean)) if not got[-1000 - k].base_failed]
    assert len(whole) > 40 and sum(got[-1000 - k].kept for k in whole) >= 0.9 * len(whole)
    labels = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    good, poor = ([i for i, t in docs if labels.get(i) == q and not base_failed(t)] for q in (1, 0))
    assert sum(got[i].kept for i in good) >= 0.98 * len(good) and sum(got[i].kept for i in poor) <= 0.8 * len(poor)
    for i, t in docs:
        assert got[i].base_failed == base_failed(t) and got[i].ratio == pytest.approx(plain_ratios(t)[0]) and not (got[i].kept and got[i].base_failed)


def test_bands_against_plain_code(spark, texts):
    """Fences from sorted values rather than counts in bins, and every verdict from them."""
    import math

    rows = [(i, t) for i, t in texts.items()] + [(7000, None), (7001, ""), (7002, LONG)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held = collections.defaultdict(list)
    for t in {t for _, t in rows if t and not base_failed(t)}:
        sizes = [len(t.encode()), *([min(4096, len(t.encode()) - k) for k in range(0, len(t.encode()), 4096)] if len(t.encode()) > 4096 else [])]
        for n, r in zip(sizes, plain_ratios(t)):
            if n >= 64:
                held[quality.length_class(n)].append(math.log(r))
    fences = {}
    for k, v in held.items():
        if len(v) >= quality.PIECES:
            a, m, b = np.quantile(v, [0.25, 0.5, 0.75])
            fences[k] = min(a - 3 * (b - a), m - quality.LEAST), max(b + 3 * (b - a), m + quality.LEAST)
    bounds = quality.by_class(quality.fit(quality.measure(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text"), (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))))
    for k, f in fences.items():
        assert np.allclose(np.log(bounds[k]), f, atol=0.06), k
    for i, t in rows:
        data = (t or "").encode()
        r = plain_ratios(t)
        pieces = [(min(4096, len(data) - k), x) for k, x in zip(range(0, len(data), 4096), r[1:])] or [(len(data), r[0])]
        out = [n >= 64 and not bounds[quality.length_class(n)][0] <= x <= bounds[quality.length_class(n)][1] for n, x in [(len(data), r[0]), *pieces]]
        bad = sum(n for (n, _), o in zip(pieces, out[1:]) if o)
        assert got[i].kept == (not base_failed(t) and not out[0] and (not data or bad / len(data) < quality.BAD_SHARE))


# The pipeline.


def test_pipeline_stages_take_odd_rows(spark, odd):
    import corpus_pipeline as cp

    docs = odd.withColumn("_text", F.lit(1)).withColumn("score", F.lit("s")).withColumn("spans", F.lit(2)).withColumn("id", F.lit(3))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == docs.columns, name
        assert out.count() <= len(ODD) and stage(spark, docs.where("false"), None).count() == 0


def test_pipeline_against_brute_force(spark, data):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = cp.language(spark, docs, data)
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    assert len(rows) == docs.count()
    comp = brute_components(rows, 5)
    one = cp.near_duplicates(spark, kept, data)
    rows = [(i, t) for i, t in rows if comp[i] == i]
    assert sorted(r.doc_id for r in one.collect()) == [i for i, _ in rows]
    left = brute_repeats(rows)
    after = [(i, t if len(left[i]) == len(words(t)) else " ".join(left[i])) for i, t in rows]
    cut = cp.repeated_passages(spark, one, data)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in cut.collect()) == [(i, t, len(t)) for i, t in after]
    masked = {r.doc_id: r.text for r in cp.personal_data(spark, cut, data).collect()}
    for i, t in after:
        out, at = "", 0
        for kind, s, e in sorted(base(t), key=lambda x: (x[1], -x[2])):
            if s >= at:
                out, at = out + t[at:s] + f"[{kind.upper()}]", e
        assert masked[i] == out + t[at:]
    encode = packing.Encoder(bpe.rank_path(), packing.added_tokens())
    want = set()
    for i, t in masked.items():
        ids = np.array([*encode(t or ""), 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want |= {(i, k, x, y - x, zlib.crc32(ids[x:y].tobytes())) for k, (x, y) in enumerate(zip(cuts, cuts[1:]))}
    final = cp.run(spark, data).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in final} == want and len(final) == len(want)
    sequences = collections.defaultdict(list)
    for r in final:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert all([o for o, _ in sorted(v)] == np.cumsum([0, *(n for _, n in sorted(v))])[:-1].tolist() and sum(n for _, n in v) <= 2048 for v in sequences.values())
