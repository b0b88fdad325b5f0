"""The ten operators against brute force, round trips and held-out accuracy."""

import gzip
import hashlib
import html
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from spanmill.llm import bpe, chat, decontam, htmltext, langid, linededup, minhash, quality, queries, secrets, warc

PATH = P.path("byte_bpe_50k.tiktoken")
EMPTY = hashlib.sha256(b"").hexdigest()
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 30_000), (5, "one two three four five six"), (6, "one two three four five six"), (6, "one two three four five six"), (None, "ünï çödé — 😀 \U0010ffff")]


def table(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"token_ids": F.lit(1), "N_TOKENS": F.lit(2), "lang_pred": F.lit("x"), "n_words": F.lit(3)}) if extra else df


# ---- 1 ----


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_equals_the_library(codec, reference, documents):
    rng = random.Random(1)
    pools = [[chr(i) for i in range(32, 127)], list("abe \n\t\r aaee==--  \x85\xa0　\x1c"), [chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(500)], list("the an ing 's 12 ,.!  ")]
    texts = ["".join(rng.choice(pools[k % 4]) for _ in range(rng.randint(0, 60))) for k in range(3000)]
    texts += [*documents.values(), " " * 3000, "a" * 3000, "ab" * 1500, "\n" * 500 + "x", "=" * 2000, "é" * 700, "<|endoftext|>"]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
        assert bpe.decode_ids(ids, codec.fst.tokens) == t


def test_bpe_without_room_for_states(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 5)
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    c = bpe.Codec(PATH, P.PATTERN)
    for t in ["hello unthinkable worlds of interoperability", "x" * 500, "antidisestablishmentarianism " * 3]:
        assert np.frombuffer(c.encode(t), "<u4").tolist() == reference.encode_ordinary(t)


def test_all_pieces_go_through_the_transducer(reference, documents, monkeypatch):
    monkeypatch.setattr(bpe, "FLUSH", 32)
    c = bpe.Codec(PATH, P.PATTERN)
    read = []
    step = c.fst.step
    monkeypatch.setattr(c.fst, "step", lambda s, b: read.append(b) or step(s, b))
    monkeypatch.setattr(c.fst, "merge", None)  # plain BPE is not called once the tables are made
    for t in [*documents.values(), "a" * 5000, "ab" * 900, "é" * 999, "x" * 33, "=" * 300 + "é" * 70]:
        assert np.frombuffer(c.encode(t), "<u4").tolist() == reference.encode_ordinary(t)
    assert c.pieces.cold > 1000 and c.fst.steps == len(read) == len(c.fst.goto)


def test_seams_equal_plain_merging(codec):
    rng = random.Random(3)
    ids = list(codec.fst.tokens)
    for _ in range(20_000):
        a, b = rng.choice(ids), rng.choice(ids)
        x, y = codec.fst.tokens[a], codec.fst.tokens[b]
        assert codec.fst.compatible(a, b) == (codec.fst.merge(x + y) == [x, y])


def test_utf8_errors_equal_the_library():
    rng, pool = random.Random(9), [0x41, 0x80, 0x90, 0xA0, 0xBF, 0xC0, 0xC2, 0xE0, 0xE2, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5, 0xFF]
    for _ in range(5000):
        data = bytes(rng.choice(pool) for _ in range(rng.randint(0, 9)))
        s, i = bpe.Utf8Stream(), rng.randint(0, len(data))
        assert s.feed(data[:i]) + s.feed(data[i:]) + s.close() == data.decode("utf-8", "replace")


def test_utf8_stream_at_every_cut():
    data = "aé€😀\U0010ffffz".encode()
    for i in range(len(data) + 1):
        for j in range(i, len(data) + 1):
            s = bpe.Utf8Stream()
            assert s.feed(data[:i]) + s.feed(data[i:j]) + s.feed(data[j:]) + s.close() == data.decode()
    s = bpe.Utf8Stream()
    assert s.feed(b"\xe2\x82") + s.close() == "�" and bpe.decode_ids(struct.pack("<I", 10**9), {}) == "�"


def test_bpe_frames(spark, codec, reference):
    out = bpe.encode(table(spark, ODD, extra=True), PATH, P.PATTERN, decoded="decoded")
    rows = out.collect()
    assert len(rows) == len(ODD) and [c.lower() for c in out.columns].count("n_tokens") == 1
    for r in rows:
        assert r["n_tokens"] == len(reference.encode_ordinary(r["text"] or "")) and r["decoded"] == (r["text"] or "")
    assert bpe.decode(out.drop("decoded"), PATH).filter("decoded <> coalesce(text, '')").count() == 0
    assert bpe.digest(table(spark, ODD[:0] or [(1, "a")]).limit(0), PATH, P.PATTERN).count() == 0
    null = bpe.digest(table(spark, [(1, None)]), PATH, P.PATTERN).head()
    assert (null["n_tokens"], null["ids_sha256"], null["decoded_sha256"]) == (0, EMPTY, EMPTY)


# ---- 2 ----


def plain_removed(rows):
    lines = [(i, j, frozenset(x.split())) for i, t in rows for j, x in enumerate((t or "").lower().split("\n")) if x.split()]
    post, out = defaultdict(set), defaultdict(list)
    for at, (i, j, s) in enumerate(lines):
        near = Counter(k for w in s for k in post[w])
        if any(5 * m >= 4 * (len(s) + len(lines[k][2]) - m) for k, m in near.items()):
            out[i].append(j)
        for w in s:
            post[w].add(at)
    return out


def test_line_dedup_equals_brute_force(spark, documents):
    rows = [(i, t) for i, t in documents.items() if len(t) < 6000]
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 14))] for _ in range(25)]
    for i in range(120):  # many short lines that differ in a word or two, and shared ones
        ls = []
        for _ in range(3):
            line = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                line[rng.randrange(len(line))] = rng.choice([*words, f"new{rng.randint(0, 10**6)}"])
            ls.append(" ".join(line))
        rows.append((10_000 + i, "\n".join(ls)))
    expected = plain_removed(rows)
    got = {r["doc_id"]: r["removed_lines"] for r in linededup.report(table(spark, rows)).collect()}
    assert got == {i: ",".join(map(str, expected[i])) for i, _ in rows}


@pytest.mark.parametrize("hot", [4096, 8])
def test_line_dedup_of_a_large_group(spark, monkeypatch, hot):
    monkeypatch.setattr(linededup, "HOT", hot)  # 8: the lists of the group's words are dealt in parts
    rng = random.Random(8)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(900):  # one group, whose members differ in up to four words, in no order of ids
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(30)] = f"x{rng.randint(0, 10**6)}"
        rows.append((rng.randint(0, 10**6) * 1000 + i, " ".join(w) + "\n\nevery text has this line"))
    expected = plain_removed(sorted(rows))
    got = {r["doc_id"]: r["removed_lines"] for r in linededup.report(table(spark, rows)).collect()}
    assert got == {i: ",".join(map(str, expected[i])) for i, _ in rows}


@pytest.mark.parametrize(
    "rows",
    [
        [(1, "one line alone with words")],
        [(1, "alpha beta gamma delta"), (2, "one two three four five")],
        [(i, " ".join(f"w{i}x{j}" for j in range(10))) for i in range(60)],
        [(i, "\n".join(f"a{i} b{j} c{i + j}" for j in range(4))) for i in range(20)],
        [(1, "\n".join(["the same line of one document"] * 1000))],
        [(1, ""), (2, None), (3, " \n ")],
    ],
)
def test_line_dedup_without_shared_words(spark, rows):
    expected = plain_removed(rows)
    got = {r["doc_id"]: r["removed_lines"] for r in linededup.report(table(spark, rows)).collect()}
    assert got == {i: ",".join(map(str, expected[i])) for i, _ in rows}
    kept = {r["doc_id"]: r["text"] for r in linededup.dedup(table(spark, rows)).collect()}
    assert kept == {i: t if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in set(expected[i])) for i, t in rows}


def test_line_dedup_ends_with_a_batch_of_own_words(spark, monkeypatch):
    monkeypatch.setattr(linededup, "PACK", 7)
    rows = [(i, "shared words at first " + " ".join(f"s{j}" for j in range(20))) for i in range(5)] + [(100 + i, " ".join(f"w{i}x{j}" for j in range(10))) for i in range(40)]
    expected = plain_removed(rows)
    got = {r["doc_id"]: r["removed_lines"] for r in linededup.report(table(spark, rows).coalesce(1)).collect()}
    assert got == {i: ",".join(map(str, expected[i])) for i, _ in rows}


def test_line_dedup_by_other_keys(spark):
    rows = [("b", "one two three four five"), ("a", "one two three four five"), (None, "six seven eight nine ten"), ("c", "Six seven eight NINE ten")]
    df = spark.createDataFrame(rows, "name string, text string").withColumns({"node": F.lit(1), "ROW": F.lit(2), "__ord": F.lit(3), "line": F.lit(4)})
    got = {r["name"]: r["text"] for r in linededup.dedup(df, "name").collect()}
    assert got == {"b": "", "a": rows[1][1], None: rows[2][1], "c": ""}


def test_line_partners_equal_all_pairs():
    rng = np.random.default_rng(6)
    p = np.zeros(400, linededup.POSTING)
    p["token"], p["n"], p["ord"], p["row"] = rng.integers(0, 12, 400), rng.integers(4, 30, 400), rng.permutation(400), np.arange(400)
    p["i"] = rng.integers(0, 6, 400) % linededup.prefix_size(p["n"].astype(int))
    p["bits"] = rng.integers(0, 4, 400)
    p, pairs, live = linededup.partners(p)
    n, i = p["n"].astype(int), p["i"].astype(int)
    meet = {(a, b) for a in range(400) for b in range(400) if a != b and p["token"][a] == p["token"][b] and linededup._fits(n[[a]], i[[a]], p["bits"][[a]], n[[b]], i[[b]], p["bits"][[b]])[0]}
    heads = {t: min((x for x in range(400) if p["token"][x] == t), key=lambda x: p["ord"][x]) for t in set(p["token"].tolist())}
    first = set(heads.values())
    assert set(map(tuple, pairs.tolist())) == {(a, b) for a, b in meet if a in first}
    assert set(live.tolist()) == {a for a, b in meet if a not in first and b not in first}


def test_line_dedup_does_not_pair_the_members_of_a_group(spark, monkeypatch):
    rng = random.Random(9)
    passage, rows = [f"p{i}" for i in range(30)], []
    for i in range(400):  # a common passage with words of its own: most lines have similar ones, few are similar to the first
        own = [f"x{rng.randint(0, 60)}" for _ in range(rng.randint(6, 12))]
        rows.append((i, " ".join([*passage, *own])))
    made, real = {}, linededup.cut

    def counted(df, name):
        out = real(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(linededup, "cut", counted)
    expected = plain_removed(rows)
    got = {r["doc_id"]: r["removed_lines"] for r in linededup.report(table(spark, rows)).collect()}
    assert got == {i: ",".join(map(str, expected[i])) for i, _ in rows} and any(got.values()) and not all(got.values())
    assert made["pairs"] < 2000


def test_line_dedup_rebuilds_texts(spark):
    rows = [(1, "a b c d e\n\nsame line here"), (2, "same line here\nother"), (3, "A B c d e x"), (4, None), (5, ""), (6, "q q\nq"), (6, "q q\nq")]
    out = sorted(((r["doc_id"], r["text"]) for r in linededup.dedup(table(spark, rows, extra=True)).collect()), key=repr)
    assert out == sorted([(1, "a b c d e\n\nsame line here"), (2, "other"), (3, ""), (4, None), (5, ""), (6, "q q"), (6, "")], key=repr)
    assert linededup.report(table(spark, rows).limit(0)).count() == 0


# ---- 3 ----


def test_arc_versions_and_lengths():
    pages = [("1", "http://a/ b", b"x\nURL 1 2 3 4\n"), ("2", None, b""), (None, "http://c/", "é".encode())]
    for version in (1, 2):
        data = warc.write_arc(pages, version)
        got = list(warc.arc_to_warc(data))
        assert [(r["key"], r["payload"]) for r in got] == [(k, p) for k, _, p in pages]
        assert got[0]["uri"] == "http://a/%20b" and got[0]["date"] == "2001-02-03T04:05:06Z" and got[0]["digest"] == warc.digest(pages[0][2])
        with pytest.raises(ValueError, match="declares"):
            list(warc.read_arc(data[:-8]))
    r = got[0] | {"ip": "0.0.0.0"}
    blob = b"\r\n\r\n".join([warc.warc_record(r), warc.warc_record(r, {"key": "1", "record_id": "<x>"}), b""])
    for data in (blob, gzip.compress(blob)):
        (f, block), (g, head) = warc.read_warc(data)
        assert f["WARC-Type"] == "response" and block.endswith(pages[0][2]) and g["WARC-Type"] == "revisit" and g["WARC-Refers-To"] == "<x>" and head == r["head"]


def test_warc_frames(spark):
    rows = [(10, "u", "same"), (9, "u", "same"), (2, None, None), (3, "u", ""), (4, "http://x", "é\r\n\r\nWARC/1.0\r\n"), (11, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x"))
    got = {r["page_id"]: tuple(r)[1:] for r in warc.round_trip(df).collect()}
    assert got[9] == (4, warc.digest(b"same"), "response", None) and got[10][2:] == ("revisit", 9) and got[11][2:] == ("revisit", 9)
    assert got[2] == (0, warc.digest(b""), "response", None) and got[3] == (0, warc.digest(b""), "revisit", 2) and got[4][0] == 16 and len(got) == 6
    assert warc.round_trip(df.limit(0)).count() == 0


# ---- 4 ----

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_spans(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def test_secret_spans_equal_plain_python(spark, documents):
    extra = ["token=token: abcdefgh", "Password = 'hunter22' 😀 api_key:abcdef", "AKIAAKIA" + "Q" * 20, "AKIA" * 3 + "!" + "f" * 24 + "g" + "0" * 23, "secret:abc token=abcdef1", "", "ſecret=abcdef"]
    rows = [*documents.items(), *enumerate(extra, 90_000), (99_999, None)]
    got = secrets.scan(table(spark, rows), ([0.0] * secrets.SIZE**2, float("inf"))).select("doc_id", "base").collect()
    texts = dict(rows)
    for r in got:
        assert [tuple(s) for s in r["base"]] == plain_spans(texts[r["doc_id"]] or "")


def test_markov_scan(spark, documents):
    planted = "see https key Zx9Qw3Rt7Yp2Lk8Vb5Nm1Hd4 and thtionhethereoftheandtheone2"
    rows = [*documents.items(), (90_000, planted), (90_001, None)]
    got = {r["doc_id"]: r for r in secrets.report(table(spark, rows)).collect()}
    assert got[90_000]["spans"] == "markov:14:38" and got[90_000]["n_assign"] == 0 and got[90_001]["spans"] == "" and got[90_001]["base_sha256"] == EMPTY
    assert sum("markov" in r["spans"] for i, r in got.items() if i < 90_000) == 0
    plan = secrets.report(table(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 5 ----


@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_main_text_of_test_pages(sf, tag):
    for (page,) in duckdb.sql(f"select html from '{sf}/pages.parquet'").fetchall():
        own = page.replace("<article>", f"<{tag}>").replace("</article>", f"</{tag}>")
        assert htmltext.extract(own) == known_text(page)
        assert htmltext.extract(own.replace("<body>", "<body><div class='with-sidebar'>").replace("</body>", "</div></body>")) == known_text(page)


def strip_tags(page):
    """The page without helpful names: all containers are div, no class or id says anything."""
    page = re.sub(r"<(/?)(?:nav|aside|footer|header|form|article|main|section)\b", r"<\1div", page)
    return re.sub(r"\b(class|id|role)=([\"'])[^\"']*\2", lambda m: f'class="k{zlib.crc32(m[0].encode()) % 97}"', page)


def plain_scores(page):
    """A second scorer: the container whose own paragraphs hold the most text outside of links, by the standard library's reader."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.sums, self.n, self.last = [], Counter(), 0, None

        def handle_starttag(self, tag, attrs):
            if tag == "div":
                self.n += 1
                self.open.append(self.n)
            self.last = tag

        def handle_endtag(self, tag):
            if tag == "div" and self.open:
                self.open.pop()
            self.last = None if tag == "a" else self.last

        def handle_data(self, data):
            if self.open and self.last not in ("a", "script", "style", "li"):
                self.sums[self.open[-1]] += len(data)

    r = Reader()
    r.feed(page)
    return r.sums.most_common(1)[0][0]


def nth_div(page, n):
    """The inner html of the n-th div, by counting."""
    at = [m for m in re.finditer(r"<(/?)div[^>]*>", page)]
    starts = [m for m in at if not m[1]]
    own, level = starts[n - 1], 0
    for m in at[at.index(own) :]:
        level += -1 if m[1] else 1
        if level == 0:
            return page[own.end() : m.start()]
    return page[own.end() :]


@pytest.mark.parametrize("wrap", [False, True])
def test_scores_decide_where_no_name_helps(sf, wrap):
    same, total, agree = 0, 0, 0
    for (page,) in duckdb.sql(f"select html from '{sf}/pages.parquet'").fetchall():
        bare = strip_tags(page)
        agree += known_text(f"<article>{nth_div(bare, plain_scores(bare))}</article>") == known_text(page)
        if wrap:
            bare = bare.replace("<body>", "<body><div><div>").replace("</body>", "<div>Copyright 2020, all rights reserved, by us.</div></div></div></body>")
        same += htmltext.extract(bare) == known_text(page)
        total += 1
    assert same >= 0.9 * total and agree >= 0.9 * total


@pytest.mark.parametrize("clutter", ['<div class="share"><p>Shared memory is a concept of many systems, old and new.</p></div>', '<section class="related-work"><p>Others, too, have looked at this before, in other ways.</p></section>', '<div id="search-methods"><p>We search, sort and merge lists by the method of the day.</p></div>', "<p><label>A label is a text</label></p>"])
def test_names_inside_the_article_only_hint(clutter):
    body = "".join(f"<p>Paragraph {i}, with commas, and text that is long enough to count for something here.</p>" for i in range(5))
    for tag in ("article", "div"):
        text = htmltext.extract(f"<body><div><a href=x>Home</a> <a href=y>More</a></div><{tag}>{body}{clutter}{body}</{tag}></body>")
        assert text.count("Paragraph") == 10 and re.sub(r"<[^>]*>", "", clutter) in text and "Home" not in text
    gone = htmltext.extract(f"<body><article>{body}<div class='share'><a href=x>Post this</a></div><div class='ad'>Buy, buy, buy and buy more of it, today.</div></article></body>")
    assert "Post" not in gone and "Buy" not in gone


def known_text(page):
    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p|br)[^>]*>", article)]
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""), ("plain &amp; simple", "plain & simple"), ("<script>x</script><style>y</style>", ""), ("<p>One", "One"), ("<p>a<script>'<p>no</p>'</script>b &lt;i&gt;</p>", "ab <i>"),
        ("<body><header>H</header><div class='sidebar'><p>Side, bar, text that is long, very long indeed.</p></div><main><h2>T</h2><p>Body, of the&nbsp;text.</p><ul><li>x<li>y</ul><form><p>f</p></form></main><div id=comments><p>Nice, nice, nice, nice, nice, nice.</p></div><footer>F</footer>", "T\nBody, of the text.\nx\ny"),
        ("<article><h1>T</h1><p>One, two, three and four, of the text.</p><ul><li><a href=1>Source one</a></li><li><a href=2>Source two</a></li></ul><p class='social'>Social policy changed, as they say.</p><p class='ad'>Buy, buy, buy.</p><div class='share'><a>x</a></div></article>", "T\nOne, two, three and four, of the text.\nSource one\nSource two\nSocial policy changed, as they say."),
        ("<p title=\"a>b\">in, quotes of all kinds</p><p class='x>open quote, and more text", "in, quotes of all kinds\nopen quote, and more text"),
        ("<div><div><p>First part, which is long enough, and has commas.</p></div><div><p>Second part.</p></div></div><div>Legal words that belong to no article.</div>", "First part, which is long enough, and has commas.\nSecond part."),
        ("a < b and <3, 5 </> x <!-- no --> y <!-- rest", "a < b and <3, 5 x y"),
        ("<div class='cookie-notice'><p>We use cookies, all of them, always, and so do others.</p></div><div><p>Short one, really.</p></div>", "Short one, really."),
    ],
)
def test_main_text(page, text):
    assert htmltext.extract(page) == text


@pytest.mark.parametrize("unit", ["<a b", "<div>", '<a "', "<p>", "</b>", "<b><div><i>", "<blockquote>x, ", "<li>", "<!--", "<td><p>", "<script>", "<a href='", "&amp", "<table><div>", "<ul><li>y</i>"])
def test_main_text_takes_linear_time(unit):
    began = time.process_time()
    htmltext.extract("<p>Text, of a page.</p>" + unit * (1_000_000 // len(unit)))
    htmltext.extract("<p>Text, of a page.</p>" + unit * (200_000 // len(unit)) + ">")
    assert time.process_time() - began < 20


def test_main_text_frames(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, "<p>x &eacute;</p>"), (2, None, "<p>x &eacute;</p>")], "page_id long, url string, html string")
    assert sorted(tuple(r) for r in htmltext.report(df).collect() if r["page_id"] == 2) == [(2, None, "x é", 3)] * 2
    assert htmltext.main_text(df.withColumn("N_chars", F.lit(1))).filter("page_id = 1").head()["text"] == "" and htmltext.report(df.limit(0)).count() == 0


# ---- 6 ----


def plain_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), len(lines) - len(set(lines)), len(covered), len(lines))


def test_statistics_equal_plain_python(documents):
    rng = random.Random(2)
    texts = [*documents.values(), "", "a b c d e a b c d e", "a a a a a a", " ".join(rng.choice("ab") for _ in range(300)), "x y \x85 z\n\n x", " ".join(f"w{i % 7000}" for i in range(7010))]
    for t in texts:
        assert quality.measure(t) == plain_statistics(t)


def test_quality_verdicts(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.rate(docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(-1).cast("long"), "text": F.lit(None).cast("string")})), labels)
    got = {r["doc_id"]: r for r in out.collect()}
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got.values())
    assert got[-1]["base_failed"] and got[-1]["n_words"] == 0
    known = [(r["quality"], got[r["doc_id"]]) for r in labels.collect()]
    good = [g["kept"] for q, g in known if q == 1 and not g["base_failed"]]
    assert sum(good) >= 0.98 * len(good)
    bare = quality.rate(docs, labels.limit(0))
    assert bare.filter("not base_failed and not kept").count() == 0 and quality.rate(docs.limit(0), labels).count() == 0


def test_quality_rejects_labelled_junk(spark):
    base = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    kept = quality.rate(spark.read.parquet(f"{base}/documents.parquet"), labels).filter("not base_failed").join(labels, "doc_id").select("quality", "kept").collect()
    good, bad = ([r["kept"] for r in kept if r["quality"] == q] for q in (1, 0))
    assert len(bad) > 20 and sum(bad) <= 0.25 * len(bad) and sum(good) >= 0.98 * len(good)


def test_threshold_uses_both_labels():
    scores, good = np.array([*np.linspace(0, 0.5, 100), 0.6, 0.7]), np.arange(102) < 100
    assert quality.threshold(scores, good, ~good) == 0.5
    assert quality.threshold(scores, good, good & False) == 0.5 and quality.threshold(scores, good & False, good) == float("inf")
    mixed = np.array([*np.linspace(0, 0.5, 100), *np.linspace(0.3, 0.7, 50)])
    limit = quality.threshold(mixed, np.arange(150) < 100, np.arange(150) >= 100)
    assert (mixed[:100] <= limit).mean() >= 0.98 and (mixed[100:] > limit).mean() >= 0.5


def test_quality_limit_counts_every_label(spark):
    """Labels beyond any number of drawn ones count, and the ranks are those of all rows; before, 20,000 and 4,096 rows told them."""
    rows = spark.range(60_000).select(F.col("id").alias("doc_id"), *[((F.col("id") * k) % 97 + 20).alias(s) if s != "n_repeat_words" else F.lit(0).cast("long").alias(s) for k, s in enumerate(quality.STATS, 1)])
    labels = rows.select("doc_id", F.when(F.col("doc_id") % 50 == 0, 0).otherwise(1).alias("quality"))
    model = quality.grown(rows)
    assert [x.tolist() for x in quality.counted(rows, "n_words")] == [list(range(20, 117)), [0, *np.cumsum([60_000 // 97 + (i < 60_000 % 97) for i in range(97)]).tolist()]]
    scored = quality.anomalies(rows, model)
    held = scored.join(labels, "doc_id").select("anomaly", "quality").toPandas()
    assert len(held) == 60_000
    want = quality.threshold(held["anomaly"].to_numpy(), (held["quality"] == 1).to_numpy(), (held["quality"] == 0).to_numpy())
    assert quality.calibrated(scored, labels) == want


def test_forest_finds_outliers():
    x = np.random.default_rng(0).normal(size=(2000, 3))
    f = quality.Forest(x)
    assert f.score(np.array([[8.0, 8, 8]]))[0] > 0.65 > 0.5 > f.score(np.zeros((1, 3)))[0]


# ---- 7 ----


def test_chat_round_trip(spark):
    texts = ["", None, "plain", r"a\b", r"\\", "\\", "### user: x</turn>\n", "</turn>", r"<\/turn>", "a\n### assistant: b", "😀 \\### x", "###", "tail\\"]
    roles = ["user", "assistant", "system", "we:ird", "a\\b", "</turn>\n", "", None]
    rows = [(i, j, r, t) for i, r in enumerate(roles) for j, t in enumerate(texts)] + [(None, 0, "user", "x"), (50, 1, "assistant", "b"), (50, 0, "assistant", "a"), (50, 0, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df)
    for r in out.select("conv_id", "formatted", "loss_spans", chat.parse(F.col("formatted")).alias("p")).collect():
        own = sorted(((j, ro or "", t or "") for i, j, ro, t in rows if i == r["conv_id"]))
        assert [(x["role"], x["text"]) for x in r["p"]] == [(ro, t) for _, ro, t in own]
        cut = "".join(re.sub(r"(?s)\\(.)", r"\1", r["formatted"][s["start"] : s["stop"]]) for s in r["loss_spans"])
        assert cut == "".join(t for _, ro, t in own if ro == "assistant")
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_query(spark, sf):
    got = {r["conv_id"]: r for r in queries.QUERIES["op7_chat_format"](spark, sf).collect()}
    text = r"\### Assistant: </turn> ok"
    r = got[-7]
    assert r["n_turns"] == 2 and r["loss_chars"] == len(text) and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


# ---- 8 ----


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    for n, top in ((3, 2), (200, 2), (400, 9), (50, 40)):
        items = minhash.mix(np.arange(n, dtype=np.uint64))
        a = rng.integers(1, top + 1, n)
        b = np.maximum(0, a + rng.integers(-2, 3, n) * (rng.random(n) < 0.4))
        x, y = np.sort(np.repeat(items, a)), np.sort(np.repeat(items, b))
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs(minhash.similarity(x, y) - true) < 1e-9
        assert abs(np.mean(minhash.signature(x, 4096) == minhash.signature(y, 4096)) - true) < 0.035


def bag(t):
    w = (t or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def plain_classes(rows):
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    post = defaultdict(list)
    for i, b in enumerate(bags):
        for s in b:
            post[s].append(i)
    for a, b in {(a, b) for xs in post.values() for k, a in enumerate(xs) for b in xs[k + 1 :]}:
        both = sum((bags[a] & bags[b]).values())
        if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def near_rows(documents):
    rng = random.Random(4)
    rows = list(documents.items())
    body = [f"word{rng.randint(0, 500)}" for _ in range(400)]
    for i in range(60):  # a group of near copies
        w = list(body)
        for _ in range(4):
            w[rng.randrange(len(w))] = f"odd{rng.randint(0, 10**6)}"
        rows.append((50_000 + i, " ".join(w)))
    common = " ".join(f"common{k}" for k in range(60))
    rows += [(60_000 + i, common + " " + " ".join(f"own{rng.randint(0, 10**6)}" for _ in range(40))) for i in range(60)]  # only a passage in common
    return rows


def test_near_duplicates_equal_brute_force(spark, documents):
    rows = near_rows(documents)
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert got == plain_classes(rows)


def test_pairs_meet_bits_before_their_multisets(spark):
    """Bits leave every pair of at least the least similarity, with repeats too; of others few carry multisets along. Before, all pairs did."""
    rng = np.random.default_rng(8)
    bags, true = [], {}
    for i in range(40):
        base = minhash.mix(rng.integers(0, 1 << 62, 150).astype(np.uint64))
        base[: 5 * (i % 4)] = base[0]
        other = base.copy()
        other[rng.permutation(150)[: 2 * i]] = minhash.mix(rng.integers(0, 1 << 62, 2 * i).astype(np.uint64))
        a, b = np.sort(base), np.sort(other)
        true[f"{i}"] = minhash.similarity(a, b)
        bags += [(f"{i}a", a.tobytes(), len(a), minhash.parity(a).tolist()), (f"{i}b", b.tobytes(), len(b), minhash.parity(b).tolist())]
    own = spark.createDataFrame(bags, "node string, bag binary, n long, bits array<long>")
    pairs = spark.createDataFrame([(f"{i}a", f"{i}b", f"{i}", f"{i}") for i in range(40)], "a string, b string, la string, lb string")
    side = lambda x: own.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    left = {r["la"] for r in pairs.join(side("a"), "a").join(side("b"), "b").filter(minhash.close(0.8)).collect()}
    similar = {i for i, s in true.items() if s >= 0.8}
    assert similar <= left and len(similar) > 5 and not left & {i for i, s in true.items() if s < 0.6}
    assert {r["a"] for r in minhash.verified(pairs, own, 0.8).collect()} == similar


def test_one_of_each(spark):
    t = " ".join(f"w{i}" for i in range(200))
    rows = [(3, t), (2, t + " x"), (2, t + " x"), (7, None), (8, ""), (8, ""), (9, "  "), (None, "solo text"), (4, "other words that are here")]
    out = sorted(((r["doc_id"], r["text"]) for r in minhash.one_of_each(table(spark, rows, extra=True)).collect()), key=repr)
    assert out == sorted([(2, t + " x"), (7, None), (8, ""), (8, ""), (9, "  "), (None, "solo text"), (4, "other words that are here")], key=repr)
    assert minhash.near_duplicates(table(spark, rows).limit(0)).count() == 0


# ---- 9 ----


def plain_hits(docs, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[s : s + k])].add(str(i))
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if own := windows.get(tuple(w[s : s + k])):
                    hit.update(range(s, s + k))
                    ids |= own
        out.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [28, 10])
def test_decontamination_equals_brute_force(spark, documents, sf, monkeypatch, bits):
    monkeypatch.setattr(decontam, "BLOOM_BITS", bits)  # 10: the filter lets nearly all through
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall() + [(900, "short item Ünï"), (900, "short item ünï"), (901, None), (902, "..."), (903, "a a a a a a a a a a a a a a a")]
    long = items[0][1]
    docs = [*documents.items(), (90_000, None), (90_001, ""), (90_002, "x " + long + " y " + long), (90_002, "SHORT, item ünï; short item"), (90_003, "a " * 40), (90_004, " ".join(long.split()[1:15])), (90_005, " ".join(long.split()[:12]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontam.report(table(spark, docs), bench).collect()), key=repr)
    assert got == plain_hits(docs, items)


def test_decontamination_of_nothing(spark):
    docs = table(spark, [(1, "a b")])
    assert decontam.report(docs, spark.createDataFrame([], "item_id long, text string")).head()["n_hit"] == 0
    assert decontam.report(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_proximity(spark):
    docs = table(spark, [(1, "alpha x x beta"), (2, "alpha x x x x x x beta"), (3, "beta alpha")])
    items = spark.createDataFrame([(7, "alpha beta")], "item_id long, text string")
    assert decontam.proximity(docs, items, 3).count() == 2


# ---- 10 ----


def test_language_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    more = docs.limit(1).select(F.explode(F.array(F.lit(None), F.lit(""), F.lit("123 !?"))).alias("text")).withColumn("doc_id", F.lit(-1).cast("long"))
    rows = langid.identify(docs.select("doc_id", "text", "lang").unionByName(more.withColumn("lang", F.lit("en")))).collect()
    own = [r for r in rows if r["doc_id"] >= 0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in own)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in own if r["held_out"]]
    assert sum(held) >= 0.95 * len(held)
    assert [(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] < 0] == [("und", 0.0)] * 3


def test_language_id_of_many_languages(spark):
    rng = random.Random(4)
    rows = []
    for k in range(230):  # each language has letters of its own
        letters = [chr(0x4E00 + 20 * k + j) for j in range(20)]
        rows += [(i * 1000 + k, "".join(rng.choice(letters) for _ in range(60)), f"l{k:03}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(df).collect()}
    assert len(set(got.values())) == 230 and sum(got[i] == name for i, _, name in rows) >= 0.95 * len(rows)


def test_language_id_without_labels(spark):
    df = spark.createDataFrame([(1, "text here", None)], "doc_id long, text string, lang string")
    assert langid.identify(df).head()["lang_pred"] == "und" and langid.identify(df.limit(0)).count() == 0


def test_long_texts_are_read_in_pieces():
    t = "Der Text, über den gesprochen wird. " * 50
    assert (langid.presence(t) == langid.presence(t, 64)).all()


def test_fits_are_bounded_for_repeated_ids(spark):
    rows = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.when(F.col("id") < 2000, "the same text again").otherwise(F.concat(F.lit("text number "), F.col("id"))).alias("text"), F.lit("en").alias("lang"))
    drawn = langid.sample(rows, per_lang=50)
    assert 0 < len(drawn) <= 50 and langid.sample(rows.withColumn("doc_id", F.lit(None).cast("long")), per_lang=50)
    assert len(langid.sample(rows.filter("text = 'the same text again'"), per_lang=50)) == 1
    labels = spark.createDataFrame([(7, 1), (7, 1), (None, 0)], "doc_id long, quality int")
    collected = []
    stats = quality.statistics(rows.select("doc_id", "text"))
    model = quality.fit(stats.cache(), labels)
    collected.append(model)
    assert collected and quality.rate(rows.select("doc_id", "text").limit(300), labels).count() == 300
    stats.unpersist()
