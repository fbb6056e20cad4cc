"""Media columns: exact round trips. Main text: whole pages against what their article holds."""

import hashlib
import html
import re
import time
import zlib

import pyarrow.fs as fs
import pytest

from tests.llm.helpers import documents, empty, odd_rows
from tidewright.llm import html_text, media


@pytest.mark.parametrize("case", ["odd", "documents"])
def test_round_trip(spark, data, tmp_path, case):
    docs = odd_rows(spark) if case == "odd" else documents(spark, data)
    rows = media.media_columns(docs, f"file://{tmp_path}").collect()
    assert len(rows) == docs.count()
    want = []
    for r in docs.select("doc_id", "text").collect():
        raw = (r.text or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        want.append((-1 if r.doc_id is None else r.doc_id, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    for r in rows:
        stored = (tmp_path / r.shard).read_bytes()[r.offset : r.offset + r.length]
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256 and len(stored) == r.media_bytes
        assert hashlib.sha256(media.from_png(stored)).hexdigest() == r.payload_sha256
        assert (r.width, r.height, r.depth) == (64, r.payload_bytes // 64, 8)
    addresses = {(r.payload_sha256, r.shard, r.offset, r.length, r.feature, r.media_sha256) for r in rows}
    assert len(addresses) == len({r.payload_sha256 for r in rows})


def test_entries_are_named_by_their_digest(spark, data, tmp_path):
    import tarfile

    rows, entries = media.ingest(documents(spark, data), f"file://{tmp_path}")
    for e in entries.limit(20).collect():
        with tarfile.open(tmp_path / e["shard"]) as tar:
            assert f"{e['digest'].hex()}.png" in tar.getnames()
    assert rows.count() == documents(spark, data).count()


def test_headers_read_headers_only(spark, data, tmp_path):
    _, entries = media.ingest(documents(spark, data), f"file://{tmp_path}")
    got = media.headers(entries, f"file://{tmp_path}").collect()
    assert len(got) == entries.count() and all((r.width, r.depth) == (64, 8) for r in got)
    system, root = media.filesystem(f"file://{tmp_path}")
    read = []

    class Source:
        def __init__(self, path):
            self.file = system.open_input_file(path)

        def read_at(self, n, at):
            read.append(n)
            return self.file.read_at(n, at)

        def close(self):
            self.file.close()

    class Counting:
        open_input_file = staticmethod(Source)

    rows = [(r.shard, r.offset, r.length) for r in got]
    found = list(media.range_reads(iter(rows), Counting(), root, lambda reader, row: media.png_header(reader(media.HEADER_BYTES))))
    assert sum(read) == media.HEADER_BYTES * len(rows) < sum(r.length for r in got)
    assert [x[3:] for x in found] == [(r.width, r.height, r.depth) for r in got]


def test_reads_are_dealt_out_by_stored_bytes(spark, data, tmp_path, monkeypatch):
    rows, entries = media.ingest(documents(spark, data), f"file://{tmp_path}")
    monkeypatch.setattr(media, "READ_BYTES", 20_000)
    found = media.read_back(entries, f"file://{tmp_path}")
    blocks = {(r.shard, r.offset // 20_000) for r in entries.collect()}
    assert found.rdd.getNumPartitions() == len(blocks) > 4
    assert {(r.payload_sha256, r.digest.hex()) for r in found.collect()} == {(r.digest.hex(), r.digest.hex()) for r in rows.collect()}


def test_shards_roll_over(tmp_path, monkeypatch):
    monkeypatch.setattr(media, "SHARD_BYTES", 1500)
    shards = media.Shards(f"file://{tmp_path}", 0)
    places = [shards.put(f"{i}", lambda i=i: bytes([i]) * 600) for i in range(4)]
    assert shards.put("3", lambda: b"") == places[3] if shards.seen else True
    shards.close()
    assert len({p[0] for p in places}) > 1
    system, root = fs.FileSystem.from_uri(f"file://{tmp_path}")
    for i, (name, offset, length) in enumerate(places):
        assert system.open_input_file(f"{root}/{name}").read_at(length, offset) == bytes([i]) * 600


def test_damage_is_noticed():
    raw = bytearray(media.to_png(b"a" * 128))
    raw[45] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(raw))
    with pytest.raises(ValueError):
        media.png_header(b"x" * 33)


def test_no_rows_no_shards(spark, tmp_path):
    assert media.media_columns(empty(spark), f"file://{tmp_path}").count() == 0
    assert not list(tmp_path.iterdir())


def article(page):
    """The blocks of the generated pages' article element."""
    inside = re.search(r"<article>(.*)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", inside[1] if inside else "")
    return "\n\n".join(t for p in parts if (t := " ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split())))


def test_articles_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: (r.url, article(r.html)) for r in pages.collect()}
    got = html_text.extract(pages).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        (None, ""),
        ("<article><h1>A &amp; B</h1><p>x&nbsp;&lt;y&#62;\n  z<br>w</p></article>", "A & B\n\nx <y> z w"),
        ("<article><p>first<p>second<!-- no --><script>var a='</p>'</script></article>", "first\n\nsecond"),
        ("<nav><a href=/>menu</a></nav><article><p>kept</p><form><p>dropped</p></form></article>", "kept"),
        ("<article><p>kept</p><div class='comments'><p>a long remark by a reader on what was said above</p></div></article>", "kept"),
        ("<article><p>kept</p><p>cut off <b", "kept\n\ncut off"),
        ("<article><p>a<b>b</b>c</p><aside><p>beside</p></aside><p>d</p>", "abc\n\nd"),
        ("<title>t</title><footer>f</footer>", ""),
    ],
)
def test_single_pages(page, text):
    assert html_text.main_text(page, html_text.train()) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article class='overflow-hidden rounded'><p>kept as it is</p></article>", "kept as it is"),
        ("<body class='single no-sidebar'><article><p>one</p><p>two three</p></article>", "one\n\ntwo three"),
        ("<body class='header-sticky'><main><p>a b c</p></main>", "a b c"),
        ("<div class='post comments-open'><p>hello there my friend</p><p>x</p></div>", "hello there my friend\n\nx"),
        ("<article><p>We know <math>x</math> is small</p><figure><img><figcaption>below</figcaption></figure></article>", "We know x is small\n\nbelow"),
        ("<article><p>see</p><p><a href='/x'>all of this stands in a link and stays</a></p><p>end</p></article>", "see\n\nall of this stands in a link and stays\n\nend"),
        ("<article><p>kept</p><div class='overflow-hidden'>kept too</div><div hidden>not</div><div style='color:red; display: none'>nor</div></article>", "kept\n\nkept too"),
        ("<form id='whole'><div class='menu'><a>x</a></div><article><h1>T</h1><p>text</p></article><div class='footer'>f</div></form>", "T\n\ntext"),
        ("<article><p>a <img src='x'>picture in a line</p></article>", "a picture in a line"),
    ],
)
def test_nothing_of_the_article_goes(page, text):
    assert html_text.main_text(page, html_text.train()) == text


ARTICLE = "<article><h1>The head</h1><p>An ordinary article has some words in its first paragraph, and more.</p><p>Second one has words too, as they do.</p></article>"
REMARK = "Here stands a remark of a reader who has read the article and says so in many words."


@pytest.mark.parametrize(
    "opened",
    ["section id='comments-section'", "section class='comments_wrap'", "div id='disqus_thread'", "div class='cookie-banner'", "div class='CookieConsentBar'", "div id='gdpr-consent'", "div class='widget-area'", "div class='promo'", "div class='sponsored'", "div class='site-footer'",
     "div class='comment-list'", "div class='userComments'", "div class='reply-thread'", "div class='ad-slot'", "div class='related-stories'", "div class='newsletter-box'", "ul class='replies'", "div class='right-rail'", "div class='sidebar-ad'", "div class='privacy-banner'"],
)
def test_what_is_not_the_article_goes(opened):
    """Names of which most are not in the labelled table."""
    model = html_text.train()
    other, want = f"<{opened}><p>{REMARK}</p></{opened.split()[0]}>", html_text.main_text(ARTICLE, model)
    assert want.count("\n\n") == 2
    for page in (ARTICLE + other, other + ARTICLE, ARTICLE.replace("</article>", other + "</article>")):
        assert html_text.main_text(page, model) == want


@pytest.mark.parametrize("name", ["share", "no-sidebar", "comments-open", "has-sidebar", "layout-no-footer", "text-wrapper", "overflow-hidden", "col-md-8", "ad-free", "section", "left", "box", "title", "list", "top", "message", "PostBody", "widget-text-editor"])
def test_names_that_say_little_lose_no_text(name):
    model, inside = html_text.train(), f"<div class='{name}'><p>{REMARK} {REMARK}</p></div>"
    assert REMARK in html_text.main_text(ARTICLE.replace("</article>", inside + "</article>"), model)
    assert name == "share" or html_text.main_text(f"<div class='{name}'>{ARTICLE}</div>", model) == html_text.main_text(ARTICLE, model)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><p>one two<svg class='i'/> and after</p><p>Second..</p></article>", "one two and after\n\nSecond.."),
        ("<svg viewBox='0 0 1 1' /><article><p>kept</p></article>", "kept"),
        ("<article><svg><path d='x'/><text>drawn</text></svg><p>kept</p><svg><p>more</p></article>", "kept\n\nmore"),
        ("<article><!--><p>a</p><!---><p>b</p><!-- <p>c</p> --!><p>d</p></article>", "a\n\nb\n\nd"),
        ("<article><select><option>1</select><p>kept</p><select><p>more</p></article>", "kept\n\nmore"),
        ("<article><p>kept</p><script>no end <p>x</p></article>", "kept"),
    ],
)
def test_foreign_elements_and_comments(page, text):
    assert html_text.main_text(page, html_text.train()) == text


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "</section>" * 40_000 + "<article><p>x y</p></article>", "<svg>x" * 40_000, "<form><main>x y" * 20_000, "<div><section>" * 20_000 + "</section></div>" * 20_000])
def test_time_is_linear(page):
    model, began = html_text.train(), time.process_time()
    html_text.main_text(page, model)
    assert time.process_time() - began < 1.5


def test_neighbours_decide():
    _, tree = html_text.train()

    def used(node):
        return {html_text.FEATURES[node[0]]} | used(node[2]) | used(node[3]) if isinstance(node, tuple) else set()

    assert len({f for f in used(tree) if f.endswith(("_before", "_after"))}) >= 2


def test_pages_without_signs():
    """Layouts of plain elements that are not in the table: only words and links of a block and its neighbours tell."""
    long = lambda n: " ".join(["word"] * n)
    link = lambda n: f"<a href='/'>{long(n)}</a>"
    for head, body, foot in [
        ([link(1), link(3), long(7)], [long(6), long(50), long(9), long(80)], [link(4), long(10)]),
        ([long(10), link(2)], [long(60), long(20), long(35)], [link(6), link(2), long(13)]),
        ([link(2)], [long(31), long(5), long(44)], [link(3), link(3)]),
    ]:
        page = "".join(f"<div>{b}</div>" for b in [*head, *(f"{b} {i}" for i, b in enumerate(body)), *foot])
        got = html_text.main_text(page, html_text.train()).split("\n\n")
        want = [f"{b} {i}" for i, b in enumerate(body)]
        assert sum(b in got for b in want) >= len(want) - 1 and len([g for g in got if g not in want]) <= 1


def test_labelled_blocks_are_learned():
    odds, tree = html_text.train()
    assert odds["comments"] < -2 < 1 < odds["<article>"] and "no-sidebar" not in odds
    right = total = 0
    for page in html_text.labelled():
        found = []
        for label, around, words, linked in page:
            own = [html_text.signs(x, odds) for _, x in around]
            found.append(html_text.Block("", words, linked, around[-1][0] in html_text.HEADINGS, min(x for x, _ in own), max(x for _, x in own)))
        got = html_text.decide(tree, html_text.describe(found)) >= 0.5
        right, total = right + sum(a == b[0] for a, b in zip(got, page, strict=True)), total + len(page)
    assert right / total > 0.96


def test_odd_pages(spark):
    rows = spark.createDataFrame([(1, None, None, "t", 1), (1, None, None, "t", 1), (None, "u", "<article><p>" + "<p>x y" * 20_000, "t", 1), (3, "u", "<" * 5000, "t", 1)], "page_id long, url string, html string, text string, n_chars long")
    got = html_text.extract(rows).collect()
    assert sorted(r.n_chars for r in got)[:2] == [0, 0] and max(r.n_chars for r in got) == 20_000 * 5 - 2
    assert html_text.extract(rows.limit(0)).count() == 0
