"""op2, op3, op10: exact round trips, damage, layouts, odd rows."""

import base64
import gzip
import hashlib
import random
import struct
import time
import zlib

import numpy as np
import pytest

from palimpsest.llm import html_text, tiff, warc

from .helpers import edge_docs, edge_rows, empty_docs

SF = "/root/testdata/sf0.001"


def payload(rnd, n):
    return bytes(rnd.choices(b"abcde \n\0", k=n))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 127, 128, 129, 5000, 40_000])
def test_codecs_round_trip(n):
    rnd = random.Random(n)
    for data in (payload(rnd, n), rnd.randbytes(n), b"\0" * n):
        assert tiff.lzw_decode(tiff.lzw_encode(data), n + 1) == data
        assert tiff.packbits_decode(tiff.packbits_encode(data), n + 1) == data
        assert len(tiff.lzw_decode(tiff.lzw_encode(data), 10)) <= 10 + 4096 and len(tiff.packbits_decode(tiff.packbits_encode(data), 10)) <= 10 + 128


def plain_lzw(data):
    """LZW read one code at a time: a code has as many bits as the next entry of the table, counted one early, asks for."""
    bits, at, width, table, out, last = "".join(f"{b:08b}" for b in data), 0, 9, {}, b"", None
    while True:
        code = int(bits[at : at + width], 2)
        at += width
        if code == 257:
            return out
        if code == 256:
            table, width, last = {i: bytes((i,)) for i in range(256)}, 9, None
            continue
        now = table[code] if code in table else last + last[:1]
        if last is not None:
            table[258 + len(table) - 256] = last + now[:1]
        width = min(12, max(9, (258 + len(table) - 256 + 1).bit_length()))
        out, last = out + now, now


@pytest.mark.parametrize("n", [0, 1, 253, 254, 255, 256, 765, 766, 767, 1790, 3835, 3836, 3837, 3838, 9000])
def test_lzw_equals_its_definition(n):
    rnd = random.Random(n)
    for data in (payload(rnd, n), rnd.randbytes(n), b"a" * n):
        assert plain_lzw(tiff.lzw_encode(data)) == data


def test_files_round_trip_in_every_form():
    rnd, forms = random.Random(2), set()
    for n in range(1, 120):
        data = payload(rnd, 64 * n)
        pages = list(tiff.pages_of(tiff.tiff_bytes(data)))
        assert [p[0] for p in pages] == [0, 1] and pages[0][6] == data and pages[0][8] is None and (pages[1][1], pages[1][2]) == (8, 8)
        assert tiff.tiff_bytes(data) == tiff.tiff_bytes(data)
        forms.add(pages[0][3:6])
    assert len(forms) == 10  # PackBits without predictor; LZW and deflate with and without; strips and tiles


def test_colour_with_predictor():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (5, 7, 3), np.uint8)
    raw = zlib.compress(np.diff(image.astype(np.int16), axis=1, prepend=np.zeros((5, 1, 3), np.int16)).astype(np.uint8).tobytes())
    entries = [(256, 3, 1, 7), (257, 3, 1, 5), (258, 3, 1, 8), (259, 3, 1, 8), (262, 3, 1, 2), (273, 4, 1, 8), (277, 3, 1, 3), (278, 3, 1, 5), (279, 4, 1, len(raw)), (317, 3, 1, 2)]
    at = 8 + len(raw)
    data = struct.pack("<2sHI", b"II", 42, at) + raw + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + b"\0" * 4
    (page,) = tiff.pages_of(data)
    assert page[6] == image.tobytes()


def plain_file(*entries, raw=b"x" * 64):
    found = {256: 8, 257: 8, 258: 8, 259: 1, 262: 1, 273: 8, 277: 1, 278: 8, 279: len(raw)} | dict(entries)
    return struct.pack("<2sHI", b"II", 42, 8 + len(raw)) + raw + struct.pack("<H", len(found)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(found.items())) + b"\0" * 4


@pytest.mark.parametrize("entries", [((256, 0),), ((257, 0),), ((277, 0),), ((278, 0),), ((256, 1 << 31), (257, 1 << 20)), ((322, 0), (323, 8), (324, 8), (325, 64)), ((322, 1 << 31), (323, 1 << 31), (324, 8), (325, 64)), ((278, 4),), ((259, 7),), ((317, 9),), ((259, 8),), ((273, 1 << 31),)])
def test_bad_sizes_are_error_rows(entries):
    (good,) = tiff.pages_of(plain_file())
    assert good[8] is None and good[6] == b"x" * 64
    (page,) = tiff.pages_of(plain_file(*entries))
    assert page[8] and page[6] is None


def test_bombs_dont_expand():
    bomb = zlib.compress(b"\0" * (50 << 20))
    (page,) = tiff.pages_of(plain_file((259, 8), raw=bomb))
    assert page[6] == b"\0" * 64
    (page,) = tiff.pages_of(plain_file((259, 8), (256, 1 << 12), (257, 1 << 13), (278, 1 << 13), raw=bomb), most=1 << 20)
    assert "more pixels" in page[8]


def test_flipped_bytes_never_raise():
    rnd = random.Random(12)
    for k in range(2000):
        data = bytearray(tiff.tiff_bytes(payload(rnd, 64 * rnd.randrange(1, 12))))
        for _ in range(rnd.randrange(1, 6)):
            data[rnd.randrange(len(data)) if k % 2 else -rnd.randrange(1, min(len(data), 320))] = rnd.randrange(256)
        list(tiff.pages_of(bytes(data), 1 << 22))


def test_damage_is_reported(spark):
    good = tiff.tiff_bytes(payload(random.Random(4), 6400))
    rows = spark.createDataFrame([(1, bytearray(b"no tiff"), "x"), (2, None, "x"), (3, bytearray(b""), "x"), (4, bytearray(good), "y"), (5, bytearray(good[: len(good) // 2]), "z")], "id long, media binary, other string")
    got = tiff.tiff_pages(rows, "media").collect()
    assert {(r.id, r.page) for r in got if r.error is None} == {(4, 0), (4, 1)}
    assert {r.id for r in got if r.error} == {1, 5} and all(r.pixels is None for r in got if r.error)


def test_media_query(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = tiff.op2_tiff_media(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        b = texts[r.doc_id]
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_media_odd_rows(spark):
    d = edge_docs(spark)
    media = tiff.text_media(d)
    assert tiff.tiff_pages(media.select("doc_id", "media"), "media").filter("page = 0 and error is null").count() == len(edge_rows())
    assert tiff.tiff_pages(tiff.text_media(empty_docs(spark)).select("doc_id", "media"), "media").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>";</script></head><body class="ad-free menu">
<header><a href="/">Home</a> Site name</header><nav><ul><li><a>one</a></li></ul></nav><!-- <article>ghost</article> --><div class="cookie-notice">We use <p>cookies</p></div>
<article class="post"><header><h1>Title &amp; more</h1></header><p>First <b>bold
 text</b>&nbsp;here.<p>Second<br>line &#233;.<aside>side</aside><form><input>Sign up</form><ul><li>item <a href="x">link</a></ul><div class="ad">buy</div><p>End.</article>
<section class="comments"><article>A comment</article></section><footer>&copy; foot</footer></body></html>"""


def test_article_layouts():
    assert html_text.main_text(PAGE) == "Title & more First bold text here. Second line é. item link End."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>menu</nav>") == ""
    assert html_text.main_text("<article><p>Hi.") == "Hi."
    assert html_text.main_text("just text") == "just text"


def test_density_without_marks():
    links = "<div>" + "".join(f"<p><a href='/{i}'>a link number {i}</a></p>" for i in range(9)) + "</div>"
    body = "".join(f"<p>Sentence {i} of the long body text that a reader came for, with some more words.</p>" for i in range(9))
    assert html_text.main_text(f"<body>{links}{body}{links}</body>").startswith("Sentence 0") and "a link number" not in html_text.main_text(f"<body>{links}{body}{links}</body>")


def test_nothing_of_an_unmarked_article_is_lost():
    words = "Two hundred words of an article that goes on and on. " * 20
    for between in ("<ul class='menu'><li>one<li>two<li>three</ul>", "<div class='ad'>buy now</div>", "<aside>x</aside>", "<form>y</form>"):
        assert html_text.main_text(f"<body><p>{words}</p>{between}<p>The end.</p></body>") == words.strip() + " The end."
        assert html_text.main_text(f"<body><p>note</p><article><div><p>{words}</p></div>{between}<div><p>The end.</p></div></article></body>") == words.strip() + " The end."


def test_markup_never_leaks():
    assert html_text.main_text('<article><p title="x>hello there</p>') == "hello there"
    assert html_text.main_text("<article><p title='a>b' id=\"c>d\">text</p>") == "text"
    assert html_text.main_text("<article>text<p title=") == "text" and html_text.main_text("<article>a < b, 1 <2 & c") == "a < b, 1 <2 & c"
    assert html_text.main_text("<article>a<!-- b --><!DOCTYPE x><?php y?></ z>c") == "ac"


@pytest.mark.parametrize("piece", ["<p a ", "<a '", "<p '>' ", "<p>", "</b>", "<!-- ", "<script>", "<p a=\"", "<", "&amp;", "<b>x</i>"])
def test_long_pages_take_linear_time(piece):
    took = []
    for n in (1, 4):
        page = "<article>" + piece * (n * 400_000 // len(piece))
        began = time.perf_counter()
        html_text.main_text(page + "'")
        took.append(time.perf_counter() - began)
    assert took[1] < max(2, 12 * took[0])
    if piece == "<p a ":
        began = time.perf_counter()
        html_text.main_text(piece * 1_000_000)
        assert time.perf_counter() - began < 2


def plain_text(page, window):
    """Blocks, surge and dive by their definition, line by line."""
    lines = html_text.lines_of(page)
    sums = [sum(length for _, length, _ in lines[i : i + window]) for i in range(len(lines))]
    inside = [s for s, x in zip(sums, lines, strict=True) if x[2] and x[1]]
    half = max(inside or sums or [0]) / 2
    kept = set()
    for i, s in enumerate(sums):
        article = lambda k: any(x[2] for x in lines[k : k + window] if x[1])
        need = min(html_text.SURGE, half) if not inside or article(i) else html_text.SURGE
        if s and s >= need:
            a = b = i
            while a and sums[a - 1]:
                a -= 1
            while b + 1 < len(lines) and sums[b + 1]:
                b += 1
            while not lines[a][1]:
                a += 1
            kept |= set(range(a, b + 1))
    return " ".join(lines[k][0] for k in sorted(kept) if lines[k][0])


def random_page(rnd):
    parts = []
    for _ in range(rnd.randrange(12)):
        text = " ".join(rnd.choices(["word", "another", "of", "text"], k=rnd.choice([1, 3, 30])))
        tag = rnd.choice(["p", "div", "li", "section", "a", "nav", "article", "span", "div class=ad"])
        parts.append(f"<{tag}>{text}</{tag.split()[0]}>" if rnd.random() < 0.8 else f"<{tag}><p>{text}</p><a>{text}</a></{tag.split()[0]}>")
    return "<body>" + "".join(parts) + "</body>"


def test_surge_and_dive_equal_their_definition():
    rnd = random.Random(21)
    pages = [random_page(rnd) for _ in range(1500)]
    for window in (1, 2, 3):
        assert [html_text.main_text(p, window) for p in pages] == [plain_text(p, window) for p in pages]
    assert sum(html_text.main_text(p) != html_text.main_text(p, 1) for p in pages) > 100  # the windows decide
    assert sum(html_text.main_text(p) != html_text.main_text(p, surge=0) for p in pages) > 50  # and the threshold


@pytest.mark.parametrize("between", ['<div class="ad">x</div>', "<aside>note</aside>", '<section class="related"><a>more</a></section>'])
@pytest.mark.parametrize("name", ["div", "section"])
def test_short_sections_after_inserted_parts_stay(name, between):
    words = "Long words of text. " * 20
    closing = "Short closing words."
    assert html_text.main_text(f"<{name}><p>{words}</p></{name}>{between}<{name}><p>{closing}</p></{name}>") == words.strip() + " " + closing
    assert html_text.main_text(f'<div>Name</div><nav>a b</nav><div><p>{words}</p></div><aside class="sidebar">x</aside><div>Rights</div>') == words.strip()  # parts of the page separate


def test_pages_query(spark):
    rows = html_text.op3_html_extraction(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count() and all(len(r.text) == r.n_chars > 0 for r in rows)
    odd = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 1), (2, "u", "<p>" + "x " * 50_000, 1)], "page_id long, url string, html string, text int")
    assert sorted(r.n_chars for r in html_text.extracted(odd).collect()) == [0, 0, 99_999]


def test_archives_round_trip(spark):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "http://c\r\nX: y", "other"), (3, "http://c\r\nX: y", "other"), (None, "http://d", "same"), (5, "u", None), (4, "u", ""), (6, "u", "é" * 100_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, archive string")
    found = warc.read_archives(warc.write_archives(pages, limit=400))
    assert found.filter("kind = 'gap'").count() == 0
    got = sorted((str(r.record_id), r.record_type, str(r.refers_to), r.payload_length) for r in found.collect())
    assert got == sorted([("1", "revisit", "2", 4), ("2", "response", "None", 4), ("3", "response", "None", 5), ("3", "response", "None", 5), ("", "revisit", "2", 4), ("5", "response", "None", 0), ("4", "revisit", "5", 0), ("6", "response", "None", 200_000)])
    assert {r.payload_digest for r in found.collect() if r.record_id in ("1", "2")} == {base64.b32encode(hashlib.sha1(b"same").digest()).decode()}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_salvage():
    members = [warc.record(i, f"http://{i}", bytes(random.Random(i).choices(b"abc \x1f\x8b\x08", k=3000))) for i in range(6)]
    members[4] = gzip.decompress(members[4])  # a plain record among members
    whole = b"".join(members)
    assert [x[2] is not None for x in warc.salvage(whole)] == [True] * 6
    ends = np.cumsum([len(m) for m in members]).tolist()
    hurt = bytearray(whole)
    hurt[ends[0] + 200] ^= 0xFF  # inside the second member
    del hurt[ends[4] - 40 : ends[4] - 20]  # the plain record loses bytes
    parts = list(warc.salvage(bytes(hurt)))
    ids = [h["warc-record-id"] for _, _, h, _, _ in parts if h]
    assert ids == [f"<urn:page:{i}>" for i in (0, 2, 3, 5)]
    gaps = [(a, b) for a, b, h, _, _ in parts if h is None]
    assert gaps == [(ends[0], ends[1]), (ends[3], ends[4] - 20)]
    assert [a for a, *_ in parts] == [0, *(b for _, b, *_ in parts[:-1])] and parts[-1][1] == len(hurt)
    assert [x[4] for x in warc.salvage(whole[:-5])][-1] == "the member is cut off"
    assert list(warc.salvage(b"garbage")) == [(0, 7, None, b"", "no version line")]
    assert list(warc.salvage(b"")) == []


def test_salvage_of_bad_numbers_and_whole_streams():
    plain = [gzip.decompress(warc.record(i, f"http://{i}", b"text %d " % i * 50)) for i in range(5)]
    for old, new in ((b"Content-Length: ", b"Content-Length: " + b"9" * 5000), (b"WARC-Payload-Length: ", b"WARC-Payload-Length: abc"), (b"Content-Length: ", "Content-Length: ²".encode())):
        bad = plain[1].replace(old, new)
        got = [h["warc-record-id"] if h else why for _, _, h, _, why in warc.salvage(plain[0] + bad + plain[2])]
        assert got == ["<urn:page:0>", "a length is no number", "<urn:page:2>"]
    stream = gzip.compress(b"".join(plain), mtime=0)  # one member with all records
    assert [h["warc-record-id"] for _, _, h, _, _ in warc.salvage(stream)] == [f"<urn:page:{i}>" for i in range(5)]
    hurt = gzip.compress(plain[0] + plain[1][:-30] + plain[2], mtime=0)
    assert [bool(h) for _, _, h, _, _ in warc.salvage(hurt)] == [True, False, True]
    rnd = random.Random(3)
    noise = [gzip.decompress(warc.record(i, None, rnd.randbytes(3000))) for i in range(5)]
    cut = gzip.compress(b"".join(noise), mtime=0)[:10_000]
    parts = list(warc.salvage(cut + warc.record(9, "u", b"after")))
    assert [h["warc-record-id"] if h else why for _, _, h, _, why in parts] == ["<urn:page:0>", "<urn:page:1>", "<urn:page:2>", parts[3][4], "<urn:page:9>"] and parts[3][4]
    assert parts[0][:2] == (0, 10_000) and parts[3][:2] == (0, 10_000)


def test_salvage_of_flipped_bytes_never_raises():
    rnd = random.Random(13)
    whole = b"".join(warc.record(i, f"http://{i}", b"a text of page %d " % i * 9) if i % 3 else gzip.decompress(warc.record(i, None, b"plain %d" % i)) for i in range(6))
    for _ in range(2000):
        data = bytearray(whole)
        for _ in range(rnd.randrange(1, 5)):
            data[rnd.randrange(len(data))] = rnd.randrange(256)
        parts = list(warc.salvage(bytes(data)))
        spans = sorted({p[:2] for p in parts})
        assert spans[0][0] == 0 and spans[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert sum(p[2] is not None for p in parts) >= 1


def test_many_plain_records_take_linear_time():
    one = gzip.decompress(warc.record(1, "u", b"x" * 100))
    began = time.perf_counter()
    assert sum(1 for _ in warc.salvage(one * 16_000)) == 16_000
    assert time.perf_counter() - began < 3


def test_groups_beyond_the_broadcast_are_joined(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i % 7}" if i < 30 else str(i)) for i in range(40)], "page_id long, url string, html string")
    seen = [sorted((r.record_id, r.record_type, str(r.refers_to)) for r in warc.read_archives(warc.write_archives(pages, broadcast_groups=n)).collect()) for n in (3, 100)]
    assert seen[0] == seen[1] and len(seen[0]) == 40 and sum(t == "revisit" for _, t, _ in seen[0]) == 23


def measured(items):
    """Items of a reader with payloads, whichever way they were read."""
    out = []
    for at, end, h, block, why in items:
        if h is not None and not isinstance(block, warc.Measured):
            block = block.partition(b"\r\n\r\n")[2] if warc.is_http(h) else block
            block = warc.Measured(len(block), warc.digest(block), block)
        out.append((at, end, h, block, why))
    return out


@pytest.mark.parametrize("piece", [1, 7, 300])
def test_members_in_pieces_equal_whole_ones(monkeypatch, piece):
    """Members with several records, bad records in between, cuts and flipped bytes: read in pieces as at once."""
    rnd = random.Random(piece)
    for k in range(60):
        records = [gzip.decompress(warc.record(i, rnd.choice([None, f"http://{i}"]), rnd.choice([b"", b"text \r\n\r\n WARC/1.1\r\n a:b ", rnd.randbytes(200)]) * rnd.randrange(4), rnd.choice([None, 3]))) for i in range(rnd.randrange(5))]
        records = [r.replace(b"Content-Length: ", rnd.choice([b"Content-Length: ", b"Content-Length: 1", b"Content-Length: x"])) if rnd.random() < 0.2 else r for r in records]
        noise = rnd.choice([b"", b"noise", b"WARC/1.1\r\nno colon\r\n"])
        whole = b"".join(gzip.compress(noise.join(part), mtime=0) for part in (records, records[:2]))
        hurt = bytearray(whole)
        for _ in range(k % 3):
            hurt[rnd.randrange(len(hurt))] = rnd.randrange(256)
        hurt = bytes(hurt[: len(hurt) - rnd.choice([0, 0, 9])])
        monkeypatch.setattr(warc, "MEMBER_BYTES", 1 << 30)
        want = measured(warc.salvage(hurt))
        monkeypatch.setattr(warc, "MEMBER_BYTES", 0)
        monkeypatch.setattr(warc, "PIECE", piece)
        got = measured(warc.salvage(hurt))
        # at damage, reading byte by byte may recover a record more
        assert got == want if k % 3 == 0 else all(x[2:4] in [y[2:4] for y in got] for x in want if x[2])
        assert [x[3].payload for x in warc.salvage(hurt, False) if x[2]] == [None] * sum(1 for x in got if x[2])


def test_long_urls_and_large_members_come_back(spark, monkeypatch):
    url = "http://long/" + "u" * (3 << 20)
    pages = spark.createDataFrame([(1, url, "one"), (2, "http://two", "two")], "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(pages)).collect()
    assert {(r.kind, r.record_id, r.target, bytes(r.payload)) for r in rows} == {("record", "1", url, b"one"), ("record", "2", "http://two", b"two")}
    big = warc.record(7, "http://big", b"z" * (1 << 20) * 80)
    assert len(big) < warc.MEMBER_BYTES // 500
    archives = spark.createDataFrame([("a", warc.record(6, None, b"six") + big + warc.record(8, None, b"eight"))], "archive string, content binary")
    for payloads in (True, False):
        rows = warc.read_archives(archives, payloads).collect()
        assert [(r.kind, r.record_id, r.payload_length) for r in rows] == [("record", "6", 3), ("record", "7", 80 << 20), ("record", "8", 5)]
        assert rows[1].payload_digest == warc.digest(b"z" * (80 << 20)) and (rows[1].payload is not None) == payloads
