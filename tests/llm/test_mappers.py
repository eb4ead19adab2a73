"""Operators whose results are exact: token tables, packing, sharding, audio, decontamination, pages."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from terrane.llm import decontamination, html, mpeg_audio, packing, sharding, token_encode, tokens
from terrane.llm.queries import byte_tokenizer, word_tokenizer
from tests.llm.helpers import frame, odd


def direct(path, text, end=2):
    return [*token_encode.tokenizer(path).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [byte_tokenizer(), word_tokenizer()])
def test_encoder_gives_the_library_ids(path):
    r = random.Random(4)
    parts = ["a", " ", "\n", "'s", "É", "é", " ", "\t", "1", "!", "  ", "Σ", "<|endoftext|>", "\x1c", "漢", ".", ",", "_", "Word", "́"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    ids, n = token_encode.Encoder(path, 2, keep=500)(texts)
    at = 0
    for t, k in zip(texts, n):
        assert ids[at : at + k].tolist() == direct(path, t), repr(t)
        at += k


def test_token_table(spark):
    docs = odd(spark)
    got = tokens.token_table(docs, byte_tokenizer()).collect()
    want = sorted(((r.doc_id, direct(byte_tokenizer(), r.text)) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted((len(i), crc(i)) for _, i in want)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [d for d, _ in want]
    assert [r.start for r in ordered] == [sum(len(i) for _, i in want[:k]) for k in range(len(want))]
    assert tokens.token_table(docs.limit(0), byte_tokenizer()).count() == 0


def test_best_fit_decreasing_against_brute_force():
    r = random.Random(1)
    lengths = np.array([r.randint(1, 64) for _ in range(500)])
    window, offset, n = packing.best_fit_decreasing(lengths, 64)
    left = []
    for need in sorted(lengths.tolist(), reverse=True):
        fits = [i for i, c in enumerate(left) if c >= need]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= need
        else:
            left.append(64 - need)
    assert n == len(left)
    used = defaultdict(list)
    for w, o, k in zip(window, offset, lengths):
        used[w].append((o, k))
    for pieces in used.values():
        at = 0
        for o, k in sorted(pieces):
            assert o == at
            at += k
        assert at <= 64


def test_packing(spark):
    docs = odd(spark)
    rows = packing.pack_documents(docs, word_tokenizer(), size=512, group_tokens=20_000).collect()
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(direct(word_tokenizer(), r.text))
    assert sum(r.length for r in rows) == sum(len(i) for x in want.values() for i in x)
    for r in rows:
        assert any(r.doc_tokens == len(i) and crc(i[r.start : r.start + r.length]) == r.ids_crc32 for i in want[r.doc_id])
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for pieces in by.values():
        assert all(o == sum(k for _, k in sorted(pieces)[:i]) for i, (o, _) in enumerate(sorted(pieces))) and sum(k for _, k in pieces) <= 512
    assert packing.pack_documents(docs.limit(0), word_tokenizer()).count() == 0


def test_sharding(spark):
    docs = odd(spark).union(frame(spark, [f"text {i}" for i in range(2000)], range(100, 2100)))
    rows = sharding.shard_documents(docs, buckets=8).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r["shard"], 8)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 8
    assert 0.07 < sum(r.grown_shard == 8 for r in rows) / len(rows) < 0.16
    same = {r.doc_id: r["shard"] for r in rows}
    assert all(same[r.doc_id] == r["shard"] for r in rows)
    text = {(r.doc_id, r.text) for r in docs.collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in text}
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_a_changed_weight_moves_rows_only_in_or_out_of_its_subtrees(spark):
    docs = spark.range(4000).withColumnRenamed("id", "doc_id")
    tree = sharding.topology(8)
    heavier = [sharding.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else 1.0) for s in tree]
    rows = sharding.place(sharding.place(docs, tree, "doc_id", "a"), heavier, "doc_id", "b").where("a <> b").collect()
    assert rows and all(r.b // 4 == 1 for r in rows)  # region 1 gained weight, so nothing moves to region 0


def test_audio_round_trip(spark):
    docs = odd(spark)
    got = {(r.doc_id, r.payload_sha256): r for r in mpeg_audio.media_digests(docs).collect()}
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        g = got[r.doc_id, hashlib.sha256(payload).hexdigest()]
        assert (g.n_bytes, g.payload_bytes, g.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-16:]))
        assert g.frames * 192 == len(payload) and g.duration_us == g.frames * 24_000
        assert g.media_sha256 == hashlib.sha256(mpeg_audio.write(raw)).hexdigest()
    assert mpeg_audio.media_digests(docs.limit(0)).count() == 0


def test_audio_parser_resynchronises_and_checks():
    data = mpeg_audio.write(b"x" * 1000)
    s = mpeg_audio.parse(data)
    assert s.table["frames"] == len(s.offsets) == 6 and not s.bad_checks and s.checked == 6
    assert mpeg_audio.seek(s, 0.03) == s.offsets[1]
    first = int(s.offsets[2])
    broken = data[:first] + b"\xff\xf0junk" + data[first:]
    t = mpeg_audio.parse(broken)
    assert len(t.offsets) == 6 and t.resyncs == 1
    flipped = bytearray(data)
    flipped[first + 8] ^= 1
    assert mpeg_audio.parse(bytes(flipped)).bad_checks == 1
    for junk in (b"", b"ID3", b"\xff" * 50, b"TAG" * 100, bytes(range(256))):
        assert mpeg_audio.parse(junk).duration >= 0


def test_tables_cut_short_are_no_error():
    """Frames of every version and layer that name a table but end before or within it."""
    r = random.Random(3)
    seen = 0
    for b1 in range(0xE0, 0x100):
        for b2 in range(0, 256, 4):
            head = bytes([0xFF, b1, b2, r.choice([0, 0x40, 0x50, 0xC0])])
            h = mpeg_audio.header_at(head, 0)
            if h is None or h.length < 4:
                continue
            for mark in (b"Xing", b"Info", b"VBRI"):
                for place in (36, 4 + h.side_info, 6 + h.side_info):
                    frame = (head + bytes(place - 4) + mark + b"\xff" * 8 + bytes(3000))[: h.length]
                    s = mpeg_audio.parse(frame * 2)
                    assert len(s.offsets) + bool(s.table) == 2
                    seen += 1
    assert seen > 1000


def serial_crc(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1) ^ (0x18005 if (crc >> 15 & 1) != b else 0)
        crc &= 0xFFFF
    return crc


@pytest.mark.parametrize("head,bits", [
    (b"\xff\xfe\xa4\xc0", 4 * 32),  # layer I, mono: 32 allocations of 4 bits
    (b"\xff\xfe\xa4\x00", 4 * 64),  # stereo
    (b"\xff\xfe\xa4\x50", 4 * (2 * 8 + 24)),  # joint stereo, 8 subbands apart
    (b"\xff\xfc\x84\xc0", 44 + 36 + 8 + 2 * 27),  # layer II, 48 kHz, 128 kbit/s mono, every allocation used: 27 selections
    (b"\xff\xfc\x24\xc0", 8 + 18 + 2 * 8),  # 48 kbit/s: the table of 8 subbands
    (b"\xff\xf4\x84\xc0", 16 + 21 + 38 + 2 * 30),  # MPEG-2
])
def test_checksums_of_layers_one_and_two(head, bits):
    """Bodies of ones: all allocations are used. The checksum is made here bit by bit."""
    h = mpeg_audio.header_at(head, 0)
    covered = [int(b) for x in head[2:4] for b in f"{x:08b}"] + [1] * bits
    frame = head + serial_crc(covered).to_bytes(2, "big") + b"\xff" * (h.length - 6)
    s = mpeg_audio.parse(frame * 3)
    assert (len(s.offsets), s.checked, s.bad_checks) == (3, 3, 0)
    bad = bytearray(frame)
    bad[7] ^= 1
    s = mpeg_audio.parse(frame + bytes(bad) + frame)
    assert (s.checked, s.bad_checks) == (3, 1)


def brute(text, items, n=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, found = set(), set()
    for item, body in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    found.add(item)
    return len(words), len(hit), sorted(map(str, found))


def test_audio_text_that_looks_like_an_end_tag():
    for lead in (89, 192 + 89, 5 * 192 + 89):
        raw = b"x" * lead + b"TAG" + b"y" * 40
        data = mpeg_audio.write(raw)
        s = mpeg_audio.parse(data)
        assert len(s.offsets) == s.table["frames"] and mpeg_audio.payload_of(data, s) == mpeg_audio.padded(raw)
    tagged = mpeg_audio.write(b"x" * 500) + b"TAG".ljust(128, b"\0")
    s = mpeg_audio.parse(tagged)
    assert (len(s.offsets), s.resyncs) == (3, 0) and mpeg_audio.payload_of(tagged, s) == mpeg_audio.padded(b"x" * 500)


def test_decontamination_against_brute_force(spark, monkeypatch):
    r = random.Random(2)
    word = lambda: r.choice(["aa", "bb", "cc", "Dd", "éé", "1"])
    items = [(i, " ".join(word() for _ in range(r.choice([0, 2, 4, 9, 10, 12, 30])))) for i in range(15)] + [(99, None), (3, "aa bb")]
    texts = [" ".join(word() for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts += [f"{a} {items[i][1]} {b}" for i, (a, b) in enumerate(zip(texts[:15], texts[15:30]))] + [None, ""]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = frame(spark, texts)
    want = {i: brute(t, items) for i, t in enumerate(texts)}
    for block in (1 << 24, 400):  # one pass, and several
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
        assert (len(list(decontamination.benchmark_blocks(bench))) > 1) == (block == 400)
        got = {r.doc_id: r for r in decontamination.contamination(docs, bench).collect()}
        assert len(got) == len(texts)
        for i, (n, hit, ids) in want.items():
            g = got[i]
            assert (g.n_words, g.n_hit, g.n_items, g.contaminated) == (n, hit, len(ids), hit > 0), texts[i]
            assert g.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
    clean = decontamination.without_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, w in want.items() if not w[1]}
    assert decontamination.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.contamination(docs.limit(0), bench).count() == 0
    assert decontamination.contamination(odd(spark), bench).count() == 10


def test_winnowing_covers_every_window():
    h = np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64)
    at = set(decontamination.winnow(h, 5).tolist())
    assert all(at & set(range(i, i + 5)) for i in range(296))


PAGE = """<html><head><title>T</title><script>if (a<b) document.write("<p>no</p>")</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/a>menu</a></ul></nav>
<div id=main><div class="sidebar"><p>side text, with commas, and more commas, all of it long enough to score.</p></div>
<div class=post><h2>Title &amp; more</h2><p>First   paragraph, with&nbsp;blanks, commas, and enough text to be taken for prose by any measure.<br>Next line.
<p>Second &lt;b&gt; one<!-- hidden -->, unclosed, and also long enough to be scored as a paragraph here.<ul><li>one<li>two</ul></div>
<div id="comments"><p>great post, really, so good, thank you very much for writing all of this down</p></div></div>
<form><p>subscribe, now, to our newsletter which is long enough to be scored as a paragraph</p></form><footer>foot</footer></body></html>"""


def test_page_text():
    assert html.main_text(PAGE).split("\n\n") == [
        "Title & more",
        "First paragraph, with blanks, commas, and enough text to be taken for prose by any measure. Next line.",
        "Second <b> one, unclosed, and also long enough to be scored as a paragraph here.", "one", "two",
    ]
    assert [html.main_text(x) for x in (None, "", " \n", "<html></html>", "<div><a href=x>l</a></div>")][:4] == ["", "", "", ""]
    assert html.main_text("plain text < 3 & more") == "plain text < 3 & more"
    assert len(html.main_text("<article>" + "<p>" + "long, text " * 20_000 + "</article>")) == 11 * 20_000 - 1
    for broken in ("<", "<<<p", "</p></div>", "<p " * 500, "<a href='", "<!--", "<script>", "&#xZZ;&#99999999;"):
        html.main_text(broken)


LONG = "A sentence of the article, with commas, and long enough to count as prose in any scoring. " * 3

#: What stands inside an article between two paragraphs, and the blocks it gives.
PARTS = [
    ("<ul><li><a href=a>First reference</a><li><a href=b>Second one</a><li><a href=c>Third one</a></ul>", ["First reference", "Second one", "Third one"]),
    ("<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", ["So x=2 holds"]),
    ("<math><semantics><mi>y</mi><annotation>y</annotation></semantics></math>", ["y"]),
    (f'<div class=searching><p>{LONG}</p></div>', [LONG.strip()]),
    (f'<div class=related-work><h2>Related work</h2><p>{LONG}</p></div>', ["Related work", LONG.strip()]),
    (f'<section id=discussion><p>{LONG}</p></section>', [LONG.strip()]),
    ("<p>zero\u200bwidth</p>", ["zero\u200bwidth"]),
    ("<p>a&nbsp;&#x20;b\t\n c</p>", ["a b c"]),
    ("<blockquote>quoted, in full</blockquote>", ["quoted, in full"]),
    ("<table><tr><td>1<td>2</table>", ["1", "2"]),
    ("<pre>code  here</pre>", ["code here"]),
    ("<h3>Sub &lt;head&gt;</h3>", ["Sub <head>"]),
    ("<dl><dt>term<dd>what it means</dl>", ["term", "what it means"]),
    ("<figure><img src=x><figcaption>A caption</figcaption></figure>", ["A caption"]),
    ("one<br>two", ["one two"]),
    ('<div class="related"><a href=a>Other</a> <a href=b>stories</a></div>', []),
    ("<div class=share><p>share this, please, with all of your friends</p></div>", []),
    (f"<div class=comments><p>{LONG}</p></div>", []),
    (f"<div id=sidebar><p>{LONG}</p></div>", []),
    ("<div class=ad>buy now</div>", []),
    ("<div class=notice>we use cookies</div>", []),
    ("<nav><a href=x>next</a></nav>", []),
    ("<form><p>mail</p><input name=x></form>", []),
    ("<script>var a = '</p>'</script><style>p { }</style>", []),
    ("<!-- <p>hidden</p> -->", []),
    ("<p hidden>unseen</p><p style='display: none'>unseen</p>", []),
    ("<header><h2>Part</h2><p>by line</p></header>", ["Part"]),
    ("<aside><p>aside</p></aside>", []),
    ("<svg><text>drawn</text></svg><noscript>turn it on</noscript>", []),
    ("<footer>2020</footer>", []),
]


@pytest.mark.parametrize("part,blocks", PARTS)
def test_parts_of_an_article(part, blocks):
    page = f"<html><body><header>site</header><nav><a href=/>home</a></nav><article><p>{LONG}</p>{part}<p>last, {LONG}</p></article><footer>foot</footer></body></html>"
    assert html.main_text(page).split("\n\n") == [LONG.strip(), *blocks, f"last, {LONG}".strip()]


def test_pages(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 9), (1, "u", PAGE, 9), (2, None, None, 9), (None, "u", "", 9)], "page_id bigint, url string, html string, text int")
    rows = html.extract_pages(pages).collect()
    assert len(rows) == 4 and all(r.n_chars == len(r.text) for r in rows) and sum(r.n_chars > 0 for r in rows) == 2
    assert html.extract_pages(pages.limit(0)).count() == 0
