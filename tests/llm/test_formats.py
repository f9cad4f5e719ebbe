"""Pages against a naive renderer of generated trees, archives of others, other tokenizer files, repeated documents."""

import base64
import hashlib
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from conftest import rows

from folioseek.llm import binslack, html_text, neardup, packing, warc

# ---- pages: a tree is made, written as HTML with some end tags left out, and rendered by plain recursion ----

SPACED = {"p", "h2", "ul", "ol", "blockquote", "table"}


class Tree:
    def __init__(self, rng):
        self.rng, self.n = rng, 0

    def word(self):
        self.n += 1
        return f"w{self.n}"

    def inline(self, depth=0):
        kind = self.rng.choice(["text", "text", "b", "br", "hidden", "script", "comment", "template"])
        if kind == "b" and depth < 3:
            return ("b", [self.inline(depth + 1) for _ in range(self.rng.randrange(1, 3))])
        return (kind if kind != "b" else "text", self.word())

    def inlines(self):
        return [self.inline() for _ in range(self.rng.randrange(1, 4))]

    def block(self, depth=0):
        kind = self.rng.choice(["p", "h2", "div", "ul", "ol", "blockquote", "table", "gone", "details", "unseen"])
        if depth > 2 and kind not in ("p", "h2"):
            kind = "p"
        if kind in ("p", "h2"):
            return (kind, self.inlines())
        if kind in ("ul", "ol"):
            return (kind, [self.mixed(depth + 1) for _ in range(self.rng.randrange(1, 4))])
        if kind == "table":
            return (kind, [[self.mixed(3) for _ in range(self.rng.randrange(1, 4))] for _ in range(self.rng.randrange(1, 4))])
        if kind == "details":
            return (kind, self.inlines(), self.mixed(depth + 1), self.rng.random() < 0.5)
        return (kind, self.mixed(depth + 1))

    def mixed(self, depth):
        return [("inline", self.inlines()) if self.rng.random() < 0.5 else self.block(depth) for _ in range(self.rng.randrange(1, 4))]


def write(node, rng):
    kind = node[0]
    maybe = lambda end: end if rng.random() < 0.6 else ""
    many = lambda nodes: " ".join(write(x, rng) for x in nodes)
    if kind == "text":
        return node[1]
    if kind == "b":
        return f"<b>{many(node[1])}</b>"
    if kind == "br":
        return "<br>"
    if kind == "hidden":
        return f"<span style=\"color:red; DISPLAY : none !important; display: inline\">{node[1]}</span>"
    if kind == "script":
        return f"<script>var x = '<p>{node[1]}</p>'</script>"
    if kind == "comment":
        return f"<!-- <p>{node[1]} -->"
    if kind == "template":
        return f"<template><p>{node[1]}<div>y</div></template>"
    if kind == "inline":
        return many(node[1])
    if kind == "h2":
        return f"<h2>{many(node[1])}</h2>"
    if kind == "p":
        return f"<p>{many(node[1])}</p>"
    if kind in ("ul", "ol"):
        return f"<{kind}>" + "".join(f"<li>{many(x)}{maybe('</li>')}" for x in node[1]) + f"</{kind}>"
    if kind == "table":
        return "<table>" + "".join("<tr>" + "".join(f"<td>{many(c)}{maybe('</td>')}" for c in r) + maybe("</tr>") for r in node[1]) + "</table>"
    if kind == "details":
        return f"<details{' open' * node[3]}><summary>{many(node[1])}</summary>{many(node[2])}</details>"
    if kind == "gone":
        return f"<dialog>{many(node[1])}</dialog>" if rng.random() < 0.5 else f"<div hidden>{many(node[1])}</div>"
    if kind == "unseen":
        return f"<div style='backface-visibility: visible; visibility: hidden'>{many(node[1])}</div>"
    return f"<{kind} style='backface-visibility: hidden; -x-display: none'>{many(node[1])}</{kind}>"


def shown(nodes):
    """The lines of inline nodes: words and breaks."""
    out = []
    for node in nodes:
        if node[0] == "text":
            out.append(node[1])
        elif node[0] == "br":
            out.append(None)
        elif node[0] == "b":
            out += shown(node[1])
    return out


def as_lines(items):
    lines = [[]]
    for x in items:
        if x is None:
            lines.append([])
        else:
            lines[-1].append(x)
    lines = [" ".join(x) for x in lines]
    while lines and not lines[-1]:
        lines.pop()
    return lines


def render(nodes, inside):
    """(blank lines before, lines, blank lines after) of what is in a block."""
    blocks, run = [], []

    def flush():
        if lines := as_lines(run):
            blocks.append((0, lines, 0))
        run.clear()

    for node in nodes:
        kind = node[0]
        if kind == "inline":
            run += shown(node[1])
            continue
        if kind in ("text", "b", "br", "hidden", "script", "comment", "template"):
            run += shown([node])
            continue
        if kind == "gone":
            continue
        flush()
        if kind in ("unseen",):
            continue
        space = int(kind in SPACED)
        if kind in ("ul", "ol"):
            lines = []
            for i, item in enumerate(node[1]):
                mark = "- " if kind == "ul" else f"{i + 1}. "
                _, own, _ = render(item, inside | {"li"})
                lines += [(mark if k == 0 else " " * len(mark) if x else "") + x for k, x in enumerate(own)] or [mark.rstrip()]
            made = (0, lines, 0)
            space = 0 if inside & {"li", "td"} else 1
        elif kind == "table":
            grid = [[render(c, inside | {"td"})[1] for c in r] for r in node[1]]
            width = [max((len(x) for r in grid if len(r) > c for x in r[c]), default=0) for c in range(max(map(len, grid)))]
            lines = []
            for r in grid:
                for k in range(max(map(len, r))):
                    cells = [(c[k] if k < len(c) else "").ljust(width[j]) for j, c in enumerate(r)]
                    lines.append("  ".join(cells).rstrip())
            made = (0, lines, 0)
        elif kind == "details":
            made = render([("div", node[1]), *(node[2] if node[3] else [])], inside)
        else:
            made = render(node[1], inside)
            if kind == "blockquote":
                made = (made[0], ["> " + x if x else ">" for x in made[1]], made[2])
        if made[1]:
            blocks.append((max(made[0], space), made[1], max(made[2], space)))
    flush()
    out, before, after = [], 0, 0
    for top, lines, bottom in blocks:
        if out:
            out += [""] * max(after, top)
        else:
            before = top
        out += lines
        after = bottom
    return before, out, after


@pytest.mark.parametrize("seed", range(300))
def test_pages_against_plain_recursion(seed):
    rng = random.Random(seed)
    nodes = Tree(rng).mixed(0)
    page = " ".join(write(x, rng) for x in nodes)
    assert html_text.page_text(page) == "\n".join(render(nodes, frozenset())[1]), page


MORE_PAGES = {
    "<p>x<template><p>t</template>y": "xy", "<p>x<object><p>t</object>y": "x\n\nt\n\ny", "<div style='backface-visibility: hidden'>text</div>": "text",
    "<div style='-webkit-backface-visibility:hidden'>text</div>": "text", "<details>a<summary>s</summary>b<p>c</details>d": "s\nd",
    "<details open>a<summary>s</summary>b</details>d": "a\ns\nb\nd", "<details><summary>s</summary><summary>t</summary></details>": "s",
    "<dialog>x</dialog>y": "y", "<dialog open>x</dialog>y": "x\ny", "<p style='visibility:hidden;visibility:visible'>x": "x",
    "<p style='display:none;display:block'>x": "x", "<p style='display:none !important;display:block'>x": "", "<p style='/* display:none */'>x": "x",
    "<p style='display&#58;none'>x": "", "<table><tr><td rowspan=100000>a<td>b<tr><td>c</table>": "a  b\n   c",
    "<details><br>x<input type=submit value=v><img></details>y": "y",
}


def test_more_pages():
    assert {p: html_text.page_text(p) for p in MORE_PAGES} == MORE_PAGES


def test_a_very_long_page():
    words = [f"w{i}" for i in range(300_000)]
    assert html_text.page_text("<p>" + " ".join(words)) == " ".join(words)
    assert html_text.page_text("".join(f"<p>{w}" for w in words[:50_000])) == "\n\n".join(words[:50_000])


# ---- archives of other writers ----


def foreign(kind, block, *fields):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0>", "WARC-Date: 2020-01-01T00:00:00Z", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archives_of_others(spark):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 7\r\n\r\n"
    records = [
        foreign("warcinfo", b"software: x\r\n", "Content-Type: application/warc-fields", f"WARC-Block-Digest: {sha1(b'software: x' + bytes([13, 10]))}"),
        foreign("response", http + b"body", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {sha1(b'body')}", "WARC-Target-URI: http://h/", "WARC-Concurrent-To: <a>", "WARC-Concurrent-To: <b>"),
        foreign("response", chunked + b"4\r\nbody\r\n0\r\n\r\n", "Content-Type: application/http"),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        foreign("revisit", http, "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Payload-Digest: {sha1(b'body')}", "WARC-Refers-To-Target-URI: http://h/"),
        foreign("resource", b"\x00bytes", "Content-Type: image/x", "X-Folded: a\r\n b"),
        foreign("response", http + b"body", f"WARC-Payload-Digest: {sha1(b'other')}"),
        foreign("resource", b"abc", f"WARC-Block-Digest: {sha1(b'abd')}"),
        foreign("odd", http),
    ]
    # No content sizes, no dictionary, skippable frames in between and at the end.
    skip = struct.pack("<II", 0x184D2A50, 3) + b"xyz"
    writer = zstandard.ZstdCompressor(write_content_size=False)
    content = skip + skip.join(writer.compress(r) for r in records) + struct.pack("<II", 0x184D2A5F, 0)
    got = list(warc.read_archive(content))
    assert [r.get("record_type") for r in got] == ["warcinfo", "response", "response", "request", "revisit", "resource", None, None, None]
    assert got[1]["payload"] == b"body" and got[1]["url"] == "http://h/" and got[1]["payload_digest"] == hashlib.sha256(b"body").hexdigest()
    assert got[4]["payload_digest"] == sha1(b"body") and got[4]["payload"] is None and got[5]["payload"] == b"\x00bytes"
    assert [("error" in r) for r in got[6:]] == [True] * 3
    assert "cut off" in list(warc.read_archive(content + struct.pack("<II", 0x184D2A51, 9)))[-1]["error"]
    table = warc.read_archives(spark.createDataFrame([("p", content), ("q", b"")], "path string, content binary"))
    assert table.where("error is null").count() == 6 and table.where("error is not null").count() == 3
    # A dictionary and frames without sizes.
    raw = b"WARC/1.0\r\nWARC-Type: resource" * 20
    writer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
    content = struct.pack("<II", warc.DICTIONARY_MAGIC, len(raw)) + raw + b"".join(writer.compress(foreign("resource", b"%d" % i)) for i in range(20))
    assert [r["payload"] for r in warc.read_archive(content)] == [b"%d" % i for i in range(20)]


def test_a_very_long_record(spark):
    html = "<p>long " * 700_000
    data = [(1, "u", html), (2, "u", html), (3, "u", "x")]
    docs = spark.createDataFrame([(*r, "y") for r in data], "page_id long, url string, html string, payload string")
    got = rows(warc.round_trip(spark, docs).select("page_id", "payload_bytes", "record_type", "refers_to", "error"))
    assert got == [(1, len(html), "response", None, None), (2, len(html), "revisit", 1, None), (3, 1, "response", None, None)]


# ---- other tokenizer files ----


def test_another_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    texts = ["It's a Test, ÉÉ  two  spaces\n\nlines", "<|endoftext|> x", "", "日本語 text " * 900, "A a"]
    assert packing.encode_texts([t.encode() for t in texts], path) == [np.array(own.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for made, end in ((packing.pack(docs, path, 64).collect(), 2), (binslack.pack(docs, path, room=64)[0].selectExpr("doc_id", "start", "length", "crc32(ids) as ids_crc32").collect(), 1)):
        found = defaultdict(int)
        for r in made:
            whole = np.array([*own.encode(texts[r["doc_id"]], add_special_tokens=False).ids, end], "<u4")
            assert r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes())
            found[r["doc_id"]] += r["length"]
        assert dict(found) == {i: len(own.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_a_large_vocabulary(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = {f"w{i}": i for i in range(70_000)} | {"?": 70_000}
    tokenizer = Tokenizer(models.WordLevel(vocabulary, unk_token="?"))
    tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    tokenizer.save(str(tmp_path / "t.json"))
    path = str(tmp_path / "t.json")
    assert packing.id_type(path) == "<u4"
    assert packing.encode_texts([b"w69999 W1 w2"], path) == [np.array([69_999, 70_000, 2], "<u4").tobytes()]


# ---- repeated documents ----


def test_rows_of_one_id_leave_the_same_one(spark):
    data = [(1, f"text {k} of five other words here", "s", k) for k in range(40)] + [(2, "alone", "s", 0)]
    kept = []
    for seed in range(2):
        random.Random(seed).shuffle(data)
        docs = spark.createDataFrame(data, "doc_id long, text string, source string, _rank int").repartition(3 + seed)
        kept.append(rows(neardup.keep_one(docs)))
    assert kept[0] == kept[1] and [r[0] for r in kept[0]] == [1, 2] and len(kept[0][0]) == 4
