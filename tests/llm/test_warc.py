import base64
import gzip
import hashlib
import zlib

from loomline.llm import warc as W

PAGES = [
    (1, "http://a.example/x y\r\nEvil: 1", "<p>é漢</p>"),
    (2, None, "<p>é漢</p>"),
    (3, "https://b.example", None),
    (4, "https://b.example/q?a=1#frag", ""),
    (5, "x", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (6, "u", "long " * 500_000),
    (7, "u", "tie"),
    (7, "u", "tie"),
    (8, "v", "tie"),
    (None, "w", "tie"),
    (None, "z", "alone"),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, bytes int")


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_captures(spark):
    got = W.captures(frame(spark)).collect()
    want = []
    for page, _, html in PAGES:
        same = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        again = first is not None and page != first
        want.append((page, len((html or "").encode()), digest(html), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    assert all(r.digest_ok for r in got)
    assert all(r.capture.request.concurrent_to == r.capture.capture_id == r.capture.metadata.concurrent_to for r in got)


def test_smaller_payloads_are_all_responses(spark):
    got = {(r.page_id, r.record_type) for r in W.captures(frame(spark), min_bytes=5).collect()}
    assert (8, "response") in got and (4, "response") in got and (2, "revisit") in got


def test_blocks_come_back_whole(spark, tmp_path):
    W.write_archives(frame(spark), str(tmp_path / "w"))
    records = W.read_archives(spark, str(tmp_path / "w")).collect()
    assert len(records) == 3 * len(PAGES)
    payloads = sorted(r.block.partition(b"\r\n\r\n")[2].decode() for r in records if r.type == "response")
    assert payloads == sorted(["<p>é漢</p>", "", PAGES[4][2], PAGES[5][2], "tie", "tie", "alone"])
    assert not any("Evil" == (r.url or "").split("\n")[-1][:4] for r in records)


def test_parse_plain_members_and_steps():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Type: text/html\r\nContent-Length: 12\r\n\r\nab\r\n\r\ncd\r\n\r\n\r\n\r\n"
    for content in (record * 3, gzip.compress(record) * 3, gzip.compress(record * 3)):
        found = list(W.parse(content))
        assert [r["block"] for r in found] == [b"ab\r\n\r\ncd\r\n\r\n"] * 3
        assert found[0]["payload_bytes"] == 12


def test_requests_without_response(spark):
    rows = [("m", "metadata", "gone", b"x"), ("r", "request", "gone", b"y"), ("s", "metadata", None, b"z")]
    base = {f.name: None for f in W.RECORD.fields}
    records = spark.createDataFrame([tuple((base | {"record_id": a, "type": b, "concurrent_to": c, "block": d}).values()) for a, b, c, d in rows], W.RECORD)
    got = W.assemble(records).collect()
    assert [(r.capture_id, r.response, r.request.record_id, r.metadata.record_id) for r in got] == [("gone", None, "r", "m")]


def test_members_archives_and_standard_headers(spark, tmp_path):
    """Each record is a gzip member of its own, archives are bounded by bytes, and a revisit names the response's record."""
    import random

    rng = random.Random(2)
    noise = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(6_000_000))  # one record over 16 MiB
    rows = [(i, f"http://h.example/{i}", "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000))) for i in range(200)]
    rows += [(1000, "http://h.example/first", "same"), (1001, "http://h.example/again", "same"), (2000, "http://h.example/large", noise)]
    W.write_archives(frame(spark, rows).repartition(2), str(tmp_path / "w"), chunk_bytes=20_000)
    files = sorted((tmp_path / "w").glob("part-*"))
    raw = [f.read_bytes() for f in files]
    assert len(files) > 4 and all(len(x) < 8 * 35_000 for x in raw if len(x) < 10_000_000) and sum(len(x) >= 10_000_000 for x in raw) == 1
    text, members = {}, 0
    for content in raw:
        while content:
            unzip = zlib.decompressobj(31)
            record = unzip.decompress(content) + unzip.flush()
            assert unzip.eof and (not record or record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n"))
            members, content = members + bool(record), unzip.unused_data
            head = dict(x.split(": ", 1) for x in record.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
            text[head.get("WARC-Type"), head.get("WARC-Target-URI")] = head
    assert members == 3 * len(rows)
    again, first = text["revisit", "http://h.example/again"], text["response", "http://h.example/first"]
    assert again["WARC-Refers-To"] == first["WARC-Record-ID"] and again["WARC-Refers-To-Target-URI"] == first["WARC-Target-URI"] and again["WARC-Payload-Digest"] == first["WARC-Payload-Digest"]
    assert len(W.read_archives(spark, str(tmp_path / "w"), with_block=False).collect()) == 3 * len(rows)


def test_ids_of_any_characters(spark):
    rows = [("a\r\nb: c", "u", "same"), ("a\r\nb: d", "u", "same"), ("é % + \t", None, "other"), (" ", "v", "third")]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    assert sorted((r.page_id, r.refers_to) for r in W.captures(pages).collect()) == sorted([("a\r\nb: c", None), ("a\r\nb: d", "a\r\nb: c"), ("é % + \t", None), (" ", None)])


def test_empty(spark):
    assert W.captures(frame(spark).limit(0)).collect() == []
