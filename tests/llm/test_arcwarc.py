"""ARC parsing in both versions, and what the WARC records say."""

import hashlib

import pytest

from strandfold.llm import arcwarc as aw


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [True, False])
def test_arc_records(version, packed):
    blocks = [b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\n\r\nbody\n\nwith 9 lines", b"plain bytes \xff", b""]
    urls = ["http://a.example/x y?z=1", "dns:a.example", "https://b.example/"]
    parts = [aw.arc_header(version, "old.arc", "19991231235959"), *(aw.arc_record(version, u, "1.2.3.4", "1999123123", "text/html", b) for u, b in zip(urls, blocks, strict=True))]
    content = b"".join(map(aw.gzip_member, parts)) if packed else b"".join(parts)
    first, *rest = list(aw.read_arc(content))
    assert first.url == "filedesc://old.arc" and [r.url for r in rest] == urls and [r.block for r in rest] == blocks
    assert [r.payload() for r in rest] == [b"body\n\nwith 9 lines", blocks[1], b""]
    warc = b"".join(aw.warc_record("old.arc", r) for r in [first, *rest])
    records = list(aw.read_warc(warc))
    assert [h["WARC-Type"] for h, _ in records] == ["warcinfo", "response", "resource", "resource"]
    assert [b for _, b in records][1:] == blocks
    assert records[1][0]["WARC-Date"] == "1999-12-31T23:00:00Z" and records[1][0]["WARC-IP-Address"] == "1.2.3.4"
    assert records[1][0]["WARC-Payload-Digest"] == "sha1:" + aw.digest(b"body\n\nwith 9 lines")
    assert len({h["WARC-Record-ID"] for h, _ in records}) == 4


def test_damaged_archives():
    whole = aw.arc_header(1, "a") + aw.arc_record(1, "http://x/", "0.0.0.0", "bad", "text/html", b"HTTP/1.0 200\r\n\r\n12345")
    cut = list(aw.read_arc(whole[:-4]))
    assert cut[-1].truncated and b"WARC-Truncated: length" in aw.warc_record("a", cut[-1]) and b"1970-01-01T00:00:00Z" in aw.warc_record("a", cut[-1])
    junk = list(aw.read_arc(whole + b"no header here\nrest"))
    assert junk[-1].broken and b"WARC-Type: metadata" in aw.warc_record("a", junk[-1]) and junk[-1].block == b"no header here\nrest"
    half = aw.gzip_member(whole)
    assert list(aw.read_arc(half + half[:20]))[-1].broken
    assert list(aw.read_arc(b"")) == []


def test_conversion_of_pages(spark):
    html = ["<p>same</p>", "<p>same</p>", None, "", "<p>été</p>", "<p>same</p>", "x" * 300_000]
    rows = [(i, None if i == 4 else f"http://e.example/{i} a", h, "clash") for i, h in enumerate(html)] + [(5, "http://e.example/5 a", "<p>same</p>", "clash"), (None, "http://n/", "<p>same</p>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, archive string").repartition(3)
    arcs = pages.transform(aw.pages_to_arc)
    from strandfold.session import materialise

    got = aw.read_warc_records(aw.convert_arc(materialise(arcs, "arcs"))).collect()
    assert len(got) == len(rows)
    same = [r for r in got if r["payload_digest"] == aw.digest(b"<p>same</p>")]
    response = [r for r in same if r["record_type"] == "response"]
    assert len(response) == 1 and response[0]["page_id"] == 5 and len(same) == 5
    assert all(r["refers_to_id"] == response[0]["record_id"] for r in same if r["record_type"] == "revisit")
    empty = [r for r in got if r["payload_digest"] == aw.digest(b"")]
    assert {(r["page_id"], r["record_type"]) for r in empty} == {(2, "revisit"), (3, "response")}
    assert next(r for r in got if r["page_id"] == 4)["payload_digest"] == aw.digest("<p>été</p>".encode()) and len(hashlib.sha1().digest()) == 20
    assert aw.pages_to_arc(pages.limit(0)).count() == 0
    least = aw.read_warc_records(aw.convert_arc(materialise(arcs, "arcs"), least=12)).collect()
    assert all(r["record_type"] == "response" for r in least)


def test_pages_whose_url_looks_like_a_version_block(spark):
    rows = [(1, "http://a.example/", "<p>one</p>"), (2, "filedesc://old.arc", "2 0 x"), (3, "filedesc://b c", "<p>three</p>"), (4, "http://d.example/x y", None), (5, None, "<p>five</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    records = aw.read_warc_records(aw.convert_arc(aw.pages_to_arc(pages))).collect()
    assert sorted(r["page_id"] for r in records) == [1, 2, 3, 4, 5]
    assert {r["page_id"]: r["payload_bytes"] for r in records} == {i: len(t or "") for i, _, t in rows}
