import base64
import hashlib
import re
import zlib

from helpers import PAGE_SCHEMA, prose

from recentlake.llm import warc as w


def pages(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], PAGE_SCHEMA + ", digest string")


ROWS = [
    (1, "http://a.example.com/x", "<p>same</p>"), (5, "https://A.example.com/y?q=1#top", "<p>same</p>"), (9, None, "<p>same</p>"),
    (2, "http://b.example.com", ""), (3, "http://b.example.com/z", None), (4, "weird url \n x", "é日本\r\n\r\nbody " * 50),
    (6, "http://u@c.example.com:80/p", prose(20_000, 3)), (None, "http://d.example.com/", "<p>alone</p>"), (None, None, "<p>same</p>"),
    (7, "http://e.example.com/", "<p>tie</p>"), (7, "http://e.example.com/", "<p>tie</p>"),
]


def test_round_trip_and_revisits(spark):
    out = w.read_captures(w.write_archive(pages(spark, ROWS), block_lines=3), with_body=True).collect()
    assert len(out) == len(ROWS)
    best = {}
    for p, _, h in ROWS:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    want = sorted(str((p, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                       "revisit" if (p is None and best[h or ""] >= 0) or (p is not None and p < best[h or ""]) else "response")) for p, _, h in ROWS)
    assert sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"])) for r in out) == want
    for r in out:
        if r["record_type"] == "revisit":
            assert r["body"] == b"" and r["refers_to"] in (9, 3)
        elif r["page_id"] == 6:
            assert r["body"].decode() == ROWS[6][2] and r["refers_to"] is None


def test_small_payloads_are_all_responses(spark):
    out = w.read_captures(w.write_archive(pages(spark, ROWS), min_bytes=1000)).collect()
    assert {r["record_type"] for r in out} == {"response"}


def test_lookup_by_url(spark):
    rows = [(k, f"http://h{k % 17}.example.org/p/{k // 3}", f"<p>{k}</p>") for k in range(400)]
    archive = w.write_archive(pages(spark, rows), block_lines=7)
    assert archive.parts.count() > 1
    urls = spark.createDataFrame([(rows[k][1],) for k in (0, 5, 77, 399)] + [("http://none.example.org/",), (None,)], "url string")
    got = sorted((r["page_id"], r["body"].decode()) for r in w.lookup(archive, urls).collect())
    keys = {w.url_key(rows[k][1]) for k in (0, 5, 77, 399)}
    assert got == sorted((p, h) for p, u, h in rows if w.url_key(u) in keys)


def test_lookup_of_every_url_returns_every_record(spark):
    rows = ROWS + [(100 + k, (None, "http://hot.example.com/")[k % 2], f"<p>{k // 2}</p>") for k in range(60)]
    table = pages(spark, rows)
    archive = w.write_archive(table, block_lines=4)
    found = w.lookup(archive, table.select("url"), with_body=True)
    assert sorted(map(str, found.collect())) == sorted(map(str, w.read_captures(archive, with_body=True).collect()))
    assert found.count() == len(rows)


def test_search_reads_only_the_blocks_that_may_hold_a_key(spark):
    rows = [(k, f"http://example.org/{k:04d}", "x") for k in range(500)]
    parts = w.write_archive(pages(spark, rows), block_lines=5).parts.orderBy("first_key").collect()
    p = parts[0]
    search = w.PartSearch(p["part"])
    assert [x[0] for x in search.find(p["first_key"])] == [p["first_key"]] and search.blocks_read == 1
    assert not list(search.find("org,example)/none")) and search.blocks_read <= 2
    whole = w.PartSearch(p["part"])
    keys = [w.url_key(u) for _, u, _ in rows if w.url_key(u) <= p["last_key"]]
    assert [x[0] for k in keys for x in whole.find(k)] == keys and whole.blocks_read <= 2 * p["blocks"]


def test_files_begin_with_warcinfo_and_record_ids_are_unique(spark):
    archive = w.write_archive(pages(spark, ROWS))
    ids, records = [], 0
    for row in archive.records.select("file").distinct().collect():
        files, path = w.open_fs(row["file"])
        rest, kinds = files.open_input_file(path).read(), []
        while rest:
            member = zlib.decompressobj(31)
            head = member.decompress(rest).partition(b"\r\n\r\n")[0].decode()
            rest = member.unused_data
            kinds.append(re.search("WARC-Type: (.*?)(\r\n|$)", head)[1])
            ids.append(re.search("WARC-Record-ID: (.*?)(\r\n|$)", head)[1])
            if kinds[-1] == "revisit":
                assert "WARC-Refers-To-Page-ID" in head and "WARC-Refers-To-Date" in head
        assert kinds[0] == "warcinfo" and "warcinfo" not in kinds[1:]
        records += len(kinds) - 1
    assert records == len(ROWS) and len(set(ids)) == len(ids)


def test_url_keys():
    assert w.url_key("http://www.Example.com/a?b#c") == "com,example,www)/a?b"
    assert w.url_key("https://example.com") == "com,example)/"
    assert w.url_key("http://u:p@h.example.com:8080?x=1") == "com,example,h:8080)/?x=1"
    assert w.url_key(None) == w.url_key("") == ""


def test_empty_table(spark):
    archive = w.write_archive(pages(spark, []))
    assert w.read_captures(archive).count() == 0
    assert w.lookup(archive, spark.createDataFrame([("http://a/",)], "url string")).count() == 0
