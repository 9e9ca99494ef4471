"""Archives and url filters: round trips, damage, rules, posteriors, odd rows."""

import hashlib

import pytest
import zstandard

from tmweave.llm import urls, warc
from tmweave.session import scratch_path


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_no long, html string, uri string, error string")


def round_trip(spark, rows, **options):
    path = scratch_path(spark, "t-warc") + "/a"
    warc.write_warc(pages(spark, rows), path, "uri", "html")
    return path, {r["uri"]: r for r in warc.read_warc(spark, path, **options).collect()}


def test_round_trip_and_revisits(spark):
    big, small = "x" * 200 + "é\r\n\r\n", "y" * 50
    rows = [(3, big, "u3", "clash"), (1, big, "u1", None), (2, small, "u2", None), (4, small, "u4", None),
            (5, None, "u5", None), (6, "", "u6", None), (7, "z" * 300_000, "u7", None)]
    _, got = round_trip(spark, rows, payload=True)
    assert {u: r["record_type"] for u, r in got.items()} == {
        "u1": "response", "u2": "response", "u3": "revisit", "u4": "response", "u5": "response",
        "u6": "response", "u7": "response"}
    assert got["u3"]["refers_to_id"] == "u1" and got["u3"]["payload"] is None
    for _, html, u, _ in rows:
        data = (html or "").encode()
        assert got[u]["payload_bytes"] == len(data) and got[u]["error"] is None
        assert got[u]["payload_digest"] == hashlib.sha256(data).hexdigest()
        if u != "u3":
            assert bytes(got[u]["payload"]) == data


def test_empty_table(spark):
    _, got = round_trip(spark, [])
    assert got == {}


def archive(records, dictionary=b"some words of a dictionary " * 20):
    stored = zstandard.ZstdCompressor().compress(dictionary)
    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    return (warc.DICT_MAGIC + len(stored).to_bytes(4, "little") + stored
            + b"".join(z.compress(r) for r in records))


def test_frames_read_the_dictionary_and_report_damage():
    one = warc.record_bytes("u", "response", b"some words of a dictionary", "0" * 64, None, 26)
    data = archive([one, one])
    assert [f for f in warc.frames(data)] == [(one, None)] * 2
    assert [e for _, e in warc.frames(data[:-3])] == [None, "truncated frame"]
    assert [e for _, e in warc.frames(data + b"junk")] == [None, None, "not a Zstandard frame"]
    broken = bytearray(data)
    broken[-6] ^= 255
    assert list(warc.frames(bytes(broken)))[-1][1].startswith("damaged frame")


def test_reading_goes_on_after_damage():
    records = [warc.record_bytes(f"u{i}", "response", b"some words of a dictionary %d" % i, "0" * 64, None, 28)
               for i in range(4)]
    parts = [archive([r]) for r in records]
    head = parts[0][:8 + int.from_bytes(parts[0][4:8], "little")]
    parts = [p[len(head):] for p in parts]
    broken = bytearray(parts[1])
    broken[-6] ^= 255
    data = head + parts[0] + bytes(broken) + parts[2] + b"junk" + warc.ZSTD_MAGIC + parts[3]
    got = list(warc.frames(data))
    assert [raw for raw, _ in got] == [records[0], None, records[2], None, records[3]]
    assert got[1][1].startswith("damaged frame") and got[3][1] == "not a Zstandard frame"
    cut = head + parts[0] + parts[1][:9] + parts[2]
    assert [raw for raw, _ in warc.frames(cut)] == [records[0], None, records[2]]
    bad = bytearray(head)
    bad[12:] = bytes(len(head) - 12)
    assert list(warc.frames(bytes(bad) + parts[0]))[0][1].startswith("damaged dictionary")


def test_archives_of_any_name(spark, tmpdir_path):
    import os
    one = warc.record_bytes("u", "response", b"abc", hashlib.sha256(b"abc").hexdigest(), None, 3)
    os.mkdir(f"{tmpdir_path}/segment")
    for name in ("CC-MAIN-1.warc.zst", "segment/CC-MAIN-2.warc.zst", "_SUCCESS", ".hidden"):
        with open(f"{tmpdir_path}/{name}", "wb") as f:
            f.write(archive([one]))
    got = warc.read_warc(spark, tmpdir_path).collect()
    assert sorted(r["archive"].split("/")[-1] for r in got) == ["CC-MAIN-1.warc.zst", "CC-MAIN-2.warc.zst"]
    assert all(r["uri"] == "u" and r["error"] is None for r in got)


@pytest.mark.parametrize("raw, error", [
    (b"HTTP/1.1 200 OK\r\n\r\n", "not a WARC record"),
    (b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n", "missing header"),
    (b"WARC/1.1\r\nno colon\r\n\r\n", "bad header line"),
    (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Date: d\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n",
     "Content-Length 9"),
    (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Date: d\r\nContent-Length: 3\r\n"
     b"WARC-Payload-Digest: sha256:00\r\n\r\nabc\r\n\r\n", "payload digest")])
def test_records_are_validated(raw, error):
    assert warc.parse_record(raw)["error"].startswith(error)


def test_public_suffixes(spark):
    want = {"a.b.com.sg": "com.sg", "com.sg": "com.sg", "x.github.io": "github.io", "a.co.kr": "co.kr",
            "a.b.ck": "b.ck", "www.ck": "ck", "a.www.ck": "ck", "ck": "ck", "a.example.com": "com", "": "",
            "1.2.3.4": "4", "a.unknown": "unknown", "a." * 3000 + "co.uk": "co.uk", "a.": ""}
    hosts = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r["host"]: r["suffix"] for r in urls.with_suffix(hosts).collect()} == want
    assert {r["suffix"] for r in urls.with_suffix(hosts.where("host = 'a.co.kr'"), ()).collect()} == {"kr"}
    counts = spark.createDataFrame([("a.com.sg", 50, 50), ("b.com.sg", 50, 0), ("www.b.com.sg", 0, 0)],
                                   "host string, n long, k long")
    rate = {r["host"]: r["rate"] for r in urls.reputations(counts).collect()}
    assert rate["www.b.com.sg"] < 0.2 < 0.8 < rate["a.com.sg"]


def judged(spark, rows, outcomes=(), **options):
    p = spark.createDataFrame(rows, "page_id long, url string, host string, verdict int")
    o = spark.createDataFrame(list(outcomes), "url string, bad int")
    return {r["page_id"]: r for r in urls.judge(p, o, **options).collect()}


def test_rules_hosts_and_paths(spark):
    got = judged(spark, [(i, u, "clash", 1) for i, u in enumerate([
        "http://a.EXAMPLE.com/en/1?x=/", "https://www.example.com/en/2#f", "http://b.com", "http://b.com/",
        "http://notexample.com/en/1", "ftp://x.net/es/1", "no scheme", None, "", "http://c.org/en/?u=http://d/",
        "://h/p"])])
    pick = {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in got.items()}
    assert pick[0] == ("a.example.com", "/en/1", "example.com/en/", "block")
    assert pick[1] == ("www.example.com", "/en/2", "www.example.com/en/", "allow")
    assert pick[2] == ("b.com", "", None, "allow")
    assert pick[3] == ("b.com", "/", "com/", "allow")
    assert pick[4][2] == "com/" and pick[5][2:] == ("net/es/", "block")
    assert pick[6] == pick[7] == pick[8] == ("", "", None, "allow")
    assert pick[9][:3] == ("c.org", "/en/", None) and pick[10][:2] == ("h", "/p")


def test_posteriors_shrink_to_domain_and_suffix(spark):
    outcomes = [(f"http://bad{i}.spam.org/x", 1) for i in range(30) for _ in range(4)]
    outcomes += [(f"http://h{i}.fine{i}.org/x", 0) for i in range(60) for _ in range(4)]
    outcomes += [("http://z.org/", None), (None, 1)]
    got = judged(spark, [(1, "http://new.spam.org/", None, 0), (2, "http://new.other.org/", None, 0),
                         (3, "http://bad1.spam.org/", None, 0), (3, "http://bad1.spam.org/", None, 0),
                         (4, "http://h1.fine1.org/", None, 0), (5, "http://z.org/", None, 0)], outcomes)
    assert got[3]["verdict"] == "block" and got[4]["verdict"] == "allow"
    assert got[1]["rate"] > 0.7 > got[2]["rate"] > 0 and got[3]["rate"] > got[1]["rate"]
    assert all(0 <= r["low"] <= r["rate"] <= 1 for r in got.values())


def test_no_pages_and_no_outcomes(spark):
    assert judged(spark, []) == {}
    assert judged(spark, [(1, "http://a.org/", None, 0)])[1]["verdict"] in ("allow", "block")


def test_one_response_a_payload_whatever_its_ids(spark, tmpdir_path):
    html = "x" * 200
    rows = [(1, html, "u1", None), (1, html, "u1", None), (None, html, "urn:page:", None), (None, "y" * 200, "urn:page:", None),
            (None, "y" * 200, "urn:page:", None), (5, "s", "u5", None), (5, "s", "u5", None)]
    for i, df in enumerate((pages(spark, rows), pages(spark, rows).limit(0))):
        path = f"{tmpdir_path}/{i}"
        warc.write_warc(df, path, "uri", "html")
        got = sorted((r["payload_bytes"], r["payload_digest"][:4], r["record_type"])
                     for r in warc.read_warc(spark, path).collect())
        if i:
            assert got == []
            continue
        assert [k for n, _, k in got if n == 1] == ["response"] * 2
        large = [(d, k) for n, d, k in got if n == 200]
        assert len(large) == 5 and sorted(k for _, k in large) == ["response"] * 2 + ["revisit"] * 3
        assert len({d for d, k in large if k == "response"}) == 2
