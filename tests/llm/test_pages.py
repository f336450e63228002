"""WARC archive and URL filters."""

import hashlib

from labelflow.llm import url_filters, warc_archive


def archive(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string, header int, payload string").repartition(3)
    at = str(tmp_path / "warc")
    warc_archive.write_archive(df, at)
    return at


def test_archive(spark, tmp_path):
    big, other = "é" * 600, "b" * 1000
    rows = [
        (1, "http://a/\r\nX: y", big), (5, "http://b", big), (3, None, big), (2, "u", "small"), (4, "u", "small"),
        (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (9, "u", "b" * 999), (None, "u", big), (10, "u", "b" * 999),
    ]
    at = archive(spark, tmp_path, [(*r, 1, "p") for r in rows])
    got = warc_archive.read_records(spark, at).collect()
    sha1 = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    expected = []
    for i, _, t in rows:
        revisit = t == big and i != 5
        expected.append((i, len((t or "").encode()), sha1(t), "revisit" if revisit else "response", 5 if revisit else None))
    columns = ("record_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted([tuple(r[c] for c in columns) for r in got], key=repr) == sorted(expected, key=repr)
    assert all(r.header_digest == r.payload_digest for r in got)
    assert spark.read.parquet(f"{at}/payloads").select("payload_sha256").distinct().count() == 5


def test_records_come_back_byte_for_byte(spark, tmp_path):
    big = "text\r\n\r\n" * 200
    at = archive(spark, tmp_path, [(1, "http://x/ü", big, 1, ""), (2, "http://y", big, 1, ""), (3, None, None, 1, "")])
    got = {r.record_id: r for r in warc_archive.reconstruct(spark, at).collect()}
    assert len(got) == 3 and all(bytes(got[i].payload).decode() == big for i in (1, 2))
    first = bytes(got[2].record).decode()
    assert first.startswith("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:2>\r\nWARC-Target-URI: http://y\r\n")
    assert first.endswith(f"Content-Length: {len(big)}\r\n\r\n{big}\r\n\r\n")
    again = bytes(got[1].record).decode()
    assert "WARC-Type: revisit" in again and "WARC-Refers-To: <urn:record:2>" in again and big not in again


def test_empty_archive(spark, tmp_path):
    assert warc_archive.read_records(spark, archive(spark, tmp_path, [])).count() == 0


def judged(spark, urls, rules, **more):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(2)
    found = url_filters.judge_urls(df, url_filters.rules_frame(spark, rules), **more)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}


def test_url_rules(spark):
    rules = [
        ("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
        ("example.org", "/fr/a", "block"), ("example.org", "/fr/a", "block"), (None, "/", "block"), ("x.org", "", "block"),
    ]
    urls = [
        "http://A.Example.NET/en/1?q=/", "https://example.net/EN/", "http://example.net", "http://badexample.com/de/",
        "ftp://www.example.com/de/x#y", "http://example.org/fr/ab", "http://sub.org/fr/", "no scheme", None, "", "x://net/#a://b",
        "http://é.net/", "http://user@h.net:80/", "http://a.b.c.d.e.f.net/" + "x/" * 2000, "http://example.com/de/",
        "http://example.com/de/",
    ]
    got = judged(spark, urls, rules)
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[1][2:] == ("net/", "block")
    assert got[2] == ("example.net", "", None, "allow")
    assert got[3][2:] == (None, "allow")
    assert got[4][2:] == ("example.com/de/", "block")
    assert got[5][2:] == ("example.org/fr/a", "block")
    assert got[6][2:] == ("org/fr/", "allow")
    assert got[7] == got[8] == got[9] == ("", "", None, "allow")
    assert got[10] == ("net", "/", "net/", "block")
    assert got[11][2:] == ("net/", "block")
    assert got[12] == ("user@h.net:80", "/", None, "allow")
    assert got[13][2:] == ("net/", "block")
    assert got[14] == got[15] == ("example.com", "/de/", "example.com/de/", "block")


def test_no_rules_and_no_pages(spark):
    assert judged(spark, ["http://a/"], [], default="block") == {0: ("a", "/", None, "block")}
    assert judged(spark, [], [("net", "/", "block")]) == {}
