import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from framelake.llm import url_filter, warc
from framelake.llm.common import new_path, table

SCHEMA = "page_id long, url string, html string, digest string, size string, fit string, tokens string"


@pytest.fixture(scope="module")
def hard(spark):
    rows = [
        (1, "http://Example.com/en/a?x=1", "<p>é</p>"), (2, "https://www.example.com/en/", "<p>é</p>"), (3, None, None), (4, "no scheme", ""), (5, "x://NET", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (6, "ftp://a.net/es/ü ü#f/en/", "\n" * 5), (7, "://net/fr/?://com/", "\n" * 5),
        (None, "http://b.example.com/en/\r\nX: y", "no id"), (8, "http://notexample.com/en/x", "x" * 300_000), (9, "http://mynet/es/", ""), (10, "http://com", "a"), (11, "a#b://x.com/", "b"),
    ]
    return spark.createDataFrame([(*r, *[None] * 4) for r in rows], SCHEMA)


def round_trip(spark, pages):
    path = new_path(spark, "warc")
    warc.write_archives(pages, path)
    return warc.captures(warc.read_records(spark, path))


@pytest.mark.parametrize("which", ["pages", "hard"])
def test_warc(request, spark, sf, which):
    pages = table(spark, sf, "pages") if which == "pages" else request.getfixturevalue("hard")
    html = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    rank = lambda i: -1 if i is None else i
    response = {}
    for i in sorted(html, key=rank):
        response[html[i]] = i
    got = round_trip(spark, pages).collect()
    assert len(got) == len(html)
    for r in got:
        i, x = r["metadata"]["page_id"], r["response"]
        full = html[i].encode()
        assert x["payload_digest"] == base64.b32encode(hashlib.sha1(full).digest()).decode()
        assert r["metadata"]["payload_bytes"] == len(full)
        if response[html[i]] == i:
            assert x["type"] == "response" and bytes(x["payload"]) == full and x["payload_bytes"] == len(full)
        else:
            assert x["type"] == "revisit" and x["payload"] is None and r["metadata"]["refers_to_page"] == response[html[i]]
        assert r["request"]["id"] and x["http_status"] == 200


def test_each_row_is_a_capture(spark):
    rows = [(1, "http://a/1", "same"), (1, "http://a/1", "same"), (1, "http://a/2", "same"), (0, "http://a/3", "same"), (None, "http://a/4", ""), (None, "http://a/5", ""), (None, None, None)]
    path = new_path(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    records = warc.read_records(spark, path)
    assert records.select("record_id").distinct().count() == records.count() == 3 * len(rows)
    got = warc.captures(records.unionByName(records)).collect()  # a replay adds nothing
    assert sorted((r["metadata"]["page_id"] is None, r["metadata"]["page_id"] or 0, r["response"]["target_uri"]) for r in got) == sorted((i is None, i or 0, u or "") for i, u, _ in rows)
    answers = {r["record_id"]: r["response"]["type"] for r in got}
    assert [answers[r["refers_to"]] for r in records.where("type = 'revisit'").collect()] == ["response"]


def test_files_are_rolled_by_bytes(spark, monkeypatch, tmp_path):
    import gzip

    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    monkeypatch.setattr(warc, "SIZES", (5_000, 50_000))
    html = [(k, "http://a/", f"{k} " * n) for k, n in enumerate([1] * 60 + [5_000] * 9 + [100_000])]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(html, "page_id long, url string, html string").coalesce(1), path)
    sizes = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").glob("*.gz")]
    assert sum(n > 100_000 for n in sizes) == 1 and len(sizes) > 3
    got = warc.captures(warc.read_records(spark, path)).collect()
    assert {r["metadata"]["page_id"]: bytes(r["response"]["payload"]).decode() for r in got} == {i: h for i, _, h in html}


@pytest.mark.parametrize("chunk", [7, 1 << 20])
def test_archives_in_any_packing(monkeypatch, chunk):
    import gzip

    monkeypatch.setattr(warc, "CHUNK", chunk)
    blocks = [b"", b"a\r\n\r\nb" * 50, bytes(range(256)) * 40, b"x" * 20_000]
    records = [b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in blocks]
    for data in (b"".join(records), gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert [b for _, b in warc.parse_archive(data)] == blocks
    assert list(warc.parse_archive(b"")) == []
    with pytest.raises(ValueError):
        list(warc.parse_archive(records[3][:-100]))


def test_small_payloads_are_responses(spark):
    pages = spark.createDataFrame([(k, "http://a/", "same") for k in range(5)], "page_id long, url string, html string")
    path = new_path(spark, "warc")
    warc.write_archives(pages, path, min_bytes=5)
    assert warc.read_records(spark, path).where("type = 'response'").count() == 5


def test_no_pages(spark, hard):
    none = hard.limit(0)
    assert round_trip(spark, none).count() == 0
    assert url_filter.judge_urls(none).count() == 0


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[k:]
    m = next((m for m, c in enumerate(path) if c in "?#"), len(path))
    return "".join(c.lower() if c.isascii() else c for c in rest[:k]), path[:m]


def judged(url):
    host, path = parts(url)
    fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best[0] + best[1] if best else None, best[2] if best else None


@pytest.mark.parametrize("which", ["pages", "hard"])
def test_urls(request, spark, sf, which):
    pages = table(spark, sf, "pages") if which == "pages" else request.getfixturevalue("hard")
    url = {r["page_id"]: r["url"] for r in pages.collect()}
    got = url_filter.judge_urls(pages).collect()
    assert len(got) == len(url)
    for r in got:
        host, path, rule, verdict = judged(url[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["mined"] else "allow"))


def test_mined_rules_against_all_subsets(spark):
    sets = [(["a", "b"], True)] * 30 + [(["a", "c"], False)] * 30 + [(["b", "c"], False)] * 20 + [(["d"], True)] * 10 + [(["d", "e"], True)] * 10 + [(["f"], True)]
    rules = url_filter.mine_rules(spark.createDataFrame(sets, "tokens array<string>, blocked boolean"), 0.05, 0.95)
    assert sorted(tuple(r["tokens"]) for r in rules) == [("a", "b"), ("d",), ("e",)]
    urls = spark.createDataFrame([(["a", "b", "x"],), (["a", "x"],), (["d"],), ([],)], "tokens array<string>")
    assert {tuple(r["tokens"]): r["mined"] for r in url_filter.match_rules(urls, rules).collect()} == {("a", "b", "x"): "a & b", ("d",): "d"}


def test_rules_from_all_tokens_of_long_urls(spark):
    keys = [f"query:k{k:02}" for k in range(30)]  # always together: 2**30 itemsets, but only single tokens can be rules
    sets = [(["host:a", "path:z"], True)] * 20 + [(["host:a", *keys, "path:z"], False)] * 20 + [([*keys, "query:bad"], True)] * 20 + [([*keys[:12], "x"], False)] * 20
    rules = url_filter.mine_rules(spark.createDataFrame(sets, "tokens array<string>, blocked boolean"), 0.05, 0.95)
    assert [(r["tokens"], r["support"], r["confidence"]) for r in rules] == [(["query:bad"], 0.25, 1.0)]


def test_a_rule_teaches_nothing_about_its_own_words(spark):
    """All of net/es/ and com/ are decided by definition; only what else their URLs have in common is learned."""
    rows = [f"http://{h}.net/es/{k}" for h in ("good", "spam") for k in range(30)] + [f"http://good.com/de/{k}" for k in range(60)] + ["http://good.net/de/x", "http://spam.net/de/x", "http://spam.org/es/x", "http://other.net/es2/"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id int, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    assert [(got[k]["verdict"], got[k]["mined"]) for k in range(120, 124)] == [("allow", None), ("block", "host:spam"), ("block", "host:spam"), ("allow", None)]


def test_rules_need_lift(spark):
    sets = [(["a"], True)] * 96 + [(["b"], False)] * 4 + [(["c"], True)] * 20
    labelled = spark.createDataFrame(sets, "tokens array<string>, blocked boolean")
    assert url_filter.mine_rules(labelled, 0.05, 0.95) == []
    assert sorted(r["tokens"] for r in url_filter.rule_table(labelled, 0.05, 0.95, z=0).collect()) == [["a"], ["c"]]


def test_rules_are_found_where_nearly_all_is_blocked(spark):
    for n in (90, 2000):  # of 100 and of 2,020 examples
        rows = [f"http://spam{k % 9}.net/es/z" if k % 2 else f"http://bad.net/es/q{k}" for k in range(n)] + [f"http://good.com/de/{k}" for k in range(max(10, n // 100))]
        pages = spark.createDataFrame([*enumerate(rows), (9000, "http://bad.org/x"), (9001, "http://other.org/x")], "page_id int, url string")
        got = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect() if r["page_id"] >= 9000}
        if n == 90:  # 45 rows aren't sure enough against a share of 90 %, and the same rows of 90 are
            assert got[9000]["verdict"] == "allow"
            assert [r["tokens"] for r in url_filter.mine_rules(spark.createDataFrame([(["s"], True)] * 90 + [(["t"], False)] * 10, "tokens array<string>, blocked boolean"), 0.05, 0.95)] == [["s"]]
        else:
            assert (got[9000]["verdict"], got[9000]["mined"]) == ("block", "host:bad")
        assert got[9001]["verdict"] == "allow"


def test_rules_rest_on_enough_rows(spark):
    labelled = spark.createDataFrame([(["few"], True)] * 19 + [(["many"], True)] * 20 + [(["x"], False)] * 61, "tokens array<string>, blocked boolean")
    assert sorted(r["tokens"] for r in url_filter.rule_table(labelled).collect()) == [["few"], ["many"]]
    assert [r["tokens"] for r in url_filter.rule_table(labelled, min_rows=url_filter.MIN_ROWS).collect()] == [["many"]]


def test_leave_one_rule_out(spark):
    rows = [f"http://{h}.net/{p}/{k}" for h, p in (("spam", "es"), ("spam", "fr"), ("good", "es")) for k in range(40)] + [f"http://good.com/de/{k}" for k in range(80)]
    got = {r["rule"]: tuple(r)[1:] for r in url_filter.leave_one_rule_out(spark.createDataFrame(list(enumerate(rows)), "page_id int, url string")).collect()}
    assert got == {"net/es/": ("block", 80, 40), "net/fr/": ("block", 40, 40), "com/": ("allow", 80, 0)}

def test_repeated_pages(spark):
    pages = spark.createDataFrame([(1, "http://example.com/en/a")] * 3 + [(1, "http://a.org/")], "page_id int, url string")
    assert sorted(r["verdict"] for r in url_filter.judge_urls(pages).collect()) == ["allow", "block", "block", "block"]


def test_labels_teach_new_hosts(spark):
    labelled = spark.createDataFrame([(f"http://casino.org/p{k}", True) for k in range(50)] + [(f"http://school.org/p{k}", False) for k in range(50)], "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://casino.org/x"), (2, "http://school.org/x")], "page_id int, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, labelled=labelled).collect()} == {1: "block", 2: "allow"}


def test_base32(spark):
    df = spark.createDataFrame([("",), ("a" * 1000,)], "t string")
    assert [r[0] for r in df.select(warc.base32_sha1(F.col("t"))).collect()] == [base64.b32encode(hashlib.sha1(t).digest()).decode() for t in (b"", b"a" * 1000)]


def test_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf}/pages.parquet')")
    got = warc.op3_warc(spark, sf)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({warc.ORACLE['op3_warc']})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.collect())
