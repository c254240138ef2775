import base64
import gzip
import hashlib

from lodevec.llm import warc_index as W
from lodevec.llm.queries import op2_warc_index
from lodevec.llm.shared_files import RangeReader

PAGES = [
    (5, "https://b.Example.org/x?q=1", "same"),
    (2, "http://a.example.org:8080/y", "same"),
    (3, "https://b.example.org/x?q=1", None),
    (4, None, ""),
    (9, "no scheme\r\nX: y%", "long " * 50_000),
    (None, "https://c.test/", "same"),
    (None, "https://c.test/only", "alone"),
    (7, "https://ünï.test/é", "🙂\r\n\r\nbody"),
    (7, "https://ünï.test/é", "🙂\r\n\r\nbody"),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(i, u, h, "x", 3) for i, u, h in rows], "page_id long, url string, html string, path string, size int")


def expected(rows):
    least = {}
    for i, _, h in rows:
        h = h or ""
        if i is not None and (h not in least or i < least[h]):
            least[h] = i
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = least.get(h or "")
        revisit = first is not None and first != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_archives_read_back(spark):
    captures = W.write_archives(frame(spark))
    index = W.build_index(captures, lines=2)
    back = W.captures_of(index)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, captures.collect()), key=str)
    rows = W.read_records(back).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == expected(PAGES)
    assert {r.url for r in rows} == {u for _, u, _ in PAGES}


def test_least_bytes_and_empty_table(spark):
    rows = W.read_records(W.write_archives(frame(spark), least_bytes=10)).collect()
    assert {r.record_type for r in rows if r.payload_bytes < 10} == {"response"}
    none = W.write_archives(frame(spark).where("false"))
    assert W.captures_of(W.build_index(none)).count() == 0 and W.read_records(none).count() == 0


def test_members_are_plain_gzip(spark):
    one = W.write_archives(frame(spark, [(1, "http://t.test/a", "abc")])).first()
    with RangeReader(one.path) as file:
        text = gzip.decompress(file.read(one.at, one.size))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and W.parse_record(text)["payload"] == b"abc"


def test_lookup_is_a_binary_search(spark):
    pages = [(i, f"https://h{i % 40:02d}.test/p{i}", f"t{i}") for i in range(400)] + [(1000 + i, "https://h07.test/hot", f"hot{i}") for i in range(150)]
    index = W.build_index(W.write_archives(frame(spark, pages)), lines=8)
    asked = spark.createDataFrame([("https://H07.test/p47",), ("http://h07.test/hot",), ("https://h99.test/",), (None,), ("https://a.test/",)], "url string")
    found = W.lookup(spark, index, asked).collect()
    assert sorted(r.page_id for r in found) == [47, *range(1000, 1150)]
    assert W.lookup(spark, index, asked.where("false")).count() == 0
    none = W.build_index(W.write_archives(frame(spark).where("false")))
    assert W.lookup(spark, none, asked).count() == 0


def test_lookup_of_all_urls_gives_all_captures(spark):
    captures = W.write_archives(frame(spark))
    index = W.build_index(captures, lines=2)
    found = W.lookup(spark, index, frame(spark))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, captures.collect()), key=str)


def test_keys_reverse_hosts():
    assert W.sort_key("https://a.B.org/x") == "org,b,a)/x" and W.sort_key(None) == ")" and W.sort_key("http://a.org:81?q") == "org,a:81)?q"


def test_query(spark, sf_dir):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows = op2_warc_index(spark, sf_dir).collect()
    assert sorted(map(tuple, rows), key=str) == expected(pages)
