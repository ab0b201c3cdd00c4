import base64
import hashlib
from collections import Counter

from tidelayer.llm.warc import END, RecordReader, captures, page_captures, read_archives, write_archives
from tidelayer.session import run_dir

SCHEMA = "page_id BIGINT, url STRING, html STRING, payload STRING, number BIGINT, record_type STRING"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "t") for r in rows], SCHEMA)


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def brute(rows, least=0):
    first, out = {}, Counter()
    for page, _, html in rows:
        key = html or ""
        first[key] = max(first.get(key, -1), -1 if page is None else page)
    for page, _, html in rows:
        key = html or ""
        size = len(key.encode())
        is_first = size < least or (-1 if page is None else page) == first[key]
        out[(page, size, digest(key), "response" if is_first else "revisit", None if is_first else (first[key] if first[key] >= 0 else None))] += 1
    return out


ROWS = [
    (1, "http://a", "same"), (2, "http://b", "same"), (3, None, "same"), (4, "http://c", None), (5, "http://d", ""), (6, "http://e\r\nX: y", f"ends{END}"),
    (7, "http://f", f"{END}WARC/1.1\r\nContent-Length: 5{END}"), (8, "u", "café \U0001f600"), (9, "u", "\r\n"), (10, "u", "long " * 200_000),
    (11, "u", "\n\r\n\r\r\n\r\n\n"), (None, None, "no id"), (3, None, "same"), (1, "http://a", "same"), (None, None, None),
]


def round_trip(spark, rows, least=0):
    path = run_dir(spark, "warc-test")
    write_archives(pages(spark, rows).repartition(2), path, least)
    return read_archives(spark, path)


def test_round_trip(spark):
    records = round_trip(spark, ROWS)
    assert Counter(map(tuple, page_captures(records).collect())) == brute(ROWS)
    payloads = {r.response.block.partition(END.encode())[2].decode() for r in captures(records).collect() if r.response.record_type == "response"}
    assert payloads == {html or "" for _, _, html in ROWS}


def test_one_nested_row_per_capture(spark):
    whole = captures(round_trip(spark, ROWS)).collect()
    assert len(whole) == len(ROWS) and all(len(r.requests) == 1 and len(r.metadata) == 1 for r in whole)
    assert {r.response.target_uri for r in whole} >= {"http://a", None, "http://eX: y"}


def test_small_payloads_are_responses(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")]
    assert Counter(map(tuple, page_captures(round_trip(spark, rows, least=3)).collect())) == brute(rows, 3)


def test_empty_table(spark):
    assert page_captures(round_trip(spark, [])).count() == 0


def test_reader_takes_any_pieces():
    records = [b"WARC/1.1\r\nWARC-Type: a\r\nContent-Length: 7\r\n\r\nx\r\n\r\nyz", b"WARC/1.1\r\nContent-Length: 0\r\n\r\n"]
    data = b"".join(r + b"\r\n\r\n" for r in records * 3)
    for size in (1, 3, 4, 11, len(data)):
        reader = RecordReader()
        got = [block for i in range(0, len(data), size) for _, block in reader.feed(data[i : i + size])]
        assert got == [b"x\r\n\r\nyz", b""] * 3
