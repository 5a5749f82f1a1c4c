import base64
import hashlib
import random

import pytest

from tidemark.llm import warc
from tidemark.llm.common import new_folder


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def by_hand(rows):
    leads = {}
    for page, _, html in rows:
        leads.setdefault(html or "", []).append(-(2**63) if page is None else page)
    out = []
    for html, ids in leads.items():
        top = max(ids)
        data = html.encode()
        first = True
        for page in sorted(ids, reverse=True):
            back = None if page == -(2**63) else page
            lead = None if top == -(2**63) else top
            out.append((back, len(data), digest(data), "response" if first else "revisit", None if first else lead))
            first = False
    return out


def key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)


def test_round_trip(spark):
    random.seed(2)
    big = "".join(random.choices("abcdé\r\n0 ", k=200_000))
    rows = [(i, f"http://x/{i}", random.choice(["a", "", None, "0\r\n\r\n", "é" * 9000, big, big[1:]])) for i in range(40)]
    rows += [(3, "u", "same"), (3, "u", "same"), (9, None, "same"), (None, "a\r\nb", "only"), (None, None, "é")]
    got = warc.archive_and_read(pages(spark, rows).withColumnRenamed("url", "url")).collect()
    assert all(r.fault is None for r in got)
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got]
    assert sorted(have, key=key) == sorted(by_hand(rows), key=key)


def test_segments_over_several_archives(spark):
    rows = [(i, "u", chr(97 + i) * 5000) for i in range(6)]
    folder = new_folder(spark, "warc-test")
    names = warc.write_archives(pages(spark, rows).coalesce(1), folder, segment=700, chunk=999, most=300)
    assert names.count() > 6
    records = warc.read_records(spark, folder)
    assert records.where("type = 'continuation'").count() > 30
    whole = warc.join_segments(records).collect()
    assert len(whole) == 6 and all(r.fault is None and len(r.block) == r.total for r in whole)
    assert {r.payload_digest for r in warc.read_payloads(spark, folder).collect()} == {digest(r[2].encode()) for r in rows}


@pytest.mark.parametrize("gone,fault", [(1, "no first segment"), (3, "segments missing or repeated")])
def test_lost_segment_is_a_fault(spark, gone, fault):
    folder = new_folder(spark, "warc-test")
    warc.write_archives(pages(spark, [(1, "u", "x" * 5000)]), folder, segment=700)
    records = warc.read_records(spark, folder).where(f"segment <> {gone}")
    row = warc.join_segments(records).first()
    assert row.block is None and row.fault == fault
    last = warc.read_records(spark, folder).where("total is null")
    assert warc.join_segments(last).first().fault == "last segment missing"
    short = warc.read_records(spark, folder).selectExpr("* except (total)", "total + 1 as total")
    assert warc.join_segments(short).first().fault == "length differs from the stated total"


def test_files_of_a_lost_attempt_are_not_read(spark):
    """The same pages written twice into one folder, as a repeated task does it: one set is named."""
    rows = [(i, "u", "ab"[i % 2] * 50) for i in range(8)]
    folder = new_folder(spark, "warc-test")
    warc.write_archives(pages(spark, rows), folder)
    names = warc.write_archives(pages(spark, rows).repartition(2), folder)
    have = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_payloads(spark, folder, names).collect()]
    assert sorted(have, key=key) == sorted(by_hand(rows), key=key)
    assert warc.read_records(spark, folder).count() == 2 * warc.read_records(spark, folder, names).count()


def test_chunk_framing():
    assert warc.unchunked(warc.chunked(b"", 5)) == b""
    assert warc.unchunked(warc.chunked(b"abcdefgh", 3)) == b"abcdefgh"
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc")


def test_empty_table(spark):
    assert warc.archive_and_read(pages(spark, [])).count() == 0
