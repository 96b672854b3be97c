import gzip
import hashlib

import pyarrow as pa
import pytest
from lithograph.llm import queries, warc_archive
from pyspark.sql import functions as F

BIG, OTHER = "ä" * 500, "x" * 999  # 1000 bytes; 999
PAGES = "page_id long, url string, html string, address string, record_id int, parts int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "a", 1, 2) for i, u, h in rows], PAGES)


def expected(rows):
    """By the contract, row by row."""
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        last = max((j for j, _, h in rows if j is not None and (h or "").encode() == data), default=None)
        revisit = len(data) >= 1000 and i != last
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def test_revisits_name_the_response_with_the_largest_page_id(spark):
    rows = [(1, "http://a/", BIG), (9, "http://b/\r\nWARC-Type: x", BIG), (3, None, BIG), (4, "http://ü/", OTHER), (5, "u", OTHER), (6, "u", None), (7, "u", ""), (None, "u", "line\r\n\r\nWARC/1.1\r\n" * 99), (None, None, None)]
    got = warc_archive.archive_and_read(pages(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == expected(rows)


def test_repeated_rows_have_one_response(spark):
    got = warc_archive.archive_and_read(pages(spark, [(2, "u", BIG)] * 3 + [(2, "v", BIG), (1, "u", BIG)])).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == sorted([(2, "response", None)] + [(2, "revisit", 2)] * 3 + [(1, "revisit", 2)], key=str)
    assert warc_archive.archive_and_read(pages(spark, [])).count() == 0


def test_a_shared_payload_is_stored_once_in_parts(spark, tmp_path):
    rows = [(i, f"http://x/{i}", BIG + str(i % 2) if i % 3 else f"own {i}") for i in range(4000)]
    warc_archive.write_archive(pages(spark, rows), f"file://{tmp_path}/a")
    stored = spark.read.parquet(f"{tmp_path}/a/payloads")
    assert stored.count() == stored.select("address").distinct().count() == len({h for *_, h in rows}) and stored.agg(F.max("parts")).first()[0] == 3
    got = warc_archive.archived_pages(spark, f"file://{tmp_path}/a").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected_fast(rows)


def expected_fast(rows):
    last = {}
    for i, _, h in rows:
        last[h] = max(i, last.get(h, i))
    return sorted(((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), *(("revisit", last[h]) if len(h.encode()) >= 1000 and last[h] != i else ("response", None))) for i, _, h in rows), key=str)


def test_damage_is_found(spark, tmp_path):
    warc_archive.write_archive(pages(spark, [(1, "u", "hello"), (2, "u", BIG)]), f"file://{tmp_path}/a")
    stored = spark.read.parquet(f"{tmp_path}/a/payloads").withColumn("payload", F.concat("payload", F.lit(b"!")))
    stored.write.parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{tmp_path}/a/records").write.parquet(f"{tmp_path}/b/records")
    with pytest.raises(Exception, match="damaged"):
        warc_archive.read_archive(spark, f"file://{tmp_path}/b").select("record").collect()


ODD = [
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nwarc-record-id: <urn:x:1>\r\nContent-Length: 4\r\n\r\nab\r\n\r\n\r\n",
    b"WARC/1.1\r\nWARC-Record-ID: <urn:x:2>\r\nX-Folded: a\r\n  b\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 31\r\n\r\nHTTP/1.0 404 No\r\na:  b\r\n\r\nhtml!\r\n\r\n",
    b"WARC/1.1\r\nContent-Length: 0\r\nContent-Type: text/plain\r\n\r\n\r\n\r\n",
    b"WARC/1.1\r\nWARC-Record-ID: <urn:x:4>\r\nContent-Length: 5\r\n\r\n\xff\x00abc\r\n\r\n",
    b"WARC/1.1\r\nWARC-Record-ID: <urn:x:5>\r\nContent-Length: 5\r\n\r\n\xff\x00abc\r\n\r\n",
]


@pytest.mark.parametrize("packed", [False, True])
def test_foreign_records_come_back_byte_by_byte(spark, tmp_path, packed):
    (tmp_path / "in.warc").write_bytes(b"".join(gzip.compress(r) for r in ODD) if packed else b"".join(ODD))
    records = warc_archive.read_warc(spark.createDataFrame([(f"file://{tmp_path}/in.warc",)], "path string"))
    warc_archive.archive_records(records, f"file://{tmp_path}/a")
    restored = warc_archive.read_archive(spark, f"file://{tmp_path}/a")
    assert sorted(bytes(r.record) for r in restored.collect()) == sorted(ODD)
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == 4  # two records share theirs
    manifest = warc_archive.write_warc(restored, f"file://{tmp_path}/out").collect()
    assert sum(m.records for m in manifest) == len(ODD)
    files = sorted(tmp_path.glob("out/*.warc.gz"))
    assert sorted(b"".join(gzip.decompress(f.read_bytes()) for f in files)) == sorted(b"".join(ODD))


def test_broken_files_are_refused():
    whole = list(warc_archive.warc_records(pa.BufferReader(b"\r\n" + b"".join(ODD))))
    assert [h + p + b"\r\n\r\n" for h, p in whole] == ODD
    for data in (ODD[0][:40], b"no such thing" * 9, ODD[3][:-8]):
        with pytest.raises(ValueError):
            list(warc_archive.warc_records(pa.BufferReader(data)))


def test_pages_of_the_small_table(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op11_warc_archive(spark, sf).collect()), key=str) == expected(rows)
