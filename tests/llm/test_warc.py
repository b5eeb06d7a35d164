import hashlib

import pytest
import zstandard

from quern.llm import warc


def pages(spark):
    big, other = "x" * 1000, "é" * 700
    rows = [(1, "http://a/", big), (5, "http://b/\r\nWARC-Type: x", big), (3, None, big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (9, "u", other), (None, "u", big), (9, "u", other), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 100), (11, "u", "y" * 3_000_000)]
    return rows, spark.createDataFrame([(*r, 1, "z") for r in rows], "page_id long, url string, html string, n int, digest string")


def want(rows):
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and i is not None:
            first[raw] = max(first.get(raw, i), i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        owner = first.get(raw)
        refers = owner if owner is not None and owner != i else None
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows, df = pages(spark)
    for frame, bundle in ((1 << 20, 64 << 20), (500, 2000)):
        archive = warc.write_archive(df, frame_bytes=frame, bundle_bytes=bundle)
        got = warc.read_archive(archive).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(rows)
        by = {(r.page_id, r.record_type): bytes(r.payload) for r in got}
        assert by[11, "response"] == b"y" * 3_000_000 and by[1, "revisit"] == b""


def test_bundles_are_seekable_zstandard(spark):
    rows, df = pages(spark)
    archive = warc.write_archive(df, frame_bytes=500, bundle_bytes=3000)
    seen = frames = 0
    for r in archive.collect():
        data = bytes(r.data)
        table = warc.read_seek_table(data)
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        assert len(plain) == sum(n for *_, n in table)
        frames += len(table)
        for i, frame, at, n in zip(r.record_ids, r.frames, r.offsets, r.lengths, strict=True):
            head, block = warc.parse_record(plain, sum(x for *_, x in table[:frame]) + at, n)
            assert head["WARC-Record-ID"] == f"<urn:page:{'null' if i is None else i}>" and int(head["Content-Length"]) == len(block)
            seen += 1
    assert seen == len(rows) and frames > 4


def test_reader_depends_on_the_seek_table(spark):
    from pyspark.sql import functions as F

    _, df = pages(spark)
    archive = warc.write_archive(df, frame_bytes=500)
    broken = archive.withColumn("data", F.expr("substring(data, 1, length(data) - 9)"))
    with pytest.raises(Exception, match="no seek table"):
        warc.read_archive(broken).collect()


def test_single_records_and_empty(spark):
    rows, df = pages(spark)
    archive = warc.write_archive(df)
    got = warc.read_records(archive, [2, 8])
    assert sorted(r.page_id for r in got.collect()) == [2, 8]
    assert warc.read_archive(warc.write_archive(df.where("false"))).count() == 0
