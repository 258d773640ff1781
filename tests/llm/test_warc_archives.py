"""Archives: round trips, revisits, frames and damage."""

import base64
import hashlib
import io
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from rankloom.llm import warc_archives as warc

HTML = "<html><body>" + "some page text " * 20 + "</body></html>"
ROWS = [(5, "http://a/b c\r\nX: y", HTML), (3, "http://é.example/", HTML), (9, None, HTML), (1, "http://x", None),
        (2, "http://x", ""), (7, "http://y", "one\r\n\r\ntwo\r\n\r\n"), (8, "", "é" * 4000), (None, "http://n", HTML),
        (None, "http://n", "only without ids"), (None, None, "only without ids"), (4, "u", "x" * 3_000_000),
        (3, "http://again", HTML), (6, "http://r", "twice"), (6, "http://r", "twice")]


def pages(spark, rows=ROWS):
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return table.withColumns({c: F.lit(1) for c in ("digest", "size", "payload", "record_type", "first", "archive")})


def plain(rows, least=0):
    out = Counter()
    for page_id, _, html in rows:
        body = (html or "").encode()
        ids = [i for i, _, h in rows if (h or "").encode() == body and i is not None] if len(body) >= least else []
        first = min(ids, default=None)
        other = first if first is not None and first != page_id else None
        out[page_id, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(),
            "response" if other is None else "revisit", other] += 1
    return out


def test_awkward_rows_come_back(spark):
    for least in (0, 16):
        got = warc.archived_pages(pages(spark).repartition(3), least_bytes=least)
        assert Counter(tuple(r) for r in got.collect()) == plain(ROWS, least)
    assert warc.archived_pages(pages(spark, [])).count() == 0


def test_files_hold_the_texts(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    table = table.unionByName(table.where("page_id % 3 = 0").withColumn("page_id", F.col("page_id") + 100_000))
    manifest = warc.write_archives(table.coalesce(2), str(tmp_path / "out"), archive_bytes=100_000)
    files = list((tmp_path / "out").iterdir())
    assert manifest.count() == len(files) > 2
    assert manifest.agg(F.sum("records")).first()[0] == table.count()
    read = warc.read_archives(warc.archives_in(spark, str(tmp_path / "out")))
    stored = {r.page_id: r for r in read.collect()}
    for row in table.collect():
        record = stored[row.page_id]
        if row.page_id >= 100_000:
            assert (record.record_type, record.refers_to, record.payload) == ("revisit", row.page_id - 100_000, None)
        else:
            assert (record.record_type, bytes(record.payload).decode(), record.url) == ("response", row.html, row.url)
    # every record opens alone from its offset, with the dictionary of the leading frame
    learnt = {r.archive for r in manifest.where("dictionary_bytes > 0").collect()}
    record = next(r for r in stored.values() if r.archive in learnt and r.record_type == "response")
    with open(record.archive.removeprefix("file://"), "rb") as file:
        held = file.read()
    assert int.from_bytes(held[:4], "little") == warc.DICTIONARY_MAGIC
    size = int.from_bytes(held[4:8], "little")
    words = zstandard.ZstdCompressionDict(held[8:8 + size])
    one = zstandard.ZstdDecompressor(dict_data=words).decompressobj().decompress(held[record.offset:])
    assert warc.parse_record(one).page_id == record.page_id
    with pytest.raises(zstandard.ZstdError):
        zstandard.ZstdDecompressor().decompressobj().decompress(held[record.offset:])


def test_only_committed_archives_are_read(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = f"file://{tmp_path}"
    warc.write_archive(folder, [warc.page_record(1, "u", b"x", 1, warc.base32_digest(b"x"), None)])  # a lost attempt's
    assert warc.archived_pages(table, folder).count() == table.count()


def test_dictionary_shrinks_records():
    texts = [f"<html><head><title>Page {i}</title></head><body class='main'>{'text %d ' % i * 9}</body></html>" * 4
             for i in range(900)]
    records = [warc.page_record(i, "u", t.encode(), len(t), warc.base32_digest(t.encode()), None)
               for i, t in enumerate(texts)]
    plain_packer = zstandard.ZstdCompressor(level=warc.LEVEL)
    alone = sum(len(plain_packer.compress(r)) for r in records)
    words = warc._dictionary(records, sum(map(len, records)))
    assert sum(len(zstandard.ZstdCompressor(level=warc.LEVEL, dict_data=words).compress(r)) for r in records) < 0.8 * alone


def archive(*records, dictionary=None):
    packer = zstandard.ZstdCompressor()
    frames = b"".join(packer.compress(r) for r in records)
    return io.BytesIO(frames)


def test_damage_is_noticed():
    good = warc.page_record(1, "u", b"abc", 3, warc.base32_digest(b"abc"), None)
    assert warc.parse_record(good).payload == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(good.replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        warc.parse_record(good[:-1])
    whole = zstandard.ZstdCompressor().compress(good)
    assert [r for _, r in warc.archive_frames(io.BytesIO(whole * 3), 7)] == [good] * 3
    with pytest.raises(ValueError):
        list(warc.archive_frames(io.BytesIO(whole + whole[:-9])))
    skipped = (warc.SKIPPABLE_MAGIC + 3).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"other"
    assert [at for at, _ in warc.archive_frames(io.BytesIO(skipped + whole), 3)] == [13]
