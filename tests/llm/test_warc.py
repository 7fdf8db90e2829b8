import gzip
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from compare import connect, duck_rows, spark_rows
from frames import CLASHING, SF, rows_of
from plumbline.llm import warc
from plumbline.llm.queries import ORACLES, QUERIES
from plumbline.session import scratch_path

PAGES = [
    (1, "http://a/1\r\nx%41", "x" * 1000), (2, None, "x" * 1000), (3, "", "x" * 1000), (4, "u", "y" * 999), (5, "u", "y" * 999), (6, "u", None),
    (7, "u", ""), (8, "u", "ü\r\n\r\nWARC/1.1\r\n" * 200), (9, "u", "z" * 300_000), (9, "u", "z" * 300_000), (None, "n", "x" * 1000), (-5, "u", "é" * 500),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in CLASHING + ["payload", "digest", "size", "kept"]})


def test_every_page_comes_back(spark, pages):
    found = sorted(rows_of(warc.round_trip(pages), *warc.RECORD.replace(" long", "").replace(" string", "").replace(" binary", "").split(", ")), key=repr)
    expected = []
    for page_id, url, html in PAGES:
        payload = (html or "").encode()
        same = [p for p, _, h in PAGES if h == html and p is not None]
        kept = max(same) if len(payload) >= 1000 and len([1 for _, _, h in PAGES if h == html]) > 1 and page_id is not None and max(same) > page_id else None
        digest = hashlib.sha1(payload).hexdigest()
        expected.append((page_id, url, "response" if kept is None else "revisit", kept, digest, len(payload), payload if kept is None else None))
    assert [(*r[:-1], None if r[-1] is None else bytes(r[-1])) for r in found] == sorted(expected, key=repr)


def test_same_as_sql(spark):
    assert spark_rows(QUERIES["op2_warc_archives"](spark, SF)) == duck_rows(connect(SF), ORACLES["op2_warc_archives"])


def test_archives_are_gzip_members_named_by_the_manifest(spark, pages):
    folder = scratch_path(spark, "warc-test")
    manifest = warc.write_archives(pages, folder).collect()
    for row in manifest:
        data = Path(folder.removeprefix("file://"), row.archive).read_bytes()
        assert len(data) == row.bytes and gzip.decompress(data).count(b"WARC-Record-ID") == row.records
    assert sum(r.records for r in manifest) == len(PAGES)


def test_damage_is_found():
    payload = b"p" * 50
    good = warc.member(1, "u", payload, hashlib.sha1(payload).hexdigest(), None, 50)
    assert warc.parsed(next(warc.members([good[:7], good[7:]])))[-1] == payload
    assert len(list(warc.members([good + good[:5], good[5:]]))) == 2
    with pytest.raises(warc.DamagedArchive, match="ends within"):
        list(warc.members([good[:-4]]))
    text = gzip.decompress(good)
    for wrong, message in ((text.replace(b"ppp", b"ppq", 1), "digest"), (text[:-6] + text[-4:], "bytes"), (text + b"x", "bytes"), (b"HTTP/1.1 200\r\n\r\n", "header")):
        with pytest.raises(warc.DamagedArchive, match=message):
            warc.parsed(wrong)


def test_empty_table(spark, pages):
    assert warc.round_trip(pages.where("false")).count() == 0
