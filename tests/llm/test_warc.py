import hashlib

import numpy as np
import pytest
from compare import duck, of_spark

from gleaner.llm import warc
from gleaner.llm.common import shared_dir
from gleaner.llm.queries import ORACLE_SQL, QUERIES

PAGES = "page_id long, url string, html string, digest int, size string"
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def rows():
    big, nested = "é" * 60, "x" * 50 + FAKE * 3 + "WARC/1.1\r\nContent-Length: 99999\r\n\r\n" + FAKE
    body = [big, big, None, "", "small", "small", nested, nested, FAKE, FAKE * 2, "\r\n\r\n", "a\nb\r\n" * 40, "z" * 99, "z" * 99, "z" * 100, "z" * 100, "q" * 300_000, "nul\0" * 40]
    out = [(k + 5, f"http://h/{k}", b, 1, "s") for k, b in enumerate(body)]
    return [*out, out[1], out[0], (None, "http://n\r\nX: y", big, 1, "s"), (None, None, "n" * 200, 1, "s"), (77, None, "n" * 200, 1, "s")]


def brute(rows):
    first = {}
    for r in rows:
        b = (r[2] or "").encode()
        if len(b) >= 100 and r[0] is not None:
            first[b] = min(first.get(b, r[0]), r[0])
    out = []
    for r in rows:
        b = (r[2] or "").encode()
        again = b in first and first[b] != r[0]
        out.append((r[0], len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


COLUMNS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_sql(spark, sf):
    assert of_spark(QUERIES["op9_warc"](spark, sf)) == duck(sf, ORACLE_SQL["op9_warc"])


def test_odd(spark):
    df = spark.createDataFrame(rows(), PAGES).repartition(2)
    got = warc.round_trip(df)
    assert sorted((tuple(r) for r in got.select(COLUMNS).collect()), key=repr) == brute(rows())
    html = {r[0]: (r[2] or "").encode() for r in rows()}
    assert all(bytes(r["payload"]) == html[r["page_id"]] for r in got.where("record_type = 'response' and page_id is not null").collect())
    assert warc.round_trip(df.where("page_id < 0")).count() == 0


def test_chain_passes_over_payloads():
    data = b"".join(b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(p), p) for p in (FAKE.encode(), b"", FAKE.encode() * 5, b"x"))
    at, _, after = warc.candidates(data)
    assert len(at) == 10 and warc.chain(at, after, len(data)).sum() == 4
    assert warc.chain(at[1:], after[1:], len(data)).sum() == 0
    assert warc.chain(np.zeros(0, np.int64), np.zeros(0, np.int64), 0).sum() == 0


def test_long_chain_and_break(spark, tmp_path):
    one = FAKE.replace("\r\n\r\nabc", "\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha256:" + hashlib.sha256(b"abc").hexdigest() + "\r\nWARC-Payload-Length: 3\r\nWARC-Target-URI: u\r\n\r\nabc").encode()
    (tmp_path / "a.txt").write_bytes(one * 700 + one[:-9])
    (tmp_path / "b.txt").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"noise" + one)
    assert warc.read(spark, f"file://{tmp_path}").count() == 700
    (tmp_path / "a.txt").write_bytes(one.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, f"file://{tmp_path}").count()


def test_shared_dir(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_many_magics_take_linear_time():
    import time

    for noise in (warc.MAGIC * 100_000, b"WARC/1.1\r\nA: b\r\n" * 60_000, (warc.MAGIC + b"Content-Length: 7\r\n") * 35_000, (warc.MAGIC + b"\r\n") * 80_000):
        data = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(noise), noise) * 2
        start = time.process_time()
        at, body, after = warc.candidates(data)
        k = np.flatnonzero(warc.chain(at, after, len(data)))
        assert time.process_time() - start < 1.5
        assert len(k) == 2 and all(data[body[j] : after[j] - 4] == noise for j in k)


def test_repeated_digests_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "REPEATED", 0)
    df = spark.createDataFrame(rows(), PAGES).repartition(2)
    assert sorted((tuple(r) for r in warc.round_trip(df).select(COLUMNS).collect()), key=repr) == brute(rows())
