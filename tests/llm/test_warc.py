import base64
import hashlib

import pytest

from rankloom.llm import warc

SEP = "WARC/1.1\r\n"
ODD = [
    "", "<p>é</p>", SEP, "\r\n" + SEP, "a" + SEP * 3 + "é" * 5, "x\r\n\r\nWARC/1.1", "WARC", "WARC/1.1", "éWARC/1.1\r\nWARC-Type: response\r\n\r\n",
    "ends\r\n\r\n", "\r\n\r\n", "\n", "Transfer-Encoding: chunked\r\n\r\nz", "7\r\nabcdefg\r\n0\r\n\r\n", "WARC\r\n1a\r\n/1.1", "y" * 300_000 + SEP,
]
COLUMNS = "page_id long, url string, html string, digest string, copy int"


def expected(rows):
    best = {}
    for page, url, html, *_ in rows:
        html = html or ""
        key = (-1 if page is None else page, url or "")
        best[html] = max(best.get(html, key), key)
    first, out = set(), []
    for page, url, html, *_ in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        own = (-1 if page is None else page, url or "")
        if best[html or ""] == own and (html or "") not in first:
            first.add(html or "")
            out.append((page, len(data), digest, "response", None))
        else:
            out.append((page, len(data), digest, "revisit", best[html or ""][0] if best[html or ""][0] >= 0 else None))
    return sorted(out, key=repr)


def read_back(frame):
    rows = frame.select("metadata.page_id", "response.payload_bytes", "response.payload_digest", "response.type", "metadata.refers_to").collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_round_trip(spark, tmp_path, compression):
    rows = [(k, f"https://a.b/{k}", html, "x", k) for k, html in enumerate(ODD)]
    rows += [(100, "u", "<p>é</p>", "", 0), (100, "u", "<p>é</p>", "", 0), (99, "u\r\nWARC-Type: x", "<p>é</p>", "", 0), (None, None, None, None, None), (None, "v", "only", "", 1), (55, "https://x/WARC/1.1", "w", "", 0)]
    frame = spark.createDataFrame(rows, COLUMNS).repartition(3)
    path = str(tmp_path / "a")
    warc.write_archives(frame, path, compression)
    records = warc.read_records(spark, path)
    assert records.groupBy("type").count().collect() and records.count() == 3 * len(rows)
    made = warc.captures(records)
    assert read_back(made) == expected(rows)
    sent = {bytes(r.response.payload) for r in made.collect() if r.response.type == "response"}
    assert sent == {(r[2] or "").encode() for r in rows}
    ids = {r.record_id: r.type for r in records.collect()}
    assert len(ids) == 3 * len(rows)
    assert all(ids[r.concurrent_to] in ("response", "revisit") for r in records.where("type in ('request', 'metadata')").collect())
    assert all(ids[r.refers_to_id] == "response" for r in records.where("type = 'revisit'").collect())


def test_separators_at_every_place_of_the_reader_s_buffer(spark, tmp_path):
    """Records of all lengths, so that buffer ends fall everywhere around a separator."""
    rows = [(k, "u", "\r\n" * (k % 7) + "p" * (k % 61) + "\r\n" * (k % 5), "", 0) for k in range(4000)]
    path = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame(rows, COLUMNS).repartition(2), path)
    assert warc.read_records(spark, path).count() == 12_000
    assert read_back(warc.captures(warc.read_records(spark, path))) == expected(rows)


def test_plain_records_have_the_standard_layout(spark, tmp_path):
    path = tmp_path / "a"
    warc.write_archives(spark.createDataFrame([(1, "https://a.b/c", "é", "", 0)], COLUMNS), str(path), "none")
    data = b"".join(p.read_bytes() for p in sorted(path.glob("part-*")))
    kinds = []
    while data:
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = dict(h.split(b": ", 1) for h in head.split(b"\r\n")[1:])
        size = int(headers[b"Content-Length"])
        assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
        kinds.append(headers[b"WARC-Type"])
        data = rest[size + 4 :]
    assert kinds == [b"request", b"response", b"metadata"]


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], COLUMNS)).count() == 0
