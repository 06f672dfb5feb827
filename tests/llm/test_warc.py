import base64
import gzip
import hashlib
import io
import random

import pytest

from valograph.llm.warc import MAGIC, members, parsed, read_warc, record, write_warc

SCHEMA = "page_id bigint, url string, html string"


def expected(rows):
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    out = []
    for i, _, h in rows:
        payload = (h or "").encode()
        first = least.get(h or "")
        revisit = first is not None and i != first
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None, b"" if revisit else payload))
    return sorted(out, key=str)


@pytest.mark.parametrize("split", [1, 97, 4_000_000])
def test_round_trip_at_any_split(spark, split):
    r = random.Random(1)
    rows = [(i, f"http://x/{i}", "".join(r.choice("<p>é日 a\x1f\x8b\x08") for _ in range(r.randrange(300)))) for i in range(40)]
    rows += [(100 - i, None, rows[3][2]) for i in range(5)] + [(200, "u\r\nX-Page-Id: 9", None), (150, "u", ""), (None, "u", "alone"), (None, "u", ""), (7, "again", rows[7][2])]
    if split > 1:
        rows.append((300, "long", "word " * 200_000))
    got = read_warc(write_warc(spark.createDataFrame(rows, SCHEMA).repartition(3)), split).collect()
    found = [(x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to, bytes(x.payload)) for x in got]
    assert sorted(found, key=str) == expected(rows)


def test_every_byte_range_owns_its_records():
    payloads = [bytes([k]) * 50 + MAGIC + b"junk" for k in range(5)]
    parts = [record("response", "u", k, None, "D", p) for k, p in enumerate(payloads)]
    data = b"noise" + MAGIC + b"\0\0\0" + gzip.compress(b"not a record") + b"".join(parts)
    for step in (1, 3, 50, 10**6):
        got = [parsed(c)[1] for low in range(0, len(data), step) for c in members(_file(data), low, min(low + step, len(data)))]
        assert got == payloads
    assert gzip.decompress(parts[0]).startswith(b"WARC/1.1\r\n")


def _file(data):
    import pyarrow as pa

    return pa.BufferReader(data)


def test_empty_table(spark):
    assert read_warc(write_warc(spark.createDataFrame([], SCHEMA))).count() == 0
