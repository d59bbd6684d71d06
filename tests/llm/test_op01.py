import base64
import hashlib

import zstandard

from quillspark.llm import op01_warc as W
from quillspark.llm.files import Reader


def brute(rows, least):
    first = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if p is not None and len(b) >= least:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        again = p is not None and f is not None and p != f
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    return out


def test_round_trip(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7} é</p>\r\n\r\nWARC/1.1" * (i % 5)) for i in range(200)] + [(500, "u: v\nw", None), (501, None, ""), (3, "http://x/3", "twice"), (3, "http://x/3", "twice"), (None, "n", "<p>1 é</p>"), (600, "long", "x" * 900_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as payload", "1 as key").repartition(6)
    for least in (0, 8):
        index = W.write(pages, least, frame_bytes=2000, bundle_bytes=5000)
        got = [tuple(r)[:5] for r in W.read_back(index).collect()]
        assert sorted(got, key=str) == sorted(brute(rows, least), key=str)
    one = W.fetch(index, [4, 600])
    assert one[600]["payload"] == b"x" * 900_000 and one[4]["WARC-Type"] in ("response", "revisit")
    uri = index.first().uri
    whole = Reader(uri)
    data = zstandard.ZstdDecompressor().stream_reader(whole.read(0, whole.size), read_across_frames=True).read()
    assert data.startswith(b"WARC/1.1\r\n")


def test_empty(spark):
    assert W.read_back(W.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
