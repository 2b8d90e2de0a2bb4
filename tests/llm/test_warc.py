import gzip
import hashlib
from pathlib import Path

from tidebar.llm import warc

PAGE = "page_id long, url string, html string, digest string, length long, refers_to long"


def rows(spark, items):
    return spark.createDataFrame([(i, f"http://a/{i}\r\nX: y", h, "own", 7, -1) for i, h in items], PAGE)


def test_round_trip_and_revisits(spark, tmp_path, prose):
    big = "<p>" + "ä𝄞" * 300 + "</p>"
    items = [(5, big), (3, big), (9, big), (1, "short"), (2, "short"), (4, ""), (6, None), (7, prose(1, 40_000)), (8, "x\r\n\r\nWARC/1.1\r\n" * 20)]
    out = {r.page_id: r for r in warc.archive(rows(spark, items), str(tmp_path)).collect()}
    assert len(out) == len(items)
    for i, h in items:
        data = (h or "").encode()
        same = [j for j, g in items if (g or "") == (h or "")]
        first = len(data) < 100 or i == min(same)
        r = out[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", min(same)))
    # payloads come back whole, and any gzip reader opens the files
    files = sorted(tmp_path.glob("*.warc.gz"))
    manifest = spark.createDataFrame([(str(f),) for f in files], "path string")
    back = {r.page_id: r for r in warc.read_archives(manifest, str(tmp_path)).collect()}
    assert all(bytes(back[i].payload) == ((h or "").encode() if out[i].record_type == "response" else b"") for i, h in items)
    assert b"".join(gzip.decompress(Path(f).read_bytes()) for f in files).count(b"WARC-Type: revisit") == 2


def test_small_files_and_reads(spark, tmp_path, prose, monkeypatch):
    monkeypatch.setattr(warc, "_READ", 13)
    with open(tmp_path / "two.gz", "wb") as f:
        f.write(gzip.compress(b"one record") + gzip.compress(b"another"))
    with open(tmp_path / "two.gz", "rb") as f:
        assert list(warc._members(f)) == [b"one record", b"another"]


def test_edges(spark, tmp_path):
    assert warc.archive(rows(spark, []), str(tmp_path / "none")).collect() == []
    big = "y" * 200
    out = warc.archive(rows(spark, [(None, big), (None, big), (2, big), (2, big)]), str(tmp_path / "nulls")).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in out) == [("2", "response", None)] * 2 + [("None", "revisit", 2)] * 2
    out = warc.archive(rows(spark, [(None, big), (None, big)]), str(tmp_path / "only")).collect()
    assert [r.record_type for r in out] == ["response"] * 2
