import base64
import hashlib
import random

import pytest

from drivetrove.llm import warc

PAGES = "page_id long, url string, html string, block string, start int"
BITS = ["\nWARC/1.1\r\n", "\r\n", "\n", "WARC/1.", "\nWARC", "\nWARC/1.0\r\nContent-Length: 5\r\n\r\n", "\r\n\r\n", "é", "Content-Length: 9\r\n", "<p>a</p>",
        "\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n", "\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\n"]


def brute(rows, least=0):
    key = [(p is not None, p or 0, u is not None, u or "") for p, u, _ in rows]
    top = {}
    for k, (_, _, h) in zip(key, rows):
        top[h or ""] = max(top.get(h or "", k), k)
    out, seen = [], set()
    for k, (p, _, h) in zip(key, rows):
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        whole = len(raw) < least or (k == top[h or ""] and raw not in seen)
        if k == top[h or ""]:
            seen.add(raw)
        out.append((p, len(raw), digest, "response" if whole else "revisit", None if whole or not top[h or ""][0] else top[h or ""][1]))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


@pytest.fixture
def ranges(spark):
    """Byte ranges of the given size for the readers."""
    def set_(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield set_
    for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(key)


@pytest.mark.parametrize("size", ["900", "128m"])
def test_magic_in_payloads(spark, ranges, size):
    rng = random.Random(5)
    rows = [(i, f"http://x/{i}", "".join(rng.choices(BITS, k=rng.randint(0, 20)))) for i in range(40)]
    rows += [(1000, None, None), (1001, "u\r\nv w", ""), (None, "a b", "dup"), (1002, "c", "dup"), (1002, "c", "dup"), (1003, "l", "word " * 3000), (7, "z", rows[3][2])]
    ranges(size)
    assert sorted(map(tuple, warc.archived(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_least_bytes(spark):
    rows = [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough"), (5, None, "")]
    assert sorted(map(tuple, warc.archived(frame(spark, rows), least=5).collect()), key=str) == brute(rows, 5)


def test_only_equal_copies(spark):
    rows = [(1, "a", "copy")] * 30 + [(None, None, None)] * 3
    assert sorted(map(tuple, warc.archived(frame(spark, rows)).collect()), key=str) == brute(rows)
    assert warc.archived(frame(spark, rows).limit(0)).count() == 0


def record(body, extra=b""):
    return b"WARC/1.0\r\nWARC-Type: resource\r\ncontent-length: %d\r\n%s\r\n" % (len(body), extra) + body + b"\r\n\r\n"


def chain(raw):
    """What a reader of the whole file meets: (start, block, complete)."""
    at, out = 0, []
    while raw[at:at + 8] in (b"WARC/1.0", b"WARC/1.1") and b"\r\n\r\n" in raw[at:]:
        head, _, _ = raw[at:].partition(b"\r\n\r\n")
        size = [int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        if not size:
            break
        begin = at + len(head) + 4
        out.append((at, raw[begin:begin + size[0]], begin + size[0] + 4))
        at = out[-1][2]
    starts = {s for s, _, _ in out}
    return [(s, b, e in starts or e == len(raw)) for s, b, e in out]


@pytest.mark.parametrize("size", ["64", "1m"])
def test_any_bytes(spark, ranges, tmp_path, size):
    inner = record(b"inside") + record(b"\xff\x00\n")
    files = {
        "whole": record(b"a\xff\xfe\nWARC/1.1\r\n") + record(inner, b"X: y\r\n") + record(b"") + record(b"b" * 300) + record(b"\r\n" * 5 + b"\n" + inner * 3),
        "cut": record(b"one") + record(b"two" * 50)[:-60],
        "wrong": record(b"one") + record(b"two").replace(b"length: 3", b"length: 2") + record(b"lost"),
        "none": b"no record here\n" + record(b"x"),
        "empty": b"",
        "end": record(b"x") + b"\nWARC/1.",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(raw)
    ranges(size)
    got = {}
    for r in warc.read_warc(spark, str(tmp_path)).collect():
        got.setdefault(r["file"].rsplit("/", 1)[1], []).append((r["start"], bytes(r["content"]), r["complete"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: c for k, raw in files.items() if (c := chain(raw))}


def test_headers(spark, tmp_path):
    warc.write_warc(frame(spark, [(4, "http://h/a b", "<p>é</p>")]), str(tmp_path / "w"))
    r = warc.read_warc(spark, str(tmp_path / "w")).first()
    assert (r["type"], r["target_uri"], r["page_id"], r["date"], r["refers_to"], r["complete"]) == ("response", "http://h/a%20b", "4", "1970-01-01T00:00:00Z", None, True)
    assert bytes(r["payload"]) == "<p>é</p>".encode() and bytes(r["content"]).startswith(b"HTTP/1.1 200 OK\r\n") and r["start"] == 0
    raw = b"".join(f.read_bytes() for f in (tmp_path / "w").glob("part-*"))
    assert raw == r["header"].encode() + bytes(r["content"]) + b"\r\n\r\n"
