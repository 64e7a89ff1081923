"""Archives written and read back, against digests of the payloads themselves and a plain reader of the format."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os

import pytest

from runlens.llm import warc

SHAPE = "page_id long, url string, html string"


def expected(rows, least=0):
    from collections import defaultdict

    groups, out = defaultdict(list), []
    for k, (i, _, html) in enumerate(rows):
        groups[(html or "").encode()].append((-1 if i is None else i, i))
    for raw, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        ids.sort(key=lambda x: x[0])
        top = ids[-1][1]
        for n, (_, i) in enumerate(ids):
            first = n == len(ids) - 1 or len(raw) < least
            out.append((i, len(raw), digest, "response" if first else "revisit", None if first else top, True))
    return sorted(out, key=repr)


def back(spark, path):
    got = warc.records(warc.read(spark, path)).select("row", "payload_bytes", "payload_digest", "kind", "refers_to", "intact")
    return sorted((tuple(r) for r in got.collect()), key=repr)


MARK = "\r\n\r\nWARC/1.1\r\n"
ROWS = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (4, "", ""), (5, "http://ä ö\r\nX: y", "é漢字" * 999),
        (6, "u", MARK), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + MARK * 3 + "x"), (8, "u", "\r\n" * 700), (9, "u", "z" * 5000),
        (9, "u", "z" * 5000), (9, "v", "other"), (None, None, None), (None, "w", "no id"), (12, "u", "end\r\n\r\n"), (13, "u", "\r\n\r\nstart"),
        (14, "u", "a" + MARK[:-1]), (15, "u", MARK[1:] + MARK), (16, "u", "b" + MARK[:-2]), (17, "u", "WARC/1.1\r\nWARC/1.1")]


@pytest.mark.parametrize("size,compression,least", [(1 << 20, "gzip", 0), (64, "none", 0), (7, "none", 0), (1000, "gzip", 100)])
def test_round_trip(spark, tmp_path, size, compression, least):
    extra = spark.createDataFrame([(*r, 1, "x", b"y") for r in ROWS], SHAPE + ", record long, chunk string, data binary").repartition(3)
    path = str(tmp_path / "out")
    warc.write(extra, path, size=size, compression=compression, least=least)
    assert back(spark, path) == expected(ROWS, least)


def test_file_splits_change_nothing(spark, tmp_path):
    rows = [(i, "u", f"<p>{i}</p>" * (i % 50) + MARK * (i % 3)) for i in range(90)]
    path = str(tmp_path / "out")
    warc.write(spark.createDataFrame(rows, SHAPE).coalesce(1), path, size=50, compression="none")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1009")
        assert back(spark, path) == expected(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_archives_read_by_the_format(spark, tmp_path):
    """A reader that follows only Content-Length finds each payload again."""
    path = str(tmp_path / "out")
    warc.write(spark.createDataFrame(ROWS, SHAPE), path, size=64)
    kinds, bodies, origin = [], {}, {}
    for name in sorted(os.listdir(path)):
        if not name.startswith("part-"):
            continue
        raw = gzip.open(os.path.join(path, name)).read()
        at = 0
        while at < len(raw):
            end = raw.index(b"\r\n\r\n", at)
            lines = raw[at:end].decode("ascii").split("\r\n")
            assert lines[0] == "WARC/1.1"
            head = dict(x.split(": ", 1) for x in lines[1:])
            n = int(head["Content-Length"])
            block = raw[end + 4:end + 4 + n]
            assert raw[end + 4 + n:end + 8 + n] == b"\r\n\r\n"
            at = end + 8 + n
            kinds.append(head["WARC-Type"])
            if head["WARC-Type"] == "revisit":
                continue
            who, segment = head.get("WARC-Segment-Origin-ID", head["WARC-Record-ID"]), int(head.get("WARC-Segment-Number", 1))
            bodies.setdefault(who, {})[segment] = block.split(b"\r\n\r\n", 1)[1] if segment == 1 else block
    want = {(html or "").encode() for _, _, html in ROWS}
    assert sorted(b"".join(v for _, v in sorted(x.items())) for x in bodies.values()) == sorted(want)
    assert kinds.count("revisit") == len(ROWS) - len(want)


def test_damage_is_seen(spark, tmp_path):
    path, hurt = str(tmp_path / "out"), str(tmp_path / "hurt")
    warc.write(spark.createDataFrame([(1, "u", "a" * 300), (2, "u", "b" * 300)], SHAPE).coalesce(1), path, size=100, compression="none")
    os.makedirs(hurt)
    raw = b"".join(open(os.path.join(path, n), "rb").read() for n in os.listdir(path) if n.startswith("part-"))
    open(os.path.join(hurt, "part-0.txt"), "wb").write(raw.replace(b"a" * 100, b"a" * 99 + b"c", 1))
    assert [(r[0], r[5]) for r in back(spark, hurt)] == [(1, False), (2, True)]


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    warc.write(spark.createDataFrame([], SHAPE), path)
    assert back(spark, path) == []
