"""Zip archives as rows: whole, damaged, too large, nested."""

import hashlib
import io
import zipfile

from lexaria.sources import archives


def made(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, content in members:
            z.writestr(name, content)
    return out.getvalue()


def test_members(spark, tmp_path):
    texts = {f"d/{i}.txt": f"line {i}\nsecond é\n" * (i + 1) for i in range(30)}
    good = made([("d/", ""), *texts.items(), ("empty.txt", "")])
    stored = made([("s.txt", "as it is\r\nlast")], zipfile.ZIP_STORED)
    inner = made([("in.txt", "inside")])
    (tmp_path / "a.zip").write_bytes(good)
    (tmp_path / "b.zip").write_bytes(stored)
    (tmp_path / "c.zip").write_bytes(made([("x.ZIP", inner), ("y.zip", "no archive"), ("t.txt", "t")]))
    (tmp_path / "d.zip").write_bytes(b"not a zip file")
    (tmp_path / "e.zip").write_bytes(made([("big.txt", "z" * 200_000)]))
    (tmp_path / "f.zip").write_bytes(b"\0" * 500_000)
    (tmp_path / "g.zip").write_bytes(b"")
    got = {(r.archive.rsplit("/", 1)[1], r.member): r for r in archives.read_members(spark, str(tmp_path), 400_000, 100_000, tasks=3).collect()}
    for name, text in texts.items():
        r = got["a.zip", name]
        assert (bytes(r.content), r.size, r.error, r.sha256) == (text.encode(), len(text.encode()), None, hashlib.sha256(good).hexdigest())
    assert bytes(got["a.zip", "empty.txt"].content) == b"" and ("a.zip", "d/") not in got
    assert bytes(got["b.zip", "s.txt"].content) == b"as it is\r\nlast" and bytes(got["c.zip", "x.ZIP"].content) == inner
    assert got["d.zip", None].error.startswith("no archive") and not any(a == "g.zip" for a, _ in got)
    assert (got["e.zip", "big.txt"].error, got["f.zip", None].error, got["f.zip", None].sha256) == ("too large", "too large", None)
    deep = {(r.archive.rsplit("/", 1)[1], r.member): r for r in archives.read_members(spark, str(tmp_path / "c.zip"), depth=2).collect()}
    assert bytes(deep["c.zip!x.ZIP", "in.txt"].content) == b"inside" and deep["c.zip!y.zip", None].error.startswith("no archive") and ("c.zip", "t.txt") in deep
    lines = archives.member_lines(archives.read_members(spark, str(tmp_path / "b.zip")))
    assert [(r.line, r.value) for r in lines.orderBy("line").collect()] == [(0, "as it is"), (1, "last")]


def test_damage():
    """Any single byte that is lost or changed gives an error or the same member, and never another one."""
    whole = made([("a.txt", "some words, some words again and again " * 5), ("b.txt", "other")])
    want = {"a.txt": b"some words, some words again and again " * 5, "b.txt": b"other"}
    for at in range(len(whole)):
        for data in (whole[:at] + bytes([whole[at] ^ 0x55]) + whole[at + 1 :], whole[:at]):
            for name, method, crc, size, packed, error in archives.cut_members(data):
                if error is None:
                    content, why = archives.inflate(packed, method, crc, size, 1 << 20)
                    assert why is not None or content in want.values() or (name not in want)
                    assert why is None or content is None


def test_a_bomb_is_not_inflated():
    packed = made([("z", b"\0" * 5_000_000)])
    ((_, method, crc, size, data, _),) = archives.cut_members(packed)
    assert archives.inflate(data, method, crc, size, 1000) == (None, "too large")
    assert archives.inflate(data, method, crc, 10, 1000) == (None, "too large")  # a directory that lies
    assert archives.inflate(b"x", 99, 0, 1, 10) == (None, "method 99")
