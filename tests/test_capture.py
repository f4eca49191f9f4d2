import random
import struct

import pytest

from windlass.sources import capture
from windlass.sources.capture import File


def _file(path, packets, order="<", nanos=False, link=1, tail=b""):
    """A capture of (seconds, fraction, wire length, body)."""
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    with open(path, "wb") as f:
        f.write(struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link))
        for s, part, wire, body in packets:
            f.write(struct.pack(order + "IIII", s, part, len(body), wire) + body)
        f.write(tail)
    return str(path)


def _body(rng, k):
    v4 = lambda head: head + bytes([0x45, *[0] * 11, 10, 0, 0, k % 200, 172, 17, 0, 2]) + rng.randbytes(rng.randrange(900))
    eth = rng.randbytes(12)
    return rng.choice([lambda: v4(eth + b"\x08\x00"), lambda: v4(eth + b"\x81\x00\x00\x05\x08\x00"), lambda: eth + b"\x86\xdd" + bytes([0x60, *[0] * 7, *[0] * 15, 1, *[0] * 15, 2]), lambda: eth + b"\x08\x06" + bytes(28), lambda: rng.randbytes(5)])()


@pytest.mark.parametrize(("order", "nanos"), [("<", False), (">", False), ("<", True)])
def test_splits_give_every_packet_once(spark, tmp_path, order, nanos):
    rng = random.Random(4)
    # bodies hold headers that look right, too
    bodies = [_body(rng, k) + (struct.pack(order + "IIII", 1_700_000_000, 5, 40, 60) * 2 if k % 9 == 0 else b"") for k in range(3000)]
    packets = [(1_700_000_000 + k, k * (1000 if nanos else 1), len(b) + k % 3, b) for k, b in enumerate(bodies)]
    path = _file(tmp_path / "a.pcap", packets, order, nanos)
    capture.register(spark)
    for split in (50_000, 333_333, 1 << 30):
        rows = spark.read.format("capture").option("split", split).load(path).orderBy("t").collect()
        assert [(r.t, r.bytes, r.captured) for r in rows] == [((1_700_000_000 + k) * 10**6 + k, w, len(b)) for k, (_, _, w, b) in enumerate(packets)]
    found = {(r.src, r.dst) for r in rows}
    assert (None, None) in found and ("::1", "::2") in found and ("10.0.0.7", "172.17.0.2") in found
    assert rows[0].file.endswith("a.pcap")


def test_folders_cut_files_and_other_files(spark, tmp_path):
    rng = random.Random(5)
    packets = [(1_700_000_000 + k, 0, 100, _body(rng, k)[:60]) for k in range(50)]
    (tmp_path / "d").mkdir()
    _file(tmp_path / "d" / "a.pcap", packets)
    _file(tmp_path / "d" / "b.pcap", packets, tail=struct.pack("<IIII", 1_700_000_099, 0, 60, 60) + b"x")
    _file(tmp_path / "d" / "empty.pcap", [])
    (tmp_path / "d" / "_SUCCESS").write_text("")
    capture.register(spark)
    for path in (f"{tmp_path}/d", f"file://{tmp_path}/d"):
        assert spark.read.format("capture").load(path).count() == 100
    (tmp_path / "x").write_bytes(b"no capture at all, but long enough for a header")
    with pytest.raises(ValueError, match="no classic capture"):
        File(str(tmp_path / "x"), 1)
