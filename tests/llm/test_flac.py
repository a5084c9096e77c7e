"""FLAC: round trips, damage, and hand-made frames of kinds the encoder does not write."""

import hashlib

import numpy as np
import pytest

from citeloom.llm import flac


class Writer:
    def __init__(self):
        self.bits = ""

    def put(self, value, n):
        self.bits += f"{value & (1 << n) - 1:0{n}b}" if n else ""

    def rice(self, value, k):
        u = value * 2 if value >= 0 else -2 * value - 1
        self.bits += "0" * (u >> k) + "1"
        self.put(u, k)

    def bytes(self):
        self.bits += "0" * (-len(self.bits) % 8)
        return bytes(int(self.bits[i : i + 8], 2) for i in range(0, len(self.bits), 8))


def slow_crc16(data):
    c = 0
    for b in data:
        c ^= b << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c >> 15 else c << 1) & 0xFFFF
    return c


def file(frames, n, channels, depth, samples):
    width = depth // 8
    flat = np.array(samples, np.int64).T.ravel()
    md5 = hashlib.md5(flat.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()).digest()
    info = (16).to_bytes(2, "big") * 2 + b"\0" * 6 + (44100 << 44 | (channels - 1) << 41 | (depth - 1) << 36 | n).to_bytes(8, "big") + md5
    return b"fLaC\x80\0\0\x22" + info + b"".join(frames)


def frame(number, n, mode, depth_code, body):
    head = b"\xff\xf8" + bytes([0x60, mode << 4 | depth_code << 1]) + flac.coded_number(number) + bytes([n - 1])
    data = head + bytes([flac.crc8(head)]) + body
    return data + slow_crc16(data).to_bytes(2, "big")


def test_mid_side_partitions_escape_wasted_and_lpc():
    rng = np.random.default_rng(1)
    left = (1000 * np.sin(np.arange(16) / 3)).astype(int)
    right = left + rng.integers(-9, 9, 16)
    mid, side = (left + right) >> 1, left - right
    w = Writer()
    w.put(0b00010100, 8)  # fixed, order 2, in four partitions, one of them escaped
    for v in mid[:2]:
        w.put(int(v), 16)
    w.put(0, 2)
    w.put(2, 4)
    residual = np.diff(mid, 2)
    for part in range(4):
        own = residual[max(0, part * 4 - 2) : part * 4 + 2]
        if part == 2:
            w.put(15, 4)
            w.put(12, 5)
            for v in own:
                w.put(int(v), 12)
        else:
            w.put(5, 4)
            for v in own:
                w.rice(int(v), 5)
    w.put(0b01000000, 8)  # linear, order 1; the side channel has 17 bits
    w.put(int(side[0]), 17)
    w.put(4, 4)
    w.put(2, 5)
    w.put(3, 5)
    w.put(1, 2)  # five-bit parameters
    w.put(0, 4)
    w.put(3, 5)
    for i in range(1, 16):
        w.rice(int(side[i] - (3 * side[i - 1] >> 2)), 3)
    first = frame(0, 16, 10, 4, w.bytes())
    w = Writer()
    w.put(0b00000011, 8)  # verbatim with two wasted bits
    w.put(1, 2)
    for v in left:
        w.put(int(v) >> 2, 14)
    w.put(0b00000000, 8)
    w.put(-7, 16)
    second = frame(1, 16, 1, 4, w.bytes())
    samples = [np.concatenate([left, left >> 2 << 2]), np.concatenate([right, np.full(16, -7)])]
    blob = file([first, second], 32, 2, 16, samples)
    (blocks, error), (_, bad) = flac.decode([blob, blob[:-5] + b"\x55" + blob[-4:]])
    assert error is None and bad == "frame checksum"
    assert [b[0] for b in blocks] == [0, 16]
    got = np.frombuffer(b"".join(b[1] for b in blocks), "<i2").reshape(-1, 2)
    assert (got.T == np.array(samples)).all()


CASES = [b"\0" * 64, b"a" * 64, bytes(range(256)) * 2, bytes(np.random.default_rng(0).integers(0, 256, 9000).astype(np.uint8)), b"hello world. " * 700, bytes((128 + 100 * np.sin(np.arange(12_288) / 20)).astype(np.uint8)), b"x"]


def encoded():
    return flac.encode(np.frombuffer(b"".join(CASES), np.uint8), np.array([len(c) for c in CASES]))


def test_round_trip_and_equal_bytes_give_equal_files():
    files = encoded()
    for case, own, (blocks, error) in zip(CASES, files, flac.decode(files), strict=True):
        assert error is None and b"".join(b[1] for b in blocks) == case
        assert [b[0] for b in blocks] == list(range(0, len(case), flac.BLOCK))
        assert flac.encode(np.frombuffer(case, np.uint8), np.array([len(case)])) == [own]
        s = flac.parse_stream(own)
        for sample, offset, n in s.seek:  # any block can be read alone
            head = flac.parse_header(flac.Bits(np.frombuffer(own, np.uint8)), s.begin + offset, 0, s, len(own))
            assert head.n == n and sample % flac.BLOCK == 0


@pytest.mark.parametrize("at", [0, 30, 200, -1])
def test_damage_is_found(at):
    files = encoded()
    hurt = bytearray(files[3])
    hurt[at] ^= 0x10
    results = flac.decode([files[0], bytes(hurt), files[4], b"", b"fLaC", files[3][:500]])
    assert [e is None for _, e in results] == [True, False, True, False, False, False]


def test_columns(spark):
    rows = [(1, None, "m"), (2, "", "m"), (3, "é" * 40, "m"), (None, "x" * 70_000, "m"), (3, "é" * 40, "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    media = flac.encode_payloads(df)
    out = flac.decode_blocks(media).collect()
    for (i, text, _), r in zip(rows, out, strict=True):
        raw = (text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.doc_id, r.n_bytes, r.error, b"".join(bytes(b.pcm) for b in r.blocks)) == (i, len(raw), None, payload)
    assert flac.decode_blocks(media.limit(0)).count() == 0
    assert flac.decode_blocks(spark.createDataFrame([(None,)], "media binary")).collect()[0].blocks is None


@pytest.mark.parametrize("n", [0, 0x7F, 0x80, 0x7FF, 0x800, 0xFFFF, 0x10000, 0x1FFFFF, 0x200000, 0x7FFFFFFF, 0xFFFFFFFFF])
def test_coded_numbers(n):
    data = flac.coded_number(n)
    ones = 8 - (data[0] ^ 0xFF).bit_length()
    value = data[0] & (0x7F >> ones)
    for b in data[1:]:
        value = value << 6 | b & 0x3F
    assert value == n and len(data) == max(1, ones) and (n >= 0x110000 or data == chr(n).encode("utf-8", "surrogatepass"))


def test_crc16_of_slices():
    raw = np.random.default_rng(2).integers(0, 256, 300).astype(np.uint8)
    start, size = np.array([0, 7, 100]), np.array([5, 90, 200])
    assert flac.crc16(raw, start, size).tolist() == [slow_crc16(raw[a : a + n].tobytes()) for a, n in zip(start, size, strict=True)]


def test_long_payloads_in_sections_are_the_same_files(monkeypatch):
    rng = np.random.default_rng(8)
    payload = np.concatenate([rng.integers(0, 256, 9_000), rng.integers(97, 123, 60_000), np.zeros(20_064, np.int64)]).astype(np.uint8)
    whole = flac.encode(payload, np.array([len(payload)]))[0]
    expected = flac.decode([whole])[0]
    monkeypatch.setattr(flac, "STEP_BYTES", 3 * flac.BLOCK)
    assert flac.encode_long(payload) == whole
    assert flac.decode_long(whole) == expected and b"".join(p for _, p in expected[0]) == payload.tobytes()
    broken = bytearray(whole)
    broken[-5_000] ^= 1
    assert flac.decode_long(bytes(broken))[1] and flac.decode_long(b"no")[1] and not flac.decode_long(bytes(broken))[0]


def test_columns_that_clash_and_blocks_put_together(spark):
    rows = [(1, None, "b", "e", "p"), (2, "x" * 5_000_000, "b", "e", "p"), (3, "ü" * 100, "b", "e", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, blocks string, error string, payload string")
    read = flac.decode_blocks(flac.encode_payloads(docs))
    got = {r.doc_id: r for r in flac.joined_blocks(read).collect()}
    assert all(r.error is None for r in got.values())
    for i, text, *_ in rows:
        raw = (text or "").encode()
        assert bytes(got[i].payload) == raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw)) and got[i].n_bytes == len(raw)
    assert flac.joined_blocks(read.filter("doc_id = 2")).first().blocks[-1].sample == 5_000_000 // flac.BLOCK * flac.BLOCK
