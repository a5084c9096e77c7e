"""FLAC columns: lossless encoding of 8-bit samples, and decoding to seekable PCM blocks.

The decoder reads any number of files at once: headers one by one, then the
Rice codes of all frames in step (one numpy call per code position for all
frames), then the predictors. Frames are found through the seek table if it
lists them all, else each one where the last ended. Header (CRC-8) and frame
(CRC-16) checksums and the stream's MD5 are verified; a file that fails any
has its reason in `error` and no blocks.

PCM is little-endian; up to 8 bits a sample it is unsigned, as in WAV files.

Defined results: a null file gives a null error-free row without blocks; an
empty or foreign file has an error; repeated rows are decoded alike; extra
columns pass through.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.arrow import binary_array, blob, pieces, tidy, utf8_bytes, with_columns

BLOCK, RATE, LPC_ORDER, PRECISION = 4096, 8000, 4, 10
#: Bytes of files that a task decodes in step; longer payloads and files are worked on in sections.
STEP_BYTES = 2 << 20


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = []
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c >> (bits - 1) & 1 else c << 1) & (1 << bits) - 1
        out.append(c)
    return np.array(out, np.uint32)


CRC8, CRC16 = _crc_table(0x07, 8).tolist(), _crc_table(0x8005, 16)


class _Far:
    """What a byte at each distance from the end adds to a CRC-16 (which is linear)."""

    table = CRC16[None, :].astype(np.uint16)

    @classmethod
    def upto(cls, n: int) -> np.ndarray:
        while len(cls.table) < n:
            last = cls.table[-1].astype(np.uint32)
            rows = [last]
            for _ in range(len(cls.table)):
                last = (last << 8 & 0xFFFF) ^ CRC16[last >> 8]
                rows.append(last)
            cls.table = np.concatenate([cls.table, np.array(rows[1:], np.uint16)])
        return cls.table


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = CRC8[c ^ b]
    return c


def crc16(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many slices of raw."""
    if not len(size):
        return np.zeros(0, np.uint16)
    end = np.cumsum(size)
    within = np.arange(int(end[-1])) - np.repeat(end - size, size)
    far = np.repeat(size, size) - 1 - within
    parts = _Far.upto(int(size.max())).ravel()[far * 256 + raw[np.repeat(start, size) + within]]
    return np.bitwise_xor.reduceat(parts, end - size)


def coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 of frame headers."""
    if n < 0x80:
        return bytes([n])
    size = max(2, -(-(n.bit_length() - 1) // 5))
    lead = 0xFF00 >> size & 0xFF
    return bytes([lead | n >> 6 * (size - 1), *(0x80 | n >> 6 * i & 0x3F for i in range(size - 2, -1, -1))])


# ---------------------------------------------------------------- encoding


def _linear(x: np.ndarray, t: np.ndarray, starts: np.ndarray, size: np.ndarray):
    """Quantised predictors of all frames and their residuals.

    Sums are whole numbers, so equal frames get equal predictors wherever they lie.
    """
    lags = [np.add.reduceat(x * x, starts)]
    for lag in range(1, LPC_ORDER + 1):
        product = np.zeros_like(x)
        np.multiply(x[lag:], x[:-lag], out=product[lag:])
        product[t < lag] = 0
        lags.append(np.add.reduceat(product, starts))
    r = np.array(lags).T + 1e-9
    a, error = np.zeros((len(r), LPC_ORDER)), r[:, 0] * 1.0000001 + 1e-6
    for i in range(LPC_ORDER):  # Levinson and Durbin, all frames at once
        k = r[:, i + 1].copy()
        for j in range(i):
            k -= a[:, j] * r[:, i - j]
        k /= error
        prior = a[:, :i].copy()
        a[:, i] = k
        a[:, :i] = prior - k[:, None] * prior[:, ::-1]
        error = np.maximum(error * (1 - k * k), 1e-6)
    top = np.maximum(np.abs(a).max(axis=1), 1e-9)
    shift = np.clip(PRECISION - 1 - np.frexp(top)[1], 0, 15).astype(np.int32)
    bound = (1 << (PRECISION - 1)) - 1
    q = np.clip(np.rint(a * (1 << shift)[:, None]), -bound, bound).astype(np.int32)
    guess = np.zeros_like(x)
    for j in range(LPC_ORDER):
        guess[j + 1 :] += np.repeat(q[:, j], size)[j + 1 :] * x[: len(x) - j - 1]
    guess >>= np.repeat(shift, size)
    return q, shift, x - guess


#: Means of folded residuals at which the next Rice parameter costs less.
MEANS = np.array([2.0**k * 1.4427 for k in range(14)])


def _frames(payload: np.ndarray, sizes: np.ndarray, begun: int = 0) -> tuple[list[bytes], np.ndarray]:
    """Frames of all runs of bytes, one after another, and how many each run has; begun: frames before them in their file."""
    x = payload.astype(np.int32) - 128
    count = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), count)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = (np.cumsum(sizes) - sizes)[owner] + number * BLOCK
    size = np.minimum(BLOCK, sizes[owner] - number * BLOCK)
    t = np.arange(len(x), dtype=np.int32) - np.repeat(first, size).astype(np.int32)
    # Residuals of each predictor; the first `order` samples go in as they are.
    orders, folded, residual = [0, 1, 2, LPC_ORDER], [], x
    q, shift, linear = _linear(x, t, first, size)
    costs, params = [], []
    for order in orders:
        residual = linear if order == LPC_ORDER else np.diff(residual, prepend=np.int32(0)) if order else x
        u = residual << 1 ^ residual >> 31  # 0, -1, 1, -2 to 0, 1, 2, 3
        folded.append(u)
        n = np.maximum(size - order, 1)
        total = np.add.reduceat(np.where(t >= order, u, 0) if order else u, first).astype(np.int64)
        k = np.searchsorted(MEANS, total / n).astype(np.int64)
        params.append(k)
        bits = n * (1 + k) + np.maximum(total - (n * ((1 << k) - 1) >> 1), 0) // (1 << k)
        costs.append(np.where(size > order, bits + 10 + order * 8 + (order == LPC_ORDER) * (9 + LPC_ORDER * PRECISION), 1 << 40))
    low, high = np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
    costs += [8 * size, np.where(low == high, 8, 1 << 41)]  # verbatim, constant
    choice = np.argmin(np.array(costs), axis=0)
    order = np.array([*orders, BLOCK, BLOCK])[choice]
    k = np.choose(np.minimum(choice, 3), params)
    heads, prefix = [], []
    for i, (kind, n, num, at) in enumerate(zip(choice.tolist(), size.tolist(), number.tolist(), first.tolist(), strict=True)):
        code = b"\xff\xf8" + bytes([0xC0 if n == BLOCK else 0x70, 0x02]) + coded_number(begun + num) + (b"" if n == BLOCK else (n - 1).to_bytes(2, "big"))
        heads.append(code + bytes([crc8(code)]))
        if kind == 5:
            prefix.append(f"00000000{int(low[i]) & 255:08b}")
        elif kind == 4:
            prefix.append("00000010")
        else:
            warm = "".join(f"{v & 255:08b}" for v in x[at : at + orders[kind]].tolist())
            rice = f"000000{int(k[i]):04b}"
            if kind == 3:
                warm += f"{PRECISION - 1:04b}{int(shift[i]):05b}" + "".join(f"{v & (1 << PRECISION) - 1:0{PRECISION}b}" for v in q[i].tolist())
                prefix.append(f"0{32 + LPC_ORDER - 1:06b}0{warm}{rice}")
            else:
                prefix.append(f"0{8 + kind:06b}0{warm}{rice}")
    lead = np.fromiter(map(len, prefix), np.int64, len(prefix))
    # Codes, a kind and parameter at a time: sample numbers, values and code lengths.
    coded, bits = [], np.zeros(len(x), np.int32)
    keys = np.where(choice <= 3, choice * 16 + k, np.where(choice == 4, 64, 65))
    per_sample = np.repeat(keys.astype(np.int8), size)
    for key in np.unique(keys[keys < 64]).tolist():
        kind, param = divmod(key, 16)
        own = np.flatnonzero((per_sample == key) & (t >= orders[kind]) if orders[kind] else per_sample == key)
        u = folded[kind][own]
        bits[own] = (u >> param) + (1 + param)
        coded.append((param, own, u))
    own_raw = np.flatnonzero(per_sample == 64)
    bits[own_raw] = 8
    ends = np.cumsum(bits, dtype=np.int64)
    body = lead + np.add.reduceat(bits, first)
    padded = -(-body // 8) * 8
    begin = np.cumsum(padded) - padded
    stream = np.zeros(int(padded.sum()), np.uint8)
    lead_at = np.repeat(begin - (np.cumsum(lead) - lead), lead) + np.arange(int(lead.sum()))
    stream[lead_at] = np.frombuffer("".join(prefix).encode(), np.uint8) - 48
    ends += np.repeat(begin + lead - (ends[first] - bits[first]), size)
    for param, own, u in coded:
        at = ends[own] - 1
        stream[at - param] = 1
        for b in range(param):
            stream[at - b] = u >> b & 1
    at = ends[own_raw] - 1
    for b in range(8):
        stream[at - b] = x[own_raw] >> b & 1
    packed = np.packbits(stream)
    frames = []
    for head, a, b in zip(heads, (begin // 8).tolist(), ((begin + padded) // 8).tolist(), strict=True):
        frames.append(head + packed[a:b].tobytes())
    lengths = np.fromiter(map(len, frames), np.int64, len(frames))
    crc = crc16(np.frombuffer(b"".join(frames), np.uint8), np.cumsum(lengths) - lengths, lengths)
    return [f + int(c).to_bytes(2, "big") for f, c in zip(frames, crc, strict=True)], count


def _file(frames: list[bytes], n: int, md5: bytes) -> bytes:
    """Metadata (with a seek point for each frame) and frames of n samples."""
    lengths = list(map(len, frames))
    block = max(16, min(BLOCK, n)) if len(frames) == 1 else BLOCK
    info = block.to_bytes(2, "big") * 2 + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | n).to_bytes(8, "big") + md5
    seek, offset = [], 0
    for j, length in enumerate(lengths):
        seek.append((j * BLOCK).to_bytes(8, "big") + offset.to_bytes(8, "big") + min(BLOCK, n - j * BLOCK).to_bytes(2, "big"))
        offset += length
    table = b"".join(seek)
    return b"".join([b"fLaC\x00", len(info).to_bytes(3, "big"), info, b"\x83", len(table).to_bytes(3, "big"), table, *frames])


def encode(payload: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A FLAC file (mono, 8 bits) for each run of bytes; sizes are 1 or more."""
    frames, count = _frames(payload, sizes)
    out, i, signed, at = [], 0, (payload ^ np.uint8(128)).tobytes(), 0
    for n, c in zip(sizes.tolist(), count.tolist(), strict=True):
        out.append(_file(frames[i : i + c], n, hashlib.md5(signed[at : at + n]).digest()))
        i, at = i + c, at + n
    return out


def encode_long(payload: np.ndarray) -> bytes:
    """The same file for one long run, made section by section."""
    frames, digest, step = [], hashlib.md5(), STEP_BYTES // BLOCK * BLOCK
    for at in range(0, len(payload), step):
        part = payload[at : at + step]
        frames += _frames(part, np.array([len(part)]), len(frames))[0]
        digest.update((part ^ np.uint8(128)).tobytes())
    return _file(frames, len(payload), digest.digest())


# ---------------------------------------------------------------- decoding


class FlacError(ValueError):
    """A file that is no FLAC stream or is damaged."""


@dataclass
class Stream:
    channels: int
    depth: int
    samples: int
    block: int
    md5: bytes
    begin: int
    seek: list[tuple[int, int, int]] = field(default_factory=list)


def parse_stream(file: bytes) -> Stream:
    """The metadata of a file."""
    if file[:4] != b"fLaC":
        raise FlacError("no FLAC marker")
    at, last, found, seek = 4, False, None, []
    while not last:
        if at + 4 > len(file):
            raise FlacError("metadata ends early")
        last, kind, n = bool(file[at] >> 7), file[at] & 127, int.from_bytes(file[at + 1 : at + 4], "big")
        data = file[at + 4 : at + 4 + n]
        if kind == 0 and n >= 34:
            packed = int.from_bytes(data[10:18], "big")
            found = Stream((packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, int.from_bytes(data[2:4], "big"), data[18:34], 0)
        elif kind == 3:
            points = [(int.from_bytes(data[i : i + 8], "big"), int.from_bytes(data[i + 8 : i + 16], "big"), int.from_bytes(data[i + 16 : i + 18], "big")) for i in range(0, n - 17, 18)]
            seek = [p for p in points if p[0] != 2**64 - 1]
        at += 4 + n
    if found is None:
        raise FlacError("no stream information")
    found.begin, found.seek = at, seek
    return found


@dataclass
class Frame:
    """A frame under way: bit position and what each channel has so far."""

    file: int
    start: int
    at: int
    n: int
    mode: int
    depth: int
    channels: int
    out: list[np.ndarray] = field(default_factory=list)


class Bits:
    """All bytes of a batch of files, with what reading in step needs."""

    def __init__(self, raw: np.ndarray):
        self.raw = np.concatenate([raw, np.zeros(8, np.uint8)])
        wide = self.raw.astype(np.int64)
        self.words = wide[:-4] << 32 | wide[1:-3] << 24 | wide[2:-2] << 16 | wide[3:-1] << 8 | wide[4:]  # 40 bits from each byte on
        ones = np.unpackbits(self.raw)
        where = np.full(len(ones), len(ones), np.int32)
        found = np.flatnonzero(ones).astype(np.int32)
        where[found] = found
        self.next_one = np.minimum.accumulate(where[::-1])[::-1].copy()
        self.limit = 8 * len(raw)

    def read(self, at: int, n: int) -> int:
        value = int.from_bytes(self.raw[at >> 3 : (at + n + 7 >> 3)].tobytes(), "big")
        return value >> (-(at + n) % 8) & (1 << n) - 1

    def signed(self, at: int, n: int) -> int:
        value = self.read(at, n)
        return value - (1 << n) if n and value >> (n - 1) else value


def parse_header(bits: Bits, at: int, file: int, s: Stream, end: int) -> Frame:
    """The header of the frame at byte `at`."""
    raw = bits.raw
    if at + 6 > end or raw[at] != 0xFF or raw[at + 1] & 0xFE != 0xF8:
        raise FlacError("no frame where one should be")
    size_code, rate_code, mode, depth_code = int(raw[at + 2]) >> 4, int(raw[at + 2]) & 15, int(raw[at + 3]) >> 4, int(raw[at + 3]) >> 1 & 7
    p, lead = at + 4, int(raw[at + 4])
    while lead & 0x80 and lead & 0x40:
        p += 1
        lead = lead << 1 & 0xFF
    p += 1
    if size_code == 0 or mode > 10 or depth_code == 3:
        raise FlacError("reserved frame header")
    if size_code in (6, 7):
        width = size_code - 5
        n = int.from_bytes(raw[p : p + width].tobytes(), "big") + 1
        p += width
    else:
        n = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if p >= end or crc8(raw[at:p].tobytes()) != int(raw[p]):
        raise FlacError("frame header checksum")
    depth = {0: s.depth, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth_code]
    return Frame(file, at, 8 * (p + 1), n, mode, depth, mode + 1 if mode < 8 else 2)


def _rice_in_step(bits: Bits, at: np.ndarray, n: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n[i] Rice codes with parameter k[i] from bit at[i] on, all lanes in step: residuals (time x lanes) and ends."""
    order = np.argsort(-n, kind="stable")
    at, n, k = at[order].copy(), n[order], k[order]
    most = int(n[0]) if len(n) else 0
    out = np.zeros((most, len(n)), np.int64 if k.max(initial=0) > 20 else np.int32)
    active = np.searchsorted(-n, -np.arange(most), side="left").tolist() if most else []
    take, mask, a = 40 - k, (1 << k) - 1, len(n) + 1
    for row, now in zip(out, active, strict=True):
        if now != a:
            a = now
            p, ka, takes, masks = at[:a], k[:a], take[:a], mask[:a]
        one = bits.next_one.take(p, mode="clip").astype(np.int64)
        after = one + 1
        low = bits.words.take(after >> 3, mode="clip")
        low >>= takes - (after & 7)
        low &= masks
        one -= p
        one <<= ka
        one |= low
        row[:a] = one
        np.add(after, ka, out=p)
    out = (out >> 1) ^ -(out & 1)
    back = np.empty(len(n), np.int64)
    back[order] = np.arange(len(n))
    return out[:, back], at[back]


def _subframes(bits: Bits, frames: list[Frame], channel: int) -> None:
    """Decode one channel of all frames."""
    todo = []
    for f in frames:
        head = bits.read(f.at, 8)
        kind, f.at = head >> 1 & 63, f.at + 8
        depth = f.depth + ((f.mode == 8 and channel == 1) or (f.mode == 9 and channel == 0) or (f.mode == 10 and channel == 1))
        wasted = 0
        if head & 1:
            wasted = int(bits.next_one[f.at]) - f.at + 1
            f.at += wasted
            depth -= wasted
        if head >> 7 or (kind > 1 and kind < 8) or (12 < kind < 32):
            raise FlacError("reserved subframe")
        if kind == 0:
            f.out.append(np.full(f.n, bits.signed(f.at, depth) << wasted, np.int64))
            f.at += depth
        elif kind == 1:
            ends = f.at + depth * np.arange(f.n)
            values = np.array([bits.signed(e, depth) for e in ends.tolist()], np.int64) if depth > 8 or f.at & 7 else bits.raw[f.at >> 3 : (f.at >> 3) + f.n].view(np.int8).astype(np.int64) if depth == 8 else np.array([bits.signed(e, depth) for e in ends.tolist()], np.int64)
            f.out.append(values << wasted)
            f.at += depth * f.n
        else:
            order = kind - 8 if kind < 32 else kind - 31
            if order > f.n:
                raise FlacError("predictor longer than its frame")
            warm = [bits.signed(f.at + i * depth, depth) for i in range(order)]
            f.at += order * depth
            coefs, shift = None, 0
            if kind >= 32:
                precision, shift = bits.read(f.at, 4) + 1, bits.signed(f.at + 4, 5)
                if shift < 0:
                    raise FlacError("negative shift")
                f.at += 9
                coefs = [bits.signed(f.at + i * precision, precision) for i in range(order)]
                f.at += order * precision
            method, parts = bits.read(f.at, 2), 1 << bits.read(f.at + 2, 4)
            f.at += 6
            if method > 1 or f.n % parts or f.n // parts < order:
                raise FlacError("reserved residual coding")
            todo.append((f, order, warm, coefs, shift, wasted, 4 + method, parts))
    if not todo:
        return
    width = max(x[0].n for x in todo)
    residual = np.zeros((width, len(todo)), np.int32 if max(x[0].depth for x in todo) <= 12 else np.int64)
    for part in range(max(x[-1] for x in todo)):
        lanes, at, n, k, start = [], [], [], [], []
        for i, (f, order, _, _, _, _, width_k, parts) in enumerate(todo):
            if part >= parts:
                continue
            size = f.n // parts
            first = max(order, part * size) if part == 0 else part * size
            param = bits.read(f.at, width_k)
            f.at += width_k
            codes = (part + 1) * size - first
            if param == (1 << width_k) - 1:
                raw_width = bits.read(f.at, 5)
                f.at += 5
                for j in range(codes):
                    residual[first + j, i] = bits.signed(f.at, raw_width)
                    f.at += raw_width
                continue
            lanes.append(i)
            at.append(f.at)
            n.append(codes)
            k.append(param)
            start.append(first)
        if lanes:
            lane = np.array(lanes)
            values, ends = _rice_in_step(bits, np.array(at), np.array(n), np.array(k))
            begins = np.array(start)
            if (begins == begins[0]).all():
                residual[begins[0] : begins[0] + len(values), lane] = values[: width - begins[0]]
            else:
                for i, b in enumerate(start):
                    residual[b : b + n[i], lanes[i]] = values[: n[i], i]
            for i, e in zip(lanes, ends.tolist(), strict=True):
                todo[i][0].at = e
    _predict(residual, todo)


def _predict(residual: np.ndarray, todo: list) -> None:
    """Undo the predictors, frames with one kind and order together, and hand out the samples."""
    kinds: dict[tuple[bool, int], list[int]] = {}
    for i, (_, order, _, coefs, *_) in enumerate(todo):
        kinds.setdefault((coefs is not None, order), []).append(i)
    for (linear, order), lanes in kinds.items():
        lanes.sort(key=lambda i: -todo[i][0].n)
        sizes = np.array([todo[i][0].n for i in lanes])
        x = residual[: int(sizes[0]), lanes]
        if order:
            x[:order] = np.array([todo[i][2] for i in lanes]).T
        if linear:
            coefs = np.array([todo[i][3] for i in lanes]).T.astype(x.dtype)
            shift = np.array([todo[i][4] for i in lanes], x.dtype)
            active = np.searchsorted(-sizes, -np.arange(len(x)), side="left").tolist()
            for t in range(order, len(x)):
                a = active[t]
                guess = coefs[0, :a] * x[t - 1, :a]
                for j in range(1, order):
                    guess += coefs[j, :a] * x[t - 1 - j, :a]
                guess >>= shift[:a]
                x[t, :a] += guess
        else:
            for level in range(order, 0, -1):
                # The (level - 1)-th differences: their first value comes from the warm-up samples.
                seed = np.diff(x[:order], n=level - 1, axis=0)[order - level]
                x[order:] = seed + np.cumsum(x[order:], axis=0)
        each = np.ascontiguousarray(x.T)
        for i, lane in enumerate(lanes):
            f, wasted = todo[lane][0], todo[lane][5]
            f.out.append(each[i, : f.n] << wasted)


def _finish(f: Frame) -> np.ndarray:
    """Interleaved samples of a frame."""
    a = f.out
    if f.mode == 8:
        a = [a[0], a[0] - a[1]]
    elif f.mode == 9:
        a = [a[0] + a[1], a[1]]
    elif f.mode == 10:
        mid = a[0] << 1 | a[1] & 1
        a = [(mid + a[1]) >> 1, (mid - a[1]) >> 1]
    return a[0] if len(a) == 1 else np.stack(a, axis=1).ravel()


def signed_bytes(samples: np.ndarray, depth: int) -> bytes:
    """Samples as signed little-endian bytes, as the stream's MD5 takes them."""
    width = -(-depth // 8)
    return samples.astype(np.int8).tobytes() if width == 1 else samples.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def pcm(samples: np.ndarray, depth: int) -> bytes:
    """Samples as PCM bytes."""
    return (samples + (1 << (depth - 1))).astype(np.uint8).tobytes() if depth <= 8 else signed_bytes(samples, depth)


def all_listed(s: Stream) -> bool:
    """Whether the seek table has every frame."""
    return bool(s.seek) and s.seek[0][0] == 0 and all(a[0] + a[2] == b[0] for a, b in zip(s.seek, s.seek[1:], strict=False)) and s.seek[-1][0] + s.seek[-1][2] == s.samples


def decode_long(file: bytes) -> tuple[list[tuple[int, bytes]], str | None]:
    """As decode() for one long file, section by section if its seek table has every frame."""
    try:
        s = parse_stream(file)
    except FlacError as e:
        return [], str(e)
    if not all_listed(s):
        return decode([file])[0]
    points = [(p[0], s.begin + p[1]) for p in s.seek]
    blocks, digest, samples, first = [], hashlib.md5(), 0, 0
    while first < len(points):
        last = first + 1
        while last < len(points) and points[last][1] - points[first][1] < STEP_BYTES:
            last += 1
        low, high = points[first][1], points[last][1] if last < len(points) else len(file)
        bits, errors, size = Bits(np.frombuffer(file[low:high], np.uint8)), [None], high - low
        try:
            frames = [parse_header(bits, at - low, 0, s, size) for _, at in points[first:last]]
        except FlacError as e:
            return [], str(e)
        frames, starts = _decode_frames(bits, frames, [p[0] for p in points[first:last]], errors, np.array([size]))
        if errors[0]:
            return [], errors[0]
        for f, sample in zip(frames, starts, strict=True):
            own = _finish(f)
            samples += len(own)
            digest.update(signed_bytes(own, s.depth))
            blocks.append((sample, pcm(own, s.depth)))
        first = last
    if s.samples and samples != s.samples * s.channels:
        return [], "samples are missing"
    if any(s.md5) and digest.digest() != s.md5:
        return [], "stream checksum"
    return blocks, None


def decode(files: list[bytes]) -> list[tuple[list[tuple[int, bytes]], str | None]]:
    """For each file its blocks (sample offset, PCM) and None, or no blocks and what is wrong."""
    sizes = np.fromiter(map(len, files), np.int64, len(files))
    base = np.cumsum(sizes) - sizes
    bits = Bits(np.frombuffer(b"".join(files), np.uint8))
    errors: list[str | None] = [None] * len(files)
    streams: list[Stream | None] = []
    done: list[list[tuple[int, np.ndarray]]] = [[] for _ in files]
    waiting = []  # (file, byte of the next frame, its first sample)
    whole = {}
    for i, file in enumerate(files):
        try:
            s = parse_stream(file)
            streams.append(s)
            whole[i] = all_listed(s)
            waiting += [(i, s.begin + p[1], p[0]) for p in s.seek] if whole[i] else [(i, s.begin, 0)] if len(file) > s.begin else []
        except FlacError as e:
            streams.append(None)
            errors[i] = str(e)
    while waiting:
        frames, starts = [], []
        for i, at, sample in waiting:
            try:
                frames.append(parse_header(bits, int(base[i]) + at, i, streams[i], int(base[i] + sizes[i])))
                starts.append(sample)
            except FlacError as e:
                errors[i] = errors[i] or str(e)
        frames, starts = _decode_frames(bits, frames, starts, errors, base + sizes)
        waiting = []
        for f, sample in zip(frames, starts, strict=True):
            done[f.file].append((sample, _finish(f)))
            end = f.at // 8 - int(base[f.file])
            if not whole[f.file] and end < sizes[f.file] and errors[f.file] is None:
                waiting.append((f.file, end, sample + f.n))
    out = []
    for i, s in enumerate(streams):
        blocks = sorted(done[i], key=lambda b: b[0])
        if errors[i] is None and s.samples and sum(len(b[1]) for b in blocks) != s.samples * s.channels:
            errors[i] = "samples are missing"
        if errors[i] is None and any(s.md5):
            digest = hashlib.md5()
            for _, b in blocks:
                digest.update(signed_bytes(b, s.depth))
            if digest.digest() != s.md5:
                errors[i] = "stream checksum"
        out.append(([], errors[i]) if errors[i] else ([(sample, pcm(b, s.depth)) for sample, b in blocks], None))
    return out


def _decode_frames(bits: Bits, frames: list[Frame], starts: list[int], errors: list[str | None], ends: np.ndarray) -> tuple[list[Frame], list[int]]:
    """Frames that decode and whose checksum holds. If one of many fails, each is tried alone."""
    if not frames:
        return [], []
    try:
        begun = [(f.at, f) for f in frames]
        for channel in range(max(f.channels for f in frames)):
            _subframes(bits, [f for f in frames if f.channels > channel], channel)
    except (FlacError, ValueError, IndexError) as e:
        if len(frames) == 1:
            errors[frames[0].file] = errors[frames[0].file] or (str(e) if isinstance(e, FlacError) else "damaged frame")
            return [], []
        kept: tuple[list[Frame], list[int]] = ([], [])
        for (at, f), sample in zip(begun, starts, strict=True):
            f.at, f.out = at, []
            own = _decode_frames(bits, [f], [sample], errors, ends)
            kept[0].extend(own[0])
            kept[1].extend(own[1])
        return kept
    stop = np.array([-(-f.at // 8) for f in frames])
    inside = stop + 2 <= ends[[f.file for f in frames]]
    size = np.where(inside, stop - np.array([f.start for f in frames]), 1)
    crc = crc16(bits.raw, np.array([f.start for f in frames]), size)
    good: tuple[list[Frame], list[int]] = ([], [])
    for f, sample, e, c, ok in zip(frames, starts, stop.tolist(), crc.tolist(), inside.tolist(), strict=True):
        if not ok or c != int(bits.raw[e]) << 8 | int(bits.raw[e + 1]):
            errors[f.file] = errors[f.file] or "frame checksum"
            continue
        f.at = 8 * (e + 2)
        good[0].append(f)
        good[1].append(sample)
    return good


# ---------------------------------------------------------------- columns


def encode_payloads(df: DataFrame, column: str = "text", unit: int = 64) -> DataFrame:
    """df without the text column, with n_bytes and media: UTF-8 bytes, padded with 0 to a multiple of unit, as FLAC."""
    keep = [c for c in df.columns if c not in (column, "n_bytes", "media")]
    schema = df.select(*keep).schema.add("n_bytes", "long").add("media", "binary")

    def run(batches):
        for batch in pieces(batches, column, 1 << 20):
            raw, at = utf8_bytes(batch.column(column))
            size = np.diff(at)
            padded = np.maximum(1, -(-size // unit)) * unit
            payload = np.zeros(int(padded.sum()), np.uint8)
            begin = np.cumsum(padded) - padded
            for a, n, b in zip(at[:-1].tolist(), size.tolist(), begin.tolist(), strict=True):
                payload[b : b + n] = raw[a : a + n]
            media = encode(payload, padded) if len(payload) <= 2 * STEP_BYTES else [encode_long(payload[b : b + n]) for b, n in zip(begin.tolist(), padded.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(size), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    return df.mapInArrow(tidy(run), schema)


def decode_blocks(df: DataFrame, column: str = "media") -> DataFrame:
    """df with blocks (array of sample offset and PCM, in order) and error."""
    keep = [c for c in df.columns if c not in ("blocks", "error")]
    schema = df.select(*keep).schema.add("blocks", T.ArrayType(T.StructType().add("sample", "long").add("pcm", "binary"))).add("error", "string")
    kind = pa.list_(pa.struct([("sample", pa.int64()), ("pcm", pa.binary())]))

    def run(batches):
        for batch in pieces(batches, column, STEP_BYTES):
            files = batch.column(column).to_pylist()
            found = decode([f or b"" for f in files]) if len(files) > 1 or len(files[0] or b"") <= STEP_BYTES else [decode_long(files[0])]
            blocks = [None if f is None else [{"sample": s, "pcm": p} for s, p in x[0]] for f, x in zip(files, found, strict=True)]
            errors = [None if f is None else x[1] for f, x in zip(files, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(blocks, kind), pa.array(errors, pa.string())], names=[*keep, "blocks", "error"])

    return df.mapInArrow(tidy(run), schema)


def joined_blocks(df: DataFrame, column: str = "blocks") -> DataFrame:
    """df with payload: the PCM of all its blocks, one after another (null blocks: empty)."""
    keep = [c for c in df.columns if c != "payload"]
    schema = df.select(*keep).schema.add("payload", "binary")

    def run(batches):
        for batch in batches:
            lists = batch.column(column)
            raw, size = blob(lists.flatten().field("pcm"))
            count = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
            yield with_columns(batch, keep, payload=binary_array(raw, np.diff(upto)))

    return df.select(*keep).mapInArrow(tidy(run), schema)


def features(column: str = "blocks") -> "F.Column":
    """What the decoded blocks are like: number of blocks, samples, and the first and last block's size."""
    sizes = F.transform(column, lambda b: F.octet_length(b["pcm"]))
    return F.concat_ws(";", F.format_string("blocks=%d", F.size(column)), F.format_string("samples=%d", F.aggregate(sizes, F.lit(0), lambda a, x: a + x)), F.format_string("first=%d", F.element_at(sizes, 1)), F.format_string("last=%d", F.element_at(sizes, -1)))


def op6_flac(spark, sf_dir: str) -> DataFrame:
    """Digests of every document's payload as it is read back from FLAC."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    read = decode_blocks(encode_payloads(docs))
    payload = F.expr("if(error IS NULL, payload, raise_error(error))")  # no row is left out
    whole = joined_blocks(read.withColumn("shape", features()).select("doc_id", "n_bytes", "media", "shape", "error", "blocks")).drop("blocks")
    media = whole.select("doc_id", "n_bytes", "media", "shape", payload.alias("payload"))
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.col("shape").alias("feature"),
    )
