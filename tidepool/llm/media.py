"""Media columns: baseline JPEG written and read in numpy.

Writer: a payload of bytes becomes a grey baseline JPEG. The format's unit here is the quantised coefficient: each byte
is one coefficient of an 8x8 block in zigzag order (bytes 0..127 as -128..-1, 128..255 as 1..128, never zero), with
quantisation steps of one, so nothing is lost. Each block is a restart interval; a comment segment keeps the lengths.
Reader: any baseline JPEG (one to four components, any sampling, restart intervals, several scans). Markers are parsed per image;
all restart intervals of a batch of images are then Huffman-decoded in lock-step, a symbol of each at a time.

Cases: null or empty text is 192 spaces; equal texts give equal rows; rows repeat as given; an empty table gives none;
other columns are not read. Long texts use a wider image: a side has at most 65,535 samples, so a payload of up to about
4 GB fits (the rest of the last row are zero blocks).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_limits, slices, text_bytes, texts

UNIT = 192
#: Payload bytes that are coded at a time; bounds a worker's memory whatever the batch.
WORK_BYTES = 1 << 20
#: Code lengths of the writer's Huffman tables. DC: sizes 0 to 11 take 4 bits each. AC: (no zeros, size), then end of block.
DC_LENGTHS = dict.fromkeys(range(12), 4)
AC_LENGTHS = {5: 1, 7: 2, 4: 4, 6: 4, 3: 5, 2: 6, 1: 7, 8: 7, 0: 7}


def huffman(lengths: dict[int, int]) -> tuple[bytes, dict[int, int]]:
    """The DHT body (counts and symbols) and canonical codes for symbols of given code lengths."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    counts = [sum(n == k for n in lengths.values()) for k in range(1, 17)]
    codes, code, last = {}, 0, 0
    for s in order:
        code <<= lengths[s] - last
        codes[s], last = code, lengths[s]
        code += 1
    return bytes(counts) + bytes(order), codes


_DC_BODY, _DC_CODES = huffman(DC_LENGTHS)
_AC_BODY, _AC_CODES = huffman(AC_LENGTHS)
_VALUE = np.where(np.arange(256) < 128, np.arange(256) - 128, np.arange(256) - 127)


def _coded(codes: dict[int, int], lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte, the bits of its coefficient and how many."""
    bits, count = np.zeros(256, np.uint64), np.zeros(256, np.uint64)
    for b, v in enumerate(_VALUE.tolist()):
        s = abs(v).bit_length()
        bits[b] = codes[s] << s | (v if v > 0 else v + (1 << s) - 1)
        count[b] = lengths[s] + s
    return bits, count


_DC_BITS, _DC_COUNT = _coded(_DC_CODES, DC_LENGTHS)
_AC_BITS, _AC_COUNT = _coded(_AC_CODES, AC_LENGTHS)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _head(height: int, width: int, payload: int, unpadded: int) -> bytes:
    return b"".join((
        b"\xff\xd8", _segment(0xFE, struct.pack(">QQ", payload, unpadded)), _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)), _segment(0xC4, b"\0" + _DC_BODY), _segment(0xC4, b"\x10" + _AC_BODY),
        _segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ))


def layout(blocks: int) -> tuple[int, int]:
    """Rows and columns of blocks for so many: three wide, or wider where the image would get too high."""
    wide = 1
    while -(-blocks // (3 * wide)) > 8191:
        wide += 1
    return -(-blocks // (3 * wide)), 3 * wide


def encode(payloads: list[bytes], unpadded: list[int]) -> list[bytes]:
    """JPEG bytes of payloads whose lengths are multiples of 64."""
    dims = [layout(len(p) // 64) for p in payloads]
    used = np.array([len(p) // 64 for p in payloads])
    each = np.array([r * c for r, c in dims])
    lanes = int(each.sum())
    first = np.concatenate([[0], np.cumsum(each)])
    real = np.zeros(lanes, bool)
    within = np.arange(lanes) - np.repeat(first[:-1], each)
    real[:] = within < np.repeat(used, each)
    blocks = np.zeros((lanes, 64), np.uint8)
    blocks[real] = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, 64)
    bits, count = _AC_BITS[blocks], _AC_COUNT[blocks]
    bits[:, 0], count[:, 0] = _DC_BITS[blocks[:, 0]], _DC_COUNT[blocks[:, 0]]
    if not real.all():
        bits[~real], count[~real] = 0, 0
        bits[~real, 0], count[~real, 0] = _DC_CODES[0], DC_LENGTHS[0]
        bits[~real, 1], count[~real, 1] = _AC_CODES[0], AC_LENGTHS[0]
    two = np.ascontiguousarray((bits[:, 0::2] << count[:, 1::2] | bits[:, 1::2]).T)
    n_two = np.ascontiguousarray((count[:, 0::2] + count[:, 1::2]).T)
    out, at = np.zeros((lanes, 32), ">u4"), np.zeros(lanes, np.int64)
    acc, held = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64)
    row, word = np.arange(lanes), np.uint64(32)
    for k in range(32):
        acc = acc << n_two[k] | two[k]
        held += n_two[k]
        full = np.flatnonzero(held >= word)
        held[full] -= word
        out[full, at[full]] = acc[full] >> held[full] & np.uint64(0xFFFFFFFF)
        at[full] += 1
        acc &= (np.uint64(1) << held) - np.uint64(1)
    pad = (np.uint64(8) - held % np.uint64(8)) % np.uint64(8)
    acc, held = acc << pad | (np.uint64(1) << pad) - np.uint64(1), held + pad
    out[row, at] = acc << (word - held) & np.uint64(0xFFFFFFFF)
    n_bytes = 4 * at + (held >> np.uint64(3)).astype(np.int64)
    raw = out.view(np.uint8).reshape(lanes, 128)
    flat = raw[np.arange(128) < n_bytes[:, None]]
    stuffed = np.ones(len(flat), np.int64) + (flat == 255)
    lane = np.repeat(row, n_bytes)
    to = np.cumsum(stuffed) - stuffed + 2 * lane
    ends = np.cumsum(np.bincount(lane, stuffed, lanes).astype(np.int64)) + 2 * row
    data = np.zeros(int(stuffed.sum()) + 2 * lanes, np.uint8)
    data[to] = flat
    data[ends] = 255
    data[ends + 1] = 0xD0 + within % 8
    data[ends[first[1:] - 1] + 1] = 0xD9
    cut = np.concatenate([[0], ends + 2])[first]
    return [_head(8 * r, 8 * c, len(p), u) + data[a:b].tobytes() for (r, c), p, u, a, b in zip(dims, payloads, unpadded, cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


@dataclass
class Component:
    h: int
    v: int
    quant: int
    wide: int = 0
    high: int = 0
    coefficients: np.ndarray | None = None  # blocks in raster order, zigzag within


@dataclass
class Image:
    width: int = 0
    height: int = 0
    components: dict[int, Component] = field(default_factory=dict)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    comments: list[bytes] = field(default_factory=list)
    scans: list[tuple] = field(default_factory=list)

    def thumbnail(self) -> np.ndarray:
        """Luminance of each block from its DC alone: a sample per 8x8 block."""
        y = next(iter(self.components.values()))
        dc = y.coefficients[:, 0].astype(np.float64) * self.quants[y.quant][0] / 8 + 128
        return np.clip(np.rint(dc), 0, 255).astype(np.uint8).reshape(y.high, y.wide)


def _lookup(body: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol; length 0 where no code fits."""
    table, code, at = np.zeros(1 << 16, np.uint32), 0, 16
    for n in range(1, 17):
        for _ in range(body[n - 1]):
            table[code << 16 - n : (code + 1) << 16 - n] = n << 8 | body[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def parse(data: bytes) -> Image:
    """Markers of a baseline JPEG; the scans' data stay where they are."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG: no start of image")
    image, tables, interval, at = Image(), {}, 0, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError(f"no marker at {at}")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = data[at + 2] << 8 | data[at + 3]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            image.comments.append(body)
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quants[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = body[0] << 8 | body[1]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("only 8-bit samples are baseline")
            image.height, image.width = struct.unpack(">HH", body[1:5])
            for k in range(body[5]):
                c, hv, q = body[6 + 3 * k : 9 + 3 * k]
                image.components[c] = Component(hv >> 4, hv & 15, q)
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError(f"frame type {marker:#x} isn't baseline")
        elif marker == 0xDA:
            parts = [(body[1 + 2 * k], tables[body[2 + 2 * k] >> 4], tables[16 | body[2 + 2 * k] & 15]) for k in range(body[0])]
            begin = at
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    at = len(data)
                    break
                if data[at + 1] and not 0xD0 <= data[at + 1] <= 0xD7:
                    break
                at += 2
                if interval == 1 and at < len(data) and (end := data.rfind(b"\xff\xd9")) > at:
                    tail = np.frombuffer(data, np.uint8)[at : end + 2]
                    ff = np.flatnonzero(tail[:-1] == 255)
                    stop = ff[(tail[ff + 1] != 0) & ((tail[ff + 1] & 0xF8) != 0xD0)]
                    at += int(stop[0])
                    break
            image.scans.append((parts, interval, begin, at))
    if not image.components or not image.scans:
        raise ValueError("no frame or no scan")
    hmax, vmax = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
    across, down = -(-image.width // (8 * hmax)), -(-image.height // (8 * vmax))
    for c in image.components.values():
        c.wide, c.high = across * c.h, down * c.v
        c.coefficients = np.zeros((c.wide * c.high, 64), np.int16)
    return image


def _units(image: Image, parts: list) -> tuple[int, list[tuple[int, np.ndarray]]]:
    """MCUs of a scan and, for each block within an MCU, its part and that block's number for every MCU."""
    comps = [image.components[p[0]] for p in parts]
    hmax, vmax = max(c.h for c in image.components.values()), max(c.v for c in image.components.values())
    if len(comps) == 1:
        c = comps[0]
        w, h = -(-image.width * c.h // (8 * hmax)), -(-image.height * c.v // (8 * vmax))
        m = np.arange(w * h)
        return w * h, [(0, m // w * c.wide + m % w)]
    across, down = comps[0].wide // comps[0].h, comps[0].high // comps[0].v
    m = np.arange(across * down)
    return across * down, [(k, (m // across * c.v + y) * c.wide + m % across * c.h + x) for k, c in enumerate(comps) for y in range(c.v) for x in range(c.h)]


def decode(files: list[bytes]) -> list[Image]:
    """Images with all coefficients; Huffman decoding runs over the restart intervals of all files at once."""
    images = [parse(f) for f in files]
    luts: dict[bytes, int] = {}
    clean, lane_bit, lane_blocks, lane_job = [], [], [], []
    jobs, place = [], 0  # a job is a scan: its first block number in the result, its block pattern
    total = 0
    for f, image in zip(files, images, strict=True):
        for parts, interval, begin, end in image.scans:
            mcus, units = _units(image, parts)
            raw = np.frombuffer(f, np.uint8)[begin:end]
            ff = np.flatnonzero(raw[:-1] == 255)
            stuffed, restart = ff[raw[ff + 1] == 0] + 1, ff[(raw[ff + 1] & 0xF8) == 0xD0]
            keep = np.ones(len(raw), bool)
            keep[stuffed] = False
            keep[restart] = keep[restart + 1] = False
            before = np.concatenate([[0], np.cumsum(keep)])
            starts = np.concatenate([[0], before[restart + 2]]) if interval else np.zeros(1, np.int64)
            per = interval or mcus
            need = -(-mcus // per)
            if len(starts) < need:
                raise ValueError(f"{len(starts)} of {need} restart intervals")
            body = raw[keep]
            clean.append(body)
            lane_bit.append((starts[:need] + place) * 8)
            done = np.minimum(per, mcus - per * np.arange(need)) * len(units)
            lane_blocks.append(done)
            lane_job.append(np.full(need, len(jobs)))
            pattern = [(luts.setdefault(parts[k][1], len(luts)), luts.setdefault(parts[k][2], len(luts))) for k, _ in units]
            jobs.append((image, parts, units, mcus, per, total, pattern))
            place += len(body)
            total += mcus * len(units)
    table = np.concatenate([_lookup(b) for b in luts])
    width = max(len(j[6]) for j in jobs)
    dc, ac = np.zeros((len(jobs), width), np.int64), np.zeros((len(jobs), width), np.int64)
    for i, j in enumerate(jobs):
        dc[i, : len(j[6])], ac[i, : len(j[6])] = np.array(j[6]).T << 16
    n_units = np.array([len(j[6]) for j in jobs])
    buffer = np.concatenate([*clean, np.zeros(16, np.uint8)])
    ahead = np.ndarray((len(buffer) - 8,), ">u8", buffer.tobytes(), 0, (1,))
    coefficients = np.zeros(total * 64 + 64, np.int16)
    bit, left, job = np.concatenate(lane_bit), np.concatenate(lane_blocks), np.concatenate(lane_job)
    out = (np.cumsum(left) - left) * 64
    k, unit = np.zeros(len(bit), np.int64), np.zeros(len(bit), np.int64)
    limit = len(ahead) - 1
    while len(bit):
        window = ahead[np.minimum(bit >> 3, limit)].astype(np.uint64) << (bit & 7).astype(np.uint64)
        direct = k == 0
        tables = (np.where(direct, dc[job, unit], ac[job, unit]) if width > 1 or len(luts) > 2 else np.where(direct, dc[0, 0], ac[0, 0]))
        entry = table[tables + (window >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        n, symbol = entry >> 8, entry & 255
        if not n.all():
            raise ValueError("a code that no table has")
        size = np.where(direct, symbol, symbol & 15)
        zeros = np.where(direct, 0, symbol >> 4)
        value = ((window << n.astype(np.uint64)) >> np.uint64(1) >> (63 - size).astype(np.uint64)).astype(np.int64)
        value += np.where(value < (1 << size >> 1), 1 - (1 << size), 0)
        bit = bit + n + size
        k = k + zeros
        has = size > 0
        if (bad := has & (k > 63)).any():
            raise ValueError(f"{int(bad.sum())} coefficients beyond their block")
        coefficients[np.where(has, out + np.minimum(k, 63), total * 64)] = value
        k = np.where(~has & ~direct & (zeros < 15), 64, k + 1)
        over = k > 63
        if over.any():
            k[over] = 0
            out[over] += 64
            left[over] -= 1
            unit[over] = (unit[over] + 1) % n_units[job[over]]
            if not (alive := left > 0).all():
                bit, left, job, out, k, unit = (x[alive] for x in (bit, left, job, out, k, unit))
    blocks = coefficients[: total * 64].reshape(-1, 64)
    for image, parts, units, mcus, per, start, _ in jobs:
        own = blocks[start : start + mcus * len(units)].reshape(mcus, len(units), 64)
        for p in range(len(parts)):
            mine = [u for u, (q, _) in enumerate(units) if q == p]
            part = own[:, mine]
            if per > 1:  # DC values are differences within a restart interval
                diffs = part[:, :, 0].reshape(-1).astype(np.int64)
                sums = np.cumsum(diffs)
                reset = np.arange(0, len(diffs), per * len(mine))
                base = np.repeat(sums[reset] - diffs[reset], np.diff(np.append(reset, len(diffs))))
                part = part.copy()
                part[:, :, 0] = (sums - base).reshape(part.shape[:2])
            image.components[parts[p][0]].coefficients[np.stack([units[u][1] for u in mine], 1)] = part
    return images


def payload(image: Image) -> tuple[bytes, int]:
    """What encode() stored, and its length before padding."""
    size, unpadded = struct.unpack(">QQ", image.comments[0])
    v = next(iter(image.components.values())).coefficients.reshape(-1)[:size]
    return np.where(v < 0, v + 128, v + 127).astype(np.uint8).tobytes(), unpadded


def thumbnail_hash(thumb: np.ndarray) -> str:
    """Difference hash of 8x8 bits: whether a sample is brighter than its left neighbour, on an 8x9 grid."""
    rows, cols = np.arange(8) * thumb.shape[0] // 8, np.arange(9) * thumb.shape[1] // 9
    grid = thumb[np.ix_(rows, cols)]
    return np.packbits(grid[:, 1:] > grid[:, :-1]).tobytes().hex()


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        body, offsets = text_bytes(batch.column(1))
        for a, b in slices(np.diff(offsets) + UNIT, WORK_BYTES):
            raw = [body[offsets[i] : offsets[i + 1]].tobytes() for i in range(a, b)]
            padded = [x + b" " * (-len(x) % UNIT or (not x) * UNIT) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(encode(padded, [len(x) for x in raw]), pa.binary())], ["doc_id", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("thumbnail_sha256", pa.string())]
    for batch in batches:
        _, offsets = text_bytes(batch.column(1))
        for a, b in slices(np.diff(offsets), WORK_BYTES):
            files, rows = batch.column(1).slice(a, b - a).to_pylist(), []
            for f, image in zip(files, decode(files), strict=True):
                data, n = payload(image)
                thumb = image.thumbnail()
                rows.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(f), hashlib.sha256(f).hexdigest(), f"{image.width}x{image.height}:{thumbnail_hash(thumb)}", image.width, image.height, hashlib.sha256(thumb.tobytes()).hexdigest()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True))], ["doc_id", *(n for n, _ in kinds)])


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary): each whole text as a JPEG."""
    arrow_limits(docs.sparkSession)
    docs = texts(docs)
    return docs.mapInArrow(_store, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Decode a media column written by store_media: payload digests, dimensions and DC thumbnail hashes."""
    arrow_limits(media.sparkSession)
    media = media.select("doc_id", "media")
    return media.mapInArrow(_read, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, thumbnail_sha256 string")
