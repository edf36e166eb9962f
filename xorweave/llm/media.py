"""Motion-JPEG in AVI: writing, parsing, decoding, and shots.

A frame is a grey baseline JPEG of flat 8 x 8 blocks, one block per 8-bit sample, so that nothing
is lost: a block's DC coefficient is its sample less 128 at quantiser 8, and no AC coefficient is
set. The frame's own Huffman table gives category c of a DC difference a code of 9 - c bits, so
code and extra bits take 9 bits always, and one bit ends the block: samples are packed and
unpacked with array operations. The last frame is filled with zeros; a chunk "plen" in the header
list holds the payload's length.

Frames with another head, as other programs write them, are decoded in full by their own tables
(baseline Huffman, 8 bits, grey or YCbCr; slowly, value by value); shots are then of their
brightness. Anything else raises.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Blocks in a row of a frame, and rows of blocks at most.
ACROSS, DOWN = 64, 32
FPS = 25
BINS = 16
WINDOW = 12
ZIGZAG_ONES = bytes([8] + [1] * 63)
#: Where a frame of this layout has its height.
HEIGHT_AT = 76
#: Places of the coefficients of a block in the order of a scan, and the cosines of the inverse transform.
ZIGZAG = np.array([8 * y + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (0.5 if u else 0.5 / np.sqrt(2)) for x in range(8)] for u in range(8)])


@functools.lru_cache(64)
def jpeg_head(down: int) -> bytes:
    dc = bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))  # one code of each length 1..9, for categories 8..0
    ac = bytes([1] + [0] * 15) + b"\x00"  # end of block: one bit
    segments = (
        (0xDB, b"\x00" + ZIGZAG_ONES),
        (0xC0, struct.pack(">BHHB", 8, 8 * down, 8 * ACROSS, 1) + b"\x01\x11\x00"),
        (0xC4, b"\x00" + dc),
        (0xC4, b"\x10" + ac),
        (0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    )
    return b"\xff\xd8" + b"".join(struct.pack(">BBH", 0xFF, kind, len(body) + 2) + body for kind, body in segments)


def difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """10-bit codes of the differences -255..255, and the difference of each code."""
    codes = np.zeros(511, dtype=np.uint16)
    back = np.zeros(1024, dtype=np.int16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << c) - 1
        prefix = (1 << (9 - c)) - 2  # 0, 10, 110, ...: category 8 has one bit
        codes[d + 255] = ((prefix << c) | extra) << 1
        back[codes[d + 255]] = d
    return codes, back


CODES, DIFFERENCES = difference_codes()


def encode_frame(samples: np.ndarray, head: bytes) -> bytes:
    level = samples.astype(np.int16) - 128
    codes = CODES[np.diff(level, prepend=np.int16(0)) + 255]
    bits = np.unpackbits(codes.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 6:].ravel()
    bits = np.concatenate([bits, np.ones(-len(bits) % 8, dtype=np.uint8)])
    return head + np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9"


def decode_frame(jpeg: bytes) -> np.ndarray:
    """The samples of a frame of this layout; of other baseline frames, the brightness of each pixel."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    down = struct.unpack_from(">H", jpeg, HEIGHT_AT)[0] // 8 if len(jpeg) > HEIGHT_AT + 2 else 0
    head = jpeg_head(down)
    if not jpeg.startswith(head):
        return luma(jpeg).ravel()
    if jpeg[-2:] != b"\xff\xd9":
        raise ValueError("frame is cut off")
    data = np.frombuffer(jpeg[len(head) : -2].replace(b"\xff\x00", b"\xff"), dtype=np.uint8)
    bits = np.unpackbits(data)[: down * ACROSS * 10].reshape(down * ACROSS, 10)
    codes = bits @ (1 << np.arange(9, -1, -1))
    if not np.array_equal(CODES[DIFFERENCES[codes] + 255], codes):
        raise ValueError("bad code in a frame")
    return (np.cumsum(DIFFERENCES[codes]) + 128).astype(np.uint8)


def code_table(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """For every 16 bits, the length and the symbol of the Huffman code that they start with; length 0: none."""
    out, k = [], 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[k : k + n]:
            out += [(length, symbol)] * (1 << (16 - length))
        k += n
    if len(out) > 1 << 16 or k != len(symbols):
        raise ValueError("bad Huffman table")
    return out + [(0, 0)] * ((1 << 16) - len(out))


def luma(jpeg: bytes) -> np.ndarray:
    """The first component (grey or Y) of a baseline JPEG, height x width, by the frame's own tables.
    What isn't baseline Huffman of 8 bits, grey or YCbCr, or brings no tables of its own, raises."""
    quant: dict[int, np.ndarray] = {}
    codes: dict[int, list] = {}
    parts: dict[int, tuple] = {}  # component: h, v, quantiser, blocks across, blocks down, coefficients
    at, restart, width, height, seen = 2, 0, 0, 0, set()
    try:
        while True:
            if jpeg[at] != 0xFF:
                raise ValueError("bad segment")
            while jpeg[at] == 0xFF:
                at += 1
            kind, at = jpeg[at], at + 1
            if kind == 0xD9:
                break
            size = struct.unpack_from(">H", jpeg, at)[0]
            body, at = jpeg[at + 2 : at + size], at + size
            if kind == 0xDB:
                while body:
                    n = 128 if body[0] >> 4 else 64
                    quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], dtype=">u2" if n == 128 else np.uint8).astype(np.float64)
                    body = body[1 + n :]
            elif kind == 0xC4:
                while body:
                    n = 17 + sum(body[1:17])
                    codes[body[0]] = code_table(body[1:17], body[17:n])
                    body = body[n:]
            elif kind == 0xDD:
                restart = struct.unpack(">H", body)[0]
            elif kind == 0xEE and body[:5] == b"Adobe" and body[11] != 1:
                raise ValueError("colours are not YCbCr")
            elif kind in (0xC0, 0xC1):
                bits, height, width, n = struct.unpack_from(">BHHB", body)
                if parts or bits != 8 or n not in (1, 3) or not height or not width:
                    raise ValueError("not a baseline frame of 8 bits, grey or YCbCr")
                own = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                most = max(h for _, h, _, _ in own), max(v for _, _, v, _ in own)
                if own[0][1:3] != most:
                    raise ValueError("first component is not of full size")
                mcus = -(-width // (8 * most[0])), -(-height // (8 * most[1]))
                for c, h, v, q in own:
                    parts[c] = (h, v, q, -(-width * h // (8 * most[0])), -(-height * v // (8 * most[1])), np.zeros((mcus[1] * v, mcus[0] * h, 64)))
            elif 0xC2 <= kind <= 0xCF:
                raise ValueError("not a baseline JPEG")
            elif kind == 0xDA:
                chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
                at = scan(jpeg, at, [(parts[c], codes[t >> 4], codes[16 + (t & 15)]) for c, t in chosen], mcus, restart)
                seen |= {c for c, _ in chosen}
    except (IndexError, KeyError, struct.error, UnboundLocalError) as e:
        raise ValueError(f"bad JPEG frame: {e!r}") from e
    if not parts or seen != set(parts) or jpeg[at:].startswith(b"\xff\xd8") or next(iter(parts.values()))[2] not in quant:
        raise ValueError("not one whole frame with its tables")
    _, _, q, _, _, found = next(iter(parts.values()))
    blocks = np.zeros_like(found)
    blocks[:, :, ZIGZAG] = found * quant[q]
    pixels = COSINES.T @ blocks.reshape(*found.shape[:2], 8, 8) @ COSINES + 128
    return np.clip(np.rint(pixels), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(8 * found.shape[0], -1)[:height, :width]


def scan(jpeg: bytes, at: int, own: list[tuple], mcus: tuple[int, int], restart: int) -> int:
    """Reads one scan's coefficients into its components; returns where the next marker stands."""
    runs_, start = [], at
    while True:
        at = jpeg.find(b"\xff", at)
        if not 0 <= at < len(jpeg) - 1:
            raise ValueError("scan is cut off")
        if jpeg[at + 1] == 0:
            at += 2
            continue
        if jpeg[at + 1] == 0xFF:
            at += 1
            continue
        runs_.append(jpeg[start:at].replace(b"\xff\x00", b"\xff"))
        if not 0xD0 <= jpeg[at + 1] <= 0xD7:
            break
        start = at = at + 2
    if len(own) == 1:
        (_, _, _, across, down, out), dc, ac = own[0]
        units = [[(out[y, x], dc, ac, 0)] for y in range(down) for x in range(across)]
    else:
        units = [[(part[5][my * part[1] + y, mx * part[0] + x], dc, ac, i) for i, (part, dc, ac) in enumerate(own) for y in range(part[1]) for x in range(part[0])] for my in range(mcus[1]) for mx in range(mcus[0])]
    step = restart or len(units)
    if len(runs_) != -(-len(units) // step):
        raise ValueError("restart markers don't fit the frame")
    for k, run in enumerate(runs_):
        data, end, pos, last = run + b"\xff" * 8, 8 * len(run), 0, [0] * len(own)

        def bits(n: int) -> int:
            nonlocal pos
            i = pos >> 3
            pos += n
            if pos > end:
                raise ValueError("scan is cut off")
            return int.from_bytes(data[i : i + 4], "big") >> (32 - n - (pos - n & 7)) & ((1 << n) - 1)

        def symbol(table: list) -> int:
            i = pos >> 3
            length, found = table[int.from_bytes(data[i : i + 3], "big") >> (8 - (pos & 7)) & 0xFFFF]
            if not length:
                raise ValueError("bad code in a frame")
            bits(length)
            return found

        def value(n: int) -> int:
            x = bits(n) if n else 0
            return x if not n or x >> (n - 1) else x - (1 << n) + 1

        for unit in units[k * step : (k + 1) * step]:
            for block, dc, ac, i in unit:
                last[i] += value(symbol(dc))
                block[0], at_ = last[i], 1
                while at_ < 64:
                    s = symbol(ac)
                    if s == 0:
                        break
                    at_ += s >> 4
                    if s & 15:
                        block[at_] = value(s & 15)
                    elif s != 0xF0:
                        raise ValueError("not a baseline scan")
                    at_ += 1
    return at


def chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    """An AVI file of the payload's bytes, a multiple of ACROSS of them."""
    rows = len(payload) // ACROSS
    down = min(DOWN, rows)
    per_frame = down * ACROSS
    n = -(-len(payload) // per_frame)
    samples = np.frombuffer(payload + b"\x00" * (n * per_frame - len(payload)), dtype=np.uint8).reshape(n, per_frame)
    head = jpeg_head(down)
    frames = [encode_frame(s, head) for s in samples]
    size = (8 * ACROSS, 8 * down)
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, *size, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, *size)
    strf = struct.pack("<IiiHH4sIiiII", 40, *size, 1, 8, b"MJPG", size[0] * size[1], 0, 0, 0, 0)
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl + chunk(b"plen", struct.pack("<Q", len(payload))))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(chunk(b"00dc", f))
        at += len(movi[-1])
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(tag, start, end) of the chunks between two offsets."""
    while start + 8 <= end:
        tag, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        if start + 8 + size > end:
            raise ValueError("chunk runs over its list")
        yield tag, start + 8, start + 8 + size
        start += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[np.ndarray, int, float]:
    """Samples (frames x samples) by the file's index, the payload's length, frames per second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, length, fps = None, b"", 0, float(FPS)
    for tag, a, b in chunks(data, 12, len(data)):
        kind = data[a : a + 4] if tag == b"LIST" else tag
        if kind == b"hdrl":
            for inner, x, y in chunks(data, a + 4, b):
                if inner == b"avih":
                    fps = 1_000_000 / struct.unpack_from("<I", data, x)[0]
                elif inner == b"plen":
                    length = struct.unpack("<Q", data[x:y])[0]
        elif kind == b"movi":
            movi = a
        elif kind == b"idx1":
            index = data[a:b]
    if movi is None or not index:
        raise ValueError("no frames or no index")
    frames = []
    for tag, _, offset, size in struct.iter_unpack("<4sIII", index):
        if tag in (b"00dc", b"00db"):
            # offsets count from the frames' list or, in some files, from the file's start
            at = (movi if data[movi + offset : movi + offset + 4] == tag else 0) + offset + 8
            if data[at - 8 : at] != tag + struct.pack("<I", size):
                raise ValueError("index does not fit the frames")
            frames.append(decode_frame(data[at : at + size]))
    return np.stack(frames), length, fps


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """Frames (first, after last) of each shot. A cut is where the histogram difference to the frame
    before exceeds, by 0.1 and three deviations, the mean of the shot's last WINDOW differences."""
    hist = np.stack([np.bincount(f >> 4, minlength=BINS) for f in frames]) / frames.shape[1]
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    cuts = [0]
    for i, d in enumerate(diff):
        near = diff[max(cuts[-1], i - WINDOW) : i]
        if d > 0.1 + (near.mean() + 3 * near.std() if len(near) else 0.0):
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], len(frames)], strict=True))


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\x00" * (-len(raw) % 64 or (0 if raw else 64))


def to_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, media (binary AVI). Null counts as the empty text; repeated rows give
    equal media; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                made = [(n, write_avi(p)) for n, p in map(payload_of, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], ["m_id", "n_bytes", "media"])

    own = docs.select(F.col(id_col).alias("m_id"), F.col(text_col).alias("text"))
    kind = own.schema["m_id"].dataType.simpleString()
    return own.mapInArrow(run, f"m_id {kind}, n_bytes long, media binary").select(F.col("m_id").alias(id_col), "n_bytes", "media")


CLIPS = "array<struct<clip: int, first_frame: int, end_frame: int, start_s: double, end_s: double, mean: double>>"


def read_media(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``media`` (binary AVI): id, payload (binary) and clips, one per shot, with times.
    Null media give nulls; bytes that aren't such an AVI raise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, clips = [], []
            for data in batch.column(1).to_pylist():
                if data is None:
                    payloads.append(None)
                    clips.append(None)
                    continue
                frames, length, fps = read_avi(data)
                payloads.append(frames.tobytes()[:length])
                clips.append([{"clip": i, "first_frame": a, "end_frame": b, "start_s": a / fps, "end_s": b / fps, "mean": float(frames[a:b].mean())} for i, (a, b) in enumerate(shots(frames))])
            row = pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean", pa.float64())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(payloads, pa.binary()), pa.array(clips, pa.list_(row))], ["m_id", "payload", "clips"])

    own = media.select(F.col(id_col).alias("m_id"), F.col("media").alias("media"))
    kind = own.schema["m_id"].dataType.simpleString()
    return own.mapInArrow(run, f"m_id {kind}, payload binary, clips {CLIPS}").select(F.col("m_id").alias(id_col), "payload", "clips")


def clip_rows(media: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row per shot: id, clip, first_frame, end_frame, start_s, end_s, mean."""
    return read_media(media, id_col=id_col).select(id_col, F.inline("clips"))


def digest(n_bytes: int, media: bytes) -> dict:
    """What the query returns of one stored file."""
    frames, length, fps = read_avi(media)
    payload = frames.tobytes()[:length]
    found = [f"{a / fps:.2f}-{b / fps:.2f}:{frames[a:b].mean():.4f}" for a, b in shots(frames)]
    return {
        "n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": f"frames={len(frames)};shots={len(found)};" + ",".join(found),
    }


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of each document's file, written and read back in one task."""
    media = to_media(table(spark, sf_dir, "documents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(n, m) for n, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            ids = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pylist([{"doc_id": i} | r for i, r in zip(ids, rows, strict=True)], schema)

    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    schema = pa.schema([("doc_id", pa.int64()), *[(k, pa.string() if k in ("payload_sha256", "media_sha256", "feature") else pa.int64()) for k in names]])
    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
