"""Media columns: AVI files of motion-JPEG frames.

Bytes are stored as 8-bit grey samples of frames of 24 by 24, each a lossless
JPEG (SOF3, predictor 1), in a RIFF file with an idx1 index.  Frames of a batch are
coded together in numpy: one table look-up per sample and a bitwise layout when
writing, and one step for each sample position over all frames when reading.

The reader parses the index, or the chunks of ``movi`` where there is none, and each frame's
markers: any lossless grey frame of 8 bits, whatever its tables, size and predictor,
and baseline frames (SOF0) of any components, of which it returns the first, luma.  Frames
without Huffman tables of their own, and other kinds, raise ValueError.

Shots: the grey histograms of neighbouring frames are compared; a difference
above the mean of its neighbourhood by ``SHARP`` deviations, and above ``FLOOR``,
begins a new clip.

Null and empty texts are stored as one frame of padding; texts of any length are
stored whole; equal texts give equal files, and rows that repeat are rows of their own;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from .common import slices, small_batches

SIDE = 24
FRAME = SIDE * SIDE
PAD = 255
MS_PER_FRAME = 40
#: Huffman codes for the difference categories 0 to 8: (length, categories), shortest first.
CODE_LENGTHS = ((3, (7, 6, 5, 4)), (4, (3, 2, 1, 0)), (5, (8,)))
BINS, NEAR, SHARP, FLOOR = 16, 4, 1.5, 0.15


def huffman_codes() -> dict[int, tuple[int, int]]:
    """Category to (code, length), numbered as a JPEG reader numbers them."""
    code, last, out = 0, 0, {}
    for length, categories in CODE_LENGTHS:
        code <<= length - last
        last = length
        for c in categories:
            out[c] = (code, length)
            code += 1
    return out


def frame_head() -> bytes:
    counts = bytearray(16)
    for length, categories in CODE_LENGTHS:
        counts[length - 1] = len(categories)
    symbols = bytes(c for _, categories in CODE_LENGTHS for c in categories)
    table = b"\xff\xc4" + struct.pack(">H", 19 + len(symbols)) + b"\x00" + bytes(counts) + symbols
    frame = b"\xff\xc3" + struct.pack(">HBHHB", 11, 8, SIDE, SIDE, 1) + b"\x01\x11\x00"
    scan = b"\xff\xda" + struct.pack(">HB", 8, 1) + b"\x01\x00\x01\x00\x00"
    return b"\xff\xd8" + table + frame + scan


HEAD, TAIL = frame_head(), b"\xff\xd9"


@functools.lru_cache(maxsize=1)
def coding() -> tuple[np.ndarray, np.ndarray]:
    """For each difference from -255 to 255: its bits and their number."""
    codes, bits, lengths = huffman_codes(), np.zeros(511, np.uint32), np.zeros(511, np.uint8)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        bits[d + 255] = code << size | (d if d >= 0 else d + (1 << size) - 1)
        lengths[d + 255] = n + size
    return bits, lengths


def code_frames(samples: np.ndarray) -> list[bytes]:
    """The JPEG files of frames given as rows of ``FRAME`` samples."""
    n = len(samples)
    x = samples.reshape(n, SIDE, SIDE).astype(np.int16)
    guess = np.empty_like(x)
    guess[:, :, 1:] = x[:, :, :-1]
    guess[:, 1:, 0] = x[:, :-1, 0]
    guess[:, 0, 0] = 128
    k = (x - guess + 255).reshape(n, FRAME)
    bits, lengths = coding()
    size = lengths[k].astype(np.int64)
    ends = np.cumsum(size, 1)
    n_bytes = (ends[:, -1] + 7) >> 3
    first = np.cumsum(n_bytes) - n_bytes
    at = (ends - size + first[:, None] * 8).ravel()
    size = size.ravel()
    window = (bits[k].ravel() << (24 - size - (at & 7)).astype(np.uint32)).astype(np.uint32)
    at >>= 3
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    where = at[starts]
    total = int(n_bytes.sum())
    flat = np.zeros(total + 3, np.uint32)
    for j in range(3):
        flat[where + j] += np.add.reduceat(window >> np.uint32(16 - 8 * j) & np.uint32(255), starts)
    flat = flat[:total].astype(np.uint8)
    spare = (n_bytes * 8 - ends[:, -1]).astype(np.int64)
    flat[first + n_bytes - 1] |= ((1 << spare) - 1).astype(np.uint8)
    full = flat == 255
    stuffed = np.repeat(flat, 1 + full)
    stuffed[np.flatnonzero(full) + np.arange(1, int(full.sum()) + 1)] = 0
    cuts = np.concatenate([[0], np.cumsum(n_bytes)]) + np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(n_bytes)])]
    data = stuffed.tobytes()
    return [HEAD + data[a:b] + TAIL for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


@dataclass(frozen=True)
class Head:
    """What a frame's markers say, up to its scan."""

    lossless: bool
    height: int
    width: int
    components: tuple  # (id, horizontal, vertical, quantization table)
    scan: tuple  # (component, dc table, ac table)
    predictor: int
    restart: int
    huffman: tuple  # (class and number, counts of lengths, symbols)
    quantization: tuple  # (number, 64 values in zigzag order)


@functools.lru_cache(maxsize=4096)
def parse_head(head: bytes) -> Head:
    """Reads the markers of a frame from its start to the end of its scan header."""
    at, huffman, quantization, frame, restart = 2, {}, {}, None, 0
    if head[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    while True:
        if head[at] != 0xFF:
            raise ValueError("a JPEG marker is missing")
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                counts = tuple(body[1:17])
                huffman[body[0]] = (counts, tuple(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quantization[body[0] & 15] = struct.unpack_from(">64H" if wide else ">64B", body, 1)
                body = body[129 if wide else 65 :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker in (0xC0, 0xC1, 0xC3):
            if body[0] != 8:
                raise ValueError("only frames of 8 bits are read")
            frame = (marker == 0xC3, *struct.unpack_from(">HH", body, 1), tuple((body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)))
        elif marker == 0xDA:
            scan = tuple((body[k], body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2))
            break
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("a kind of JPEG frame that isn't read")
    if frame is None or not huffman:
        raise ValueError("a frame without its own size or Huffman tables")
    return Head(*frame, scan, body[1 + 2 * body[0]], restart, tuple((k, *v) for k, v in sorted(huffman.items())), tuple(sorted(quantization.items())))


def head_size(file: bytes) -> int:
    """Where a frame's coded samples begin."""
    at = 2
    while file[:2] == b"\xff\xd8" and at + 4 <= len(file):
        end = at + 2 + struct.unpack_from(">H", file, at + 2)[0]
        if file[at + 1] == 0xDA:
            return end
        at = end
    raise ValueError("not a JPEG frame")


@functools.lru_cache(maxsize=256)
def reading_table(counts: tuple, symbols: tuple) -> tuple[np.ndarray, np.ndarray]:
    """For each window of 16 bits: the symbol whose code it begins with, and the code's length (0: none)."""
    value, length, code, k = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8), 0, 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            at = code << (16 - n)
            value[at : at + (1 << (16 - n))], length[at : at + (1 << (16 - n))] = symbols[k], n
            code, k = code + 1, k + 1
        code <<= 1
    return value, length


def unstuffed(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bits of several scans without their stuffing, as 32-bit windows at each byte, and where each scan begins."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    stuffing = np.zeros(len(raw), bool)
    stuffing[1:] = (raw[:-1] == 255) & (raw[1:] == 0)
    dropped = np.concatenate([[0], np.cumsum(stuffing)])
    starts = np.cumsum([0, *map(len, data)])[:-1]
    flat = np.concatenate([raw[~stuffing], np.zeros(4, np.uint8)]).astype(np.uint32)
    windows = flat[:-3] << np.uint32(24) | flat[1:-2] << np.uint32(16) | flat[2:-1] << np.uint32(8) | flat[3:]
    return windows, starts - dropped[starts]


def lossless_samples(head: Head, data: list[bytes]) -> np.ndarray:
    """The samples of frames that share a head, a row for each; a step for each place handles all frames."""
    if len(head.components) != 1 or head.restart:
        raise ValueError("only grey lossless frames without restarts are read")
    tables = {k: (counts, symbols) for k, counts, symbols in head.huffman}
    category, length = reading_table(*tables[head.scan[0][1]])
    windows, starts = unstuffed(data)
    at = starts.astype(np.int64) * 8
    h, w, n = head.height, head.width, len(data)
    out = np.empty((h * w, n), np.int16)
    for k in range(h * w):
        bits = windows[at >> 3] << (at & 7).astype(np.uint32)  # 25 bits or more are true ones
        code = bits >> np.uint32(16)
        size, used = category[code], length[code]
        extra = ((bits << used.astype(np.uint32)) >> np.uint32(16)).astype(np.int32) >> (16 - size.astype(np.int32))
        out[k] = np.where(extra < (1 << size.astype(np.int32) >> 1), extra - (1 << size.astype(np.int32)) + 1, extra)
        at += used
        at += size
    x = np.ascontiguousarray(out.T).reshape(n, h, w)
    x[:, 0, 0] += 128
    if head.predictor == 1:
        x[:, :, 0] = np.cumsum(x[:, :, 0], 1, dtype=np.int16)
        return np.cumsum(x, 2, dtype=np.int16).astype(np.uint8).reshape(n, h * w)
    x[:, 0] = np.cumsum(x[:, 0], 1, dtype=np.int16)
    guess = {2: lambda a, b, c: b, 3: lambda a, b, c: c, 4: lambda a, b, c: a + b - c, 5: lambda a, b, c: a + ((b - c) >> 1), 6: lambda a, b, c: b + ((a - c) >> 1), 7: lambda a, b, c: (a + b) >> 1}[head.predictor]
    x &= 255
    for row in range(1, h):
        x[:, row, 0] = (x[:, row, 0] + x[:, row - 1, 0]) & 255
        for col in range(1, w):
            x[:, row, col] = (x[:, row, col] + guess(x[:, row, col - 1], x[:, row - 1, col], x[:, row - 1, col - 1])) & 255
    return x.astype(np.uint8).reshape(n, h * w)


@functools.lru_cache(maxsize=1)
def zigzag() -> list[int]:
    """Places of a block of 8 by 8 along its diagonals, which are walked up and down in turn."""
    return sorted(range(64), key=lambda k: (k // 8 + k % 8, k % 8 if (k // 8 + k % 8) % 2 == 0 else k // 8))


@functools.lru_cache(maxsize=1)
def cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)


def baseline_samples(head: Head, data: bytes) -> np.ndarray:
    """Luma of a baseline frame, one block after the other."""
    tables = {k: reading_table(counts, symbols) for k, counts, symbols in head.huffman}
    parts = re.split(b"\xff[\xd0-\xd7]", data) if head.restart else [data]
    wide, high = max(c[1] for c in head.components), max(c[2] for c in head.components)
    if len(head.components) == 1:
        wide = high = 1
    across, down = -(-head.width // (8 * wide)), -(-head.height // (8 * high))
    luma = head.components[0]
    planes = (luma[1], luma[2]) if len(head.components) > 1 else (1, 1)
    blocks = np.zeros((down * planes[1], across * planes[0], 64))
    chosen, order = {c: (d, a) for c, d, a in head.scan}, zigzag()
    units, done = across * down, 0
    for part in parts:
        windows = unstuffed([part])[0].tolist()
        at, last = 0, dict.fromkeys((c[0] for c in head.components), 0)

        def taken(n: int) -> int:
            nonlocal at
            out = (windows[at >> 3] << (at & 7) & 0xFFFFFFFF) >> (32 - n) if n else 0
            at += n
            return out

        def symbol(table) -> int:
            nonlocal at
            code = (windows[at >> 3] << (at & 7) & 0xFFFFFFFF) >> 16
            at += int(table[1][code])
            return int(table[0][code])

        def signed(size: int) -> int:
            x = taken(size)
            return x if not size or x >> (size - 1) else x - (1 << size) + 1

        for unit in range(done, min(done + (head.restart or units), units)):
            for name, hs, vs, _ in head.components:
                dc, ac = tables[chosen[name][0]], tables[16 + chosen[name][1]]
                for b in range(hs * vs if len(head.components) > 1 else 1):
                    values = [0] * 64
                    last[name] += signed(symbol(dc))
                    values[0], k = last[name], 1
                    while k < 64:
                        run, size = divmod(symbol(ac), 16)
                        if not size and run != 15:
                            break
                        k += run
                        if size:
                            values[k] = signed(size)
                        k += 1
                    if name == luma[0]:
                        blocks[unit // across * planes[1] + b // planes[0], unit % across * planes[0] + b % planes[0], order] = values
        done += head.restart or units
    scaled = np.zeros(64)
    scaled[order] = dict(head.quantization)[luma[3]]
    coefficients = (blocks * scaled).reshape(*blocks.shape[:2], 8, 8)
    c = cosines()
    x = np.rint(np.einsum("kx,abkl,ly->abxy", c, coefficients, c) + 128).clip(0, 255).astype(np.uint8)
    whole = x.transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, -1)
    return np.ascontiguousarray(whole[: -(-head.height * planes[1] // high), : -(-head.width * planes[0] // wide)])


def decode_frames(files: list[bytes]) -> list[np.ndarray]:
    """The samples of JPEG frames, rows of a table for frames of one head; lossless frames that share a head are read together."""
    out: list = [None] * len(files)
    groups: dict[bytes, list[int]] = {}
    for k, f in enumerate(files):
        if not f.endswith(TAIL):
            raise ValueError("not a JPEG frame")
        groups.setdefault(HEAD if f.startswith(HEAD) else bytes(f[: head_size(f)]), []).append(k)
    for name, members in groups.items():
        head = parse_head(name)
        data = [files[k][len(name) : -len(TAIL)] for k in members]
        for k, x in zip(members, lossless_samples(head, data) if head.lossless else [baseline_samples(head, d).ravel() for d in data]):
            out[k] = x
    return out


def chunk(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) & 1)


def avi(frames: list[bytes]) -> bytes:
    """A RIFF file of the frames, each a key frame in the index."""
    most = max(map(len, frames))
    main = struct.pack("<14I", MS_PER_FRAME * 1000, 0, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, 1000 // MS_PER_FRAME, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    image = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    head = chunk(b"LIST", b"hdrl", chunk(b"avih", main), chunk(b"LIST", b"strl", chunk(b"strh", stream), chunk(b"strf", image)))
    movie, index, at = [], [], 4
    for f in frames:
        movie.append(b"00dc" + struct.pack("<I", len(f)) + f + b"\x00" * (len(f) & 1))
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        at += len(movie[-1])
    return chunk(b"RIFF", b"AVI ", head, chunk(b"LIST", b"movi", *movie), chunk(b"idx1", *index))


def index_of(file: bytes) -> tuple[int, list[tuple[int, int]]]:
    """Milliseconds per frame, and (offset, length) of each video frame of an AVI file, from its index or, without one, its chunks.

    Offsets in an index count from ``movi`` or, in some files, from the start of the file.
    """
    if file[:4] != b"RIFF" or file[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movie, found, inner, ms = 12, None, None, [], MS_PER_FRAME
    while at + 8 <= len(file):
        name, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"LIST" and file[at + 8 : at + 12] == b"movi":
            movie, place = at + 8, at + 12
            while place + 8 <= min(at + 8 + size, len(file)) and not file.startswith(b"idx1", at + 8 + size):
                inner_size = struct.unpack_from("<I", file, place + 4)[0]
                if file[place + 2 : place + 4] in (b"dc", b"db"):
                    inner.append((place + 8, inner_size))
                place += 12 if file[place : place + 4] == b"LIST" else 8 + inner_size + (inner_size & 1)
        elif name == b"LIST" and file[at + 8 : at + 12] == b"hdrl":
            ms = struct.unpack_from("<I", file, at + 20)[0] // 1000
        elif name == b"idx1":
            entries = np.frombuffer(file, "<u4", size // 16 * 4, at + 8).reshape(-1, 4)
            video = ((entries[:, 0] >> 16) == 0x6364) | ((entries[:, 0] >> 16) == 0x6264)
            offsets = entries[video, 2].astype(np.int64)
            base = 0 if len(offsets) and file[offsets[0] : offsets[0] + 4] == entries[video][0, :1].tobytes() else movie
            found = list(zip((offsets + base + 8).tolist(), entries[video, 3].tolist()))
        at += 8 + size + (size & 1)
    return ms, inner if found is None else found


def cuts_of(frames: np.ndarray) -> list[int]:
    """The frames that begin a shot."""
    if len(frames) < 2:
        return [0]
    bins = (frames >> 4).astype(np.int64) + np.arange(len(frames))[:, None] * BINS
    hist = np.bincount(bins.ravel(), minlength=len(frames) * BINS).reshape(-1, BINS)
    steps = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * frames.shape[1])
    sums, squares = np.concatenate([[0], np.cumsum(steps)]), np.concatenate([[0], np.cumsum(steps * steps)])
    k = np.arange(len(steps))
    a, b = np.maximum(k - NEAR, 0), np.minimum(k + NEAR + 1, len(steps))
    mean = (sums[b] - sums[a]) / (b - a)
    spread = np.sqrt(np.maximum((squares[b] - squares[a]) / (b - a) - mean * mean, 0))
    return [0, *(np.flatnonzero((steps > FLOOR) & (steps > mean + SHARP * spread)) + 1).tolist()]


def store_avi(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8 bytes as an AVI file."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts, 2_000_000):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts[a:b]]
                counts = [max(1, -(-len(r) // FRAME)) for r in raw]
                payload = b"".join(r.ljust(n * FRAME, bytes([PAD])) for r, n in zip(raw, counts))
                files = code_frames(np.frombuffer(payload, np.uint8).reshape(-1, FRAME))
                ends = np.cumsum(counts).tolist()
                media = [avi(files[e - n : e]) for e, n in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decoded(batch, column: str = "media"):
    """(row, ms per frame, samples of its frames) of each file of a batch; files are decoded together, a bounded number of bytes at a time."""
    media = batch.column(column)
    sizes = pa.compute.binary_length(media).to_pylist()
    start, held = 0, 0
    for i, size in enumerate(sizes):
        held += size or 0
        if held < 3_000_000 and i + 1 < len(sizes):
            continue
        files = media.slice(start, i + 1 - start).to_pylist()
        indexes = [index_of(f) for f in files]
        samples = decode_frames([f[a : a + n] for f, (_, places) in zip(files, indexes) for a, n in places])
        at = 0
        for k, (ms, places) in enumerate(indexes):
            yield start + k, files[k], ms, np.stack(samples[at : at + len(places)]) if places else np.zeros((0, FRAME), np.uint8)
            at += len(places)
        start, held = i + 1, 0


def clips(media: DataFrame) -> DataFrame:
    """doc_id, clip, start_ms, end_ms, n_frames: the shots of each file."""

    def run(batches):
        for batch in batches:
            rows = []
            names = batch.column("doc_id").to_pylist()
            for k, _, ms, frames in decoded(batch):
                cuts = [*cuts_of(frames), len(frames)]
                rows += [(names[k], i, a * ms, b * ms, b - a) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)], ["doc_id", "clip", "start_ms", "end_ms", "n_frames"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, clip long, start_ms long, end_ms long, n_frames long")


def media_digests(media: DataFrame) -> DataFrame:
    """What the stored files give when read back: sizes, digests, and the clips' times as ``feature``."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        for batch in batches:
            rows = []
            for _, file, ms, frames in decoded(batch):
                payload = frames.tobytes()
                cuts = [*cuts_of(frames), len(frames)]
                feature = ",".join(f"{a * ms}-{b * ms}" for a, b in zip(cuts, cuts[1:]))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *cols], [f.split()[0] for f in schema.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
