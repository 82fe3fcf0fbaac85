"""Media columns: AVI files of lossless motion JPEG, their index, their frames and their shots.

Bytes become 8-bit samples in rows of 64 and frames of at most 32 rows. Each frame is a lossless
JPEG (SOF3, predictor 1, one Huffman table, a restart marker after each row), each file a RIFF
AVI with an ``idx1`` index. Reading goes the other way: the index names the frames, the frames
are decoded, and shots are cut where the difference between the histograms of neighbouring
frames exceeds a threshold that adapts to the differences seen before. Rows of many frames are
coded side by side with numpy, in blocks of ``BLOCK`` frames, so that memory is bounded however
long a payload is.

Defined results: a null payload counts as empty; a payload is followed by zero bytes up to a
positive multiple of 64. Equal payloads give equal files. A file without an index or with a
frame of another kind raises ``ValueError``. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, named

WIDTH, ROWS, BLOCK, FPS = 64, 32, 512, 25
#: Code length of each difference category, 0 to 8; the all-ones code stays free.
LENGTHS = {1: 3, 2: 3, 3: 3, 4: 3, 5: 3, 6: 3, 7: 3, 0: 4, 8: 5}
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
CLIPS = "doc_id long, clip long, first_frame long, frames long, start_s double, end_s double, mean_level double"


def canonical(lengths: list[int], values: list[int]) -> dict[int, tuple[int, int]]:
    """value: (code, length), from counts of codes by length and values in order."""
    codes, code, at = {}, 0, 0
    for n, many in enumerate(lengths, 1):
        for _ in range(many):
            codes[values[at]] = (code, n)
            code, at = code + 1, at + 1
        code <<= 1
    return codes


VALUES = sorted(LENGTHS, key=lambda v: (LENGTHS[v], v))
COUNTS = [sum(n == k for n in LENGTHS.values()) for k in range(1, 17)]
CODES = canonical(COUNTS, VALUES)
CATEGORY = np.array([0 if d == 0 else abs(d).bit_length() for d in range(-255, 256)])
CODE = np.array([CODES[c][0] for c in range(9)])
CODE_LENGTH = np.array([CODES[c][1] for c in range(9)])


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_header(rows: int) -> bytes:
    return (
        b"\xff\xd8"
        + segment(0xC4, bytes([0, *COUNTS, *VALUES]))
        + segment(0xC3, struct.pack(">BHHBBBB", 8, rows, WIDTH, 1, 1, 0x11, 0))
        + segment(0xDD, struct.pack(">H", WIDTH))
        + segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
    )


HEADERS = {rows: frame_header(rows) for rows in range(1, ROWS + 1)}


def encode_frames(frames: list[np.ndarray]) -> list[bytes]:
    """Lossless JPEGs of arrays of samples (rows x 64)."""
    heights = np.array([len(f) for f in frames])
    x = np.concatenate(frames).astype(np.int16)
    n = len(x)
    diff = np.diff(x, axis=1, prepend=np.int16(128))
    cat = CATEGORY[diff + 255]
    bits = CODE_LENGTH[cat] + cat
    extra = np.where(diff < 0, diff + (1 << cat) - 1, diff)
    word = (CODE[cat] << cat) | extra
    at = np.cumsum(bits, axis=1)
    total = at[:, -1].copy()
    at -= bits
    room = int(total.max() + 7) // 8 + 5
    out = np.zeros((n, room), np.uint8)
    line = np.arange(n)
    for j in range(WIDTH):
        k, p = at[:, j] >> 3, at[:, j] & 7
        v = word[:, j] << (24 - bits[:, j] - p)
        out[line, k] |= (v >> 16).astype(np.uint8)
        out[line, k + 1] |= (v >> 8 & 255).astype(np.uint8)
        out[line, k + 2] |= (v & 255).astype(np.uint8)
    size = (total + 7) >> 3
    out[line, size - 1] |= ((1 << (-total & 7)) - 1).astype(np.uint8)  # filled up with ones
    last = np.cumsum(heights) - 1
    within = line - np.repeat(last + 1 - heights, heights)
    mark = 0xD0 + within % 8
    mark[last] = 0xD9
    column = np.arange(room)
    stuffed = (out == 255) & (column < size[:, None])
    out[line, size], out[line, size + 1] = 255, mark
    valid = column < size[:, None] + 2
    step = 1 + stuffed[valid]
    ends = np.cumsum(step)
    flat = np.zeros(int(ends[-1]), np.uint8)
    flat[ends - step] = out[valid]
    line_end = ends[np.cumsum(size + 2) - 1]
    data, starts = flat.tobytes(), np.concatenate([[0], line_end[last][:-1]])
    return [HEADERS[int(h)] + data[a:b] for h, a, b in zip(heights, starts.tolist(), line_end[last].tolist(), strict=True)]


def frame_parts(jpeg: bytes) -> tuple[int, dict[int, tuple[int, int]], bytes]:
    """Rows, code table and entropy-coded data of one frame."""
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, rows, codes = 2, 0, {}
    while True:
        mark, size = jpeg[at + 1], int.from_bytes(jpeg[at + 2 : at + 4], "big")
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xC4:
            codes = canonical(list(body[1:17]), list(body[17:]))
        elif mark == 0xC3:
            precision, rows, width, parts = struct.unpack(">BHHB", body[:6])
            if (precision, width, parts) != (8, WIDTH, 1):
                raise ValueError("not a frame of 64 8-bit samples a row")
        elif 0xC0 <= mark <= 0xCF:
            raise ValueError("not a lossless Huffman frame")
        elif mark == 0xDA:
            return rows, codes, jpeg[at:]


def decode_frames(jpegs: list[bytes]) -> list[np.ndarray]:
    """The samples of each frame, rows x 64."""
    parts = [frame_parts(j) for j in jpegs]
    table = np.zeros(1 << 8, np.int64)  # category and code length by the next 8 bits
    for c, (code, n) in parts[0][1].items():
        table[code << (8 - n) : (code + 1) << (8 - n)] = c << 8 | n
    if any(p[1] != parts[0][1] for p in parts):
        return [f for j in jpegs for f in decode_frames([j])]
    flat = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    escape = np.flatnonzero(flat[:-1] == 255)
    after = flat[escape + 1]
    marks = escape[after != 0]
    keep = np.ones(len(flat), bool)
    keep[escape[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    data = flat[keep]
    ends = np.cumsum(keep)[marks]
    size = np.diff(ends, prepend=0)
    n, room = len(ends), int(size.max()) + 4
    lines = np.zeros((n, room), np.int64)
    own = np.repeat(np.arange(n), size)
    lines[own, np.arange(len(data)) - np.repeat(ends - size, size)] = data
    line, at, left = np.arange(n), np.zeros(n, np.int64), np.full(n, 128, np.int64)
    out = np.zeros((n, WIDTH), np.uint8)
    for j in range(WIDTH):
        k = at >> 3
        window = (lines[line, k] << 16 | lines[line, k + 1] << 8 | lines[line, k + 2]) << (at & 7) & 0xFFFFFF
        found = table[window >> 16]
        cat, length = found >> 8, found & 255
        extra = (window >> (24 - length - cat)) & ((1 << cat) - 1)
        left = left + np.where((cat > 0) & (extra < 1 << np.maximum(cat - 1, 0)), extra - (1 << cat) + 1, extra)
        out[:, j] = left
        at += length + cat
    cuts = np.cumsum([p[0] for p in parts])
    if cuts[-1] != n:
        raise ValueError("rows are missing")
    return np.split(out, cuts[:-1])


def blockwise(work, items: list) -> list:
    return [x for i in range(0, len(items), BLOCK) for x in work(items[i : i + BLOCK])]


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(frames: list[bytes]) -> bytes:
    """A RIFF AVI file of motion-JPEG frames, with its index."""
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, len(frames), 0, 1, largest, WIDTH, ROWS, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, ROWS)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, ROWS, 1, 8, b"MJPG", WIDTH * ROWS, 0, 0, 0, 0)
    header = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    movi, index, at = [b"movi"], [], 4
    for f in frames:
        body = chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        movi.append(body)
        at += len(body)
    return chunk(b"RIFF", b"AVI " + header + chunk(b"LIST", b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def read_index(avi: bytes) -> list[bytes]:
    """The frames that the index names, in its order."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, index = 12, None, None
    while at + 8 <= len(avi):
        name, size = avi[at : at + 4], int.from_bytes(avi[at + 4 : at + 8], "little")
        if name == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = avi[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("no frames or no index")
    entries = (struct.unpack("<4sIII", index[k : k + 16]) for k in range(0, len(index), 16))
    return [avi[movi + start + 8 : movi + start + 8 + size] for name, _, start, size in entries if name[2:] in (b"dc", b"db")]


def shots(frames: list[np.ndarray], floor: float = 0.25, spread: float = 2.0) -> list[tuple[int, int, float]]:
    """(first frame, frames, mean level) of each shot.

    A shot begins where two frames' histograms differ by more than the mean and ``spread``
    standard deviations of the differences since the last cut, and by ``floor`` at least.
    """
    sizes = np.array([f.size for f in frames])
    owner = np.repeat(np.arange(len(frames)), sizes)
    values = np.concatenate([f.ravel() for f in frames])
    level = np.bincount(owner, values, len(frames)) / sizes
    cuts = [0]
    if len(frames) > 1:
        bins = np.bincount(owner * 32 + (values >> 3), minlength=32 * len(frames)).reshape(-1, 32) / sizes[:, None]
        change = np.abs(np.diff(bins, axis=0)).sum(1) / 2
        for k, d in enumerate(change.tolist(), 1):
            seen = change[cuts[-1] : k - 1]
            if d > floor and (not len(seen) or d > seen.mean() + spread * seen.std()):
                cuts.append(k)
    ends = [*cuts[1:], len(frames)]
    return [(a, b - a, float(level[a:b].mean())) for a, b in zip(cuts, ends, strict=True)]


def payload_of(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % 64 or (0 if data else 64))


def split_frames(payload: bytes) -> list[np.ndarray]:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return [rows[k : k + ROWS] for k in range(0, len(rows), ROWS)]


def grouped(items: list, counts: list[int]) -> list[list]:
    ends = np.cumsum(counts).tolist()
    return [items[b - n : b] for b, n in zip(ends, counts, strict=True)]


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    frames = [split_frames(p) for p in payloads]
    coded = blockwise(encode_frames, [f for own in frames for f in own])
    return [write_avi(own) for own in grouped(coded, [len(own) for own in frames])]


def decode_files(files: list[bytes]) -> list[list[np.ndarray]]:
    coded = [read_index(f) for f in files]
    frames = blockwise(decode_frames, [j for own in coded for j in own])
    return grouped(frames, [len(own) for own in coded])


def by_size(sizes: list[int], most: int = BLOCK * ROWS * WIDTH) -> Iterator[slice]:
    """Slices of neighbouring items, each of about ``most`` bytes or one item."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield slice(start, k)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and media: the text's bytes as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [payload_of(x or b"") for x in batch.column("data").to_pylist()]
            for s in by_size([len(x) for x in data]):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[s], pa.array(encode_payloads(data[s]), pa.binary())], ["doc_id", "media"])

    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("data"))
    return rows.mapInArrow(run, "doc_id long, media binary")


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each shot of each file: clip, first_frame, frames, start_s, end_s, mean_level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, files = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for s in by_size([len(x or b"") for x in files]):
                some = [(i, f) for i, f in zip(ids[s], files[s], strict=True) if f is not None]
                frames = decode_files([f for _, f in some])
                rows = [(i, k, a, n, a / FPS, (a + n) / FPS, m) for (i, _), own in zip(some, frames, strict=True) for k, (a, n, m) in enumerate(shots(own))]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 4 else pa.float64()) for k, c in enumerate(columns)], [x.split()[0] for x in CLIPS.split(", ")])

    return media.select(named(id_col).alias("doc_id"), named(media_col).alias("media")).mapInArrow(run, CLIPS)


def feature(own: list[tuple[int, int, float]]) -> str:
    return f"{sum(n for _, n, _ in own)} frames;" + ";".join(f"{a / FPS:.2f}-{(a + n) / FPS:.2f}s@{m:.3f}" for a, n, m in own)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a file, reads it back and digests both; see DIGEST for the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = batch.column("doc_id").to_pylist(), [x or b"" for x in batch.column("data").to_pylist()]
            for s in by_size([len(x) for x in data]):
                files = encode_payloads([payload_of(x) for x in data[s]])
                rows = []
                for i, x, f, frames in zip(ids[s], data[s], files, decode_files(files), strict=True):
                    back = b"".join(a.tobytes() for a in frames)
                    rows.append((i, len(x), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(f), hashlib.sha256(f).hexdigest(), feature(shots(frames))))
                kinds = [pa.string() if k in (3, 6, 7) else pa.int64() for k in range(8)]
                arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in DIGEST.split(", ")])

    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("data"))
    return rows.mapInArrow(run, DIGEST)
