"""Media columns: AVI files of motion-JPEG frames as binary columns.

``encode`` stores a text's bytes, padded with zeros to a multiple of 64, as
the samples of a grey film: 64 samples a row, up to 64 rows a frame, each
frame a lossless JPEG (SOF3, predictor 1, one restart interval a row), in a
RIFF file with an ``idx1`` index. ``frames`` goes the way back: it walks the
RIFF chunks, finds the frames by the index, decodes them and cuts the padding
off. All rows of all frames of a batch are decoded in step with each other,
so the loop is as long as a row and not as the data. ``clips`` finds shots
where the histogram changes by more than the film's usual changes.

Defined results: null and empty texts are one row of 64 zeros. Rows with a
null id, repeated rows and rows of any length are treated like all others.
``encode`` keeps only doc_id and text's form, so other columns never clash. A
null or malformed film gives no clips and a null payload.
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

from .common import text_chunks

WIDTH = 64
HEIGHT = 64
#: Frames per second of the films that encode() writes.
RATE = 25
#: Bins of a frame's histogram.
BINS = 32
#: A shot ends where the change exceeds the mean of the last changes by so many standard deviations, and this floor.
DEVIATIONS = 3.0
MEMORY = 24
FLOOR = 0.12

#: Code lengths of the difference categories 0 to 8, for bytes of prose (the code of ones alone stays free).
CODE_LENGTHS = {4: 2, 7: 2, 2: 3, 3: 3, 0: 4, 1: 4, 5: 4, 6: 5, 8: 6}


def _canonical(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) by the rule of JPEG's annex C."""
    out, code, k = [], 0, 0
    for length, count in enumerate(counts, 1):
        for _ in range(count):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _dht() -> bytes:
    order = sorted(CODE_LENGTHS, key=lambda c: (CODE_LENGTHS[c], c))
    counts = bytes(sum(n == length for n in CODE_LENGTHS.values()) for length in range(1, 17))
    return counts + bytes(order)


def _encode_table() -> tuple[np.ndarray, np.ndarray]:
    """(bits, their count) of each difference from -255 to 255, at index difference + 255."""
    bits, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    codes = {s: (c, n) for s, c, n in _canonical(_dht()[:16], _dht()[16:])}
    for d in range(-255, 256):
        k = abs(d).bit_length()
        code, n = codes[k]
        extra = d if d >= 0 else d + (1 << k) - 1
        bits[d + 255], sizes[d + 255] = code << k | extra, n + k
    return bits, sizes


def _decode_table(dht: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(difference, bits used) for each 16-bit window; 0 bits where no code fits."""
    value, used = np.zeros(1 << 16, np.int16), np.zeros(1 << 16, np.int64)
    for symbol, code, n in _canonical(dht[:16], dht[16:]):
        if n + symbol > 16:
            raise ValueError("a code and its difference exceed 16 bits")
        extra = np.arange(1 << symbol)
        diff = np.where(extra >= (1 << symbol) >> 1, extra, extra - (1 << symbol) + 1) if symbol else extra
        spare = 16 - n - symbol
        at = (code << (16 - n)) + np.arange(1 << (16 - n))
        value[at], used[at] = np.repeat(diff, 1 << spare), n + symbol
    return value, used


_BITS, _SIZES = _encode_table()
_HEAD = b"\xff\xd8\xff\xc4" + struct.pack(">HB", 3 + len(_dht()), 0) + _dht()
_SCAN = b"\xff\xdd" + struct.pack(">HH", 4, WIDTH) + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)


def _packed_rows(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of rows of samples, each row filled up with ones; and the rows' first bytes."""
    d = np.empty((len(samples), WIDTH), np.int64)
    d[:, 0] = samples[:, 0].astype(np.int64) - 128 + 255
    d[:, 1:] = np.diff(samples.astype(np.int16), axis=1) + 255
    size = np.empty((len(d), WIDTH + 1), np.int64)
    bits = np.empty((len(d), WIDTH + 1), np.uint32)
    size[:, :-1], bits[:, :-1] = _SIZES[d], _BITS[d]
    last = -size[:, :-1].sum(axis=1) % 8
    size[:, -1], bits[:, -1] = last, (1 << last) - 1
    size, bits = size.ravel(), bits.ravel()
    ends = np.cumsum(size)
    at = ends - size
    byte = at >> 3
    window = bits << (24 - size - (at & 7)).astype(np.uint32)
    total = int(ends[-1] >> 3)
    out = np.zeros(total + 3, np.uint8)
    for k, shift in enumerate((16, 8, 0)):
        out += np.bincount(byte + k, weights=(window >> np.uint32(shift)) & np.uint32(255), minlength=total + 3)[: total + 3].astype(np.uint8)
    return out[:total], np.r_[0, ends[WIDTH :: WIDTH + 1] >> 3]


def _frame_bytes(samples: np.ndarray, heights: np.ndarray) -> list[bytes]:
    """A lossless JPEG for each run of ``heights`` rows."""
    packed, starts = _packed_rows(samples)
    ff = packed == 0xFF
    before = np.r_[0, np.cumsum(ff)]
    sizes = np.diff(starts) + np.diff(before[starts]) + 2  # each row with its marker
    base = np.r_[0, np.cumsum(sizes)]
    row = np.repeat(np.arange(len(samples)), np.diff(starts))
    out = np.zeros(base[-1], np.uint8)
    out[np.arange(len(packed)) + before[:-1] + 2 * row] = packed
    first = np.r_[0, np.cumsum(heights)]
    number = np.arange(len(samples)) - np.repeat(first[:-1], heights)
    out[base[1:] - 2], out[base[1:] - 1] = 0xFF, 0xD0 + number % 8
    out[base[first[1:]] - 1] = 0xD9
    data = out.tobytes()
    head = {h: _HEAD + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, h, WIDTH, 1, 1, 0x11, 0) + _SCAN for h in set(heights.tolist())}
    cuts = base[first].tolist()
    return [head[h] + data[cuts[i] : cuts[i + 1]] for i, h in enumerate(heights.tolist())]


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def avi(frames: list[bytes], height: int, payload: int) -> bytes:
    """A RIFF AVI file of JPEG frames; the INFO comment says how many samples count."""
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(frames), 0, 1, largest, WIDTH, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    head = b"LIST" + struct.pack("<I", 4 + 8 + len(avih) + 12 + 8 + len(strh) + 8 + len(strf)) + b"hdrl" + _chunk(b"avih", avih)
    head += b"LIST" + struct.pack("<I", 4 + 8 + len(strh) + 8 + len(strf)) + b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)
    info = b"INFO" + _chunk(b"ICMT", b"%d\0" % payload)
    head += _chunk(b"LIST", info)
    body, index, at = [], [], 4
    for f in frames:
        body.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(body[-1])
    movi = b"movi" + b"".join(body)
    data = b"AVI " + head + _chunk(b"LIST", movi) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", data)


def encode_chunk(data: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """A film for each text of a chunk."""
    n = np.diff(offs)
    rows = np.maximum(-(-n // WIDTH), 1)
    high = np.minimum(rows, HEIGHT)
    counts = -(-rows // high)
    first = np.r_[0, np.cumsum(counts * high)]
    samples = np.zeros(first[-1] * WIDTH, np.uint8)
    samples[np.arange(len(data)) + np.repeat(first[:-1] * WIDTH - offs[:-1], n)] = data
    frames = _frame_bytes(samples.reshape(-1, WIDTH), np.repeat(high, counts))
    cuts = np.r_[0, np.cumsum(counts)].tolist()
    return [avi(frames[cuts[i] : cuts[i + 1]], int(high[i]), int(rows[i]) * WIDTH) for i in range(len(n))]


def encode(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop, data, offs in text_chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, stop - first), pa.array(np.diff(offs)), pa.array(encode_chunk(data, offs), pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


# --- reading --------------------------------------------------------------------------


def riff(media: bytes) -> tuple[int, list[tuple[int, int]]]:
    """(samples that count, or -1; places of the frames in order) by the file's chunks and index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    at, end, payload, movi, index = 12, 8 + struct.unpack_from("<I", media, 4)[0], -1, -1, None
    while at + 8 <= end:
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        kind = media[at + 8 : at + 12] if name == b"LIST" else b""
        if kind == b"movi":
            movi = at + 8
        elif kind == b"INFO" and media[at + 12 : at + 16] == b"ICMT":
            payload = int(media[at + 20 : at + 20 + struct.unpack_from("<I", media, at + 16)[0]].rstrip(b"\0"))
        elif name == b"idx1":
            index = media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi < 0 or index is None:
        raise ValueError("no frames or no index")
    places = [(movi + offset + 8, size) for tag, _, offset, size in struct.iter_unpack("<4sIII", index) if tag[2:] in (b"dc", b"db")]
    return payload, places


def _jpeg(media: bytes, at: int, size: int) -> tuple[bytes, int, int, int, int]:
    """(Huffman table, height, width, first and last place of the scan) of a frame."""
    end, dht, high, wide = at + size, b"", 0, 0
    at += 2
    while at < end:
        mark, n = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
        if mark == 0xC4:
            dht = media[at + 5 : at + 2 + n]
        elif mark == 0xC3:
            high, wide = struct.unpack_from(">HH", media, at + 5)
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise ValueError("no lossless frame")
        elif mark == 0xDA:
            return dht, high, wide, at + 2 + n, end
        at += 2 + n
    raise ValueError("no scan")


def _decoded(scans: bytes, dht: bytes, wide: int, rows: int) -> np.ndarray:
    """The samples of the rows of scans laid end to end, each with its last marker."""
    raw = np.frombuffer(scans, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    keep = np.ones(len(raw), bool)
    keep[ff + 1] = False
    keep[ff[after != 0]] = False
    ends = ff[after != 0]
    place = np.r_[0, np.cumsum(keep)]
    body = np.r_[raw[keep], np.full(4, 255, np.uint8)]
    starts = np.r_[0, place[ends]][:-1]
    if len(starts) != rows:
        raise ValueError("rows and markers don't agree")
    value, used = _decode_table_of(dht)
    wide24 = (body[:-2].astype(np.uint32) << 16) | (body[1:-1].astype(np.uint32) << 8) | body[2:]
    limit = np.int64(len(wide24) - 1)
    out = np.empty((wide, rows), np.uint8)
    bit, prior = starts * 8, np.full(rows, 128, np.int16)
    for k in range(wide):
        window = (wide24[np.minimum(bit >> 3, limit)] >> (8 - (bit & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        prior = (prior + value[window]) & 255
        bit += used[window]
        out[k] = prior
    return out.T


_tables: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _decode_table_of(dht: bytes) -> tuple[np.ndarray, np.ndarray]:
    if dht not in _tables:
        if len(_tables) > 64:
            _tables.clear()
        _tables[dht] = _decode_table(dht)
    return _tables[dht]


def decode_films(films: list[bytes | None]) -> list[tuple[np.ndarray, list[int]] | None]:
    """(samples that count, samples of each frame) of each film; None where a film is null or can't be read."""
    groups: dict[tuple[bytes, int], list[tuple[int, int, bytes, int]]] = {}
    heads: list[int | None] = []
    for i, media in enumerate(films):
        try:
            payload, places = riff(media or b"")
            parts = [_jpeg(media, at, size) for at, size in places]
        except (ValueError, struct.error, IndexError):
            heads.append(None)
            continue
        heads.append(payload)
        for k, (dht, high, wide, start, end) in enumerate(parts):
            groups.setdefault((dht, wide), []).append((i, k, media[start:end], high))
    got: list[dict[int, np.ndarray]] = [{} for _ in films]
    for (dht, wide), parts in groups.items():
        try:
            rows = _decoded(b"".join(p[2] for p in parts), dht, wide, sum(p[3] for p in parts))
        except ValueError:  # one film is broken: each on its own
            for i, k, scan, high in parts:
                try:
                    got[i][k] = _decoded(scan, dht, wide, high).ravel()
                except ValueError:
                    heads[i] = None
            continue
        at = 0
        for i, k, _, high in parts:
            got[i][k] = rows[at : at + high].ravel()
            at += high
    out: list[tuple[np.ndarray, list[int]] | None] = []
    for head, by in zip(heads, got, strict=True):
        if head is None:
            out.append(None)
            continue
        samples = [by[k] for k in sorted(by)]
        whole = np.concatenate(samples) if samples else np.zeros(0, np.uint8)
        out.append((whole[:head] if head >= 0 else whole, [len(s) for s in samples]))
    return out


def shots(samples: np.ndarray, sizes: list[int]) -> list[tuple[int, int]]:
    """(first, last) frame of each shot: a cut is a change of histogram above what the shot's last changes let expect."""
    if not sizes:
        return []
    hist = np.zeros((len(sizes), BINS))
    at = 0
    for i, n in enumerate(sizes):
        part = samples[at : at + n]
        hist[i] = np.bincount(part >> 3, minlength=BINS) / max(len(part), 1)
        at += n
    change = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts, since = [0], 0
    for i, c in enumerate(change.tolist()):
        past = change[max(since, i - MEMORY) : i]
        most = max(FLOOR, float(past.mean() + DEVIATIONS * past.std())) if len(past) else 2 * FLOOR
        if c > most:
            cuts.append(i + 1)
            since = i + 1
    return [(a, b - 1) for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True)]


def _films(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, list[bytes | None]]]:
    """(first row, films) in runs of about ``limit`` bytes."""
    run, size, first = [], 0, 0
    for i, x in enumerate(column):
        run.append(x.as_py())
        size += len(run[-1] or b"")
        if size >= limit:
            yield first, run
            run, size, first = [], 0, i + 1
    if run:
        yield first, run


def clips(media: DataFrame) -> DataFrame:
    """Timed clip rows (doc_id, clip, first_frame, last_frame, start_ms, end_ms) of films (doc_id, media)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for first, films in _films(batch.column("media")):
                rows = [(ids[first + i], k, a, b, a * 1000 // RATE, (b + 1) * 1000 // RATE) for i, film in enumerate(decode_films(films)) if film for k, (a, b) in enumerate(shots(*film))]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(6)], ["doc_id", "clip", "first_frame", "last_frame", "start_ms", "end_ms"])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(run, "doc_id long, clip long, first_frame long, last_frame long, start_ms long, end_ms long")


def digests(media: DataFrame) -> DataFrame:
    """Per film (doc_id, n_bytes, media): sizes and hashes of the file and of what decoding it gives, and its shots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, films in _films(batch.column("media")):
                rows = []
                for media, film in zip(films, decode_films(films), strict=True):
                    if film is None:
                        rows.append((None, None, None, len(media) if media is not None else None, hashlib.sha256(media).hexdigest() if media is not None else None, None))
                        continue
                    data = film[0].tobytes()
                    cut = ",".join(f"{a}-{b}" for a, b in shots(*film))
                    rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={len(film[1])};shots={cut}"))
                k = len(rows)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, k), batch.column("n_bytes").slice(first, k), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
