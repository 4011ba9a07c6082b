"""GIF: LZW code streams, palettes, disposal, transparency; timed frames with colour histograms."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import sliced

#: Samples a row, rows and time of a frame, the sample that no UTF-8 text has, codes of a full table.
WIDTH, MAX_ROWS, DELAY_MS, CLEAR, FULL = 192, 256, 40, 255, 4096
GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def _widths(count: int, depth: int) -> np.ndarray:
    """Bits of each of the codes after a clear: one more from the code on that the table has outgrown."""
    table = (1 << depth) + 2 + np.maximum(np.arange(count), 1) - 1  # entries that a reader has when it meets the code
    width = np.ceil(np.log2(np.maximum(table + 1, 2))).astype(np.int64)
    return np.clip(width, depth + 1, 12)


_WIDTHS = {d: _widths(FULL + 2, d) for d in range(2, 9)}
_STARTS = {d: np.concatenate([[0], np.cumsum(w)]) for d, w in _WIDTHS.items()}


def lzw_encode(data: bytes, depth: int = 8) -> bytes:
    """The code stream of data (samples under 2^depth); the table is cleared whenever it's full."""
    clear, end = 1 << depth, (1 << depth) + 1
    codes: list[int] = [clear]
    resets = [0]
    table: dict[int, int] = {}
    get, add = table.get, codes.append
    fresh = end + 1
    it = iter(data)
    prefix = next(it, None)
    if prefix is None:
        add(end)
    else:
        for c in it:
            key = (prefix << 8) | c
            known = get(key)
            if known is not None:
                prefix = known
            else:
                add(prefix)
                table[key] = fresh
                fresh += 1
                prefix = c
                if fresh == FULL:
                    resets.append(len(codes))
                    add(clear)
                    table.clear()
                    fresh = end + 1
        add(prefix)
        add(end)
    return _pack(codes, resets, depth)


def _pack(codes: list[int], resets: list[int], depth: int) -> bytes:
    values = np.array(codes, np.uint32)
    widths = np.empty(len(values), np.int64)
    table = _WIDTHS[depth]
    for i, r in enumerate(resets):
        nxt = resets[i + 1] + 1 if i + 1 < len(resets) else len(values)
        if i == 0:
            widths[0] = depth + 1
        widths[r + 1 : nxt] = table[: nxt - r - 1]
    at = np.cumsum(widths) - widths
    bits = int(at[-1] + widths[-1])
    out = np.zeros(bits // 8 + 4, np.uint32)
    word, shifted = at >> 3, values.astype(np.uint32) << (at & 7).astype(np.uint32)
    for k in range(3):
        out += np.bincount(word + k, weights=((shifted >> np.uint32(8 * k)) & np.uint32(255)).astype(np.float64), minlength=len(out))[: len(out)].astype(np.uint32)
    return out[: -(-bits // 8)].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, depth: int, most: int | None = None) -> bytes:
    """The samples of a code stream. It may clear at any code or never, and may lack its end code."""
    clear, end = 1 << depth, (1 << depth) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    starts, widths, bits = _STARTS[depth], _WIDTHS[depth], len(stream) * 8
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    size, at = 0, 0
    while at < bits:
        # A run of codes up to the next clear: their widths depend on their number alone.
        n = int(np.searchsorted(starts, bits - at, side="right")) - 1
        n = min(n, len(widths))
        tail = 0
        if n == len(widths):  # a table that stays full: 12 bits a code from there on
            tail = (bits - at - int(starts[n])) // 12
        pos = at + np.concatenate([starts[:n], starts[n] + 12 * np.arange(tail)]) if tail else at + starts[:n]
        wid = np.concatenate([widths[:n], np.full(tail, 12)]) if tail else widths[:n]
        if len(pos) == 0:
            break
        w = pos >> 3
        codes = ((raw[w] | (raw[w + 1] << np.uint32(8)) | (raw[w + 2] << np.uint32(16))) >> (pos & 7).astype(np.uint32)) & ((np.uint32(1) << wid.astype(np.uint32)) - np.uint32(1))
        stop = np.flatnonzero((codes == clear) | (codes == end))
        length = int(stop[0]) if len(stop) else len(codes)
        table = roots.copy()
        grow, put = table.append, out.append
        prev = b""
        for c in codes[:length].tolist():
            if c < len(table):
                entry = table[c]
                if prev and len(table) < FULL:
                    grow(prev + entry[:1])
            elif c == len(table) and prev and c < FULL:
                entry = prev + prev[:1]
                grow(entry)
            else:
                raise ValueError("GIF code outside its table")
            put(entry)
            size += len(entry)
            prev = entry
        if most is not None and size >= most or not len(stop) or codes[length] == end:
            break
        at = int(pos[length] + wid[length])
    return b"".join(out)[:most]


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    disposal: int
    transparent: int | None
    palette: np.ndarray
    samples: np.ndarray


def write_gif(frames: list[tuple[bytes, int]], width: int, height: int, palette: bytes = GREY, delays: list[int] | None = None, extras: list[dict] | None = None, loop: bool = True) -> bytes:
    """A GIF89a of frames (samples, rows) of full width; extras: left, top, width, disposal, transparent of a frame."""
    bits = max(1, (len(palette) // 3 - 1).bit_length())
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | (bits - 1), 0, 0), palette.ljust(3 << bits, b"\0")]
    if loop and len(frames) > 1:
        parts.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    depth = max(2, bits)
    for i, (samples, rows) in enumerate(frames):
        x = (extras or [{}] * len(frames))[i]
        t = x.get("transparent")
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHBB", (x.get("disposal", 1) << 2) | (t is not None), (delays or [10] * len(frames))[i], t or 0, 0))
        parts.append(b"\x2c" + struct.pack("<HHHHB", x.get("left", 0), x.get("top", 0), x.get("width", width), rows, 0) + bytes([depth]))
        stream = lzw_encode(samples, depth)
        parts += [bytes([len(b := stream[k : k + 255])]) + b for k in range(0, len(stream), 255)]
        parts.append(b"\0")
    return b"".join(parts) + b"\x3b"


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def read_gif(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width, height and frames as stored (rows in order, interlacing undone)."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", data[6:11])
    at, shared = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        shared = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
    frames, delay, disposal, clear = [], 0, 0, None
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, at = _blocks(data, at + 2)
            if kind == 0xF9 and len(body) >= 4:
                disposal, delay, clear = (body[0] >> 2) & 7, struct.unpack("<H", body[1:3])[0] * 10, body[3] if body[0] & 1 else None
        elif data[at] == 0x2C:
            left, top, w, h, f = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at, palette = at + 10, shared
            if f & 0x80:
                n = 3 << ((f & 7) + 1)
                palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
                at += n
            depth = data[at]
            stream, at = _blocks(data, at + 1)
            samples = np.frombuffer(lzw_decode(stream, depth, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if f & 0x40:
                order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
                samples = samples[np.argsort(order, kind="stable")]
            frames.append(Frame(left, top, w, h, delay, disposal, clear, palette if palette is not None else np.frombuffer(GREY, np.uint8).reshape(-1, 3), samples))
            delay, disposal, clear = 0, 0, None
        else:
            raise ValueError("GIF block of an unknown kind")
    return width, height, frames


def composed(width: int, height: int, frames: list[Frame]) -> Iterator[np.ndarray]:
    """The RGBA canvas as shown for each frame (until the next is asked for): transparent samples leave it as it was;
    disposal 2 clears a frame's area afterwards, 3 puts back what was there before."""
    canvas = np.zeros((height, width, 4), np.uint8)
    for f in frames:
        area = canvas[f.top : f.top + f.height, f.left : f.left + f.width]
        kept = area.copy() if f.disposal == 3 else None
        s = f.samples[: area.shape[0], : area.shape[1]]
        colours = np.full((256, 4), 255, np.uint8)
        colours[:, :3] = f.palette[np.minimum(np.arange(256), len(f.palette) - 1)]
        if f.transparent is None:
            area[:] = colours[s]
        else:
            drawn = s != f.transparent
            area[drawn] = colours[s[drawn]]
        yield canvas
        if f.disposal == 2:
            area[:] = 0
        elif kept is not None:
            area[:] = kept


def histogram(rgb: np.ndarray) -> np.ndarray:
    """Counts of 64 colours: two bits of each channel."""
    q = rgb.reshape(-1, rgb.shape[-1])[:, :3] >> 6
    return np.bincount((q[:, 0].astype(np.int64) << 4) | (q[:, 1] << 2) | q[:, 2], minlength=64)


def encode_payload(payload: bytes) -> bytes:
    """payload (a multiple of WIDTH bytes) as grey samples, in timed frames of at most MAX_ROWS rows on one canvas.

    A frame stays (disposal 1), and a sample that is on the canvas already is left out of the next frame as transparent;
    a payload that has the byte CLEAR goes without. After every eighth frame the canvas is cleared (disposal 2), so the
    frame that follows is whole again and a reader can begin there.
    """
    step = WIDTH * MAX_ROWS
    frames, extras, shown = [], [], None
    free = bytes([CLEAR]) not in payload
    for i in range(0, len(payload), step):
        part = payload[i : i + step]
        x: dict = {"disposal": 2 if len(frames) % 8 == 7 else 1}
        if free and shown is not None:
            own = np.frombuffer(part, np.uint8)
            x["transparent"] = CLEAR
            frames.append((np.where(own == shown[: len(own)], CLEAR, own).astype(np.uint8).tobytes(), len(part) // WIDTH))
        else:
            frames.append((part, len(part) // WIDTH))
        # Later frames aren't taller, so what they cover is this one's part of the canvas.
        shown = np.frombuffer(part, np.uint8) if x["disposal"] == 1 else None
        extras.append(x)
    return write_gif(frames, WIDTH, frames[0][1], delays=[DELAY_MS // 10] * len(frames), extras=extras)


def decode_payload(media: bytes) -> tuple[bytes, str]:
    """The payload of encode_payload, read off the composed canvas frame by frame, and a feature: frames, milliseconds
    in all, then counts of 16 grey levels of what each frame shows where it's drawn."""
    width, height, frames = read_gif(media)
    levels, parts, ms = np.zeros(16, np.int64), [], 0
    for f, canvas in zip(frames, composed(width, height, frames), strict=True):
        grey = canvas[f.top : f.top + f.height, f.left : f.left + f.width, 0].tobytes()
        levels += np.bincount(np.frombuffer(grey, np.uint8) >> 4, minlength=16)
        parts.append(grey)
        ms += f.delay_ms
    return b"".join(parts), f"{len(frames)}f:{ms}ms:" + ",".join(map(str, levels.tolist()))


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _media_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in MEDIA.split(", ")]
    for batch in sliced(batches):
        out, last = [], (None, None)
        for t in batch.column(1).to_pylist():
            t = t or ""
            if t != last[0]:
                raw = t.encode("utf-8", "surrogatepass")
                media = encode_payload(raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b" "))
                payload, feature = decode_payload(media)
                last = (t, (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            out.append(last[1])
        cols = [pa.array(c, pa.string() if isinstance(c[0], str) else pa.int64()) for c in zip(*out, strict=True)] if out else []
        if out:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], names=names)


def media_digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text (null: empty), padded with blanks to a positive multiple of 192 bytes, as a GIF and reads it back.

    Reading goes through code streams, palette, disposal and transparency. feature: frames, their time, counts of 16
    grey levels. Rows don't meet, so repeats and ties need nothing; an empty table gives none.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_media_rows, MEDIA)


FRAMES = "media_id long, frame int, start_ms long, delay_ms long, width int, height int, disposal int, transparent boolean, histogram array<long>, error string"


def _frame_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("media_id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.bool_()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])
    for batch in sliced(batches):
        rows = []
        for i, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                w, h, frames = read_gif(media or b"")
                start = 0
                for k, (f, canvas) in enumerate(zip(frames, composed(w, h, frames), strict=True)):
                    shown = canvas[canvas[..., 3] > 0]
                    rows.append((i, k, start, f.delay_ms, f.width, f.height, f.disposal, f.transparent is not None, histogram(shown).tolist(), None))
                    start += f.delay_ms
            except (ValueError, IndexError, struct.error) as e:
                rows.append((i, None, None, None, None, None, None, None, None, str(e)))
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)


def frames(media: DataFrame, *, id_col: str = "media_id", data_col: str = "media") -> DataFrame:
    """A row a frame of each GIF, as composed on its canvas; of bytes that are no GIF (null too) one row with error."""
    return media.select(F.col(id_col).cast("long"), F.col(data_col)).mapInArrow(_frame_rows, FRAMES)
