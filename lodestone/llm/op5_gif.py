"""Media columns: GIF. Decodes LZW code streams, palettes, transparency and disposal into timed frames.

encode() stores a payload losslessly as the palette indices of a 64-pixel-wide GIF89a, up to 1024 rows a
frame, with real LZW; decode() reads any GIF: global and local palettes, interlacing, deferred clear codes,
the three disposal methods, transparent pixels. Frames carry their time and histogram columns.

Defined results: null and empty texts have a payload of 64 zero bytes; a text of any length becomes as many
frames as it needs, and is held one document at a time; equal texts give equal rows; an empty table gives an
empty one; extra columns are not read.
"""

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import read_table, stored

NAME = "op5_gif_media"
WIDTH, ROWS, DELAY = 64, 1024, 10
CLEAR, END = 256, 257
#: The red channel is the sample, so that colours give samples back.
PALETTE = bytes(x for i in range(256) for x in (i, i * 5 + 64 & 255, 255 - i))


def _widths(n: int, size: int = 8) -> np.ndarray:
    """Bits of the k-th code after a clear code, k < n."""
    entries = np.arange(n) + (1 << size) + 1
    return np.minimum(12, np.maximum(size + 1, np.floor(np.log2(np.maximum(entries, 1))).astype(np.int64) + 1))


_BLOCK = 4096 - 258
_WIDTHS = _widths(_BLOCK + 1)


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples: a clear code, blocks of up to 3838 codes with a clear code each, the end code."""
    codes, starts = [], [0]
    table, free, emit = {}, 258 << 8, codes.append
    w = data[0] << 8 if data else -1  # codes stand 8 bits up, to take the next sample below
    for b in data[1:]:
        key = w | b
        if key in table:
            w = table[key]
        else:
            emit(w)
            table[key] = free
            free += 256
            w = b << 8
            if free == 4096 << 8:
                table.clear()
                free = 258 << 8
                emit(CLEAR << 8)
                starts.append(len(codes))
    if w >= 0:
        emit(w)
    emit(END << 8)
    widths = np.concatenate([[9], *(_WIDTHS[: b - a] for a, b in zip(starts, [*starts[1:], len(codes)]))])
    values = np.concatenate([[CLEAR], np.array(codes, np.int64) >> 8])
    at = np.concatenate([[0], np.cumsum(widths)])
    out = np.zeros((int(at[-1]) + 7) // 8 + 3, np.int64)
    values = values << (at[:-1] & 7)
    for k in range(3):
        np.add.at(out, (at[:-1] >> 3) + k, values >> 8 * k & 255)
    return out[:-3].astype(np.uint8).tobytes()


def _expand(codes: np.ndarray, clear: int) -> bytes:
    """The samples of the codes after a clear code.

    Entry clear + 2 + i is the string of code i and the sample after it, which stand side by side in the
    output; so each sample is a copy of an earlier one, found by doubling pointers, all codes at once.
    """
    n = len(codes)
    own = np.arange(n)
    parent = np.where(codes < clear, own, codes - clear - 2)
    bad = np.flatnonzero((parent >= own) & (codes >= clear))
    if len(bad):
        raise ValueError("an LZW code comes before its entry")
    depth, up = (codes >= clear).astype(np.int64), parent
    while True:
        further = up[up]
        if (further == up).all():
            break
        depth += depth[up]
        up = further
    size = depth + 1
    start = np.cumsum(size) - size
    of = np.repeat(own, size)
    place = np.arange(len(of))
    source = np.where(codes[of] < clear, place, start[parent[of]] + place - start[of])
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    return codes[of[source]].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, size: int) -> bytes:
    """The samples of a code stream with the given minimum code size; a stream that breaks off gives what it holds."""
    clear = 1 << size
    raw = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(4, np.uint8)]).astype(np.int64)
    bits, p, out = 8 * len(stream), 0, []
    want = 4096
    schedule = np.concatenate([[0], np.cumsum(_widths(want, size))])
    while p < bits:
        while True:
            at = p + schedule[:-1]
            at = at[at + np.diff(schedule)[: len(at)] <= bits]
            if not len(at):
                return b"".join(out)
            width = np.diff(schedule)[: len(at)]
            i = at >> 3
            codes = (raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) >> (at & 7) & (1 << width) - 1
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            if len(stop) or len(at) < want:
                break
            want *= 2
            schedule = np.concatenate([[0], np.cumsum(_widths(want, size))])
        k = int(stop[0]) if len(stop) else len(codes)
        if k:
            out.append(_expand(codes[:k], clear))
        if not len(stop) or codes[k] == clear + 1:
            break
        p = int(at[k] + width[k])
    return b"".join(out)


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode(payload: bytes) -> bytes:
    """A GIF whose frames' indices, row by row, are the payload; its length is a multiple of 64."""
    rows = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, ROWS), 0xF7, 0, 0), PALETTE]
    for r in range(0, rows, ROWS):
        n = min(ROWS, rows - r)
        out += [b"\x21\xf9\x04", struct.pack("<BHB", 1 << 2, DELAY, 0), b"\0", b"\x2c", struct.pack("<HHHHB", 0, 0, WIDTH, n, 0), b"\x08"]
        out.append(_blocks(lzw_encode(payload[r * WIDTH : (r + n) * WIDTH])))
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    """One frame: its place, its time in milliseconds, and the whole canvas as RGBA once it is drawn."""

    x: int
    y: int
    width: int
    height: int
    start_ms: int
    delay_ms: int
    canvas: np.ndarray

    def part(self):
        return self.canvas[self.y : self.y + self.height, self.x : self.x + self.width]


def decode(gif: bytes):
    """Frames of a GIF, one at a time."""
    if gif[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", gif, 6)
    p, palette = 13, None
    if flags & 0x80:
        n = 3 * (2 << (flags & 7))
        palette, p = np.frombuffer(gif[p : p + n], np.uint8).reshape(-1, 3), p + n
    canvas, now = np.zeros((height, width, 4), np.uint8), 0
    disposal, delay, clear = 0, 0, None

    def sub(p):
        parts = []
        while p < len(gif) and gif[p]:
            parts.append(gif[p + 1 : p + 1 + gif[p]])
            p += 1 + gif[p]
        return b"".join(parts), p + 1

    while p < len(gif) and gif[p] != 0x3B:
        if gif[p] == 0x21:
            label = gif[p + 1]
            body, p = sub(p + 2)
            if label == 0xF9:
                flags, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear = flags >> 2 & 7, index if flags & 1 else None
        elif gif[p] == 0x2C:
            x, y, w, h, flags = struct.unpack_from("<HHHHB", gif, p + 1)
            p, own = p + 10, palette
            if flags & 0x80:
                n = 3 * (2 << (flags & 7))
                own, p = np.frombuffer(gif[p : p + n], np.uint8).reshape(-1, 3), p + n
            size = gif[p]
            body, p = sub(p + 1)
            pixels = np.frombuffer(lzw_decode(body, size)[: w * h].ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if flags & 0x40:
                order = [r for s, d in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(s, h, d)]
                plain = np.empty_like(pixels)
                plain[order] = pixels
                pixels = plain
            before = canvas.copy() if disposal == 3 else None
            colours = np.zeros((256, 4), np.uint8)
            colours[: len(own), :3] = own
            colours[:, 3] = 255
            area = canvas[y : y + h, x : x + w]
            pixels = pixels[: area.shape[0], : area.shape[1]]
            if clear is None:
                area[...] = colours[pixels]
            else:
                shown = pixels != clear
                area[shown] = colours[pixels[shown]]
            yield Frame(x, y, area.shape[1], area.shape[0], now, 10 * delay, canvas)
            now += 10 * delay
            if disposal == 2:
                canvas = canvas.copy()
                canvas[y : y + h, x : x + w] = 0
            elif disposal == 3:
                canvas = before
            else:
                canvas = canvas.copy()
            disposal, delay, clear = 0, 0, None
        else:
            break


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Pixels in 8 bins of each of red, green and blue; transparent ones left out."""
    shown = rgba.reshape(-1, 4)
    shown = shown[shown[:, 3] > 0]
    return np.stack([np.bincount(shown[:, c] >> 5, minlength=8) for c in range(3)])


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 or (0 if text else 64))


def _store(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            texts = [(t.as_py() or "").encode() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([encode(payload_of(t)) for t in texts], pa.binary())], ["id", "n_bytes", "media"])


def _frames(batches):
    for batch in batches:
        for id, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = [(id, k, f.start_ms, f.delay_ms, f.width, f.height, f.part()[..., :3].tobytes(), histogram(f.part()).ravel().tolist()) for k, f in enumerate(decode(media))]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, kinds)], ["id", "frame", "start_ms", "delay_ms", "width", "height", "rgb", "histogram"])


def frames(media: DataFrame) -> DataFrame:
    """One row for each timed frame of media(id bigint, media binary)."""
    return media.select("id", "media").mapInArrow(_frames, "id bigint, frame int, start_ms bigint, delay_ms bigint, width int, height int, rgb binary, histogram array<bigint>")


def media_table(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a GIF, written to the shared folder and read back."""
    return stored(docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(_store, "id bigint, n_bytes bigint, media binary"), "op5-media")


_FRAME = "frame: int, start_ms: bigint, delay_ms: bigint, width: int, height: int, histogram: array<bigint>"
_TIMED = f"id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, frames array<struct<{_FRAME}>>"


def _timed(batches):
    struct_ = pa.struct([("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(struct_)]
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames"]
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            batch = whole.slice(i, 256)
            cols = [[] for _ in names]
            for id, n, media in zip(batch.column(0), batch.column(1), batch.column(2)):
                media = media.as_py()
                sha, size, tail, shown = hashlib.sha256(), 0, b"", []
                for k, f in enumerate(decode(media)):
                    part = f.part()
                    samples = part[..., 0].tobytes()
                    sha.update(samples)
                    size += len(samples)
                    tail = (tail + samples)[-64:]
                    shown.append((k, f.start_ms, f.delay_ms, f.width, f.height, histogram(part).ravel().tolist()))
                for c, x in zip(cols, (id.as_py(), n.as_py(), size, sha.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), [dict(zip(("frame", "start_ms", "delay_ms", "width", "height", "histogram"), x)) for x in shown])):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


def frame_table(media: DataFrame) -> DataFrame:
    """Of each row of media(id, n_bytes, media), its timed frames with colour histograms and the digests of samples and file, written to the shared folder."""
    return stored(media.mapInArrow(_timed, _TIMED), "op5-frames")


def feature(frames: Column) -> Column:
    """Pixels of all frames in 8 bins of red, of green and of blue."""
    none = F.array_repeat(F.lit(0).cast("bigint"), 24)
    total = F.aggregate(frames, none, lambda a, f: F.zip_with(a, f["histogram"], lambda x, y: x + y))
    return F.get(F.transform(F.array(total.cast("array<string>")), lambda t: F.concat_ws("|", *[F.array_join(F.slice(t, 8 * k + 1, 8), ",") for k in range(3)])), 0)


def query(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows, last = frame_table(media_table(docs)), F.element_at("frames", -1)
    made = feature(F.col("frames")).alias("feature"), F.size("frames").alias("n_frames"), (last["start_ms"] + last["delay_ms"]).alias("duration_ms")
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", *made)
