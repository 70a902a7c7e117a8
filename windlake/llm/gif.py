"""GIF media columns: LZW code streams, palettes, disposal and transparency, timed frames and colour histograms.

``decode`` reads any GIF87a/89a file; ``encode`` writes indexed frames losslessly. Frames are decoded one at a time, so
memory is bounded by the canvas.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windlake.llm.common import Scratch, documents, small_batches, text_or_empty

MAX_CODES = 4096
WIDTH = 64
FRAME_ROWS = 1024
DELAY_CS = 10


@dataclass
class Frame:
    left: int
    top: int
    indices: np.ndarray  # rows x columns, uint8
    delay_cs: int
    rgba: np.ndarray  # the whole canvas after this frame, uint8


def _pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of varying width, least significant bit first."""
    cuts = np.flatnonzero(np.diff(widths)) + 1
    runs = [(c[:, None] >> np.arange(w[0]) & 1).astype(np.uint8).ravel() for c, w in zip(np.split(codes.astype(np.uint16), cuts), np.split(widths, cuts))]
    return np.packbits(np.concatenate(runs), bitorder="little").tobytes()


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of bytes below 2**bits: the table starts anew whenever it is full."""
    clear = 1 << bits
    codes, sizes = array("l", [clear << 8]), []
    if data:
        emit = codes.append
        # codes are kept shifted by 8, so that a code and the next byte make a key by one operation
        table: dict[int, int] = {}
        get = table.get
        free, full = (clear + 2) << 8, MAX_CODES << 8
        code = data[0] << 8
        for byte in data[1:]:
            longer = get(code | byte)
            if longer:
                code = longer
                continue
            emit(code)
            table[code | byte] = free
            free += 256
            if free == full:
                emit(clear << 8)
                table.clear()
                sizes.append(len(codes))
                free = (clear + 2) << 8
            code = byte << 8
        emit(code)
    codes.append((clear + 1) << 8)
    sizes.append(len(codes))
    widths = np.empty(len(codes), np.int64)
    widths[0], at = bits + 1, 1
    for end in sizes:
        widths[at:end] = _widths(bits, end - at)
        at = end
    return _pack_codes(np.frombuffer(codes, codes.typecode) >> 8, widths)


SEGMENT = MAX_CODES


def _widths(bits: int, n: int) -> np.ndarray:
    """Bits of each of the n codes (at most SEGMENT) after a clear code: the k-th (from 1) comes when the table has 2**bits + k entries."""
    if bits not in _WIDTHS:
        entries = (1 << bits) + 1 + np.arange(SEGMENT)
        _WIDTHS[bits] = np.clip(np.ceil(np.log2(entries + 1)), bits + 1, 12).astype(np.int64)
    return _WIDTHS[bits][:n]


_WIDTHS: dict[int, np.ndarray] = {}


def lzw_decode(stream: bytes, bits: int, n: int) -> bytes:
    """At most ``n`` bytes of a code stream.

    Where codes lie depends only on how many came since the last clear code, so they are read SEGMENT at a time.
    """
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.int64)
    total = len(stream) * 8
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, out = list(roots), []
    put, add = out.append, table.append
    previous, seen, position = b"", 0, 0  # seen: codes since the last clear code
    widths = _widths(bits, SEGMENT)
    while position < total:
        width = widths[seen : seen + SEGMENT] if seen < SEGMENT else np.full(SEGMENT, 12, np.int64)
        ends = position + np.cumsum(width)
        k = int(np.searchsorted(ends, total, "right"))
        starts = ends[:k] - width[:k]
        at = starts >> 3
        codes = (raw[at] | raw[at + 1] << 8 | raw[at + 2] << 16) >> (starts & 7) & ((1 << width[:k]) - 1)
        stop = np.flatnonzero((codes == clear) | (codes == end))
        last = int(stop[0]) if len(stop) else k
        todo = codes[:last].tolist()
        if todo and not previous:
            if todo[0] > clear:
                raise ValueError("a code stream starts with an unknown code")
            previous = table[todo[0]]
            put(previous)
            del todo[0]
        room = MAX_CODES - len(table)
        for code in todo[:room]:
            try:
                entry = table[code]
            except IndexError:
                if code != len(table):
                    raise ValueError("a code stream has an unknown code") from None
                entry = previous + previous[:1]
            add(previous + entry[:1])
            previous = entry
        if todo[room:]:
            previous = table[todo[-1]]
        out += map(table.__getitem__, todo)
        seen += last
        if not len(stop):
            if k < len(width):
                break
            position = int(ends[-1])
            continue
        if codes[last] == end:
            break
        position, seen, previous = int(ends[last]), 0, b""
        table = list(roots)
        add = table.append
    return b"".join(out)[:n]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


GREYS = bytes(i for i in range(256) for _ in range(3))


def encode(frames: Iterable[np.ndarray], palette: bytes = GREYS, delay_cs: int = DELAY_CS, disposal: int = 1, transparent: int | None = None) -> bytes:
    """A GIF89a file of indexed frames, all from the top left corner; the canvas holds the largest."""
    frames = list(frames)
    bits = max(2, (len(palette) // 3 - 1).bit_length())
    height, width = max(f.shape[0] for f in frames), max(f.shape[1] for f in frames)
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), bytes([0x80 | 0x70 | (bits - 1), 0, 0]), palette.ljust(3 << bits, b"\0")]
    for f in frames:
        flags = disposal << 2 | (transparent is not None)
        out.append(b"\x21\xf9\x04" + bytes([flags]) + delay_cs.to_bytes(2, "little") + bytes([transparent or 0, 0]))
        out.append(b"\x2c\0\0\0\0" + f.shape[1].to_bytes(2, "little") + f.shape[0].to_bytes(2, "little") + b"\0" + bytes([bits]))
        out.append(_blocks(lzw_encode(f.astype(np.uint8).tobytes(), bits)))
    return b"".join([*out, b"\x3b"])


def _sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    size = 3 << ((flags & 7) + 1)
    return np.frombuffer(data[at : at + size], np.uint8).reshape(-1, 3), at + size


def _interlaced(height: int) -> np.ndarray:
    return np.concatenate([np.arange(start, height, step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF file, drawn one over the other as their disposal and transparency say."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    width, height, flags = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little"), data[10]
    common, at = _palette(data, 13, flags)
    canvas = np.zeros((height, width), np.uint32)  # red, green, blue and alpha bytes of a pixel in one
    delay, disposal, transparent = 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = _sub_blocks(data, at + 2)
            if label == 0xF9:
                disposal, delay = body[0] >> 2 & 7, int.from_bytes(body[1:3], "little")
                transparent = body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("a GIF file has an unknown block")
        left, top, w, h = (int.from_bytes(data[at + 1 + 2 * i : at + 3 + 2 * i], "little") for i in range(4))
        flags = data[at + 9]
        own, at = _palette(data, at + 10, flags)
        palette = own if own is not None else common
        bits = data[at]
        stream, at = _sub_blocks(data, at + 1)
        raw = lzw_decode(stream, bits, w * h)
        indices = np.zeros(w * h, np.uint8)
        indices[: len(raw)] = np.frombuffer(raw, np.uint8)
        indices = indices.reshape(h, w)
        if flags & 0x40:
            rows = np.empty_like(indices)
            rows[_interlaced(h)] = indices
            indices = rows
        before = canvas.copy() if disposal == 3 else None
        if palette is None:
            raise ValueError("a GIF frame has no palette")
        colours = np.zeros((256, 4), np.uint8)
        colours[: len(palette), :3], colours[: len(palette), 3] = palette, 255
        box = canvas[top : top + h, left : left + w]
        drawn = colours.view(np.uint32)[:, 0][indices[: box.shape[0], : box.shape[1]]]
        if transparent is None:
            box[:] = drawn
        else:
            on = indices[: box.shape[0], : box.shape[1]] != transparent
            box[on] = drawn[on]
        yield Frame(left, top, indices, delay, canvas.view(np.uint8).reshape(height, width, 4))
        if disposal == 2:
            box[:] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, transparent = 0, 0, None


def colour_histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of opaque pixels in 4 x 4 x 4 boxes of red, green and blue."""
    seen = rgba[rgba[..., 3] > 0].astype(np.int64) >> 6
    return np.bincount(seen[:, 0] * 16 + seen[:, 1] * 4 + seen[:, 2], minlength=64)


FRAMES_SQL = "frame int, start_cs long, delay_cs int, width int, height int, pixels binary, histogram array<long>, error string"
FRAME_ROW = pa.schema([("frame", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])


def safe_frames(data: bytes) -> Iterator[Frame | str]:
    """The frames of a file; where it is cut off or broken, what is wrong with it follows those before."""
    try:
        yield from decode(data)
    except (ValueError, IndexError) as e:
        yield str(e) or type(e).__name__


def frame_table(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each frame of each GIF: its time, its RGBA canvas and its colour histogram; a null file has none. A broken
    file has its frames up to there and then a row with only an ``error``."""
    id_type = media.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column("m").to_pylist()):
                start = 0
                for k, f in enumerate(safe_frames(data)):
                    if isinstance(f, str):
                        row = {"frame": k, "error": f}
                    else:
                        row = {"frame": k, "start_cs": start, "delay_cs": f.delay_cs, "width": f.rgba.shape[1], "height": f.rgba.shape[0], "pixels": f.rgba.tobytes(), "histogram": colour_histogram(f.rgba).tolist()}
                        start += f.delay_cs
                    columns = pa.RecordBatch.from_pylist([row], FRAME_ROW)
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1), *columns.columns], ["id", *FRAME_ROW.names])

    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("m")).where("m is not null")
    return rows.mapInArrow(run, f"id {id_type}, {FRAMES_SQL}").withColumnRenamed("id", id_col)


def to_gif(payload: bytes) -> bytes:
    """Stores bytes, a multiple of 64, as grey frames of 64 columns."""
    pixels = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode(pixels[i : i + FRAME_ROWS] for i in range(0, len(pixels), FRAME_ROWS))


def read_back(media: bytes) -> tuple[bytes, np.ndarray, int]:
    """The payload as the grey values that the drawn frames show, their summed histogram, and the running time."""
    parts, histogram, time = [], np.zeros(64, np.int64), 0
    for f in decode(media):
        h, w = f.indices.shape
        shown = np.ascontiguousarray(f.rgba[f.top : f.top + h, f.left : f.left + w, 0])
        parts.append(shown.tobytes())
        histogram += np.bincount(shown.ravel(), minlength=256).reshape(4, 64).sum(axis=1) @ GREY_BOXES
        time += f.delay_cs
    return b"".join(parts), histogram, time


#: Which colour boxes the four grey levels fall in.
GREY_BOXES = np.eye(64, dtype=np.int64)[[0, 21, 42, 63]]


def padded(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // 64)) * 64, b"\0")


MEDIA = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _describe(batches):
    for batch in batches:
        rows = []
        for media in batch.column("media").to_pylist():
            payload, histogram, time = read_back(media)
            levels = histogram[[0, 21, 42, 63]]
            rows.append(
                {
                    "payload_bytes": len(payload),
                    "payload_sha256": sha256(payload).hexdigest(),
                    "tail_crc32": zlib.crc32(payload[-64:]),
                    "media_bytes": len(media),
                    "media_sha256": sha256(media).hexdigest(),
                    "feature": f"{time}cs:" + "-".join(map(str, levels)),
                }
            )
        columns = pa.RecordBatch.from_pylist(rows, MEDIA)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns.columns], ["doc_id", "n_bytes", *MEDIA.names])


def media_column(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text's bytes, padded to a positive multiple of 64, stored as a GIF file (column ``media``)."""
    small_batches(spark)

    def run(batches):
        for batch in batches:
            data = [t.encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, data), pa.int64()), pa.array([to_gif(padded(x)) for x in data], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def media_features(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Stores each text as a GIF in a table of the shared folder, reads that through the decoder, and describes both.

    A null or empty text is 64 zero bytes. Repeated rows give repeated results; null ids are kept; other columns are
    ignored; an empty table gives an empty result. ``feature`` is the running time and the pixels of each grey quarter.
    """
    stored = Scratch(spark, "gif").put(media_column(spark, docs), "media")
    columns = ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in MEDIA)
    return stored.mapInArrow(_describe, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, {columns}")


def op7_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(spark, documents(spark, sf_dir))


QUERIES = {"op7_gif": op7_gif}
ORACLE_SQL: dict[str, str] = {}
