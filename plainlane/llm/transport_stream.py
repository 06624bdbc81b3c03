"""Media columns as MPEG transport streams (ISO/IEC 13818-1): write texts as streams and read them back.

A stream starts with a program association and a program map table, then carries the payload as the PES packets of one
elementary stream. Each PES packet holds one access unit with a presentation time stamp; every GROUP-th unit is a
random-access point, marked in the adaptation field together with a clock reference. Streams are stored in a table. The
reader takes them from there, parses the tables (whose sections may cross packets), checks the continuity counters of each
PID and leaves out repeated packets, reassembles the PES packets and returns time stamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column_bytes, read_table, staged, tidied

PACKET = 188
SYNC = 0x47
PAT_PID, PMT_PID, ES_PID = 0x0000, 0x1000, 0x0100
PROGRAM = 1
#: Private PES data: any bytes may be an access unit.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
UNIT_BYTES = 8192
#: 90 kHz ticks from one unit to the next (25 units a second), and units from one random-access point to the next.
TICKS, GROUP = 3600, 8
PES_HEADER = 14
#: Multiple of bytes to which payloads are padded.
ALIGN = 64


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        c = np.where(c & np.uint64(1 << 31), (c << np.uint64(1)) ^ np.uint64(0x04C11DB7), c << np.uint64(1)) & np.uint64(0xFFFFFFFF)
    return c


_CRC = [int(x) for x in _crc_table()]


def section_crc(data: bytes) -> int:
    """The CRC-32 of program tables (not reflected, no final inversion)."""
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    length = len(body) + 9
    head = bytes([table_id, 0xB0 | length >> 8, length & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + section
    return packet + b"\xff" * (PACKET - len(packet))


HEADER = _table_packet(PAT_PID, _section(0x00, 1, bytes([PROGRAM >> 8, PROGRAM & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))) + _table_packet(
    PMT_PID, _section(0x02, PROGRAM, bytes([0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | ES_PID >> 8, ES_PID & 255, 0xF0, 0]))
)


def _stamp(ticks: int) -> bytes:
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 255, 0x01 | ticks >> 14 & 0xFE, ticks >> 7 & 255, 0x01 | ticks << 1 & 0xFE])


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES) -> bytes:
    """A transport stream that carries payload, in access units of unit_bytes."""
    out, counter = [HEADER], 0
    for n, at in enumerate(range(0, len(payload), unit_bytes)):
        unit = payload[at : at + unit_bytes]
        pts = n * TICKS & (1 << 33) - 1
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(unit) + PES_HEADER - 6).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + unit
        # first packet: adaptation field of at least flags, and on random-access points the clock reference
        field = b""
        if n % GROUP == 0:
            field = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
        out.append(_packet(pes, 0, field, True, counter))
        done = PACKET - 5 - len(field) if field else PACKET - 4
        counter = counter + 1 & 15
        whole = max(len(pes) - done, 0) // (PACKET - 4)
        if whole:
            body = np.empty((whole, PACKET), np.uint8)
            body[:, 0], body[:, 1], body[:, 2] = SYNC, ES_PID >> 8, ES_PID & 255
            body[:, 3] = 0x10 | (counter + np.arange(whole) & 15)
            body[:, 4:] = np.frombuffer(pes, np.uint8, whole * (PACKET - 4), done).reshape(whole, PACKET - 4)
            out.append(body.tobytes())
            done += whole * (PACKET - 4)
            counter = counter + whole & 15
        if done < len(pes):
            out.append(_packet(pes, done, b"", False, counter))
            counter = counter + 1 & 15
    return b"".join(out)


def _packet(pes: bytes, at: int, field: bytes, first: bool, counter: int) -> bytes:
    """One packet from byte at of pes; a short rest is filled by stuffing in the adaptation field."""
    room = PACKET - 4 - (1 + len(field) if field else 0)
    take = min(room, len(pes) - at)
    stuffing = room - take
    if stuffing and not field:
        field = b"\x00" if stuffing > 1 else b""
        head = bytes([stuffing - 1]) + field + b"\xff" * max(stuffing - 2, 0)
    elif field:
        head = bytes([len(field) + stuffing]) + field + b"\xff" * stuffing
    else:
        head = b""
    return bytes([SYNC, 0x40 * first | ES_PID >> 8, ES_PID & 255, (0x30 if head else 0x10) | counter]) + head + pes[at : at + take]


@dataclass
class Stream:
    """What demux() finds: programs by number, the PES payloads, and their stamps."""

    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    payload: bytes = b""
    stamps: list[int] = field(default_factory=list)
    access_points: list[tuple[int, int]] = field(default_factory=list)
    packets: int = 0
    discontinuities: int = 0
    errors: list[str] = field(default_factory=list)


def _continuous(p: np.ndarray, rows: np.ndarray, body: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, int]:
    """rows of one PID's packets with payload, without packets sent twice, and the number of gaps in their counters.

    A packet sent twice has its predecessor's counter and payload. A gap at a packet marked as a discontinuity is none.
    """
    if len(rows) < 2:
        return rows, 0
    step = (p[rows[1:], 3].astype(np.int16) - p[rows[:-1], 3]) % 16
    twice = np.zeros(len(rows), bool)
    for k in np.flatnonzero((step == 0) & (body[rows[1:]] == body[rows[:-1]])) + 1:
        start = body[rows[k]]
        twice[k] = (p[rows[k], start:] == p[rows[k - 1], start:]).all()
    gaps = (step != 1) & ~twice[1:] & ~marked[rows[1:]]
    return rows[~twice], int(gaps.sum())


def _sections(p: np.ndarray, rows: np.ndarray, first: np.ndarray, body: np.ndarray) -> Iterator[bytes | None]:
    """The sections in one PID's packets, which may cross packets or share one; None for each that is damaged or cut off."""
    held = None

    def whole() -> Iterator[bytes | None]:
        nonlocal held
        while held and held[0] != 0xFF and len(held) >= 3:
            size = 3 + ((held[1] & 0x0F) << 8 | held[2])
            if len(held) < size:
                return
            yield held[:size] if section_crc(held[:size]) == 0 else None
            held = held[size:]
        if held and held[0] == 0xFF:
            held = b""

    for i in rows:
        data = p[i, body[i] :].tobytes()
        if first[i] and data:
            start = 1 + data[0]
            if held:
                held += data[1:start]
                yield from whole()
                if held:
                    yield None
            held = data[start:]
        elif held is not None:
            held += data
        yield from whole()
    if held:
        yield None


def demux(media: bytes) -> Stream:
    """Reads a transport stream: tables, continuity, PES packets, time stamps and random-access points.

    Damage is reported in errors and discontinuities; what can be read is returned.
    """
    s = Stream()
    if len(media) % PACKET:
        s.errors.append("length is no multiple of 188")
    n = len(media) // PACKET
    s.packets = n
    if not n:
        return s
    p = np.frombuffer(media, np.uint8, n * PACKET).reshape(n, PACKET)
    synced = p[:, 0] == SYNC
    if not synced.all():
        s.errors.append(f"{int((~synced).sum())} packets without sync byte")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    first = (p[:, 1] & 0x40) > 0
    control = p[:, 3] >> 4 & 3
    field_bytes = np.where(control >= 2, p[:, 4].astype(np.int32) + 1, 0)
    body = np.where(control & 1, 4 + field_bytes, PACKET).clip(max=PACKET)
    marked = (field_bytes > 1) & (p[:, 5] & 0x80 > 0)

    def packets_of(wanted: int) -> np.ndarray:
        rows, gaps = _continuous(p, np.flatnonzero(synced & (pid == wanted) & ((control & 1) > 0)), body, marked)
        s.discontinuities += gaps
        return rows

    for x in _sections(p, packets_of(PAT_PID), first, body):
        if x is None or x[0] != 0:
            s.errors.append("bad program association table")
            continue
        for at in range(8, len(x) - 4, 4):
            s.programs[x[at] << 8 | x[at + 1]] = (x[at + 2] & 0x1F) << 8 | x[at + 3]
    for table in sorted({v for k, v in s.programs.items() if k}):
        for x in _sections(p, packets_of(table), first, body):
            if x is None or x[0] != 2:
                s.errors.append("bad program map table")
                continue
            at = 12 + ((x[10] & 0x0F) << 8 | x[11])
            while at + 5 <= len(x) - 4:
                s.streams[(x[at + 1] & 0x1F) << 8 | x[at + 2]] = x[at]
                at += 5 + ((x[at + 3] & 0x0F) << 8 | x[at + 4])
    parts: list[bytes] = []
    for es in s.streams:
        rows = packets_of(es)
        if not len(rows):
            continue
        q, start = p[rows], body[rows]
        data = q[np.arange(PACKET)[None, :] >= start[:, None]].tobytes()
        ends = np.cumsum(PACKET - start)
        heads = np.flatnonzero(first[rows])
        cuts = [*(int(ends[h] - (PACKET - start[h])) for h in heads), len(data)]
        for k, h in enumerate(heads):
            pes = data[cuts[k] : cuts[k + 1]]
            if pes[:3] != b"\x00\x00\x01" or len(pes) < PES_HEADER:
                s.errors.append("bad PES start")
                continue
            length, header = pes[4] << 8 | pes[5], 9 + pes[8]
            if length and length + 6 != len(pes):
                s.errors.append("PES packet of another length")
            stamp = _read_stamp(pes[9:14]) if pes[7] & 0x80 else -1
            s.stamps.append(stamp)
            if field_bytes[rows[h]] > 1 and q[h, 5] & 0x40:
                s.access_points.append((stamp, int(rows[h])))
            parts.append(pes[header:])
    s.payload = b"".join(parts)
    return s


def feature(s: Stream) -> str:
    """A short description of a parsed stream."""
    first, last = (min(s.stamps), max(s.stamps)) if s.stamps else (-1, -1)
    points = ",".join(f"{t}@{at}" for t, at in s.access_points)
    return f"ts;programs={len(s.programs)};streams={','.join(f'{k}:{v}' for k, v in sorted(s.streams.items()))};packets={s.packets};units={len(s.stamps)};pts={first}-{last};access={points};gaps={s.discontinuities};errors={len(s.errors)}"


def padded(text: bytes) -> bytes:
    """text with bytes 0 up to a positive multiple of 64."""
    return text + bytes(max(-(-len(text) // ALIGN), 1) * ALIGN - len(text))


STORED = "doc_id long, n_bytes long, media binary"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, stamps array<long>, access_stamps array<long>, access_packets array<long>"
#: Bytes of streams that a worker gives back at once, and of a row group of the stored table.
LOT_BYTES, GROUP_BYTES = 8 << 20, 16 << 20


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a transport stream, and its bytes without padding. Narrow: no shuffle."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            streams, size, done = [], 0, 0
            for i in range(batch.num_rows):
                streams.append(mux(padded(data[offsets[i] : offsets[i + 1]].tobytes())))
                size += len(streams[-1])
                if size > LOT_BYTES or i == batch.num_rows - 1:
                    sizes = pa.array(np.diff(offsets[done : i + 2]), pa.int64())
                    yield pa.record_batch([batch.column(0).slice(done, i + 1 - done), sizes, pa.array(streams, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    streams, size, done = [], 0, i + 1

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(run), STORED)


def read_media(stored: DataFrame, keep_media: bool = True) -> DataFrame:
    """What a reader finds in stored streams (doc_id, n_bytes, media), as SCHEMA has it; null streams are empty ones."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc_id, n, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                media = media.as_py() or b""
                s = demux(media)
                back = s.payload
                rows.append((
                    doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), feature(s),
                    media if keep_media else None, s.stamps if keep_media else None,
                    [t for t, _ in s.access_points] if keep_media else None, [at for _, at in s.access_points] if keep_media else None,
                ))
                size += len(media)
                if size > LOT_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(tidied(run), SCHEMA)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Stores each text as a transport stream in a table in the shared folder and reads it back from there.

    Returns SCHEMA's columns: sizes and digests of what was read back and of the stored form, the feature string, the
    stream itself, all time stamps, and time stamps and packet numbers of random-access points. keep_media=False leaves
    the four bulky ones null. Null and empty texts become one unit of 64 zero bytes; a null id stays null; equal texts
    give equal values; repeated rows are all returned; very long texts are one stream each; an empty table gives an empty
    one. Other columns are not looked at. Narrow: no shuffle.
    """
    stored = staged(write_media(docs, id_col, text_col), "media", compression="zstd", **{"parquet.block.size": GROUP_BYTES})
    return read_media(stored, keep_media)


def _batch(rows: list[tuple]):
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)


def op10_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_column(read_table(spark, sf_dir, "documents"), keep_media=False)
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
