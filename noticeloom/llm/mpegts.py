"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

``ts_encoded`` stores 8-bit samples in a transport stream: a program association table and a program map table at the
start and at every random-access point, and the samples as access units in packetized elementary stream (PES) packets
with presentation timestamps. ``ts_parsed`` reads a stream back: program tables (with their CRC), continuity counters,
the reassembled elementary stream, its timestamps and random-access points. Both work on one value at a time inside
Arrow batches; nothing is shuffled.

Defined results: a null value gives null; an empty payload gives tables without access units; bytes that are no
transport stream give ``sync_errors`` and whatever packets remain; a lost packet counts in ``continuity_errors`` and a
repeated one in ``repeated``, whose payload is read once; repeated rows are stored each, with equal streams; an empty
table gives an empty result; further columns pass through. One value is held at a time, so a very long one needs memory
for itself and its stream alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeloom.llm.common import in_pandas, slices, table

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
#: Samples at 48 kHz in access units of 40 ms; the clock runs at 90 kHz. A random-access point each second.
UNIT_BYTES, TICKS_PER_UNIT, FIRST_PTS, UNITS_PER_ACCESS = 1920, 3600, 90_000, 25
#: What payloads are padded to.
SAMPLE_BLOCK = 192


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
        table.append(value)
    return table


CRC_TABLE = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """0 over a section with its CRC."""
    value = 0xFFFFFFFF
    for byte in data:
        value = value << 8 & 0xFFFFFFFF ^ CRC_TABLE[value >> 24 ^ byte]
    return value


def _section(table_id: int, id_: int, body: bytes) -> bytes:
    data = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, id_, 0xC1, 0, 0) + body
    return data + struct.pack(">I", crc32_mpeg(data))


def _tables() -> tuple[bytes, bytes]:
    pat = _section(0x00, 1, struct.pack(">HH", PROGRAM, 0xE000 | PMT_PID))
    pmt = _section(0x02, PROGRAM, struct.pack(">HH", 0xE000 | DATA_PID, 0xF000) + struct.pack(">BHH", STREAM_TYPE, 0xE000 | DATA_PID, 0xF000))
    return tuple((b"\x00" + s).ljust(PACKET - 4, b"\xff") for s in (pat, pmt))


TABLES = _tables()


def _head(pid: int, start: bool, counter: int, adaptation: bool) -> bytes:
    return bytes((SYNC, (0x40 if start else 0) | pid >> 8, pid & 0xFF, (0x30 if adaptation else 0x10) | counter & 15))


def _stamp(prefix: int, value: int) -> bytes:
    return struct.pack(">BHH", prefix << 4 | value >> 29 & 0x0E | 1, value >> 14 & 0xFFFE | 1, value << 1 & 0xFFFE | 1)


def mux(payload: bytes) -> bytes:
    out, tables, data = [], 0, 0
    for unit, at in enumerate(range(0, max(len(payload), 1), UNIT_BYTES)):
        access = unit % UNITS_PER_ACCESS == 0
        if access:
            for pid, body in zip((PAT_PID, PMT_PID), TABLES, strict=True):
                out += _head(pid, True, tables, False), body
            tables += 1
        samples = payload[at : at + UNIT_BYTES]
        if not samples:
            break
        pts = FIRST_PTS + unit * TICKS_PER_UNIT
        pes = b"\x00\x00\x01" + struct.pack(">BHBBB", STREAM_ID, len(samples) + 8, 0x84, 0x80, 5) + _stamp(2, pts & (1 << 33) - 1) + samples
        sent = 0
        while sent < len(pes):
            fields = b""
            if sent == 0 and access:  # random access and a program clock reference
                fields = b"\x50" + struct.pack(">IH", pts >> 1 & 0xFFFFFFFF, (pts & 1) << 15 | 0x7E00)
            room = PACKET - 4 - (len(fields) + 1 if fields else 0)
            chunk = pes[sent : sent + room]
            fill = room - len(chunk)
            if fields or fill:
                if not fields and fill == 1:
                    field = b"\x00"
                else:
                    body = fields or b"\x00"
                    body += b"\xff" * (PACKET - 5 - len(chunk) - len(body))
                    field = bytes((len(body),)) + body
                out += _head(DATA_PID, sent == 0, data, True), field, chunk
            else:
                out += _head(DATA_PID, sent == 0, data, False), chunk
            data += 1
            sent += len(chunk)
    return b"".join(out)


def _psi(buffers: dict[int, bytes], pid: int, start: bool, payload: bytes) -> bytes | None:
    """A whole section, if this packet ends one."""
    if start:
        pointer = payload[0] if payload else 0
        buffers[pid] = payload[1 + pointer :]
    elif pid in buffers:
        buffers[pid] += payload
    held = buffers.get(pid, b"")
    if len(held) >= 3 and len(held) >= (size := 3 + (struct.unpack_from(">H", held, 1)[0] & 0xFFF)):
        del buffers[pid]
        return held[:size]
    return None


def _pes(data: bytes) -> tuple[int | None, bytes] | None:
    """Timestamp and samples of a packet; None if it is no PES packet."""
    if len(data) < 9 or data[:3] != b"\x00\x00\x01":
        return None
    pts = None
    if data[7] & 0x80 and len(data) >= 14:
        a, b, c = struct.unpack_from(">BHH", data, 9)
        pts = (a >> 1 & 7) << 30 | (b >> 1) << 15 | c >> 1
    size = struct.unpack_from(">H", data, 4)[0]
    return pts, data[9 + data[8] : 6 + size if size else len(data)]


def demux(media: bytes) -> dict:
    programs, types, last, buffers, open_ = {}, {}, {}, {}, {}
    found = {"packets": 0, "sync_errors": 0, "continuity_errors": 0, "repeated": 0, "table_errors": 0}
    streams: dict[int, list] = {}
    access: list[dict] = []

    def close(pid: int) -> None:
        if pid in open_:
            parts, flagged, at = open_.pop(pid)
            if read := _pes(b"".join(parts)):
                streams.setdefault(pid, []).append(read)
                if flagged:
                    access.append({"pid": pid, "pts": read[0], "packet": at})

    for number, at in enumerate(range(0, len(media) - PACKET + 1, PACKET)):
        found["packets"] += 1
        if media[at] != SYNC:
            found["sync_errors"] += 1
            continue
        b1, b2, b3 = media[at + 1], media[at + 2], media[at + 3]
        pid, start, flagged, jumped = (b1 & 0x1F) << 8 | b2, bool(b1 & 0x40), False, False
        body = at + 4
        if b3 & 0x20:
            length = media[body]
            if length:
                flagged, jumped = bool(media[body + 1] & 0x40), bool(media[body + 1] & 0x80)
            body += 1 + length
        if not b3 & 0x10 or pid == 0x1FFF:
            continue
        counter, before = b3 & 15, last.get(pid)
        if before is not None and not jumped:
            if counter == before:
                found["repeated"] += 1
                continue
            if counter != (before + 1) & 15:
                found["continuity_errors"] += 1
        last[pid] = counter
        payload = media[body : at + PACKET]
        if pid == PAT_PID or pid in programs.values():
            if section := _psi(buffers, pid, start, payload):
                if crc32_mpeg(section):
                    found["table_errors"] += 1
                elif pid == PAT_PID and section[0] == 0:
                    for i in range(8, len(section) - 4, 4):
                        program, target = struct.unpack_from(">HH", section, i)
                        if program:
                            programs[program] = target & 0x1FFF
                elif section[0] == 2:
                    i = 12 + (struct.unpack_from(">H", section, 10)[0] & 0xFFF)
                    while i < len(section) - 4:
                        kind, target, extra = struct.unpack_from(">BHH", section, i)
                        types[target & 0x1FFF] = kind
                        i += 5 + (extra & 0xFFF)
        elif pid in types:
            if start:
                close(pid)
                open_[pid] = ([payload], flagged, number)
            elif pid in open_:
                open_[pid][0].append(payload)
    for pid in list(open_):
        close(pid)
    units = [u for pid in sorted(streams) for u in streams[pid]]
    return found | {
        "sync_errors": found["sync_errors"] + bool(len(media) % PACKET),
        "programs": [{"program": p, "pmt_pid": x} for p, x in sorted(programs.items())],
        "streams": [{"pid": p, "stream_type": x, "units": len(streams.get(p, []))} for p, x in sorted(types.items())],
        "pts": [pts for pts, _ in units],
        "random_access": access,
        "payload": b"".join(data for _, data in units),
    }


def _fields(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in types.items()])


INT, LONG = T.IntegerType(), T.LongType()
PARSED = _fields(
    packets=INT,
    sync_errors=INT,
    continuity_errors=INT,
    repeated=INT,
    table_errors=INT,
    programs=T.ArrayType(_fields(program=INT, pmt_pid=INT)),
    streams=T.ArrayType(_fields(pid=INT, stream_type=INT, units=INT)),
    pts=T.ArrayType(LONG),
    random_access=T.ArrayType(_fields(pid=INT, pts=LONG, packet=INT)),
    payload=T.BinaryType(),
)


@F.pandas_udf(T.BinaryType())
def ts_encoded(payloads: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Bytes to a transport stream that carries them."""
    for batch in slices(payloads):
        yield batch.map(lambda x: None if x is None else mux(bytes(x)))


@F.pandas_udf(PARSED)
def ts_parsed(streams: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A transport stream to its tables, errors, timestamps, random-access points and samples."""
    names = PARSED.names
    for batch in slices(streams):
        rows = [dict.fromkeys(names) if x is None else demux(bytes(x)) for x in batch]
        yield pd.DataFrame(rows, columns=names, dtype=object)


def padded(data: Column) -> Column:
    """Bytes 32 up to a positive multiple of the sample block."""
    blocks = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(float(SAMPLE_BLOCK))))
    return F.rpad(data, (blocks * SAMPLE_BLOCK).cast("int"), F.lit(b" "))


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in slices(batches):
        out = []
        for doc_id, n_bytes, media in zip(batch["doc_id"], batch["n_bytes"], batch["media"], strict=True):
            media = bytes(media)
            x = demux(media)
            payload = x["payload"]
            feature = ";".join(
                (
                    "programs=" + ",".join(f"{p['program']}@{p['pmt_pid']}" for p in x["programs"]),
                    "streams=" + ",".join(f"{s['pid']}:{s['stream_type']}x{s['units']}" for s in x["streams"]),
                    f"packets={x['packets']}",
                    f"errors={x['sync_errors']}/{x['continuity_errors']}/{x['table_errors']}",
                    f"pts={x['pts'][0]}-{x['pts'][-1]}" if x["pts"] else "pts=",
                    "access=" + ",".join(f"{a['pts']}@{a['packet']}" for a in x["random_access"]),
                )
            )
            out.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in DIGESTS.split(", ")])


def op3_mpeg_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as media columns; the digests come from the stored streams alone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"))
    stored = docs.select("doc_id", F.octet_length("bytes").cast("long").alias("n_bytes"), ts_encoded(padded(F.col("bytes"))).alias("media"))
    return in_pandas(stored, _digest, DIGESTS)
