"""Media columns in Ogg: a writer, and a reader that trusts nothing.

The reader verifies each page's checksum, reassembles packets from lacing values over page ends, separates the logical
streams and derives timestamps from granule positions. The writer stores bytes losslessly as 8-bit samples: fixed-size
packets dealt to two interleaved logical streams, each led by a packet with its format.

Edge cases: null and empty texts are stored as padding only; texts of any length are stored whole, over as many pages as
they need; equal texts give equal files and a repeated row repeats; other columns, whatever their names, aren't kept; bytes that are no valid Ogg give null payload and a count of faulty pages; an
empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..arrow import arrow_map
from .common import documents

# The payload's unit and padding byte; packet size, streams, sample rate and mark of our sample format.
UNIT, PAD = 576, b"\xff"
PACKET, TRACKS, RATE, MAGIC = 4 * UNIT, 2, 8000, b"PCM8RAW\0"
#: Fixed values of the container: capture pattern, page header, flags of a page, most segments in one.
CAPTURE, HEADER = b"OggS", struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST, SEGMENTS = 1, 2, 4, 255
FORMAT = struct.Struct("<8sIBBIQ")

#: Each byte with its bits in reverse order.
REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_crc(page: bytes) -> int:
    """The container's CRC (polynomial 04C11DB7, high bit first, start 0) by the library's low-bit-first CRC on reversed bits."""
    low_first = zlib.crc32(page.translate(REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low_first.to_bytes(4, "little").translate(REVERSED), "big")


def page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    whole = head + body
    return whole[:22] + struct.pack("<I", page_crc(whole)) + whole[26:]


def pages_of(serial: int, packets: list[bytes], granules: list[int]) -> list[bytes]:
    """The pages of a logical stream; the first packet has a page of its own. granules: position after each packet."""
    out = [page(FIRST | (LAST if len(packets) == 1 else 0), 0, serial, 0, bytes([*[255] * (len(packets[0]) // 255), len(packets[0]) % 255]), packets[0])]
    lacing, ends = bytearray(), []
    for p in packets[1:]:
        lacing += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
        ends.append(len(lacing))
    body, at, done, inside = b"".join(packets[1:]), 0, 0, False
    for start in range(0, len(lacing), SEGMENTS):
        part = bytes(lacing[start : start + SEGMENTS])
        before = done
        while done < len(ends) and ends[done] <= start + len(part):
            done += 1
        size = sum(part)
        flags = (CONTINUED if inside else 0) | (LAST if start + len(part) == len(lacing) else 0)
        out.append(page(flags, granules[done] if done > before else -1, serial, len(out), part, body[at : at + size]))
        at, inside = at + size, part[-1] == 255
    return out


def write_ogg(payload: bytes) -> bytes:
    """The payload as 8-bit samples in an Ogg file of two logical streams. The streams' numbers follow from the payload."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    serial, streams = zlib.crc32(payload) & 0xFFFFFFFE, []
    for track in range(TRACKS):
        own = packets[track::TRACKS]
        granules = np.cumsum([0, *map(len, own)]).tolist()
        streams.append(pages_of(serial + track, [FORMAT.pack(MAGIC, RATE, track, TRACKS, PACKET, len(payload)), *own], granules))
    out = [s[0] for s in streams]
    for i in range(1, max(map(len, streams))):
        out += [s[i] for s in streams if i < len(s)]
    return b"".join(out)


def read_ogg(data: bytes) -> tuple[dict[int, dict], int]:
    """The logical streams by number, each with packets, pages and last granule position; the number of faulty pages.

    A page whose checksum fails is passed over; a packet that it held part of is dropped.
    """
    streams: dict[int, dict] = {}
    faulty = at = 0
    while (at := data.find(CAPTURE, at)) >= 0:
        if at + HEADER.size > len(data):
            faulty += 1
            break
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        lacing = data[at + HEADER.size : at + HEADER.size + n]
        begin = at + HEADER.size + n
        end = begin + sum(lacing)
        if version or len(lacing) < n or end > len(data) or page_crc(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            faulty += 1
            at += len(CAPTURE)
            continue
        s = streams.setdefault(serial, {"packets": [], "pages": 0, "granule": 0, "next": 0, "part": None, "lost": 0})
        if number != s["next"] or (not flags & CONTINUED and s["part"] is not None) or (flags & CONTINUED and s["part"] is None):
            s["lost"], s["part"] = s["lost"] + 1, None
        broken = flags & CONTINUED and s["part"] is None
        size = 0
        for value in lacing:
            size += value
            if value < 255:
                piece = data[begin : begin + size]
                if broken:
                    broken = 0
                else:
                    s["packets"].append(b"".join([*(s["part"] or ()), piece]))
                s["part"], begin, size = None, begin + size, 0
        if lacing and lacing[-1] == 255 and not broken:
            s["part"] = [*(s["part"] or ()), data[begin:end]]
        s["pages"], s["next"] = s["pages"] + 1, number + 1
        s["granule"] = granule if granule >= 0 else s["granule"]
        at = end
    return streams, faulty


def samples_of(streams: dict[int, dict]) -> bytes | None:
    """The payload from the streams of our sample format; None if any of it is missing."""
    tracks: dict[int, list[bytes]] = {}
    wanted = None
    for s in streams.values():
        if s["packets"] and len(s["packets"][0]) == FORMAT.size and s["packets"][0].startswith(MAGIC):
            _, _, track, n, _, wanted = FORMAT.unpack(s["packets"][0])
            tracks[track] = s["packets"][1:]
    if not tracks or sorted(tracks) != list(range(n)):
        return None
    longest = max(map(len, tracks.values()))
    payload = b"".join(tracks[t][i] for i in range(longest) for t in range(n) if i < len(tracks[t]))
    return payload if len(payload) == wanted else None


def features(streams: dict[int, dict], faulty: int, payload: bytes | None) -> str:
    """Streams, pages, packets, faults, milliseconds from granule positions; mean, deviation and peak of the samples."""
    said = f"streams={len(streams)};pages={sum(s['pages'] for s in streams.values())};packets={sum(len(s['packets']) for s in streams.values())};faulty={faulty}"
    said += f";ms={'/'.join(str(1000 * s['granule'] // RATE) for _, s in sorted(streams.items()))}"
    if not payload:
        return said
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    total = int(counts.sum())
    first, second = int(counts @ np.arange(256)), int(counts @ np.arange(256) ** 2)
    return f"{said};mean={first / total:.4f};deviation={max(0, second / total - (first / total) ** 2) ** 0.5:.4f};peak={int(counts.nonzero()[0][-1])}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the Ogg file of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch["text"].cast(pa.binary()).to_pylist()]
            media = [write_ogg(x + PAD * (-len(x) % UNIT if x else UNIT)) for x in raw]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "doc_id bigint, n_bytes bigint, media binary")


def read(stored: DataFrame) -> DataFrame:
    """The stored columns with the payload read back and its features; a null file reads as one without pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, said = [], []
            for data in batch["media"].to_pylist():
                streams, faulty = read_ogg(data or b"")
                payloads.append(samples_of(streams))
                said.append(features(streams, faulty, payloads[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(said, pa.string())], ["doc_id", "n_bytes", "media", "payload", "feature"])

    return arrow_map(stored.select("doc_id", "n_bytes", "media"), run, "doc_id bigint, n_bytes bigint, media binary, payload binary, feature string")


def op2_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read(store(documents(spark, sf_dir)))
    size = lambda name: F.octet_length(name).cast("bigint").alias(f"{name}_bytes")
    digest = lambda name: F.sha2(name, 256).alias(f"{name}_sha256")
    tail = F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32")
    return back.select("doc_id", "n_bytes", size("payload"), digest("payload"), tail, size("media"), digest("media"), "feature")
