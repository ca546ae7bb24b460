"""MPEG audio columns: a lossless carrier for bytes, and a scanner of frames, tags and seek tables.

`write_mpeg` stores a payload in the ancillary bytes of silent Layer III frames
(MPEG-1, 32 kHz, mono, checksummed), led by an ID3v2 tag and a Xing table and
ended by an ID3v1 tag.  `scan_mpeg` takes any MPEG audio bytes: it resynchronises on frame
headers, parses the tags and the Xing or VBRI table, verifies the frame checksums
and gives exact durations and frame seek offsets.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_texts

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bitrate index, Hz by sampling index.
V1_L1 = (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
V1_L2 = (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
V1_L3 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
V2_L1 = (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
V2_L23 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
HZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}

UNIT = 64
#: Header, checksum and mono side information in front of a carrier frame's own bytes.
LEAD = 4 + 2 + 17


@lru_cache(maxsize=4096)
def header(word: bytes) -> tuple | None:
    """(version, layer, protected, bitrate, hz, length, samples, side bytes, mono) of four header bytes; None if they are none."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = (2.5, None, 2, 1)[word[1] >> 3 & 3]
    layer = (None, 3, 2, 1)[word[1] >> 1 & 3]
    rate, hz, pad = word[2] >> 4, word[2] >> 2 & 3, word[2] >> 1 & 1
    if version is None or layer is None or rate in (0, 15) or hz == 3:  # free format has no length of its own
        return None
    table = {1: V1_L1, 2: V1_L2, 3: V1_L3}[layer] if version == 1 else V2_L1 if layer == 1 else V2_L23
    kbit, hz = table[rate], HZ[version][hz]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    length = (12000 * kbit // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbit // hz + pad
    mono = word[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return version, layer, not word[1] & 1, kbit, hz, length, samples, side, mono


@lru_cache(maxsize=65_536)
def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005 from 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def crc16_bits(data: bytes, bits: int) -> int:
    """crc16 of the first bits of data."""
    crc = crc16(data[: bits // 8])
    for k in range(bits % 8):
        crc = (crc << 1 ^ 0x8005 if crc >> 15 ^ data[bits // 8] >> 7 - k & 1 else crc << 1) & 0xFFFF
    return crc


def layer2_bits(version: float, kbit: int, hz: int, channels: int) -> tuple[int, ...]:
    """Bits of the allocation of each subband of a Layer II frame (ISO/IEC 11172-3 tables B.2a to d, 13818-3 table B.1)."""
    if version != 1:
        return (4,) * 4 + (3,) * 7 + (2,) * 19
    each = kbit // channels
    if each <= 48:
        return (4,) * 2 + (3,) * (10 if hz == 32000 else 6)
    return (4,) * 11 + (3,) * 12 + (2,) * (4 if each <= 80 or hz == 48000 else 7)


def protected_bits(frame: bytes, found: tuple) -> int | None:
    """Bits behind header and checksum that the checksum covers: side information, allocation, in Layer II selection as well; None if the frame is too short."""
    version, layer, _, kbit, hz, _, _, side, mono = found
    if layer == 3:
        return 8 * side if len(frame) >= 6 + side else None
    channels = 1 if mono else 2
    bound = 4 * ((frame[3] >> 4 & 3) + 1) if frame[3] >> 6 == 1 else 32  # from there on joint stereo shares what it allocates
    sizes = (4,) * 32 if layer == 1 else layer2_bits(version, kbit, hz, channels)
    bits = sum(n * (channels if band < bound else 1) for band, n in enumerate(sizes))
    if layer == 2:
        body, at = int.from_bytes(frame[6 : 6 + (bits + 7) // 8], "big") >> -bits % 8, bits
        for band, n in enumerate(sizes):
            for _ in range(channels if band < bound else 1):
                at -= n
                # two bits a channel that has samples in the band
                bits += 2 * (1 if band < bound else channels) * bool(body >> at & (1 << n) - 1)
    return bits if 8 * (len(frame) - 6) >= bits else None


def checked(frame: bytes, found: tuple) -> bool:
    """Whether a protected frame's checksum holds."""
    bits = protected_bits(frame, found)
    return bits is not None and int.from_bytes(frame[4:6], "big") == crc16_bits(frame[2:4] + frame[6:], 16 + bits)


def syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


@lru_cache(maxsize=64)
def carrier(index: int) -> tuple[bytes, int]:
    """Head of a silent carrier frame of a bitrate index, and the bytes left in it."""
    head = bytes((0xFF, 0xFA, index << 4 | 2 << 2, 0xC0))
    side = bytes(17)
    length = header(head)[5]
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side, length - LEAD


def pad(data: bytes) -> bytes:
    """data and zero bytes up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def write_mpeg(payload: bytes) -> bytes:
    """payload (whole units of 64 bytes) as an MPEG stream."""
    full, room = carrier(14)
    room -= room % UNIT
    frames = []
    whole = len(payload) - len(payload) % room
    for at in range(0, whole, room):
        frames.append(full + payload[at : at + room] + bytes(carrier(14)[1] - room))
    if rest := payload[whole:]:
        index = next(k for k in range(1, 15) if carrier(k)[1] >= len(rest))
        head, space = carrier(index)
        frames.append(head + rest + bytes(space - len(rest)))
    audio = b"".join(frames)
    text = b"\x03payload_bytes\x00" + str(len(payload)).encode()
    frame = b"TXXX" + syncsafe(len(text)) + b"\x00\x00" + text
    tag = b"ID3\x04\x00\x00" + syncsafe(len(frame)) + frame
    head, space = carrier(4)  # 56 kbit/s hold the table
    size = header(head[:4])[5] + len(audio)
    starts = [header(head[:4])[5]]
    for f in frames:
        starts.append(starts[-1] + len(f))
    toc = bytes(min(255, starts[min(len(frames) - 1, p * len(frames) // 100)] * 256 // size) for p in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + size.to_bytes(4, "big") + toc
    # a table frame goes unprotected: players look for it right behind the side information
    lead = bytes((0xFF, 0xFB, 4 << 4 | 2 << 2, 0xC0)) + bytes(17)
    table = lead + xing + bytes(space + 2 - len(xing))
    v1 = b"TAG" + b"payload".ljust(30, b"\0") + bytes(94) + b"\xff"
    return tag + table + audio + v1


@dataclass
class Scan:
    """What scan_mpeg found; offsets are those of audio frames from the first byte on."""

    tags: dict[str, str] = field(default_factory=dict)
    frames: int = 0
    samples: int = 0
    seconds: float = 0.0
    hz: int = 0
    kbit: dict[int, int] = field(default_factory=dict)
    vbr: str = ""
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    toc: bytes = b""
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0
    offsets: list[int] = field(default_factory=list)


def _tag(data: bytes, scan: Scan) -> int:
    """Parse an ID3v2 tag at the front; where the audio may begin."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 0x80 for b in data[6:10]):
        return 0
    size = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end, at = min(len(data), 10 + size(data[6:10])), 10
    while at + 10 <= end and data[at]:
        name = data[at : at + 4].decode("latin-1")
        n = size(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : min(end, at + 10 + n)]
        if name[0] == "T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            key, _, value = body[1:].decode(code, "replace").partition("\0") if name == "TXXX" else (name, "", body[1:].decode(code, "replace"))
            scan.tags[key] = value.rstrip("\0")
        at += 10 + n
    return 10 + size(data[6:10]) + (10 if data[5] & 0x10 else 0)


def scan_mpeg(data: bytes) -> Scan:
    """Frames, tags and tables of MPEG audio bytes; foreign bytes are skipped and counted."""
    scan = Scan()
    at = _tag(data, scan)
    end = len(data)
    if data[-128:-125] == b"TAG":
        end -= 128
        scan.tags["ID3v1"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    while at + 4 <= end:
        found = header(data[at : at + 4])
        if found:
            _, layer, protected, kbit, hz, length, samples, side, _ = found
            body = at + 4 + 2 * protected + side
            good = protected and checked(data[at : min(end, at + length)], found)
            after = header(data[at + length : at + length + 4])
            # four bytes that look like a header are none unless the checksum holds or a frame of the kind, or the end, follows
            found = at + length <= end and (good or at + length == end or bool(after and after[1] == layer and after[4] == hz))
        if not found:
            nxt = data.find(b"\xff", at + 1, end)
            scan.skipped += (nxt if nxt >= 0 else end) - at
            at = nxt if nxt >= 0 else end
            continue
        mark = data[body : body + 4] if not scan.frames else b""
        vbri = data[at + 36 : at + 40] if not scan.frames else b""
        if mark in (b"Xing", b"Info"):
            flags, p = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8
            scan.vbr = mark.decode()
            if flags & 1:
                scan.vbr_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 2:
                scan.vbr_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4:
                scan.toc = data[p : p + 100]
        elif vbri == b"VBRI":
            scan.vbr = "VBRI"
            scan.vbr_bytes = int.from_bytes(data[at + 46 : at + 50], "big")
            scan.vbr_frames = int.from_bytes(data[at + 50 : at + 54], "big")
        else:
            if protected:
                scan.crc_ok += good
                scan.crc_bad += not good
            scan.frames += 1
            scan.samples += samples
            scan.hz = scan.hz or hz
            scan.seconds += samples / hz
            scan.kbit[kbit] = scan.kbit.get(kbit, 0) + 1
            scan.offsets.append(at)
        at += length
    scan.skipped += max(0, end - at)
    if scan.hz:
        scan.seconds = round(scan.seconds, 9)
    return scan


def read_payload(data: bytes, scan: Scan) -> bytes:
    """The bytes that write_mpeg stored, out of the frames that scan found."""
    left, parts = int(scan.tags["payload_bytes"]), []
    for at in scan.offsets:
        space = header(data[at : at + 4])[5] - LEAD
        take = min(left, space - space % UNIT if left > space else left)
        parts.append(data[at + LEAD : at + LEAD + take])
        left -= take
    if left:
        raise ValueError("the stream holds fewer bytes than its tag states")
    return b"".join(parts)


def feature(scan: Scan) -> str:
    """Duration, rates, checksums and seek offsets of a stream, in one line."""
    seek = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in scan.offsets))
    rates = ",".join(f"{k}x{n}" for k, n in sorted(scan.kbit.items()))
    return (
        f"hz={scan.hz};frames={scan.frames};samples={scan.samples};seconds={scan.seconds:.6f};kbit={rates};"
        f"vbr={scan.vbr}:{scan.vbr_frames}:{scan.vbr_bytes};crc={scan.crc_ok}/{scan.crc_bad};seek={seek:08x}"
    )


def store_as_mpeg(docs: DataFrame) -> DataFrame:
    """doc_id and media (binary): every whole text, null as empty, as an MPEG stream; repeated rows stay repeated."""
    work = lambda ids, texts: {"doc_id": ids, "media": [write_mpeg(pad(t.encode())) for t in texts]}
    return map_texts(docs, lambda: work, "doc_id long, media binary")


def scan_media(media: DataFrame) -> DataFrame:
    """Frames, samples, seconds, checksums, tags and seek offsets of the streams in a media column; null media give no frames."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            scans = [scan_mpeg(m or b"") for m in pdf["media"]]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "frames": [s.frames for s in scans],
                    "samples": [s.samples for s in scans],
                    "seconds": [s.seconds for s in scans],
                    "crc_ok": [s.crc_ok for s in scans],
                    "crc_bad": [s.crc_bad for s in scans],
                    "skipped": [s.skipped for s in scans],
                    "tags": [s.tags for s in scans],
                    "offsets": [s.offsets for s in scans],
                }
            )

    schema = "doc_id long, frames long, samples long, seconds double, crc_ok long, crc_bad long, skipped long, tags map<string,string>, offsets array<long>"
    return media.select("doc_id", "media").mapInPandas(run, schema)


def media_roundtrip(docs: DataFrame) -> DataFrame:
    """Store each whole text as MPEG, read the stored bytes back and digest both.

    Null and empty texts are one unit of zero bytes; equal texts give equal values;
    repeated rows stay repeated; an empty table gives an empty result; other columns are not read.
    """

    def work(ids, texts):
        out = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "seconds")}
        for text in texts:
            raw = text.encode()
            media = write_mpeg(pad(raw))
            scan = scan_mpeg(media)
            payload = read_payload(media, scan)
            out["n_bytes"].append(len(raw))
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-UNIT:]))
            out["media_bytes"].append(len(media))
            out["media_sha256"].append(hashlib.sha256(media).hexdigest())
            out["feature"].append(feature(scan))
            out["frames"].append(scan.frames)
            out["seconds"].append(scan.seconds)
        return out | {"doc_id": ids}

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, seconds double"
    return map_texts(docs, lambda: work, schema)
