import hashlib
import random
import re

import pytest

from spindrift.llm import audio, licenses

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1408, 1409, 2816, 5000, 200_000])
def test_payload_round_trip(n):
    payload = audio.pad(bytes(random.Random(n).randrange(256) for _ in range(n)))
    media = audio.write_mpeg(payload)
    scan = audio.scan_mpeg(media)
    assert audio.read_payload(media, scan) == payload and len(payload) % 64 == 0 and payload
    assert scan.crc_bad == 0 and scan.crc_ok == scan.frames == scan.vbr_frames and scan.skipped == 0
    assert scan.samples == 1152 * scan.frames and scan.seconds == pytest.approx(scan.samples / 32000)
    assert scan.vbr_bytes == len(media) - 128 - (scan.offsets[0] - audio.header(media[scan.offsets[0] - 252 :][:4])[5]) and len(scan.toc) == 100


def test_resynchronises_and_verifies():
    media = bytearray(audio.write_mpeg(audio.pad(b"x" * 4000)))
    clean = audio.scan_mpeg(bytes(media))
    at = clean.offsets[1]
    junk = bytes(media[:at]) + b"\xff\xfajunk\xff" + bytes(media[at:])  # the second byte pair looks like a frame's start
    scan = audio.scan_mpeg(junk)
    assert scan.frames == clean.frames and scan.skipped == 7 and scan.offsets[1] == at + 7
    media[at + 10] ^= 1
    assert audio.scan_mpeg(bytes(media)).crc_bad == 1
    assert audio.scan_mpeg(b"no audio at all").frames == 0 and audio.scan_mpeg(b"").skipped == 0


def with_checksum(head, bits, length):
    """A frame of a header and the bits its checksum covers, the checksum by long division."""
    crc = 0xFFFF
    for bit in f"{int.from_bytes(head[2:], 'big'):016b}" + bits:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) != int(bit) else 0)) & 0xFFFF
    body = int(bits.ljust(-(-len(bits) // 8) * 8, "1"), 2).to_bytes(-(-len(bits) // 8), "big")
    return (head + crc.to_bytes(2, "big") + body).ljust(length, b"\x55")


@pytest.mark.parametrize(
    "head, sizes",
    [
        ("fffe98c0", [(4, 1)] * 32),  # Layer I, mono
        ("fffe9800", [(4, 2)] * 32),  # stereo
        ("fffe9850", [(4, 2)] * 8 + [(4, 1)] * 24),  # joint from band 8 on
        ("fffc84c0", [(4, 1)] * 11 + [(3, 1)] * 12 + [(2, 1)] * 4),  # Layer II, 48 kHz, 128 kbit/s, mono
        ("fffc9000", [(4, 2)] * 11 + [(3, 2)] * 12 + [(2, 2)] * 4),  # 44.1 kHz, 80 kbit/s a channel
        ("fffcc040", [(4, 2)] * 4 + [(4, 1)] * 7 + [(3, 1)] * 12 + [(2, 1)] * 7),  # 128 a channel, joint from band 4 on
        ("fffc14c0", [(4, 1)] * 2 + [(3, 1)] * 6),  # 32 kbit/s, mono
        ("fffc18c0", [(4, 1)] * 2 + [(3, 1)] * 10),  # the same at 32 kHz
        ("fff480c0", [(4, 1)] * 4 + [(3, 1)] * 7 + [(2, 1)] * 19),  # MPEG-2
    ],
)
def test_checksums_of_layers_one_and_two(head, sizes):
    head, rng = bytes.fromhex(head), random.Random(4)
    _, layer, protected, *_, mono = found = audio.header(head)
    assert protected
    frames = []
    for _ in range(6):
        bits, chosen = "", 0
        for n, stored in sizes:
            for _ in range(stored):
                value = rng.choice([0, rng.randrange(1 << n) if layer == 2 else rng.randrange(15)])
                bits += f"{value:0{n}b}"
                chosen += (value > 0) * (1 if mono or stored == 2 else 2)
        bits += "".join(rng.choice("01") for _ in range(2 * chosen * (layer == 2)))
        frames.append(bytearray(with_checksum(head, bits, found[5])))
    scan = audio.scan_mpeg(b"".join(frames))
    assert (scan.frames, scan.crc_ok, scan.crc_bad, scan.skipped) == (6, 6, 0, 0)
    frames[2][7] ^= 8
    scan = audio.scan_mpeg(b"".join(frames))
    assert (scan.frames, scan.crc_ok, scan.crc_bad) == (6, 5, 1)


def test_headers():
    assert audio.header(bytes((0xFF, 0xFB, 0x90, 0x00)))[3:7] == (128, 44100, 417, 1152)
    assert audio.header(bytes((0xFF, 0xF3, 0x80, 0xC0)))[3:7] == (64, 22050, 208, 576)
    assert audio.header(b"\xff\xfb\xf0\x00") is None and audio.header(b"ab") is None
    assert audio.crc16(b"123456789") == 0xAEE7


def test_media_operators(docs):
    df = docs("héllo", None, "héllo", "x" * 100_000)
    got = {r["doc_id"]: r for r in audio.media_roundtrip(df).collect()}
    want = audio.pad("héllo".encode())
    assert got[0]["payload_sha256"] == hashlib.sha256(want).hexdigest() and got[0]["n_bytes"] == 6 and got[0]["payload_bytes"] == 64
    assert (got[1]["n_bytes"], got[1]["payload_bytes"]) == (0, 64)
    assert got[0]["feature"] == got[2]["feature"] and got[0]["media_sha256"] == got[2]["media_sha256"]
    scans = {r["doc_id"]: r for r in audio.scan_media(audio.store_as_mpeg(df)).collect()}
    assert scans[3]["frames"] == got[3]["frames"] and scans[3]["tags"]["payload_bytes"] == str(got[3]["payload_bytes"]) and len(scans[3]["offsets"]) == scans[3]["frames"]
    assert audio.media_roundtrip(docs()).collect() == []


def brute(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def test_base_places():
    rng = random.Random(3)
    signs = ["cc", "by", "CC-BY", "general", "public", "License", "all", "rights", "reserved", "é", "by.", "\x00", "ccby"]
    for _ in range(2000):
        text = rng.choice([" ", "-", "\n"]).join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        found = licenses.scan_text(text)
        assert (found["n_words"], found["base"]) == brute(text)


def test_templates():
    spans = lambda t: licenses.scan_text(t)["spans"]
    assert spans("x Released under the MIT License.") == [("mit", 1, 6)]
    assert spans("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.")[0][2] == 22
    assert spans("GNU General Public License, version 3.") == [("gpl", 0, 6)]
    assert spans("gnu generic public license") == []
    assert spans("Copyright (c) 2020 Some Name. All rights reserved.") == [("copyright", 0, 8)]
    own = (("t", "alpha <<beginOptional>>beta <<beginOptional>>gamma<<endOptional>><<endOptional>> <<var;name=x;words=1-2>> omega"),)
    accepts = lambda t: bool(licenses.scan_text(t, own)["spans"])
    assert all(map(accepts, ["alpha x omega", "alpha beta x omega", "alpha beta gamma x y omega", "alpha x y omega"]))
    assert not any(map(accepts, ["alpha omega", "alpha x y z omega", "alpha x omeg", "beta x omega"]))
    for bad in ("<<beginOptional>>x", "x<<endOptional>>", "<<var;name=a;words=1-2>>"):
        with pytest.raises(ValueError):
            licenses.compile_template("bad", bad)


def test_license_operator(docs):
    got = {r["doc_id"]: r for r in licenses.scan(docs("Licensed under CC BY-NC 4.0.", None, "a " * 50_000 + "all rights reserved", "plain")).collect()}
    assert (got[0]["base_labels"], got[0]["labels"], got[0]["first_word"]) == ("cc-by", "cc-by,cc-by-nc", 2)
    assert (got[1]["n_words"], got[1]["first_word"], got[1]["labels"], got[1]["score"]) == (0, None, "", 0.0)
    assert (got[2]["first_word"], got[2]["last_word"], got[2]["score"]) == (50_000, 50_000, 0.5)
    assert licenses.scan(docs()).collect() == []
