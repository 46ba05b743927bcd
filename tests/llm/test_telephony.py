import hashlib
import random
import zlib

import numpy as np

from ragtide.llm import telephony as t

from .conftest import LONG


def slow_adpcm(block):
    steps, out = [7, 8, 9, 10, 11, 12, 13, 14, 16], []
    while len(steps) < 89:
        steps.append(None)
    steps = t._STEP.tolist()
    now = int.from_bytes(block[:2], "little", signed=True)
    at = min(block[2], 88)
    out.append(now)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = steps[at]
            move = step >> 3
            for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
                move += part if code & bit else 0
            now = max(-32768, min(32767, now - move if code & 8 else now + move))
            at = max(0, min(88, at + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
            out.append(now)
    return out


def test_tables_hold_the_standards_values():
    assert [int(t.MU_LAW[c]) for c in (0x00, 0x7F, 0x80, 0xFF, 0xFE)] == [-32124, 0, 32124, 0, 8]
    assert [int(t.A_LAW[c]) for c in (0xD5, 0x55, 0xAA, 0x2A)] == [8, -8, 32256, -32256]
    assert len(set(t.A_LAW.tolist())) == 256


def test_adpcm_blocks_together_are_as_one_by_one():
    r = random.Random(5)
    blocks = np.array([[r.randrange(256) for _ in range(64)] for _ in range(40)], np.uint8)
    got = t.decode_adpcm(blocks)
    assert got.shape == (121, 40)
    for i, b in enumerate(blocks):
        assert got[:, i].tolist() == slow_adpcm(b.tolist())


def test_resampling_keeps_samples():
    pcm = np.array([0, 1000, -1000, 32767, -32768], np.int16)
    assert t.resample_double(pcm)[::2].tolist() == pcm.tolist()
    assert abs(int(t.resample_double(np.full(50, 800, np.int16))[41]) - 800) <= 2


def expanded(code, law):
    """A code's sample, worked out bit by bit."""
    if law == "mu":
        code = ~code & 255
        size = ((2 * (code & 15) + 33) << (code >> 4 & 7)) - 33 << 2
        return -size if code & 128 else size
    code ^= 0x55
    part, fine = code >> 4 & 7, code & 15
    size = (2 * fine + 1 if part == 0 else (2 * fine + 33) << part - 1) << 3
    return size if code & 128 else -size


def slow_features(whole):
    """The feature, and the length and checksum of the PCM file, sample by sample."""
    mu, a = [expanded(c, "mu") for c in whole], [expanded(c, "a") for c in whole]
    adpcm = [x for i in range(0, len(whole), 64) for x in slow_adpcm(list(whole[i : i + 64]))]
    top = lambda v: max(map(abs, v))
    energy = lambda v: sum(x * x for x in v)
    turns = sum((x < 0) != (y < 0) for x, y in zip(mu, mu[1:]))
    taps, out = t._TAPS.tolist(), []
    for i, x in enumerate(mu):
        near = [mu[j] if 0 <= j < len(mu) else 0 for j in range(i - 3, i + 5)]
        out += [x, max(-32768, min(32767, sum(u * v for u, v in zip(near, taps)) + 16384 >> 15))]
    pcm = t.wav(np.array(out, "<i2").tobytes(), 1, 16000, 16)
    return f"mu {top(mu)} {energy(mu)} {turns};a {top(a)} {energy(a)};adpcm {top(adpcm)} {energy(adpcm)}", len(pcm), zlib.crc32(pcm)


def test_rows(documents):
    rows = [(1, "hello"), (2, None), (3, ""), (4, "hello"), (4, "hello"), (None, "ü" * 64), (6, LONG)]
    got = t.read_audio(t.store_audio(documents(rows), "doc_id", "text")).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        text = next(x for i, x in rows if i == r["id"])
        raw = (text or "").encode()
        whole = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(whole))
        assert r["payload_sha256"] == hashlib.sha256(whole).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(whole[-64:])
        assert by_text.setdefault(text or "", r[1:]) == r[1:]
        assert (r["feature"], r["pcm_bytes"], r["pcm_crc32"]) == slow_features(whole)
    assert t.read_audio(t.store_audio(documents([]), "doc_id", "text")).count() == 0


def test_stored_form_has_both_files(documents):
    r = t.store_audio(documents([(1, "abc")]), "doc_id", "text").first()
    tag, rate, data = t.read_wav(bytes(r["media"]))
    assert (tag, rate, data) == (7, 8000, b"abc" + b"\0" * 61)
    tag, rate, data = t.read_wav(bytes(r["pcm"]))
    assert (tag, rate, len(data)) == (1, 16000, 256)
    assert np.frombuffer(data, np.int16)[::2].tolist() == t.MU_LAW[np.frombuffer(b"abc" + b"\0" * 61, np.uint8)].tolist()
