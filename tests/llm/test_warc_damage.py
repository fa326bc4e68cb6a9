"""Damage inside records and members: nothing forged, no sound record lost."""

import hashlib
import io
import random

from loomveil.llm import warc


def record(page, payload):
    return warc.record_bytes(page, f"http://x/{page}", payload, hashlib.sha1(payload).digest(), None)


def flipped(data, what):
    at = data.index(what)
    return data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]


def read(data):
    rows = list(warc.salvage(io.BytesIO(data)))
    return [warc.page_row(*r[2:])[0] for r in rows if r[0] == "record"], [r[1:] for r in rows if r[0] == "gap"]


def test_a_damaged_payload_forges_no_record():
    inner = record(99, b"inner")
    for inside in (inner, warc.member(inner)):
        bad = flipped(record(2, b"outer payload " + inside), b"outer")
        data = record(1, b"a") + bad + record(3, b"c")
        first = len(record(1, b"a"))
        assert read(data) == ([1, 3], [(first, first + len(bad), "block digest")])
        assert read(bad) == ([], [(0, len(bad), "block digest")])


def test_sound_records_of_a_damaged_member_are_given():
    parts = [record(i, f"payload {i}".encode() * 50) for i in range(4)]
    for k in range(4):
        for what, why in ((b"payload", "block digest"), (b"WARC/1.1", "version line"), (b"Content-Length: 1", "header")):
            bad = flipped(parts[k], what) if why != "header" else parts[k].replace(b"WARC-Date: ", b"WARC-Date; ", 1).replace(b"T00:00:00Z", b"")
            one = warc.member(b"".join([*parts[:k], bad, *parts[k + 1 :]]))
            pages, gaps = read(one + warc.member(record(7, b"z")))
            assert pages == [*(i for i in range(4) if i != k), 7]
            assert gaps == [(0, len(one), why)]


def test_records_before_the_damage_of_a_member_and_all_later_members():
    rnd = random.Random(2)
    big = [record(i, rnd.randbytes(400_000)) for i in range(3)]
    one, last = warc.member(b"".join(big)), warc.member(record(9, b"z"))
    broken = one[: len(one) - 300_000]
    pages, gaps = read(broken + last)
    assert pages == [0, 1, 9] and len(gaps) == 1 and gaps[0][1] == len(broken)
    assert read(broken)[0] == [0, 1]
    assert read(one + last) == ([0, 1, 2, 9], [])


def test_one_flipped_byte_anywhere_loses_one_record_at_most():
    parts = [record(i, bytes([65 + i]) * 30) for i in range(3)]
    data, rnd = b"".join(map(warc.member, parts)), random.Random(3)
    for _ in range(200):
        at = rnd.randrange(len(data))
        pages, gaps = read(data[:at] + bytes([data[at] ^ (1 << rnd.randrange(8))]) + data[at + 1 :])
        assert len(pages) >= 2 and set(pages) <= {0, 1, 2} and (len(pages) == 3 or gaps)
