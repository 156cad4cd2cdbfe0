"""WARC archives: round trips against a direct computation, and salvage of damaged bytes."""

import base64
import glob
import gzip
import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from nodeloom.llm import warc
from nodeloom.runtime import work_path

LARGE = (1 << 62) + 1
ODD = [
    (1, "http://a/1", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (4, None, "<p>same</p>"), (2, "http://a/2", None),
    (3, "http://a/3", ""), (None, "http://a/n", "<p>same</p>"), (None, None, "without an id"), (None, "x", "without an id"),
    (5, "http://a/5", "twice"), (5, "http://a/5", "twice"), (5, "http://a/5b", "twice"), (LARGE, "http://a/é x\n", "é 😀 \x00\r\n\r\n"),
    (6, "http://a/6", "WARC/1.0\r\nWARC-Type: response\r\n\r\n"), (7, "", "\x1f\x8b\x08 no member"), (8, "u", "long " * 300_000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, payload string")


def expected(rows, revisit_from=0):
    groups = defaultdict(list)
    for i, url, html in rows:
        groups[(html or "").encode()].append((i, url))
    out = Counter()
    for payload, found in groups.items():
        sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""), reverse=True)
        for n, (i, _) in enumerate(found):
            lead = n == 0 or len(payload) < revisit_from
            out[i, len(payload), sha1, "response" if lead else "revisit", None if lead else found[0][0]] += 1
    return out


def read_back(spark, path):
    found = warc.read_archives(spark, path)
    assert warc.gaps(found).count() == 0
    return found, Counter(
        tuple(r) for r in found.select(
            warc.page_of(F.col("record_id")), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to"))
        ).collect()
    )


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("revisit_from", [0, 6])
def test_round_trip(spark, compress, revisit_from):
    path = work_path(spark, "warc")
    warc.write_archives(frame(spark, ODD), path, compress, revisit_from, archive_bytes=500_000)
    found, got = read_back(spark, path)
    assert got == expected(ODD, revisit_from)
    ids = [r.record_id for r in found.collect()]
    assert len(set(ids)) == len(ODD)
    payloads = Counter(bytes(r.payload) for r in found.collect() if r.payload is not None)
    want = Counter((h or "").encode() for _, _, h in ODD)
    assert payloads.keys() == want.keys()
    refers = {r.refers_to for r in found.where("record_type = 'revisit'").collect()}
    assert refers <= {r.record_id for r in found.where("record_type = 'response'").collect()}
    # Any gzip reader takes the members with their padding.
    if compress:
        assert sum(gzip.open(f).read().count(b"WARC-Record-ID: ") for f in glob.glob(path.removeprefix("file:") + "/part*")) == len(ODD)


def test_no_pages(spark):
    path = work_path(spark, "warc")
    warc.write_archives(frame(spark, []), path)
    assert warc.read_archives(spark, path).count() == 0


def test_hot_payload(spark):
    rows = [(n, f"u{n}", "hot" if n % 3 else f"own {n}") for n in range(300)]
    labels = warc.label(frame(spark, rows), hot_rows=10).collect()
    hot = {r.lead_name for r in labels if r.n_bytes == 3}
    assert len(labels) == 300 and len(hot) == 1 and hot.pop().startswith("299:")


def plain(n, text=None):
    payload = (text or f"payload {n} " * (n % 7 + 1)).encode()
    return warc.record_bytes("response", f"urn:page:{n}:-:x:1", f"http://a/{n}", warc.digest(payload), len(payload), payload, None) + b"\r\n\r\n"


def check(pieces, sound):
    """Pieces of bytes, some of them sound records: those come back, and gaps cover all the rest."""
    data, starts = b"".join(pieces), []
    for p in pieces:
        starts.append((starts[-1][1] if starts else 0, (starts[-1][1] if starts else 0) + len(p)))
    found = list(warc.salvage(data))
    got = {x[5].fields["warc-record-id"]: x[:2] for x in found if x[5] is not None}
    assert got == {f"<urn:page:{n}:-:x:1>": starts[at] for at, n in sound.items()}
    covered = sorted(x[:2] for x in found)
    assert all(a[1] <= b[0] for a, b in zip(covered, covered[1:]))
    bad = set()
    for x in found:
        if x[5] is None:
            assert x[4]
            bad |= set(range(x[0], x[1]))
    kept = set()
    for at in sound:
        kept |= set(range(*starts[at]))
    assert not bad & kept
    return found, bad, starts


def test_salvage_of_members():
    good = [warc.member(plain(n)) for n in range(8)]
    flipped = bytearray(good[1])
    flipped[len(flipped) // 2] ^= 0x55
    crc = good[3][:-8] + b"\x01\x02\x03\x04" + good[3][-4:]
    pieces = [good[0], bytes(flipped), good[2], crc, b"\x00", good[4], b"garbage \x1f\x8b\x08 WARC/1.0\r\n", good[5], plain(6), good[7][:20]]
    found, bad, starts = check(pieces, {0: 0, 2: 2, 5: 4, 7: 5, 8: 6})
    for at in (1, 3, 6, 9):
        assert bad & set(range(*starts[at])) == set(range(*starts[at]))
    assert [x[4] for x in found if x[5] is None] == ["member check", "member check", "version line", "end of member"]


def test_salvage_inside_a_member():
    """A sound member that holds a broken record between two sound ones."""
    broken = plain(2).replace(b"payload 2", b"payload 9")
    found = list(warc.salvage(warc.member(plain(1) + broken + plain(3))))
    assert [x[4] for x in found] == [None, "block digest", None]
    assert [x[2:4] for x in found] == [(0, len(plain(1))), (len(plain(1)), len(plain(1) + broken)), (len(plain(1) + broken), len(plain(1) + broken + plain(3)))]
    whole = warc.member(b"no record")
    assert [x[:6] for x in warc.salvage(whole)] == [(0, len(whole), None, None, "version line", None)]


def test_salvage_of_plain_records():
    trap = plain(4, "WARC/1.0\r\nWARC-Type: x\r\n\r\n and \x1f\x8b\x08")
    long = plain(1).replace(b"Content-Length: ", b"Content-Length: 9")
    pieces = [plain(0), long, trap, b"\r\n", plain(5), plain(6).replace(b"WARC-Type", b"WARC+Type"), plain(7), plain(8)[:-9]]
    found, bad, starts = check(pieces, {0: 0, 2: 4, 4: 5, 6: 7})
    assert bad == {p for at in (1, 3, 5, 7) for p in range(*starts[at])}
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"\x00\x00\x00")) == []


def test_salvage_of_random_damage():
    rng = random.Random(5)
    for _ in range(60):
        pieces = [warc.member(plain(n)) if rng.random() < 0.6 else plain(n) for n in range(12)]
        hurt = set(rng.sample(range(12), 4))
        for at in hurt:
            piece = bytearray(pieces[at])
            kind = rng.randrange(3)
            if kind == 0:
                piece[rng.randrange(8, len(piece) - 4)] ^= 1 << rng.randrange(8)
            elif kind == 1:
                del piece[rng.randrange(10, len(piece) - 5) :]
            else:
                piece[12:12] = bytes(rng.randrange(256) for _ in range(30))
            pieces[at] = bytes(piece)
        data = b"".join(pieces)
        got = {x[5].fields["warc-record-id"]: x[5] for x in warc.salvage(data) if x[5] is not None}
        for n in set(range(12)) - hurt:
            assert f"<urn:page:{n}:-:x:1>" in got


def test_damaged_archive_in_spark(spark):
    path = work_path(spark, "warc")
    warc.write_archives(frame(spark, [(n, f"u{n}", f"text {n}") for n in range(200)]), path, archive_bytes=10**9)
    (file,) = [f for f in glob.glob(path.removeprefix("file:") + "/part*") if not f.endswith(".crc")]
    data = bytearray(open(file, "rb").read())
    data[len(data) // 2] ^= 0xFF
    other = work_path(spark, "warc")
    spark.createDataFrame([(data,)], "value binary").selectExpr("cast(value as string) value").coalesce(1).write.option("lineSep", "\x00").text(other)
    found = warc.read_archives(spark, other, payloads=False)
    assert found.where("problem is null").count() == 199
    (gap,) = warc.gaps(found).collect()
    assert gap.start <= len(data) // 2 < gap.end
