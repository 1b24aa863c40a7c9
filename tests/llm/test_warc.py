"""Archives: exact round trip, revisits, salvage of damaged files."""

import random
from base64 import b32encode, b64encode
from hashlib import sha1, sha256

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import queries, warc

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                       T.StructField("html", T.StringType()), T.StructField("content", T.StringType())])
BIG = "<p>" + "x" * 200 + "é" * 50


def pages(spark, data):
    return spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)


def brute(data, least=100):
    out = []
    for i, _, html in data:
        raw = (html or "").encode()
        same = [j for j, _, h in data if (h or "") == (html or "")]
        first = min((j for j in same if j is not None), default=None)
        again = len(raw) >= least and first is not None and i != first
        out.append((str(i) if i is not None else "", len(raw), sha256(raw).hexdigest(), "revisit" if again else "response",
                    str(first) if again else None))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


DATA = ([(i, f"http://a/{i}", BIG if i % 3 else f"page {i} " * 30) for i in range(60)]
        + [(60, None, None), (61, "u\r\nWARC/1.1", ""), (62, "u", "y" * 99), (63, "u", "y" * 99), (64, "u", "y" * 100),
           (65, "u", "y" * 100), (65, "u", "y" * 100), (64, "u", "y" * 100), (None, "n", "y" * 100), (None, None, "z" * 500),
           (None, None, "z" * 500), (70, "u", "WARC/1.1\r\n\r\n" + "a\r\n\r\n" * 50), (71, "u", "\x1f\x8b\x08" * 40), (72, "u", "é" * 300_000)])


def test_round_trip(spark):
    read = warc.read_archives(warc.write_archives(pages(spark, DATA)))
    assert result(read) == brute(DATA)
    payloads = {r.record_id: bytes(r.payload) for r in read.where("record_type = 'response'").collect()}
    for i, _, html in DATA:
        if i is not None and str(i) in payloads:
            assert payloads[str(i)] == (html or "").encode()


def test_op6_with_null_ids(spark, scratch_dir):
    pages(spark, DATA).write.parquet(f"{scratch_dir}/pages.parquet")
    got = [(str(r.page_id) if r.page_id is not None else "", r.payload_bytes, r.payload_digest, r.record_type,
            str(r.refers_to) if r.refers_to is not None else None) for r in queries.op6_warc(spark, scratch_dir).collect()]
    assert sorted(got, key=repr) == brute(DATA)


def test_empty(spark):
    assert warc.read_archives(warc.write_archives(pages(spark, []))).collect() == []
    odd = spark.createDataFrame([("a", None), ("b", b""), (None, b"junk")], "archive string, content binary")
    assert [(r.record_type, r.byte_length, r.gap_reason) for r in warc.read_archives(odd).collect()] == [("gap", 4, "version line")]


def _records(n, plain):
    out = []
    for i in range(n):
        body = (f"record {i} " * (5 + i)).encode()
        r = warc.record("response", i, f"http://x/{i}", body, sha256(body).hexdigest(), None)
        out.append(r if plain else warc.gzip_member(r))
    return out


def test_salvage_recovers_later_records():
    rnd = random.Random(2)
    for plain in (True, False):
        parts = _records(12, plain)
        for _ in range(60):
            hit = rnd.randrange(12)
            bad = bytearray(parts[hit])
            kind = rnd.randrange(3)
            if kind == 0:
                # a plain record's header fields carry no checksum
                at = rnd.randrange(bad.index(b"HTTP/") if plain else 0, len(bad))
                bad[at] ^= 0xFF
            elif kind == 1:
                del bad[rnd.randrange(1, len(bad)):]
            else:
                bad = bytearray(b"garbage WARC/1.1\r\n \x1f\x8b\x08") + bad
            content = b"".join([*parts[:hit], bytes(bad), *parts[hit + 1:]])
            found = list(warc.salvage(content))
            good = [f["record_id"] for *_, f in found if isinstance(f, dict)]
            want = [str(i) for i in range(12) if i != hit]
            assert [g for g in good if g != str(hit)] == want and (kind == 2) <= (str(hit) in good)
            assert sum(n for _, n, _ in found) == len(content)
            assert [o for o, *_ in found] == sorted(o for o, *_ in found)


def _salvaged(content):
    found = list(warc.salvage(content))
    assert sum(n for _, n, _ in found) == len(content) and [o for o, *_ in found] == sorted(o for o, *_ in found)
    return [f["record_id"] for *_, f in found if isinstance(f, dict)], [f for *_, f in found if isinstance(f, str)]


def test_members_of_many_records():
    rnd = random.Random(3)
    parts = []
    for i in range(9):
        body = rnd.randbytes(20_000).hex().encode()
        parts.append(warc.record("response", i, f"http://x/{i}", body, sha256(body).hexdigest(), None))
    ids = [str(i) for i in range(9)]
    whole = warc.gzip_member(b"".join(parts))
    after = warc.gzip_member(_records(12, True)[11])
    assert _salvaged(whole) == (ids, [])
    assert _salvaged(whole + after) == ([*ids, "11"], [])
    hurt = b"".join([*parts[:4], parts[4].replace(b"HTTP/1.1 200", b"HTTP/1.1 404"), *parts[5:]])
    good, gaps = _salvaged(warc.gzip_member(hurt))
    assert good == ids[:4] + ids[5:] and len(gaps) == 1 and gaps[0].startswith("block digest (bytes ")
    cut = whole[:len(whole) * 7 // 10]
    good, gaps = _salvaged(cut)
    assert good == ids[:6] and gaps == ["gzip member cut off"]
    good, gaps = _salvaged(after + cut + after)
    assert sorted(good) == sorted([*ids[:6], "11", "11"]) and len(gaps) == 1


def test_digests_in_common_encodings():
    plain = _records(1, True)[0]
    block = plain[plain.index(b"HTTP/"):-4]
    payload = block.partition(b"\r\n\r\n")[2]
    old_block, old_payload = warc.block_digest(block).encode(), b"sha256:" + sha256(payload).hexdigest().encode()
    for code in (bytes.hex, lambda d: d.hex().upper(), lambda d: b32encode(d).decode(), lambda d: b32encode(d).decode().lower(),
                 lambda d: b64encode(d).decode()):
        for label in ("sha1", "SHA-1"):
            new = plain.replace(old_block, f"{label}:{code(sha1(block).digest())}".encode())
            new = new.replace(old_payload, f"sha256:{code(sha256(payload).digest())}".encode())
            assert _salvaged(new) == (["0"], []) and _salvaged(warc.gzip_member(new)) == (["0"], [])
            assert _salvaged(new.replace(b"record 0", b"record 1", 1)) == ([], ["block digest"])


def test_real_files(spark, scratch_dir):
    parts = _records(5, False)
    with open(f"{scratch_dir}/a.warc.gz", "wb") as f:
        f.write(parts[0] + b"damage" + b"".join(parts[1:]))
    with open(f"{scratch_dir}/b.warc", "wb") as f:
        f.write(b"".join(_records(3, True)))
    read = warc.read_archives(spark.read.format("binaryFile").load(scratch_dir), "path", "content")
    got = read.groupBy(F.regexp_extract("archive", "[^/]*$", 0).alias("f"), "record_type").count().collect()
    assert sorted((r.f, r.record_type, r["count"]) for r in got) == [
        ("a.warc.gz", "gap", 1), ("a.warc.gz", "response", 5), ("b.warc", "response", 3)]


def test_archive_of_many_records(spark, monkeypatch):
    """Records are handed on in groups, in order, none lost between two."""
    content = b"".join(warc.gzip_member(warc.record("response", i, "http://x", b"%d" % i, sha256(b"%d" % i).hexdigest(), None)) for i in range(25_000))
    assert 25_000 > 2 * warc.GROUP_RECORDS
    archives = spark.createDataFrame([("a", bytearray(content)), ("empty", None)], "archive string, content binary")
    got = warc.read_archives(archives).select("record_id", "byte_offset", "byte_length", "payload").collect()
    assert [r.record_id for r in got] == [str(i) for i in range(25_000)] and got[-1].byte_offset + got[-1].byte_length == len(content)
    assert [r.payload for r in got[::5000]] == [b"%d" % i for i in range(0, 25_000, 5000)]
