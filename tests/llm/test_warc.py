"""WARC archives: writing, reading back, and archives that break the format."""

import struct

import pytest
import zstandard

from perilscope.llm import warc


def archive(records, dictionary=None):
    frame = zstandard.ZstdCompressor(dict_data=dictionary).compress
    head = b""
    if dictionary is not None:
        data = dictionary.as_bytes()
        head = struct.pack("<II", warc.DICTIONARY_FRAME, len(data)) + data
    return head + b"".join(frame(r) for r in records)


def record(payload=b"hello", kind="response", refers=None):
    return warc.record_bytes(kind, "<urn:perilscope:page:1>", payload, "http://a/ b\n", refers)


def read(data):
    return list(warc.read_archive(data, "x"))


def test_round_trip_without_dictionary():
    found = read(archive([record(b""), record("é\r\n\r\n".encode()), record(b"z", "revisit", "r")]))
    assert [r["payload"] for r in found] == [b"", "é\r\n\r\n".encode(), None]
    assert [r["payload_bytes"] for r in found] == [0, 6, 1]
    assert found[2]["refers_to_id"] == "r" and found[0]["target_uri"] == "http://a/%20b%0A"
    assert found[2]["payload_digest"] == warc.sha1_base32(b"z")
    assert found[0]["offset"] == 0 < found[1]["offset"]
    assert read(b"") == []


def samples(n=400):
    return [record(b"<p>%d common text of all pages %d</p>" % (i, i * 7)) for i in range(n)]


def test_dictionary_is_read_plain_or_compressed():
    head, dictionary = warc.dictionary_frame(samples(), 4096)
    assert dictionary is not None and struct.unpack("<I", head[:4])[0] == warc.DICTIONARY_FRAME
    plain = archive(samples(5), dictionary)
    assert len(read(plain)) == 5
    packed = zstandard.compress(dictionary.as_bytes())
    body = plain[len(head) :]
    again = struct.pack("<II", warc.DICTIONARY_FRAME, len(packed)) + packed + body
    assert len(read(again)) == 5
    with pytest.raises(warc.WarcError):
        read(body)  # without its dictionary
    with pytest.raises(warc.WarcError):
        read(head[:-1])


def test_archives_are_rolled():
    records = [(r, 0) for r in samples(300)]
    found = list(warc.archives_of(iter(records), 20_000, 5_000))
    assert len(found) > 3 and sum(n for _, n in found) == 300
    back = [r["payload"] for data, _ in found for r in read(data)]
    assert back == [warc.parse_record(r, "")["payload"] for r, _ in records]
    assert list(warc.archives_of(iter([]), 10, 10)) == []


def swap(old, new, data=None):
    return (data or record()).replace(old, new)


@pytest.mark.parametrize(
    "broken",
    [
        swap(b"WARC/1.1", b"WARC/9.9"),
        swap(b"WARC-Date: ", b"WARC-Datum: "),
        swap(b"WARC-Type: response\r\n", b""),
        swap(b"WARC-Type: response", b"WARC-Type response"),
        swap(b"hello", b"hallo"),
        swap(b"hello", b"hell"),
        swap(b"Content-Length: 5", b"Content-Length: 6"),
        record()[:-1],
        record() + b"x",
        record() + record(),
        b"",
        swap(b"WARC-Refers-To: r\r\n", b"", record(b"", "revisit", "r")),
    ],
)
def test_broken_records(broken):
    with pytest.raises(warc.WarcError):
        read(archive([broken]))


def test_broken_frames():
    data = archive([record(), record()])
    for broken in (data[:-3], data + b"junk", data[1:]):
        with pytest.raises(warc.WarcError):
            read(broken)
    middle = len(data) // 4
    with pytest.raises(warc.WarcError):
        read(data[:middle] + bytes([data[middle] ^ 255]) + data[middle + 1 :])


ROWS = [
    (3, "u", "same"), (1, None, "same"), (2, "http://x/\n", "other"), (4, "u", None), (5, "u", ""),
    (None, "n", "alone"), (None, "n", "same"), (7, "u", "é" * 100_000), (1, "again", "same"),
]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_pages(spark, tmp_path, min_bytes):
    pages = spark.createDataFrame(
        [(*r, "clash") for r in ROWS], "page_id bigint, url string, html string, refers_to string"
    ).repartition(3)
    planned = warc.plan_records(pages, "page_id", "url", "html", min_bytes)
    folder = f"file:{tmp_path}/out"
    written = warc.write_archives(planned, folder, archive_bytes=500)
    (tmp_path / "out" / "part-left-over.warc.zst").write_bytes(b"of a lost attempt")
    found = warc.read_archives(spark, folder, written).select(
        warc.page_of("record_id").cast("bigint"), "record_type",
        warc.page_of("refers_to_id").cast("bigint"), "payload_bytes", "payload_digest",
    ).collect()
    first = {}
    for page, _, html in ROWS:
        size = len((html or "").encode())
        if page is not None and size >= min_bytes:
            first[html or ""] = min(page, first.get(html or "", page))
    expect = []
    for page, _, html in ROWS:
        payload = (html or "").encode()
        refers = first.get(html or "") if len(payload) >= min_bytes else None
        refers = None if refers == page else refers
        expect.append(
            (page, "response" if refers is None else "revisit", refers, len(payload),
             warc.sha1_base32(payload))
        )
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expect))


def test_no_pages(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    planned = warc.plan_records(empty, "page_id", "url", "html")
    (tmp_path / "out").mkdir()
    written = warc.write_archives(planned, f"file:{tmp_path}/out")
    assert written.count() == 0
    assert warc.read_archives(spark, f"file:{tmp_path}/out", written).count() == 0
