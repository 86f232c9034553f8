import pyarrow as pa
import pytest

from millrace.functions.bits import BitReader, BitWriter
from millrace.operators import frames
from millrace.plans import reports
from millrace.sources import plain
from millrace.sources import recordings as rec
from millrace.sources.plain import MAGIC, command, recording

#: (cmd, tick, body, compressed): a stop before the sync tick's playback ends, ticks below zero inside it, an empty body, a second stop.
MIXED = [
    (1, -1, b"who and when", False), (4, -1, b"s" * 300, True), (3, 4, b"", False), (7, 4, b"one", False), (12, -3, b"", True), (9, 4, b"two", False), (3, 5, b"", False),
    (13, 6, b"all", True), (7, -9, b"x", False), (7, 7, b"", False), (40, 7, b"odd", False), (0, 8, b"", False), (2, 8, b"i" * 5, False), (15, 9, b"g" * 70, True), (0, 9, b"", False),
]


def test_numbers():
    for n in (0, 15, 16, 255, 256, 4095, 4096, 65535, 1 << 20):
        assert BitReader(BitWriter().ubitvar(n).data()).ubitvar() == n
    for n in (0, 3, 4, 15, 16, 1023, 1024, 131071, 131072, 1000000):
        w = BitWriter().flag(True).ubitvarfp(n)
        r = BitReader(w.data(), 1)
        assert r.ubitvarfp() == n and r.at == w.at
    for n in (0, 1, 127, 128, 1 << 31, (1 << 64) - 1):
        assert BitReader(BitWriter().uvarint(n).data()).uvarint(64) == n
    for n in (0, -1, 5, -123, 1 << 40, -(1 << 62)):
        assert BitReader(BitWriter().svarint(n).data()).svarint(64) == n
    assert BitReader(bytes.fromhex("f501")).svarint() == -123 and command(7, -1)[1:6].hex() == "ffffffff0f"
    assert BitReader(b"\xff" * 7).uvarint() == 0xFFFFFFFF  # what exceeds the width is dropped
    data = bytes(range(16))
    for at in range(8):
        for n in range(57, 65):
            assert BitReader(data, at).bits(n) == int.from_bytes(data, "little") >> at & ((1 << n) - 1)
    r = BitReader(b"\x80\x80")
    with pytest.raises(EOFError):
        r.uvarint()
    assert r.at == 0
    with pytest.raises(EOFError):
        r.skip(17)
    r.seek(9)
    assert r.left() == 7 and BitReader(b"\x34\x12").whole(2) == 0x1234 and BitReader(b"\xab\x0c").bit_bytes(12) == b"\xab\x0c"


def of(spark, **files):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "demo_id string, content binary")


def test_headers(spark, tmp_path):
    good = MAGIC + (32).to_bytes(4, "little") + (48).to_bytes(4, "little") + bytes(48)
    assert rec.header(good, MAGIC) == (32, 48) and rec.header(MAGIC + bytes(8), MAGIC) == (None, None)
    for bad in (8, 64):
        with pytest.raises(rec.FormatError):
            rec.header(MAGIC + bad.to_bytes(4, "little") + bytes(52), MAGIC)
    (tmp_path / "a").write_bytes(good)
    (tmp_path / "b").write_bytes(b"short")
    (tmp_path / "c").write_bytes(b"other..." + bytes(8))
    got = {r.demo_id[-1]: r for r in rec.headers(rec.files(spark, str(tmp_path)), MAGIC).collect()}
    assert (got["a"].file_info_offset, got["a"].file_size, got["a"].error) == (32, 64, None) and got["b"].error and got["c"].error


def test_commands_and_reports(spark):
    parts = [command(*c) for c in MIXED]
    at = [16 + sum(map(len, parts[:i])) for i in range(len(parts))]
    files = of(spark, mixed=recording(parts, info=at[12], spawn=at[13]), empty=recording([]))
    got = rec.commands(files, MAGIC).cache()
    rows = got.orderBy("idx").collect()
    assert [(r.cmd, r.tick, bytes(r.body), r.compressed) for r in rows] == MIXED and [r.offset for r in rows] == at
    assert rows[10].command_type == "Unknown" and rows[1].compression_ratio < 1 and rows[2].compression_ratio is None
    bare = rec.commands(files, MAGIC, bodies=False).orderBy("idx").collect()
    assert all(r.body is None for r in bare) and [r.decoded_size for r in bare] == [r.decoded_size for r in rows]
    meta = {r.what: (r.cmd, bytes(r.body)) for r in rec.metadata(files, MAGIC).collect()}
    assert meta == {"file_info": (2, b"i" * 5), "spawn_groups": (15, b"g" * 70)}
    r = reports.inspection(got).first()
    assert (r.first_tick, r.last_tick, r.distinct_ticks, r.playback_first, r.playback_last, r.playback_ticks) == (4, 9, 6, 4, 7, 3)
    assert (r.sync_points, r.seek_points, r.first_stop_command, r.commands_after_stop, r.unknown_commands) == (2, 1, 11, 3, 1)
    assert [x.tick for x in frames.tick_starts(frames.playback(got)).orderBy("idx").collect()] == [4, 6, 7]
    assert [(x.idx, x.resume_offset) for x in reports.sync_points(got).orderBy("idx").collect()] == [(2, at[3]), (6, at[7])]
    view = reports.index_view(got).first()
    assert view.playback_tick_range == (4, 7, 3) and [p.tick for p in view.full_packet_seek_points] == [6] and len(view.sync_points) == 2
    c = reports.compression(got).first()
    assert c.compressed_commands == 4 and c.compressed_decoded_bytes == 373 and c.compressed_bytes_saved == 373 - c.compressed_encoded_bytes
    assert c.command_header_bytes == sum(map(len, parts)) - c.total_encoded_bytes
    assert reports.compression(got.filter("false")).first().compressed_ratio is None
    s = {r.demo_id: r for r in reports.full_summary(rec.headers(files, MAGIC), got).collect()}
    assert s["mixed"].file_info_offset == at[12] and s["empty"].commands is None and s["mixed"].total_decoded_bytes == sum(len(c[2]) for c in MIXED)
    assert '"demo_id" : "mixed"' in "".join(r.json for r in reports.as_json(reports.index_view(got)).collect())


def test_scan_from_an_offset(spark):
    parts = [command(*c) for c in MIXED]
    at = 16 + sum(map(len, parts[:12]))
    rows = rec.commands(of(spark, m=recording(parts)), MAGIC, start=at).orderBy("idx").collect()
    assert [(r.idx, r.cmd) for r in rows] == [(0, 2), (1, 15), (2, 0)]
    bad = rec.commands(of(spark, m=recording(parts)), MAGIC, start=8, failfast=False).collect()
    assert len(bad) == 1 and bad[0].error


def test_damage(spark):
    files = of(spark, cut=recording([command(7, 1, b"abc"), b"\x07\x01\x04a"]), fine=recording([command(7, 1, b"abc", True)]), not_one=b"x" * 40)
    rows = rec.commands(files, MAGIC, failfast=False).filter("demo_id = 'cut'").orderBy("idx").collect()
    assert [r.cmd for r in rows] == [7, None] and rows[1].error
    with pytest.raises(Exception, match="command 1"):
        rec.commands(files.filter("demo_id = 'cut'"), MAGIC).collect()
    assert "exceeds" in rec.commands(files.filter("demo_id = 'cut'"), MAGIC, limits=rec.Limits(body=2), failfast=False).first().error
    assert "exceeds" in rec.commands(files.filter("demo_id = 'fine'"), MAGIC, limits=rec.Limits(decoded=2), failfast=False).first().error
    v = {r.demo_id: r for r in reports.validation(rec.headers(files, MAGIC), rec.commands(files, MAGIC, failfast=False)).collect()}
    assert v["fine"].valid and v["fine"].error is None and v["fine"].commands == 1
    assert not v["cut"].valid and v["cut"].error.startswith("failed to inspect cut: ") and not v["not_one"].valid


def test_messages(spark):
    body = plain.packet([(7, b"abc"), (72, b"de"), (1 << 20, b"")])
    packets = spark.createDataFrame([("d", 0, body), ("d", 1, None), ("d", 2, body[:4])], "demo_id string, idx long, body binary")
    rows = rec.messages(packets, failfast=False).orderBy("idx", "msg").collect()
    assert [(r.message_type, bytes(r.payload), r.payload_bit_offset, r.aligned) for r in rows[:3]] == [(7, b"abc", 14, False), (72, b"de", 56, True), (1 << 20, b"", 114, False)]
    assert rows[3].idx == 2 and rows[3].error
    assert "exceeds" in rec.messages(packets.filter("idx = 0"), rec.Limits(message=2), failfast=False).first().error
    assert pa.types.is_binary(rec.arrow_schema(rec.MESSAGES).field("payload").type)


def test_batches_are_bounded_by_what_rows_hold():
    """Long values and many short rows alike, in order and whole."""
    schema = rec.arrow_schema("n bigint, text string, body binary, path array<int>")
    for rows in ([(i, "x" * 500_000, bytes(500_000), None) for i in range(100)], [(i, None, None, [1, 2]) for i in range(150_000)]):
        made = list(rec.in_batches(iter(rows), schema))
        assert [n for b in made for n in b.column(0).to_pylist()] == list(range(len(rows)))
        assert max(b.nbytes for b in made) < 18 << 20 and max(b.num_rows for b in made) < 100_000
    assert [b.num_rows for b in rec.in_batches(iter([(1, "x" * (20 << 20), None, None)] * 2), schema)] == [1, 1] and not list(rec.in_batches(iter([]), schema))
