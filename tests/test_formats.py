"""Files read and written."""

import gzip
import hashlib
import json

import pytest

from tracklens.sources import formats
from tracklens.sources.tables import FEEDBACK


def test_logs(spark, tmp_path):
    day = tmp_path / "2026" / "03" / "13"
    day.mkdir(parents=True)
    (day / "events.jsonl").write_text('{"ts": "2026-03-13T10:00:00Z", "sid_path": "A", "song_index": 1, "action": "like"}\nbroken\n')
    (day / "other.jsonl").write_text('{"sid_path": "B"}\n')
    assert [(r.sid_path, str(r.day)) for r in formats.feedback_days(spark, str(tmp_path)).collect()] == [("A", "2026-03-13")]
    assert {r.sid_path for r in formats.flat_json_lines(spark, str(day), FEEDBACK).where("_corrupt IS NULL").collect()} == {"A", "B"}
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        formats.strict_json_lines(spark, str(tmp_path), FEEDBACK.removesuffix(", _corrupt string")).collect()
    (tmp_path / "classification_2026-03-01.jsonl").write_text('{"sid_path": "C", "ratings": {"e": 1}}\n{"sid_path": "D", "classified_at": "x"}\n')
    (tmp_path / "features_2026-03-02.jsonl").write_text('{"sid_path": "E"}\n')
    got = {(r.sid_path, r.kind, r.classified_at) for r in formats.classification_files(spark, str(tmp_path)).collect()}
    assert got == {("C", "classification", "2026-03-01"), ("D", "classification", "x"), ("E", "features", "2026-03-02")}


def test_append_by_day(spark, tmp_path):
    rows = spark.createDataFrame([("2026-03-13T23:30:00Z", "A", 1), ("2026-03-13T01:00:00Z", "B", 0)], "ts string, sid_path string, song_index int")
    for _ in range(2):
        formats.append_by_day(rows, str(tmp_path / "out"), "Europe/Berlin")
    got = sorted((r.sid_path, r.day, r.song_index) for r in spark.read.json(str(tmp_path / "out")).collect())
    assert got == [("A", 14, 1), ("A", 14, 1), ("B", 13, None), ("B", 13, None)]


def test_sidecar(spark, tmp_path):
    rows = spark.createDataFrame([("b#1", '{"bpm": 1}'), ('a"#1', "broken"), ("c#1", None)], "track_id string, features string")
    assert formats.write_sidecar(rows, str(tmp_path / "s")) == 2
    lines = [json.loads(x) for p in sorted((tmp_path / "s").glob("*.gz")) for x in gzip.open(p, "rt")]
    assert lines == [{"features": {}, "track_id": 'a"#1'}, {"features": {"bpm": 1}, "track_id": "b#1"}, {"features": {}, "track_id": "c#1"}]


def test_song_lengths_and_playlist(spark, tmp_path):
    (tmp_path / "l.txt").write_text(f"[Database]\n; /M/a.sid\n{'0a' * 16}=1:02.5 0:03\n; /M/b.sid\n{'0B' * 16}=10:00\n")
    got = {(r.path, r.md5, tuple(r.ms)) for r in formats.song_lengths(spark, str(tmp_path / "l.txt")).collect()}
    assert got == {("/M/a.sid", "0a" * 16, (62_500, 3_000)), ("/M/b.sid", "0b" * 16, (600_000,))}
    rows = spark.createDataFrame([(1, "M/a.sid", 62.5), (2, "M/b.sid", None)], "place int, sid_path string, seconds double")
    assert [r.value for r in formats.playlist_lines(rows).orderBy("n").collect()] == ["#EXTM3U", "#EXTINF:62,a.sid", "M/a.sid", "#EXTINF:-1,b.sid", "M/b.sid"]


def test_binary_files(spark, tmp_path):
    head = b"PSID" + (2).to_bytes(2, "big") + bytes(8) + (3).to_bytes(2, "big") + (1).to_bytes(2, "big") + bytes(4)
    whole = head + b"T\xe4st".ljust(32, b"\0") + b"Me".ljust(32, b"\0") + b"1987 X".ljust(32, b"\0") + bytes(4)
    (tmp_path / "a.sid").write_bytes(whole)
    (tmp_path / "b.sid").write_bytes(b"XXXX" + whole[4:])
    (tmp_path / "c.sid").write_bytes(b"")
    got = [(r.title, r.author, r.released, r.songs, r.version) for r in formats.sid_files(spark, str(tmp_path)).collect()]
    assert got == [("Täst", "Me", "1987 X", 3, 2)]
    sums = {r.path.rsplit("/", 1)[1]: r.sha256 for r in formats.checksums(spark, str(tmp_path)).collect()}
    assert sums["a.sid"] == hashlib.sha256(whole).hexdigest() and "c.sid" not in sums
