import hashlib
import zlib

import pyarrow.fs as pafs
import pytest

from tessera.llm import media
from tessera.llm.media import decode_png, encode_png, media_features, pad, read_media, write_media
from tessera.llm.media_query import op1_media_columns

TEXTS = [(1, "one"), (2, None), (3, ""), (3, "x" * 64), (None, "é\x00\x00"), (4, "long " * 300_000), (1, "one")]


def expected(text):
    raw = (text or "").encode()
    payload = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
    stored = encode_png(payload)
    return (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest())


def test_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    write_media(spark.createDataFrame([(i, t, "x") for i, t in TEXTS], "doc_id long, text string, name string"), path)
    got = media_features(read_media(spark, path, range_bytes=300)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([tuple(r)[:-1] for r in got], key=key) == sorted([(i, *expected(t)) for i, t in TEXTS], key=key)
    assert len({r.feature for r in got if r.payload_sha256 == expected("one")[2]}) == 1


def test_png():
    for raw in (b"", b"a", bytes(range(256)) * 33):
        assert decode_png(encode_png(pad(raw))) == pad(raw)
    with pytest.raises(ValueError):
        decode_png(encode_png(pad(b"a"))[:-6] + b"123456")


def test_damaged_member_fails_alone(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    write_media(spark.createDataFrame([(i, f"text {i}") for i in range(5)], "doc_id long, text string").coalesce(1), path)
    archive = next((tmp_path / "m").glob("*.zip"))
    whole = archive.read_bytes()
    at = whole.index(b"IDAT", whole.index(b"000000002;")) + 8
    archive.write_bytes(whole[:at] + b"\xff\xff" + whole[at + 2 :])
    rows = read_media(spark, path, on_error="null").collect()
    assert [r.doc_id for r in rows if r.error] == [2] and len(rows) == 5
    with pytest.raises(Exception, match="checksum"):
        read_media(spark, path).collect()


def test_member_is_retried(tmp_path, monkeypatch):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as out:
        out.writestr("x", b"payload")
    info = zipfile.ZipFile(tmp_path / "a.zip").infolist()[0]
    monkeypatch.setattr(media.time, "sleep", lambda s: None)

    class Flaky:
        calls = 0

        def open_input_file(self, path):
            self.calls += 1
            if self.calls < 3:
                raise OSError("lost")
            return pafs.LocalFileSystem().open_input_file(path)

    assert media.read_member(Flaky(), str(tmp_path / "a.zip"), info) == (b"payload", None)


def test_table_and_empty(spark, sf_dir, tmp_path):
    want = sorted((r.doc_id, *expected(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    assert sorted(tuple(r)[:-1] for r in op1_media_columns(spark, sf_dir).collect()) == want
    path = f"file://{tmp_path}/none"
    write_media(spark.createDataFrame([], "doc_id long, text string"), path)
    assert media_features(read_media(spark, path)).count() == 0
