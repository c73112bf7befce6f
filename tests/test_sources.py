"""Readers and writers: round trips and damaged input."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinworks.operators import duplicates, images, kernels
from skeinworks.sources import files, sinks, tiff


@pytest.mark.parametrize("dtype", ["uint8", "uint16", "int16", "float32"])
@pytest.mark.parametrize("shape", [(5, 7), (6, 4, 3)])
@pytest.mark.parametrize("compress", [False, True])
def test_tiff_round_trip(dtype, shape, compress):
    pages = [np.random.default_rng(i).integers(0, 200, shape).astype(dtype) for i in range(2)]
    got = tiff.read_pages(tiff.write_pages(pages, compress, "a note"))
    assert len(got) == 2 and all((a == b).all() and a.dtype == b.dtype for a, b in zip(got, pages))


def test_tiff_codecs_and_damage():
    assert tiff._packbits(bytes([2, 1, 2, 3, 254, 9, 128])) == bytes([1, 2, 3, 9, 9, 9])
    codes, width, bits, n = [256, 65, 66, 258, 257], 9, 0, 0
    for c in codes:
        bits, n = (bits << width) | c, n + width
    pad = -n % 8
    assert tiff._lzw((bits << pad).to_bytes((n + pad) // 8, "big")) == b"ABAB"
    for bad in (b"not a tif", b"", b"II*\0\x08\0\0\0"):
        with pytest.raises(ValueError):
            tiff.read_pages(bad)


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(5)
    ramp = np.tile(np.linspace(0, 255, 64), (64, 1)).astype(np.uint8)
    noisy = np.clip(ramp.astype(int) + rng.integers(-2, 3, ramp.shape), 0, 255).astype(np.uint8)
    (tmp_path / "sub").mkdir()
    (tmp_path / "PN001_1R_AD_DIV01 (Series 0) [1].tif").write_bytes(tiff.write_pages([ramp]))
    (tmp_path / "PN001_1R_AD_DIV01 (Series 1) [1].tif").write_bytes(tiff.write_pages([ramp], description="other"))
    (tmp_path / "sub" / "PN001_1R_AD_DIV01 (Series 2) [1].tif").write_bytes(tiff.write_pages([noisy]))
    (tmp_path / "PN001_1R_AD_DIV01 (Series 3) [1].tif").write_bytes(b"not a tif")
    return str(tmp_path)


def test_inventory_of_a_folder(spark, folder):
    decoded = files.decode_images(files.scan_files(spark, folder), "root", "fiber_image").cache()
    assert decoded.count() == 4
    bad = decoded.where("error IS NOT NULL").collect()
    assert [r.error for r in bad] == ["ValueError"] and bad[0].source_sha256 and bad[0].pixels is None
    assert images.expected_shape(decoded) == (64, 64)
    prof = images.profile_images(decoded, (64, 64)).cache()
    rows = {r.relative_path: r for r in prof.collect()}
    a, b = rows["PN001_1R_AD_DIV01 (Series 0) [1].tif"], rows["PN001_1R_AD_DIV01 (Series 1) [1].tif"]
    assert a.pixel_sha256 == b.pixel_sha256 and a.thumbnail_hash == b.thumbnail_hash and len({r.source_sha256 for r in decoded.collect()}) == 4
    numbered = duplicates.number_duplicates(prof, "source_root_id", "relative_path", "thumbnail_hash", "thumbnail_duplicate_group", "group").cache()
    assert {r.relative_path: r.group for r in numbered.collect()}[a.relative_path] == "thumbnail_duplicate_group_001"
    pairs = duplicates.near_pairs(numbered, 0.995, "relative_path", "thumbnail", exclude="group").collect()
    assert {(r.left, r.right) for r in pairs} == {(x, "sub/PN001_1R_AD_DIV01 (Series 2) [1].tif") for x in (a.relative_path, b.relative_path)}
    decoded.unpersist()


def test_csv_keeps_every_cell(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "x", y', None), ("b", "two\nlines", 3)], "k string, t string, n int")
    sinks.write_csv_file(df, tmp_path / "one.csv", ["k", "t", "n", "extra"])
    got = files.read_csv(spark, str(tmp_path / "one.csv")).collect()
    assert [tuple(r) for r in got] == [("a", 'say "x", y', "", ""), ("b", "two\nlines", "3", "")]
    sinks.write_csv(df, str(tmp_path / "parts"), ["k", "n"])
    assert sorted(map(tuple, files.read_csv(spark, str(tmp_path / "parts")).collect())) == [("a", ""), ("b", "3")]


def test_records_and_json(tmp_path):
    with pytest.raises(ValueError):
        sinks.write_records([], tmp_path / "x.csv")
    sinks.write_records([], tmp_path / "x.csv", empty="skip")
    assert not (tmp_path / "x.csv").exists()
    sinks.write_records([{"b": 1, "a": 2}], tmp_path / "x.csv")
    assert (tmp_path / "x.csv").read_text().splitlines() == ["b,a", "1,2"]
    sinks.write_json({"b": 1, "a": [2]}, tmp_path / "d" / "x.json")
    assert (tmp_path / "d" / "x.json").read_text() == '{\n  "a": [\n    2\n  ],\n  "b": 1\n}\n'


def test_jsonl_yaml_npz(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    assert sorted(r.k for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k int").collect()) == [1, 2]
    assert files.read_jsonl(spark, str(tmp_path / "a.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text('{"k": 1}\n{oops\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "k int").collect()
    (tmp_path / "e.yaml").write_text("")
    (tmp_path / "l.yaml").write_text("- 1\n")
    (tmp_path / "m.yaml").write_text("papers:\n- cite_key: A\n  pages: 3\n- cite_key: B\n")
    assert files.load_yaml(tmp_path / "e.yaml") == {}
    with pytest.raises(ValueError):
        files.load_yaml(tmp_path / "l.yaml")
    got = files.yaml_records(spark, tmp_path / "m.yaml", "papers", "cite_key string, pages int").collect()
    assert [tuple(r) for r in got] == [("A", 3, 0), ("B", None, 1)]
    data = sinks.npz_bytes({"x": np.arange(6).reshape(2, 3), "y": np.ones(2, np.float32)})
    assert data == sinks.npz_bytes({"y": np.ones(2, np.float32), "x": np.arange(6).reshape(2, 3)})
    (tmp_path / "s.npz").write_bytes(data)
    arrays = files.read_npz(files.scan_files(spark, str(tmp_path), "*.npz"), ["x"]).collect()
    assert len(arrays) == 1 and np.frombuffer(arrays[0].data, arrays[0].dtype).reshape(arrays[0].shape).tolist() == [[0, 1, 2], [3, 4, 5]]
    with pytest.raises(ValueError):
        sinks.npz_bytes({"o": np.array([None])})
    (tmp_path / "j.json").write_text(json.dumps({"a": 1}, indent=1))
    assert files.read_json(spark, str(tmp_path / "j.json")).collect()[0].a == 1


def test_paths_names_and_versions(spark, tmp_path):
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    assert [r.name for r in files.file_names(spark, str(tmp_path), "*.pdf").collect()] == ["p.pdf"]
    df = spark.createDataFrame([("r1", "a/b.tif"), ("r2", "c.tif")], "source_root_id string, relative_path string")
    assert {r.relative_path: r.source_path for r in files.resolve_paths(df, {"r1": "/data"}).collect()} == {"a/b.tif": "/data/a/b.tif", "c.tif": None}
    assert files.code_version(str(tmp_path)) == "not_available" and files.pdf_pages(str(tmp_path / "p.pdf")) is None
    with pytest.raises(ValueError):
        files.sample_range(spark, 7)
    assert files.sample_range(spark, 8).count() == 8
    with pytest.raises(ValueError):
        files.required({}, "x")


def test_path_order_is_by_component(spark, tmp_path):
    for n in ("a.b", "a/b", "ab"):
        p = tmp_path / (n + ".x")
        p.parent.mkdir(exist_ok=True)
        p.write_text("1")
    got = [r.relative_path for r in files.scan_files(spark, str(tmp_path)).orderBy("path_order").select("relative_path").collect()]
    assert got == ["a/b.x", "a.b.x", "ab.x"]


def test_png_markdown_and_check(tmp_path):
    png = sinks.png_bytes(np.zeros((3, 4), np.uint8))
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and png[16:24] == (4).to_bytes(4, "big") + (3).to_bytes(4, "big")
    assert sinks.bars_png({"a": [1.0, 3.0], "b": []})[:4] == b"\x89PNG"
    assert sinks.markdown_table(["x", "n"], [("a", 1)], right=[1]) == ["| x | n |", "|:--|--:|", "| a | 1 |"]
    out = {tmp_path / "r.md": "text\n"}
    assert sinks.write_or_check(out, check=True) == [str(tmp_path / "r.md")]
    assert sinks.write_or_check(out) == [] and sinks.write_or_check(out, check=True) == []


def test_pixel_hash_is_the_same_on_both_sides(spark):
    from skeinworks.functions.text import pixel_hash

    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    df = spark.createDataFrame([(3, 4, "uint8", bytearray(a.tobytes()))], "h int, w int, t string, p binary")
    assert df.select(pixel_hash(F.col("h"), F.col("w"), F.col("t"), F.col("p"))).first()[0] == kernels.pixel_hash(a)


def test_empty_files_have_a_row(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    for name, data in (("a b/x+y.tif", b""), ("a b/full.tif", b"xx"), ("ü%20.tif", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r.relative_path: (r.length, bytes(r.content)) for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a b/x+y.tif": (0, b""), "a b/full.tif": (2, b"xx"), "ü%20.tif": (0, b"")}
    assert all(r.error for r in files.decode_images(files.scan_files(spark, str(tmp_path)), "r", "k").collect())


def test_png_round_trip_and_filters():
    import struct
    import zlib

    from skeinworks.sources import png

    rng = np.random.default_rng(3)
    for shape in ((5, 7), (6, 4, 3)):
        a = rng.integers(0, 256, shape).astype(np.uint8)
        assert (png.read_png(sinks.png_bytes(a)) == a).all()

    def packed(rows: bytes, w, h, bits, colour, extra=b""):
        part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        return png.MAGIC + part(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, 0)) + extra + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")

    a = rng.integers(0, 256, (5, 9)).astype(int)
    lines = b""
    for y, kind in enumerate((0, 1, 2, 3, 4)):  # each filter by its definition
        lines += bytes([kind])
        for x in range(9):
            left, up, corner = (a[y, x - 1] if x else 0), (a[y - 1, x] if y else 0), (a[y - 1, x - 1] if x and y else 0)
            p = left + up - corner
            nearest = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            lines += bytes([(a[y, x] - (0, left, up, (left + up) // 2, nearest)[kind]) % 256])
    assert (png.read_png(packed(lines, 9, 5, 8, 0)) == a).all()
    assert png.read_png(packed(b"\0" + struct.pack(">3H", 1, 256, 65535), 3, 1, 16, 0)).tolist() == [[1, 256, 65535]]
    assert png.read_png(packed(b"\0\xa0", 3, 1, 1, 0)).tolist() == [[255, 0, 255]]
    palette = struct.pack(">I", 6) + b"PLTE" + bytes([1, 2, 3, 4, 5, 6]) + struct.pack(">I", zlib.crc32(b"PLTE" + bytes([1, 2, 3, 4, 5, 6])))
    assert png.read_png(packed(b"\0\x40", 2, 1, 1, 3, palette)).tolist() == [[[1, 2, 3], [4, 5, 6]]]
    for bad in (b"", png.MAGIC, sinks.png_bytes(np.zeros((3, 3), np.uint8))[:50], packed(b"\0", 3, 1, 8, 0)):
        with pytest.raises(Exception):  # noqa: B017, PT011
            png.read_png(bad)


def test_png_files_are_decoded(spark, tmp_path):
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    (tmp_path / "a.png").write_bytes(sinks.png_bytes(a))
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\nxx")
    got = {r.relative_path: r for r in files.decode_images(files.scan_files(spark, str(tmp_path)), "r", "k").collect()}
    assert bytes(got["a.png"].pixels) == a.tobytes() and got["a.png"].height == 3 and got["b.png"].error


def test_identity_with_fallbacks(spark):
    m = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "id string, mean double")
    rows = spark.createDataFrame([("a", "AD", None)], "id string, cond string, div string")
    got = {r.id: (r.cond, r["div"], r["round"]) for r in images.with_identity(m, rows, "id", ["cond", "div", "round"]).collect()}
    assert got == {"a": ("AD", "unknown", "unknown"), "b": ("unknown", "unknown", "unknown")}
