import io
import struct
import zipfile

from pyspark.sql import functions as F

from tracewell.sources import archives, mappings

TINY = "tiny\t2\t0\tofficial\tnamed\nc\taa\tmod/Player\n\tm\t(Lbb;)V\ta\tgetFood\n\tf\tI\tb\t\nc\tbb\tmod/Food\n\tm\t()V\tx\teat\n\t\tp\t0\tignored\n"
PROGUARD = "# comment\na.b.Player -> aa:\r\n    int level -> a\r\n    12:14:a.b.Food getFood(int,a.b.Player[]) -> b\nc.D$E -> bb:\n    void <init>(java.lang.String[][],byte) -> <init>\na.b.Food -> cc:\n"


def test_tiny(spark, tmp_path):
    (tmp_path / "a.tiny").write_text(TINY)
    (tmp_path / "b.tiny").write_text("tiny\t1\nc\tx\ty\n")
    classes, members, errors = mappings.tiny_v2(mappings.lines(spark, str(tmp_path), "*.tiny"))
    assert [r["names"] for r in classes.orderBy("class_at").collect()] == [["aa", "mod/Player"], ["bb", "mod/Food"]]
    got = [(r["kind"], r["desc"], r["names"], r["class_at"]) for r in members.orderBy("at").collect()]
    assert got == [("method", "(Lbb;)V", ["a", "getFood"], 1), ("field", "I", ["b", None], 1), ("method", "()V", ["x", "eat"], 4)]
    assert errors.count() == 1


def test_escaped_names_of_tiny_files(spark, tmp_path):
    body = "\\tescaped-names\\nc\\taa\\tmod/A\\\\tB\\\\\\\\n\\n\\tm\\t()V\\ta\\tx\\\\0y\\\\q\\n".encode().decode("unicode_escape")
    (tmp_path / "a.tiny").write_text("tiny\t2\t0\tofficial\tnamed\n" + body)
    (tmp_path / "b.tiny").write_text("tiny\t2\t0\tofficial\tnamed\n" + body.partition("\n")[2])
    classes, members, errors = mappings.tiny_v2(mappings.lines(spark, str(tmp_path), "*.tiny"))
    names = lambda df, k: sorted(r["names"][k] for r in df.collect())
    assert names(classes, 1) == ["mod/A\tB\\n", "mod/A\\tB\\\\n"] and names(members, 1) == ["x\0yq", "x\\0y\\q"] and errors.count() == 0


def test_proguard(spark, tmp_path):
    (tmp_path / "m.txt").write_bytes(PROGUARD.encode())
    classes, members = mappings.proguard(mappings.lines(spark, str(tmp_path)))
    assert {(r["source"], r["obf"]) for r in classes.collect()} == {("a/b/Player", "aa"), ("c/D$E", "bb"), ("a/b/Food", "cc")}
    got = {(r["kind"], r["source_name"], r["obf_name"], r["desc_source"], r["desc_obf"]) for r in members.collect()}
    assert got == {
        ("field", "level", "a", "I", "I"), ("method", "getFood", "b", "(I[La/b/Player;)La/b/Food;", "(I[Laa;)Lcc;"),
        ("method", "<init>", "<init>", "([[Ljava/lang/String;B)V", "([[Ljava/lang/String;B)V"),
    }
    assert mappings.named_surface(classes, members).count() == 3


def test_properties(spark, tmp_path):
    text = "# c\n\na.b = 1.2 \nc:d\nodd line\nlong = x\\\n"
    (tmp_path / "g.properties").write_text(text)
    entries, suspects = mappings.properties(mappings.lines(spark, str(tmp_path)))
    got = {r["key"]: (r["value"], text[r["start"] : r["end"]]) for r in entries.collect()}
    assert got == {"a.b": ("1.2", "1.2"), "c": ("d", "d")} and suspects.count() == 2


def class_file(name=b"t/T"):
    utf = lambda b: b"\x01" + struct.pack(">H", len(b)) + b
    pool = utf(name) + b"\x07\0\x01" + utf(b"java/lang/Object") + b"\x07\0\x03" + utf(b"go") + utf(b"()V") + b"\x05" + bytes(8) + utf(b"x")
    return struct.pack(">IHHH", 0xCAFEBABE, 0, 61, 10) + pool + struct.pack(">HHHH", 1, 2, 4, 0) + struct.pack(">H", 0) + struct.pack(">HHHHH", 1, 1, 5, 6, 0) + struct.pack(">H", 0)


def test_archives_and_classes(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("t/T.class", class_file())
        z.writestr("t/Bad.class", b"not a class")
        z.writestr("t/Moved.class", class_file())
        z.writestr("META-INF/x.class", b"")
        z.writestr("readme", b"r")
    (tmp_path / "a.jar").write_bytes(buffer.getvalue())
    (tmp_path / "broken.jar").write_bytes(b"PK nothing")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    found = archives.entries(files)
    assert {r["name"] for r in found.where("error is null").collect()} == {"t/T.class", "t/Bad.class", "t/Moved.class", "readme"}
    assert found.where("error is not null").count() == 1
    out = {r["name"]: r for r in archives.classes(found).collect()}
    good = out["t/T.class"]
    assert (good["owner"], good["super"], good["major"], good["error"]) == ("t/T", "java/lang/Object", 61, None)
    assert [tuple(m) for m in good["members"]] == [("method", "go", "()V", 1)]
    assert "magic" in out["t/Bad.class"]["error"] and "path differs" in out["t/Moved.class"]["error"]
    pins = files.where(F.col("path").endswith("a.jar")).select("path", F.sha1("content").alias("sha1"), F.lit(None).cast("long").alias("size"))
    assert archives.pinned(files, pins).first()["reason"] is None
    assert archives.pinned(files, pins.withColumn("sha1", F.lit("0"))).first()["reason"] == "hash differs"
    assert archives.catalog(spark, str(tmp_path)).count() == 2


def test_archive_entries_and_what_is_wrong_with_them(spark):
    def archive(*rows, comment=b""):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            z.comment = comment
            for name, data, kind in rows:
                z.writestr(zipfile.ZipInfo(name), data, kind)
        return buffer.getvalue()

    big = bytes(range(256)) * 60000
    good = archive(("a.txt", b"hello", zipfile.ZIP_STORED), ("d/", b"", zipfile.ZIP_STORED), ("big.bin", big, zipfile.ZIP_DEFLATED), ("é.txt", b"", zipfile.ZIP_DEFLATED), ("META-INF/x", b"no", zipfile.ZIP_STORED), comment=b"PK\x05 or so")
    twice = archive(("n", b"first", zipfile.ZIP_STORED), ("n", b"second", zipfile.ZIP_DEFLATED))
    at = good.rfind(b"PK\x01\x02", 0, good.rfind(b"big.bin"))  # the directory entry of big.bin
    wrong_crc = good[: at + 16] + b"\x00\x00\x00\x00" + good[at + 20 :]
    wrong_size = good[: at + 24] + b"\x07\x00\x00\x00" + good[at + 28 :]
    wrong_method = good[: at + 10] + b"\x0c\x00" + good[at + 12 :]
    cases = {"good": good, "twice": twice, "crc": wrong_crc, "size": wrong_size, "method": wrong_method, "none": b"nothing", "null": None, "empty": archive(), "cut": good[:40] + good[at - 50 :]}
    files = spark.createDataFrame([(k, v if v is None else bytearray(v)) for k, v in cases.items()], "path string, content binary")
    out = {(r["path"], r["name"]): (r["data"] and bytes(r["data"]), r["error"]) for r in archives.entries(files).collect()}
    fine = {("a.txt"): b"hello", "big.bin": big, "é.txt": b""}
    for path in ("good", "crc"):  # check sums are not compared
        assert {n: (out[path, n][0] or b"", out[path, n][1]) for p, n in out if p == path} == {n: (d, None) for n, d in fine.items()}
    assert out["twice", "n"] == (b"second", None) and not any(p == "empty" for p, _ in out)
    assert out["size", "big.bin"][1] == "size differs" and out["method", "big.bin"][1] == "compression method 12" and out["size", "a.txt"] == (b"hello", None)
    assert out["none", None][1] == out["null", None][1] == "no central directory" and all(e is not None for (p, _), (_, e) in out.items() if p == "cut")
