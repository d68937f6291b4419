"""Archives and binary classes as DataFrames.

Spark lists and reads the files; a small helper decodes one archive or class inside the task.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import visible_class, visible_member

_ENTRY = "path string, name string, size long, method int, crc long, data binary, error string"
_MEMBER = "struct<kind:string,name:string,desc:string,access:int>"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Rows (path, length, modificationTime) of cached files, temporary ones left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(~F.col("path").endswith(".tmp")).select("path", "length", "modificationTime")


def pinned(files: DataFrame, pins: DataFrame) -> DataFrame:
    """Files whose SHA-1 and size equal their pin, others with the reason.

    ``files(path, content, length)``, ``pins(path, sha1, size)``.
    """
    met = pins.join(files, "path", "left")
    reason = F.when(F.col("content").isNull(), "missing").when(F.col("size").isNotNull() & (F.col("size") != F.col("length")), "size differs").when(F.sha1("content") != F.lower("sha1"), "hash differs")
    return met.select("path", reason.alias("reason"), F.when(reason.isNull(), F.col("content")).alias("content"))


# Fixed values of the zip format: signatures, and the fields that are read at their places behind one.
END, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"
END_FIELDS, CENTRAL_FIELDS, LOCAL_FIELDS = "<10xHII", "<8xHH4xIIIHHH8xI", "<26xHH"
STORED, DEFLATED = 0, 8
#: Compressed bytes that one task inflates, and bytes of a batch.
DEALT, BATCH = 4 << 20, 8 << 20
_PACKED = "path string, name string, size long, method int, crc long, bin int, packed binary, error string"


def central_directory(raw: memoryview) -> list[tuple[str, int, int, int, int, int, int]]:
    """(name, flags, method, crc, packed size, size, offset of the local header) of each entry; the last of a name counts.

    Raises ValueError where there is no directory, where it is cut off, or where it is one of the 64-bit kind.
    """
    at = bytes(raw[-65557:]).rfind(END)
    if at < 0 or len(raw) < 22:
        raise ValueError("no central directory")
    at += max(0, len(raw) - 65557)
    if at + struct.calcsize(END_FIELDS) > len(raw):
        raise ValueError("the end of the central directory is cut off")
    count, _, start = struct.unpack_from(END_FIELDS, raw, at)
    if count == 0xFFFF or start == 0xFFFFFFFF:
        raise ValueError("a 64-bit archive")
    found = {}
    for _ in range(count):
        if raw[start : start + 4] != CENTRAL or start + 46 > len(raw):
            raise ValueError("broken central directory")
        flags, method, crc, packed, size, names, extra, comment, offset = struct.unpack_from(CENTRAL_FIELDS, raw, start)
        name = bytes(raw[start + 46 : start + 46 + names]).decode("utf-8" if flags & 0x800 else "cp437", "replace")
        found[name] = (name, flags, method, crc, packed, size, offset)
        start += 46 + names + extra + comment
    return list(found.values())


def _packed(suffix: str, skip: tuple[str, ...]):
    """Entries as they stand in the archive, with a number for each DEALT bytes of it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = memoryview(content.as_buffer()).cast("B") if content.is_valid else memoryview(b"")
                total = 0
                try:
                    listed = central_directory(raw)
                except ValueError as e:
                    rows.append((path, None, None, None, None, 0, None, str(e)))
                    continue
                for name, flags, method, crc, packed, whole, offset in listed:
                    if not name.endswith(suffix) or name.startswith(skip) or name.endswith("/"):
                        continue
                    head = raw[offset : offset + 30]
                    error = "encrypted" if flags & 1 else "no local header" if len(head) < 30 or head[:4] != LOCAL else None
                    data = None
                    if error is None:
                        begin = offset + 30 + sum(struct.unpack_from(LOCAL_FIELDS, head))
                        data = bytes(raw[begin : begin + packed])
                        error = "cut off" if len(data) < packed else None
                    rows.append((path, name, whole, method, crc, total // DEALT, data if error is None else None, error))
                    total += packed
                    size += packed
                    if size >= BATCH:
                        yield _rows(rows, _PACKED)
                        rows, size = [], 0
        if rows:
            yield _rows(rows, _PACKED)

    return run


def _inflate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries with their bytes; as they were found, those of another size are errors, check sums are not compared."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for path, name, whole, method, crc, packed, error in zip(*(batch.column(c) for c in ("path", "name", "size", "method", "crc", "packed", "error")), strict=True):
            data, why = None, error.as_py()
            if why is None:
                data = packed.as_py()
                if method.as_py() == DEFLATED:
                    try:
                        data = zlib.decompressobj(-15).decompress(data, whole.as_py() + 1)
                    except zlib.error as e:
                        data, why = None, str(e)
                elif method.as_py() != STORED:
                    data, why = None, f"compression method {method.as_py()}"
                if data is not None and len(data) != whole.as_py():
                    data, why = None, "size differs"
            rows.append((path.as_py(), name.as_py(), whole.as_py(), method.as_py(), crc.as_py(), data, why))
            size += len(data or b"")
            if size >= BATCH:
                yield _rows(rows, _ENTRY)
                rows, size = [], 0
    if rows:
        yield _rows(rows, _ENTRY)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def entries(files: DataFrame, suffix: str = "", skip: tuple[str, ...] = ("META-INF/",)) -> DataFrame:
    """Entries of zip archives given as ``files(path, content)``; broken archives and entries are error rows.

    One pass cuts archives at their central directory, without inflating anything; entries are then dealt by their
    compressed size, so that a large archive is inflated by many tasks.
    """
    cut = files.select("path", "content").mapInArrow(_packed(suffix, skip), _PACKED)
    return cut.repartition("path", "bin").mapInArrow(_inflate, _ENTRY)


def parse_class(data: bytes) -> dict:
    """Header and members of a class file; ValueError says what is wrong with it."""
    at = 0

    def take(form: str) -> tuple:
        nonlocal at
        if at + struct.calcsize(">" + form) > len(data):
            raise ValueError("truncated class file")
        out = struct.unpack_from(">" + form, data, at)
        at += struct.calcsize(">" + form)
        return out

    magic, _, major, n = take("IHHH")
    if magic != 0xCAFEBABE:
        raise ValueError(f"bad magic {magic:#x}")
    pool: list = [None] * n
    k = 1
    while k < n:
        (tag,) = take("B")
        if tag == 1:
            (size,) = take("H")
            pool[k] = data[at : at + size].decode("utf-8", "surrogatepass") if b"\xc0\x80" not in data[at : at + size] else data[at : at + size].replace(b"\xc0\x80", b"\0").decode()
            at += size
        elif tag in (7, 8, 16, 19, 20):
            pool[k] = take("H")[0]
        elif tag in (3, 4, 9, 10, 11, 12, 17, 18):
            take("I")
        elif tag in (5, 6):
            take("Q")
            k += 1  # these take two slots
        elif tag == 15:
            take("BH")
        else:
            raise ValueError(f"unknown constant tag {tag} at {k}")
        k += 1
    name = lambda i: pool[pool[i]] if i else None
    access, this, parent, count = take("HHHH")
    interfaces = [name(take("H")[0]) for _ in range(count)]
    members = []
    for kind in ("field", "method"):
        for _ in range(take("H")[0]):
            flags, label, desc, attributes = take("HHHH")
            for _ in range(attributes):
                at += take("HI")[1]
            members.append({"kind": kind, "name": pool[label], "desc": pool[desc], "access": flags})
    return {"owner": name(this), "access": access, "major": major, "super": name(parent), "interfaces": interfaces, "members": members}


def _decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ("owner", "access", "major", "super", "interfaces", "members")
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("desc", pa.string()), ("access", pa.int32())])))
    for batch in batches:
        rows, errors = [], []
        for name, data in zip(batch.column("name").to_pylist(), batch.column("data").to_pylist(), strict=True):
            row, error = dict.fromkeys(keys), None
            try:
                row = parse_class(data or b"")
                if name != f"{row['owner']}.class":
                    error = f"path differs from class {row['owner']}"
            except (ValueError, IndexError, TypeError, struct.error) as e:
                error = str(e)
            rows.append(row)
            errors.append(error)
        out = batch.select(["path", "name"])
        for k, t in zip(keys, kinds, strict=True):
            out = out.append_column(k, pa.array([r[k] for r in rows], t))
        yield out.append_column("error", pa.array(errors, pa.string()))


def classes(found: DataFrame) -> DataFrame:
    """Decoded classes of archive entries ``(path, name, data)``; errors are rows, not failures."""
    wanted = found.where(F.col("name").endswith(".class") & ~F.col("name").rlike("(^|/)(module|package)-info\\.class$"))
    schema = f"path string, name string, owner string, access int, major int, super string, interfaces array<string>, members array<{_MEMBER}>, error string"
    return wanted.select("path", "name", "data").mapInArrow(_decode, schema)


def surface(decoded: DataFrame, public_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(members (owner, super, interfaces, kind, name, desc, access), errors (path, name, error)) of decoded classes.

    public_only: visible classes and members alone.  A class without members has no rows.
    """
    good = decoded.where("error is null").select("owner", "super", "interfaces", F.col("access").alias("_a"), F.explode("members").alias("m"))
    if public_only:
        good = good.where(visible_class(F.col("_a")) & visible_member(F.col("m.access")))
    return good.select("owner", "super", "interfaces", "m.kind", "m.name", "m.desc", "m.access"), decoded.where("error is not null").select("path", "name", "error")
