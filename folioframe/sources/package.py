"""Zip packages of parts, read with limits against hostile files."""

from __future__ import annotations

import hashlib
import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import model

#: The largest part, sum of parts, ratio of sizes and number of parts that are read.
MAX_PART, MAX_TOTAL, MAX_RATIO, MAX_PARTS = 256 << 20, 1 << 30, 200, 8192


class Package:
    """A zip of parts; sizes are checked before a part is read, checksums while it is."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.infos = {i.filename: i for i in self.zip.infolist() if not i.is_dir()}
        total = sum(i.file_size for i in self.infos.values())
        if len(self.infos) > MAX_PARTS or total > MAX_TOTAL:
            raise ValueError("the package is too large")
        for i in self.infos.values():
            if i.file_size > MAX_PART or i.file_size > MAX_RATIO * max(1, i.compress_size) and i.file_size > 1 << 20:
                raise ValueError(f"part {i.filename} is too large")

    def __contains__(self, part: str) -> bool:
        return part in self.infos

    def read(self, part: str) -> bytes:
        return self.zip.read(self.infos[part])

    def xml(self, part: str) -> ET.Element:
        return ET.fromstring(_safe(self.read(part)))

    def events(self, part: str) -> Iterator[tuple[str, ET.Element]]:
        """Start and end events of a part, read as a stream."""
        stream = self.zip.open(self.infos[part])
        _safe(self.zip.open(self.infos[part]).read(4096))
        return ET.iterparse(stream, ("start", "end"))

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """id -> (kind, target part) of a part's relationships; outside targets are left out."""
        folder, name = posixpath.split(part)
        rels = posixpath.join(folder, "_rels", f"{name}.rels")
        if rels not in self:
            return {}
        out = {}
        for r in self.xml(rels):
            target = r.get("Target", "")
            if r.get("TargetMode") != "External":
                target = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                out[r.get("Id", "")] = (r.get("Type", "").rsplit("/", 1)[-1], target)
        return out


def _safe(data: bytes) -> bytes:
    if b"<!DOCTYPE" in data[:4096]:
        raise ValueError("document types are refused")
    return data


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def attr(e: ET.Element | None, name: str, default: str | None = None) -> str | None:
    """An attribute by its local name."""
    if e is None:
        return default
    return next((v for k, v in e.attrib.items() if local(k) == name), default)


def child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for name in path:
        if e is None:
            return None
        e = next((c for c in e if local(c.tag) == name), None)
    return e


def descendants(e: ET.Element, *names: str) -> Iterator[ET.Element]:
    return (c for c in e.iter() if local(c.tag) in names)


#: Bytes of a file's rows that are held until its end is known to be sound.
HELD = 64 << 20


def _sound_batches(parse: Callable[[], Iterator[tuple]], names: list[str], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of a parse that reaches its end; none of one that fails.

    Rows are held until the end; of a file with more than HELD bytes of rows the parse only checks
    the rest, and a second one gives the rows, so memory stays bounded.
    """

    def batches() -> Iterator[pa.RecordBatch]:
        rows: list = []
        for row in parse():
            rows.append(dict(zip(names, row, strict=True)))
            if len(rows) >= 8192:
                yield pa.RecordBatch.from_pylist(rows, arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    held, size, all_held = [], 0, True
    try:
        for b in batches():
            size += b.nbytes
            if size > HELD:
                held, all_held = [], False
            elif all_held:
                held.append(b)
    except Exception:  # whatever a broken or hostile file makes the parser do; unreadable() tells the reason
        return
    yield from held if all_held else batches()


def _load(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content")


def _one_by_one(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in it:
        for i in range(batch.num_rows):  # one file at a time becomes a Python object
            yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()


def read_files(spark: SparkSession, path: str, schema: str, parse: Callable[[str, bytes], Iterator[tuple]], pattern: str | None = None) -> DataFrame:
    """Rows of `parse(file_id, content)` for every file; a file is read by Spark, so any file system will do.

    A file that cannot be read to its end gives no rows at all, and does not end the query;
    unreadable() lists such files with the reasons.
    """
    kinds = StructType.fromDDL(schema)

    def run(it):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kinds)
        for file_id, content in _one_by_one(it):
            yield from _sound_batches(lambda: parse(file_id, content), kinds.fieldNames(), arrow)  # noqa: B023

    return _load(spark, path, pattern).mapInArrow(run, schema)


def unreadable(spark: SparkSession, path: str, parse: Callable[[str, bytes], Iterator[tuple]], pattern: str | None = None) -> DataFrame:
    """file_id, error, reason of the files that `parse` cannot read to their end."""

    def run(it):
        for file_id, content in _one_by_one(it):
            try:
                for _ in parse(file_id, content):
                    pass
            except Exception as e:
                yield pa.RecordBatch.from_pylist([{"file_id": file_id, "error": type(e).__name__, "reason": str(e)}])

    return _load(spark, path, pattern).mapInArrow(run, "file_id string, error string, reason string")


def _parts(file_id: str, content: bytes) -> Iterator[tuple]:
    p = Package(content)
    for name, i in p.infos.items():
        yield file_id, name, i.compress_type, i.CRC, i.compress_size, i.file_size, bool(i.flag_bits & 1), None if i.flag_bits & 1 else hashlib.sha256(p.read(name)).hexdigest()


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """file_id, part, method, crc, sizes, encrypted, sha256 of the parts of zip packages."""
    return read_files(spark, path, model.PARTS, _parts)


def _opened(file_id: str, content: bytes) -> Iterator[tuple]:
    Package(content)
    yield (file_id,)


def bad_files(spark: SparkSession, path: str) -> DataFrame:
    """file_id, error, reason of files that are no readable package; unreadable() checks a whole parse."""
    return unreadable(spark, path, _opened)


def _relations(file_id: str, content: bytes) -> Iterator[tuple]:
    p = Package(content)
    for name in p.infos:
        folder, base = posixpath.split(name)
        if posixpath.basename(folder) == "_rels" and base.endswith(".rels"):
            source = posixpath.join(posixpath.dirname(folder), base.removesuffix(".rels"))
            for rid, (kind, target) in p.relations(source).items():
                yield file_id, source, rid, kind, target


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """file_id, part, id, kind, target of the relations inside packages; those to the outside are left out."""
    return read_files(spark, path, "file_id string, part string, id string, kind string, target string", _relations)


def safety(parts: DataFrame) -> DataFrame:
    """One row for each package of read_parts(): what it carries that asks for care, and its size when unpacked."""
    has = lambda pattern: F.coalesce(F.bool_or(F.col("part").rlike(pattern)), F.lit(False))
    return parts.groupBy("file_id").agg(
        has(r"(^|/)vbaProject\.bin$").alias("macros"), has(r"(^|/)externalLinks/").alias("external_links"), has(r"(^|/)(embeddings|activeX|ctrlProps)/").alias("embedded"),
        has(r"(^|/)(pivotTables|charts|drawings)/").alias("drawn"), F.bool_or("encrypted").alias("encrypted"), F.count(F.lit(1)).alias("n_parts"), F.sum("uncomp_size").alias("unpacked_bytes"),
    )


def validate(parts: DataFrame, relations: DataFrame, required: list[str]) -> DataFrame:
    """file_id, check, ok, failures: required parts, targets of relations, repeated names (case aside), per package of read_parts()."""
    files = parts.select("file_id").distinct()
    need = parts.sparkSession.createDataFrame([(r,) for r in required], "part string")
    missing = files.join(F.broadcast(need)).join(parts.select("file_id", "part"), ["file_id", "part"], "left_anti").withColumn("check", F.lit("required_parts"))
    dangling = relations.select("file_id", F.col("target").alias("part")).join(parts.select("file_id", "part"), ["file_id", "part"], "left_anti").withColumn("check", F.lit("relation_targets"))
    repeated = parts.groupBy("file_id", F.lower("part").alias("part")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("file_id", "part").withColumn("check", F.lit("part_names"))
    bad = missing.unionByName(dangling).unionByName(repeated).groupBy("file_id", "check").agg(F.count(F.lit(1)).alias("n"))
    checks = parts.sparkSession.createDataFrame([("required_parts",), ("relation_targets",), ("part_names",)], "check string")
    every = files.join(F.broadcast(checks)).join(bad, ["file_id", "check"], "left")
    return every.select("file_id", "check", F.col("n").isNull().alias("ok"), F.coalesce("n", F.lit(0)).alias("failures"))
