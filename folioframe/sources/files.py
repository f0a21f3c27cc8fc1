"""Image files as tables and tables as image files.

``scan_metadata`` reads headers, ``load`` decodes pages; both go through the
binaryFile source, list inputs in natural order of their names, and keep a row
for each file that can't be read, with its status.  ``register`` adds a Spark
data source that writes packed pages as files: each task writes under temporary
names, the commit renames them, and an abort removes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from folioframe.operators import pages as A
from folioframe.sources import formats

META = "path string, status string, kind string, page int, width int, height int, dpi_x int, dpi_y int"
PAGES = "path string, status string, page int, img_id long, width int, height int, data binary"
_HEADS = 1 << 20


def listed(spark: SparkSession, inputs: list[str]) -> DataFrame:
    """path and content of the files that a list of files, folders or patterns names, each once."""
    return spark.read.format("binaryFile").load([i for i in dict.fromkeys(x.strip() for x in inputs) if i]).select("path", "content")


def ordered(files: DataFrame, path: str = "path") -> DataFrame:
    """files with rank: natural order of the names within each folder (from 0)."""
    folder, name = F.regexp_extract(path, "^(.*/)?[^/]*$", 1), F.regexp_extract(path, "([^/]*)$", 1)
    return A.numbered(files.withColumn("folder", folder), [A.natural_key(name), F.col(path)], "folder", [c for c in files.columns] + ["folder"])


def scan_metadata(files: DataFrame) -> DataFrame:
    """A row for each page of each file (path, content) from its header; status is loaded, no_images or unrecognised.

    Only the first megabyte of a file travels to Python, unless its pages'
    directories can lie behind it (TIFF and PDF).
    """
    deep = F.substring("content", 1, 4).isin(*(F.unhex(F.lit(h)) for h in ("49492A00", "4D4D002A", "25504446")))
    heads = files.select("path", F.when(deep, F.col("content")).otherwise(F.substring("content", 1, _HEADS)).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                found = formats.metadata(content or b"")
                if not found:
                    rows.append((path, "unrecognised" if found is None else "no_images", *(None,) * 6))
                else:
                    rows += [(path, "loaded", m.kind, m.page, m.width, m.height, m.dpi_x, m.dpi_y) for m in found]
            yield _batch(rows, (pa.string(), pa.string(), pa.string(), *(pa.int32(),) * 5), META)

    return heads.mapInArrow(run, META)


def _batch(rows: list[tuple], kinds: tuple, ddl: str) -> pa.RecordBatch:
    names = [c.strip().split(" ")[0] for c in ddl.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def load(files: DataFrame) -> DataFrame:
    """A row for each page of each file (path, content): decoded gray pixels, status loaded, header_only (a format whose pixels can't be decoded, or a damaged page), no_images or unrecognised. img_id is a hash of path and page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                path, content = b.column("path")[k].as_py(), b.column("content")[k].as_py() or b""
                found = formats.metadata(content)
                rows = []
                for m in found or []:
                    a = formats.decode(content, m.page)
                    rows.append((path, "header_only", m.page, None, m.width, m.height, None) if a is None else (path, "loaded", m.page, None, a.shape[1], a.shape[0], np.ascontiguousarray(a).tobytes()))
                rows = rows or [(path, "unrecognised" if found is None else "no_images", *(None,) * 5)]
                yield _batch(rows, (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), PAGES)

    pages = files.select("path", "content").mapInArrow(run, PAGES)
    return pages.withColumn("img_id", F.when(F.col("data").isNotNull(), F.xxhash64("path", "page")))


# --- sink -------------------------------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.folder = options["path"].rstrip("/")
        self.kind = options.get("kind", "tiff")
        self.dpi = int(options.get("dpi", "300"))
        self.codecs = options.get("bw_codec", "packbits"), options.get("colour_codec", "deflate")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def _open(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        """Rows (name, width, height, data), or (name, pages: list of those) for files of several pages."""
        out = []
        system, folder = self._open(self.folder)
        system.create_dir(folder, recursive=True)
        for b in iterator:
            for r in b.to_pylist():
                parts = r.get("pages") or [r]
                pages = [np.frombuffer(p["data"], np.uint8).reshape(p["height"], p["width"]) for p in parts]
                temporary, final = f"{folder}/.{self.job}-{uuid.uuid4().hex}", f"{folder}/{r['name']}"
                with system.open_output_stream(temporary) as f:
                    f.write(formats.encode(pages, self.kind, self.dpi, *self.codecs))
                out.append((temporary, final))
        return _Written(out)

    def commit(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        system, _ = self._open(self.folder)
        done = [f for m in messages if m is not None for f in m.files]
        names = [final for _, final in done]
        there = [i.path for i in system.get_file_info(names) if i.type != fs.FileType.NotFound] if names else []
        if len(set(names)) < len(names) or (there and not self.overwrite):
            self.abort(messages)
            raise ValueError(f"files that are there or named twice, {there[:3] or 'named twice'}")
        for temporary, final in done:
            system.move(temporary, final)

    def abort(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        system, folder = self._open(self.folder)
        for i in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if i.base_name.startswith(f".{self.job}-"):
                system.delete_file(i.path)


class PageFiles(DataSource):
    """Packed pages as image files: options path, kind (tiff, pdf, png, pgm), dpi, bw_codec (none, packbits, lzw, deflate, fax), colour_codec (the same but fax)."""

    @classmethod
    def name(cls) -> str:
        return "pagefiles"

    def schema(self) -> str:
        return "name string, width int, height int, data binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageFiles)


def write(pages: DataFrame, path: str, kind: str = "tiff", mode: str = "append", **options: str) -> None:
    """Packed pages with name (or name and pages) as files in a folder; overwrite replaces files of the same names."""
    register(pages.sparkSession)
    pages.write.format("pagefiles").mode(mode).options(kind=kind, **options).save(path)


def zone_text(zones: DataFrame, header: list[str]) -> DataFrame:
    """value: lines of tab-separated zones (img_id, ord, kind, points) of each image behind five comment lines, one text an image."""
    if len(header) != 5:
        raise ValueError("five header lines")
    line = F.concat_ws("\t", F.col("ord").cast("string"), "kind", F.array_join(F.transform("points", lambda p: p.cast("string")), "\t"))
    lines = zones.groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    head = F.lit("\n".join("# " + h for h in header))
    return lines.select("img_id", F.concat_ws("\n", head, F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("value"))
