"""Two data sources of our own: recorded pages of a provider, read in parts, and sitemaps, written in two phases.

Register them with register(spark); then spark.read.format("recorded_pages").load(folder) and
df.write.format("sitemap").option("base", address).save(folder). Paths are addresses that pyarrow's file systems open.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from xml.sax.saxutils import escape

from pyspark.sql import Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: The format of sitemaps.
NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
ADDRESSES = 50_000  # in one file at most


def register(spark: SparkSession) -> None:
    for source in (RecordedPages, Sitemap):
        spark.dataSource.register(source)


def _files(path: str):
    """(file system, path in it) of an address or a local path."""
    from pyarrow import fs

    if re.match(r"^[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


@dataclass
class Pages(InputPartition):
    """Files of one task: path, code, month and page of each."""

    files: tuple[tuple[str, str, str, int], ...]


class RecordedPages(DataSource):
    """A provider's answers as they were recorded: <folder>/<code>/<month>/<page>.xml, a row for each page.

    Options: path; perpartition (files of one task, 64 by default); code (only this one's folder is listed).
    """

    @classmethod
    def name(cls) -> str:
        return "recorded_pages"

    def schema(self) -> str:
        return "code string, month string, page int, xml string"

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.size, self.code = options["path"].rstrip("/"), int(options.get("perpartition", 64)), options.get("code")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        files, root = _files(self.path)
        listed = files.get_file_info(fs.FileSelector(f"{root}/{self.code}" if self.code else root, recursive=True, allow_not_found=True))
        named = ((f.path, re.search(r"([^/]+)/(\d{6})/(\d+)\.xml$", f.path)) for f in listed if f.is_file)
        pages = iter(sorted((p, *m.groups()[:2], int(m[3])) for p, m in named if m))
        return [Pages(part) for part in iter(lambda: tuple(islice(pages, self.size)), ())] or [Pages(())]

    def read(self, partition: Pages) -> Iterator[tuple]:
        files, _ = _files(self.path)
        for path, code, month, page in partition.files:
            with files.open_input_stream(path) as f:
                yield code, month, page, f.read().decode("utf-8")


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: (path, addresses) of each file."""

    files: tuple[tuple[str, int], ...]


class Sitemap(DataSource):
    """Rows (path, and if there lastmod, changefreq, priority) as sitemap files of at most ADDRESSES each, with an index.

    Options: path; base (what stands before every path); index (the index file's name, sitemap.xml by default). Tasks
    write to a folder aside; only when all have ended do their files get their names, and the index is written last, so
    readers that go by the index see all or nothing. A write that fails leaves what was there before. Null paths are
    left out.
    """

    @classmethod
    def name(cls) -> str:
        return "sitemap"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return SitemapWriter(self.options, schema.fieldNames())


class SitemapWriter(DataSourceWriter):
    def __init__(self, options, columns: list[str]) -> None:
        if "path" not in columns:
            raise ValueError("a sitemap needs a column `path`")
        self.path, self.base, self.index = options["path"].rstrip("/"), options.get("base", "").rstrip("/"), options.get("index", "sitemap.xml")
        self.columns = [c for c in ("lastmod", "changefreq", "priority") if c in columns]
        self.run = uuid.uuid4().hex
        self.aside = f"{self.path}/_{self.run}"

    def _entry(self, row: Row) -> str:
        told = "".join(f"<{c}>{escape(str(row[c]))}</{c}>" for c in self.columns if row[c] is not None and str(row[c]) != "")
        return f"<url><loc>{escape(self.base + row['path'])}</loc>{told}</url>\n"

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        files, _ = _files(self.path)
        _, aside = _files(self.aside)
        rows = (r for r in rows if r["path"] is not None)
        done = []
        for first in rows:
            path, n = f"{aside}/{uuid.uuid4().hex}.xml", 0
            files.create_dir(aside, recursive=True)
            with files.open_output_stream(path) as f:
                f.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="{NAMESPACE}">\n{self._entry(first)}'.encode())
                for n, row in enumerate(islice(rows, ADDRESSES - 1), 1):  # noqa: B007
                    f.write(self._entry(row).encode())
                f.write(b"</urlset>\n")
            done.append((path, n + 1))
        return Staged(tuple(done))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = _files(self.path)
        files.create_dir(root, recursive=True)
        names = []
        for k, (path, _) in enumerate(f for m in messages if m is not None for f in m.files):
            names.append(f"sitemap-{self.run[:8]}-{k:05}.xml")
            files.move(path, f"{root}/{names[-1]}")
        listed = "".join(f"<sitemap><loc>{escape(f'{self.base}/{n}')}</loc></sitemap>\n" for n in names)
        old = self._named()
        with files.open_output_stream(f"{root}/_{self.run}.index") as f:
            f.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="{NAMESPACE}">\n{listed}</sitemapindex>\n'.encode())
        files.move(f"{root}/_{self.run}.index", f"{root}/{self.index}")
        for n in old:
            files.delete_file(f"{root}/{n}")
        self.abort([])

    def _named(self) -> list[str]:
        """The files that the index names now."""
        from pyarrow import fs

        files, root = _files(self.path)
        if files.get_file_info(f"{root}/{self.index}").type == fs.FileType.NotFound:
            return []
        with files.open_input_stream(f"{root}/{self.index}") as f:
            return [n for n in re.findall(r"/(sitemap-[0-9a-f]{8}-\d{5}\.xml)</loc>", f.read().decode()) if files.get_file_info(f"{root}/{n}").is_file]

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, aside = _files(self.aside)
        if files.get_file_info(aside).type == fs.FileType.Directory:
            files.delete_dir(aside)


def sitemap_files(spark: SparkSession, path: str, index: str = "sitemap.xml") -> list[str]:
    """The files that the index of a folder names: what a reader sees."""
    rows = spark.read.text(f"{path}/{index}", wholetext=True).first()
    return [f"{path}/{n}" for n in re.findall(r"/(sitemap-[0-9a-f]{8}-\d{5}\.xml)</loc>", rows[0])]
