"""Page records of a folder as a Spark data source.

    spark.dataSource.register(PageSource)
    spark.read.format("lectern_pages").option("path", folder).option("pdf", "module:function").load().where("modality = 'text'")

A parser is named by its module and function: bytes to a text or a list of pages. Files of kinds without a parser aren't
listed. Partitions are runs of files of about `bytes` in all. Conditions on modality and source_file are pushed down, so files that they
leave out aren't opened; so is the absence of text and error from a query, which `columns` tells (a comma-separated list): a query for names and kinds
alone opens nothing. A file that fails gives a row with its error. Paths are those of pyarrow's file systems: local, hdfs, s3, gs.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "path string, source_file string, modality string, length bigint, page int, text string, error string"
# Which endings are of which kind.
KINDS = {"pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image", "tiff": "image", "bmp": "image", "mp3": "audio", "mp4": "audio", "wav": "audio", "m4a": "audio", "txt": "text"}
FOLDED = 32 << 20


def plain_text(content: bytes) -> str:
    return content.decode()


def kind_of(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1].lower()
    return KINDS.get(name.rsplit(".", 1)[-1]) if "." in name else None


def named(parser: str):
    module, _, function = parser.partition(":")
    return getattr(importlib.import_module(module), function)


@dataclass
class Files(InputPartition):
    files: list[tuple[str, str, int]]  # path, kind, length


class PageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        if not self.path:
            raise ValueError("option path is missing")
        self.parsers = {"text": f"{__name__}:plain_text"} | {k: options[k] for k in ("pdf", "image", "audio", "text") if options.get(k)}
        self.bytes = int(options.get("bytes", FOLDED))
        columns = options.get("columns")
        self.opens = columns is None or bool({"text", "error", "page"} & {c.strip() for c in columns.split(",")})
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("modality",), ("source_file",)):
                key = f.attribute[0]
                self.only[key] = self.only[key] & values if key in self.only else values
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        out, held, size = [], [], 0
        for info in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda x: (x.base_name.lower(), x.path)):
            kind = kind_of(info.path)
            if info.type != fs.FileType.File or kind not in self.parsers or kind not in self.only.get("modality", {kind}) or info.base_name not in self.only.get("source_file", {info.base_name}):
                continue
            held.append((info.path, kind, info.size))
            size += info.size
            if size >= self.bytes:
                out.append(Files(held))
                held, size = [], 0
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow import fs

        system = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        parsers = {k: named(p) for k, p in self.parsers.items() if self.opens}
        for path, kind, length in partition.files:
            head = (path, path.rsplit("/", 1)[-1], kind, length)
            if not self.opens:
                yield (*head, None, None, None)
                continue
            try:
                with system.open_input_stream(path) as f:
                    out = parsers[kind](f.read())
                pages = [(None, out)] if isinstance(out, str) else list(enumerate(out, 1))
            except Exception as e:  # noqa: BLE001  a bad file mustn't end the others
                yield (*head, None, None, f"{type(e).__name__}: {e}")
                continue
            for number, text in pages:
                if text is not None and text.strip():
                    yield (*head, number, text, None)


def register(spark) -> None:
    """The source in a session, with its filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PageSource)
