"""A sink of one file per document, all or none: tasks write aside, the commit moves what succeeded into place.

Rows of a document come in page order, which is made here and nowhere before. A task that is killed or retried leaves
nothing in the folder: only the files that the commit is told of are moved, and a job that fails removes what was
written aside. Any file system that Arrow knows (local or shared folders, HDFS, S3) can hold the folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """Places of a task's files: written aside, and their names."""

    files: list[tuple[str, str]]


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str, suffix: str) -> None:
        self.path, self.suffix, self.aside = path.rstrip("/"), suffix, f"_aside-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        """A file for each run of rows (name, content) of one name."""
        files, root = _at(self.path)
        mine = f"{root}/{self.aside}/{uuid.uuid4().hex}"
        files.create_dir(mine, recursive=True)
        done: list[tuple[str, str]] = []
        name, out = None, None
        try:
            for row in iterator:
                if out is None or row.name != name:
                    if out is not None:
                        out.close()
                    name, target = row.name, f"{mine}/{len(done)}"
                    out = files.open_output_stream(target)
                    done.append((target, f"{row.name}{self.suffix}"))
                out.write((row.content or "").encode())
        finally:
            if out is not None:
                out.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _at(self.path)
        for m in messages:
            for aside, name in m.files if m else []:
                files.move(aside, f"{root}/{name}")
        self._clean()

    def abort(self, messages: list[Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        files, root = _at(self.path)
        if files.get_file_info(f"{root}/{self.aside}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.aside}")


class DocumentFiles(DataSource):
    """Format document_files; options path and suffix; rows (name, content)."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"], self.options.get("suffix", ".json"))


def write_documents(pages: DataFrame, path: str, suffix: str = ".json", name: str = "doc_id", order: str = "page_number", content: str = "content") -> None:
    """pages (name, order, content) to one file per name under path; a file holds its pages' contents in order."""
    pages.sparkSession.dataSource.register(DocumentFiles)
    rows = pages.select(pages[name].cast("string").alias("name"), pages[order].alias("at"), pages[content].alias("content"))
    rows = rows.repartition("name").sortWithinPartitions("name", "at").select("name", "content")
    rows.write.format("document_files").option("path", path).option("suffix", suffix).mode("append").save()
