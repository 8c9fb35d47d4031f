"""A data source over landed pages: folders of files, one partition for each host, so that hosts stay apart.

``spark.dataSource.register(LandedPages)``; ``spark.read.format("landed_pages").load(folder)``,
with the option ``hosts`` (separated by commas) for some of them. The folder has
one subfolder for each host; a page ``name.html`` may have ``name.json`` with its url and status. Nothing is
fetched: what reads live sites writes such folders, at its own pace.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "host string, url string, status int, body string, error string"


class _Host(InputPartition):
    def __init__(self, folder: str):
        super().__init__(folder)
        self.folder = folder


class LandedPages(DataSource):
    """Rows (host, url, status, body, error); a page that can't be read is a row with an error."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path", "")
        self.hosts = {h.strip() for h in options.get("hosts", "").split(",") if h.strip()}

    def partitions(self) -> list[InputPartition]:
        folders = sorted(p for p in Path(self.root).iterdir() if p.is_dir()) if self.root else []
        return [_Host(str(p)) for p in folders if not self.hosts or p.name in self.hosts] or [_Host("")]

    def read(self, partition: _Host) -> Iterator[tuple]:
        if not partition.folder:
            return
        folder = Path(partition.folder)
        for page in sorted(folder.glob("*.html")):
            url, status, error, body = f"https://{folder.name}/{page.stem}", 200, None, None
            try:
                side = page.with_suffix(".json")
                if side.exists():
                    told = json.loads(side.read_text())
                    url, status = told.get("url", url), told.get("status", status)
                body = page.read_text(encoding="utf-8", errors="replace") if status < 400 else None
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"[:200]
            yield folder.name, url, status, body, error
