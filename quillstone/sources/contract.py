"""The contract of a source of citations, as a data source of Spark.

A harvest is a folder of the answers of sources, a line of JSON a citation, in files by source and year
(``source=pubmed/year=2020/...``). ``spark.read.format("citations")`` lists it; a file is a partition. Conditions on source and
year are pushed to the reader, which leaves out the files that cannot meet them; conditions on what a title or abstract contains are
tried as lines are read, so that no others leave the reader. What the reader doesn't take on, Spark evaluates.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains

SCHEMA = "source string, year int, id string, title string, abstract string, journal string, doi string, pmid string, cited_by long"
FIELDS = ("id", "title", "abstract", "journal", "doi", "pmid", "cited_by")
TESTS: dict[type, Callable] = {
    EqualTo: lambda v, x: v == x, In: lambda v, x: v in x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x, StringContains: lambda v, x: x in v,
}


def meets(f: Filter, value) -> bool:
    """Whether a value meets a condition; null meets none."""
    return value is not None and (isinstance(f, IsNotNull) or TESTS[type(f)](value, f.value))


@dataclass
class HarvestFile(InputPartition):
    path: str
    source: str
    year: int | None


class HarvestReader(DataSourceReader):
    def __init__(self, path: str, enabled: set[str] | None, limit: int | None):
        self.path, self.enabled, self.limit = path, enabled, limit
        self.files: list[Filter] = []  #: conditions on source and year
        self.lines: list[Filter] = []  #: conditions on a line

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if name in ("source", "year") and (type(f) in TESTS or isinstance(f, IsNotNull)):
                self.files.append(f)
            elif name in ("title", "abstract") and isinstance(f, (StringContains, IsNotNull)) and self.limit is None:
                self.lines.append(f)
            else:
                yield f

    def partitions(self) -> list[HarvestFile]:
        """The files of enabled sources that can meet the conditions, in order of their names."""
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        out = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            parts = dict(p.split("=", 1) for p in info.path[len(root) :].split("/") if "=" in p)
            if not info.is_file or posixpath.basename(info.path)[:1] in "._" or "source" not in parts:
                continue
            source, year = unquote(parts["source"]), parts.get("year", "")
            file = HarvestFile(info.path, source, int(year) if year.lstrip("-").isdigit() else None)
            if (self.enabled is None or source in self.enabled) and all(meets(f, getattr(file, f.attribute[0])) for f in self.files):
                out.append(file)
        return sorted(out, key=lambda p: p.path) or [HarvestFile("", "", None)]

    def read(self, partition: HarvestFile) -> Iterator[tuple]:
        """The citations of a file; a line that is no JSON object is passed over, so that a fault of one answer doesn't fail the rest. With a limit, so many of the file's first."""
        from pyarrow import fs

        if not partition.path:
            return
        system, _ = fs.FileSystem.from_uri(self.path)
        left = self.limit
        with system.open_input_stream(partition.path) as stream:
            for line in _lines(stream):
                try:
                    row = json.loads(line)
                except ValueError:
                    continue
                if not isinstance(row, dict) or not all(meets(f, row.get(f.attribute[0])) for f in self.lines):
                    continue
                if left is not None:
                    if left <= 0:
                        return
                    left -= 1
                cited = row.get("cited_by")
                yield (partition.source, partition.year, *[row[c] if isinstance(row.get(c), str) else None for c in FIELDS[:-1]], cited if isinstance(cited, int) else None)


def _lines(stream, size: int = 1 << 20) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(size):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


class Harvest(DataSource):
    """Options: ``path``; ``enabled``, names of sources with commas (all without it); ``limit``, rows of a file (a service's page)."""

    @classmethod
    def name(cls) -> str:
        return "citations"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HarvestReader:
        enabled, limit = self.options.get("enabled"), self.options.get("limit")
        return HarvestReader(self.options["path"], None if enabled is None else {x.strip() for x in enabled.split(",")}, None if limit is None else int(limit))


def search(spark: SparkSession, path: str, enabled: Iterable[str] | None = None, years: tuple[int, int] | None = None, words: Iterable[str] = (), limit: int | None = None) -> DataFrame:
    """Citations of the enabled sources, of years from the first to the last, whose titles hold all the words, as written. ``limit`` is a file's."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Harvest)
    read = spark.read.format("citations").option("path", path)
    if enabled is not None:
        read = read.option("enabled", ",".join(enabled))
    if limit is not None:
        read = read.option("limit", limit)
    df = read.load()
    if years:
        df = df.where(F.col("year").between(*years))
    for w in words:
        df = df.where(F.col("title").contains(w))
    return df


def save_harvest(citations: DataFrame, path: str) -> None:
    """Citations (source, year, ...) as a harvest."""
    cols = [F.col(c) for c in ("source", "year", *FIELDS) if c in citations.columns]
    citations.select(*cols).repartition("source", "year").write.partitionBy("source", "year").json(path, mode="append")


def health(spark: SparkSession, path: str, sources: Iterable[str]) -> DataFrame:
    """(source, ok, files): whether each source has files in a harvest."""
    files = HarvestReader(path, None, None).partitions()
    held = {s: sum(f.source == s for f in files) for s in sources}
    return spark.createDataFrame([(s, n > 0, n) for s, n in held.items()], "source string, ok boolean, files long")
