"""JSON arrays in ZIP archives as a Spark data source: ``spark.read.format("zipped_json")``.

Every array file of every archive is one partition. Its elements are cut out of the inflated stream one after the
other, so a partition holds one block and one element, however large the file is. ``field`` and ``values`` keep
the elements whose field (text) is one of the values before they leave the reader; a filter with = or IN on a
column that the schema names does the same by push-down.

Options: path (a folder, an archive, or several with commas), field, values (with commas), element_bytes.
Rows: archive, file, at (the number of the element in its array), element (JSON text, null if broken), problem.
With a schema of one's own, columns of that name beside these are the element's fields as text.

Defined results: an element that is no JSON, or is longer than ``element_bytes``, gives a row with null and what is
wrong, and reading goes on behind it; a file that ends early gives its whole elements and one such row; an archive that
is none gives one such row; files other than *.json, and empty arrays, give nothing. Archives are read where the
executors see them as files: this source is for mounted storage.
"""

from __future__ import annotations

import glob
import json
import os
import zipfile
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

BLOCK = 1 << 16
#: Longest element that is handed on.
ELEMENT_BYTES = 16 << 20
_OWN = ["archive", "file", "at", "element", "problem"]


def elements(blocks: Iterator[bytes], most: int = ELEMENT_BYTES) -> Iterator[tuple[bytes | None, str | None]]:
    """The elements of a JSON array from its bytes: (element, None), or (None, what is wrong)."""
    depth, quoted, escaped, begun, ended, held, size = 0, False, False, False, False, [], 0
    for block in blocks:
        start = 0
        for k, c in enumerate(block):
            if quoted:
                if escaped:
                    escaped = False
                elif c == 0x5C:
                    escaped = True
                elif c == 0x22:
                    quoted = False
                continue
            if c == 0x22:
                quoted = True
            elif c in b"[{":
                depth += 1
                if depth == 1 and not begun:
                    begun, start = True, k + 1
            elif c in b"]}":
                depth -= 1
            if (c == 0x2C and depth == 1) or (depth == 0 and begun and not ended):
                size += k - start
                held.append(block[start:k])
                piece = b"".join(held).strip() if size <= most else None
                if piece is None:
                    yield None, f"longer than {most} bytes"
                elif piece or c == 0x2C:
                    yield piece, None
                held, size, start, ended = [], 0, k + 1, depth == 0
        if begun and not ended:
            size += len(block) - start
            held = [*held, block[start:]] if size <= most else []
    if not ended:
        yield None, "the array does not end" if begun else "no array"


class Member(InputPartition):
    def __init__(self, archive: str, file: str | None, problem: str | None = None):
        self.archive, self.file, self.problem = archive, file, problem


class ZippedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names = schema.fieldNames()
        self.paths = [p for part in options["path"].split(",") for p in ([part] if part.endswith(".zip") else sorted(glob.glob(os.path.join(part, "**", "*.zip"), recursive=True)))]
        self.most = int(options.get("element_bytes", ELEMENT_BYTES))
        self.keep: dict[str, set[str]] = {}
        if options.get("field"):
            self.keep[options["field"]] = set(options.get("values", "").split(","))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in self.names and f.attribute[0] not in _OWN:
                name = f.attribute[0]
                self.keep[name] = values & self.keep[name] if name in self.keep else values
            else:
                yield f

    def partitions(self) -> list[Member]:
        found = []
        for path in self.paths:
            try:
                with zipfile.ZipFile(path) as z:
                    found += [Member(path, i.filename) for i in z.infolist() if i.filename.endswith(".json")]
            except (OSError, zipfile.BadZipFile) as e:
                found.append(Member(path, None, str(e)))
        return found

    def _row(self, member: Member, at: int, element: str | None, problem: str | None, value: object) -> tuple:
        own = {"archive": member.archive, "file": member.file, "at": at, "element": element, "problem": problem}
        fields = value if isinstance(value, dict) else {}
        said = lambda v: None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return tuple(own[n] if n in own else said(fields.get(n)) for n in self.names)

    def read(self, partition: Member) -> Iterator[tuple]:
        if partition.problem is not None:
            yield self._row(partition, 0, None, partition.problem, None)
            return
        at = 0
        try:
            with zipfile.ZipFile(partition.archive) as z, z.open(partition.file) as stream:
                for raw, problem in elements(iter(lambda: stream.read(BLOCK), b""), self.most):
                    value, text = None, None
                    if raw is not None:
                        try:
                            text = raw.decode()
                            value = json.loads(text)
                        except ValueError as e:
                            text, problem = None, str(e)
                    fields = value if isinstance(value, dict) else {}
                    if problem is not None or all(str(fields.get(k)) in map(str, v) and fields.get(k) is not None for k, v in self.keep.items()):
                        yield self._row(partition, at, text, problem, value)
                    at += 1
        except (OSError, EOFError, zipfile.BadZipFile) as e:
            yield self._row(partition, at, None, str(e), None)


class ZippedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zipped_json"

    def schema(self) -> str:
        return "archive string, file string, at long, element string, problem string"

    def reader(self, schema: StructType) -> ZippedReader:
        return ZippedReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("zipped_json")`` known, with push-down of filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ZippedJson)
