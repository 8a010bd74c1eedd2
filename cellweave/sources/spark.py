"""Networks and logic inside Spark SQL: a data source of network files, and table functions.

After register(spark):
    spark.read.format("network").load("models/*.bnd")
    SELECT node, d.* FROM rules, LATERAL dnf(logic) d
    SELECT model_id, p.* FROM models, LATERAL local_paths(text, 'a') p
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase
from os.path import splitext

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from ..plans.frames import PARSED, parsed_row
from .text import READERS, FormatError, clauses, format_of, parse_boolean, read_anx


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, str | None]]):
        self.paths = paths


class NetworkReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise FormatError("a path is needed")
        self.uri, self.kind = options["path"], options.get("format", "auto")
        self.size = max(1, int(options.get("filesperpartition", "16")))

    def _base(self) -> tuple[fs.FileSystem, str, list[str], int]:
        """The file system, the path before the first part with wildcards, all parts, and that part's place."""
        parts = self.uri.split("/")
        wild = next((i for i, x in enumerate(parts) if set(x) & set("*?[")), len(parts))
        return *fs.FileSystem.from_uri("/".join(parts[:wild]) or "/"), parts, wild

    def _readable(self, path: str) -> bool:
        try:
            return not path.lower().endswith(".cfg") and format_of(path, self.kind) in READERS
        except FormatError:
            return False

    def partitions(self) -> list[Files]:
        """The files by name, dealt out in groups; only names pass the driver."""
        store, base, parts, wild = self._base()
        pattern = "/".join([base.rstrip("/"), *parts[wild:]])
        info = store.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FormatError(f"there is no {self.uri}")
        if info.type == fs.FileType.File:
            names = [base]
        else:
            found = store.get_file_info(fs.FileSelector(base, recursive=wild < len(parts)))
            names = [x.path for x in found if x.type == fs.FileType.File]
        inside = [x for x in names if wild == len(parts) or (x.count("/") == pattern.count("/") and fnmatchcase(x, pattern))]
        models = sorted(x for x in inside if self._readable(x))
        seconds = {x for x in ([f"{splitext(m)[0]}.cfg" for m in models if format_of(m, self.kind) == "maboss"]) if store.get_file_info(x).type == fs.FileType.File}
        pairs = [(m, c if (c := f"{splitext(m)[0]}.cfg") in seconds else None) for m in models]
        return [Files(pairs[i : i + self.size]) for i in range(0, len(pairs), self.size)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        store = self._base()[0]

        def content(path: str) -> bytes:
            with store.open_input_stream(path) as f:
                return f.read()

        for path, second in partition.paths:
            kind, name = format_of(path, self.kind), splitext(path.rpartition("/")[2])[0]
            if kind == "maboss":
                net = READERS[kind](content(path).decode(), second and content(second).decode(), name=name)
            else:
                net = READERS[kind](content(path) if kind == "zginml" else content(path).decode(), name=name)
            yield tuple(parsed_row(name, net).values())


class NetworkSource(DataSource):
    """A row a model, in the columns that Models.of_parsed() takes; a file is parsed once, a task reads filesPerPartition
    of them (16). The path is a file, a folder or has wildcards, on any file system that pyarrow opens by URI. Of a folder,
    files with endings of no readable format are left out; a .cfg file belongs to the .bnd file of its name. The file's
    name without ending is the model_id, so that files of one name in two formats are two rows of one id. No files: no
    rows. A file that is not in its format fails the query."""

    @classmethod
    def name(cls) -> str:
        return "network"

    def schema(self) -> str:
        return PARSED

    def reader(self, schema) -> NetworkReader:
        return NetworkReader(dict(self.options))


class Dnf:
    """dnf(logic): the clauses of an expression's disjunctive form, a row a literal. False has no rows, true one clause
    whose variable and value are null; a null expression has no rows, a malformed one fails the query."""

    def eval(self, logic: str):
        for n, clause in enumerate([] if logic is None else clauses(parse_boolean(logic))):
            for variable, value in sorted(clause.items()) or [(None, None)]:
                yield n, variable, value


class LocalPaths:
    """local_paths(text, automaton): paths inside an automaton that visit no level twice; path lists the numbers of the
    transitions. The text is in the ANX format. Nulls and unknown automata have no rows."""

    def eval(self, text: str, automaton: str):
        if text is None or automaton is None:
            return
        own = [(n, m.source, m.target) for n, m in enumerate(read_anx(text).transitions) if m.automaton == automaton]
        ways = [(f, (f, g), [n]) for n, f, g in own if f != g]
        while ways:
            source, seen, path = ways.pop()
            yield source, seen[-1], path
            ways += [(source, (*seen, g), [*path, n]) for n, f, g in own if f == seen[-1] and g not in seen]


def register(spark: SparkSession) -> None:
    """Makes the source and the table functions known to a session."""
    spark.dataSource.register(NetworkSource)
    spark.udtf.register("dnf", udtf(Dnf, returnType="clause int, variable string, value int"))
    spark.udtf.register("local_paths", udtf(LocalPaths, returnType="source int, target int, path array<int>"))
