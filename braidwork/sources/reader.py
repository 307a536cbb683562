"""A data source for folders of structure files: spark.read.format("structure").load(folder).

register(spark) makes it known. Options: table (residues, the default, atoms, elements or seqres), hydrogens (false),
partitionBytes (32 MB), pushdown (false). Columns and rules are those of structures.scan; a file is parsed by one
task, whole, and files are packed into partitions by size, so nothing is shuffled. A schema given to the reader names the
columns that are built, others are not. With pushdown, which needs spark.sql.python.filterPushdown.enabled, conditions on file
decide which files are opened at all.

Edge cases: files that begin with a dot or an underscore are passed over, as Spark's readers do; a file without records,
or an empty one, has no rows; bytes that are no UTF-8 are replaced; numbers that can't be read are null; an empty folder
gives an empty table; a folder that is not there, an unknown table and an unknown column are errors.
"""

from __future__ import annotations

import gzip
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import CaseInsensitiveDict, DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from braidwork.sources.structures import LETTERS, NUCLEOTIDES

TABLES = {
    "residues": "file string, chain string, chain_num int, res_idx int, label string, aa string, x double, y double, z double",
    "atoms": "file string, chain string, chain_num int, res_idx int, label string, aa string, atom string, x double, y double, z double",
    "elements": "file string, chain string, type string, ini string, end string, no int",
    "seqres": "file string, chain string, pos int, aa string",
}
#: Bytes that opening a file counts for when files are packed into partitions.
OPEN_BYTES = 64 << 10


def stem(path: str) -> str:
    """The name that structures.read_texts gives a file."""
    return re.sub(r"(\.(pdb|ent|txt))?(\.gz)?$", "", path.rsplit("/", 1)[-1])


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


@dataclass
class _Atom:
    no: int
    chain: str
    hetero: bool
    atom: str
    alt: str
    code: str
    label: str
    place: tuple


class StructureText:
    """Tables of one file's text."""

    def __init__(self, file: str, text: str, hydrogens: bool = False):
        self.file, self.hydrogens = file, hydrogens
        lines = text.split("\n")
        stop = next((k for k, line in enumerate(lines) if line.startswith("ENDMDL")), len(lines))
        self.lines = lines[:stop]
        standard: dict[str, str] = {}
        for line in self._records("MODRES"):
            standard.setdefault(line[12:15].strip(" "), line[24:27].strip(" "))
        self.standard = standard

    def _records(self, name: str) -> list[str]:
        return [line for line in self.lines if line.startswith(name)]

    def _letter(self, code: str) -> str:
        return LETTERS.get(code) or LETTERS.get(self.standard.get(code, ""), "X")

    def _own_atoms(self) -> dict[str, list[_Atom]]:
        """Atoms by chain that are no ligands, water, hydrogens or second alternates."""
        chains: dict[str, list[_Atom]] = {}
        ter, kept_alt = -1, None
        for no, line in enumerate(self.lines):
            if line.startswith("TER"):
                ter = no
            elif line.startswith(("ATOM", "HETATM")) and (self.hydrogens or line[13:14] != "H"):
                own = chains.setdefault(line[21:22], [])
                # a chain that has begun is closed by the next TER
                if own and ter > own[0].no:
                    continue
                place = tuple(_number(line[30 + 8 * k : 38 + 8 * k]) for k in range(3))
                own.append(_Atom(no, line[21:22], line.startswith("HETATM"), line[12:16].strip(" "), line[16:17].strip(" "), line[17:20].strip(" "), line[22:27].strip(" "), place))
                kept_alt = kept_alt or own[-1].alt
        return {chain: [a for a in own if a.alt in ("", kept_alt)] for chain, own in chains.items()}

    def _chains(self) -> Iterator[tuple[str, int, list[list[_Atom]]]]:
        """Chain, its number by its first atom, and its residues as lists of atoms."""
        found = []
        for chain, atoms in self._own_atoms().items():
            residues: list[list[_Atom]] = []
            for a in atoms:
                if not residues or residues[-1][0].label != a.label:
                    residues.append([])
                residues[-1].append(a)
            kept = []
            for r in residues:
                backbone = {"N", "CA"} <= {a.atom for a in r}
                r = [a for a in r if backbone or not a.hetero]
                if r:
                    kept.append(r)
            if kept:
                found.append((kept[0][0].no, chain, kept))
        for number, (_, chain, kept) in enumerate(sorted(found, key=lambda f: f[0]), 1):
            yield chain, number, kept

    def _residues(self) -> Iterator[tuple[tuple, list[_Atom]]]:
        for chain, number, residues in self._chains():
            at, before = 0, None
            for r in residues:
                first, last = r[0], before
                before = first
                if last and first.label[-1:].isascii() and first.label[-1:].isalpha() and None not in first.place + last.place:
                    if sum((a - b) ** 2 for a, b in zip(first.place, last.place, strict=True)) < 1.0:
                        continue
                if first.code not in NUCLEOTIDES:
                    yield (self.file, chain, number, at, first.label, self._letter(first.code)), r
                at += 1

    def residues(self) -> Iterator[tuple]:
        for key, r in self._residues():
            yield *key, *next((a.place for a in r if a.atom == "CA"), r[0].place)

    def atoms(self) -> Iterator[tuple]:
        for key, r in self._residues():
            for a in r:
                yield *key, a.atom, *a.place

    def elements(self) -> Iterator[tuple]:
        for no, line in enumerate(self.lines):
            if line.startswith("HELIX"):
                yield self.file, line[19:20], "H", line[21:26].strip(" "), line[33:38].strip(" "), no
            elif line.startswith("SHEET"):
                yield self.file, line[21:22], "E", line[22:27].strip(" "), line[33:38].strip(" "), no

    def seqres(self) -> Iterator[tuple]:
        at: dict[str, int] = {}
        for line in self._records("SEQRES"):
            for code in line[19:71].split():
                at[line[11:12]] = at.get(line[11:12], 0) + 1
                yield self.file, line[11:12], at[line[11:12]], self._letter(code)


@dataclass
class Files(InputPartition):
    paths: list[str]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)


class StructureReader(DataSourceReader):
    def __init__(self, options: CaseInsensitiveDict, schema: StructType):
        self.path, self.table, self.schema = options["path"], options.get("table", "residues").lower(), schema
        self.hydrogens = options.get("hydrogens", "false").lower() == "true"
        self.bytes = int(options.get("partitionBytes", 32 << 20))
        self.files: set | None = None
        names = [column.split()[0] for column in TABLES[self.table].split(", ")]
        unknown = [f.name for f in schema.fields if f.name not in names]
        if unknown:
            raise ValueError(f"{self.table} has no column {unknown[0]}; it has {', '.join(names)}")
        self.columns = [names.index(f.name) for f in schema.fields]

    def partitions(self) -> list[Files]:
        system, path = _opened(self.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=True)) if system.get_file_info(path).type != fs.FileType.File else [system.get_file_info(path)]
        packs, room = [], 0
        for info in sorted(found, key=lambda i: i.path):
            hidden = any(part[:1] in ("_", ".") for part in info.path[len(path.rstrip("/")) :].split("/") if part)
            if info.type != fs.FileType.File or hidden or (self.files is not None and stem(info.path) not in self.files):
                continue
            cost = info.size + OPEN_BYTES
            if cost > room:
                packs.append(Files([]))
                room = self.bytes
            packs[-1].paths.append(info.path)
            room -= cost
        return packs or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system = _opened(self.path)[0]
        types = [pa.string() if t == "string" else pa.int32() if t == "int" else pa.float64() for t in (f.dataType.simpleString() for f in self.schema.fields)]
        schema = pa.schema([(f.name, t) for f, t in zip(self.schema.fields, types, strict=True)])
        for path in partition.paths:
            with system.open_input_stream(path, compression=None) as stream:
                data = stream.read()
            text = (gzip.decompress(data) if path.endswith(".gz") and data else data).decode("utf-8", "replace")
            rows = list(getattr(StructureText(stem(path), text, self.hydrogens), self.table)())
            if rows:
                columns = list(zip(*rows, strict=True))
                yield pa.record_batch([pa.array(columns[k], t) for k, t in zip(self.columns, types, strict=True)], schema=schema)


class ChoosingReader(StructureReader):
    """Spark refuses readers that take conditions unless its own setting lets them, so they are asked for by an option."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("file",):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = wanted if self.files is None else self.files & wanted
            else:
                yield f


class StructureSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "structure"

    def schema(self) -> str:
        table = self.options.get("table", "residues").lower()
        if table not in TABLES:
            raise ValueError(f"no table {table}; there are {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema: StructType) -> StructureReader:
        self.schema()
        choosing = self.options.get("pushdown", "false").lower() == "true"
        return (ChoosingReader if choosing else StructureReader)(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session; one that already knows it keeps it."""
    try:
        spark.dataSource.register(StructureSource)
    except AnalysisException as e:
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


def write_files(texts: DataFrame, folder: str, suffix: str = ".pdb.gz") -> int:
    """Writes each row of texts (file, text; names differ) as a file of its own and returns how many. A file appears whole
    or not at all, and a task that runs again writes the same files again."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _opened(folder)
        system.create_dir(path, recursive=True)
        for batch in batches:
            for file, text in zip(batch.column("file").to_pylist(), batch.column("text").to_pylist(), strict=True):
                part = f"{path}/_{uuid.uuid4().hex}"
                with system.open_output_stream(part, compression=None) as stream:
                    data = (text or "").encode()
                    stream.write(gzip.compress(data, mtime=0) if suffix.endswith(".gz") else data)
                system.move(part, f"{path}/{file}{suffix}")
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64())})

    # the folder is there even without rows
    system, path = _opened(folder)
    system.create_dir(path, recursive=True)
    return texts.select("file", "text").mapInArrow(write, "n long").groupBy().sum("n").first()[0] or 0
