"""MSH 4.1 ASCII meshes as a data source: ``spark.read.format("msh").load(path)``.

Planning reads a file once for its line feeds and section names, keeps a place for every ``CHUNK`` bytes, and jumps from one
block header of a section to the next, so it holds an index of blocks and no rows. Nodes and elements are then dealt
into partitions of about ``ROWS_EACH`` lines of one block, each with the byte ranges of its lines: for nodes that of the ids
and that of the coordinates. Tasks read only their ranges and parse them as arrays.

The options ``sections`` and ``etype`` choose partitions before any task runs; ``Mesh`` scans with the ones that a table needs.
(They are options and no pushed filters: Spark keeps what a Python source was told by one scan for the other scans of the
same frame, so that a join of nodes with elements would lose rows.) A path that does not exist, is a directory, is
empty, holds no mesh or is not named .msh raises.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ionframe.operators.mesh import joined_corners
from ionframe.sources.framed import opened, write_framed

ROWS = "file string, section string, id long, dim int, tag int, etype int, x double, y double, z double, nodes array<long>, name string"
KINDS = {"file": pa.string(), "section": pa.string(), "id": pa.int64(), "dim": pa.int32(), "tag": pa.int32(), "etype": pa.int32(), "x": pa.float64(), "y": pa.float64(), "z": pa.float64(), "nodes": pa.list_(pa.int64()), "name": pa.string()}
CHUNK, ROWS_EACH = 4 << 20, 100_000
#: The names of sections in a file and here.
SECTIONS = {"PhysicalNames": "physical", "Entities": "entity", "Nodes": "node", "Elements": "element"}


class Lines:
    """Where the lines of a file begin, from one pass over its bytes: the first line of each chunk, and the lines that name sections."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()
        self.first = [0]  # the number of line feeds before each chunk
        self.sections: dict[str, int] = {}
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, np.int64))
        before = b"\n"
        for k in range(0, self.size, CHUNK):
            data = self._bytes(k, min(CHUNK + 64, self.size - k))
            own = data[:CHUNK]
            starts = [0] if before == b"\n" and own[:1] == b"$" else []
            found = own.find(b"\n$")
            while found >= 0:
                starts.append(found + 1)
                found = own.find(b"\n$", found + 1)
            for at in starts:
                name = data[at + 1 : at + 64].split(b"\n", 1)[0].strip().decode("utf-8", "replace")
                self.sections[name] = self.first[-1] + own[:at].count(b"\n")
            self.first.append(self.first[-1] + own.count(b"\n"))
            before = own[-1:]

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def place(self, line: int) -> int:
        """The byte at which a line begins; the file's size beyond the last."""
        if line <= 0:
            return 0
        if line > self.first[-1]:
            return self.size
        chunk = int(np.searchsorted(self.first, line, side="left")) - 1
        if self.held[0] != chunk:
            data = np.frombuffer(self._bytes(chunk * CHUNK, CHUNK), dtype=np.uint8)
            self.held = chunk, np.flatnonzero(data == 10) + chunk * CHUNK
        return int(self.held[1][line - self.first[chunk] - 1]) + 1

    def text(self, line: int, n: int = 1) -> str:
        begin = self.place(line)
        return self._bytes(begin, self.place(line + n) - begin).decode()


@dataclass
class Range(InputPartition):
    """Lines of one block: the bytes of elements or of another section, or those of node ids with those of their places."""

    file: str
    section: str
    begin: int
    end: int
    dim: int = 0
    tag: int = 0
    etype: int | None = None
    begin2: int = 0
    end2: int = 0

    def __post_init__(self):
        self.value = (self.file, self.begin)


def blocks(file: str, lines: Lines) -> Iterator[Range]:
    """The partitions of a file."""
    for name in ("PhysicalNames", "Entities"):
        if name in lines.sections and f"End{name}" in lines.sections:
            yield Range(file, SECTIONS[name], lines.place(lines.sections[name] + 1), lines.place(lines.sections[f"End{name}"]))
    for name in ("Nodes", "Elements"):
        if name not in lines.sections:
            continue
        at = lines.sections[name] + 1
        n_blocks = int(lines.text(at).split()[0])
        at += 1
        for _ in range(n_blocks):
            dim, tag, kind, n = (int(c) for c in lines.text(at).split())
            at += 1
            for k in range(0, n, ROWS_EACH):
                m = min(ROWS_EACH, n - k)
                own = lines.place(at + k), lines.place(at + k + m)
                if name == "Nodes":
                    yield Range(file, "node", *own, dim, tag, None, lines.place(at + n + k), lines.place(at + n + k + m))
                else:
                    yield Range(file, "element", *own, dim, tag, kind)
            at += 2 * n if name == "Nodes" else n


class Msh(DataSource):
    """Options: ``path``, ``sections`` (comma-separated, all by default), ``etype`` (of elements, all by default)."""

    @classmethod
    def name(cls) -> str:
        return "msh"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema: StructType) -> MshReader:
        sections = set(filter(None, self.options.get("sections", "").split(","))) or set(SECTIONS.values())
        return MshReader(self.options["path"], sections, int(self.options["etype"]) if self.options.get("etype") else None)


class MshReader(DataSourceReader):
    def __init__(self, path: str, sections: set[str], etype: int | None = None):
        self.files, self.sections, self.etype = checked_files(path), sections, etype

    def partitions(self) -> list[Range]:
        found, some = [], False
        for path in self.files:
            system, inner = opened(path)
            with system.open_input_file(inner) as file:
                every = list(blocks(path, Lines(file)))
            some = some or any(b.section == "node" for b in every)
            found += [b for b in every if b.section in self.sections and (self.etype is None or b.etype == self.etype)]
        if not some:
            raise ValueError(f"{', '.join(self.files)}: no mesh")
        return found or [Range(self.files[0], "element", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, inner = opened(part.file)
        with system.open_input_file(inner) as file:
            own = _read(file, part.begin, part.end)
            columns = {"node": _nodes, "element": _elements, "physical": _physical, "entity": _entities}[part.section](own, _read(file, part.begin2, part.end2))
        n = max((len(c) for c in columns.values()), default=0)
        fixed = {"file": part.file, "section": part.section} | ({"dim": part.dim, "tag": part.tag, "etype": part.etype} if part.section in ("node", "element") else {})
        arrays = [columns[c].cast(k) if c in columns else pa.array([fixed.get(c)] * n, k) for c, k in KINDS.items()]
        yield pa.RecordBatch.from_arrays(arrays, names=list(KINDS))


def _read(file: pa.NativeFile, begin: int, end: int) -> bytes:
    file.seek(begin)
    return file.read(end - begin)


def _nodes(ids: bytes, places: bytes) -> dict[str, pa.Array]:
    number = np.array(ids.split(), dtype=np.int64)
    xyz = np.array(places.split(), dtype=np.float64).reshape(max(1, len(number)), -1)  # parametric nodes have more than three
    return {"id": pa.array(number)} | {a: pa.array(xyz[:, i]) for i, a in enumerate("xyz")}


def _elements(own: bytes, _: bytes) -> dict[str, pa.Array]:
    first = own.split(b"\n", 1)[0].split()
    cells = np.array(own.split(), dtype=np.int64).reshape(-1, max(1, len(first)))  # a block has elements of one type
    width = cells.shape[1] - 1
    return {"id": pa.array(cells[:, 0]), "nodes": pa.ListArray.from_arrays(np.arange(len(cells) + 1, dtype=np.int32) * width, cells[:, 1:].ravel())} if own else {}


def _physical(own: bytes, _: bytes) -> dict[str, pa.Array]:
    rows = [line.split(maxsplit=2) for line in own.decode().splitlines()[1:] if line.strip()]
    return {"dim": pa.array([int(r[0]) for r in rows], pa.int32()), "tag": pa.array([int(r[1]) for r in rows], pa.int32()), "name": pa.array([r[2].strip().strip('"') for r in rows], pa.string())}


def _entities(own: bytes, _: bytes) -> dict[str, pa.Array]:
    lines = own.decode().splitlines()
    out, at = [], 1
    for dim, n in enumerate(int(c) for c in lines[0].split()):
        for line in lines[at : at + n]:
            cells = line.split()
            groups = int(cells[4 if dim == 0 else 7])
            begin = (4 if dim == 0 else 7) + 1
            rest = cells[begin + groups :]
            out.append((dim, int(cells[0]), [abs(int(t)) for t in rest[1:]], ",".join(cells[begin : begin + groups])))
        at += n
    return {c: pa.array([r[i] for r in out], KINDS[c]) for i, c in enumerate(("dim", "tag", "nodes", "name"))}


def checked_files(path: str) -> list[str]:
    """The .msh files of a path, or of comma-separated paths; the guards of this module's docstring."""
    files = [p for p in path.split(",") if p]
    for p in files:
        if not p.endswith(".msh"):
            raise ValueError(f"{p} is no .msh file")
        system, inner = opened(p)
        info = system.get_file_info(inner)
        if info.type.name == "NotFound":
            raise FileNotFoundError(f"{p} does not exist")
        if info.type.name == "Directory":
            raise IsADirectoryError(f"{p} is a directory")
        if not info.size:
            raise ValueError(f"{p} is empty")
    return files


class Mesh:
    """The files at a path; each table of them is a scan of its own sections."""

    def __init__(self, spark: SparkSession, path: str):
        checked_files(path)
        self.spark, self.path = spark, path
        spark.dataSource.register(Msh)

    def scan(self, section: str, etype: int | None = None) -> DataFrame:
        reader = self.spark.read.format("msh").option("sections", section)
        return (reader if etype is None else reader.option("etype", etype)).load(self.path)


def read_msh(spark: SparkSession, path: str) -> Mesh:
    """The mesh at ``path``; what is no mesh raises, at once or when it is read."""
    return Mesh(spark, path)


def _rows(mesh: Mesh | DataFrame, section: str, etype: int | None = None) -> DataFrame:
    rows = mesh.scan(section, etype) if isinstance(mesh, Mesh) else mesh
    rows = rows.where(F.col("section") == section)
    return rows if etype is None else rows.where(F.col("etype") == etype)


def write_msh(points: DataFrame, cells: DataFrame, path: str) -> None:
    """Nodes (node_id, x, y, z) and tetrahedra (tetra_id, n0..n3) as one .msh file of one block each."""
    n, m = points.count(), cells.count()
    least, most = points.agg(F.min("node_id"), F.max("node_id")).first()
    low, high = cells.agg(F.min("tetra_id"), F.max("tetra_id")).first()
    number = lambda c: F.col(c).cast("string")
    ids = points.select(F.lit(0).alias("k"), F.col("node_id").alias("i"), number("node_id").alias("line"))
    places = points.select(F.lit(1).alias("k"), F.col("node_id").alias("i"), F.concat_ws(" ", *map(number, "xyz")).alias("line"))
    between = f"$EndNodes\n$Elements\n1 {m} {low or 0} {high or 0}\n3 1 4 {m}"
    middle = points.sparkSession.range(1).select(F.lit(2).alias("k"), F.col("id").alias("i"), F.lit(between).alias("line"))
    solid = cells.select(F.lit(3).alias("k"), F.col("tetra_id").alias("i"), F.concat_ws(" ", *map(number, ("tetra_id", "n0", "n1", "n2", "n3"))).alias("line"))
    lines = ids.unionByName(places).unionByName(middle).unionByName(solid).orderBy("k", "i")
    write_framed(lines.select("line"), path, f"$MeshFormat\n4.1 0 8\n$EndMeshFormat\n$Nodes\n1 {n} {least or 0} {most or 0}\n3 1 0 {n}", "$EndElements")


def nodes(mesh: Mesh | DataFrame) -> DataFrame:
    return _rows(mesh, "node").select(F.col("id").alias("node_id"), "x", "y", "z")


def elements(mesh: Mesh | DataFrame, etype: int) -> DataFrame:
    """Elements by type: 15 point, 1 line, 2 triangle, 4 tetrahedron."""
    return _rows(mesh, "element", etype).select(F.col("id").alias("element_id"), F.col("dim").alias("entity_dim"), F.col("tag").alias("entity_tag"), "nodes")


def physical_groups(mesh: Mesh | DataFrame) -> DataFrame:
    return _rows(mesh, "physical").select("dim", "tag", "name")


def boundary_tags(mesh: Mesh | DataFrame) -> DataFrame:
    """(volume_tag, surface_tag) of the entities."""
    return _rows(mesh, "entity").where("dim = 3").select(F.col("tag").alias("volume_tag"), F.explode("nodes").alias("surface_tag"))


def triangles(mesh: Mesh | DataFrame) -> DataFrame:
    """(tri_id, v0, v1, v2, n0, n1, n2, cnt) with a count of 0."""
    e = elements(mesh, 2)
    return joined_corners(e, nodes(mesh), 3).join(e, "element_id").select(F.col("element_id").alias("tri_id"), "v0", "v1", "v2", *[F.col("nodes")[i].alias(f"n{i}") for i in range(3)], F.lit(0).cast("long").alias("cnt"))


def tetras(mesh: Mesh | DataFrame) -> DataFrame:
    """(tetra_id, v0..v3, n0..n3)."""
    e = elements(mesh, 4)
    return joined_corners(e, nodes(mesh), 4).join(e, "element_id").select(F.col("element_id").alias("tetra_id"), *[f"v{i}" for i in range(4)], *[F.col("nodes")[i].alias(f"n{i}") for i in range(4)])


def tree(mesh: Mesh | DataFrame) -> DataFrame:
    """(entity_dim, entity_tag, element_ids): the elements under each entity."""
    return _rows(mesh, "element").groupBy(F.col("dim").alias("entity_dim"), F.col("tag").alias("entity_tag")).agg(F.array_sort(F.collect_list("id")).alias("element_ids"))


def group_tag(mesh: Mesh | DataFrame, name: str) -> int:
    """The tag of the physical group of that name; none raises."""
    found = physical_groups(mesh).where(F.col("name") == name).orderBy("tag").limit(1).collect()
    if not found:
        raise KeyError(f"no physical group {name}")
    return found[0]["tag"]


def has_group(mesh: Mesh | DataFrame, name: str) -> bool:
    return not physical_groups(mesh).where(F.col("name") == name).isEmpty()
