"""Readers and writers of mesh files.

Every reader gives the tables of ``trellis.model``. Line-based formats are read in parallel splits; binary files are parsed with
numpy, one file a task (2 GB at most, the bound of Spark's binary source). Writers make one ordered file.
"""

from __future__ import annotations

import base64
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.model import NODE_COUNT, Mesh
from trellis.sources.lines import fields, numbers, read_lines, write_lines

ELEMENTS = "eid long, etype string, con array<long>, tag long, fib array<double>"
NODES = "nid long, x double, y double, z double"
HEADER = 1024  # fixed value: bytes of the header of binary files
# fixed values: numeric codes of element types in binary files
CODES = ["Tt", "Hx", "Py", "Pr", "Qd", "Tr", "Ln"]
# fixed values: VTK cell types
VTK_TYPES = {"Tt": 10, "Hx": 12, "Pr": 13, "Py": 14, "Tr": 5, "Qd": 9, "Ln": 3}
# fixed values: native node order of cells whose order in VTK differs
VTK_ORDER = {"Hx": [5, 6, 7, 4, 3, 2, 1, 0], "Pr": [0, 1, 2, 3, 5, 4]}


# ---- native text

def read_points(spark: SparkSession, path: str) -> DataFrame:
    v = F.col("v")
    return numbers(spark, path, 1).select(F.col("line").alias("nid"), v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """(eid, etype, con, tag) of lines ``type nodes [tag]``; unknown types are lines, a missing tag is 0."""
    rows = fields(read_lines(spark, path).filter("line > 0")).filter(F.size("w") > 0)
    etype = F.when(F.col("w")[0].isin(list(NODE_COUNT)), F.col("w")[0]).otherwise("Ln")
    count = F.element_at(F.create_map(*(F.lit(x) for pair in NODE_COUNT.items() for x in pair)), etype)
    rows = rows.select((F.col("line") - 1).alias("eid"), etype.alias("etype"), "w", count.alias("n"))
    return rows.select("eid", "etype", F.slice("w", 2, F.col("n")).cast("array<bigint>").alias("con"), F.coalesce(F.get("w", F.col("n") + 1).cast("long"), F.lit(0)).cast("long").alias("tag"))


def read_fibres(spark: SparkSession, path: str) -> DataFrame:
    """(eid, fib); the first line is the number of vectors, or already data (three or six numbers)."""
    rows = numbers(spark, path)
    first = F.when(F.size("v") == 1, 1).otherwise(0)
    shift = rows.filter("line = 0").select(first.alias("s"))
    return rows.crossJoin(F.broadcast(shift)).filter(F.col("line") >= F.col("s")).select((F.col("line") - F.col("s")).alias("eid"), F.col("v").alias("fib"))


def assemble(nodes: DataFrame, elements: DataFrame, fibres: DataFrame | None) -> Mesh:
    """Without fibres each element gets (1, 0, 0)."""
    default = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    elements = elements.withColumn("fib", default) if fibres is None else elements.join(fibres, "eid", "left").withColumn("fib", F.coalesce("fib", default))
    return Mesh(nodes, elements.select("eid", "etype", "con", "tag", "fib"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_text(spark: SparkSession, base: str) -> Mesh:
    fib = read_fibres(spark, f"{base}.lon") if exists(spark, f"{base}.lon") else None
    mesh = assemble(read_points(spark, f"{base}.pts"), read_elements(spark, f"{base}.elem"), fib)
    return override_tags(spark, mesh, f"{base}.tags") if exists(spark, f"{base}.tags") else mesh


def override_tags(spark: SparkSession, mesh: Mesh, path: str) -> Mesh:
    new = numbers(spark, path).select(F.col("line").alias("eid"), F.col("v")[0].cast("long").alias("_t"))
    return mesh.with_elements(mesh.elements.join(new, "eid", "left").withColumn("tag", F.coalesce("_t", "tag")).drop("_t").select(*mesh.elements.columns))


def number(x: float) -> str:
    return repr(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


def write_text(mesh: Mesh, base: str) -> None:
    write_lines(mesh.nodes, "nid", f"{base}.pts", lambda r: " ".join(number(c) for c in (r.x, r.y, r.z)), [str(mesh.nodes.count())])
    write_lines(mesh.elements, "eid", f"{base}.elem", lambda r: f"{r.etype} {' '.join(map(str, r.con))} {r.tag}", [str(mesh.elements.count())])
    arity = mesh.elements.agg(F.max(F.size("fib"))).first()[0] or 0
    if arity:
        write_lines(mesh.elements, "eid", f"{base}.lon", lambda r: " ".join(number(c) for c in r.fib), [str(arity // 3)])


# ---- native binary

def parse_file(spark: SparkSession, path: str, parse: Callable[[bytes], pd.DataFrame], schema: str) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for content in pdf.content:
                yield parse(bytes(content))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_binary(spark: SparkSession, base: str) -> Mesh:
    """``.bpts`` (float32), ``.belem`` (int32 type, int64 nodes, int64 tag) and ``.blon`` (float32) after headers of 1024 bytes."""

    def points(data: bytes) -> pd.DataFrame:
        v = np.frombuffer(data, "<f4", offset=HEADER).reshape(-1, 3).astype(float)
        return pd.DataFrame({"nid": np.arange(len(v)), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]})

    def elements(data: bytes) -> pd.DataFrame:
        rows, at = [], HEADER
        while at < len(data):
            kind = CODES[struct.unpack_from("<i", data, at)[0]]
            n = NODE_COUNT[kind]
            *con, tag = struct.unpack_from(f"<{n + 1}q", data, at + 4)
            rows.append((len(rows), kind, con, tag))
            at += 4 + 8 * (n + 1)
        return pd.DataFrame(rows, columns=["eid", "etype", "con", "tag"])

    def fibres(data: bytes) -> pd.DataFrame:
        arity = int(data[:HEADER].split()[0])
        v = np.frombuffer(data, "<f4", offset=HEADER).reshape(-1, 3 * arity).astype(float)
        return pd.DataFrame({"eid": np.arange(len(v)), "fib": v.tolist()})

    fib = parse_file(spark, f"{base}.blon", fibres, "eid long, fib array<double>") if exists(spark, f"{base}.blon") else None
    return assemble(parse_file(spark, f"{base}.bpts", points, NODES), parse_file(spark, f"{base}.belem", elements, "eid long, etype string, con array<long>, tag long"), fib)


def write_binary(mesh: Mesh, base: str) -> None:
    def put(path: str, head: str, rows, pack) -> None:
        with Path(path).open("wb") as out:
            out.write(f"{head} 0 0".encode().ljust(HEADER, b"\0"))
            for row in rows.toLocalIterator(prefetchPartitions=True):
                out.write(pack(row))

    put(f"{base}.bpts", str(mesh.nodes.count()), mesh.nodes.orderBy("nid"), lambda r: struct.pack("<3f", r.x, r.y, r.z))
    put(f"{base}.belem", str(mesh.elements.count()), mesh.elements.orderBy("eid"), lambda r: struct.pack(f"<i{len(r.con) + 1}q", CODES.index(r.etype), *r.con, r.tag))
    arity = (mesh.elements.agg(F.max(F.size("fib"))).first()[0] or 0) // 3
    if arity:
        put(f"{base}.blon", str(arity), mesh.elements.orderBy("eid"), lambda r: struct.pack(f"<{len(r.fib)}f", *r.fib))


# ---- small companions

def read_vtx(spark: SparkSession, path: str) -> DataFrame:
    """(nid) after a count and a domain line."""
    return numbers(spark, path, 2).select(F.explode(F.col("v").cast("array<bigint>")).alias("nid"))


def write_vtx(nodes: DataFrame, path: str, domain: str = "extra") -> None:
    write_lines(nodes.select("nid").distinct(), "nid", path, lambda r: str(r.nid), [str(nodes.select("nid").distinct().count()), domain])


def read_surf(spark: SparkSession, path: str) -> DataFrame:
    """(fid, face)."""
    return read_elements(spark, path).select(F.col("eid").alias("fid"), F.col("con").alias("face"))


def write_surf(surface: DataFrame, path: str) -> None:
    rows = surface.withColumn("_k", F.struct("eid", "fkey"))
    write_lines(rows, "_k", path, lambda r: f"{'Tr' if len(r.face) == 3 else 'Qd'} {' '.join(map(str, r.face))}", [str(surface.count())])


def read_neubc(spark: SparkSession, path: str) -> DataFrame:
    """(face, tag, sp_vtx, eid)."""
    v = F.col("v").cast("array<bigint>")
    return numbers(spark, path, 1).filter(F.size("v") >= 6).select(F.slice(v, 1, 3).alias("face"), v[3].alias("tag"), v[4].alias("sp_vtx"), v[5].alias("eid"))


def read_data(spark: SparkSession, path: str) -> DataFrame:
    """(idx, value): one number for each line of ``.dat``, an array for each line of ``.vec``."""
    v = F.col("v")
    return numbers(spark, path).select(F.col("line").alias("idx"), (v if path.endswith(".vec") else v[0]).alias("value"))


def write_data(data: DataFrame, path: str) -> None:
    write_lines(data, "idx", path, lambda r: " ".join(map(number, r.value)) if isinstance(r.value, list) else number(r.value))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(sub_idx, mesh_idx) of a bare int64 file (``.nod``, ``.eidx``)."""

    def parse(data: bytes) -> pd.DataFrame:
        v = np.frombuffer(data, "<i8")
        return pd.DataFrame({"sub_idx": np.arange(len(v)), "mesh_idx": v})

    return parse_file(spark, path, parse, "sub_idx long, mesh_idx long")


def write_index(mapping: DataFrame, path: str) -> None:
    with Path(path).open("wb") as out:
        for row in mapping.orderBy("sub_idx").toLocalIterator(prefetchPartitions=True):
            out.write(struct.pack("<q", row.mesh_idx))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(elem, old, new) after a count."""
    v = F.col("v").cast("array<bigint>")
    return numbers(spark, path, 1).select(v[0].alias("elem"), v[1].alias("old"), v[2].alias("new"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(q, x, y, z, thr), or (q, z, rho, phi, v, thr, eps) of six columns, after a count."""
    rows = numbers(spark, path, 1)
    names = ("z", "rho", "phi", "v", "thr", "eps") if rows.agg(F.max(F.size("v"))).first()[0] == 6 else ("x", "y", "z", "thr")
    return rows.select(F.col("line").alias("q"), *(F.col("v")[i].alias(n) for i, n in enumerate(names)))


def write_id_lists(lists: DataFrame, path: str) -> None:
    """Id lists (q, ids) as a count and a line for each query, in order of the queries."""
    write_lines(lists.select("q", "ids"), "q", path, lambda r: "".join(f"{i} " for i in r.ids or ()), [str(lists.count())])


def read_cables(spark: SparkSession, path: str) -> DataFrame:
    """(cid, par, br, size, gap, conductivity, pts) of a ``.pkje`` file: a count, then for each cable its index, its parents, its branches, the
    number of its points, its size, gap junction resistance and conductivity, and its points, a line each."""

    def parse(data: bytes) -> pd.DataFrame:
        lines = iter(data.decode().split("\n"))
        rows = []
        for n in range(int(next(lines))):
            label = next(lines).split()
            if label[:1] != ["Cable"] or int(label[1]) != n:
                raise ValueError(f"cable {n} is out of order: {' '.join(label)}")
            par, br = ([int(x) for x in next(lines).split()[:2]] for _ in range(2))
            count = int(next(lines))
            size, gap, conductivity = (float(next(lines)) for _ in range(3))
            rows.append((n, par, br, size, gap, conductivity, [dict(zip("xyz", map(float, next(lines).split()[:3]))) for _ in range(count)]))
        return pd.DataFrame(rows, columns=["cid", "par", "br", "size", "gap", "conductivity", "pts"])

    return parse_file(spark, path, parse, "cid long, par array<long>, br array<long>, size double, gap double, conductivity double, pts array<struct<x:double,y:double,z:double>>")


def write_cables(cables: DataFrame, path: str) -> None:
    def text(r) -> str:
        head = [f"Cable {r.cid}", " ".join(map(str, r.par)), " ".join(map(str, r.br)), str(len(r.pts)), *(f"{x:f}" for x in (r["size"], r.gap, r.conductivity))]
        return "\n".join((*head, *(f"{p.x:f} {p.y:f} {p.z:f}" for p in r.pts)))

    write_lines(cables, "cid", path, text, [str(cables.count())])


def read_uvc(spark: SparkSession, path: str) -> DataFrame:
    """(nid, z, rho, phi, v) after a count."""
    return numbers(spark, path, 1).select(F.col("line").alias("nid"), *(F.col("v")[i].alias(n) for i, n in enumerate(("z", "rho", "phi", "v"))))


# ---- time series and images

IGB_TYPES = {"byte": "u1", "char": "i1", "short": "i2", "long": "i4", "int": "i4", "uint": "u4", "ushort": "u2", "float": "f4", "double": "f8", "vec3f": "f4", "vec3d": "f8", "vec4f": "f4", "vec4d": "f8", "vec9f": "f4", "vec9d": "f8"}


def igb_header(data: bytes) -> dict[str, str]:
    return dict(item.split(":", 1) for item in data[:HEADER].decode("latin-1").replace("\0", " ").split() if ":" in item)


def read_igb(spark: SparkSession, path: str) -> DataFrame:
    """(t, idx, value array<double>), scaled by ``facteur`` and ``zero``."""

    def parse(data: bytes) -> pd.DataFrame:
        h = igb_header(data)
        kind = h.get("type", "float")
        width = int(kind[3]) if kind.startswith("vec") else 1
        order = ">" if h.get("systeme", "little_endian").startswith("big") else "<"
        n = int(h.get("x", 1)) * int(h.get("y", 1)) * int(h.get("z", 1))
        v = np.frombuffer(data, order + IGB_TYPES[kind], offset=HEADER).astype(float) * float(h.get("facteur", 1)) + float(h.get("zero", 0))
        v = v[: len(v) // (n * width) * n * width].reshape(-1, width)  # a truncated last slice goes
        at = np.arange(len(v))
        return pd.DataFrame({"t": (at // n).astype("int32"), "idx": at % n, "value": v.tolist()})

    return parse_file(spark, path, parse, "t int, idx long, value array<double>")


def write_igb(series: DataFrame, path: str, width: int = 1) -> None:
    row = series.agg(F.max("t") + 1, F.max("idx") + 1).first()
    kind = "float" if width == 1 else f"vec{width}f"
    head = f"x:{row[1]} y:1 z:1 t:{row[0]} type:{kind} systeme:little_endian facteur:1 zero:0 "
    with Path(path).open("wb") as out:
        out.write(head.encode().ljust(HEADER - 1) + b"\f")
        for r in series.orderBy("t", "idx").toLocalIterator(prefetchPartitions=True):
            out.write(struct.pack(f"<{width}f", *(r.value if isinstance(r.value, list) else [r.value])))


def read_image(spark: SparkSession, path: str):
    """A structured-points file with ASCII scalars."""
    from trellis.operators.voxels import Image

    rows = read_lines(spark, path)
    head = {r.value.split()[0].upper(): r.value.split()[1:] for r in rows.filter("line < 12").orderBy("line").collect() if re.match(r"[A-Za-z_]", r.value)}
    start = rows.filter(F.col("value").rlike("(?i)^LOOKUP_TABLE")).agg(F.min("line")).first()[0] + 1
    nx, ny, nz = map(int, head["DIMENSIONS"])
    flat = fields(rows.filter(F.col("line") >= start)).select("line", F.posexplode("w").alias("p", "s"))
    from trellis.model import dense_ids

    width = flat.agg(F.max("p") + 1).first()[0]
    values = dense_ids(flat.select((F.col("line") * width + F.col("p")).alias("at"), F.col("s").cast("double").alias("value")), "at", "n")
    n = F.col("n")
    voxels = values.select((n % nx).cast("int").alias("i"), (F.floor(n / nx) % ny).cast("int").alias("j"), F.floor(n / (nx * ny)).cast("int").alias("k"), "value")
    return Image(voxels, (nx, ny, nz), tuple(map(float, head["ORIGIN"])), tuple(map(float, head.get("SPACING") or head["ASPECT_RATIO"])))


def write_image(image, path: str) -> None:
    n = [image.dim[0], image.dim[0] * image.dim[1]]
    total = image.dim[0] * image.dim[1] * image.dim[2]
    spark = image.voxels.sparkSession
    sparse = image.voxels.select((F.col("i") + F.col("j") * n[0] + F.col("k") * n[1]).cast("long").alias("id"), "value")
    rows = spark.range(total).join(sparse, "id", "left").select("id", F.coalesce("value", F.lit(0.0)).alias("value"))
    head = ["# vtk DataFile Version 3.0", "image", "ASCII", "DATASET STRUCTURED_POINTS", "DIMENSIONS %d %d %d" % image.dim, "ORIGIN %g %g %g" % image.origin, "SPACING %g %g %g" % image.spacing, f"POINT_DATA {total}", "SCALARS values double 1", "LOOKUP_TABLE default"]
    write_lines(rows, "id", path, lambda r: number(r.value), head)


# ---- VTK, VTU and other exchange formats: one parser for a file, in one task

def table(spark: SparkSession, path: str, parse: Callable[[bytes], tuple[list, list]]) -> Mesh:
    """``parse`` gives points [(x, y, z)] and cells [(type, nodes, tag, fibre)]."""

    def nodes(data: bytes) -> pd.DataFrame:
        p = np.array(parse(data)[0], dtype=float).reshape(-1, 3)
        return pd.DataFrame({"nid": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})

    def cells(data: bytes) -> pd.DataFrame:
        rows = [(i, k, list(map(int, c)), int(t), [float(v) for v in f]) for i, (k, c, t, f) in enumerate(parse(data)[1])]
        return pd.DataFrame(rows, columns=["eid", "etype", "con", "tag", "fib"])

    return Mesh(parse_file(spark, path, nodes, NODES), parse_file(spark, path, cells, ELEMENTS))


def native(kind: str, con: list[int]) -> list[int]:
    """From VTK's node order to the native one."""
    order = VTK_ORDER.get(kind)
    if order is None:
        return con
    out = [0] * len(con)
    for place, source in enumerate(order):
        out[source] = con[place]
    return out


def parse_vtk(data: bytes) -> tuple[list, list]:
    """ASCII unstructured grid or polydata; cell scalars are tags."""
    words = data.decode("latin-1").split("\n", 4)[4].split()
    upper = [w.upper() for w in words]
    at = upper.index("POINTS")
    n = int(words[at + 1])
    points = np.array(words[at + 3 : at + 3 + 3 * n], dtype=float).reshape(-1, 3).tolist()
    cells, kinds = [], None
    for name in ("CELLS", "POLYGONS"):
        if name in upper:
            at = upper.index(name)
            count, flat = int(words[at + 1]), list(map(int, words[at + 3 : at + 3 + int(words[at + 2])]))
            i = 0
            for _ in range(count):
                cells.append(flat[i + 1 : i + 1 + flat[i]])
                i += 1 + flat[i]
    if "CELL_TYPES" in upper:
        at = upper.index("CELL_TYPES")
        names = {v: k for k, v in VTK_TYPES.items()}
        kinds = [names[int(w)] for w in words[at + 2 : at + 2 + len(cells)]]
    kinds = kinds or [{3: "Tr", 4: "Qd", 2: "Ln"}[len(c)] for c in cells]
    tags = [0] * len(cells)
    if "CELL_DATA" in upper and "LOOKUP_TABLE" in upper[upper.index("CELL_DATA") :]:
        at = upper.index("LOOKUP_TABLE", upper.index("CELL_DATA")) + 2
        tags = [int(float(w)) for w in words[at : at + len(cells)]]
    return points, [(k, native(k, c), t, [1.0, 0.0, 0.0]) for k, c, t in zip(kinds, cells, tags)]


def vtk_con(row) -> list[int]:
    order = VTK_ORDER.get(row.etype)
    return [row.con[i] for i in order] if order else list(row.con)


def write_vtk(mesh: Mesh, path: str) -> None:
    n, m = mesh.nodes.count(), mesh.elements.count()
    size = mesh.elements.agg(F.sum(F.size("con") + 1)).first()[0] or 0
    ordered = lambda: mesh.elements.orderBy("eid").toLocalIterator(prefetchPartitions=True)
    with Path(path).open("w") as out:
        out.write(f"# vtk DataFile Version 3.0\nmesh\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS {n} double\n")
        out.writelines(f"{number(r.x)} {number(r.y)} {number(r.z)}\n" for r in mesh.nodes.orderBy("nid").toLocalIterator(prefetchPartitions=True))
        out.write(f"CELLS {m} {size}\n")
        out.writelines(f"{len(r.con)} {' '.join(map(str, vtk_con(r)))}\n" for r in ordered())
        out.write(f"CELL_TYPES {m}\n")
        out.writelines(f"{VTK_TYPES[r.etype]}\n" for r in ordered())
        out.write(f"CELL_DATA {m}\nSCALARS elemTag int 1\nLOOKUP_TABLE default\n")
        out.writelines(f"{r.tag}\n" for r in ordered())


VTU_TYPES = {"UInt8": "u1", "Int8": "i1", "Int32": "i4", "Int64": "i8", "UInt32": "u4", "UInt64": "u8", "Float32": "f4", "Float64": "f8"}


def vtu_array(node: ET.Element) -> np.ndarray:
    kind = VTU_TYPES[node.get("type")]
    if node.get("format") == "ascii":
        return np.array((node.text or "").split(), dtype=kind)
    text = "".join((node.text or "").split())
    head = base64.b64decode(text[:8])  # a 4-byte size, coded apart from or together with the data
    size = struct.unpack("<I", head[:4])[0]
    data = base64.b64decode(text)
    if len(data) < 4 + size:
        data = head[:4] + base64.b64decode(text[8:])
    return np.frombuffer(data, "<" + kind, offset=4, count=size // np.dtype(kind).itemsize)


def parse_vtu(data: bytes) -> tuple[list, list]:
    piece = ET.fromstring(data).find(".//Piece")
    points = vtu_array(piece.find("Points/DataArray")).reshape(-1, 3).tolist()
    arrays = {a.get("Name"): vtu_array(a) for part in ("Cells", "CellData") for a in piece.findall(f"{part}/DataArray")}
    names = {v: k for k, v in VTK_TYPES.items()}
    ends = arrays["offsets"].tolist()
    con = arrays["connectivity"].tolist()
    m = len(ends)
    tags = arrays.get("elemTag", np.zeros(m)).tolist()
    fibres = [arrays[n].reshape(m, -1) for n in ("fiber", "sheet") if n in arrays]
    rows = []
    for i, (a, b) in enumerate(zip([0, *ends], ends)):
        kind = names[int(arrays["types"][i])]
        rows.append((kind, native(kind, con[a:b]), tags[i], np.concatenate([f[i] for f in fibres]).tolist() if fibres else [1.0, 0.0, 0.0]))
    return points, rows


def write_vtu(mesh: Mesh, path: str) -> None:
    """ASCII arrays."""
    nodes = mesh.nodes.orderBy("nid")
    ordered = lambda: mesh.elements.orderBy("eid").toLocalIterator(prefetchPartitions=True)
    with Path(path).open("w") as out:
        out.write(f'<?xml version="1.0"?>\n<VTKFile type="UnstructuredGrid" version="0.1" byte_order="LittleEndian">\n<UnstructuredGrid>\n<Piece NumberOfPoints="{mesh.nodes.count()}" NumberOfCells="{mesh.elements.count()}">\n')

        def array(kind: str, name: str, lines, width: int = 1) -> None:
            out.write(f'<DataArray type="{kind}" Name="{name}" NumberOfComponents="{width}" format="ascii">\n')
            out.writelines(lines)
            out.write("</DataArray>\n")

        out.write("<Points>\n")
        array("Float64", "Points", (f"{number(r.x)} {number(r.y)} {number(r.z)}\n" for r in nodes.toLocalIterator(prefetchPartitions=True)), 3)
        out.write("</Points>\n<Cells>\n")
        array("Int64", "connectivity", (f"{' '.join(map(str, vtk_con(r)))}\n" for r in ordered()))
        ends = 0

        def offsets():
            nonlocal ends
            for r in ordered():
                ends += len(r.con)
                yield f"{ends}\n"

        array("Int64", "offsets", offsets())
        array("UInt8", "types", (f"{VTK_TYPES[r.etype]}\n" for r in ordered()))
        out.write("</Cells>\n<CellData>\n")
        array("Int64", "elemTag", (f"{r.tag}\n" for r in ordered()))
        out.write("</CellData>\n</Piece>\n</UnstructuredGrid>\n</VTKFile>\n")


def parse_medit(data: bytes) -> tuple[list, list]:
    """``.mesh``: numbered from 1, a reference at the end of each row."""
    words = data.decode("latin-1").split()
    points, cells = [], []
    kinds = {"Tetrahedra": "Tt", "Hexahedra": "Hx", "Triangles": "Tr", "Quadrilaterals": "Qd", "Edges": "Ln", "Prisms": "Pr"}
    i = 0
    while i < len(words):
        if words[i] == "Vertices":
            n = int(words[i + 1])
            points = np.array(words[i + 2 : i + 2 + 4 * n], dtype=float).reshape(-1, 4)[:, :3].tolist()
            i += 2 + 4 * n
        elif words[i] in kinds and i + 1 < len(words) and words[i + 1].isdigit():
            kind = kinds[words[i]]
            w, n = NODE_COUNT[kind] + 1, int(words[i + 1])
            rows = np.array(words[i + 2 : i + 2 + w * n], dtype=np.int64).reshape(-1, w)
            cells += [(kind, (r[:-1] - 1).tolist(), int(r[-1]), [1.0, 0.0, 0.0]) for r in rows]
            i += 2 + w * n
        else:
            i += 1
    return points, cells


def parse_obj(data: bytes) -> tuple[list, list]:
    points, cells = [], []
    for line in data.decode("latin-1").splitlines():
        w = line.split()
        if w[:1] == ["v"]:
            points.append([float(x) for x in w[1:4]])
        elif w[:1] == ["f"]:
            ids = [int(x.split("/")[0]) for x in w[1:]]
            ids = [i - 1 if i > 0 else len(points) + i for i in ids]
            cells.append(({3: "Tr", 4: "Qd"}[len(ids)], ids, 0, [1.0, 0.0, 0.0]))
    return points, cells


def write_obj(mesh: Mesh, path: str) -> None:
    with Path(path).open("w") as out:
        out.writelines(f"v {number(r.x)} {number(r.y)} {number(r.z)}\n" for r in mesh.nodes.orderBy("nid").toLocalIterator(prefetchPartitions=True))
        out.writelines(f"f {' '.join(str(i + 1) for i in r.con)}\n" for r in mesh.elements.filter("etype in ('Tr', 'Qd')").orderBy("eid").toLocalIterator(prefetchPartitions=True))


def parse_neutral(data: bytes) -> tuple[list, list]:
    """``.neu``: points; tetrahedra ``tag n1 n2 n3 n4`` numbered from 1; surface triangles are left out."""
    words = data.split()
    n = int(words[0])
    points = np.array(words[1 : 1 + 3 * n], dtype=float).reshape(-1, 3).tolist()
    at = 1 + 3 * n
    rows = np.array(words[at + 1 : at + 1 + 5 * int(words[at])], dtype=np.int64).reshape(-1, 5)
    return points, [("Tt", (r[1:] - 1).tolist(), int(r[0]), [1.0, 0.0, 0.0]) for r in rows]


def read_stellar(spark: SparkSession, base: str) -> Mesh:
    """``.node`` and ``.ele``; the first number of the first row says whether ids start at 0 or 1."""
    p = numbers(spark, f"{base}.node", 1).filter(F.size("v") >= 4)
    e = numbers(spark, f"{base}.ele", 1).filter(F.size("v") >= 5)
    low = p.agg(F.min(F.col("v")[0])).first()[0]
    nodes = p.select((F.col("v")[0] - low).cast("long").alias("nid"), *(F.col("v")[i].alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))))
    elements = e.select((F.col("v")[0] - low).cast("long").alias("eid"), F.lit("Tt").alias("etype"), F.transform(F.slice("v", 2, 4), lambda x: (x - low).cast("long")).alias("con"), F.coalesce(F.get("v", F.lit(5)).cast("long"), F.lit(0)).cast("long").alias("tag"))
    return assemble(nodes, elements, None)


# ---- dispatch

READERS = {
    "text": read_text, "binary": read_binary, "stellar": read_stellar,
    **{name: (lambda spark, base, e=ext, f=parse: table(spark, base if base.endswith(e) else base + e, f)) for name, ext, parse in (("vtk", ".vtk", parse_vtk), ("vtu", ".vtu", parse_vtu), ("mmg", ".mesh", parse_medit), ("obj", ".obj", parse_obj), ("netgen", ".neu", parse_neutral))},
}
WRITERS = {"text": write_text, "binary": write_binary, "vtk": lambda m, b: write_vtk(m, b if b.endswith(".vtk") else b + ".vtk"), "vtu": lambda m, b: write_vtu(m, b if b.endswith(".vtu") else b + ".vtu"), "obj": lambda m, b: write_obj(m, b if b.endswith(".obj") else b + ".obj")}
EXTENSIONS = {".vtk": "vtk", ".vtu": "vtu", ".mesh": "mmg", ".obj": "obj", ".neu": "netgen", ".belem": "binary", ".elem": "text", ".node": "stellar"}


def read_mesh(spark: SparkSession, path: str, fmt: str | None = None) -> Mesh:
    """By name of the format, else by extension, else binary if it is there, else text."""
    ext = Path(path).suffix
    fmt = fmt or EXTENSIONS.get(ext) or ("binary" if exists(spark, f"{path}.belem") else "text")
    base = path[: -len(ext)] if fmt in ("text", "binary", "stellar") and ext in EXTENSIONS else path
    return READERS[fmt](spark, base)


def write_mesh(mesh: Mesh, path: str, fmt: str | None = None) -> None:
    ext = Path(path).suffix
    fmt = fmt or EXTENSIONS.get(ext) or "text"
    base = path[: -len(ext)] if fmt in ("text", "binary") and ext in EXTENSIONS else path
    WRITERS[fmt](mesh, base)
