"""OBJ and MTL: files to face rows and back. A file is read whole, as its sections carry state from line to line."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

FACES = (
    "path string, face_id long, element string, material string, ring array<struct<x:double,y:double,z:double>>,"
    " uv array<struct<u:double,v:double>>, error string"
)
#: The comment lines that open a section; all three have to be there.
SECTIONS = {"# Roof": "ROOF", "# Wall": "WALL", "# Ground": "GROUND"}


def face_token(token: str) -> tuple[int | None, int | None, int | None]:
    """p/t/n of one corner; absent parts are None."""
    parts = [int(x) if x else None for x in token.split("/")]
    if parts[0] is None or len(parts) > 3:
        raise ValueError(f"not a corner: {token!r}")
    return tuple((parts + [None, None])[:3])


def _at(rows: list, index: int):
    """The row of a 1-based index; negative ones count from the end."""
    if index == 0 or index > len(rows) or -index > len(rows):
        raise IndexError(f"index {index} of {len(rows)}")
    return rows[index - 1 if index > 0 else index]


def parse_obj(text: str) -> list[dict]:
    """The faces of a file, or one row with an error."""
    v, vt, faces, element, material, seen = [], [], [], None, None, set()
    try:
        for number, line in enumerate(text.splitlines(), 1):
            line = line.strip()
            if line in SECTIONS:
                element = SECTIONS[line]
                seen.add(element)
                continue
            kind, *rest = line.split() or ["#"]
            if kind == "v":
                v.append(dict(zip("xyz", map(float, rest[:3]), strict=True)))
            elif kind == "vt":
                vt.append(dict(zip("uv", map(float, rest[:2]), strict=True)))
            elif kind == "usemtl":
                material = " ".join(rest)
            elif kind == "f":
                corners = [face_token(t) for t in rest]
                uv = [_at(vt, t) for _, t, _ in corners if t is not None]
                faces.append({
                    "face_id": len(faces), "element": element, "material": material,
                    "ring": [_at(v, p) for p, _, _ in corners], "uv": uv if len(uv) == len(corners) else [], "error": None,
                })
    except (ValueError, IndexError, TypeError) as e:
        return [{"error": f"line {number}: {e}"}]
    if missing := sorted(set(SECTIONS.values()) - seen):
        return [{"error": f"missing sections: {', '.join(missing)}"}]
    return faces


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """The faces of OBJ files; a malformed file is one row with its error, and null elsewhere."""
    target = to_arrow_schema(_parse_datatype_string(FACES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for path, text in zip(files.column(0).to_pylist(), files.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([{"path": path} | face for face in parse_obj(text)], target)

    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return files.mapInArrow(run, FACES)


def textured_walls(faces: DataFrame) -> DataFrame:
    """The faces that can be rectified: four corners or more, each with a texture coordinate."""
    return faces.where("error IS NULL AND size(ring) >= 4 AND size(uv) = size(ring)")


def obj_text(faces: DataFrame, mtl: str | None = None) -> DataFrame:
    """(mesh_id, text): one file's text for each mesh; coordinates with three decimals, vertices numbered by first use."""
    corner = faces.select("mesh_id", "element", "face_id", F.posexplode("ring").alias("idx", "p"))
    order = F.when(F.col("element") == "ROOF", 0).when(F.col("element") == "WALL", 1).otherwise(2)
    line = F.format_string("v %.3f %.3f %.3f", F.col("p.x"), F.col("p.y"), F.col("p.z"))
    rows = corner.select("mesh_id", "element", order.alias("o"), "face_id", "idx", line.alias("line"))
    firsts = rows.groupBy("mesh_id", "line").agg(F.min(F.struct("o", "face_id", "idx")).alias("at"))
    own = F.array_sort(F.collect_list(F.struct("at", "line")))
    vertices = firsts.groupBy("mesh_id").agg(own.alias("v"))
    rows = rows.join(vertices, "mesh_id").withColumn("n", F.array_position(F.transform("v", lambda s: s["line"]), F.col("line")))
    parts = rows.groupBy("mesh_id", "o", "face_id").agg(F.array_sort(F.collect_list(F.struct("idx", "n"))).alias("c"))
    parts = parts.withColumn("f", F.concat(F.lit("f "), F.array_join(F.transform("c", lambda s: s["n"].cast("string")), " ")))
    section = parts.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("o", "face_id", "f"))).alias("f"))
    part = lambda i: F.transform(F.filter("f", lambda s: s["o"] == i), lambda s: s["f"])
    body = [F.concat(F.array(F.lit(title)), part(i)) for i, title in enumerate(SECTIONS)]
    head = F.array(F.lit(f"mtllib {mtl}")) if mtl else F.array().cast("array<string>")
    lines = F.concat(head, F.transform("v", lambda s: s["line"]), *body)
    return section.join(vertices, "mesh_id").select("mesh_id", F.array_join(lines, "\n").alias("text"))


def parse_mtl(lines: DataFrame) -> DataFrame:
    """(path, material, map) from lines (path, n, value) of MTL files: the last map_Kd of each material."""
    name = F.when(F.col("value").startswith("newmtl "), F.trim(F.substring("value", 8, 1 << 20)))
    by = Window.partitionBy("path").orderBy("n")
    rows = lines.withColumn("material", F.last(name, ignorenulls=True).over(by))
    texture = F.when(F.trim("value").startswith("map_Kd "), F.trim(F.substring(F.trim("value"), 8, 1 << 20)))
    best = F.max_by(texture, F.when(texture.isNotNull(), F.col("n")))
    return rows.where("material IS NOT NULL").groupBy("path", "material").agg(best.alias("map"))


def textured_obj(faces: DataFrame, mtl: str) -> DataFrame:
    """(mesh_id, text): as obj_text, with texture coordinates: each corner has its own vt; faces without uv have none.

    faces: mesh_id, face_id, element, material, ring, uv.
    """
    order = F.when(F.col("element") == "ROOF", 0).when(F.col("element") == "WALL", 1).otherwise(2)
    has = F.size("uv") == F.size("ring")
    corner = F.transform("ring", lambda p: F.format_string("v %.3f %.3f %.3f", p["x"], p["y"], p["z"]))
    texture = F.when(has, F.transform("uv", lambda p: F.format_string("vt %.6f %.6f", p["u"], p["v"]))).otherwise(F.array().cast("array<string>"))
    rows = faces.select("mesh_id", order.alias("o"), "face_id", "element", F.coalesce("material", F.lit("")).alias("material"), corner.alias("v"), texture.alias("t"))
    before = Window.partitionBy("mesh_id").orderBy("o", "face_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"{c}0": F.coalesce(F.sum(F.size(c)).over(before), F.lit(0)) for c in ("v", "t")})
    number = lambda i: F.concat((F.col("v0") + i + 1).cast("string"), F.when(F.size("t") > 0, F.concat(F.lit("/"), (F.col("t0") + i + 1).cast("string"))).otherwise(""))
    face = F.concat(F.lit("f "), F.array_join(F.transform(F.sequence(F.lit(0), F.size("v") - 1), number), " "))
    lines = F.concat(F.when(F.col("material") != "", F.array(F.concat(F.lit("usemtl "), F.col("material")))).otherwise(F.array().cast("array<string>")), F.array(face))
    own = rows.where(F.size("v") > 0).groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("o", "face_id", "v", "t", lines.alias("f")))).alias("r"))
    every = lambda c: F.flatten(F.transform("r", lambda s: s[c]))
    part = lambda i: F.flatten(F.transform(F.filter("r", lambda s: s["o"] == i), lambda s: s["f"]))
    body = [F.concat(F.array(F.lit(title)), part(i)) for i, title in enumerate(SECTIONS)]
    return own.select("mesh_id", F.array_join(F.concat(F.array(F.lit(f"mtllib {mtl}")), every("v"), every("t"), *body), "\n").alias("text"))


def mtl_text(materials: DataFrame) -> DataFrame:
    """(mesh_id, text): the MTL file of each mesh's materials (mesh_id, material, map)."""
    one = F.concat(F.lit("newmtl "), F.col("material"), F.coalesce(F.concat(F.lit("\nmap_Kd "), F.col("map")), F.lit("")))
    rows = materials.select("mesh_id", "material", one.alias("t")).distinct()
    return rows.groupBy("mesh_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("material", "t"))), lambda s: s["t"]), "\n").alias("text"))
