"""CityGML: buildings and textures in; detailed models and appearances back into the tree that they came from.

Reading is Spark's XML source, an element at a time. Writing parses a file whole, as its elements are put back in
place; a file is a row, and files are written side by side.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_RING = "struct<`gml:LinearRing`: struct<`gml:posList`: string>>"
_SURFACE = (
    "struct<`gml:MultiSurface`: struct<`gml:surfaceMember`: array<struct<`gml:Polygon`:"
    f" struct<`gml:exterior`: {_RING}, `gml:interior`: array<{_RING}>>>>>>"
)
_SCHEMA = f"`_gml:id` string, `bldg:lod0RoofEdge` {_SURFACE}, `bldg:lod0FootPrint` {_SURFACE}"


def positions(text: Column) -> Column:
    """A posList as (lat, lon, h)."""
    v = F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda s: s != ""), lambda s: s.cast("double"))
    return F.transform(
        F.sequence(F.lit(0), F.floor(F.size(v) / 3).cast("int") - 1),
        lambda i: F.struct(F.get(v, i * 3).alias("lat"), F.get(v, i * 3 + 1).alias("lon"), F.get(v, i * 3 + 2).alias("h")),
    )


def _parts(name: str) -> Column:
    """All polygons of an outline: (ring, holes); members without an exterior are left out."""
    members = F.col(f"`{name}`.`gml:MultiSurface`.`gml:surfaceMember`")
    text = lambda ring: ring["gml:LinearRing"]["gml:posList"]
    given = F.filter(members, lambda m: text(m["gml:Polygon"]["gml:exterior"]).isNotNull())
    return F.transform(
        given,
        lambda m: F.struct(
            positions(text(m["gml:Polygon"]["gml:exterior"])).alias("ring"),
            F.transform(F.coalesce(m["gml:Polygon"]["gml:interior"], F.array().cast(f"array<{_RING}>")), lambda h: positions(text(h))).alias("holes"),
        ),
    )


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    """(build_id, file, ring, parts, status): the roof edge, else the footprint; without either the status is ERROR.

    ring is the first polygon's outline; parts holds all polygons with their holes.
    """
    rows = spark.read.format("xml").option("rowTag", "bldg:Building").schema(_SCHEMA).load(path)
    roof, foot = _parts("bldg:lod0RoofEdge"), _parts("bldg:lod0FootPrint")
    rows = rows.select(F.col("`_gml:id`").alias("build_id"), F.input_file_name().alias("file"), F.when(F.size(roof) > 0, roof).when(F.size(foot) > 0, foot).alias("parts"))
    status = F.when(F.col("parts").isNull(), "ERROR").otherwise("SUCCESS")
    return rows.select("build_id", "file", F.get("parts", F.lit(0))["ring"].alias("ring"), "parts", status.alias("status"))


def order_of(element: Column) -> Column:
    """Roofs come first, then walls, then grounds."""
    return F.when(element == "ROOF", 0).when(element == "WALL", 1).otherwise(2)


def numbered(faces: DataFrame) -> DataFrame:
    """faces with gml_id <build_id>_<n>: roofs, walls, then grounds."""
    n = F.row_number().over(Window.partitionBy("build_id").orderBy(order_of(F.col("element")), "face_no")) - 1
    return faces.withColumn("gml_id", F.concat_ws("_", "build_id", n.cast("string")))


def with_meshes(buildings: DataFrame, meshes: DataFrame) -> DataFrame:
    """buildings with the columns of meshes of their build_id; status WARN where a sound building has none."""
    rows = buildings.join(meshes.withColumn("found", F.lit(True)), "build_id", "left")
    status = F.when((F.col("status") == "SUCCESS") & F.col("found").isNull(), "WARN").otherwise(F.col("status"))
    return rows.withColumn("status", status).drop("found")


def ring_text(ring: Column) -> Column:
    """A closed posList: the first position is repeated at the end."""
    closed = F.concat(ring, F.slice(ring, 1, 1))
    return F.array_join(F.transform(closed, lambda p: F.concat_ws(" ", p["lat"].cast("string"), p["lon"].cast("string"), p["h"].cast("string"))), " ")


def surface_name(element: Column) -> Column:
    return F.when(element == "ROOF", "RoofSurface").when(element == "WALL", "WallSurface").otherwise("GroundSurface")


def bounded_by(element: Column, gml_id: Column, ring: Column) -> Column:
    kind = surface_name(element)
    short = F.when(element == "ROOF", "roof_").when(element == "WALL", "wall_").otherwise("ground_")
    return F.concat(
        F.lit("<bldg:boundedBy><bldg:"), kind, F.lit(' gml:id="'), short, gml_id,
        F.lit('"><bldg:lod2MultiSurface><gml:MultiSurface><gml:surfaceMember><gml:Polygon gml:id="texture_'), gml_id,
        F.lit('"><gml:exterior><gml:LinearRing gml:id="shape_'), gml_id, F.lit('"><gml:posList>'), ring_text(ring),
        F.lit("</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod2MultiSurface></bldg:"),
        kind, F.lit("></bldg:boundedBy>"),
    )


def solids(faces: DataFrame) -> DataFrame:
    """(build_id, xml): lod2Solid and all boundedBy elements of each building, from numbered faces with rings of (lat, lon, h)."""
    number = F.substring_index("gml_id", "_", -1).cast("long")
    rows = faces.select("build_id", number.alias("n"), "gml_id", bounded_by(F.col("element"), F.col("gml_id"), F.col("ring")).alias("xml"))
    own = rows.groupBy("build_id").agg(F.array_sort(F.collect_list(F.struct("n", "gml_id", "xml"))).alias("f"))
    member = F.transform("f", lambda s: F.concat(F.lit('<gml:surfaceMember xlink:href="#texture_'), s["gml_id"], F.lit('"/>')))
    solid = F.concat(
        F.lit("<bldg:lod2Solid><gml:Solid><gml:exterior><gml:CompositeSurface>"), F.array_join(member, ""),
        F.lit("</gml:CompositeSurface></gml:exterior></gml:Solid></bldg:lod2Solid>"),
    )
    return own.select("build_id", F.concat(solid, F.array_join(F.transform("f", lambda s: s["xml"]), "")).alias("xml"))


def textures(faces: DataFrame) -> DataFrame:
    """(build_id, xml): the surfaceDataMember of each building that has an image.

    faces: build_id, gml_id, image, uv (array of (u, v), empty for faces without texture).
    """
    closed = F.concat("uv", F.slice("uv", 1, 1))
    text = F.array_join(F.transform(closed, lambda p: F.concat_ws(" ", p["u"].cast("string"), p["v"].cast("string"))), " ")
    target = F.concat(
        F.lit('<app:target uri="#texture_'), F.col("gml_id"), F.lit('"><app:TexCoordList><app:textureCoordinates ring="#shape_'), F.col("gml_id"),
        F.lit('">'), text, F.lit("</app:textureCoordinates></app:TexCoordList></app:target>"),
    )
    rows = faces.where("image IS NOT NULL AND size(uv) > 0")
    rows = rows.select("build_id", "image", F.substring_index("gml_id", "_", -1).cast("long").alias("n"), target.alias("target"))
    own = rows.groupBy("build_id").agg(F.min("image").alias("image"), F.array_sort(F.collect_list(F.struct("n", "target"))).alias("t"))
    escaped = F.replace(F.replace(F.col("image"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    head = F.concat(F.lit("<app:surfaceDataMember><app:ParameterizedTexture><app:imageURI>"), escaped, F.lit("</app:imageURI><app:mimeType>image/jpg</app:mimeType>"))
    tail = F.lit("</app:ParameterizedTexture></app:surfaceDataMember>")
    return own.select("build_id", F.concat(head, F.array_join(F.transform("t", lambda s: s["target"]), ""), tail).alias("texture"))


def without_default(prefixes: Column) -> Column:
    """A map of XML prefixes to names without the default one (an empty or null prefix)."""
    return F.map_filter(prefixes, lambda k, _: k != "")


def _tree(text: str) -> tuple[ET.Element, dict[str, str]]:
    """A document's root and its prefixes; the prefixes are known to the writer from then on."""
    spaces = {k: v for _, (k, v) in ET.iterparse(io.BytesIO(text.encode()), events=["start-ns"])}
    for k, v in spaces.items():
        ET.register_namespace(k, v)
    return ET.fromstring(text.encode()), spaces


def _elements(xml: str, spaces: dict[str, str]) -> list[ET.Element]:
    known = " ".join(f'xmlns:{k}="{v}"' for k, v in spaces.items() if k)
    return list(ET.fromstring(f"<root {known}>{xml}</root>"))


def rewritten(text: str, models: dict[str, str], images: list[str], replace: bool = False) -> str:
    """A CityGML file with the models (elements by building id) behind each building's lod1Solid, or at its end, and an
    appearance of the images (elements). replace: other appearances go."""
    root, spaces = _tree(text)
    bldg, app, gml = (spaces.get(k, k) for k in ("bldg", "app", "gml"))
    for building in root.iter(f"{{{bldg}}}Building"):
        if xml := models.get(building.get(f"{{{gml}}}id")):
            tags = [child.tag for child in building]
            at = tags.index(f"{{{bldg}}}lod1Solid") + 1 if f"{{{bldg}}}lod1Solid" in tags else len(tags)
            for k, element in enumerate(_elements(xml, spaces)):
                building.insert(at + k, element)
    if replace:
        for old in root.findall(f"{{{app}}}appearanceMember"):
            root.remove(old)
    if images:
        look = ET.SubElement(ET.SubElement(root, f"{{{app}}}appearanceMember"), f"{{{app}}}Appearance")
        ET.SubElement(look, f"{{{app}}}theme").text = "rgbTexture"
        for xml in images:
            look.extend(_elements(xml, spaces))
    ET.indent(root, "\t")
    return '<?xml version="1.0" encoding="utf-8"?>\n' + ET.tostring(root, encoding="unicode")


def rewritten_files(files: DataFrame, models: DataFrame, replace: bool = False) -> DataFrame:
    """(file, text, status, message) of files (file, text) with the models and textures of their buildings.

    models: file, build_id, xml, texture (either may be null). A file that cannot be parsed comes back as it was, with
    status ERROR; one without any model is a WARN.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        found = sorted(right.to_pylist(), key=lambda r: r["build_id"] or "")
        for f in left.to_pylist():
            try:
                text = rewritten(f["text"], {r["build_id"]: r["xml"] for r in found if r["xml"]}, [r["texture"] for r in found if r["texture"]], replace)
                rows.append({"file": f["file"], "text": text, "status": "SUCCESS" if found else "WARN", "message": None if found else "no model"})
            except (ET.ParseError, TypeError, AttributeError) as e:
                rows.append({"file": f["file"], "text": f["text"], "status": "ERROR", "message": str(e)})
        return pa.Table.from_pylist(rows, pa.schema([(k, pa.string()) for k in ("file", "text", "status", "message")]))

    # columns of their own, as both sides may come from one table
    left = files.select(*(F.col(c).alias(c) for c in ("file", "text")))
    right = models.select(*(F.col(c).alias(c) for c in ("file", "build_id", "xml", "texture")))
    pairs = left.groupBy("file").cogroup(right.groupBy("file"))
    return pairs.applyInArrow(run, "file string, text string, status string, message string")


_TARGET = "struct<`_uri`: string, `app:TexCoordList`: struct<`app:textureCoordinates`: struct<`_ring`: string, `_VALUE`: string>>>"


def read_textures(spark: SparkSession, path: str) -> DataFrame:
    """(file, image, uri, ring, uv): the targets of all parameterised textures."""
    schema = f"`app:imageURI` string, `app:mimeType` string, `app:target` array<{_TARGET}>"
    rows = spark.read.format("xml").option("rowTag", "app:ParameterizedTexture").schema(schema).load(path)
    rows = rows.select(F.input_file_name().alias("file"), F.col("`app:imageURI`").alias("image"), F.explode("`app:target`").alias("t"))
    coordinates = F.col("t")["app:TexCoordList"]["app:textureCoordinates"]
    v = F.transform(F.filter(F.split(F.trim(coordinates["_VALUE"]), r"\s+"), lambda s: s != ""), lambda s: s.cast("double"))
    uv = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(v) / 2).cast("int") - 1), lambda i: F.struct(F.get(v, i * 2).alias("u"), F.get(v, i * 2 + 1).alias("v"))
    )
    return rows.select("file", "image", F.col("t")["_uri"].alias("uri"), coordinates["_ring"].alias("ring"), uv.alias("uv"))


def mesh_of_target(targets: DataFrame, buildings: DataFrame) -> DataFrame:
    """targets (uri, ...) with code: the mesh code of the first building (seq) whose ids hold the uri; null if none does.

    buildings: seq, code, ids (array of uris). An equi-join on the exploded ids, not a search through lists.
    """
    ids = buildings.select("seq", "code", F.explode("ids").alias("uri"))
    first = ids.groupBy("uri").agg(F.min_by("code", "seq").alias("code"))
    return targets.join(first, "uri", "left")
