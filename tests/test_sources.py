"""Readers and writers on files made for the purpose, broken ones among them."""

import json
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from kawara.sources import citygml, las, obj, tables

GOOD = "v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nvt 0 0\nvt 1 1\n# Roof\nusemtl wall one\nf 1/1 2/2 3/1 4/2\n# Wall\nf -3 -2 -1\n# Ground\nf 1//1 3 4\n"


def write(folder, **files):
    for name, text in files.items():
        path = folder / name.replace("__", ".")
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def test_obj(spark, tmp_path):
    bad = {"b__obj": "# Roof\nf 1 2 3\n", "c__obj": "v 0 0\n", "d__obj": "v 1 2 3\n# Roof\n", "e__obj": "v 0 0 x\n", "g__obj": "# Roof\n# Wall\n# Ground\nf 1/2/3/4\n", "h__obj": ""}
    path = write(tmp_path, a__obj=GOOD, **bad)
    rows = obj.read_obj(spark, path).collect()
    errors = {r.path[-5:]: r.error for r in rows if r.error}
    assert set(errors) == {"b.obj", "c.obj", "d.obj", "e.obj", "g.obj"} and "missing sections" in errors["d.obj"] and "line 2" in errors["b.obj"]
    good = sorted((r for r in rows if not r.error), key=lambda r: r.face_id)
    assert [(r.element, len(r.ring), len(r.uv), r.material) for r in good] == [("ROOF", 4, 4, "wall one"), ("WALL", 3, 0, "wall one"), ("GROUND", 3, 0, "wall one")]
    assert [(p.x, p.y) for p in good[1].ring] == [(1, 0), (1, 1), (0, 1)]
    assert [r.face_id for r in obj.textured_walls(obj.read_obj(spark, path)).collect()] == [0]


def test_obj_round_trip(spark, tmp_path):
    faces = obj.read_obj(spark, write(tmp_path, a__obj=GOOD)).withColumn("mesh_id", F.lit(1))
    text = obj.obj_text(faces, "a.mtl").first().text
    (tmp_path / "out").mkdir()
    again = obj.read_obj(spark, write(tmp_path / "out", b__obj=text)).orderBy("face_id").collect()
    assert [(r.element, r.ring) for r in again] == [(r.element, r.ring) for r in faces.orderBy("face_id").collect()]
    assert text.startswith("mtllib a.mtl\nv 0.000 0.000 0.000\n")


def test_mtl(spark):
    lines = ["newmtl a", "Kd 1 1 1", "map_Kd old.jpg", " map_Kd a b.jpg", "newmtl c", "Ka 0 0 0"]
    rows = spark.createDataFrame([("p", i, x) for i, x in enumerate(lines)], "path string, n int, value string")
    assert {(r.material, r.map) for r in obj.parse_mtl(rows).collect()} == {("a", "a b.jpg"), ("c", None)}


def test_las(spark, tmp_path):
    rng = np.random.default_rng(1)
    xyz, rgb = np.round(rng.uniform(0, 50, (100, 3)), 3), rng.integers(300, 60000, (100, 3))
    data = las.las_bytes(xyz, rgb)
    path = write(tmp_path, a__las=data, b__las=b"nonsense", c__las=data[:300], d__las=las.las_bytes(xyz[:0], rgb[:0]))
    rows = las.read_las(spark, path).collect()
    assert np.allclose(sorted((r.x, r.y, r.z) for r in rows), sorted(map(tuple, xyz.tolist())), atol=1e-6)
    assert {(r.red, r.green, r.blue) for r in rows} == set(map(tuple, rgb.tolist()))
    assert {(r.path[-5:], r.points, r.status) for r in las.tile_status(spark, path).collect()} == {
        ("a.las", 100, "SUCCESS"), ("b.las", 0, "WARN"), ("c.las", 0, "WARN"), ("d.las", 0, "SUCCESS"),
    }
    heads = {r.path[-5:]: r for r in las.tiles(spark, path).collect()}
    assert heads["b.las"].status == "WARN" and heads["a.las"].min_x == pytest.approx(xyz[:, 0].min())
    swapped = las.read_las(spark, path + "/a.las", swap_xy=True).agg(F.min("x")).first()[0]
    assert swapped == pytest.approx(xyz[:, 1].min())
    points = spark.createDataFrame([("t", *map(float, p), *map(int, c)) for p, c in zip(xyz, rgb, strict=True)], las.SCHEMA)
    made = las.las_files(points).first()
    assert las.points(bytes(made.content)).num_rows == 100


GML = """<?xml version="1.0" encoding="utf-8"?>
<core:CityModel xmlns:core="http://c" xmlns:bldg="http://b" xmlns:gml="http://g" xmlns:app="http://a" xmlns:xlink="http://x">
<core:cityObjectMember><bldg:Building gml:id="one"><bldg:lod0RoofEdge><gml:MultiSurface>
<gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>35 139 1 35 140 1 36 140 1</gml:posList></gml:LinearRing></gml:exterior>
<gml:interior><gml:LinearRing><gml:posList>35.1 139.1 1 35.1 139.2 1 35.2 139.2 1</gml:posList></gml:LinearRing></gml:interior></gml:Polygon></gml:surfaceMember>
<gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>1 2 3 4 5 6 7 8 9</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember>
</gml:MultiSurface></bldg:lod0RoofEdge><bldg:lod1Solid/><bldg:last/></bldg:Building></core:cityObjectMember>
<core:cityObjectMember><bldg:Building gml:id="two"><bldg:lod0FootPrint><gml:MultiSurface><gml:surfaceMember><gml:Polygon><gml:exterior><gml:LinearRing>
<gml:posList>0 0 0 0 1 0 1 1 0</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon></gml:surfaceMember></gml:MultiSurface></bldg:lod0FootPrint></bldg:Building></core:cityObjectMember>
<core:cityObjectMember><bldg:Building gml:id="three"/></core:cityObjectMember></core:CityModel>"""


def test_citygml_in(spark, tmp_path):
    rows = {r.build_id: r for r in citygml.read_buildings(spark, write(tmp_path, a__gml=GML)).collect()}
    assert {k: r.status for k, r in rows.items()} == {"one": "SUCCESS", "two": "SUCCESS", "three": "ERROR"}
    one = rows["one"]
    assert len(one.ring) == 3 and [len(p.ring) for p in one.parts] == [3, 3] and [len(p.holes) for p in one.parts] == [1, 0]
    assert tuple(one.parts[1].ring[2]) == (7, 8, 9) and tuple(one.parts[0].holes[0][0]) == (35.1, 139.1, 1)


def test_citygml_back(spark, tmp_path):
    path = write(tmp_path, a__gml=GML)
    ring = [{"lat": 1.0, "lon": 2.0, "h": 3.0}, {"lat": 4.0, "lon": 5.0, "h": 6.0}, {"lat": 7.0, "lon": 8.0, "h": 9.0}]
    made = [("one", e, n, ring, [{"u": 0.0, "v": 1.0}, {"u": 0.5, "v": 0.25}], "x&y.jpg") for n, e in enumerate(["GROUND", "WALL", "ROOF"])]
    schema = "build_id string, element string, face_no int, ring array<struct<lat:double,lon:double,h:double>>, uv array<struct<u:double,v:double>>, image string"
    faces = citygml.numbered(spark.createDataFrame(made, schema))
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))
    models = citygml.solids(faces).join(citygml.textures(faces), "build_id", "left").crossJoin(files.select("file"))
    broken = files.select(F.lit("broken").alias("file"), F.lit("<a>").alias("text"))
    out = {r.file: r for r in citygml.rewritten_files(files.unionByName(broken), models).collect()}
    assert out["broken"].status == "ERROR" and out["broken"].text == "<a>"
    text = next(r.text for k, r in out.items() if k != "broken")
    (tmp_path / "out").mkdir()
    again = write(tmp_path / "out", b__gml=text)
    assert citygml.read_buildings(spark, again).count() == 3
    order = [text.index(x) for x in ("lod1Solid", "lod2Solid", "RoofSurface", "WallSurface", "GroundSurface", "bldg:last")]
    assert order == sorted(order) and text.count("surfaceMember xlink:href") == 3
    found = citygml.read_textures(spark, again).collect()
    assert {r.uri for r in found} == {f"#texture_one_{k}" for k in range(3)} and {r.image for r in found} == {"x&y.jpg"}
    assert [tuple(p) for p in found[0].uv] == [(0, 1), (0.5, 0.25), (0, 1)]
    replaced = citygml.rewritten(text, {}, [], replace=True)
    assert "appearanceMember" not in replaced
    missing = citygml.with_meshes(citygml.read_buildings(spark, path), spark.createDataFrame([("one", 1)], "build_id string, mesh int"))
    assert {r.build_id: r.status for r in missing.collect()} == {"one": "SUCCESS", "two": "WARN", "three": "ERROR"}
    codes = citygml.mesh_of_target(spark.createDataFrame([("#a",), ("#z",)], "uri string"), spark.createDataFrame([(1, 4, ["#b", "#a"]), (0, 2, ["#a"])], "seq int, code int, ids array<string>"))
    assert {r.uri: r.code for r in codes.collect()} == {"#a": 2, "#z": None}


def test_tables(spark, tmp_path):
    (tmp_path / "w").mkdir()
    path = write(tmp_path, o__tsv="file\tx\ty\tz\to\tp\tk\na.tif\t1\t2\t3\t4\t5\t6\nb.tif\t1\t\t3\t4\t5\t6\n", c__tsv="f\tw\th\tpw\tph\tx\ty\n50\t36\t24\t0.01\t0.02\t1\t2\n")
    assert [tuple(r) for r in tables.read_orientation(spark, path + "/o.tsv").collect()] == [("a.tif", 1, 2, 3, 4, 5, 6)]
    assert tables.read_camera(spark, path + "/c.tsv").first().pixel_h == 0.02
    worlds = tables.read_world_files(spark, write(tmp_path / "w", a__tfw="0.5\n0\n0\n-0.5\n100\n200\n", b__tfw="what\n"))
    rows = {r.path[-5:]: r for r in worlds.collect()}
    assert (rows["a.tfw"].a, rows["a.tfw"].e, rows["a.tfw"].c, rows["a.tfw"].f) == (0.5, -0.5, 100, 200) and rows["b.tfw"].a is None
    images = spark.createDataFrame([(k, 0.5, -0.5, 100.0 + 40 * k, 200.0, 100, 80) for k in range(4)], "image_no int, a double, e double, c double, f double, width int, height int")
    points = spark.createDataFrame([(1, 100.0, 200.0), (2, 145.0, 170.0), (3, 149.9, 160.1), (4, 0.0, 0.0), (5, 230.0, 199.0)], "id int, x double, y double")
    assert {r.id: r.image_no for r in tables.image_at(points, images).collect()} == {1: 0, 2: 0, 3: 0, 5: 3}
    assert tables.image_at(points, images.limit(0)).count() == 0


@dataclass(frozen=True)
class Wanted:
    name: "str"
    size: "float"
    on: "bool"


def test_parameters():
    good = {"name": "x", "size": 1, "on": True}
    assert tables.read_parameters(json.dumps(good), Wanted) == Wanted("x", 1, True)
    for bad in ({"name": "x"}, good | {"more": 1}, good | {"size": "1"}, good | {"on": 1}, good | {"size": True}):
        with pytest.raises(tables.ParameterError):
            tables.read_parameters(json.dumps(bad), Wanted)
    with pytest.raises(tables.ParameterError):
        tables.read_parameters("{", Wanted)


def test_tool_parameters():
    good = {"input_folder": "入力", "output_folder": "o", "width": 10, "height": 5, "background": "#fff", "margin": 0}
    assert tables.read_atlas(json.dumps(good, ensure_ascii=False).encode("shift_jis")).input_folder == "入力"
    for bad in (good | {"width": 0}, good | {"margin": -1}, {"width": 1}):
        with pytest.raises(tables.ParameterError):
            tables.read_atlas(json.dumps(bad).encode("shift_jis"))
    with pytest.raises(tables.ParameterError):
        tables.read_atlas(b"\xff\xff")
    enlarging = {"input_folder": "i", "output_folder": "o", "gsd": 0.2, "device": "cpu"}
    assert tables.read_enlarging(json.dumps(enlarging)).gsd == 0.2
    for gsd in (0.05, 0.3):
        with pytest.raises(tables.ParameterError):
            tables.read_enlarging(json.dumps(enlarging | {"gsd": gsd}))


def test_textured_files(spark, tmp_path):
    faces = obj.read_obj(spark, write(tmp_path, a__obj=GOOD)).withColumn("mesh_id", F.lit(1))
    text = obj.textured_obj(faces, "a.mtl").first().text
    (tmp_path / "out").mkdir()
    again = obj.read_obj(spark, write(tmp_path / "out", b__obj=text)).orderBy("face_id").collect()
    assert [(r.element, r.material, r.ring, r.uv) for r in again] == [(r.element, r.material, r.ring, r.uv) for r in faces.orderBy("face_id").collect()]
    materials = spark.createDataFrame([(1, "b", None), (1, "a", "x.jpg"), (1, "a", "x.jpg")], "mesh_id int, material string, map string")
    assert obj.mtl_text(materials).first().text == "newmtl a\nmap_Kd x.jpg\nnewmtl b"
