"""Readers, sinks, the register client and streams on small files."""

import warnings

import pytest
from pyspark.sql import functions as F

from stratalake.collection import Collection
from stratalake.functions.geotech import CLASSES, COARSEST, grainsize_fractions, grainsize_percentiles
from stratalake.operators import validation
from stratalake.operators.voxel import VoxelModel
from stratalake import roles
from stratalake.sources import api, mesh, readers, sinks
from stratalake.streaming import surveys

NS = 'xmlns="http://www.broservices.nl/xsd/dsbhr/2.0" xmlns:brocom="http://www.broservices.nl/xsd/brocommon/3.0" xmlns:c="http://www.broservices.nl/xsd/common/2.0" xmlns:gml="http://www.opengis.net/gml/3.2"'


def dispatch(*payloads):
    return f"<dispatchDataResponse {NS}><dispatchDocument>{''.join(payloads)}</dispatchDocument></dispatchDataResponse>".encode()


def survey(nr, place, offset, boring, body, crs=4258):
    return f"""<BHR_O><brocom:broId>{nr}</brocom:broId>
<standardizedLocation><brocom:location srsName="urn:ogc:def:crs:EPSG::{crs}"><gml:pos>{place}</gml:pos></brocom:location></standardizedLocation>
<deliveredVerticalPosition><c:offset>{offset}</c:offset><c:verticalDatum>NAP</c:verticalDatum></deliveredVerticalPosition>{boring}{body}</BHR_O>"""


def layer(a, b, name, tag="soilNameNEN5104", row="layer"):
    return f"<c:{row}><c:upperBoundary>{a}</c:upperBoundary><c:lowerBoundary>{b}</c:lowerBoundary><c:soil><c:{tag}>{name}</c:{tag}></c:soil></c:{row}>"


BHRG = dispatch(
    survey(
        "BHR000000396406",
        "52.057009967 4.966538731",
        0.69,
        "<boring><c:Boring><c:finalDepthBoring>3.000</c:finalDepthBoring></c:Boring></boring>",
        "<boreholeSampleDescription><c:BoreholeSampleDescription><c:descriptiveBoreholeLog>"
        + "".join(layer(*x) for x in (("0.000", "0.250", "zwakZandigeKlei"), ("0.250", "1.600", "sterkSiltigeKlei"), ("1.600", "2.000", "zwakZandigeKlei"), ("2.000", "2.500", "sterkZandigeKlei"), ("2.500", "3.000", "zwakSiltigZand")))
        + "</c:descriptiveBoreholeLog></c:BoreholeSampleDescription></boreholeSampleDescription>",
    )
)
COMPANY = """<ns1:registrationRequest xmlns:ns1="http://a/1" xmlns:ns2="http://a/2" xmlns:ns3="http://a/3"><ns1:sourceDocument><ns1:BHR_GT>
<ns1:objectIdAccountableParty>_87078_HB001</ns1:objectIdAccountableParty>
<ns1:deliveredLocation><ns3:location><ns2:Point srsName="urn:ogc:def:crs:EPSG::28992"><ns2:pos>182243.9 335073.8</ns2:pos></ns2:Point></ns3:location></ns1:deliveredLocation>
<ns1:deliveredVerticalPosition><ns3:offset>37.74</ns3:offset><ns3:verticalDatum>NAP</ns3:verticalDatum></ns1:deliveredVerticalPosition>
<ns1:boring><ns3:groundwaterLevel>1.1</ns3:groundwaterLevel><ns3:finalDepthBoring>2.2</ns3:finalDepthBoring></ns1:boring>
<ns1:boreholeSampleDescription><ns3:descriptiveBoreholeLog>""" + "".join(
    f"<ns3:layer><ns3:upperBoundary>{a}</ns3:upperBoundary><ns3:lowerBoundary>{b}</ns3:lowerBoundary><ns3:soil><ns3:geotechnicalSoilName>{n}</ns3:geotechnicalSoilName></ns3:soil></ns3:layer>"
    for a, b, n in (("0.00", "0.10", "zwakZandigSilt"), ("0.10", "0.40", "zwakZandigGrind"), ("0.40", "0.70", "klei"), ("0.70", "1.70", "zand"), ("1.70", "2.20", "zand"))
) + "</ns3:descriptiveBoreholeLog></ns1:boreholeSampleDescription></ns1:BHR_GT></ns1:sourceDocument></ns1:registrationRequest>"


def put(path, content):
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_register_file(spark, tmp_path):
    c = readers.read_xml(spark, put(tmp_path / "a.xml", BHRG), "bhrg")
    head = c.header.first()
    assert (head.nr, head.x, head.y, head.surface, round(head.end, 2), c.crs) == ("BHR000000396406", 4.966538731, 52.057009967, 0.69, -2.31, 4258)
    rows = c.data.orderBy("top").collect()
    assert [(r.top, r.bottom) for r in rows] == [(0, 0.25), (0.25, 1.6), (1.6, 2), (2, 2.5), (2.5, 3)]
    assert [r.soilNameNEN5104 for r in rows][1] == "sterkSiltigeKlei"
    moved = readers.read_xml(spark, str(tmp_path / "a.xml"), "bhrg", crs=28992)
    assert moved.crs == 28992 and 100_000 < moved.header.first().x < 150_000


def test_company_file(spark, tmp_path):
    path = put(tmp_path / "w.xml", COMPANY)
    c = readers.read_xml(spark, path, "bhrgt", company="Wiertsema")
    head = c.header.first()
    assert (head.nr, head.x, head.y, head.surface, round(head.end, 2), head.groundwater_level, c.crs) == ("_87078_HB001", 182243.9, 335073.8, 37.74, 35.54, "1.1", 28992)
    assert [(r.top, r.bottom, r.geotechnicalSoilName) for r in c.data.orderBy("top").collect()][-1] == (1.7, 2.2, "zand")
    for kind, company in (("bhrgt", "UnknownCompany"), ("bhrg", "Wiertsema"), ("none", None)):
        with pytest.raises(ValueError):
            readers.read_xml(spark, path, kind, company=company)


def test_a_missing_payload_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="has no dispatchDocument"):
        readers.read_xml(spark, put(tmp_path / "w.xml", COMPANY), "bhrgt").data.collect()


def test_samples_have_all_fractions(spark, tmp_path):
    parts = {n: float(i + 1) for i, (n, _) in enumerate(CLASSES)} | {COARSEST: 2.0, "fractionLarger63um": 70.0}
    body = "".join(f"<c:{k}>{v}</c:{k}>" for k, v in parts.items() if k != "fraction2to4mm")
    intervals = f"<boreholeSampleAnalysis><c:investigatedInterval><c:beginDepth>1.0</c:beginDepth><c:endDepth>1.5</c:endDepth>{body}</c:investigatedInterval></boreholeSampleAnalysis>"
    path = put(tmp_path / "s.xml", dispatch(survey("BHR1", "52.0 5.0", 1.0, "<boring><c:finalDepthBoring>4</c:finalDepthBoring></boring>", intervals)))
    data = readers.read_xml(spark, path, "bhrgt_samples").data
    assert {n for n, _ in CLASSES} | {COARSEST, "fractionLarger63um", "top", "bottom"} <= set(data.columns)
    (r,) = data.collect()
    assert r.fraction2to4mm is None and all(r[k] == v for k, v in parts.items() if k != "fraction2to4mm")
    shares = grainsize_fractions(data).first()
    assert (shares.perc_fines, shares.perc_sand) == (1.0, float(sum(range(2, 12)))) and shares.perc_gravel == 13 + 14 + 15 + 16 + 2
    assert grainsize_percentiles(data, [50]).first().d50 > 63


def test_lithology_description_file(spark, tmp_path):
    body = '<xml><pointSurvey id="P1"><identification>P1</identification><x>1000.5</x><y>2000.5</y><surfaceLevel>2.5</surfaceLevel><lithoInterval baseDepth="0.5"><lithology code="K"/></lithoInterval><lithoInterval baseDepth="2.0"><lithology code="Z"/></lithoInterval></pointSurvey></xml>'
    rows = readers.read_boris_xml(spark, put(tmp_path / "b.xml", body)).orderBy("top").collect()
    assert [(r.nr, r.x, r.y, r.surface, r.end, r.top, r.bottom, r.lithology) for r in rows] == [("P1", 1000.5, 2000.5, 2.5, 0.5, 0.0, 0.5, "K"), ("P1", 1000.5, 2000.5, 2.5, 0.5, 0.5, 2.0, "Z")]


def test_gef_folder(spark, tmp_path):
    head = "#GEFID= 1,1,0\n#COLUMN= 3\n#COLUMNINFO= 1, m, sondeerlengte, 1\n#COLUMNINFO= 2, MPa, conusweerstand, 2\n#COLUMNINFO= 3, MPa, {what}, {code}\n#COLUMNVOID= 2, -9999\n#TESTID= {nr}\n#XYID= 31000, 1000.0, 2000.0\n#ZID= 31000, 1.5\n#EOH=\n"
    put(tmp_path / "a.gef", head.format(nr="A", what="wrijving", code=3) + "0.5 1.0 0.01\n1.0 -9999 0.02\n")
    put(tmp_path / "b.GEF", head.format(nr="B", what="waterdruk", code=6) + "0.5 2.0 0.1\n")
    c = readers.read_gef_cpts(spark, str(tmp_path))
    rows = c.data.orderBy("nr", "depth").collect()
    assert [(r.nr, r.depth, r.qc, r.fs, r.u2) for r in rows] == [("A", 0.5, 1.0, 0.01, None), ("A", 1.0, None, 0.02, None), ("B", 0.5, 2.0, None, 0.1)]
    assert rows[0].rf == pytest.approx(1.0) and c.header.orderBy("nr").first().end == 0.5


def test_geopackage_both_ways(spark, tmp_path):
    head = spark.createDataFrame([("A", 1.5, 2.5, 0.1), ("B", 3.0, 4.0, None)], "nr string, x double, y double, surface double")
    data = spark.createDataFrame([("A", 0.0, 1.0, "K"), ("A", 1.0, 2.0, "Z"), ("B", 0.0, 3.0, None)], "nr string, top double, bottom double, lith string")
    path = str(tmp_path / "a.gpkg")
    sinks.to_geopackage({"header": head, "data": data}, path, 28992)
    c = readers.read_collection_geopackage(spark, path)
    assert c.crs == 28992 and sorted(map(tuple, c.header.collect()), key=str) == sorted(map(tuple, head.collect()), key=str)
    assert sorted(map(tuple, c.data.collect()), key=str) == sorted(map(tuple, data.collect()), key=str)
    with readers.Geopackage(spark, path) as g:
        assert g.layers() == ["data", "header"] and "lith" in g.get_column_names("data") and g.table_head("data", 2).count() == 2
        blob = g.query("select geom from header where nr = 'A'").first().geom
    assert readers.geometry_of(bytes(blob)).coords == (1.5, 2.5)


def test_geopackage_tables_are_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "GPKG_ROWS", 7)
    rows = [(i, i / 4, f"n{i}" if i % 3 else None, i % 2 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, v double, s string, b boolean")
    path = str(tmp_path / "r.gpkg")
    sinks.to_geopackage({"t": df, "none": df.limit(0)}, path)
    with readers.Geopackage(spark, path) as g:
        got, none = g.read_table("t"), g.read_table("none")
    assert got.rdd.getNumPartitions() > 10 and none.count() == 0 and none.columns == ["fid", "k", "v", "s", "b"]
    assert sorted(map(tuple, got.select("k", "v", "s", "b").collect())) == [(k, v, s, int(b)) for k, v, s, b in rows]
    assert [readers.gpkg_kind(t) for t in ("MEDIUMINT", "POINT", "TEXT(20)", "DOUBLE", "BLOB", "MULTIPOLYGON", "BOOLEAN")] == ["long", "binary", "string", "double", "binary", "binary", "long"]


def test_cpt_geopackage(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "cpt.gpkg")
    with sqlite3.connect(path) as db:
        db.executescript("""
            create table gpkg_contents (table_name text, data_type text, srs_id integer);
            insert into gpkg_contents values ('geotechnical_cpt_survey', 'features', 28992);
            create table geotechnical_cpt_survey (fid integer primary key, bro_id text, geom blob);
            create table delivered_location (delivered_location_pk integer, geotechnical_cpt_survey_fk integer, horizontal_positioning_date text, horizontal_positioning_method text);
            create table bro_location (bro_location_pk integer, delivered_location_fk integer, crs text);
            create table bro_point (bro_point_pk integer, bro_location_fk integer, x_or_lon real, y_or_lat real);
            insert into geotechnical_cpt_survey values (1, 'CPT1', null), (2, 'CPT2', null);
            insert into delivered_location values (10, 1, '2020-01-01', 'GPS'), (20, 2, '2021-01-01', 'RTK');
            insert into bro_location values (100, 10, '28992'), (200, 20, '28992');
            insert into bro_point values (5, 100, 1.5, 2.5), (6, 200, 3.5, 4.5);
        """)
    g = readers.CptGeopackage(spark, path)
    assert g.surveys.columns == ["fid", "bro_id"] and g["bro_point"].count() == 2
    assert sorted(map(tuple, g.select_location_info().collect())) == [(1, "2020-01-01", "GPS", "28992", 1.5, 2.5), (2, "2021-01-01", "RTK", "28992", 3.5, 4.5)]
    with pytest.raises(KeyError):
        g["other"]


def test_geoparquet_both_ways(spark, tmp_path):
    import pyarrow.parquet as pq

    head = spark.createDataFrame([(f"n{i}", i / 3, -i * 1000.25) for i in range(50)] + [("none", None, 1.0)], "nr string, x double, y double")
    path = tmp_path / "geo"
    sinks.to_geoparquet(head.repartition(3), str(path), 28992)
    files = sorted(path.glob("*.parquet"))
    assert len(files) == 3 and all(b'"primary_column": "geometry"' in pq.read_schema(f).metadata[b"geo"] for f in files)
    back = readers.read_geoparquet(spark, str(path))
    assert sorted(map(tuple, back.select("nr", "x", "y").collect())) == sorted(map(tuple, head.collect()))
    points = readers.read_geoparquet(spark, str(path)).drop("x", "y")
    points.write.parquet(str(tmp_path / "bare"))
    bare = {r.nr: (r.x, r.y) for r in readers.read_geoparquet(spark, str(tmp_path / "bare")).collect()}
    assert all(bare[f"n{i}"] == (i / 3, -i * 1000.25) for i in range(50)) and bare["none"] == (None, None)


def test_register_client(spark):
    seen = []

    def transport(method, url, body):
        seen.append((method, url))
        if method == "POST":
            return b"<r><numberOfDocuments>1</numberOfDocuments><brocom:broId>BHR000000396406</brocom:broId></r>"
        return BHRG

    client = api.RegisterClient("https://register.example", transport)
    c = client.read(spark, "BHR-G", ids="BHR000000396406")
    assert c.crs == 28992 and c.data.count() == 5
    place = c.header.first()
    near = client.read(spark, "BHR-G", geometry=(place.x, place.y), buffer=100)
    boxed = client.read(spark, "BHR-G", bbox=(place.x - 10, place.y - 10, place.x + 10, place.y + 10))
    assert near.data.count() == boxed.data.count() == 5 and seen[0][0] == "POST"
    lon0, lat0, lon1, lat1 = api.degrees_box(spark, (place.x - 100, place.y - 100, place.x + 100, place.y + 100), 28992)
    assert lon0 < 4.966538731 < lon1 and lat0 < 52.057009967 < lat1 and lon1 - lon0 < 0.01
    for bad in (lambda: client.read(spark, "XYZ", ids=["a"]), lambda: client.read(spark, "CPT")):
        with pytest.raises(ValueError):
            bad()


def test_register_search_splits_large_answers():
    calls = []

    def transport(method, url, body):
        calls.append(body)
        n = 4100 if len(calls) == 1 else 3
        return f"<numberOfDocuments>{n}</numberOfDocuments><broId>CPT{len(calls):012d}</broId>".encode()

    found = api.RegisterClient("https://register.example/", transport).search("CPT", (4.0, 52.0, 5.0, 53.0))
    assert len(calls) == 5 and found == [f"CPT{i:012d}" for i in range(2, 6)]


def test_tables(spark, tmp_path):
    path = put(tmp_path / "t.csv", "nr,x,y,surface,top,bottom,lith\nA,1,2,0.5,0,1,K\nA,1,2,0.5,1,2,Z\n")
    c = readers.read_table(spark, path, crs=28992)
    assert isinstance(c, Collection) and len(c) == 1 and c.data.count() == 2
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert readers.read_borehole_table(spark, path, as_collection=False).count() == 2
    assert any(issubclass(x.category, DeprecationWarning) for x in w)
    readers.csv_to_parquet(spark, path, str(tmp_path / "t.parquet"))
    assert readers.read_file(spark, str(tmp_path / "t.parquet")).count() == 2
    for bad in ("t.xls", "t.json"):
        with pytest.raises(TypeError):
            readers.read_file(spark, bad)


def test_too_many_columns_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(readers, "MAX_COLUMNS", 3)
    rows = spark.createDataFrame([({"a": 1.0, "b": 2.0},), ({"c": 1.0},)], "m map<string,double>")
    assert readers.names_in(rows, "m") == ["a", "b", "c"]
    with pytest.raises(ValueError):
        readers.names_in(rows.union(spark.createDataFrame([({"d": 1.0},)], "m map<string,double>")), "m")


def test_vtk_file(spark, tmp_path):
    cells = spark.createDataFrame([(0.5, 0.5, 0.25, 1), (1.5, 0.5, 0.25, None), (0.5, 0.5, 0.75, 3), (1.5, 0.5, 0.75, 4)], "x double, y double, z double, lith int")
    points, made = mesh.voxel_mesh(VoxelModel.from_table(cells), "lith")
    path = tmp_path / "m.vtk"
    mesh.write_vtk(points, made, "lith", str(path))
    lines = path.read_text().splitlines()
    n = points.count()
    assert lines[4] == f"POINTS {n} double" and lines[5 + n] == "CELLS 3 27" and lines[-3:] == ["1", "3", "4"]
    corners = [tuple(map(float, x.split())) for x in lines[5 : 5 + n]]
    first = [corners[int(i)] for i in lines[6 + n].split()[1:]]
    assert {tuple(sorted({p[k] for p in first})) for k in range(3)} == {(0.0, 1.0), (0.0, 0.5)}


def test_streams(spark, tmp_path):
    schema = "nr string, surface double, top double, bottom double, lith string"
    batches = [[("A", 0.0, 0.0, 1.0, "K"), ("B", 0.0, 0.0, 2.0, "Z")], [("A", 0.0, 1.0, 2.5, "Z"), ("C", 0.0, 0.0, 1.0, "K")]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    surveys.each_batch(surveys.filter_stream(stream(), "lith", "Z"), lambda df: df.select("nr", "bottom"), lambda df, i: got.extend(map(tuple, df.collect())), str(tmp_path / "c1")).awaitTermination(120)
    assert sorted(got) == [("A", 2.5), ("B", 2.0)]
    query = surveys.running_thickness(stream(), "lith", ["Z", "K"]).writeStream.outputMode("update").format("memory").queryName("thick").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = {r.nr: r.t for r in spark.table("thick").groupBy("nr").agg(F.max("thickness").alias("t")).collect()}
    assert last == {"A": 2.5, "B": 2.0, "C": 1.0}


def test_settled_collections_and_files_without_order(spark, tmp_path):
    rows = [("A", 1.0, 2.0, 0.5, float(i), i + 1.0, "KZ"[i % 2]) for i in range(6)]
    df = spark.createDataFrame(rows, "nr string, x double, y double, surface double, top double, bottom double, lith string")
    c = Collection.of(df).slice_by_values("lith", "Z").settled()
    assert c.data.count() == 3 and len(c) == 1 and "Scan ExistingRDD" in c.data._jdf.queryExecution().toString()
    df.repartition(3).write.parquet(str(tmp_path / "several"))
    with pytest.warns(UserWarning, match="no order"):
        validation.errors(spark.read.parquet(str(tmp_path / "several")))
    df.coalesce(1).write.parquet(str(tmp_path / "one"))
    assert validation.errors(spark.read.parquet(str(tmp_path / "one"))).count() == 0


def test_two_tables_and_cores(spark, tmp_path):
    put(tmp_path / "h.csv", "id,x,y,mv\n1,10,20,1.5\n2,30,40,2.5\n")
    put(tmp_path / "d.csv", "id,van,tot\n1,0,1\n1,1,2\n2,0,3\n")
    c = readers.read_header_and_data(spark, str(tmp_path / "h.csv"), str(tmp_path / "d.csv"), {"id": "nr", "mv": "surface", "van": "top", "tot": "bottom"})
    assert sorted((r.nr, r.x, r.surface, r.bottom) for r in c.data.collect()) == [("1", 10, 1.5, 1), ("1", 10, 1.5, 2), ("2", 30, 2.5, 3)]
    rows = spark.createDataFrame([("c", 1.0, 2.0, 10.0, 12.0), ("c", 1.5, 2.5, 12.0, 15.0)], "hole string, x double, y double, van double, tot double")
    cores = readers.read_cores(rows, {"hole": "nr", "van": "top", "tot": "bottom"})
    head = cores.header.first()
    assert cores.has_inclined and (head.x, head.y, head.surface, head.end) == (1.0, 2.0, -10.0, -15.0)
    assert sorted((r.top, r.bottom) for r in cores.data.collect()) == [(0.0, 2.0), (2.0, 5.0)]


def test_exports(spark, tmp_path):
    rows = [("A", 1.0, 2.0, 0.5, 0.0, 1.0, "K"), ("A", 1.0, 2.0, 0.5, 1.0, 2.0, "Z")]
    df = spark.createDataFrame(rows, "nr string, x double, y double, surface double, top double, bottom double, lith string")
    c = Collection.of(df)
    c.to_parquet(str(tmp_path / "p"))
    c.to_csv(str(tmp_path / "c"), data_table=False)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and spark.read.csv(str(tmp_path / "c"), header=True).columns == c.header.columns
    lines = sinks.segment_wkt(sinks.segments_3d(df)).orderBy("top").collect()
    assert lines[0].wkt == "LINESTRING Z (1.0 2.0 0.51, 1.0 2.0 -0.49)"
    sinks.to_kingdom(df, str(tmp_path / "k"))
    assert spark.read.csv(str(tmp_path / "k/intervals"), header=True).count() == 2
    assert [(r.id, r.MD) for r in spark.read.csv(str(tmp_path / "k/tdchart"), header=True, inferSchema=True).orderBy("id", "MD").collect()] == [(1, 0), (1, 1)]


def test_aliases(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.0)], "bohrung string, Tiefe double")
    try:
        roles.add_aliases(depth="tiefe", nr=["bohrung"], save_to=str(tmp_path / "names.json"))
        assert (roles.Roles.of(df).nr, roles.Roles.of(df).depth) == ("bohrung", "Tiefe")
        with pytest.raises(KeyError):
            roles.add_aliases(colour="red")
        roles.reset_aliases()
        roles.load_aliases(str(tmp_path / "names.json"))
        assert roles.Roles.of(df).depth == "Tiefe"
    finally:
        roles.reset_aliases(str(tmp_path / "names.json"))
    with pytest.raises(KeyError):
        roles.Roles.of(df)
    assert not (tmp_path / "names.json").exists()


def test_model_of_lower_left_corners(spark):
    cells = spark.createDataFrame([(float(x), float(y), float(z), x + y) for x in (0, 100, 200) for y in (0, 100) for z in (-1, 0)], "x double, y double, z double, lith int")
    m = VoxelModel.from_lower_left(cells, 100, 1, crs=28992, bbox=(0, 0, 150, 200))
    assert (m.bounds, m.z_bounds, m.shape) == ((0, 0, 200, 200), (-1, 1), (2, 2, 2))


def test_too_many_classes_are_an_error(spark, monkeypatch):
    from stratalake.operators import voxel

    m = VoxelModel.from_table(spark.createDataFrame([(0.5, 0.5, float(z), z if z % 2 else None) for z in range(9)], "x double, y double, z double, lith int"))
    assert sorted((r.value, r.n) for r in m.value_counts("lith", dim="z").collect()) == [(1, 1), (3, 1), (5, 1), (7, 1)]
    monkeypatch.setattr(voxel, "MAX_VALUES", 3)
    with pytest.raises(ValueError):
        m.value_counts("lith", dim="z")


def test_files_of_several_surveys(spark, tmp_path):
    one = lambda nr: survey(nr, "52.0 5.0", 1.0, "<boring><c:Boring><c:finalDepthBoring>2</c:finalDepthBoring></c:Boring></boring>", layer(0, 1, "zand"))
    path = put(tmp_path / "two.xml", dispatch(one("B1"), one("B2")))
    assert len(readers.read_xml(spark, path, "bhrg")) == 2
    with pytest.warns(UserWarning, match="read_all"):
        assert len(readers.read_xml(spark, path, "bhrg", read_all=False)) == 1


def test_geometries_in_another_system(spark):
    c = Collection.of(spark.createDataFrame([("in", 155000.0, 463000.0, 0.0, 0.0, 1.0), ("out", 100000.0, 463000.0, 0.0, 0.0, 1.0)], "nr string, x double, y double, surface double, top double, bottom double"), crs=28992)
    town = "POLYGON ((5.3 52.1, 5.5 52.1, 5.5 52.2, 5.3 52.2, 5.3 52.1))"
    with pytest.warns(UserWarning, match="4326"):
        out = c.spatial_join([("town", town)], "place", include_in_header=True, geometry_crs=4326)
    assert out.header.columns == [*c.header.columns, "place"]
    assert {r.nr: (r.x, r.place) for r in out.header.collect()} == {"in": (155000.0, "town"), "out": (100000.0, None)}
    with pytest.raises(ValueError, match="dimensions"):
        VoxelModel.from_table(c.data)
