"""Survey files read as streams: structures of real files, broken ones, and files larger than a worker's memory allows whole."""

import io
import subprocess
import sys
from pathlib import Path

import pytest

from stratalake.sources import readers

REPO = Path(__file__).resolve().parents[1]
#: Namespaces, wrapping levels, parts that are missing and elements that no schema names, as registers deliver them.
BHRGT = """<?xml version="1.0" encoding="UTF-8"?>
<ns5:dispatchDataResponse xmlns="http://www.broservices.nl/xsd/dsbhr-gt/2.1" xmlns:ns2="http://www.opengis.net/gml/3.2" xmlns:ns5="http://www.broservices.nl/xsd/x" xmlns:ns4="http://www.broservices.nl/xsd/bhrgtcommon/2.1">
 <ns4:responseType>dispatch</ns4:responseType><junk><upperBoundary>99</upperBoundary></junk>
 <dispatchDocument>
  <BHR_GT_O ns2:id="BRO_1"><ns4:broId>BHR1</ns4:broId><!-- a remark -->
   <standardizedLocation><ns4:location srsName="urn:ogc:def:crs:EPSG::28992" ns2:id="loc"><ns2:pos> 120000.5 480000.25 </ns2:pos></ns4:location></standardizedLocation>
   <deliveredVerticalPosition><ns4:offset uom="m">1.5</ns4:offset><ns4:verticalDatum codeSpace="urn">NAP</ns4:verticalDatum></deliveredVerticalPosition>
   <boring><ns4:finalDepthBoring uom="m">10</ns4:finalDepthBoring></boring>
   <boreholeSampleDescription><ns4:descriptiveBoreholeLog>
     <ns4:layer><ns4:upperBoundary uom="m">0.00</ns4:upperBoundary><ns4:lowerBoundary>2.5</ns4:lowerBoundary><ns4:soil><ns4:geotechnicalSoilName codeSpace="c">zwakSiltigZand</ns4:geotechnicalSoilName></ns4:soil></ns4:layer>
     <ns4:layer><ns4:upperBoundary>2.5</ns4:upperBoundary><ns4:lowerBoundary>4</ns4:lowerBoundary><ns4:soil><ns4:geotechnicalSoilName>  </ns4:geotechnicalSoilName></ns4:soil></ns4:layer>
   </ns4:descriptiveBoreholeLog></boreholeSampleDescription>
  </BHR_GT_O>
  <BHR_GT_O><ns4:broId>BHR2</ns4:broId>
   <standardizedLocation><ns4:location srsName="urn:ogc:def:crs:EPSG::28992"><ns2:pos>1 2</ns2:pos></ns4:location></standardizedLocation>
   <boreholeSampleDescription><ns4:descriptiveBoreholeLog><ns4:layer><ns4:upperBoundary>0</ns4:upperBoundary><ns4:lowerBoundary>1</ns4:lowerBoundary></ns4:layer></ns4:descriptiveBoreholeLog></boreholeSampleDescription>
  </BHR_GT_O>
 </dispatchDocument>
 <dispatchDocument><BHR_GT_O><ns4:broId>not read</ns4:broId></BHR_GT_O></dispatchDocument>
</ns5:dispatchDataResponse>"""


def put(path, text):
    path.write_text(text)
    return str(path)


def test_structures_of_registers(spark, tmp_path):
    c = readers.read_xml(spark, put(tmp_path / "a b%20.xml", BHRGT), "bhrgt")
    rows = sorted(map(tuple, c.data.select("nr", "x", "y", "surface", "end", "top", "bottom", "geotechnicalSoilName").collect()), key=str)
    assert rows == [
        ("BHR1", 120000.5, 480000.25, 1.5, -8.5, 0.0, 2.5, "zwakSiltigZand"),
        ("BHR1", 120000.5, 480000.25, 1.5, -8.5, 2.5, 4.0, None),
        ("BHR2", 1.0, 2.0, None, None, 0.0, 1.0, None),
    ]
    assert c.crs == 28992 and "vertical_datum" in c.header.columns
    with pytest.warns(UserWarning, match="several surveys"):
        one = readers.read_xml(spark, put(tmp_path / "c.xml", BHRGT), "bhrgt", read_all=False)
    assert {r.nr for r in one.data.collect()} == {"BHR1"}


def test_broken_files_are_named(spark, tmp_path):
    for kind, text, word in (("bhrgt", BHRGT[:1200], "well-formed"), ("bhrgt", "<a><b/></a>", "dispatchDocument")):
        path = put(tmp_path / "broken.xml", text)
        with pytest.raises(Exception, match=f"(?s)broken.xml.*{word}"):
            readers.read_xml(spark, path, kind)
    with pytest.raises(Exception, match="(?s)broken.xml.*well-formed"):
        readers.read_boris_xml(spark, put(tmp_path / "broken.xml", "<xml><pointSurvey id='1'>"))
    (tmp_path / "g").mkdir()
    put(tmp_path / "g" / "no end.gef", "#TESTID= a\n#COLUMNINFO= 1, m, length, 1\n1.0\n")
    with pytest.raises(Exception, match="(?s)no end.gef.*#EOH"):
        readers.read_gef(spark, str(tmp_path / "g"))


def test_schema_without_a_payload_and_resolvers(spark, tmp_path):
    text = "<all><site><code>A</code><place><pos>3 4</pos></place><bed><from>0</from><to>2</to><kind>clay</kind></bed><bed><from>2</from><to>5</to></bed></site><site><code>b</code><bed><from>1</from><to>2</to></bed></site></all>"
    schema = readers.XmlSchema(None, {"nr": "code", "location": "place/pos"}, "bed", ["from", "to", "kind"], resolvers={"nr": lambda v: v.upper()})
    found = list(readers.surveys_in(io.BytesIO(text.encode()), schema, "t"))
    assert [(h["nr"], len(rows), more) for h, rows, more in found] == [("A", 2, False), ("B", 1, False)]
    assert found[0][1] == [{"from": "0", "to": "2", "kind": "clay"}, {"from": "2", "to": "5"}]


def test_point_surveys(spark, tmp_path):
    text = "<boris xmlns='urn:x'><head><x>9</x></head>" + "".join(f"<pointSurvey id='P{i}'><x>{i}</x><surfaceLevel value='2'/><lithoInterval baseDepth='1'><lithology code='Z'/></lithoInterval><lithoInterval baseDepth='{i + 2}'><lithology>K</lithology></lithoInterval></pointSurvey>" for i in range(3)) + "</boris>"
    rows = readers.read_boris_xml(spark, put(tmp_path / "b.xml", text)).orderBy("nr", "top").collect()
    assert [(r.nr, r.x, r.y, r.surface, r.end, r.top, r.bottom, r.lithology) for r in rows][:2] == [("P0", 0.0, None, 2.0, 0.0, 0.0, 1.0, "Z"), ("P0", 0.0, None, 2.0, 0.0, 1.0, 2.0, "K")]
    assert len(rows) == 6


MEASURE = """
import resource, sys
sys.path.insert(0, {repo!r})
from stratalake.sources import readers
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
with open({path!r}, "rb") as f:
    n = sum(len(rows) for _, rows, _ in readers.surveys_in(f, readers.schema_of("bhrgt"), "p"))
print(n, (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("surveys", [1, 500])
def test_three_million_elements_within_a_gigabyte(tmp_path, surveys):
    layers = 750_000 // surveys
    with open(tmp_path / "large.xml", "w") as f:
        f.write("<answer><dispatchDocument>")
        for s in range(surveys):
            f.write(f"<survey><broId>B{s}</broId><log>")
            for i in range(layers):
                f.write(f"<layer><upperBoundary>{i}</upperBoundary><lowerBoundary>{i + 1}</lowerBoundary><geotechnicalSoilName>zand</geotechnicalSoilName></layer>")
            f.write("</log></survey>")
        f.write("</dispatchDocument></answer>")
    out = subprocess.run([sys.executable, "-c", MEASURE.format(repo=str(REPO), path=str(tmp_path / "large.xml"))], capture_output=True, text=True, timeout=300)
    rows, grown = map(int, out.stdout.split())
    assert rows == layers * surveys and grown < (500 if surveys == 1 else 40), out.stderr
