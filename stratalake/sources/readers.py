"""Readers of tabular, GEF, XML and GeoPackage files. Files are parsed on the executors, a file a row."""

from __future__ import annotations

import io
import re
import sqlite3
import warnings
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, BinaryIO
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import Collection
from ..functions.geometry import from_wkb, wkb_point
from ..functions.geotech import CLASSES, COARSEST
from ..operators.layers import adjust_depths
from ..roles import check_roles, col
from ..storage import open_file, settled

#: Columns that files may have between them.
MAX_COLUMNS = 10_000
#: Rows that a task hands on at a time.
OUT_ROWS = 20_000


def names_in(rows: DataFrame, maps: str) -> list[str]:
    """The keys of a map column, in order: the columns that files have between them."""
    found = sorted(r[0] for r in rows.select(F.explode(F.map_keys(maps))).distinct().limit(MAX_COLUMNS + 1).collect())
    if len(found) > MAX_COLUMNS:
        raise ValueError(f"the files have more than {MAX_COLUMNS} different columns between them")
    return found


# Tables


def read_file(spark: SparkSession, path: str, **options) -> DataFrame:
    """Parquet, delimited text or a workbook, by suffix."""
    low = path.lower().rstrip("/")
    if low.endswith((".xlsx", ".xlsm")):
        from .excel import read_excel

        return read_excel(spark, path, **options)
    if low.endswith((".parquet", ".pq")):
        return spark.read.parquet(path)
    if low.endswith((".csv", ".txt", ".tsv")):
        return spark.read.csv(path, header=True, inferSchema=True, **({"sep": "\t"} if low.endswith(".tsv") else {}) | options)
    raise TypeError(f"can't read {path}: Parquet, CSV, TSV, TXT and XLSX files are supported")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN stands for missing values in files; here they are null."""
    made = {c: F.when(~F.isnan(col(c)), col(c)) for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns(made) if made else df


def read_table(spark: SparkSession, path: str, as_collection: bool = True, column_mapper: dict[str, str] | None = None, include_in_header: list[str] | None = None, coordinate_names: tuple[str, str] | None = None, crs: int | None = None, vertical_datum: int | None = None, has_inclined: bool = False, **options) -> Collection | DataFrame:
    """A survey table with depths from the surface down, as a collection or a table."""
    df = nan_to_null(read_file(spark, path, **options)).withColumnsRenamed(column_mapper or {})
    roles = check_roles(df)
    if roles.has_depths:
        df = adjust_depths(df)
    if not as_collection:
        return df
    return Collection.of(df, include_in_header, coordinate_names, crs=crs, vertical_datum=vertical_datum, has_inclined=has_inclined)


def read_borehole_table(spark: SparkSession, path: str, **options):
    warnings.warn("use read_table", DeprecationWarning, stacklevel=2)
    return read_table(spark, path, **options)


def read_cpt_table(spark: SparkSession, path: str, **options):
    warnings.warn("use read_table", DeprecationWarning, stacklevel=2)
    return read_table(spark, path, **options)


def csv_to_parquet(spark: SparkSession, path: str, out: str, **options) -> None:
    if not path.lower().endswith((".csv", ".txt", ".tsv")):
        raise TypeError(f"{path} is no delimited text")
    read_file(spark, path, **options).write.mode("overwrite").parquet(out)


def read_header_and_data(spark: SparkSession, header_path: str, data_path: str, mapper: dict[str, str], crs: int = 28992, vertical_datum: int = 5709) -> Collection:
    """Two tables of one set of surveys; ids as text, coordinates and surface of the header added to the data."""
    head = read_file(spark, header_path).withColumnsRenamed(mapper)
    data = read_file(spark, data_path).withColumnsRenamed(mapper)
    head, data = (t.withColumn("nr", F.col("nr").cast("string")) for t in (head, data))
    extra = [c for c in ("x", "y", "surface", "end") if c in head.columns and c not in data.columns]
    return Collection(head, data.join(head.select("nr", *extra), "nr", "left"), crs=crs, vertical_datum=vertical_datum)


def read_cores(df: DataFrame, mapper: dict[str, str]) -> Collection:
    """Inclined cores in elevations: the header comes from aggregates of the layers."""
    data = df.withColumnsRenamed(mapper).withColumns({"top": 0.0 - F.col("top"), "bottom": 0.0 - F.col("bottom")})
    head = data.groupBy("nr").agg(F.max_by("x", "top").alias("x"), F.max_by("y", "top").alias("y"), F.max("top").alias("surface"), F.min("bottom").alias("end"))
    return Collection(head, adjust_depths(data.join(head.select("nr", "surface", "end"), "nr", "left")), crs=28992, vertical_datum=5709, has_inclined=True)


# GEF

#: The names of measured quantities by their numbers.
GEF_COLUMNS = {
    1: "length", 2: "qc", 3: "fs", 4: "rf", 5: "u1", 6: "u2", 7: "u3", 8: "inclination_res", 9: "inclination_ns", 10: "inclination_ew",
    11: "corrected_depth", 12: "time", 13: "qt", 14: "qn", 15: "Bq", 16: "Nm", 17: "gamma", 18: "u0", 19: "sigma", 20: "sigma_eff",
    21: "inclination_x", 22: "inclination_y", 23: "ec", 24: "Bx", 25: "By", 26: "Bz",
}
#: Height systems by code.
GEF_LEVELS = {"00000": "own reference level", "00001": "Low Low Water Spring", "31000": "NAP", "32000": "Ostend Level", "32001": "TAW", "49000": "Normall Null"}


def _number(text: Any) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def parse_gef(text: str) -> tuple[dict, list[dict]]:
    """(header, rows) of a cone penetration test. Later keywords replace earlier ones; ragged rows are left out."""
    parts = re.split(r"#EOH\s*=[^\n]*\n?", text, maxsplit=1)
    if len(parts) < 2:
        raise ValueError("the header of a GEF file ends with #EOH, and there is none")
    head, body = parts
    info: dict[str, list[str]] = {}
    columns, voids, variables = {}, {}, {}
    for line in head.splitlines():
        m = re.match(r"#\s*([A-Z]+)\s*=\s*(.*)", re.sub(r" {2,}", " ", line.replace('"', "")).strip())
        if not m:
            continue
        values = [v.strip() for v in m[2].split(",")]
        if m[1] == "COLUMNINFO" and len(values) >= 4:
            columns[int(values[0])] = GEF_COLUMNS.get(int(float(values[3])), values[2])
        elif m[1] == "COLUMNVOID" and len(values) >= 2:
            voids[int(values[0])] = _number(values[1])
        elif m[1] == "MEASUREMENTVAR" and len(values) >= 2:
            variables[int(_number(values[0]) or 0)] = _number(values[1])
        else:
            info[m[1]] = values if m[1] != "COLUMNSEPARATOR" else [m[2].strip() or " "]
    separator, end = info.get("COLUMNSEPARATOR", [" "])[0], info.get("RECORDSEPARATOR", ["!"])[0] or "!"
    names = [columns[k] for k in sorted(columns)]
    rows = []
    for line in body.splitlines():
        line = line.replace(end, " ").strip()
        parts = line.split() if separator == " " else [p for p in (p.strip() for p in line.strip(separator + " ").split(separator))]
        values = [_number(p) for p in parts]
        if len(values) == len(names) and None not in values:
            rows.append({n: None if v == voids.get(i + 1) else v for i, (n, v) in enumerate(zip(names, values))})
    for r in rows:
        if "rf" not in r and r.get("qc") and r.get("fs") is not None:
            r["rf"] = r["fs"] / r["qc"] * 100
        r["depth"] = r["corrected_depth"] if r.get("corrected_depth") is not None else r.get("length")
    xy, z = info.get("XYID", []), info.get("ZID", [])
    surface = _number(z[1]) if len(z) > 1 else None
    deep = variables.get(16) if variables.get(16) is not None else max((r["length"] for r in rows if r.get("length") is not None), default=None)
    header = {
        "nr": (info.get("TESTID") or info.get("PROJECTID") or [None])[0],
        "x": _number(xy[1]) if len(xy) > 2 else None,
        "y": _number(xy[2]) if len(xy) > 2 else None,
        "surface": surface,
        "end": surface - deep if surface is not None and deep is not None else None,
        "level": GEF_LEVELS.get(z[0], z[0]) if z else None,
    }
    return header, rows


def read_gef(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of GEF files or folders, each parsed once. The columns are those that any of the files has."""
    return gef_rows(spark.read.format("binaryFile").option("pathGlobFilter", "*.[gG][eE][fF]").load(paths))


def gef_rows(files: DataFrame) -> DataFrame:
    """The rows of GEF files given as rows (path, content)."""

    def parse(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    header, rows = parse_gef(bytes(content).decode("utf-8", "replace"))
                except ValueError as error:
                    raise ValueError(f"{path}: {error}") from error
                if rows:
                    flat = [(path, header["nr"], header["x"], header["y"], header["surface"], header["end"], i, {k: v for k, v in r.items() if v is not None}) for i, r in enumerate(rows)]
                    yield pd.DataFrame(flat, columns=["path", "nr", "x", "y", "surface", "end", "_pos", "values"])

    rows = settled(files.select("path", "content").mapInPandas(parse, "path string, nr string, x double, y double, surface double, end double, _pos int, values map<string,double>"))
    names = names_in(rows, "values")
    return rows.select("nr", "x", "y", "surface", "end", *[F.element_at("values", n).alias(n) for n in names], "_pos")


def read_gef_cpts(spark: SparkSession, paths: str | list[str]) -> Collection:
    return Collection.of(read_gef(spark, paths), crs=28992, vertical_datum=5709)


# XML


@dataclass
class XmlSchema:
    """Where a kind of survey keeps its parts. Paths are local names from the payload down, without prefixes.

    ``rows`` names the elements that become rows and ``attributes`` their descendants; or, with ``values``, rows are a
    delimited block of numbers.
    """

    payload: str | None
    paths: dict[str, str]
    rows: str | None = None
    attributes: list[str] = field(default_factory=list)
    values: bool = False
    resolvers: dict[str, Callable[[str | None], Any]] = field(default_factory=dict)


def _schema(offset: str, end: str, rows: str | None, name: str | None, **more: str) -> XmlSchema:
    base = {"nr": "broId", "location": "standardizedLocation/location/pos", "crs": "standardizedLocation/location@srsName", "surface": f"deliveredVerticalPosition/{offset}", "vertical_datum": "deliveredVerticalPosition/verticalDatum", "end": end}
    return XmlSchema("dispatchDocument", base | more, rows, ["upperBoundary", "lowerBoundary", name] if name else [], rows is None)


#: The public schemas of subsurface surveys.
SCHEMAS = {
    "bhrgt": _schema("offset", "boring/finalDepthBoring", "layer", "geotechnicalSoilName", groundwater_level="boring/groundwaterLevel"),
    "bhrp": _schema("offset", "boring/boredTrajectory/endDepth", "soilLayer", "standardSoilName", begin_depth="boring/boredTrajectory/beginDepth", ghg="boreholeSampleDescription/result/meanHighestGroundwaterLevel", glg="siteCharacteristic/meanLowestGroundwaterTable", landuse="siteCharacteristic/landUse"),
    "bhrg": _schema("offset", "boring/Boring/finalDepthBoring", "layer", "soilNameNEN5104"),
    "sfr": _schema("offset", "soilUncovering/SoilUncovering/endDepthSoilFace", "SoilLayer", "soilNameNEN5104", landuse="siteCharacteristic/SiteCharacteristic/soilUse", outcrop_type="soilUncovering/SoilUncovering/outcropType"),
    "cpt": _schema("offset", "conePenetrometerSurvey/trajectory/finalDepth", None, None, predrilled_depth="conePenetrometerSurvey/trajectory/predrilledDepth"),
}
#: Samples have a share for each grain-size class, and what is coarser than 63 um or 63 mm as a whole.
SCHEMAS["bhrgt_samples"] = XmlSchema("dispatchDocument", SCHEMAS["bhrgt"].paths, "investigatedInterval", ["beginDepth", "endDepth", "fractionLarger63um", *[n for n, _ in CLASSES], COARSEST])
#: Files that a company delivers keep the same parts elsewhere.
COMPANIES = {
    ("bhrgt", "Wiertsema"): XmlSchema(
        "sourceDocument",
        SCHEMAS["bhrgt"].paths | {"nr": "objectIdAccountableParty", "location": "deliveredLocation/location/Point/pos", "crs": "deliveredLocation/location/Point@srsName"},
        SCHEMAS["bhrgt"].rows,
        SCHEMAS["bhrgt"].attributes,
    )
}


def schema_of(kind: str | XmlSchema, company: str | None = None) -> XmlSchema:
    """A schema by its kind of survey, and the company whose files are read."""
    if isinstance(kind, XmlSchema):
        return kind
    if kind not in SCHEMAS:
        raise ValueError(f"no schema {kind!r}; there are {', '.join(SCHEMAS)}")
    if company is None:
        return SCHEMAS[kind]
    if (kind, company) not in COMPANIES:
        raise ValueError(f"no schema of {company!r} for {kind!r}; there are {', '.join(f'{c} ({k})' for k, c in COMPANIES)}")
    return COMPANIES[kind, company]


NUMERIC = {"surface", "end", "begin_depth", "ghg", "glg", "groundwater_level", "predrilled_depth"}
MISSING = -999999.0


def local(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2]


def _find(element: ET.Element, path: str) -> str | None:
    """Text, or an attribute after @, at a path of local names; a step may skip one level of wrapping."""
    path, _, attribute = path.partition("@")
    now = [element]
    for step in path.split("/"):
        now = [c for e in now for c in e if local(c).lower() == step.lower()] or [c for e in now for d in e for c in d if local(c).lower() == step.lower()]
    for e in now:
        if attribute:
            got = e.get(attribute) or next((c.get(attribute) for c in e.iter() if c.get(attribute)), None)
        else:
            got = e.text.strip() if e.text and e.text.strip() else None
        if got:
            return got
    return None


def parse_survey(payload: ET.Element, schema: XmlSchema, layers: list[dict]) -> tuple[dict[str, Any], list[dict[str, str | float | None]]]:
    """(header, rows) of a survey's element, from which the elements of its layers are taken out."""
    head: dict[str, Any] = {k: _find(payload, p) for k, p in schema.paths.items()}
    for k in NUMERIC & head.keys():
        head[k] = _number(head[k])
    for k, f in schema.resolvers.items():
        head[k] = f(head.get(k))
    if schema.values:
        block = next((e for e in payload.iter() if local(e) == "values"), None)
        encoding = next((e for e in payload.iter() if local(e) == "TextEncoding"), None)
        row_end = encoding.get("blockSeparator", ";") if encoding is not None else ";"
        cell_end = encoding.get("tokenSeparator", ",") if encoding is not None else ","
        names = [local(e).lower() for p in payload.iter() if local(p) == "parameters" for e in p]
        rows = [{n: None if (v := _number(x)) == MISSING else v for n, x in zip(names, r.split(cell_end))} for r in (block.text or "").strip().split(row_end) if r.strip()] if block is not None else []
        for r in rows:
            r["depth"] = r.get("depth") if r.get("depth") is not None else r.get("penetrationlength")
        return head, sorted(rows, key=lambda r: (r["depth"] is None, r["depth"] or 0.0))
    return head, layers


def layer_of(e: ET.Element, schema: XmlSchema) -> dict[str, str]:
    """The attributes of a row's element that have a text."""
    found: dict[str, str] = {}
    wanted = set(schema.attributes)
    for c in e.iter():
        name = local(c)
        if name in wanted and name not in found and c.text and (text := c.text.strip()):
            found[name] = text
    return found


def surveys_in(source: BinaryIO, schema: XmlSchema, path: str, read_all: bool = True) -> Iterator[tuple[dict, list[dict], bool]]:
    """(header, rows, whether the file has more surveys) of a file's surveys, read as a stream.

    What is done with goes from the tree at once: a survey when it has been read, a layer when its attributes are taken,
    what stands beside the payload when it ends. Memory holds the values of one survey, whatever the file's size.
    """
    stack: list[ET.Element] = []
    holder: ET.Element | None = None
    closed, first = False, None
    layers: list[dict] = []
    try:
        for event, e in ET.iterparse(source, ("start", "end")):
            if event == "start":
                if holder is None and (schema.payload is None and not stack or local(e) == schema.payload):
                    holder = e
                elif first and holder is not None and stack and stack[-1] is holder:
                    yield (*first, True)
                    return
                stack.append(e)
                continue
            stack.pop()
            if e is holder:
                closed = True
            inside = holder is not None and not closed
            if inside and stack and stack[-1] is holder:
                found = parse_survey(e, schema, layers)
                layers = []
                if read_all:
                    yield (*found, False)
                else:
                    first = found
                holder.remove(e)
            elif inside and stack and not schema.values and local(e) == schema.rows:
                layers.append(layer_of(e, schema))
                stack[-1].remove(e)
            elif not inside and e is not holder:
                e.clear()
    except ET.ParseError as error:
        raise ValueError(f"{path} is no well-formed XML: {error}") from error
    if holder is None:
        raise ValueError(f"{path} has no {schema.payload}: the schema is one for other files")
    if first:
        yield (*first, False)


#: File systems that tasks open themselves; files of others come as a whole from Spark.
OPENED = ("file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def files_at(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content) of files: without contents where tasks can open the paths, which then may have any size."""
    files = spark.read.format("binaryFile").load(paths)
    schemes = {r[0] for r in files.select(F.substring_index("path", ":", 1)).distinct().collect()}
    if schemes <= set(OPENED):
        return files.select("path", F.lit(None).cast("binary").alias("content"))
    return files.select("path", "content")


def opened(path: str, content: bytes | None) -> BinaryIO:
    """The file of a row of files_at."""
    return io.BytesIO(content) if content is not None else open_file(path)


def read_xml(spark: SparkSession, paths: str | list[str], kind: str | XmlSchema, read_all: bool = True, crs: int | None = None, company: str | None = None) -> Collection:
    """Surveys of XML files as a collection in one reference system; end as an elevation.

    ElementTree resolves no external entities. Locations of geographic systems come as latitude, longitude. A file
    without the schema's payload is an error; a schema without one reads the document's own elements.
    """
    return surveys_of(files_at(spark, paths), schema_of(kind, company), read_all, crs)


def surveys_of(files: DataFrame, schema: XmlSchema, read_all: bool = True, crs: int | None = None) -> Collection:
    """The surveys of XML files given as rows (path, content); where content is null, tasks open the path."""
    names = ["nr", "x", "y", "surface", "end", "epsg", "more", "meta", "_pos", "row"]

    def parse(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                with opened(path, content) as source:
                    for head, rows, more in surveys_in(source, schema, path, read_all):
                        a, b = (*map(_number, re.split(r"[\s,;]+", (head.pop("location", None) or "").strip())), None, None)[:2]
                        code = re.search(r"(\d+)$", head.pop("crs", None) or "")
                        epsg = int(code[1]) if code else None
                        x, y = (b, a) if epsg in (4326, 4258, None) else (a, b)
                        surface, end = head.get("surface"), head.get("end")
                        meta = {k: str(v) for k, v in head.items() if v is not None and k not in ("nr", "surface", "end")}
                        for i, r in enumerate(rows):
                            out.append((head["nr"], x, y, surface, surface - end if surface is not None and end is not None else None, epsg, more, meta, i, {k: str(v) for k, v in r.items() if v is not None}))
                            if len(out) >= OUT_ROWS:
                                yield pd.DataFrame(out, columns=names)
                                out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    rows = settled(files.select("path", "content").mapInPandas(parse, "nr string, x double, y double, surface double, end double, epsg int, more boolean, meta map<string,string>, _pos int, row map<string,string>"))
    if not read_all and not rows.where("more").isEmpty():
        warnings.warn("some files hold several surveys, of which the first is read: use read_all", UserWarning, stacklevel=3)
    systems = [r[0] for r in rows.select("epsg").distinct().limit(3).collect() if r[0] is not None]
    if len(systems) > 1:
        raise ValueError(f"the files are in several reference systems: {systems}")
    # A schema's attributes are columns also where no survey has a value.
    names = sorted({*names_in(rows, "row"), *schema.attributes})
    heads = names_in(rows, "meta")
    rename = {"upperBoundary": "top", "lowerBoundary": "bottom", "beginDepth": "top", "endDepth": "bottom"}
    number = lambda n, c: c.try_cast("double") if n in rename or n.startswith("fraction") or schema.values else c
    data = rows.select("nr", "x", "y", "surface", "end", *[number(n, F.element_at("row", n)).alias(rename.get(n, n)) for n in names], *[F.element_at("meta", h).alias(h) for h in heads])
    c = Collection.of(data, include_in_header=heads, crs=systems[0] if systems else None)
    data = c.data.drop(*heads)
    c = c.with_data(data)
    return c.to_crs(crs) if crs and c.crs and crs != c.crs else c


def read_boris_xml(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Layers of the point surveys of lithological description files: depths of bases, tops from the layer above."""
    return boris_rows(files_at(spark, paths))


def point_surveys(source: BinaryIO, path: str) -> Iterator[tuple]:
    """(nr, x, y, surface, layers) of the point surveys of a file, read as a stream; a layer is (top, base, values)."""
    stack: list[ET.Element] = []
    layers: list[tuple] = []
    top, within = 0.0, None
    try:
        for event, e in ET.iterparse(source, ("start", "end")):
            if event == "start":
                if within is None and local(e) == "pointSurvey":
                    within, top, layers = e, 0.0, []
                stack.append(e)
                continue
            stack.pop()
            if e is within:
                nr = e.get("id") or next((c.text for c in e.iter() if local(c) in ("identification", "id") and c.text), None)
                place = {local(c).lower(): _number(c.text or c.get("value")) for c in e.iter() if local(c).lower() in ("x", "y", "xcoord", "ycoord", "surfacelevel", "elevation")}
                yield nr, place.get("x", place.get("xcoord")), place.get("y", place.get("ycoord")), place.get("surfacelevel", place.get("elevation")), layers
                within = None
                if stack:
                    stack[-1].remove(e)
            elif within is not None and local(e) == "lithoInterval":
                base = _number(e.get("baseDepth"))
                layers.append((top, base, {local(c): next(iter(c.attrib.values()), c.text or "") for c in e}))
                top = base
                stack[-1].remove(e)
            elif within is None:
                e.clear()
    except ET.ParseError as error:
        raise ValueError(f"{path} is no well-formed XML: {error}") from error


def boris_rows(files: DataFrame) -> DataFrame:
    """The layers of lithological description files given as rows (path, content); where content is null, tasks open the path."""
    columns = ["nr", "x", "y", "surface", "end", "top", "bottom", "values"]

    def parse(it: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                with opened(path, content) as source:
                    for nr, x, y, surface, layers in point_surveys(source, path):
                        end = surface - layers[-1][1] if layers and surface is not None and layers[-1][1] is not None else None
                        for row in layers:
                            out.append((nr, x, y, surface, end, *row))
                            if len(out) >= OUT_ROWS:
                                yield pd.DataFrame(out, columns=columns)
                                out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

    rows = settled(files.select("path", "content").mapInPandas(parse, "nr string, x double, y double, surface double, end double, top double, bottom double, values map<string,string>"))
    names = names_in(rows, "values")
    return rows.select("nr", "x", "y", "surface", "end", "top", "bottom", *[F.element_at("values", n).alias(n) for n in names])


# GeoPackage


#: Rows that a task reads of a GeoPackage's table at a time.
GPKG_ROWS = 50_000


def gpkg_kind(declared: str) -> str:
    """The Spark type of a declared column type; geometries are declared by their kinds and stored as blobs."""
    name = declared.upper().partition("(")[0].strip()
    if name in ("REAL", "DOUBLE", "FLOAT", "DOUBLE PRECISION", "NUMERIC"):
        return "double"
    if "INT" in name and "POINT" not in name or name == "BOOLEAN":
        return "long"
    return "string" if name in ("TEXT", "VARCHAR", "DATE", "DATETIME", "") else "binary"


#: Operators of conditions on a GeoPackage's columns.
OPERATORS = ("=", "<>", "<", "<=", ">", ">=", "like", "is", "is not")


def range_statement(table: str, columns: list[str], where: Sequence[tuple[str, str, Any]], tree: str | None, bbox: tuple[float, float, float, float] | None) -> tuple[str, tuple]:
    """What a task asks of a GeoPackage for a range of row numbers, and its values beyond the range."""
    sql = f"select {', '.join(f'"{n}"' for n in columns)} from \"{table}\" where rowid >= ? and rowid < ?"
    sql += "".join(f' and "{c}" {op} ?' for c, op, _ in where)
    values = tuple(v for _, _, v in where)
    if tree:
        sql += f' and rowid in (select id from "{tree}" where minx <= ? and maxx >= ? and miny <= ? and maxy >= ?)'
        values += (bbox[2], bbox[0], bbox[3], bbox[1])
    return sql, values


class Geopackage:
    """Layers of a GeoPackage (an SQLite file) as DataFrames.

    Tables are read by tasks, a range of row numbers each, so the file lies where driver and executors see it; results of
    other statements pass the driver.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.db = spark, path, sqlite3.connect(path)

    def __enter__(self) -> Geopackage:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.db.close()

    def layers(self) -> list[str]:
        return [r[0] for r in self.db.execute("select table_name from gpkg_contents order by table_name")]

    def get_column_names(self, table: str) -> list[str]:
        return [r[1] for r in self.db.execute(f'pragma table_info("{table}")')]

    def _frame(self, cursor: sqlite3.Cursor) -> DataFrame:
        names = [c[0] for c in cursor.description]
        out: DataFrame | None = None
        while rows := cursor.fetchmany(50_000):
            kinds = ["binary" if any(isinstance(r[i], bytes) for r in rows) else "double" if any(isinstance(r[i], float) for r in rows) else "long" if any(isinstance(r[i], int) for r in rows) else "string" for i in range(len(names))]
            rows = [tuple(float(v) if k == "double" and v is not None else v for v, k in zip(r, kinds)) for r in rows]
            part = self.spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
            out = part if out is None else out.unionByName(part)
        return out if out is not None else self.spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))

    def table_head(self, table: str, n: int = 5) -> DataFrame:
        return self._frame(self.db.execute(f'select * from "{table}" limit {int(n)}'))

    def tree(self, table: str) -> str | None:
        """The table's R-tree of boxes, if it has one."""
        found = self.db.execute("select column_name from gpkg_geometry_columns where table_name = ?", (table,)).fetchone() if self._has("gpkg_geometry_columns") else None
        name = f"rtree_{table}_{found[0]}" if found else ""
        return name if name and self._has(name) else None

    def _has(self, name: str) -> bool:
        return self.db.execute("select 1 from sqlite_master where name = ?", (name,)).fetchone() is not None

    def read_table(self, table: str, columns: list[str] | None = None, where: list[tuple[str, str, Any]] = (), bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
        """A table's rows; of these columns, of rows that meet all conditions (column, operator, value), and whose
        geometry's box meets a box. All three go into the statement that tasks send, the box by way of the R-tree."""
        kinds = [(r[1], gpkg_kind(r[2])) for r in self.db.execute(f'pragma table_info("{table}")')]
        known = [n for n, _ in kinds]
        if missing := [n for n in [*(columns or []), *(c for c, _, _ in where)] if n not in known]:
            raise ValueError(f"{table} has no column {', '.join(missing)}")
        if bad := [op for _, op, _ in where if op.lower() not in OPERATORS]:
            raise ValueError(f"no operator {', '.join(bad)}; there are {', '.join(OPERATORS)}")
        kinds = [(n, k) for n, k in kinds if columns is None or n in columns]
        if self.db.execute("select type from sqlite_master where name = ?", (table,)).fetchone() != ("table",):
            if where or bbox or columns:
                raise ValueError(f"{table} is a view: it is read as a whole, or by a statement of its own")
            return self._frame(self.db.execute(f'select * from "{table}"'))  # a view has no row numbers
        tree = self.tree(table) if bbox else None
        if bbox and tree is None:
            raise ValueError(f"{table} has no R-tree of boxes")
        low, high = self.db.execute(f'select min(rowid), max(rowid) from "{table}"').fetchone()
        schema = ", ".join(f"`{n}` {k}" for n, k in kinds)
        if low is None:
            return self.spark.createDataFrame([], schema)
        address, types = f"file:{quote(str(Path(self.path).resolve()))}?mode=ro", {"double": pa.float64(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        made = {"double": float, "long": int, "string": str, "binary": bytes}
        stored = {"double": {float}, "long": {int}, "string": {str}, "binary": {bytes}}

        def column(kind: str, values: tuple) -> pa.Array:
            if not set(map(type, values)) <= stored[kind] | {type(None)}:  # a column may hold values of any type
                values = [None if v is None else made[kind](v) for v in values]
            return pa.array(values, types[kind])

        sql, values = range_statement(table, [n for n, _ in kinds], where, tree, bbox)

        def read(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            with closing(sqlite3.connect(address, uri=True)) as db:
                for start in (x for b in it for x in b.column(0).to_pylist()):
                    rows = db.execute(sql, (start, start + GPKG_ROWS, *values)).fetchall()
                    if rows:
                        yield pa.RecordBatch.from_arrays([column(k, c) for (_, k), c in zip(kinds, zip(*rows))], names=[n for n, _ in kinds])

        return self.spark.range(low, high + 1, GPKG_ROWS, max(1, min(1000, (high - low) // GPKG_ROWS + 1))).mapInArrow(read, schema)

    def query(self, sql: str) -> DataFrame:
        return self._frame(self.db.execute(sql))


def geometry_of(blob: bytes):
    """The geometry in a GeoPackage blob."""
    envelope = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7]
    return from_wkb(bytes(blob[8 + envelope :]))


#: The tables of a register's cone penetration tests, the main layer first.
CPT_TABLES = (
    "geotechnical_cpt_survey", "delivered_location", "bro_location", "bro_point", "delivered_vertical_position",
    "cone_penetrometer_survey", "trajectory", "processing", "cone_penetrometer", "zero_load_measurement", "parameters",
    "cone_penetration_test", "cone_penetration_test_result", "dissipation_test", "dissipation_test_result",
    "additional_investigation", "removed_layer", "registration_history", "nga_properties",
)


class CptGeopackage:
    """A GeoPackage of cone penetration tests: its tables by name, and the locations as a Spark join.

    A child table holds its parent's key as ``<parent>_fk``; a parent's own key is ``<table>_pk``, that of the main
    layer ``fid``.
    """

    def __init__(self, spark: SparkSession, path: str):
        with Geopackage(spark, path) as g:
            there = set(g.layers()) | {r[0] for r in g.db.execute("select name from sqlite_master where type = 'table'")}
            if CPT_TABLES[0] not in there:
                raise ValueError(f"{path} has no layer {CPT_TABLES[0]}")
            self.tables = {t: g.read_table(t) for t in CPT_TABLES if t in there}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in CPT_TABLES:
            raise KeyError(f"{name} is no table; there are {', '.join(CPT_TABLES)}")
        return self.tables[name]

    @property
    def surveys(self) -> DataFrame:
        """The main layer, without its geometry blob."""
        return self[CPT_TABLES[0]].drop("geom")

    def with_child(self, parent: DataFrame, parent_name: str, child_name: str) -> DataFrame:
        """parent joined with the rows of a child table; columns of both names come from the parent."""
        key = "fid" if parent_name == CPT_TABLES[0] else f"{parent_name}_pk"
        child = self[child_name]
        child = child.select(col(f"{parent_name}_fk").alias("_fk"), *[col(c) for c in child.columns if c not in (*parent.columns, "geom", f"{parent_name}_fk")])
        return parent.join(child, parent[key] == F.col("_fk")).drop("_fk")

    def select_location_info(self) -> DataFrame:
        """A survey's delivered positioning, reference system and coordinates, a row a point."""
        out, before = self.surveys.select("fid"), CPT_TABLES[0]
        for name in CPT_TABLES[1:4]:
            out, before = self.with_child(out, before, name), name
        return out.select("fid", "horizontal_positioning_date", "horizontal_positioning_method", "crs", "x_or_lon", "y_or_lat")


def read_geoparquet(spark: SparkSession, path: str) -> DataFrame:
    """A GeoParquet table with its geometries as WKB, and for points their coordinates x and y (null for others)."""
    df = spark.read.parquet(path)
    name = next((c for c, t in df.dtypes if t == "binary" and c.lower() in ("geometry", "geom")), None)
    if name is None:
        raise ValueError(f"{path} has no column of geometries")
    x, y = wkb_point(col(name))
    return df.withColumns({k: v for k, v in (("x", x), ("y", y)) if k not in df.columns})


def read_collection_geopackage(spark: SparkSession, path: str, crs: int | None = None, vertical_datum: int | None = None) -> Collection:
    with Geopackage(spark, path) as g:
        head, data = (t.drop("fid", "geom") for t in (g.read_table("header"), g.read_table("data")))
        srs = g.db.execute("select srs_id from gpkg_contents where table_name = 'header'").fetchone()
    return Collection(head, data, crs=crs or (srs and srs[0]), vertical_datum=vertical_datum)

