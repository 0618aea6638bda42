"""Client of a public survey register: search by box, fetch files by id. The transport is injected."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collection import Collection
from ..functions.crs import transform_coordinates
from ..functions.geometry import as_geometries
from .readers import XmlSchema, schema_of, surveys_of

BBox = tuple[float, float, float, float]
Transport = Callable[[str, str, bytes | None], bytes]
MOST = 2000
OBJECT_TYPES = ("BHR-GT", "BHR-P", "BHR-G", "CPT", "SFR")
#: What is read of an object: its type in the register and the kind of its files' schema.
READS = {"BHR-GT": ("BHR-GT", "bhrgt"), "BHR-GT-samples": ("BHR-GT", "bhrgt_samples"), "BHR-P": ("BHR-P", "bhrp"), "BHR-G": ("BHR-G", "bhrg"), "CPT": ("CPT", "cpt"), "SFR": ("SFR", "sfr")}


def box_request(box: BBox) -> bytes:
    """The search body for a box of longitudes and latitudes."""
    corners = {"lowerCorner": {"lon": box[0], "lat": box[1]}, "upperCorner": {"lon": box[2], "lat": box[3]}}
    return json.dumps({"area": {"boundingBox": corners}}).encode()


def bounds(geometry, buffer: float | None = None) -> BBox:
    """The box around geometries, wider by a buffer on each side."""
    shapes = as_geometries(geometry)
    points = [p for g in shapes for p in [*g.points, *(q for path in g.paths for q in path), *(q for a in g.polygons for ring in a.rings for q in ring)]]
    (x0, x1), (y0, y1) = ((min(v), max(v)) for v in zip(*((p[0], p[1]) for p in points)))
    far = buffer or 0
    return x0 - far, y0 - far, x1 + far, y1 + far


def degrees_box(spark: SparkSession, box: BBox, crs: int) -> BBox:
    """The box of longitudes and latitudes around a box in another reference system."""
    corners = spark.createDataFrame([(float(x), float(y)) for x in box[::2] for y in box[1::2]], "x double, y double").withColumn("nr", F.lit(0))
    there = transform_coordinates(corners, crs, 4326).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    return tuple(there)


class RegisterClient:
    """transport(method, url, body) returns the answer's bytes."""

    def __init__(self, base: str, transport: Transport):
        self.base, self.transport = base.rstrip("/"), transport

    def _check(self, object_type: str) -> str:
        if object_type not in OBJECT_TYPES:
            raise ValueError(f"no object type {object_type!r}; there are {', '.join(OBJECT_TYPES)}")
        return object_type.lower().replace("-", "")

    def search(self, object_type: str, box: BBox) -> list[str]:
        """Ids of the surveys in a box; where there are more than one answer may hold, slices of the box are searched."""
        kind = self._check(object_type)
        answer = self.transport("POST", f"{self.base}/{kind}/v1/characteristics/searches", box_request(box)).decode()
        total = re.search(r"numberOfDocuments>\s*(\d+)", answer)
        if total and int(total[1]) > MOST:
            parts = -(-int(total[1]) // MOST) + 1
            step = (box[2] - box[0]) / parts
            found = [i for k in range(parts) for i in self.search(object_type, (box[0] + k * step, box[1], box[0] + (k + 1) * step, box[3]))]
            return list(dict.fromkeys(found))
        return list(dict.fromkeys(re.findall(r"broId>\s*([A-Z]{3}\d+)\s*<", answer)))

    def objects(self, object_type: str, ids: list[str]) -> Iterator[tuple[str, bytes]]:
        kind = self._check(object_type)
        for i in ids:
            yield i, self.transport("GET", f"{self.base}/{kind}/v1/objects/{i}", None)

    def fetch(self, spark: SparkSession, object_type: str, ids: list[str], parts: int = 8) -> DataFrame:
        """(id, content): files fetched on the executors, some ids a task. The transport must be picklable."""
        self._check(object_type)

        def get(it):
            import pandas as pd

            for pdf in it:
                yield pd.DataFrame(list(self.objects(object_type, list(pdf["id"]))), columns=["id", "content"])

        return spark.createDataFrame([(i,) for i in ids], "id string").repartition(parts).mapInPandas(get, "id string, content binary")

    def read(
        self,
        spark: SparkSession,
        object_type: str,
        ids: str | list[str] | None = None,
        crs: int = 28992,
        bbox: BBox | None = None,
        geometry=None,
        buffer: float | None = None,
        schema: XmlSchema | None = None,
        parts: int = 8,
    ) -> Collection:
        """The surveys of these ids, or of the box (around the geometry and its buffer) in crs, as a collection in crs."""
        if object_type not in READS:
            raise ValueError(f"can't read {object_type!r}; there are {', '.join(READS)}")
        registered, kind = READS[object_type]
        if ids is None:
            if bbox is None and geometry is None:
                raise ValueError("give ids, a box or a geometry")
            box = tuple(bbox) if bbox is not None else bounds(geometry, buffer)
            ids = self.search(registered, degrees_box(spark, box, crs))
        ids = [ids] if isinstance(ids, str) else list(ids)
        files = self.fetch(spark, registered, ids, parts).withColumnRenamed("id", "path")
        return surveys_of(files, schema or schema_of(kind), crs=crs)
