"""A header table and a data table of the same surveys, kept aligned by semi-joins."""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import crs as crs_
from .operators import header as header_
from .operators import layers, selection, spatial, validation
from .predicates import column_name_from
from .roles import Roles, col
from .storage import settled


class AlignmentWarning(UserWarning):
    """Header and data hold different surveys."""


def uppermost(roles: Roles) -> Column:
    """The surface of a survey's uppermost row, should its rows differ."""
    return F.min_by(col(roles.surface), F.struct(col(roles.top or roles.depth), col(roles.surface)))


@dataclass(frozen=True)
class Collection:
    """Immutable: every operation returns a new collection and stays lazy. Selections keep both tables aligned by
    construction; :meth:`check_alignment` and :meth:`align` run only when asked for."""

    header: DataFrame
    data: DataFrame
    crs: int | None = None
    vertical_datum: int | None = None
    has_inclined: bool = False

    def __post_init__(self) -> None:
        if self.data is None:
            raise ValueError("a collection needs a data table")
        if self.header is not None and Roles.of(self.header).nr != Roles.of(self.data).nr:
            raise KeyError("header and data must name the survey id alike")

    @classmethod
    def of(cls, data: DataFrame, include_in_header: list[str] | None = None, coordinate_names: tuple[str, str] | None = None, **meta) -> Collection:
        """A collection whose header is made from the data."""
        return cls(header_.to_header(data, include_in_header, coordinate_names), data, **meta)

    @property
    def nr(self) -> str:
        return Roles.of(self.data).nr

    def __len__(self) -> int:
        return self.header.count()

    @property
    def n_points(self) -> int:
        return len(self)

    @property
    def header_has_geometry(self) -> bool:
        return Roles.of(self.header).has_xy

    def __repr__(self) -> str:
        return f"Collection(header={self.header.columns}, data={self.data.columns}, crs={self.crs}, vertical_datum={self.vertical_datum})"

    def with_header(self, header: DataFrame) -> Collection:
        return replace(self, header=header)

    def with_data(self, data: DataFrame, validate: bool = False) -> Collection:
        return replace(self, data=validation.validate(data) if validate else data)

    def _data_like_header(self, header: DataFrame) -> Collection:
        return replace(self, header=header, data=self.data.join(header.select(self.nr), self.nr, "left_semi"))

    def _header_like_data(self, data: DataFrame) -> Collection:
        return replace(self, data=data, header=self.header.join(data.select(self.nr).distinct(), self.nr, "left_semi"))

    # Alignment

    def check_alignment(self) -> bool:
        """Whether both tables hold the same surveys; warns for each side that lacks some."""
        good = True
        for one, other, what in ((self.header, self.data, "header rows without data"), (self.data, self.header, "data without header rows")):
            if not one.join(other.select(self.nr).distinct(), self.nr, "left_anti").isEmpty():
                warnings.warn(what, AlignmentWarning, stacklevel=2)
                good = False
        return good

    def align(self) -> Collection:
        """Header rows of the surveys in data: those there are, with their added columns, and new ones for the others."""
        ids = self.data.select(self.nr).distinct()
        kept = self.header.join(ids, self.nr, "left_semi")
        roles = Roles.of(self.data)
        if not roles.has_xy:
            return replace(self, header=kept)
        missing = self.data.join(self.header.select(self.nr), self.nr, "left_anti")
        made = header_.to_header(missing, [c for c in self.header.columns if c in self.data.columns])
        return replace(self, header=kept.unionByName(made.select(*[c for c in made.columns if c in kept.columns]), allowMissingColumns=True))

    def reset_header(self) -> Collection:
        return self.align()

    def add_header_column_to_data(self, column: str) -> Collection:
        return replace(self, data=self.data.join(self.header.select(self.nr, col(column)), self.nr, "inner"))

    def get(self, values: Any, column: str | None = None) -> Collection:
        values = [values] if isinstance(values, (str, int, float)) else list(values)
        return self._data_like_header(self.header.where(col(column or self.nr).isin(*values)))

    # Selections

    def select_by_values(self, column: str, values: Any, how: str = "or", invert: bool = False, inclusive: str = "both") -> Collection:
        return self._header_like_data(selection.select_by_values(self.data, column, values, how, invert, inclusive))

    def slice_by_values(self, column: str, values: Any, invert: bool = False, inclusive: str = "both") -> Collection:
        return self._header_like_data(selection.slice_by_values(self.data, column, values, invert, inclusive))

    def select_by_condition(self, condition: Column, invert: bool = False) -> Collection:
        return self._header_like_data(selection.select_by_condition(self.data, condition, invert))

    def slice_depth_interval(self, upper: float | None = None, lower: float | None = None, **options) -> Collection:
        return self._header_like_data(selection.slice_depth_interval(self.data, upper, lower, **options))

    def _header_with_end(self) -> DataFrame:
        if Roles.of(self.header).end:
            return self.header
        roles = Roles.of(self.data)
        ends = self.data.groupBy(self.nr).agg((uppermost(roles) - F.max(col(roles.depth))).alias("end"))
        return self.header.join(ends, self.nr, "left")

    def select_by_elevation(self, top_min=None, top_max=None, end_min=None, end_max=None) -> Collection:
        return self._data_like_header(selection.select_by_elevation(self._header_with_end(), top_min, top_max, end_min, end_max).select(*map(col, self.header.columns)))

    def select_by_length(self, min_length=None, max_length=None) -> Collection:
        return self._data_like_header(selection.select_by_length(self._header_with_end(), min_length, max_length).select(*map(col, self.header.columns)))

    def select_within_bbox(self, xmin, ymin, xmax, ymax, invert: bool = False) -> Collection:
        return self._data_like_header(spatial.select_within_bbox(self.header, xmin, ymin, xmax, ymax, invert))

    def select_with_points(self, points, max_distance: float, invert: bool = False) -> Collection:
        return self._data_like_header(spatial.select_with_points(self.header, points, max_distance, invert))

    def select_with_lines(self, lines, max_distance: float, invert: bool = False) -> Collection:
        return self._data_like_header(spatial.select_with_lines(self.header, lines, max_distance, invert))

    def select_within_polygons(self, polygons, buffer: float = 0, invert: bool = False) -> Collection:
        return self._data_like_header(spatial.select_within_polygons(self.header, polygons, buffer, invert))

    def spatial_join(self, geometries, label_id: str, include_in_header: bool = False, drop_label_if_exists: bool = False, geometry_crs: int | None = None, **options):
        """The joined header, or with include_in_header a collection that keeps every survey.

        Geometries are taken to be in the collection's reference system, or are met in their own, with a warning.
        """
        if geometry_crs and self.crs and geometry_crs != self.crs:
            warnings.warn(f"the geometries are in EPSG:{geometry_crs}: points are brought there from EPSG:{self.crs} to be met", UserWarning, stacklevel=2)
            options |= {"crs": self.crs, "geometry_crs": geometry_crs}
        if include_in_header:
            if "how" in options:
                raise ValueError("how can't be chosen when the label goes into the header")
            return replace(self, header=spatial.spatial_join(self.header, geometries, label_id, "left", drop_label_if_exists, **options))
        return spatial.spatial_join(self.header, geometries, label_id, drop_label_if_exists=drop_label_if_exists, **options)

    # Depth analytics

    def determine_end_depth(self) -> DataFrame:
        roles = Roles.of(self.data)
        return self.data.groupBy(self.nr).agg((uppermost(roles) - F.max(col(roles.depth))).alias("end"))

    def _into_header(self, found: DataFrame, name: str, include: bool) -> DataFrame | Collection:
        if not include:
            return found
        return replace(self, header=self.header.join(found.withColumnRenamed(found.columns[-1], name), self.nr, "left"))

    def get_cumulative_thickness(self, column: str, values: Any, include_in_header: bool = False):
        return self._into_header(layers.cumulative_thickness(self.data, column, values), column_name_from(values, f"{column}[" if isinstance(values, slice) else "", "]_thickness" if isinstance(values, slice) else "_thickness"), include_in_header)

    def get_layer_top(self, column: str, values: Any, min_thickness: float | None = None, min_fraction: float | None = None, include_in_header: bool = False):
        return self._into_header(layers.layer_top(self.data, column, values, min_thickness, min_fraction), column_name_from(values, f"{column}[" if isinstance(values, slice) else "", "]_top" if isinstance(values, slice) else "_top"), include_in_header)

    def get_layer_base(self, column: str, values: Any, min_thickness: float = 0, include_in_header: bool = False):
        return self._into_header(layers.layer_base(self.data, column, values, min_thickness), column_name_from(values, f"{column}[" if isinstance(values, slice) else "", "]_base" if isinstance(values, slice) else "_base"), include_in_header)

    # Reference systems

    def set_crs(self, crs: int, allow_override: bool = False) -> Collection:
        if self.crs not in (None, crs) and not allow_override:
            raise ValueError(f"the collection is in EPSG:{self.crs}; use to_crs, or allow_override")
        return replace(self, crs=crs)

    def set_vertical_datum(self, datum: int) -> Collection:
        return replace(self, vertical_datum=datum)

    def to_crs(self, crs: int, xbot: str | None = None, ybot: str | None = None) -> Collection:
        if self.crs is None:
            raise ValueError("the collection has no reference system; use set_crs first")
        head = crs_.transform_coordinates(self.header, self.crs, crs)
        data = crs_.transform_coordinates(self.data, self.crs, crs, xbot, ybot) if Roles.of(self.data).has_xy else self.data
        return replace(self, header=head, data=data, crs=crs)

    def to_vertical_datum(self, datum: int) -> Collection:
        raise NotImplementedError("vertical transforms are not available")

    # Storage

    def settled(self) -> Collection:
        """Both tables computed once and checkpointed, for several operations on what took long to select."""
        return replace(self, header=settled(self.header), data=settled(self.data))

    def to_parquet(self, path: str, data_table: bool = True) -> None:
        (self.data if data_table else self.header).write.mode("overwrite").parquet(path)

    def to_csv(self, path: str, data_table: bool = True) -> None:
        (self.data if data_table else self.header).write.mode("overwrite").csv(path, header=True)

    def save(self, path: str) -> None:
        """Both tables as Parquet, and a manifest."""
        spark = self.data.sparkSession
        self.header.write.mode("overwrite").parquet(f"{path}/header")
        self.data.write.mode("overwrite").parquet(f"{path}/data")
        meta = json.dumps({"crs": self.crs, "vertical_datum": self.vertical_datum, "has_inclined": self.has_inclined})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Collection:
        meta = json.loads(spark.read.text(f"{path}/manifest").first().value)
        return cls(spark.read.parquet(f"{path}/header"), spark.read.parquet(f"{path}/data"), **meta)
