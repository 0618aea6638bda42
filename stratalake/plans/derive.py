"""Survey and voxel relations derived from the driver's tables; all depths are multiples of 1/8, so that sums are exact."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.voxel import VoxelModel


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layered surveys: one an order, a layer a line. The join and the window share the exchange on the order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    down = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    deep = F.sum("l_quantity").over(down)
    size = F.col("p_size")
    return rows.select(
        F.col("l_orderkey").alias("nr"),
        (F.col("o_custkey") % 64).cast("double").alias("x"),
        (F.col("o_custkey") % 48).cast("double").alias("y"),
        ((F.col("o_custkey") % 17).cast("double") / 4).alias("surface"),
        ((deep - F.col("l_quantity")) / 8).alias("top"),
        (deep / 8).alias("bottom"),
        F.when(size <= 12, "K").when(size <= 25, "Z").when(size <= 38, "V").otherwise("L").alias("lith"),
    )


def header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a survey with its end elevation, made from the layers' aggregates."""
    return layers(spark, sf_dir).groupBy("nr").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.first("surface").alias("surface"), (F.first("surface") - F.max("bottom")).alias("end"))


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discrete surveys: one a user, a measurement an event."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        user.alias("nr"),
        (user % 64).cast("double").alias("x"),
        (user % 48).cast("double").alias("y"),
        ((user % 13).cast("double") / 4).alias("surface"),
        (F.row_number().over(order).cast("double") * 0.25).alias("depth"),
        F.col("value").alias("qc"),
        F.col("event_type").alias("kind"),
    )


def voxel_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    e = F.col("e").cast("double")
    return cells.select(
        ((F.col("vec_id") % 25).cast("double") + 0.5).alias("x"),
        (F.floor(F.col("vec_id") / 25).cast("double") + 0.5).alias("y"),
        (F.col("pos").cast("double") * 0.5 - 31.75).alias("z"),
        F.when(e < -0.1, 1).when(e < 0.05, 2).when(e < 0.2, 3).alias("lith"),
    )


def voxels(spark: SparkSession, sf_dir: str) -> VoxelModel:
    return VoxelModel.from_table(voxel_cells(spark, sf_dir))


def tenth_cells(spark: SparkSession, sf_dir: str, z: str = "pos * 0.1D - 6.35D") -> DataFrame:
    """The cells on a grid of steps that are no binary fractions; z may be any ascending function of the position."""
    cells = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "e"))
    return cells.selectExpr(
        "vec_id % 25 * 0.1D + 0.05D as x",
        "cast(floor(vec_id / 25) as double) / 3D as y",
        f"{z} as z",
        "case when cast(e as double) < -0.1D then 1 when cast(e as double) < 0.05D then 2 when cast(e as double) < 0.2D then 3 end as code",
    )


SQL = {
    "layers": """layers as (
  select l.l_orderkey as nr, cast(o.o_custkey % 64 as double) as x, cast(o.o_custkey % 48 as double) as y,
         cast(o.o_custkey % 17 as double) / 4 as surface, ((sum(l.l_quantity) over w) - l.l_quantity) / 8 as top,
         (sum(l.l_quantity) over w) / 8 as bottom,
         case when p.p_size <= 12 then 'K' when p.p_size <= 25 then 'Z' when p.p_size <= 38 then 'V' else 'L' end as lith
  from lineitem l join orders o on l.l_orderkey = o.o_orderkey join part p on l.l_partkey = p.p_partkey
  window w as (partition by l.l_orderkey order by l.l_linenumber, l.l_partkey, l.l_suppkey rows between unbounded preceding and current row))""",
    "header": """header as (select nr, min(x) as x, min(y) as y, min(surface) as surface, min(surface) - max(bottom) as "end" from layers group by nr)""",
    "measurements": """measurements as (
  select user_id as nr, cast(user_id % 64 as double) as x, cast(user_id % 48 as double) as y, cast(user_id % 13 as double) / 4 as surface,
         cast(row_number() over (partition by user_id order by ts, event_id) as double) * cast(0.25 as double) as depth, value as qc, event_type as kind
  from events)""",
    "voxels": """voxels as (
  select cast(vec_id % 25 as double) + 0.5 as x, floor(vec_id / 25) + 0.5 as y, cast(pos as double) * 0.5 - 31.75 as z,
         case when e < -0.1 then 1 when e < 0.05 then 2 when e < 0.2 then 3 end as lith
  from (select vec_id, generate_subscripts(embedding, 1) - 1 as pos, cast(unnest(embedding) as double) as e from embeddings) t)""",
}
for _name, _z in (("tenths", "pos * 0.1::double - 6.35::double"), ("uneven", "pos * pos * 0.01::double - 40.3::double")):
    SQL[_name] = f"""{_name} as (
  select vec_id % 25 * 0.1::double + 0.05::double as x, floor(vec_id / 25)::double / 3::double as y, {_z} as z,
         case when e < -0.1 then 1 when e < 0.05 then 2 when e < 0.2 then 3 end as code
  from (select vec_id, (generate_subscripts(embedding, 1) - 1)::int as pos, cast(unnest(embedding) as double) as e from embeddings) t)"""


def with_relations(sql: str) -> str:
    """The SQL with the relations it names in front."""
    needed = [k for k in SQL if re.search(rf"\b(from|join) {k}\b|, {k}\b", sql)]
    if "header" in needed and "layers" not in needed:
        needed.insert(0, "layers")
    needed.sort(key=list(SQL).index)
    body = sql.strip()
    if not needed:
        return body
    more = body.startswith("with ")
    return "with " + ",\n".join(SQL[k] for k in needed) + (",\n" + body[5:] if more else "\n" + body)
