"""Rasters, frames and labels derived from the relational tables: in Spark, and as DuckDB common table expressions.

px: a raster 128 wide, whole rows only, from orders. frames: a positioned rectangle for each event. fpx: the pixels under each
frame, with a value that tells frames apart. lab: the raster as labelled objects in frames of 32 x 32; g is the object over
the whole raster, label its number in its frame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import floor_div
from tessera.operators.raster import pixels_in_frames

WIDTH, TILE = 128, 32

CTES = {
    "h": "select cast(floor(count(*) / 128.0) as bigint) as h from orders",
    "px": "select o_orderkey % 128 as x, o_orderkey // 128 as y, o_custkey % 251 as v from orders where o_orderkey // 128 < (select h from h)",
    "frames": "select event_id as frame_seq, (user_id * 37 + event_id * 11) % 112 as min_x, (user_id * 37 + event_id * 11) % 112 + event_id % 16 as max_x, (event_id * 29) % (select h from h) as min_y, (event_id * 29) % (select h from h) + user_id % 16 as max_y from events",
    "fpx": "select f.frame_seq, p.x, p.y, p.v + f.frame_seq as v from frames f join px p on p.x between f.min_x and f.max_x and p.y between f.min_y and f.max_y",
    "gg": "select (y // 32) * 4 + x // 32 as frame_seq, x, y, case when (x // 5 + y // 7) % 3 = 0 then 0 else (y // 7) * 1000 + x // 5 + 1 end as g from px",
    "lab": "select q.frame_seq, q.x, q.y, q.g, case when q.g = 0 then 0 else d.lbl end as label from gg q left join (select frame_seq, g, dense_rank() over (partition by frame_seq order by g) as lbl from (select distinct frame_seq, g from gg where g <> 0)) d on q.frame_seq = d.frame_seq and q.g = d.g",
    "labf": "select frame_seq, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y from lab group by frame_seq",
    "rois": "select s_suppkey as roi_index, (s_suppkey * 977) % 5003 as min_x, (s_suppkey * 977) % 5003 + 20 + s_nationkey * 7 as max_x, (s_suppkey * 613) % 4001 as min_y, (s_suppkey * 613) % 4001 + 30 + s_suppkey % 91 as max_y from supplier",
}
_NEEDS = {"h": [], "px": ["h"], "frames": ["h"], "fpx": ["px", "frames"], "gg": ["px"], "lab": ["gg"], "labf": ["lab"], "rois": []}


def with_views(sql: str, *names: str) -> str:
    """The statement after the expressions it needs."""
    order: list[str] = []

    def need(n: str) -> None:
        for m in _NEEDS[n]:
            need(m)
        if n not in order:
            order.append(n)

    for n in names:
        need(n)
    head = "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    return f"{head}, {sql[5:]}" if sql.lower().startswith("with ") else f"{head} {sql}"


class Views:
    """The same views as DataFrames; nothing is read before it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def height(self) -> int:
        """Rows of the raster, from the row count in the files' metadata."""
        return self.table("orders").count() // WIDTH

    @property
    def px(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").where(key < self.height * WIDTH).select((key % WIDTH).alias("x"), floor_div(key, F.lit(WIDTH)).alias("y"), (F.col("o_custkey") % 251).alias("v"))

    @property
    def frames(self) -> DataFrame:
        x, y = (F.col("user_id") * 37 + F.col("event_id") * 11) % 112, (F.col("event_id") * 29) % self.height
        return self.table("events").select(F.col("event_id").alias("frame_seq"), x.alias("min_x"), (x + F.col("event_id") % 16).alias("max_x"), y.alias("min_y"), (y + F.col("user_id") % 16).alias("max_y"))

    @property
    def fpx(self) -> DataFrame:
        return pixels_in_frames(self.px, self.frames, 16).select("frame_seq", "x", "y", (F.col("v") + F.col("frame_seq")).alias("v"))

    @property
    def gg(self) -> DataFrame:
        bx, by = floor_div("x", F.lit(5)), floor_div("y", F.lit(7))
        g = F.when((bx + by) % 3 == 0, 0).otherwise(by * 1000 + bx + 1)
        return self.px.select((floor_div("y", F.lit(TILE)) * 4 + floor_div("x", F.lit(TILE))).alias("frame_seq"), "x", "y", g.alias("g"))

    @property
    def lab(self) -> DataFrame:
        gg = self.gg
        names = gg.where("g <> 0").select("frame_seq", "g").distinct().withColumn("label", F.dense_rank().over(Window.partitionBy("frame_seq").orderBy("g")).cast("bigint"))
        return gg.join(names, ["frame_seq", "g"], "left").select("frame_seq", "x", "y", "g", F.coalesce("label", F.lit(0)).cast("bigint").alias("label"))

    @property
    def labf(self) -> DataFrame:
        return self.gg.groupBy("frame_seq").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))

    @property
    def rois(self) -> DataFrame:
        k = F.col("s_suppkey")
        x, y = (k * 977) % 5003, (k * 613) % 4001
        return self.table("supplier").select(k.alias("roi_index"), x.alias("min_x"), (x + 20 + F.col("s_nationkey") * 7).alias("max_x"), y.alias("min_y"), (y + 30 + k % 91).alias("max_y"))
