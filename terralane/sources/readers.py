"""Scans of manifests, graphs, ground truth, regions, annotations, diagnostics and rasters; sinks for graphs and tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geom

POINT = "struct<x:double,y:double>"


def scene_of(path: Column) -> Column:
    """The file name without its ending."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]+)?$", 1)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True).withColumn("scene_id", scene_of(F.input_file_name()))


def read_graphs(spark: SparkSession, path: str, mode: str = "explicit") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, audit) of graph files, one file a scene.

    Nodes stand under nodes_rc as [row, column] or under nodes as [x, y] or {id, x, y}; which one is what names the axis
    order, and a file with neither or both is refused in the audit. Edges name their ends source, target or u, v, or are pairs; a
    polyline under coordinates, polyline or geometry is taken from the first end to the second, else the segment stands.
    Coordinates that aren't finite are refused. explicit: only plain pairs and nodes_rc or nodes; tolerant: all forms.
    """
    edge = "struct<source:bigint,target:bigint,u:bigint,v:bigint,coordinates:array<array<double>>,polyline:array<array<double>>,geometry:array<array<double>>,confidence:double,score:double>"
    if mode == "explicit":
        raw = _json(spark, path, "nodes_rc array<array<double>>, nodes array<array<double>>, edges array<array<bigint>>")
    else:
        raw = _json(spark, path, f"nodes_rc array<array<double>>, nodes array<struct<id:bigint,x:double,y:double>>, edges array<{edge}>")
    both = F.col("nodes_rc").isNotNull() & F.col("nodes").isNotNull()
    error = F.when(both, "two axis orders").when(F.col("nodes_rc").isNull() & F.col("nodes").isNull(), "axis order not declared")
    raw = raw.withColumn("error", error)
    good = raw.where("error is null")
    rc = good.where("nodes_rc is not null").select("scene_id", F.posexplode("nodes_rc").alias("ord", "p")).select("scene_id", F.col("ord").cast("long").alias("id"), "ord", F.col("p")[1].alias("x"), F.col("p")[0].alias("y"))
    xy = good.where("nodes is not null").select("scene_id", F.posexplode("nodes").alias("ord", "p"))
    xy = xy.select("scene_id", F.col("ord").cast("long").alias("id"), "ord", F.col("p")[0].alias("x"), F.col("p")[1].alias("y")) if mode == "explicit" else xy.select("scene_id", F.coalesce("p.id", F.col("ord").cast("long")).alias("id"), "ord", "p.x", "p.y")
    nodes = rc.unionByName(xy)
    wrong = F.col("x").isNull() | F.col("y").isNull() | F.isnan("x") | F.isnan("y") | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf"))
    infinite = nodes.where(wrong).select("scene_id").distinct().withColumn("error", F.lit("coordinates not finite"))
    audit = raw.select("scene_id", "error").where("error is not null").unionByName(infinite)
    nodes = nodes.join(infinite.select("scene_id"), "scene_id", "left_anti")
    e = good.select("scene_id", F.posexplode("edges").alias("ord", "e"))
    if mode == "explicit":
        e = e.select("scene_id", "ord", F.col("e")[0].alias("u"), F.col("e")[1].alias("v"), F.lit(None).cast(f"array<{POINT}>").alias("line"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("double").alias("score"))
    else:
        line = F.coalesce("e.coordinates", "e.polyline", "e.geometry")
        e = e.select("scene_id", "ord", F.coalesce("e.source", "e.u").alias("u"), F.coalesce("e.target", "e.v").alias("v"), F.transform(line, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("line"), "e.confidence", "e.score")
    p = nodes.select("scene_id", "id", F.struct("x", "y").alias("p"))
    e = e.join(p.withColumnsRenamed({"id": "u", "p": "pu"}), ["scene_id", "u"]).join(p.withColumnsRenamed({"id": "v", "p": "pv"}), ["scene_id", "v"])
    poly = F.when(F.size("line") > 1, geom.oriented(F.col("line"), F.col("pu.x"), F.col("pu.y"))).otherwise(F.array("pu", "pv"))
    # ends are exchanged so that u is the lesser one, and the polyline with them
    e = e.withColumn("poly", poly).withColumn("polyline", F.when(F.col("u") > F.col("v"), F.reverse("poly")).otherwise(F.col("poly")))
    edges = e.select("scene_id", "ord", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "polyline", geom.arc_length(F.col("polyline")).alias("length"), "confidence", "score")
    return nodes, edges, audit


def read_nav_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with polylines, weighted by arc length."""
    nodes, edges, _ = read_graphs(spark, path, "tolerant")
    return nodes, edges.withColumn("weight", F.col("length"))


def read_cvat(spark: SparkSession, path: str, label: str = "path") -> DataFrame:
    """(scene_id, line_id, width, height, points) of the polylines of a label; lines with fewer than two points are dropped."""
    line = "struct<_label:string,_points:string>"
    images = spark.read.format("xml").option("rowTag", "image").schema(f"_name string, _width long, _height long, polyline array<{line}>").load(path)
    rows = images.select(scene_of(F.col("_name")).alias("scene_id"), F.col("_width").alias("width"), F.col("_height").alias("height"), F.posexplode("polyline").alias("line_id", "l")).where(F.col("l._label") == label)
    points = F.transform(F.split("l._points", ";"), lambda p: F.struct(F.split(p, ",")[0].cast("double").alias("x"), F.split(p, ",")[1].cast("double").alias("y")))
    return rows.select("scene_id", "line_id", "width", "height", points.alias("points")).where(F.size("points") > 1)


def read_gt(spark: SparkSession, path: str, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """(nodes and edges of the accepted scenes as one table of files, rejects): reviewed ground-truth graphs.

    A file passes when its frame is the given size, it is human-reviewed and complete, its node ids are unique and inside
    the image, and each edge's polyline ends within 1e-4 of its nodes.
    """
    schema = "annotation_status string, coverage_complete boolean, image_size array<int>, nodes array<struct<id:bigint,x:double,y:double>>, edges array<struct<source:bigint,target:bigint,polyline:array<array<double>>>>"
    raw = _json(spark, path, schema)
    ids = F.transform("nodes", lambda n: n["id"])
    outside = F.exists("nodes", lambda n: (n["x"] < 0) | (n["y"] < 0) | (n["x"] >= width) | (n["y"] >= height))
    node = lambda i: F.filter("nodes", lambda n: n["id"] == i)[0]
    off = lambda p, n: F.coalesce(geom.distance(p[0], p[1], n["x"], n["y"]) > 1e-4, F.lit(True))
    apart = F.exists("edges", lambda e: off(e["polyline"][0], node(e["source"])) | off(F.element_at(e["polyline"], -1), node(e["target"])))
    rules = [
        ((F.col("image_size")[0] != width) | (F.col("image_size")[1] != height) | F.col("image_size").isNull(), "frame"),
        (F.coalesce(F.col("annotation_status") != "human_reviewed", F.lit(True)), "not reviewed"),
        (~F.coalesce("coverage_complete", F.lit(False)), "not complete"),
        (F.size(F.array_distinct(ids)) != F.size(ids), "node ids repeat"),
        (outside, "node outside"),
        (apart, "edge ends off their nodes"),
    ]
    raw = raw.withColumn("errors", F.array_compact(F.array(*(F.when(c, n) for c, n in rules))))
    return raw.where(F.size("errors") == 0).drop("errors"), raw.where(F.size("errors") > 0).select("scene_id", "errors")


def discover_pairs(files: DataFrame, split: str, domain: str) -> tuple[DataFrame, DataFrame]:
    """(pairs, problems) of a file listing (path): images and masks of a split's domain folder met by file name."""
    at = F.regexp_extract("path", rf"{split}/{domain}/(images_png|masks_png)/([^/]+)\.png$", 1)
    name = F.regexp_extract("path", r"([^/]+)\.png$", 1)
    rows = files.withColumn("kind", at).where("kind <> ''").withColumn("id", name)
    image, mask = rows.where("kind = 'images_png'").select("id", F.col("path").alias("image")), rows.where("kind = 'masks_png'").select("id", F.col("path").alias("mask"))
    twice = image.groupBy("id").count().where("count > 1").select("id", F.lit("repeated id").alias("problem"))
    missing = image.join(mask, "id", "left_anti").select("id", F.lit("missing label").alias("problem")).distinct()
    return image.join(mask, "id"), twice.unionByName(missing)


def ingest_raster(files: DataFrame, layer: str, decode: Callable, tile: int = 256) -> DataFrame:
    """(scene_id, layer, tile_y, tile_x, h, w, values) of a binaryFile scan; decode(bytes) gives a 2-D array per file.

    8-bit values are divided by 255. A file that isn't two-dimensional or has values outside 0 to 1 is an error.
    """
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for scene, content in zip(pdf["scene_id"], pdf["content"]):
                a = np.asarray(decode(content))
                if a.ndim != 2:
                    raise ValueError(f"{scene}: {a.ndim} dimensions")
                a = a / 255.0 if a.dtype == np.uint8 else a.astype(float)
                if a.size and not (0 <= a.min() and a.max() <= 1):
                    raise ValueError(f"{scene}: values outside 0 to 1")
                for y in range(0, a.shape[0], tile):
                    for x in range(0, a.shape[1], tile):
                        part = a[y : y + tile, x : x + tile]
                        out.append((scene, layer, y // tile, x // tile, *part.shape, part.ravel().tolist()))
            yield pd.DataFrame(out, columns=["scene_id", "layer", "tile_y", "tile_x", "h", "w", "values"])

    rows = files.select(scene_of(F.col("path")).alias("scene_id"), "content")
    return rows.mapInPandas(run, "scene_id string, layer string, tile_y int, tile_x int, h int, w int, values array<double>")


def raster_cells(tiles: DataFrame, tile: int = 256) -> DataFrame:
    """(scene_id, layer, x, y, value) of raster tiles."""
    rows = tiles.select("scene_id", "layer", "tile_y", "tile_x", "w", F.posexplode("values").alias("i", "value"))
    return rows.select("scene_id", "layer", (F.col("tile_x") * tile + F.col("i") % F.col("w")).cast("long").alias("x"), (F.col("tile_y") * tile + F.floor(F.col("i") / F.col("w"))).cast("long").alias("y"), "value")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(id, split, units, frame, x0, y0, x1, y1)."""
    raw = spark.read.schema("regions array<struct<id:string,split:string,units:string,geographic_frame:string,bbox_xyxy:array<double>>>").json(path, multiLine=True)
    r = raw.select(F.explode("regions").alias("r"))
    return r.select("r.id", "r.split", "r.units", F.col("r.geographic_frame").alias("frame"), *(F.col("r.bbox_xyxy")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, source_type, validity, reasons, endpoint, selection, action): one row per source and endpoint, or per source without any."""
    label = "struct<selection:string,derived_action:string,candidate_rank:int>"
    record = f"struct<source_subgraph_id:string,source_type:string,component_validity:string,source_reason_codes:array<string>,endpoint_labels:map<string,{label}>>"
    raw = spark.read.text(path, wholetext=True)
    wrapped = F.when(F.substring(F.ltrim("value"), 1, 1) == "[", F.concat(F.lit('{"annotations":'), "value", F.lit("}"))).otherwise(F.col("value"))
    rows = raw.select(F.explode(F.from_json(wrapped, f"annotations array<{record}>")["annotations"]).alias("a"))
    rows = rows.select(F.col("a.source_subgraph_id").alias("source_id"), "a.source_type", F.col("a.component_validity").alias("validity"), F.col("a.source_reason_codes").alias("reasons"), F.explode_outer(F.map_entries("a.endpoint_labels")).alias("e"))
    return rows.select("source_id", "source_type", "validity", "reasons", F.col("e.key").alias("endpoint"), F.col("e.value.selection").alias("selection"), F.col("e.value.derived_action").alias("action"))


def segments_to_graph(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Draft graph of hand-drawn segments (scene_id, x0, y0, x1, y1): nodes are the distinct ends, loops and repeated pairs go."""
    from pyspark.sql.window import Window

    ends = segments.select("scene_id", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).distinct()
    nodes = ends.withColumn("id", (F.row_number().over(Window.partitionBy("scene_id").orderBy("p.x", "p.y")) - 1).cast("long")).select("scene_id", "id", "p.x", "p.y")
    at = lambda i, n: nodes.select("scene_id", F.col("id").alias(n), F.col("x").alias(f"x{i}"), F.col("y").alias(f"y{i}"))
    e = segments.join(at(0, "a"), ["scene_id", "x0", "y0"]).join(at(1, "b"), ["scene_id", "x1", "y1"]).where("a <> b")
    edges = e.select("scene_id", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().withColumn("status", F.lit("draft"))
    return nodes, edges


def read_diagnostics(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Per-case JSON files under experiment and model folders as one table with fixed columns; missing ones are null."""
    raw = spark.read.json(path, multiLine=True).withColumn("__p", F.input_file_name())
    have = set(raw.columns)
    return raw.select(F.regexp_extract("__p", r"([^/]+)/[^/]+/[^/]+$", 1).alias("experiment"), F.regexp_extract("__p", r"([^/]+)/[^/]+$", 1).alias("model"), scene_of(F.col("__p")).alias("image"), *(F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in columns))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """One JSON row per scene with its nodes, edges and metadata. A scene is the unit of a graph file and is gathered in one row."""
    n = nodes.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("nodes"))
    e = edges.groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("u", "v", "length"))).alias("edges"))
    out = n.join(e, "scene_id", "left").withColumns({k: F.lit(v) for k, v in (metadata or {}).items()})
    out.write.mode("overwrite").json(path)


def write_table(tables: Sequence[DataFrame], path: str, format: str = "csv") -> None:
    """Tables with different columns under the union of their columns."""
    df = tables[0]
    for other in tables[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    (df.write.mode("overwrite").option("header", True).csv(path) if format == "csv" else df.write.mode("overwrite").json(path))


def rescale(nodes: DataFrame, edges: DataFrame, sx: float, sy: float) -> tuple[DataFrame, DataFrame]:
    """Nodes and edge polylines in the original frame; lengths anew."""
    n = nodes.withColumn("x", F.col("x") * sx).withColumn("y", F.col("y") * sy)
    e = edges.withColumn("polyline", F.transform("polyline", lambda p: F.struct((p["x"] * sx).alias("x"), (p["y"] * sy).alias("y"))))
    return n, e.withColumn("length", geom.arc_length(F.col("polyline")))
