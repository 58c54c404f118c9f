"""Layers in files: GeoJSON lines, ASCII grids, folders of dated layers; and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "features array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(source, feature, part, seq, x, y, properties) of all line parts in GeoJSON files.

    Multi-part lines become parts; other geometries and nulls are dropped.
    """
    raw = spark.read.option("multiLine", True).schema(FEATURES).json(path).withColumn("source", F.col("_metadata.file_name"))
    rows = raw.select("source", F.posexplode("features").alias("feature", "f")).filter(F.col("f.geometry.type").isin("LineString", "MultiLineString"))
    one = F.array(F.from_json("f.geometry.coordinates", "array<array<double>>"))
    many = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    parts = rows.select("source", "feature", F.col("f.properties").alias("properties"), F.posexplode(F.when(F.col("f.geometry.type") == "LineString", one).otherwise(many)).alias("part", "line"))
    nodes = parts.select("source", "feature", "part", "properties", F.posexplode("line").alias("seq", "c"))
    return nodes.select("source", "feature", "part", "seq", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"), "properties")


def lines_as_features(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One GeoJSON feature text for each line of nodes (keys, seq, x, y)."""
    packed = nodes.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda a: F.array(a["x"], a["y"])).alias("coordinates"))
    return packed.select(*keys, F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*keys).alias("properties"), geometry.alias("geometry"))).alias("feature"))


def write_features(nodes: DataFrame, keys: list[str], path: str) -> None:
    """Lines as text files of one feature a line, which any part of a cluster can write."""
    lines_as_features(nodes, keys).select("feature").write.mode("overwrite").text(path)


def write_layers(nodes: DataFrame, layer: str, keys: list[str], path: str) -> None:
    """Lines of nodes (layer, keys, seq, x, y) as GeoJSON features, one file for each layer, named after it.

    Spark writes a folder for each layer; its file is then moved to its name,
    on the store itself.  There are as many moves as layers.
    """
    spark = nodes.sparkSession
    rows = lines_as_features(nodes, [layer, *keys]).select(F.col(layer).alias("layer"), "feature")
    rows.repartition("layer").write.mode("overwrite").partitionBy("layer").text(f"{path}/.parts")
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in store.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/.parts")):
        name = folder.getPath().getName()
        if name.startswith("layer="):
            parts = sorted((f.getPath() for f in store.listStatus(folder.getPath())), key=lambda p: p.getName())
            for i, part in enumerate(p for p in parts if p.getName().startswith("part-")):
                store.rename(part, jvm.org.apache.hadoop.fs.Path(root, name.removeprefix("layer=") + (f"-{i}" if i else "") + ".geojson"))
    store.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/.parts"), True)


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    """(source, properties, seq, x, y) of the nodes of all layers of a folder; ``source`` is the name of the file that held them.

    Files hold a GeoJSON feature a line, as ``write_layers`` makes them.
    """
    rows = spark.read.schema("properties map<string, string>, geometry struct<type: string, coordinates: array<array<double>>>").json(f"{path}/*.geojson")
    # Names come as in a URL, in which a plus sign is one.
    source = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    nodes = rows.filter("geometry.type = 'LineString'").select(source.alias("source"), "properties", F.posexplode("geometry.coordinates").alias("seq", "c"))
    return nodes.select("source", "properties", "seq", F.col("c")[0].alias("x"), F.col("c")[1].alias("y"))


def base_name(path: Column) -> Column:
    """The name of a file without folder and ending."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def write_as_named(rows: DataFrame, path: str, nested: str) -> DataFrame:
    """``rows`` written in the form that ``path`` ends in, and read back: ``.csv`` flat, ``.json`` as they are, ``.parquet``.

    A flat form has no room for the array ``nested``; its items become rows.
    """
    form = path.rsplit(".", 1)[-1]
    if form == "csv":
        rows = rows.select(*[c for c in rows.columns if c != nested], F.explode(nested).alias("_i")).select("*", "_i.*").drop("_i")
    elif form not in ("json", "parquet"):
        raise ValueError(f"no such form: {form}")
    rows.write.mode("overwrite").format(form).save(path)
    return rows.sparkSession.read.schema(rows.schema).format(form).load(path)


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """Cells (tile, row_ix, col_ix, x, y, z) of ASCII grids; cells without data are dropped.

    The header has six named numbers, then one text line for each row.  Grids
    with rows and columns of unequal size can't be written in this format.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("tile"), F.split("value", r"\r?\n").alias("rows"))
    number = lambda i: F.element_at(F.split(F.trim(F.col("rows")[i]), r"\s+"), 2).cast("double")
    head = lines.select("tile", number(0).alias("ncols"), number(1).alias("nrows"), number(2).alias("xll"), number(3).alias("yll"), number(4).alias("res"), number(5).alias("nodata"), F.posexplode(F.slice("rows", 7, 1_000_000)).alias("row_ix", "text"))
    cells = head.filter(F.length(F.trim("text")) > 0).select("*", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("col_ix", "v")).withColumn("z", F.col("v").cast("double"))
    return cells.filter(F.col("z") != F.col("nodata")).select("tile", "row_ix", "col_ix", (F.col("xll") + (F.col("col_ix") + 0.5) * F.col("res")).alias("x"), (F.col("yll") + (F.col("nrows") - F.col("row_ix") - 0.5) * F.col("res")).alias("y"), "z")


def require(df: DataFrame, columns: list[str], unique: list[str] | None = None) -> DataFrame:
    """``df``, after a check of its columns and, if asked, of the uniqueness of a key."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    if unique and df.groupBy(*unique).count().filter("count > 1").limit(1).count():
        raise ValueError(f"not unique: {', '.join(unique)}")
    return df
