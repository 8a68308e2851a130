"""Reading and writing the tables, JSON documents and vectors the operators use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars as S
from ..operators.ranking import dense_row_number

ID_NAMES = ("cell_id", "Barcode", "barcode")
X_NAMES = ("x_centroid", "cell_centroid_x", "x")
Y_NAMES = ("y_centroid", "cell_centroid_y", "y")
# Ordered places of a cluster table below a dataset root
CLUSTER_TABLES = (
    "analysis/clustering/gene_expression_graphclust/clusters.csv",
    "analysis/analysis/clustering/gene_expression_graphclust/clusters.csv",
)

# Media types of the formats in use
MEDIA_TYPES = {
    "json": "application/json", "csv": "text/csv", "tsv": "text/tab-separated-values", "txt": "text/plain",
    "html": "text/html", "md": "text/markdown", "png": "image/png", "tif": "image/tiff", "geojson": "application/geo+json",
    "parquet": "application/vnd.apache.parquet", "jsonl": "application/jsonl",
}


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, tab separated for ``.tsv``/``.tab``; every column is text."""
    sep = "\t" if path.lower().rsplit(".", 1)[-1] in ("tsv", "tab") else ","
    return spark.read.csv(path, header=True, sep=sep, quote='"', escape='"', multiLine=True, encoding="UTF-8")


def read_cells(spark: SparkSession, path: str, id_names=ID_NAMES, x_names=X_NAMES, y_names=Y_NAMES) -> DataFrame:
    """Cell coordinates with column aliases resolved; only three columns are scanned."""
    df = spark.read.parquet(path)
    cid = S.pick_column(df, id_names, required="cell id")
    x = S.pick_column(df, x_names, required="x coordinate")
    y = S.pick_column(df, y_names, required="y coordinate")
    return df.select(F.col(cid).alias("cell_id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def find_cluster_table(spark: SparkSession, root: str) -> str:
    """Path of the preferred cluster table below ``root``."""
    listed = _list_files(spark, root, "clusters.csv")
    path = F.regexp_replace("path", "^file:/*", "/")
    rank = F.lit(None).cast("int")
    for i, name in reversed(list(enumerate(CLUSTER_TABLES))):
        rank = F.when(path.endswith("/" + name), i).otherwise(rank)
    generic = path.rlike(r"/analysis/(.*/)?clustering/[^/]+/clusters\.csv$")
    ranked = listed.select(path.alias("path"), F.coalesce(rank, F.when(generic, len(CLUSTER_TABLES))).alias("rank"))
    hit = ranked.filter("rank IS NOT NULL").orderBy("rank", "path").first()
    if hit is None:
        raise FileNotFoundError(f"no clusters.csv below {root}")
    return hit["path"]


def _list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below ``root`` without their bytes (content is pruned from the scan)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
            .load(root).select("path", "length", "modificationTime"))


def name_features(df: DataFrame, name: str = "name", id_: str = "id", row: str = "row") -> DataFrame:
    """Feature name, else its id, else ``feature_{row}``, as column ``gene``."""
    return df.withColumn("gene", F.coalesce(F.col(name), F.col(id_).cast("string"),
                                            F.concat(F.lit("feature_"), F.col(row).cast("string"))))


def read_geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: ``feature_no, contour_id, properties, geometry type and coordinates``.

    A collection without features fails the job.
    """
    schema = ("type string, features array<struct<type: string, id: string, properties: map<string,string>, "
              "geometry: struct<type: string, coordinates: string>>>")
    doc = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("c"))
    features = F.when(F.size(F.col("c.features")) > 0, F.col("c.features")).otherwise(
        F.raise_error(F.concat(F.lit("no features in "), "file")).cast("array<struct<type: string, id: string, "
                      "properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"))
    rows = doc.select("file", F.posexplode(features).alias("i", "f"))
    props = F.coalesce(F.col("f.properties"), F.create_map().cast("map<string,string>"))
    named = [F.nullif(props[k], F.lit("")) for k in ("name", "polygon_id", "id")]
    return rows.select("file", (F.col("i") + 1).alias("feature_no"),
                       F.coalesce(*named, F.concat(F.lit("contour_"), (F.col("i") + 1).cast("string"))).alias("contour_id"),
                       props.alias("properties"), F.col("f.geometry.type").alias("geometry_type"),
                       F.col("f.geometry.coordinates").alias("coordinates"))


def geojson_vertices(features: DataFrame) -> DataFrame:
    """Feature geometry as vertices ``(contour_id, part, ring, seq, x, y)``; ring 0 is the outline."""
    as_polygon = F.from_json("coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("geometry_type") == "MultiPolygon", F.from_json("coordinates", "array<array<array<array<double>>>>")) \
        .otherwise(F.array(as_polygon))
    return (features.select("contour_id", F.posexplode(parts).alias("part", "p"))
            .select("contour_id", "part", F.posexplode("p").alias("ring", "r"))
            .select("contour_id", "part", "ring", F.posexplode("r").alias("seq", "v"))
            .select("contour_id", "part", "ring", "seq", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")))


def json_objects(df: DataFrame, line: str, schema: str) -> DataFrame:
    """Keep rows whose text is a JSON object, parsed as ``record``."""
    v = F.try_parse_json(F.col(line))
    return (df.filter(v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"))
            .withColumn("record", F.from_json(line, schema)))


def read_evidence_jsonl(spark: SparkSession, path: str, schema: str, max_records: int | None = None) -> DataFrame:
    """JSON objects among the first ``max_records`` lines (bad lines count), files in the order of their names."""
    lines = spark.read.text(path)
    if max_records is not None:
        # ids rise along a split, and splits are told apart by where they start
        placed = lines.select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("_line"))
        lines = placed.orderBy("file_path", "file_block_start", "_line").limit(max_records).select("value")
    return json_objects(lines, "value", schema).select("record.*")


def read_first_json(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """The first of ``names`` that exists in ``folder`` and holds a JSON object (0 or 1 row)."""
    docs = (spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
            .select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("name"), F.col("value").alias("doc")))
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("name"))
    v = F.try_parse_json("doc")
    return (docs.filter(F.col("name").isin(*names) & v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT"))
            .orderBy(order).limit(1))


def read_embeddings(spark: SparkSession, path: str, column: str = "vector") -> DataFrame:
    """Vectors as ``ARRAY<DOUBLE>`` so that sums do not lose precision."""
    df = spark.read.parquet(path)
    return df.withColumn("vector", F.col(column).cast("array<double>"))


def batch_rows(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """Add ``batch_id``: consecutive batches of ``n`` rows in the given order."""
    return (dense_row_number(df, order, "_rn").withColumn("batch_id", F.floor((F.col("_rn") - 1) / n).cast("bigint"))
            .drop("_rn"))


def union_tables(*frames: DataFrame) -> DataFrame:
    """Rows of all frames under the union of their columns, missing text as ``""``."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.fillna("")


def write_table(df: DataFrame, path: str) -> dict[str, str]:
    """The same rows as ``{path}/csv`` and ``{path}/json``; nested columns go to CSV as JSON text."""
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
    flat.write.mode("errorifexists").csv(f"{path}/csv", header=True, emptyValue="", quote='"', escape='"')
    df.write.mode("errorifexists").json(f"{path}/json")
    return {"csv": f"{path}/csv", "json": f"{path}/json"}


def write_cells(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").parquet(path)
    return path


def file_inventory(spark: SparkSession, root: str, hash_below: int | None = None, glob: str = "*") -> DataFrame:
    """Files below ``root``: size, SHA-256, media type, one row per path.

    With ``hash_below`` bigger files get no hash. The bytes are hashed where they are
    read; files above the limit are listed without reading their content.
    """
    files = _list_files(spark, root, glob)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    if hash_below is not None:
        content = content.filter(F.col("length") <= hash_below)
    hashed = content.select("path", F.sha2("content", 256).alias("sha256"))
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    known = F.create_map(*[F.lit(v) for kv in MEDIA_TYPES.items() for v in kv])
    media = F.coalesce(known[ext], F.lit("application/octet-stream"))
    return (files.join(hashed, "path", "left").dropDuplicates(["path"])
            .select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size_bytes"),
                    "sha256", media.alias("media_type"), "modificationTime"))
