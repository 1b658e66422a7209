"""Readers and writers of spatial datasets; every reader takes paths that Spark can list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.schema import READS, normalise_columns

c = F.col


def read_reads_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return normalise_columns(spark.read.schema(READS).parquet(*paths))


def read_reads_csv(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Reads as CSV; gzip files are read as they are, and dealt out anew as they cannot be split."""
    out = normalise_columns(spark.read.schema(READS).csv(path, header=True, enforceSchema=False))
    return out.repartition(partitions) if partitions else out


def read_samples(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Reads of many samples in one scan, with the sample's name; paths are folders that hold Parquet."""
    raw = spark.read.schema(READS).parquet(*paths.values()).withColumn("__path", F.input_file_name())
    name = F.lit(None).cast("string")
    for sample, path in paths.items():
        name = F.when(F.contains("__path", F.lit(f"{path.rstrip('/')}/")), sample).otherwise(name)
    return normalise_columns(raw.withColumn("sample", name).drop("__path"))


def read_cells(spark: SparkSession, path: str, barcodes: DataFrame | None = None) -> DataFrame:
    """Cells from CSV or Parquet, only those with a barcode if barcodes (cell_id) are given."""
    out = spark.read.csv(path, header=True, inferSchema=True) if path.endswith((".csv", ".csv.gz")) else spark.read.parquet(path)
    out = out.withColumn("cell_id", c("cell_id").cast("string"))
    return out if barcodes is None else out.join(barcodes.select("cell_id"), "cell_id")


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(idx from 1, value) of the lines of a list file, which has one line per gene or cell and is not split by order."""
    lines = spark.sparkContext.textFile(path).zipWithIndex().map(lambda x: (x[1] + 1, x[0]))
    return spark.createDataFrame(lines, "idx long, value string")


def read_matrix_market(spark: SparkSession, matrix: str, features: str, barcodes: str) -> DataFrame:
    """Long counts (cell_id, feature_name, n) from a genes x cells MatrixMarket file and its two lists."""
    parts = F.split(F.trim("value"), r"\s+")
    body = spark.read.text(matrix).filter(~F.startswith("value", F.lit("%")))
    genes = _numbered_lines(spark, features).select(c("idx").alias("g"), F.split("value", "\t").alias("f"))
    genes = genes.select("g", F.coalesce(F.get("f", F.lit(1)), F.get("f", F.lit(0))).alias("feature_name"))
    cells = _numbered_lines(spark, barcodes).select(c("idx").alias("b"), c("value").alias("cell_id"))
    size = body.first()  # the first line that is no comment
    if size:
        # One such line goes; an entry may read like it, and is then put back.
        like_it = c("value") == size["value"]
        entries = body.filter(like_it).count() - 1
        body = body.filter(~like_it).unionByName(spark.range(entries).select(F.lit(size["value"]).alias("value")))
    kept = body.select(parts[0].cast("long").alias("g"), parts[1].cast("long").alias("b"), parts[2].cast("double").alias("n"))
    return kept.join(F.broadcast(genes), "g").join(cells, "b").select("cell_id", "feature_name", "n")


def read_panel_tsv(spark: SparkSession, path: str, genes: DataFrame | None = None) -> DataFrame:
    """Genes of a panel table; the name column is Gene, or Name where there is none.

    With ``genes`` (feature_name, ...) all of those, with the panel's columns and whether they are in it.
    """
    raw = spark.read.csv(path, sep="\t", header=True)
    name = "Gene" if "Gene" in raw.columns else "Name"
    panel = raw.withColumn("feature_name", c(name)).withColumn("in_panel", F.lit(True))
    if genes is None:
        return panel
    own = [x for x in panel.columns if x == "feature_name" or x not in genes.columns]
    return genes.join(panel.select(*own).dropDuplicates(["feature_name"]), "feature_name", "left").na.fill(False, ["in_panel"])


def read_panel_json(spark: SparkSession, path: str) -> DataFrame:
    """(feature_name, gene_id, reason): a missing id is newid_ and the position, a missing descriptor is 'other'."""
    raw = spark.read.json(path, multiLine=True).select(F.posexplode("payload.targets").alias("pos", "t"))
    fields = dict(raw.select("t.type.*").dtypes)
    data = raw.select("t.type.data.*").columns
    gene_id = c("t.type.data.id") if "id" in data else F.lit(None).cast("string")
    reason = c("t.type.descriptor") if "descriptor" in fields else F.lit(None).cast("string")
    return raw.select(
        c("t.type.data.name").alias("feature_name"),
        F.coalesce(gene_id, F.concat(F.lit("newid_"), c("pos").cast("string"))).alias("gene_id"),
        F.coalesce(reason, F.lit("other")).alias("reason"),
    )


def read_analysis(spark: SparkSession, cells: DataFrame, tables: dict[str, str]) -> DataFrame:
    """Cells with the columns of precomputed tables (name -> CSV with Barcode), each read from its own file."""
    out = cells
    for name, path in tables.items():
        t = spark.read.csv(path, header=True, inferSchema=True).withColumnRenamed("Barcode", "cell_id")
        t = t.withColumn("cell_id", c("cell_id").cast("string"))
        out = out.join(t.withColumnsRenamed({x: f"{name}_{x}" for x in t.columns if x != "cell_id"}), "cell_id", "left")
    return out


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Polygon vertices (cell_id, seq, x, y) in file order."""
    raw = spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)
    ordered = normalise_columns(raw, "boundaries").withColumn("__row", F.monotonically_increasing_id())
    seq = F.row_number().over(Window.partitionBy("cell_id").orderBy("__row")) - 1
    return ordered.withColumn("seq", seq).drop("__row")


def read_regions_json(spark: SparkSession, path: str) -> DataFrame:
    """Region vertices (region_annotation, region_general, poly_id, seq, x, y) from a list of name and coordinates."""
    schema = "name string, coordinates array<array<array<double>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("poly_id", F.monotonically_increasing_id())
    v = raw.select("name", "poly_id", F.posexplode(F.get("coordinates", F.lit(0))).alias("seq", "p"))
    return v.select(
        c("name").alias("region_annotation"),
        F.regexp_replace("name", r" \[\d+\]$", "").alias("region_general"),
        "poly_id",
        "seq",
        F.get("p", F.lit(0)).alias("x"),
        F.get("p", F.lit(1)).alias("y"),
    )


def read_regions_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True, inferSchema=True).withColumn("__row", F.monotonically_increasing_id())
    seq = F.row_number().over(Window.partitionBy("region_annotation").orderBy("__row")) - 1
    return raw.select("region_annotation", c("ID").alias("poly_id"), seq.alias("seq"), "x", "y")


def read_segmentation(spark: SparkSession, molecules: str, cell_stats: str) -> tuple[DataFrame, DataFrame]:
    """Counts and cells of an external segmentation, only cells that are in both files."""
    m = spark.read.csv(molecules, header=True, inferSchema=True).select(c("cell").cast("string").alias("cell_id"), c("gene").alias("feature_name"))
    s = spark.read.csv(cell_stats, header=True, inferSchema=True).withColumnRenamed("cell", "cell_id")
    s = s.withColumn("cell_id", c("cell_id").cast("string"))
    n = m.join(s.select("cell_id"), "cell_id", "left_semi").groupBy("cell_id", "feature_name").agg(F.count("*").alias("n"))
    return n, s.join(m.select("cell_id"), "cell_id", "left_semi")


def read_assignments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Molecules with null for no cell, and one row with the share of noise."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    noise = raw.agg(F.avg((c("cell") <= 0).cast("int")).alias("pct_noise"))
    return normalise_columns(raw, "assignments"), noise


def write_table(df: DataFrame, path: str, kind: str = "parquet", by_sample: bool = True) -> None:
    out = df.write.mode("overwrite")
    if by_sample and "sample" in df.columns:
        out = out.partitionBy("sample")
    out.option("header", True).format(kind).save(path)


def export_matrix(counts: DataFrame, genes: list[str], path: str) -> None:
    """A wide cell x gene CSV over an explicit gene list, for tools that need one."""
    wide = counts.groupBy("cell_id").pivot("feature_name", genes).agg(F.sum("n")).na.fill(0)
    wide.write.mode("overwrite").csv(path, header=True)


def filter_catalogue(catalogue: DataFrame, word: str, low: int = 10_000, high: int = 50_000) -> DataFrame:
    """Datasets whose title has the word, in any case, and whose number of cells lies strictly between the limits."""
    return catalogue.filter(F.contains(F.lower("title"), F.lit(word.lower())) & (c("n_cells") > low) & (c("n_cells") < high))
