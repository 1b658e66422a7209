"""Every reader and writer on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from cellweave import session
from cellweave.operators import spatial
from cellweave.schema import READS
from cellweave.sources import files


@pytest.fixture()
def put(tmp_path):
    def write(name, text):
        path = tmp_path / name
        path.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
        return str(path)

    return write


def test_reads_of_all_formats_agree(spark, put, tmp_path):
    rows = [("5", "g", 1.0, 1.5, 0.0, 30.0, 1, 0.0, "f"), ("-1", "h", 1.0, 1.0, 0.0, 10.0, 0, 2.0, "f")]
    frame = spark.createDataFrame(rows, READS)
    frame.write.parquet(str(tmp_path / "reads"))
    text = "\n".join([",".join(frame.columns), *(",".join(map(str, r)) for r in rows)])
    want = sorted(map(repr, files.read_reads_parquet(spark, str(tmp_path / "reads")).collect()))
    assert "cell_id=None" in want[0] + want[1]
    for name in ("r.csv", "r.csv.gz"):
        assert sorted(map(repr, files.read_reads_csv(spark, put(name, text), 2).collect())) == want


def test_cells_and_analysis(spark, put):
    cells = files.read_cells(spark, put("cells.csv", "cell_id,x\n1,2.5\n2,3.5\n3,4.5\n"), spark.createDataFrame([("1",), ("3",)], "cell_id string"))
    assert sorted(r.cell_id for r in cells.collect()) == ["1", "3"]
    out = files.read_analysis(spark, cells, {"k": put("k.csv", "Barcode,Cluster\n1,7\n2,8\n"), "p": put("p.csv", "Barcode,PC\n3,0.5\n")})
    assert {tuple(r) for r in out.select("cell_id", "k_Cluster", "p_PC").collect()} == {("1", 7, None), ("3", None, 0.5)}


def test_entry_that_reads_like_the_size_line(spark, put):
    lists = put("f.tsv", "id1\tG1\nid2\tG2\n"), put("b.tsv", "c1\nc2\n")
    m = files.read_matrix_market(spark, put("m.mtx", "%%MatrixMarket\n%\n2 2 2\n1 1 9\n2 2 2\n"), *lists)
    assert {tuple(r) for r in m.collect()} == {("c1", "G1", 9.0), ("c2", "G2", 2.0)}
    assert files.read_matrix_market(spark, put("n.mtx", "%%MatrixMarket\n2 2 0\n"), *lists).count() == 0


def test_panel_marks_genes(spark, put):
    path = put("panel.tsv", "Name\tAnnotation\nA\tneuron\nB\tglia\n")
    assert {r.feature_name for r in files.read_panel_tsv(spark, path).collect()} == {"A", "B"}
    genes = spark.createDataFrame([("A", 1), ("C", 2)], "feature_name string, n int")
    got = {(r.feature_name, r.n, r.Annotation, r.in_panel) for r in files.read_panel_tsv(spark, path, genes).collect()}
    assert got == {("A", 1, "neuron", True), ("C", 2, None, False)}


def test_polygons_regions_and_segmentation(spark, put):
    b = files.read_boundaries(spark, put("b.csv", "cell_id,vertex_x,vertex_y\n1,0,0\n1,1,0\n1,1,1\n2,5,5\n"))
    assert [r.seq for r in b.filter("cell_id = '1'").orderBy("seq").collect()] == [0, 1, 2]
    r = files.read_regions_csv(spark, put("r.csv", "region_annotation,ID,x,y\nT,1,0,0\nT,1,2,0\nU,2,1,1\n"))
    assert {tuple(x) for x in r.select("region_annotation", "poly_id", "seq").collect()} == {("T", 1, 0), ("T", 1, 1), ("U", 2, 0)}
    n, cells = files.read_segmentation(spark, put("m.csv", "cell,gene\n1,A\n1,A\n2,B\n9,B\n"), put("s.csv", "cell,area\n1,3.5\n2,4.5\n4,1\n"))
    assert {tuple(x) for x in n.collect()} == {("1", "A", 2), ("2", "B", 1)}
    assert {x.cell_id for x in cells.collect()} == {"1", "2"}


def test_writers_and_catalogue(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "sample string, n int")
    for kind in ("parquet", "csv"):
        files.write_table(df, str(tmp_path / kind), kind)
        back = spark.read.option("header", True).format(kind).load(str(tmp_path / kind))
        assert {(r["sample"], int(r.n)) for r in back.collect()} == {("a", 1), ("b", 2)}
        assert (tmp_path / kind / "sample=a").is_dir()
    listed = spark.createDataFrame([("Mouse BRAIN", 20_000), ("brain", 10_000), ("liver", 20_000)], "title string, n_cells int")
    assert [r.title for r in files.filter_catalogue(listed, "Brain").collect()] == ["Mouse BRAIN"]


def test_small_first_radius_loses_nothing(spark):
    points = spark.createDataFrame([(0, k, 100.0 * k, 0.0) for k in range(12)], "sample int, id long, x double, y double")
    near = spatial.nearest_neighbours(points, 2, radius=1.0)
    assert near.groupBy("src").agg(F.count("*").alias("n")).filter("n = 2").count() == 12


def test_shared_folder_is_not_local_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return "yarn" if key == "spark.master" else default

    class Session:
        conf = Conf()

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
