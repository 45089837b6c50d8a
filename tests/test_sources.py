"""Readers, format checks and extraction on temporary files."""

import bz2
import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.errors import PythonException

from quillcell.operators.filters import MatrixError
from quillcell.operators.reads import quality_encodings, quality_range
from quillcell.sources import archives, matrices, sinks, sniff, tables
from quillcell.sources.lines import broken_fastq, fastq, numbered_lines

TEXT = "cellid\tAAAC\tAAAG\nXist\t0\t3\nMt-1\t2\t0\n"
WANT = [("Mt-1", "AAAC", 2.0), ("Xist", "AAAG", 3.0)]


def save(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def rows(m):
    return sorted((r["gene"], r["cell"], r["value"]) for r in m.expr.collect())


@pytest.mark.parametrize("text", [
    TEXT, TEXT.replace("\t", ","), TEXT.replace("\t", " "), TEXT.replace("cellid\t", ""),
])
def test_header_and_delimiter_variants(spark, tmp_path, text):
    path = save(tmp_path, "m.txt", text)
    assert rows(matrices.read_delimited(spark, path, min_genes=1)) == WANT


def test_headerless_matrix_names_cells_by_position(spark, tmp_path):
    path = save(tmp_path, "m.txt", "Xist\t0\t3\n")
    assert rows(matrices.read_delimited(spark, path, header="no", min_genes=1)) == [("Xist", "cell2", 3.0)]


@pytest.mark.parametrize("line,want", [("a\tb", True), ("1\t2.5", False), ("-1\t2", True), ("1e3\t2", True), ("g\t1", True)])
def test_header_rule(line, want):
    assert sniff.is_header(line, "\t") is want


@pytest.mark.parametrize("text,message", [
    ("a\tc1\tc2\nX\t1\n Y\t1\t2\n", "number of fields"),
    ("a\tc1\tc2\nX\t1\t1\nX\t1\t2\n", "duplicated"),
    ("a\tc1\tc2\nX\t1\tfoo\n", "no numbers"),
])
def test_bad_matrices_are_refused(spark, tmp_path, text, message):
    with pytest.raises(MatrixError, match=message):
        matrices.read_delimited(spark, save(tmp_path, "m.txt", text), min_genes=1)


def test_duplicates_can_be_dropped(spark, tmp_path):
    path = save(tmp_path, "m.txt", "a\tc1\nX\t1\nX\t2\nY\t4\n")
    assert rows(matrices.read_delimited(spark, path, min_genes=1, on_duplicate="drop_all")) == [("Y", "c1", 4.0)]


def test_too_few_genes(spark, tmp_path):
    with pytest.raises(MatrixError, match="genes"):
        matrices.read_delimited(spark, save(tmp_path, "m.txt", TEXT), min_genes=3)


def zipped(*names):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in names:
            z.writestr(n, TEXT)
    return out.getvalue()


@pytest.mark.parametrize("name,data,kind", [
    ("m.txt", TEXT.encode(), "text"), ("m.gz", gzip.compress(TEXT.encode()), "gzip"), ("m.dat", gzip.compress(TEXT.encode()), "gzip"),
    ("m.bz2", bz2.compress(TEXT.encode()), "bzip2"), ("m2.dat", bz2.compress(TEXT.encode()), "bzip2"), ("m.zip", zipped("m.txt"), "zip"),
])
def test_containers(spark, tmp_path, name, data, kind):
    found, path = archives.unpack(spark, save(tmp_path, name, data))
    assert found == kind
    assert rows(matrices.read_delimited(spark, path, min_genes=1)) == WANT


def test_zip_with_two_members_empty_file_and_corrupt_gzip(spark, tmp_path):
    with pytest.raises(PythonException, match="exactly one"):
        archives.unpack(spark, save(tmp_path, "two.zip", zipped("a", "b")))
    with pytest.raises(MatrixError, match="empty"):
        archives.unpack(spark, save(tmp_path, "empty", b""))
    with pytest.raises(PythonException):
        archives.unpack(spark, save(tmp_path, "bad.dat", gzip.compress(TEXT.encode() * 50)[:-20]))


def test_binary_check(spark, tmp_path):
    broken = spark.read.text(save(tmp_path, "b", TEXT.encode().replace(b"\n", b"\x00\n", 1)))
    with pytest.raises(MatrixError, match="binary"):
        sniff.check_columns(broken, sniff.sniff(broken))


def bundle(**members):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, text in members.items():
            info = tarfile.TarInfo(name.replace("_", "."))
            info.size = len(text)
            tar.addfile(info, io.BytesIO(text.encode()))
    return out.getvalue()


def test_matrix_market_bundle(spark, tmp_path):
    data = bundle(matrix_mtx="%%MatrixMarket matrix coordinate integer general\n% c\n3 2 3\n1 1 5\n3 2 7\n2 1 0\n",
                  barcodes_tsv="AA\nCC\n", genes_tsv="E1\tFoo\nE2\tBar\nE3\tBaz\n")
    kind, path = archives.unpack(spark, save(tmp_path, "m.tar.gz", data))
    assert kind == "tar"
    assert rows(matrices.read_matrix_market(spark, path)) == [("Baz_E3", "CC", 7.0), ("Foo_E1", "AA", 5.0)]
    with pytest.raises(PythonException, match="unexpected member"):
        archives.unpack(spark, save(tmp_path, "w.tar.gz", bundle(matrix_mtx="x", other_txt="y", genes_tsv="z")))


def test_line_numbers_across_splits(spark, tmp_path):
    path = save(tmp_path, "lines.txt", "".join(f"line{i:05d}\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = numbered_lines(spark, path)
        assert df.filter("value <> format_string('line%05d', line)").count() == 0
        assert df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_fastq_records_and_encoding(spark, tmp_path):
    text = "".join(f"@r{i} d\nACGT\n+r{i}\n@+#I\n" for i in range(7))
    records = fastq(spark, save(tmp_path, "r.fastq", text))
    assert records.count() == 7 and broken_fastq(records).count() == 0
    got = quality_encodings(quality_range(records)).first()
    assert (got["min"], got["max"]) == (35, 73)
    assert got["encodings"] == "Sanger, Illumina 1.8+"
    assert broken_fastq(fastq(spark, save(tmp_path, "b.fastq", "r\nA\n+\nI\n"))).count() == 1


def test_side_tables(spark, tmp_path):
    marks = tables.markers(spark, save(tmp_path, "mk.tsv", "species\tofficial gene symbol\tcell type\tubiquitousness index\nMm Hs\tCD3E\tT cells\t0.01\n"))
    assert marks.first()["gene"] == "CD3E" and marks.first()["ui"] == 0.01
    given = tables.clustering(spark, save(tmp_path, "cl.tsv", "A\t0\nB\t1\nC\t1\n"))
    cells = spark.createDataFrame([("A",), ("B",)], "cell string")
    assert sorted(r["cell"] for r in tables.match_clustering(cells, given).collect()) == ["A", "B"]
    with pytest.raises(MatrixError):
        tables.match_clustering(cells.union(spark.createDataFrame([("Z",)], "cell string")), given)
    anno = tables.annotations(spark, save(tmp_path, "an.tsv", "Xist\tinactivation\n"))
    genes = spark.createDataFrame([("Xist",), ("Foo",)], "gene string")
    assert {r["gene"]: r["desc"] for r in tables.annotate(genes, anno).collect()} == {"Xist": "inactivation", "Foo": "no annotation"}


def test_dense_text(spark):
    m = spark.createDataFrame([("X", "a", 1.0), ("X", "b", 2.0), ("Y", "b", 3.0)], "gene string, cell string, value double")
    assert sorted(r["value"] for r in sinks.dense_lines(m, ["a", "b"]).collect()) == ["X\t1.0\t2.0", "Y\t0.0\t3.0"]


def test_inputs_by_a_path_that_only_hadoop_knows(spark, tmp_path):
    """A mounted view of the local folder: no other library can open it."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.mounted.link./in", f"file://{tmp_path}")
    save(tmp_path, "plain.tsv", TEXT)
    save(tmp_path, "packed.tsv.gz", gzip.compress(TEXT.encode()))
    for name, kind in (("plain.tsv", "text"), ("packed.tsv.gz", "gzip")):
        found, path = archives.unpack(spark, f"viewfs://mounted/in/{name}")
        assert found == kind and path.startswith("viewfs://mounted/in/")
        assert "\n".join(r["value"] for r in spark.read.text(path).collect()) == TEXT.strip("\n")


def test_wide_lines_are_made_after_the_sort(spark):
    df = spark.createDataFrame([("b", "y", 2), ("a", "z", 3), ("a", "x", 1), ("b", "z", None)], "gene string, cluster string, v long")
    out = sinks.wide_lines(df, "cluster", "v", ",")
    assert [r["value"] for r in out.collect()] == ["gene,x,y,z", "a,1,,3", "b,,2,"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("array_join") < plan.index("Sort [")


def test_lines_are_dealt_by_record_and_not_sorted_before(spark, tmp_path):
    """Records of two gzip files stay apart, and no task gets the lines of a whole split for their numbers."""
    for f, n in (("a", 5), ("b", 3)):
        text = "".join(f"@{f}{i}\nACGT{f}\n+\nIIII{i}\n" for i in range(n))
        save(tmp_path, f"{f}.fastq.gz", gzip.compress(text.encode()))
    records = fastq(spark, str(tmp_path))
    assert sorted((r["id"], r["seq"], r["plus"], r["qual"]) for r in records.collect()) == [
        (f"@{f}{i}", f"ACGT{f}", "+", f"IIII{i}") for f, n in (("a", 5), ("b", 3)) for i in range(n)]
    plan = records._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "strategy=broadcast" in plan
