"""The stored count table: whole results from few files."""

from pyspark.sql import functions as F

from somaspark.operators import tensors as T
from somaspark.sources import counts as K


def test_a_look_up_reads_only_files_near_it(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = spark.range(40_000).selectExpr("cast(id % 4 as int) as contig", "cast(id div 4 * 3 as int) as pos", "id as n", "'x' as file")
    K.write_counts(table, path, per_file=500, files=8)
    whole = K.read_counts(spark, path)
    assert len(whole.inputFiles()) >= 80 and sorted(map(tuple, whole.collect())) == sorted(map(tuple, table.collect()))
    loci = spark.createDataFrame([(1, 1, 300), (2, 1, 303), (3, 3, 29_990), (4, 2, None), (5, 9, 5)], "id long, contig int, pos int")
    got = K.read_counts(spark, path, loci, 4)
    assert 2 <= len(got.inputFiles()) <= 4
    near = lambda df: sorted(map(tuple, T.window_matrix(loci.dropna(), df, 4, ["n"]).collect()))
    assert near(got) == near(table)


def test_windows_across_files_and_beside_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = spark.range(10, 30).selectExpr("0 as contig", "cast(id as int) as pos", "id as n")
    K.write_counts(table, path, per_file=1, files=2)
    asked = lambda pos, pad: sorted(r.pos for r in K.read_counts(spark, path, spark.createDataFrame([(0, pos)], "contig int, pos int"), pad).collect())
    assert asked(20, 2) == [18, 19, 20, 21, 22] and asked(7, 3) == [10] and asked(33, 3) == [] and asked(9, 0) == []
    assert K.read_counts(spark, path, spark.createDataFrame([], "contig int, pos int")).count() == 0
    K.write_counts(table.where(F.lit(False)), f"{path}-none")
    assert K.read_counts(spark, f"{path}-none", table).count() == 0
