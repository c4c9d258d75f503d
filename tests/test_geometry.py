import pytest

from tomoframe.functions import geometry as geo
from tomoframe.operators import aggregate, select


def test_sizes_of_the_fake_scanner():
    s = geo.FAKE
    assert (s.detectors, s.num_r, s.dets_per_ring, s.num_z, s.bins) == (1152, 76, 48, 132, 481_536)


def test_ring_map_has_all_far_pairs_and_some_at_five(spark):
    pairs = {(r.d1r, r.d2r) for r in geo.ring_map(spark).collect()}
    far = {(a, b) for a in range(48) for b in range(a + 1, 48) if min(b - a, 48 - b + a) >= 6}
    rest = pairs - far
    assert len(pairs) == 912 and far <= pairs and len(rest) == 24
    assert {min(b - a, 48 - b + a) for a, b in rest} == {5}


@pytest.mark.parametrize("scanner", [geo.FAKE, geo.Scanner(dets_per_ring=24, rings=5, num_doi=1, max_ring_diff=4, min_ang_diff=4, dets_per_block=3)])
def test_bins_and_pairs_are_inverse(spark, scanner):
    rm = geo.ring_map(spark, scanner)
    step = max(1, scanner.bins // 20_000)
    bins = spark.range(0, scanner.bins, step).withColumnRenamed("id", "bin")
    pairs = geo.bin_to_pair(bins, rm, geo.z_map(spark, scanner), scanner).select("bin", "d1", "d2").withColumnRenamed("bin", "want")
    again = geo.pair_to_bin(pairs, rm, scanner).where("bin = want")
    n = pairs.count()
    assert again.count() == n and n > 0.9 * bins.count()


def test_illegal_pairs_raise_when_asked(spark):
    rows = spark.createDataFrame([(0, 1)], "d1 long, d2 long")
    rm = geo.ring_map(spark)
    assert geo.pair_to_bin(rows, rm).count() == 0
    with pytest.raises(Exception, match="outside"):
        geo.pair_to_bin(rows, rm, on_illegal="error").collect()


def test_constraints_on_worked_examples(spark):
    rows = spark.createDataFrame([(0, 4), (0, 8), (3, 8), (3, 47), (4, 47), (100, 105), (47, 3)], "d1 long, d2 long")
    got = {(r.d1, r.d2) for r in rows.where(select.block_index(2)).collect()}
    assert {(0, 8), (3, 8), (4, 47)} <= got and not {(0, 4), (3, 47)} & got
    got = {(r.d1, r.d2) for r in rows.where(select.angle_index(5)).collect()}
    assert {(100, 105), (4, 47)} <= got and not {(0, 4), (47, 3)} & got


def test_sparse_histogram_worked_example(spark):
    events = [(0, 15), (10, 15), (0, 15), (12, 78), (10, 15), (0, 20), (48, 21), (0, 15), (10, 13), (20, 0)]
    got = {(r.d1, r.d2): r.value for r in aggregate.sparse_histogram(spark.createDataFrame(events, "d1 long, d2 long")).collect()}
    assert got == {(0, 15): 3, (0, 20): 2, (10, 13): 1, (10, 15): 2, (12, 78): 1, (21, 48): 1}


def test_chronological_subsets_partition_the_rows(spark):
    rows = spark.range(10).withColumnRenamed("id", "event_id")
    sizes = [select.chronological(rows, 3, k, 10).count() for k in range(3)]
    assert sizes == [3, 3, 4]
    with pytest.raises(ValueError):
        select.chronological(rows, 3, 3, 10)
