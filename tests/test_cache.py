import pytest

from massloom.operators.extraction import ion_images
from massloom.sources.cache import ExtractionCache, fingerprint

PEAKS = [(y, x, 500.0 + y * 0.001, float(x + 1)) for y in range(4) for x in range(5)]


@pytest.fixture
def tables(spark):
    peaks = spark.createDataFrame(PEAKS, "y int, x int, mz double, intensity double")
    return peaks, spark.createDataFrame([(1, 500.0), (2, 500.003)], "feature_id int, feature_mz double")


def test_one_extraction_for_each_content_and_setting(spark, tables, tmp_path, monkeypatch):
    peaks, features = tables
    made = []
    monkeypatch.setattr("massloom.sources.cache.ion_images", lambda *a: made.append(a[2]) or ion_images(*a))
    cache = ExtractionCache(spark, f"{tmp_path}/c a")
    first = sorted(cache.images(peaks, features, 2.0).collect())
    assert first == sorted(ion_images(peaks, features, 2.0).collect()) and first
    # the same rows in another order and another session's object are the same content
    again = ExtractionCache(spark, f"{tmp_path}/c a").images(spark.createDataFrame(PEAKS[::-1], peaks.schema).repartition(3), features, 2.0)
    assert sorted(again.collect()) == first and made == [2.0]
    cache.images(peaks, features, 3.0)
    cache.images(peaks.where("y > 0"), features, 2.0)
    assert made == [2.0, 3.0, 2.0]
    assert cache.isotopes(peaks, features, 2.0, 20).count() == 2 and made == [2.0, 3.0, 2.0]


def test_failed_attempts_are_never_read_and_the_first_writer_wins(spark, tables, tmp_path):
    peaks, features = tables
    cache = ExtractionCache(spark, str(tmp_path / "c"))
    inputs = {"peaks": peaks}
    with pytest.raises(Exception, match="broken"):
        cache.get("t", {}, inputs, lambda: spark.range(3).selectExpr("raise_error('broken') AS v"))

    def late():
        cache.get("t", {}, inputs, lambda: spark.range(5))
        return spark.range(7)

    assert cache.get("t", {}, inputs, late).count() == 5
    assert cache.get("t", {}, inputs, late).count() == 5
    assert len(list((tmp_path / "c").glob("t-*"))) == 1


def test_fingerprints_tell_values_nulls_names_and_repeats(spark):
    made = [spark.createDataFrame(r, s) for r, s in (
        ([(1, None)], "a int, b int"), ([(None, 1)], "a int, b int"), ([(1, None)], "a int, c int"), ([(1, None)] * 2, "a int, b int"),
        ([(1, 2)], "a int, b int"), ([(2, 1)], "a int, b int"), ([(1, 2)], "a long, b int"), ([], "a int, b int"), ([(1, 2)], "`a.x` int, b int"),
    )]
    assert len({fingerprint(t) for t in made}) == len(made)
