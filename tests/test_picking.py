import math

import numpy as np
import pytest

from massloom.operators import extraction, picking
from massloom.plans.queries_imaging import peaks

COLUMNS = ("mz_lo", "mz_hi", "mz_apex", "apex_intensity")


def plain_baseline(x, half):
    n = len(x)
    least = np.array([x[max(0, i - half) : i + half + 1].min() for i in range(n)])
    mirror = lambda i: i % (2 * n) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)
    w = np.array([math.exp(-0.5 * (k / half) ** 2) for k in range(-4 * half, 4 * half + 1)])
    w = w / w.sum()
    return np.array([max(0.0, x[i] - sum(c * least[mirror(i + k - 4 * half)] for k, c in enumerate(w))) for i in range(n)])


def plain_tops(x):
    out, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            out.append((i + j) // 2)
        i = j + 1
    return out


def plain_peaks(x, mz, share, width, order, least_ppm, local, height, edge_ppm):
    """The whole spectrum in one loop."""
    s, h = x.copy(), width // 2
    for i in range(len(x)):
        a = min(max(0, i - h), len(x) - width)
        fit = np.polyfit(np.arange(width) - h, x[a : a + width], order)
        s[i] = np.polyval(fit, i - a - h)
    s = np.maximum(s, 0.0)
    s = np.rint(s / (x.max() * 1e-11)) * (x.max() * 1e-11)
    valleys, out = plain_tops(-s), []
    for k in plain_tops(s):
        top = s[max(0, k - local) : k + local + 1].max() if local else s.max()
        if s[k] < share * top:
            continue
        apex = mz[k]
        if height:
            t, ends = height * s[k], []
            for way in (-1, 1):
                c = k + way
                while 0 < c < len(s) - 1 and s[c] >= t:
                    c += way
                ends.append(mz[c] + (t - s[c]) / (s[c - way] - s[c]) * (mz[c - way] - mz[c]) if s[c - way] > s[c] else mz[c])
            apex = sum(ends) / 2
        low, high = [v for v in valleys if v < k], [v for v in valleys if v > k]
        half = apex * edge_ppm * 1e-6
        lo = mz[low[-1]] if low else mz[int(np.searchsorted(mz, apex - half - 1e-9))]
        hi = mz[high[0]] if high else mz[int(np.searchsorted(mz, apex + half + 1e-9, side="right")) - 1]
        if (hi - lo) / apex * 1e6 < least_ppm:
            lo, hi = apex * (1 - least_ppm * 0.5e-6), apex * (1 + least_ppm * 0.5e-6)
        out.append((lo, hi, apex, s[k]))
    return out


def spectrum(seed, n=900):
    """Peaks, a level stretch and long gaps. Equal values stand in these only: rounding can break no other tie."""
    rng = np.random.default_rng(seed)
    x = np.zeros(n)
    for c in rng.integers(0, n, 25):
        x += rng.uniform(5, 90) * np.exp(-((np.arange(n) - c) ** 2) / rng.uniform(2, 40))
    x[x < 0.5] = 0
    x[200:420] = 0
    x[500:540] = 30
    x[0] = x[-1] = 1
    return x


def rows_of(spark, x, mz, key=None):
    data = [((key,) if key else ()) + (int(k) + 7, float(mz[k]), float(x[k])) for k in np.nonzero(x)[0]]
    return spark.createDataFrame(data, ("key string, " if key else "") + "cell long, mz double, intensity double")


@pytest.mark.parametrize("local,height", [(0, 0.0), (0, 0.75), (40, 0.75), (12, 0.3)])
def test_peaks_equal_a_plain_loop_wherever_the_ranges_are_cut(spark, local, height):
    x = spectrum(1)
    mz = 800 + np.arange(len(x)) * 0.01
    want = plain_peaks(x, mz, 0.02, 7, 2, 30.0, local, height, 40.0)
    assert len(want) > 10
    for cells, halo in ((1 << 16, 1024), (37, 8), (128, 16)):
        got = picking.pick_peaks(rows_of(spark, x, mz), 0.02, least_ppm=30.0, local_cells=local, picking_height=height, edge_ppm=40.0, cells=cells, halo=halo).orderBy("interval_id").collect()
        assert [r["interval_id"] for r in got] == list(range(1, len(want) + 1))
        for r, w in zip(got, want, strict=True):
            assert [r[c] for c in COLUMNS] == pytest.approx(w, rel=1e-9)


def test_spectra_of_several_keys_are_picked_each_on_its_own(spark):
    mz = 800 + np.arange(900) * 0.01
    both = rows_of(spark, spectrum(2), mz, "a").unionByName(rows_of(spark, spectrum(3) * 50, mz, "b"))
    for key, seed, times in (("a", 2, 1), ("b", 3, 50)):
        want = plain_peaks(spectrum(seed) * times, mz, 0.05, 7, 2, 2.0, 0, 0.75, 10.0)
        got = picking.pick_peaks(both, 0.05, keys=("key",), cells=100, halo=8).where(f"key = '{key}'").orderBy("interval_id").collect()
        assert [[r[c] for c in COLUMNS] for r in got] == [pytest.approx(w, rel=1e-9) for w in want]


def test_baseline_equals_a_plain_loop_wherever_the_ranges_are_cut(spark):
    x = spectrum(4, 300) + np.arange(300) % 7 + 3
    x[120:130] = 0
    mz = 800 + np.arange(300) * 0.01
    want = plain_baseline(x, 9)
    for width in (1 << 16, 41, 100):
        got = {r["cell"] - 7: r["intensity"] for r in picking.without_baseline(rows_of(spark, x, mz), 9, width=width).collect()}
        assert [got.get(k, 0.0) for k in range(300)] == pytest.approx(want.tolist(), abs=1e-9)


def test_few_cells_and_no_rows_give_no_peaks(spark):
    none = spark.createDataFrame([], "cell long, mz double, intensity double")
    assert picking.pick_peaks(none).count() == 0 and picking.without_baseline(none, 5).count() == 0
    few = spark.createDataFrame([(1, 500.0, 1.0), (2, 500.1, 9.0), (3, 500.2, 1.0)], none.schema)
    assert picking.pick_peaks(few).count() == 0
    one = spark.createDataFrame([(5, 500.0, 4.0)], none.schema)
    assert picking.pick_peaks(one).count() == 0


def test_query_equals_the_loop_on_the_mean_spectrum(spark):
    d = "/root/testdata/sf0.001"
    s = picking.without_baseline(extraction.mean_spectrum(peaks(spark, d), 1000, 5.0), 25)
    rows = s.orderBy("cell").collect()
    first, x = rows[0]["cell"], np.zeros(rows[-1]["cell"] - rows[0]["cell"] + 1)
    for r in rows:
        x[r["cell"] - first] = r["intensity"]
    want = plain_peaks(x, (first + np.arange(len(x))) * 5.0, 0.01, 7, 2, 2.0, 0, 0.75, 10.0)
    got = picking.pick_peaks(s).orderBy("interval_id").collect()
    assert len(got) == len(want)
    assert [r[c] for r in got for c in COLUMNS] == pytest.approx([v for w in want for v in w], rel=1e-6)
