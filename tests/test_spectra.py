"""Spectra by ranges of bytes: any cut gives the same rows."""

import base64
import io
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from massloom.sources import readers, spectra

GROUPS = "".join(f'<referenceableParamGroup id="{i}"><cvParam accession="{a}"/><cvParam accession="{b}" name="x"/></referenceableParamGroup>' for i, a, b in (("mzArray", "MS:1000514", "MS:1000523"), ("intensityArray", "MS:1000515", "MS:1000521"), ("mobilityArray", "MS:1000515", "MS:1000523")))


def part(ref, offset, n, extra=""):
    return f'<binaryDataArray><referenceableParamGroupRef ref="{ref}"/>{extra}<cvParam accession="IMS:1000102" value="{offset}"/><cvParam accession="IMS:1000103" value="{n}"/></binaryDataArray>'


def imzml(folder, n=60, far=0, mobility=True):
    rng = np.random.default_rng(n)
    xml, want = ['<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><referenceableParamGroupList>', GROUPS, f'</referenceableParamGroupList><run><spectrumList count="{n}">'], []
    with open(folder / "i.ibd", "wb") as f:
        f.write(b"0" * 16)
        for k in range(n):
            if far and k == n // 2:
                f.seek(far)
            m = int(rng.integers(0, 9))
            mz, v, k0 = np.sort(rng.uniform(500, 900, m)), rng.uniform(0, 9, m).astype("<f4"), rng.uniform(1, 2, m)
            at = []
            for a in (mz.astype("<f8"), v, k0.astype("<f8")):
                at.append(f.tell())
                f.write(a.tobytes())
            parts = [part("mzArray", at[0], m), part("intensityArray", at[1], m), *([part("mobilityArray", at[2], m)] if mobility else [])]
            xml.append(f'<spectrum id="Scan={k}" index="{k}"><cvParam accession="IMS:1000050" value="{k % 7 + 1}"/><cvParam accession="IMS:1000051" value="{k // 7 + 1}"/>{"".join(parts)}</spectrum>\n')
            want += [(k, k // 7, k % 7, float(a), float(b), float(c) if mobility else None) for a, b, c in zip(mz, v, k0, strict=True)]
    (folder / "i.imzML").write_text("".join(xml) + "</spectrumList></run></mzML>")
    return want


@pytest.mark.parametrize("mobility", [True, False])
def test_imzml_in_any_number_of_parts(spark, tmp_path, mobility):
    want = imzml(tmp_path, mobility=mobility)
    for parts in (None, 1, 2, 7, 200):
        df = readers.read_imzml(spark, str(tmp_path / "i.imzML"), parts)
        assert df.rdd.getNumPartitions() == (parts or 1)
        assert sorted(map(tuple, df.collect())) == sorted(want)


def test_data_beyond_two_gigabytes_is_read_by_many_tasks(spark, tmp_path):
    # a sparse file: only its ends are written
    want = imzml(tmp_path, far=(2 << 30) + (200 << 20))
    df = readers.read_imzml(spark, str(tmp_path / "i.imzML"))
    assert df.rdd.getNumPartitions() > 30
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert df.groupBy("pixel").agg(F.sum("intensity")).count() == len({w[0] for w in want})


def mzml(n=40):
    def array(v, kind, packed):
        raw = np.array(v, "<f8").tobytes()
        text = base64.b64encode(zlib.compress(raw) if packed else raw).decode()
        return f'<binaryDataArray><cvParam accession="MS:1000523"/>{"<cvParam accession=%r/>" % "MS:1000574" if packed else ""}<cvParam accession="{kind}"/><binary>{text}</binary></binaryDataArray>'

    text, want = '<mzML xmlns="http://psi.hupo.org/ms/mzml"><run><spectrumList>', []
    for k in range(n):
        m, level = k % 5, 1 + k % 2
        mz, v = [100.0 + k + j for j in range(m)], [float(j) for j in range(m)]
        ion = f'<cvParam accession="MS:1000744" value="{500 + k}"/><cvParam accession="MS:1000041" value="{k % 4}"/>' if level == 2 and k % 3 else ""
        text += f'<spectrum index="{k}" id="s{k}"><cvParam accession="MS:1000511" value="{level}"/><cvParam accession="MS:1000016" value="{k}" unitName="minute"/>{ion}{array(mz, "MS:1000514", k % 3 == 0)}{array(v, "MS:1000515", k % 3 == 0)}</spectrum>'
        if m and not (level == 2 and not ion):
            want.append((k, level, float(k), 500.0 + k if ion else None, k % 4 if ion and k % 4 else 2, [(a, b) for a, b in zip(mz, v, strict=True)]))
    return text + "</spectrumList></run></mzML>", want


def test_mzml_in_any_number_of_parts(spark, tmp_path):
    text, want = mzml()
    (tmp_path / "a.mzML").write_text(text)
    for parts in (None, 2, 33):
        got = readers.read_mzml(spark, str(tmp_path / "a.mzML"), parts).orderBy("scan_id").collect()
        assert [(*r[:5], [tuple(p) for p in r["peaks"]]) for r in got] == want
    (tmp_path / "b.mzML").write_text(text)
    assert readers.read_mzml(spark, str(tmp_path)).count() == 2 * len(want)
    with pytest.raises(Exception, match="none.mzML"):
        readers.read_mzml(spark, str(tmp_path / "none.mzML")).count()


def test_elements_at_every_cut():
    text = mzml(12)[0].encode()
    whole = list(spectra.spectrum_elements(io.BytesIO(text), 0, len(text)))
    assert len(whole) == 12
    for step in (1, 7, 64):
        for cut in range(0, len(text), 97):
            f = io.BytesIO(text)
            assert list(spectra.spectrum_elements(f, 0, cut, step)) + list(spectra.spectrum_elements(f, cut, len(text), step)) == whole
    assert list(spectra.spectrum_elements(io.BytesIO(b"<spectrumList></spectrumList>"), 0, 99)) == []
    assert spectra.header_groups(io.BytesIO(GROUPS.encode()), 10)["mobilityArray"] == {"MS:1000515", "MS:1000523"}
