"""Arrays of every type in both storage forms, digests by blocks with planted faults, peaks merged across slices."""

import hashlib
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionweave.operators import spectra_ops
from ionweave.sources import digests, npy, readers

ARRAYS = {"b1": np.array([True, False, True]), "u1": np.array([0, 255, 7], "u1"), "u2": np.array([0, 65535, 7], "u2"), "u4": np.array([0, 2**32 - 1, 7], "u4"),
          "u8": np.array([0, 2**64 - 1, 7], "u8"), "i1": np.array([-128, 127, 7], "i1"), "i2": np.array([-(2**15), 2**15 - 1, 7], "i2"), "i4": np.array([-(2**31), 2**31 - 1, 7], "i4"),
          "i8": np.array([-(2**63), 2**63 - 1, 7]), "f2": np.array([0.5, -65504, 7], "f2"), "f4": np.array([0.1, -3e38, 7], "f4"), "f8": np.array([0.1, -1e300, 7])}


@pytest.mark.parametrize("form", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, None])
def test_every_type_round_trips(spark, tmp_path, form):
    for name, values in ARRAYS.items():
        for shape in ((3,), (3, 1)):
            folder = tmp_path / f"{name}{len(shape)}"
            folder.mkdir()
            np.save(folder / "x.npy", values.reshape(shape))
            if form is not None:
                with zipfile.ZipFile(folder / "a.npz", "w", form) as archive:
                    archive.writestr("other.npy", b"not read")
                    archive.write(folder / "x.npy", "x.npy")
                (folder / "x.npy").unlink()
            got = [r.value for r in npy.scan_npy(spark, str(folder), rows_per_partition=2, member="x*").orderBy("row_id").collect()]
            assert [g if len(shape) == 1 else g[0] for g in got] == values.tolist(), (name, form)


def test_members_are_read_by_range_or_as_a_stream(spark, tmp_path):
    values = np.arange(40_000, dtype="u2")
    np.savez(tmp_path / "stored.npz", v=values)
    np.savez_compressed(tmp_path / "deflated.npz", v=values)
    got = npy.scan_npy(spark, str(tmp_path), rows_per_partition=10_000)
    assert got.rdd.getNumPartitions() == 1 + 4
    assert got.groupBy("file_index").agg(F.sum("value"), F.count("*"), F.max("row_id")).orderBy("file_index").collect()[1][1:] == (int(values.astype(int).sum()), 40_000, 39_999)


def test_different_members_are_refused(spark, tmp_path):
    np.savez(tmp_path / "a.npz", v=np.arange(3), w=np.arange(3.0))
    with pytest.raises(Exception, match="different types"):
        npy.scan_npy(spark, str(tmp_path)).collect()
    assert npy.scan_npy(spark, str(tmp_path), member="w.npy").count() == 3
    with zipfile.ZipFile(tmp_path / "a.npz", "w", zipfile.ZIP_DEFLATED) as archive, archive.open("v.npy", "w") as out:
        np.lib.format.write_array(out, np.arange(9))
        out.write(b"")
    raw = (tmp_path / "a.npz").read_bytes()
    assert npy.scan_npy(spark, str(tmp_path)).count() == 9 and raw


def test_written_archives_hold_a_batch_each(spark, tmp_path):
    rows = spark.range(25_000).selectExpr("cast(id as float) as half", "id % 2 = 0 as even").coalesce(1)
    npy.write_npz(rows, {"half": "f4", "even": "?"}, f"{tmp_path}/z", deflate=True).collect()
    assert len(list((tmp_path / "z").iterdir())) == 3
    assert npy.scan_npy(spark, f"{tmp_path}/z", member="half.npy").agg(F.sum("value")).first()[0] == sum(range(25_000))


def test_many_small_files_share_partitions(spark, tmp_path):
    for k in range(1200):
        (np.savez_compressed if k % 3 else np.savez)(tmp_path / f"{k:05d}.npz", v=np.full(5 + k % 2, k, "u8"), w=np.arange(2.0))
    got = npy.scan_npy(spark, str(tmp_path), rows_per_partition=2, member="v.npy")
    assert got.rdd.getNumPartitions() <= npy.MOST_TASKS
    rows = got.groupBy("file_index").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.max("row_id").alias("r")).collect()
    assert sorted((r.file_index, r.n, int(r.lo), int(r.hi), r.r) for r in rows) == [(k, 5 + k % 2, k, k, 4 + k % 2) for k in range(1200)]


def test_gathered_ranges_keep_their_order_and_balance():
    ranges = [npy.RowRange("x", None, k, 0, rows) for k, rows in enumerate([1] * 50 + [100] + [1] * 50)]
    parts = npy._gathered(ranges, 10)
    assert [r.file_index for p in parts for r in p.ranges] == list(range(101)) and len(parts) <= 10
    assert max(sum(r.stop for r in p.ranges if r.stop < 100) for p in parts) <= 21


def test_numbers_without_objects():
    import decimal

    import pyarrow as pa

    whole = pa.array([decimal.Decimal(2**64 - 1), decimal.Decimal(0)], pa.decimal128(20, 0))
    assert npy._numbers(whole, "u8").tolist() == [2**64 - 1, 0]
    assert npy._numbers(pa.array([True, False]), "?").tolist() == [True, False]
    assert npy._numbers(pa.array([1.0, 0.1], pa.float32()), "f2").tolist() == np.array([1.0, 0.1], "f4").astype("f2").tolist()
    with pytest.raises(Exception):
        npy._numbers(pa.array([decimal.Decimal(-1)], pa.decimal128(20, 0)), "u8")


def test_manifest_names_every_fault(spark, tmp_path):
    for folder in ("a", "b", "c", "d", "e"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.bin").write_bytes(folder.encode() * 3_000_000)
    found = digests.file_manifest(spark, str(tmp_path))
    got = {r.name: (r.bytes, r.sha256) for r in found.collect()}
    assert got == {f"{f}/same.bin": (3_000_000, hashlib.sha256(f.encode() * 3_000_000).hexdigest()) for f in "abcde"}
    listed = found.checkpoint()
    (tmp_path / "a" / "same.bin").write_bytes(b"x" * 3_000_000)  # tampered
    (tmp_path / "b" / "same.bin").write_bytes(b"b")  # cut
    (tmp_path / "c" / "same.bin").unlink()
    (tmp_path / "d" / "new.bin").write_bytes(b"")
    status = {r.name: r.status for r in readers.manifest_audit(digests.file_manifest(spark, str(tmp_path)), listed).collect()}
    assert status == {"a/same.bin": "digest", "b/same.bin": "size", "c/same.bin": "missing", "d/same.bin": "ok", "d/new.bin": "unlisted", "e/same.bin": "ok"}


@pytest.mark.parametrize("width", [0.31, 1.0, 500.0])
def test_merged_views_across_slices(spark, width):
    rng = random.Random(2)
    views = [(q, v, [(round(rng.uniform(10, 14), 1) + rng.choice([0, 0, 0.05]), rng.choice([1.0, 2.0, 5.0])) for _ in range(0 if q == 3 else rng.randint(1, 60))]) for q in range(5) for v in range(4)]
    df = spark.createDataFrame(views, "q int, v int, peaks array<struct<mz:double,intensity:double>>").repartition(3)
    got = {}
    for r in spectra_ops.merged_views(df, "q", "v", "peaks", 0.3, width).collect():
        got.setdefault(r.q, []).append((r.mz, r.intensity))
    for q in range(5):
        rows = sorted((m, v, k, i / max(x[1] for x in p)) for qq, v, p in views if qq == q for k, (m, i) in enumerate(p))
        keep = [not (j and r[0] - rows[j - 1][0] < 0.3 and r[3] < rows[j - 1][3]) and not (j + 1 < len(rows) and rows[j + 1][0] - r[0] < 0.3 and rows[j + 1][3] >= r[3]) for j, r in enumerate(rows)]
        assert sorted(got.get(q, [])) == sorted((r[0], r[3]) for r, k in zip(rows, keep) if k)
