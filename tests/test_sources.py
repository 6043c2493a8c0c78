"""Archives and reports as data sources: round trips, damaged files, aborted writes."""

from __future__ import annotations

import csv
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessitura.sources.npz import NpzSource
from tessitura.sources.report import ReportSource, append_report


@pytest.fixture(scope="module")
def sources(spark):
    spark.dataSource.register(NpzSource)
    spark.dataSource.register(ReportSource)
    return spark


def catalog(n, seed):
    rng = np.random.default_rng(seed)
    return {"ids": np.array([f"tück{i % 7}" for i in range(n)], dtype="U6"), "offsets": (5.0 * np.arange(n)).astype(np.float32), "vectors": rng.normal(size=(n, 8)).astype(np.float32), "pos": np.arange(n), "ok": np.arange(n) % 2 == 0}


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_numpy_archives_are_read(sources, tmp_path, save):
    made = [catalog(n, n) for n in (25, 1, 0, 10_000)]
    for i, c in enumerate(made):
        save(tmp_path / f"{i}.npz", **c)
    df = sources.read.format("npz").option("rowsPerPartition", 7).load(str(tmp_path / "0.npz"))
    assert df.dtypes == [("ids", "string"), ("offsets", "float"), ("vectors", "array<float>"), ("pos", "bigint"), ("ok", "boolean")]
    assert df.rdd.getNumPartitions() == (4 if save is np.savez else 1)
    rows = sorted(df.collect(), key=lambda r: r["pos"])
    assert [tuple(r[:2]) for r in rows] == list(zip(made[0]["ids"].tolist(), made[0]["offsets"].tolist(), strict=True)) and [r["ok"] for r in rows] == made[0]["ok"].tolist()
    assert np.array_equal(np.array([r["vectors"] for r in rows], dtype=np.float32), made[0]["vectors"])
    whole = sources.read.format("npz").load(f"file://{tmp_path}")
    assert whole.count() == 10_026 and whole.agg(F.sum("pos")).first()[0] == sum(int(c["pos"].sum()) for c in made)


def test_damaged_archives_are_errors(sources, tmp_path):
    good = tmp_path / "good.npz"
    np.savez(good, **catalog(500, 1))
    raw = good.read_bytes()
    bad = {"cut": raw[: len(raw) // 2], "none": b"no archive"}
    cases = {"lengths": {"a": np.zeros(3), "b": np.zeros(4)}, "objects": {"a": np.array([{}, []], dtype=object)}, "axes": {"a": np.zeros((2, 2, 2))}, "empty": {}}
    for name, arrays in cases.items():
        out = io.BytesIO()
        np.savez(out, **arrays)
        bad[name] = out.getvalue()
    for name, data in bad.items():
        (tmp_path / f"{name}.bad").write_bytes(data)
        with pytest.raises(Exception, match="damaged"):
            sources.read.format("npz").load(str(tmp_path / f"{name}.bad")).count()
    np.savez(tmp_path / "other.npz", x=np.zeros(2))
    with pytest.raises(Exception, match="other columns"):
        sources.read.format("npz").load(str(tmp_path)).count()


def test_tables_become_archives(sources, tmp_path):
    path = str(tmp_path / "out")
    df = sources.createDataFrame([(i, f"n{i}", [float(i), 2.0]) for i in range(100)], "id long, name string, v array<double>").repartition(3)
    df.write.format("npz").mode("append").save(path)
    df.filter("id < 10").write.format("npz").mode("append").save(path)
    back = sources.read.format("npz").load(path)
    assert sorted(map(tuple, back.collect())) == sorted([*map(tuple, df.collect()), *map(tuple, df.filter("id < 10").collect())])
    df.filter("id < 5").write.format("npz").mode("overwrite").save(path)
    assert sources.read.format("npz").load(path).count() == 5
    with pytest.raises(Exception, match="no nulls"):
        df.withColumn("id", F.when(F.col("id") != 3, F.col("id"))).write.format("npz").mode("overwrite").save(path)
    assert sources.read.format("npz").load(path).count() == 5 and not [f for f in (tmp_path / "out").iterdir() if f.name.startswith(".")]


def test_report_bytes_and_appends(sources, tmp_path):
    path = tmp_path / "r" / "report.csv"
    rows = [(i, f'say "{i}", ü\nx', [{"t": "ö", "s": 0.5 * i}] if i % 3 else None, i / 7) for i in range(20)]
    df = sources.createDataFrame(rows, "id long, text string, matches array<struct<t: string, s: double>>, score double").repartitionByRange(3, "id").sortWithinPartitions("id")
    df.write.format("report").mode("overwrite").save(str(path))
    out = io.StringIO(newline="")
    w = csv.writer(out)
    w.writerows([df.columns, *[(i, t, json.dumps(m, ensure_ascii=False) if m else m, s) for i, t, m, s in rows]])
    want = b"\xef\xbb\xbf" + out.getvalue().encode()
    assert path.read_bytes() == want
    with pytest.raises(ValueError, match="there already"):
        append_report(df.filter("id = 4"), str(path), "id")
    bad = F.when(F.col("id") > 1000, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id")
    with pytest.raises(Exception, match="broken"):
        df.select((F.col("id") + 990).alias("id"), "text", "matches", "score").select(bad, "text", "matches", "score").write.format("report").mode("append").save(str(path))
    assert path.read_bytes() == want
    append_report(df.select((F.col("id") + 100).alias("id"), "text", "matches", "score"), str(path), "id")
    got = list(csv.reader(io.StringIO(path.read_bytes().decode("utf-8-sig"), newline="")))
    assert len(got) == 41 and got[0] == df.columns and [r[0] for r in got[1:]] == [str(i + d) for d in (0, 100) for i in range(20)]
    with pytest.raises(Exception, match="header"):
        df.select("id").write.format("report").mode("append").save(str(path))
    assert len([f for f in path.parent.iterdir()]) == 1
