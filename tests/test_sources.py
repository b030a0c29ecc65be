from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairaudit.functions import text
from pairaudit.operators import gates
from pairaudit.operators.curation import exclusion_reason, size_code
from pairaudit.session import Materialized
from pairaudit.sources import files, jobs, sinks
from pairaudit.streaming import incremental


def test_all_text_keeps_every_cell(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("a,b\nNA,\n01,null\n")
    assert [tuple(r) for r in files.all_text(spark, str(p), ["a", "b"]).collect()] == [("NA", ""), ("01", "null")]
    assert files.strict_rows(spark, str(p), ["a", "b"]).count() == 2
    with pytest.raises(files.SourceError):
        files.strict_rows(spark, str(p), ["b", "a"])


def test_doubles_are_correctly_rounded(spark, tmp_path):
    from pyspark.sql import types as T

    values = [0.1, 1 / 3, 5e-324, 1.7976931348623157e308, 2**53 + 2.0]
    p = tmp_path / "a.tsv"
    p.write_text("x\tk\n" + "".join(f"{v!r}\t{i}\n" for i, v in enumerate(values)))
    schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("k", T.LongType())])
    assert [r.x for r in files.delimited(spark, str(p), schema, sep="\t").orderBy("k").collect()] == values


def test_header_gate(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("a,a\n1,2\n")
    with pytest.raises(files.SourceError):
        files.header_of(spark, str(p))
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(files.SourceError):
        files.header_of(spark, str(tmp_path / "e.csv"))


def test_byte_gate(spark, tmp_path):
    good = {"ok.csv": b"a,b\n1,2\n"}
    bad = {"bom.csv": (b"\xef\xbb\xbfa\n", "byte_order_mark"), "cr.csv": (b"a\r\n", "carriage_return"), "latin.csv": (b"a\xe9\n", "not_utf8"), "empty.csv": (b"", "empty")}
    for n, c in good.items():
        (tmp_path / n).write_bytes(c)
    for n, (c, _) in bad.items():
        (tmp_path / n).write_bytes(c)
    got = {r.path.rsplit("/", 1)[1]: r.fault for r in files.byte_faults(spark, str(tmp_path)).collect()}
    assert got == {n: f for n, (_, f) in bad.items()}


@pytest.mark.parametrize("path", ["/etc/passwd", "../x", "a/../../x", "", "C:/x", "a\\b"])
def test_unsafe_paths(path):
    with pytest.raises(files.SourceError):
        files.safe_path("/data", path)


def test_safe_path():
    assert files.safe_path("/data/", "a/b.csv") == "/data/a/b.csv"
    with pytest.raises(files.SourceError):
        files.safe_path("/data", "a/predictions.csv", forbidden=["prediction"])


def test_projection(spark):
    df = spark.createDataFrame([("x", "1", "k"), ("y", "2", "k"), ("x", "3", "z")], "s string, v string, w string")
    spec = files.Projection({"value": "v"}, equals={"s": "x"}, within={"w": ["k", "q"]}, forbidden=["y_pred"])
    assert [r.value for r in files.projected(df, spec).collect()] == ["1"]
    with pytest.raises(files.SourceError):
        files.projected(df.withColumn("Y_PRED", F.lit(1)), spec)
    with pytest.raises(files.SourceError):
        files.projected(df.drop("w"), spec)


def test_npz(spark, tmp_path):
    p = tmp_path / "m.npz"
    np.savez(p, row_index=np.arange(250), x=np.arange(500.0).reshape(250, 2))
    spark.dataSource.register(files.NpzSource)
    reader = spark.read.format("npz").schema("row_index bigint, x array<double>").option("rowsPerBatch", 100)
    df = reader.load(str(p))
    assert df.rdd.getNumPartitions() == 1  # decompressed once, 100 rows at a time
    assert df.agg(F.sum("row_index"), F.sum(F.col("x")[1])).first()[:] == (31125, sum(range(1, 500, 2)))
    np.savez_compressed(p, row_index=np.arange(7), x=np.ones((6, 2)))
    with pytest.raises(Exception, match="unequal length"):
        reader.load(str(p)).collect()


def test_folds_jobs_and_hashes(spark, tmp_path):
    for job, r2 in (("s0_a", 0.5), ("s0_b", None)):
        d = tmp_path / "jobs" / job
        d.mkdir(parents=True)
        (d / "result.json").write_text(json.dumps({"job_id": job, "metrics": {"R2": r2}}, indent=1))
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string("job_id string, metrics struct<R2: double>")
    jobs = files.job_results(spark, str(tmp_path), schema)
    assert {r.job_dir: r.metrics.R2 for r in jobs.collect()} == {"s0_a": 0.5, "s0_b": None}
    assert files.select_jobs(jobs, ["s0_b"]).count() == 1
    for wanted in (["s0_a", "s0_a"], ["nope"]):
        with pytest.raises(files.SourceError):
            files.select_jobs(jobs, wanted)
    hashes = files.content_hashes(spark, str(tmp_path / "jobs" / "*"))
    assert hashes.select("sha256").distinct().count() == 2
    fold = spark.createDataFrame([("random", "0", "OK", [3, 4], [1], None)], "regime string, fold string, flag string, outer_train array<int>, test array<int>, excluded array<int>")
    assert sorted((r.role, r.position, r.row_index) for r in files.fold_members(fold).collect()) == [("test", 0, 1), ("train", 0, 3), ("train", 1, 4)]


def test_file_faults(spark):
    have = spark.createDataFrame([("a", 1, "aa"), ("b", 2, "bb"), ("c", 3, "cc")], "name string, bytes bigint, sha256 string")
    want = spark.createDataFrame([("a", 1, "AA"), ("b", 9, "bb"), ("c", 3, "xx"), ("d", 1, "dd")], "name string, bytes bigint, sha256 string")
    assert {r.name: r.fault for r in files.file_faults(have, want).collect()} == {"b": "size", "c": "content", "d": "missing"}
    assert sorted(r[0] for r in files.differing_files(have, want.withColumn("sha256", F.lower("sha256"))).collect()) == ["c", "d"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None, [1, 2]), (1, 0.1, None)], "k bigint, x double, a array<int>")
    sinks.table_with_undefined(df, str(tmp_path / "t"))
    out = next((tmp_path / "t").glob("part-*")).read_text()
    assert out == "k\tx\ta\n2\tUNDEFINED\t[1,2]\n1\t0.1\tUNDEFINED\n"
    sinks.sorted_delimited(df.select("k", "x"), str(tmp_path / "s"), ["x", "k"], ["k"])
    assert next((tmp_path / "s").glob("part-*")).read_text() == "x,k\n0.1,1\n,2\n"
    with pytest.raises(ValueError, match="without a place"):
        sinks.sorted_delimited(df, str(tmp_path / "u"), ["k"], ["k"])
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.table_with_undefined(df, str(tmp_path / "t"))
    assert [r[0] for r in df.orderBy("k").select(sinks.seventeen_digits("x")).collect()] == ["0.10000000000000001", None]
    assert sinks.markdown_table(df.select("k", "x").orderBy("k")).splitlines()[2:] == ["| 1 | 0.1 |", "| 2 | UNDEFINED |"]


def test_json_and_claims(tmp_path):
    p = tmp_path / "r.json"
    sinks.write_json(str(p), {"b": math.nan, "a": (1, {"c": math.inf})})
    assert json.loads(p.read_text()) == {"a": [1, {"c": None}], "b": None}
    assert list(tmp_path.iterdir()) == [p]
    sinks.claim(str(tmp_path / "out"), "me")
    sinks.claim(str(tmp_path / "out"), "me")
    with pytest.raises(sinks.OutputExists):
        sinks.claim(str(tmp_path / "out"), "you")
    with pytest.raises(sinks.OutputExists):
        sinks.claim(str(tmp_path / "out"), "me", binding={"input": "00"})
    (tmp_path / "out" / "link").symlink_to(tmp_path)
    with pytest.raises(sinks.OutputExists):
        sinks.claim(str(tmp_path / "out"), "me")


def test_text_functions(spark):
    df = spark.createDataFrame([("07", "Yes", "b|A| a"), ("0", "0", ""), ("12", None, None), ("-1", " TRUE ", "x")], "i string, b string, n string")
    got = df.select(text.parse_index(F.col("i")), F.array_join(text.name_tokens(F.col("n")), ",")).collect()
    assert [tuple(r) for r in got] == [(None, "a,b"), (0, ""), (12, None), (None, "x")]


def test_two_dialects_of_booleans(spark):
    cells = ["Yes", "0", None, " TRUE ", "y", "N", "", "1", "false", "True", "maybe"]
    df = spark.createDataFrame([(c,) for c in cells], "b string")
    of = lambda words: [r[0] for r in df.select(text.parse_bool(F.col("b"), words, strict=False)).collect()]
    assert of(text.TABLE_WORDS) == [True, False, False, True, True, False, False, True, False, True, None]
    assert of(text.MASK_WORDS) == [None, False, None, None, None, None, None, True, False, True, None]
    for words in (text.TABLE_WORDS, text.MASK_WORDS):
        with pytest.raises(Exception, match="not a boolean"):
            df.select(text.parse_bool(F.col("b"), words)).collect()


def test_blanks_around_a_cell_stay(spark, tmp_path):
    df = spark.createDataFrame([(1, " a "), (2, "b\t")], "k int, t string")
    sinks.sorted_delimited(df, str(tmp_path / "b"), ["k", "t"], ["k"])
    assert [r.t for r in files.all_text(spark, str(tmp_path / "b"), ["k", "t"]).collect()] == [" a ", "b\t"]


def test_quoted_names_in_a_header(spark, tmp_path):
    (tmp_path / "q.csv").write_text('\ufeffa,"b,c",d\n1,2,3\n')
    assert files.header_of(spark, str(tmp_path / "q.csv")) == ["a", "b,c", "d"]


def test_saved_jobs_and_their_faults(spark, tmp_path):
    rows = spark.createDataFrame([(m, i, i * 0.5, i * 0.25 if i else float("nan")) for m in "abcd" for i in range(5)], "m string, row_index bigint, y_true double, y_pred double")
    scores = spark.createDataFrame([(m, 5, None if m == "a" else 0.5) for m in "abcd"], "m string, n bigint, r2 double")
    jobs.save_jobs(rows, scores, ["m"], str(tmp_path))
    saved = jobs.read_jobs(spark, str(tmp_path), "n bigint, r2 double")
    assert jobs.job_faults(saved).count() == 0
    got = sorted(map(tuple, saved.predictions.filter("job_id = 'b'").select("position", "row_index", "y_true").collect()))
    assert got == [(i, i, i * 0.5) for i in range(5)]
    assert {r.job_id: r.r2 for r in saved.results.collect()} == {"a": None, "b": 0.5, "c": 0.5, "d": 0.5}
    lines = (tmp_path / "jobs/b/predictions.csv").read_text().splitlines()
    (tmp_path / "jobs/b/predictions.csv").write_text("\n".join([lines[0], lines[2], lines[1], *lines[3:]]) + "\n")
    (tmp_path / "jobs/c").rename(tmp_path / "jobs/x")
    (tmp_path / "jobs/d/membership.json").unlink()
    faults = jobs.job_faults(jobs.read_jobs(spark, str(tmp_path), "n bigint, r2 double"))
    assert sorted(map(tuple, faults.collect())) == [("b", "predictions"), ("b", "test_order"), ("d", "absent"), ("d", "test_order"), ("x", "name")]


def test_a_gate_stops_before_outcomes(spark):
    mask = spark.range(3)
    faults = spark.createDataFrame([(1, "value")], "k int, fault string")
    asked = []
    with pytest.raises(Exception, match="baseline"):
        gates.gated(mask, lambda: faults, asked.append, Materialized(spark, "t"))
    assert not asked
    assert gates.gated(mask, lambda: faults.limit(0), lambda m: m, Materialized(spark, "t")).count() == 3


def test_reasons_take_the_host_first(spark):
    df = spark.createDataFrame([("", None), (None, ""), ("C?C", ""), ("CC", "ClC"), ("CC", None)], "h string, g string")
    coded = df.select(size_code(F.col("h")).alias("h"), size_code(F.col("g")).alias("g"))
    got = coded.select("h", "g", exclusion_reason(F.col("h"), F.col("g"))).collect()
    assert [tuple(r) for r in got] == [(0, -1, "host_empty"), (-1, 0, "host_missing"), (-2, 0, "host_unreadable"), (2, 2, None), (2, -1, "guest_missing")]


def test_streaming_scores_match_the_batch(spark, tmp_path):
    data = [("m", i % 3, float(i % 7), float(i % 5)) for i in range(60)] + [("m", 0, 1.0, None)]
    df = spark.createDataFrame(data, "model string, block int, y_true double, y_pred double")
    path = str(tmp_path / "in")
    df.filter("block < 2").write.parquet(path)
    stream = incremental.running_scores(incremental.read_panel(spark, path, df.schema), ["model", "block"])
    query = incremental.start(stream, "memory", "running", str(tmp_path / "c"))
    query.awaitTermination()
    want = lambda d: {(r.model, r.block): (r.n, round(r.r2, 9)) for r in incremental.running_scores(d, ["model", "block"]).collect()}
    got = lambda: {(r.model, r.block): (r.n, round(r.r2, 9)) for r in spark.table("running").collect()}
    assert got() == want(df.filter("block < 2"))
