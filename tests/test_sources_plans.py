import base64
import hashlib
import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import video
from tessera.plans import plan, report
from tessera.sources import files
from tessera.streaming import frames as streams

# Sources


def test_folder_and_labels(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("a/one.png", "a/b/two.jpg", "a/notes.txt"):
        (tmp_path / name).write_bytes(b"12345")
    (tmp_path / "labels.txt").write_text("one.png 3\n\nthree.png 4\n")
    (tmp_path / "list.txt").write_text("one\n\n two \n")
    images = files.folder(spark, f"{tmp_path}/a")
    got = {r.stem: r for r in files.with_labels(images, files.label_lines(spark, f"{tmp_path}/labels.txt")).collect()}
    assert set(got) == {"one", "two"} and got["one"].label == 3 and got["two"].label is None and got["one"].length == 5
    assert [r.path for r in files.listing(spark, f"{tmp_path}/list.txt", "root/", ".png").collect()] == ["root/one.png", "root/two.png"]


def test_questions(spark, tmp_path):
    image = base64.b64encode(b"pixels").decode()
    (tmp_path / "q.tsv").write_text(f"index\tquestion\tA\tB\tC\tD\tanswer\tcategory\tl2_category\timage\n1\tWhich?\tcat\tdog\t\t\tA\tx\ty\t{image}\n")
    r = files.questions(spark, f"{tmp_path}/q.tsv").first()
    assert r.options == {"A": "cat", "B": "dog"} and bytes(r.image) == b"pixels" and r.answer == "A"


def test_results_and_sinks(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"name": "n", "results": {"bpfp": 0.25, "cls_top-1": 90.0}, "records": []}, indent=1))
    assert {r.metric: r.value for r in files.results(spark, f"{tmp_path}/r.json").collect()} == {"bpfp": 0.25, "cls_top-1": 90.0}
    rows = spark.createDataFrame([("a", None), ("b", 1.0)], "k string, v double")
    files.write_result(rows, f"{tmp_path}/out")
    assert sorted(spark.read.json(f"{tmp_path}/out").collect(), key=str) == sorted(rows.select("k", "v").collect(), key=str)
    files.write_csv(rows, f"{tmp_path}/csv")
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 2


def test_arrays(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(6, dtype=np.float32).reshape(2, 3))
    np.savez(tmp_path / "b.npz", x=np.ones((1, 2)), y=np.zeros(3))
    r = files.arrays(spark, str(tmp_path)).first()
    assert r.shape == [2, 3] and r["values"] == [0, 1, 2, 3, 4, 5]
    assert files.arrays(spark, str(tmp_path), "x").first()["values"] == [1.0, 1.0]


def test_yuv(spark, tmp_path):
    (tmp_path / "v.yuv").write_bytes(bytes(range(24)) * 2 + b"rest")
    got = files.yuv420_frames(spark, f"{tmp_path}/v.yuv", 4, 4).orderBy("frame_idx").collect()
    assert len(got) == 2 and bytes(got[1].y) == bytes(range(16)) and bytes(got[1].u) == bytes(range(16, 20)) and bytes(got[1].v) == bytes(range(20, 24))


def test_manifest(spark):
    body = b"content"
    sha = hashlib.sha256(body).hexdigest()
    lines = ["# a comment", "", f"a sha256:{sha[:10]}", "b https://x/y md5:00", "c size:7", "d size:8", "e", "gone md5:1", f"f https://x/f sha256:{sha.upper()}"]
    entries = files.manifest(spark.createDataFrame([(x,) for x in lines], "value string"), "https://base/")
    content = spark.createDataFrame([(n, bytearray(body)) for n in "abcdef"], "dest string, content binary")
    got = {r.dest: r for r in files.verify(entries, content).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "ok", "b": "checksum_mismatch", "c": "ok", "d": "size_mismatch", "e": "ok", "gone": "missing", "f": "ok"}
    assert got["a"].url == "https://base/a" and got["b"].url == "https://x/y"


def test_structured_data(spark):
    frame = spark.createDataFrame([("i", json.dumps({"Object Detection": {"plane_1": [9, 0, 1, 1], "plane_2": [1, 0, 1, 1], "car_1": [0, 0, 2, 2]}}))], "image string, value string")
    boxes = files.structured_data(frame)
    named = files.numbered(boxes, "image")
    assert {r.name: r.box[0] for r in named.collect()} == {"plane_1": 1.0, "plane_2": 9.0, "car_1": 0.0}
    assert set(json.loads(files.structured_text(named, "image").first().value)["Object Detection"]) == {"plane_1", "plane_2", "car_1"}


def test_identities(spark):
    names = spark.createDataFrame([("0005_c001.jpg",), ("-1_c002.jpg",), ("0002_c002.jpg",), ("x",)], "name string")
    found = files.identities(names)
    assert {(r.pid, r.label) for r in files.relabelled(found).collect()} == {(2, 0), (5, 1)}
    r = files.identity_statistics(found).first()
    assert (r.n_pids, r.n_images, r.n_cams, r.cam_range) == (2, 2, 2, 3)


# Plans

RAW = {"name": "n", "description": "d", "dataset": {"type": "x"}, "model": {"type": "raw", "dtype": "float16"}, "task_configs": [{"label": "cls", "meter": {"type": "m"}}, {"label": "own", "kind": "rec", "meter": {"type": "m"}}]}


def test_plan_checks():
    p = plan.parse(RAW)
    assert [t.kind for t in p.tasks] == ["cls", "rec"] and plan.labels_by_kind(p) == {"cls": ["cls"], "rec": ["own"]}
    for key in ("name", "description", "dataset", "task_configs", "model"):
        with pytest.raises(ValueError, match=key):
            plan.parse({k: v for k, v in RAW.items() if k != key})
    for bad in ({"dataset": {}}, {"task_configs": [{"meter": {"type": "m"}}]}, {"task_configs": [{"label": "a"}]}, {"task_configs": [{"label": "a", "kind": "no", "meter": {"type": "m"}}]}):
        with pytest.raises(ValueError):
            plan.parse(RAW | bad)
    with pytest.raises(ValueError):
        plan.parse(None)


def test_qualities_start_from_the_base():
    p = plan.parse(RAW | {"multi_run": {"q1": {"dtype": "bfloat16", "extra": {"a": 1}}, "q2": {"extra": {"b": 2}}}})
    found = dict(plan.runs(p))
    assert found["q1"].model == {"type": "raw", "dtype": "bfloat16", "extra": {"a": 1}} and found["q2"].model == {"type": "raw", "dtype": "float16", "extra": {"b": 2}}
    assert plan.runs(plan.parse(RAW))[0][0] == ""


def test_registry():
    assert isinstance(plan.build({"type": "raw", "dtype": "float16"}), plan.Raw)
    assert plan.resolve("json.dumps") is json.dumps
    for name in ("nothing", "json.nothing", "no.such.module"):
        with pytest.raises(KeyError):
            plan.resolve(name)
    with pytest.raises(ValueError):
        plan.register("raw")(dict)


@pytest.mark.parametrize("spec,bits", [({"type": "bypass"}, 0), ({"type": "raw", "dtype": "float16"}, 64), ({"type": "uniform", "low": -4, "high": 4}, 32)])
def test_evaluate(spark, spec, bits):
    samples = spark.createDataFrame([(1, [1.0, -2.0, 3.0, 0.5]), (2, [0.0, 0.25, -1.0, 4.0])], "sample_id long, vec array<double>")

    def meter(rows):
        if "pred_vec" not in rows.columns:
            return rows.agg(F.count("*").alias("n"))
        return rows.agg(F.max(F.array_max(F.transform(F.arrays_zip("vec", "pred_vec"), lambda s: F.abs(s["vec"] - s["pred_vec"])))).alias("e"))

    streams_, result = plan.evaluate(samples, plan.build(spec), meter)
    assert {r.bits for r in streams_.collect()} == {bits}
    r = result.first()
    assert r.n == 2 if spec["type"] == "bypass" else r.e < 0.04


def test_empty_evaluation(spark):
    bits, result = plan.evaluate(spark.createDataFrame([], "sample_id long, vec array<float>"), plan.Raw(), lambda rows: rows)
    assert bits.collect() == [] and result.collect() == []


# Reports


def test_renaming(spark):
    rules = [("startswith", "a.", "A/"), ("exact", "gone", ""), ("regex", r"^b(\d)$", "B$1"), ("contains", "mid", "MID"), ("endswith", ".x", "")]
    keys = {"a.mid": "A/mid", "gone": None, "b7": "B7", "xmidx": "xMIDx", "q.x": "q", "same": "same", ".x": None}
    frame = spark.createDataFrame([(k,) for k in keys], "k string")
    assert {r.k: r.v for r in frame.select("k", report.renamed(F.col("k"), rules).alias("v")).collect()} == keys


def test_comparison(spark):
    refs = spark.createDataFrame([("a", 0.1, 90.0), ("b", 0.1, 90.0), ("c", 0.1, 90.0), ("d", 0.1, 90.0)], "k string, ref_rate double, ref_value double")
    results = spark.createDataFrame([("a", 0.11, 90.2), ("b", 0.1, 90.3), ("d", 0.1, 90.0)], "k string, rate double, value double")
    plans = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "k string")
    assert {r.k: r.status for r in report.compare(refs, results, plans, ["k"]).collect()} == {"a": "match", "b": "mismatch", "c": "missing_result", "d": "missing_plan"}


def test_summaries(spark):
    rows = spark.createDataFrame([("q1", "m", 1.0), ("q3", "m", 3.0), ("q2", "n", 5.0)], "quality string, metric string, value double")
    assert {r.metric: r["values"] for r in report.aligned(rows, ["q1", "q2", "q3"]).collect()} == {"m": [1.0, None, 3.0], "n": [None, 5.0, None]}
    records = spark.createDataFrame([("bpp", 1.0), ("cls_acc", 0.0)], "metric string, value double")
    meters = spark.createDataFrame([("cls", "acc", 9.0)], "label string, metric string, value double")
    assert {r.metric: r.value for r in report.finalized(records, meters).collect()} == {"bpp": 1.0, "cls_acc": 9.0}
    updates = spark.createDataFrame([(1, 0, "c", 1.0), (1, 2, "c", 3.0), (1, 1, "c", 2.0)], "id long, seq long, column string, value double")
    assert report.upserted(updates).first().value == 3.0
    both = spark.range(1).select(F.create_map(F.lit("a"), F.lit(1)).alias("x"), F.create_map(F.lit("a"), F.lit(2)).alias("y"))
    with pytest.raises(PySparkException):
        both.select(report.disjoint(F.col("x"), F.col("y"))).collect()
    assert spark.range(1).select(report.percent(F.lit(0.5)).alias("a"), report.percent(F.lit(50.0)).alias("b")).first()[:] == (50.0, 50.0)


# Streams


def test_stream_of_frames_equals_the_batch(spark, tmp_path):
    rows = [(s, i, "big" if (i + s) % 5 == 0 else "small") for s in (1, 2) for i in range(30)]
    frame = spark.createDataFrame(rows, "sequence long, frame_idx long, shape string")
    for k in range(3):
        frame.where(f"frame_idx div 10 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for k in range(3):
        source = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in/*")
    query = streams.coded(source, 8, 30).writeStream.format("memory").queryName("coded").option("checkpointLocation", f"{tmp_path}/check").start()
    query.processAllAvailable()
    query.stop()
    batch = video.parameter_sets(video.schedule(frame, 8, 0, 30), ["shape"]).select("sequence", "frame_idx", "kind", "qp", "last_qp", "sps_id", "writes_sps")
    assert sorted(map(tuple, spark.sql("SELECT * FROM coded").collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_stream_of_windows(spark, tmp_path):
    events = spark.createDataFrame([(0, "2024-01-01 00:05:00", "a", 1.0), (1, "2024-01-01 00:55:00", "a", 2.0), (2, "2024-01-01 01:05:00", "b", 4.0)], "event_id long, ts string, event_type string, value double")
    events = events.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(f"{tmp_path}/e")
    source = streams.event_time(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e"))
    query = streams.windowed(source, "1 hour").writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.event_type, r.n, r.total) for r in spark.sql("SELECT * FROM win").collect()} == {("a", 2, 3.0), ("b", 1, 4.0)}
