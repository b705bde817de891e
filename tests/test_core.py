import json

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvine.functions import tensors as T
from corvine import __main__ as cli
from corvine.operators import control, lookups, metrics, splits
from corvine.plans import workflow
from corvine.sources import configs, frames, logs, sinks


def one(spark, column, **values):
    df = spark.range(1)
    for k, (v, kind) in values.items():
        df = df.withColumn(k, F.lit(json.dumps(v) if v is not None else None) if kind != "string" else F.lit(v))
        df = df.withColumn(k, F.from_json(k, kind)) if kind not in ("string", "int", "double") else df.withColumn(k, F.col(k).cast(kind))
    return df.select(column.alias("x")).first().x


def test_voigt_and_shapes(spark):
    v = ([1.0, 2, 3, 4, 5, 6], "array<double>")
    assert one(spark, T.voigt_to_matrix(F.col("v")), v=v) == [[1, 6, 5], [6, 2, 4], [5, 4, 3]]
    assert one(spark, T.voigt_to_nine(F.col("v")), v=v) == [1, 6, 5, 6, 2, 4, 5, 4, 3]
    assert one(spark, T.matrix_from_any(F.col("v")), v=(list(range(9)), "array<double>")) == [[0, 1, 2], [3, 4, 5], [6, 7, 8]]
    with pytest.raises(PySparkException):
        one(spark, T.matrix_from_any(F.col("v")), v=([1.0, 2], "array<double>"))
    got = one(spark, T.stress_from_kbar(F.col("v"), F.col("m"), 2.0), v=(None, "array<double>"), m=([[1.0, 2, 3]] * 3, "array<array<double>>"))
    assert got == [[2, 4, 6]] * 3
    assert one(spark, T.reshape_n3(F.col("v"), F.lit(2)), v=v) == [[1, 2, 3], [4, 5, 6]]
    assert one(spark, T.reshape_n3(F.col("v"), F.lit(0)), v=([], "array<double>")) == []
    with pytest.raises(PySparkException):
        one(spark, T.reshape_n3(F.col("v"), F.lit(3)), v=v)


@pytest.mark.parametrize("text,n", [("gpu:4", 4), ("gpu", 1), ("gpu:a100:2", 2), ("gpu:a100", 1), ("cpu:3,gpu:1", 1), ("cpu:3, gpu", 1), ("", 0)])
def test_gpus(spark, text, n):
    assert one(spark, T.gpus(F.col("t")), t=(text, "string")) == n


def test_text_functions(spark):
    assert one(spark, T.strip_ansi(F.col("t")), t=("\x1b[31mred\x1b[0m\r", "string")) == "red"
    assert one(spark, T.try_number(F.col("t")), t=(" 1.5e2 ", "string")) == 150
    assert one(spark, T.try_number(F.col("t")), t=("x", "string")) is None
    for text, want in {"a=b=c": ("a", "b=c"), "runs/x.csv": ("x", "runs/x.csv"), "y": ("y", "y")}.items():
        assert (one(spark, T.label_and_path(F.col("t"))[0], t=(text, "string")), one(spark, T.label_and_path(F.col("t"))[1], t=(text, "string"))) == want


def test_resolve_target_order(spark):
    kinds = "map<string,double>"
    get = lambda i, a, c: one(spark, T.resolve_target(["k1", "k2"], F.col("i"), F.col("a"), F.col("c")), i=(i, kinds), a=(a, kinds), c=(c, "double"))
    assert get({"k1": 1.0}, {"k1": 2.0}, 3.0) == 1
    assert get({"k2": 1.0}, {"k1": 2.0}, 3.0) == 2
    assert get({}, {"k2": 2.0}, 3.0) == 2
    assert get({}, {}, 3.0) == 3
    with pytest.raises(PySparkException):
        get({}, {}, None)


@pytest.mark.parametrize("n,fraction", [(10, 0.8), (11, 0.8), (100, 0.29)])
def test_splits(spark, n, fraction):
    rows = splits.exact_splits(spark, n, fraction, 3).collect()
    of = lambda s: [r.position for r in sorted((r for r in rows if r.split == s), key=lambda r: r.ord)]
    size = int(fraction * n)
    assert len(of("train")) == size and sorted(of("train") + of("val")) == of("all") == list(range(n))
    assert of("half") == sorted(of("half_train") + of("half_val")) and len(of("half")) == n // 2
    assert rows == splits.exact_splits(spark, n, fraction, 3).collect()
    hashed = splits.hashed_split(spark.range(n).repartition(3), "id", fraction, "s").collect()
    assert sorted(r["rank"] for r in hashed) == list(range(1, n + 1)) and sum(r["split"] == "train" for r in hashed) == size
    assert splits.hashed_half(spark.range(n), "id", "h").count() == n // 2


@pytest.mark.parametrize("n,fraction", [(1, 0.8), (10, 0.0), (10, 1.0), (3, 0.1)])
def test_impossible_splits(n, fraction):
    with pytest.raises(ValueError):
        splits.train_size(n, fraction)


def test_logs(spark, tmp_path):
    files = {
        "csv/train.csv": 'Epoch,"validation energy/x MAE (per atom)",validation forces[0] MAE,validation v MAE (per atom) virial[1]\n,meV,meV,meV\n0, 1.5,2.5,3.5\n\n1,1,2,3\n',
        "text/output.log": "x Epoch 3: loss=1, MAE_E_per_atom= 1.5 meV, MAE_F= 2 meV, MAE_stress= 3e1\nEpoch 4: MAE_E_per_atom= nan, MAE_F= 2, MAE_stress= 3\n",
        "jsonl/a_train.txt": 'hello\n{"mode": "opt"}\n{"mode": "eval", "epoch": 2, "mae_e_per_atom": 0.001, "mae_f": 0.002, "mae_stress": 0.003}\n{"mode": "eval", "epoch": null, "mae_e_per_atom": 1}\n',
        "state/job.out": "val/energy,per_atom_mae: 9\n\x1b[1mEval Epoch 5\x1b[0m\nval/x energy,per_atom_mae: 0.001\nval/x forces,mae: 0.002\nval/x stress,mae: 0.003\nval/x stress,mae: 0.006\nval/x forces,mae: 0.005\nval/x energy,per_atom_mae: 0.004\nEval Epoch 6\nval/x forces,mae: 1\n",
        "void/train.csv": "Epoch,validation energy/ MAE (per atom),validation forces[ MAE,validation MAE (per atom) virial[\nu\nx,1,2,3\n1,1,2,3\n",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(text)
    found = logs.read_files(spark, str(tmp_path)).withColumn("label", F.element_at(F.split("path", "/"), -2))
    with pytest.raises(ValueError, match="void"):
        logs.load(found)
    got = [tuple(r)[:5] for r in logs.load(found.where("label != 'void'")).collect()]
    want = [("csv", 0, 1.5, 2.5, 3.5), ("csv", 1, 1, 2, 3), ("jsonl", 2, 1, 2, 3), ("state", 5, 1, 2, 3), ("state", 5, 4, 5, 6), ("text", 3, 1.5, 2, 30)]
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2:] for g in got], [w[2:] for w in want])


def test_frames_and_records(spark, tmp_path):
    (tmp_path / "a.extxyz").write_text('2\nenergy=-1.5 name="a b"\nH 0 0 0 1 2 3\nO 0 0 1.5 4 5 6\n1\nenergy=2\nC 1 2 3 0 0 0\n')
    (tmp_path / "b.txt").write_text("no")
    rows = frames.read_extxyz(spark, str(tmp_path)).orderBy("file_rank", "path", "frame_ord").collect()
    assert [r.n for r in rows] == [2, 1] and rows[0].info == {"energy": "-1.5", "name": "a b"} and rows[0].forces[1] == [4, 5, 6] and rows[1].positions == [[1, 2, 3]]
    df = frames.read_extxyz(spark, str(tmp_path))
    assert frames.first_frames(df, 1).count() == 1
    assert df.orderBy("frame_ord").select(sinks.extxyz_text(F.col("n"), F.col("comment"), F.col("species"), F.col("positions")).alias("t")).first().t.split("\n")[2] == "H 0.0 0.0 0.0"
    (tmp_path / "r.json").write_text(json.dumps([{"energy": 1.0, "structure": "s", "forces": [[1, 2, 3]]}, {"energy": 2.0}]))
    records = frames.read_json_array(spark, str(tmp_path / "r.json"))
    assert [(r.source_index, r.energy) for r in records.orderBy("source_index").collect()] == [(0, 1.0), (1, 2.0)]
    assert records.where(T.is_record(F.col("structure"), F.col("energy"), F.col("forces"))).count() == 1
    (tmp_path / "i.txt").write_text("5\n3\n\n9\n")
    indices = frames.read_indices(spark, str(tmp_path / "i.txt"), 2)
    assert [r[0] for r in indices.collect()] == [3, 5]
    assert frames.choose_source(indices, 4, True) == "index-file" and frames.choose_source(indices, 9, True) == "dataset"
    with pytest.raises(IndexError):
        lookups.check_range(indices, "source_index", 5)


def test_sinks(spark, tmp_path):
    parts = splits.exact_splits(spark, 10, 0.8, 1).withColumnRenamed("position", "source_index")
    f = spark.range(10).select(F.col("id").alias("source_index"), F.lit(1.0).alias("energy"), F.array(*map(F.lit, [1.0] * 6)).alias("stress"), F.array(F.lit(1.0)).alias("forces"), F.lit(0.0).alias("calc_energy"))
    sinks.write_splits(f, parts, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).where("split = 'train'").count() == 8
    sinks.write_indices(parts, "half", str(tmp_path / "i"))
    assert [int(r[0]) for r in spark.read.text(str(tmp_path / "i")).collect()] == sorted(r.source_index for r in parts.where("split = 'half'").collect())
    ready = sinks.model_ready(f, "m", flat_stress=True)
    assert ready.columns == ["source_index", "m_energy", "m_stress", "m_forces"] and len(ready.first().m_stress) == 9
    sinks.validate_targets(ready, "m")
    with pytest.raises(ValueError):
        sinks.validate_targets(ready.where("false"), "m")
    assert json.loads(sinks.metadata("train", 8, 10, seed=1))["desired_frame_count"] == 10


def test_lookups_and_metrics(spark):
    listing = spark.createDataFrame([("r", "a", 1), ("r", "b", 2), ("r", "c", 2), ("s", None, None)], "run string, path string, t int")
    assert dict(lookups.latest(listing, ["run"], "path", "t", "default").collect()) == {"r": "c", "s": "default"}
    with pytest.raises(ValueError):
        lookups.zip_strict(spark.range(2), spark.range(3), "id")
    h = spark.createDataFrame([(0, 1, [1.0, 2.0]), (0, 8, [0.5, 0.0])], "f int, z int, h array<double>")
    assert metrics.descriptors(h, "f", "z", "h").first().descriptor == [5, 2]


def test_references(spark):
    frames_, atoms = spark.createDataFrame([(1, 10.0), (2, 500.0)], "f int, e double"), spark.createDataFrame([(1, z) for z in range(1, 201)] + [(2, 3)], "f int, z int")
    every = spark.createDataFrame([(z, 0.5 * z) for z in range(1, 201)], "z int, e_ref double")
    got = {r.f: (r.n_atoms, r.residual) for r in lookups.subtract_references(frames_, atoms, every, "f", "e").collect()}
    assert got == {1: (200, 10 - 0.5 * 200 * 201 / 2), 2: (1, 498.5)}
    for bad, said in ((every.where("z != 7"), "for 7"), (every.selectExpr("z", "if(z = 9, null, e_ref) e_ref"), "for 9"), (every.union(every.where("z = 4")), "several")):
        with pytest.raises(ValueError, match=said):
            lookups.subtract_references(frames_, atoms, bad, "f", "e")


def test_zip_ordinals(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "i int"), spark.createDataFrame([(1, "x"), (2, "y")], "i int, v string")
    assert sorted(map(tuple, lookups.zip_strict(a, b, "i").collect())) == [(1, "x"), (2, "y")]
    for other in (b.selectExpr("i + 1 as i", "v"), b.selectExpr("1 as i", "v"), b.limit(1)):
        with pytest.raises(ValueError):
            lookups.zip_strict(a, other, "i")


def test_small_splits_raise(spark):
    with pytest.raises(PySparkException, match="too few rows"):
        splits.hashed_split(spark.range(1), "id", 0.8, "s").collect()


def test_losses(spark):
    rows = spark.createDataFrame([([3.0, 4.0, 0.0], [0.0, 0.0, 0.0]), ([1.0, 1.0, 1.0], [1.0, 1.0, 2.0])], "p array<double>, t array<double>")
    assert rows.agg(metrics.l2_norm_loss(F.col("p"), F.col("t")).alias("l")).first().l == 3


def test_extxyz_frames(spark, tmp_path):
    """Comments of one integer, frames without atoms, line ends and blank lines, in files that are split."""
    (tmp_path / "a.xyz").write_text("1\n7\nH 0 0 0\n0\n5\n2\nc\nH 1 0 0\nHe 2 0 0\n\n")
    (tmp_path / "b.extxyz").write_bytes(b"1\r\nx=1\r\nC 1 2 3\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16")
    try:
        got = [(r.file_rank, r.frame_ord, r.n, r.comment, r.species) for r in frames.in_file_order(frames.read_extxyz(spark, str(tmp_path))).collect()]
        lines = frames.numbered_lines(spark, str(tmp_path)).where("path like '%a.xyz'").orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(1, 0, 1, "7", ["H"]), (1, 1, 0, "5", []), (1, 2, 2, "c", ["H", "He"]), (2, 0, 1, "x=1", ["C"])]
    assert [(r.line, r.text) for r in lines] == list(enumerate((tmp_path / "a.xyz").read_text().split("\n")[:-1]))


def test_records_to_frames(spark):
    site = '{"species": [{"element": "%s", "occu": 1}], "xyz": [0, 0, %d]}'
    structure = '{"lattice": {"matrix": [[1, 0, 0], [0, 1, 0], [0, 0, 1]]}, "sites": [' + site % ("Fe", 1) + "," + site % ("Og", 2) + "]}"
    kinds = "source_index long, structure string, energy double, forces array<array<double>>, stress string, matpes_id string"
    row = (4, structure, 1.5, [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], "[1, 2, 3, 4, 5, 6]", None)
    got = frames.records_to_frames(spark.createDataFrame([row], kinds)).first()
    assert got.numbers == [26, 118] and got.positions == [[0, 0, 1], [0, 0, 2]] and got.info == {"source_index": "4"} and got.stress[0][1] == 6 * T.KBAR
    for bad in ((4, "{}", *row[2:]), (*row[:3], [[1.0]], *row[4:]), (*row[:4], "[1, 2]", None)):
        with pytest.raises(PySparkException):
            frames.records_to_frames(spark.createDataFrame([bad], kinds)).collect()


def test_model_files(spark, tmp_path):
    f = spark.createDataFrame([(3, 1, ["H"], [[0.0, 1.0, 2.0]], -1.5, [[4.0, 5.0, 6.0]], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "source_index long, n int, species array<string>, positions array<array<double>>, energy double, forces array<array<double>>, stress array<double>")
    sinks.write_extxyz(sinks.model_ready(f, "m", flat_stress=False), "m", str(tmp_path / "x"), ["source_index"], ("source_index",))
    got = frames.read_extxyz(spark, str(tmp_path / "x"), "txt$").first()
    assert got.forces == [[4, 5, 6]] and got.positions == [[0, 1, 2]] and got.info["m_stress"] == "1.0 6.0 5.0 6.0 2.0 4.0 5.0 4.0 3.0" and got.info["source_index"] == "3"


def test_command_line(spark, tmp_path, capsys):
    site = '{"species": [{"element": "H", "occu": 1}], "xyz": [0, 0, 0]}'
    records = [{"structure": {"lattice": {"matrix": [[1, 0, 0]] * 3}, "sites": [json.loads(site)]}, "energy": i, "forces": [[0, 0, i]], "stress": [0] * 6} for i in range(12)]
    (tmp_path / "r.json").write_text(json.dumps(records))
    (tmp_path / "i.txt").write_text("\n".join(map(str, range(11, 0, -1))))
    cli.main(["curate", "--indices", str(tmp_path / "i.txt"), "--dataset-path", str(tmp_path / "r.json"), "--output-dir", str(tmp_path / "out"), "--limit", "10"])
    counts = {s: spark.read.parquet(str(tmp_path / "out/frames")).where(F.col("split") == s).count() for s in workflow.SPLITS}
    assert counts == {"all": 10, "train": 8, "val": 2, "half": 5, "half_train": 4, "half_val": 1}
    kept = json.loads("".join(r.value for r in spark.read.text(str(tmp_path / "out/metadata/val"), wholetext=True).collect()))
    assert kept["sample_size"] == 2 and kept["desired_frame_count"] == 10 and kept["stress_input_unit"] == "kbar"
    (tmp_path / "c.yaml").write_text("b: 1\nval_dataset: {splits: {val: {src: old}}}\n")
    cli.main(["paths", str(tmp_path / "c.yaml"), "--train", "/t", "--val", "/v", "--out", str(tmp_path / "c")])
    assert configs.read_yaml(spark, str(tmp_path / "c")) == {"b": 1, "val_dataset": {"splits": {"val": {"src": "/v"}}}, "train_dataset": {"splits": {"train": {"src": "/t"}}}}
    (tmp_path / "run.txt").write_text("Epoch 3: MAE_E_per_atom= 1, MAE_F= 2, MAE_stress= 3\n")
    cli.main(["evaluate", f"a={tmp_path}/run.txt", "--out", str(tmp_path / "table")])
    assert spark.read.csv(str(tmp_path / "table"), header=True).first().epoch == "3" and "1.0" in capsys.readouterr().out
    with pytest.raises(IndexError):
        workflow.curate(spark, str(tmp_path / "i.txt"), str(tmp_path / "r.json"), str(tmp_path / "no"), limit=None) if (tmp_path / "i.txt").write_text("99") else None


def test_control():
    config = {"a": {"b": 1}, "z": 3}
    assert control.set_nested(config, ["a", "c", "d"], 2) == {"a": {"b": 1, "c": {"d": 2}}, "z": 3}
    assert control.set_nested(config, ["z", "y"], 1) == {"a": {"b": 1}, "z": {"y": 1}} and config == {"a": {"b": 1}, "z": 3}
    defaults = [{"data": 1, "more": 0}, {"data": 2}]
    assert control.set_default(defaults, "data", 9) == [{"data": 9, "more": 0}, {"data": 2}] and defaults == [{"data": 1, "more": 0}, {"data": 2}]
    assert control.set_default(["x"], "data", 9) == [{"data": 9}, "x"]
    with pytest.raises(TypeError):
        control.set_default({}, "data", 9)
