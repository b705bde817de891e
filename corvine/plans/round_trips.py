"""Queries that write files, records, configurations and logs, read them back and go on with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tensors as T
from ..operators import lookups, metrics, splits
from ..sources import configs, frames, logs, sinks
from . import workflow
from .catalogue import REF_SQL, _references
from .registry import folder, query
from .registry import read_table as _t


def _frames(spark, d) -> DataFrame:
    """An order with lines as a frame: a line is an atom, its number the element."""
    atoms = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_index"), F.struct("l_linenumber", "l_quantity", "l_discount", "l_tax").alias("a"))
    held = atoms.groupBy("source_index").agg(F.sort_array(F.collect_list("a")).alias("atoms"))
    orders = _t(spark, d, "orders").select(F.col("o_orderkey").alias("source_index"), F.col("o_totalprice").alias("energy"), F.array(*(F.lit(float(i)) for i in range(5)), F.col("o_custkey").cast("double")).alias("stress"), F.lit(0.0).alias("calc_energy"))
    of = lambda f: F.transform("atoms", f)
    rows = held.join(orders, "source_index").withColumns({"n": F.size("atoms"), "numbers": of(lambda a: a["l_linenumber"]), "species": of(lambda a: F.element_at(F.array(*map(F.lit, T.SYMBOLS[:7])), a["l_linenumber"]))})
    return rows.withColumns({"positions": of(lambda a: F.array(a["l_quantity"], a["l_discount"], a["l_tax"])), "forces": of(lambda a: F.array(a["l_tax"], a["l_quantity"], F.lit(0.5)))}).drop("atoms")


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS source_index, CAST(count(*) AS INTEGER) AS n, any_value(o_totalprice) AS energy, any_value(o_custkey)::DOUBLE AS xy, round(sum(l_quantity), 4) AS x, round(sum(l_tax), 4) AS fx,
  string_agg(['H', 'He', 'Li', 'Be', 'B', 'C', 'N'][l_linenumber], '' ORDER BY l_linenumber) AS species FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey""")
def q27_extxyz_round_trip(spark, d):
    path = folder(spark)
    ready = sinks.model_ready(_frames(spark, d), "m", flat_stress=False)
    sinks.write_extxyz(ready, "m", path, ["source_index"], ("source_index",))
    rows = frames.read_extxyz(spark, path, r"\.txt$")
    total = lambda c, i: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + F.get(v, i)), 4)
    nine = F.split(F.col("info")["m_stress"], " ")
    return rows.select(F.col("info")["source_index"].alias("source_index"), "n", F.col("info")["m_energy"].cast("double").alias("energy"), F.get(nine, 1).cast("double").alias("xy"), total("positions", 0).alias("x"), total("forces", 0).alias("fx"), F.array_join("species", "").alias("species"))


@query("""SELECT o_orderstatus AS path, o_orderkey, CAST(r - 1 AS INTEGER) AS frame_ord FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 7""")
def q28_first_frames(spark, d):
    numbered = _t(spark, d, "orders").selectExpr("o_orderstatus AS path", "1 AS file_rank", "o_orderkey", "row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS frame_ord")
    return frames.in_file_order(frames.first_frames(numbered, 7)).drop("file_rank")


def _records(spark, d) -> str:
    """A JSON array of a record for each supplier, in one file; returns its path."""
    sites = '[{"species": [{"element": "H", "occu": 1}], "abc": [0.5, 0.5, 0.25]}, {"species": [{"element": "O", "occu": 1}], "xyz": [%d, 1, 2]}]'
    structure = F.format_string('{"lattice": {"matrix": [[1, 0, 0], [0, 2, 0], [0, 0, 4]]}, "sites": ' + sites + "}", "s_suppkey")
    stress = F.when(F.col("s_suppkey") % 2 == 0, F.format_string("[1, 2, 3, 4, 5, %d]", "s_nationkey")).otherwise(F.format_string("[[1, %d, 5], [%d, 2, 4], [5, 4, 3]]", "s_nationkey", "s_nationkey"))
    more = F.when(F.col("s_suppkey") % 3 > 0, F.format_string(', "matpes_id": "m%d", "formula_pretty": null', "s_suppkey")).otherwise(F.lit(""))
    record = F.concat(F.lit('{"structure": '), structure, F.lit(', "energy": '), F.col("s_acctbal").cast("string"), F.lit(', "forces": [[1, 2, 3], ['), F.col("s_nationkey").cast("string"), F.lit(', 5, 6]], "stress": '), stress, more, F.lit("}"))
    whole = _t(spark, d, "supplier").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", record.alias("r")))).alias("l"))  # the format is one array
    path = folder(spark)
    whole.select(F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["r"]), ",\n"), F.lit("]"))).coalesce(1).write.text(path)
    return path


RECORD_SQL = "SELECT *, CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS source_index FROM supplier"


@query(f"""SELECT source_index, 2 AS n, s_acctbal AS energy, 0.5::DOUBLE AS x0, 1::DOUBLE AS z0, s_suppkey::DOUBLE AS x1, s_nationkey::DOUBLE AS f, round(s_nationkey * {T.KBAR!r}::DOUBLE, 10) AS xy, '1,8' AS numbers,
  CASE WHEN s_suppkey % 3 > 0 THEN 'm' || s_suppkey END AS id, CASE WHEN s_suppkey % 3 > 0 THEN 2 ELSE 1 END AS fields FROM ({RECORD_SQL})""")
def q29_records_to_frames(spark, d):
    records = frames.read_json_array(spark, _records(spark, d))
    rows = frames.records_to_frames(records.where(T.is_record(F.col("structure"), F.col("energy"), F.col("forces"), F.col("stress"))))
    at = lambda c, i, j: F.get(F.get(F.col(c), i), j)
    return rows.select("source_index", "n", "energy", at("positions", 0, 0).alias("x0"), at("positions", 0, 2).alias("z0"), at("positions", 1, 0).alias("x1"), at("forces", 1, 0).alias("f"), F.round(at("stress", 0, 1), 10).alias("xy"), F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"), F.col("info")["matpes_id"].alias("id"), F.size("info").alias("fields"))


SPLIT_SQL = "SELECT *, CASE WHEN r <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'val' END AS split FROM (SELECT *, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM orders)"


def _members(spark, d) -> DataFrame:
    keys = _t(spark, d, "orders").select(F.col("o_orderkey").alias("source_index"))
    return splits.hashed_split(keys, "source_index", 0.8, "7", "ord")


@query(f"SELECT o_orderkey AS source_index FROM ({SPLIT_SQL}) WHERE split = 'val' ORDER BY o_orderkey LIMIT 200")
def q30_index_file(spark, d):
    path = folder(spark)
    sinks.write_indices(_members(spark, d), "val", path)
    chosen = frames.read_indices(spark, path, 200)
    lookups.check_range(chosen, "source_index", 1 << 40)
    return chosen


@query(f"SELECT split, r AS ord, o_orderkey AS source_index, o_totalprice FROM ({SPLIT_SQL})")
def q31_write_splits(spark, d):
    path = folder(spark)
    sinks.write_splits(_t(spark, d, "orders").select(F.col("o_orderkey").alias("source_index"), "o_totalprice"), _members(spark, d), path)
    return spark.read.parquet(path).select("split", F.col("ord").cast("long").alias("ord"), "source_index", "o_totalprice")


@query("""SELECT CAST(user_id AS VARCHAR) AS path, CAST(event_id AS INTEGER) AS epoch, CAST(r + 1 AS INTEGER) AS line, event_id + 0.5::DOUBLE AS E, user_id::DOUBLE AS F, 7::DOUBLE AS S
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE event_type <> 'error'""")
def q32_csv_logs(spark, d):
    head = 'Epoch,time,validation energy/x MAE (per atom),"validation forces[0], MAE",validation v MAE (per atom) virial[1]\n,s,meV,meV,meV'
    cell = F.when(F.col("event_type") == "error", F.lit(" ")).otherwise(F.col("event_id").cast("string"))
    line = F.concat_ws(",", cell, F.lit("0"), F.concat(F.col("event_id").cast("string"), F.lit(".5")), F.col("user_id").cast("string"), F.lit('"7"'))
    rows = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.struct("ts", "event_id", line.alias("line")).alias("r")).groupBy("path").agg(F.sort_array(F.collect_list("r")).alias("r"))
    return logs.csv_rows(rows.select("path", F.concat(F.lit(head + "\n"), F.array_join(F.transform("r", lambda x: x["line"]), "\n")).alias("content")))


@query("SELECT 'r' || r_regionkey AS parent, CAST(length(r_name) + 1 AS BIGINT) AS length, true AS dated FROM region")
def q33_artifacts(spark, d):
    path = folder(spark)
    for r in _t(spark, d, "region").collect():  # a fixed table of a few rows
        sinks.write_text(spark, r.r_name, f"{path}/r{r.r_regionkey}")
    rows = frames.artifacts(spark, path, ".txt")
    return rows.select(F.element_at(F.split("parent", "/"), -1).alias("parent"), "length", F.col("mtime").isNotNull().alias("dated"))


@query("""WITH o AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND contains('run-' || event_id || '-x', 'run-1'))
SELECT user_id, arg_max('f' || event_id, ts) AS path FROM events WHERE user_id IN (SELECT user_id FROM o) AND event_type = 'view' AND 'f' || event_id <> 'f17' GROUP BY user_id""")
def q34_restart_files(spark, d):
    events = _t(spark, d, "events").select("user_id", "event_type", "ts", F.concat(F.lit("f"), "event_id").alias("path"), F.concat(F.lit("run-"), "event_id", F.lit("-x")).alias("content"))
    files = lookups.restart_files(events.where("event_type = 'view'").drop("content"), events.where("event_type = 'signup'"), "user_id", "content", "run-1")
    return lookups.latest(lookups.except_pretrained(files, "path", "f17"), ["user_id"], "path", "ts")


@query("SELECT p_partkey, CAST(CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN p_size WHEN 2 THEN 1 ELSE 0 END AS INTEGER) AS gpus FROM part")
def q35_resources(spark, d):
    text = F.element_at(F.array(F.lit("cpu:3, gpu"), F.concat(F.lit("gpu:a100:"), "p_size"), F.lit("gpu:a100"), F.concat(F.lit("cpu:"), "p_size")), (F.col("p_size") % 4 + 1).cast("int"))
    return _t(spark, d, "part").select("p_partkey", T.gpus(text).alias("gpus"))


@query(r"""SELECT page_id, CASE WHEN contains(url, '=') THEN split_part(url, '=', 1) ELSE CASE WHEN regexp_replace(f, '\.[^.]*$', '') <> '' THEN regexp_replace(f, '\.[^.]*$', '') ELSE f END END AS label,
  CASE WHEN contains(url, '=') THEN regexp_replace(url, '^[^=]*=', '') ELSE url END AS path FROM (SELECT *, string_split(url, '/')[-1] AS f FROM pages)""")
def q36_label_and_path(spark, d):
    label, path = T.label_and_path(F.col("url"))
    return _t(spark, d, "pages").select("page_id", label.alias("label"), path.alias("path"))


@query("SELECT event_id, event_type || ' [1m' AS text FROM events")
def q37_strip_ansi(spark, d):
    text = F.concat(F.lit("\x1b[31;1m"), "event_type", F.lit("\x1b[0m [1m\r"))
    return _t(spark, d, "events").select("event_id", T.strip_ansi(text).alias("text"))


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[4] AS DOUBLE) AS b, CAST(embedding[6] AS DOUBLE) AS c FROM embeddings")
def q38_reshape_forces(spark, d):
    rows = _t(spark, d, "embeddings").select("vec_id", T.reshape_n3(F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double")), F.lit(2)).alias("m"))
    at = lambda i, j: F.get(F.get("m", i), j)
    return rows.select("vec_id", at(0, 0).alias("a"), at(1, 0).alias("b"), at(1, 2).alias("c"))


@query(f"SELECT vec_id, round(CAST(embedding[6] AS DOUBLE) * {T.KBAR!r}, 12) AS xy, round(CAST(embedding[3] AS DOUBLE) * {T.KBAR!r}, 12) AS zz FROM embeddings")
def q39_stress_from_kbar(spark, d):
    voigt = F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double"))
    rows = _t(spark, d, "embeddings").select("vec_id", T.stress_from_kbar(voigt, F.lit(None).cast("array<array<double>>")).alias("m"))
    return rows.select("vec_id", F.round(F.get(F.get("m", 0), 1), 12).alias("xy"), F.round(F.get(F.get("m", 2), 2), 12).alias("zz"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def q40_zip(spark, d):
    orders = _t(spark, d, "orders")
    return lookups.zip_strict(orders.select("o_orderkey", "o_custkey"), orders.select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("SELECT DISTINCT l_linenumber AS z FROM lineitem WHERE l_returnflag IN ('R', 'A')")
def q41_element_union(spark, d):
    atoms = _t(spark, d, "lineitem").withColumnRenamed("l_linenumber", "z")
    return lookups.element_union([atoms.where("l_returnflag = 'R'"), atoms.where("l_returnflag = 'A'")], "z")


@query("SELECT event_type AS label, CAST(count(*) AS INTEGER) AS epoch, round(avg(event_id), 6) AS \"E_meV_atom\" FROM events GROUP BY event_type")
def q42_metrics_csv(spark, d):
    path = folder(spark)
    sinks.write_metrics(_t(spark, d, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("epoch"), F.avg("event_id").alias("E_meV_atom")), path)
    return spark.read.schema("label string, epoch int, E_meV_atom double").csv(path, header=True).withColumn("E_meV_atom", F.round("E_meV_atom", 6))


@query(f"""SELECT split, CAST(count(*) AS BIGINT) AS sample_size, any_value(n) AS desired_frame_count, 'eV' AS energy_unit, {T.KBAR!r}::DOUBLE AS factor, 7 AS seed FROM ({SPLIT_SQL}) GROUP BY split""")
def q43_metadata(spark, d):
    path = folder(spark)
    counts = {r["split"]: r["count"] for r in _members(spark, d).groupBy("split").count().collect()}  # two rows
    for split, n in counts.items():
        sinks.write_text(spark, sinks.metadata(split, n, sum(counts.values()), seed=7), f"{path}/{split}")
    kinds = "created_at_utc timestamp, split string, sample_size long, desired_frame_count long, energy_unit string, stress_conversion_factor double, seed int"
    rows = spark.read.schema(kinds).option("recursiveFileLookup", "true").json(path, multiLine=True)
    return rows.where("created_at_utc is not null").select("split", "sample_size", "desired_frame_count", "energy_unit", F.col("stress_conversion_factor").alias("factor"), "seed")


@query("""WITH v AS (SELECT label, dim, sum(label * CAST(embedding[dim] AS DOUBLE)) AS value FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings) GROUP BY label, dim)
SELECT label, CAST(count(*) AS INTEGER) AS dims, round(sum(value), 5) AS total, round(arg_min(value, dim), 5) AS first FROM v GROUP BY label""")
def q44_descriptors(spark, d):
    path = folder(spark)
    sinks.write_descriptors(metrics.descriptors(_t(spark, d, "embeddings").withColumn("z", F.col("label")), "label", "z", "embedding"), path)
    total = F.aggregate("descriptor", F.lit(0.0), lambda a, x: a + x)
    return spark.read.parquet(path).select("label", F.size("descriptor").alias("dims"), F.round(total, 5).alias("total"), F.round(F.get("descriptor", 0), 5).alias("first"))


@query("""SELECT * FROM (VALUES ('train_dataset.splits.train.src', '/data/train'), ('train_dataset.splits.train.kind', 'a'), ('val_dataset.splits.val.src', '/data/val'), ('defaults', 'data=b,runner')) AS t(key, value)""")
def q45_yaml_paths(spark, d):
    path = folder(spark)
    given = {"train_dataset": {"splits": {"train": {"src": "old", "kind": "a"}}}, "defaults": [{"data": "b"}, "runner"]}
    configs.write_yaml(spark, given, f"{path}/given")
    workflow.set_paths(spark, f"{path}/given", f"{path}/set", "/data/train", "/data/val")

    def flat(at, key):
        if isinstance(at, dict):
            return [x for k, v in at.items() for x in flat(v, f"{key}.{k}" if key else k)]
        return [(key, ",".join("=".join(next(iter(x.items()))) if isinstance(x, dict) else x for x in at) if isinstance(at, list) else at)]

    return spark.createDataFrame(flat(configs.read_yaml(spark, f"{path}/set"), ""), "key string, value string")


@query(f"""WITH s AS ({RECORD_SQL}), n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM s), t AS (SELECT n, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT) AS train, n // 2 AS half FROM n), h AS (SELECT *, CAST(floor(half * CAST(0.8 AS DOUBLE)) AS BIGINT) AS ht FROM t)
SELECT unnest(['all', 'train', 'val', 'half', 'half_train', 'half_val']) AS split, unnest([n, train, n - train, half, ht, half - ht]) AS n, unnest([n, train, n - train, half, ht, half - ht]) AS frames FROM h""")
def q46_curate(spark, d):
    path = folder(spark)
    _t(spark, d, "supplier").select((F.col("s_suppkey") - F.lit(_t(spark, d, "supplier").agg(F.min("s_suppkey")).first()[0])).cast("string")).write.text(f"{path}/indices")
    counts = workflow.curate(spark, f"{path}/indices", _records(spark, d), f"{path}/out", seed=3)
    written = spark.read.parquet(f"{path}/out/frames").groupBy("split").agg(F.count("*").alias("frames"))
    return counts.join(written, "split")


@query(f"""SELECT o_orderkey AS source_index, CAST(count(*) AS BIGINT) AS n_atoms, round(any_value(o_totalprice) - sum(e_ref), 4) AS residual, any_value(o_custkey)::DOUBLE AS xy
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN (VALUES {REF_SQL}) AS r(z, e_ref) ON z = l_linenumber GROUP BY o_orderkey""")
def q47_normalize(spark, d):
    out = workflow.normalize(_frames(spark, d), _references(spark), "m", flat_stress=True)
    return out.select("source_index", "n_atoms", F.round("residual", 4).alias("residual"), F.get("m_stress", 1).alias("xy"))


@query("SELECT r_name AS label, CAST(r_regionkey AS INTEGER) AS epoch, 1.5::DOUBLE AS \"E_meV_atom\", 2::DOUBLE AS \"F_meV_A\", r_regionkey + 3::DOUBLE AS \"S_meV_scale\" FROM region")
def q48_evaluate(spark, d):
    path = folder(spark)
    rows = _t(spark, d, "region").collect()  # a fixed table of a few rows
    for r in rows:
        sinks.write_text(spark, f"start\nEpoch {r.r_regionkey}: MAE_E_per_atom= 1.5 meV, MAE_F= 2, MAE_stress= {r.r_regionkey + 3}\nend", f"{path}/{r.r_regionkey}")
    return workflow.evaluate(spark, [f"{r.r_name}={path}/{r.r_regionkey}" for r in rows], f"{path}/out").drop("source")
