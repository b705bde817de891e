"""Named queries over the test tables, with equivalent SQL.

The tables stand in for atomistic data: an order is a frame (its price the energy), a line an atom (its number the element),
an embedding a latent vector or tensor, a user's events in time order a training log, an event an artifact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tensors as T
from ..operators import lookups, metrics, splits
from ..sources import logs
from .registry import QUERIES, SQL, query
from .registry import read_table as _t

__all__ = ["QUERIES", "SQL", "flagship"]

#: reference energies of the stand-in elements; ``SOME`` leaves out 7
REFERENCES = [(z, 1000.0 * z) for z in range(1, 8)]
SOME = REFERENCES[:-1]
REF_SQL, SOME_SQL = (", ".join(f"({z}, {e})" for z, e in rows) for rows in (REFERENCES, SOME))
REQUIRED = ["energy", "forces", "stress", "signup", "view"]


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("z"))


def _references(spark: SparkSession, rows: list[tuple[int, float]] = REFERENCES) -> DataFrame:
    return spark.createDataFrame(rows, "z int, e_ref double")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def q01_select_by_index(spark, d):
    indices = _t(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lookups.select_by_index(_t(spark, d, "lineitem"), indices, "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100")
def q02_limit_after_sort(spark, d):
    return _t(spark, d, "orders").where("o_orderstatus = 'F'").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, CAST(r AS BIGINT) AS rank, CASE WHEN r <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'val' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM orders)""")
def q03_split_assign(spark, d):
    return splits.hashed_split(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.8, "7").select("o_orderkey", F.col("rank").cast("long").alias("rank"), "split")


HALF_SQL = """WITH h AS (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('half:' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= n // 2),
s AS (SELECT o_orderkey, CASE WHEN r <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'half_train' ELSE 'half_val' END AS split FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('inner:' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM h))
"""


def _half(spark, d):
    half = splits.hashed_half(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", "half")
    return splits.hashed_split(half, "o_orderkey", 0.8, "inner").withColumn("split", F.concat(F.lit("half_"), "split"))


@query(HALF_SQL + "SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM s GROUP BY split")
def q04_half_split(spark, d):
    return _half(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(HALF_SQL + """, v AS (SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7:' || o_orderkey), o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r > floor(n * CAST(0.8 AS DOUBLE)))
SELECT CAST(count(*) AS BIGINT) AS overlap FROM s JOIN v USING (o_orderkey) WHERE split = 'half_train'""")
def q05_split_overlap(spark, d):
    val = splits.hashed_split(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.8, "7").where("split = 'val'").select("o_orderkey")
    return _half(spark, d).where("split = 'half_train'").join(val, "o_orderkey", "left_semi").agg(F.count("*").alias("overlap"))


@query("""SELECT vec_id, round(CAST(e[1] AS DOUBLE), 6) AS s1, round(CAST(e[6] AS DOUBLE), 6) AS s2, round(CAST(e[5] AS DOUBLE), 6) AS s3, round(CAST(e[6] AS DOUBLE), 6) AS s4, round(CAST(e[2] AS DOUBLE), 6) AS s5,
round(CAST(e[4] AS DOUBLE), 6) AS s6, round(CAST(e[5] AS DOUBLE), 6) AS s7, round(CAST(e[4] AS DOUBLE), 6) AS s8, round(CAST(e[3] AS DOUBLE), 6) AS s9, round(CAST(e[1] AS DOUBLE) + CAST(e[2] AS DOUBLE) + CAST(e[3] AS DOUBLE), 6) AS trace
FROM (SELECT vec_id, embedding AS e FROM embeddings)""")
def q06_voigt(spark, d):
    nine = T.voigt_to_nine(F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double")))
    rows = _t(spark, d, "embeddings").select("vec_id", nine.alias("s"))
    return rows.select("vec_id", *(F.round(F.get("s", i), 6).alias(f"s{i + 1}") for i in range(9)), F.round(F.get("s", 0) + F.get("s", 4) + F.get("s", 8), 6).alias("trace"))


@query("""SELECT l_orderkey AS o_orderkey, array_to_string(list_sort(list_distinct(list(l_linenumber))), ',') AS elements FROM lineitem GROUP BY l_orderkey""")
def q07_element_set(spark, d):
    return lookups.element_sets(_atoms(spark, d), "o_orderkey", "z").select("o_orderkey", F.array_join(F.transform("elements", lambda x: x.cast("string")), ",").alias("elements"))


@query(f"""SELECT o_orderkey, CAST(count(*) AS BIGINT) AS n_atoms, round(any_value(o_totalprice) - sum(e_ref), 4) AS residual
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN (VALUES {REF_SQL}) AS r(z, e_ref) ON z = l_linenumber GROUP BY o_orderkey""")
def q08_ref_subtract(spark, d):
    out = lookups.subtract_references(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), _atoms(spark, d), _references(spark), "o_orderkey", "o_totalprice")
    return out.select("o_orderkey", "n_atoms", F.round("residual", 4).alias("residual"))


@query(f"SELECT DISTINCT l_linenumber AS z FROM lineitem WHERE l_linenumber NOT IN (SELECT z FROM (VALUES {SOME_SQL}) AS r(z, e_ref))")
def q09_missing_ref(spark, d):
    return lookups.missing_references(_atoms(spark, d), _references(spark, SOME))


@query("""SELECT d.doc_id, CAST(coalesce(CASE WHEN l.toxic = 1 THEN l.quality END, l.toxic, d.n_chars) AS BIGINT) AS target FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def q10_target_coalesce(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "n_chars").join(_t(spark, d, "labels"), "doc_id", "left")
    info = F.map_from_arrays(F.array(F.lit("energy")), F.array(F.when(F.col("toxic") == 1, F.col("quality")).cast("long")))
    arrays = F.map_from_arrays(F.array(F.lit("energy")), F.array(F.col("toxic").cast("long")))
    return rows.select("doc_id", T.resolve_target(["energy"], info, arrays, F.col("n_chars")).alias("target"))


def _log_files(spark, d, line) -> DataFrame:
    """path and content of a log for each user, with a line for each event, in time order."""
    rows = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.struct("ts", "event_id", line.alias("line")).alias("r"))
    return rows.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["line"]), "\n").alias("content"))


_kind = lambda kind: F.col("event_type") == kind
_number = lambda c, tail="": F.concat(F.col(c).cast("string"), F.lit(tail))
LINES_SQL = "l AS (SELECT CAST(user_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS line, * FROM events)"


@query(f"""WITH {LINES_SQL} SELECT path, CAST(user_id AS INTEGER) AS epoch, line, event_id + 0.5::DOUBLE AS E, user_id + 0.25::DOUBLE AS F, 30::DOUBLE AS S FROM l WHERE event_type = 'view'""")
def q11_log_regex(spark, d):
    found = F.concat(F.lit("INFO Epoch "), "user_id", F.lit(": loss=1, MAE_E_per_atom= "), _number("event_id", ".5 meV, MAE_F= "), _number("user_id", ".25, MAE_stress=  3e1"))
    return logs.text_rows(_log_files(spark, d, F.when(_kind("view"), found).otherwise(F.concat(F.lit("Epoch 7 "), "event_type"))))


@query(f"""WITH RECURSIVE {LINES_SQL},
s(path, line, epoch, E, F, S, oE, oF, oS) AS (
  SELECT DISTINCT path, -1, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM l
  UNION ALL
  SELECT path, line, epoch, CASE WHEN NOT done THEN E END, CASE WHEN NOT done THEN F END, CASE WHEN NOT done THEN S END, CASE WHEN done THEN E END, CASE WHEN done THEN F END, CASE WHEN done THEN S END
  FROM (SELECT *, E IS NOT NULL AND F IS NOT NULL AND S IS NOT NULL AS done FROM (
    SELECT l.path, l.line, CASE WHEN l.event_type = 'signup' THEN l.event_id ELSE s.epoch END AS epoch,
      CASE WHEN l.event_type = 'signup' OR s.epoch IS NULL THEN NULL WHEN l.event_type = 'view' THEN l.event_id + 0.5 ELSE s.E END AS E,
      CASE WHEN l.event_type = 'signup' OR s.epoch IS NULL THEN NULL WHEN l.event_type = 'click' THEN l.event_id + 0.25 ELSE s.F END AS F,
      CASE WHEN l.event_type = 'signup' OR s.epoch IS NULL THEN NULL WHEN l.event_type = 'error' THEN l.event_id ELSE s.S END AS S
    FROM s JOIN l ON l.path = s.path AND l.line = s.line + 1)))
SELECT path, CAST(epoch AS INTEGER) AS epoch, round(oE * 1000, 3) AS E, round(oF * 1000, 3) AS F, round(oS * 1000, 3) AS S FROM s WHERE oE IS NOT NULL""")
def q12_log_state_machine(spark, d):
    of = {"signup": F.concat(F.lit("\x1b[1mEval Epoch "), "event_id", F.lit("\x1b[0m")), "view": F.concat(F.lit("val/a energy,per_atom_mae: "), _number("event_id", ".5"))}
    of |= {"click": F.concat(F.lit("x val/a forces,mae: "), _number("event_id", ".25")), "error": F.concat(F.lit("val/a stress,mae: "), "event_id")}
    line = F.coalesce(*(F.when(_kind(k), v) for k, v in of.items()), F.lit("other"))
    return logs.stateful_rows(_log_files(spark, d, line)).select("path", "epoch", *(F.round(c, 3).alias(c) for c in "EFS"))


@query(f"""WITH {LINES_SQL} SELECT path, CAST(user_id AS INTEGER) AS epoch, line, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 1000 AS E, event_id * 1000::DOUBLE AS F, 500::DOUBLE AS S FROM l
WHERE event_type = 'click' AND json_extract_string(props, '$.k') IS NOT NULL""")
def q13_json_eval_rows(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("double")
    found = F.to_json(F.struct(F.lit("eval").alias("mode"), F.col("user_id").alias("epoch"), k.alias("mae_e_per_atom"), F.col("event_id").alias("mae_f"), F.lit(0.5).alias("mae_stress")))
    return logs.jsonl_rows(_log_files(spark, d, F.when(_kind("click"), found).when(_kind("view"), F.lit('{"mode": "opt"}')).otherwise(F.lit("text"))))


@query("""WITH f AS (SELECT * FROM events WHERE event_type IN ('view', 'click', 'error')),
b AS (SELECT user_id, arg_max(event_id, ts) AS event_id FROM f GROUP BY user_id)
SELECT CAST(f.user_id AS VARCHAR) AS label, 'f' || event_id AS path, CAST(user_id AS INTEGER) AS epoch, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS line,
  CASE WHEN event_type = 'click' THEN 2000 ELSE event_id END::DOUBLE AS E, CASE WHEN event_type = 'click' THEN 3000 ELSE 2 END::DOUBLE AS F, CASE WHEN event_type = 'click' THEN 4000 ELSE 3 END::DOUBLE AS S
FROM f JOIN b USING (user_id, event_id)""")
def q14_parser_cascade(spark, d):
    text = F.concat(F.lit("Epoch "), "user_id", F.lit(": MAE_E_per_atom= "), "event_id", F.lit(", MAE_F= 2, MAE_stress= 3"))
    json = F.concat(F.lit('\n{"mode": "eval", "epoch": '), "user_id", F.lit(', "mae_e_per_atom": 2, "mae_f": 3, "mae_stress": 4}'))
    content = F.when(_kind("view"), text).when(_kind("click"), json).when(_kind("error"), F.concat(text, json)).otherwise(F.lit("nothing"))
    files = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("label"), F.concat(F.lit("f"), "event_id").alias("path"), F.col("ts").alias("mtime"), content.alias("content"))
    return logs.cascade(files).withColumn("line", F.col("line").cast("int"))


@query("""SELECT l_returnflag, round(avg(abs(l_extendedprice - 1000 * l_quantity)), 4) AS mae, round(avg(abs(l_extendedprice - 1000 * l_quantity) / l_linenumber), 4) AS per_atom_mae, round(avg(pow(l_discount - l_tax, 2)), 8) AS mse
FROM lineitem GROUP BY l_returnflag""")
def q15_error_metrics(spark, d):
    p, t = F.col("l_extendedprice"), 1000 * F.col("l_quantity")
    return _t(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(metrics.mae(p, t), 4).alias("mae"), F.round(metrics.per_atom_mae(p, t, F.col("l_linenumber")), 4).alias("per_atom_mae"), F.round(metrics.mse(F.col("l_discount"), F.col("l_tax")), 8).alias("mse"))


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std FROM orders GROUP BY o_orderstatus")
def q16_target_stats(spark, d):
    return _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_pop("o_totalprice"), 4).alias("std"))


@query("""WITH p AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
t AS (SELECT vec_id, list_sum(list_transform(range(1, len(x) + 1), lambda i: CAST(x[i] AS DOUBLE) * CAST(y[i] AS DOUBLE))) AS xy, sqrt(list_sum(list_transform(x, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) AS nx, sqrt(list_sum(list_transform(y, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) AS ny FROM p)
SELECT vec_id, round(xy / (nx * ny), 5) AS cosine, round(abs(nx - ny), 5) AS magnitude_error FROM t""")
def q17_force_vector_metrics(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    return pairs.select("vec_id", F.round(T.cosine(F.col("x"), F.col("y")), 5).alias("cosine"), F.round(F.abs(T.norm(F.col("x")) - T.norm(F.col("y"))), 5).alias("magnitude_error"))


@query("""SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(sum(label * CAST(embedding[dim] AS DOUBLE)), 6) AS value FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS dim FROM embeddings) GROUP BY label, dim""")
def q18_latent_descriptor(spark, d):
    e = _t(spark, d, "embeddings").withColumn("z", F.col("label"))
    return metrics.weighted_vector_sum(e, "label", "z", "embedding").select("label", "dim", F.round("value", 6).alias("value"))


@query("SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id")
def q19_latest_artifact(spark, d):
    return lookups.latest(_t(spark, d, "events"), ["user_id"], "event_id", "ts")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q20_sibling_semi_join(spark, d):
    siblings = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return lookups.with_sibling(_t(spark, d, "orders"), siblings, "o_orderkey").select("o_orderkey", "o_custkey")


@query(r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:]+)', 1) AS host FROM pages")
def q21_host_from_url(spark, d):
    return _t(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1).alias("host"))


@query(f"SELECT k FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)})' for k in REQUIRED)}) AS r(k) WHERE k NOT IN (SELECT event_type FROM events)")
def q22_set_difference(spark, d):
    return lookups.missing_keys(REQUIRED, _t(spark, d, "events").select(F.col("event_type").alias("k")), "k")


@query("""SELECT 'orders' AS label, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 4) AS mean FROM orders UNION ALL SELECT 'lines', count(*), round(avg(l_extendedprice), 4) FROM lineitem""")
def q23_long_table_union(spark, d):
    part = lambda name, label, c: _t(spark, d, name).agg(F.count("*").alias("n"), F.round(F.avg(c), 4).alias("mean")).select(F.lit(label).alias("label"), "n", "mean")
    return part("orders", "orders", "o_totalprice").unionByName(part("lineitem", "lines", "l_extendedprice"))


@query("""SELECT l_linestatus, round(20 * avg(abs(l_discount - l_tax) / l_linenumber) + 2 * avg(sqrt(pow(l_quantity - 25, 2) + pow(l_discount, 2) + pow(l_tax - 1, 2))) + avg(abs(l_tax)), 6) AS loss FROM lineitem GROUP BY l_linestatus""")
def q24_weighted_loss(spark, d):
    forces = F.array("l_quantity", "l_discount", "l_tax"), F.array(F.lit(25.0), F.lit(0.0), F.lit(1.0))
    loss = metrics.weighted_loss(metrics.per_atom_mae(F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber")), metrics.l2_norm_loss(*forces), metrics.mae(F.col("l_tax"), F.lit(0.0)))
    return _t(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(loss, 6).alias("loss"))


@query("""SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS flagged, bool_and(l_quantity > 5) AS all_valid, bool_or(l_tax > 0.07) AND bool_or(l_discount > 0.05) AS have_all FROM lineitem GROUP BY l_orderkey""")
def q25_validity_gates(spark, d):
    rows = _t(spark, d, "lineitem")
    have = metrics.have_all(["tax", "discount"], {"tax": F.when(F.col("l_tax") > 0.07, 1), "discount": F.when(F.col("l_discount") > 0.05, 1)})
    return rows.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("flagged"), metrics.all_valid(F.col("l_quantity") > 5).alias("all_valid"), have.alias("have_all"))


@query("""SELECT o_orderstatus, o_orderkey, round((o_totalprice - 0.0) / sqrt(avg(o_totalprice * o_totalprice) OVER (PARTITION BY o_orderstatus)), 6) AS normalized FROM orders""")
def q26_target_normalization(spark, d):
    o = _t(spark, d, "orders")
    scale = o.groupBy("o_orderstatus").agg(metrics.rmsd(F.col("o_totalprice")).alias("rmsd"))
    return o.join(scale, "o_orderstatus").select("o_orderstatus", "o_orderkey", F.round(metrics.normalized(F.col("o_totalprice"), F.col("rmsd")), 6).alias("normalized"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames less reference energies, split by digest: count, mean and MAE of the residual by split."""
    frames = lookups.subtract_references(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), _atoms(spark, sf_dir), _references(spark), "o_orderkey", "o_totalprice")
    return splits.hashed_split(frames, "o_orderkey", 0.8, "7").groupBy("split").agg(F.count("*").alias("frames"), F.avg("residual").alias("mean"), metrics.mae(F.col("residual"), F.lit(0.0)).alias("mae"))
