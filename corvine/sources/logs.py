"""Training logs of four dialects as one table of errors: path, epoch, line, E, F, S.

Files are read whole, so that line numbers are a column. Each dialect is a function from files to rows; a cell that
can't be read voids the dialect for its file. Of each run the newest file with rows in any dialect wins, there the first
dialect with rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tensors import strip_ansi, try_number

NUMBER = r"([0-9.eE+-]+)"
#: line ends of text files: universal newlines, and those that also end a line in Python
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
#: Fixed names and patterns of the four dialects.
CSV_COLUMNS = {"E": ("validation energy/", "MAE (per atom)"), "F": ("validation forces[", "MAE"), "S": ("validation ", "MAE (per atom)", "virial[")}
TEXT_LINE = rf"Epoch\s+(\d+):.*?MAE_E_per_atom=\s*{NUMBER}.*?MAE_F=\s*{NUMBER}.*?MAE_stress=\s*{NUMBER}"
EVAL_HEADER = r"Eval Epoch\s+(\d+)"
EVAL_VALUES = {"E": rf"val/.*energy,per_atom_mae:\s*{NUMBER}", "F": rf"val/.*forces,mae:\s*{NUMBER}", "S": rf"val/.*stress,mae:\s*{NUMBER}"}
CANDIDATES = r"(^|/)(train\.csv|output\.log|[^/]*\.out|[^/]*_train\.txt)$"


def read_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, mtime, content of text files; bytes that aren't UTF-8 become replacement characters."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    return rows.select("path", F.col("modificationTime").alias("mtime"), F.decode("content", "UTF-8").alias("content"))


def lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", LINE_END)).alias("line", "text"))


def _voided(rows: DataFrame) -> DataFrame:
    """Rows of the files in which all rows can be read."""
    bad = F.max(F.expr("epoch is null or E is null or F is null or S is null")).over(W.partitionBy("path"))
    return rows.withColumn("_bad", bad).where("not _bad").drop("_bad")


def matching(header: Column, needles: tuple[str, ...]) -> Column:
    """The place of the first cell that holds all needles."""
    hit = lambda c: F.forall(F.array(*map(F.lit, needles)), lambda n: F.contains(c, n))
    return F.array_position(F.transform(header, hit), True) - 1


def csv_rows(files: DataFrame) -> DataFrame:
    """Header, a row of units that is skipped, data; columns by substrings; rows with a blank first cell are skipped."""
    cells = lambda c: F.transform(F.split(c, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.regexp_replace(x, '^"|"$', ""))
    all_ = lines(files).select("path", "line", cells(F.col("text")).alias("c"))
    heads = all_.where("line = 0").select("path", matching(F.col("c"), ("Epoch",)).alias("_epoch"), F.array_position("c", "Epoch").alias("_at"), *(matching(F.col("c"), n).alias(f"_{k}") for k, n in CSV_COLUMNS.items()))
    heads = heads.where("_at > 0 and _E >= 0 and _F >= 0 and _S >= 0")
    rows = all_.where("line > 1").join(heads, "path").where(F.trim(F.get("c", 0)) != "")
    number = lambda k: try_number(F.get("c", F.col(f"_{k}").cast("int"))).alias(k)
    return _voided(rows.select("path", F.trim(F.get("c", (F.col("_at") - 1).cast("int"))).try_cast("int").alias("epoch"), "line", number("E"), number("F"), number("S")))


def text_rows(files: DataFrame) -> DataFrame:
    part = lambda i: F.regexp_extract("text", TEXT_LINE, i)
    rows = lines(files).where(F.col("text").rlike(TEXT_LINE))
    return _voided(rows.select("path", part(1).try_cast("int").alias("epoch"), "line", *(try_number(part(i)).alias(k) for i, k in ((2, "E"), (3, "F"), (4, "S")))))


def jsonl_rows(files: DataFrame) -> DataFrame:
    """Lines that begin with a brace; evaluations in units of 1/1000. A line that isn't JSON voids the file."""
    kinds = "mode string, epoch int, mae_e_per_atom double, mae_f double, mae_stress double, _bad string"
    rows = lines(files).where(F.startswith("text", F.lit("{"))).select("path", "line", F.from_json("text", kinds, {"columnNameOfCorruptRecord": "_bad"}).alias("j"))
    voids = rows.where("j._bad is not null").select("path").distinct()
    rows = rows.where("j.mode = 'eval' and j.epoch is not null and j.mae_e_per_atom is not null").join(voids, "path", "left_anti")
    return _voided(rows.select("path", "j.epoch", "line", *((F.col(f"j.{c}") * 1000).alias(k) for c, k in (("mae_e_per_atom", "E"), ("mae_f", "F"), ("mae_stress", "S")))))


def stateful_rows(files: DataFrame) -> DataFrame:
    """Values after a header, in units of 1/1000; a row whenever all three are there, then they start anew; a header clears them.

    A running header number cuts each file into evaluations; an ordered fold over one evaluation's few values makes its rows.
    """
    clean = lines(files).select("path", "line", strip_ansi(F.col("text")).alias("text"))
    found = clean.select("path", "line", F.regexp_extract("text", EVAL_HEADER, 1).try_cast("int").alias("header"), *(F.regexp_extract("text", p, 1).alias(k) for k, p in EVAL_VALUES.items())).where("header is not null or E != '' or F != '' or S != ''")
    upto = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    runs = found.select("*", F.last("header", ignorenulls=True).over(upto).alias("epoch"), F.count("header").over(upto).alias("run")).where("epoch is not null")
    one = lambda k: F.when(F.col(k) != "", F.struct(F.lit(k).alias("k"), try_number(F.col(k)).alias("v")))
    values = runs.select("path", "epoch", "run", "line", F.filter(F.array(one("E"), one("F"), one("S")), lambda x: x.isNotNull()).alias("vs"))
    grouped = values.groupBy("path", "epoch", "run").agg(F.min("line").alias("line"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line", "vs"))), lambda x: x["vs"])).alias("vs"))
    triple = "named_struct('E', s.E, 'F', s.F, 'S', s.S)"
    step = "named_struct('E', if(x.k = 'E', x.v, s.E), 'F', if(x.k = 'F', x.v, s.F), 'S', if(x.k = 'S', x.v, s.S), 'out', s.out)"
    zero = "named_struct('E', cast(null as double), 'F', cast(null as double), 'S', cast(null as double), 'out', cast(array() as array<struct<E: double, F: double, S: double>>))"
    fold = f"""aggregate(vs, {zero}, (s0, x0) -> element_at(transform(array(struct(s0 as s, x0 as x)), y -> element_at(transform(array({step.replace("s.", "y.s.").replace("x.", "y.x.")}), s ->
      if(s.E is not null and s.F is not null and s.S is not null, named_struct('E', cast(null as double), 'F', cast(null as double), 'S', cast(null as double), 'out', concat(s.out, array({triple}))), s)), 1)), 1), s -> s.out)"""
    bad = F.max(F.exists("vs", lambda x: x["v"].isNull())).over(W.partitionBy("path"))
    rows = grouped.withColumn("_bad", bad).where("not _bad").select("path", "epoch", "line", F.posexplode(F.expr(fold)).alias("_n", "r"))
    return rows.select("path", "epoch", (F.col("line") + F.col("_n")).alias("line"), *((F.col(f"r.{k}") * 1000).alias(k) for k in "EFS"))


DIALECTS = [csv_rows, text_rows, jsonl_rows, stateful_rows]


def cascade(files: DataFrame) -> DataFrame:
    """label, path, epoch, line, E, F, S of ``files`` (label, path, mtime, content): of each label the newest file with rows, by its first dialect with rows."""
    rows = None
    for rank, dialect in enumerate(DIALECTS):
        part = dialect(files.select("path", "content")).select(F.lit(rank).alias("rank"), "path", F.col("epoch").cast("int").alias("epoch"), F.col("line").cast("long").alias("line"), "E", "F", "S")
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.join(files.select("label", "path", "mtime"), "path")
    best = rows.groupBy("label").agg(F.max(F.struct("mtime", "path", (-F.col("rank")).alias("r"))).alias("b")).select("label", F.col("b.path").alias("path"), (-F.col("b.r")).alias("rank"))
    return rows.join(best, ["label", "path", "rank"]).select("label", "path", "epoch", "line", "E", "F", "S")


def load(files: DataFrame) -> DataFrame:
    """The long table label, epoch, E_meV_atom, F_meV_A, S_meV_scale, source; raises if a label has no rows."""
    out = cascade(files)
    without = [r[0] for r in files.select("label").distinct().join(out.select("label").distinct(), "label", "left_anti").collect()]  # labels are a user's short list
    if without:
        raise ValueError(f"no E/F/S metrics found for {', '.join(map(str, without))}")
    return out.select("label", "epoch", F.col("E").alias("E_meV_atom"), F.col("F").alias("F_meV_A"), F.col("S").alias("S_meV_scale"), F.col("path").alias("source")).orderBy("label", "epoch", "line")
