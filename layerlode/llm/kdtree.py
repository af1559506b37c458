"""Sharding by a k-d tree over metadata, split at weighted medians until leaves reach a target of bytes."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerlode.llm.common import materialise, split_by_size

#: Bytes of text in a leaf at most, where rows differ; rows of a node that one task takes over.
TARGET_BYTES, LOCAL_ROWS = 1 << 20, 200_000
DIMENSIONS = ("n_chars", "source", "lang", "doc_id")
#: Ranges that a node's values are counted in at once.
_ARITY = 256
_LARGEST = sys.float_info.max
_WHOLE = ("tinyint", "smallint", "int", "bigint")
#: Differences of whole numbers closer than this are taken exactly; wider ones, which may not fit 64 bits, as doubles.
_NARROW = 1 << 60


def _ranks(values: DataFrame) -> DataFrame:
    """(v, rank from 1) of a column's distinct values in their order: ranges of values are numbered apart, then shifted."""
    ranged = values.where("v is not null").distinct().repartitionByRange("v").withColumn("p", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    shift = ranged.groupBy("p").count().withColumn("before", F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)))
    own = ranged.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("v")))
    return own.join(F.broadcast(shift), "p").select("v", (F.col("r") + F.coalesce("before", F.lit(0))).cast("bigint").alias("rank"))


def _number(c: Column, kind: str) -> tuple[Column, str]:
    """A dimension as a whole number or a double that is never null."""
    if kind in _WHOLE:
        return F.coalesce(c.cast("bigint"), F.lit(-1).cast("bigint")), "bigint"
    if kind in ("float", "double") or kind.startswith("decimal"):
        c = c.cast("double")
        return F.when(c.isNull() | F.isnan(c), F.lit(-1.0)).otherwise(F.greatest(F.least(c, F.lit(_LARGEST)), F.lit(-_LARGEST))), "double"
    if kind == "boolean":
        return F.coalesce(c.cast("int").cast("bigint"), F.lit(-1).cast("bigint")), "bigint"
    if kind == "date":
        return F.coalesce(F.unix_date(c).cast("bigint"), F.lit(-1).cast("bigint")), "bigint"
    return F.coalesce(F.unix_micros(c.cast("timestamp")), F.lit(-1).cast("bigint")), "bigint"


def _coordinates(docs: DataFrame, dimensions: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """(doc_id, bytes, x0, x1, ...) and the types of the coordinates: numbers, dates and times as they are, all else as
    the rank of its text among the distinct ones, nulls first."""
    out = docs.select("doc_id", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("bigint").alias("bytes"), *[F.col(d).alias(f"_{i}") for i, d in enumerate(dimensions)])
    kinds = dict(out.dtypes)
    types = []
    for i in range(len(dimensions)):
        kind = kinds[f"_{i}"]
        if kind in _WHOLE or kind in ("float", "double", "boolean", "date", "timestamp", "timestamp_ntz") or kind.startswith("decimal"):
            value, kind = _number(F.col(f"_{i}"), kind)
            out = out.withColumn(f"x{i}", value)
            types.append(kind)
        else:
            out = out.withColumn(f"_{i}", F.col(f"_{i}").cast("string"))
            ranks = _ranks(out.select(F.col(f"_{i}").alias("v")))
            out = out.join(split_by_size(ranks.select(F.col("v").alias(f"_{i}"), F.col("rank").alias(f"x{i}"))), f"_{i}", "left").withColumn(f"x{i}", F.coalesce(f"x{i}", F.lit(0)).cast("bigint"))
            types.append("bigint")
    return out.select("doc_id", "bytes", *[f"x{i}" for i in range(len(dimensions))]), types


def _split_value(values: np.ndarray, weights: np.ndarray):
    """The weighted median, or the value before the largest if the median is the largest: rows up to it go left."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    last = np.append(np.flatnonzero(values[1:] != values[:-1]), len(values) - 1)
    sums = np.cumsum(weights)[last]
    k = int(np.searchsorted(2 * sums, sums[-1]))
    return values[last[min(k, len(last) - 2)]]


def _finish(spans: list[float], types: list[str], target: int):
    def run(rows: pa.Table) -> pa.Table:
        x = [rows.column(f"x{i}").to_numpy() for i in range(len(types))]
        weights = rows.column("bytes").to_numpy()
        paths = np.empty(len(weights), dtype=object)
        todo = [(np.arange(len(weights)), rows.column("path")[0].as_py())]
        while todo:
            at, path = todo.pop()
            axis, widest = -1, 0.0
            if weights[at].sum() > target:
                for i, v in enumerate(x):
                    low, high = v[at].min(), v[at].max()
                    width = _share(float(low), float(high), spans[i])
                    if high > low and (axis < 0 or width > widest):
                        axis, widest = i, width
            if axis < 0:
                paths[at] = path
                continue
            left = x[axis][at] <= _split_value(x[axis][at], weights[at])
            todo += [(at[left], path + "0"), (at[~left], path + "1")]
        return pa.Table.from_arrays([rows.column("doc_id"), pa.array(paths, pa.string()), rows.column("bytes")], names=["doc_id", "path", "bytes"])

    return run


def _share(low: float, high: float, half_span: float) -> float:
    """Halves are subtracted, so that no difference overflows."""
    return (high / 2 - low / 2) / half_span if half_span > 0 else 0.0


def _axis(half_spans: list[float]) -> Column:
    """The dimension of the largest extent as a share of the whole table's, the first of equals; -1 if there is none."""
    widths = [F.when(F.col(f"x{i}hi") > F.col(f"x{i}lo"), (F.col(f"x{i}hi").cast("double") / 2 - F.col(f"x{i}lo").cast("double") / 2) / F.lit(s if s > 0 else 1.0)).otherwise(F.lit(-1.0)) for i, s in enumerate(half_spans)]
    every = F.array(*widths)
    return F.when(F.array_max(every) < 0, F.lit(-1)).otherwise(F.array_position(every, F.array_max(every)).cast("int") - 1)


def _bin(low: str, high: str, value: str, whole: bool) -> str:
    """Which of ``_ARITY`` equal ranges from low to high a value is in; the ends are in the first and the last."""
    share = f"try_divide(cast({value} as double) / 2 - cast({low} as double) / 2, cast({high} as double) / 2 - cast({low} as double) / 2)"
    wide = f"cast(least(floor(coalesce({share}, if({value} = {low}, 0D, 1D)) * {_ARITY}), {_ARITY - 1}) as int)"
    if not whole:
        return f"case when {low} = {high} then 0 else {wide} end"
    narrow = f"cast(({value} - {low}) div (({high} - {low}) div {_ARITY} + 1) as int)"
    return f"case when cast({high} as double) - cast({low} as double) < {_NARROW} then {narrow} else {wide} end"


def _medians(rows: DataFrame, nodes: DataFrame, types: list[str]) -> DataFrame:
    """(path, axis, iv, dv): where each of ``nodes(path, axis)`` splits, as a whole number or a double.

    Bytes are counted in ever narrower ranges of values. A round is one aggregation, to at most ``_ARITY`` rows a node; the
    ranges stay tables, so that the driver holds none of the nodes.
    """

    def value(kind: str) -> Column:
        own = [F.when(F.col("axis") == i, F.col(f"x{i}")) for i, t in enumerate(types) if t == kind]
        return F.coalesce(*own, F.lit(None)).cast(kind) if own else F.lit(None).cast(kind)

    held = materialise(rows.join(split_by_size(nodes), "path").select("path", "axis", value("bigint").alias("iv"), value("double").alias("dv"), "bytes"), "values")
    ends = held.groupBy("path").agg(F.min("iv").alias("ilo"), F.max("iv").alias("ihi"), F.min("dv").alias("dlo"), F.max("dv").alias("dhi"), F.sum("bytes").alias("total"))
    ends = materialise(ends, "ends")
    ranges, done = ends.withColumn("run", F.lit(0).cast("bigint")), None
    order = Window.partitionBy("path").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        inside = held.join(split_by_size(ranges), "path").where("iv between ilo and ihi or dv between dlo and dhi")
        bins = inside.withColumn("bin", F.expr(f"if(iv is null, {_bin('dlo', 'dhi', 'dv', False)}, {_bin('ilo', 'ihi', 'iv', True)})"))
        bins = bins.groupBy("path", "bin").agg(F.sum("bytes").alias("w"), F.min("iv").alias("ilo"), F.max("iv").alias("ihi"), F.min("dv").alias("dlo"), F.max("dv").alias("dhi"), F.first("run").alias("run"), F.first("total").alias("total"))
        upto = bins.withColumn("upto", F.col("run") + F.sum("w").over(order)).where("2 * upto >= total")
        found = upto.groupBy("path").agg(F.min_by(F.struct("ilo", "ihi", "dlo", "dhi", (F.col("upto") - F.col("w")).alias("run"), "total"), "bin").alias("s")).select("path", "s.*")
        found = materialise(found, "ranges")
        ready = found.where("ilo = ihi or dlo = dhi").selectExpr("path", "ilo as iv", "dlo as dv")
        done = ready if done is None else done.unionByName(ready)
        ranges = found.where("not (coalesce(ilo = ihi, false) or coalesce(dlo = dhi, false))")
        if ranges.isEmpty():
            break
    # A median that is the largest value gives way to the one before it.
    cuts = materialise(done.join(ends.select("path", "ihi", "dhi"), "path").selectExpr("path", "iv", "dv", "coalesce(iv = ihi, dv = dhi) as full"), "cuts")
    full = cuts.where("full").select("path", F.col("iv").alias("ci"), F.col("dv").alias("cd"))
    before = held.join(split_by_size(full), "path").where("iv < ci or dv < cd").groupBy("path").agg(F.max("iv").alias("iv"), F.max("dv").alias("dv"))
    return nodes.select("path", "axis").join(cuts.where("not full").select("path", "iv", "dv").unionByName(before), "path")


def kd_tree_shards(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, target_bytes: int = TARGET_BYTES, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Assign every row to a leaf of a k-d tree: doc_id, shard_path ("0" left, "1" right at each split) and bytes.

    A node of more than ``target_bytes`` bytes of text is split along the dimension whose extent is the largest share
    of the whole table's extent (the first of equals), at the median of its values weighted by bytes: rows up to the
    median go left. A median that is the largest value gives way to the value before it, so both sides have rows.
    Rows that agree in every dimension are never split: a single document or repeated rows can exceed the target.

    Nodes of more than ``local_rows`` rows are split by distributed counting, a level of the tree at a time; smaller
    ones go on in one task each, by the same rule and with the same result. Nodes and their medians stay in tables.

    Whole numbers of any width, fractions, dates and times count as they are, all else as the rank of its text. A null
    comes before every value (ranks) or counts as -1 (numbers and times), as does NaN; an infinite value counts as the
    largest finite one of its sign. doc_id keeps its type. A null text weighs 0 bytes. Repeated rows come out as often
    as they go in. An empty table gives no rows; other columns aren't read. A table within the target is one leaf with
    the path "".
    """
    rows, types = _coordinates(docs, dimensions)
    rows = materialise(rows.withColumn("path", F.lit("")), "coordinates")
    names = [f"x{i}" for i in range(len(dimensions))]
    extents = [f(n).alias(f"{n}{k}") for n in names for k, f in (("lo", F.min), ("hi", F.max))]
    total = rows.agg(*extents).first()
    spans = [float(total[f"{n}hi"] or 0) / 2 - float(total[f"{n}lo"] or 0) / 2 for n in names]
    done: list[DataFrame] = []
    while True:
        stats = rows.groupBy("path").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), *extents)
        big = materialise(stats.where((F.col("n") > local_rows) & (F.col("bytes") > target_bytes)).select("path", _axis(spans).alias("axis")), "nodes")
        whole, split = big.where("axis < 0").select("path"), big.where("axis >= 0")
        if not whole.isEmpty():  # leaves of more rows than a task should take
            done.append(rows.join(split_by_size(whole), "path", "left_semi").select("doc_id", "path", "bytes"))
            rows = rows.join(split_by_size(whole), "path", "left_anti")
        if split.isEmpty():
            break
        cuts = materialise(_medians(rows, split, types), "cuts")
        at_most = [F.when(F.col("axis") == i, F.col(n) <= F.col("iv" if t == "bigint" else "dv")) for i, (n, t) in enumerate(zip(names, types, strict=True))]
        side = F.when(F.col("axis").isNull(), F.col("path")).when(F.coalesce(*at_most), F.concat("path", F.lit("0"))).otherwise(F.concat("path", F.lit("1")))
        rows = materialise(rows.join(split_by_size(cuts), "path", "left").select("doc_id", "bytes", *names, side.alias("path")), "level")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.groupBy("path").applyInArrow(_finish(spans, types, target_bytes), f"doc_id {kind}, path string, bytes bigint")
    for part in done:
        out = out.unionByName(part)
    return out.select("doc_id", F.col("path").alias("shard_path"), "bytes")


def write_shards(docs: DataFrame, shards: DataFrame, path: str) -> None:
    """Write ``docs`` partitioned by the shard of their doc_id; ids in no shard are left out, repeated ids must agree."""
    own = shards.select("doc_id", F.col("shard_path").alias("shard")).dropDuplicates(["doc_id"])
    docs.join(own, "doc_id").repartition("shard").write.partitionBy("shard").parquet(path)
