"""A profile that grows batch by batch, by merging partial states.

Each batch adds one row of mergeable state per column: counts, sums of powers
about zero-shifted origins, extremes, a distinct-count sketch, a sketch of ranks
(KLL, for quantiles and histograms) and one of values (Theta, for what two
profiles share).  Reading the profile merges the states, so no batch is read
twice.  Usable by hand (``add``) or as a Structured Streaming sink
(``writeStream.foreachBatch(p)``).  A batch has a folder of its own, so adding
one reads no other; a batch id that was added before is left out, which makes
replays harmless.

After every ``merge_after`` batches their states are merged to one: a new
generation is written beside the old one, with the ids of the batches in it,
and counts once it is whole; then what it holds goes.  If that is interrupted,
batches that a whole generation has are left out by their ids.  So the number of
folders is bounded, whatever the number of batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import NUMERIC
from ..operators.drift import Drift, drift, set_counts, set_row
from ..operators.profile import ColumnProfile, DatasetProfile
from ..plans.passes import BINS, SKETCH, fields_of, shape

STATE = "batch long, column string, type_str string, rows long, n long, origin double, s1 double, s2 double, s3 double, s4 double, low double, high double, sketch binary, ranks binary, distinct binary"
#: Size of the sketch of ranks (a rank is off by 0.35 %, one standard error); log2 of the entries of that of values.
RANKS, ENTRIES = 800, 12


class IncrementalProfile:
    def __init__(self, path: str, merge_after: int = 64):
        """``path``: the folder of the states; one that exists is continued.  One writer at a time."""
        self.path, self.merge_after = path, merge_after

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.add(batch, batch_id)

    def _at(self, spark, path: str):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()), at

    def _there(self, spark, path: str) -> bool:
        fs, at = self._at(spark, path)
        return fs.exists(at)

    def _numbers(self, spark, folder: str, key: str) -> list[int]:
        """Numbers of the whole parts of a folder, in order."""
        fs, at = self._at(spark, folder)
        if not fs.exists(at):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return sorted(int(n[len(key) + 1 :]) for n in names if n.startswith(f"{key}=") and self._there(spark, f"{folder}/{n}/_SUCCESS"))

    def _parts(self, spark) -> tuple[str | None, list[list[int]], list[int]]:
        """Folder of the newest whole generation, ranges of batch ids in it, ids of the batches beside it."""
        merged = f"{self.path}/_merged"
        done = self._numbers(spark, merged, "generation")
        folder = f"{merged}/generation={done[-1]}" if done else None
        ranges = [list(r) for r in spark.read.parquet(f"{merged}/ids={done[-1]}").orderBy("first").collect()] if done else []
        beside = [i for i in self._numbers(spark, self.path, "batch") if not any(a <= i <= b for a, b in ranges)]
        return folder, ranges, beside

    def _known(self, spark, parts=None) -> DataFrame:
        folder, _, beside = parts or self._parts(spark)
        out = spark.createDataFrame([], STATE)
        if beside:
            out = spark.read.schema(STATE).option("basePath", self.path).parquet(*[f"{self.path}/batch={i}" for i in beside])
        return out.unionByName(spark.read.schema(STATE).parquet(folder)) if folder else out

    def add(self, batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{self.path}/batch={batch_id}"
        if self._there(spark, f"{path}/_SUCCESS") or any(a <= batch_id <= b for a, b in self._parts(spark)[1]):
            return
        fields = [f for f in fields_of(batch) if f.kind != "unknown"]
        origins = batch.agg(F.count(F.lit(1)), *[F.avg(f.number) if f.number is not None else F.lit(None) for f in fields]).first()
        parts = []
        for f, origin in zip(fields, origins[1:]):
            key = f.value.cast("long") if f.kind == "int" else f.value.cast("int").cast("long") if f.kind == "bool" else F.when(f.value.isNotNull(), F.xxhash64(f.value)) if f.kind == "float" else f.value.cast("string")
            d = f.number - F.lit(origin) if f.number is not None else F.lit(None).cast("double")
            parts.append(
                F.struct(
                    F.lit(f.name).alias("column"), F.lit(f.kind).alias("type_str"), F.count(f.value).alias("n"), F.lit(origin).cast("double").alias("origin"),
                    *[F.coalesce(F.sum(F.pow(d, F.lit(k))), F.lit(0.0)).alias(f"s{k}") for k in (1, 2, 3, 4)],
                    F.min(f.number if f.number is not None else F.lit(None).cast("double")).alias("low"), F.max(f.number if f.number is not None else F.lit(None).cast("double")).alias("high"),
                    F.hll_sketch_agg(key, F.lit(SKETCH)).alias("sketch"),
                    (F.kll_sketch_agg_double(f.number, F.lit(RANKS)) if f.number is not None else F.lit(None).cast("binary")).alias("ranks"), F.theta_sketch_agg(f.value.cast("string"), ENTRIES).alias("distinct"),
                )
            )
        state = batch.agg(F.array(*parts).alias("x"), F.count(F.lit(1)).alias("rows")).select("rows", F.explode("x").alias("x")).select("x.column", "x.type_str", "rows", *[f"x.{c}" for c in ("n", "origin", "s1", "s2", "s3", "s4", "low", "high", "sketch", "ranks", "distinct")])
        state.coalesce(1).write.mode("overwrite").parquet(path)  # what a failed attempt has left goes
        if len(self._numbers(spark, self.path, "batch")) >= self.merge_after:
            self.merge(spark)

    def merge(self, spark) -> None:
        """Merges all states to one generation and deletes what it replaces."""
        parts = folder, ranges, beside = self._parts(spark)
        if not beside:
            return
        merged = f"{self.path}/_merged"
        number = int(folder.rsplit("=", 1)[1]) + 1 if folder else 0
        whole: list[list[int]] = []
        for first, last in sorted([*ranges, *([i, i] for i in beside)]):
            if whole and first == whole[-1][1] + 1:
                whole[-1][1] = last
            else:
                whole.append([first, last])
        spark.createDataFrame(whole, "first long, last long").coalesce(1).write.mode("overwrite").parquet(f"{merged}/ids={number}")
        self._merged(spark, parts).coalesce(1).write.mode("overwrite").parquet(f"{merged}/generation={number}")  # whole from here on
        gone = [f"{self.path}/batch={i}" for i in self._numbers(spark, self.path, "batch") if any(a <= i <= b for a, b in whole)]
        gone += [f"{merged}/{key}={i}" for key in ("generation", "ids") for i in self._numbers(spark, merged, key) if i < number]
        for path in gone:
            fs, at = self._at(spark, path)
            fs.delete(at, True)

    def _merged(self, spark, parts=None) -> DataFrame:
        """One row of state for each column, about the origin of its first batch that has values."""
        known = self._known(spark, parts)
        full = known.where("n > 0")
        by = F.col("origin") - F.col("to")
        sums = _moved(F.col("n"), [F.lit(0.0), *[F.col(f"s{k}") for k in (1, 2, 3, 4)]], by)[1:]
        moved = [F.coalesce(F.sum(x), F.lit(0.0)).alias(f"s{k}") for k, x in enumerate(sums, 1)]
        sketches = [F.hll_union_agg("sketch").alias("sketch"), F.kll_merge_agg_double("ranks").alias("ranks"), F.theta_union_agg("distinct").alias("distinct")]
        origins = full.groupBy("column").agg(F.min_by("origin", "batch").alias("to"))
        held = full.join(origins, "column").groupBy("column").agg(F.sum("n").alias("n"), F.first("to").alias("origin"), *moved, F.min("low").alias("low"), F.max("high").alias("high"), *sketches)
        rows = known.groupBy("column").agg(F.max("batch").alias("batch"), F.sum("rows").alias("rows"), F.max_by("type_str", "batch").alias("type_str")).join(held, "column", "left")
        names = [x.split()[0] for x in STATE.split(", ")]
        return rows.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) if c == "n" else F.col(c) for c in names])

    def columns(self, spark) -> list[dict]:
        """Merged statistics of each column, by name: one aggregate, which gives a row for each column.

        ``quantiles`` are those for 1/4, 1/2 and 3/4, where all batches have a sketch of ranks.
        """
        numeric = F.col("type_str").isin(*NUMERIC, "bool") & (F.col("n") > 0)
        rows = self._merged(spark).select("column", "type_str", "rows", "n", "origin", "s1", "s2", "s3", "s4", "low", "high", F.when(F.col("n") > 0, F.hll_sketch_estimate("sketch")).alias("u"), _ranked(numeric, lambda x: F.kll_sketch_get_quantile_double(x, F.array(*map(F.lit, (0.25, 0.5, 0.75))))).alias("q"))
        out = []
        for r in rows.orderBy("column").collect():
            row = {"column": r["column"], "type_str": r["type_str"], "total_count": r["rows"], "non_null_count": r["n"], "unique_approx": r["u"] or 0, "val_min": r["low"], "val_max": r["high"]}
            if r["type_str"] in (*NUMERIC, "bool") and r["n"]:
                variance, skewness, kurtosis = shape(r["n"], [0.0, r["s1"], r["s2"], r["s3"], r["s4"]])
                row |= {"mean": r["origin"] + r["s1"] / r["n"], "variance": variance, "skewness": skewness, "kurtosis": kurtosis, "quantiles": r["q"]}
            out.append(row)
        return out

    def profile(self, spark) -> DatasetProfile:
        """The merged statistics as a profile, with histograms from the ranks at the edges of the bins; values aren't listed."""
        stats = self.columns(spark)
        inner = [F.lit(None).cast("array<double>")]
        for r in stats:
            if r["type_str"] in NUMERIC and r["non_null_count"] and r["val_max"] > r["val_min"]:
                edges = [r["val_min"] + (r["val_max"] - r["val_min"]) * i / BINS for i in range(1, BINS)]
                inner.append(_ranked(F.col("column") == r["column"], lambda x: F.kll_sketch_get_rank_double(x, F.array(*map(F.lit, edges)))))
        ranks = dict(self._merged(spark).select("column", F.coalesce(*inner)).collect())
        columns = []
        for r in stats:
            n, total = r["non_null_count"], r["total_count"]
            c = ColumnProfile(r["column"], r["type_str"], total, total - n, n, r["unique_approx"])
            c.null_pct, c.unique_pct = 100 * c.null_count / max(1, total), min(100.0, 100 * c.unique_approx / max(1, n))
            if r["type_str"] in NUMERIC and n:
                c.mean, c.variance, c.skewness, c.kurtosis = (r[x] for x in ("mean", "variance", "skewness", "kurtosis"))
                c.stddev, c.val_min, c.val_max, c.range = c.variance**0.5, r["val_min"], r["val_max"], r["val_max"] - r["val_min"]
                upto = [0.0, *(ranks[r["column"]] or []), 1.0]
                c.histogram_bins = [round(n * b) - round(n * a) for a, b in zip(upto, upto[1:])] + [0] * (BINS - len(upto) + 1)
            columns.append(c)
        rows, numeric = max((c.total_count for c in columns), default=0), sum(c.type_str in NUMERIC for c in columns)
        nulls, cells = sum(c.null_count for c in columns), rows * len(columns)
        return DatasetProfile(self.path, self.path.rstrip("/").rsplit("/", 1)[-1], rows, len(columns), numeric, sum(c.type_str == "str" for c in columns), 100 * nulls / max(1, cells), nulls, cells, 0.0, False, columns, [])


def _ranked(where, f):
    """``f`` of the sketch of ranks where the condition holds and there is one."""
    return F.when(where & F.col("ranks").isNotNull() & (F.kll_sketch_get_n_double("ranks") > 0), f(F.col("ranks")))


def compare_states(a: IncrementalProfile, b: IncrementalProfile, spark) -> Drift:
    """Drift between two growing profiles, from their states alone: PSI, KS and the like by histograms, shared values by sketches."""
    found = drift(a.profile(spark), b.profile(spark))
    one, two = (p._merged(spark).where("n > 0").select("column", F.col("distinct").alias(x)) for p, x in ((a, "x"), (b, "y")))
    sets = {r[0]: set_row(*r, ENTRIES) for r in one.join(two, "column").where("x IS NOT NULL AND y IS NOT NULL").select("column", *set_counts(F.col("x"), F.col("y"))).collect()}
    for c in found.categories:
        c.update(sets.get(c["col_name"], {}))
    return found


def _moved(n, s: list, by) -> list:
    """Sums of powers (numbers or Columns) about an origin that lies ``by`` lower."""
    return [
        s[0],
        s[1] + n * by,
        s[2] + 2 * by * s[1] + n * by**2,
        s[3] + 3 * by * s[2] + 3 * by**2 * s[1] + n * by**3,
        s[4] + 4 * by * s[3] + 6 * by**2 * s[2] + 4 * by**3 * s[1] + n * by**4,
    ]
