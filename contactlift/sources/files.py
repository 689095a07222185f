"""Readers, writers and the dataset catalog.

Delimited text is read with an explicit schema when one is known (inference is a full extra
pass); monthly snapshots are written partitioned by month, so a filter on the month prunes files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from contactlift.functions.rowwise import days_to_snapshot_end, present
from contactlift.operators.packs import CARD_DATE_COLUMNS
from contactlift.session import scratch_path, sized


def scan_delimited(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None,
                   sep: str = "\t", header: bool = True) -> DataFrame:
    """TSV (or other delimiter) with a header; empty fields are missing. Gzip is read transparently."""
    r = spark.read.option("sep", sep).option("header", header).option("nullValue", "").option("emptyValue", "")
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    return r.csv(path)


# Columns of the quarantine, and the folder column that keeps both outputs of one write apart.
RAW_LINE, SOURCE_FILE, _BROKEN = "raw_line", "source_file", "broken"


@dataclass
class Parsed:
    """Outcome of ``parse_delimited``: the whole rows, the rows that did not parse, and how many of each were read."""

    rows: DataFrame
    quarantine: DataFrame
    n_rows: int
    n_quarantined: int


def parse_delimited(spark: SparkSession, source: str | list[str], out_dir: str, schema: StructType | str | None = None,
                    sep: str = "\t", header: bool = True) -> Parsed:
    """Parse delimited text once into parquet under ``out_dir``, rows that do not fit the schema apart from the others.

    A row is quarantined when it has too few or too many fields or a field that its type cannot hold; the quarantine
    keeps the line as it was (``raw_line``) and the file it came from (``source_file``), never a half-parsed row. Both
    outputs are folders of one write, and the rows read are counted in that same pass; if what was written does not add
    up to what was read, the job fails. A line of white space only (separators included) is no row, as in every Spark read
    of such text; a file without rows gives two empty tables. Without a schema it is inferred first
    (a second read of the text; no row can then fail by its type).
    """
    reader = spark.read.option("sep", sep).option("header", header).option("nullValue", "").option("emptyValue", "")
    if schema is None:
        schema = reader.option("inferSchema", True).csv(source).schema
    elif isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    clash = {RAW_LINE, SOURCE_FILE, _BROKEN} & {f.name.lower() for f in schema.fields}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are used by the quarantine")
    fields = [StructField(f.name, f.dataType, True) for f in schema.fields]
    parsed = (reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW_LINE)
              .schema(StructType([*fields, StructField(RAW_LINE, StringType(), True)])).csv(source))
    broken = F.col(RAW_LINE).isNotNull()
    seen = Observation()
    marked = parsed.withColumns({SOURCE_FILE: F.when(broken, F.input_file_name()), _BROKEN: broken}).observe(
        seen, F.count(F.lit(1)).alias("read"), F.count_if(broken).alias("broken"))
    sink_columnar(marked, out_dir, partition_by=[_BROKEN])
    counts = seen.get
    whole = StructType([*fields, StructField(RAW_LINE, StringType(), True), StructField(SOURCE_FILE, StringType(), True)])
    # the folder of one side is missing when it has no rows: read the table with its schema and filter by the folder
    written = spark.read.schema(whole.add(_BROKEN, "boolean")).parquet(out_dir)
    good = written.where(~F.col(_BROKEN)).select(*[F.col(f"`{f.name}`") for f in fields])
    bad = written.where(F.col(_BROKEN)).select(RAW_LINE, SOURCE_FILE)
    n_good, n_bad = good.count(), bad.count()
    if (n_good + n_bad, n_bad) != (counts["read"], counts["broken"]):
        raise RuntimeError(f"{out_dir}: read {counts}, wrote {n_good} rows and {n_bad} quarantined ones")
    return Parsed(good, bad, n_good, n_bad)


def scan_columnar(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def sink_columnar(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Iterable[str] = ()) -> None:
    """Parquet with zstd (the reference writes its columnar files at maximum compression)."""
    w = df.write.mode(mode).option("compression", "zstd")
    part = list(partition_by)
    if part:
        w = w.partitionBy(*part)
    w.parquet(path)


def sink_delimited(df: DataFrame, path: str, sep: str = "\t", header: bool = True, line_sep: str = "\n",
                   mode: str = "overwrite") -> None:
    """Whole table as delimited text, missing values as empty fields."""
    (df.write.mode(mode).option("sep", sep).option("header", header).option("nullValue", "")
     .option("emptyValue", "").option("lineSep", line_sep).csv(path))


def convert_to_columnar(spark: SparkSession, sources: Mapping[str, str], target_dir: str,
                        schema: StructType | str | None = None, sep: str = "\t") -> dict[str, str]:
    """Delimited files -> parquet, one output per input; returns name -> parquet path."""
    out = {}
    for name, src in sources.items():
        dst = f"{target_dir.rstrip('/')}/{name}"
        sink_columnar(scan_delimited(spark, src, schema, sep), dst)
        out[name] = dst
    return out


def snapshot_extract(df: DataFrame, month: int | str, month_col: str = "foto_mes") -> DataFrame:
    """Rows of one month (the month may be given as text)."""
    return df.where(F.col(month_col) == F.lit(int(month)))


def read_month(spark: SparkSession, path: str, month: int | str, month_col: str = "foto_mes") -> DataFrame:
    """One month of a month-partitioned snapshot: the filter prunes to that month's folder."""
    return snapshot_extract(scan_columnar(spark, path), month, month_col)


def snapshot_partitions(df: DataFrame, path: str, month_col: str = "foto_mes",
                        sort_cols: Iterable[str] = ("numero_de_cliente",)) -> None:
    """One folder per month, rows sorted by customer inside each file.

    Range-partition on (month, customer) so every task writes few month folders with sorted rows; the number of
    ranges is left to AQE.
    """
    keys = [month_col, *sort_cols]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    sink_columnar(ordered, path, partition_by=[month_col])


MANIFEST = "month int, n_rows bigint, run string, written_at timestamp"


def upsert_months(df: DataFrame, path: str, manifest: str, month_col: str = "foto_mes",
                  sort_cols: Iterable[str] = ("numero_de_cliente",), run: str | None = None) -> DataFrame:
    """Replace the months that ``df`` holds, whole, in the month-partitioned table at ``path``; others keep their files.

    Dynamic partition overwrite: the new files are staged and moved in at the end, so a job that fails before leaves the
    table as it was, and a rerun replaces the same months again. Every run then appends its months and row counts to the
    table at ``manifest``; returned are this run's lines. Rows without a month have no folder to replace, so they are an
    error, as is a schema that differs from the stored one (it would leave months that cannot be read together). An empty
    ``df`` replaces nothing.
    """
    spark = df.sparkSession
    keys = [month_col, *sort_cols]
    run = run or uuid.uuid4().hex
    stored = _schema_at(spark, path)
    if stored is not None:
        require_schema(df, stored, path, ignore=[month_col])  # a partition column's type is inferred
    lines = sized(df.groupBy(F.col(month_col).cast("int").alias("month")).agg(F.count(F.lit(1)).alias("n_rows")).withColumns(
        {"run": F.lit(run), "written_at": F.current_timestamp()}))
    if not lines.where(F.col("month").isNull()).isEmpty():
        raise ValueError(f"{path}: rows without {month_col}")
    _replace_months(df, path, [month_col], keys)
    lines.write.mode("append").parquet(manifest)
    return read_manifest(spark, manifest).where(F.col("run") == run)


def _replace_months(df: DataFrame, path: str, partition_by: list[str], keys: list[str], fmt: str = "parquet", **options) -> None:
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    (ordered.write.mode("overwrite").format(fmt).options(**{"compression": "zstd", "partitionOverwriteMode": "dynamic", **options})
     .partitionBy(*partition_by).save(path))


def read_manifest(spark: SparkSession, manifest: str, latest: bool = False) -> DataFrame:
    """Lines of the manifest; ``latest``: of each month the line of its last run."""
    lines = spark.read.schema(MANIFEST).parquet(manifest)
    if not latest:
        return lines
    last = Window.partitionBy("month").orderBy(F.desc("written_at"), F.desc("run"))
    return lines.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")


def _schema_at(spark: SparkSession, path: str) -> StructType | None:
    """Schema of the parquet table at ``path``, None if there is none yet."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return scan_columnar(spark, path).schema if fs.exists(p) else None


def require_schema(df: DataFrame, wanted: StructType, where: str, ignore: Iterable[str] = ()) -> None:
    """Raise unless ``df`` has exactly the columns and types of ``wanted`` (in any order, nullability aside)."""
    skip = set(ignore)
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name not in skip}
    want = {f.name: f.dataType.simpleString() for f in wanted.fields if f.name not in skip}
    if have != want:
        lines = [f"{c}: {have.get(c, 'missing')}, expected {want.get(c, 'no such column')}"
                 for c in sorted(have.keys() | want.keys()) if have.get(c) != want.get(c)]
        raise ValueError(f"{where}: schema differs: {'; '.join(lines)}")


def sort_snapshot(df: DataFrame, month_col: str = "foto_mes", id_col: str = "numero_de_cliente") -> DataFrame:
    """Ascending by month and customer, missing first (``setorder``)."""
    return df.orderBy(F.asc_nulls_first(month_col), F.asc_nulls_first(id_col))


def dates_to_day_offsets(df: DataFrame, month_col: str = "foto_mes", date_cols: Iterable[str] = CARD_DATE_COLUMNS) -> DataFrame:
    """Replace each present ``yyyymmdd`` card date by days to the end of the snapshot month."""
    present = [c for c in date_cols if c in df.columns]
    return df.withColumns({c: days_to_snapshot_end(F.col(month_col), F.col(c)) for c in present})


def ingest_snapshots(spark: SparkSession, source: str | list[str], out_dir: str, raw_months: Iterable[int] = (),
                     schema: StructType | str | None = None, month_col: str = "foto_mes",
                     id_col: str = "numero_de_cliente", sep: str = "\t") -> dict[str, str]:
    """The ingest job: delimited snapshot (plain or gzip) -> raw columnar copy of the whole table and raw text copies of
    chosen months (all columns) -> card dates as day offsets -> month partitions sorted by customer, plus the whole
    table as text in the source's column order.

    The text is parsed once: everything else reads the columnar copy. Returns the output paths. Every step is a
    distributed read or write; nothing is collected.
    """
    out = out_dir.rstrip("/")
    paths = {"raw": f"{out}/raw/whole"}
    sink_columnar(scan_delimited(spark, source, schema, sep), paths["raw"])
    raw = scan_columnar(spark, paths["raw"])
    for m in raw_months:
        paths[f"raw_{m}"] = f"{out}/raw/{m}"
        sink_delimited(snapshot_extract(raw, m, month_col), paths[f"raw_{m}"], sep=sep)
    dated = dates_to_day_offsets(raw, month_col)
    paths["months"] = f"{out}/months"
    snapshot_partitions(dated, paths["months"], month_col, [id_col])
    paths["whole"] = f"{out}/whole"
    # the whole table is written from the month partitions, sorted by (month, customer)
    whole = scan_columnar(spark, paths["months"]).select(*[F.col(f"`{c}`") for c in raw.columns])
    sink_delimited(sort_snapshot(whole, month_col, id_col), paths["whole"], sep=sep)
    return paths


def upsert_snapshots(spark: SparkSession, source: str | list[str], out_dir: str, raw_months: Iterable[int] = (),
                     schema: StructType | str | None = None, month_col: str = "foto_mes",
                     id_col: str = "numero_de_cliente", sep: str = "\t") -> dict[str, str]:
    """``ingest_snapshots`` for a delivery of some months: they replace those months, whole, in all outputs.

    The text is parsed once into a scratch table and reconciled there; lines that do not parse go to
    ``quarantine/run=...`` and nowhere else. Then the months are replaced in ``raw/whole`` and ``months`` (both by month,
    see ``upsert_months``) and in ``whole``, the text in the source's column order, one folder a month. Months that the
    delivery does not hold keep their files. Runs and row counts are in ``manifest``. Returns the output paths.
    """
    out, run = out_dir.rstrip("/"), uuid.uuid4().hex
    paths = {name: f"{out}/{name}" for name in ("months", "whole", "manifest", "quarantine")}
    paths["raw"] = f"{out}/raw/whole"
    got = parse_delimited(spark, source, scratch_path(spark, "parsed"), schema, sep)
    if got.n_quarantined:
        sink_columnar(got.quarantine, f"{paths['quarantine']}/run={run}")
    columns = got.rows.columns
    upsert_months(got.rows, paths["raw"], f"{out}/manifest-raw", month_col, [id_col], run)
    dated = dates_to_day_offsets(got.rows, month_col)
    upsert_months(dated, paths["months"], paths["manifest"], month_col, [id_col], run)
    _replace_months(dated.select(*columns, F.col(month_col).alias("month")), paths["whole"], ["month"], ["month", id_col],
                    "csv", sep=sep, header=True, nullValue="", emptyValue="", compression="none")
    for m in raw_months:
        paths[f"raw_{m}"] = f"{out}/raw/{m}"
        one = read_month(spark, paths["raw"], m, month_col)
        sink_delimited(one.select(*[F.col(f"`{c}`") for c in columns]), paths[f"raw_{m}"], sep=sep)
    return paths


def export_ranked_probs(scores: DataFrame, path: str, id_col: str = "id_cliente", prob: str = "prob_positivo") -> None:
    """All (id, prob) by descending prob, tab separated, CRLF, with header.

    A global sort writes part files in order: reading the parts by name gives the ranking.
    """
    ranked = scores.select(id_col, prob).orderBy(F.desc_nulls_last(present(prob)), F.asc(id_col))
    sink_delimited(ranked, path, header=True, line_sep="\r\n")


def target_ids(scores: DataFrame, cutoff: float = 0.025, id_col: str = "id_cliente", prob: str = "prob_positivo",
               ranked: bool = True) -> DataFrame:
    """Ids to contact: strict ``prob > cutoff``; optionally by descending probability."""
    sel = scores.where(present(prob) > F.lit(cutoff))
    if ranked:
        sel = sel.orderBy(F.desc(prob), F.asc(id_col))
    return sel.select(id_col)


def export_target_ids(scores: DataFrame, path: str, cutoff: float = 0.025, id_col: str = "id_cliente",
                      prob: str = "prob_positivo", header: bool = False, ranked: bool = True) -> None:
    """Ids with ``prob > cutoff`` as CRLF text (no header by default)."""
    sink_delimited(target_ids(scores, cutoff, id_col, prob, ranked), path, header=header, line_sep="\r\n")


STATISTICS = "dataset string, column string, type string, n_rows bigint, n_missing bigint, lowest double, highest double"


def column_statistics(df: DataFrame, dataset: str) -> DataFrame:
    """One row per column: rows, missing values (NULL or NaN), and for numbers the lowest and highest value.

    One aggregate over the table: Catalyst reads every column once and shuffles one row per task.
    """
    n, aggs = F.count(F.lit(1)), []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        value = present(c) if number else F.lit(None).cast("double")
        missing = F.count_if(value.isNull() if number else c.isNull())
        aggs.append(F.struct(F.lit(dataset).alias("dataset"), F.lit(f.name).alias("column"), F.lit(kind).alias("type"),
                             n.alias("n_rows"), missing.alias("n_missing"), F.min(value).alias("lowest"),
                             F.max(value).alias("highest")))
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s"))


@dataclass
class DatasetCatalog:
    """Logical dataset names mapped to parquet tables, exposed as temp views.

    The reference's names: ``train`` (labelled), ``predict`` (to score), ``results`` (outcome)
    and ``predict_full`` (application set with its label). ``register`` names a table that is there, ``store`` writes one
    under ``root`` with its statistics beside it; both check a given schema before the name is known.
    """

    spark: SparkSession
    paths: dict[str, str] = field(default_factory=dict)
    root: str | None = None

    def register(self, name: str, path: str, schema: StructType | str | None = None) -> DatasetCatalog:
        if schema is not None:
            wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
            require_schema(scan_columnar(self.spark, path), wanted, path)
        self.paths[name] = path
        return self

    def store(self, name: str, df: DataFrame, schema: StructType | str | None = None) -> DatasetCatalog:
        if self.root is None:
            raise ValueError("a catalog that stores tables needs a root folder")
        if schema is not None:
            require_schema(df, StructType.fromDDL(schema) if isinstance(schema, str) else schema, name)
        path = f"{self.root.rstrip('/')}/{name}"
        sink_columnar(df, path)
        self.paths[name] = path
        self._write_statistics(name)
        return self

    def _statistics_path(self, name: str) -> str:
        base = self.root if self.root is not None else scratch_path(self.spark, "statistics")
        return f"{base.rstrip('/')}/{name}-statistics"

    def _write_statistics(self, name: str) -> str:
        path = self._statistics_path(name)
        sink_columnar(column_statistics(self.get(name), name), path)
        return path

    def statistics(self, name: str) -> DataFrame:
        """Stored statistics of a dataset; a registered table's are computed on the first call."""
        path = self._statistics_path(name)
        if _schema_at(self.spark, path) is None:
            path = self._write_statistics(name)
        return self.spark.read.schema(STATISTICS).parquet(path)

    def get(self, name: str) -> DataFrame:
        if name not in self.paths:
            raise KeyError(f"dataset {name!r} is not in the catalog (known: {sorted(self.paths)})")
        return scan_columnar(self.spark, self.paths[name])

    def as_views(self) -> list[str]:
        for name in self.paths:
            self.get(name).createOrReplaceTempView(name)
        return list(self.paths)

    def get_train(self) -> DataFrame:
        return self.get("train")

    def get_predict(self) -> DataFrame:
        return self.get("predict")

    def get_results(self) -> DataFrame:
        return self.get("results")

    def get_predict_full(self) -> DataFrame:
        return self.get("predict_full")


def table_shape(df: DataFrame) -> DataFrame:
    """(rows, columns) as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("bigint"))
