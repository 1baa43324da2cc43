"""Spectral text files and metadata CSV: readers with a reject table, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from specspark.operators.shared import numbered

#: Layout of a spectral file: header row and this many spectra.
ROWS = 3
METADATA = T.StructType(
    [
        T.StructField("sample_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("sex", T.StringType()),
        T.StructField("target_SI", T.DoubleType()),
        T.StructField("HGS_pp_avg", T.DoubleType()),
        T.StructField("ADF_pp_avg", T.DoubleType()),
    ]
)


def sample_key(file_name: Column) -> Column:
    """The first two `_` tokens of a file name."""
    return F.concat_ws("_", F.slice(F.split(file_name, "_"), 1, 2))


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(file_name, content) of whole text files."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("content"))


class SpectralText(DataSource):
    """Sink for rows (file_name, content): one text file each, below `path`, on any store that pyarrow can write."""

    @classmethod
    def name(cls) -> str:
        return "spectral_text"

    def schema(self) -> str:
        return "file_name string, content string"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("spectral_text appends to a folder; it does not overwrite one")
        return _FileWriter(self.options["path"])


class _FileWriter(DataSourceWriter):
    """A file appears by one rename, so a task that runs twice leaves one whole file."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> WriterCommitMessage:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.path if ":" in self.path.split("/")[0] else f"file://{self.path}")
        store.create_dir(base, recursive=True)
        for row in iterator:
            part = f"{base}/.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as f:
                f.write((row["content"] or "").encode())
            store.move(part, f"{base}/{row['file_name']}")
        return WriterCommitMessage()


def write_texts(files: DataFrame, path: str) -> None:
    """Write `files(file_name, content)` as text files of these names into the folder `path`."""
    files.sparkSession.dataSource.register(SpectralText)
    files.select("file_name", "content").write.format("spectral_text").mode("append").save(path)


def _cells(content: Column) -> Column:
    """Rows of numbers: blank lines dropped, the first cell of each row dropped, bad numbers null."""
    lines = F.filter(F.split(content, r"\r?\n"), lambda x: F.trim(x) != "")
    return F.transform(lines, lambda line: F.transform(F.slice(F.split(line, "\t"), 2, 1_000_000), lambda c: c.try_cast("double")))


def _parsed(files: DataFrame, points: int | None, strict: bool) -> DataFrame:
    df = files.select("file_name", _cells(F.col("content")).alias("cells"))
    width = F.lit(points) if points is not None else F.size(F.col("cells")[0])
    reason = F.when(F.size("cells") == 0, "empty file")
    if strict:
        reason = reason.when(F.size("cells") != ROWS + 1, "wrong number of rows").when(F.exists("cells", lambda r: F.size(r) != width), "wrong number of points")
    reason = reason.when(F.exists("cells", lambda r: F.exists(r, lambda x: x.isNull())), "not a number")
    return df.withColumn("reason", reason)


def scan_spectra(files: DataFrame, points: int | None = None, strict: bool = True) -> DataFrame:
    """(file_name, sample_id, rep_no, intensity) of the good files of `files(file_name, content)`.

    strict: a header and ROWS spectra of `points` values; otherwise any number of rows and points.
    """
    good = _parsed(files, points, strict).where("reason is null")
    rows = good.select("file_name", F.posexplode(F.slice("cells", 2, 1_000_000)).alias("rep_no", "intensity"))
    return rows.select("file_name", sample_key(F.col("file_name")).alias("sample_id"), (F.col("rep_no") + 1).alias("rep_no"), "intensity")


def rejected_files(files: DataFrame, points: int | None = None, strict: bool = True) -> DataFrame:
    return _parsed(files, points, strict).where("reason is not null").select("file_name", "reason")


def wavenumber_axis(files: DataFrame, points: int | None = None) -> DataFrame:
    """(idx, wavenumber, n_axes): the header of the first good file by name; n_axes is 1 if all agree."""
    good = _parsed(files, points, True).where("reason is null").select("file_name", F.col("cells")[0].alias("axis"))
    one = good.agg(F.min_by("axis", "file_name").alias("axis"), F.count_distinct("axis").alias("n_axes"))
    return one.select(F.posexplode("axis").alias("idx", "wavenumber"), "n_axes")


def scan_metadata(spark: SparkSession, *paths: str) -> DataFrame:
    """Metadata CSV with a header (a byte-order mark is allowed); the key is text."""
    return spark.read.csv(list(paths), header=True, schema=METADATA, enforceSchema=True)


def number_rows(meta: DataFrame, order: str) -> DataFrame:
    """Legacy key: the position of a row in the order of a column, counted from 0, as text."""
    return numbered(meta.drop("sample_id"), order).withColumn("sample_id", F.col("position").cast("string")).drop("position")


def group_files(files: DataFrame) -> DataFrame:
    """(sample_id, files): sorted file names of each sample."""
    return files.select(sample_key(F.col("file_name")).alias("sample_id"), "file_name").distinct().groupBy("sample_id").agg(F.array_sort(F.collect_list("file_name")).alias("files"))


def parse_map_files(files: DataFrame, pattern: str = r"^((?:DM1|AdCo)_\d+)_Map(\d)_") -> DataFrame:
    """(sample_id, map_no, file_name) of the names that match; others are left out."""
    key = F.regexp_extract("file_name", pattern, 1)
    return files.where(key != "").select(key.alias("sample_id"), F.regexp_extract("file_name", pattern, 2).cast("int").alias("map_no"), "file_name")


def spectra_for_maps(spectra: DataFrame, maps: list[int]) -> DataFrame:
    """Spectra of the chosen maps with a label; an empty choice of spectra raises."""
    out = spectra.where(F.col("map_no").isin(maps)).withColumn("map", F.concat(F.lit("Map"), F.col("map_no")))
    if not out.head(1):
        raise ValueError(f"no spectra for maps {maps}")
    return out


def combine(parts: list[DataFrame]) -> DataFrame:
    """Bag union of several data sets by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_report(df: DataFrame, path: str, *order: str) -> None:
    """Text sink: the rows of a result table in order, one line each, as tab-separated text with a header."""
    df.orderBy(*order).coalesce(1).write.mode("errorifexists").option("header", True).option("sep", "\t").csv(path)


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = (), kind: str = "parquet") -> None:
    """Result sink: Parquet or CSV, partitioned by the given columns."""
    writer = df.write.mode("errorifexists")
    if by:
        writer = writer.partitionBy(*by)
    writer.option("header", True).format(kind).save(path)


def write_matrices(df: DataFrame, path: str, by: tuple[str, ...], row: str, column: str, value: str, columns: int) -> None:
    """Matrix sink: for each value of `by` a folder with one row per `row` and its `values`, an array over `column` 0 to `columns` - 1.

    Cells that `df` does not have are null. A row has `columns` numbers, whatever the number of rows.
    """
    filled = F.map_from_entries(F.collect_list(F.struct(column, value)))
    rows = df.groupBy(*by, row).agg(filled.alias("cells"))
    values = F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda k: F.try_element_at("cells", k))
    write_table(rows.select(*by, row, values.alias("values")), path, by)


def read_matrices(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """The rows (keys, values) of `write_matrices`."""
    return spark.read.schema(f"{keys}, values array<double>").parquet(path)
