"""Interactions, items and text tables from Parquet, CSV, JSON lines and `::`-separated files."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERACTION = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("ts", T.LongType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("domain", T.StringType()),
    ]
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_seconds(column: str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"cast(cast({column} - timestamp_ntz'1970-01-01 00:00:00' as interval second) as bigint)")


def event_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """The event log as interactions: item from props, value as rating, type as domain. Times have no ties."""
    events = table(spark, folder, "events")
    item = F.get_json_object("props", "$.k").cast("long")
    return events.select("event_id", "user_id", item.alias("item_id"), epoch_seconds("ts").alias("ts"), F.col("value").alias("rating"), F.col("event_type").alias("domain"))


def order_interactions(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as interactions by day, with many ties; no event ids."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), epoch_seconds("o_orderdate").alias("ts"), F.col("l_quantity").alias("rating"), F.col("o_orderpriority").alias("domain"))


def part_items(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as an item catalogue with text fields."""
    return table(spark, folder, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"))


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """`user::item::rating::timestamp` lines in Latin-1."""
    schema = "raw_user_id string, raw_item_id string, rating double, timestamp long"
    return spark.read.option("sep", "::").option("encoding", "ISO-8859-1").option("mode", "FAILFAST").schema(schema).csv(path)


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    """`item::title::genres` lines in Latin-1."""
    return spark.read.option("sep", "::").option("encoding", "ISO-8859-1").option("quote", "").schema("raw_item_id string, title string, genres string").csv(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines (plain or gzip), CSV with a header or Parquet, by suffix."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    name = path.lower().removesuffix(".gz")
    if name.endswith((".jsonl", ".ndjson", ".json")):
        return reader.option("mode", "FAILFAST").json(path)
    if name.endswith(".csv"):
        return reader.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if name.endswith(".parquet"):
        return reader.parquet(path)
    raise ValueError(f"unknown kind of table: {path}")


def choose_file(names: list[str], metadata: bool) -> str | None:
    """The review file, or the one named meta*, plain before compressed, then by name."""
    fitting = [n for n in names if n.rsplit("/", 1)[-1].lower().startswith("meta") == metadata]
    return min(fitting, key=lambda n: (n.endswith(".gz"), n), default=None)


def first_readable(spark: SparkSession, choices: list[tuple[str, T.StructType | str | None]]) -> DataFrame:
    """The first of several places that holds data: a processed table, raw files, JSON lines."""
    context = spark.sparkContext
    for path, schema in choices:
        location = context._jvm.org.apache.hadoop.fs.Path(path)
        if location.getFileSystem(context._jsc.hadoopConfiguration()).exists(location):
            return read_ratings(spark, path) if path.endswith(".dat") else read_records(spark, path, schema)
    raise FileNotFoundError(", ".join(p for p, _ in choices))


def inspect(frame: DataFrame, fields_needed: dict[str, tuple[str, ...]], sample_rows: int = 1000) -> dict:
    """Columns of a sample and, for each needed role, whether one of its aliases is there."""
    sample = frame.limit(sample_rows)
    columns = sorted(sample.columns)
    return {"columns": columns, "sampled": sample.count(), "convertible": {role: any(a in columns for a in aliases) for role, aliases in fields_needed.items()}}


def unzip_ratings(archive: str, folder: str) -> str:
    """Unpack an archive into a folder, both of any store that Spark reads, and return the folder that holds its ratings.dat; an error if it has none.

    Entries are copied as streams, so that executors find them where they read.
    """
    context = SparkSession.active().sparkContext
    jvm, settings = context._jvm, context._jsc.hadoopConfiguration()
    place = lambda path: (lambda p: (p, p.getFileSystem(settings)))(jvm.org.apache.hadoop.fs.Path(path))
    source, store = place(archive)
    packed = jvm.java.util.zip.ZipInputStream(store.open(source))
    inside = []
    try:
        while (entry := packed.getNextEntry()) is not None:
            name = entry.getName()
            if entry.isDirectory() or name.startswith("/") or ".." in name.split("/"):
                continue
            target, there = place(f"{folder}/{name}")
            out = there.create(target, True)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(packed, out, 1 << 16, False)
            finally:
                out.close()
            if name.rsplit("/", 1)[-1] == "ratings.dat":
                inside.append(name)
    finally:
        packed.close()
    if not inside:
        raise FileNotFoundError(f"{archive} holds no ratings.dat")
    return f"{folder}/{inside[0].rpartition('/')[0]}".rstrip("/")


def estimated_rows(spark: SparkSession, path: str, sample_rows: int = 1000) -> int | None:
    """Rows of a plain text table by its bytes and the mean length of some lines; None where lines are not what is stored."""
    if path.lower().endswith((".gz", ".csv", ".parquet")):
        return None
    row = spark.read.text(path).limit(sample_rows).agg(F.avg(F.octet_length("value") + 1).alias("mean")).first()
    context = spark.sparkContext
    location = context._jvm.org.apache.hadoop.fs.Path(path)
    size = location.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(location).getLength()
    return round(size / row["mean"]) if row["mean"] else 0


def inspect_domains(spark: SparkSession, files: dict[str, list[str]], fields_needed: dict[str, tuple[str, ...]], sample_rows: int = 1000) -> dict:
    """files: the paths of each domain -> which review and metadata file it has, their estimated rows, and whether the reviews can be converted."""
    report = {}
    for domain, names in sorted(files.items()):
        reviews, metadata = choose_file(names, metadata=False), choose_file(names, metadata=True)
        found = inspect(read_records(spark, reviews), fields_needed, sample_rows) if reviews else {"columns": [], "sampled": 0, "convertible": dict.fromkeys(fields_needed, False)}
        report[domain] = {"reviews": reviews, "metadata": metadata, "rows": estimated_rows(spark, reviews, sample_rows) if reviews else 0, "metadata_rows": estimated_rows(spark, metadata, sample_rows) if metadata else 0, **found}
    return {"domains": report, "status": "convertible" if report and all(all(d["convertible"].values()) for d in report.values()) else "partial"}
