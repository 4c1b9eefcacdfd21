"""File sources with row checks, and snapshot sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import text
from ..operators.guard import require_clean
from ..operators.labels import unpivot_coded

STATUSES = ("bachelor", "master", "staff")
ROSTER = ("uid", "status", "ma_start_semester", "source")


def read_lines(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """(line, columns) of a CSV file with a header, one record a line; a missing column raises. Line numbers are the
    file's own, as the file (a list kept by hand) is read whole."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "record"))
    header = lines.filter("at = 0").select(F.from_csv("record", F.lit(", ".join(f"c{i} string" for i in range(64)))).alias("h")).first()
    names = [x.strip() for x in header["h"] if x] if header else []
    if missing := set(columns) - set(names):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    schema = ", ".join(f"`{n}` string" for n in names)
    rows = lines.filter("at > 0 and trim(record) <> ''").select((F.col("at") + 1).alias("line"), F.from_csv("record", F.lit(schema)).alias("r"))
    return rows.select("line", *[F.col(f"r.`{c}`").alias(c) for c in columns])


def read_roster(spark: SparkSession, path: str, key: bytes) -> tuple[DataFrame, DataFrame]:
    """(roster, rejects) of a CSV file with a header."""
    return check_roster(read_lines(spark, path, ROSTER), key)


def check_roster(raw: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """Good rows and (line, fault). A transition term needs the status before it, bachelor; a user's second line is at
    fault even where it is equal after normalisation."""
    t = raw.select("line", *[F.coalesce(F.trim(c), F.lit("")).alias(c) for c in ROSTER])
    term = F.col("ma_start_semester")
    own = (
        F.when(F.col("uid") == "", "uid").when(~F.col("status").isin(*STATUSES), "status")
        .when((term != "") & ((F.col("status") != "bachelor") | ~term.rlike(r"^\d{4}[SW]$")), "ma_start_semester").when(F.col("source") == "", "source")
    )
    t = t.withColumns({"own": own, "pseudonym": text.hmac_sha256(text.normal_uid(F.col("uid")), key)})
    nth = F.row_number().over(Window.partitionBy("pseudonym").orderBy("line"))
    t = t.withColumn("fault", F.coalesce("own", F.when(nth > 1, "duplicate")))
    good = t.filter("fault is null").select("pseudonym", "status", F.nullif(term, F.lit("")).alias("ma_start_semester"), F.col("source").alias("provenance"))
    return good, t.filter("fault is not null").select("line", "fault")


def import_roster(stored: DataFrame, raw: DataFrame, students: DataFrame, key: bytes) -> tuple[DataFrame, DataFrame]:
    """The stored roster with the rows of `raw`, which replace a user's old row, and (imported, unmatched): how many rows
    came and how many students have none now. Any fault refuses the whole import."""
    good, bad = check_roster(raw, key)
    if faults := bad.orderBy("line").limit(5).collect():
        raise ValueError("the roster is refused: " + ", ".join(f"line {r['line']} ({r['fault']})" for r in faults))
    merged = good.unionByName(stored.join(good.select("pseudonym"), "pseudonym", "left_anti").select(good.columns))
    unmatched = without_roster(students, merged).agg(F.count(F.lit(1)).alias("unmatched"))
    return merged, good.agg(F.count(F.lit(1)).alias("imported")).crossJoin(unmatched)


def without_roster(students: DataFrame, roster: DataFrame) -> DataFrame:
    return students.join(roster.select("pseudonym"), "pseudonym", "left_anti")


def read_coded(spark: SparkSession, path: str, categories: list[str]) -> DataFrame:
    """A Latin-1 CSV of coded messages; a missing column raises."""
    df = spark.read.option("encoding", "ISO-8859-1").csv(path, header=True)
    missing = {"ID", "group", "started", *categories} - set(df.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return df.select(F.col("ID").cast("long").alias("history_id"), "group", F.col("started").cast("long").alias("started"), *[F.col(c).cast("int").alias(c) for c in categories])


def join_check(messages: DataFrame, coded: DataFrame) -> DataFrame:
    """Rows whose session start differs between both sides; an import is refused if there are any."""
    m = messages.select("history_id", "session_started")
    return coded.join(m, "history_id").filter(F.col("started") != F.col("session_started")).select("history_id", "started", "session_started")


def import_coded(messages: DataFrame, coded: DataFrame, categories: list[str]) -> DataFrame:
    """Label rows of a coded file; refused if a session start differs from the corpus. A value that is neither 0 nor 1
    raises when the rows are read."""
    if n := join_check(messages, coded).count():
        raise ValueError(f"{n} rows have another session start than the corpus")
    return unpivot_coded(coded, categories)


def read_enrolled(spark: SparkSession, path: str) -> DataFrame:
    """(window_id, level, enrolled) of a JSON file {window: {bachelor, master, source, as_of}}; missing file: error."""
    entry = "struct<bachelor: int, master: int, source: string, as_of: date>"
    one = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string, {entry}>")).alias("window_id", "e"))
    return one.select("window_id", F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(f"e.{x}").alias("enrolled")) for x in ("bachelor", "master")])).alias("x")).select("window_id", "x.*").filter("enrolled is not null")


def render(table: DataFrame, keys: list[str]) -> DataFrame:
    """One JSON line a row, fields in name order, rows in key order: the same rows always give the same bytes."""
    fields = F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "true"})
    return table.orderBy(*keys).select(fields.alias("value"))


#: Lines of a document's file.
LINES = 100_000


def render_document(tables: dict[str, DataFrame], folder: str, lines: int = LINES) -> DataFrame:
    """The tables as JSON lines below `folder`/lines, and the manifest (section, part, lines, sha256) of its files.

    A section's lines are in the order of their text and cut into parts of `lines`, so that the same rows give the same
    bytes, file by file, however many tasks there are. The manifest is one text file, in order, besides.
    """
    spark = next(iter(tables.values())).sparkSession
    text = lambda t: F.to_json(F.struct(*sorted(t.columns)), {"ignoreNullFields": "true"})
    rows = reduce(DataFrame.unionByName, [t.select(F.lit(name).alias("section"), text(t).alias("value")) for name, t in tables.items()])
    nth = F.row_number().over(Window.partitionBy("section").orderBy("value")) - 1
    parts = rows.withColumn("n", nth).withColumn("part", F.floor(F.col("n") / lines).cast("int"))
    parts.repartition("section", "part").sortWithinPartitions("section", "part", "n").drop("n").write.mode("errorifexists").partitionBy("section", "part").text(f"{folder}/lines")
    manifest = read_manifest(spark, folder)
    manifest.coalesce(1).orderBy("section", "part").select(F.to_json(F.struct("section", "part", "lines", "sha256")).alias("value")).coalesce(1).write.text(f"{folder}/manifest")
    return manifest


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(section, part, lines, sha256) of the files as they are now; each is hashed whole, and has LINES lines at most."""
    whole = spark.read.schema("value string, section string, part int").text(f"{folder}/lines", wholetext=True)
    return whole.select("section", "part", (F.size(F.split("value", "\n")) - 1).alias("lines"), F.sha2("value", 256).alias("sha256"))


def check_document(spark: SparkSession, folder: str) -> None:
    """Raises if a file of the document is not what its manifest says."""
    said = spark.read.text(f"{folder}/manifest").select(F.from_json("value", "section string, part int, lines int, sha256 string").alias("m")).select("m.*")
    now = read_manifest(spark, folder)
    if changed := [r["section"] for r in said.exceptAll(now).unionByName(now.exceptAll(said)).select("section").distinct().collect()]:
        raise ValueError(f"the document is not what its manifest says: {sorted(changed)}")


def publish(table: DataFrame, folder: str, version: str, rules: DataFrame | None = None) -> None:
    """Writes a version, once and for all, and then a pointer to it. Nothing is replaced, so a reader always finds the
    last whole version, also after a crash in between. `rules`: a report of the guard; a broken rule refuses."""
    if rules is not None:
        require_clean(rules)
    table.write.mode("errorifexists").parquet(f"{folder}/{version}")
    pointer = table.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("published_at"))
    pointer.coalesce(1).write.mode("append").parquet(f"{folder}/pointers")


def read_latest(spark: SparkSession, folder: str, *, max_age: str | None = None) -> DataFrame:
    """The version published last; nothing published, or only what is older than `max_age` (an interval), raises."""
    try:
        last = spark.read.parquet(f"{folder}/pointers").agg(F.max_by("version", "published_at").alias("version"), F.max("published_at").alias("at"))
    except AnalysisException as e:
        raise FileNotFoundError(f"nothing is published in {folder}") from e
    fresh = F.lit(True) if max_age is None else F.col("at") >= F.current_timestamp() - F.expr(f"interval {max_age}")
    version, is_fresh = last.select("version", fresh.alias("fresh")).first()
    if not is_fresh:
        raise TimeoutError(f"version {version} is older than {max_age}")
    return spark.read.parquet(f"{folder}/{version}")


def write_watermark(spark: SparkSession, folder: str, history_id: int) -> None:
    """Appended, as are pointers: what was recorded before stays until the new row is whole."""
    row = spark.range(1).select(F.lit(history_id).cast("long").alias("history_id"), F.current_timestamp().alias("extracted_at"))
    row.coalesce(1).write.mode("append").parquet(folder)


def read_watermark(spark: SparkSession, folder: str) -> tuple | None:
    try:
        last = F.max_by(F.struct("history_id", "extracted_at"), "extracted_at")
        return tuple(spark.read.parquet(folder).agg(last.alias("x")).select("x.*").first())
    except AnalysisException:
        return None
