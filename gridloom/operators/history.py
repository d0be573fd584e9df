"""Runs and comparisons that were made: small Parquet tables, rewritten by key, one writer at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The columns of the tables.
TABLES = {
    "users": "id bigint, username string, password_hash string, created_at timestamp",
    "extraction_records": "id bigint, filename string, mode string, status string, rows bigint, csv_path string, created_at timestamp",
    "extracted_tables": "id bigint, record_id bigint, table_index int, page int, heading string, rows bigint, columns bigint",
    "comparison_records": "id bigint, record_id bigint, summary string, report_path string, extracted_only_path string, created_at timestamp",
}


def with_filenames(comparisons: DataFrame, records: DataFrame) -> DataFrame:
    """``comparisons`` with the filename of their record, null if it is not known any more."""
    return comparisons.join(records.select(F.col("id").alias("record_id"), "filename"), "record_id", "left")


class History:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs
        for name in TABLES:
            self._repair(name)

    def _path(self, name: str):
        path = self._fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _repair(self, name: str) -> None:
        """Finish a swap that was broken off."""
        fs, path = self._path(name)
        new = self._fs.Path(f"{self.root}/{name}.new")
        if not fs.exists(path) and fs.exists(self._fs.Path(f"{self.root}/{name}.new/_SUCCESS")):
            fs.rename(new, path)

    def table(self, name: str) -> DataFrame:
        """The rows, with columns that older files lack as null."""
        fs, path = self._path(name)
        empty = self.spark.createDataFrame([], TABLES[name])
        if not fs.exists(path):
            return empty
        return empty.unionByName(self.spark.read.parquet(f"{self.root}/{name}"), allowMissingColumns=True)

    def _replace(self, name: str, df: DataFrame) -> None:
        fs, path = self._path(name)
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{name}.new")
        fs.delete(path, True)
        fs.rename(self._fs.Path(f"{self.root}/{name}.new"), path)

    def add(self, name: str, **values: object) -> int:
        """Insert a row; its id is one above the largest."""
        old = self.table(name)
        key = (old.agg(F.max("id")).first()[0] or 0) + 1
        fields = old.schema
        stamp = {"created_at": F.current_timestamp()} if "created_at" in fields.names else {}
        row = self.spark.range(1).select(*[F.lit(key).alias("id") if f.name == "id" else (stamp.get(f.name) if f.name in stamp and f.name not in values else F.lit(values.get(f.name)).cast(f.dataType)).alias(f.name) for f in fields])
        self._replace(name, old.unionByName(row))
        return key

    def get(self, name: str, key: int) -> dict | None:
        row = self.table(name).where(F.col("id") == key).first()
        return row and row.asDict()

    def records(self) -> DataFrame:
        return self.table("extraction_records").orderBy(F.desc("created_at"), F.desc("id"))

    def tables_of(self, record: int) -> DataFrame:
        return self.table("extracted_tables").where(F.col("record_id") == record).orderBy("table_index")

    def comparisons(self) -> DataFrame:
        """Newest first, with the file that each was made from, if it is still known."""
        return with_filenames(self.table("comparison_records"), self.table("extraction_records")).orderBy(F.desc("created_at"), F.desc("id"))

    def set_reports(self, key: int, report: str, extracted_only: str) -> None:
        put = lambda c, v: F.when(F.col("id") == key, F.lit(v)).otherwise(F.col(c))
        df = self.table("comparison_records")
        self._replace("comparison_records", df.withColumns({"report_path": put("report_path", report), "extracted_only_path": put("extracted_only_path", extracted_only)}))

    def delete_record(self, key: int) -> bool:
        """A record with its tables and comparisons; says whether it was there. Files stay."""
        there = self.get("extraction_records", key) is not None
        for name, column in (("comparison_records", "record_id"), ("extracted_tables", "record_id"), ("extraction_records", "id")):
            self._replace(name, self.table(name).where(~F.col(column).eqNullSafe(key)))
        return there


def password_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def seed_user(history: History, username: str, password: str) -> bool:
    """Add a user unless there is one of that name; says whether it was added."""
    if not history.table("users").where(F.col("username") == username).isEmpty():
        return False
    digest = history.spark.range(1).select(password_hash(F.lit(password))).first()[0]
    history.add("users", username=username, password_hash=digest)
    return True


def knows_user(history: History, username: str, password: str) -> bool:
    """There is a user of that name with that password."""
    mine = (F.col("username") == username) & (F.col("password_hash") == password_hash(F.lit(password)))
    return not history.table("users").where(mine).isEmpty()
