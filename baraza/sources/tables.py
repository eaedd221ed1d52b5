"""Model tables on Parquet, with their fixed schemas."""

from pyspark.sql import DataFrame, SparkSession

from baraza import schemas


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def write_table(df: DataFrame, root: str, name: str, mode: str = "error") -> None:
    names = schemas.TABLES[name].fieldNames()
    df.select(*names).write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def seed_if_empty(spark: SparkSession, rows: DataFrame, root: str, name: str) -> bool:
    """Write a starting registry unless the table already holds rows. Returns whether it wrote."""
    path = f"{root.rstrip('/')}/{name}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    if exists and not read_table(spark, root, name).isEmpty():
        return False
    rows.select(*schemas.TABLES[name].fieldNames()).write.mode("append").parquet(path)
    return True
