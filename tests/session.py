"""Session used by tests and tools."""

from pyspark.sql import SparkSession


def make_session(cpus: int = 4, partitions: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("pandwerk")
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark
