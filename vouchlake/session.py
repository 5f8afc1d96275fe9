"""SparkSession settings shared by tests, bench and applications."""

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(master).appName("vouchlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
