"""cairn.sources"""

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    """Make the formats `car` and `fstree` known to the session."""
    from cairn.sources.car import CarDataSource
    from cairn.sources.fstree import TreeDataSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CarDataSource)
    spark.dataSource.register(TreeDataSource)
