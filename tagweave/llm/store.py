"""Tables written in the shared folder between the steps of an operator."""

from pyspark.sql import DataFrame, SparkSession

from tagweave.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written once as Parquet under ``spark.checkpoint.dir`` and
    read back: a reliable cut of the lineage, more compact than a checkpoint,
    and columns that a step doesn't need aren't read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this package wrote."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """The stored tables of one run; ``clear`` deletes them once the result no
    longer reads them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            remove(self.spark, path)
        self.paths.clear()
