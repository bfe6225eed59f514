import pytest


@pytest.fixture
def table_dir(tmp_path):
    """Writes tables as a sf folder: save(spark, name, rows, schema, parts)."""
    def save(spark, name, rows, schema, parts=3):
        spark.createDataFrame(rows, schema).repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return save
