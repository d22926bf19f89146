"""Tables stored between steps."""

from pathlib import Path

from panelworks.llm.common import stored


def test_stored_tables_are_compressed_and_equal(spark):
    df = spark.range(1000).selectExpr("id", "repeat(cast(id as string), 20) AS line")
    kept = stored(df)
    names = [Path(f.removeprefix("file:")).name for f in kept.inputFiles()]
    assert names and all(n.endswith(".zstd.parquet") for n in names)
    assert kept.columns == df.columns and sorted(kept.collect()) == sorted(df.collect())
