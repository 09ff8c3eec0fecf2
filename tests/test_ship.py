"""What a session gets before Python runs on its executors."""

from foliospark.ship import BATCHES, ship


def test_batches_and_path(spark):
    records, size = BATCHES
    before = {k: spark.conf.get(k) for k in BATCHES}
    try:
        spark.conf.set(records, "10000")
        spark.conf.set(size, "123456")
        ship(spark)
        assert spark.conf.get(records) == "1000" and spark.conf.get(size) == "123456"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

    def where(batches):
        import foliospark
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([foliospark.__name__])], names=["name"])

    assert spark.range(3).coalesce(1).mapInArrow(where, "name string").first()[0] == "foliospark"
