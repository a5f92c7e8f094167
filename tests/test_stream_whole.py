import numpy as np
import pandas as pd

from recurra.streaming.profile import incremental_profile


def test_old_windows_stay_in_reach(spark, tmp_path):
    x = np.random.default_rng(24).normal(size=10_020)
    x[-6:] = x[:6]
    schema = "series string, dim int, t long, v double"
    for k, (a, z) in enumerate(((0, 5000), (5000, 10_010), (10_010, 10_020))):
        part = pd.DataFrame({"series": "s", "dim": 0, "t": np.arange(a, z), "v": x[a:z]})
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*")
    for keep in (None, 100):
        q = incremental_profile(stream, 6, keep=keep).writeStream.format("memory").queryName(f"whole_{keep}").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp{keep}").start()
        q.processAllAvailable()
        q.stop()
        last = spark.table(f"whole_{keep}").where("i = 10014").first()
        assert last["j"] == 0 if keep is None else last["j"] >= last["since"] == 9910
