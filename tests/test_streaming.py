import json

from graphloom.streaming import incremental


def test_only_new_files_are_parsed(spark, tmp_path):
    src, out, ck = (tmp_path / x for x in ("in", "out", "ck"))
    src.mkdir()
    for k in range(2):
        (src / f"{k}.json").write_text(json.dumps({"service": "s", "path": f"{k}.py", "language": "python", "text": f"def f{k}():\n    return {k}\n"}) + "\n")
        incremental.parse_stream(spark, f"file://{src}", f"file://{out}", f"file://{ck}").awaitTermination(60)
    rows = spark.read.parquet(f"file://{out}").where("type = 'function'").collect()
    assert sorted(r.name for r in rows) == ["f0", "f1"]
