from geoplane.operators import catalog as CT
from geoplane.plans import tables as T

SF = "/root/testdata/sf0.001"


def test_job_logs_are_dealt_by_size(spark, monkeypatch):
    want = sorted(map(tuple, CT.log_level_counts(T.history(spark, SF)).collect()))
    rows = T.read(spark, SF, "lineitem").count()
    monkeypatch.setattr(T, "TASK_ROWS", 200, raising=False)
    counts = CT.log_level_counts(T.history(spark, SF))
    assert sorted(map(tuple, counts.collect())) == want
    assert f", {-(-rows // 200)})" in counts._jdf.queryExecution().toString()
