"""The nearest frame against a plain search, whatever the buckets."""

import random

import pytest

from tagloom.sources import tables


@pytest.mark.parametrize("bucket", [1, 70, 1000, 10**7])
def test_nearest_frame(spark, bucket):
    rng = random.Random(bucket)
    frames = [(v, t) for v, n in (("a", 60), ("b", 3), ("c", 0)) for t in rng.sample(range(0, 9000), n)] + [("a", 20000)]
    asked = sorted({(v, rng.randint(-500, 12000)) for v in "abc" for _ in range(150)} | {("a", t) for _, t in frames[:5]} | {("a", 16000)})
    got = tables.nearest_frame(spark.createDataFrame(asked, "filename string, ts long"), spark.createDataFrame(frames, "filename string, timestamp_ms long"), bucket)
    want = {(v, ts): min((t for w, t in frames if w == v), key=lambda t: (abs(t - ts), t), default=None) for v, ts in asked}
    assert {(r.filename, r.ts): r.frame_ts for r in got.collect()} == want


def test_settings_without_a_reader(tmp_path, monkeypatch):
    import builtins

    real = builtins.__import__
    monkeypatch.setattr(builtins, "__import__", lambda name, *a, **k: (_ for _ in ()).throw(ImportError(name)) if name == "yaml" else real(name, *a, **k))
    (tmp_path / "a.yaml").write_text("# x\nfps: 3\n\nname: b: c\n")
    assert tables.read_config(str(tmp_path / "a.yaml")) == {"fps": "3", "name": "b: c"}
    (tmp_path / "b.yaml").write_text("run:\n  fps: 3\n")
    with pytest.raises(ValueError, match="nested"):
        tables.read_config(str(tmp_path / "b.yaml"))
