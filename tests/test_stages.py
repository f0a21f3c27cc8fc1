"""Registry, options, the chain of stages, and streams."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioframe.functions import options as O
from folioframe.functions import registry
from folioframe.operators import kernels as K
from folioframe.operators import scans as S
from folioframe.plans import stages
from folioframe.streaming import queue, stats
from test_kernels import text_page


def packed(spark, pages: dict[int, np.ndarray]):
    return spark.createDataFrame([(k, a.shape[1], a.shape[0], a.tobytes()) for k, a in pages.items()], "img_id long, width int, height int, data binary")


def unpacked(df) -> dict[int, np.ndarray]:
    return {r["img_id"]: np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"]) for r in df.collect()}


def test_options():
    o, rest = O.parsed(["--layout=2", "-ld=rl", "--margins=5", "--margins-top=7", "--verbose", "--content-box=1x2:30x40", "in.tif", "out"])
    assert rest == ["in.tif", "out"] and o["layout"] == "2" and o["layout-direction"] == "rl" and o["verbose"]
    assert (o["margins-left"], o["margins-top"], o["content-box"]) == (5.0, 7.0, (1.0, 2.0, 30.0, 40.0)) and o["dpi-x"] == 300
    for bad in (["--layout=3"], ["--nothing"], ["--threshold"], ["--threshold=x"], ["--start-filter=5", "--end-filter=2"], ["--end-filter=7"]):
        with pytest.raises(ValueError):
            O.parsed(bad)
    assert O.fingerprint(o) == O.fingerprint(dict(reversed(o.items()))) and len(O.OPTIONS) >= 60


def test_registry(spark):
    registry.register_binarizer("half", lambda g, size, k, delta: (g < 128).astype(np.uint8), replace=True)
    assert K.binarized(np.array([[10, 200]], np.uint8), "half").tolist() == [[1, 0]]
    with pytest.raises(ValueError, match="registered"):
        registry.register_binarizer("half", lambda *a: None)
    registry.register_order("odd_first", lambda: [F.col("page") % 2 == 0], replace=True)
    df = spark.createDataFrame([(1, 1, p, p != 3, p * 1.0) for p in range(1, 6)], "project long, img long, page long, done boolean, angle double")
    rank = lambda **k: [r["page"] for r in registry.ordered(df, project_order, "project", ["img", "page"], **k).orderBy("rank").collect()]
    project_order = "odd_first"
    assert rank() == [1, 3, 5, 2, 4] and rank(complete=F.col("done")) == [1, 5, 2, 4, 3]
    project_order = "angle"
    assert rank() == [5, 4, 3, 2, 1] and rank(reverse=True, complete=F.col("done")) == [1, 2, 4, 5, 3]
    with pytest.raises(ValueError, match="no order"):
        registry.ordered(df, "other", "project", ["page"])


def test_chain_of_stages(spark):
    assert [n for n, _ in registry.stages()][:6] == ["fix_orientation", "page_split", "deskew", "select_content", "page_layout", "output"]
    spread = np.hstack([text_page(600, 420, angle=2.0, seed=1), np.full((600, 3), 60, np.uint8), text_page(600, 420, angle=2.0, seed=2)])
    pages = packed(spark, {5: spread, 7: np.full((300, 200), 235, np.uint8)})
    halves = unpacked(stages.process(pages, ["--start-filter=1", "--end-filter=2"]))
    assert sorted(halves) == [16, 17, 21] and abs(halves[16].shape[1] - 421) < 12
    right = unpacked(stages.process(pages, ["--end-filter=2", "--layout-direction=rl"]))
    assert (right[17] == halves[16]).all()
    out = unpacked(stages.process(pages, ["--dpi=300", "--margins=2", "--despeckle=off"]))
    assert len({a.shape for a in out.values()}) == 1 and all(set(np.unique(a)) <= {0, 255} for a in out.values())
    assert abs(K.find_skew(S.black(out[16]))[0]) < 0.6 and (out[21] == 255).all()
    turned = unpacked(stages.process(pages, ["--orientation=left", "--end-filter=1"]))
    assert turned[7].shape == (200, 300)


def test_queue_takes_in_order_and_cancels(spark, tmp_path):
    rows = [(1, 1, "take", 5), (1, 2, "take", 3), (1, 3, "take", 4), (1, 3, "cancel", 6), (2, 1, "cancel", 1), (2, 1, "take", 2), (1, 2, "take", 9)]
    spark.createDataFrame(rows, "img long, page long, kind string, at long").write.json(f"{tmp_path}/in")
    source = spark.readStream.schema("img long, page long, kind string, at long").json(f"{tmp_path}/in")
    got = []
    query = queue.worked(source, lambda df, k: got.extend((r["img"], r["page"], r["place"]) for r in df.collect()), f"{tmp_path}/check")
    query.processAllAvailable()
    query.stop()
    assert sorted(got) == [(1, 1, 2), (1, 2, 1), (2, 1, 1)]


def test_settings_are_compared_and_updated(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    source = spark.readStream.schema(queue.UPDATES).json(str(folder))
    query = queue.settled(source).writeStream.format("memory").queryName("settled").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").start()
    for k, lines in enumerate(['{"img":1,"seen":0,"value":"a"}\n{"img":2,"seen":4,"value":"x"}', '{"img":1,"seen":1,"value":"b"}', '{"img":1,"seen":1,"value":"late"}']):
        (folder / f"{k}.json").write_text(lines)
        query.processAllAvailable()
    query.stop()
    got = sorted((r["img"], r["value"], r["applied"], r["version"]) for r in spark.table("settled").collect())
    assert got == [(1, "a", True, 1), (1, "b", True, 2), (1, "late", False, 2), (2, "x", False, 0)]


def test_late_events_are_left_out(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    query = stats.windowed(spark.readStream.schema(schema).json(str(folder))).writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").start()
    line = lambda k, ts: f'{{"event_id":{k},"ts":"{ts}","user_id":1,"event_type":"a","value":1.0}}'
    for k, times in enumerate([["2024-01-01T00:00:10", "2024-01-01T00:20:00"], ["2024-01-03T00:00:00"], ["2024-01-01T00:00:20", "2024-01-03T00:10:00"], ["2024-01-06T00:00:00"], ["2024-01-07T00:00:00"]]):
        (folder / f"{k}.json").write_text("\n".join(line(10 * k + j, t) for j, t in enumerate(times)))
        query.processAllAvailable()
    query.stop()
    rows = spark.table("late").collect()
    assert sum(r["n"] for r in rows if str(r["window"]["start"]).startswith("2024-01-01")) == 2
