import pytest

from voxloom.plans import config
from voxloom.sources import manifests


def test_all_faults_at_once():
    with pytest.raises(ValueError) as e:
        config.checked("grow", {"img_path": "a.tif", "seg_path": 3, "thresholds": [5, -1], "dilation_steps": 2, "touch_rule": "push", "output_folder": "o", "colour": 1})
    for part in ("colour: unknown", "seg_path: int", "thresholds: out of", "touch_rule: not one of"):
        assert part in str(e.value)
    good = config.checked("grow", {"img_path": "a.tif", "seg_path": "s.tif", "thresholds": 5, "dilation_steps": [2], "touch_rule": "stop", "output_folder": "o"})
    assert good["min_growth_size"] == 50 and good["no_growth_max_iter"] == 3
    with pytest.raises(ValueError, match="is needed"):
        config.checked("mesh", {"num_threads": 1, "output_folder": "o"})


def test_threshold_order():
    assert config.thresholds([1, 2], [9, 8], rising=True) == [(1, 9), (2, 8)]
    assert config.thresholds(7, None, rising=False) == [(7, None)]
    for lower, upper, rising in (([2, 1], None, True), ([1, 2], None, False), ([1, 2], [8, 9], True), ([5], [4], True), ([1], [2, 3], True)):
        with pytest.raises(ValueError):
            config.thresholds(lower, upper, rising)


def test_lists():
    assert config.segment_list(5, 2, 1) == [5, 5, 5, 5]
    assert config.segment_list(5, None, 2, first=9, last=1) == [9, 5, 1]
    assert config.footprints("ball", 2, ["ball"]) == ["ball", "ball"]
    assert (config.adaptive_mode([3]), config.adaptive_mode([3, 4])) == ("erosion", "threshold")
    with pytest.raises(ValueError):
        config.footprints(["ball", "disc"], 2, ["ball"])


def test_manifest(spark, tmp_path):
    (tmp_path / "m.csv").write_text('img_path,thresholds,steps\na.tif,"[3, 4]",1\nb.tif,5,\n')
    rows = manifests.read(spark, str(tmp_path / "m.csv"), ["thresholds"])
    assert [r.thresholds for r in rows.orderBy("img_path").collect()] == [[3, 4], [5]]

    def make(row):
        if row["steps"] is None:
            raise ValueError("no steps")
        return "out/" + row["img_path"]

    got = {r.img_path: (r.output_folder, r.error) for r in manifests.run(rows, make).collect()}
    assert got == {"a.tif": ("out/a.tif", None), "b.tif": (None, "ValueError: no steps")}
    assert manifests.merged({"a": 1, "b": None}, {"b": 2}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        manifests.merged({"a": 1}, {"a": 2})


def test_parameters_of_a_run_are_saved_and_read(spark, tmp_path):
    given = {"img_path": "a.tif", "seg_path": "s.tif", "thresholds": [9, 5], "dilation_steps": [2, 1], "touch_rule": "stop", "output_folder": "o"}
    config.save(spark, str(tmp_path / "run"), {**given, "image": object()})
    assert config.load(spark, str(tmp_path / "run")) == given
    assert config.load(spark, str(tmp_path / "run"), "grow")["min_growth_size"] == 50
    (tmp_path / "c.json").write_text('{"num_threads": 2, "output_folder": "o", "input_folder": "i"}')
    assert config.load(spark, str(tmp_path / "c.json"), "mesh")["num_threads"] == 2
    (tmp_path / "bad.yaml").write_text("- 1")
    with pytest.raises(ValueError, match="no parameters"):
        config.load(spark, str(tmp_path / "bad.yaml"))


def test_a_pair_of_thresholds_out_of_order_fails(spark):
    from voxloom.functions import thresholds

    cells = spark.createDataFrame([(0, 5)], "img_id int, v int")
    with pytest.raises(Exception, match="isn't below upper"):
        thresholds.threshold_pairs(cells, "actual_values", (100, 140), (100, 180), 3).collect()
