"""The golden store: several keys for each image, updated one by one."""

import json
import os

import pytest

from gridweave.sources import golden_store as GS
from gridweave.sources.files import read_golden_class

DET = "image_id bigint, det_idx int, score double, l double, t double, r double, b double"


def dets(spark, rows):
    return spark.createDataFrame([(i, k, s, x, 0.0, x + 5.0, 9.0) for i, k, s, x in rows], DET)


def state(spark, path):
    rows = GS.read_golden_store(spark, path).collect()
    assert len({(r.image_id, r.list) for r in rows}) == len(rows)  # one record for an image and key
    lists = {(r.image_id, r.list): [(d.bbox.l, d.confidence) for d in r.detection] for r in rows if r.list != "classification"}
    return lists, {r.image_id: tuple(r.classification) for r in rows if r.list == "classification"}


def test_an_update_of_one_key_leaves_the_others(spark, scratch):
    path = os.path.join(scratch, "store")
    wired = dets(spark, [(i, 0, 0.5, 2.0) for i in range(20)] + [(3, 1, 0.25, 1.0), (None, 0, 0.75, 4.0)])
    classes = spark.createDataFrame([(i, "wired", 0.5) for i in range(20)] + [(3, "wireless", 0.90625)], "image_id bigint, label string, score float")
    GS.write_golden_store(path, {"a": wired, "b": dets(spark, [(1, 0, 0.5, 7.0)])}, classes, buckets=4)
    want = {(i, "a"): [(2.0, 0.5)] for i in range(20)}
    want |= {(3, "a"): [(1.0, 0.25), (2.0, 0.5)], (None, "a"): [(4.0, 0.75)], (1, "b"): [(7.0, 0.5)]}  # reading order
    want_classes = {i: ("wired", 0.5) for i in range(20)} | {3: ("wireless", 0.9062)}  # half to even, highest score
    assert state(spark, path) == (want, want_classes)

    GS.update_golden_store(spark, path, {"a": dets(spark, [(5, 0, 1.0, 8.0), (None, 0, 1.0, 9.0), (40, 0, 1.0, 1.0)])})
    want |= {(5, "a"): [(8.0, 1.0)], (None, "a"): [(9.0, 1.0)], (40, "a"): [(1.0, 1.0)]}
    assert state(spark, path) == (want, want_classes)

    GS.update_golden_store(spark, path, {"new key/1": dets(spark, [(5, 0, 1.0, 8.0)])}, classes.filter("image_id = 2").withColumn("label", classes.label))
    want[5, "new key/1"] = [(8.0, 1.0)]
    assert state(spark, path) == (want, want_classes)

    GS.update_golden_store(spark, path, {"a": dets(spark, [])})
    assert state(spark, path) == (want, want_classes)

    objects = {r.image_id: r for r in GS.golden_objects(GS.read_golden_store(spark, path), ["a", "b", "new key/1"]).collect()}
    assert len(objects) == 22 and objects[1]["b"][0].bbox.l == 7.0 and objects[40].classification is None and objects[2]["b"] is None
    flat = GS.object_detections(GS.golden_objects(GS.read_golden_store(spark, path), ["new key/1"]), "new key/1").collect()
    assert [(r.image_id, r.rank, r.l, r["class"]) for r in flat] == [(5, 0, 8.0, "wired")]


def test_a_new_store_replaces_the_old_one_and_bad_keys_raise(spark, scratch):
    path = os.path.join(scratch, "store")
    GS.write_golden_store(path, {"a": dets(spark, [(1, 0, 0.5, 2.0)])}, buckets=3)
    GS.write_golden_store(path, {"b": dets(spark, [(2, 0, 0.5, 2.0)])}, buckets=5)
    assert state(spark, path) == ({(2, "b"): [(2.0, 0.5)]}, {})
    with pytest.raises(ValueError):
        GS.golden_rows({"classification": dets(spark, [])})
    with pytest.raises(ValueError):
        GS.golden_rows({})


def test_the_classification_of_a_golden_file(spark, scratch):
    path = os.path.join(scratch, "golden.json")
    with open(path, "w") as f:
        json.dump({"classification": {"class": "wired", "confidence": 0.99}, "list": []}, f)
    assert [tuple(r) for r in read_golden_class(spark, path).collect()] == [("wired", 0.99)]
