import json

import pytest

from corpusplan.sources.requests import read_batch, single_request

ENTRIES = [
    {"target_dir": None, "dataset_id": "news-commentary-v18"},
    {"dataset_id": "wmt09", "language_pair": "", "category": "dev", "mirror": ["eu", 2], "target_dir": ""},
    {"dataset_id": "europarl", "language_pair": "cs-en", "target_dir": "parl"},
]


def write(tmp_path, body):
    path = tmp_path / "batch.json"
    path.write_text(body if isinstance(body, str) else json.dumps(body), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("body", [ENTRIES, {"datasets": ENTRIES, "other": 1}])
def test_list_and_object(spark, tmp_path, body):
    rows = read_batch(spark, write(tmp_path, body)).orderBy("req_id").collect()
    assert [(r.req_id, r.dataset_id, r.language_pair, r.category, r.target_dir, r.has_target_dir, r.extra)
            for r in rows] == [
        (0, "news-commentary-v18", None, None, None, True, {}),
        (1, "wmt09", None, "dev", "", True, {"mirror": '["eu",2]'}),
        (2, "europarl", "cs-en", None, "parl", True, {})]


def test_missing_target_dir(spark, tmp_path):
    row = read_batch(spark, write(tmp_path, [{"dataset_id": "wmt"}])).first()
    assert (row.target_dir, row.has_target_dir) == (None, False)


@pytest.mark.parametrize("body,problem", [
    ("{}", "not a JSON array"), ("3", "not a JSON array"), ('"x"', "not a JSON array"), ("null", "not a JSON array"),
    ('{"datasets": [', "not a JSON array"), ("[]", "no datasets"), ('{"datasets": []}', "no datasets"),
    ('{"datasets": null}', "no datasets"), ("[3]", "not an object"), ('{"datasets": ["x"]}', "not an object"),
    ('[{"dataset_id": "wmt"}] junk', "not a JSON array"), ('{"datasets": [{"dataset_id": "wmt"}]} {}', "not a JSON array"), ('[{"category": "x"}]', "no dataset_id"), ("", "batch|JSON"),
    ('[{"dataset_id": "wmt"}]] junk', "not a JSON array"), ('{"datasets": [{"dataset_id": "wmt"}]}] junk', "not a JSON array"),
    ('[{"dataset_id": "wmt"}]} junk', "not a JSON array"), ('[{"dataset_id": "wmt"}],"v":1', "not a JSON array"),
    ('[{"dataset_id": "wmt"}],', "not a JSON array"), ('[{"dataset_id": "wmt"}]}, {"v": 1', "not a JSON array"),
])
def test_malformed(spark, tmp_path, body, problem):
    with pytest.raises(ValueError, match=problem):
        read_batch(spark, write(tmp_path, body))


def test_one_batch_file_only(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps(ENTRIES))
    with pytest.raises(ValueError, match="2 batch files"):
        read_batch(spark, str(tmp_path))


def test_last_of_doubled_keys(spark, tmp_path):
    assert read_batch(spark, write(tmp_path, '[{"dataset_id": "a", "dataset_id": "b"}]')).first().dataset_id == "b"


def test_unreadable(spark, tmp_path):
    with pytest.raises(Exception):
        read_batch(spark, str(tmp_path / "none.json"))


def test_single_request(spark):
    row = single_request(spark, "wmt14", category="").first()
    assert (row.dataset_id, row.category, row.has_target_dir) == ("wmt14", None, False)
