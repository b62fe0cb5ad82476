"""Side inputs and lists of files."""

import json
import pickle

import pytest

from orrery.sources import files


def test_term_maps_are_plain_values(spark, tmp_path):
    path = tmp_path / "terms.pkl"
    path.write_bytes(pickle.dumps({"abc": {"GO:1", "GO:2", "X:1"}, "d": frozenset(), 5: ["GO:3"]}))
    assert sorted(map(tuple, files.read_term_map(spark, str(path), "GO:").collect())) == [("5", "GO:3"), ("ABC", "GO:1"), ("ABC", "GO:2")]

    class Runs:
        def __reduce__(self):
            return (print, ("ran",))

    path.write_bytes(pickle.dumps({"a": Runs()}))
    with pytest.raises(pickle.UnpicklingError):
        files.read_term_map(spark, str(path))
    path.write_bytes(pickle.dumps([1]))
    with pytest.raises(ValueError):
        files.read_term_map(spark, str(path))


def test_downloads_come_from_the_cache_where_there_is_one(spark, tmp_path):
    source, cache = tmp_path / "a.tsv", tmp_path / "c" / "a.tsv"
    source.write_text("preferredName_A\tpreferredName_B\tscore\na\tb\t0.4\nB\tA\t0.9\na\tc\t7\nx\tx\t1\nq\tr\t?\n")
    text = files.fetched(source.as_uri(), str(cache))
    source.unlink()
    assert files.fetched(source.as_uri(), str(cache)) == text and not (tmp_path / "c" / "a.tsv.part").exists()
    rows = sorted(map(tuple, files.association_scores(spark, text).collect()))
    assert rows == [("A", "B", 0.9), ("A", "C", 1.0), ("B", "A", 0.9), ("C", "A", 1.0)]
    assert files.association_scores(spark, "").count() == 0


def test_file_lists_and_settings(tmp_path):
    (tmp_path / "x").mkdir()
    for n in ("b.txt", "x/a.txt", "x/._a.txt"):
        (tmp_path / n).write_text("")
    assert files.relative_files(str(tmp_path)) == ["b.txt", "x/a.txt"] and files.is_system_file("q/._z")
    (tmp_path / "c.json").write_text(json.dumps({"a": 2, "b": 3}))
    assert files.read_config(str(tmp_path / "c.json"), {"b": None, "a": 5}, {"a": 1, "b": 1, "c": 1}) == {"a": 5, "b": 3, "c": 1}
    with pytest.raises(ValueError, match="z"):
        files.read_config(None, {"z": 1}, {"a": 1})
