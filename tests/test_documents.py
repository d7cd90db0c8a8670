"""Documents are written and named in tasks."""

import os

from tickerloom.sources import sinks
from tickerloom.sources.files import Files


def test_driver_renames_nothing(spark, tmp_path, monkeypatch):
    moved = []
    monkeypatch.setattr(Files, "move", lambda self, name, to: moved.append(name))
    folder = f"file://{tmp_path}/documents"
    rows = [(f"D {k}+%.json", f'{{"k": {k}, "text": "é"}}') for k in range(50)] + [(None, "no name"), ("two.txt", "a"), ("two.txt", "b"), ("none.txt", None)]
    for again in ("", "x"):  # names that are there already are replaced
        documents = spark.createDataFrame([(f, v and v + again) for f, v in rows], "file string, value string").repartition(7)
        sinks.write_documents(documents, folder)
        found = {f: (tmp_path / "documents" / f).read_text() for f in os.listdir(tmp_path / "documents")}
        assert sorted(found.pop("two.txt").split("\n")) == ["", f"a{again}", f"b{again}"]
        assert found.pop("none.txt") == "\n"
        assert found == {f: v + again + "\n" for f, v in rows[:50]}
    assert not moved
    assert {r.file: r.value for r in sinks.read_documents(spark, folder).collect()}["D 7+%.json"] == rows[7][1] + "x"
