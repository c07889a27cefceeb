"""Growing, torn, shortened and replaced log files, restarts, and ranges read by several tasks."""

import json

import pytest

from turnscope.streaming import jobs


@pytest.fixture
def log(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()

    def run(**options):
        """New lines of this run, in order: (file, value)."""
        before = {tuple(r) for r in rows()}
        jobs.follow(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "checkpoint"), **options)
        return sorted((p.rsplit("/", 1)[1], at, json.loads(v)["n"]) for p, at, _, v in {tuple(r) for r in rows()} - before)

    def rows():
        if not (tmp_path / "out").exists():
            return []
        return spark.read.schema("path string, at long, type string, value string").parquet(str(tmp_path / "out")).collect()

    return folder, run


def line(n, size=0):
    return json.dumps({"type": "user", "n": n, "pad": "é" * size}) + "\n"


def test_appended_torn_and_new_files(log):
    folder, run = log
    (folder / "a").write_text(line(1) + line(2))
    (folder / "_SUCCESS").write_text("")
    assert [n for _, _, n in run()] == [1, 2]
    whole = line(4)
    (folder / "a").write_text(line(1) + line(2) + line(3) + whole[:9])
    (folder / "b").write_text(line(5)[:-1])
    assert [n for _, _, n in run()] == [3]
    assert run() == []
    with open(folder / "a", "a") as f:
        f.write(whole[9:] + "not json\n\n" + line(6))
    with open(folder / "b", "a") as f:
        f.write("\n")
    assert [(p, n) for p, _, n in run()] == [("a", 4), ("a", 6), ("b", 5)]


def test_shortened_and_replaced_files(log):
    folder, run = log
    (folder / "a").write_text("".join(line(n) for n in range(1, 6)))
    assert len(run()) == 5
    (folder / "a").write_text(line(7) + line(8))  # shorter: from zero
    assert [n for _, _, n in run()] == [7, 8]
    (folder / "a").write_text("".join(line(n) for n in range(20, 29)))  # longer, but another beginning
    assert [n for _, _, n in run()] == list(range(20, 29))
    (folder / "a").unlink()
    assert run() == []


def test_ranges_split_anywhere(log):
    folder, run = log
    (folder / "a").write_text("".join(line(n, n % 7 * 5) for n in range(200)))
    assert [n for _, _, n in run(rangeBytes="61")] == list(range(200))
    with open(folder / "a", "a") as f:
        f.write("".join(line(n, 90) for n in range(200, 230)))
    assert [n for _, _, n in run(rangeBytes="33")] == list(range(200, 230))
