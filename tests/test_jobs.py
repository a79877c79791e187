"""The jobs: reruns, growing input, lost batches, odd rows."""

import json
import logging
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from jobs import annotate_texts, profile_arrivals, registry

ROOT, SF = Path(__file__).parents[1], "/root/testdata/sf0.001"
PLAIN = profile_arrivals.Settings(files_per_batch=1, state_partitions=3)


def counted(cells):
    """(label, pos) with cells and ones, from (label, vector)."""
    out = {}
    for label, x in cells:
        for pos, v in enumerate(x or ()):
            n, ones = out.get((label or 0, pos), (0, 0))
            out[label or 0, pos] = n + 1, ones + (v is not None and v > 0)
    return out


def profiles(df):
    return {(r["label"], r["pos"]): (r["cells"], r["ones"]) for r in df.collect()}


@pytest.fixture(scope="module")
def arrivals(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    return [rows[:200], rows[200:300], [*rows[300:], (1000, [1.0] * 64, None), (1001, None, 3), (None, [float("nan")] * 64, 3)]]


def add(spark, folder, rows):
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.mode("append").parquet(folder)


def test_only_what_is_new_is_read(spark, arrivals, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    cells, output = f"{tmp_path}/cells", f"file://{tmp_path}/out"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for k, rows in enumerate(arrivals):
        add(spark, cells, rows)
        caplog.clear()
        out = profiles(profile_arrivals.run(spark, cells, output, PLAIN))
        assert out == counted((label, x) for part in arrivals[: k + 1] for _, x, label in part)
        assert f"read {len(rows)} new rows" in caplog.text
    caplog.clear()
    assert profiles(profile_arrivals.run(spark, cells, output, PLAIN)) == out and "read 0 new rows" in caplog.text
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    from tessella.operators import memory

    held = memory.load(spark, f"{output}/model").patterns.collect()
    assert {r["cls"] for r in held} == {label for label, _ in out if label} and all(r["p"][5] == (2 * out[r["cls"], 5][1] > out[r["cls"], 5][0]) for r in held)


def test_a_batch_that_broke_off_is_taken_again(spark, arrivals, tmp_path, monkeypatch):
    cells, output = f"{tmp_path}/cells", f"{tmp_path}/out"
    for rows in arrivals:
        add(spark, cells, rows)
    whole, calls = profile_arrivals.written, []

    def broken(df, path, *by):
        calls.append(path)
        if len(calls) == 2:
            raise OSError("lost")
        return whole(df, path, *by)

    monkeypatch.setattr(profile_arrivals, "written", broken)
    with pytest.raises(Exception, match="lost"):
        profile_arrivals.run(spark, cells, output, PLAIN)
    out = profiles(profile_arrivals.run(spark, cells, output, PLAIN))
    assert out == counted((label, x) for part in arrivals for _, x, label in part) and len(calls) == 4  # one batch twice


def test_no_cells(spark, tmp_path):
    add(spark, f"{tmp_path}/cells", [])
    assert profile_arrivals.run(spark, f"{tmp_path}/cells", f"{tmp_path}/out", PLAIN).count() == 0


DOCS = [(1, "the cat the dog", "en"), (2, "the bird", "en"), (2, "a cat", "en"), (3, "le chat le chien", "fr"), (4, "le oiseau", "fr"), (None, "the the", "en"), (5, None, None), (6, "", "xx"), (7, "the le", None)]
TURNS = [(1, 0, "the dog the"), (1, 1, "LE chien"), (1, 1, "le"), (2, 0, None), (None, 0, "the"), (2, None, "the")]


@pytest.fixture
def texts(spark, tmp_path):
    spark.createDataFrame([(*r, "further") for r in DOCS], "doc_id bigint, text string, lang string, label string").write.parquet(f"{tmp_path}/documents")
    spark.createDataFrame([(*r, "user") for r in TURNS], "conv_id bigint, turn bigint, text string, role string").write.parquet(f"{tmp_path}/conversations")
    return {"documents": f"{tmp_path}/documents", "conversations": f"{tmp_path}/conversations"}


def test_annotations(spark, texts, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    settings = annotate_texts.Settings({"en": 1, "fr": 2}, features=4)
    runs = [sorted(map(tuple, annotate_texts.run(spark, **texts, output=f"{tmp_path}/out", settings=settings).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    # The words in most documents, ties by word. No turn has a or cat.
    assert [(r["pos"], r["frequency"]) for r in spark.read.parquet(f"{tmp_path}/out/features").orderBy("rank").collect()] == [("le", 3.0), ("the", 3.0), ("cat", 2.0), ("a", 1.0)]
    assert {r["cell_id"]: r["x"] for r in spark.read.parquet(f"{tmp_path}/out/vectors").collect()} == {
        "1": [0, 1, 0, 1], "2": [1, 1, 0, 1], "3": [0, 0, 1, 0], "4": [0, 0, 1, 0], "5": [0] * 4, "6": [0] * 4, "7": [0, 0, 1, 1],
        "1:0": [0.5, 0.5, 0, 1], "1:1": [0.5, 0.5, 1, 0], "2:0": [0.5, 0.5, 0, 0],
    }
    found = {r[0]: (r[1], r[5], r[6]) for r in runs[0]}
    assert {k: found[k] for k in ("1", "2", "3", "4", "1:0", "1:1")} == {"1": (1, "documents", "en"), "2": (1, "documents", "en"), "3": (2, "documents", "fr"), "4": (2, "documents", "fr"), "1:0": (0, "conversations", "en"), "1:1": (0, "conversations", "fr")}
    assert found["5"][0] == found["6"][0] == found["7"][0] == 0 and len(found) == 10
    assert "read 9 rows" in caplog.text and "1 of them without an id" in caplog.text and "2 of them without an id" in caplog.text and "wrote 10 rows" in caplog.text
    assert {p.name for p in (tmp_path / "out/annotations/data_set=documents").iterdir()} == {"class=en", "class=fr"}


def test_vectors_are_formed_by_many_tasks(spark, texts, tmp_path):
    annotate_texts.run(spark, **texts, output=f"{tmp_path}/out", settings=annotate_texts.Settings({"en": 1, "fr": 2}, features=4))
    assert len(list((tmp_path / "out/vectors/data_set=documents").glob("*.parquet"))) > 1


def test_words_are_cut_once_and_only_packed_ones_move(spark, texts):
    from tessella.operators import packed

    cells = annotate_texts.cells_of(spark.read.parquet(texts["documents"]), "doc_id")
    top = spark.createDataFrame([("the", 1), ("cat", 2)], "pos string, rank int")
    rows = packed.from_entries(annotate_texts.chosen(cells, top), 2, cells.select("cell_id").distinct())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "partial_bit_or" in plan
    above = plan[: plan.index("regexp_extract_all")].rsplit("Exchange hashpartitioning", 1)[1]
    assert "BroadcastHashJoin" in above and "partial_bit_or" in above  # both come before the first shuffle of words
    assert {r["cell_id"]: r["words"] for r in rows.collect()} == {"1": [0b11], "2": [0b11], "3": [0], "4": [0], "5": [0], "6": [0], "7": [0b10]}


def test_packed_entries(spark):
    from tessella.operators import packed

    entries = spark.createDataFrame([("a", p) for p in (0, 63, 64, 64, 69, 70, -1)] + [("b", 129), ("d", 1)], "cell_id string, pos int")
    cells = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "cell_id string, label int")
    assert sorted(map(tuple, packed.from_entries(entries, 70, cells).collect())) == [("a", 1, [1 - 2**63, 0b100001]), ("b", 2, [0, 0]), ("c", 3, [0, 0])]
    assert {tuple(r["words"]) for r in packed.from_entries(entries, 0, cells).collect()} == {()}


def test_too_many_features():
    with pytest.raises(ValueError, match="features"):
        annotate_texts.Settings({"en": 1}, features=annotate_texts.MOST_FEATURES + 1)


def test_command_line(tmp_path):
    config = tmp_path / "settings.json"
    config.write_text(json.dumps({"files_per_batch": 2, "state_partitions": 2}))
    command = [sys.executable, "-m", "jobs.profile_arrivals", "--config", str(config), "--cells", f"{SF}/embeddings.parquet", "--output", str(tmp_path / "out")]
    said = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, check=True)
    assert "read 500 new rows" in said.stderr and "wrote 640 rows" in said.stderr
    assert len(list((tmp_path / "out/profiles").glob("label=*"))) == 10


def test_queries_leave_their_files(spark):
    folder = Path(registry.shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("profile_arrivals-*"))
    assert registry.job2_profile_arrivals(spark, SF).count() == 640
    new = set(folder.glob("profile_arrivals-*")) - before
    assert len(new) == 1 and {p.name for p in new.pop().iterdir()} == {"checkpoint", "profiles", "model"}


def test_configurations_fit():
    assert Counter(type(registry.configured(j)).__module__ for j in (annotate_texts, profile_arrivals)) == {"jobs.annotate_texts": 1, "jobs.profile_arrivals": 1}
