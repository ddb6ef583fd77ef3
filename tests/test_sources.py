"""Stores, readers and backups on small folders."""

from datetime import datetime

from pyspark.sql import functions as F

from cairn.sources import backup, stores


def test_partitioned_store(spark, tmp_path):
    path = str(tmp_path / "ltm")
    assert stores.read(spark, path, stores.LTM).count() == 0
    row = lambda i, c: spark.createDataFrame([(i, "x", c, "s", ["t"], datetime(2025, 1, 1), None, False, None, None)], stores.LTM)
    stores.write(row("1", "habit"), path)
    stores.append(row("2", "other"), path)
    stores.write(row("3", "habit"), path)
    assert {r["id"] for r in stores.read(spark, path, stores.LTM).collect()} == {"2", "3"}
    assert [r["id"] for r in stores.read(spark, path, stores.LTM, "other").collect()] == ["2"]
    stores.write(row("4", "habit"), path, whole=True)
    assert {r["id"] for r in stores.read(spark, path, stores.LTM).collect()} == {"4"}


def test_json_and_front_matter(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"a": 3, "b": 5}')
    assert {tuple(r) for r in stores.read_weights(spark, str(tmp_path / "w.json")).collect()} == {("a", 3), ("b", 5)}
    (tmp_path / "e").mkdir()
    (tmp_path / "e/1.json").write_text('[{"id": "1", "hint": "h"}]')
    (tmp_path / "e/2.json").write_text('{"entries": [{"id": "2"}]}')
    (tmp_path / "e/3.json").write_text("broken")
    assert {r["id"] for r in stores.read_encrypted(spark, str(tmp_path / "e")).collect()} == {"1", "2"}
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.md").write_text("---\nentries:\n- {id: a, content: 你好, tags: [x], created_at: '2025-01-01T00:00:00', more: 1}\n- 3\n---\nbody")
    (tmp_path / "m/b.md").write_text("---\n: [\n---\n")
    (tmp_path / "m/c.md").write_text("plain")
    got = stores.read_front_matter(spark, str(tmp_path / "m"), stores.LTM).collect()
    assert [(r["id"], r["content"], r["tags"], r["category"], r["created_at"]) for r in got] == [("a", "你好", ["x"], None, datetime(2025, 1, 1))]


def test_backups(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "b")
    (src / ".git").mkdir(parents=True)
    (src / "a.md").write_text("1")
    (src / "x.log").write_text("no")
    (src / ".git/c").write_text("no")
    at = datetime(2025, 1, 1)
    assert backup.create(str(src), root, "one", at)["files"] == ["a.md"]
    (src / "a.md").write_text("2")
    assert backup.restore(root, "one", str(src), at) == 1
    assert (src / "a.md").read_text() == "1"
    assert backup.listed(spark, root).count() == 2
    d = spark.createDataFrame([("n3", "2025-03-01T00:00:00"), ("n2", "2025-02-01T00:00:00"), ("n1", "bad")], "backup_name string, timestamp string")
    as_of = F.lit("2025-03-02").cast("timestamp")
    assert [r[0] for r in backup.expired(d, 1, 10, as_of).select("backup_name").collect()]
    assert backup.expired(d, 5, 0, as_of).count() == 0
    assert backup.delete(root, "one", True) and not backup.delete(root, "one", True)
    assert spark.range(1).select(backup.excluded_column(F.lit("a/.gitignore"))).first()[0] and backup.excluded("a/.gitignore")
