import json

from spanmill import cli
from tests_support import sessions


def test_commands(spark, tmp_path, capsys):
    rows = [{"timestamp": "2026-01-01T00:00:00Z", "request": {"path": "/v1/messages", "body": {"model": "m", "system": "Be brief", "messages": [{"role": "user", "content": "deploy the red service"}]}}, "response": {"body": {"content": [{"type": "text", "text": "The red service is deployed."}]}}}]
    source, store = str(tmp_path / "t.jsonl"), str(tmp_path / "kb")
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "empty.jsonl").write_text("")
    run = lambda *a: cli.main(list(a), spark)
    assert run("export", source, "--format", "markdown") == 0 and "deploy the red service" in capsys.readouterr().out
    assert run("export", str(tmp_path / "empty.jsonl")) == 1 and run("export", source, "--format", "odd") == 2
    assert run("export-prompt", source) == 0 and "Be brief" in capsys.readouterr().out
    assert run("index", source, store) == 0 and run("status", store) == 0
    assert run("reindex", store) == 0 and "indexed=2 failed=0" in capsys.readouterr().out
    assert run("search", store, "red service") == 0 and "deploy" in capsys.readouterr().out
    assert run("search", store, "!!!", "--min-score", "2") == 1
    spark.read.parquet(store).drop("embedder").selectExpr("*", "'other' AS embedder").write.parquet(store + "2")
    assert run("search", store + "2", "red") == 3
    sessions(spark, [{"id": "a", "date_key": "2026-01-01", "record_count": 1}]).write.parquet(str(tmp_path / "s"))
    assert run("stats", str(tmp_path / "s")) == 0 and run("stats", str(tmp_path / "s"), "--from", "soon") == 2


def test_purge_and_timeline(spark, tmp_path, capsys):
    rows = [{"timestamp": f"2026-01-0{i}T00:00:00Z", "request": {"path": "/v1/messages", "body": {"model": "m", "system": f"Rule {i}", "messages": [{"role": "user", "content": f"find the blue door {i}"}]}}, "response": {"body": {"content": []}}} for i in (1, 2)]
    for i, r in enumerate(rows):
        (tmp_path / f"t{i}.jsonl").write_text(json.dumps(r))
    source, store = str(tmp_path / "t*.jsonl"), str(tmp_path / "kb")
    run = lambda *a: cli.main(list(a), spark)
    assert run("timeline", source) == 0 and capsys.readouterr().out.count("v1") == 1
    assert run("index", source, store) == 0
    digest = spark.read.parquet(store).where("text LIKE '%door 1'").first()["content_hash"]
    assert run("purge", store, "nothing") == 1 and run("purge", store, digest, "--undo") == 1
    assert run("purge", store, digest) == 0 and spark.read.parquet(store).count() == 1
    assert run("index", source, store) == 0 and spark.read.parquet(store).count() == 1
    assert run("purge", store, digest, "--undo") == 0 and run("index", source, store) == 0 and spark.read.parquet(store).count() == 2
    (tmp_path / "s.toml").write_text('[retrieval]\nembedder = "api"\n')
    assert run("search", store, "door", "--settings", str(tmp_path / "s.toml")) == 2


def test_replace_that_was_interrupted(spark, tmp_path):
    """A table that was set aside before another took its place is there again."""
    from spanmill import cli

    path = str(tmp_path / "store")
    spark.range(3).write.parquet(path + cli.ASIDE)
    assert cli._table(spark, path, "id long").count() == 3
    cli._replace(spark, spark.read.parquet(path).where("id > 0"), path)
    assert cli._table(spark, path, "id long").count() == 2
    assert cli._table(spark, str(tmp_path / "none"), "id long").count() == 0
