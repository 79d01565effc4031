import pandas as pd
from pyspark.sql import functions as F

from gritstone import jobs, schemas
from gritstone.operators import lifecycle
from gritstone.rules.load import read_packs


def files(spark):
    return spark.createDataFrame(
        [("go.mod", "module x"), ("a.go", 'exec.Command("sh", "-c", x)\n'), ("b.py", "import os\nq = input()\nos.system(q)\neval(q)\n"), ("c.rs", '.route("/x", post(h))'), ("d.c", "strcpy(a, b);")], "path string, content string"
    )


def test_scan_twice(spark):
    rules = read_packs()
    first = jobs.scan_project(spark, files(spark), rules, run="1").cache()
    got = {r.path: sorted((c.vulnSlug, c.lineNumbers[0]) for c in r.candidates) for r in first.collect()}
    assert got["a.go"] == [("go-shell-command", 1)] and got["b.py"] == [("py-eval-call", 4), ("py-shell-call", 3)] and got["d.c"] == [("c-unbounded-copy", 1)] and got["c.rs"] == []
    again = jobs.scan_project(spark, files(spark), rules, known=first, run="2")
    assert {r.path: (len(r.candidates), r.run_id) for r in again.collect()} == {p: (len(c), "2") for p, c in got.items()}


def backend(tag):
    def run(batch, paths, rows):
        return {"results": [{"filePath": p, "findings": [{"severity": "HIGH", "vulnSlug": "s", "title": f"The  {tag} hole" if tag != "same" else "the HOLE", "description": "d", "lineNumbers": [1], "confidence": "high"}]} for p in paths], "cost": 1.0}

    return run


def records(spark):
    none = F.array()
    return spark.createDataFrame([("a", "pending"), ("b", "analyzed"), ("c", "error")], "filePath string, status string").withColumns(
        {"candidates": F.from_json(F.lit('[{"vulnSlug":"s"}]'), schemas.CANDIDATES), "analysisHistory": none.cast(f"array<{schemas.HISTORY}>"), "lockedByRunId": F.lit(None).cast("string"), "lockedAt": F.lit(None).cast("string")}
    )


def test_process_and_ensemble(spark):
    src = spark.createDataFrame([(x, "x\n") for x in "abc"], "path string, content string")
    got = jobs.process(spark, records(spark), src, backend("one"))
    assert sorted((r.path, r.problem, r.cost) for r in got.collect()) == [("a", None, 0.5), ("c", None, 0.5)]
    both = jobs.ensemble(spark, records(spark), src, {"x": backend("big"), "y": backend("BIG"), "z": backend("other")})
    assert sorted((r.path, r.n_agents) for r in both.collect()) == sorted([(p, n) for p in "abc" for n in (1, 2)])


def test_locks_and_runs(spark):
    held = lifecycle.lock(records(spark), records(spark).where("filePath = 'a'"), "r1", "t")
    assert {r.filePath: (r.status, r.lockedByRunId) for r in held.collect()}["a"] == ("processing", "r1")
    free = lifecycle.release(held, "r1", F.lit("analyzed"))
    assert {r.filePath: (r.status, r.lockedByRunId) for r in free.collect()} == {"a": ("analyzed", None), "b": ("analyzed", None), "c": ("error", None)}
    runs = lifecycle.open_run(spark, "r1", "p", "process", "t0").unionByName(lifecycle.open_run(spark, "r2", "p", "scan", "t0"))
    done = lifecycle.close_run(runs, spark.createDataFrame([("r1", 0, 2)], "runId string, analyses long, error_batches long"), "t1")
    assert {r.runId: (r.phase, r.completedAt) for r in done.collect()} == {"r1": ("error", "t1"), "r2": ("running", None)}
    assert lifecycle.new_run_id() < lifecycle.new_run_id(pd.Timestamp("2999-01-01").to_pydatetime())


def test_commands_without_data(capsys):
    assert jobs.main(["rules"]) == 0 and "py-shell-call" in capsys.readouterr().out
    assert jobs.main(["lint"]) == 0


def test_classes(spark):
    rows = spark.createDataFrame([("SQL hole", ""), ("x", "an open Redirect"), ("y", None)], "t string, d string")
    assert [r[0] for r in rows.select(lifecycle.finding_class(F.col("t"), F.col("d"))).collect()] == ["injection", "redirect", "other"]


def test_scan_process_enrich_export(spark, tmp_path, capsys):
    import json
    import re
    import subprocess

    root, data = tmp_path / "p", tmp_path / "data"
    root.mkdir()
    (root / "a.py").write_text("import os\neval(x)\n")
    (root / "b.py").write_text("x = 1\n")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=N", "-c", "user.email=n@a.example", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "a.py")
    git("commit", "-qm", "first")
    finding = {"severity": "HIGH", "vulnSlug": "py-eval-call", "title": "Eval", "description": "d", "lineNumbers": [2], "confidence": "high"}
    (tmp_path / "r.jsonl").write_text(json.dumps({"batchPaths": ["a.py"], "output": {"results": [{"filePath": "a.py", "findings": [finding, finding | {"title": "Far", "lineNumbers": [99]}]}]}}) + "\n")
    assert jobs.main(["scan", str(root), str(data)]) == 0 and jobs.main(["scan", str(root), str(data)]) == 0
    assert re.findall(r"^\|\s*\d+\|\s*\d+\|\s*(\d+)\|$", capsys.readouterr().out, re.M) == ["0", "2"]
    assert jobs.main(["process", str(data), str(root), str(tmp_path / "r.jsonl")]) == 0
    assert jobs.main(["enrich", str(data), str(root)]) == 0
    got = {r.filePath: r for r in jobs.read(spark, str(data)).collect()}
    assert got["a.py"].status == "analyzed" and [f.title for f in got["a.py"].findings] == ["Eval"] and got["a.py"].analysisHistory[0].findingCount == 1
    assert got["a.py"].gitInfo.recentCommitters[0].email == "n@a.example" and got["b.py"].gitInfo is None and got["b.py"].status == "pending" and got["b.py"].projectId == "p"
    assert jobs.main(["scan", str(root), str(data)]) == 0
    assert jobs.main(["export", str(data), str(tmp_path / "out"), "--min-severity", "HIGH", "--slug", "py-eval-call"]) == 0
    assert [json.loads(r.value)["finding"]["title"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["Eval"]
    assert jobs.main(["export", str(data), str(tmp_path / "none"), "--prefix", "b"]) == 0 and spark.read.text(str(tmp_path / "none")).count() == 0


def test_blame_of_a_folder(spark, tmp_path):
    from gritstone.sources import git

    out = git.blames(spark.createDataFrame([("a.py", 1)], "path string, line int"), str(tmp_path))
    assert out.select(git.blame_text(F.col("path"), F.col("line"), F.col("output"))).first()[0] == "a.py:1: no blame data"


SECRET = "hunter2hunter2"


def test_no_command_writes_a_secret(spark, tmp_path, capsys):
    """What agents and scans wrote, in every text of a record, through process, second look, triage, report and export."""
    import json

    root, data, said = tmp_path / "p", tmp_path / "data", f"password = {SECRET}"
    root.mkdir()
    (root / "a.py").write_text(f'{said}\neval("{said}")\n')
    finding = {"severity": "HIGH", "vulnSlug": "py-eval-call", "title": f"Eval {said}", "description": said, "recommendation": said, "lineNumbers": [2], "confidence": "high"}
    (tmp_path / "r.jsonl").write_text(json.dumps({"batchPaths": ["a.py"], "output": {"results": [{"filePath": "a.py", "findings": [finding]}]}}) + "\n")
    answers = [{"filePath": "a.py", "index": 0, "verdict": "uncertain", "reasoning": "first"}, {"filePath": "a.py", "index": 0, "verdict": "true-positive", "reasoning": said, "adjustedSeverity": "CRITICAL"}, {"filePath": "a.py", "index": 7, "verdict": "fixed"}]
    (tmp_path / "v.jsonl").write_text("".join(json.dumps(x) + "\n" for x in answers))
    (tmp_path / "t.jsonl").write_text(json.dumps({"filePath": "a.py", "index": 0, "priority": "P1", "reasoning": said}) + "\n")
    assert jobs.main(["scan", str(root), str(data)]) == 0
    assert jobs.main(["process", str(data), str(root), str(tmp_path / "r.jsonl")]) == 0
    assert jobs.main(["revalidate", str(data), str(tmp_path / "v.jsonl")]) == 0 and jobs.main(["triage", str(data), str(tmp_path / "t.jsonl")]) == 0
    f = jobs.read(spark, str(data)).first().findings[0]
    assert f.revalidation.verdict == "true-positive" and f.revalidation.adjustedSeverity == "CRITICAL" and f.triage.priority == "P1" and "[REDACTED]" in f.triage.reasoning
    # a later second look changes nothing unless forced
    (tmp_path / "w.jsonl").write_text(json.dumps(answers[0]) + "\n")
    for force, verdict in (([], "true-positive"), (["--force"], "uncertain")):
        assert jobs.main(["revalidate", str(data), str(tmp_path / "w.jsonl"), *force]) == 0
        assert jobs.read(spark, str(data)).first().findings[0].revalidation.verdict == verdict
    for kind in ("markdown", "csv", "json", "sarif", "html"):
        assert jobs.main(["report", str(data), str(tmp_path / f"out-{kind}"), "--format", kind]) == 0
    assert jobs.main(["export", str(data), str(tmp_path / "out-export")]) == 0
    spark.read.parquet(jobs.versions(spark, f"{data}/records")[-1]).write.json(str(tmp_path / "out-records"))
    spark.read.parquet(jobs.versions(spark, f"{data}/scan")[-1]).write.json(str(tmp_path / "out-scan"))
    written = [p for p in tmp_path.rglob("*") if p.is_file() and p.relative_to(tmp_path).parts[0].startswith("out-")]
    assert len(written) > 5 and not [p for p in written if SECRET in p.read_text(errors="replace")] and SECRET not in capsys.readouterr().out
    # records of older versions hold secrets everywhere; they are clean as they are read
    (data / "files").mkdir()
    old = {"filePath": "o.py", "projectId": "p", "candidates": [{"vulnSlug": "s", "snippet": said, "matchedPattern": said}], "findings": [finding | {"triage": {"reasoning": said}, "revalidation": {"reasoning": said}}], "analysisHistory": [{"codexStderr": said, "refusal": {"reason": said, "raw": said, "skipped": [{"reason": said}]}}]}
    (data / "files" / "o.json").write_text(json.dumps(old))
    from gritstone.sources import tables

    assert SECRET not in tables.read_records(spark, str(data / "files")).toJSON().first()


def test_versions_of_a_table(spark, tmp_path):
    at = str(tmp_path / "t")
    assert jobs.newest(spark, at) is None
    for n in range(3):
        have = jobs.newest(spark, at)
        jobs.replace(spark.range(n) if have is None else have.union(spark.range(n)), at)
    (tmp_path / "t" / "v-000000000099").mkdir()  # a version without its mark
    assert len(jobs.versions(spark, at)) == 2 and sorted(r.id for r in jobs.newest(spark, at).collect()) == [0, 0, 1]
    jobs.replace(spark.range(1), at)
    assert jobs.versions(spark, at)[-1].endswith("v-000000000100") and jobs.newest(spark, at).count() == 1
