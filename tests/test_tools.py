"""The tool loop and its tools, reply by reply."""

import pandas as pd

from gritstone.operators import tools

ROWS = pd.DataFrame({"path": ["a.py", "b.py"], "content": ["x = 1\ncall(x)\npassword = 'hunter22'\n", None]})


def run(*replies, **limits):
    left = list(replies)
    seen = []

    def ask(batch, paths, rows, turns):
        seen.append([t[:] for t in turns])
        return left.pop(0) if len(left) > 1 else left[0]

    return tools.tool_loop(ask, **limits)(1, ["a.py", "b.py"], ROWS), seen


def test_shown():
    assert tools.shown("f", "a\nb\nc\n", 2, 0) == "f:2-3\n     2  b\n     3  c\n"
    assert tools.shown("f", "a\n", -4, 9) == "f:1-1\n     1  a\n"
    assert tools.shown("f", "a\n", 2, 2) == "f: no lines in requested range\n"
    assert tools.shown("f", "", 0, 0) == "f: no lines in requested range\n"
    long = tools.shown("f", "é" * 20_000)
    assert long.endswith(tools.CUT_ANSWER + tools.CUT_SOURCE) and "hunter" not in tools.shown("a.py", ROWS["content"][0])


def test_report_ends_the_loop():
    call = {"name": "read_file", "args": {"path": "a.py", "start_line": 2, "end_line": 2}}
    bad = [{"name": "read_file", "args": {"path": "no.py"}}, {"name": "grep", "args": {"pattern": "("}}, {"name": "other", "args": {}}]
    out, seen = run({"calls": [call, *bad], "cost": 1, "tokens": 5}, {"calls": [{"name": "report_findings", "args": {"results": [{"filePath": "a.py", "findings": []}]}}], "cost": 2, "tokens": 6})
    assert out["results"] == [{"filePath": "a.py", "findings": []}] and (out["cost"], out["tokens"], out["turns"]) == (3, 11, 2)
    assert [x["error"] for x in seen[1][0]] == [False, True, True, True] and seen[1][0][0]["content"] == "a.py:2-2\n     2  call(x)\n"


def test_refusals():
    call = {"name": "find_callers", "args": {"symbol": "call"}}
    assert run({"report": {"refusal": "token=abc no"}})[0]["reason"] == "token=[REDACTED] no"
    assert run({"calls": [call], "cost": 2}, most_usd=5)[0] | {} == {"cost": 6, "tokens": 0, "turns": 3, "results": [], "refused": True, "reason": tools.COST_CAP}
    assert run({"calls": []})[0]["reason"] == tools.NO_CALL
    assert run({"calls": [], "text": "so"})[0]["reason"] == tools.TEXT_ONLY
    assert run({"calls": [call] * 9})[0]["reason"] == tools.CALL_CAP
    out, seen = run({"calls": [call]})
    assert out["reason"] == tools.TURN_CAP and out["turns"] == 8 and seen[-1][0][0]["content"] == "a.py:2: call(x)\n"


def test_batches_go_to_python_together_and_are_seen_alone(spark):
    from gritstone.operators import investigate

    rows = spark.createDataFrame([(b, f"f{b}-{i}", str(b)) for b in range(70) for i in range(3)], "batch_id long, path string, content string")
    ask = lambda batch, paths, own: {"results": [{"filePath": paths[0], "findings": [{"title": "|".join(sorted(own["content"]))}]}], "cost": 3.0 * batch, "tokens": len(own)}
    out = investigate.investigate(rows, ask)
    got = {r.path: (r.batch_id, r.cost, r.tokens, [f.title for f in r.findings]) for r in out.collect()}
    assert got == {f"f{b}-{i}": (b, float(b), 1, [f"{b}|{b}|{b}"] if i == 0 else []) for b in range(70) for i in range(3)}
    assert "FLOOR" in out._jdf.queryExecution().optimizedPlan().toString().upper()
