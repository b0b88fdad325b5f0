"""Loops of several turns against a plain loop, grid runs that are killed and resumed, and their command line."""

import json

import pytest
from pyspark.sql import functions as F

from spanmill.operators import grid, rounds, runner
from spanmill.plans.run_queries import TOOLS, found_by_length, obedient

LIST, VIEW, ANALYZE, ANSWER, PLAIN = "[TOOL_CALL: list_skills]", "[TOOL_CALL: view_skill pii-detection]", "[TOOL_CALL: analyze_pii]", '```json\n[{"type": "PERSON", "text": "J", "start": 0, "end": 4}]\n```', "I am thinking about it"
KINDS = {LIST: "list_skills", VIEW: "view_skill", ANALYZE: "analyze_pii"}
SCRIPTS = [
    [LIST, VIEW, ANALYZE, ANSWER, PLAIN], [ANSWER, ANALYZE, ANSWER, PLAIN, PLAIN], [PLAIN] * 5, [LIST] * 5, [VIEW] * 5, [ANALYZE] * 5,
    [PLAIN, PLAIN, PLAIN, PLAIN, ANSWER], [ANALYZE, PLAIN, PLAIN, PLAIN, PLAIN], [ANSWER] * 5, [PLAIN, LIST, VIEW, PLAIN, ANALYZE],
]


def by_scripts(seconds=None):
    def make(model):
        scripts = SCRIPTS

        def answer(rows):
            out = []
            for r in rows:
                said = scripts[r["id"] % len(scripts)][min(r["__calls"] - 1, 4)]
                out.append(runner.Reply(said, seconds) if seconds else said)
            return out

        answer.takes_rows = True
        return answer

    return make


def samples(spark, n=20, **more):
    df = spark.createDataFrame([(i, "x" * i, f"Find {i}") for i in range(n)], "id int, text string, prompt string").withColumn("model", F.lit("m"))
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def plain_discovery(script, body, prompt, limit=None, each=0.0, max_turns=5):
    """The loop for one conversation, with clauses of its own: what is said, counted and found."""
    history, flags, spent, calls = [("user", prompt)], set(), 0.0, 0
    ask = lambda need, words: words if need else None
    for turn in range(1, max_turns + 1):
        if limit and spent > limit:
            return [], history, flags, turn, "timeout", calls
        said, spent, calls = script[min(calls, 4)], spent + each, calls + 1
        history.append(("assistant", said))
        if limit and spent > limit:
            return [], history, flags, turn, "timeout", calls
        tool = KINDS.get(said)
        if tool:
            flags.add(tool)
            history.append(("system", TOOLS.said(tool, TOOLS.run(tool, "pii-detection", body))))
            found = found_by_length(body)["detections"] if tool == "analyze_pii" else []
            if turn < max_turns:
                continue
        else:
            found = json.loads(said.split("\n")[1]) if said is ANSWER else []
            if turn < max_turns:
                if found and "analyze_pii" in flags:
                    return found, history, flags, turn, "", calls
                words = ask(found and "analyze_pii" not in flags, rounds.NUDGE_FIRST_CALL) or ask("list_skills" not in flags, f"Reply with exactly: {LIST}") or ask("view_skill" not in flags, f"Reply with exactly: {VIEW}") or ask("analyze_pii" not in flags, f"Reply with exactly: {ANALYZE}") or rounds.NUDGE_FINAL
                history.append(("system", words))
                continue
        if not found:
            found = found_by_length(body)["detections"]
            flags |= {"analyze_pii"} if found else set()
        return found, history, flags, turn, "", calls


@pytest.mark.parametrize("limit,each", [(None, None), (2.5, 1.0)])
def test_discovery_equals_a_plain_loop(spark, limit, each):
    own = samples(spark)
    out = rounds.discover(own, by_scripts(each), TOOLS, max_seconds=limit)
    assert out.columns == [*own.columns, *rounds.RESULT]
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == 20
    for i, r in got.items():
        found, history, flags, turns, error, calls = plain_discovery(SCRIPTS[i % len(SCRIPTS)], "x" * i, f"Find {i}", limit, each or 0.0)
        assert (len(r["preds"]), r["conversation_turns"], r["error"], r["model_calls"]) == (len(found), turns, error, calls), i
        assert (r["tool_executed"], r["skill_viewed"]) == ("analyze_pii" in flags, "view_skill" in flags), i
        assert r["raw_response"] == "\n\n".join(f"[{who}]\n{said}" for who, said in history), i
        assert [p["type"] for p in r["preds"]] == [p["type"] for p in found]


def test_time_is_looked_at_before_a_response(spark):
    def slow(text):
        import time

        time.sleep(0.3)
        return {"detections": []}

    tools = rounds.SkillTools(tools=runner.Tools(analyze_pii=slow))
    make = lambda model: lambda prompts: [runner.Reply("[TOOL_CALL: analyze_pii]", 0.0)] * len(prompts)
    out = rounds.discover(samples(spark, 1), make, tools, max_seconds=0.2).head()
    assert (out["error"], out["conversation_turns"], out["model_calls"], out["preds"], out["tool_executed"]) == ("timeout", 2, 1, [], True)
    fine = rounds.discover(samples(spark, 1), make, tools, max_turns=2).head()
    assert (fine["error"], fine["conversation_turns"], fine["model_calls"]) == ("", 2, 2)


def test_failures_end_one_conversation(spark):
    def make(model):
        def answer(prompts):
            if any("3" in p for p in prompts):
                raise ValueError("refused")
            return [None if "5" in p else '[{"type": "PERSON"}]' for p in prompts]

        return answer

    for loop in (rounds.discover, rounds.ask_tool):
        got = {r["id"]: r for r in loop(samples(spark, 8), make, rounds.SkillTools()).collect()}
        assert {i: r["error"] for i, r in got.items() if r["error"]} == {3: "refused", 5: "no response"}
        assert got[3]["raw_response"] is None and got[3]["preds"] == [] and len(got[1]["preds"]) == 1
    empty = rounds.discover(samples(spark, 1).limit(0), make, TOOLS)
    assert empty.collect() == [] and rounds.converse(samples(spark, 1, condition="with_tools").limit(0), make, TOOLS).collect() == []


def test_direct_loop_uses_the_tools_result(spark):
    def make(model):
        return lambda prompts: ["[TOOL_CALL: analyze_pii]" if p.startswith("Find") else "nothing" if "x" * 4 in p else '[{"type": "EMAIL"}]' for p in prompts]

    got = {r["id"]: r for r in rounds.ask_tool(samples(spark, 6), make, TOOLS).collect()}
    assert all(r["tool_executed"] and r["conversation_turns"] == 2 for r in got.values())
    assert [p["type"] for p in got[2]["preds"]] == ["EMAIL"] and [p["type"] for p in got[5]["preds"]] == ["URL"] * 2
    assert got[2]["raw_response"] == '[Turn 1]\n[TOOL_CALL: analyze_pii]\n\n[Turn 2]\n[{"type": "EMAIL"}]'
    without = rounds.ask_tool(samples(spark, 2), make, rounds.SkillTools()).collect()
    assert not any(r["tool_executed"] or r["preds"] for r in without) and {r["model_calls"] for r in without} == {1}


def test_skill_tools():
    tools = rounds.SkillTools({"b": "text of b", "a": "A"}, runner.Tools(analyze_pii=found_by_length))
    assert tools.run("list_skills") == {"tool": "list_skills", "result": ["a", "b"], "message": "Available skills: a, b"}
    assert tools.run("view_skill", "b")["content"] == "text of b" and tools.run("view_skill", "pii-detection")["content"] == rounds.NO_SKILL_TEXT
    assert tools.run("view_skill", "c")["error"] == "Skill 'c' not found. Available: a, b"
    assert tools.run("analyze_pii")["error"] == rounds.NO_TEXT and rounds.SkillTools().run("analyze_pii", body="x")["error"] == rounds.NO_TOOL
    assert tools.run("other") == {"error": "Unknown tool: other"}
    assert tools.told("view_skill", {"skill_name": "b"}, "", ["analyze_pii"]) == "TOOL_ERROR: unknown tool 'view_skill'"
    assert tools.told("list_skills", {"x": 1}, "", ["list_skills"]).startswith("TOOL_ERROR(TypeError)")
    broken = rounds.SkillTools(tools=runner.Tools(analyze_pii=lambda text: 1 / 0))
    assert "division" in broken.told("analyze_pii", {}, "x", ["analyze_pii"]) and len(json.loads(tools.told("analyze_pii", {"text": "xx"}, "", ["analyze_pii"]))["detections"]) == 2


def test_agent_by_condition_and_native_messages(spark):
    def make(model):
        def answer(prompts):
            if model == "native":  # sees all messages
                seen = [json.loads(p) for p in prompts]
                assert all(m[0]["role"] == "system" and m[1]["role"] == "user" for m in seen)
                return ['[{"type": "A"}]' if any(x["role"] == "tool" for x in m) else "both [TOOL_CALL: list_skills] and\n[TOOL_CALL: analyze_pii]\nrest" for m in seen]
            return obedient(model)(["Agent: " + p if p.startswith("Find") else p for p in prompts])

        return answer

    base = samples(spark, 4).drop("model")
    grid_rows = base.withColumn("condition", F.explode(F.array(*map(F.lit, ["zero_shot", "with_tools", "with_skills"])))).withColumn("model", F.explode(F.array(F.lit("native"), F.lit("flat"))))
    got = {(r["model"], r["condition"]): r for r in rounds.converse(grid_rows, make, TOOLS, native=("native",)).filter("id = 1").collect()}
    flags = {k: (r["conversation_turns"], r["tool_executed"], r["skill_viewed"], len(r["preds"])) for k, r in got.items()}
    assert flags["native", "with_skills"] == (2, True, False, 1) and flags["native", "with_tools"] == (2, True, False, 1)
    assert flags["native", "zero_shot"] == (1, False, False, 0) and got["native", "zero_shot"]["raw_response"].endswith("rest")
    assert flags["flat", "with_skills"] == (4, True, True, 2)
    # with_tools offers no list_skills: its call is an error message, and the follow-up asks on
    assert flags["flat", "with_tools"] == (4, True, False, 2)
    assert rounds.agent_system("with_skills", " s ", ["d"]) == rounds.AGENT_SYSTEM + rounds.SKILL_BLOCK.format("s") + rounds.DOCS_BLOCK.format("d") and rounds.agent_system("zero_shot", "s", ["d"]) == rounds.AGENT_SYSTEM


# ---- grids ----

KIND = "id int, text string, source string, gold array<struct<type:string,text:string,start:int,stop:int>>"


def cards(spark, n=6):
    return spark.createDataFrame([(i, "y" * i, "s", []) for i in range(n)], KIND)


def shown(df):
    return sorted(map(str, df.drop("work", "elapsed").select("id", "model", "condition", "preds", "raw_response", "error", "tool", "turns").collect()))


CONFIG = runner.Config(["m0", "m1"], {"zero_shot": "{text}", "with_skills": "Agent: {text}", "cot": "Think. {text}"})


class Stop(RuntimeError):
    pass


def test_a_killed_grid_resumes(spark, tmp_path):
    whole = shown(grid.Grid(CONFIG, obedient, str(tmp_path / "whole"), TOOLS).run(cards(spark)))
    own, done = grid.Grid(CONFIG, obedient, str(tmp_path / "own"), TOOLS), []

    def stop(model, condition):
        done.append((model, condition))
        if len(done) == 2:
            raise Stop

    with pytest.raises(Stop):
        own.run(cards(spark), committed=stop)
    assert len(shown(own.records(spark))) == 12
    # killed between the records and the log: the group is not visible, and is done again
    broken = own._group(cards(spark), "m0", "cot").withColumn("work", F.lit("other"))
    broken.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "condition").parquet(str(tmp_path / "own/records"))
    assert len(shown(own.records(spark))) == 12
    more = []
    assert shown(own.run(cards(spark), committed=lambda m, c: more.append((m, c)))) == whole
    assert done == [("m0", "zero_shot"), ("m0", "with_skills")] and more == [("m0", "cot"), ("m1", "zero_shot"), ("m1", "with_skills"), ("m1", "cot")]
    own.run(cards(spark).repartition(3), committed=lambda m, c: more.append(0))
    assert 0 not in more
    # a changed template is new work, other groups stay
    changed = grid.Grid(runner.Config(["m0"], {"cot": "Deeply. {text}"}), obedient, str(tmp_path / "own"), TOOLS)
    changed.run(cards(spark), committed=lambda m, c: more.append(1))
    assert more.count(1) == 1 and len(shown(changed.records(spark))) == 36
    assert {(r["model"], r["condition"]): r["n"] for r in own.summary(spark).collect()} == {(m, c): 6 for m in ("m0", "m1") for c in CONFIG.templates}


def test_grid_without_tools_and_with_a_hook(spark, tmp_path):
    bare = grid.Grid(runner.Config(["m0"], {"with_tools": "{text}"}), obedient, str(tmp_path / "bare")).run(cards(spark, 2)).collect()
    assert {r["error"] for r in bare} == {grid.NO_LOOP} and all(r["preds"] == [] for r in bare)

    def hook(model, sample, prompt, flags):
        if sample["id"] == 1:
            raise KeyError("lost")
        return {"predictions": [{"type": "URL", "start": 0, "end": 1}], "tool_executed": flags["with_tools"], "conversation_turns": 3}

    got = {r["id"]: r for r in grid.Grid(runner.Config(["m0"], {"with_tools": "{text}"}), obedient, str(tmp_path / "hook"), hook=hook).run(cards(spark, 3)).collect()}
    assert got[1]["error"] == "'lost'" and got[0]["preds"][0]["type"] == "URL" and got[2]["tool"] and got[2]["turns"] == 3


def test_command_line(spark, tmp_path):
    (tmp_path / "samples.json").write_text(json.dumps([{"id": f"s{i}", "text": f"mail a{i}@b.example", "source": "x", "ground_truth": json.dumps([{"type": "EMAIL_ADDRESS", "start": 5, "end": 17}])} for i in range(4)]))
    (tmp_path / "run.json").write_text(json.dumps({"models": ["m0", "m1"], "templates": {"zero_shot": "{text}", "cot": "T {text}"}, "batch": 2}))
    runner.main(["--samples", str(tmp_path / "samples.json"), "--out", str(tmp_path / "found"), "--predictions"])
    assert spark.read.parquet(str(tmp_path / "found")).agg(F.avg("f1")).head()[0] == 1.0 and spark.read.parquet(str(tmp_path / "found_run")).count() == 4
    args = ["--samples", str(tmp_path / "samples.json"), "--out", str(tmp_path / "grid"), "--config", str(tmp_path / "run.json"), "--make", "spanmill.plans.run_queries:obedient"]
    runner.main([*args, "--conditions", "cot", "--models", "m1", "--n", "3"])
    log = spark.read.json(str(tmp_path / "grid/log")).collect()
    assert [(r["model"], r["condition"], r["n"]) for r in log] == [("m1", "cot", 3)]
    with pytest.raises(SystemExit):
        runner.main([*args, "--conditions", "none"])


def test_a_file_of_one_row_group_is_dealt_out_before_models_are_asked(spark, tmp_path):
    """One task read it, and gave its model every prompt of a group; whole rows still come to models that take them."""
    spark.range(64).select("id", F.concat(F.lit("t"), "id").alias("text")).coalesce(1).write.parquet(str(tmp_path / "one"))
    path = tmp_path / "tasks"
    path.mkdir()

    def make(model):
        def answer(prompts):
            from pyspark import TaskContext

            (path / str(TaskContext.get().partitionId())).touch()
            return [f'[{{"type": "{p}"}}]' for p in prompts]

        return answer

    own = grid.Grid(runner.Config(["m"], {"zero_shot": "{text}"}), make, str(tmp_path / "grid"))
    out = own.run(spark.read.parquet(str(tmp_path / "one"))).select("id", "preds").collect()
    assert sorted((r["id"], r["preds"][0]["type"]) for r in out) == [(i, f"t{i}") for i in range(64)]
    assert len(list(path.iterdir())) > 1


def test_a_model_that_gives_too_few_responses_is_asked_one_by_one(spark):
    rows = spark.createDataFrame([(i, "m", f"p{i}") for i in range(7)], "id int, model string, prompt string")
    out = runner.generate(rows, lambda m: lambda prompts: prompts[:1], 3).collect()
    assert sorted((r["id"], r["raw_response"], r["error"]) for r in out) == [(i, f"p{i}", "") for i in range(7)]


def test_rounds_send_small_batches(spark):
    rows = spark.range(5000).repartition(1).selectExpr("id", "'m' AS model", "concat('p', id) AS prompt", "'t' AS text").coalesce(1)
    most = spark.sparkContext.accumulator(0)

    def step(live, number):
        def sizes(batches):
            for b in batches:
                most.add(int(b.num_rows > rounds.PIECE))
                yield b

        return live.coalesce(1).mapInArrow(sizes, live.schema).withColumn("__open", F.lit(False))

    before = spark.conf.get(rounds.BATCH, rounds.DEFAULT)
    assert rounds._rounds(rounds._start(rows), step, 2).count() == 5000
    assert most.value == 0 and spark.conf.get(rounds.BATCH, rounds.DEFAULT) == before
