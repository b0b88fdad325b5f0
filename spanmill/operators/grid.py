"""Grid runs with a commit log: models x conditions over samples, group by group; what is committed is not run again.

A group is one model and one condition. Its records replace the group's partition, by dynamic overwrite; then one line is appended to the log.
Only records whose work (a digest of template and samples) the log names are visible: a run that was killed between the two
leaves nothing half done, and the next one does the group again. Other groups stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from spanmill.operators import rounds, runner
from spanmill.sources.paths import dealt, stored

LOG = "model string, condition string, work string, n long, errors long, tool_calls long, seconds double, at timestamp"
MULTI_TURN = ("with_tools", "with_skills")
NO_LOOP = "with_skills and with_tools need tools or a hook"


class Grid:
    """run(samples) does what the log does not name yet; records() and summary() show all committed groups under the path.

    tools: what multi-turn conditions call (`rounds.SkillTools`), by the agent or, with agent=False, by the plain loops.
    hook: a callable a sample that takes the place of both (see runner.hooked()).
    """

    def __init__(
        self, config: runner.Config, make: Callable[[str], Callable[[list], list]], path: str, tools: rounds.SkillTools | None = None, hook: Callable[..., dict] | None = None,
        agent: bool = True, max_turns: int = 5, max_seconds: float | None = None,
    ):
        self.config, self.make, self.path, self.tools, self.hook, self.agent = config, make, path.rstrip("/"), tools, hook, agent
        self.max_turns, self.max_seconds = max_turns, max_seconds

    def work(self, samples: DataFrame, body: str = "text") -> dict[str, str]:
        """The digest of each condition's work: its template and what samples there are, whatever their order."""
        ident = F.xxhash64(*[F.col(f"`{c}`") for c in samples.columns if samples.schema[c].dataType.simpleString() in ("string", "bigint", "int")])
        n, a, b = samples.agg(F.count(F.lit(1)), F.bit_xor(ident), F.sum(F.pmod(ident, F.lit(1 << 31)))).head()
        return {c: hashlib.md5(f"{t}\n{n} {a} {b}".encode()).hexdigest() for c, t in self.config.templates.items()}

    def log(self, spark: SparkSession) -> DataFrame:
        """The last commit of each group."""
        try:
            lines = spark.read.schema(LOG).json(f"{self.path}/log")
        except AnalysisException:
            lines = spark.createDataFrame([], LOG)
        last = F.max_by(F.struct(*lines.columns), "at")
        return lines.groupBy("model", "condition").agg(last.alias("l")).select("l.*")

    def pending(self, spark: SparkSession, work: dict[str, str], resume: bool = True) -> DataFrame:
        """Groups of the grid, in its order (place), that the log does not name with the same work."""
        cells = [(i, m, c, work[c]) for i, (m, c) in enumerate((m, c) for m in self.config.models for c in self.config.templates)]
        grid = spark.createDataFrame(cells, "place int, model string, condition string, work string")
        return grid.join(self.log(spark), ["model", "condition", "work"], "left_anti") if resume else grid

    def _group(self, samples: DataFrame, model: str, condition: str) -> DataFrame:
        c = self.config
        asked = runner.prompts(samples, {condition: c.templates[condition]}, [model])
        if self.hook is not None:
            return runner.answered(runner.hooked(asked, self.make, self.hook))
        if condition not in MULTI_TURN:
            out = runner.answered(runner.generate(asked, self.make, c.batch))
            return out.withColumns({"tool": F.lit(False), "skill": F.lit(False), "turns": F.lit(1).cast("long")})
        if self.tools is None:
            failed = asked.withColumns({"raw_response": F.lit(None).cast("string"), "error": F.lit(NO_LOOP), "elapsed": F.lit(0.0), "tool": F.lit(False), "skill": F.lit(False), "turns": F.lit(0).cast("long")})
            return runner.answered(failed)
        if self.agent:
            out = rounds.converse(asked, self.make, self.tools, self.max_turns, c.batch)
        elif condition == "with_tools":
            out = rounds.ask_tool(asked, self.make, self.tools, c.batch)
        else:
            out = rounds.discover(asked, self.make, self.tools, self.max_turns, self.max_seconds, c.batch)
        names = {"tool_executed": "tool", "skill_viewed": "skill", "conversation_turns": "turns"}
        return out.withColumnsRenamed(names).drop("model_calls")

    def run(self, samples: DataFrame, resume: bool = True, committed: Callable[[str, str], None] | None = None) -> DataFrame:
        """records() after all pending groups are done; resume=False does the whole grid again. committed is told each group."""
        spark = samples.sparkSession
        samples = stored(dealt(samples), "samples")  # every group reads them, in many tasks
        work = self.work(samples)
        for cell in self.pending(spark, work, resume).orderBy("place").collect():  # the cells of the grid
            model, condition = cell["model"], cell["condition"]
            out = self._group(samples, model, condition).withColumn("work", F.lit(cell["work"]))
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "condition").parquet(f"{self.path}/records")
            back = spark.read.parquet(f"{self.path}/records").filter((F.col("model") == model) & (F.col("condition") == condition))
            line = back.agg(*_sums()).select(F.lit(model).alias("model"), F.lit(condition).alias("condition"), F.lit(cell["work"]).alias("work"), "n", "errors", "tool_calls", "seconds", F.current_timestamp().alias("at"))
            line.coalesce(1).write.mode("append").json(f"{self.path}/log")
            if committed:
                committed(model, condition)
        return self.records(spark)

    def records(self, spark: SparkSession) -> DataFrame:
        """The records of all committed groups."""
        return spark.read.parquet(f"{self.path}/records").join(self.log(spark).select("model", "condition", "work"), ["model", "condition", "work"], "left_semi")

    def summary(self, spark: SparkSession) -> DataFrame:
        """model, condition, n, errors, tool_calls, total_seconds, mean_seconds of each committed group, from the log alone."""
        mean = F.when(F.col("n") > 0, F.round(F.col("seconds") / F.col("n"), 1)).otherwise(0.0)
        return self.log(spark).select("model", "condition", "n", "errors", "tool_calls", F.round("seconds", 1).alias("total_seconds"), mean.alias("mean_seconds"))


def _sums() -> list:
    return [F.count(F.lit(1)).alias("n"), F.count_if(F.col("error") != "").alias("errors"), F.count_if("tool").alias("tool_calls"), F.coalesce(F.sum("elapsed"), F.lit(0.0)).alias("seconds")]
