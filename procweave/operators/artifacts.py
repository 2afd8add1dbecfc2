"""Artifacts as rows: skill documents, decision tables, lanes, flow documents, summaries and checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from procweave.functions import fixed
from procweave.functions.text import blank, null_if_blank, or_blank, procedure_steps, safe_name, strip
from procweave.operators.graph import union_all
from procweave.operators.ordered import scan


def skill_rows(tasks: DataFrame) -> DataFrame:
    """Skill record and markdown document of every agent task."""
    t = tasks.where("task_type = 'agent'").withColumn("__inst", strip(or_blank("instruction"))).withColumn("__desc", strip(or_blank("description")))
    source = F.coalesce(null_if_blank("__inst"), F.col("__desc"))
    t = t.select("*", F.explode(F.array(procedure_steps(source))).alias("procedure"))
    purpose = F.coalesce(null_if_blank("__desc"), F.concat("name", F.lit(fixed.SKILL_PURPOSE_SUFFIX)))
    t = t.withColumn("skill_name", F.concat("name", F.lit(fixed.SKILL_SUFFIX))).withColumn("purpose", purpose).withColumn("summary", F.coalesce(null_if_blank("__desc"), "__inst"))
    numbered = F.array_join(F.transform("procedure", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    failures = "\n".join(f"- {x}" for x in fixed.SKILL_EXCEPTIONS)
    markdown = F.concat(
        F.lit("# Skill: "), "skill_name", F.lit("\n\n"), "summary", F.lit("\n\n## Purpose\n"), "purpose", F.lit("\n\n## Procedure\n"), numbered, F.lit("\n\n## Exceptions\n" + failures + "\n")
    )
    return t.select("task_id", "skill_name", "summary", "purpose", "procedure", markdown.alias("markdown"), F.concat(safe_name("name"), F.lit(".skill.md")).alias("file_name"))


def decision_rows(decisions: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules of each decision in order, one row each: (decision_id, name, rule_no, when, then, confidence)."""
    numbered = scan(rules, ["decision_id"], ["rule_id"], number="rule_no")
    return decisions.select("decision_id", "name").join(numbered.select("decision_id", "rule_no", "rule_id", "when", "then", "confidence"), "decision_id", "left")


def decision_inputs(decisions: DataFrame) -> DataFrame:
    """Distinct inputs over all decisions with their place in sorted order."""
    names = decisions.select(F.explode("input_data").alias("input")).where(~blank("input")).distinct().withColumn("all", F.lit(1))
    return scan(names, ["all"], ["input"], number="column_no").drop("all")


def decision_json(table: DataFrame) -> DataFrame:
    """Each rule row of a decision as one JSON line, ready for a text writer."""
    return table.select("decision_id", "rule_no", F.to_json(F.struct("name", "when", "then", "confidence")).alias("value"))


def lane_membership(nodes: DataFrame) -> DataFrame:
    """(proc_id, lane_no, lane, node_no, id): roles in name order, the unassigned lane last, nodes in
    list order. Input (proc_id, pos, id, role)."""
    n = nodes.withColumn("lane", F.coalesce(null_if_blank("role"), F.lit(""))).withColumn("__last", (F.col("lane") == "").cast("int"))
    lanes = scan(n.select("proc_id", "lane", "__last").distinct(), ["proc_id"], ["__last", "lane"], number="lane_no").drop("__last")
    placed = scan(n, ["proc_id", "lane"], ["pos", "id"], number="node_no")
    return placed.join(lanes, ["proc_id", "lane"]).select("proc_id", "lane_no", "lane", "node_no", "id")


def flow_document_lines(processes: DataFrame, nodes: DataFrame, seqs: DataFrame) -> DataFrame:
    """Model text of each process as ordered lines (proc_id, part, at, tie, value): process, lanes,
    nodes and flows. Lines stay rows, so a model of any size is written from many tasks."""
    esc = lambda c: F.replace(F.replace(F.replace(or_blank(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("$") else esc(p[1:]) for p in parts])
    pid = F.col("proc_id")
    head = processes.select(pid, F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("").alias("tie"), F.concat(F.lit('<process id="'), pid.cast("string"), q('" name="', "$name", '">')).alias("value"))
    tail = processes.select(pid, F.lit(9).alias("part"), F.lit(0).cast("long").alias("at"), F.lit("").alias("tie"), F.lit("</process>").alias("value"))
    lanes = lane_membership(nodes)
    lane = lanes.select(pid, F.lit(1).alias("part"), F.col("lane_no").alias("at"), F.lpad(F.col("node_no").cast("string"), 12, "0").alias("tie"), q('<lane name="', "$lane", '" node="', "$id", '"/>').alias("value"))
    kind = F.concat(F.lower(F.substring("type", 1, 1)), F.substring("type", 2, 1000))
    node = nodes.select(pid, F.lit(2).alias("part"), F.col("pos").cast("long").alias("at"), F.col("id").alias("tie"), F.concat(F.lit("<"), kind, q(' id="', "$id", '" name="', "$name", '"/>')).alias("value"))
    flow = seqs.select(
        pid, F.lit(3).alias("part"), F.col("pos").cast("long").alias("at"), F.col("id").alias("tie"),
        q('<sequenceFlow id="', "$id", '" sourceRef="', "$source", '" targetRef="', "$target", '" name="', "$condition", '"/>').alias("value"),
    )
    return union_all([head, lane, node, flow, tail])


def variables_rows(variables: DataFrame) -> DataFrame:
    """Named variables with type and default."""
    return variables.where(~blank("name")).select("proc_id", strip("name").alias("name"), F.coalesce(null_if_blank("type"), F.lit("string")).alias("type"), or_blank("default").alias("default"))


def run_summary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, n) of every entity and relation table of a run."""
    return union_all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()])


def step_timings(runs: DataFrame) -> DataFrame:
    """Share of each step in its configuration's time, and improvement of totals against the first.

    Input (config_no, config, step, seconds).
    """
    total = runs.groupBy("config_no", "config").agg(F.sum("seconds").alias("total"))
    # A global aggregate is one row, so it can always be broadcast.
    first = total.agg(F.min_by("total", "config_no").alias("__base")).withColumn("__one", F.lit(1))
    compared = total.withColumn("__one", F.lit(1)).join(F.broadcast(first), "__one").withColumn("improvement", (F.col("__base") - F.col("total")) / F.col("__base") * 100)
    return runs.join(compared.select("config_no", "total", "improvement"), "config_no").withColumn("share", F.col("seconds") / F.col("total") * 100)


def role_coverage(tasks: DataFrame, task_role: DataFrame, roles: DataFrame, threshold: float = fixed.ROLE_COVERAGE) -> DataFrame:
    """One row: tasks, tasks with a role, roles, and the two warnings."""
    with_role = tasks.select("task_id").distinct().join(task_role.select("task_id").distinct().withColumn("__r", F.lit(1)), "task_id", "left")
    counts = with_role.agg(F.count(F.lit(1)).alias("n_tasks"), F.count("__r").alias("n_with_role")).withColumn("__one", F.lit(1))
    n_roles = roles.agg(F.count(F.lit(1)).alias("n_roles")).withColumn("__one", F.lit(1))
    j = counts.join(F.broadcast(n_roles), "__one").drop("__one")
    low = (F.col("n_tasks") > 0) & (F.col("n_with_role") < F.col("n_tasks") * threshold)
    return j.withColumn("low_coverage", low).withColumn("no_roles", (F.col("n_tasks") > 0) & (F.col("n_roles") == 0))


def orphan_checks(tasks: DataFrame, task_role: DataFrame, flows: DataFrame, created_at) -> DataFrame:
    """Open questions for tasks without role or order and for gateway branches without condition."""

    def ask(rows: DataFrame, kind: str, key: str, text: str) -> DataFrame:
        return rows.select(
            F.concat_ws(":", F.lit(text), F.col(key).cast("string")).alias("amb_id"), F.lit(kind).alias("entity_type"), F.col(key).cast("string").alias("entity_id"),
            F.lit(text).alias("question"), F.lit("open").alias("status"), created_at.alias("created_at"),
        ).distinct()

    branches = flows.where("from_type = 'gateway'")
    wide = branches.groupBy("from_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(blank("condition")).alias("open")).where("n >= 2 AND open > 0")
    return union_all(
        [
            ask(tasks.join(task_role.select("task_id"), "task_id", "left_anti"), "task", "task_id", "role?"),
            ask(tasks.where(F.col("order").isNull()), "task", "task_id", "order?"),
            ask(wide, "gateway", "from_id", "condition?"),
        ]
    )


def bare_merges(mapping: DataFrame, sigs: DataFrame) -> DataFrame:
    """Merged processes that had neither tasks nor roles to compare, for review."""
    bare = sigs.where((F.size("task_tokens") == 0) & (F.size("role_tokens") == 0)).select(F.col("proc_id").alias("old_id"))
    return mapping.where("old_id <> new_id").join(bare, "old_id", "left_semi")
