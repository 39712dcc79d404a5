"""Policies, budgets, cost deltas between snapshots, and the gates built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK, ERROR, OVER_BUDGET, POLICY, API = 0, 1, 2, 3, 4


def work_list(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest prompts, then given files, in order and with repeats: path, model, place, origin."""
    a = manifest.select("path", "model", "place", F.lit(0).alias("origin"))
    return a.unionByName(files.select("path", "model", "place", F.lit(1).alias("origin")))


def violations(used: DataFrame, allowed: list[str] | None) -> DataFrame:
    """Rows of used (model, ...) whose model isn't on the list; without a list there is none."""
    return used.where(F.lit(False)) if allowed is None else used.where(~F.col("model").isin(allowed) if allowed else F.lit(True))


def budget(total: Column, limit: float | None) -> Column:
    """struct(total, percent, over): over means strictly above the limit."""
    if limit is None:
        return F.struct(total.alias("total"), F.lit(None).cast("double").alias("percent"), F.lit(False).alias("over"))
    percent = total / limit * 100 if limit else F.lit(None).cast("double")
    return F.struct(total.alias("total"), percent.alias("percent"), (total > limit).alias("over"))


def check(rows: DataFrame, allowed: list[str] | None, limit: float | None) -> DataFrame:
    """One row of checked prompts (model, cost): prompts, total, percent, exit_code (policy before budget)."""
    bad = F.lit(False) if allowed is None else ~F.col("model").isin(allowed)
    sums = rows.agg(F.count("*").alias("prompts"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total"), F.coalesce(F.max(bad.cast("int")), F.lit(0)).alias("bad"))
    out = sums.withColumn("b", budget(F.col("total"), limit))
    return out.select("prompts", "total", F.col("b.percent").alias("percent"), F.when(F.col("bad") == 1, POLICY).when(F.col("b.over"), OVER_BUDGET).otherwise(OK).alias("exit_code"))


def last_by_path(rows: DataFrame, place: str = "place", first: bool = False) -> DataFrame:
    """One row a path: the last by place, or the first."""
    pick = F.min_by if first else F.max_by  # rows of a path are combined before they are shuffled
    return rows.groupBy("path").agg(pick(F.struct(*rows.columns), place).alias("__row")).select("__row.*")


def deltas(base: DataFrame, head: DataFrame) -> DataFrame:
    """Cost changes between snapshots (path, resource_id, cost in pico-dollars, null where there is none).

    Columns: resource_id, path, base_cost, head_cost, delta, status, priority.
    """
    a = base.select("path", F.col("resource_id").alias("__a"), F.col("cost").cast("decimal(38,0)").alias("base_cost"), F.lit(True).alias("__in_a"))
    b = head.select("path", F.col("resource_id").alias("__b"), F.col("cost").cast("decimal(38,0)").alias("head_cost"), F.lit(True).alias("__in_b"))
    both = a.join(b, "path", "full_outer")
    zero = F.lit(0).cast("decimal(38,0)")
    delta = (F.coalesce("head_cost", zero) - F.coalesce("base_cost", zero)).cast("decimal(38,0)")
    status = F.when(F.col("base_cost").isNull() & F.col("head_cost").isNotNull(), "added").when(F.col("head_cost").isNull() & F.col("base_cost").isNotNull(), "removed").when(delta > 0, "increased").when(delta < 0, "decreased").otherwise("unchanged")
    priority = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("status"))
    return both.select(F.coalesce("__b", "__a").alias("resource_id"), "path", "base_cost", "head_cost", delta.alias("delta"), status.alias("status")).withColumn("priority", priority.cast("int"))


# Fixed order of statuses in reports.
PRIORITY = ["increased", "added", "decreased", "removed", "unchanged"]


def ordered(changes: DataFrame) -> DataFrame:
    """Changes by status, size of the change, resource and path."""
    return changes.orderBy("priority", F.abs("delta").desc(), "resource_id", "path")


def gate(total: Column, limit: float | None, delta: Column, fail_on_increase: bool) -> Column:
    """Exit code of the CI gate."""
    over = total > limit if limit is not None else F.lit(False)
    up = delta > 0 if fail_on_increase else F.lit(False)
    return F.when(over | up, OVER_BUDGET).otherwise(OK)


def wants_comment(delta: Column, threshold: float | None) -> Column:
    return F.lit(True) if threshold is None else F.abs(delta) >= threshold


def sticky_comment(comments: DataFrame, marker: str) -> DataFrame:
    """The one comment (id, body) to update: the last that holds the marker; no row means a new one is to be made."""
    return comments.where(F.col("body").contains(marker)).agg(F.max("id").alias("id")).where("id IS NOT NULL")


COMMENT_PAGES, PAGE_SIZE = 10, 100


def comment_action(comments: DataFrame, marker: str) -> DataFrame:
    """One row action (create or update), id: of the first ten pages of comments (id, body), in order of id, the last with the marker is updated."""
    seen = comments.orderBy("id").limit(COMMENT_PAGES * PAGE_SIZE)
    last = seen.where(F.col("body").contains(marker)).agg(F.max("id").alias("id"))
    return last.select(F.when(F.col("id").isNull(), "create").otherwise("update").alias("action"), "id")


def changes_table(changes: DataFrame, style: str = "table", most: int = 10_000) -> str:
    """The ordered changes as text table, json or markdown, for a person to read; more than `most` rows are refused."""
    rows = ordered(changes).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many changes to print")
    if style == "json":
        import json

        keys = ("resource_id", "path", "base_cost", "head_cost", "delta", "status")
        return json.dumps([{k: int(r[k]) if k in keys[2:5] and r[k] is not None else r[k] for k in keys} for r in rows])
    usd = lambda x: "-" if x is None else f"{int(x) / 1e12:.6f}"
    cells = [("Resource", "Status", "Base", "Head", "Delta")] + [(r["resource_id"], r["status"], usd(r["base_cost"]), usd(r["head_cost"]), usd(r["delta"])) for r in rows]
    if style == "markdown":
        lines = ["| " + " | ".join(c) + " |" for c in cells]
        return "\n".join([lines[0], "|" + " --- |" * 5, *lines[1:]])
    widths = [max(len(c[k]) for c in cells) for k in range(5)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(c, widths)).rstrip() for c in cells)


def pull_request_comment(total: float, limit: float | None, marker: str) -> str:
    state = "none" if limit is None else f"${limit:.2f} ({total / limit * 100:.1f} %)" if limit else "$0.00"
    return f"{marker}\n| Cost | Budget |\n| --- | --- |\n| ${total:.6f} | {state} |"
