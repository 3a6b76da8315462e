"""Reports over the catalogue and its side tables."""

from pyspark.sql import DataFrame, functions as F



def asset_count(catalogue: DataFrame) -> DataFrame:
    """Assets per project, and in total (project null)."""
    return catalogue.rollup("project").agg(F.count("*").alias("assets"))


def catalogue_metrics(catalogue: DataFrame) -> DataFrame:
    return catalogue.agg(
        F.count("*").alias("assets"), F.sum("call_count").alias("calls"),
        F.avg("reliability_score").alias("reliability"))


def health_rollup(components: DataFrame, by=()) -> DataFrame:
    """Worst status of the components: Error, then Warning, then Healthy."""
    severity = F.when(F.col("status") == "Error", 2).when(
        F.col("status") == "Warning", 1).otherwise(0)
    names = F.array(F.lit("Healthy"), F.lit("Warning"), F.lit("Error"))
    return components.groupBy(*by).agg(
        F.get(names, F.max(severity)).alias("status"), F.count("*").alias("components"))


def restore_summary(outcomes: DataFrame) -> DataFrame:
    """Successes as one count; each failure stays a row with its error text."""
    return outcomes.groupBy(
        F.when(F.col("error").isNull(), "success").otherwise("failed").alias("outcome"),
        F.when(F.col("error").isNotNull(), F.concat("name", F.lit(": "), "error")).alias("error"),
    ).agg(F.count("*").alias("assets"))


def compat_matrix(results: DataFrame, versions) -> DataFrame:
    """Latest status per system and version; N/A where there is no result."""
    status = F.when(F.max_by("status", "ts") == "Pass", "Pass").otherwise("Fail")
    latest = results.groupBy("os", "python").agg(status.alias("status"))
    wide = latest.groupBy("os").pivot("python", versions).agg(F.first("status"))
    return wide.select("os", *[
        F.coalesce(F.col(f"`{v}`"), F.lit("N/A")).alias(v) for v in versions])


def certification_rows(results: DataFrame) -> DataFrame:
    return results.withColumn(
        "label", F.when(F.col("status") == "pass", "PASS").otherwise("FAIL")
    ).orderBy("os", "node", "python", "timestamp")


def next_version(tags: DataFrame, default="v1.0.0") -> DataFrame:
    """Highest version tag per project with its last number raised by one.

    Arrays of integers compare number by number, so ``max`` is the highest
    version and aggregates before the shuffle. A tag that is no version counts
    as 0.0.0; a project without tags starts at ``default``.
    """
    numbers = F.transform(
        F.split(F.substring("tag", 2, 1 << 30), r"\."), lambda x: x.try_cast("int"))
    bad = F.exists(numbers, lambda n: n.isNull())
    zero = F.array(F.lit(0), F.lit(0), F.lit(0))
    usable = F.col("tag").startswith("v") & F.col("tag").contains(".")
    best = F.max(F.when(usable, F.when(bad, zero).otherwise(numbers)))
    last = F.element_at("_best", -1)
    raised = F.concat(F.slice("_best", F.lit(1), F.size("_best") - 1), F.array(last + 1))
    return tags.groupBy("project").agg(best.alias("_best")).select(
        "project",
        F.coalesce(
            F.concat(F.lit("v"), F.array_join(raised.cast("array<string>"), ".")),
            F.lit(default)).alias("next_version"))


def explorer_listing(catalogue: DataFrame, limit=100) -> DataFrame:
    return catalogue.orderBy(F.desc("updated_at"), "project", "name").limit(limit).select(
        "name", "project", "language",
        F.format_string("%.1f%%", F.col("reliability_score") * 100).alias("reliability"),
        F.array_join("tags", ", ").alias("tags"),
        F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))


def stabilise_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("assets"))


def tool_owners(calls: DataFrame, registry: DataFrame) -> DataFrame:
    """Owner of each called tool; null when the registry does not know it."""
    return calls.join(registry, "tool", "left")


