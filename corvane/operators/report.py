"""Tables and plots over finished runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_metrics(spark: SparkSession, root: str) -> DataFrame:
    """One row for each ``metrics.json`` in a folder of runs."""
    return spark.read.json(f"{root}/*/metrics.json", multiLine=True)


def table(runs: DataFrame) -> DataFrame:
    """task, system and the metrics, risk, cost and latency columns that the runs have."""
    fields = {f.name: [x.name for x in f.dataType.fields] for f in runs.schema.fields if hasattr(f.dataType, "fields")}
    cols = [F.col(f"aggregate.`{m}`").alias(m) for m in fields.get("aggregate", [])]
    for group, names in (("risk", ("coverage", "risk", "aurc")), ("cost", ("usd",)), ("latency", ("p95",))):
        cols += [F.col(f"{group}.{n}").alias(n) for n in names if n in fields.get(group, [])]
    return runs.select("task", "system", *cols, F.col("n_failed").alias("failed")).orderBy("task", "system")


def pivoted(aggregates: DataFrame) -> DataFrame:
    """(task, system, metric, value) with a column for each metric."""
    return aggregates.groupBy("task", "system").pivot("metric").agg(F.first("value"))


def plot_risk_coverage(curves: dict[str, DataFrame], path: str) -> str:
    """A line for each system, from curves with i, coverage and risk; needs matplotlib."""
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot

    fig, ax = pyplot.subplots(figsize=(6, 4))
    for name, curve in curves.items():
        rows = curve.orderBy("i").toPandas()
        ax.plot(rows["coverage"], rows["risk"], label=name)
    ax.set(xlabel="coverage", ylabel="risk", xlim=(0, 1), ylim=(0, None))
    ax.legend()
    fig.tight_layout()
    fig.savefig(path, dpi=150)
    pyplot.close(fig)
    return path
