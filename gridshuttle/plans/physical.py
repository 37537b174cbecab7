"""What Spark did for a DataFrame: exchanges, bytes and spills of its plan."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame


class Node(NamedTuple):
    """A physical operator and its figures."""

    name: str
    rows: int
    bytes: int
    spilled: int


def _nodes(plan) -> Iterator:
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    else:
        yield plan
        for k in range(plan.children().size()):
            yield from _nodes(plan.children().apply(k))


def _figure(plan, *names: str) -> int:
    found = plan.metrics()
    return sum(int(found.apply(n).value()) for n in names if found.contains(n))


def executed(df: DataFrame) -> list[Node]:
    """Runs ``df`` (its rows go nowhere) and returns the operators of the plan
    that ran, the last one first."""
    run = df._jdf.queryExecution()
    run.toRdd().count()
    return [Node(p.nodeName(), _figure(p, "shuffleRecordsWritten") or _figure(p, "numOutputRows"), _figure(p, "shuffleBytesWritten"), _figure(p, "spillSize")) for p in _nodes(run.executedPlan())]


def exchanges(nodes: list[Node]) -> list[Node]:
    return [n for n in nodes if n.name in ("Exchange", "ShuffleExchange")]


def described(df: DataFrame) -> str:
    """Runs ``df`` and says what it cost."""
    nodes = executed(df)
    moved = exchanges(nodes)
    lines = [f"exchanges {len(moved)}, {sum(n.bytes for n in moved)} bytes in {sum(n.rows for n in moved)} rows, spilled {sum(n.spilled for n in nodes)} bytes"]
    lines += [f"{n.name}: {n.rows} rows, {n.bytes} bytes" for n in reversed(moved)]
    python = sum(n.name in ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython") for n in nodes)
    return "\n".join([*lines, f"Python steps {python}"])
