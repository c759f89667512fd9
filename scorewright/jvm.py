"""All reads of JVM objects that have no public Python API (classic sessions only): parsed plans, tree nodes, distributions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _scala_list(seq) -> list:
    it, out = seq.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def plan_tables(spark: SparkSession, statement: str) -> tuple[str | None, set[str]]:
    """Target and sources of a statement by walking its parsed plan; nothing is resolved, so tables need not exist."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    sources, hidden, target = set(), set(), None

    def name(parts) -> str:
        return ".".join(_scala_list(parts)).lower()

    def walk(node, is_target: bool = False) -> None:
        nonlocal target
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            if is_target:
                target = name(node.multipartIdentifier())
            else:
                sources.add(name(node.multipartIdentifier()))
        elif kind == "UnresolvedIdentifier":
            target = name(node.nameParts())
        elif kind == "UnresolvedWith":
            for pair in _scala_list(node.cteRelations()):
                hidden.add(pair._1().lower())
                walk(pair._2())
        elif kind == "InsertIntoStatement":
            walk(node.table(), True)
            walk(node.query())
            return
        for child in _scala_list(node.children()):
            walk(child)
        for inner in _scala_list(node.subqueries()):
            walk(inner)

    walk(plan)
    return target, sources - hidden


def chi2_p(spark: SparkSession, statistic: float, dof: int) -> float:
    """P(X > statistic)."""
    return 1.0 - spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(dof)).cumulativeProbability(float(statistic))


def chi2_isf(spark: SparkSession, p: float, dof: int) -> float:
    return spark._jvm.org.apache.commons.math3.distribution.ChiSquaredDistribution(float(dof)).inverseCumulativeProbability(1.0 - p)


def t_two_sided_p(spark: SparkSession, t: float, dof: int) -> float:
    return 2.0 * (1.0 - spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(dof)).cumulativeProbability(abs(float(t))))


def tree_nodes(model) -> dict:
    """A fitted MLlib tree as nested dictionaries: feature, threshold (or categories), left, right, stats."""

    def read(node) -> dict:
        out = {"stats": list(node.impurityStats().stats()), "prediction": node.prediction()}
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            out["feature"] = split.featureIndex()
            if hasattr(split, "threshold") and split.getClass().getSimpleName() == "ContinuousSplit":
                out["threshold"] = split.threshold()
            else:
                out["categories"] = list(split.leftCategories())
            out["left"], out["right"] = read(node.leftChild()), read(node.rightChild())
        return out

    return read(model._java_obj.rootNode())
