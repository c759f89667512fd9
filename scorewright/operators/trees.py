"""Decision trees as rules: leaf paths with class counts, an ASCII drawing, and rule lists."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright import jvm

RULE_SCHEMA = "condition string, samplecnt array<double>, precision array<double>, recall array<double>"
#: One comparison of a path: feature, "<=" or ">" (or "in" / "not in"), threshold or categories.
Test = tuple[str, str, object]


def paths(tree: dict, names: list[str], max_depth: int | None = None, above: tuple[Test, ...] = ()) -> Iterator[tuple[tuple[Test, ...], list[float]]]:
    """Tests and class counts of each leaf; a subtree below max_depth counts as one leaf."""
    if "left" not in tree or (max_depth is not None and len(above) >= max_depth):
        yield above, list(tree["stats"])
        return
    name = names[tree["feature"]]
    yes, no = ((name, "<=", tree["threshold"]), (name, ">", tree["threshold"])) if "threshold" in tree else ((name, "in", tuple(tree["categories"])), (name, "not in", tuple(tree["categories"])))
    yield from paths(tree["left"], names, max_depth, (*above, yes))
    yield from paths(tree["right"], names, max_depth, (*above, no))


def condition_text(tests: tuple[Test, ...]) -> str:
    return "|".join(f"{name} {op} {value}" for name, op, value in tests)


def condition_column(tests: tuple[Test, ...]) -> Column:
    """True where all tests hold; a missing value fails. No test at all holds for every row."""
    out = F.lit(True)
    for name, op, value in tests:
        x = F.col(name)
        test = {"<=": lambda x, v: x <= v, ">": lambda x, v: x > v, "in": lambda x, v: x.isin(*v), "not in": lambda x, v: ~x.isin(*v)}[op](x, value)
        out = out & F.coalesce(test, F.lit(False))
    return out


def rules(tree: dict, names: list[str], max_depth: int | None = None) -> list[tuple[tuple[Test, ...], list[float], list[float], list[float]]]:
    """(tests, class counts, precision, recall) of each leaf; counts are weighted as the tree saw them."""
    totals = tree["stats"]
    out = []
    for tests, counts in paths(tree, names, max_depth):
        size = sum(counts)
        out.append((tests, counts, [c / size if size else 0.0 for c in counts], [c / t if t else 0.0 for c, t in zip(counts, totals, strict=True)]))
    return out


def tree_rules(spark: SparkSession, model, names: list[str], max_depth: int | None = None) -> DataFrame:
    return spark.createDataFrame([(condition_text(t), c, p, r) for t, c, p, r in rules(jvm.tree_nodes(model), names, max_depth)], RULE_SCHEMA)


def forest_rules(spark: SparkSession, model, names: list[str], max_depth: int | None = None) -> DataFrame:
    """Rules of all trees; of equal conditions the first tree's stays."""
    seen: dict[str, tuple] = {}
    for tree in model.trees:
        for t, c, p, r in rules(jvm.tree_nodes(tree), names, max_depth):
            seen.setdefault(condition_text(t), (condition_text(t), c, p, r))
    return spark.createDataFrame(list(seen.values()), RULE_SCHEMA)


def draw(tree: dict, names: list[str], max_depth: int | None = None, indent: str = "") -> str:
    """The tree as text: a test on each line, its YES branch before its NO branch, class counts at the leaves."""
    if "left" not in tree or max_depth == 0:
        return f"{indent}{[round(x, 3) for x in tree['stats']]}\n"
    test = f"<= {tree['threshold']}" if "threshold" in tree else f"in {tree['categories']}"
    deeper = None if max_depth is None else max_depth - 1
    return (
        f"{indent}{names[tree['feature']]} {test} {[round(x, 3) for x in tree['stats']]}\n{indent}|- YES\n{draw(tree['left'], names, deeper, indent + '|  ')}"
        f"{indent}|- NO\n{draw(tree['right'], names, deeper, indent + '   ')}"
    )


class RuleList:
    """Each round fits a tree, keeps its path of highest positive precision and takes that path's rows away; the last round keeps all its paths."""

    def __init__(self, max_depth: int, rounds: int, seed: int = 233) -> None:
        self.max_depth, self.rounds, self.seed = max_depth, rounds, seed
        self.rules: list[tuple[tuple[Test, ...], list[float], list[float], list[float]]] = []

    def fit(self, df: DataFrame, names: list[str], label: str) -> RuleList:
        """Rounds filter the same source by the rules so far, so lineage stays one scan and one filter deep."""
        vectors = VectorAssembler(inputCols=names, outputCol="__features", handleInvalid="skip").transform(df.select(*names, F.col(label).cast("double").alias("__label")))
        left = F.lit(True)
        for k in range(self.rounds):
            rows = vectors.filter(left)
            if rows.limit(1).count() == 0:
                break
            model = DecisionTreeClassifier(featuresCol="__features", labelCol="__label", maxDepth=self.max_depth, seed=self.seed).fit(rows)
            found = [r for r in rules(jvm.tree_nodes(model), names) if len(r[2]) > 1]
            if not found:
                break
            found.sort(key=lambda r: (-r[2][1], condition_text(r[0])))
            if k == self.rounds - 1:
                self.rules += found
                break
            self.rules.append(found[0])
            left = left & ~condition_column(found[0][0])
        return self

    def score(self) -> Column:
        """Precision vector of the first rule that holds; [-1, -1] without one."""
        default = F.array(F.lit(-1.0), F.lit(-1.0))
        return F.coalesce(*[F.when(condition_column(t), F.array(*map(F.lit, p))) for t, _, p, _ in self.rules], default)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(condition_text(t), c, p, r) for t, c, p, r in self.rules], RULE_SCHEMA)
