"""Imputing, scaling and encoding features as a saved Spark ML pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pandwerk.functions.scalar import nan_to_null

FEATURES = "features"


def split_kinds(df: DataFrame, features: list[str]) -> tuple[list[str], list[str]]:
    """Numeric and text features, by column type."""
    text = [f.name for f in df.schema.fields if f.name in features and f.dataType.typeName() == "string"]
    return [c for c in features if c not in text], text


def numeric_statistics(df: DataFrame, numeric: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and divisor of every numeric column from one aggregate.

    Missing values are replaced by the mean before scaling, so the variance is taken over all
    rows with the mean in the gaps; a constant column is left unscaled.
    """
    aggs = [F.count("*").alias("_n")]
    for c in numeric:
        v = nan_to_null(F.col(c).cast("double"))
        aggs += [F.avg(v).alias(f"m_{c}"), F.var_pop(v).alias(f"v_{c}"), F.count(v).alias(f"c_{c}")]
    row = df.agg(*aggs).first()
    out = {}
    for c in numeric:
        variance = (row[f"v_{c}"] or 0.0) * row[f"c_{c}"] / max(row["_n"], 1)
        out[c] = (row[f"m_{c}"] or 0.0, variance**0.5 if variance > 0 else 1.0)
    return out


def categories(df: DataFrame, text: list[str]) -> dict[str, tuple[str, list[str]]]:
    """Most frequent value (smallest on a tie) and sorted values of every text column.

    Classes are code lists, so the value sets collected here are small.
    """
    if not text:
        return {}
    row = df.agg(*[F.mode(c, True).alias(f"mode_{c}") for c in text],
                 *[F.array_sort(F.collect_set(c)).alias(f"set_{c}") for c in text]).first()
    return {c: (row[f"mode_{c}"], list(row[f"set_{c}"])) for c in text}


def _number(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def _text(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def encoded_names(text: dict[str, tuple[str, list[str]]]) -> dict[str, list[str]]:
    """Indicator columns per text feature; the first level is dropped when there are only two."""
    return {c: [f"{c}_x0_{v}" for v in (values[1:] if len(values) == 2 else values)]
            for c, (_, values) in text.items()}


def statement(keep: list[str], numeric: dict, text: dict) -> str:
    """SQL that imputes, scales and encodes; an unseen class is an error."""
    parts = [f"`{c}`" for c in keep]
    for c, (mean, divisor) in numeric.items():
        value = f"CAST(`{c}` AS DOUBLE)"
        filled = f"CASE WHEN `{c}` IS NULL OR isnan({value}) THEN {_number(mean)} ELSE {value} END"
        parts.append(f"({filled} - {_number(mean)}) / {_number(divisor)} AS `{c}`")
    for c, (mode, values) in text.items():
        filled = f"coalesce(`{c}`, {_text(mode)})"
        known = ", ".join(_text(v) for v in values)
        for name in encoded_names({c: (mode, values)})[c]:
            level = name.split("_x0_", 1)[1]
            parts.append(f"CASE WHEN {filled} IN ({known}) THEN CAST({filled} = {_text(level)} AS DOUBLE) "
                         f"ELSE raise_error(concat('unseen value in {c}: ', {filled})) END AS `{name}`")
    return f"SELECT {', '.join(parts)} FROM __THIS__"


def fit(df: DataFrame, features: list[str], keep: list[str]) -> PipelineModel:
    """Fitted preparation stages: prepared columns and their vector ``features``."""
    numeric, text = split_kinds(df, features)
    stats, classes = numeric_statistics(df, numeric), categories(df, text)
    names = numeric + [n for c in text for n in encoded_names(classes)[c]]
    return PipelineModel([SQLTransformer(statement=statement(keep, stats, classes)),
                          VectorAssembler(inputCols=names, outputCol=FEATURES)])


def fit_lists(df: DataFrame, lists: dict[str, list[str]], keep: list[str]) -> tuple[PipelineModel, dict[str, PipelineModel]]:
    """Preparation of all features of several lists together, and of each list alone, from one set of statistics."""
    union = list(dict.fromkeys(c for features in lists.values() for c in features))
    numeric, text = split_kinds(df, union)
    stats, classes = numeric_statistics(df, numeric), categories(df, text)

    def stages(features):
        own_stats = {c: stats[c] for c in numeric if c in features}
        own_classes = {c: classes[c] for c in text if c in features}
        names = [*own_stats, *[n for c in own_classes for n in encoded_names(own_classes)[c]]]
        return PipelineModel([SQLTransformer(statement=statement(keep, own_stats, own_classes)),
                              VectorAssembler(inputCols=names, outputCol=FEATURES)])

    return stages(union), {name: stages(features) for name, features in lists.items()}


# Prefix of columns that pass the preparation unchanged.
CARRIED = "_carried_"


def carrying(prep: PipelineModel, columns: list[str]) -> PipelineModel:
    """The same stages, letting ``columns`` of the input through under the prefix."""
    if not columns:
        return prep
    passed = ", ".join(f"`{c}` AS `{CARRIED}{c}`" for c in columns)
    return PipelineModel([SQLTransformer(statement=f"SELECT {passed}, {s.getStatement().removeprefix('SELECT ')}")
                          if isinstance(s, SQLTransformer) else s for s in prep.stages])


def input_names(prep: PipelineModel) -> list[str]:
    """Names of the vector positions."""
    assembler = [s for s in prep.stages if isinstance(s, VectorAssembler)][0]
    return assembler.getInputCols()
