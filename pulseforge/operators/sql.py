"""Operators written in SQL: a query over named inputs that takes DataFrames, and a plan of such operators over tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .store import checkpointed


class SqlOperator:
    """{name} in the text stands for an input. Calling the operator with DataFrames gives a lazy DataFrame."""

    def __init__(self, text: str, other: str | None = None, **defaults: object):
        """other: the same query for an engine with other function names, where rules of spelling do not suffice."""
        self.text, self.other, self.defaults = text.strip(), other and other.strip(), defaults
        self.inputs = list(dict.fromkeys(x for x in re.findall(r"\{(\w+)\}", self.text) if x not in defaults))

    def __call__(self, **inputs: DataFrame | object) -> DataFrame:
        frames = {k: v for k, v in inputs.items() if isinstance(v, DataFrame)}
        text = self.text
        for k, v in (self.defaults | {k: v for k, v in inputs.items() if k not in frames}).items():
            text = text.replace("{" + k + "}", str(v))
        return next(iter(frames.values())).sparkSession.sql(text, **frames)

    def on(self, **inputs: object) -> Plan:
        return Plan(self, {k: v for k, v in inputs.items() if k in self.inputs}, {k: v for k, v in inputs.items() if k not in self.inputs})


class Table:
    """A table of the data folder."""

    def __init__(self, name: str):
        self.name = name

    def frame(self, spark: SparkSession, sf_dir: str, made: dict) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{self.name}.parquet")


class Plan:
    """An operator with its inputs, themselves plans or tables."""

    def __init__(self, operator: SqlOperator, inputs: dict, values: dict):
        self.operator, self.inputs, self.values = operator, inputs, values

    def readers(self, found: dict[int, int]) -> dict[int, int]:
        """How many steps of the plan read each step."""
        for p in self.inputs.values():
            if isinstance(p, Plan):
                found[id(p)] = found.get(id(p), 0) + 1
                if found[id(p)] == 1:
                    p.readers(found)
        return found

    def made(self, frames: dict[str, DataFrame]) -> DataFrame:
        return self.operator(**frames, **self.values)

    def frame(self, spark: SparkSession, sf_dir: str, made: dict | None = None, readers: dict | None = None) -> DataFrame:
        """A step that three or more others read is written once (see checkpointed), as it would be computed for each, and its plan
        planned anew within theirs; the rest is lazy."""
        made, readers = {} if made is None else made, self.readers({}) if readers is None else readers
        if self not in made:  # the plan itself is the key, so that it lives as long as its table
            inputs = {k: p.frame(spark, sf_dir, made, readers) if isinstance(p, Plan) else p.frame(spark, sf_dir, made) for k, p in self.inputs.items()}
            made[self] = self.made(inputs)
        return self.written(made) if readers.get(id(self), 0) >= 3 else made[self]

    def written(self, made: dict) -> DataFrame:
        """The step's table in made, written if it was not yet."""
        if ("written", self) not in made:
            made["written", self] = made[self] = checkpointed(made[self])
        return made[self]

    def query(self) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: self.frame(spark, sf_dir)

    def sql(self) -> str:
        """The whole plan as one SQL text for DuckDB."""
        names: dict[int, str] = {}
        parts: list[str] = []

        def visit(p: Plan | Table) -> str:
            if isinstance(p, Table):
                return p.name
            if id(p) not in names:
                text = p.operator.other or spelled(p.operator.text)
                for k, v in (p.operator.defaults | p.values).items():
                    text = text.replace("{" + k + "}", str(v))
                for k, x in p.inputs.items():
                    text = text.replace("{" + k + "}", visit(x))
                names[id(p)] = f"q{len(names)}"
                parts.append(f"{names[id(p)]} AS MATERIALIZED ({text})")
            return names[id(p)]

        last = visit(self)
        return f"WITH {', '.join(parts)} SELECT * FROM {last}"


#: Functions and operators that DuckDB spells otherwise.
SPELLING = [
    (r"\bdiv\b", "//"),
    (r"\bpercentile\(", "quantile_cont("),
    (r"\bbround\(", "round_even("),
    (r"\bexplode\(sequence\(", "unnest(generate_series("),
    (r"\bexplode\(array\(([^()]*)\)\)", r"unnest([\1])"),
    (r"\bjoined_set\(([^()]*)\)", r"array_to_string(list_sort(list(DISTINCT \1)), ', ')"),
    (r"\bmillis\((\w+)\)", r"(epoch_us(\1) // 1000)"),
    (r"\bprop\((\w+)\)", r"CAST(json_extract_string(\1, '$.k') AS BIGINT)"),
    (r"\bas string\)", "as varchar)"),
]
SPARK_SPELLING = [
    (r"\bjoined_set\(([^()]*)\)", r"array_join(array_sort(collect_set(\1)), ', ')"),
    (r"\bmillis\((\w+)\)", r"(unix_micros(cast(\1 as timestamp)) div 1000)"),
    (r"\bprop\((\w+)\)", r"cast(get_json_object(\1, '$.k') as bigint)"),
]


def spelled(text: str, rules: list[tuple[str, str]] = SPELLING) -> str:
    for pattern, to in rules:
        text = re.sub(pattern, to, text)
    return text


def operator(text: str, other: str | None = None, **defaults: object) -> SqlOperator:
    made = SqlOperator(spelled(text, SPARK_SPELLING), other, **defaults)
    made.other = other and other.strip() or spelled(text.strip())
    return made
