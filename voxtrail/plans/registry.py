"""Registered queries: a Spark plan and, where SQL can say it, an independent check.

Views over the given tables are plain SQL that both engines read, so that the
check starts from the same rows and shares nothing else with the Spark plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtrail.plans.views import TABLES, VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

# Text macros of the check SQL. tp2 is the two-sided p of Student's t for whole df
# (finite trigonometric sum), another formula than the one used in the operators.
_TH = "atan(abs({0})/sqrt({1}))"
MACROS = {
    "rnd": (1, "(round({0},6)+0.0)"),
    "h32": (1, "(('0x'||substring(md5({0}),1,8))::BIGINT)"),
    "tp2": (2, "(CASE WHEN {1}>=1 THEN greatest(0.0, 1 - CASE WHEN CAST({1} AS BIGINT) % 2 = 1 THEN "
               "2/pi()*(" + _TH + "+sin(" + _TH + ")*coalesce(list_sum(list_transform("
               "range(0, CAST(({1}-1)/2 AS BIGINT)), lambda j: exp(lgamma(j+1)-lgamma(j+1.5)+lgamma(1.5))"
               "*power(cos(" + _TH + "), 2*j+1))),0)) ELSE sin(" + _TH + ")*list_sum(list_transform("
               "range(0, CAST({1}/2 AS BIGINT)), lambda j: exp(lgamma(j+0.5)-lgamma(0.5)-lgamma(j+1))"
               "*power(cos(" + _TH + "), 2*j))) END) END)"),
}


def _split_args(body: str) -> list[str]:
    args, depth, start = [], 0, 0
    for i, ch in enumerate(body):
        depth += ch in "([" 
        depth -= ch in ")]"
        if ch == "," and depth == 0:
            args.append(body[start:i])
            start = i + 1
    return [a.strip() for a in [*args, body[start:]]]


def expand(sql: str) -> str:
    for name, (n, template) in MACROS.items():
        while (m := re.search(rf"\b{name}\(", sql)):
            depth, i = 1, m.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[i], 0)
                i += 1
            body = sql[m.end():i - 1]
            args = _split_args(body) if n > 1 else [body]
            sql = sql[:m.start()] + template.format(*args) + sql[i:]
    return sql


def _needed(sql: str, seen: list[str]) -> list[str]:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b{name}\b", sql):
            _needed(VIEWS[name], seen)
            seen.append(name)
    return seen


def with_views(sql: str, dialect: dict[str, str]) -> str:
    ctes = []
    for name in _needed(sql, []):
        text = VIEWS[name]
        for key, value in dialect.items():
            text = text.replace("{" + key + "}", value)
        ctes.append(f"{name} AS ({text})")
    head = ",\n".join(ctes)
    body = sql.strip()
    if not head:
        return body
    if re.match(r"(?i)with\s+recursive\s", body):
        return f"WITH RECURSIVE {head},\n" + re.sub(r"(?i)^with\s+recursive\s+", "", body)
    if re.match(r"(?i)with\s", body):
        return f"WITH {head},\n" + re.sub(r"(?i)^with\s+", "", body)
    return f"WITH {head}\n{body}"


CHECK_DIALECT = {
    **{t: t for t in TABLES},
    "day": "date_diff('day', DATE '2024-01-01', ts::DATE)",
    "ms": "(extract(hour from ts)*3600000 + extract(minute from ts)*60000 + extract(millisecond from ts))",
}


class Context:
    """The given tables and the views over them, for one session and folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._sources: dict[str, str] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.sql(f"SELECT * FROM {self.source(name)}")

    def source(self, name: str) -> str:
        """SQL of a given table, with NaN read as NULL in numbers and in arrays of numbers."""
        if name not in self._sources:
            path = f"parquet.`{self.sf_dir}/{name}.parquet`"
            cols = []
            for col, kind in self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").dtypes:
                if kind in ("double", "float"):
                    cols.append(f"nullif(`{col}`, {kind}('NaN')) AS `{col}`")
                elif kind in ("array<double>", "array<float>"):
                    nan = f"{kind[6:-1]}('NaN')"  # looked for first: the lambda runs on arrays that hold one only
                    cols.append(f"if(array_contains(`{col}`, {nan}), transform(`{col}`, x -> nullif(x, {nan})), `{col}`) AS `{col}`")
                else:
                    cols.append(f"`{col}`")
            self._sources[name] = f"(SELECT {', '.join(cols)} FROM {path})" if any(" AS " in x for x in cols) else path
        return self._sources[name]

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str) -> DataFrame:
        needed = text + "".join(VIEWS[v] for v in _needed(text, []))
        dialect = {
            **{t: self.source(t) for t in TABLES if "{" + t + "}" in needed},
            "day": "CAST(datediff(CAST(ts AS DATE), DATE'2024-01-01') AS BIGINT)",
            "ms": "(extract(HOUR FROM ts)*3600000 + extract(MINUTE FROM ts)*60000"
                  " + CAST(floor(extract(SECOND FROM ts)*1000) AS BIGINT))",
        }
        return self.spark.sql(with_views(text, dialect))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits (and no negative zero), as the check SQL does."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c)
                       for c, t in df.dtypes])


def query(name: str, check: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(Context(spark, sf_dir)))
        if check:
            CHECKS[name] = with_views(expand(check), CHECK_DIALECT)
        return fn
    return register
