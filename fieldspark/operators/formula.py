"""Model formulas as column expressions: ``log(z) ~ x + sqrt(dist) + f + (1 | site)``.

The response may be any SQL expression. A term is a SQL expression; a string term becomes treatment contrasts against
its first level in order. Random effects are ``(1 | g)`` or ``(x || g)``: one indicator column for each level of g.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BAR = re.compile(r"\(([^()|]*(?:\([^()]*\)[^()|]*)*)(\|\|?)([^()]*)\)")


@dataclass(frozen=True)
class Formula:
    response: str
    terms: tuple[str, ...]
    random: tuple[tuple[str, str], ...]
    intercept: bool = True

    def __str__(self) -> str:
        return f"{self.response}~{'+'.join(self.terms) if self.terms else '1'}"


def parse(text: str) -> Formula:
    left, sep, right = text.partition("~")
    if not sep or not left.strip():
        raise ValueError("a formula is response ~ terms")
    random = []
    for inner, bars, group in _BAR.findall(right):
        inner, group = inner.strip(), group.strip()
        if "/" in group:
            raise ValueError("nested random effects are not supported")
        if bars == "|" and inner.replace(" ", "") not in ("1",):
            raise ValueError("correlated random effects are not supported; use ||")
        random.append((inner, group))
    right = _BAR.sub("", right)
    if re.search(r"(^|\+)\s*(-\s*1|0)\s*($|\+)|-\s*1", right):
        raise ValueError("a formula needs its intercept")
    terms = tuple(t for t in (x.strip() for x in _split(right)) if t and t != "1")
    return Formula(left.strip(), terms, tuple(random))


def _split(text: str) -> list[str]:
    out, depth, now = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "+" and not depth:
            out.append(now)
            now = ""
        else:
            now += ch
    return [*out, now]


def without_covariates(text: str) -> str:
    """The response, transformed as it is, on an intercept."""
    return f"{text.partition('~')[0].strip()}~1"


@dataclass(frozen=True)
class Design:
    """Column expressions of fixed effects with their names; levels of factors are fixed when the design is made."""

    names: tuple[str, ...]
    columns: tuple[str, ...]

    def array(self) -> Column:
        return F.array(*[F.expr(c).cast("double") for c in self.columns])


def design(formula: Formula, units: DataFrame) -> Design:
    """Fixed effects over units; levels of string terms are read from them (a small distinct)."""
    names, columns = ["Intercept"], ["1D"]
    kinds = units.select(*[F.expr(t).alias(f"t{i}") for i, t in enumerate(formula.terms)]).schema if formula.terms else []
    for t, field in zip(formula.terms, kinds, strict=True):
        if isinstance(field.dataType, StringType):
            levels = sorted(r[0] for r in units.select(F.expr(t)).distinct().limit(1001).collect() if r[0] is not None)
            if len(levels) > 1000:
                raise ValueError(f"{t} has more than 1000 levels; make it a random effect")
            for level in levels[1:]:
                names.append(f"{t}{level}")
                columns.append(f"CASE WHEN {t} = '{level.replace(chr(39), chr(39) * 2)}' THEN 1D ELSE 0D END")
        else:
            names.append(t)
            columns.append(f"CAST({t} AS DOUBLE)")
    return Design(tuple(names), tuple(columns))


def checked(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` where a null in any of the columns is an error at run time (missing values are not allowed)."""
    for c in columns:
        df = df.withColumn(c, F.coalesce(c, F.raise_error(F.lit(f"{c} has missing values")).cast(df.schema[c].dataType)))
    return df


def random_levels(formula: Formula, units: DataFrame) -> DataFrame:
    """(bau_id, grp, level, x): one row for each random effect of a unit."""
    out = None
    for i, (inner, group) in enumerate(formula.random):
        x = F.lit(1.0) if inner == "1" else F.expr(inner).cast("double")
        part = units.select("bau_id", F.lit(i).alias("grp"), F.col(group).cast("string").alias("level"), x.alias("x"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("the formula has no random effects")
    return out


def observed_levels(levels: DataFrame, incidence: DataFrame) -> DataFrame:
    """Levels that some observation sees; others are left out of fitting."""
    return levels.join(incidence.select("bau_id").distinct(), "bau_id", "left_semi").select("grp", "level").distinct()
