"""Rules over the star tables, checked in one pass per table and reported together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from brisa.schemas import STAR, Table

REPORT = "tabela string, regra string, coluna string, linhas long"


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
            .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("linhas")))


def column_checks(df: DataFrame, required: Sequence[str], ranges: Mapping[str, tuple]) -> DataFrame:
    """(regra, coluna, linhas) of nulls and of values outside inclusive ranges."""
    counts, labels = [], []
    for c in required:
        labels.append(("nulos", c))
        counts.append(F.count_if(F.col(c).isNull()))
    for c, (low, high) in ranges.items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(c) < low)
        if high is not None:
            bad = bad | (F.col(c) > high)
        labels.append(("faixa", c))
        counts.append(F.count_if(F.coalesce(bad, F.lit(False))))
    one = df.agg(*[n.alias(f"n{i}") for i, n in enumerate(counts)])
    cells = F.array(*[F.struct(F.lit(rule).alias("regra"), F.lit(c).alias("coluna"),
                               F.col(f"n{i}").alias("linhas")) for i, (rule, c) in enumerate(labels)])
    return one.select(F.explode(cells).alias("r")).select("r.*")


def orphans(fact: DataFrame, dim: DataFrame, key: str = "usina_id") -> DataFrame:
    """Rows of a fact whose key is not in the dimension."""
    return fact.join(dim.select(key).distinct(), key, "left_anti")


def table_report(name: str, tables: Mapping[str, DataFrame], table: Table | None = None) -> DataFrame:
    table = table or STAR[name]
    df = tables[name]
    parts = [duplicate_keys(df, table.key).select(
        F.lit("chave").alias("regra"), F.lit(",".join(table.key)).alias("coluna"), "linhas")]
    parts.append(column_checks(df, table.required, table.ranges))
    for column, (target, target_key) in table.references.items():
        lost = orphans(df, tables[target].withColumnRenamed(target_key, column), column)
        parts.append(lost.agg(F.count(F.lit(1)).alias("linhas")).select(
            F.lit("orfao").alias("regra"), F.lit(column).alias("coluna"), "linhas"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(name).alias("tabela"), "regra", "coluna", F.col("linhas").cast("long").alias("linhas"))


def report(tables: Mapping[str, DataFrame], specs: Mapping[str, Table] | None = None) -> DataFrame:
    """Every rule of every given table: (tabela, regra, coluna, linhas)."""
    out = None
    for name in tables:
        part = table_report(name, tables, (specs or STAR)[name])
        out = part if out is None else out.unionByName(part)
    return out


def validate(tables: Mapping[str, DataFrame], specs: Mapping[str, Table] | None = None) -> None:
    """Stop with every broken rule at once."""
    broken = report(tables, specs).filter("linhas > 0").collect()
    if broken:
        lines = sorted(f"{r['tabela']}: {r['linhas']} rows break {r['regra']} ({r['coluna']})" for r in broken)
        raise ValueError("curated tables are not valid:\n  " + "\n  ".join(lines))
