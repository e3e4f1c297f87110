"""Gates stated once: features of a text by pattern, and ordered rules over them, for Spark and for a second engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import textfn as X
from corpusloom.operators import rules
from corpusloom.plans.registry import query

Source = Callable[[SparkSession, str], DataFrame]


def bounded(words: str) -> str:
    """A pattern that holds where one of ``words`` (alternatives) stands by itself, in any case."""
    return f"(?i)(^|[^\\p{{L}}\\p{{N}}_])({words})([^\\p{{L}}\\p{{N}}_]|\\z)"


def text_sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@dataclass(frozen=True)
class Gate:
    """``features``: name -> (kind, argument); ``rules``: (reason, condition over features).

    Kinds: ``has`` and ``count`` take a pattern, ``letters`` nothing (the share of letters), ``sql`` an expression over the
    row's columns that both engines read alike.  ``t`` is the text and ``n`` its length.  The first rule that holds gives
    the reason; with ``every``, all that hold, joined by commas.
    """

    features: dict[str, tuple[str, str]]
    rules: list[tuple[str, str]]
    every: bool = False
    keep: tuple[str, ...] = ("doc_id",)
    extra: tuple[str, ...] = field(default=())

    def columns(self) -> list[Column]:
        t, out = F.col("t"), [F.length("t").alias("n")]
        for name, (kind, arg) in self.features.items():
            made = {
                "has": lambda a: F.regexp_like(t, F.lit(a)),
                "count": lambda a: X.count_of(t, a),
                "letters": lambda a: X.alpha_count(t) / F.greatest(F.lit(1), F.length(t)),
                "sql": F.expr,
            }[kind](arg)
            out.append(made.alias(name))
        return out

    def judge(self, df: DataFrame) -> DataFrame:
        """``df`` has ``t`` and what ``keep`` and the expressions name."""
        kept = [*self.keep, *self.extra]
        found = df.select(*kept, *self.columns())
        named = [(name, F.expr(cond)) for name, cond in self.rules]
        reason = F.array_join(rules.all_reasons(named), ",") if self.every else rules.first_reason(named)
        return found.select(*kept, reason.alias("reason"))

    def sql(self, source: str) -> str:
        made = ["length(t) AS n"]
        for name, (kind, arg) in self.features.items():
            made.append(
                {
                    "has": lambda a: f"regexp_matches(t, {text_sql(a)})",
                    "count": lambda a: f"len(regexp_extract_all(t, {text_sql(a)}))",
                    "letters": lambda a: "len(regexp_extract_all(t, '\\p{L}'))::DOUBLE / greatest(1, length(t))",
                    "sql": lambda a: a,
                }[kind](arg)
                + f" AS {name}"
            )
        kept = ", ".join([*self.keep, *self.extra])
        if self.every:
            reason = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in self.rules) + "], lambda x: x IS NOT NULL), ',')"
        else:
            reason = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in self.rules) + " END"
        return f"SELECT {kept}, {reason} AS reason FROM (SELECT {kept}, {', '.join(made)} FROM ({source}))"

    def register(self, name: str, source: Source, sql: str, doc: str) -> None:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return self.judge(source(spark, sf_dir))

        run.__name__, run.__doc__ = name, doc
        query(self.sql(sql), name=name)(run)
