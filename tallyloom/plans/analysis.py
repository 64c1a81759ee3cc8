"""The programming surface: one table, several tables, a corpus. Results are lazy, named DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from tallyloom.functions import columns as C
from tallyloom.functions.dates import features, same_source
from tallyloom.operators import association as A
from tallyloom.operators import facts as FA
from tallyloom.operators import multitable as M
from tallyloom.operators import profile as P
from tallyloom.operators import quality as Q
from tallyloom.operators import rules as U
from tallyloom.operators import text as X
from tallyloom.operators import timeseries as T
from tallyloom.operators.charts import chart_data
from tallyloom.sources import sinks


class Results(dict[str, Callable[[], DataFrame]]):
    """Named results; each is planned when asked for."""

    def get_frame(self, name: str) -> DataFrame:
        return self[name]()

    def frames(self) -> dict[str, DataFrame]:
        return {k: f() for k, f in self.items()}

    def to_json(self) -> str:
        return sinks.to_json(self.frames())

    def to_markdown(self) -> str:
        return sinks.to_markdown(self.frames())

    def to_html(self) -> str:
        return sinks.to_html(self.frames())


class Profile:
    """Everything about one table. types override what is inferred; `exclude` leaves a column out."""

    def __init__(self, df: DataFrame, types: dict[str, str] | None = None, mode: str = "strict", date_level: str = "basic", key: list[str] | None = None, as_of: str = "1970-01-01", clean: bool = False):
        raw = Q.prescreen(C.tidy(df))
        if clean:
            raw = Q.auto_clean(raw, key or raw.columns)
        found = FA.types_of(raw, mode) | (types or {})
        self.df = raw.drop(*[c for c, t in found.items() if t == "exclude" or c.startswith("_")])
        self.types = {c: t for c, t in found.items() if c in self.df.columns}
        self.as_of, self.key = as_of, key or self.of("identifier")[:1] or self.df.columns[:1]
        self.wide = self.df
        for c in self.of("datetime"):
            self.wide = features(self.wide, c, date_level)

    def of(self, *kinds: str) -> list[str]:
        return [c for c, t in self.types.items() if t in kinds]

    def run(self) -> Results:
        cont, cats, times, df = self.of("continuous"), self.of("categorical", "categorical_numeric"), self.of("datetime"), self.df
        out = Results(profile=lambda: P.profile(df), missing=lambda: Q.missing(df), duplicates=lambda: Q.duplicates(df), facts=lambda: FA.facts(df, self.types), scenarios=lambda: FA.scenarios(FA.facts(df, self.types)))
        out["score"] = lambda: Q.score(df, cont, times[0] if times else None, self.as_of)
        if cont:
            out |= {"summary": lambda: P.summary(df, cont), "outliers": lambda: Q.outliers(df, cont), "suggestions": lambda: Q.suggestions(df, cont)}
        if cats:
            out |= {"modes": lambda: P.modes(df, cats), "top_values": lambda: P.top_values(df, cats), "concentration": lambda: Q.concentration(df, cats)}
        if len(cont) > 1:
            pairs = [(a, b) for i, a in enumerate(cont) for b in cont[i + 1 :] if not same_source(self.wide, a, b)]
            out |= {"correlations": lambda: A.correlations(df, cont, pairs), "sums": lambda: U.sums(df, cont), "equalities": lambda: U.equalities(df, cont)}
        if len(cats) > 1:
            out["dependencies"] = lambda: U.dependencies(df, cats)
        if times and cont:
            out |= {"series": lambda: T.series(df, times[0], cont[0]), "diagnostics": lambda: T.diagnose(T.series(df, times[0], cont[0])), "trend": lambda: T.trend_line(T.series(df, times[0], cont[0]))}
        if len(times) > 1:
            out["date_rules"] = lambda: U.date_rules(df, times)
        return Results(out)

    def charts(self) -> Results:
        return Results(chart_data(self.df, self.types))

    def execute(self, scenario: str, **more: Any) -> DataFrame:
        return FA.execute(self.df, scenario, self.key, self.types, **more)


class Dataset:
    """Several tables: relations, groups, the merged table's profile."""

    def __init__(self, tables: dict[str, DataFrame], relations: list[dict] | None = None, strip_prefix: bool = False):
        if not tables:
            raise ValueError("no tables")
        self.tables, self.own, self.strip_prefix = tables, relations or [], strip_prefix

    def relations(self) -> list[dict]:
        return M.merge_relations(self.own, [r.asDict() for r in M.discover(self.tables, self.strip_prefix).collect()])

    def groups(self) -> list[list[str]]:
        return M.groups(list(self.tables), self.relations())

    def merged(self, main: str | None = None) -> DataFrame:
        return M.star_merge(self.tables, self.relations(), main)

    def profiles(self, **options: Any) -> dict[str, Profile]:
        return {name: Profile(df, **options) for name, df in self.tables.items()}

    def report(self, most: int = 1000, **options: Any) -> str:
        """One JSON document: relations, groups, and the results of the merged table and of every table."""
        relations = self.relations()
        merged = Profile(M.star_merge(self.tables, relations), **options)
        results = {name: sinks.collect_small(p.run().frames(), most) for name, p in self.profiles(**options).items()}
        return json.dumps({"relations": relations, "groups": M.groups(list(self.tables), relations), "merged": sinks.collect_small(merged.run().frames(), most), "tables": results}, ensure_ascii=False, default=str)


class TextProfile:
    """Everything about a corpus."""

    def __init__(self, df: DataFrame, text: str | None = None, key: str = "doc_id"):
        text = text or next((c for c, r in X.roles(df).items() if r == "content"), None)
        if text is None:
            raise ValueError("no text column")
        self.docs = X.corpus(df, text, key)

    def run(self) -> Results:
        d = self.docs
        return Results(
            statistics=lambda: X.statistics(d), languages=lambda: X.language_mix(d), quality=lambda: X.quality_report(d), duplicates=lambda: X.prefix_duplicates(d), top_tokens=lambda: X.top_tokens(d), keywords=lambda: X.tfidf_terms(d),
            sentiment=lambda: X.sentiment_distribution(d), entities=lambda: X.entity_stats(d), templates=lambda: X.template_words(d), pairs=lambda: X.pmi(X.frequent(X.token_counts(d).withColumnRenamed("token", "item"), 200)),
        )
