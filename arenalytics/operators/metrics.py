"""User-defined metrics: a provider registry, the long value tables, and their aggregates.

A provider is a function from the input tables to a DataFrame ``(key, value)``; its results land in one
long table with a typed column per value kind.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arenalytics.functions.stats import ratio

# Value kinds with their column and type, and the number formats without a meaningful mean.
KINDS = {
    "boolean": ("boolean_value", "boolean"),
    "double": ("double_value", "double"),
    "percentage": ("percentage_value", "double"),
    "number": ("long_value", "bigint"),
    "string": ("string_value", "string"),
    "component": ("component_value", "string"),
    "group": ("group_name", "string"),
}
DATE_FORMATS = ["DATE_YEAR", "DATE_SECOND"]
VALUE_COLUMNS = [c for c, _ in KINDS.values()]


@dataclass(frozen=True)
class Provider:
    name: str
    kind: str
    scope: str
    evaluate: Callable[[dict[str, DataFrame]], DataFrame]
    plugin: str = "default"
    condition: str | None = None
    provides: str | None = None
    format: str = "NONE"
    show_in_table: bool = False
    on: tuple[str, ...] = ("periodic",)


@dataclass
class Registry:
    """Registered providers of user, server and group metrics, and table providers."""

    providers: dict[tuple[str, str], Provider] = field(default_factory=dict)

    def metric(self, kind: str, scope: str = "user", name: str | None = None, **options):
        """Decorator: ``@registry.metric("number", "user", provides="veteran")``."""
        if kind not in KINDS and kind != "table":
            raise ValueError(f"unknown metric kind {kind}")
        if scope not in ("user", "server", "group"):
            raise ValueError(f"unknown metric scope {scope}")

        def register(fn):
            provider = Provider(name or fn.__name__, kind, scope, fn, **options)
            self.providers[(provider.plugin, provider.name)] = provider
            return fn

        return register

    def select(self, scope: str | None = None, event: str | None = None, tables: bool = False) -> list[Provider]:
        return [
            p
            for p in self.providers.values()
            if (scope is None or p.scope == scope) and (event is None or event in p.on) and (p.kind == "table") == tables
        ]

    def evaluate(self, tables: dict[str, DataFrame], scope: str = "user", event: str | None = None) -> DataFrame:
        """Long rows ``(plugin, provider, key, one column per kind)`` of the scope's providers.

        Conditional results whose condition does not hold for the key are left out.
        """
        frames = [self._rows(p, tables) for p in self.select(scope, event)]
        if not frames:
            raise ValueError("no provider is registered for this scope")
        rows = frames[0]
        for frame in frames[1:]:
            rows = rows.unionByName(frame)
        return self._satisfied(rows, scope)

    def evaluate_tables(self, tables: dict[str, DataFrame], scope: str = "user") -> DataFrame:
        """Rows of the table providers: ``(plugin, provider, key, col_1 … col_5)``, missing columns null."""
        frames = []
        for p in self.select(scope, tables=True):
            out = p.evaluate(tables)
            columns = [
                (F.col(f"col_{i}") if f"col_{i}" in out.columns else F.lit(None)).cast("string").alias(f"col_{i}") for i in range(1, 6)
            ]
            frames.append(out.select(F.lit(p.plugin).alias("plugin"), F.lit(p.name).alias("provider"), "key", *columns))
        rows = frames[0]
        for frame in frames[1:]:
            rows = rows.unionByName(frame)
        return rows

    @staticmethod
    def _rows(p: Provider, tables: dict[str, DataFrame]) -> DataFrame:
        column, kind = KINDS[p.kind]
        typed = [
            (F.col("value") if c == column else F.lit(None)).cast(t).alias(c) for c, t in KINDS.values()
        ]
        return p.evaluate(tables).select(F.lit(p.plugin).alias("plugin"), F.lit(p.name).alias("provider"), "key", *typed)

    def _satisfied(self, rows: DataFrame, scope: str) -> DataFrame:
        provided = {(p.plugin, p.provides): p for p in self.select(scope) if p.provides and p.kind == "boolean"}
        kept = rows
        for p in self.select(scope):
            if p.condition is None:
                continue
            negated = p.condition.startswith("not_") and (p.plugin, p.condition) not in provided
            source = provided.get((p.plugin, p.condition[4:] if negated else p.condition))
            if source is None:
                continue
            failing = rows.where(
                (F.col("plugin") == source.plugin) & (F.col("provider") == source.name) & (F.col("boolean_value") == negated)
            ).select(F.lit(p.plugin).alias("plugin"), F.lit(p.name).alias("provider"), "key")
            kept = kept.join(failing, ["plugin", "provider", "key"], "left_anti")
        return kept


def _described(aggregated: DataFrame, providers: DataFrame, plugins: DataFrame, hidden: bool = False) -> DataFrame:
    """Rows with the provider and plugin they belong to, without hidden providers unless ``hidden``."""
    shown = providers if hidden else providers.where(~F.coalesce(F.col("hidden"), F.lit(False)))
    meta = shown.select(F.col("id").alias("provider_id"), F.col("name").alias("provider"), "plugin_id", "format")
    owner = plugins.select(F.col("id").alias("plugin_id"), F.col("name").alias("plugin"), "server_id")
    return aggregated.join(meta, "provider_id").join(owner, "plugin_id").drop("plugin_id")


def boolean_shares(values, providers, plugins) -> DataFrame:
    """Share of true per boolean provider."""
    shares = values.where(F.col("boolean_value").isNotNull()).groupBy("provider_id").agg(
        ratio(F.count_if("boolean_value"), F.count("*")).alias("share")
    )
    return _described(shares, providers, plugins).drop("format")


def double_stats(values, providers, plugins) -> DataFrame:
    stats = values.where(F.col("double_value").isNotNull()).groupBy("provider_id").agg(
        F.avg("double_value").alias("average"), F.sum("double_value").alias("total")
    )
    return _described(stats, providers, plugins).drop("format")


def number_stats(values, providers, plugins) -> DataFrame:
    """Mean and total per number provider, without date-formatted numbers."""
    stats = values.where(F.col("long_value").isNotNull()).groupBy("provider_id").agg(
        F.avg("long_value").alias("average"), F.sum("long_value").alias("total")
    )
    return _described(stats, providers, plugins).where(~F.col("format").isin(DATE_FORMATS)).drop("format")


def percentage_stats(values, providers, plugins) -> DataFrame:
    stats = values.where(F.col("percentage_value").isNotNull()).groupBy("provider_id").agg(F.avg("percentage_value").alias("average"))
    return _described(stats, providers, plugins).drop("format")


def group_sizes(groups, providers, plugins) -> DataFrame:
    sizes = groups.groupBy("provider_id", "group_name").agg(F.count("*").alias("users"))
    return _described(sizes, providers, plugins).drop("format")


def with_metadata(values, providers, plugins, hidden: bool = False) -> DataFrame:
    """Values of users or servers with the provider and plugin they belong to; hidden providers on request."""
    return _described(values, providers, plugins, hidden)


def table_rows(rows, headers, key: str) -> DataFrame:
    """Rows of metric tables with the table name and their plugin."""
    named = headers.select(F.col("id").alias("table_id"), F.col("name").alias("table"), "plugin_id", F.col("col_1").alias("header_1"))
    return rows.join(named, "table_id").select(key, "table", "plugin_id", "header_1", *[c for c in rows.columns if c.startswith("col_")])


def history_series(history, providers, plugins) -> DataFrame:
    """Points of every provider ordered by provider and time; one long series is spread over many tasks."""
    points = history.select("provider_id", "date", "id", F.coalesce("double_value", F.col("long_value").cast("double")).alias("value"))
    return _described(points, providers, plugins).drop("format").orderBy("provider_id", "date", "id")


def append_history(history, server_values, at: int) -> DataFrame:
    """History extended by the current numeric values, dated ``at``."""
    current = server_values.where(F.coalesce(F.col("double_value"), F.col("percentage_value"), F.col("long_value")).isNotNull()).select(
        "provider_id", "server_id", F.lit(at).cast("bigint").alias("date"),
        F.coalesce("double_value", "percentage_value").alias("double_value"), "long_value",
    )
    return history.select("provider_id", "server_id", "date", "double_value", "long_value").unionByName(current)


def in_player_table(values, groups, providers, users: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per user of ``users`` (user_id) with the shown metrics as text columns.

    ``names`` lists the providers so the pivot needs no extra pass; several groups of one provider are joined by comma.
    """
    shown = providers.where("show_in_table").select(F.col("id").alias("provider_id"), F.concat(F.col("plugin_id").cast("string"), F.lit("."), "name").alias("metric"))
    text = F.coalesce(*[F.col(c).cast("string") for c in ("boolean_value", "double_value", "percentage_value", "long_value")])
    wanted = users.select("user_id")
    single = values.join(wanted, "user_id", "left_semi").select("user_id", "provider_id", text.alias("value"))
    grouped = (
        groups.join(wanted, "user_id", "left_semi").select("user_id", "provider_id", "group_name").distinct()
        .groupBy("user_id", "provider_id").agg(F.array_join(F.sort_array(F.collect_list("group_name")), ",").alias("value"))
    )
    long = single.unionByName(grouped).join(shown, "provider_id")
    return long.groupBy("user_id").pivot("metric", list(names)).agg(F.max("value"))


def recent_users(sessions, n: int) -> DataFrame:
    """The ``n`` users seen last, ties by id."""
    seen = sessions.groupBy("user_id").agg(F.max("session_end").alias("last_seen"))
    return seen.orderBy(F.col("last_seen").desc(), F.col("user_id").asc()).limit(n)


def users_in_groups(groups, provider_ids: DataFrame, names: Sequence[str]) -> DataFrame:
    chosen = groups.where(F.col("group_name").isin(list(names)))
    return chosen.join(provider_ids.select(F.col("id").alias("provider_id")), "provider_id", "left_semi").select("user_id").distinct()


def users_with_boolean(values, provider_ids: DataFrame, wanted: str) -> DataFrame:
    """Users whose boolean value is TRUE, FALSE, or either (BOTH)."""
    value = F.col("boolean_value")
    condition = {"TRUE": value, "FALSE": ~value, "BOTH": value.isNotNull()}[wanted]
    return values.where(condition).join(provider_ids.select(F.col("id").alias("provider_id")), "provider_id", "left_semi").select("user_id").distinct()


def satisfied_values(values, providers) -> DataFrame:
    """Values without those whose condition (``x`` or ``not_x``) is contradicted by the same user's boolean."""
    source = providers.where(F.col("provided_condition").isNotNull()).select(F.col("id").alias("provider_id"), "plugin_id", "provided_condition")
    broken = values.where(F.col("boolean_value").isNotNull()).join(source, "provider_id").select(
        "user_id", "plugin_id",
        F.when(F.col("boolean_value"), F.concat(F.lit("not_"), "provided_condition")).otherwise(F.col("provided_condition")).alias("condition"),
    )
    targets = providers.where(F.col("condition").isNotNull()).select(F.col("id").alias("provider_id"), "plugin_id", "condition")
    unsatisfied = broken.join(targets, ["plugin_id", "condition"]).select("user_id", "provider_id").distinct()
    return values.join(unsatisfied, ["user_id", "provider_id"], "left_anti")


def drop_providers(table, provider_ids: DataFrame, column: str = "provider_id") -> DataFrame:
    return table.join(provider_ids.select(F.col("id").alias(column)), column, "left_anti")


def stale_providers(providers, plugins, cutoff: int, disabled: Sequence[str] = ()) -> DataFrame:
    """Providers of plugins not updated since ``cutoff`` or switched off by name."""
    old = plugins.where((F.col("last_updated") < cutoff) | F.col("name").isin(list(disabled))).select(F.col("id").alias("plugin_id"))
    return providers.join(old, "plugin_id", "left_semi").select("id")


def installed(plugins, servers) -> DataFrame:
    return plugins.select("id", "name", "server_id").join(servers.select(F.col("id").alias("server_id"), F.col("name").alias("server")), "server_id")
