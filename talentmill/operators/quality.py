"""Contract checks: what a relational database would enforce, as a violation report."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TABLES, Table
from ..session import materialise
from .writes import net_changes


@dataclass(frozen=True)
class _Rule:
    """A rule as the place where its violations are counted: a key space and a slot of that space."""

    table: str
    name: str
    space: int
    slot: int


class _Compiled:
    """The rules of some tables, as the stacked rows (space, key, text, slot) that each table contributes.

    Three kinds of space: the rows that break a rule (no key), the values of a unique column (slot 0), and of an id
    that others link to (slot 0 own rows, then one slot per link). Every value carries a count per slot, so there are only as many
    slots as an id has links; whole numbers stay numbers, and all other values are text.
    """

    def __init__(self, tables: Mapping[str, DataFrame]) -> None:
        self.rules: list[_Rule] = []
        self.row_spaces: set[int] = set()
        self.stacked: dict[str, list[Column]] = {name: [] for name in tables}
        spaces: dict[tuple[str, str], int] = {}
        used: dict[int, int] = {}

        # An id and all columns that link to it are compared alike.
        texts = {parent for name, df in tables.items() for c, parent in [("id", name), *TABLES[name].links.items()]
                 if c in df.columns and not isinstance(df.schema[c].dataType, T.IntegralType)}

        def space_of(table: str, column: str) -> int:
            if (table, column) not in spaces:
                number = spaces[table, column] = len(spaces)
                used[number] = 1
                if column in tables[table].columns:
                    number_like = column == "id" and table not in texts
                    self._emit(table, number, 0, F.col(column), F.col(column).isNotNull(), number_like)
            return spaces[table, column]

        def slot_of(space: int) -> int:
            used[space] += 1
            return used[space] - 1

        for name, df in tables.items():
            table = TABLES[name]
            for _, rule, bad in _broken_rules(name, df.columns):
                own = space_of(name, f"rule: {rule}")
                self.row_spaces.add(own)
                self.rules.append(_Rule(name, rule, own, 0))
                self._emit(name, own, 0, F.lit(None), bad, True)
            for c in table.unique:
                if c in df.columns:
                    self.rules.append(_Rule(name, f"{c} unique", space_of(name, c), 0))
            for c, parent in table.links.items():
                if c in df.columns and parent in tables:
                    ids = space_of(parent, "id")
                    slot = slot_of(ids)
                    self.rules.append(_Rule(name, f"{c} in {parent}", ids, slot))
                    self._emit(name, ids, slot, F.col(c), F.col(c).isNotNull(), parent not in texts)
        self.slots = max(used.values(), default=0)

    def _emit(self, table: str, space: int, slot: int, key: Column, present: Column, number_like: bool) -> None:
        number, text = (key, F.lit(None)) if number_like else (F.lit(None), key)
        entry = F.struct(
            F.lit(space).alias("space"), number.cast("long").alias("key"), text.cast("string").alias("text"), F.lit(slot).alias("slot"))
        self.stacked[table].append(F.when(present, entry))


def contract_violations(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Violations per table and rule, zero included, for the given tables.

    Null, domain and length rules count broken rows; a unique rule counts the rows in excess of one per value, a
    link rule the rows whose parent is missing; nulls break neither. Every table is read once: a row gives one stacked row per
    value that a unique or link rule looks at and one per rule that it breaks itself. One aggregate per value, combined on the map
    side, so a value in most rows costs one row per task, holds both sides of every link; no table is joined.
    """
    rules = _Compiled(tables)
    # A table without any rule is not read. Absent entries are dropped after the arrays are unfolded: a filter of arrays is not compiled.
    parts = [
        df.select(F.inline(F.array(*rules.stacked[name]))).where("space is not null") for name, df in tables.items() if rules.stacked[name]
    ]
    slots = range(rules.slots)
    per_key = reduce(DataFrame.union, parts).groupBy("space", "key", "text").agg(
        *[F.count_if(F.col("slot") == i).alias(f"_{i}") for i in slots])
    of_rows, orphan = F.col("space").isin(*sorted(rules.row_spaces)), F.col("_0") == 0
    excess = F.when(of_rows, F.col("_0")).otherwise(F.greatest(F.col("_0") - 1, F.lit(0)))
    broken = [excess] + [F.when(of_rows | orphan, F.col(f"_{i}")).otherwise(0) for i in slots[1:]]
    sums = per_key.select("space", *[c.alias(f"_{i}") for i, c in enumerate(broken)]).groupBy("space").agg(
        F.array(*[F.sum(f"_{i}") for i in slots]).alias("found"))
    known = F.array(*[
        F.struct(F.lit(r.table).alias("table"), F.lit(r.name).alias("rule"), F.lit(r.space).alias("space"), F.lit(r.slot).alias("slot"))
        for r in rules.rules
    ])
    # One row per rule meets one row per space: both as many as the schemas have columns.
    catalogue = sums.sparkSession.range(1, numPartitions=1).select(F.inline(known))
    return catalogue.join(F.broadcast(sums), "space", "left").select(
        "table", "rule", F.coalesce(F.get("found", F.col("slot")), F.lit(0)).cast("long").alias("violations"))


def _broken_rules(name: str, columns: Collection[str]) -> list[tuple[str, str, Column]]:
    """(column, rule, condition under which a row breaks it) for the null, domain and length rules."""
    table = TABLES[name]
    rules = [(c, f"{c} not null", F.col(c).isNull()) for c in table.required]
    rules += [(c, f"{c} in domain", ~F.col(c).isin(*d)) for c, d in table.domains.items()]
    rules += [(c, f"{c} length <= {n}", F.length(c) > n) for c, n in table.max_length.items()]
    return [r for r in rules if r[0] in columns]


def _split(df: DataFrame, broken: list[Column]) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("_broken", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))
    return (
        checked.where(F.size("_broken") == 0).drop("_broken"),
        checked.where(F.size("_broken") > 0).withColumnRenamed("_broken", "broken_rules"),
    )


def split_valid(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the null, domain and length rules, and the rest with the broken rules."""
    return _split(df, [F.when(bad, F.lit(rule)) for _, rule, bad in _broken_rules(name, df.columns)])


def split_changes(changes: DataFrame, name: str, fields: Collection[str]) -> tuple[DataFrame, DataFrame]:
    """Changes whose set values meet the rules of their columns, and the rest with the broken rules."""
    return _split(changes, [
        F.when(F.array_contains("set_fields", c) & bad, F.lit(rule)) for c, rule, bad in _broken_rules(name, fields)
    ])


def split_insertable(
    batch: DataFrame, name: str, stored: DataFrame, parents: Mapping[str, DataFrame], order: str,
) -> tuple[DataFrame, DataFrame]:
    """Rows that may be inserted beside the stored ones, and the rest with the broken rules.

    Beyond split_valid: a unique column may not repeat a stored value, nor one of an earlier row of
    the batch (by the column `order`, unique in the batch); a link needs its parent. Keys are reduced
    to one row each before they meet, so a value that fills the batch costs one row per task.
    """
    table = TABLES[name]
    valid, broken = split_valid(batch, name)
    marks, checks = [], valid
    for c in (c for c in table.unique if c != "id" and c in batch.columns):
        first = valid.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(order).alias(f"_first_{c}"))
        known = stored.select(F.col(c).alias("_k")).where("_k is not null").distinct()
        per_key = first.join(known, F.col(c) == F.col("_k"), "left").select(
            F.col(c).alias(f"_key_{c}"), f"_first_{c}", F.col("_k").isNotNull().alias(f"_known_{c}"))
        checks = checks.join(per_key, F.col(c) == F.col(f"_key_{c}"), "left")
        marks.append(F.when(F.col(f"_known_{c}") | (F.col(order) > F.col(f"_first_{c}")), F.lit(f"{c} unique")))
    for c, parent in table.links.items():
        if c in batch.columns and parent in parents:
            ids = parents[parent].select(F.col("id").alias(f"_parent_{c}")).distinct()
            checks = checks.join(ids, F.col(c) == F.col(f"_parent_{c}"), "left")
            marks.append(F.when(F.col(c).isNotNull() & F.col(f"_parent_{c}").isNull(), F.lit(f"{c} in {parent}")))
    good, bad = _split(checks, marks)
    return good.select(*batch.columns), broken.unionByName(bad.select(*batch.columns, "broken_rules"))


def _links_checked(changes: DataFrame, name: str, fields: Collection[str], parents: Mapping[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Changes that set no link without a parent, and the rest with the broken rules."""
    marks, checks = [], changes
    for c, parent in TABLES[name].links.items():
        if c in fields and parent in parents:
            ids = parents[parent].select(F.col("id").alias(f"_parent_{c}")).distinct()
            checks = checks.join(ids, F.col(c) == F.col(f"_parent_{c}"), "left")
            lost = F.array_contains("set_fields", c) & F.col(c).isNotNull() & F.col(f"_parent_{c}").isNull()
            marks.append(F.when(lost, F.lit(f"{c} in {parent}")))
    good, bad = _split(checks, marks)
    return good.select(*changes.columns), bad.select(*changes.columns, "broken_rules")


def _unique_conflicts(changes: DataFrame, columns: list[str], stored: DataFrame) -> DataFrame:
    """Columns id, column: the keys whose net change may not take the value of a unique column.

    Two sides of each value meet before any stored row is asked for: the rows that take it and
    those that give it up. Of several takers the smallest id counts. A taker is refused if a row that does not
    move holds the value; and a refused row gives nothing up, so whoever takes its old value is refused too, and so on.
    """
    # net_changes over the rows that set a unique column; moves are small: one row per key and column that changes.
    net = net_changes(changes, columns)
    moves = []
    for c in columns:
        moved = net.where(F.col(f"_set_{c}")).join(stored.select("id", F.col(c).alias("_old")), "id")
        moves.append(moved.select("id", F.lit(c).alias("column"), F.col("_old").cast("string").alias("old"),
                                  F.col(f"_new_{c}").cast("string").alias("new")).where("not (old <=> new)"))
    moves = materialise(reduce(DataFrame.union, moves), "moves")
    takers = moves.where("new is not null").groupBy("column", "new").agg(F.min("id").alias("first"))
    late = moves.join(takers, ["column", "new"]).where("id <> first").select("id", "column")
    held = [stored.select("id", F.lit(c).alias("column"), F.col(c).cast("string").alias("new")).where("new is not null") for c in columns]
    held = reduce(DataFrame.union, held).join(takers, ["column", "new"]).where("id <> first")
    stays = held.join(moves.select("id", "column"), ["id", "column"], "left_anti").select(F.col("first").alias("id"), "column")
    refused = materialise(late.union(stays).distinct(), "refused")
    found = refused
    while not refused.isEmpty():
        kept = moves.join(refused.select("id").distinct(), "id", "left_semi").select("column", F.col("old").alias("new"))
        chain = moves.join(kept.where("new is not null").distinct(), ["column", "new"], "left_semi").select("id", "column")
        refused = materialise(chain.join(found, ["id", "column"], "left_anti").distinct(), "refused")
        found = materialise(found.union(refused), "refused-all")
    return found


def split_updates(
    changes: DataFrame, name: str, fields: Collection[str], stored: DataFrame, parents: Mapping[str, DataFrame],
) -> tuple[DataFrame, DataFrame]:
    """Changes (id, set_fields, changed_at, seq, fields...) that may be applied to the stored rows, and the rest with the broken rules.

    Beyond split_changes: a link needs its parent, and after the whole batch a unique column holds each value once. A row
    that moves away frees its value for another of the same batch. Where a key's net change is refused, all its
    changes of unique columns are; of several keys that take one value only the smallest may.
    """
    valid, broken = split_changes(changes, name, fields)
    valid, lost = _links_checked(valid, name, fields, parents)
    broken = broken.unionByName(lost)
    columns = [c for c in TABLES[name].unique if c != "id" and c in fields]
    if not columns:
        return valid, broken
    taken = _unique_conflicts(valid.where(F.arrays_overlap("set_fields", F.array(*map(F.lit, columns)))), columns, stored)
    rules = taken.groupBy("id").agg(F.sort_array(F.collect_set(F.concat("column", F.lit(" unique")))).alias("_rules"))
    checked = valid.join(rules, "id", "left").withColumn(
        "_refused", F.col("_rules").isNotNull() & F.arrays_overlap("set_fields", F.array(*map(F.lit, columns))))
    return (
        checked.where("not _refused").select(*changes.columns),
        broken.unionByName(checked.where("_refused").select(*changes.columns, F.col("_rules").alias("broken_rules"))),
    )
