"""Which rows of an ordered feed are kept, decided in rounds over many tasks.

The rule is a fold: a row is left out if a kept row has its id, or (unless it is a correction) is the same person
within DAYS days and AGE years; a correction first takes away what has the id that it names. A row depends
only on earlier rows that share its id, its person and near days, or that correct one of these. So each
round settles every row whose earlier rivals are settled, or which a settled one shuts out for certain; rows of
unlike days or ages never wait for each other. Rivals are folded before they meet: by id to the first of each
kind, by person, day and age likewise, so a hot person or id makes as many pairs as it has days and ages.
A round keeps only the folds that rows still waiting look for, so later rounds cost what waits, not what is settled.

Only ids that some correction names (mortal ones) need more: their adds and removals are read in order within the
id. What still waits after ROUNDS rounds is a chain in which each row hangs on the one before; such rows are
linked with those that they can meet and each group is folded in order, earlier verdicts standing.

A null id equals no other, and a null key is no one's.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.tables import linked, written

DAYS, AGE, ROUNDS = 2, 1, 8
PERSON = ["scope", "key", "day", "age"]
#: What rows meet by: a person's key, day and age, or an id (then day is 0 and there is no age).
TOKEN, KINDS = ["scope", "person", "key", "day", "age"], ("base", "sure", "pending")


def alike(a: Column, b: Column) -> Column:
    """Whether two ages may be one person's: unknown ones may."""
    return a.isNull() | b.isNull() | (F.abs(a - b) <= AGE)


def by_day(rows: DataFrame) -> DataFrame:
    return rows.where("key IS NOT NULL").withColumn("day", F.explode(F.array_distinct("days")))


def tokens(rows: DataFrame, use: str = "settled") -> DataFrame:
    """rows by TOKEN, no mortal ids. settled: persons of rows that none can take away; waits: of all rows; asks: what a row looks for, a correction no person."""
    none = F.lit(None)
    at = lambda person, key, day, age: F.struct(F.lit(person).alias("person"), key.alias("key"), day.cast("int").alias("day"), age.cast("int").alias("age"))
    persons = F.transform(F.array_distinct("days"), lambda d: at(True, F.col("key"), d, F.col("age")))
    empty = F.array().cast("array<struct<person: boolean, key: string, day: int, age: int>>")
    wanted = F.col("key").isNotNull() & {"settled": lambda: ~F.col("mortal"), "waits": lambda: F.lit(True), "asks": lambda: F.col("corrects").isNull()}[use]()
    found = F.concat(F.when(F.col("id").isNotNull() & ~F.col("mortal"), F.array(at(False, F.col("id"), F.lit(0), none))).otherwise(empty), F.when(wanted, persons).otherwise(empty))
    return rows.withColumn("_t", F.explode(found)).select("scope", *(["place"] if "place" in rows.columns else []), "_t.*")


def near(cells: DataFrame) -> DataFrame:
    """Each cell once for every day that it reaches; an id reaches its own only."""
    reach = F.sequence(F.col("day") - DAYS, F.col("day") + DAYS)
    return cells.withColumn("day", F.explode(F.when(F.col("person"), reach).otherwise(F.array("day")) if "person" in cells.columns else reach))


class Merge:
    """The rows of one merge and what is settled of them: feed has scope, place, id, key, age, days, corrects; base the first and last but place and corrects."""

    def __init__(self, base: DataFrame, feed: DataFrame) -> None:
        self.place = feed.schema["place"].dataType
        self.targets = written(feed.where("corrects IS NOT NULL").select("scope", F.col("corrects").alias("id")).distinct(), "targets")
        self.any_targets = not self.targets.isEmpty()
        self.base = self._marked(base)
        self.waiting = written(self._marked(feed), "waiting")
        self.kept: list[DataFrame] = []
        self.told: list[DataFrame] = []  # of the kept rows, those with mortal ids and the corrections
        self.cells = written(self._cells(tokens(self.base).select(*TOKEN).distinct(), base=F.lit(True)), "base-cells")
        self.base_mortal = written(self.base.where("mortal"), "base-mortal") if self.any_targets else self.base.where("mortal")
        self.base_ids = self.base_mortal.select("scope", "id").distinct()

    def _marked(self, rows: DataFrame) -> DataFrame:
        """Adds mortal: whether a correction names the id."""
        if not self.any_targets:
            return rows.withColumn("mortal", F.lit(False))
        return rows.join(self.targets.withColumn("mortal", F.lit(True)), ["scope", "id"], "left").withColumn("mortal", F.coalesce("mortal", F.lit(False)))

    def _cells(self, rows: DataFrame, **kinds: Column) -> DataFrame:
        """TOKEN, and base (whether rows of base are among them), sure and pending (places of kept and of waiting rows)."""
        none = F.lit(None).cast(self.place)
        return rows.select(*TOKEN, *(kinds.get(c, F.lit(False) if c == "base" else none).alias(c) for c in KINDS))

    def all_kept(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.kept) if self.kept else self.waiting.where(F.lit(False))

    def _rivals(self) -> DataFrame:
        """scope, place of waiting rows with the folded rows that hold their id (i_base, i_sure, i_pending) and that are their person (p_ likewise)."""
        place = F.col("place")
        folded = lambda rows: rows.groupBy(*TOKEN).agg(F.max("base").alias("base"), F.min("sure").alias("sure"), F.min("pending").alias("pending"))
        own = tokens(self.waiting, "asks")
        asked = near(own.select(*TOKEN).distinct().withColumn("at", F.col("day")))  # what waits goes to the days around it
        if self.kept:  # no row asks for a cell that none of now asks for
            settled = self.cells.unionByName(self._cells(tokens(self.kept[-1]), sure=place))
            self.cells = written(folded(settled.join(asked.select(*TOKEN[:-1]).distinct(), TOKEN[:-1], "left_semi")), "cells")
        cells = folded(self.cells.unionByName(self._cells(tokens(self.waiting, "waits"), pending=place)))
        met = asked.join(cells.withColumnRenamed("age", "its_age"), TOKEN[:-1]).where(alike(F.col("age"), F.col("its_age"))).withColumn("day", F.col("at"))
        met = met.groupBy(*TOKEN).agg(F.max("base").alias("base"), F.min("sure").alias("sure"), F.min("pending").alias("pending"))
        met = met.withColumnsRenamed({c: f"m_{c}" for c in TOKEN})
        same = [F.col(c) == F.col(f"m_{c}") for c in TOKEN[:-1]] + [F.col("age").eqNullSafe(F.col("m_age"))]
        of = lambda person, c: F.when(F.col("person") == person, F.col(c))
        told = [f(of(person, c)).alias(f"{'p' if person else 'i'}_{c}") for person in (False, True) for f, c in ((F.max, "base"), (F.min, "sure"), (F.min, "pending"))]
        return own.join(met, same).groupBy("scope", "place").agg(*told)

    def _mortal_ids(self, kept: DataFrame) -> DataFrame:
        """scope, place of waiting rows with mortal ids: held (a row with the id is there as far as is settled), unsure (what waits may change that)."""
        flags = ("added", "adding", "removed", "removing")
        event = lambda rows, id_, kind: rows.select("scope", F.col(id_).alias("id"), "place", *(F.lit(c == kind).alias(c) for c in flags))
        fixes, mine = kept.where("corrects IS NOT NULL"), self.waiting.where("mortal")
        events = event(kept.where("mortal"), "id", "added").unionByName(event(mine, "id", "adding")).unionByName(event(fixes, "corrects", "removed")).unionByName(event(self.waiting.where("corrects IS NOT NULL"), "corrects", "removing"))
        events = events.groupBy("scope", "id", "place").agg(*(F.max(c).alias(c) for c in flags))
        before = Window.partitionBy("scope", "id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        last = lambda c: F.max(F.when(F.col(c), F.col("place"))).over(before)
        seen = events.select("*", last("added").alias("a"), last("removed").alias("r"), F.coalesce(F.max("adding").over(before), F.lit(False)).alias("may_add"), F.coalesce(F.max("removing").over(before), F.lit(False)).alias("may_go"))
        seen = seen.where("adding").join(self.base_ids.withColumn("base", F.lit(True)), ["scope", "id"], "left")
        held = F.coalesce(F.when(F.col("a").isNotNull(), F.col("r").isNull() | (F.col("a") >= F.col("r"))), F.col("base").isNotNull() & F.col("r").isNull())
        return seen.select("scope", "place", held.alias("held"), F.when(held, F.col("may_go")).otherwise(F.col("may_add")).alias("unsure"))

    def _mortal_persons(self, kept: DataFrame) -> DataFrame:
        """scope, place of waiting rows that a kept row with a mortal id shuts out: for certain, or unless a waiting correction takes it away."""
        columns = ["scope", "id", "key", "age", "days"]
        there = self.base_mortal.select(*columns, F.lit(None).cast(self.place).alias("since")).unionByName(kept.where("mortal").select(*columns, F.col("place").alias("since")))
        for name, rows in (("gone", kept), ("may_go", self.waiting)):  # the first correction after it came
            fixes = rows.where("corrects IS NOT NULL").select(F.col("scope").alias("s"), F.col("corrects").alias("c"), F.col("place").alias("at"))
            after = (F.col("scope") == F.col("s")) & (F.col("id") == F.col("c")) & (F.col("since").isNull() | (F.col("at") > F.col("since")))
            there = there.join(fixes, after, "left").groupBy(*there.columns).agg(F.min("at").alias(name))
        reach = near(by_day(there)).select("scope", "key", "day", F.col("age").alias("its_age"), "since", "gone", "may_go").distinct()
        own = by_day(self.waiting.where("corrects IS NULL")).select(*PERSON, "place")
        met = own.join(reach, ["scope", "key", "day"]).where(alike(F.col("age"), F.col("its_age")))
        met = met.where((F.col("since").isNull() | (F.col("since") < F.col("place"))) & (F.col("gone").isNull() | (F.col("gone") > F.col("place"))))
        return met.groupBy("scope", "place").agg(F.max(F.col("may_go").isNull() | (F.col("may_go") > F.col("place"))).alias("shut"))

    def round(self) -> None:
        """Settle what can be settled now."""
        no, place = F.lit(False), F.col("place")
        rows = self.waiting.join(self._rivals(), ["scope", "place"], "left")
        held, unsure = F.coalesce("i_base", no) | F.coalesce(F.col("i_sure") < place, no), F.coalesce(F.col("i_pending") < place, no)
        certain, maybe = F.coalesce("p_base", no) | F.coalesce(F.col("p_sure") < place, no), F.coalesce(F.col("p_pending") < place, no)
        unsure = unsure & ~held
        if self.any_targets:
            kept = reduce(DataFrame.unionByName, self.told) if self.told else self.waiting.where(no)
            rows = rows.join(self._mortal_ids(kept), ["scope", "place"], "left").join(self._mortal_persons(kept), ["scope", "place"], "left")
            held, unsure = F.when(F.col("mortal"), F.coalesce("held", no)).otherwise(held), F.when(F.col("mortal"), F.coalesce("unsure", no)).otherwise(unsure)
            certain, maybe = certain | F.coalesce("shut", no), maybe | F.col("shut").isNotNull()
        fix = F.col("corrects").isNotNull()
        out = (held & ~unsure) | (~fix & certain)
        stays = ~held & ~unsure & (fix | ~maybe)
        verdict = F.when(out, "out").when(stays, "kept").otherwise("waits")
        settled = written(rows.select(*self.waiting.columns, verdict.alias("verdict")), "round")
        self.kept.append(settled.where("verdict = 'kept'").drop("verdict"))
        if self.any_targets:
            self.told.append(written(self.kept[-1].where("mortal OR corrects IS NOT NULL"), "told"))
        self.waiting = settled.where("verdict = 'waits'").drop("verdict")

    def fold_rest(self) -> None:
        """Fold what still waits in order, with the rows that it can meet and their verdicts."""
        columns = ["scope", "id", "key", "age", "days"]
        none = F.lit(None).cast(self.place)
        rows = self.base.select(*columns, F.lit(0).alias("kind"), none.alias("place"), F.lit(None).cast("string").alias("corrects"))
        for kind, part in ((1, self.all_kept()), (2, self.waiting)):
            rows = rows.unionByName(part.select(*columns, F.lit(kind).alias("kind"), "place", "corrects"))
        scope = F.coalesce(F.col("scope").cast("string"), F.lit(""))
        named = lambda c: F.when(F.col(c).isNotNull(), F.concat_ws("\x01", F.lit("id"), scope, F.col(c)))
        bands = F.flatten(F.transform("days", lambda d: F.array(F.floor(d / (DAYS + 1)), F.floor(d / (DAYS + 1)) + 1)))
        person = F.when(F.col("key").isNotNull(), F.transform(bands, lambda b: F.concat_ws("\x01", F.lit("person"), scope, "key", b.cast("string"))))
        tokens = F.concat(F.array_compact(F.array(named("id"), named("corrects"))), F.coalesce(person, F.array().cast("array<string>")))
        groups = written(linked(rows.where(F.size(tokens) > 0), tokens), "groups")
        groups = groups.join(groups.where("kind = 2").select("group").distinct(), "group", "left_semi")
        ordered = groups.select("group", "kind", "scope", "id", "key", "age", "days", "corrects", "place").repartition("group").sortWithinPartitions("group", F.col("kind") > 0, "place")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            group, state = object(), Kept()
            for batch in batches:
                stay = []
                told = zip(*(batch.column(c).to_pylist() for c in ("group", "kind", "scope", "id", "key", "age", "days", "corrects")), strict=True)
                for at, (own, kind, *row) in enumerate(told):
                    if own != group:
                        group, state = own, Kept()
                    if state.take(kind, *row) and kind == 2:
                        stay.append(at)
                yield batch.select(["scope", "place"]).take(pa.array(stay, pa.int64()))

        stays = ordered.mapInArrow(run, ordered.select("scope", "place").schema)
        self.kept.append(written(self.waiting.join(stays, ["scope", "place"], "left_semi"), "folded"))
        self.waiting = self.waiting.where(F.lit(False))

    def settle(self, rounds: int = ROUNDS) -> DataFrame:
        """The feed's rows that are kept at their turn: scope, place, id, corrects."""
        for _ in range(rounds):
            if self.waiting.isEmpty():
                break
            self.round()
        if not self.waiting.isEmpty():
            self.fold_rest()
        return self.all_kept().select("scope", "place", "id", "corrects")


class Kept:
    """The kept rows of one group so far, found by id and by person and band of days; no row that was left out is held."""

    def __init__(self) -> None:
        self.next = 0
        self.by_id: dict = defaultdict(list)
        self.by_person: dict = defaultdict(list)
        self.gone: set[int] = set()

    def _shut_out(self, scope: object, key: str, age: int | None, days: list[int]) -> bool:
        for day in days:
            for band in range(day // (DAYS + 1) - 1, day // (DAYS + 1) + 2):
                for at, its_age, its_day in self.by_person.get((scope, key, band), ()):
                    if at not in self.gone and abs(its_day - day) <= DAYS and (age is None or its_age is None or abs(its_age - age) <= AGE):
                        return True
        return False

    def take(self, kind: int, scope: object, id_: str | None, key: str | None, age: int | None, days: list[int] | None, corrects: str | None) -> bool:
        """Whether the row is kept; kinds 0 (base) and 1 (kept before) always are."""
        days = days or []
        if kind == 2 and id_ is not None and self.by_id.get((scope, id_)):
            return False
        if kind and corrects is not None:
            self.gone.update(self.by_id.pop((scope, corrects), ()))
        elif kind == 2 and key is not None and self._shut_out(scope, key, age, days):
            return False
        if id_ is not None:
            self.by_id[scope, id_].append(self.next)
        if key is not None:
            for day in set(days):
                self.by_person[scope, key, day // (DAYS + 1)].append((self.next, age, day))
        self.next += 1
        return True
