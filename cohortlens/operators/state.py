"""The summary from kept state: new files are added to what is known, old ones are not read again.

State is what ``facts`` reduces each relation to, in a form that can be put together: sums, least and greatest values, flags and
month bits per user (people: per user and combination of dimensions). ``ModelState.update`` lists the files of the three
relations, reduces those that no version covers, puts their rows together with the kept ones (one aggregate a
relation) and makes the next version. A version names the files that it covers; it exists as a whole or not at all (``sources.snapshots``).

Events before signup are counted from details of the users who break the rule (their events by date, their
signup dates). Once broken, a user stays so; only for users whom the new files make break it are the old files read again,
for these users alone. A file that was covered and is gone or changed makes the state start anew from all files.

The state grows with the users, not with the log. Update costs the new files and one pass over the state.
"""

from __future__ import annotations

import uuid
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.months import PREFIX, month_index, slots_in, slots_of
from ..session import run_folder, stored
from ..sources import snapshots
from ..sources.model import Model
from ..sources.tables import MODEL_SCHEMAS
from . import facts, quality, summary

RELATIONS = tuple(MODEL_SCHEMAS)
PARTS = ("people", "acts", "bills", "early_events", "early_signups")
FILES = "relation string, path string, bytes long, modified long"


class File(NamedTuple):
    relation: str
    path: str
    bytes: int
    modified: int


def listed(spark: SparkSession, base_dir: str) -> list[File]:
    """The Parquet files of users, events and subscriptions below ``base_dir``, as Spark itself lists them to plan a scan."""
    out = []
    for name in RELATIONS:
        _, fs, path = snapshots._file_system(spark, f"{base_dir}/{name}")
        at = path(f"{base_dir}/{name}")
        if not fs.exists(at):
            continue
        found = fs.listFiles(at, True)
        while found.hasNext():
            f = found.next()
            if not f.getPath().getName().startswith(("_", ".")):
                out.append(File(name, f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def _read(spark: SparkSession, relation: str, files: list[File]) -> DataFrame:
    own = [f.path for f in files if f.relation == relation]
    read = spark.read.schema(MODEL_SCHEMAS[relation])
    return read.parquet(*own) if own else spark.createDataFrame([], MODEL_SCHEMAS[relation])


def add_people(*rows: DataFrame) -> DataFrame:
    return _union(rows).groupBy("user_id", *facts.DIMENSIONS).agg(
        F.sum("copies").alias("copies"), F.max("last_signup").alias("last_signup"), F.sum("bad_users").alias("bad_users")
    )


def add_acts(*rows: DataFrame) -> DataFrame:
    every = _union(rows)
    return every.groupBy("user_id").agg(
        *(F.sum(c).alias(c) for c in ("total_event_count", "event_rows", "bad_events")),
        *(F.max(c).alias(c) for _, c in facts.STAGES),
        F.min("first_event").alias("first_event"),
        *(F.bit_or(f"{PREFIX}{s}").alias(f"{PREFIX}{s}") for s in slots_in(every.columns)),
    )


def add_bills(*rows: DataFrame) -> DataFrame:
    def total(c: str):  # as wide as one relation's sum
        return F.sum(c).cast("decimal(38,8)").alias(c)

    return _union(rows).groupBy("user_id").agg(total("rev"), total("annual_rev"), F.sum("n_subs").alias("n_subs"), F.sum("bad_bills").alias("bad_bills"))


def _union(rows: tuple[DataFrame, ...]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"))


class ModelState:
    """Kept state below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _table(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def covered(self) -> list[File]:
        """The files that the newest version covers."""
        if snapshots.version(self.spark, self._table("covered")) is None:
            return []
        return sorted(File(*r) for r in snapshots.read(self.spark, self._table("covered")).collect())  # a row a file, as ``listed``

    def part(self, name: str) -> DataFrame | None:
        """Kept rows of the newest version."""
        found = snapshots.version(self.spark, self._table("covered"))
        return None if found is None else snapshots.read(self.spark, self._table(name), found.notes[name])

    def update(self, base_dir: str) -> list[File]:
        """Bring the state to the files below ``base_dir``; returns those that were read."""
        with run_folder(self.spark):
            return self._update(base_dir)

    def _update(self, base_dir: str) -> list[File]:
        now, known = listed(self.spark, base_dir), self.covered()
        fresh = bool(set(known) - set(now)) or not known
        kept = {name: None if fresh else self.part(name) for name in PARTS}
        new = now if fresh else sorted(set(now) - set(known))
        if not new and not fresh:
            return []
        users, events, bills = (_read(self.spark, r, new) for r in RELATIONS)
        first, last = events.agg(F.min(month_index(F.col("event_date"))), F.max(month_index(F.col("event_date")))).first()
        rows = {"people": facts.people_rows(users), "acts": facts.act_rows(events, slots_of(first, last)), "bills": facts.bill_rows(bills)}
        add = {"people": add_people, "acts": add_acts, "bills": add_bills}
        made = {name: snapshots.write(add[name](*(r for r in (kept[name], rows[name]) if r is not None)), self._table(name)) for name in add}
        made |= self._early(kept, made, users, events, now)
        notes = {name: v.number for name, v in made.items()}
        files = self.spark.createDataFrame([tuple(f) for f in now], FILES)
        snapshots.write(files.coalesce(1), self._table("covered"), notes)
        return new

    def _early(self, kept: dict, made: dict, users: DataFrame, events: DataFrame, now: list[File]) -> dict:
        """Details of the users who break the rule: those kept, the new files' rows for them, and for users who
        break it only now the rows of all files."""
        spark = self.spark
        people, acts = (snapshots.read(spark, self._table(n), made[n].number) for n in ("people", "acts"))
        last = people.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(F.max("last_signup").alias("last_signup"))
        # none of these is small: their files hold many rows in few bytes, so no join may broadcast one
        broken = last.join(acts.select("user_id", "first_event").hint("merge"), "user_id").where(F.col("first_event") < F.col("last_signup")).select("user_id")
        broken = stored(broken, "broken-users")
        old = kept["early_signups"]
        before = broken.limit(0) if old is None else old.select("user_id").distinct()
        newly = stored(broken.join(before.hint("merge"), "user_id", "left_anti"), "newly-broken")
        dates = [(before, users, events)]
        if not newly.isEmpty():
            every = {r: _read(spark, r, now) for r in RELATIONS}
            dates.append((newly, every["users"], every["events"]))

        def detail(column: str, index: int, name: str) -> DataFrame:
            parts = [] if kept[name] is None else [kept[name]]
            for who, *relations in dates:
                own = relations[index].where(F.col(column).isNotNull()).join(who.hint("merge"), "user_id", "left_semi")
                parts.append(own.select("user_id", column, F.lit(1).cast("long").alias("n")))
            return _counted(_union(tuple(parts)), "user_id", column)

        wanted = {"early_signups": ("signup_date", 0), "early_events": ("event_date", 1)}
        return {name: snapshots.write(detail(c, i, name), self._table(name)) for name, (c, i) in wanted.items()}

    def early(self) -> DataFrame:
        """One row, invalid_date_count."""
        signups = self.part("early_signups").withColumnRenamed("n", "copies")
        return quality.early_pairs(signups, self.part("early_events"))

    def analyses(self) -> summary.Analyses:
        """Every section of the summary, from the state alone."""
        if not snapshots.versions(self.spark, self._table("covered")):
            raise LookupError(f"{self.folder} holds no state yet")
        return summary.Analyses(None, facts.facts_of(self.part("people"), self.part("acts"), self.part("bills")), self.early())

    def kpi_summary(self) -> DataFrame:
        return summary.kpi_summary(None, self.analyses())

    def expire(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions."""
        for name in ("covered", *PARTS):
            snapshots.expire(self.spark, self._table(name), keep)


def in_two_steps(model: Model, folder: str) -> ModelState:
    """The state of ``model``, written below ``folder`` as files in two steps: most rows, then those of some users and
    some rows of all others."""
    spark = model.users.sparkSession
    base = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    state = ModelState(spark, f"{base}/state")
    late = F.coalesce(F.pmod(F.xxhash64("user_id"), F.lit(5)) == 0, F.lit(False))
    some = {"users": late, "events": late | (F.dayofmonth("event_date") == 7), "subscriptions": F.coalesce(F.dayofmonth("subscribed_date") > 20, F.lit(False))}
    for step in (False, True):
        for name, relation in zip(RELATIONS, model):
            relation.where(F.coalesce(some[name], F.lit(False)) == step).write.mode("append").parquet(f"{base}/model/{name}")
        state.update(f"{base}/model")
    return state
