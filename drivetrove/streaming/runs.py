"""Tables that a stream adds to batch by batch and that stay cheap to read.

A batch is a run of level 0. As soon as a level has ``fan`` runs, they are merged into one of the next level, so after n batches a reader
opens some ``fan * log(n)`` runs. Which runs make up the tables is said by one commit record: a reader sees whole batches
only, a batch that is seen again is found there and adds nothing, and a merge that dies leaves everything as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from drivetrove.catalog import Commit, commit_if_free, last_commit, vacuum

Tables = dict[str, DataFrame]


class Runs:
    """The tables named by ``schemas`` below ``root``. ``merge`` may leave out rows of several runs that later ones replace. Batches come with
    ascending numbers, as those of one streaming query with its checkpoint do."""

    def __init__(self, root: str, schemas: dict[str, str], merge: Callable[[Tables], Tables], fan: int = 8, keep_seconds: float = 86400):
        self.root, self.schemas, self.merge, self.fan, self.keep_seconds = root, schemas, merge, fan, keep_seconds

    def add(self, spark: SparkSession, batch_id: int, tables: Tables) -> None:
        last = last_commit(spark, self.root)
        if last and any(batch_id <= until for _, until in map(_parse, last.places)):
            return  # the batch is there already
        places = {**(last.places if last else {}), _name(0, batch_id): self._store(tables)}
        version = self._advance(spark, last.version if last else 0, places)
        deep = False
        while crowded := self._crowded(places):
            merged = self._store(self.merge(self._load(spark, [places[n] for n in crowded])))
            level, until = _parse(crowded[-1])
            places = {n: p for n, p in places.items() if n not in crowded} | {_name(level + 1, until): merged}
            version = self._advance(spark, version, places)
            deep = deep or level > 0
        if deep:
            vacuum(spark, self.root, keep=2, older_than_seconds=self.keep_seconds)

    def read(self, spark: SparkSession) -> Tables:
        last = last_commit(spark, self.root)
        return self._load(spark, list(last.places.values()) if last else [])

    def _crowded(self, places: dict[str, str]) -> list[str]:
        """The oldest runs of a level that has enough of them."""
        levels: dict[int, list[str]] = {}
        for name in sorted(places, key=lambda n: _parse(n)[1]):
            levels.setdefault(_parse(name)[0], []).append(name)
        return next((names[:self.fan] for names in levels.values() if len(names) >= self.fan), [])

    def _store(self, tables: Tables) -> str:
        place = f"data/{uuid.uuid4().hex}/run"
        for name in self.schemas:
            tables[name].write.parquet(f"{self.root}/{place}/{name}")
        return place

    def _load(self, spark: SparkSession, places: list[str]) -> Tables:
        return {name: spark.read.schema(schema).parquet(*[f"{self.root}/{p}/{name}" for p in places]) if places
                else spark.createDataFrame([], schema) for name, schema in self.schemas.items()}

    def _advance(self, spark: SparkSession, version: int, places: dict[str, str]) -> int:
        if not commit_if_free(spark, Commit(self.root, version + 1, places)):
            raise RuntimeError(f"another query writes to {self.root}")
        return version + 1


def _name(level: int, until: int) -> str:
    return f"{level}:{until}"


def _parse(name: str) -> tuple[int, int]:
    """Level of a run and its last batch."""
    level, until = name.split(":")
    return int(level), int(until)
