"""A search over sets of fields in sprints: each set is a swarm of its own, and swarms run side by side.

The first sprint tries each field alone; the next ones add useful fields to the
best sets. A swarm's jobs bear its tag. Whenever a swarm has finished a
generation, those that are out (grown old, poor beside the others, or without a
field of the best and worse than it) are stopped, and the jobs that they have
running are cancelled. Only candidates and their errors reach the driver.
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.search import Choice, Range, Swarm, ended, next_sets, useless

#: (the set's fields, candidates) -> candidate and error.
Score = Callable[[tuple[str, ...], DataFrame], DataFrame]


class Out(Exception):
    """A swarm has been stopped."""


@dataclass(slots=True)
class FieldSearch:
    """variables: what can be varied of each field (names are made <field>__<name>). base: the error without any of the fields, against which contributions are measured."""

    variables: dict[str, dict[str, Range | Choice]]
    base: float
    particles: int = 5
    generations: int = 4
    sprints: int = 3
    branches: int = 5
    least: float = 0.2
    window: int = 2
    seed: int = 42
    #: What happened: sprint, fields, generation, best, event (generation, stopped, cancelled, ended, failed).
    log: list[dict] = field(default_factory=list)

    def run(self, spark: SparkSession, score: Score) -> DataFrame:
        """All candidates: sprint, fields (comma-joined, sorted), candidate (numbered over all), generation, particle, place (JSON of the variables), error."""
        rows: list[tuple] = []
        sets = sorted((f,) for f in self.variables)
        for sprint in range(self.sprints):
            rows += self._sprint(spark, score, sprint, sets)
            found = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "candidate long, sprint int, fields string, generation int, particle int, place string, error double")
            tried = sorted({tuple(r[1].split(",")) for r in rows})
            sets = [s for s in next_sets(found, "fields", tried, self.base, self.least, self.branches) if s not in tried]
            if not sets:
                break
        return found.select("sprint", "fields", "candidate", "generation", "particle", "place", "error")

    def _sprint(self, spark: SparkSession, score: Score, sprint: int, sets: list[tuple[str, ...]]) -> list[tuple]:
        lock, sc = threading.Lock(), spark.sparkContext
        tags = {",".join(s): f"search-{uuid.uuid4().hex}" for s in sets}
        bests: dict[str, list[float]] = {name: [] for name in tags}
        busy, out, failed, rows = set(), set(), [], []

        def note(name: str, event: str) -> None:
            self.log.append({"sprint": sprint, "fields": name, "generation": len(bests[name]) - 1, "best": bests[name][-1] if bests[name] else None, "event": event})

        def judge(name: str, generation: int, best: float) -> None:
            """After a generation of one swarm: who is out now?"""
            with lock:
                bests[name].append(best)
                note(name, "generation")
                gone = ended(bests, generation, self.window, self.generations)
                if sprint and (known := {k: b[-1] for k, b in bests.items() if b}):
                    gone |= useless(known, min(known, key=lambda k: (known[k], k)))
                for other in sorted(gone - out):
                    out.add(other)
                    note(other, "cancelled" if other in busy and other != name else "stopped")
                    if other != name:
                        sc.cancelJobsWithTag(tags[other])
                if name in out:
                    raise Out

        def one(fields: tuple[str, ...], number: int) -> None:
            name = ",".join(fields)
            variables = {f"{f}__{k}": v for f in fields for k, v in self.variables[f].items()}
            swarm = Swarm(variables, self.particles, self.generations, self.seed + 1000 * sprint + number)

            def errors(candidates: DataFrame) -> DataFrame:
                with lock:
                    if name in out:
                        raise Out
                    busy.add(name)
                try:
                    return spark.createDataFrame(score(fields, candidates).collect(), "candidate long, error double")
                finally:
                    with lock:
                        busy.discard(name)

            sc.addJobTag(tags[name])
            try:
                swarm.run(spark, errors, told=lambda g, best: judge(name, g, best))
                note(name, "ended")
            except Exception as e:
                if name not in out:
                    failed.append(e)
                    note(name, "failed")
            finally:
                sc.removeJobTag(tags[name])
            with lock:
                rows.extend((sprint, name, h["generation"], h["particle"], json.dumps({k: h[k] for k in variables}, default=float), float(h["error"])) for h in swarm.history)

        threads = [InheritableThread(target=one, args=(s, i)) for i, s in enumerate(sets)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        if failed:
            raise failed[0]
        return sorted(rows, key=lambda r: (r[1], r[2], r[3]))
