"""Hyper-parameter search by particle swarm: positions move on the driver, all candidates of a generation are scored in one Spark job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.spec import StreamSpec

#: A particle's inertia, pull to its own best and to the swarm's best.
INERTIA, OWN, SOCIAL = 0.25, 0.25, 1.0


@dataclass(frozen=True, slots=True)
class Range:
    """A number from low to high, in steps if step is given; whole: an integer."""

    low: float
    high: float
    step: float = 0.0
    whole: bool = False

    def snapped(self, x: float) -> float:
        x = self.low + round((x - self.low) / self.step) * self.step if self.step else x
        x = min(max(x, self.low), self.high)
        return int(round(x)) if self.whole else float(x)


#: Fixed value: how far above the worst mean error a choice's weight begins.
HEADROOM = 1.1


@dataclass(frozen=True, slots=True)
class Choice:
    """One of some values; those that scored well are drawn more often."""

    values: tuple

    def drawn(self, rng: np.random.Generator, history: list[tuple[object, float]]):
        means = [np.mean([e for v, e in history if v == value] or [0.0]) for value in self.values]
        weight = HEADROOM * max(means) - np.array(means)
        return self.values[rng.choice(len(self.values), p=weight / weight.sum() if weight.sum() > 0 else None)]


@dataclass(frozen=True, slots=True)
class EncoderVariable:
    """An encoder whose parameters vary: its fixed ones, and those that are variables."""

    column: str
    kind: str
    fixed: dict
    varied: dict[str, Range | Choice]

    def variables(self, name: str) -> dict[str, Range | Choice]:
        """The variables that the swarm moves, as name.parameter."""
        return {f"{name}.{k}": v for k, v in self.varied.items()}

    def definition(self, name: str, place: dict) -> dict:
        """The encoder's definition at a place of the swarm."""
        return {"fieldname": self.column, "type": self.kind, **self.fixed, **{k: place[f"{name}.{k}"] for k in self.varied}}


def apart(low: float, high: float, others: list[float]) -> float:
    """Where a particle is least near the others: of a grid of four places for each of them, the one of the least sum of Gaussian falloffs a step wide (the first on a tie)."""
    if low == high or not others:
        return low
    step = (high - low) / (4 * len(others))
    places = low + step * np.arange(4 * len(others) + 1)
    return float(places[np.exp(-(((places[:, None] - np.array(others)) / step) ** 2)).sum(1).argmin()])


@dataclass(slots=True)
class Swarm:
    """Particles over named variables. score(candidates) gives a DataFrame of candidate and error.

    patience: the search ends when the best error has stayed the same for so many generations.
    """

    variables: dict[str, Range | Choice]
    particles: int = 5
    generations: int = 4
    seed: int = 42
    patience: int | None = None
    history: list[dict] = field(default_factory=list)

    def run(self, spark: SparkSession, score: Callable[[DataFrame], DataFrame], keep: Callable[[dict], bool] = lambda p: True, told: Callable[[int, float], None] = lambda g, best: None) -> DataFrame:
        """All candidates with their errors: candidate, generation, particle, the variables, error. keep refuses candidates before they are scored; told hears each generation's best error."""
        rng = np.random.default_rng(self.seed)
        place = [{k: v.snapped(rng.uniform(v.low, v.high)) if isinstance(v, Range) else v.values[i % len(v.values)] for k, v in self.variables.items()} for i in range(self.particles)]
        speed = [{k: rng.uniform(-0.2, 0.2) * (v.high - v.low) for k, v in self.variables.items() if isinstance(v, Range)} for _ in place]
        own: list[tuple[float, dict]] = [(float("inf"), p) for p in place]
        known: dict[tuple, float] = {}
        bests: list[float] = []
        for g in range(self.generations):
            fresh = {tuple(p.values()): p for p in place if tuple(p.values()) not in known and keep(p)}
            if fresh:
                rows = [(i, *p.values()) for i, p in enumerate(fresh.values())]
                done = {r["candidate"]: r["error"] for r in score(spark.createDataFrame(rows, ["candidate", *self.variables])).collect()}
                known |= {key: done.get(i, float("inf")) for i, key in enumerate(fresh)}
            for i, p in enumerate(place):
                error = known.get(tuple(p.values()), float("inf"))
                self.history.append({"candidate": len(self.history), "generation": g, "particle": i, **p, "error": error})
                own[i] = min(own[i], (error, p), key=lambda x: x[0])
            bests.append(min(own, key=lambda x: x[0])[0])
            told(g, bests[-1])
            if self.patience and len(bests) > self.patience and bests[-1] == bests[-1 - self.patience]:
                break
            self._move(place, speed, own, rng)
        return spark.createDataFrame([tuple(h.values()) for h in self.history], list(self.history[0]))

    def _move(self, place: list[dict], speed: list[dict], own: list[tuple[float, dict]], rng: np.random.Generator) -> None:
        """Every particle to its next place."""
        top = min(own, key=lambda x: x[0])[1]
        for i, p in enumerate(place):
            new = {}
            for k, v in self.variables.items():
                if isinstance(v, Choice):
                    new[k] = v.drawn(rng, [(h[k], h["error"]) for h in self.history])
                    continue
                u = rng.uniform(0.8, 1.2, 2)
                speed[i][k] = INERTIA * speed[i][k] + OWN * u[0] * (own[i][1][k] - p[k]) + SOCIAL * u[1] * (top[k] - p[k])
                new[k] = v.snapped(p[k] + speed[i][k])
            place[i] = new


def ended(bests: dict[str, list[float]], generation: int, window: int = 2, most: int = 10) -> set[str]:
    """Of swarms' best errors by generation, those that stop: over `most` generations, no better for `window` generations, or worse than the best by more than 1 / (generation + 1) of it."""
    known = {k: b for k, b in bests.items() if len(b) > generation}
    least = min((b[generation] for b in known.values()), default=0.0)
    poor = {k for k, b in known.items() if b[generation] > (1 + 1 / (generation + 1)) * least}
    mature = {k for k, b in bests.items() if len(b) >= window and min(b) == min(b[: len(b) - window + 1])}
    return poor | mature | {k for k, b in bests.items() if len(b) > most}


def next_sets(results: DataFrame, field: str, sets: list[tuple[str, ...]], base: float, least: float = 0.2, branches: int = 5) -> list[tuple[str, ...]]:
    """The field sets of the next sprint: the `branches` best ones so far, each with one more field whose own contribution is `least` per cent or more. results has an error for each set's name (its fields, comma-joined)."""
    errors = {r[field]: r["error"] for r in results.groupBy(field).agg(F.min("error").alias("error")).collect()}
    single = [s for s in errors if "," not in s]
    useful = [s for s in single if 100 * (base - errors[s]) / base >= least]
    best = sorted((s for s in sets if ",".join(s) in errors), key=lambda s: (errors[",".join(s)], s))[:branches]
    return sorted({tuple(sorted({*s, f})) for s in best for f in useful if f not in s})


def useless(errors: dict[str, float], best: str) -> set[str]:
    """Swarms that lack a field of the best one and do worse than it."""
    fields = set(best.split(","))
    return {k for k, e in errors.items() if e > errors[best] and not fields <= set(k.split(","))}


#: Particles by the size of a search.
PARTICLES = {"small": 3, "medium": 5, "large": 15}


def generated(description: dict) -> dict:
    """From what a user says of a search ({includedFields: [{fieldName, fieldType, minValue, maxValue}], inferenceArgs: {predictedField, predictionSteps}, swarmSize}): encoders by field, metric and particles."""
    encoders: dict[str, EncoderVariable] = {}
    for f in description["includedFields"]:
        name, kind = f["fieldName"], f["fieldType"]
        if kind in ("int", "float"):
            encoders[name] = EncoderVariable(name, "scalar", {"w": 21, "low": f["minValue"], "high": f["maxValue"]}, {"n": Range(22, 521, 1, whole=True)})
        elif kind == "string":
            encoders[name] = EncoderVariable(name, "category", {"w": 21, "categories": tuple(f["categories"])}, {})
        elif kind == "datetime":
            encoders[name] = EncoderVariable(name, "date", {"weekend": 21}, {"time_of_day": Choice((0, 21)), "day_of_week": Choice((0, 21))})
        else:
            raise ValueError(f"no such field type: {kind}")
    predicted = description["inferenceArgs"]["predictedField"]
    numeric = next(f["fieldType"] for f in description["includedFields"] if f["fieldName"] == predicted) in ("int", "float")
    steps = description["inferenceArgs"].get("predictionSteps", [1])
    return {"encoders": encoders, "metrics": [("alt_mape" if numeric else "avg_err", predicted, s) for s in steps], "particles": PARTICLES[description.get("swarmSize", "medium")]}


def smoothing_errors(df: DataFrame, spec: StreamSpec, column: str) -> Callable[[DataFrame], DataFrame]:
    """Scores candidates (candidate, window): the mean absolute error of a moving mean of `window` previous values, all candidates in one pass: one sort by stream, a frame for each."""

    def score(candidates: DataFrame) -> DataFrame:
        asked = [(r["candidate"], int(r["window"])) for r in candidates.select("candidate", "window").collect()]
        frame = lambda n: Window.partitionBy(*spec.keys).orderBy(spec.ts, *spec.order).rowsBetween(-n, -1)
        errors = df.select(*[F.abs(F.col(column) - F.avg(column).over(frame(n))).alias(f"e{i}") for i, (_, n) in enumerate(asked)])
        each = [F.struct(F.lit(c).alias("candidate"), F.avg(f"e{i}").alias("error")) for i, (c, _) in enumerate(asked)]
        return errors.agg(F.array(*each).alias("all")).select(F.explode("all").alias("s")).select("s.*")

    return score


def best(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The candidate of the least error (of each group)."""
    return results.groupBy(*(by or [])).agg(F.min_by("candidate", F.struct("error", "candidate")).alias("candidate"), F.min("error").alias("error"))


def contributions(results: DataFrame, field: str, base: float) -> DataFrame:
    """How much better than the base each field's best candidate is, in per cent."""
    return results.groupBy(field).agg((100 * (F.lit(base) - F.min("error")) / F.lit(base)).alias("contribution"))


def register(results: DataFrame, folder: str, job: str) -> None:
    """Append a job's candidates to the run registry, a Parquet table parted by job; the latest row of a candidate counts."""
    results.withColumns({"job": F.lit(job), "at": F.current_timestamp()}).write.mode("append").partitionBy("job").parquet(folder)


def registered(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(folder)
    w = Window.partitionBy("job", "candidate").orderBy(F.desc("at"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def run_description(spark: SparkSession, description: dict, score: Callable[[DataFrame], DataFrame], generations: int = 4, seed: int = 42) -> tuple[DataFrame, dict]:
    """A search from its description: all candidates, and the encoders' definitions of the best one. score takes candidates whose columns are the encoders' variables (name.parameter as name__parameter)."""
    made = generated(description)
    variables = {k.replace(".", "__"): v for name, e in made["encoders"].items() for k, v in e.variables(name).items()}
    found = Swarm(variables, made["particles"], generations, seed, patience=2).run(spark, score)
    top = found.orderBy("error", "candidate").first().asDict()
    place = {k.replace("__", "."): v for k, v in top.items()}
    return found, {name: e.definition(name, place) for name, e in made["encoders"].items()}
