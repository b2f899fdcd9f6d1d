"""A command as a graph of steps: each writes a table, and runs only when what it is made of has changed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..run_log import RunLog


@dataclass(frozen=True)
class Step:
    """name: also the output's folder; make: from the outputs of needs, by name, to the step's table.

    inputs are paths (globs as Spark reads them) that make reads; version changes when make does; counts are
    aggregates over the output that go to the run log; save writes in another form than Parquet, which later steps cannot need.
    """

    name: str
    make: Callable[[dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    inputs: tuple[str, ...] = ()
    version: str = "1"
    counts: dict[str, Column] = field(default_factory=dict)
    save: Callable[[DataFrame, str], None] | None = None


def in_order(steps: Sequence[Step]) -> list[Step]:
    """Steps so that each comes after what it needs, else in the given order."""
    by_name, out = {s.name: s for s in steps}, []

    def visit(step: Step, above: tuple[str, ...]) -> None:
        if step.name in above:
            raise ValueError(f"steps need each other: {' > '.join([*above, step.name])}")
        for need in step.needs:
            visit(by_name[need], (*above, step.name))
        if step not in out:
            out.append(step)

    for step in steps:
        visit(step, ())
    return out


def with_needs(steps: Sequence[Step], chosen: Sequence[str]) -> set[str]:
    """chosen and all that they need, directly or not."""
    by_name, out = {s.name: s for s in steps}, set()
    left = list(chosen)
    while left:
        name = left.pop()
        if name not in by_name:
            raise ValueError(f"no step {name}; there are {', '.join(by_name)}")
        if name not in out:
            out.add(name)
            left += by_name[name].needs
    return out


def input_state(spark: SparkSession, paths: Sequence[str]) -> str:
    """A digest of the names, lengths and times of the files, whatever their order; contents are not read, and only a sum comes back."""
    if not paths:
        return "-"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    got = files.agg(F.count(F.lit(1)), F.sum(F.xxhash64("path", "length", F.unix_micros("modificationTime")).cast("decimal(38,0)"))).first()
    return f"{got[0]}:{got[1]}"


class Runner:
    """Steps over an output folder; folder/_steps has the fingerprint of what each table there was made of."""

    def __init__(self, spark: SparkSession, steps: Sequence[Step], folder: str, chosen: Sequence[str] = (), force: bool = False):
        self.spark, self.steps, self.folder, self.force = spark, in_order(steps), folder.rstrip("/"), force
        self.chosen = with_needs(steps, chosen or [s.name for s in steps])
        self.store = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _noted(self, name: str) -> str | None:
        """The fingerprint of the step's table; none if the table is not whole."""
        note = self._path(f"_steps/{name}")
        if not self.store.exists(note) or not self.store.exists(self._path(f"{name}/_SUCCESS")):
            return None
        return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(self.store.open(note), "UTF-8"))["fingerprint"]

    def _note(self, name: str, fingerprint: str) -> None:
        out = self.store.create(self._path(f"_steps/{name}"), True)
        out.write(json.dumps({"fingerprint": fingerprint}).encode())
        out.close()

    def fingerprints(self) -> dict[str, str]:
        """Of each step: its name, version and inputs, and the fingerprints of what it needs."""
        out: dict[str, str] = {}
        states: dict[tuple[str, ...], str] = {}
        for s in self.steps:
            if s.name in self.chosen:
                if s.inputs not in states:
                    states[s.inputs] = input_state(self.spark, s.inputs)
                parts = [s.name, s.version, states[s.inputs], *[out[n] for n in s.needs]]
                out[s.name] = hashlib.sha256("\n".join(parts).encode()).hexdigest()
        return out

    def plan(self) -> Iterator[tuple[Step, str, str, str]]:
        """step, run or skip, reason and fingerprint, in order."""
        prints, runs = self.fingerprints(), set()
        for s in self.steps:
            if s.name not in self.chosen:
                continue
            noted = self._noted(s.name)
            if self.force:
                why = "forced"
            elif noted is None:
                why = "new"
            elif any(n in runs for n in s.needs):
                why = "after " + ", ".join(n for n in s.needs if n in runs)
            else:
                why = "changed" if noted != prints[s.name] else ""
            if why:
                runs.add(s.name)
            yield s, "run" if why else "skip", why or "unchanged", prints[s.name]

    def dry_run(self) -> list[str]:
        return [f"{s.name}: {what} ({why})" for s, what, why, _ in self.plan()]

    def run(self, log: RunLog) -> bool:
        """Run what the plan says; a step that fails blocks those that need it, and the others go on.  Whether all ended well."""
        bad: set[str] = set()
        made: dict[str, DataFrame] = {}
        for s, what, why, fingerprint in list(self.plan()):
            if lost := [n for n in s.needs if n in bad]:
                bad.add(s.name)
                log.skip(s.name, "BLOCKED", f"{', '.join(lost)} failed")
                continue
            if what == "skip":
                log.skip(s.name, "SKIPPED", why)
                continue
            with log.step(s.name, stop=False) as step:
                step.detail = why
                # A table whose making is cut short must not pass for whole.
                self.store.delete(self._path(f"_steps/{s.name}"), False)
                df = s.make({n: self._read(n, made) for n in s.needs})
                if s.save:
                    s.save(df, f"{self.folder}/{s.name}")
                else:
                    made[s.name] = step.write(df, f"{self.folder}/{s.name}", **s.counts)
                self._note(s.name, fingerprint)
            if log.rows[-1][3] == "FAILED":
                bad.add(s.name)
        return not bad

    def _read(self, name: str, made: dict[str, DataFrame]) -> DataFrame:
        if name not in made:
            made[name] = self.spark.read.parquet(f"{self.folder}/{name}")
        return made[name]
