"""Running a pipeline of modules in the background: progress of what runs, and cancelling it.

Each module is a job group of Spark. Its tables are written before the next module starts, so a module's work is done
under its own group; progress comes from Spark's status tracker, and cancelling stops the group's running jobs.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

from fluora.functions.shared import cut
from fluora.plans.pipeline import Context, Module, execute


@dataclass
class Progress:
    """The module that runs, how many are done of how many, and the share of its known tasks that are done."""

    module: str | None
    done: int
    total: int
    tasks: int
    tasks_done: int

    @property
    def share(self) -> float:
        now = self.tasks_done / self.tasks if self.tasks else 0.0
        return (self.done + (now if self.module else 0.0)) / self.total if self.total else 1.0


class Run:
    """A pipeline that runs in a thread of its own."""

    def __init__(self, spark: SparkSession, names: list[str], modules: dict[str, Module], params: dict[str, dict], context: Context | None = None, own_links: dict[str, dict] | None = None, log: Callable[[str], None] = lambda _: None):
        self.spark, self.names, self.context, self.log = spark, list(names), context or Context(), log
        self.params, self.own_links = params, own_links
        self.modules = {n: replace(modules[n], run=self._within(n, modules[n])) for n in names}
        self.id, self.now, self.done = uuid.uuid4().hex, None, 0
        self.succeeded: bool | None = None
        self._cancelled = threading.Event()
        self._thread: threading.Thread | None = None

    def _group(self, name: str) -> str:
        return f"{self.id}-{name}"

    def _within(self, name: str, module: Module) -> Callable[[dict, Context], dict]:
        from inspect import signature

        def run(values: dict[str, Any], context: Context) -> dict[str, Any]:
            self.now = name
            self.spark.sparkContext.setJobGroup(self._group(name), name, interruptOnCancel=True)
            out = module.run(values, context) if len(signature(module.run).parameters) >= 2 else module.run(values)
            out = {k: self._written(v) for k, v in (out or {}).items()}
            self.now, self.done = None, self.done + 1
            return out

        return run

    def _written(self, value: Any) -> Any:
        if self._cancelled.is_set():
            raise InterruptedError("cancelled")
        return cut(value) if isinstance(value, DataFrame) else value

    def start(self) -> Run:
        def work() -> None:
            try:
                self.succeeded = execute(self.names, self.modules, self.params, self.context, self.own_links, self.log, self._cancelled.is_set)
            finally:
                self.now = None
                self.succeeded = bool(self.succeeded)

        self._thread = InheritableThread(target=work, session=self.spark, daemon=True)
        self._thread.start()
        return self

    def progress(self) -> Progress:
        """From the jobs of the running module that Spark has seen so far."""
        tracker, name = self.spark.sparkContext.statusTracker(), self.now
        tasks = done = 0
        for job in tracker.getJobIdsForGroup(self._group(name)) if name else ():
            info = tracker.getJobInfo(job)
            for stage in map(tracker.getStageInfo, info.stageIds) if info else ():
                if stage:
                    tasks, done = tasks + stage.numTasks, done + stage.numCompletedTasks
        return Progress(name, self.done, len(self.names), tasks, done)

    def cancel(self) -> None:
        """Stops the running module's jobs; no later module starts."""
        self._cancelled.set()
        for name in self.names:
            self.spark.sparkContext.cancelJobGroup(self._group(name))

    def wait(self, timeout: float | None = None) -> bool | None:
        """Whether all modules ran; None if the time is over before that is known."""
        self._thread.join(timeout)
        return self.succeeded
