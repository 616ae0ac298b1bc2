"""Pipelines of named steps from frames to frames, checked when they are put together."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

from tidegrid.sources.store import PanelStore, Variable

Step = Callable[..., DataFrame]


class Pipeline:
    """Each step reads frames by name and makes one; unknown inputs and repeated outputs are rejected."""

    def __init__(self, given: Sequence[str]) -> None:
        self.known, self.steps = set(given), []
        self.given = tuple(given)

    def add(self, step: Step, inputs: Sequence[str], output: str) -> Pipeline:
        if missing := set(inputs) - self.known:
            raise ValueError(f"{output} reads {', '.join(sorted(missing))}, which nothing makes")
        if output in self.known:
            raise ValueError(f"{output} is made already")
        self.known.add(output)
        self.steps.append((step, tuple(inputs), output))
        return self

    def run(self, **frames: DataFrame) -> Mapping[str, DataFrame]:
        """All frames, lazily: nothing is computed until one of them is."""
        if missing := set(self.given) - set(frames):
            raise ValueError(f"not given: {', '.join(sorted(missing))}")
        out = dict(frames)
        for step, inputs, output in self.steps:
            out[output] = step(*[out[i] for i in inputs])
        return out


def store_step(store: PanelStore, variable: Variable, overwrite: bool = True) -> Step:
    """A step that saves its frame (dates that are there are replaced) and gives back what was stored of its dates."""

    def step(df: DataFrame) -> DataFrame:
        store.save(variable, df, overwrite)
        return store.load(variable).join(df.select("date").distinct(), "date", "left_semi")

    return step
