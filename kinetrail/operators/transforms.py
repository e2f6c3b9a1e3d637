"""Row and episode transforms: functions of columns with names mapped in and out, chained, and applied to datasets."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowTransform:
    """``function`` takes columns by keyword and returns a dict of columns.

    inputs: parameter to column, where names differ; a column that a table lacks takes the
    parameter's default, or null with ``missing_as_null``. outputs: returned name to column.
    With ``keep_inputs`` the other columns stay, else only the returned ones and ``keep``.
    """

    function: Callable[..., dict[str, Column]]
    inputs: Mapping[str, str] = field(default_factory=dict)
    outputs: Mapping[str, str] = field(default_factory=dict)
    keep_inputs: bool = True
    keep: tuple[str, ...] = ()
    missing_as_null: bool = False
    returns: tuple[str, ...] | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        given = {}
        for name, parameter in inspect.signature(self.function).parameters.items():
            column = self.inputs.get(name, name)
            if column in df.columns:
                given[name] = df[column]
            elif parameter.default is not inspect.Parameter.empty:
                given[name] = parameter.default
            elif self.missing_as_null:
                given[name] = F.lit(None)
            else:
                raise ValueError(f"no column {column} for {name}")
        made = self.function(**given)
        if self.returns is not None and set(made) != set(self.returns):
            raise ValueError(f"{sorted(made)} returned, {sorted(self.returns)} announced")
        named = {self.outputs.get(k, k): c for k, c in made.items()}
        if self.keep_inputs:
            return df.withColumns(named)
        return df.select(*self.keep, *[c.alias(k) for k, c in named.items()])

    def __add__(self, other: RowTransform | Chain) -> Chain:
        return Chain((self,)) + other


@dataclass(frozen=True)
class Chain:
    """Transforms one after the other; nested chains are laid flat."""

    steps: tuple[Callable[[DataFrame], DataFrame], ...] = ()

    def __call__(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = df.transform(step)
        return df

    def __add__(self, other: RowTransform | Chain | Callable[[DataFrame], DataFrame]) -> Chain:
        return Chain(self.steps + (other.steps if isinstance(other, Chain) else (other,)))


def same(df: DataFrame) -> DataFrame:
    return df


def added(**constants) -> Callable[[DataFrame], DataFrame]:
    """Constant columns."""
    return lambda df: df.withColumns({k: F.lit(v) for k, v in constants.items()})


def cast(kinds: Mapping[str, str], strict: bool = True) -> Callable[[DataFrame], DataFrame]:
    """Columns cast by name; without ``strict``, names that the table lacks are passed over."""

    def do(df: DataFrame) -> DataFrame:
        if strict and (lost := set(kinds) - set(df.columns)):
            raise ValueError(f"no columns {sorted(lost)}")
        return df.withColumns({k: df[k].cast(v) for k, v in kinds.items() if k in df.columns})

    return do


def unsqueezed(*names: str) -> Callable[[DataFrame], DataFrame]:
    """Each column as an array of itself."""
    return lambda df: df.withColumns({n: F.array(n) for n in names})


def scaled(scale: float, shift: float) -> Callable[[DataFrame], DataFrame]:
    """Attaches the scale and shift of a robot's joints."""
    return added(scale=float(scale), shift=float(shift))


@dataclass(frozen=True)
class EpisodeTransform:
    """What becomes of a dataset's episodes and frames.

    keep: predicate on episodes; episodes without it go, with their frames. episode, frame:
    transforms of the tables; new columns evolve the schema. Indices and times must stay as they are.
    """

    keep: Column | None = None
    episode: Callable[[DataFrame], DataFrame] = same
    frame: Callable[[DataFrame], DataFrame] = same
    immutable: tuple[str, ...] = ("index", "episode_index", "frame_index")

    def __call__(self, dataset):
        episodes, frames = dataset.episodes, dataset.frames
        if self.keep is not None:
            episodes = episodes.where(self.keep)
            frames = frames.join(episodes.select(F.col("episode_index").alias("_kept")), F.col("episode_index") == F.col("_kept"), "left_semi")
        made = self.frame(frames)
        if lost := [c for c in self.immutable if c in frames.columns and c not in made.columns]:
            raise ValueError(f"a frame transform must keep {lost}")
        return replace(dataset, episodes=self.episode(episodes), frames=made)


def task_names(names: Mapping[str, str], task: Column) -> Column:
    """A task's canonical name: lower case, blanks as one underscore, then by the map where it has one."""
    plain = F.regexp_replace(F.lower(F.trim(task)), r"\s+", "_")
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map().cast("map<string,string>")
    return F.coalesce(F.try_element_at(table, plain), plain)


def table_order(references: Mapping[str, set[str]]) -> list[str]:
    """Table names so that each comes after those it refers to; cycles are refused."""
    left, out = {t: set(r) & set(references) for t, r in references.items()}, []
    while left:
        free = sorted(t for t, r in left.items() if not r)
        if not free:
            raise ValueError(f"references go round among {sorted(left)}")
        out += free
        left = {t: r - set(free) for t, r in left.items() if t not in free}
    return out
