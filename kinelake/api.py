"""A fluent front for the usual pipeline: dataset, windows, statistics, splits, batches."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.operators import batching, geometry, sampling, space, stats, temporal
from kinelake.spec import REGISTRY, DumpSpec, dataset_path

KEYS = ["repo", "episode_index"]


@dataclass(frozen=True)
class Config:
    """Seconds and Hz of a sample, and how its actions are represented."""

    action_length: float = 1.0
    action_freq: float | None = None
    history_length: float = 0.0
    history_freq: float = 10.0
    action_mode: str = "abs"
    rescan: bool = False


@dataclass(frozen=True)
class Dataset:
    """Frames (keys, frame, n, state, action) of a spec; each step returns a new one."""

    spec: DumpSpec
    frames: DataFrame
    config: Config = Config()
    norm: DataFrame | None = None

    def with_config(self, **options) -> Dataset:
        return replace(self, config=replace(self.config, **options))

    @property
    def freq(self) -> float:
        return temporal.locked_frequency(self.resolved, self.spec.fps, self.config.action_freq)

    @property
    def resolved(self):
        return self.spec.resolved(self.config.action_mode)

    def complete(self) -> Dataset:
        """Actions derived from states where the dump has none."""
        s = temporal.native_stride(self.spec.fps, self.freq)
        told = temporal.derived_actions(self.frames.withColumn("_s", space.fit_dim(F.col("state"), self.spec.action_dim)), KEYS, "_s", s, name="_a")
        return replace(self, frames=told.withColumn("action", F.coalesce("action", "_a")).drop("_a", "_s"))

    def windows(self) -> DataFrame:
        """(keys, frame, state, action chunk) in the training space, normalized where statistics are set."""
        c, sp, dim = self.config, self.resolved, self.spec.action_dim
        deltas = temporal.delta_indices(c.action_length, self.freq, self.spec.fps)
        steps = temporal.gather(self.frames, KEYS, deltas, ["action"])
        chunk = steps.groupBy(*KEYS, "frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "action"))), lambda x: x["action"]).alias("action"))
        out = chunk.join(self.frames.select(*KEYS, "frame", "n", "state"), [*KEYS, "frame"])
        if c.action_mode != "abs":
            out = out.withColumn("action", space.to_train(F.col("action").cast("array<array<double>>"), F.col("state").cast("array<double>"), sp, dim))
            out = geometry.eef_chunks(out, "action", "state", sp)
        if self.norm is not None:
            out = stats.normalize_vectors(out, self.norm, "state", "state", space.scaled(sp, self.spec.state_dim, "state"))
            # chunks are scaled cell by cell with the same ranges
            lo, hi = (self._range(k) for k in ("lo", "hi"))
            mask = F.array(*[F.lit(m) for m in space.scaled(sp, dim)])
            cell = lambda x, i: stats.normalize(x.cast("double"), F.get(lo, i), F.get(hi, i), F.coalesce(F.get(mask, i), F.lit(True)))
            out = out.withColumn("action", F.transform("action", lambda a: F.transform(a, cell)))
        if c.history_length > 0:
            past = temporal.timed_history(self.frames, KEYS, self.spec.fps, c.history_length, c.history_freq, ["state"])
            past = past.groupBy(*KEYS, "frame").agg(F.sort_array(F.collect_list(F.struct("k", "state", "valid", "offset"))).alias("_h"))
            pick = lambda f: F.transform("_h", lambda x: x[f])
            out = out.join(past.select(*KEYS, "frame", pick("state").alias("state_history"), pick("valid").alias("history_mask"), pick("offset").alias("history_offsets")), [*KEYS, "frame"])
        return out.withColumn("embodiment_id", F.lit(self.spec.embodiment_id))

    def _range(self, which: str):
        rows = {r["dim"]: r for r in self.norm.filter("field = 'action'").collect()}  # a row per dim
        return F.array(*[F.lit(float(rows[i]["q01" if which == "lo" else "q99"])) for i in sorted(rows)])

    def statistics(self) -> DataFrame:
        """(field, dim, mean, std, min, max, q01, q99, count) of states and of actions in the training space."""
        flat = replace(self, norm=None).with_config(history_length=0.0).windows().select(F.explode("action").alias("action"))
        cells = stats.long_form(flat, [], ["action"]).unionByName(stats.long_form(self.frames, [], ["state"]))
        return stats.moments(cells, ["field", "dim"]).join(stats.quantiles_bounded(cells, ["field", "dim"], {"q01": 0.01, "q99": 0.99}), ["field", "dim"])

    def normalized(self, norm: DataFrame | None = None) -> Dataset:
        return replace(self, norm=self.statistics() if norm is None else norm)

    def split(self, fraction: float, seed: int = 0, parent: str = "episode_index") -> tuple[Dataset, Dataset]:
        """Training and validation data by whole parents; validation takes the statistics of training."""
        held = sampling.holdout(self.frames, parent, fraction, seed)
        train = replace(self, frames=held.filter("not held").drop("held"), norm=None)
        norm = train.statistics() if self.norm is not None else None
        return replace(train, norm=norm), replace(self, frames=held.filter("held").drop("held"), norm=norm)

    def batches(self, size: int, world: int = 1, seed: int = 0, epoch: int = 0, start: int = 0, drop_last: bool = True) -> DataFrame:
        """Windows in the epoch's order with batch, rank and slot, ragged vectors filled per batch."""
        rows = self.windows()
        total = self.frames.count()
        placed = sampling.cursor_batches(sampling.shuffled(rows, [*KEYS, "frame"], seed, epoch), size, world, total, start, drop_last)
        right = [c for c in ("state_history", "history_mask", "history_offsets") if c in placed.columns and c == "state_history"]
        return batching.pad_batches(placed, "batch", ["action", "state"], right)


def dataset(spark: SparkSession, name: str, root: str | None = None, **options) -> Dataset:
    """A registered dump by name: its source's reader, else the repos under its folder."""
    from kinelake.sources import adapters, lerobot

    adapters.attach(REGISTRY)
    source = REGISTRY.get(name)
    folder = dataset_path(name, root)
    if source.frames is not None:
        frames = source.frames(spark, folder)
    else:
        records = lerobot.scan(spark, folder, source.spec)
        frames = lerobot.read_frames(spark, records, source.spec, folder).withColumnRenamed("n_frames", "n")
    return Dataset(source.spec, frames).with_config(**options)


def mixture(parts: list[tuple[Dataset, float]]) -> DataFrame:
    """Windows of several datasets with source and weight."""
    return sampling.mixture([(d.spec.name, w, d.windows()) for d, w in parts])
