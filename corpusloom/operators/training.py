"""Training on tables: gradients as partial sums in Spark, the optimiser's state on the driver, checkpoints as Parquet."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..sources.readers import path_exists
from .corpus import shuffled_batches

IGNORE = -100


@dataclass
class Schedule:
    """The learning rate of a step: linear warm-up, then half a cosine; its state goes into checkpoints."""

    base: float
    warmup: int
    steps: int
    current: int = 0

    def lr(self) -> float:
        if self.current < self.warmup:
            return self.base * self.current / max(1, self.warmup)
        done = min(1.0, (self.current - self.warmup) / max(1, self.steps - self.warmup))
        return self.base * 0.5 * (1 + math.cos(math.pi * done))

    def state(self) -> dict:
        return {"base": self.base, "warmup": self.warmup, "steps": self.steps, "current": self.current}

    @classmethod
    def of(cls, state: dict) -> Schedule:
        return cls(**state)


@dataclass
class AdamW:
    """Adam with decay apart from the gradient, over named arrays. Gradients of a total norm over `clip` are scaled down to it."""

    decay: float = 0.01
    clip: float = 1.0
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    count: int = 0
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray], lr: float) -> bool:
        """Changes params; a gradient that isn't finite changes nothing and gives False."""
        norm = math.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        if not math.isfinite(norm):
            return False
        scale = min(1.0, self.clip / (norm + 1e-6)) if self.clip > 0 else 1.0
        self.count += 1
        a, b = self.betas
        for name, g in grads.items():
            g = g * scale
            m = self.first[name] = a * self.first.get(name, 0.0) + (1 - a) * g
            v = self.second[name] = b * self.second.get(name, 0.0) + (1 - b) * g * g
            params[name] = params[name] * (1 - lr * self.decay) - lr * (m / (1 - a**self.count)) / (np.sqrt(v / (1 - b**self.count)) + self.eps)
        return True


def linear_model(n_features: int, n_classes: int) -> dict[str, np.ndarray]:
    """A layer of logits, w x + b, at zero."""
    return {"w": np.zeros((n_classes, n_features)), "b": np.zeros(n_classes)}


def gradients(rows: DataFrame, features: str, label: str, params: dict[str, np.ndarray], ignore: int = IGNORE) -> tuple[dict[str, np.ndarray], float, int]:
    """Mean gradients of the cross entropy, mean loss and count, over rows whose label isn't `ignore`. Each task sums its rows; the sums, as many numbers as the model
    has, meet in one aggregate. Labels outside the classes fail the job."""
    n_classes, n_features = params["w"].shape
    w, b = params["w"], params["b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gw, gb, loss, n = np.zeros_like(w), np.zeros_like(b), 0.0, 0
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            x = np.array(batch.column(0).to_pylist(), dtype=np.float64).reshape(len(y), -1)
            x, y = x[y != ignore], y[y != ignore]
            if not len(y):
                continue
            if y.min() < 0 or y.max() >= n_classes:
                raise IndexError(f"label out of range: {int(y.max())}")
            z = x @ w.T + b
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            total = p.sum(axis=1)
            loss += float((np.log(total) - z[np.arange(len(y)), y]).sum())
            p /= total[:, None]
            p[np.arange(len(y)), y] -= 1
            gw += p.T @ x
            gb += p.sum(axis=0)
            n += len(y)
        flat = np.concatenate([gw.ravel(), gb, [loss, n]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["at", "value"])

    sums = np.zeros(n_classes * n_features + n_classes + 2)
    part = rows.filter(F.col(label).isNotNull() & F.col(features).isNotNull()).select(F.col(features).cast("array<double>"), F.col(label).cast("long")).mapInArrow(run, "at int, value double")
    for at, value in part.groupBy("at").agg(F.sum("value")).collect():  # as many rows as the model has numbers
        sums[at] = value
    n = int(sums[-1])
    grad = sums[:-2] / max(1, n)
    return {"w": grad[: w.size].reshape(w.shape), "b": grad[w.size :]}, float(sums[-2]) / n if n else float("nan"), n


@dataclass
class Training:
    """A model in training. step() takes the gradients of one micro-batch; every `accumulate`-th of them the optimiser steps with their mean."""

    params: dict[str, np.ndarray]
    schedule: Schedule
    optimiser: AdamW = field(default_factory=AdamW)
    accumulate: int = 1
    best_loss: float = float("inf")
    held: list[tuple[dict[str, np.ndarray], float]] = field(default_factory=list)

    def step(self, rows: DataFrame, features: str, label: str) -> dict:
        grads, loss, _ = gradients(rows, features, label, self.params)
        self.held.append((grads, loss))
        mean = sum(x for _, x in self.held) / len(self.held)
        if len(self.held) < self.accumulate:
            return {"step": self.schedule.current, "loss": mean, "learning_rate": self.schedule.lr(), "step_performed": False}
        ok = self.optimiser.step(self.params, {k: sum(g[k] for g, _ in self.held) / len(self.held) for k in self.params}, self.schedule.lr())
        self.held = []
        self.schedule.current += 1
        self.best_loss = min(self.best_loss, mean) if math.isfinite(mean) else self.best_loss
        return {"step": self.schedule.current, "loss": mean, "learning_rate": self.schedule.lr(), "step_performed": ok}


def train(rows: DataFrame, key: str, features: str, label: str, training: Training, batch: int, seed: str = "0", log: Callable[[dict], None] | None = None, save: tuple[str, int] | None = None) -> list[dict]:
    """Goes through the rows in batches of a seeded shuffle, epoch after epoch, until the schedule ends, and returns the records of all steps (as many as
    the schedule has). save: a folder and every how many steps a checkpoint goes there."""
    records: list[dict] = []
    epoch = 0
    while training.schedule.current < training.schedule.steps:
        order = shuffled_batches(rows, key, batch, f"{seed}:{epoch}").cache()
        n = (order.agg(F.max("batch_no")).first()[0] or 0) + 1
        for at in range(n):
            if training.schedule.current >= training.schedule.steps:
                break
            part = rows.join(order.filter(F.col("batch_no") == at).select(key), key, "left_semi")
            records.append(training.step(part, features, label))
            if log:
                log(records[-1])
            if save and records[-1]["step_performed"] and training.schedule.current % save[1] == 0:
                save_checkpoint(rows.sparkSession, save[0], training)
        order.unpersist()
        epoch += 1
    return records


def predicted(rows: DataFrame, features: str, params: dict[str, np.ndarray]) -> DataFrame:
    """rows with logits, an array of doubles."""
    w, b = params["w"], params["b"]
    layer = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in w])
    bias = F.array(*[F.lit(float(v)) for v in b])
    return rows.withColumn("logits", F.zip_with(A.linear(F.col(features).cast("array<double>"), layer), bias, lambda x, y: x + y))


def save_checkpoint(spark: SparkSession, root: str, training: Training) -> str:
    """Arrays by row and the state as JSON, in a folder of the step; it counts once its state is written, which comes last."""
    path = f"{root}/step_{training.schedule.current}"
    arrays = {**training.params, **{f"first.{k}": v for k, v in training.optimiser.first.items()}, **{f"second.{k}": v for k, v in training.optimiser.second.items()}}
    rows = [(name, list(a.shape), i, [float(v) for v in row]) for name, a in arrays.items() for i, row in enumerate(np.atleast_2d(a))]
    spark.createDataFrame(rows, "name string, shape array<int>, row int, vals array<double>").write.mode("overwrite").parquet(f"{path}/arrays")
    state = {"schedule": training.schedule.state(), "count": training.optimiser.count, "best_loss": training.best_loss, "accumulate": training.accumulate}
    spark.createDataFrame([(json.dumps(state),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")
    return path


def load_checkpoint(spark: SparkSession, path: str) -> Training:
    if not path_exists(spark, f"{path}/state/_SUCCESS"):
        raise FileNotFoundError(f"no complete checkpoint at {path}")
    state = json.loads(spark.read.text(f"{path}/state").first()[0])
    found: dict[str, dict[int, list[float]]] = {}
    shape = {}
    for r in spark.read.parquet(f"{path}/arrays").collect():  # the model
        found.setdefault(r["name"], {})[r["row"]] = r["vals"]
        shape[r["name"]] = r["shape"]
    arrays = {k: np.array([v[i] for i in sorted(v)]).reshape(shape[k]) for k, v in found.items()}
    opt = AdamW(count=state["count"], first={k[6:]: v for k, v in arrays.items() if k.startswith("first.")}, second={k[7:]: v for k, v in arrays.items() if k.startswith("second.")})
    return Training({k: v for k, v in arrays.items() if "." not in k}, Schedule.of(state["schedule"]), opt, state["accumulate"], state["best_loss"])


def timed(evaluate: Callable[[], DataFrame], tokens: str = "n_tokens", clock: Callable[[], float] = time.perf_counter) -> dict:
    """The one row of an evaluation, with eval_time_seconds and tokens_per_second."""
    began = clock()
    row = evaluate().first().asDict()
    took = clock() - began
    return row | {"eval_time_seconds": took, "tokens_per_second": (row[tokens] or 0) / took if took > 0 else 0.0}


def throughput_grid(spark: SparkSession, seqs: list[int], batches: list[int], run: Callable[[int, int], None], repeats: int = 3, clock: Callable[[], float] = time.perf_counter) -> DataFrame:
    """seq, batch, seconds (the least of the repeats after one warm-up), tokens_per_second of a step that run() takes."""
    rows = []
    for seq in seqs:
        for batch in batches:
            run(seq, batch)
            took = []
            for _ in range(repeats):
                began = clock()
                run(seq, batch)
                took.append(clock() - began)
            rows.append((seq, batch, min(took), seq * batch / max(min(took), 1e-9)))
    return spark.createDataFrame(rows, "seq int, batch int, seconds double, tokens_per_second double")
