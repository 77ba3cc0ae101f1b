"""Text generation over tables of prompts: any model of next tokens, run in Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A model: from a batch of sequences of ids (none empty) the logits of the token after each, a row for each sequence.
Model = Callable[[list[list[int]]], np.ndarray]
#: The bounds of a request's fields (least, most); null fields are left out of it.
BOUNDS = {"max_new_tokens": (1, 4096), "temperature": (0.0, 2.0), "top_k": (1, 1000), "top_p": (0.0, 1.0), "repetition_penalty": (1.0, 5.0)}
PROMPT_CHARS = (1, 32_768)


class Bigrams:
    """The logarithm of how often a token has followed the last one, plus one. The table of counts has vocab * vocab numbers, whatever the corpus."""

    def __init__(self, counts: np.ndarray):
        self.logits = np.log(counts + 1.0)

    @classmethod
    def fit(cls, seqs: DataFrame, ids: str, vocab: int) -> Bigrams:
        """Counts all neighbours of all sequences; ids outside the vocabulary fail the job."""
        bad = F.filter(ids, lambda i: i.isNull() | (i < 0) | (i >= vocab))
        sure = F.when(F.size(bad) > 0, F.raise_error(F.lit("id out of range")).cast("array<int>")).otherwise(F.col(ids).cast("array<int>"))
        pairs = F.transform(F.sequence(F.lit(1), F.size("s") - 1), lambda i: F.struct(F.get("s", i - 1).alias("a"), F.get("s", i).alias("b")))
        rows = seqs.select(sure.alias("s")).filter(F.size("s") > 1).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").count()
        counts = np.zeros((vocab, vocab))
        for a, b, n in rows.collect():  # vocab * vocab rows at most
            counts[a, b] = n
        return cls(counts)

    def __call__(self, batch: list[list[int]]) -> np.ndarray:
        return self.logits[[s[-1] for s in batch]]


def distribution(logits: np.ndarray, seen: list[int], temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None, penalty: float = 1.0) -> np.ndarray:
    """What the next token is drawn from, by the priorities of evaluate.sampler."""
    x = np.array(logits, dtype=np.float64)
    if penalty > 1:
        at = np.unique(np.array(seen, dtype=np.int64))
        x[at] = np.where(x[at] > 0, x[at] / penalty, x[at] * penalty)
    if temperature == 0:
        return np.eye(len(x))[int(x.argmax())]
    p = np.exp((x - x.max()) / temperature)
    p /= p.sum()
    if top_k:
        p[x < np.sort(x)[-min(top_k, len(x))]] = 0
    elif top_p:
        order = np.argsort(-p, kind="stable")
        p[order[np.cumsum(p[order]) - p[order] > top_p]] = 0
    return p / p.sum()


def _uniform(seed: str, key, step: int) -> float:
    """The same for a row and step, whatever the partition."""
    return int(hashlib.md5(f"{seed}:{key}:{step}".encode()).hexdigest()[:13], 16) / 16**13


def _drawn(p: np.ndarray, u: float) -> int:
    return min(int(np.searchsorted(np.cumsum(p), u * p.sum(), side="right")), int(np.flatnonzero(p)[-1]))


def generated(
    prompts: DataFrame, key: str, ids: str, model: Model, max_new: int = 50, max_len: int = 1 << 30, stop_id: int | None = None, stops: tuple[str, ...] = (), decode: Callable[[list[int]], str] | None = None,
    seed: str = "0", **sampling,
) -> DataFrame:
    """key, ids (the new tokens), stopped (`eos`, `stop`, `max_len` or `length`) of each prompt.

    A prompt keeps its last max_len tokens. Tokens are drawn one after another for all prompts of a batch together, until the stop id comes, any stop string is in the
    decoded text, prompt and new tokens are max_len, or max_new are made. Prompts without tokens, and null ones, get none (`empty`). Rows are apart from each other:
    draws come from the key and the step, and nothing is shuffled.
    """
    if max_new < 1 or max_len < 1:
        raise ValueError("max_new and max_len must be positive")
    if stops and decode is None:
        raise ValueError("stop strings need a decoder")
    distribution(np.zeros(2), [0], **sampling)  # wrong names fail here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            seqs = [list(x or ())[-max_len:] for x in batch.column(1).to_pylist()]
            new: list[list[int]] = [[] for _ in seqs]
            why = ["length" if s else "empty" for s in seqs]
            live = [i for i, s in enumerate(seqs) if s]
            for step in range(max_new):
                if not live:
                    break
                for i, logits in zip(live, model([seqs[i][-max_len:] for i in live]), strict=True):
                    token = _drawn(distribution(logits, seqs[i], **sampling), _uniform(seed, keys[i], step))
                    seqs[i].append(token)
                    new[i].append(token)
                    if step + 1 == max_new:
                        continue
                    if token == stop_id:
                        why[i] = "eos"
                    elif len(seqs[i]) >= max_len:
                        why[i] = "max_len"
                    elif stops and any(s in decode(seqs[i]) for s in stops):
                        why[i] = "stop"
                live = [i for i in live if why[i] == "length"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.list_(pa.int32())), pa.array(why, pa.string())], names=[key, "ids", "stopped"])

    rows = prompts.select(key, F.col(ids).cast("array<int>").alias("_ids"))
    return rows.mapInArrow(run, f"`{key}` {dict(prompts.dtypes)[key]}, ids array<int>, stopped string")


def speculated(prompts: DataFrame, key: str, ids: str, target: Model, draft: Model, gamma: int = 5, max_new: int = 50, temperature: float = 1.0, top_k: int | None = None, top_p: float | None = None, seed: str = "0") -> DataFrame:
    """key, ids (max_new new tokens), rounds, accepted: decoding by drafts.

    A round lets the draft model draw gamma tokens and the target model judge them: a token stays with the chance of its target probability over its
    draft probability; the first that doesn't is drawn anew from what the target has over the draft, and ends the round; if all stay, the
    target adds one. So tokens are distributed as if the target alone had drawn them. Prompts without tokens get none.
    """
    if gamma < 1 or max_new < 1:
        raise ValueError("gamma and max_new must be positive")
    how = {"temperature": temperature, "top_k": top_k, "top_p": top_p}

    def one(k, prompt: list[int]) -> tuple[list[int], int, int]:
        seq, rounds, accepted, draws = list(prompt), 0, 0, 0

        def u() -> float:
            nonlocal draws
            draws += 1
            return _uniform(seed, k, draws)

        while len(seq) - len(prompt) < max_new:
            rounds += 1
            guess, q = list(seq), []
            for _ in range(gamma):
                q.append(distribution(draft([guess])[0], guess, **how))
                guess.append(_drawn(q[-1], u()))
            p = [distribution(x, guess, **how) for x in target([guess[: len(seq) + i] for i in range(gamma + 1)])]
            for i, token in enumerate(guess[len(seq) :]):
                if u() * q[i][token] < p[i][token]:
                    seq.append(token)
                    accepted += 1
                    continue
                over = np.maximum(p[i] - q[i], 0)
                seq.append(_drawn(over if over.sum() > 0 else p[i], u()))
                break
            else:
                seq.append(_drawn(p[gamma], u()))
        return seq[len(prompt) : len(prompt) + max_new], rounds, accepted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(k, x) if x else ([], 0, 0) for k, x in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=[key, "ids", "rounds", "accepted"])

    rows = prompts.select(key, F.col(ids).cast("array<int>").alias("_ids"))
    return rows.mapInArrow(run, f"`{key}` {dict(prompts.dtypes)[key]}, ids array<int>, rounds int, accepted int")


def answered(prompts: DataFrame, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], model: Model, **how) -> DataFrame:
    """From query_id, prompt (retrieval.context_prompts): query_id, prompt, answer: the text that is generated after the prompt."""
    as_ids = F.pandas_udf(lambda x: x.map(encode), "array<int>")
    as_text = F.pandas_udf(lambda x: x.map(lambda v: decode([int(i) for i in v])), "string")
    found = generated(prompts.select("query_id", as_ids("prompt").alias("ids")), "query_id", "ids", model, decode=decode, **how)
    return prompts.join(found.select("query_id", as_text("ids").alias("answer")), "query_id")


def request_problems(requests: DataFrame) -> Column:
    """The names of a request's fields that are out of bounds, in the order of BOUNDS after prompt; fields that the table lacks or that are null are fine but for prompt."""
    n = F.coalesce(F.char_length("prompt"), F.lit(0))
    wrong = [F.when(~n.between(*PROMPT_CHARS), "prompt")]
    for name, (lo, hi) in BOUNDS.items():
        if name in requests.columns:
            low = F.col(name) <= lo if name == "top_p" else F.col(name) < lo
            wrong.append(F.when(low | (F.col(name) > hi), name))
    return F.filter(F.array(*wrong), lambda x: x.isNotNull())
