"""Model-in-the-loop operators with injected callables.

The model is not part of this package: callers pass plain Python callables.

* ``generate(prompts: list[str]) -> list[(text, n_tokens)]`` - a teacher
  completion endpoint or a local model;
* ``score(texts: list[str]) -> list[str]`` - any per-text scorer.

They run inside ``mapInPandas`` on Arrow batches (``spark.sql.execution.
arrow.maxRecordsPerBatch`` rows), so a client is built once per task and
called once per batch (per round for turn-by-turn generation) instead of once
per row.  A thread pool inside the batch gives the reference's "up to N
requests in flight" (F6) for callables that take one prompt at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import strip_ws
from ..session import materialize
from .turns import LLAMA_ASSISTANT_HEADER, LLAMA_EOT, LLAMA_USER_HEADER

Generate = Callable[[list[str]], list[tuple[str, int]]]
Score = Callable[[list[str]], list[str]]
SCORE_POSITIONS = 65_536       # ids that the teacher scores at once


# ------------------------------------------------------------------ stubs
def md5_generator(prompts: list[str]) -> list[tuple[str, int]]:
    """Deterministic stand-in generator: reply = md5 of the prompt, token
    count = prompt length (used by tests and the registered queries)."""
    return [(hashlib.md5(p.encode("utf-8")).hexdigest(), len(p)) for p in prompts]


def md5_scorer(texts: list[str]) -> list[str]:
    return [hashlib.md5(t.encode("utf-8")).hexdigest() for t in texts]


def one_at_a_time(fn: Callable[[str], tuple[str, int]], max_workers: int = 10) -> Generate:
    """Lift a single-prompt client into a batch generator with ``max_workers``
    requests in flight; results keep submit order (F6)."""
    def run(prompts: list[str]) -> list[tuple[str, int]]:
        with ThreadPoolExecutor(max_workers=max_workers) as ex:
            return list(ex.map(fn, prompts))
    return run


# ------------------------------------------------------------------ scoring
def score_column(df: DataFrame, col: str, out: str, scorer: Score = md5_scorer) -> DataFrame:
    """Add ``out = scorer(col)``, one call a batch (F1, F7).  Only ``col`` goes through
    Python, and no filter on ``out`` makes the scorer run twice; a null stays null."""
    def run(texts: pd.Series) -> pd.Series:
        there = texts.notna()
        result = pd.Series([None] * len(texts), dtype=object)
        if there.any():
            result[there.to_numpy()] = scorer(texts[there].tolist())
        return result
    return df.withColumn(out, F.pandas_udf(run, StringType()).asNondeterministic()(F.col(col)))


def score_distinct(df: DataFrame, col: str, out: str, scorer: Score = md5_scorer) -> DataFrame:
    """Score each distinct value once and join the result back (J5): the batch form of
    the reference's prompt cache.

    Texts meet by a 256-bit digest, so the join and its hot keys carry 64 bytes a row
    instead of whole prompts; the scored table is broadcast when its measured size
    allows, else a repeated prompt's rows are left to AQE's skew-join splitting.
    """
    from .ordered import _join_small
    digest = F.sha2(F.col(col).cast("binary"), 256)
    d = df.withColumn("_digest", digest)
    uniq = d.groupBy("_digest").agg(F.any_value(col).alias("_text"))
    scored = score_column(uniq, "_text", out, scorer).select("_digest", out)
    return _join_small(d, scored, ["_digest"], how="left").drop("_digest")


def gather_score_scatter(df: DataFrame, rank: str, row: str, col: str, out: str,
                         scorer: Score = md5_scorer) -> DataFrame:
    """Inputs of all ranks scored together, each result with its ``(rank, row)``
    (J4, ST6 batch twin).  The row keeps its key through the scorer, so nothing is
    joined back and rows without a rank stay."""
    return score_column(df, col, out, scorer)


# ------------------------------------------------------------------ pseudo-labelling
def _render_prefix(users: list[str], replies: list[str]) -> str:
    parts = []
    for i, u in enumerate(users):
        parts.append(LLAMA_USER_HEADER + u + LLAMA_EOT)
        if i < len(replies):
            parts.append(LLAMA_ASSISTANT_HEADER + replies[i] + LLAMA_EOT)
    return "".join(parts) + LLAMA_ASSISTANT_HEADER


def label_conversations(df: DataFrame, key: str, prompts: str, generate: Generate = md5_generator,
                        limit: int = 2048, inclusive: bool = True, checkpoint: bool = False,
                        with_prompts: bool = True) -> DataFrame:
    """Turn-by-turn pseudo-labelling.

    For each conversation (``prompts``: the user turns), prompt k is the
    template-A rendering of every earlier user turn and generated reply plus
    user turn k; the reply is appended and generation stops after the pair
    whose token count reaches the limit (``>=`` when ``inclusive``, else
    ``>``, quirk Q14).  All conversations of an Arrow batch advance together,
    one ``generate`` call per round.  Output: ``key, k, prompt, reply, n_tokens``; without
    ``with_prompts`` the prompts, which grow with every turn, don't leave Python.

    With ``checkpoint=True`` the labels are written once to the checkpoint
    directory, so a recomputed downstream task never calls a (possibly
    nondeterministic, always expensive) generator again.
    """
    names = [key, "k", "prompt", "reply", "n_tokens"]
    schema = f"{key} {df.schema[key].dataType.simpleString()}, k long, prompt string, reply string, n_tokens long"
    if not with_prompts:
        names.remove("prompt")
        schema = schema.replace(" prompt string,", "")

    def fn(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            keys = pdf[key].tolist()
            users = [list(x) if x is not None else [] for x in pdf[prompts].tolist()]
            replies: list[list[str]] = [[] for _ in keys]
            active = [i for i, u in enumerate(users) if len(u) > 0]
            out = []
            k = 0
            while active:
                ps = [_render_prefix(users[i][:k + 1], replies[i]) for i in active]
                res = generate(ps)
                nxt = []
                for i, p, (text, ntok) in zip(active, ps, res):
                    replies[i].append(text)
                    out.append((keys[i], k, p, text, int(ntok)))
                    stop = ntok >= limit if inclusive else ntok > limit
                    if not stop and k + 1 < len(users[i]):
                        nxt.append(i)
                active = nxt
                k += 1
            yield pd.DataFrame(out, columns=[key, "k", "prompt", "reply", "n_tokens"])[names]
    res = df.select(key, prompts).mapInPandas(fn, schema)
    return materialize(res) if checkpoint else res


def teacher_scores(df: DataFrame, key: str, ids: str, scorer: Callable[[list], list],
                   checkpoint: bool = False) -> DataFrame:
    """Teacher scoring of token batches (F7): ``scorer`` maps a batch of id
    lists to per-position score vectors; output one row per
    ``(key, pos)`` with ``logits ARRAY<FLOAT>`` (T5).  Documents are scored together up
    to ``SCORE_POSITIONS`` ids, a longer one in parts of as many, so memory stays bounded
    by them.  ``checkpoint=True`` stores the scores once (see :func:`label_conversations`)."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, pos long, logits array<float>"

    def scored(keys: pa.Array, rows: list[int], starts: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        n = np.array([len(p) for p in parts])
        scores = np.concatenate([np.asarray(s, np.float32) for s in scorer(parts)])
        total, width = scores.shape
        pos = np.arange(total) + np.repeat(np.array(starts) - (np.cumsum(n) - n), n)
        logits = pa.ListArray.from_arrays(pa.array(np.arange(total + 1) * width, pa.int32()), pa.array(scores.ravel()))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(np.array(rows), n))), pa.array(pos), logits],
                                          names=[key, "pos", "logits"])

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(0), batch.column(1)
            rows, starts, parts, held = [], [], [], 0
            for i in range(batch.num_rows):
                seq = lists[i].values
                for at in range(0, len(seq) if seq is not None else 0, SCORE_POSITIONS):
                    part = seq.slice(at, SCORE_POSITIONS).to_numpy(zero_copy_only=False)
                    if held + len(part) > SCORE_POSITIONS:
                        yield scored(keys, rows, starts, parts)
                        rows, starts, parts, held = [], [], [], 0
                    rows.append(i)
                    starts.append(at)
                    parts.append(part)
                    held += len(part)
            if parts:
                yield scored(keys, rows, starts, parts)
    res = df.select(key, ids).mapInArrow(fn, schema)
    return materialize(res) if checkpoint else res


def cosine_stub_scorer(vocab: int = 8) -> Callable[[list], list[np.ndarray]]:
    """Deterministic stand-in teacher: score of class v at a position with
    token id x is ``((x * (v + 1)) % 97) / 97``."""
    mult = np.arange(1, vocab + 1)

    def run(batch: list) -> list[np.ndarray]:
        return [np.asarray(seq)[:, None] * mult % 97 / 97.0 for seq in batch]
    return run


# Fixed value: the affirmative answer of the extraction loop's gate.
AFFIRMATIVE = "\u662f"
CONTINUE_PROMPT = "\nSome entities and relations are missing. Add them in the same format, without repeating any:\n"
GATE_PROMPT = "\nIs an entity or a relation still missing? Answer \u662f if so, else \u5426:\n"


def yes_no_gate(answer) -> "F.Column":
    """Follow-up gate of the extraction loop (C14): true when the stripped answer is
    the affirmative; a null answer is no."""
    return F.coalesce(strip_ws(answer) == F.lit(AFFIRMATIVE), F.lit(False))


def extraction_loop(chunks: DataFrame, keys: list[str], prompt: str, extract: Score, answer: Score,
                    max_rounds: int = 3, out: str = "output", continue_prompt: str = CONTINUE_PROMPT,
                    gate_prompt: str = GATE_PROMPT) -> DataFrame:
    """Prompt, extract, ask whether anything is left, go on where it is (F8, C14).

    Round 0 prompts every chunk.  Each further round prompts only the chunks whose
    answer to ``gate_prompt`` passed :func:`yes_no_gate`, with all that was said before
    and ``continue_prompt``; the loop ends after ``max_rounds`` rounds or when no chunk
    goes on.  Output: ``keys, round, out``, one row per prompted chunk and round.

    Every round is written once to the checkpoint directory, so the expensive, possibly
    nondeterministic model is called once a prompt, also when an executor is lost in a
    later round, and each round reads only the chunks that are still active.  Rows are
    told apart by nothing but their place in the table: repeated keys are kept.
    """
    active = chunks.select(*keys, F.col(prompt).alias("_said"))
    done: DataFrame | None = None
    for i in range(max_rounds):
        said = materialize(score_column(active, "_said", out, extract))
        step = said.select(*keys, F.lit(i).cast("long").alias("round"), out)
        done = step if done is None else done.unionByName(step)
        if i + 1 == max_rounds:
            break
        asked = said.select(*keys, F.concat("_said", out, F.lit(gate_prompt)).alias("_said"))
        answered = score_column(asked, "_said", "_answer", answer)
        active = materialize(answered.where(yes_no_gate(F.col("_answer"))).select(
            *keys, F.concat("_said", "_answer", F.lit(continue_prompt)).alias("_said")))
        if active.isEmpty():
            break
    return done


def md5_extractor(prompts: list[str]) -> list[str]:
    """Deterministic stand-in extractor: two entities and a relation between them,
    named after the md5 of the prompt."""
    out = []
    for p in prompts:
        h = hashlib.md5(p.encode("utf-8")).hexdigest()
        a, b = f"E{h[:4]}", f"E{h[4:8]}"
        out.append(f'("entity"<|>"{a}"<|>concept<|>"{h[8:16]}")##("entity"<|>"{b}"<|>event<|>"{h[16:24]}")##'
                   f'("relationship"<|>"{a}"<|>"{b}"<|>"{h[24:28]}"<|>kw{h[28]}<|>{int(h[29], 16) % 9 + 1})<|COMPLETE|>')
    return out


def md5_gate(prompts: list[str]) -> list[str]:
    """Deterministic stand-in answers: yes for six of 16 prompts, with white space around."""
    return [f" {AFFIRMATIVE}\n" if hashlib.md5(p.encode("utf-8")).hexdigest()[0] < "6" else "\u5426" for p in prompts]
