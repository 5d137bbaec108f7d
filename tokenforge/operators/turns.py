"""Chat transcripts: canonical turns, format variants, templates and parsers.

Canonical form (T2): ``conv_id, turns ARRAY<STRUCT<role STRING, content STRING>>``.
A conversation is one record, as in every input format of the reference, so
all per-conversation logic is array expressions on that row (no shuffle after
the one ``groupBy(conv_id)`` that assembles exploded turn rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import let
from ..functions.text import strip_ws

# ---------------------------------------------------------------------------
# Chat template markers and role prefixes, as the reference
# renders them (must be equal for equal prompts and samples).
LLAMA_USER_HEADER = "<|start_header_id|>user<|end_header_id|>\n\n"
LLAMA_ASSISTANT_HEADER = "<|start_header_id|>assistant<|end_header_id|>\n\n"
LLAMA_EOT = "<|eot_id|>"
LLAMA_BOS_TEXT = "<|begin_of_text|>"
QWEN_USER_GEN = "<|im_start|>user\n\n"          # generation template (two newlines)
QWEN_ASSISTANT_GEN = "<|im_start|>assistant\n\n"
QWEN_END = "<|im_end|>"
QWEN_USER_TRAIN = "<|im_start|>user\n"          # training wrappers (one newline, Q7)
QWEN_ASSISTANT_TRAIN = "<|im_start|>assistant\n"
ROLE_PREFIX_SPACED = {"user": "User : ", "assistant": "Assistant : "}  # builders 1 and 4
ROLE_TEXT_MARKERS = {"user": "User: ", "assistant": "Assistant: ", "system": "System: "}
TURN_SEP = "\n\n"
# ---------------------------------------------------------------------------


def turns_from_rows(rows: DataFrame, key: str = "conv_id", order: str = "turn",
                    role: str = "role", text: str = "text") -> DataFrame:
    """Exploded turn rows -> one row per conversation with ordered ``turns``."""
    st = F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content"))
    return (rows.groupBy(key).agg(F.array_sort(F.collect_list(st)).alias("_t"))
            .select(key, F.transform("_t", lambda t: F.struct(t["role"].alias("role"),
                                                                t["content"].alias("content"))).alias("turns")))


def as_flat_list(turns) -> Column:
    """Chat B: ``data: [str, ...]`` (roles implied by position)."""
    return F.transform(turns, lambda t: t["content"])


def as_from_value(turns) -> Column:
    """Chat C: ``conversations: [{from, value}]`` with human / gpt / other."""
    def conv(t):
        frm = (F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt")
               .otherwise(t["role"]))
        return F.struct(frm.alias("from"), t["content"].alias("value"))
    return F.transform(turns, conv)


def as_role_text(turns) -> Column:
    """Chat E: ``User: ..\\n\\nAssistant: ..`` (System for system turns)."""
    def one(t):
        m = F.coalesce(*[F.when(t["role"] == k, F.lit(v)) for k, v in ROLE_TEXT_MARKERS.items()],
                       F.concat(F.initcap(t["role"]), F.lit(": ")))
        return F.concat(m, t["content"])
    return F.array_join(F.transform(turns, one), TURN_SEP)


def even_items(data) -> Column:
    """Even-index items of a flat list: the user turns of chat B."""
    return F.filter(data, lambda x, i: i % 2 == 0)


def blank_non_human(conversations) -> Column:
    """Chat C -> flat list with every non-``human`` value blanked (P10)."""
    return F.transform(conversations, lambda c: F.when(c["from"] == "human", c["value"]).otherwise(F.lit("")))


def role_prefix(role) -> Column:
    """``User : `` / ``Assistant : `` / capitalised role + `` : ``."""
    return (F.when(role == "assistant", F.lit(ROLE_PREFIX_SPACED["assistant"]))
            .when(role == "user", F.lit(ROLE_PREFIX_SPACED["user"]))
            .otherwise(F.concat(F.upper(F.substring(role, 1, 1)), F.substring(role, 2, 1 << 30),
                                F.lit(" : "))))


# ------------------------------------------------------------------ templates
def _wrap(role: Column, content: Column, user_pre: str, asst_pre: str, end: str,
          others_as_assistant: bool = False) -> Column:
    u = F.concat(F.lit(user_pre), content, F.lit(end))
    a = F.concat(F.lit(asst_pre), content, F.lit(end))
    if others_as_assistant:
        return F.when(role == "user", u).otherwise(a)
    return F.when(role == "user", u).when(role == "assistant", a).otherwise(F.lit(""))


def render_llama(turns, generation_prompt: bool = True, bos: bool = False) -> Column:
    """Template A (C1; C2 with ``bos``): user/assistant turns only."""
    body = F.array_join(F.transform(turns, lambda t: _wrap(
        t["role"], t["content"], LLAMA_USER_HEADER, LLAMA_ASSISTANT_HEADER, LLAMA_EOT)), "")
    parts = ([F.lit(LLAMA_BOS_TEXT)] if bos else []) + [body]
    if generation_prompt:
        parts.append(F.lit(LLAMA_ASSISTANT_HEADER))
    return F.concat(*parts)


def render_qwen(turns, generation_prompt: bool = True) -> Column:
    """Template B (C3): ``<|im_start|>role\\n\\n..<|im_end|>``, user/assistant only."""
    body = F.array_join(F.transform(turns, lambda t: _wrap(
        t["role"], t["content"], QWEN_USER_GEN, QWEN_ASSISTANT_GEN, QWEN_END)), "")
    return F.concat(body, F.lit(QWEN_ASSISTANT_GEN)) if generation_prompt else body


def render_for_model(turns, model: Column, generation_prompt: bool = True) -> Column:
    """Template by model name (C5): A where the name holds ``llama`` in any case, else B."""
    is_a = F.coalesce(F.lower(model).contains("llama"), F.lit(False))
    return F.when(is_a, render_llama(turns, generation_prompt)).otherwise(render_qwen(turns, generation_prompt))


def cut_closing_tag(prompt: Column, tag: str = QWEN_END) -> Column:
    """A rendered prompt without its closing tag and the newline after it (C15), so that
    generation goes on inside the last turn.  A prompt that doesn't end so stays whole."""
    end = tag + "\n"
    return F.when(prompt.endswith(end), F.substring(prompt, F.lit(1), F.length(prompt) - F.lit(len(end)))).otherwise(prompt)


def render_history(turns, generation_prompt: bool = True) -> Column:
    """Model chat template over the full history, system turns included."""
    body = F.array_join(F.transform(turns, lambda t: F.concat(
        F.lit("<|start_header_id|>"), t["role"], F.lit("<|end_header_id|>\n\n"),
        t["content"], F.lit(LLAMA_EOT))), "")
    return F.concat(body, F.lit(LLAMA_ASSISTANT_HEADER)) if generation_prompt else body


def train_wrapper(role: Column, content: Column, is_llama: bool) -> Column:
    """Per-turn training wrappers (C4): user vs everything else."""
    if is_llama:
        return _wrap(role, content, LLAMA_USER_HEADER, LLAMA_ASSISTANT_HEADER, LLAMA_EOT, True)
    return _wrap(role, content, QWEN_USER_TRAIN, QWEN_ASSISTANT_TRAIN, QWEN_END + "\n", True)


def prompt_prefixes(data) -> Column:
    """Cumulative prompts of chat B (W8): prompt k = template A of every turn
    before user turn k, user turn k, then the assistant header.

    Returns ``ARRAY<STRUCT<k, prompt>>`` for the even (user) positions.
    """
    pieces = F.transform(data, lambda x, i: F.when(i % 2 == 0, F.concat(F.lit(LLAMA_USER_HEADER), x, F.lit(LLAMA_EOT)))
                         .otherwise(F.concat(F.lit(LLAMA_ASSISTANT_HEADER), x, F.lit(LLAMA_EOT))))
    idx = F.filter(F.sequence(F.lit(0), F.size(data) - 1), lambda i: i % 2 == 0)
    return let(pieces, lambda pcs: F.transform(idx, lambda i: F.struct(
        (i / 2).cast("long").alias("k"),
        F.concat(F.array_join(F.slice(pcs, 1, i + 1), ""), F.lit(LLAMA_ASSISTANT_HEADER)).alias("prompt"))))


def budget_keep(totals, limit: int, inclusive: bool = True) -> Column:
    """Which pairs survive a cumulative budget.

    Pair k is kept iff every earlier pair's total is below the limit
    (``>=`` stops: ``inclusive=True``) or at most the limit (``>`` stops).
    The pair that crosses the limit is kept.
    """
    stop = (lambda x: x >= F.lit(limit)) if inclusive else (lambda x: x > F.lit(limit))

    def keep(tt):
        first = F.array_position(F.transform(tt, lambda x: F.coalesce(stop(x), F.lit(False))), True)
        return let(first, lambda at: F.transform(tt, lambda x, i: (at == 0) | (i < at)))
    return let(totals, keep)


# ------------------------------------------------------------------ parsers
def parse_role_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """Chat E string -> ``out: ARRAY<STRUCT<role, content>>``.

    The text is stripped; a user turn ends only at ``\\n\\nAssistant: ``, an
    assistant or system turn only at ``\\n\\nUser: ``.  The text is split at
    every marker and folded left once: a piece whose marker has the same type
    as the current state (system counts as assistant) is merged back into the
    previous turn, any other piece opens a turn.  A text that does not start
    with a role marker yields null (quarantine), an empty text an empty list.
    """
    d = df.withColumn("_rt_s", strip_ws(F.col(text)))
    d = d.withColumn("_rt_p", F.split("_rt_s", "\n\n(?=(User|Assistant): )"))
    cut = {"user": 6, "assistant": 11, "system": 8}

    def kind(p):
        return (F.when(p.startswith("User: "), "user").when(p.startswith("Assistant: "), "assistant")
                .when(p.startswith("System: "), "system"))

    def body(p, k):
        n = F.coalesce(*[F.when(k == r, F.lit(v)) for r, v in cut.items()])
        return F.substring(p, n + 1, 1 << 30)

    empty = F.array().cast("array<struct<role:string,content:string>>")

    def turns_of(ps):
        # a piece opens a turn where its speaker differs from the piece's before it
        speaker = F.transform(ps, lambda p: F.when(kind(p) == "system", "assistant").otherwise(kind(p)))

        def grouped(who):
            opens = F.filter(F.sequence(F.lit(0), F.size(ps) - 1), lambda i: (i == 0) | (
                F.element_at(who, i + 1) != F.element_at(who, F.greatest(i, F.lit(1)))))

            def cut_at(starts):
                def turn(i, j):
                    first = F.element_at(ps, i + 1)
                    end = F.coalesce(F.try_element_at(starts, j + 2), F.size(ps))
                    said = F.concat(F.array(body(first, kind(first))), F.slice(ps, i + 2, end - i - 1))
                    return F.struct(kind(first).alias("role"), F.array_join(said, TURN_SEP).alias("content"))
                return F.transform(starts, turn)
            return let(opens, cut_at)
        return let(speaker, grouped)

    res = (F.when(F.length("_rt_s") == 0, empty)
           .when(kind(F.element_at("_rt_p", 1)).isNull(), F.lit(None))
           .otherwise(let(F.col("_rt_p"), turns_of)))
    return d.withColumn(out, res).drop("_rt_s", "_rt_p")


def parse_tag_pairs(text, user_tag: str = LLAMA_USER_HEADER,
                    assistant_tag: str = LLAMA_ASSISTANT_HEADER) -> Column:
    """Decoded chat text -> alternating ``[prompt, response, ...]``.

    Text between a user tag and the next assistant tag is a prompt; from there
    to the next user tag (or the end) is the response.  Parsing stops at the
    first user tag without a following assistant tag.
    """
    pieces = F.slice(F.split(text, r"\Q" + user_tag + r"\E"), 2, 1 << 30)
    zipped = F.transform(pieces, lambda p: F.struct(p.alias("p"), F.locate(assistant_tag, p).alias("at")))

    def cut(z):
        first_bad = F.array_position(F.transform(z, lambda r: r["at"] == 0), True)
        n_ok = F.when(first_bad == 0, F.size(z)).otherwise(first_bad - 1)
        return F.flatten(F.transform(F.slice(z, 1, n_ok), lambda r: F.array(
            F.substring(r["p"], 1, r["at"] - 1),
            F.substring(r["p"], r["at"] + len(assistant_tag), 1 << 30))))
    return let(zipped, cut)

