"""Chat formatting into budgeted windows, with built-in expressions only.

A turn is written as ``<s>role\\n`` + text + ``</s>``; user texts stand in ``[INST] … [/INST]`` and system texts in
``<<SYS>>…<</SYS>>``. Inside roles and texts every backslash is doubled and every control string is broken by one
backslash, so no control string survives there and the original can be read back.

A conversation is cut into windows at turn borders. Prefix sums of the turn costs decide how many fresh turns fit into
the budget beside the retained system turn and the repeated history. History is limited in turns and in cost. Only
assistant texts that are fresh in a window lie under its loss mask; repeated ones are context.

Defined results: null texts and roles are empty; turns sort by (turn, role, text), nulls first; repeated rows are turns
of their own; a null conv_id is a conversation; a turn that alone exceeds the budget gets a window of its own and is not
cut; other columns are ignored. One conversation is one training sample and has to fit into a task, as its digest does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cost of a window in words and marks; history within it; history in turns.
BUDGET, HISTORY, HISTORY_TURNS = 512, 128, 2
#: Marks a turn costs beside its words.
TURN_MARKS = 4

OPEN, CLOSE = "<s>", "</s>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    angled = F.regexp_replace(doubled, r"<(?=/?s>|</?SYS>>)", r"<\\")
    return F.regexp_replace(angled, r"\[(?=/?INST\])", r"[\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _before(role: Column) -> Column:
    """What stands between the role line and the text."""
    return F.when(role == "user", "[INST] ").when(role == "system", "<<SYS>>").otherwise("")


def _after(role: Column) -> Column:
    return F.when(role == "user", " [/INST]").when(role == "system", "<</SYS>>").otherwise("")


def _written_turn(role: Column, text: Column) -> Column:
    """The turn as written, where its text begins and how long it is there, and its cost."""
    escaped = escape(text)
    head = F.concat(F.lit(OPEN), F.replace(escape(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"), _before(role))
    return F.struct(
        F.concat(head, escaped, _after(role), F.lit(CLOSE)).alias("written"),
        F.length(head).alias("text_at"), F.length(escaped).alias("text_length"),
        (role == "assistant").alias("learned"), (role == "system").alias("is_system"),
        (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + F.lit(TURN_MARKS)).alias("cost"))


def _spans(budget: int, history: int, history_turns: int) -> Column:
    """Turn-aligned windows (first fresh turn, first repeated turn) over the array ``body`` with prefix sums ``sums``."""
    sums = lambda k: F.get(F.col("sums"), k)  # noqa: E731  cost of the turns before turn k
    history_from = lambda k: F.filter(
        F.sequence(F.greatest(k - F.lit(history_turns), F.lit(0)), k), lambda x: sums(k) - sums(x) <= history)[0]
    one = lambda k: F.struct(k.cast("int").alias("fresh"), history_from(k).cast("int").alias("repeated"))

    def step(spans, k):
        last = F.element_at(spans, -1)
        full = F.col("system_cost") + sums(k + 1) - sums(last["repeated"]) > budget
        return F.when(full, F.concat(spans, F.array(one(k)))).otherwise(spans)

    first = F.array(F.struct(F.lit(0).alias("fresh"), F.lit(0).alias("repeated")))
    return F.aggregate(F.sequence(F.lit(1), F.size("body")), first,
                       lambda spans, k: F.when(k < F.size("body"), step(spans, k)).otherwise(spans))


def format_conversations(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY,
                         history_turns: int = HISTORY_TURNS) -> DataFrame:
    """One row per conversation: conv_id and ``windows``, an array of
    (text, n_context: repeated turns at its start, loss: spans under the mask as 0-based start and length in code points).
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    ordered = turns.select("conv_id", F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    whole = ordered.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = whole.select("conv_id", F.transform("turns", lambda t: _written_turn(t["role"], t["text"])).alias("turns"))
    has_system = F.get("turns", F.lit(0))["is_system"]
    split = written.select(
        "conv_id", F.when(has_system, F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0)).alias("system"),
        F.when(has_system, F.expr("slice(turns, 2, size(turns))")).otherwise(F.col("turns")).alias("body"))
    summed = split.select(
        "*", F.coalesce(F.get("system", F.lit(0))["cost"], F.lit(0)).alias("system_cost"),
        F.aggregate("body", F.array(F.lit(0)), lambda s, t: F.concat(s, F.array(F.element_at(s, -1) + t["cost"]))).alias("sums"))
    spans = summed.select("conv_id", "system", "body", _spans(budget, history, history_turns).alias("spans"))

    def window(span, k):
        until = F.coalesce(F.get("spans", k + 1)["fresh"], F.size("body"))
        repeated = span["fresh"] - span["repeated"]
        return F.struct(
            F.concat("system", F.slice("body", span["repeated"] + 1, until - span["repeated"])).alias("turns"),
            (F.when(k > 0, F.size("system")).otherwise(0) + repeated).alias("n_context"))

    built = spans.select("conv_id", F.transform("spans", window).alias("windows"))

    def place(state, turn):
        start = state["at"] + turn["text_at"]
        fresh = turn["learned"] & (state["seen"] >= state["n_context"])
        loss = F.when(fresh, F.concat(state["loss"], F.array(F.struct(start.alias("start"), turn["text_length"].alias("length"))))).otherwise(state["loss"])
        return F.struct((state["at"] + F.length(turn["written"])).alias("at"), (state["seen"] + 1).alias("seen"),
                        state["n_context"].alias("n_context"), loss.alias("loss"))

    def finish(w):
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("seen"), w["n_context"].alias("n_context"),
                         F.expr("cast(array() as array<struct<start:int,length:int>>)").alias("loss"))
        return F.struct(F.array_join(F.transform(w["turns"], lambda t: t["written"]), "").alias("text"),
                        w["n_context"].alias("n_context"),
                        F.aggregate(w["turns"], start, place, lambda s: s["loss"]).alias("loss"))

    return built.select("conv_id", F.transform("windows", finish).alias("windows"))


def window_rows(formatted: DataFrame) -> DataFrame:
    """One row per window: conv_id, window (from 0), text, n_context, loss."""
    return formatted.select("conv_id", F.posexplode("windows").alias("window", "w")).select("conv_id", "window", "w.*")


def read_turns(window: Column) -> Column:
    """The fresh turns of a window read back from its text, as an array of (role, text)."""
    pieces = F.filter(F.split(window["text"], CLOSE), lambda p: p != "")
    wanted = F.slice(pieces, window["n_context"] + 1, F.size(pieces))

    def parse(piece):
        shape = r"(?s)^<s>((?:[^\\\n]|\\.)*)\n(.*)$"
        role, rest = unescape(F.regexp_extract(piece, shape, 1)), F.regexp_extract(piece, shape, 2)
        begin, end = F.length(_before(role)), F.length(_after(role))
        return F.struct(role.alias("role"), unescape(F.substr(rest, begin + 1, F.length(rest) - begin - end)).alias("text"))

    return F.transform(wanted, parse)


def read_loss(window: Column) -> Column:
    """The text under the loss mask of a window, unescaped."""
    return F.array_join(F.transform(window["loss"], lambda s: unescape(F.substr(window["text"], s["start"] + 1, s["length"]))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what can be read back from its windows: counts, lengths and SHA-256 digests."""
    read = formatted.select(
        "conv_id", F.flatten(F.transform("windows", read_turns)).alias("turns"),
        F.array_join(F.transform("windows", read_loss), "").alias("loss"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda n, w: n + F.length(w["text"])).alias("formatted_chars"),
        F.size("windows").cast("long").alias("n_windows"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv_id").cast("long"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars", "n_windows")
