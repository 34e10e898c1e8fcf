"""Sessions as rows and cells: the registry's sessions, what their logs add up to, what their status says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import axes, texts, units
from ..sources.logs import flatten_sessions
from . import tokens


def session_rows(sessions: DataFrame, records: DataFrame) -> DataFrame:
    """(session, name, cwd, status, pane, model, tokens, agents, cost_usd, context_percent, last_turn_ms) of each session.

    sessions: (sessionId, name, cwd, status, tmux and info, the status payload or null), as sources.status.with_status gives them
    once `status` is renamed to info; records: (session, ord and the fields of a record). A name defaults to the id, folder
    and status to ''. The model is the family of the status's raw model id, null without a status. Tokens and messages of
    subagents are 0 for a session without any."""
    flat = tokens.requests(records, ["session"])
    sums = tokens.by_session(tokens.once(flat, ["session"])).select("session", F.col("total").alias("tokens"), F.col("sidechain_messages").alias("agents"))
    turns = tokens.last_duration(records, ["session"]).withColumnRenamed("duration_ms", "last_turn_ms")
    rows = flatten_sessions(sessions.filter(F.col("sessionId").isNotNull())).withColumnRenamed("sessionId", "session")
    met = rows.join(sums, "session", "left").join(turns, "session", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return met.select(
        "session", "name", "cwd", "status", F.coalesce(texts.pane(F.col("tmux")), F.lit("")).alias("pane"), F.when(F.col("info.model.id").isNotNull(), texts.fold(F.col("info.model.id"))).alias("model"),
        zero("tokens"), zero("agents"), F.col("info.cost.total_cost_usd").alias("cost_usd"), F.col("info.context_window.used_percentage").alias("context_percent"), "last_turn_ms",
    )


def _known(text: Column) -> Column:
    return F.coalesce(text, F.lit("N/A"))


def session_cells(rows: DataFrame) -> DataFrame:
    """The texts of the rows of session_rows: 'N/A' for what no status tells."""
    return rows.select(
        "session", "name", texts.last_part(F.col("cwd")).alias("directory"), _known(F.col("model")).alias("model"), "status",
        axes.abbreviated(F.col("tokens").cast("double"), billions=False).alias("tokens"), _known(F.concat(F.lit("$"), units.fixed(F.col("cost_usd"), 2))).alias("cost"),
        _known(F.concat(units.fixed(F.col("context_percent"), 0), F.lit("%"))).alias("context"), F.col("agents").cast("string").alias("agents"),
    )
