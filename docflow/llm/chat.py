"""Chat formatting from event logs: fold the events of each conversation into messages, then render these.

Events (conversation, sequence, message, kind, role, text), of kind
  delta       text goes behind what the message has so far; the first delta begins it,
  edit        text takes the place of what the message has so far,
  regenerate  as edit, and all later messages as they stand are void.
The log is dealt by conversation once; the fold, the order, the offsets and the rendering keep that dealing.
An event counts if nothing after it makes it void: the last edit or regeneration of its own message, and the
last regeneration of any earlier message. Both are maxima, so no state is carried from row to row.

The template is START role MIDDLE text END. Inside roles and texts a backslash is doubled, and one is put
behind the first character of every control string, so none is left whole; removing one backslash of each
run's odd or paired ones gives the text back. The loss mask is a list of spans over the formatted string, in
code points: the escaped texts of assistants.

Defined results: a null text or role is empty. Events of one sequence number are ordered by text. Repeated
events count each. A conversation whose messages are all void has none and is left out. A null conversation
is one of its own. Very long texts are handled whole. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that chat templates use for control; '<|' begins all of the first kind.
CONTROL = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
LOSS_ROLE = "assistant"


def _quoted(text: str) -> str:
    return "".join("\\" + c if c in "\\|[]()<>/.*+?^${}" and c not in "<>/" else c for c in text)


def _marked() -> str:
    """A pattern for the first character of each control string."""
    firsts = sorted({c[0] for c in CONTROL})
    return "|".join(_quoted(f) + "(?=" + "|".join(_quoted(c[1:]) for c in CONTROL if c[0] == f) + ")" for f in firsts)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), f"({_marked()})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def turn_events(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The log of a table with one finished message a row: one delta each, in order of turn, role and text."""
    order = Window.partitionBy("conversation").orderBy(turn, "role", "text")
    plain = rows.select(F.col(conversation).alias("conversation"), F.col(turn), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    at = F.row_number().over(order)
    return plain.repartition("conversation").select("conversation", at.cast("long").alias("sequence"), at.cast("long").alias("message"), F.lit("delta").alias("kind"), "role", "text")


def folded(events: DataFrame) -> DataFrame:
    """Final messages: (conversation, message, role, text).

    The role is the last one that an event of the message gives, as streamed deltas often carry it on the first only.
    """
    restart = F.col("kind").isin("edit", "regenerate")
    log = events.select("conversation", "sequence", "message", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_message = log.repartition("conversation").groupBy("conversation", "message").agg(
        F.max(F.when(restart, F.col("sequence"))).alias("own"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("sequence"))).alias("again"),
        F.sort_array(F.collect_list(F.struct("sequence", "text", "role"))).alias("parts"),
    )
    earlier = Window.partitionBy("conversation").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    void = F.max("again").over(earlier)
    roles = F.filter(F.transform("parts", lambda p: p["role"]), lambda r: r != "")
    role = F.when(F.size(roles) > 0, F.element_at(roles, -1)).otherwise(F.lit(""))
    counts = by_message.withColumn("void", void).withColumn("role", role).withColumn(
        "parts", F.filter("parts", lambda p: (F.col("own").isNull() | (p["sequence"] >= F.col("own"))) & (F.col("void").isNull() | (p["sequence"] > F.col("void"))))
    )
    return counts.where(F.size("parts") > 0).select("conversation", "message", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """Per conversation: formatted string and loss, array of (start, length) in code points."""
    order = Window.partitionBy("conversation").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(MIDDLE))
    parts = messages.select("conversation", "message", (F.col("role") == LOSS_ROLE).alias("learned"), head.alias("head"), escape(F.col("text")).alias("body"))
    size = (F.char_length("head") + F.char_length("body") + len(END)).cast("long")
    placed = parts.withColumn("at", F.coalesce(F.sum(size).over(order), F.lit(0)))
    turn = F.struct(
        "message", F.concat("head", "body", F.lit(END)).alias("piece"), "learned",
        (F.col("at") + F.char_length("head")).cast("int").alias("start"), F.char_length("body").alias("length"),
    )
    turns = placed.groupBy("conversation").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return turns.select(
        "conversation", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss"),
    )


def parsed(rows: DataFrame, formatted: str = "formatted", loss: str = "loss") -> DataFrame:
    """Adds turns (array of role and text) and learned (array of texts under the mask), read from the output alone."""

    def turn(x: Column) -> Column:
        role = F.substring_index(x, MIDDLE, 1)
        first = F.char_length(role) + len(MIDDLE)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(x, first + 1, F.char_length(x) - first - len(END))).alias("text"))

    pieces = F.split(F.col(formatted), _quoted(START), -1)
    return rows.withColumn("turns", F.transform(F.slice(pieces, F.lit(2), F.size(pieces) - 1), turn)).withColumn(
        "learned", F.transform(loss, lambda s: unescape(F.substring(F.col(formatted), s["start"] + 1, s["length"])))
    )


def digests(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation, read back from its formatted string: turns and the text under the loss mask, as digests."""
    read = parsed(rows).select(
        F.col("conversation").alias(key), F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
        F.array_join("learned", "").alias("learned"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    return read.select(key, "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


def oracle_sql(table: str, extra: str) -> str:
    """DuckDB SQL for digests(rendered(folded(turn_events(table with the extra rows))))."""
    def escaped(c: str) -> str:
        counts = [rf"(length({c}) - length(replace({c}, '\', '')))"] + [f"(length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in CONTROL]
        return f"length({c}) + " + " + ".join(counts)

    return f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {table} {extra})
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256,
               sum({len(START + MIDDLE + END)} + {escaped('role')} + {escaped('text')})::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id"""
