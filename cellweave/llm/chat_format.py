r"""Relational chat formatting: turn structs are sorted, merged and concatenated by Spark expressions alone.

Template of one run of turns with the same role::

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT ... <|end|>

Inside roles and texts a backslash is doubled and every control string (those of this template, and the
sentence and instruction marks of common others) gets a backslash after its first character, so a text can
never be taken for a mark and ``\\x -> x`` restores it.

Defined cases: a null text or role is empty; turns are ordered by (turn, role, text) with nulls first, so ties
and repeated rows have one order; every row is a turn, repeated rows included; a null conv_id is a conversation
of its own; an empty table gives no row; other columns, whatever their names, are ignored. Rows that already belong
to conversation -1 are one conversation with the two that the query adds. A conversation is one row of the output, so
the turns of one conversation meet in one task by nature; nothing else does, and the work is linear in them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Marks of the template, and control strings that must not survive inside a text.
TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]")

TRAINED_ROLE = "assistant"


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    c = _replace(c, "\\", "\\\\")
    for mark in CONTROLS:
        c = _replace(c, mark, mark[0] + "\\" + mark[1:])
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def collect_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as they are and escaped (``r``, ``x``).

    ``chars`` and ``bytes`` say where the turn's text ends in the formatted conversation: a running sum over its turns.
    """
    clean = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).withColumns({"r": escape(F.col("role")), "x": escape(F.col("text"))})
    before = Window.partitionBy("conv_id").orderBy(*[F.asc_nulls_first(c) for c in ("turn", "role", "text")])
    last, so_far = F.lag("role").over(before), before.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def end(length) -> Column:
        opening = length(F.col("r")) + len(TURN) + len(TEXT)
        mark = F.when(last.isNull(), opening).when(last == F.col("role"), len(NEXT)).otherwise(opening + len(END))
        return F.sum((mark + length(F.col("x"))).cast("long")).over(so_far)

    placed = clean.select(*clean.columns, end(F.char_length).alias("chars"), end(F.octet_length).alias("bytes"))
    turn = F.struct("turn", "role", "text", "chars", "bytes", "r", "x")
    return placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_conversations(rows: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    ``loss_spans`` say where the escaped texts of the trained role are in ``formatted``: start and length in code points, and
    byte_start and byte_length. Marks, roles and the other texts are outside the loss.
    """

    def opened(t: Column, i: Column) -> Column:
        before = F.get("turns", i - 1)["role"]
        head = F.concat(F.lit(TURN), t["r"], F.lit(TEXT))
        return F.when(i == 0, head).when(before == t["role"], F.lit(NEXT)).otherwise(F.concat(F.lit(END), head))

    def span(t: Column) -> Column:
        chars, size = F.char_length(t["x"]).cast("long"), F.octet_length(t["x"]).cast("long")
        return F.struct(
            (t["chars"] - chars).alias("start"),
            chars.alias("length"),
            (t["bytes"] - size).alias("byte_start"),
            size.alias("byte_length"),
        )

    said = F.array_join(F.transform("turns", lambda t, i: F.concat(opened(t, i), t["x"])), "")
    return collect_turns(rows).select(
        "conv_id",
        F.concat(said, F.lit(END)).alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["role"] == trained_role), span).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text and formatted, all parsed from the formatted strings."""
    blocks = F.filter(F.split("formatted", r"<\|turn\|>"), lambda b: b != "")
    turns = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(
                    F.regexp_replace(F.regexp_replace(b, r"(?s)^.*?<\|text\|>", ""), r"(?s)<\|end\|>$", ""),
                    r"<\|next\|>",
                    -1,
                ),
                lambda x: F.struct(
                    unescape(F.substring_index(b, TEXT, 1)).alias("role"),
                    unescape(x).alias("text"),
                ),
            ),
        )
    )

    # The bytes are a variable of their own, so that they are made once and not for every span.
    def under_mask(raw: Column) -> Column:
        cut = lambda s: F.substring(raw, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int"))
        return F.array_join(F.transform("loss_spans", lambda s: unescape(cut(s).cast("string"))), "")

    loss = F.get(F.transform(F.array(F.col("formatted").cast("binary")), under_mask), F.lit(0))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise(TRAINED_ROLE)
    extra = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(probe).alias("text"))
    back = read_back(format_conversations(rows.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(c: str) -> str:
    out = f"replace({c}, '\\', '\\\\')"
    for mark in CONTROLS:
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


OP3_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS before
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       coalesce(sum(CASE WHEN role = '{TRAINED_ROLE}' THEN length(text) END), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = '{TRAINED_ROLE}'), '')) AS loss_sha256,
       sum(length({_sql_escape('text')}) + CASE WHEN role = before THEN {len(NEXT)}
           ELSE {len(TURN) + len(TEXT) + len(END)} + length({_sql_escape('role')}) END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
