r"""Chat formatting with typed content parts, in DataFrame functions only.

A conversation becomes one string: for each turn ``<|start|>role<|body|>content<|end|>`` and a newline. A visitor walks
the content parts of a turn in order: text goes in escaped, an image, audio or document part leaves its placeholder
``<|image|>``, ``<|audio|>`` or ``<|document|>``, any other kind ``<|other|>``. What the placeholders stand for is
recorded in order: turn, kind, reference and the tokens it expands to (units times the kind's rate, rounded up).

Control strings inside texts and roles are escaped by one backslash after their first character, those with backslashes
there already by one more; so no text can hold a control string, and unescaping takes exactly one backslash away.

Under the loss mask lies each assistant text: spans of code points in the formatted string. A turn's offset is a running
sum over its conversation, so long conversations cost no more than their length. A conversation is one string and one
row: it must fit a task, which is the only limit.

Defined cases: a null text, role or part is empty; null parts mean the text column. Turns come by turn number, nulls
first, ties by role, then text; repeated rows are turns of their own. A very long text is formatted whole. Rows with a null
conversation id form one conversation. An empty table gives an empty result. Columns of the input may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|start|>", "<|body|>", "<|end|>\n"
#: What makes a control string of this or of common chat templates, after its first character.
TAILS = r"(\||/?s>|/?INST\]|/?SYS>)"
#: Tokens that one unit of a part expands to: an image tile, a second of audio, a page of a document.
RATES = {"image": 256.0, "audio": 25.0, "document": 700.0}
PARTS = "array<struct<kind:string,text:string,ref:string,units:double>>"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + TAILS, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\" + TAILS, "$1$2$3")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _kind(part: Column) -> Column:
    return F.when(part["kind"].isin("text", *RATES), part["kind"]).otherwise("other")


def _placed(part: Column) -> Column:
    """What a part leaves in the string."""
    return F.when(_kind(part) == "text", escape(_text(part["text"]))).otherwise(F.concat(F.lit("<|"), _kind(part), F.lit("|>")))


def _expanded(part: Column, rates: dict[str, float]) -> Column:
    rate = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), _kind(part)), F.lit(1.0))
    words = F.regexp_count(_text(part["text"]), F.lit(TOKEN)).cast("long")
    return F.when(_kind(part) == "text", words).otherwise(F.ceil(rate * F.coalesce(part["units"], F.lit(1.0))).cast("long"))


def format_chats(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None, learned: tuple[str, ...] = ("assistant",), rates: dict[str, float] | None = None
) -> DataFrame:
    """One row for each conversation: id, n_turns, formatted, loss_spans (turn_index, start, length), attachments
    (turn_index, kind, ref, tokens), expanded_tokens. ``parts``: a column of the type PARTS."""
    rates = RATES if rates is None else rates
    whole = F.array(F.struct(F.lit("text").alias("kind"), _text(F.col(text)).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units")))
    given = whole if parts is None else F.coalesce(F.filter(F.col(parts).cast(PARTS), lambda p: p.isNotNull()), whole)
    own = rows.select(F.col(conv_id).alias("_conv"), F.col(turn).alias("_turn"), _text(F.col(role)).alias("_role"), _text(F.col(text)).alias("_text"), given.alias("_parts"))
    own = own.withColumns(
        {
            "_head": F.concat(F.lit(TURN), escape(F.col("_role")), F.lit(BODY)),
            "_body": F.array_join(F.transform("_parts", _placed), ""),
            "_tokens": F.aggregate(F.transform("_parts", lambda p: _expanded(p, rates)), F.lit(0).cast("long"), lambda a, x: a + x),
            "_refs": F.transform(F.filter("_parts", lambda p: _kind(p) != "text"), lambda p: F.struct(_kind(p).alias("kind"), p["ref"].alias("ref"), _expanded(p, rates).alias("tokens"))),
        }
    )
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_text", "_body")
    size = F.length("_head") + F.length("_body") + len(END)
    before = F.coalesce(F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    at = (F.row_number().over(order) - 1).alias("at")
    turns = own.select("_conv", F.struct(at, F.concat("_head", "_body", F.lit(END)).alias("segment"), F.col("_role").isin(*learned).alias("learned"), (before + F.length("_head")).alias("start"), F.length("_body").cast("long").alias("length"), F.col("_refs").alias("refs"), F.col("_tokens").alias("tokens")).alias("t"))
    chats = turns.groupBy("_conv").agg(F.array_sort(F.collect_list("t")).alias("t"))
    spans = F.transform(F.filter("t", lambda t: t["learned"]), lambda t: F.struct(t["at"].alias("turn_index"), t["start"].alias("start"), t["length"].alias("length")))
    refs = F.flatten(F.transform("t", lambda t: F.transform(t["refs"], lambda r: F.struct(t["at"].alias("turn_index"), r["kind"].alias("kind"), r["ref"].alias("ref"), r["tokens"].alias("tokens")))))
    return chats.select(
        F.col("_conv").alias(conv_id),
        F.size("t").cast("long").alias("n_turns"),
        F.array_join(F.transform("t", lambda t: t["segment"]), "").alias("formatted"),
        spans.alias("loss_spans"),
        refs.alias("attachments"),
        F.aggregate("t", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array of (role, content, raw), raw being the content as it stands there."""
    segments = F.filter(F.split(formatted, r"<\|start\|>"), lambda s: s != "")
    return F.transform(
        segments,
        lambda s: F.struct(
            unescape(F.regexp_extract(s, r"(?s)^(.*?)<\|body\|>", 1)).alias("role"),
            unescape(F.regexp_extract(s, r"(?s)<\|body\|>(.*)<\|end\|>\n$", 1)).alias("content"),
            F.regexp_extract(s, r"(?s)<\|body\|>(.*)<\|end\|>\n$", 1).alias("raw"),
        ),
    )


def masked(turns: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask; null where a span is not as long as its turn's content."""
    one = lambda s: F.when(F.length(F.element_at(turns, s["turn_index"] + 1)["raw"]) == s["length"], F.element_at(turns, s["turn_index"] + 1)["content"])
    found = F.transform(spans, one)
    return F.when(~F.exists(found, lambda x: x.isNull()), F.array_join(found, ""))
