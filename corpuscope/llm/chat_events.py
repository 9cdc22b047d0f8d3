"""Chat formatting from event logs.

A log holds, per conversation, events ordered by ``seq``: ``message`` opens a message with a role and a first text, ``delta``
appends a streamed piece, ``edit`` replaces the text so far, ``regenerate`` starts the text anew. Logs are
partitioned by conversation and message, sorted by ``seq`` and folded into final messages: the last event that sets a text, then
the deltas after it. Final messages are rendered with a template that marks turns, and the spans of assistant text form the loss mask.

Template: ``<s>`` role ``[INST]`` text, then ``</s>`` after an assistant and ``[/INST]`` after any other role. In roles and texts ``\\``,
``<`` and ``[`` are written ``\\b``, ``\\l`` and ``\\i``; so no control string can come from a text and reading back is exact.

Cases: null texts and roles count as empty; a null conversation or message id is a conversation or message of its own; unknown
event kinds are ignored; a message without a ``message`` event has an empty role; deltas before the first setting event append to the
empty text; events equal in ``seq`` are ordered by kind and text; an empty log gives no rows. A conversation is rendered to one
string and so has to fit a row; messages are folded apart from each other, so a long conversation is not folded in one task. Work grows with the
length of a reply and with the number of turns, however many: replies are cut by one pattern, offsets are running sums, and the mask, which names its spans in
code points and in bytes, is read by bytes. Columns of other names are left out, whatever they are called. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuscope.functions.text import let

BEGIN, ROLE_END, TURN_END, REPLY_END = "<s>", "[INST]", "[/INST]", "</s>"
ASSISTANT = "assistant"
SETS = ("message", "edit", "regenerate")
PIECE, DRAFT = 400, 40


def escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\i"))


def unescape(c: Column) -> Column:
    out = F.replace(F.replace(c, F.lit("\\i"), F.lit("[")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\b"), F.lit("\\"))


def events_of(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """A log for whole turns (conv_id, turn, role, text), as a chat would have left it: a message event each; a reply streams in deltas of ``piece`` characters, after a first
    draft that is regenerated; other texts of even turns are sent as a draft and edited."""
    text = F.coalesce(turns["text"].cast("string"), F.lit(""))
    role = F.coalesce(turns["role"].cast("string"), F.lit(""))
    rows = turns.select(turns["conv_id"].alias("conv_id"), turns["turn"].alias("turn"), role.alias("role"), text.alias("text"))
    # equal rows are turns of their own: number the rows of one turn
    rows = rows.groupBy("conv_id", "turn", "role", "text").count()
    rows = rows.select("conv_id", "role", "text", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("again"), "turn")
    rows = rows.withColumn("message", F.struct("turn", "role", F.xxhash64("text").alias("hash"), "again"))
    event = lambda nth, kind, text: F.struct(nth.cast("int").alias("nth"), F.lit(kind).alias("kind"), (F.col("role") if kind == "message" else F.lit(None).cast("string")).alias("role"), text.alias("text"))
    draft = F.concat(F.left("text", F.lit(DRAFT)), F.lit(" ..."))
    found = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    pieces = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))
    reply = F.concat(F.array(event(F.lit(0), "message", F.lit("")), event(F.lit(1), "delta", draft), event(F.lit(2), "regenerate", F.lit(""))),
                     F.transform(pieces, lambda p, i: event(i + 3, "delta", p)))
    edited = F.array(event(F.lit(0), "message", draft), event(F.lit(1), "edit", F.col("text")))
    plain = F.array(event(F.lit(0), "message", F.col("text")))
    events = F.when(F.col("role") == ASSISTANT, reply).when(F.coalesce(F.col("turn") % 2 == 0, F.lit(False)), edited).otherwise(plain)
    log = rows.select("conv_id", "message", F.explode_outer(events).alias("e"))
    return log.select("conv_id", "message", F.struct("message", "e.nth").alias("seq"), "e.kind", "e.role", "e.text")


def fold(log: DataFrame) -> DataFrame:
    """Final messages (conv_id, seq of its first event, role, text) of a log (conv_id, message, seq, kind, role, text)."""
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    known = log.where(F.col("kind").isin(*SETS, "delta"))
    one = known.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(event)).alias("events"), F.min("seq").alias("seq"),
        F.max(F.when(F.col("kind").isin(*SETS), F.col("seq"))).alias("reset"))
    live = F.filter("events", lambda e: F.col("reset").isNull() | (e["seq"] >= F.col("reset")))
    opened = F.filter("events", lambda e: e["kind"] == "message")
    return one.select("conv_id", "seq", F.coalesce(F.get(opened, F.lit(0))["role"], F.lit("")).alias("role"),
                      F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Per conversation: ``conv_id``, ``formatted`` and ``loss`` (start and length of each assistant text, in code points and in bytes)."""
    reply = F.col("role") == ASSISTANT
    parts = messages.select("conv_id", "seq", F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(ROLE_END)).alias("head"), escape(F.col("text")).alias("body"), reply.alias("reply"))
    before = Window.partitionBy("conv_id").orderBy("seq", "head", "body", "reply").rowsBetween(Window.unboundedPreceding, -1)
    tail = F.when(F.col("reply"), F.lit(REPLY_END)).otherwise(F.lit(TURN_END))
    place = []
    for name, size in (("start", F.length), ("byte_start", F.octet_length)):
        whole = (size("head") + size("body") + size(tail)).cast("long")
        place.append((F.coalesce(F.sum(whole).over(before), F.lit(0)) + size("head")).alias(name))
    placed = parts.select("*", *place)
    turn = F.struct("seq", "head", "body", "reply", "start", "byte_start")
    one = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    shown = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.when(t["reply"], F.lit(REPLY_END)).otherwise(F.lit(TURN_END))))
    spans = F.transform(F.filter("turns", lambda t: t["reply"]), lambda t: F.struct(
        t["start"].alias("start"), F.length(t["body"]).cast("long").alias("length"), t["byte_start"].alias("byte_start"), F.octet_length(t["body"]).cast("long").alias("byte_length")))
    return one.select("conv_id", F.array_join(shown, "").alias("formatted"), spans.alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Adds ``turns`` (role, text) parsed from ``formatted``, and ``loss_text``: what lies under the mask, unescaped."""
    pattern = F.lit(r"<s>([^<\[]*)\[INST\]([^<\[]*)(?:</s>|\[/INST\])")
    roles, texts = (F.regexp_extract_all("formatted", pattern, F.lit(i)) for i in (1, 2))
    turns = F.transform(F.arrays_zip(roles.alias("role"), texts.alias("text")),
                        lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text")))

    def cut(data: Column) -> Column:
        return F.transform("loss", lambda s: unescape(F.substring(data, (s["byte_start"] + 1).cast("int"), s["byte_length"].cast("int")).cast("string")))

    under = let(F.col("formatted").cast("binary"), cut)
    return rendered.select("*", turns.alias("turns"), F.array_join(under, "").alias("loss_text"))
