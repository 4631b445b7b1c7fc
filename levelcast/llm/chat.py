"""Chat formatting: every reply becomes an example with all turns before it as context."""

from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def escape(text):
    r"""'<|' becomes '<\|', '<\|' becomes '<\\|' and so on; nothing else changes."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text):
    r"""The inverse: one backslash less in every '<\...\|'."""
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def expand(conversations):
    """One training example per assistant turn.

    The example holds all turns up to and including the reply; only the reply's
    text is trainable, from code point `loss_start` on, `loss_chars` long. A
    conversation that does not end in a reply gives one more example, without
    trainable text, so that its last turns are in the output too.

    Returns conv_id, example (1, 2, ...), formatted, loss_start, loss_chars.
    NULL texts and roles are empty, roles are URL-encoded in the template. Turns
    are ordered by turn, then role and text, NULLs first; repeated rows are
    repeated turns. Rows without a conv_id form one conversation. Extra columns
    are ignored, an empty table gives no examples.

    The shuffle by conversation is the only one. A conversation is gathered into
    one row because its last example holds all of it anyway.
    """
    turns = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    turns = turns.withColumn(
        "head", F.concat(F.lit(OPEN), F.url_encode("role"), F.lit("\n"))
    ).withColumn("body", escape(F.col("text")))
    # NULL turns sort first: a flag, because struct ordering would do it silently.
    row = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "text", "head", "body")
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    rendered = F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE + "\n")))
    last = F.size("turns")
    ends = F.filter(
        F.sequence(F.lit(1), last),
        lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == last),
    )
    gathered = gathered.select("conv_id", "turns", rendered.alias("pieces"), ends.alias("ends"))
    examples = gathered.select("conv_id", "turns", "pieces", F.posexplode("ends").alias("example", "end"))
    target = F.element_at("turns", F.col("end"))
    is_reply = target["role"] == "assistant"
    context = F.array_join(F.slice("pieces", F.lit(1), F.col("end") - 1), "")
    examples = examples.select(
        "conv_id",
        (F.col("example") + 1).cast("bigint").alias("example"),
        context.alias("context"),
        F.element_at("pieces", F.col("end")).alias("piece"),
        F.length(target["head"]).alias("head"),
        F.when(is_reply, F.length(target["body"])).otherwise(0).alias("loss"),
    )
    return examples.select(
        "conv_id",
        "example",
        F.concat("context", "piece").alias("formatted"),
        (F.length("context") + F.col("head")).cast("bigint").alias("loss_start"),
        F.col("loss").cast("bigint").alias("loss_chars"),
    )


def trainable(formatted, loss_start, loss_chars):
    """The text under the loss mask, unescaped."""
    return unescape(F.substring(formatted, (loss_start + 1).cast("int"), loss_chars.cast("int")))


def parse(formatted):
    """The turns of a formatted example as an array of (role, text)."""
    pieces = F.split(formatted, r"<\|im_start\|>")
    pieces = F.slice(pieces, F.lit(2), F.size(pieces))
    cut = lambda p: F.instr(p, "\n")
    body = lambda p: F.substring(p, cut(p) + 1, F.length(p) - cut(p) - len(CLOSE) - 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(F.substring_index(p, "\n", 1)).alias("role"), unescape(body(p)).alias("text")
        ),
    )


def digest(examples):
    """What the examples of each conversation hold, read back from their text."""
    loss = trainable(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))
    read = examples.select("conv_id", "example", "formatted", loss.alias("loss"))
    whole = F.expr("max_by(formatted, example)")
    per = read.groupBy("conv_id").agg(
        whole.alias("whole"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("formatted")).cast("bigint").alias("formatted_chars"),
    )
    all_loss = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    per = per.select("conv_id", parse(F.col("whole")).alias("turns"), all_loss.alias("loss"), "formatted_chars")
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
