"""Chat formatting of typed content parts, and its inverse; DataFrame functions only.

A message is a role and an array of parts (type, text, uri, units).  A visitor over the parts writes
texts escaped and every other part as a placeholder <|kind:n|>, n counting the conversation's
attachments in order; the attachment's reference and its expanded token count (units times the kind's
rate) are kept beside the text.  A turn is <|turn|>role, a line feed, the body, <|end|> and a line
feed; "&", "<" and "[" inside texts are escaped, so no control string of this template or of a common
other one can occur in them, and roles escape line feeds too.

Cases: null texts and roles are empty; a null list of parts is an empty body; null units count as 1,
kinds without a rate as 0 tokens; null conversation ids form one conversation, null turns come first;
equal turns are ordered by role, then body; repeated rows stay; an empty table gives an empty result.
Other columns are ignored.  A conversation is one output row, so it must fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TURN, END = "<|turn|>", "<|end|>\n"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))
#: Expanded tokens for each unit: image tiles, seconds of audio, document pages.
RATES = {"image": 256, "audio": 25, "document": 512}


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def text_parts(text: str) -> Column:
    """A text column as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("long").alias("units")))


def format_chat(messages: DataFrame, rates: dict = RATES, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: tuple = ("assistant",)) -> DataFrame:
    """conv_id, formatted, n_turns, loss_spans (start, length in code points), attachments, expanded_tokens."""
    m = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(messages.schema[parts].dataType)).alias("parts"))
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    m = m.withColumn("media", F.filter("parts", lambda p: ~is_text(p)))
    m = m.withColumn("who", F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&nl;")))
    raw = F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "")
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", raw)
    before = order.rowsBetween(W.unboundedPreceding, -1)
    m = m.withColumn("seen", F.coalesce(F.sum(F.size("media")).over(before), F.lit(0)))
    nth = lambda p, i: (F.col("seen") + F.size(F.filter(F.slice("parts", 1, i + 1), lambda x: ~is_text(x)))).cast("string")
    visit = lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), p["type"], F.lit(":"), nth(p, i), F.lit("|>")))
    m = m.withColumn("body", F.array_join(F.transform("parts", visit), ""))
    m = m.withColumn("line", F.concat(F.lit(TURN), "who", F.lit("\n"), "body", F.lit(END)))
    m = m.withColumn("pos", F.row_number().over(order)).withColumn("start", F.coalesce(F.sum(F.length("line").cast("long")).over(before), F.lit(0)) + F.length("who") + len(TURN) + 1)
    rate = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])
    tokens = lambda p: F.coalesce(F.element_at(rate, p["type"]), F.lit(0)).cast("long") * F.coalesce(p["units"], F.lit(1))
    m = m.withColumn("media", F.transform("media", lambda p, i: F.struct((F.col("seen") + i + 1).alias("n"), p["type"].alias("kind"), p["uri"].alias("uri"), tokens(p).alias("tokens"))))
    rows = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line", F.col("role").isin(*learn).alias("learnt"), "start", F.length("body").cast("long").alias("length"), "media"))).alias("t"))
    spans = F.transform(F.filter("t", lambda x: x["learnt"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    media = F.flatten(F.col("t.media"))
    out = rows.select("conv_id", F.array_join("t.line", "").alias("formatted"), F.size("t").cast("long").alias("n_turns"), spans.alias("loss_spans"), media.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted conversation holds."""
    lines = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda x: x != "")
    bare = F.transform(lines, lambda x: F.substr(x, F.lit(len(TURN) + 1)))
    return F.transform(bare, lambda x: F.struct(unescape(F.replace(F.substring_index(x, "\n", 1), F.lit("&nl;"), F.lit("\n"))).alias("role"), unescape(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + 2)).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    said = F.array_join(F.transform(read_turns(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    rows = formatted.withColumn("said", said).withColumn("loss", loss).withColumn("n", F.size(read_turns(F.col("formatted"))).cast("long"))
    return rows.select("conv_id", F.col("n").alias("n_turns"), F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: The conversation that the query adds: a user's and an assistant's row saying another template's control strings.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("int"), "role", "text")
    probe = conversations.sparkSession.sql(f"SELECT CAST(-1 AS BIGINT) conv_id, turn, role, '{PROBE}' text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return rows.unionByName(probe)


DIGEST_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;')) + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), chr(10), '&nl;')) + {len(TURN) + 1 + len(END)}) AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
