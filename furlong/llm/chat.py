"""Chat formatting of reply trees, with DataFrame functions only.

Messages form trees: each has an id, the id of the message that it answers (NULL for a first one), a role, a text and a
score. Self-joins over ancestor links of doubling length list every path from a leaf to its root; the paths of a tree are
ranked by their mean score, and each chosen path becomes one conversation.

Template: ``<turn ROLE>TEXT</turn>\\n`` for each message. In roles and texts a backslash becomes ``\\b``, ``<`` becomes
``\\l`` and ``>`` becomes ``\\g``, so a text can't hold a marker and ``unescape`` restores it exactly. The loss mask is the
list of spans (start and length in code points of the formatted string) of the texts of assistant turns.

Cases: a NULL text or role is empty; a NULL score, or one that isn't a number, counts as 0. A parent that isn't in the tree
makes its reply a first message. Of messages that share tree and id one stays: that with the highest score, then the smallest
parent (NULL first), role and text. A message without an id is in no path, as nothing tells its repeats apart. Equal scores: the path with the
greater depth, then the smaller leaf id, is ranked first. A tree id that is NULL is a tree of its own. Messages on a cycle,
and those that hang on one, reach no root and are in no path. An empty table gives no conversation. Only the columns named
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furlong.llm import _common as common


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def _levels(links: DataFrame, messages: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """Links (tree, id, to, score of to) to the ancestors 1, 2, 4 ... steps above, each level written once, until none is left;
    and, where links never end, those of a level that is longer than any tree: they belong to messages that reach no root."""
    levels, step, longest = [common.cut(links)], 1, None
    while not levels[-1].isEmpty():
        if step >= 16 and longest is None:  # deep: from here on there might be a cycle
            longest = messages.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        if longest is not None and step >= longest:
            return levels[:-1], levels[-1]
        onward = levels[-1].select("tree", F.col("id").alias("to"), F.col("to").alias("far"), F.col("score").alias("far_score"))
        levels.append(common.cut(levels[-1].join(onward, ["tree", "to"]).select("tree", "id", F.col("far").alias("to"), F.col("far_score").alias("score"))))
        step *= 2
    return levels[:-1], None


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, id, up, score): every message on the way from each leaf to its root, how far above the leaf it is, its score.

    messages: tree, id, parent, score. Round k joins what is known so far with the links 2**k steps up, so a tree of depth d
    takes log2(d) rounds; each round writes only its new rows, and the work follows the rows of the result."""
    m = messages.select("tree", "id", "parent", "score")
    links = m.select("tree", "id", F.col("parent").alias("to")).join(m.select("tree", F.col("id").alias("to"), "score"), ["tree", "to"]).select("tree", "id", "to", "score")
    levels, endless = _levels(links, m)
    leaves = m.join(links.select("tree", F.col("to").alias("id")), ["tree", "id"], "left_anti")
    if endless is not None:
        leaves = leaves.join(endless, ["tree", "id"], "left_anti")
    reached = common.cut(leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up"), "score"))
    for k, level in enumerate(levels):
        further = reached.drop("score").join(level, ["tree", "id"]).select("tree", "leaf", F.col("to").alias("id"), (F.col("up") + (1 << k)).alias("up"), "score")
        reached = reached.unionByName(common.cut(further))
    return reached


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """One row for each chosen path: tree, leaf, rank, n_messages, formatted, loss_spans array<struct<start,length>>.

    messages: tree, id, parent, role, text, score; top: how many of the best paths of each tree. Texts move once the paths are
    chosen."""
    score = F.coalesce(F.nanvl(F.col("score").cast("double"), F.lit(0.0)), F.lit(0.0))
    m = messages.filter(F.col("id").isNotNull()).select(F.struct(F.col("tree").alias("v")).alias("tree"), "id", "parent", "role", "text", score.alias("score"))
    first = Window.partitionBy("tree", "id").orderBy(F.desc("score"), F.asc_nulls_first("parent"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    m = common.cut(m.withColumn("repeat", F.row_number().over(first)).filter("repeat = 1").drop("repeat"))  # read four times below
    way = paths(m)
    ranked = way.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.count("*").alias("n_messages"))
    best = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("n_messages"), "leaf"))).filter(F.col("rank") <= top)
    turn = F.concat(F.lit("<turn "), F.col("r"), F.lit(">"), F.col("t"), F.lit("</turn>\n"))
    rows = (
        way.drop("score").join(best.drop("mean"), ["tree", "leaf"])
        .join(m.select("tree", "id", "role", "text"), ["tree", "id"])
        .withColumns({"r": escape(F.col("role")), "t": escape(F.col("text"))})
        .withColumns({"turn": turn, "at": F.col("n_messages") - 1 - F.col("up")})
    )
    order = Window.partitionBy("tree", "leaf").orderBy("at")
    rows = rows.withColumn("begin", F.sum(F.length("turn")).over(order) - F.length("turn"))
    span = F.struct((F.col("begin") + F.length("r") + 7).cast("long").alias("start"), F.length("t").cast("long").alias("length"))
    parts = rows.groupBy("tree", "leaf", "rank", "n_messages").agg(F.sort_array(F.collect_list(F.struct("at", "turn", (F.col("role").eqNullSafe("assistant")).alias("loss"), span.alias("span")))).alias("parts"))
    loss = F.transform(F.filter("parts", lambda p: p.loss), lambda p: p.span)
    return parts.select(
        F.col("tree.v").alias("tree"), "leaf", "rank", "n_messages",
        F.array_join(F.transform("parts", lambda p: p.turn), "").alias("formatted"),
        loss.alias("loss_spans"),
    )


def turns(formatted: Column) -> Column:
    """array<struct<role, text>>, read back from a formatted conversation."""
    body = r"<turn ([^<>]*)>([^<>]*)</turn>\n"
    return F.arrays_zip(
        F.transform(F.regexp_extract_all(formatted, F.lit(body), F.lit(1)), unescape).alias("role"),
        F.transform(F.regexp_extract_all(formatted, F.lit(body), F.lit(2)), unescape).alias("text"),
    )


def masked(formatted: Column, spans: Column) -> Column:
    """The unescaped text under a loss mask, spans in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s.start + 1).cast("int"), s.length.cast("int")))), "")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    chain = told.unionByName(own).withColumn("id", number)
    messages = chain.select(F.col("conv_id").alias("tree"), "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))
    out = format_trees(messages)
    lines = F.transform(turns(F.col("formatted")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    out = out.select("tree", "formatted", lines.alias("lines"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return out.select(
        F.col("tree").alias("conv_id"),
        F.size("lines").cast("long").alias("n_turns"),
        F.sha2(F.array_join("lines", "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(role) + length(text) + 15
    + (length(role) - length(replace(replace(replace(role, '\', ''), '<', ''), '>', '')))
    + (length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '>', ''))) AS chars
  FROM told
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars
FROM joined
"""
