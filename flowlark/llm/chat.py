"""Chat formatting from reply trees, in DataFrame operations only.

Messages name their parent; iterative self-joins walk from every leaf towards its root, doubling the distance each time,
so a tree of depth d takes log2(d) joins. A first walk takes only each leaf's sum of scores and length to the root, which
rank the branches; a second one lists the messages of the best branches alone, and these are formatted.

A turn is written as ``### Role: text</turn>\\n``. Inside roles and texts the characters that markers are made of are
escaped: backslash, ``<``, ``#`` and ``:`` become ``\\b``, ``\\l``, ``\\h`` and ``\\c``. Escaped text holds none of the
three marker characters, so markers can be found by plain string search, and the escape is undone exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: Raw character, its escape. The backslash is first when escaping and last when reading back.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
HEAD, SEP, TAIL = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    for raw, code in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def linear_tree(turns: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees: each message answers the one before it.

    Order within a conversation is by turn, nulls last, then role and text; rows that agree in all of them are messages
    of their own. Null texts and roles are empty strings. A null conv_id is a conversation too. Very long texts stay whole;
    an empty table gives no messages; other columns are not read.
    """
    said = turns.select(F.col("conv_id").alias("tree_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(W.partitionBy("tree_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")).cast("long") - 1
    return said.withColumn("msg_id", place).select(
        "tree_id", "msg_id", F.when(F.col("msg_id") > 0, F.col("msg_id") - 1).alias("parent_id"), "role", "text", F.lit(0.0).alias("score")
    )


def _same(a: str, b: str, left: str, right: str) -> Column:
    return F.col(f"{a}.tree_id").eqNullSafe(F.col(f"{b}.tree_id")) & (F.col(f"{a}.{left}") == F.col(f"{b}.{right}"))


def _walks(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The jumps of 1, 2, 4, ... steps towards the root (tree_id, msg_id, to, gained: the scores of the messages left
    behind), and the leaves (tree_id, leaf_id) from which they get to a root.

    A message whose parent is null or missing is a root. Messages on a cycle, and leaves that hang on one, have no root
    and so no path. (tree_id, msg_id) must be unique; tree_id may be null.
    """
    known = messages.where("msg_id is not null").select("tree_id", "msg_id")
    jump = (
        messages.where("parent_id is not null and msg_id is not null")
        .alias("m")
        .join(known.alias("k"), _same("m", "k", "parent_id", "msg_id"), "left_semi")
        .select("tree_id", "msg_id", F.col("parent_id").alias("to"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("gained"))
    )
    jumps, most = [stored(jump, "reply-jumps")], messages.count()
    leaves = known.alias("m").join(jumps[0].alias("j"), _same("m", "j", "msg_id", "to"), "left_anti").select("tree_id", F.col("msg_id").alias("leaf_id"))
    while 1 << len(jumps) <= most and not jumps[-1].isEmpty():
        a, b = jumps[-1].alias("a"), jumps[-1].alias("b")
        further = a.join(b, _same("a", "b", "to", "msg_id")).select("a.tree_id", "a.msg_id", "b.to", (F.col("a.gained") + F.col("b.gained")).alias("gained"))
        jumps.append(stored(further, "reply-jumps"))
    if 1 << len(jumps) > most:  # what can still jump as far as there are messages never gets to a root
        leaves = leaves.alias("r").join(jumps[-1].alias("e"), _same("r", "e", "leaf_id", "msg_id"), "left_anti")
    return jumps, stored(leaves, "reply-leaves")


def _ranked(messages: DataFrame, jumps: list[DataFrame], leaves: DataFrame, branches: int) -> DataFrame:
    """The best leaves of each tree: tree_id, leaf_id, score, n_turns, branch. One row a leaf goes from jump to jump."""
    rows = leaves.withColumns({"at": F.col("leaf_id"), "score": F.lit(0.0), "n_turns": F.lit(1).cast("long")})
    for k in range(len(jumps) - 1, -1, -1):
        rows = rows.alias("r").join(jumps[k].alias("j"), _same("r", "j", "at", "msg_id"), "left").select(
            "r.tree_id", "r.leaf_id", F.coalesce("j.to", "r.at").alias("at"), (F.col("r.score") + F.coalesce("j.gained", F.lit(0.0))).alias("score"),
            (F.col("r.n_turns") + F.when(F.col("j.to").isNotNull(), 1 << k).otherwise(0)).alias("n_turns"),
        )
    roots = messages.select("tree_id", "msg_id", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("own"))
    whole = rows.alias("r").join(roots.alias("s"), _same("r", "s", "at", "msg_id")).select("r.tree_id", "r.leaf_id", (F.col("r.score") + F.col("s.own")).alias("score"), "r.n_turns")
    best = W.partitionBy("tree_id").orderBy(F.col("score").desc(), F.col("n_turns").desc(), "leaf_id")
    return whole.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)


def _expanded(jumps: list[DataFrame], leaves: DataFrame) -> DataFrame:
    """The leaves' paths as rows (tree_id, leaf_id, msg_id, up): from the longest jump on, each leaf's ancestors so far
    and those one jump further, so that each ancestor comes up once. Ids move through the joins, texts don't, and every
    row made is a row of the result."""
    rows = leaves.select("tree_id", "leaf_id", F.col("leaf_id").alias("msg_id"), F.lit(0).cast("long").alias("up"))
    for k in range(len(jumps) - 1, -1, -1):
        further = (
            rows.alias("r")
            .join(jumps[k].alias("j"), _same("r", "j", "msg_id", "msg_id"))
            .select("r.tree_id", "r.leaf_id", F.col("j.to").alias("msg_id"), (F.col("r.up") + (1 << k)).alias("up"))
        )
        rows = stored(rows.unionByName(further), "reply-rows") if k else rows.unionByName(further)
    return rows


def root_to_leaf_paths(messages: DataFrame) -> DataFrame:
    """The paths of every tree as rows (tree_id, leaf_id, msg_id, up): ``up`` counts the steps from the leaf, 0 at it.

    (tree_id, msg_id) must be unique, as ``linear_tree`` makes it: where it is repeated, each path through it is there once
    for every combination of its rows. A message whose parent isn't in its tree, or is null, is a root; an empty table
    gives no paths."""
    return _expanded(*_walks(messages))


def format_reply_trees(messages: DataFrame, branches: int = 1, loss_role: str = "assistant") -> DataFrame:
    """Each tree's best ``branches`` root-to-leaf paths as one formatted conversation each.

    messages: tree_id, msg_id, parent_id, role, text, score. Paths rank by the sum of their scores, ties by more
    messages and then the smaller leaf id. Returns tree_id, leaf_id, branch (from 1), score, n_turns, formatted and
    loss_spans: array of (start from 0, length) in code points of ``formatted``, one for each turn by ``loss_role``.
    Null scores count 0, null roles and texts are empty; very long texts are formatted whole, a conversation being one
    string; other columns are ignored; an empty table gives no rows.
    """
    jumps, leaves = _walks(messages)
    chosen = stored(_ranked(messages, jumps, leaves, branches), "reply-branches")
    said = messages.select("tree_id", "msg_id", "role", "text")
    paths = _expanded(jumps, chosen).alias("p").join(said.alias("s"), _same("p", "s", "msg_id", "msg_id"))
    paths = paths.select("p.tree_id", "p.leaf_id", "p.up", "s.role", "s.text")
    role, text = (escape(F.coalesce(F.col(x), F.lit(""))) for x in ("role", "text"))
    along = W.partitionBy("tree_id", "leaf_id").orderBy(F.col("up").desc())
    pieces = paths.select("tree_id", "leaf_id", "up", "role", F.concat(F.lit(HEAD), role, F.lit(SEP)).alias("head"), text.alias("body")).withColumn("piece", F.concat("head", "body", F.lit(TAIL)))
    pieces = pieces.withColumn("start", F.sum(F.length("piece")).over(along.rowsBetween(W.unboundedPreceding, 0)) - F.length("piece"))
    span = F.struct((F.col("start") + F.length("head")).alias("start"), F.length("body").cast("long").alias("length"))
    whole = pieces.groupBy("tree_id", "leaf_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda x: x["piece"]), "").alias("formatted"),
        F.array_sort(F.collect_list(F.when(F.col("role") == loss_role, span))).alias("loss_spans"),
    )
    return chosen.alias("c").join(whole.alias("w"), _same("c", "w", "leaf_id", "leaf_id")).select("c.tree_id", "c.leaf_id", "c.branch", "c.score", "c.n_turns", "w.formatted", "w.loss_spans")


def read_back(formatted: Column) -> Column:
    """The (role, text) turns that a formatted conversation was made from."""
    turns = F.split(formatted, TAIL)
    inner = lambda x: F.substring(x, F.lit(len(HEAD) + 1), F.length(x))
    coded = lambda x: F.substring_index(inner(x), SEP, 1)
    return F.transform(
        F.slice(turns, F.lit(1), F.size(turns) - 1),
        lambda x: F.struct(
            unescape(coded(x)).alias("role"),
            unescape(F.substring(inner(x), F.length(coded(x)) + (len(SEP) + 1), F.length(x))).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
