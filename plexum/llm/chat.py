"""Chat formatting over reply trees, in DataFrame operations only.

Messages name their parent. Iterative self-joins double the distance of each message's ancestor pointer, so a tree of
depth d takes log2(d) rounds. Leaves are ranked by the summed score of their path, ties by the smaller leaf; the chosen
leaves' paths are listed with the pointers of all rounds, and each path is formatted as one conversation.

Template: `<s>`, the turns, `</s>`. A user's turn is `[INST] text [/INST]`, an assistant's `[ANS] text [/ANS]`, any other
role's `[ROLE] role [SAYS] text [/ROLE]`. Inside texts and roles a backslash is doubled and a control string gets one
after its bracket, so that none is left; dropping the first of each pair of a backslash and a character restores the text.

Defined cases: null text or role counts as empty; a parent that is null or not in the tree makes a root; messages on a
cycle hang from no root and are on no path; a null tree is a tree of its own; a repeated (tree, node) counts once, the one
with the least (role, text, parent); an empty table gives no conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexum.llm.common import cut

BEGIN, END = "<s>", "</s>"
CONTROL = ("INST", "ANS", "ROLE", "SAYS")
_NAMES = "|".join(CONTROL)


def escape(text: Column) -> Column:
    """The text with no control string left in it."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, rf"\[(/?(?:{_NAMES})\])", r"[\\$1")
    return F.regexp_replace(text, r"<(/?s>)", r"<\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _same(a: str, b: str, *pairs: tuple[str, str]) -> Column:
    on = F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    for x, y in pairs:
        on = on & (F.col(f"{a}.{x}") == F.col(f"{b}.{y}"))
    return on


def pointers(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """nodes: tree, node, parent, score. First the ancestor pointers (tree, node, up) at distance 1, 2, 4, ...; then tree,
    node, depth and path score of every message that hangs from a root."""
    known = nodes.select("tree", F.col("node").alias("parent")).alias("k")
    now = cut(
        nodes.alias("n").join(known, _same("n", "k", ("parent", "parent")), "left")
        .select("n.tree", "n.node", F.col("k.parent").alias("up"), F.when(F.col("k.parent").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("n.score", F.lit(0.0)).cast("double").alias("total"))
    )
    steps, size = [], 1
    bound = now.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    at_root, live = now.where("up is null"), now.where("up is not null")
    while size <= bound and not live.isEmpty():  # only messages whose pointer has not come to a root go on
        steps.append(live.select("tree", "node", "up"))
        a, b = live.alias("a"), at_root.unionByName(live).alias("b")
        moved = cut(
            a.join(b, _same("a", "b", ("up", "node")), "left")
            .select("a.tree", "a.node", F.col("b.up").alias("up"), (F.col("a.depth") + F.coalesce("b.depth", F.lit(0))).alias("depth"), (F.col("a.total") + F.coalesce("b.total", F.lit(0.0))).alias("total"))
        )
        at_root, live = at_root.unionByName(moved.where("up is null")), moved.where("up is not null")
        size *= 2
    return steps, at_root.select("tree", "node", "depth", "total")


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """messages: tree, node, parent, role, text, score. A row for each turn of the `top` best paths of each tree: tree, leaf,
    rank (from 1), score (of the path), pos (from 0, the root), role, text."""
    own = (
        messages.groupBy("tree", "node")
        .agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "parent", "score")).alias("m"))
        .select("tree", "node", "m.*")
    )
    own = cut(own)
    steps, hung = pointers(own.select("tree", "node", "parent", "score"))
    parents = own.select("tree", F.col("parent").alias("node")).where("node is not null").distinct().alias("p")
    leaves = hung.alias("h").join(parents, _same("h", "p", ("node", "node")), "left_anti")
    order = Window.partitionBy("tree").orderBy(F.col("total").desc(), F.col("node").asc())
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    on_path = chosen.select("tree", F.col("node").alias("leaf"), "rank", F.col("total").alias("score"), "node", F.col("depth").alias("pos"))
    for k, step in enumerate(steps):
        jumped = on_path.alias("o").join(step.alias("s"), _same("o", "s", ("node", "node")))
        on_path = on_path.unionByName(jumped.select("o.tree", "o.leaf", "o.rank", "o.score", F.col("s.up").alias("node"), (F.col("o.pos") - 2**k).alias("pos")))
        on_path = cut(on_path)
    return on_path.alias("o").join(own.alias("m"), _same("o", "m", ("node", "node"))).select("o.tree", "o.leaf", "o.rank", "o.score", "o.pos", "m.role", "m.text")


def render(turns: DataFrame) -> DataFrame:
    """turns as of paths(). A row for each path: tree, leaf, rank, score, n_turns, formatted, and loss_spans: where in
    formatted, in characters, the escaped texts of assistants stand."""
    head = F.when(F.col("role") == "user", F.lit("[INST] ")).when(F.col("role") == "assistant", F.lit("[ANS] ")).otherwise(F.concat(F.lit("[ROLE] "), escape(F.col("role")), F.lit(" [SAYS] ")))
    tail = F.when(F.col("role") == "user", F.lit(" [/INST]")).when(F.col("role") == "assistant", F.lit(" [/ANS]")).otherwise(F.lit(" [/ROLE]"))
    before = Window.partitionBy("tree", "leaf", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    segments = (
        turns.withColumns({"head": head, "body": escape(F.col("text")), "tail": tail})
        .withColumn("segment", F.concat("head", "body", "tail"))
        .withColumn("at", F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)) + len(BEGIN))
        .withColumn("start", F.when(F.col("role") == "assistant", F.col("at") + F.length("head")))
    )
    rows = F.array_sort(F.collect_list(F.struct("pos", "segment", "start", F.length("body").alias("size"))))
    return (
        segments.groupBy("tree", "leaf", "rank").agg(F.min("score").alias("score"), rows.alias("rows"))
        .select(
            "tree", "leaf", "rank", "score", F.size("rows").cast("long").alias("n_turns"),
            F.concat(F.lit(BEGIN), F.array_join("rows.segment", ""), F.lit(END)).alias("formatted"),
            F.transform(F.filter("rows", lambda r: r["start"].isNotNull()), lambda r: F.struct(r["start"].alias("start"), (r["start"] + r["size"]).alias("stop"))).alias("loss_spans"),
        )
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and text."""
    pattern = F.lit(r"(?s)\[(INST|ANS|ROLE)\] (.*?) \[/\1\]")
    turns = F.arrays_zip(F.regexp_extract_all(formatted, pattern, F.lit(1)).alias("kind"), F.regexp_extract_all(formatted, pattern, F.lit(2)).alias("body"))
    other = r"(?s)^(.*?) \[SAYS\] (.*)$"

    def turn(t: Column) -> Column:
        kind, body = t["kind"], t["body"]
        role = F.when(kind == "INST", F.lit("user")).when(kind == "ANS", F.lit("assistant")).otherwise(unescape(F.regexp_extract(body, other, 1)))
        return F.struct(role.alias("role"), unescape(F.when(kind == "ROLE", F.regexp_extract(body, other, 2)).otherwise(body)).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """The best paths of every tree, formatted; see paths() and render()."""
    return render(paths(messages, top))
