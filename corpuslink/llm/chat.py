"""Chat formatting of reply trees.

Messages point to their parents. Paths come from iterative self-joins with doubled steps. First every node learns
its distance and summed score from the root: after round k its pointer is 2**k ancestors up, so a thread of n turns takes log2(n) rounds
of one narrow row a node. Leaves are ranked by the score of their path before any path is written out; only the chosen ones are
enumerated, again by doubled steps, so work and rows grow with messages and chosen paths, not with leaves times depth. Each chosen path becomes
one conversation. A turn is formatted by itself, and turns are written and read back in order, one stream per conversation: no task holds a
conversation whole.

Template: ``[INST]`` user ``[/INST]``, ``<<SYS>>`` system ``<</SYS>>``, assistant ``</s>``, any other role
``[ROLE]`` role ``[AS]`` text ``[/ROLE]``. Inside texts and roles a backslash goes before each ``[``, ``<`` and backslash, so no control
string can begin there, and reading takes the backslashes away.

Defined results: null text and null role count as empty. In linear conversations repeated rows are turns of their own, in order of (turn, role, text).
In trees, of several rows with one (tree, node) the least by (parent, score, role, text) counts, nulls first; a null parent makes a root; messages whose
chain of parents never reaches a root (a missing parent or a cycle) belong to no path; a null score counts 0; of equal paths the one
of the smaller leaf wins. Trees may have any type that sorts. An empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

_BODY = r"((?:[^\[<\\]++|\\.)*+)"
TURN = re.compile(rf"\[INST\]{_BODY}\[/INST\]|<<SYS>>{_BODY}<</SYS>>|\[ROLE\]{_BODY}\[AS\]{_BODY}\[/ROLE\]|{_BODY}</s>", re.DOTALL)
_UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
#: Turns a bucket when the turns of one conversation are numbered.
TURNS = 4096


def distinct_nodes(messages: DataFrame) -> DataFrame:
    """(tree, node, up, score, role, text): the least row of each (tree, node)."""
    rest = F.struct("up", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), "role", "text")
    return messages.groupBy("tree", "node").agg(F.min(rest).alias("m")).select("tree", "node", "m.*")


def climbed(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Of nodes (tree, node, up, score): (tree, node, path_score, depth) of those that reach a root, depth 0 at the root; and the jump
    tables (tree, node, up) of 1, 2, 4 ... ancestors.

    A round that settles no further node ends it: the rest hang on a cycle. Those whose chain meets a missing parent drop out.
    """
    done = nodes.filter("up is null").select("tree", "node", F.col("score").alias("path_score"), F.lit(0).cast("long").alias("depth"))
    open_ = nodes.filter("up is not null").select("tree", "node", "up", "score", F.lit(1).cast("long").alias("steps"))
    done, open_, jumps = checkpointed(done), checkpointed(open_), []
    while (left := open_.count()) and (not jumps or left < before):
        before = left
        jumps.append(open_.select("tree", "node", "up"))
        on = lambda x: (F.col("o.tree") == F.col(f"{x}.tree")) & (F.col("o.up") == F.col(f"{x}.node"))
        settled = open_.alias("o").join(done.alias("d"), on("d")).select(
            "o.tree", "o.node", (F.col("o.score") + F.col("d.path_score")).alias("path_score"), (F.col("o.steps") + F.col("d.depth")).alias("depth")
        )
        further = open_.alias("o").join(open_.alias("p"), on("p")).select(
            "o.tree", "o.node", "p.up", (F.col("o.score") + F.col("p.score")).alias("score"), (F.col("o.steps") + F.col("p.steps")).alias("steps")
        )
        done, open_ = checkpointed(done.union(settled)), checkpointed(further)
    return done, jumps


def best_leaves(nodes: DataFrame, reached: DataFrame, per_tree: int) -> DataFrame:
    """(tree, leaf, depth, path_score): of each tree the ``per_tree`` leaves of highest path score."""
    inner = nodes.filter("up is not null").select("tree", F.col("up").alias("node")).distinct()
    leaves = reached.join(inner, ["tree", "node"], "left_anti").withColumnRenamed("node", "leaf")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf"))
    return leaves.withColumn("r", rank).filter(F.col("r") <= per_tree).select("tree", "leaf", "depth", "path_score")


def best_paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """(tree, leaf, node, place, path_score) of the ``per_tree`` root-to-leaf paths of highest score in each tree of distinct nodes; place counts
    from the root, 0."""
    nodes = checkpointed(messages.select("tree", "node", "up", "score"))
    reached, jumps = climbed(nodes)
    path = best_leaves(nodes, reached, per_tree).select("tree", "leaf", F.col("leaf").alias("node"), F.col("depth").alias("place"), "path_score")
    path = checkpointed(path)
    for k, jump in enumerate(jumps):
        more = path.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("place") - 2**k).alias("place"), "path_score")
        path = checkpointed(path.union(more))
    return path


def escaped(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"([\[<\\])", r"\\$1")


def formatted(role: Column, text: Column) -> Column:
    """One turn in the template."""
    t = escaped(text)
    return (
        F.when(role == "user", F.concat(F.lit("[INST]"), t, F.lit("[/INST]")))
        .when(role == "system", F.concat(F.lit("<<SYS>>"), t, F.lit("<</SYS>>")))
        .when(role == "assistant", F.concat(t, F.lit("</s>")))
        .otherwise(F.concat(F.lit("[ROLE]"), escaped(role), F.lit("[AS]"), t, F.lit("[/ROLE]")))
    )


def read_back(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of formatted text; raises ValueError on anything else."""
    at = 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError(f"not in the template at {at}")
        user, system, role, other, assistant = (None if g is None else _UNESCAPE.sub(r"\1", g) for g in m.groups())
        at = m.end()
        if user is not None:
            yield "user", user
        elif system is not None:
            yield "system", system
        elif role is not None:
            yield role, other
        else:
            yield "assistant", assistant


def digests(turns: DataFrame, partitions: int) -> DataFrame:
    """Per conversation, from formatted turns (tree, place, piece): what reading them back gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, state, kind_of_tree = None, None, None
        for batch in batches:
            done, kind_of_tree = [], batch.column(0).type
            for t, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or t != tree:
                    if state is not None:
                        done.append((tree, *state))
                    tree, state = t, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(piece)
                for role, text in read_back(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        state[2] += len(text)
                        state[3].update(text.encode())
            yield _rows(done, batch.column(0).type)
        if state is not None:
            yield _rows([(tree, *state)], kind_of_tree)

    kind = turns.schema["tree"].dataType.simpleString()
    ordered = turns.repartition(partitions, "tree").sortWithinPartitions("tree", "place").select("tree", "piece")
    return ordered.mapInArrow(run, f"tree {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _rows(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in done], kind), pa.array([r[1] for r in done], pa.int64()),
            pa.array([r[2].hexdigest() for r in done], pa.string()), pa.array([r[3] for r in done], pa.int64()),
            pa.array([r[4].hexdigest() for r in done], pa.string()), pa.array([r[5] for r in done], pa.int64()),
        ],
        names=["tree", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    )


def threads(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Linear conversations as reply trees: (tree, node, up, score, role, text), each turn (a whole number) a reply to the one before.

    Turns are counted in buckets of TURNS numbers, and rows are numbered inside theirs, so a long conversation is many tasks.
    The tree is a struct of the conversation's id, which joins where the id is null, too.
    """
    rows = conversations.select(F.struct(F.col(conv).alias("id")).alias("tree"), F.col(turn).cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(2**62))))
    counts = rows.groupBy("tree", "bucket").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.sum("n").over(Window.partitionBy("tree").orderBy("bucket")) - F.col("n")).drop("n")
    order = Window.partitionBy("tree", "bucket").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    known = rows.withColumn("i", F.row_number().over(order)).join(starts, ["tree", "bucket"])
    numbered = known.select("tree", (F.col("start") + F.col("i")).alias("node"), "role", "text")
    return numbered.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("up"), F.length(F.coalesce("text", F.lit(""))).cast("double").alias("score"), "role", "text"
    )


def conversations_formatted(messages: DataFrame, per_tree: int = 1, distinct: bool = False) -> DataFrame:
    """(tree, leaf, place, role, text, piece) of the best paths of ``messages`` (tree, node, up, score, role, text).

    ``distinct``: no (tree, node) is repeated and no score is null, so the rows need no look at that.
    """
    nodes = messages if distinct else distinct_nodes(messages)
    chosen = best_paths(nodes, per_tree)
    return chosen.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"]).select(
        "tree", "leaf", "place", "role", "text", formatted(F.col("role"), F.col("text")).alias("piece")
    )
