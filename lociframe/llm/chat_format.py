r"""Chat formatting on a prefix tree.

Conversations that begin with the same turns share them: a node is a turn
together with all turns before it, and a tree holds all conversations with the
same first turn. Each node's text is emitted once, in depth-first order of its
tree, with

* ``start``, ``length``: its place in the packed sequence of the tree (a token
  is a code point here; a tokenizer's count may be put in its place),
* ``position``: the position id of its first token, counted along its branch,
* ``attention``: the intervals of the packed sequence that hold its ancestors.
  A token may attend to these and to what precedes it in its own node; merged
  where they touch.

A turn is ``<|role|>\ntext<|end|>\n``. Control strings inside roles and texts
are broken by a backslash after their first character and backslashes are
doubled, so the original can be read back exactly.

Depth-first order needs no step per level: conversations are sorted by their
paths (a hash per turn, one path per conversation), and a node stands where the
first conversation that holds it stands, at its depth. A tree that a third of
all conversations share is spread over tasks. One conversation is one training
sequence and is handled as one value, in size proportional to its texts.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lociframe.llm.common import map_columns, table
from lociframe.session import written

NAME = "op3_chat_format"
LOSS_ROLE = "assistant"
_CONTROL = re.compile(r"<(?=\||/?s>|<SYS>)|\|(?=>)|\[(?=/?INST\])")
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<\|(.*?)\|>\n(.*?)<\|end\|>\n", re.S)
PROBE = "</s>[INST] ok [/INST]"

_LENGTH = " + ".join(
    [
        "length({0})",
        "length({0}) - length(replace({0}, '\\', ''))",
        *[
            f"(length({{0}}) - length(replace({{0}}, '{mark}', ''))) // {len(mark)}"
            for mark in ("<|", "|>", "<s>", "</s>", "<<SYS>", "[INST]", "[/INST]")
        ],
    ]
)
ORACLE_SQL = f"""
WITH turns AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum({_LENGTH.format("role")} + {_LENGTH.format("text")} + 13) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the span of its text inside; a null role or text counts as empty."""
    head, body = f"<|{escape(role)}|>\n", escape(text)
    return f"{head}{body}<|end|>\n", len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation; refuses anything else."""
    turns, at = [], 0
    while at < len(formatted):
        match = _TURN.match(formatted, at)
        if not match:
            raise ValueError(f"not a formatted turn at {at}")
        turns.append((unescape(match[1]), unescape(match[2])))
        at = match.end()
    return turns


@dataclass(frozen=True)
class Packed:
    """``nodes``: a row per node; ``branches``: a row per conversation: ``rank`` (its number), ``conv_id``, its last
    node and its nodes in order."""

    nodes: DataFrame
    branches: DataFrame


_NODE = (
    "node binary, parent binary, tree binary, depth int, role string, text string, "
    "length long, position long, loss_start long, loss_end long"
)


def _branches(conv_ids, turn_lists):
    """Each conversation with its nodes, from the root on, and its path."""
    out, paths = [], []
    for turns in turn_lists:
        node, path, position, branch = b"", bytearray(), 0, []
        for depth, turn in enumerate(turns):
            role, text = turn["role"] or "", turn["text"] or ""
            formatted, start, end = format_turn(role, text)
            parent, node = node, xxhash.xxh3_128_digest(node + len(role).to_bytes(8, "big") + (role + text).encode())
            path += node[:8]
            lost = role == LOSS_ROLE
            branch.append(
                {
                    "node": node,
                    "parent": parent or None,
                    "tree": branch[0]["node"] if branch else node,
                    "depth": depth,
                    "role": role,
                    "text": formatted,
                    "length": len(formatted),
                    "position": position,
                    "loss_start": start if lost else 0,
                    "loss_end": end if lost else 0,
                }
            )
            position += len(formatted)
        out.append(branch)
        paths.append(bytes(path))
    yield {"conv_id": conv_ids, "path": paths, "branch": out}


def _attention(leaves, chains):
    """The merged intervals of each node's ancestors, for the nodes that this leaf answers for."""
    nodes, spans = [], []
    for leaf, chain in zip(leaves, chains, strict=True):
        merged: list[tuple[int, int]] = []
        for step in chain:
            if step["owner"] == leaf:
                nodes.append(step["node"])
                spans.append([{"start": a, "end": b} for a, b in merged])
            start, end = step["start"], step["start"] + step["length"]
            if merged and merged[-1][1] == start:
                merged[-1] = (merged[-1][0], end)
            else:
                merged.append((start, end))
    yield {"node": nodes, "attention": spans}


def pack(conversations: DataFrame) -> Packed:
    """The prefix trees of all conversations (``conv_id``, ``turn``, ``role``, ``text``; others are ignored).

    Turns are ordered by ``turn``, ties by role and text, nulls first; repeated
    rows are repeated turns. A row without ``conv_id`` is a conversation of its
    own, as nothing says what it belongs to. An empty table gives empty results.
    """
    turn = F.struct("turn", "role", "text")
    named = conversations.filter("conv_id IS NOT NULL").groupBy("conv_id")
    gathered = named.agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    single = conversations.filter("conv_id IS NULL").select("conv_id", F.array(turn).alias("turns"))
    fields = ", ".join(f"{name}: {kind}" for name, kind in (part.split() for part in _NODE.split(", ")))
    conv_type = conversations.schema["conv_id"].dataType.simpleString()
    made = f"conv_id {conv_type}, path binary, branch array<struct<{fields}>>"
    formatted = map_columns(gathered.unionByName(single), ["conv_id", "turns"], made, _branches)
    # Numbered in the order of their paths; copies of one conversation may lie in several ranges.
    sorted_paths = formatted.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    placed = written(sorted_paths.withColumn("rank", F.monotonically_increasing_id()).drop("path"), "branches")
    branches = placed.select(
        "rank", "conv_id", F.element_at("branch.node", -1).alias("leaf"), F.col("branch.node").alias("nodes")
    )
    # Equal prefixes become one node; the first conversation that has it answers for it.
    every = placed.select(
        "rank", F.element_at("branch.node", -1).alias("leaf"), F.explode("branch").alias("n")
    ).select("rank", "leaf", "n.*")
    names = [part.split()[0] for part in _NODE.split(", ")]
    single = every.groupBy("node").agg(
        F.min(F.struct("rank", "leaf")).alias("first"), *[F.first(name).alias(name) for name in names if name != "node"]
    )
    single = single.select("*", "first.rank", F.col("first.leaf").alias("owner")).drop("first")
    # Depth-first order: ranges of it, sums per range and tree, then sums inside each range.
    ranged = written(
        single.repartitionByRange("tree", "rank", "depth").withColumn("range", F.spark_partition_id()), "nodes"
    )
    so_far = Window.partitionBy("tree").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        ranged.groupBy("tree", "range")
        .agg(F.sum("length").alias("total"))
        .select("tree", "range", F.coalesce(F.sum("total").over(so_far), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("tree", "range").orderBy("rank", "depth").rowsBetween(Window.unboundedPreceding, -1)
    numbered = written(
        ranged.join(before, ["tree", "range"])
        .withColumn("start", F.col("before") + F.coalesce(F.sum("length").over(inside), F.lit(0)))
        .drop("before", "range", "rank"),
        "nodes",
    )
    chains = branches.groupBy("leaf").agg(F.first("nodes").alias("nodes"))
    places = numbered.select("node", "owner", "start", "length")
    steps = (
        chains.select("leaf", F.posexplode("nodes").alias("at", "node"))
        .join(places, "node")
        .groupBy("leaf")
        .agg(F.sort_array(F.collect_list(F.struct("at", "node", "owner", "start", "length"))).alias("chain"))
    )
    attention = map_columns(
        steps, ["leaf", "chain"], "node binary, attention array<struct<start: long, end: long>>", _attention
    )
    return Packed(numbered.join(attention, "node").drop("owner"), branches)


def read_back(packed: Packed) -> DataFrame:
    """``conv_id`` with its formatted text and ``loss`` spans (code points), put together from the nodes of its branch."""
    steps = packed.branches.select("rank", "conv_id", F.posexplode("nodes").alias("at", "node"))
    kept = packed.nodes.select("node", "text", "position", "loss_start", "loss_end")
    turn = F.struct("at", "text", "position", "loss_start", "loss_end")
    whole = steps.join(kept, "node").groupBy("rank", "conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(
        F.filter("turns", lambda t: t["loss_end"] > t["loss_start"]),
        lambda t: F.struct(
            (t["position"] + t["loss_start"]).alias("start"), (t["position"] + t["loss_end"]).alias("end")
        ),
    )
    return whole.select("conv_id", F.array_join("turns.text", "").alias("formatted"), spans.alias("loss"))


def _digest(conv_ids, texts, losses):
    rows = []
    for text, spans in zip(texts, losses, strict=True):
        turns = parse_turns(text)
        lost = "".join(unescape(text[span["start"] : span["end"]]) for span in spans)
        rows.append(
            (
                len(turns),
                hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest(),
                len(lost),
                hashlib.sha256(lost.encode()).hexdigest(),
                len(text),
            )
        )
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    yield {"conv_id": conv_ids} | dict(zip(names, map(list, zip(*rows, strict=True)) if rows else [[]] * 5, strict=True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe -7, formatted, packed and read back."""
    kept = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], kept.schema)
    back = read_back(pack(kept.unionByName(probe)))
    schema = (
        f"conv_id {kept.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, "
        "loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return map_columns(back, ["conv_id", "formatted", "loss"], schema, _digest)
