"""The trie of conversations' beginnings, by partition refinement: classes of equal beginnings are split turn by turn."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.spark_io import stored

#: A conversation takes over the first turns of that whose id ends its block of so many ids, and fewer than so many of them.
BLOCK, MOST = 5, 9
_TEXTLESS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # SHA-256 of nothing


def _taken(conv_id: Column) -> Column:
    """How many first turns a conversation takes over."""
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST


def turns_of(table: DataFrame) -> DataFrame:
    """(conv_id, pos, key, bytes): the turns numbered from 1, null turns first, ties by role and text; key is a SHA-256 of role and text.

    Rows without a conv_id are left out, null roles and texts are empty. Only keys go on: the texts move once, to be
    put in order.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = table.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("pos", F.row_number().over(order).cast("long")).select("conv_id", "pos", "key", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, key, bytes) of the rebuilt conversations, and (conv_id, len) of all of them, those without turns too.

    Conversation c has the first h turns of conversation c - c % 5, as far as there are so many, then its own after
    the h-th; h is the CRC-32 of c in decimal, modulo 9.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    heads = own.where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("of_base"))
    convs = own.withColumn("h", _taken(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).join(heads, "base", "left")
    convs = stored(convs.withColumn("first", F.least("h", F.coalesce("of_base", F.lit(0)))), "conversations")
    before = turns.where((F.col("pos") < MOST) & (F.col("conv_id") % BLOCK == 0)).withColumnRenamed("conv_id", "base")
    taken = before.join(convs.select("conv_id", "base", "h"), "base").where(F.col("pos") <= F.col("h")).select("conv_id", F.col("pos").alias("depth"), "key", "bytes")
    rest = turns.join(convs.select("conv_id", "h", "first"), "conv_id").where(F.col("pos") > F.col("h")).select("conv_id", (F.col("first") + F.col("pos") - F.col("h")).alias("depth"), "key", "bytes")
    return taken.unionByName(rest), convs.select("conv_id", (F.col("first") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len"))


def _alike(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, rep, len, copies): equal conversations go under the smallest id, found by two sums without carry of the turns' hashes."""
    marks = turns.groupBy("conv_id").agg(*[F.bit_xor(F.xxhash64(F.lit(seed), "depth", "key")).alias(f"mark{seed}") for seed in (1, 2)])
    marked = convs.join(marks, "conv_id", "left").select("conv_id", "len", *[F.coalesce(f"mark{s}", F.lit(0)).alias(f"mark{s}") for s in (1, 2)])
    by = ["len", "mark1", "mark2"]
    marked = stored(marked, "marks")
    return marked.join(marked.groupBy(*by).agg(F.min("conv_id").alias("rep"), F.count("*").alias("copies")), by).select("conv_id", "rep", "len", "copies")


def refined(turns: DataFrame, texts: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """The classes of each depth, those that one text alone is in with the depth they retire at, and where texts end.

    ``texts`` (rep, len, copies) are the different conversations. The class at depth 0 holds them all. At each depth
    the texts of the classes with two or more go on: each class is split by the next turn's key, its parts are named
    by their smallest id. A part with one text retires, its tail needs no splitting. So the rounds are as many as the
    longest beginning that two different conversations share, and each takes only the texts that still share one.
    """
    total = stored(texts.agg(F.min("rep").alias("conv_id"), F.sum("copies").alias("n_convs"), F.count("*").alias("texts")), "root")
    root = total.first()
    levels = [total.where("texts > 0").select("conv_id", F.lit(None).cast("long").alias("parent"), "n_convs", F.lit(0).cast("long").alias("bytes"), "texts")]
    retired, ended = [], []
    active = texts.select("rep", "len", "copies", F.lit(root["conv_id"]).cast("long").alias("cls"), F.lit(root["texts"] > 1).alias("open"))
    depth = 0
    while True:
        ended.append(active.where((F.col("len") == depth) & F.col("open")).select("rep", F.col("cls").alias("node"), F.col("len").alias("depth")))
        retired.append(active.where("NOT open").select("rep", "len", "copies", F.lit(depth).cast("long").alias("at")))
        going = active.where(F.col("open") & (F.col("len") > depth))
        if going.isEmpty():
            return levels, _union(retired), _union(ended)
        depth += 1
        next_turns = turns.where(F.col("depth") == depth).select(F.col("conv_id").alias("rep"), "key", "bytes")
        members = going.drop("open").join(next_turns, "rep")
        split = members.groupBy("cls", "key").agg(F.min("rep").alias("conv_id"), F.sum("copies").alias("n_convs"), F.min("bytes").alias("bytes"), F.count("*").alias("texts"))
        split = stored(split, f"classes-{depth}")
        levels.append(split.select("conv_id", F.col("cls").alias("parent"), "n_convs", "bytes", "texts"))
        named = split.select("cls", "key", F.col("conv_id").alias("new"), (F.col("texts") > 1).alias("open"))
        active = stored(members.join(named, ["cls", "key"]).select("rep", "len", "copies", F.col("new").alias("cls"), "open"), f"active-{depth}")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tails(turns: DataFrame, retired: DataFrame) -> DataFrame:
    """The nodes below retired classes, each an only child: (conv_id, depth, n_convs, n_children, saved_tokens, at)."""
    below = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    rows = turns.join(retired.where("len > at").withColumnRenamed("rep", "conv_id"), "conv_id").where(F.col("depth") > F.col("at"))
    saved = F.sum((F.col("copies") - 1) * F.col("bytes")).over(below)
    return rows.select("conv_id", "depth", F.col("copies").alias("n_convs"), (F.col("depth") < F.col("len")).cast("long").alias("n_children"), saved.alias("saved_tokens"), "at")


def folded(levels: list[DataFrame], tops: DataFrame) -> list[DataFrame]:
    """From the deepest classes up, what lies below each: the classes with n_children, n_leaves and saved_tokens.

    ``tops`` (parent, depth, saved_tokens) are the uppermost nodes of the tails.
    """
    below, out = None, []
    for depth in range(len(levels) - 1, -1, -1):
        chains = tops.where(F.col("depth") == depth + 1).select("parent", F.lit(1).cast("long").alias("n_leaves"), "saved_tokens")
        children = chains if below is None else chains.unionByName(below.select("parent", "n_leaves", "saved_tokens"))
        sums = children.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        level = levels[depth].join(sums.withColumnRenamed("parent", "conv_id"), "conv_id", "left")
        zero = lambda c, other=0: F.coalesce(c, F.lit(other).cast("long"))
        saved = (F.col("n_convs") - 1) * F.col("bytes") + zero("saved")
        level = level.select("conv_id", F.lit(depth).cast("long").alias("depth"), "parent", "n_convs", zero("n_children").alias("n_children"), zero("n_leaves", 1).alias("n_leaves"), saved.alias("saved_tokens"))
        below = stored(level, f"folded-{depth}")
        out.append(below)
    return out


def end_hashes(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256): SHA-256 of the ids of equal conversations, ascending, comma-joined.

    Most conversations have no copies: these need no shuffle. The ids of copies pass by in order and leave only the
    state of the hash, however many they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, state = None, None
        for b in batches:
            done = []
            for r, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if r != rep or state is None:
                    if state is not None:
                        done.append((rep, state.hexdigest()))
                    rep, state = r, hashlib.sha256(str(c).encode())
                else:
                    state.update(b",%d" % c)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in done], pa.int64()), pa.array([h for _, h in done])], ["rep", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()])], ["rep", "ends_sha256"])

    alone = members.where("copies = 1").select("rep", F.sha2(F.col("rep").cast("string"), 256).alias("ends_sha256"))
    several = members.where("copies > 1").select("rep", "conv_id").repartition("rep").sortWithinPartitions("rep", "conv_id")
    return alone.unionByName(several.mapInArrow(run, "rep long, ends_sha256 string"))


def trie(table: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), one per node.

    The table has conv_id, turn, role, text; other columns are ignored. A node is a sequence of first turns (role and
    text) of rebuilt conversations (``rebuilt``) and named by its smallest member and its depth. Null roles and texts
    count as empty, rows without a conv_id not at all; equal turns are put in order by role and text, so that repeated
    rows are turns each. Ids are taken modulo 5 as Spark does, with the sign of the id. An empty table has no nodes.

    Texts are told apart by a SHA-256 of role and text, and whole conversations by 128 bits over these. Conversations
    that are all the same are refined once, with their number. Each step is a table in the shared folder.
    """
    turns, convs = rebuilt(stored(turns_of(table), "turns"))
    turns = stored(turns.repartitionByRange("depth", "conv_id"), "rebuilt")
    members = stored(_alike(turns, convs), "members")
    texts = members.where("conv_id = rep").select("rep", "len", "copies")
    levels, retired, ended = refined(turns, texts)
    chains = stored(tails(turns, retired), "tails")
    tops = chains.where(F.col("depth") == F.col("at") + 1).select(F.col("conv_id").alias("parent"), "depth", "saved_tokens")
    inner = _union(folded(levels, tops)).withColumnRenamed("parent", "parent_conv_id")
    nodes = inner.unionByName(chains.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", "n_children", F.lit(1).cast("long").alias("n_leaves"), "saved_tokens"))
    ends = ended.unionByName(retired.select("rep", F.col("rep").alias("node"), F.col("len").alias("depth")))
    told = ends.join(end_hashes(members), "rep").select(F.col("node").alias("conv_id"), "depth", "ends_sha256")
    return nodes.join(told, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_TEXTLESS)))
