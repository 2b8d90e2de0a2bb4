"""Prefix trie of conversations by fixed-length block hashing.

A conversation is a sequence of turns; a turn is its role and text, of which only a digest and the
text's length travel. Four turns make a block. Blocks are grouped first: by the digest of all
that goes before them and their own. A block whose parent has no other block after it is one path:
its inner turns hold the members of the block, and none is compared. Only blocks with siblings
are refined: their distinct contents, no longer their conversations, are grouped turn by turn.

A prefix's digest is the exclusive or of 128-bit digests of its blocks, each hashed with its
place, so that prefixes of long conversations are summed by chunks, in no task's memory. Each node
belongs to its smallest member, so a conversation owns one run of depths of its own path, and a
node is named by (conversation, depth). Sums over subtrees run over the tree of such owners:
in round k each owner adds what the owners 2^k steps below it have gathered. Then a sum from the
deepest turn upwards gives each node its subtree.

Edge cases: a null role or text counts as empty. Turns go by their number, nulls first; equal
numbers by role, the first 32 characters of the text and its digest; repeated rows are turns of their own.
Rows without a conversation id belong to none and are left out. Texts are hashed whole, however
long. Without conversations there is no node, the root neither. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidebar.llm.common import let, saved

BLOCK = 4
# blocks or depths that a window handles at once
CHUNK = 1024
# ids that are joined to one text before they are hashed
ID_BITS = 16
HEAD_OF, HEAD_TURNS = 5, 9


def _before(w: Column | str, *keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy(w).rowsBetween(Window.unboundedPreceding, -1)


def ordered_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conv, at, digest, bytes) and the spans (conv, part, first, ahead, n) that turn ``at`` into a position.

    Rows are sorted by ranges, so a long conversation may lie in several parts; a span tells how
    many of its turns lie in earlier ones.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    narrow = saved(df.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.substring(text, 1, 32).alias("start"),
        F.unhex(F.sha2(whole, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
    ))
    order = ["conv", "turn", "role", "start", "digest"]
    turns = saved(narrow.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", F.monotonically_increasing_id().alias("at"), "digest", "bytes"))
    turns = turns.withColumn("part", F.shiftright("at", 33))
    spans = turns.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    return turns, spans.select("*", F.coalesce(F.sum("n").over(_before("part", "conv")), F.lit(0)).alias("ahead"))


def plain_rows(turns: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation as it is: (conv, pos, digest, bytes), pos from 1, and the ids (conv)."""
    rows = turns.join(spans, ["conv", "part"]).select("conv", (F.col("at") - F.col("first") + F.col("ahead") + 1).alias("pos"), "digest", "bytes")
    return rows, spans.select("conv").distinct()


def rebuilt_rows(turns: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with the head of another: the first h turns of conversation c - c % 5, then c's own after its first h.

    h is the CRC-32 of c in decimal modulo 9, and % keeps c's sign as SQL's does; a head is shorter where that conversation is, and
    empty where it doesn't exist.
    """
    lens = spans.groupBy("conv").agg(F.sum("n").alias("own"))
    convs = lens.select("conv", (F.col("conv") - F.col("conv") % HEAD_OF).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % HEAD_TURNS).alias("h"))
    bases = lens.where(F.col("conv") % HEAD_OF == 0).select(F.col("conv").alias("base"), F.col("own").alias("base_len"))
    convs = saved(convs.join(bases, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("base_len", F.lit(0))).alias("head")))
    placed = turns.join(spans.join(convs, "conv"), ["conv", "part"]).select(
        "conv", "base", "h", "head", (F.col("at") - F.col("first") + F.col("ahead") + 1).alias("pos"), "digest", "bytes"
    )
    placed = saved(placed)
    same = F.col("conv") == F.col("base")
    own = placed.where(same | (F.col("pos") > F.col("h"))).select("conv", F.when(same, F.col("pos")).otherwise(F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "digest", "bytes")
    # at most HEAD_TURNS - 1 rows of a conversation go to the HEAD_OF - 1 that follow it
    lent = placed.where(same & (F.col("pos") < HEAD_TURNS)).select("base", "pos", "digest", "bytes")
    heads = lent.join(convs.where(~same).select("conv", "base", "head"), "base").where("pos <= head").select("conv", "pos", "digest", "bytes")
    return own.unionByName(heads), convs.select("conv")


def _keys(turns: Column, k: Column) -> Column:
    """A 128-bit digest of each prefix of a block, hashed with the block's place."""

    def prefixes(hexes: Column) -> Column:
        def key(j: Column) -> Column:
            return let(F.array_join(F.slice(hexes, 1, j), ""), lambda s: F.struct(F.xxhash64(k, s).alias("x1"), F.xxhash64(F.lit(1), k, s).alias("x2")))

        return F.transform(F.sequence(F.lit(1), F.size(hexes)), key)

    return let(F.transform(turns, lambda t: F.hex(t["digest"])), prefixes)


def blocks(rows: DataFrame) -> DataFrame:
    """(conv, k, p1, p2, turns): each block with the digest before it and, per turn, (x1, x2, bytes), the digest up to it."""
    k = F.expr(f"(pos - 1) div {BLOCK}")
    cut = rows.withColumn("k", k).withColumn("chunk", F.expr(f"k div {CHUNK}")).repartition("conv", "chunk")
    made = cut.groupBy("conv", "chunk", "k").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("turns"))  # BLOCK turns at most
    made = made.select("conv", "chunk", "k", F.transform("turns", lambda t: t["bytes"]).alias("bytes"), _keys(F.col("turns"), F.col("k")).alias("keys"))
    last = F.element_at("keys", -1)
    w = _before("k", "conv", "chunk")
    made = made.select("*", *[F.coalesce(F.bit_xor(last[x]).over(w), F.lit(0).cast("long")).alias(p) for p, x in (("p1", "x1"), ("p2", "x2"))])
    made = saved(made)
    # what chunks hold together, for conversations of more than one
    full = made.where(F.col("k") % CHUNK == CHUNK - 1).select("conv", "chunk", F.col("p1").bitwiseXOR(last["x1"]).alias("s1"), F.col("p2").bitwiseXOR(last["x2"]).alias("s2"))
    upto = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    carry = full.select("conv", (F.col("chunk") + 1).alias("chunk"), F.bit_xor("s1").over(upto).alias("s1"), F.bit_xor("s2").over(upto).alias("s2"))
    far = made.where("chunk > 0").join(carry, ["conv", "chunk"]).withColumns({p: F.col(p).bitwiseXOR(F.col(s)) for p, s in (("p1", "s1"), ("p2", "s2"))})
    both = made.where("chunk = 0").unionByName(far.drop("s1", "s2"))
    joined = F.transform(F.arrays_zip("keys", "bytes"), lambda t: F.struct(t["keys"]["x1"].bitwiseXOR(F.col("p1")).alias("x1"), t["keys"]["x2"].bitwiseXOR(F.col("p2")).alias("x2"), t["bytes"].alias("bytes")))
    return both.select("conv", "k", "p1", "p2", joined.alias("turns"))


def _spread(groups: DataFrame) -> DataFrame:
    """A row for each turn of the given blocks, with its own key x and that of the turn before, u."""
    t, i = F.col("turns"), F.col("i")
    out = groups.select("*", F.posexplode("turns").alias("i", "t"))
    prior = F.get(t, i - 1)
    return out.select(
        (F.col("k") * BLOCK + i + 1).alias("depth"), "t.x1", "t.x2", F.coalesce(prior["x1"], "p1").alias("u1"), F.coalesce(prior["x2"], "p2").alias("u2"),
        "n", "conv", F.col("t.bytes").alias("bytes"),
    )


def keyed_nodes(made: DataFrame) -> DataFrame:
    """(depth, x1, x2, u1, u2, n, conv, bytes) of every node but the root; u is the parent's key, conv the least member."""
    last = F.element_at("turns", -1)
    groups = made.withColumns({"l1": last["x1"], "l2": last["x2"], "size": F.size("turns")})
    groups = saved(groups.groupBy("k", "p1", "p2", "l1", "l2", "size").agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.first("turns").alias("turns")))
    # the root's blocks are refined without asking; of others, those whose parent has several
    inner = groups.where("k > 0")
    parted = inner.groupBy("k", "p1", "p2").agg(F.count("*").alias("branches")).where("branches > 1")
    marked = saved(inner.join(parted, ["k", "p1", "p2"], "left").select(*groups.columns, F.col("branches").isNotNull().alias("parted")))
    refined = _spread(groups.where("k = 0").unionByName(marked.where("parted").drop("parted"))).groupBy("depth", "x1", "x2").agg(
        F.min("u1").alias("u1"), F.min("u2").alias("u2"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.min("bytes").alias("bytes")
    )
    return refined.unionByName(_spread(marked.where("not parted").drop("parted")))


def _gathered(owners: DataFrame, root: int) -> DataFrame:
    """Sums of ``leaves`` and ``saved`` over each owner's subtree, by doubling steps towards the root.

    A step adds what lies up to twice as far below; there are as many as the logarithm of the
    deepest chain of owners. The root's owner, above very many, needs no look-up.
    """
    state = saved(owners.select("conv", "up", "leaves", "saved"))
    while state.where("up is not null").limit(1).count():
        below = state.where("up is not null").groupBy(F.col("up").alias("conv")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        jump = state.where("up is not null").select(F.col("conv").alias("up"), F.col("up").alias("next"))
        moved = state.where(F.col("up") != root).join(jump, "up", "left").select("conv", "leaves", "saved", F.col("next").alias("up"))
        moved = moved.unionByName(state.where(F.col("up").isNull() | (F.col("up") == root)).select("conv", "leaves", "saved", F.lit(None).cast("long").alias("up")))
        state = saved(moved.join(below, "conv", "left").select("conv", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved")))
    return state


def trie(rows: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie over ``rows`` (conv, pos, digest, bytes; pos dense from 1) and where each of ``convs`` ends.

    Nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens. Ends:
    (member, conv_id, depth), the node that the member's last turn makes.
    """
    spark = rows.sparkSession
    total = convs.agg(F.count("*").alias("n"), F.min("conv").alias("conv")).collect()[0]  # one row
    if not total.n:
        return (
            spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"),
            spark.createDataFrame([], "member long, conv_id long, depth long"),
        )
    root = total.conv
    made = saved(blocks(rows))
    top = spark.createDataFrame([(0, 0, 0, None, None, total.n, root, 0)], "depth long, x1 long, x2 long, u1 long, u2 long, n long, conv long, bytes long")
    nodes = saved(top.unionByName(keyed_nodes(made)))
    worth = ((F.col("n") - 1) * F.col("bytes")).alias("saved")
    shared = nodes.where("n > 1").select((F.col("depth") + 1).alias("start"), F.col("x1").alias("u1"), F.col("x2").alias("u2"), F.col("conv").alias("up"))

    # the run of depths that each owner has, and the node above it
    runs = nodes.groupBy("conv").agg(F.min(F.struct("depth", "u1", "u2")).alias("t"), F.max("depth").alias("deepest"), F.sum(worth).alias("saved"))
    runs = saved(runs.select("conv", F.col("t.depth").alias("start"), "t.u1", "t.u2", "deepest", "saved"))
    hung = runs.where("start > 1").join(shared, ["start", "u1", "u2"]).select("conv", "start", "deepest", "saved", "up")
    first = runs.where("start <= 1").select("conv", "start", "deepest", "saved", F.when(F.col("start") == 1, F.lit(root)).alias("up"))
    runs = saved(hung.unionByName(first))
    kids = runs.where("up is not null").groupBy(F.col("up").alias("conv"), (F.col("start") - 1).alias("depth")).agg(F.count("*").alias("n"))
    ended = kids.select("conv", F.col("depth").alias("deepest"), F.lit(0).alias("none"))
    owners = runs.join(ended, ["conv", "deepest"], "left").select("conv", "up", F.coalesce("none", F.lit(1)).cast("long").alias("leaves"), "saved")
    sums = _gathered(owners, root)
    below = runs.where("up is not null").select("conv", "up", "start").join(sums.select("conv", "leaves", "saved"), "conv")
    below = below.groupBy(F.col("up").alias("conv"), (F.col("start") - 1).alias("depth")).agg(F.count("*").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))

    # nodes, their hanging subtrees and the parents of first nodes on one line per owner, cut in chunks
    none = F.lit(None).cast("long")
    zero = F.lit(0).cast("long")
    line = nodes.select("conv", "depth", "n", none.alias("up"), zero.alias("kids"), zero.alias("leaves"), worth)
    line = line.unionByName(below.select("conv", "depth", none.alias("n"), none.alias("up"), "kids", "leaves", "saved"))
    line = line.unionByName(runs.select("conv", F.col("start").alias("depth"), none.alias("n"), "up", zero.alias("kids"), zero.alias("leaves"), zero.alias("saved")))
    line = line.withColumn("chunk", F.expr(f"depth div {CHUNK}")).repartition("conv", "chunk")
    line = line.groupBy("conv", "chunk", "depth").agg(F.max("n").alias("n"), F.max("up").alias("up"), *[F.sum(c).alias(c) for c in ("kids", "leaves", "saved")])
    later = Window.partitionBy("conv").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, 0)
    deep = line.where("chunk > 0").groupBy("conv", "chunk").agg(F.max("depth").alias("deepest"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max_by("kids", "depth").alias("end_kids"))
    # an owner's last node is a leaf itself if nothing hangs from it; only its last chunk counts that
    final = F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("chunk"))) == 1
    deep = deep.withColumn("leaves", F.col("leaves") + F.when(final & (F.col("end_kids") == 0), 1).otherwise(0))
    carry = deep.select("conv", (F.col("chunk") - 1).alias("chunk"), F.sum("leaves").over(later).alias("c_leaves"), F.sum("saved").over(later).alias("c_saved"))
    w = Window.partitionBy("conv", "chunk").orderBy(F.desc("depth"))
    line = line.join(carry, ["conv", "chunk"], "left").withColumn("own", (F.lag("depth").over(w).isNotNull() | F.col("c_saved").isNotNull()).cast("long"))
    line = line.withColumn("leaf", F.when(F.col("kids") + F.col("own") == 0, 1).otherwise(0))
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    out = line.select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("up", "conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.col("kids") + F.col("own")).alias("n_children"),
        (F.sum(F.col("leaves") + F.col("leaf")).over(up) + F.coalesce("c_leaves", zero)).alias("n_leaves"),
        (F.sum("saved").over(up) + F.coalesce("c_saved", zero)).alias("saved_tokens"),
    )

    last = F.element_at("turns", -1)
    stops = made.groupBy("conv").agg(F.max(F.struct((F.col("k") * BLOCK + F.size("turns")).alias("depth"), last["x1"].alias("x1"), last["x2"].alias("x2"))).alias("e"))
    stops = stops.select(F.col("conv").alias("member"), "e.*")
    ends = stops.join(nodes.select("depth", "x1", "x2", F.col("conv").alias("conv_id")), ["depth", "x1", "x2"]).select("member", "conv_id", "depth")
    silent = convs.join(stops, convs["conv"] == stops["member"], "left_anti")
    return out, ends.unionByName(silent.select(F.col("conv").alias("member"), F.lit(root).alias("conv_id"), F.lit(0).cast("long").alias("depth")))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the texts of each (conv_id, depth) in the order they come, comma-joined; nothing but its state is held."""
    at, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([state.hexdigest()])], names=["conv_id", "depth", "ends_sha256"])

    for batch in batches:
        done = []
        for conv, depth, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (conv, depth) == at:
                state.update(b"," + ids.encode())
                continue
            if at is not None:
                done.append(row())
            at, state = (conv, depth), hashlib.sha256(ids.encode())
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if at is not None:
        yield row()


def with_ends_digest(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes with the SHA-256 of the ids that end there, ascending and comma-joined.

    Ids are joined by ranges of 2^ID_BITS first, so copies in their thousands go to the hash as
    few texts; a hash over one node's ids is a chain by its nature.
    """
    ranges = ends.groupBy("conv_id", "depth", F.shiftright("member", ID_BITS).alias("range")).agg(F.sort_array(F.collect_list("member")).alias("ids"))
    texts = ranges.select("conv_id", "depth", "range", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    sorted_texts = texts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "range").select("conv_id", "depth", "ids")
    made = sorted_texts.mapInArrow(_hashed, "conv_id long, depth long, ends_sha256 string")
    return nodes.join(made, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def conversation_trie(df: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and ends of the conversations as they are."""
    return trie(*plain_rows(*ordered_turns(df, **columns)))


def rebuilt_trie(df: DataFrame, **columns: str) -> DataFrame:
    """Nodes, with the digests of their ends, of the conversations rebuilt by ``rebuilt_rows``."""
    nodes, ends = trie(*rebuilt_rows(*ordered_turns(df, **columns)))
    return with_ends_digest(nodes, ends).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
