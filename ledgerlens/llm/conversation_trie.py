"""The prefix trie of conversations that borrow their first turns from another one, without building their texts.

A conversation c is rebuilt from the first h turns of its base (the conversation c - c mod 20) and its own turns after the
first h, with h from a hash of c. Every distinct sequence of first turns is a node of a trie.

A sequence has the fingerprint (n, x): its length and sum(e_i * B**i) modulo a prime, with e_i from a digest of turn i. These
form a monoid, (n, x) * (m, y) = (n + m, x + B**n * y), in which a known head can also be taken off again. The fingerprint of a
rebuilt prefix is therefore put together from two numbers of the base and two of the conversation's own running product:
P_base(h) * own(h)**-1 * own(i). Texts are read once, for their digests; a row of the trie is (conversation, depth,
fingerprint, words, reference to the turn that it ends with). Two such sums stand side by side, 122 bits.

Rows with one fingerprint are a node. That is verified: the turns they refer to must have equal digests (then the prefixes
before them have equal fingerprints too, and so on up to the root), else everything is done again with other elements; and
different turns of one digest must have equal role and text.

Nothing walks the trie level by level. A node is counted at its smallest member: what lies below a node is the sum, over
its members, of what each holds from that depth on, and that is a running total along each conversation. Nodes of one
member, which are most, need no grouping. The digest of the ids that end at a node is inherently sequential; ids are joined
in pieces of bounded size first, and a task feeds pieces, not rows, to the hash.

Skew: a first turn that a third of all conversations share is a group that is folded per task; its facts come back by
broadcast. A conversation with very many turns is cut into ordered slices (`operators.skew`).

Awkward input: a missing role or text is empty; turns of one conversation with the same number, or without one (those come
first), are ordered by the SHA-256 of "length of role : role text"; repeated rows are turns of their own. Rows without conv_id
belong to no conversation and are left out. A conversation whose rebuilt form has no turn ends at the root. For a negative
conv_id the base is the next smaller multiple of 20. An empty table has no nodes, not even a root. Only the named columns
are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.frames import BROADCAST_ROWS, WORD, attach, materialise
from ledgerlens.operators.skew import measure, numbered, running, windowed

PRIME = (1 << 61) - 1
BASES = (0x0F0E_1D2C_3B4A_5968, 0x1357_9BDF_0246_8ACE)
#: Conversations 20 k .. 20 k + 19 share a base; a head has fewer than HEADS turns.
FAMILY, HEADS = 20, 4
#: Ids joined into one piece.
PIECE = 4096
#: Digest of no ids.
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _exact(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def _mod(value: Column) -> Column:
    """A decimal modulo the prime, as a long."""
    return F.pmod(value, F.lit(PRIME).cast("decimal(19,0)")).cast("long")


def digested(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """`conv_id, turn, digest, role, text` of all turns."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), r.alias("role"), t.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.where("conv_id is not null").select("conv_id", "turn", digest.alias("digest"), "role", "text")


def _products(turns: DataFrame, salt: int) -> DataFrame:
    """`conv_id, pos, digest, words, x0, x1`: every turn with the product of its conversation up to it."""

    @F.pandas_udf("x0 long, x1 long")
    def placed(a: pd.Series, b: pd.Series, pos: pd.Series) -> pd.DataFrame:
        """Elements times the base to the power of their place."""
        scaled = [[x * pow(base, p, PRIME) % PRIME for x, p in zip(e, pos)] for e, base in zip((a, b), BASES)]
        return pd.DataFrame({"x0": scaled[0], "x1": scaled[1]}, dtype="int64")

    slices = measure(turns, "conv_id", "turn")
    rows = numbered(turns, "conv_id", ["turn", "digest"], slices, "pos")
    elements = F.sha2(F.concat(F.lit(f"{salt}:"), F.hex("digest")), 256)
    e = [F.conv(F.substring(elements, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(2)]
    rows = rows.select("conv_id", "pos", "digest", "words", placed(*e, "pos").alias("p"))
    sums = {f"x{i}": ("sum", F.col(f"p.x{i}").cast("decimal(20,0)")) for i in range(2)}
    out = running(rows, "conv_id", "pos", sums, slices and slices.by_position(), peers=False)
    return out.select("conv_id", "pos", "digest", "words", *[_mod(F.col(f"x{i}")).alias(f"x{i}") for i in range(2)])


def _families(turns: DataFrame) -> DataFrame:
    """Per conversation: `n` own turns, `base`, `taken` turns of the base and `left` own ones, the `size` when rebuilt, the products
    of both heads and the turns of the base's head."""
    head = F.struct("x0", "x1", "words", "digest")
    heads = [F.max(F.when(F.col("pos") == i, head)).alias(f"t{i}") for i in range(1, HEADS)]
    per = turns.groupBy("conv_id").agg(F.max("pos").alias("n"), *heads)
    per = per.select("conv_id", "n", F.array(*[f"t{i}" for i in range(1, HEADS)]).alias("head"))
    asked = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    own = per.select("conv_id", "n", "head", asked.alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).alias("base"))
    bases = per.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"), F.col("head").alias("base_head"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0))).cast("int")
    out = own.join(bases, "base", "left").select("*", taken.alias("taken"), F.least("h", "n").cast("int").alias("left"))

    def product(heads: str, count: str, i: int) -> Column:
        return F.when(F.col(count) == 0, F.lit(0).cast("long")).otherwise(F.get(heads, F.col(count) - 1)[f"x{i}"])

    products = [product(h, c, i).alias(f"{side}{i}") for side, h, c in (("a", "base_head", "taken"), ("o", "head", "left")) for i in range(2)]
    used = F.slice("base_head", F.lit(1), F.col("taken")).alias("used")
    return out.select("conv_id", "n", "base", "taken", "left", (F.col("taken") + F.col("n") - F.col("left")).cast("long").alias("size"), *products, used)


def trie_rows(turns: DataFrame, salt: int = 0) -> DataFrame:
    """`conv_id, size, depth, x0, x1, words, digest, ref_conv, ref_pos`, a row for every depth of every rebuilt conversation."""
    own = materialise(_products(turns, salt))
    families = materialise(_families(own))
    zero = F.lit(0).cast("long")
    none = [F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("ref_conv"), F.lit(None).cast("long").alias("ref_pos")]
    roots = families.select("conv_id", "size", zero.alias("depth"), zero.alias("x0"), zero.alias("x1"), zero.alias("words"), *none)
    heads = families.select("conv_id", "size", "base", F.posexplode("used").alias("i", "t"))
    at = (F.col("i") + 1).cast("long")
    heads = heads.select("conv_id", "size", at.alias("depth"), "t.x0", "t.x1", "t.words", "t.digest", F.col("base").alias("ref_conv"), at.alias("ref_pos"))
    facts = families.select("conv_id", "n", "taken", "left", "size", "a0", "a1", "o0", "o1")
    tails = attach(own, facts, "conv_id", "n").where(F.col("pos") > F.col("left"))

    def moved(i: int) -> Column:
        """The product of the base's head and the own turns after theirs, which move from place `left` to `taken`."""
        back = F.element_at(F.array(*[F.lit(pow(BASES[i], -k, PRIME)).cast("decimal(19,0)") for k in range(HEADS)]), F.col("left") - F.col("taken") + 1)
        suffix = _mod(_exact(F.col(f"x{i}")) - _exact(F.col(f"o{i}")))
        return _mod(_exact(_mod(_exact(suffix) * back)) + _exact(F.col(f"a{i}")))

    depth = (F.col("taken") + F.col("pos") - F.col("left")).alias("depth")
    ref = [F.col("conv_id").alias("ref_conv"), F.col("pos").alias("ref_pos")]
    tails = tails.select("conv_id", "size", depth, moved(0).alias("x0"), moved(1).alias("x1"), "words", "digest", *ref)
    return roots.unionByName(heads).unionByName(tails)


NODE = ["depth", "x0", "x1"]


def shared_nodes(rows: DataFrame) -> DataFrame:
    """The nodes of several members: how many, the smallest, the largest size, the turns referred to."""
    ref = F.struct("ref_conv", "ref_pos")
    facts = [F.min("digest").alias("digest"), F.max("digest").alias("other_digest"), F.min(ref).alias("ref"), F.max(ref).alias("other_ref")]
    nodes = rows.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("first"), F.max("size").alias("deepest"), *facts)
    return nodes.where("n_convs > 1")


def _contents_agree(conversations: DataFrame, shared: DataFrame) -> bool:
    """Whether the different turns that one node refers to have equal role and text."""
    asked = materialise(shared.where("ref <> other_ref").select("digest").distinct())
    few = asked.count() <= BROADCAST_ROWS
    content = F.struct("role", "text")
    named = conversations.join(F.broadcast(asked) if few else asked, "digest", "left_semi")
    return named.groupBy("digest").agg(F.min(content).alias("a"), F.max(content).alias("b")).where("a <> b").isEmpty()


def _ends(rows: DataFrame) -> DataFrame:
    """Digest of the ascending ids of the conversations that end at a node, for `rows` of those ends."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = rows.groupBy(*NODE, F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(ids.alias("ids"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*NODE, "ends_sha256"])

        for batch in batches:
            for *now, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if now != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(out) > 50_000:
                yield given()
                out = []
        if node is not None:
            out.append((*node, state.hexdigest()))
        if out:
            yield given()

    dealt = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return dealt.mapInArrow(join, "depth long, x0 long, x1 long, ends_sha256 string")


def _placed(turns: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows of the trie, and its shared nodes, verified."""
    salt = 0
    while True:
        rows = materialise(trie_rows(turns, salt))
        shared = materialise(shared_nodes(rows))
        if shared.where("digest <> other_digest").isEmpty():
            break
        salt += 1  # two different prefixes have one fingerprint; never seen
    if not _contents_agree(contents, shared):
        raise ValueError("different turns have the same SHA-256")
    return rows, shared


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations.

    `conv_id` (smallest member), `depth`, `parent_conv_id` (smallest member of the parent), `n_convs` (members), `n_children`,
    `n_leaves` (childless nodes of its subtree), `saved_tokens` (words of last turns that need not be kept again, over the
    subtree) and `ends_sha256` (digest of the ids that end here).
    """
    contents = digested(conversations, conv_id, turn, role, text)
    turns = materialise(contents.select("conv_id", "turn", "digest", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")))
    rows, shared = _placed(turns, contents)

    node = F.struct(*NODE).alias("node")
    facts = shared.select(node, "n_convs", "first", "deepest")
    placed = materialise(attach(rows.select("conv_id", "size", "depth", "words", node), facts, "node", "n_convs"))
    one = F.col("n_convs").isNull()
    alone = placed.select(
        "conv_id", "size", "depth", "words", "node", (-F.col("depth")).alias("back"), F.coalesce("n_convs", F.lit(1)).alias("n_convs"),
        F.coalesce("first", "conv_id").alias("first"), F.coalesce("deepest", "size").alias("deepest"), one.alias("alone"),
    )
    counted = F.col("first") == F.col("conv_id")  # a node is counted at its smallest member
    leaf = counted & (F.col("depth") == F.col("size")) & (F.col("deepest") == F.col("depth"))
    slices = measure(alone, "conv_id", "back")
    near = windowed(
        alone.withColumn("counted", counted),
        "conv_id",
        "back",
        lambda w: {"child": F.coalesce(F.lag("counted").over(w).cast("long"), F.lit(0).cast("long")), "parent": F.lead("first").over(w)},
        before=1,
        after=1,
        slices=slices,
    )
    kept = F.when(counted, (F.col("n_convs") - 1) * F.col("words")).otherwise(0)
    below = running(near, "conv_id", "back", {"saved": ("sum", kept.cast("long")), "leaves": ("sum", leaf.cast("long"))}, slices, peers=False)
    below = materialise(below.select("conv_id", "size", "depth", "node", "n_convs", "first", "alone", "child", "parent", "saved", "leaves"))

    last = F.col("depth") == F.col("size")
    single = below.where("alone").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.col("child").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NO_ENDS).alias("ends_sha256"),
    )
    several = below.where("not alone")
    sums = [F.min("first").alias("conv_id"), F.max("parent").alias("parent_conv_id"), F.max("n_convs").alias("n_convs")]
    sums += [F.sum(c).alias(name) for c, name in (("child", "n_children"), ("leaves", "n_leaves"), ("saved", "saved_tokens"))]
    groups = several.groupBy("node.depth", "node.x0", "node.x1").agg(*sums)
    ends = _ends(several.where(last).select("node.*", "conv_id"))
    groups = groups.join(ends, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    return single.unionByName(groups.select(*single.columns))
