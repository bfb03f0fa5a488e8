"""Train, validation and test splits that keep related records together.

Ties are turned into stars (each member of a key to the key's smallest member), never into all pairs.
Connected components by hash-to-min: every node holds a cluster, at first itself and its neighbours;
in a round it sends the cluster to the cluster's minimum and the minimum to all of the cluster, until
nothing changes. Clusters are kept as rows (node, member), so no cluster is ever one value in one task,
and each round is written to the shared folder. A join on a node with a giant cluster is split by the
engine's handling of skewed joins, as the other side has one row per node.

Components go to splits by weighted rendezvous hashing: the split with the smallest
``-ln(u) / weight``, ``u`` a number in (0, 1) from the hash of component and split. Shares of frames hold
in expectation, and adding a split moves only what the new one takes.

Defined cases: keys that are null, or only say that nothing was recorded, tie nothing; ``derived_from``
null, negative or the episode itself ties nothing; an origin that is no episode itself still ties those
derived from it; repeated rows count once; rows without an episode number are left out; frames of
unlisted episodes are components of their own; weights of zero get nothing, and no positive weight raises
ValueError; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinegrain.runtime import materialize, release

# What, without case, blanks and punctuation, says that nothing was recorded.
NOTHING = (
    "", "na", "nan", "nil", "no", "none", "null", "nodata", "nothing", "norecord", "notapplicable", "notavailable", "notgiven", "notknown",
    "notrecorded", "notset", "missing", "tba", "tbc", "tbd", "todo", "undefined", "unknown", "unrecorded", "unset", "unspecified", "empty",
)

MOST_ROUNDS = 60


def tie_key(x: Column) -> Column:
    """Without case, blanks and punctuation; null where nothing was recorded."""
    k = F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", "")
    return F.when(~k.isin(*NOTHING), k)


def star_edges(members: DataFrame, node: str, key: str) -> DataFrame:
    """(a, b): each member of a key and the key's smallest member."""
    m = members.where(F.col(key).isNotNull()).select(F.col(node).alias("a"), F.col(key).alias("__k")).distinct()
    least = m.groupBy("__k").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    return m.join(least, "__k").where("a <> b").select("a", "b")


def components(edges: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) is tied to."""
    e = edges.select("a", "b").where("a is not null and b is not null")
    state = e.union(e.select("b", "a")).union(e.select("a", "a")).union(e.select("b", "b")).toDF("node", "member").distinct()
    state = materialize(state, "clusters")

    def digest(df: DataFrame) -> tuple:
        h = F.xxhash64("node", "member").cast("decimal(38,0)")
        return tuple(df.agg(F.count(F.lit(1)), F.sum(h)).first())

    seen = digest(state)
    for _ in range(rounds):
        least = state.groupBy("node").agg(F.min("member").alias("m"))
        sent = state.join(least, "node").select("m", "member")
        last, state = state, materialize(sent.select("member", "m").union(sent).toDF("node", "member").distinct(), "clusters")
        now = digest(state)
        # the round before is read no more, so the disk doesn't grow with the rounds
        release(last)
        if now == seen:
            return state.groupBy("node").agg(F.min("member").alias("component"))
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def episode_groups(episodes: DataFrame) -> DataFrame:
    """(episode_index, group): every episode and the smallest episode that it is tied to."""
    e = episodes.where(F.col("episode_index").isNotNull()).select(
        F.col("episode_index").cast("bigint").alias("episode_index"), tie_key(F.col("recording_id")).alias("rec"), tie_key(F.col("workpiece")).alias("work"), F.col("derived_from").cast("bigint").alias("origin")
    )
    derived = e.where("origin >= 0 and origin <> episode_index").select(F.col("episode_index").alias("a"), F.col("origin").alias("b"))
    found = components(star_edges(e, "episode_index", "rec").union(star_edges(e, "episode_index", "work")).union(derived))
    own = e.select("episode_index").distinct()
    placed = own.join(found.withColumnRenamed("node", "episode_index"), "episode_index", "left").withColumn("component", F.coalesce("component", "episode_index"))
    # an origin that is no episode must not be named as one
    first = placed.groupBy("component").agg(F.min("episode_index").alias("group"))
    return placed.join(first, "component").select("episode_index", "group")


def rendezvous(group: Column, weights: dict[str, float], seed: int = 0) -> Column:
    """Name of the split of ``group``."""
    live = {s: float(w) for s, w in weights.items() if w and w > 0}
    if not live:
        raise ValueError("no split has a positive weight")

    def score(s: str, w: float) -> Column:
        u = (F.pmod(F.xxhash64(group, F.lit(s), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        return -F.log(u) / w

    return F.array_min(F.array(*[F.struct(score(s, w).alias("score"), F.lit(s).alias("name")) for s, w in live.items()])).getField("name")


def split_frames(frames: DataFrame, episodes: DataFrame, weights: dict[str, float], seed: int = 0) -> DataFrame:
    """episode_index, frame_index, split of every distinct frame of ``frames`` (episode_index, frame_index)."""
    of = materialize(episode_groups(episodes), "groups").withColumn("split", rendezvous(F.col("group"), weights, seed))
    f = frames.select("episode_index", "frame_index").where("episode_index is not null and frame_index is not null").distinct()
    return f.join(of.select("episode_index", "split"), "episode_index", "left").withColumn("split", F.coalesce("split", rendezvous(F.col("episode_index"), weights, seed)))
