"""Recorded datasets on disk: layout, column roles, episode index, loading.

A dataset is a folder with ``data/`` parquet files, one per episode or shared, and optional ``meta/`` JSON.
Only footers and small JSON files are read on the driver; records always stay DataFrames. Any path that
Spark can read works for records; metadata is read through Spark too.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinegrain.operators.timeseries import clean_rows
from kinegrain.runtime import hadoop_path

# Names a column may have for each role, first match wins.
ROLE_NAMES = {
    "joint_state": ("observation.state", "joint_states", "state", "obs_state", "robot_state"),
    "joint_command": ("action", "joint_commands", "commands", "target_state", "desired_state"),
    "ee_pose": ("observation.ee_pose", "ee_pose", "cartesian_pose", "end_effector_pose", "eef_pose"),
    "gripper": ("observation.gripper", "gripper", "gripper_state", "gripper_opening", "grip", "gripper_ratio"),
    "timestamp": ("timestamp", "timestamps", "time", "t"),
    "episode_index": ("episode_index", "episode_id", "episode"),
    "frame_index": ("frame_index", "step_index", "timestep", "index"),
}
FROM_INFO = ("joint_state", "joint_command", "ee_pose", "gripper", "timestamp")


@dataclass
class DatasetSchema:
    path: str
    fps: float = 30.0
    n_episodes: int = 0
    layout: str = "unknown"
    keys: dict[str, str | None] = field(default_factory=dict)
    joint_dim: int = 0
    state_names: list[str] = field(default_factory=list)
    command_names: list[str] = field(default_factory=list)
    state_names_from: str = "missing"
    command_names_from: str = "missing"
    all_keys: list[str] = field(default_factory=list)
    files: list[str] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "files"}


def first_match(names: list[str], candidates: tuple[str, ...]) -> str | None:
    return next((c for c in candidates if c in names), None)


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = hadoop_path(spark, pattern)
    found = fs.globStatus(p)
    return sorted(str(s.getPath().toString()) for s in found) if found is not None else []


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop_path(spark, path)
    return fs.exists(p)


def _below(spark: SparkSession, root: str) -> list[str]:
    """All parquet files below a folder, at any depth."""
    fs, p = hadoop_path(spark, root)
    if not fs.exists(p):
        return []
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        name = str(it.next().getPath().toString())
        if name.endswith(".parquet"):
            found.append(name)
    return sorted(found)


def _text(spark: SparkSession, path: str) -> str | None:
    if not _exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def read_info(spark: SparkSession, root: str) -> dict:
    for place in (f"{root}/meta/info.json", f"{root}/info.json"):
        text = _text(spark, place)
        if text is not None:
            return json.loads(text)
    return {}


def discover_layout(spark: SparkSession, root: str) -> tuple[str, list[str]]:
    """per_episode before shared before any parquet; files of chunk folders before flat ones."""
    for name, stem in (("per_episode", "episode_*"), ("shared", "file-*")):
        files = _glob(spark, f"{root}/data/chunk-*/{stem}.parquet") + _glob(spark, f"{root}/data/{stem}.parquet")
        if files:
            return name, files
    files = _below(spark, f"{root}/data")
    return ("parquet", files) if files else ("unknown", [])


def _feature_names(info: dict, key: str | None, dim: int, stem: str) -> tuple[list[str], str]:
    if not key or dim <= 0:
        return [], "missing"
    names = (info.get("features") or {}).get(key, {}).get("names")
    if isinstance(names, list) and names and isinstance(names[0], list):
        names = [n for group in names for n in group]
    if isinstance(names, list) and len(names) == dim:
        return [str(n) for n in names], "info_json"
    return [f"{stem}_{k}" for k in range(dim)], "generated"


def metadata_rows(spark: SparkSession, root: str) -> list[dict] | None:
    """Rows of episodes.jsonl or episodes.json (a list, or a list under episodes, data or items); None without such a file."""
    for folder in (f"{root}/meta", root):
        lines = _text(spark, f"{folder}/episodes.jsonl")
        if lines is not None:
            return [json.loads(x) for x in lines.splitlines() if x.strip()]
        whole = _text(spark, f"{folder}/episodes.json")
        if whole is not None:
            data = json.loads(whole)
            if isinstance(data, dict):
                data = next((data[k] for k in ("episodes", "data", "items") if isinstance(data.get(k), list)), [])
            return data
    return None


def episode_id_of(row: dict, number: int):
    return next((row[k] for k in ("episode_id", "episode_index", "id", "episode") if k in row), number)


def episode_length_of(row: dict) -> int | None:
    return next((row[k] for k in ("length", "num_frames", "num_steps", "size") if isinstance(row.get(k), int)), None)


def distinct_episodes(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct ids of one column (only it is read)."""
    return df.select(F.col(f"`{column}`").alias("episode_id")).dropna().distinct().orderBy("episode_id")


def inspect_dataset(spark: SparkSession, root: str) -> DatasetSchema:
    """Roles, layout, rate, channel names and number of episodes of a dataset."""
    if not _exists(spark, root):
        raise FileNotFoundError(root)
    info = read_info(spark, root)
    layout, files = discover_layout(spark, root)
    if not files and not info:
        raise FileNotFoundError(f"{root} has neither parquet files nor info.json")
    s = DatasetSchema(path=root, fps=float(info.get("fps") or 30.0), layout=layout, files=files)
    first = spark.read.parquet(files[0]) if files else None
    s.all_keys = list(first.columns) if first is not None else []
    s.keys = {role: first_match(s.all_keys, names) for role, names in ROLE_NAMES.items()}
    if s.keys["joint_state"] is None:
        known = list((info.get("features") or {}).keys())
        for role in FROM_INFO:
            s.keys[role] = s.keys[role] or first_match(known, ROLE_NAMES[role])
    state = s.keys["joint_state"]
    if first is not None and state in s.all_keys:
        row = first.select(F.col(f"`{state}`")).first()
        if row is not None and row[0] is not None:
            s.joint_dim = len(row[0]) if isinstance(row[0], list) else 1
    s.state_names, s.state_names_from = _feature_names(info, state, s.joint_dim, "state")
    s.command_names, s.command_names_from = _feature_names(info, s.keys["joint_command"], s.joint_dim, "action")
    s.n_episodes = _count(spark, s, info)
    return s


def _count(spark: SparkSession, s: DatasetSchema, info: dict) -> int:
    rows = metadata_rows(spark, s.path)
    if rows:
        return len(rows)
    key = s.keys["episode_index"]
    ids = lambda: spark.read.parquet(*s.files).select(F.count_distinct(F.col(f"`{key}`"))).first()[0]
    if s.layout == "shared" and key in s.all_keys:
        return ids()
    if isinstance(info.get("total_episodes"), int):
        return info["total_episodes"]
    if s.layout == "per_episode":
        return len(s.files)
    return ids() if key in s.all_keys and s.files else 0


def _id_of_file(path: str):
    m = re.match(r"episode_(.+)\.parquet$", path.rsplit("/", 1)[-1])
    return (int(m[1]) if m[1].isdigit() else m[1]) if m else None


def list_episodes(spark: SparkSession, s: DatasetSchema) -> DataFrame:
    """episode_id, episode_num (null for names), length, metadata: distinct, numbers before names."""
    fields = T.StructType([T.StructField("episode_id", T.StringType()), T.StructField("length", T.IntegerType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])
    rows = metadata_rows(spark, s.path) or []
    meta = spark.createDataFrame([(str(episode_id_of(r, k)), episode_length_of(r), {a: str(b) for a, b in r.items()}) for k, r in enumerate(rows)], fields).dropDuplicates(["episode_id"])
    if s.layout == "per_episode":
        ids = spark.createDataFrame([(str(_id_of_file(f)),) for f in s.files], "episode_id string")
    elif s.files and s.keys["episode_index"] in s.all_keys:
        ids = distinct_episodes(spark.read.parquet(*s.files), s.keys["episode_index"]).select(F.col("episode_id").cast("string"))
    else:
        ids = meta.select("episode_id")
    out = ids.distinct().join(meta, "episode_id", "left").withColumn("episode_num", F.col("episode_id").try_cast("bigint"))
    return out.select("episode_id", "episode_num", "length", "metadata").orderBy(F.col("episode_num").asc_nulls_last(), "episode_id")


def _as_array(df: DataFrame, key: str) -> Column:
    c = F.col(f"`{key}`")
    return c.cast("array<double>") if isinstance(df.schema[key].dataType, T.ArrayType) else F.when(c.isNotNull(), F.array(c.cast("double")))


def load_frames(spark: SparkSession, s: DatasetSchema, episode_id: int | str | None = None, fill_policy: str | None = None) -> DataFrame:
    """Frames under the roles' names: episode_id, frame_idx, t, q, q_cmd, ee_pose, gripper.

    All files of an episode are read; a filter on the episode reaches the files. Without times they are
    frame number over fps. With a fill policy, gaps are filled forward and rows that still miss a value
    dropped.
    """
    if s.keys.get("joint_state") is None or s.keys["joint_state"] not in s.all_keys:
        raise KeyError("no joint state column")
    files = s.files
    if s.layout == "per_episode" and episode_id is not None:
        stems = [f"episode_{int(episode_id):06d}.parquet"] if str(episode_id).isdigit() else []
        stems.append(f"episode_{episode_id}.parquet")
        files = next(([f for f in s.files if f.rsplit("/", 1)[-1] == x][:1] for x in stems if any(f.rsplit("/", 1)[-1] == x for f in s.files)), [])
        if not files:
            raise FileNotFoundError(f"episode {episode_id}")
    df = spark.read.parquet(*files)
    key = s.keys["episode_index"]
    if key in df.columns:
        if episode_id is not None and s.layout != "per_episode":
            df = df.where(F.col(f"`{key}`") == episode_id)
        eid = F.col(f"`{key}`").cast("string")
    else:
        eid = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_name"), r"episode_(.+)\.parquet$", 1), r"^0+(?=\d)", "")
    frame = s.keys["frame_index"]
    ts = s.keys["timestamp"]
    ordered = F.row_number().over(Window.partitionBy("episode_id").orderBy(F.monotonically_increasing_id())) - 1
    d = df.withColumn("episode_id", eid)
    idx = F.col(f"`{frame}`").cast("bigint") if frame in df.columns else ordered.cast("bigint")
    if ts in df.columns:
        t = F.col(f"`{ts}`").cast("double")
    elif frame in df.columns:
        if s.fps <= 0:
            raise ValueError("fps must be positive")
        t = F.col(f"`{frame}`") / s.fps
    else:
        raise KeyError("neither a time nor a frame column")
    d = d.withColumn("frame_idx", idx).withColumn("t", t)
    out = [F.col("episode_id"), F.col("frame_idx"), F.col("t"), _as_array(df, s.keys["joint_state"]).alias("q")]
    for role, name in (("joint_command", "q_cmd"), ("ee_pose", "ee_pose"), ("gripper", "gripper")):
        k = s.keys[role]
        out.append((_as_array(df, k) if k in df.columns else F.lit(None).cast("array<double>")).alias(name))
    d = d.select(*out)
    return clean_vectors(d, fill_policy, [n for n, r in (("q", "joint_state"), ("q_cmd", "joint_command"), ("ee_pose", "ee_pose"), ("gripper", "gripper")) if s.keys[r] in df.columns]) if fill_policy else d


def clean_vectors(d: DataFrame, policy: str, vectors: list[str]) -> DataFrame:
    """Forward fill element by element within an episode and drop rows that still miss an element of any signal or the time."""
    row = d.agg(*[F.max(F.size(v)).alias(v) for v in vectors]).first()
    cells = {f"__{v}_{k}": F.try_element_at(v, F.lit(k + 1)) for v in vectors for k in range(row[v] or 0)}
    wide = clean_rows(d.withColumns(cells), ["episode_id"], "frame_idx", [*cells, "t"], policy)
    return wide.select(*[F.array(*[F.col(f"__{c}_{k}") for k in range(row[c] or 0)]).alias(c) if c in vectors else F.col(c) for c in d.columns])


def list_recorded(spark: SparkSession, root: str) -> DataFrame:
    """episode_id, length, metadata of the metadata's rows in the order of the file, repeated ones too; without such a file as ``list_episodes``."""
    rows = metadata_rows(spark, root)
    if rows is None:
        return list_episodes(spark, inspect_dataset(spark, root)).select("episode_id", "length", "metadata")
    if any(not isinstance(r, dict) for r in rows):
        raise ValueError("a row of the metadata is no object")
    made = [(k, str(episode_id_of(r, k)), episode_length_of(r), {a: str(b) for a, b in r.items()}) for k, r in enumerate(rows)]
    return spark.createDataFrame(made, "position bigint, episode_id string, length int, metadata map<string,string>").orderBy("position").drop("position")


def load_plain_episode(spark: SparkSession, root: str, episode_id: int | str) -> DataFrame:
    """An episode from ``data/episode_<id>`` as parquet, json or jsonl, with state and command; array archives aren't supported (KeyError)."""
    stem = f"{root}/data/episode_{episode_id}"
    if _exists(spark, f"{stem}.parquet"):
        df = spark.read.parquet(f"{stem}.parquet")
    elif _exists(spark, f"{stem}.json"):
        df = spark.read.json(f"{stem}.json", multiLine=True)
    elif _exists(spark, f"{stem}.jsonl"):
        df = spark.read.json(f"{stem}.jsonl")
    elif _exists(spark, f"{stem}.npz") or _exists(spark, f"{stem}.npy"):
        raise KeyError("joint_states")
    else:
        raise FileNotFoundError(stem)
    found = {r: first_match(df.columns, n) for r, n in (("q", ("joint_states", "observation.state", "state")), ("q_cmd", ("joint_commands", "action", "commands")), ("ee_pose", ("ee_pose", "observation.ee_pose", "cartesian_pose")))}
    for r in ("q", "q_cmd"):
        if found[r] is None:
            raise KeyError(r)
    return df.select(*[F.col(f"`{k}`").alias(r) for r, k in found.items() if k], F.lit(found["ee_pose"] is None).alias("needs_fk"))
