"""Command line: ``text`` cuts a text file's lines into segments, ``dataset`` segments a recorded dataset."""

from __future__ import annotations

import argparse
import csv
import json
import sys
from pathlib import Path


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinegrain")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("text")
    t.add_argument("--dataset-path", required=True)
    t.add_argument("--num-samples", type=int, default=10)
    t.add_argument("--seed", type=int, default=42)
    t.add_argument("--output", required=True)
    d = sub.add_parser("dataset")
    d.add_argument("--dataset", required=True)
    d.add_argument("--config")
    d.add_argument("--n-episodes", type=int)
    d.add_argument("--seed", type=int)
    d.add_argument("--modalities", nargs="+", default=["joint", "joint_command"])
    d.add_argument("--urdf")
    d.add_argument("--ee-frame")
    d.add_argument("--tolerance", type=float, default=5.0)
    d.add_argument("--output", required=True)
    return p


def save_text(rows: list[dict], output: str) -> None:
    path = Path(output)
    path.parent.mkdir(parents=True, exist_ok=True)
    if path.suffix == ".json":
        path.write_text(json.dumps(rows, indent=2))
    elif path.suffix == ".csv":
        with path.open("w", newline="") as f:
            w = csv.writer(f)
            w.writerow(["sample_id", "num_segments", "label_lengths"])
            w.writerows([r["sample_id"], r["num_segments"], json.dumps(r["label_lengths"])] for r in rows)
    else:
        raise ValueError(f"unknown output format {path.suffix!r}")


def run_text(spark, args) -> int:
    from kinegrain.sources.texts import segment_texts, text_lines

    lines = text_lines(spark, args.dataset_path, args.num_samples)
    # the number of samples bounds what comes back
    made = segment_texts(lines, "sample_id", "text", args.seed, per_row=False).join(lines, "sample_id").orderBy("sample_id").collect()
    rows = [{"sample_id": k, "text": r.text, "num_segments": r.num_segments, "label_lengths": dict(r.label_lengths), "segments": [s.asDict() for s in r.segments]} for k, r in enumerate(made)]
    try:
        save_text(rows, args.output)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
    print(f"{len(rows)} samples, {sum(r['num_segments'] for r in rows)} segments")
    return 0


def run_dataset(spark, args) -> int:
    """Schema report, boundaries, comparison tables, nested results and report of a dataset's (sampled) episodes.

    Sections of the YAML file: dataset, features, ruptures, sktime (enabled), ticc (enabled), kinematics (urdf, frame).
    """
    from pyspark.sql import functions as F

    from kinegrain.config import change_config, enabled, feature_config, modalities, primitive_config, read_yaml
    from kinegrain.functions.segmenters import AVAILABLE
    from kinegrain.operators.kernels import forward_kinematics
    from kinegrain.operators.report import boundary_strings, comparison_markdown, selected_ids_json, write_csv, write_json
    from kinegrain.operators.sampling import systematic_sample
    from kinegrain.plans.pipeline import mean_runtimes, method_rows, pipeline_summary, process_recordings, skipped
    from kinegrain.runtime import materialize
    from kinegrain.sources.datasets import inspect_dataset, list_episodes, load_frames

    cfg = read_yaml(args.config)
    out = Path(args.output)
    out.mkdir(parents=True, exist_ok=True)
    schema = inspect_dataset(spark, args.dataset)
    (out / "schema_report.json").write_text(json.dumps(schema.to_dict(), indent=2))
    if schema.n_episodes <= 0:
        print("no episodes")
        return 0
    own = cfg.get("dataset", {})
    n = args.n_episodes if args.n_episodes is not None else own.get("n_episodes", 5)
    seed = args.seed if args.seed is not None else own.get("seed", 42)
    chosen = systematic_sample(list_episodes(spark, schema), ["episode_num", "episode_id"], n, seed)
    (out / "selected_episode_ids.json").write_text(selected_ids_json(chosen))
    frames = load_frames(spark, schema, fill_policy="ffill_drop").join(chosen.select("episode_id"), "episode_id", "left_semi")
    names, notes = modalities(args.modalities)
    moves = cfg.get("kinematics", {})
    urdf, tip = args.urdf or moves.get("urdf"), args.ee_frame or moves.get("frame")
    if "cartesian" in names and schema.keys["ee_pose"] is None:
        if urdf and tip:
            frames = forward_kinematics(frames, "q", Path(urdf).read_text(), schema.state_names, tip)
        else:
            notes.append("cartesian: no pose column, and no model and frame to work it out")
    segmenters = AVAILABLE if enabled(cfg, "sktime") else ()
    primitive = primitive_config(cfg) if enabled(cfg, "ticc") else None
    frames = materialize(frames, "frames")
    parts = ["\n".join(["# Segmentation", "", f"{schema.path}: {schema.n_episodes} episodes, {n} chosen", "", *[f"- {x}" for x in notes]])]
    whole = None
    for m in names:
        channels = schema.command_names if m == "joint_command" else schema.state_names
        results = materialize(process_recordings(frames, "episode_id", "frame_idx", m, feature_config(cfg), change_config(cfg), primitive, segmenters, names=channels), f"results-{m}")
        whole = results if whole is None else whole.unionByName(results)
        found = method_rows(results, "episode_id")
        stats, pairs = pipeline_summary(found.withColumn("status", F.when(F.col("method").isNull(), "error").otherwise(F.col("status"))), "episode_id", None, args.tolerance)
        write_csv(stats.withColumn("modality", F.lit(m)), str(out / f"comparison_{m}.csv"))
        parts.append(f"# {m}\n\n" + comparison_markdown(stats, pairs, mean_runtimes(found), skipped(results)))
    if whole is not None:
        rows = method_rows(whole, "episode_id").withColumn("method", F.coalesce("method", F.lit(""))).withColumn("boundaries", F.coalesce("boundaries", F.array().cast("array<bigint>")))
        write_csv(boundary_strings(rows, ["episode_id", "modality", "status", "reason", "method"]), str(out / "boundaries.csv"))
        nested = whole.groupBy("episode_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("modality", F.struct(*[c for c in whole.columns if c not in ("episode_id", "modality")]))))).alias("modalities"))
        write_json(nested, str(out / "results.json"))
    parts.append("# Limits\n\n- Boundaries are positions on the resampled grid.\n- Agreement compares methods with each other, not with a truth.\n\n# Next\n\n- Look at recordings whose methods disagree.\n- Set a penalty where the elbow isn't clear.")
    (out / "report.md").write_text("\n\n".join(parts))
    return 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("kinegrain").getOrCreate()
    return (run_text if args.command == "text" else run_dataset)(spark, args)


if __name__ == "__main__":
    sys.exit(main())
