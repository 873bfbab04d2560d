"""Command line: build the reference's tables from observation / metadata
inputs (CSV with header, Parquet folders or catalog tables).

    python -m lcspark padded   --obs OBS --meta META --out OUT [--length 256] [--augment --seed 0]
    python -m lcspark flat     --obs OBS --meta META --test-obs TOBS --test-meta TMETA --out OUT [--copies 10]
    python -m lcspark train    --table FLAT_TABLE [--runs RUNS] [--length 256]
    python -m lcspark baseline --obs OBS --meta META --out OUT [--copies 25] [--extragalactic yes|no]

Observation inputs have object_id, mjd, passband, flux, flux_err, detected;
the order inside an object is (mjd, passband, flux, flux_err, detected)
unless --tie names other columns.
"""

from __future__ import annotations

import argparse
import json
import sys

from lcspark.schema import METADATA_SCHEMA, OBSERVATION_SCHEMA, TEST_METADATA_SCHEMA

DEFAULT_TIE = ["passband", "flux", "flux_err", "detected"]


def _load(spark, src: str, kind: str):
    from lcspark.sources import io as S
    if src.lower().endswith(".csv") or src.lower().endswith(".csv.gz"):
        if kind == "obs":
            return S.read_observations_csv(spark, src, OBSERVATION_SCHEMA)
        with_target = "target" in spark.read.option("header", True).csv(src).columns
        return S.read_metadata_csv(spark, src, METADATA_SCHEMA if with_target else TEST_METADATA_SCHEMA)
    return S.read_table(spark, src)


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="lcspark")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("padded", "flat", "baseline"):
        q = sub.add_parser(name)
        q.add_argument("--obs", required=True)
        q.add_argument("--meta", required=True)
        q.add_argument("--out", required=True)
        q.add_argument("--tie", default=",".join(DEFAULT_TIE))
        q.add_argument("--seed", type=int, default=0)
        q.add_argument("--length", type=int, default=256)
    sub.choices["padded"].add_argument("--augment", action="store_true")
    sub.choices["flat"].add_argument("--test-obs", required=True)
    sub.choices["flat"].add_argument("--test-meta", required=True)
    sub.choices["flat"].add_argument("--copies", type=int, default=10)
    sub.choices["baseline"].add_argument("--copies", type=int, default=25)
    sub.choices["baseline"].add_argument("--extragalactic", choices=["yes", "no"], default=None)
    t = sub.add_parser("train")
    t.add_argument("--table", required=True)
    t.add_argument("--runs", default=None)
    t.add_argument("--length", type=int, default=256)
    args = p.parse_args(argv)

    from lcspark.plans import programs
    from lcspark.session import program_session, size_session
    from lcspark.sources.io import input_bytes
    spark = program_session(f"lcspark-{args.cmd}")
    source = args.table if args.cmd == "train" else args.obs
    if "/" in source:
        size_session(spark, input_bytes(spark, source))
    out: dict = {"command": args.cmd}
    if args.cmd == "train":
        out["precision"] = programs.distributed_training(spark, args.table, args.runs, args.length).first()[0]
    else:
        tie = [c for c in args.tie.split(",") if c]
        obs, meta = _load(spark, args.obs, "obs"), _load(spark, args.meta, "meta")
        if args.cmd == "padded":
            out["table"] = programs.fifth_model_table(spark, obs, meta, tie, args.out, args.length,
                                                      augment=args.augment, seed=args.seed)
        elif args.cmd == "flat":
            tobs, tmeta = _load(spark, args.test_obs, "obs"), _load(spark, args.test_meta, "meta")
            out["tables"] = programs.flat_tables(spark, obs, meta, tobs, tmeta, tie, f"{args.out}/train",
                                                 f"{args.out}/test", args.copies, args.seed)
        else:
            eg = {None: None, "yes": True, "no": False}[args.extragalactic]
            out["tables"] = programs.baseline_program(spark, obs, meta, tie, args.out, args.length,
                                                      args.copies, args.seed, extragalactic=eg)
    print(json.dumps(out))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
