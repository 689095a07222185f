"""Command line: ``python -m contactlift ingest|score ...``.

ingest  SOURCE OUT [--raw-month M ...] [--schema DDL] [--upsert]
                                            delimited snapshots -> month partitions with day offsets; with a
                                            schema the text is read once; --upsert replaces the delivered
                                            months only and sets lines apart that do not parse
score   TRAIN APPLY OUT [--rounds N ...]    train profile A on a labelled parquet table, score the
                                            application table, write ranked probabilities,
                                            target ids and the importance table
"""

from __future__ import annotations

import argparse

from contactlift.session import build_session, ensure_checkpoint_dir


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="contactlift")
    sub = ap.add_subparsers(dest="cmd", required=True)
    ing = sub.add_parser("ingest")
    ing.add_argument("source")
    ing.add_argument("out")
    ing.add_argument("--raw-month", type=int, action="append", default=[])
    ing.add_argument("--schema", default=None, help="columns and types, as in a create table statement")
    ing.add_argument("--upsert", action="store_true")
    sc = sub.add_parser("score")
    sc.add_argument("train")
    sc.add_argument("apply")
    sc.add_argument("out")
    sc.add_argument("--rounds", type=int, default=300)
    sc.add_argument("--eta", type=float, default=0.04)
    sc.add_argument("--colsample", type=float, default=0.6)
    sc.add_argument("--cutoff", type=float, default=0.025)
    sc.add_argument("--id", default="id_cliente")
    ap.add_argument("--master", default=None, help="only for local runs; omit under spark-submit")
    args = ap.parse_args(argv)

    if args.master:
        spark = build_session(master=args.master)
    else:
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.getOrCreate()
        ensure_checkpoint_dir(spark)

    if args.cmd == "ingest":
        from contactlift.sources.files import ingest_snapshots, upsert_snapshots
        ingest = upsert_snapshots if args.upsert else ingest_snapshots
        for k, v in ingest(spark, args.source, args.out, args.raw_month, schema=args.schema).items():
            print(k, v)
    else:
        from contactlift.operators import boosting as BO
        from contactlift.operators.projections import feature_columns, label_from_class
        from contactlift.plans.trials import fit
        from contactlift.sources import files as IO

        train = label_from_class(IO.scan_columnar(spark, args.train))
        apply_ = IO.scan_columnar(spark, args.apply)
        feats = [c for c in feature_columns(train, args.id) if c in apply_.columns]
        f = fit(train, feats, BO.profile_a(args.eta, args.rounds, args.colsample))
        probs = f.predict(apply_, args.id, name="prob_positivo")
        IO.export_ranked_probs(probs, f"{args.out}/ranked", args.id)
        IO.export_target_ids(probs, f"{args.out}/ids", args.cutoff, args.id)
        IO.sink_delimited(f.importance_frame(spark), f"{args.out}/importance", line_sep="\r\n")
        print("written", args.out)


if __name__ == "__main__":
    main()
