"""Commands over a folder of tables: python -m tagmill.cli COMMAND --data DIR --out DIR.

``fetch`` takes for --data a JSON file of document names, each with its addresses.

Only the argument parser is loaded before a command is known.
"""

from __future__ import annotations

import argparse
import sys

#: Command -> queries whose results it writes.
COMMANDS = {
    "verify": ("manifest_verify", "mirror_agreement"),
    "build": ("question_records", "questions_flat", "needs_review", "dq_checks", "tag_problems", "validation_summary"),
    "tag-vectors": ("zero_shot_topk", "knn_blend", "nested_cv_grid"),
    "tag-batches": ("cache_todo", "batch_assign", "prompt_block"),
    "evaluate": ("tagger_scores", "recall_at_k", "item_set_prf", "cohen_kappa", "tagger_agreement", "mcnemar", "tag_disagreements", "usage_cost"),
    "analyze": ("section_weightage", "cluster_weightage", "item_weightage", "type_mix", "yearly_coverage", "cooccurrence", "tag_sensitivity", "forecast_posterior", "forecast_backtest", "dirichlet_backtest"),
    "plan": ("unit_table", "mastery_update", "water_filling", "expected_secured", "build_weeks", "weekly_plan", "plan_notes"),
    "export": ("atlas_questions", "atlas_document"),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tagmill", description=__doc__)
    parser.add_argument("command", choices=sorted([*COMMANDS, "fetch"]))
    parser.add_argument("--data", required=True, help="folder of the tables, or for fetch the file of addresses")
    parser.add_argument("--out", required=True, help="folder for the results")
    parser.add_argument("--format", choices=("csv", "json", "parquet"), default="parquet")
    args = parser.parse_args(argv)
    if args.command == "fetch":
        import json

        from tagmill.sources.fetch import fetch_all

        with open(args.data, encoding="utf-8") as sources:
            print(f"{len(fetch_all(json.load(sources), args.out))} documents: {args.out}")
        return 0
    from tagmill.plans.catalogue import QUERIES
    from tagmill.session import local_session
    from tagmill.sources import files

    spark = local_session()
    for name in COMMANDS[args.command]:
        rows, path = QUERIES[name](spark, args.data), f"{args.out}/{name}"
        if args.format == "csv":
            files.write_csv(rows, path)
        elif args.format == "json":
            files.write_jsonl(rows, path)
        else:
            rows.write.mode("overwrite").parquet(path)
        print(f"{name}: {path}")
    if args.command == "build":
        from tagmill.operators.quality import passed

        return 0 if passed(QUERIES["dq_checks"](spark, args.data)).first()["passed"] else 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
