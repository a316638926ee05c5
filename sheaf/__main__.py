"""Command line: analyze, and profile build, show and reset."""

from __future__ import annotations

import argparse
import logging
import os
import sys

log = logging.getLogger("sheaf")


def load_env(path: str = ".env") -> None:
    """Settings of a file of ``NAME=value`` lines, for names that the environment does not have."""
    if not os.path.isfile(path):
        return
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, found, value = line.strip().removeprefix("export ").partition("=")
            if found and name.strip() and not name.lstrip().startswith("#"):
                value = value.strip()
                quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "\"'"
                os.environ.setdefault(name.strip(), value[1:-1] if quoted else value.split(" #")[0].rstrip())


def _readable(documents, most: int = 20):
    """Documents as they were read; a file that cannot be read stops the command."""
    bad = [r["error"] for r in documents.where("error is not null").limit(most).collect()]
    if bad:
        raise ValueError("\n".join(bad))
    return documents


def _numbered(rows, name: str):
    from pyspark.sql import functions as F

    return rows.select(F.xxhash64("path").alias(name), "text")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sheaf")
    commands = parser.add_subparsers(dest="command", required=True)
    analyze = commands.add_parser("analyze", help="compare CVs or saved profiles with jobs and write the results")
    analyze.add_argument("--cv", help="file or folder of CVs")
    analyze.add_argument("--job", required=True, help="file or folder of job descriptions")
    analyze.add_argument("--no-save-context", action="store_true")
    analyze.add_argument("--best", type=int, help="compare each job with so many profiles, those that share most of its skills, instead of all")
    profile = commands.add_parser("profile", help="manage saved profiles").add_subparsers(dest="action", required=True)
    build = profile.add_parser("build")
    build.add_argument("--cv", required=True)
    profile.add_parser("show")
    profile.add_parser("reset")
    for p in (analyze, build):
        p.add_argument("--provider")
        p.add_argument("--calls", type=int, default=8, help="model calls at a time")
        p.add_argument("--per-minute", type=float, help="model calls in a minute, over all tasks")
        p.add_argument("--answers", help="folder of answers, by which a run that broke off goes on without asking again")
    for p in (analyze, *profile.choices.values()):
        p.add_argument("--context", default="context/profiles")
    analyze.add_argument("--preferences", default="context/preferences.json")
    analyze.add_argument("--output", default=".")
    args = parser.parse_args(argv)
    load_env()
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    try:
        return run(args)
    except Exception as e:  # noqa: BLE001 - a command reports and ends with 1
        log.error("%s", e)
        return 1


def run(args) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from sheaf.operators.model_stage import Pace, create_provider
    from sheaf.plans import workflow as W
    from sheaf.sources import files, sinks

    spark = SparkSession.builder.appName("sheaf").getOrCreate()
    if args.command == "profile" and args.action == "reset":
        log.info("Deleted %s." if sinks.delete_if_exists(spark, args.context) else "No profile found at %s.", args.context)
        return 0
    if args.command == "profile" and args.action == "show":
        if not files.exists(spark, args.context):
            log.info("No profile found at %s.", args.context)
            return 0
        for row in files.load_profiles(spark, args.context).toLocalIterator():
            log.info("%s", row["error"] or sinks.pretty(row["data"]))
        return 0
    provider = create_provider(args.provider)
    pace = Pace(args.calls, args.per_minute, files.resolve(args.answers) if args.answers else None)
    if args.command == "profile":
        good, bad, _ = W.build_profiles(_numbered(_readable(files.read_documents(spark, args.cv)), "doc_id"), provider, pace=pace)
        sinks.save_profiles(good.select("doc_id", F.col("profile_json").alias("data")), args.context)
        log.info("Saved profiles to %s; %d could not be used.", args.context, bad.count())
        return 0
    jobs = _numbered(files.read_text(spark, args.job), "job_id")
    wishes = files.load_preferences(spark, args.preferences)
    if args.cv:
        out = W.analyze(spark, _numbered(_readable(files.read_documents(spark, args.cv)), "doc_id"), jobs, provider, wishes, best=args.best, pace=pace)
        if not args.no_save_context:
            sinks.save_profiles(out.profiles.select("doc_id", F.col("profile_json").alias("data")), args.context)
    else:
        saved = files.load_profiles(spark, args.context).where("error is null").select(F.xxhash64("path").alias("doc_id"), "data") if files.exists(spark, args.context) else None
        out = W.analyze(spark, None, jobs, provider, wishes, saved=saved, best=args.best, pace=pace)
    log.info("Wrote %d files; %d rows in quarantine.", W.write_run(out, args.output).count(), out.quarantine.count())
    return 0


if __name__ == "__main__":
    sys.exit(main())
