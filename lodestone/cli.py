"""Run modes: python -m lodestone.cli MODE FOLDER [--dump PATH --pages PATH --projects PATH --settings FILE...]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans.build import DATABASE, WORK, build_from_files
from .plans.checkpoints import purge
from .plans.settings import load_settings

MODES = ("resume", "restart", "test", "clean", "purge")


def main(args: list[str] | None = None) -> list[str]:
    """clean removes work in progress, purge the database too; the others build, from the last checkpoint or (restart, test) from the start."""
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("mode", choices=MODES)
    p.add_argument("folder")
    p.add_argument("--dump")
    p.add_argument("--pages")
    p.add_argument("--projects", help="Parquet with project_id and lang")
    p.add_argument("--settings", nargs="*", default=[])
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if a.mode in ("clean", "purge"):
        return purge(spark, a.folder, WORK + (DATABASE if a.mode == "purge" else ()))
    if not (a.dump and a.pages and a.projects):
        p.error("a build needs --dump, --pages and --projects")
    build = build_from_files(spark, a.folder, a.dump, a.pages, spark.read.parquet(a.projects), load_settings(*a.settings), a.mode == "test")
    return build.run(resume=a.mode == "resume")


if __name__ == "__main__":
    print("ran:", ", ".join(main()) or "nothing")
