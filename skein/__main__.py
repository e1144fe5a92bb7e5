"""python -m skein COMMAND FOLDER: a thin command line over skein.api."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from skein import api


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="skein")
    parser.add_argument("command", choices=["list", "current", "diagnose", "tokens", "treat", "what-if", "strategy", "recap", "checkpoint", "doctor", "formulary", "guard", "reload", "init", "resolve"])
    parser.add_argument("folder", nargs="?")
    parser.add_argument("--session")
    parser.add_argument("--project")
    parser.add_argument("--text")
    parser.add_argument("--rx", default="standard")
    parser.add_argument("--name", help="operator for strategy")
    parser.add_argument("--thinking-mode", default="remove", choices=["remove", "truncate", "signature-only"])
    parser.add_argument("--protect-team", action="store_true")
    parser.add_argument("--write-to")
    parser.add_argument("--version", default="1")
    parser.add_argument("--configs")
    parser.add_argument("--state")
    parser.add_argument("--checkpoint")
    parser.add_argument("--hard-mb", type=float, default=50)
    parser.add_argument("--danger-mb", type=float, default=90)
    parser.add_argument("--settings", help="settings file, for doctor and init")
    parser.add_argument("--fix", action="store_true")
    parser.add_argument("--cwd")
    parser.add_argument("--rows", type=int, default=50)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("skein").getOrCreate()
    config = {"thinking_mode": given.thinking_mode}
    commands = {
        "list": lambda: api.list_sessions(spark, given.folder, given.project),
        "current": lambda: api.current_session(spark, given.folder, given.project, given.text),
        "diagnose": lambda: api.diagnose(spark, given.folder, given.session),
        "tokens": lambda: api.estimate_tokens(spark, given.folder, given.session),
        "treat": lambda: api.treat(spark, given.folder, given.rx, given.session, config, given.protect_team, given.write_to, given.version),
        "what-if": lambda: api.what_if(spark, given.folder, given.session),
        "strategy": lambda: api.run_strategy(spark, given.folder, given.name, given.session, config),
        "recap": lambda: api.recaps(spark, given.folder, given.session),
        "checkpoint": lambda: api.checkpoints(spark, given.folder, given.session, given.configs),
        "doctor": lambda: api.doctor(spark, given.folder, given.settings, os.name == "nt", given.fix),
        "reload": lambda: api.reload(spark, given.folder, given.session, given.write_to, given.rx, given.version),
        "resolve": lambda: api.resolve(spark, given.folder, given.session or "current", given.cwd or os.getcwd()),
        "formulary": lambda: api.formulary(spark),
    }
    if given.command == "guard":
        api.guard(spark, given.folder, given.state, given.checkpoint, given.hard_mb, danger_mb=given.danger_mb, prescription=given.rx).awaitTermination()
    elif given.command == "init":
        print("\n".join(api.init(given.settings)) or "nothing to add")
    else:
        commands[given.command]().show(given.rows, truncate=False)


if __name__ == "__main__":
    main()
