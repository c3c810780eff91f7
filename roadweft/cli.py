"""Command line: python -m roadweft.cli COMMAND ..."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from roadweft.sources.lxd import convert_lxd
from roadweft.sources.recordings import read_recording


def from_osi(spark: SparkSession, a) -> None:
    read_recording(spark, a.input, a.validate, a.map_path).write(a.output)


def from_csv(spark: SparkSession, a) -> None:
    read_recording(spark, a.input, a.validate, a.odr).write(a.output)


def validate(spark: SparkSession, a) -> None:
    r = read_recording(spark, a.input, True)
    r.lanes().count()
    print(f"{a.input} is valid.")


def to_odr(spark: SparkSession, a) -> None:
    print(read_recording(spark, a.input).write_map(a.output or os.path.dirname(a.input) or "."))


def to_parquet(spark: SparkSession, a) -> None:
    read_recording(spark, a.input).write_parquet(a.output or f"{os.path.splitext(a.input)[0]}.parquet")


def attach_odr(spark: SparkSession, a) -> None:
    stem, suffix = os.path.splitext(a.input)
    read_recording(spark, a.input, map_path=a.odr).write(a.output or f"{stem}_with_odr{suffix}")


def from_lxd(spark: SparkSession, a) -> None:
    for r in convert_lxd(spark, a.input, a.output, a.skip_existing).collect():
        print(r["status"], r["file_path_input"], r["file_path_output"], r["error_message"])


#: (function, help, arguments); a trailing ? marks optional ones.
COMMANDS = {
    "from-osi": (from_osi, "a trace (.osi, .mcap) as a recording", ("input", "output", "--map-path", "--validate")),
    "from-csv": (from_csv, "a table (.csv) as a recording", ("input", "output", "--odr", "--validate")),
    "from-lxd": (from_lxd, "a folder of drone recordings as Parquet tables", ("input", "output", "--skip-existing")),
    "validate": (validate, "check a recording and its map", ("input",)),
    "to-odr": (to_odr, "take out the OpenDRIVE map", ("input", "output?")),
    "to-parquet": (to_parquet, "a recording as Parquet", ("input", "output?")),
    "attach-odr": (attach_odr, "put an OpenDRIVE map into a recording", ("input", "odr", "--output")),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="roadweft")
    commands = out.add_subparsers(required=True)
    for name, (run, text, arguments) in COMMANDS.items():
        p = commands.add_parser(name, help=text)
        p.set_defaults(run=run)
        for a in arguments:
            if a in ("--validate", "--skip-existing"):
                p.add_argument(a, action=argparse.BooleanOptionalAction, default=a == "--validate")
            elif a.startswith("--"):
                p.add_argument(a)
            else:
                p.add_argument(a.rstrip("?"), nargs="?" if a.endswith("?") else None)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName("roadweft").getOrCreate(), args)


if __name__ == "__main__":
    main()
