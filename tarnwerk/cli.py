"""A command line over the plans: ``python -m tarnwerk.cli COMMAND --config FILE --set section.key=value``.

The exit code is 0, or 1 if anything fails; the reason goes to the log, with its trace under ``--verbose``.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from .plans import catalogue, climate, stock
from .session import session
from .sources import files, sinks

LOG = logging.getLogger("tarnwerk")
#: What each command needs in its config.
NEEDED = {"deltas": ("source", "output"), "base-matrix": ("geometry", "airtightness", "u_values", "output"), "query": ("name", "tables")}


def read_config(path: str | None, overrides: Sequence[str] = ()) -> dict:
    """A JSON or YAML mapping with ``section.key=value`` overrides; values are JSON where they can be."""
    if path is None:
        config: dict = {}
    elif path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
    else:
        config = files.yaml(path)
    for item in overrides:
        name, sign, text = item.partition("=")
        if not sign or not name:
            raise ValueError(f"an override is section.key=value, not {item!r}")
        at = config
        *sections, last = name.split(".")
        for part in sections:
            at = at.setdefault(part, {})
            if not isinstance(at, dict):
                raise ValueError(f"{part!r} of {name!r} is a value, not a section")
        try:
            at[last] = json.loads(text)
        except ValueError:
            at[last] = text
    return config


def _table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def deltas(spark: SparkSession, config: Mapping) -> dict[str, DataFrame]:
    """Climatologies and monthly deltas of a daily table (scenario, timestamp, T_out_C, I_solar_W_m2)."""
    daily = _table(spark, config["source"])
    bounds = tuple(config.get("bounds", climate.ALPHA_BOUNDS))
    clim = climate.timeseries.climatology(daily, ["scenario"], "timestamp", {"T": "T_out_C", "I": "I_solar_W_m2"})
    found = climate.deltas_of(clim, config.get("baseline", "historical"), bounds)
    for name, df in (("monthly_climatologies", clim), ("monthly_deltas", found)):
        sinks.one_csv(df, f"{config['output']}/{name}.csv", ["scenario", "month"])
    return {"monthly deltas": found.select("scenario", "month", "delta", "alpha", "clipped").orderBy("scenario", "month")}


def base_matrix(spark: SparkSession, config: Mapping) -> dict[str, DataFrame]:
    """The archetype matrix of three class tables."""
    read = {k: files.csv(spark, config[k]) for k in ("geometry", "airtightness", "u_values")}
    out = stock.base_matrix(read["geometry"], read["u_values"], read["airtightness"])
    sinks.one_csv(out, config["output"], ["archetype_id"], general=12)
    return {"archetypes": out.select("archetype_id", "dwelling_type", "construction_period").orderBy("archetype_id")}


def query(spark: SparkSession, config: Mapping) -> dict[str, DataFrame]:
    """A query of the catalogue over a folder of tables."""
    if config["name"] not in catalogue.QUERIES:
        raise ValueError(f"no query {config['name']!r}; there are {', '.join(sorted(catalogue.QUERIES))}")
    out = catalogue.QUERIES[config["name"]](spark, config["tables"])
    if config.get("output"):
        out.write.mode("overwrite").parquet(config["output"])
    return {config["name"]: out}


COMMANDS: dict[str, Callable[[SparkSession, Mapping], dict[str, DataFrame]]] = {"deltas": deltas, "base-matrix": base_matrix, "query": query}


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tarnwerk", description="Scenario analytics on Spark.")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("--config", help="a JSON or YAML file")
    parser.add_argument("--set", action="append", default=[], metavar="section.key=value", help="override a value of the config")
    parser.add_argument("--verbose", action="store_true")
    given = parser.parse_args(arguments)
    logging.basicConfig(level=logging.DEBUG if given.verbose else logging.INFO, format="%(levelname)s %(name)s - %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    try:
        config = read_config(given.config, given.set)
        if missing := [k for k in NEEDED[given.command] if k not in config]:
            raise ValueError(f"the config lacks {', '.join(missing)}")
        print(sinks.console(COMMANDS[given.command](spark or session(), config)))
    except Exception as error:
        LOG.error("%s failed: %s", given.command, error, exc_info=given.verbose)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
