"""python -m lexiloom STEP --option value ...: the steps of lexiloom.plans.tools; tables that a step returns are shown."""

from __future__ import annotations

import argparse
import inspect

from pyspark.sql import DataFrame, SparkSession

from lexiloom.plans import tools

STEPS = {
    "preprocess": tools.preprocess,
    "vocab": tools.vocab,
    "stats": tools.stats,
    "cooccurrence": tools.cooccurrence,
    "pca": tools.pca,
    "embeddings": tools.embeddings,
    "inference": tools.inference,
    "eval": tools.evaluation,
    "neighbors": tools.nearest,
}


def truth(text: str) -> bool:
    if text.lower() not in ("0", "1", "true", "false"):
        raise argparse.ArgumentTypeError("0 or 1 is needed")
    return text.lower() in ("1", "true")


def mapping(text: str) -> dict[str, str]:
    """name=path,name=path"""
    return dict(part.split("=", 1) for part in text.split(",") if part)


def parser() -> argparse.ArgumentParser:
    """Options are the parameters of the steps, with their defaults."""
    out = argparse.ArgumentParser(prog="lexiloom")
    steps = out.add_subparsers(dest="step", required=True)
    for name, step in STEPS.items():
        one = steps.add_parser(name, help=(step.__doc__ or "").split("\n")[0])
        for p in list(inspect.signature(step).parameters.values())[1:]:
            kind = {"bool": truth, "int": int, "float": float}.get(str(p.annotation), mapping if "Mapping" in str(p.annotation) else int if "int" in str(p.annotation) else str)
            needed = p.default is inspect.Parameter.empty
            one.add_argument("--" + p.name.replace("_", "-"), type=kind, required=needed, default=None if needed else p.default)
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None, rows: int = 1000) -> DataFrame | None:
    options = vars(parser().parse_args(arguments))
    step = STEPS[options.pop("step")]
    found = step(spark or SparkSession.builder.appName("lexiloom").getOrCreate(), **options)
    if found is not None:
        found.show(rows, truncate=False)
    return found


if __name__ == "__main__":
    main()
