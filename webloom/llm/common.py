"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from webloom.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[..., Callable], **kw) -> DataFrame:
    """mapInArrow over the named columns alone. ``make(**kw)`` runs once a task and gives a function from the
    columns' Python lists to a dict of the output's columns; one output batch per input batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(df.sparkSession)
    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make(**kw)
        for b in batches:
            got = f(*(c.to_pylist() for c in b.columns))
            yield pa.RecordBatch.from_arrays([pa.array(got[x.name], type=x.type) for x in out], schema=out)

    return df.select(*columns).mapInArrow(run, schema)


def unused(names: list[str], *wanted: str) -> list[str]:
    """Column names like those wanted that are not among names; names differ in more than case."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        name = f"_{w}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """The file of a public tokenizer; ``folder`` overrides the installed package's place."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
